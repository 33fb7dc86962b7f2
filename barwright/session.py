"""A session with the settings that the library's jobs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", app: str = "barwright", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
