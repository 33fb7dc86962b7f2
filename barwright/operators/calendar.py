"""Session arithmetic on a calendar table (date, session_no)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(dates: DataFrame, sessions: DataFrame, years_back: int = 2, look: int = 10) -> DataFrame:
    """dates(d) with last_session (latest on or before d), next_session (first on or after d, within `look` days) and
    years_ago (d minus years, 29 February becoming the 28th).

    An as-of join: dates and sessions in one ordered line per year-independent key would be one task, so every date
    meets only the sessions of its neighbourhood by an equality on a day number.
    """
    out = dates.withColumn("years_ago", F.add_months("d", -12 * years_back))
    near = dates.select("d").distinct().select("d", F.explode(F.sequence(F.date_sub("d", look), F.date_add("d", look))).alias("date"))
    hits = near.join(sessions.select("date"), "date").groupBy("d").agg(F.max(F.when(F.col("date") <= F.col("d"), F.col("date"))).alias("last_session"), F.min(F.when(F.col("date") >= F.col("d"), F.col("date"))).alias("next_session"))
    return out.join(hits, "d", "left").select("d", "last_session", "next_session", "years_ago")


def planned(samples: DataFrame, sessions: DataFrame, past: int, future: int = 0) -> DataFrame:
    """samples x sessions from `past` - 1 before asof_date to `future` after it: bar_date and t_rel (0 at asof_date).
    Samples without that many sessions go; an asof_date that is no session has none. The calendar is small and is
    broadcast when its size allows; session numbers are exploded, so no range join is needed."""
    n = sessions.agg(F.max("session_no").alias("_last"))
    at = samples.join(sessions.select(F.col("date").alias("asof_date"), F.col("session_no").alias("_s")), "asof_date").crossJoin(F.broadcast(n))
    at = at.where((F.col("_s") >= past - 1) & (F.col("_s") + future <= F.col("_last")))
    rows = at.withColumn("session_no", F.explode(F.sequence(F.col("_s") - (past - 1), F.col("_s") + future))).withColumn("t_rel", F.col("session_no") - F.col("_s"))
    return rows.join(sessions.select("session_no", F.col("date").alias("bar_date")), "session_no").drop("_s", "_last", "session_no")


def last_complete(sessions: DataFrame, today, now=None) -> DataFrame:
    """One row (end): the last session on or before `today` (a date). If that is today itself and `now` (a timestamp in UTC)
    is before 20:00 in New York, its bars aren't out yet and it is the session before, if one lies within ten days."""
    day = F.lit(today).cast("date")
    found = sessions.where(F.col("date") <= day)
    out = found.agg(F.max("date").alias("last"), F.max(F.when((F.col("date") < day) & (F.col("date") >= F.date_sub(day, 10)), F.col("date"))).alias("before"))
    if now is None:
        return out.select(F.col("last").alias("end"))
    early = (F.col("last") == day) & (F.hour(F.from_utc_timestamp(F.lit(now).cast("timestamp"), "America/New_York")) < 20)
    return out.select(F.when(early, F.coalesce("before", "last")).otherwise(F.col("last")).alias("end"))


def ingest_plan(sessions: DataFrame, existing: DataFrame, n: int | None = None, *, today=None, now=None, years: int | None = None) -> DataFrame:
    """(date, phase, step): which sessions to fetch, in order: the latest (phase 0), then missing ones from the newest on (1),
    then ones that exist already, to catch late corrections (2).

    Sessions end with the last complete one (last_complete) if `today` is given, and go back `years` (29 February becomes the
    28th) or `n` sessions.
    """
    if today is not None:
        end = last_complete(sessions, today, now)
        sessions = sessions.crossJoin(F.broadcast(end)).where(F.col("date") <= F.col("end"))  # one row
        if years is not None:
            sessions = sessions.where(F.col("date") >= F.add_months("end", -12 * years))
    last = sessions.select("date")
    if n is not None:
        last = last.orderBy(F.desc("date")).limit(n)
    newest = last.agg(F.max("date").alias("newest"))
    have = existing.select("date").distinct().withColumn("_have", F.lit(True))
    rows = last.join(have, "date", "left").crossJoin(F.broadcast(newest))
    phase = F.when(F.col("date") == F.col("newest"), 0).when(F.col("_have").isNull(), 1).otherwise(2)
    rows = rows.select("date", phase.alias("phase"))
    return rows.withColumn("step", F.row_number().over(Window.orderBy("phase", F.desc("date"))))
