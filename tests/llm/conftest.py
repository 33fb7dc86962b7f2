from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from {id: text}, or pairs where ids repeat, with an extra column of a clashing name."""

    def make(texts, lang=None, source=None):
        pairs = list(texts.items()) if isinstance(texts, dict) else list(texts)
        rows = [(i, t, (lang or {}).get(i, "en"), (source or {}).get(i, "s"), len(t or "")) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make
