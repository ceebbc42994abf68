from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows], SCHEMA)

    return make


@pytest.fixture
def clash(docs):
    """Adds columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ("id", "fp", "root", "digest", "text_hash", "score", "size", "copies", "gram", "kept", "term", "spans", "target", "s", "h", "lang_pred", "n_tokens")
    return lambda df: df.withColumns({n: F.lit("x") for n in names})
