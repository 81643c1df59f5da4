import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "size key class block row copies component fingerprint shard label list rank score word n held_out path".split()


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, lang[, source]]), with columns of clashing names."""

    def build(rows, parts=3):
        full = [(*r, *([None] * (4 - len(r))), len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, DOCUMENTS).repartition(parts)
        return frame.withColumns({c: F.lit("x") for c in CLASHING})

    return build


def table(frame, key):
    """Rows by key; a key that occurs twice fails."""
    rows = {r[key]: r.asDict() for r in frame.collect()}
    assert len(rows) == frame.count()
    return rows
