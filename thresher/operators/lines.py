"""Lines: normalization, samples, matched and unmatched parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thresher.functions.dialect import empty_map

# The characters Python's str.rstrip() removes.
WHITESPACE = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

SAMPLE_LINES = 12


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def normalize_lines(lines: DataFrame) -> DataFrame:
    """Add ``raw`` (no trailing whitespace) and ``transformed`` (single spaces)."""
    raw = strip_right(F.col("raw_line"))
    return lines.withColumn("raw", raw).withColumn(
        "transformed", F.regexp_replace("raw", " {2,}", " ")
    )


def sample_head(lines: DataFrame, count: int = SAMPLE_LINES) -> DataFrame:
    """The first non-empty raw lines of each source.

    Spark limits each task to ``count`` rows per source before the exchange, so a
    source with most of the lines sends no more than any other.
    """
    order = Window.partitionBy("source_id").orderBy("line_number")
    return (
        lines.filter(F.col("raw_line") != "")
        .select("source_id", "line_number", "raw_line")
        .withColumn("sample_no", F.row_number().over(order))
        .filter(F.col("sample_no") <= count)
    )


def unmatched_rows(assigned: DataFrame) -> DataFrame:
    """Result rows of the lines without a template: null id, no variables."""
    return assigned.filter(F.col("template_id").isNull()).select(
        "source_id",
        "line_number",
        F.lit(None).cast("string").alias("template_id"),
        empty_map().alias("variables"),
        "raw",
    )


def split_matched(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) parts of an assigned table."""
    found = F.col("template_id").isNotNull()
    return assigned.filter(found), assigned.filter(~found)


def unmatched_anomalies(assigned: DataFrame, examples: int = 5, width: int = 120) -> DataFrame:
    """Per source the number of unmatched lines, then the first few of them."""
    rest = assigned.filter(F.col("template_id").isNull())
    totals = rest.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source_id").orderBy("line_number")
    first = (
        rest.select("source_id", "line_number", "raw")
        .withColumn("anomaly_no", F.row_number().over(order))
        .filter(F.col("anomaly_no") <= examples)
    )
    return totals.select(
        "source_id",
        F.lit(0).alias("anomaly_no"),
        F.concat(
            F.col("n").cast("string"), F.lit(" lines remain unmatched after template learning")
        ).alias("anomaly"),
    ).unionByName(
        first.select(
            "source_id",
            "anomaly_no",
            F.concat(
                F.lit("Unmatched line "),
                F.col("line_number").cast("string"),
                F.lit(": "),
                F.substring("raw", 1, width),
            ).alias("anomaly"),
        )
    )


def ordered_results(*parts: DataFrame) -> DataFrame:
    """Matched, learned, re-matched and unmatched rows, ordered by line."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("source_id", "line_number")
