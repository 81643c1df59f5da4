"""Log files: numbered lines from text, and the parsed-rows text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A split's row in the offset table is a path and three numbers.
SPLIT_ROW_BYTES = 1024
BROADCAST_LIMIT = 256 << 20
PART_BYTES = 128 << 20


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``source_id, line_number, raw_line`` of text files, numbered per file.

    No sort: a task numbers the lines of its split, and the number of lines in
    the earlier splits of the file is added. The offset table has one row per
    split, bounded by files plus partitions; it is broadcast while that bound is
    small.
    """
    scan = spark.read.text(paths).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("position"),
    )
    splits = scan.groupBy("path", "split_start").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("first_position")
    )
    before = (
        Window.partitionBy("path")
        .orderBy("split_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = splits.select(
        "path",
        "split_start",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_position")).alias("shift"),
    )
    split_count = len(scan.inputFiles()) + scan.rdd.getNumPartitions()
    if split_count * SPLIT_ROW_BYTES <= BROADCAST_LIMIT:
        offsets = F.broadcast(offsets)
    return scan.join(offsets, ["path", "split_start"]).select(
        F.col("path").alias("source_id"),
        (F.col("position") + F.col("shift") + 1).alias("line_number"),
        decode_lossy(F.col("value")).alias("raw_line"),
    )


def decode_lossy(text: Column) -> Column:
    """Drop undecodable bytes.

    They are first turned into U+FFFD; in a line that has any, a genuine U+FFFD
    is dropped too.
    """
    cleaned = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(cleaned)


def parsed_lines(rows: DataFrame) -> DataFrame:
    """One tab-separated text per parsed row: line, template_id, raw."""
    return rows.select(
        "source_id",
        "line_number",
        F.concat_ws(
            "\t",
            F.col("line_number").cast("string"),
            F.coalesce("template_id", F.lit("")),
            F.translate("raw", "\t\n\r", "   "),
        ).alias("value"),
    )


def write_parsed_tsv(rows: DataFrame, path: str, header: bool = False) -> None:
    """Write the parsed rows as text, in line order across part files of ``PART_BYTES``.

    With ``header`` each part file starts with the column names, as every part
    of a Spark text table must be readable alone.
    """
    lines = parsed_lines(rows)
    size = lines.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    lines = lines.repartitionByRange(max(1, -(-size // PART_BYTES)), "source_id", "line_number")
    if not header:
        lines.sortWithinPartitions("source_id", "line_number").select("value").write.mode(
            "overwrite"
        ).text(path)
        return
    (
        lines.sortWithinPartitions("source_id", "line_number")
        .select(
            F.split_part("value", F.lit("\t"), F.lit(1)).alias("line"),
            F.split_part("value", F.lit("\t"), F.lit(2)).alias("template_id"),
            F.split_part("value", F.lit("\t"), F.lit(3)).alias("raw"),
        )
        .write.mode("overwrite")
        .option("sep", "\t")
        .option("header", "true")
        .option("quote", "\u0000")
        .option("escapeQuotes", "false")
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )
