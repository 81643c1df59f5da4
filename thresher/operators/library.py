"""Template libraries as tables: ids, upserts, statistics, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thresher.functions import text as X
from thresher.operators.match import valid_regex
from thresher.schemas import LIBRARY_KEY, LINE_KEY, TEMPLATE

TEMPLATE_KEY = [*LIBRARY_KEY, "template_id"]
NUMBERING_BLOCK = 1 << 20


def number_rows(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """1-based number of each row within ``keys``, ordered by source and line.

    A window over ``keys`` would put a large library into one task. Rows are
    numbered within blocks of lines instead, and the sizes of the earlier blocks
    (a small table) are added.
    """
    block = F.floor(F.col("line_number") / NUMBERING_BLOCK)
    blocked = df.withColumn("_block", block)
    place = [*keys, "source_id", "_block"]
    before = (
        Window.partitionBy(*keys)
        .orderBy("source_id", "_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        blocked.groupBy(*place)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = F.row_number().over(Window.partitionBy(*place).orderBy("line_number"))
    return (
        blocked.withColumn("_within", within)
        .join(starts, place)
        .withColumn(name, F.col("_start") + F.col("_within"))
        .drop("_block", "_within", "_start")
    )


# --- ids and upserts ----------------------------------------------------------


def id_prefix(device_type: Column, vendor: Column) -> Column:
    return F.concat(X.id_part(device_type), F.lit("-"), X.id_part(vendor), F.lit("-"))


def next_sequences(templates: DataFrame, meta: DataFrame) -> DataFrame:
    """Per library the next id number: the stored one, or past the largest in use."""
    prefix = id_prefix(F.col("device_type"), F.col("vendor"))
    suffix = F.when(
        F.startswith("template_id", prefix),
        F.substring(F.col("template_id"), F.length(prefix) + 1, F.length("template_id")),
    )
    used = F.when(suffix.rlike(r"\A[0-9]+\z"), suffix.try_cast("bigint"))
    stored = F.element_at("metadata", "next_sequence").try_cast("bigint")
    return (
        templates.select(*LIBRARY_KEY, (used + 1).alias("n"), F.col("seq"))
        .unionByName(
            meta.select(*LIBRARY_KEY, stored.alias("n"), F.lit(None).cast("bigint").alias("seq"))
        )
        .groupBy(*LIBRARY_KEY)
        .agg(
            F.greatest(F.coalesce(F.max("n"), F.lit(1)), F.lit(1)).alias("next_sequence"),
            F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"),
        )
    )


def allocate_template_ids(new_rows: DataFrame, templates: DataFrame, meta: DataFrame) -> DataFrame:
    """Give rows (ordered by source and line) their library id and ``seq``."""
    numbered = number_rows(new_rows.drop("template_id", "seq"), LIBRARY_KEY, "_no")
    sequence = F.coalesce("next_sequence", F.lit(1)) + F.col("_no") - 1
    return (
        numbered.join(next_sequences(templates, meta), LIBRARY_KEY, "left")
        .withColumn(
            "template_id",
            F.concat(
                id_prefix(F.col("device_type"), F.col("vendor")),
                F.format_string("%04d", sequence),
            ),
        )
        .withColumn("seq", F.coalesce("last_seq", F.lit(0)) + F.col("_no"))
        .drop("_no", "next_sequence", "last_seq")
    )


def with_next_sequence(meta: DataFrame, templates: DataFrame) -> DataFrame:
    """Store the next id number in the metadata, adding libraries not listed yet."""
    found = next_sequences(templates, meta).select(*LIBRARY_KEY, "next_sequence")
    fresh = F.create_map(
        F.lit("device_type"), F.col("device_type"), F.lit("vendor"), F.col("vendor"),
        F.lit("version"), F.lit("v1"),
    )
    kept = F.map_filter("metadata", lambda k, v: k != "next_sequence")
    return found.join(meta, LIBRARY_KEY, "left").select(
        *LIBRARY_KEY,
        F.map_concat(
            F.coalesce(kept, fresh),
            F.create_map(F.lit("next_sequence"), F.col("next_sequence").cast("string")),
        ).alias("metadata"),
        "timestamp_spec",
    )


def upsert_templates(templates: DataFrame, records: DataFrame, meta: DataFrame) -> DataFrame:
    """Known ids are replaced in place, other records appended under new ids.

    ``records`` are template rows with ``source_id, line_number`` as their order;
    rows with an invalid regex are left out. Of several records with one known
    id the last one stays.
    """
    fields = [f for f in TEMPLATE.names if f not in (*TEMPLATE_KEY, "seq")]
    usable = valid_regex(records).filter("valid").drop("valid", "error")
    known = usable.join(templates.select(*TEMPLATE_KEY), TEMPLATE_KEY, "left_semi")
    last = known.groupBy(*TEMPLATE_KEY).agg(
        F.max_by(F.struct(*fields), F.struct(*LINE_KEY)).alias("_new")
    )
    replaced = templates.join(last, TEMPLATE_KEY, "left").select(
        *LIBRARY_KEY,
        "seq",
        "template_id",
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f)).alias(f)
            for f in fields
        ],
    )
    new = usable.join(templates.select(*TEMPLATE_KEY), TEMPLATE_KEY, "left_anti")
    return replaced.unionByName(
        allocate_template_ids(new, templates, meta).select(*TEMPLATE.names)
    )


# --- statistics ----------------------------------------------------------------


def template_usage(templates: DataFrame, assigned: DataFrame) -> DataFrame:
    """Add the number of lines assigned to each template to its usage count."""
    counts = (
        assigned.filter(F.col("template_id").isNotNull())
        .groupBy(*TEMPLATE_KEY)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return _add_counts(templates, counts, "usage_count")


def mark_failures(templates: DataFrame, failures: DataFrame) -> DataFrame:
    """One failure more per failure event of a known template."""
    counts = failures.groupBy(*TEMPLATE_KEY).agg(F.count(F.lit(1)).alias("_n"))
    return _add_counts(templates, counts, "failure_count")


def _add_counts(templates: DataFrame, counts: DataFrame, column: str) -> DataFrame:
    return (
        templates.join(counts, TEMPLATE_KEY, "left")
        .withColumn(column, F.col(column) + F.coalesce("_n", F.lit(0)))
        .select(*templates.columns)
    )


def failing(min_usage: int = 1, max_failure_ratio: float = 0.6) -> Column:
    events = F.col("usage_count") + F.col("failure_count")
    ratio = F.when(events > 0, F.col("failure_count") / events).otherwise(F.lit(0.0))
    return (F.col("usage_count") < min_usage) | (ratio > max_failure_ratio)


def cleanup_templates(
    templates: DataFrame,
    *,
    min_usage: int = 1,
    max_failure_ratio: float = 0.6,
    dry_run: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(library, ids put on hold). A dry run leaves the library as it is."""
    bad = failing(min_usage, max_failure_ratio)
    held = templates.filter(bad).select(*TEMPLATE_KEY)
    if dry_run:
        return templates, held
    return templates.withColumn("is_active", F.col("is_active") & ~bad), held


def cleanup_all(templates: DataFrame, **options) -> DataFrame:
    """Every library with the ids put on hold, one per row; null where none.

    One row per id, because a library's list has no size limit.
    """
    _, held = cleanup_templates(templates, **options)
    return list_libraries(templates).join(held, LIBRARY_KEY, "left")


def constant_coverage(
    templates: DataFrame,
    *,
    enforce: bool = False,
    min_ratio: float = 0.2,
    min_chars: int = 12,
    min_segments: int = 2,
) -> DataFrame:
    """Share of constant text per template.

    The thresholds are reported against only on request: by default every
    template counts as covered.
    """
    metrics = X.constant_metrics(F.col("template"))
    out = templates.select(*TEMPLATE_KEY, *[c.alias(name) for name, c in metrics.items()])
    enough = (
        (F.col("constant_ratio") >= min_ratio)
        & (F.col("constant_chars") >= min_chars)
        & (F.size("segments") >= min_segments)
    )
    return out.withColumn("covered", enough if enforce else F.lit(True))


def list_templates(templates: DataFrame) -> DataFrame:
    """Templates as a snapshot shows them, without the derived fields."""
    return templates.drop("template", "variables", "constants")


def list_libraries(templates: DataFrame) -> DataFrame:
    return templates.select(*LIBRARY_KEY).distinct()


def unknown_routes(routing: DataFrame) -> DataFrame:
    """Routing rows whose device type or vendor stayed unknown."""
    return routing.filter((F.col("device_type") == "unknown") | (F.col("vendor") == "unknown"))
