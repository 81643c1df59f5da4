"""Streams of lines: matching, learning between batches, usage over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thresher.operators import match as M
from thresher.operators.lines import normalize_lines
from thresher.plans.parse import parse_logs
from thresher.schemas import LIBRARY_KEY, LINE_KEY
from thresher.session import materialize
from thresher.sources import store


def stream_match(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """Stateless matching with variables on a stream of lines with their library.

    Small libraries are a generated expression, larger ones an index that every task
    holds; both are map-only, so nothing is kept between batches. A library beyond
    ``TASK_INDEX_LIMIT`` needs an aggregation for each batch: use `write_matches`.
    """
    compiled = M.compiled_templates(templates)
    if lines.isStreaming and not _map_only(compiled):
        raise ValueError("the library is too large for every task; use write_matches")
    return M.match_compiled(normalize_lines(lines), compiled, variables=True)


def _map_only(compiled: DataFrame) -> bool:
    """Whether the templates, or their index, fit into every task."""
    return compiled.limit(M.CASE_LIMIT + 1).count() <= M.CASE_LIMIT or M.fits_in_tasks(compiled)


def match_batch(templates: DataFrame, output_path: str, columns: list | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: match a micro-batch to a library of any size.

    A batch is an ordinary table, so the join and the minimum of a large library run
    on it. Its rows (``columns`` of them, if given) go to a folder of their own: a batch
    that is run again replaces them.
    """
    compiled = materialize(M.compiled_templates(templates), "compiled")

    def run(batch: DataFrame, batch_id: int) -> None:
        lines = materialize(normalize_lines(batch), "lines")
        found = M.match_compiled(lines, compiled, variables=True)
        found.select(*(columns or ["*"])).write.mode("overwrite").parquet(f"{output_path}/batch={batch_id}")

    return run


def write_matches(
    lines: DataFrame, templates: DataFrame, output_path: str, checkpoint_path: str, *, columns: list | None = None, **trigger
) -> StreamingQuery:
    """Start matching a stream into parquet, whatever the size of the library.

    Up to ``TASK_INDEX_LIMIT`` the rows stream through; beyond that each micro-batch is
    matched like a table. ``columns`` are what is kept; ``trigger`` is that of the query.
    """
    if _map_only(M.compiled_templates(templates)):
        found = stream_match(lines, templates).select(*(columns or ["*"]))
        writer = found.writeStream.format("parquet").option("path", output_path)
    else:
        writer = lines.writeStream.foreachBatch(match_batch(templates, output_path, columns))
    return writer.option("checkpointLocation", checkpoint_path).trigger(**(trigger or {"availableNow": True})).start()


def learn_batch(
    store_path: str, output_path: str, *, stream_id: str | None = None, **options
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: parse a micro-batch and grow the stored library.

    Rows go to a folder per batch, and the library version carries the batch's number
    under ``stream_id`` (the output folder, if not given). A batch that is run again
    replaces its rows and does not learn twice; other streams on the store are their
    own. A version that another stream published meanwhile makes the batch fail and
    be run again by Spark.
    """
    stream = stream_id or output_path

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if store.is_published(spark, store_path, stream, batch_id):
            return
        templates, meta = store.open_library(spark, store_path)
        parsed = parse_logs(batch.select(*LINE_KEY, "raw_line"), templates, meta, **options)
        parsed.rows.drop("transformed").write.mode("overwrite").parquet(
            f"{output_path}/batch={batch_id}"
        )
        store.save_library(parsed.templates, parsed.meta, store_path, (stream, batch_id))

    return run


def stream_usage(
    matched: DataFrame, window: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Lines per template and event-time window; ``matched`` has ``event_time``."""
    return (
        matched.filter(F.col("template_id").isNotNull())
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", window), *LIBRARY_KEY, "template_id")
        .agg(F.count(F.lit(1)).alias("usage"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *LIBRARY_KEY,
            "template_id",
            "usage",
        )
    )
