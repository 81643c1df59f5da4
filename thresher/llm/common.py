"""Shared pieces: folds, skew-safe joins, block numbering, connected components."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from thresher.session import bounded, materialize, scratch_dir

WORD = "[^\\x20\\x09-\\x0D]+"
BROADCAST_BYTES = 32 << 20
BLOCK_ROWS = 50_000


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def unsigned_text_crc(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long")


def add_columns(rows: DataFrame, compute: Callable[[pa.RecordBatch], dict], added: str) -> DataFrame:
    """All rows and columns with those ``compute`` makes of a batch (``added``: their types)."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in compute(batch).items()}
            yield pa.RecordBatch.from_arrays(batch.columns + list(new.values()), batch.schema.names + list(new))

    shape = T.StructType(rows.schema.fields + T._parse_datatype_string(added).fields)
    return rows.mapInArrow(extend, shape)


def beside(rows: DataFrame, given: list[str], compute: Callable[[pa.RecordBatch], dict], added: str) -> DataFrame:
    """All rows and columns with those ``compute`` makes of the columns ``given`` (``added``: their types).

    Only these columns go to Python and only the new ones come back, so a task never holds
    its texts a second time on their way back. What filters the new columns runs after them.
    """
    shape = T._parse_datatype_string(added)

    def made(column: pa.Array) -> pa.Array:
        new = compute(pa.RecordBatch.from_struct_array(column)).values()
        return pa.StructArray.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in new], shape.names)

    name, whole = fresh(rows, "_made"), F.struct(*[F.col(f"`{c}`") for c in given])
    found = F.arrow_udf(made, shape).asNondeterministic()(whole)
    return rows.select("*", found.alias(name)).select(*[f"`{c}`" for c in rows.columns], f"{name}.*")


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name


def attach(rows: DataFrame, side: DataFrame, key: list[str], weight: str, how: str = "left") -> DataFrame:
    """Join ``side`` (unique on ``key``) to ``rows`` whose keys may be very uneven.

    ``weight`` of ``side`` is the number of rows that carry the key. A side below
    ``BROADCAST_BYTES`` is broadcast after measuring it. Beyond that, keys with more
    than a thousandth of all rows (fewer than a thousand keys) are broadcast and
    the others, none of them hot, go through a shuffle. ``key`` holds no nulls.
    """
    if bounded(side, [F.col(c).cast("string") for c in side.columns], BROADCAST_BYTES):
        return rows.join(F.broadcast(side), key, how)
    total = side.agg(F.sum(weight)).first()[0]
    hot = F.col(weight) > total / 1000
    heavy, light = F.broadcast(side.filter(hot)), side.filter(~hot)
    return rows.join(heavy, key).unionByName(
        rows.join(heavy.select(key), key, "left_anti").join(light, key, how)
    )


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in blocks of bounded size.

    A group may hold most rows: it is dealt into blocks by a hash of ``order``, each
    block is numbered by itself, and the counts of the blocks before it are added.
    Rows equal in ``order`` get different numbers in no stated order.
    """
    most = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // BLOCK_ROWS))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy(*group, "_block")
        .count()
        .withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count")
    )
    inside = Window.partitionBy(*group, "_block").orderBy(*order)
    return (
        dealt.withColumn("_place", F.row_number().over(inside))
        .join(before, [*group, "_block"])
        .withColumn(name, F.col("_before") + F.col("_place") - 1)
        .drop("_block", "_before", "_place")
    )


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node, from undirected edges ``(a, b)``.

    Alternates large-star and small-star steps until every node points at its
    smallest reachable node. Returns ``(node, component)`` for the nodes that are
    not their own component. Each step is a written table, so lineage stays short.
    """
    folder = scratch_dir(edges.sparkSession)
    turned = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars, last = materialize(turned.filter("a <> b").distinct(), "edges", folder), None
    for step in itertools.count():
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == last or not state[0]:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = state
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        ).distinct()
        large = materialize(large, f"large{step}", folder)
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = large.join(lowest, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        stars = materialize(moved.union(lowest).distinct(), f"small{step}", folder)
