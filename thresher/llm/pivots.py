"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its ``PREFIX`` nearest reference points (pivots), in order.
Each pivot has an inverted list of the vectors that name it. Vectors that share at
least ``SHARED`` pivots are candidates, and their cosine is then checked in double
precision. Two vectors at cosine 0.9 share two of eight among 256 pivots in over 99 %
of cases (64 dimensions); nearer ones practically always do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thresher.llm.common import attach, components
from thresher.llm.vectors import clean, sample
from thresher.session import materialize, scratch_dir

COSINE = 0.9
PREFIX = 8
SHARED = 2
MIN_PIVOTS, MAX_PIVOTS = 16, 4096
CELL_ROWS = 2000
BATCH = 512
LINKS = "vec_id long, links long, low long"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe for very large components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def describe(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each point, nearest first, ties to the smaller number."""
    return np.argsort(-(points @ pivots.T), axis=1, kind="stable")[:, :PREFIX].astype(np.int32)


def cell_links(rows: pd.DataFrame, pivot: int, first: int, second: int) -> pd.DataFrame:
    """Links between blocks ``first`` and ``second`` of one pivot's list.

    A pair may meet in several lists; it counts in that of its smallest shared pivot.
    Rows out: each linked vector, its number of links here, and the smallest vector of
    its connected part of this cell. The product of vectors is cheap and runs first, so
    only near pairs have their shared pivots counted.
    """
    points = unit(np.stack(rows["vector"].to_numpy()).astype(float))
    names = np.sort(np.stack(rows["pivots"].to_numpy()), axis=1)
    ids, copies, block = (rows[c].to_numpy() for c in ("vec_id", "copies", "block"))
    need = min(SHARED, names.shape[1])
    left, right = [], []
    for at in range(0, len(rows), BATCH):
        near = points[at : at + BATCH] @ points.T >= COSINE
        near &= np.arange(at, at + len(near))[:, None] < np.arange(len(rows))[None]
        if first != second:
            near &= block[at : at + BATCH, None] != block[None]
        a, b = np.nonzero(near)
        a = a + at
        for part in range(0, len(a), 100_000):
            one, two = a[part : part + 100_000], b[part : part + 100_000]
            same = names[one][:, :, None] == names[two][:, None, :]
            common = same.any(axis=2)
            smallest = names[one, common.argmax(axis=1)]
            keep = (common.sum(axis=1) >= need) & (smallest == pivot)
            left.append(one[keep])
            right.append(two[keep])
    a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
    links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
    low = np.arange(len(rows))
    order = np.argsort(ids, kind="stable")
    low[order] = np.arange(len(rows))
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[order[low]]
        if (before == low).all():
            break
    linked = np.flatnonzero(links)
    return pd.DataFrame({"vec_id": ids[linked], "links": links[linked].astype(np.int64), "low": ids[order[low[linked]]]})


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each id of the table.

    Links are pairs found with cosine 0.9 or more, none below. Vectors that are null,
    zero or hold null or non-finite components link with nothing and name themselves.
    Rows without an id are left out; of several vectors of one id the smallest counts.
    An empty table gives no rows.

    Equal vectors are compared once and counted as often as they occur. A long list is
    dealt into blocks that meet pairwise, and cells report sums and connected parts, so
    a group of n near copies costs n rows for each cell, never its pairs. The number of
    pivots grows with the square root of the vectors (16 to 4096, from a sample as large).
    """
    spark, folder = vectors.sparkSession, scratch_dir(vectors.sparkSession)
    everyone = vectors.select(F.col(vec_id).cast("long").alias("vec_id")).filter("vec_id is not null").distinct()
    rows = materialize(clean(vectors, vec_id, embedding), "rows", folder)
    classes = rows.groupBy("vector").agg(F.min("vec_id").alias("name"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes", folder)
    total = classes.count()
    kind = rows.schema["vector"].dataType.simpleString()
    found = spark.createDataFrame([], LINKS)
    if total:
        pivots = int(min(MAX_PIVOTS, max(MIN_PIVOTS, 2 ** round(np.log2(total) / 2))))
        reference = spark.sparkContext.broadcast(unit(sample(classes.withColumnRenamed("name", "vec_id"), pivots)[1]))

        def describe_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), BATCH):
                    part = batch.iloc[at : at + BATCH]
                    names = describe(unit(np.stack(part["vector"].to_numpy()).astype(float)), reference.value)
                    yield part.assign(pivots=list(names))

        described = classes.select(F.col("name").alias("vec_id"), "copies", "vector").mapInPandas(
            describe_all, f"vec_id long, copies long, vector {kind}, pivots array<int>"
        )
        described = materialize(described, "described", folder)
        listed = described.withColumn("pivot", F.explode("pivots"))
        sizes = listed.groupBy("pivot").count().withColumn(
            "blocks", F.ceil(F.col("count") / CELL_ROWS).cast("int")
        ).select("pivot", "blocks")
        own = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
        dealt = (
            listed.join(F.broadcast(sizes), "pivot")
            .withColumn("block", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("first", F.least("block", "other"))
            .withColumn("second", F.greatest("block", "other"))
            .select("pivot", "first", "second", "block", "vec_id", "copies", "vector", "pivots")
        )

        def link(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
            return cell_links(cell, *key)

        found = materialize(dealt.groupBy("pivot", "first", "second").applyInPandas(link, LINKS), "found", folder)
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    named = (
        classes.join(counts.withColumnRenamed("vec_id", "name"), "name", "left")
        .join(roots.withColumnRenamed("node", "name"), "name", "left")
        .select(
            "vector",
            "copies",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "name").alias("component_id"),
        )
    )
    named = materialize(named, "named", folder)
    member = attach(rows, named, ["vector"], "copies", "inner").select("vec_id", "n_links", "component_id")
    whole = everyone.join(member, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return whole.withColumn("kept", F.col("vec_id") == F.col("component_id"))
