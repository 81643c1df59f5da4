"""Approximate nearest neighbours by inner product over balanced posting lists.

A bounded sample is halved again and again into lists of equal size. Every vector is
posted to its nearest list and, near a boundary, to further ones. The centroids form
a graph that fits in memory; a search walks it from fixed entries and keeps every
centroid within a ratio of the nearest distance found, which selects the lists to scan.
Inner products become distances by one more component that gives all vectors the same
norm, so the method holds for vectors of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thresher.llm.vectors import clean, sample
from thresher.session import materialize, scratch_dir

NEAREST = 20
SAMPLE = 16_384
LIST_SIZE = 256
MAX_LISTS = 2048
GRAPH_DEGREE = 16
ENTRIES = 4
POST_RATIO = 1.05
MAX_POSTINGS = 4
SEARCH_RATIO = 1.15
CELL_ROWS = 4096
BATCH = 256
FOUND = "query_id long, vec_id long, score double"


def halve(points: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of ``lists`` groups of equal size (one apart): balanced 2-means splits.

    Two means are moved three times with the points divided at the middle of their
    order along the line between the means.
    """
    parts = [np.arange(len(points))]
    while len(parts) < lists:
        halves = []
        for part in parts:
            own = points[part]
            far = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
            axis = far - own.mean(0)
            for _ in range(3):
                order = np.argsort(own @ axis, kind="stable")
                low, high = order[: len(order) // 2], order[len(order) // 2 :]
                axis = own[high].mean(0) - own[low].mean(0)
            halves += [part[low], part[high]]
        parts = halves
    return np.stack([points[p].mean(0) for p in parts])


class Index:
    """Centroids, their graph, and the sample that gives each query a first bound."""

    def __init__(self, ids: np.ndarray, drawn: np.ndarray, norm: float, lists: int):
        self.norm, self.ids, self.sample = norm, ids, drawn
        self.centroids = halve(self.lift(drawn), lists)
        squares = (self.centroids**2).sum(1)
        gaps = squares[:, None] + squares[None] - 2 * self.centroids @ self.centroids.T
        degree = min(GRAPH_DEGREE, lists)
        near = np.argsort(gaps, axis=1, kind="stable")[:, :degree]
        self.edges = np.zeros((lists, lists), bool)
        np.put_along_axis(self.edges, near, True, axis=1)
        ring = np.arange(lists)
        self.edges[ring, (ring + 1) % lists] = True
        self.edges |= self.edges.T
        self.entries = np.linspace(0, lists - 1, min(ENTRIES, lists)).astype(int)

    def lift(self, points: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (points**2).sum(1), 0))
        return np.hstack([points, rest[:, None]])

    def walk(self, points: np.ndarray, ratio: float) -> np.ndarray:
        """Distance to every centroid the walk reached within ``ratio`` of the nearest; else inf.

        A round opens all reached and unopened centroids inside the current radius and
        measures their unseen neighbours, until no such centroid is left.
        """
        gaps = np.full((len(points), len(self.centroids)), np.inf)
        opened = np.zeros(gaps.shape, bool)
        todo = np.zeros(gaps.shape, bool)
        todo[:, self.entries] = True
        while True:
            rows, columns = np.nonzero(todo & np.isinf(gaps))
            gaps[rows, columns] = np.sqrt(((points[rows] - self.centroids[columns]) ** 2).sum(1))
            radius = ratio * gaps.min(axis=1, keepdims=True)
            fresh = (gaps <= np.maximum(radius, 1e-12)) & ~opened
            if not fresh.any():
                return np.where(gaps <= np.maximum(radius, 1e-12), gaps, np.inf)
            opened |= fresh
            todo = (fresh.astype(np.float32) @ self.edges.astype(np.float32)) > 0

    def postings(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, list): the nearest list and those almost as near, ``MAX_POSTINGS`` at most."""
        gaps = self.walk(self.lift(points), POST_RATIO)
        order = np.argsort(gaps, axis=1, kind="stable")[:, :MAX_POSTINGS]
        rows, places = np.nonzero(np.isfinite(np.take_along_axis(gaps, order, 1)))
        return rows, order[rows, places]

    def routes(self, points: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        lifted = np.hstack([points, np.zeros((len(points), 1))])
        return np.nonzero(np.isfinite(self.walk(lifted, ratio)))

    def first(self, ids: np.ndarray, points: np.ndarray, nearest: int) -> tuple[np.ndarray, pd.DataFrame]:
        """Each query's nearest of the sample, and the score of the last of them: no
        vector below it can be among the nearest of all (-inf if the sample is short)."""
        kept = best_of(
            pd.DataFrame({"query_id": ids, "vector": list(points), "bound": -np.inf}),
            pd.DataFrame({"vec_id": self.ids, "vector": list(self.sample)}),
            nearest,
        )
        last = kept.groupby("query_id")["score"].agg(["min", "size"]).reindex(ids)
        bound = np.where(last["size"] >= nearest, last["min"], -np.inf)
        return bound - 1e-9 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0))), kept


def best_of(queries: pd.DataFrame, postings: pd.DataFrame, nearest: int) -> pd.DataFrame:
    """The ``nearest`` postings of one cell for each query, above the query's bound."""
    found = []
    if len(queries) and len(postings):
        theirs, ids = np.stack(postings["vector"].to_numpy()).astype(float), postings["vec_id"].to_numpy()
        for at in range(0, len(queries), BATCH):
            part = queries.iloc[at : at + BATCH]
            own = np.stack(part["vector"].to_numpy()).astype(float)
            rough = own @ theirs.T
            rough[part["query_id"].to_numpy()[:, None] == ids[None]] = -np.inf
            least = part["bound"].to_numpy()
            if len(ids) > nearest:
                # Only what may be among the nearest of this cell is looked at again.
                last = np.partition(rough, -nearest, axis=1)[:, -nearest]
                least = np.maximum(least, last - 1e-9 * (1 + np.abs(np.where(np.isfinite(last), last, 0))))
            rows, columns = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
            score = np.einsum("ij,ij->i", own[rows], theirs[columns])
            order = np.lexsort((ids[columns], -score, rows))
            rows, columns, score = rows[order], columns[order], score[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keep = place < nearest
            found.append(
                pd.DataFrame(
                    {
                        "query_id": part["query_id"].to_numpy()[rows[keep]],
                        "vec_id": ids[columns[keep]],
                        "score": score[keep],
                    }
                )
            )
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _blocks(counts: dict[int, int]) -> Column:
    """Number of blocks of a list: one for each ``CELL_ROWS`` rows."""
    many = {k: -(-n // CELL_ROWS) for k, n in counts.items() if n > CELL_ROWS}
    if not many:
        return F.lit(1)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in many.items() for x in kv])[F.col("list")], F.lit(1))


def search(
    vectors: DataFrame,
    is_query: Column | None = None,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    nearest: int = NEAREST,
    ratio: float = SEARCH_RATIO,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's nearest vectors found.

    Queries are the rows where ``is_query`` (over ``vec_id``; all rows by default) holds,
    candidates all rows but the query's own. Rank 1 is the largest inner product, ties
    go to the smaller id. Vectors that are null, zero or hold null or non-finite
    components, and rows without an id, take no part; of several vectors of one id the
    smallest counts. Fewer candidates give fewer rows, an empty table none.

    Of equal vectors only the ``nearest + 1`` smallest ids can be among the results, so
    no list fills up with copies. Lists and their queries beyond ``CELL_ROWS`` rows are
    dealt into blocks that meet pairwise. The nearest of the sample (16,384 rows) are a
    query's first results; what a cell reports must be as near as the last of them.
    """
    folder = scratch_dir(vectors.sparkSession)
    rows = materialize(clean(vectors, vec_id, embedding), "rows", folder)
    queries = rows.filter(is_query) if is_query is not None else rows
    copies = Window.partitionBy("vector").orderBy("vec_id")
    posted = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= nearest + 1).drop("copy")
    posted = materialize(posted, "distinct", folder)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    total, largest = posted.agg(F.count("*"), F.max(square)).first()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ids, drawn = sample(posted, SAMPLE)
    lists = 1
    while lists < MAX_LISTS and lists * LIST_SIZE < total and lists * 8 <= len(drawn):
        lists *= 2
    index = vectors.sparkSession.sparkContext.broadcast(Index(ids, drawn, float(np.sqrt(largest)), lists))
    kind = rows.schema["vector"].dataType.simpleString()

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                which, where = index.value.postings(np.stack(part["vector"].to_numpy()).astype(float))
                yield part.iloc[which].assign(list=where)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                points = np.stack(part["vector"].to_numpy()).astype(float)
                bound, _ = index.value.first(part["query_id"].to_numpy(), points, nearest)
                which, where = index.value.routes(points, ratio)
                yield part.iloc[which].assign(list=where, bound=bound[which])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                points = np.stack(part["vector"].to_numpy()).astype(float)
                yield index.value.first(part["query_id"].to_numpy(), points, nearest)[1]

    postings = posted.select("vec_id", "vector").mapInPandas(post, f"vec_id long, vector {kind}, list int")
    postings = materialize(postings, "postings", folder)
    named = queries.select(F.col("vec_id").alias("query_id"), "vector")
    asked = named.mapInPandas(route, f"query_id long, vector {kind}, list int, bound double")
    asked = materialize(asked, "asked", folder)
    post_blocks, ask_blocks = (_blocks(dict(x.groupBy("list").count().collect())) for x in (postings, asked))
    own = F.pmod(F.xxhash64("vec_id"), post_blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), ask_blocks.cast("int") - 1))
    left = postings.select("vec_id", "vector", "list", own.alias("a"), other.alias("b"))
    own = F.pmod(F.xxhash64("query_id"), ask_blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), post_blocks.cast("int") - 1))
    right = asked.select("query_id", "vector", "bound", "list", own.alias("b"), other.alias("a"))
    cell = ["list", "a", "b"]

    def scan(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        return best_of(theirs, mine, nearest)

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(scan, FOUND)
    found = found.unionByName(named.mapInPandas(first, FOUND))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        once.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )
