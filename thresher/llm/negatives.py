"""Hard negatives by a vertical scan with branch and bound.

Vectors are stored in slabs, one column of numbers for each dimension. For an anchor the
columns are read in descending magnitude of its own components. After each few columns
the smallest and largest contribution that the unread ones can still make bound every
row's score, and rows that cannot enter a result any more leave the candidate bitmap.
Scores are integers, so bounds and results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thresher.session import materialize, scratch_dir

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # hundredths of the positive's score between which a negative lies
STEP = 8
SLAB_ROWS, LEAST_ROWS, LEAST_SLABS = 16_384, 1_024, 16
ANCHOR_ROWS = 4_096
EXACT = 2**53
LONG = 2**63 - 1


def pack(vectors: np.ndarray) -> tuple[bytes, str]:
    """A column for each dimension, in the smallest type that holds ``floor(256 x)`` exactly."""
    whole = np.ascontiguousarray(np.floor(SCALE * vectors.astype(np.float64)).T)
    most = np.abs(whole).max(initial=0.0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return whole.astype(kind).tobytes(), kind


def unpack(data: bytes, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(dims, -1)


def exact_pair(anchors: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in doubles if every sum of products is exact in them, else in Python integers."""
    limit = np.abs(anchors.astype(float)).max(initial=0) * np.abs(columns.astype(float)).max(initial=0)
    if limit * max(1, len(columns)) < EXACT:
        return anchors.astype(float), columns.astype(float)
    to_int = np.vectorize(int, otypes=[object])
    return tuple(to_int(x) if x.size else x.astype(object) for x in (anchors, columns))


class Slab:
    """Columns of a block of rows with the range of each, sorted by label, then id."""

    def __init__(self, columns: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.columns, self.ids, self.labels = columns, ids, labels
        self.low, self.high = columns.min(axis=1), columns.max(axis=1)

    def same_label(self, label: int) -> np.ndarray:
        return np.arange(*np.searchsorted(self.labels, (label, label + 1)))

    def other_labels(self, label: int) -> np.ndarray:
        one, two = np.searchsorted(self.labels, (label, label + 1))
        return np.concatenate((np.arange(one), np.arange(two, len(self.ids))))

    def scan(self, anchor: np.ndarray, alive: np.ndarray, narrow: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Rows that ``narrow`` leaves, with their scores.

        ``narrow`` gets the lowest and highest score each row can still reach and says
        which rows stay.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = anchor[order] * self.low[order], anchor[order] * self.high[order]
        least, most = np.minimum(*ends), np.maximum(*ends)
        left_low, left_high = least.sum(), most.sum()
        score = np.zeros(len(alive), self.columns.dtype)
        for at in range(0, len(order), STEP):
            if not len(alive):
                break
            read = order[at : at + STEP]
            part = self.columns[read] if len(alive) == self.columns.shape[1] else self.columns[np.ix_(read, alive)]
            score = score + anchor[read] @ part
            left_low, left_high = left_low - least[at : at + STEP].sum(), left_high - most[at : at + STEP].sum()
            keep = narrow(score + left_low, score + left_high)
            if not keep.all():
                alive, score = alive[keep], score[keep]
        return alive, score

    def nearest(self, anchor: np.ndarray, name: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the first ``k`` other rows of the label, ties to the smaller id."""
        alive = self.same_label(label)
        alive = alive[self.ids[alive] != name]

        def narrow(lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
            if len(lowest) <= k:
                return np.ones(len(lowest), bool)
            return highest >= np.sort(lowest)[-k] if lowest.dtype == object else highest >= np.partition(lowest, -k)[-k]

        alive, score = self.scan(anchor, alive, narrow)
        first = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][first], score[first]

    def windows(self, anchor: np.ndarray, label: int, spans: list[tuple[int, int]], k: int) -> list:
        """For each span of scores ids and scores of the first ``k`` rows of other labels in it."""
        floors = [low for low, _ in spans]

        def narrow(lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
            stay = np.zeros(len(lowest), bool)
            for i, (low, high) in enumerate(spans):
                sure = lowest[(lowest >= low) & (highest <= high)]
                if len(sure) >= k:
                    floors[i] = max(floors[i], np.sort(sure)[-k])
                stay |= (highest >= floors[i]) & (lowest <= high)
            return stay

        alive, score = self.scan(anchor, self.other_labels(label), narrow)
        found = []
        for low, high in spans:
            inside = np.flatnonzero((score >= low) & (score <= high))
            first = inside[np.lexsort((self.ids[alive[inside]], -score[inside]))[:k]]
            found.append((self.ids[alive[first]], score[first]))
        return found


def _cell(group: pd.DataFrame, packed: pd.DataFrame) -> tuple[pd.DataFrame, Slab]:
    """The anchors of a cell with their numbers, and its slab."""
    row = packed.iloc[0]
    columns = unpack(row["columns"], row["kind"], row["dims"])
    numbers = np.floor(SCALE * np.stack(group["vector"].to_numpy()).astype(np.float64))
    numbers, columns = exact_pair(numbers, columns)
    slab = Slab(columns, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"))
    return group.assign(numbers=list(numbers)), slab


def _long(score) -> int:
    """A score as a whole number of 64 bits; one beyond them counts as the nearest."""
    return max(-LONG, min(LONG, int(score)))


def prepared(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``vec_id, label, dims, vector`` of the rows that take part, one for each id."""
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("long").alias("label"),
        F.col(embedding).cast("array<double>").alias("vector"),
    )
    limit = F.lit(float("inf"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    rows = rows.dropna(subset=["vec_id", "label", "vector"]).filter(finite & (F.size("vector") > 0))
    first = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r"))
    return first.select("vec_id", "r.label", F.size("r.vector").alias("dims"), "r.vector")


def mine(
    vectors: DataFrame,
    anchors: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows for which ``anchors`` (over ``vec_id, label``) holds. An anchor's
    positives are its first ``positives`` other rows of the same label; each takes the
    first ``negatives`` rows of other labels whose score lies between ``low`` and ``high``
    hundredths of the positive's. Scores are inner products of ``floor(256 x)``; higher
    come first, ties by the smaller id.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite
    component take no part. Of several rows of one id the smallest label and vector
    counts. Vectors of different lengths do not meet. A zero vector takes part like any
    other, and a positive's score beyond 64 bits counts as the nearest of them. Other
    columns are ignored; an empty table gives no rows.

    Every anchor meets every row: groups of anchors meet slabs in cells of bounded size,
    dealt by a hash of the id, so no label, copy or cluster makes a cell large. A cell
    reports at most ``positives`` or ``positives * negatives`` rows for each anchor.
    """
    folder = scratch_dir(vectors.sparkSession)
    rows = materialize(prepared(vectors, vec_id, embedding, label), "rows", folder)
    total, asked = rows.agg(F.count("*"), F.count_if(anchors)).first()
    slabs = max(1, -(-total // SLAB_ROWS), min(LEAST_SLABS, -(-total // LEAST_ROWS)))
    groups = max(1, -(-asked // ANCHOR_ROWS))

    def fold_up(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["label", "vec_id"])
        data, kind = pack(np.stack(block["vector"].to_numpy()))
        ids, labels = (block[c].to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label"))
        first = block.iloc[0]
        return pd.DataFrame(
            [(first["dims"], first["slab"], ids, labels, data, kind)],
            columns=["dims", "slab", "ids", "labels", "columns", "kind"],
        )

    dealt = rows.withColumn("slab", F.pmod(F.xxhash64("vec_id"), F.lit(slabs)).cast("int"))
    packed = dealt.groupBy("dims", "slab").applyInPandas(
        fold_up, "dims int, slab int, ids binary, labels binary, columns binary, kind string"
    )
    packed = materialize(packed, "slabs", folder)
    copies = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    chosen = rows.filter(anchors).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int"))
    chosen = materialize(chosen, "anchors", folder)
    cell = ["dims", "slab", "part"]

    def spread_out(frame: DataFrame) -> DataFrame:
        return frame.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))).groupBy(*cell)

    def find_positives(group: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(group) and len(packed):
            group, slab = _cell(group, packed)
            for name, own, numbers in zip(group["vec_id"], group["label"], group["numbers"]):
                ids, scores = slab.nearest(numbers, name, own, positives)
                out += [(name, int(i), _long(s)) for i, s in zip(ids, scores)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])

    near = spread_out(chosen).cogroup(copies.groupBy(*cell)).applyInPandas(
        find_positives, "anchor_id long, positive_id long, positive_score long"
    )
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= positives)
    wanted = near.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("wanted")
    )
    wanted = materialize(wanted, "positives", folder)
    asking = chosen.join(wanted.withColumnRenamed("anchor_id", "vec_id"), "vec_id")

    def find_negatives(group: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(group) and len(packed):
            group, slab = _cell(group, packed)
            for name, own, numbers, goals in zip(group["vec_id"], group["label"], group["numbers"], group["wanted"]):
                scores = sorted({g["positive_score"] for g in goals})
                spans = [(-(-low * s // 100), high * s // 100) for s in scores]
                found = dict(zip(scores, slab.windows(numbers, own, spans, negatives)))
                for goal in goals:
                    for i, s in zip(*found[goal["positive_score"]]):
                        out.append((name, goal["positive_id"], goal["positive_score"], int(i), _long(s)))
        return pd.DataFrame(
            out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        )

    hard = spread_out(asking).cogroup(copies.groupBy(*cell)).applyInPandas(
        find_negatives,
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        hard.withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
