"""K-d tree sharding: recursive splits at distributed weighted medians.

The points are the documents' metadata: size in bytes, source and id. A node of the
tree that owes several shards is split along its widest dimension (its range against
that of the whole table) so that both sides get bytes in proportion to the shards they
owe. The split value is found by counting bytes in bins of the node's range and again
inside the bin that holds the sought weight; only the bin sums leave the tasks.
Everything is a DataFrame function.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thresher.llm.common import numbered, unsigned_text_crc
from thresher.session import materialize, scratch_dir

SHARDS = 40
ROW_BYTES = 16
BINS = 4096
MAX_PASSES = 6
# A bin of at most this part of the sought weight is fine enough to split at.
FINE = 1 / 1000
TIE_BITS = 24
DIMENSIONS = ("by_size", "by_source", "by_id")


@dataclass
class Node:
    """Owes shards ``first`` to ``first + shards - 1``; split once it owes more than one."""

    first: int
    shards: int
    dimension: str | None = None
    at: int = 0
    sides: list[Node] = field(default_factory=list)

    def route(self) -> Column:
        """The leaf of a row: its first shard."""
        if not self.sides:
            return F.lit(self.first)
        low, high = self.sides
        return F.when(F.col(self.dimension) <= F.lit(self.at), low.route()).otherwise(high.route())

    def open(self) -> list[Node]:
        """Leaves that still owe several shards."""
        if self.sides:
            return [n for side in self.sides for n in side.open()]
        return [self] if self.shards > 1 else []


def points(documents: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32`` and one whole number per dimension.

    The low bits of a dimension are a hash of id and checksum, so rows equal in the
    metadata (copies, a hot source) can still be told apart and split evenly.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        unsigned_text_crc("text").alias("text_crc32"),
        F.coalesce(F.crc32(F.col("source").cast("string").cast("binary")), F.lit(0)).cast("long").alias("source"),
    )
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(1 << TIE_BITS))
    limit = F.lit(1 << 38)
    clip = F.greatest(F.least(F.coalesce("doc_id", F.lit(0)), limit), -limit)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        *(
            (F.shiftleft(value, TIE_BITS) + tie).alias(name)
            for name, value in zip(DIMENSIONS, (F.col("size"), F.col("source"), clip))
        ),
    )


def _ranges(rows: DataFrame, route: Column) -> dict[int, dict]:
    """Weight and range of each leaf: one row per node reaches the driver."""
    ends = [f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]
    found = rows.groupBy(route.alias("leaf")).agg(F.sum("size").alias("size"), *ends).collect()
    return {r["leaf"]: r.asDict() for r in found}


def _narrow(rows: DataFrame, route: Column, want: dict[int, dict]) -> None:
    """One pass: the bin of each leaf's range in which its sought weight is reached.

    Six passes of 4,096 bins resolve any range of 64 bits to single values.
    """
    table = F.create_map(
        *[
            x
            for leaf, w in want.items()
            for x in (
                F.lit(leaf),
                F.struct(
                    F.lit(w["low"]).cast("long").alias("low"),
                    F.lit(w["width"]).cast("long").alias("width"),
                    F.lit(w["below"]).cast("long").alias("below"),
                    F.lit(w["goal"]).cast("long").alias("goal"),
                ),
            )
        ]
    )
    along = F.coalesce(*[F.when(route == leaf, F.col(w["dimension"])) for leaf, w in want.items()])
    placed = rows.select(route.alias("leaf"), along.alias("value"), "size").withColumn("w", table[F.col("leaf")])
    bin_of = F.floor((F.col("value") - F.col("w.low")) / F.col("w.width")).cast("long")
    inside = placed.filter("w is not null").withColumn("bin", bin_of).filter(F.col("bin").between(0, BINS - 1))
    sums = inside.groupBy("leaf", "bin", F.col("w.below").alias("below"), F.col("w.goal").alias("goal")).agg(
        F.sum("size").alias("size")
    )
    upto = F.col("below") + F.sum("size").over(Window.partitionBy("leaf").orderBy("bin"))
    reached = sums.withColumn("upto", upto).filter("upto >= goal").groupBy("leaf").agg(
        F.min(F.struct("bin", "upto", "size")).alias("hit")
    )
    for row in reached.collect():
        w, hit = want[row["leaf"]], row["hit"]
        low = w["low"] + hit["bin"] * w["width"]
        w.update(at=low + w["width"] - 1, low=low, below=hit["upto"] - hit["size"], upto=hit["upto"])
        w["open"] = w["width"] > 1 and hit["size"] > FINE * w["goal"]
        w["width"] = -(-w["width"] // BINS)


def grow(rows: DataFrame, shards: int = SHARDS) -> Node:
    """The tree for ``rows`` (a stored table of points): one level at a time."""
    root, spans = Node(0, shards), None
    while parts := root.open():
        route = root.route()
        ranges = _ranges(rows, route)
        spans = spans or {d: max(1, r[f"high_{d}"] - r[f"low_{d}"]) for r in ranges.values() for d in DIMENSIONS}
        want = {}
        for node in parts:
            left = node.shards // 2
            node.sides = [Node(node.first, left), Node(node.first + left, node.shards - left)]
            node.dimension = DIMENSIONS[0]
            if (r := ranges.get(node.first)) is None:
                continue
            widths = {d: r[f"high_{d}"] - r[f"low_{d}"] for d in DIMENSIONS}
            node.dimension = max(DIMENSIONS, key=lambda d: widths[d] / spans[d])
            low = r[f"low_{node.dimension}"]
            width = -(-(widths[node.dimension] + 1) // BINS)
            goal = r["size"] * left // node.shards
            want[node.first] = {"dimension": node.dimension, "low": low, "width": width, "below": 0, "goal": goal}
        for _ in range(MAX_PASSES):
            if coarse := {leaf: w for leaf, w in want.items() if w.get("open", True)}:
                _narrow(rows, route, coarse)
        for node in parts:
            if (w := want.get(node.first)) and "at" in w:
                over = w["upto"] - w["goal"] > w["goal"] - w["below"]
                node.at = w["low"] - 1 if over else w["at"]
    return root


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every document.

    The law is ``bytes``: shards are near equal in the sum of ``size``, the UTF-8
    bytes of the text (null: none) plus 16. ``slot`` numbers the rows of a shard from 0
    without gaps; ``grown_shard`` is null. Copies of one text may lie in different
    shards, since one group can be larger than a shard. Null ids and sources are values
    of their own, repeated rows stay, ties fall by a hash. An empty table gives no rows.
    """
    folder = scratch_dir(documents.sparkSession)
    rows = materialize(points(documents), "points", folder)
    route = grow(rows, shards).route()
    placed = rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), route.cast("int").alias("shard"))
    slotted = numbered(placed, ["shard"], ["doc_id", "size", "text_crc32"], "slot")
    return slotted.withColumn("grown_shard", F.lit(None).cast("int"))
