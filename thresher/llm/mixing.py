"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions.

Every document starts with the same expected number of copies as its source needs:
``target / source_size``, between 0 and 2. The whole part is certain, the fraction is
rounded dependently. Two fractional documents meet, and words move from one to the
other at random until one has a whole number of copies; the expectation of each and
the words of the pair stay as they were. Blocks of documents of like size fold in
this way to at most one fractional document, the residuals of all blocks form the
next level, and so on: a reduction tree in which no task sees more than a block. At
its root the residuals of a source, one per size class, are settled from the largest
to the smallest: what the larger one rounds off is carried to the next.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thresher.llm.common import WORD, attach, numbered
from thresher.session import materialize, scratch_dir

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
CAP = 2.0
BLOCK = 64
CLASSES_PER_OCTAVE = 4
SEED = 11
# What names a row and travels with it through the tree.
ROW = ("doc_id", "size", "print", "place", "whole")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, cap: float = CAP) -> DataFrame:
    """``source, key, rank, source_size, rows, target`` for each source.

    Sources by code point, null last, take the weights in turn. The target of a source
    is its weight's part of ``share`` times all words, stopped at ``cap`` times its own
    size; what is cut off goes to the others by weight until none is above. Sorted by
    size per weight, the stopped sources come first, so running sums give the level.
    The window holds one row per source, not per document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = totals.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    )
    limit = cap * F.col("source_size")
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    ahead = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words, mass = F.sum("source_size").over(every), F.sum("weight").over(every)
    level = (share * words - cap * F.coalesce(F.sum("source_size").over(ahead), F.lit(0))) / (
        mass - F.coalesce(F.sum("weight").over(ahead), F.lit(0))
    )
    leveled = ranked.withColumn("level", level).withColumn("stopped", limit <= F.col("level") * F.col("weight"))
    common = F.min(F.when(~F.col("stopped"), F.struct(F.col("source_size") / F.col("weight"), "rank", "level"))).over(every)
    target = F.when(F.col("stopped"), limit).otherwise(F.least(limit, common["level"] * F.col("weight")))
    return leveled.withColumn("target", target.cast("double")).select(
        "source", source_key("source").alias("key"), "rank", "source_size", "rows", "target"
    )


def source_key(source: str) -> Column:
    """The source as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def _item(part: Column, of: Column) -> Column:
    return F.struct(*[of[c].alias(c) for c in ROW], part.alias("part"))


def _ordered() -> Column:
    """The rows of a group in order of size; ties by id, content and place."""
    return F.sort_array(F.collect_list(F.struct("size", "doc_id", "print", "place", "whole", "part")))


def _meet(state: Column, new: Column, level: int) -> Column:
    """One pivotal step: the open document of the block meets the next one."""
    old = state["open"]
    a, b = old["part"], new["part"]
    up = F.least(old["size"] * (1 - a), new["size"] * b)
    down = F.least(old["size"] * a, new["size"] * (1 - b))
    rise = _uniform(old["print"], old["place"], new["print"], new["place"], F.lit(SEED + level)) * (up + down) < down
    old_up = F.when(old["size"] * (1 - a) <= new["size"] * b, 1.0).otherwise(a + up / old["size"])
    new_up = F.when(old["size"] * (1 - a) >= new["size"] * b, 0.0).otherwise(b - up / new["size"])
    old_down = F.when(old["size"] * a <= new["size"] * (1 - b), 0.0).otherwise(a - down / old["size"])
    new_down = F.when(old["size"] * a >= new["size"] * (1 - b), 1.0).otherwise(b + down / new["size"])
    one = _item(F.when(rise, old_up).otherwise(old_down), old)
    two = _item(F.when(rise, new_up).otherwise(new_down), new)
    pair = F.struct(one.alias("one"), two.alias("two"))
    settled = (pair["one"]["part"] <= 0.0) | (pair["one"]["part"] >= 1.0)
    return F.struct(
        F.when(settled, pair["two"]).otherwise(pair["one"]).alias("open"),
        F.concat(state["done"], F.array(F.when(settled, pair["one"]).otherwise(pair["two"]))).alias("done"),
    )


def _step(state: Column, new: Column, level: int) -> Column:
    """A whole open document (nothing is fractional yet) just gives way to the next."""
    a = state["open"]["part"]
    whole = (a <= 0.0) | (a >= 1.0)
    passed = F.struct(new.alias("open"), F.concat(state["done"], F.array(state["open"])).alias("done"))
    return F.when(whole, passed).otherwise(_meet(state, new, level))


def _fold(rows: DataFrame, level: int) -> DataFrame:
    """Fold each block of ``rows`` to at most one fractional document."""
    grouped = rows.groupBy("key", "class", "block").agg(_ordered().alias("items"))
    first = _item(F.element_at("items", 1)["part"], F.element_at("items", 1))
    start = F.struct(first.alias("open"), F.filter(F.array(first), lambda x: F.lit(False)).alias("done"))
    rest = F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0)))
    folded = F.aggregate(rest, start, lambda s, x: _step(s, _item(x["part"], x), level))
    return grouped.select("key", "class", folded.alias("state")).select(
        "key", "class", F.inline(F.concat(F.col("state.done"), F.array("state.open")))
    )


def _settle(rows: DataFrame) -> DataFrame:
    """Root of the tree: a source's residuals, one per size class, largest first.

    A residual is taken with the probability that also makes up for the words carried
    from the larger ones; the last goes to the nearer side, so the words of a source end
    within about half of that document of its target.
    """
    items = F.reverse(_ordered())
    none = F.expr(
        "cast(array() as array<struct<doc_id:bigint,size:bigint,print:bigint,place:bigint,whole:bigint,part:double>>)"
    )
    start = F.struct(F.lit(0.0).alias("carry"), none.alias("done"))

    def settle(state: Column, x: Column) -> Column:
        want = x["part"] + state["carry"] / x["size"]
        last = F.size(state["done"]) + 1 == F.size("items")
        draw = F.when(last, 0.5).otherwise(_uniform(x["print"], x["place"], F.lit(SEED)))
        part = F.when(draw < want, 1.0).otherwise(0.0)
        return F.struct(
            (state["carry"] + x["size"] * (x["part"] - part)).alias("carry"),
            F.concat(state["done"], F.array(_item(part, x))).alias("done"),
        )

    return (
        rows.groupBy("key")
        .agg(items.alias("items"))
        .select("key", F.inline(F.aggregate("items", start, settle)["done"]))
    )


def copies(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``doc_id, key, size, print, place, source_size, target, copies`` for every row of ``sizes``.

    ``sizes`` has ``doc_id, source, size`` and the row's name, ``print`` and ``place`` (made
    of the three if missing). Documents without words cannot move words: their fraction is
    rounded by a hash of the name.
    """
    folder = scratch_dir(sizes.sparkSession)
    if "place" not in sizes.columns:
        sizes = placed(sizes.withColumn("print", F.xxhash64("doc_id", source_key("source"), "size")), folder)
    known = sources.select("key", "source_size", "target", "rows")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(TOTAL_SHARE))
    rows = attach(sizes.withColumn("key", source_key("source")), known, ["key"], "rows", "inner").select(
        "key", *ROW[:-1], F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part")
    )
    empty = rows.filter("size = 0").withColumn(
        "part", F.when(_uniform(F.col("print"), F.col("place"), F.lit(SEED)) < F.col("part"), 1.0).otherwise(0.0)
    )
    open_rows = rows.filter("size > 0").withColumn(
        "class", F.floor(CLASSES_PER_OCTAVE * F.log2("size")).cast("int")
    )
    done = [empty.select("key", *ROW, "part")]
    for level in itertools.count():
        counts = open_rows.groupBy("key", "class").count().withColumnRenamed("count", "members")
        counts = materialize(counts, f"counts{level}", folder)
        largest = counts.agg(F.max("members")).first()[0] or 0
        if largest <= 1 and level:
            break
        slots = F.ceil(F.col("members") / BLOCK)
        dealt = attach(open_rows, counts, ["key", "class"], "members", "inner").withColumn(
            "block", F.pmod(F.xxhash64("print", "place", F.lit(SEED + level)), slots)
        )
        folded = materialize(_fold(dealt, level), f"level{level}", folder)
        settled = (F.col("part") <= 0) | (F.col("part") >= 1)
        done.append(folded.filter(settled).select("key", *ROW, "part"))
        open_rows = folded.filter(~settled)
    done.append(_settle(open_rows).select("key", *ROW, "part"))
    whole = reduce(DataFrame.unionByName, done).withColumn("copies", (F.col("whole") + F.col("part")).cast("int"))
    return attach(whole, known, ["key"], "rows", "inner").select(
        "key", *ROW[:-1], "source_size", "target", "copies"
    )


def content_print() -> Column:
    """Hash of a document's id, source and text; rows that share it are told apart by ``placed``."""
    return F.xxhash64(F.col("doc_id").cast("long"), source_key("source"), F.col("text").cast("string"))


def word_sizes(documents: DataFrame) -> DataFrame:
    """``doc_id, source, size, print`` with the number of words of each whole text."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        content_print().alias("print"),
    )


def placed(rows: DataFrame, folder: str) -> DataFrame:
    """The rows with ``place``: those that share a ``print`` are numbered from 0.

    Only repeated prints are numbered, in blocks, so that a third of all rows may be one
    document. Which of two rows with the same content gets which number is open.
    """
    rows = materialize(rows.withColumn("spot", F.monotonically_increasing_id()), "spots", folder)
    repeated = materialize(rows.groupBy("print").agg(F.count("*").alias("members")).filter("members > 1"), "repeated", folder)
    if repeated.isEmpty():
        return rows.drop("spot").withColumn("place", F.lit(0).cast("long"))
    known = attach(rows, repeated, ["print"], "members")
    alone = known.filter("members is null").withColumn("place", F.lit(0).cast("long"))
    several = materialize(known.filter("members is not null"), "several", folder)
    lined = numbered(several, ["print"], ["spot"], "place").withColumn("place", F.col("place").cast("long"))
    return materialize(alone.unionByName(lined).drop("spot", "members"), "placed", folder)


def mix(documents: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for every document.

    ``taken`` is the document's size times its copies (0, 1 or 2). Null texts have no
    words; a null source is a source of its own, the last; null ids and repeated rows
    stay rows of their own; ties in size fall by id and content; an empty table gives no
    rows. The draws are hashes of content, so reruns agree on any partitioning.
    """
    return _mixed(documents).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def _mixed(documents: DataFrame) -> DataFrame:
    folder = scratch_dir(documents.sparkSession)
    sizes = placed(word_sizes(documents), folder)
    return copies(sizes, materialize(targets(sizes), "sources", folder))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns of any name.

    Copies go to the row that earned them, by its content: two sources may use one id.
    Only documents whose content repeats (extra columns may differ) are numbered again;
    the others meet their copies on the hash alone, broadcast if measured small.
    """
    folder = scratch_dir(documents.sparkSession)
    rows = documents.select(F.struct("*").alias("row"), content_print().alias("print"))
    taken = materialize(_mixed(documents).select("print", "place", "copies"), "taken", folder)
    repeated = taken.groupBy("print").agg(F.count("*").alias("members")).filter("members > 1")
    repeated = materialize(repeated, "shared", folder)
    chosen = taken.filter("copies > 0").withColumn("members", F.lit(1))
    if repeated.isEmpty():
        found = attach(rows, chosen.select("print", "copies", "members"), ["print"], "members", "inner")
    else:
        known = attach(rows, repeated, ["print"], "members")
        several = placed(known.filter("members is not null").drop("members"), folder)
        rows = known.filter("members is null").select("row", "print", F.lit(0).cast("long").alias("place"))
        rows = rows.unionByName(several.select("row", "print", "place"))
        found = attach(rows, chosen, ["print", "place"], "members", "inner")
    again = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return found.select("row", again).select("row.*")
