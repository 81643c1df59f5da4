"""A deterministic template miner.

Values with a recognizable shape are masked; the constants around them identify
the line's pattern. Every pattern yields one candidate template. The statistics
that decide which positions are fixed words (branches) and which carry instance
data (fruits) come from one pass over the lines that keeps a bounded set of value
hashes for each position, so even a pattern with most of the lines is reduced
before the exchange. Words that act as values are found by a tree over the words'
positions, and patterns that differ there become one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thresher.functions import text as X
from thresher.functions.dialect import captured_values, with_compiled
from thresher.schemas import LIBRARY_KEY, LINE_KEY
from thresher.session import bounded, materialize, scratch_dir, spread

# Shapes of instance data, most specific first. Only constructs
# that mean the same in Java, RE2 and Python.
SHAPES = {
    "json": r"\{[^{}]*\}",
    "time": (
        r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?"
        r"|[A-Z][a-z]{2} +[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
    ),
    "url": r"https?://[^ ]+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "uuid": r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    "mac": r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "hex": r"0x[0-9A-Fa-f]+",
    "num": r"[0-9]+(?:\.[0-9]+)?",
}
ANY_SHAPE = "|".join(f"(?:{shape})" for shape in SHAPES.values())
# Digits between the letters of a word that starts with a letter belong to the word.
NAME = r"[A-Za-z]+[0-9]+[A-Za-z]+"
# A word, with the digits that such names hold.
WORD = "[A-Za-z_][A-Za-z0-9_]*"
# Around a value in a masked text; the second pair serves texts that hold the first.
EDGES = (("\x11", "\x12"), ("\x13", "\x14"))

# A slot is a branch from this support on, if it only ever showed one value.
BRANCH_SUPPORT = 10
# A position with more values than this is open (instance data).
OPEN_VALUES = 20
# So many other words must remain when a word becomes a slot; a template with
# hardly any constant text would match lines of every kind.
KEPT_WORDS = 2
SPREAD_PATTERNS = 64
BROADCAST_LIMIT = 256 << 20
# Positions whose values one task holds at a time.
HELD_SLOTS = 50_000

# Patterns whose words, of so many bytes in all, the driver takes apart at once.
TREE_BYTES = 8 << 20

# Joins constants while words are looked at; patterns containing it are left alone.
SLOT = "\x00"


def shape_of(value: Column) -> Column:
    kind = F.lit("word")
    for name, shape in reversed(SHAPES.items()):
        kind = F.when(value.rlike(rf"\A(?:{shape})\z"), F.lit(name)).otherwise(kind)
    # A payload may be deeper than its flat shape.
    return F.when(F.startswith(value, F.lit("{")) & F.endswith(value, F.lit("}")), F.lit("json")).otherwise(kind)


_NAMED = f"((?<![0-9A-Za-z_]){NAME.replace('+', '++')})"


def _mask(email: bool, json: bool) -> str:
    """Three groups: values other than numbers, names with digits inside, numbers.

    The engine takes the leftmost match and, there, the first group, so a name counts
    only where no other shape begins and only from its first letter on.
    """
    left_out = {"num"} | ({"email"} if not email else set()) | ({"json"} if not json else set())
    values = "|".join(f"(?:{shape})" for name, shape in SHAPES.items() if name not in left_out)
    return f"({values})|{_NAMED}|({SHAPES['num']})"


# Every shape and name holds one of these: a digit, a brace, an at sign, the mark of a
# url, or the letters around two hyphens or colons of a uuid or mac without digits.
_MAY_HOLD = r"[0-9{@]|://|[A-Fa-f]{4}-[A-Fa-f]{4}-|[A-Fa-f]{2}:[A-Fa-f]{2}:"


def _marked(text: Column, edges: tuple[str, str], json: bool = True) -> Column:
    """The text with each value between two marks; a name is left as it is."""
    start, end = edges

    def cut(email: bool) -> Column:
        return F.replace(
            F.regexp_replace(text, _mask(email, json), f"$2{start}$1$3{end}"), F.lit(start + end), F.lit("")
        )

    # Without these characters only names and whole numbers can occur, and without an at
    # sign not the costliest shape.
    numbers = F.regexp_replace(text, f"{_NAMED}|({SHAPES['num']})", f"$1{start}$2{end}")
    plain = F.replace(numbers, F.lit(start + end), F.lit(""))
    return F.when(~text.rlike(_MAY_HOLD), text).when(~text.rlike(r"[{:@.\-]|0x"), plain).when(text.contains("@"), cut(True)).otherwise(cut(False))


def _pieces(text: Column, edges: tuple[str, str]) -> Column:
    start, end = edges
    parts = F.when(X.deep_payloads(text), X.payload_parts(text))
    deep = F.array_join(
        F.transform(
            parts,
            lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(start), p, F.lit(end))).otherwise(_marked(p, edges, False)),
        ),
        "",
    )
    return F.split(F.coalesce(deep, _marked(text, edges)), f"[{start}{end}]", -1)


def line_tokens(text: Column) -> Column:
    """Constants (even places) and values (odd places) of a text.

    Values are the shapes above, with a JSON-like payload as a whole however deep it is.
    A text that holds the marks of both pairs of edges is one constant.
    """
    tokens = F.array(text)
    for edges in reversed(EDGES):
        holds = text.contains(edges[0]) | text.contains(edges[1])
        tokens = F.when(holds, tokens).otherwise(_pieces(text, edges))
    return tokens


def constants_of(tokens: Column) -> Column:
    return F.filter(tokens, lambda t, i: i % 2 == 0)


def values_of(tokens: Column) -> Column:
    return F.filter(tokens, lambda t, i: i % 2 == 1)


def mask_lines(lines: DataFrame) -> DataFrame:
    """Non-empty lines with ``pattern_id``, ``constants`` and masked ``slot_values``."""
    return _masked(lines.filter(F.col("transformed") != ""))


def _masked(lines: DataFrame) -> DataFrame:
    return (
        lines.withColumn("_tokens", line_tokens(F.col("transformed")))
        .withColumn("constants", constants_of(F.col("_tokens")))
        .withColumn("slot_values", values_of(F.col("_tokens")))
        .withColumn("pattern_id", F.md5(F.to_json("constants").cast("binary")))
        .drop("_tokens")
    )


# What mining needs of a line.
MARKS = ["pattern_id", "hashes"]


def with_marks(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Lines with their key, ``columns`` and ``MARKS``: the pattern and a hash of each value."""
    hashes = F.transform("slot_values", lambda v: F.xxhash64(v)).alias("hashes")
    return _masked(lines).select(*LINE_KEY, *LIBRARY_KEY, *columns, "pattern_id", hashes)


_PARTIAL = (
    "device_type string, vendor string, pattern_id string, source_id string, line_number long,"
    " support long, slots array<array<long>>"
)


def _grouped(batch: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows, those that agree in ``columns`` side by side, and where each group starts."""
    codes = np.zeros(batch.num_rows, np.int64)
    for column in columns:
        own = batch[column].dictionary_encode(null_encoding="encode")
        # Numbered anew after each column, so the codes stay below the square of the rows.
        codes = np.unique(codes * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    return order, np.concatenate(([0], np.flatnonzero(np.diff(codes[order])) + 1))


_NO_LINE = 2**63 - 1


class _Held:
    """What a task knows of the patterns it has seen: support, first line, values by position."""

    def __init__(self, most: int):
        self.most, self.rows, self.slots = most, {}, 0

    def add(self, batch: pa.RecordBatch) -> None:
        # Lists of one pattern have one length, so its values are a rectangle of numbers.
        flat, ends = batch["hashes"].flatten().to_numpy(), batch["hashes"].offsets.to_numpy()
        ends = ends - ends[0]
        columns = ["device_type", "vendor", "pattern_id", "source_id"]
        order, starts = _grouped(batch, columns)
        numbers = batch["line_number"].fill_null(_NO_LINE).to_numpy()[order]
        heads = batch.select(columns).take(pa.array(order[starts]))
        groups = zip(*(heads[c].to_pylist() for c in columns), np.minimum.reduceat(numbers, starts).tolist(), np.split(order, starts[1:]))
        for device, vendor, pattern, source, number, places in groups:
            k, first = (device, vendor, pattern), (source, None if number == _NO_LINE else number)
            width = int(ends[places[0] + 1] - ends[places[0]])
            held = self.rows.get(k)
            if held is None:
                held = self.rows[k] = [first, 0, [set() for _ in range(width)]]
                self.slots += width + 1
            held[0], held[1] = min(held[0], first), held[1] + len(places)
            if len(places) == 1:
                begin = ends[places[0]]
                for seen, value in zip(held[2], flat[begin : begin + width].tolist()):
                    if len(seen) < self.most:
                        seen.add(value)
                continue
            values = flat[ends[places][:, None] + np.arange(width)]
            for position, seen in enumerate(held[2]):
                if len(seen) < self.most:
                    seen.update(np.unique(values[:, position])[: self.most].tolist())

    def release(self) -> pa.RecordBatch:
        rows, self.rows, self.slots = self.rows, {}, 0
        found = [(*k, *first, n, [sorted(s)[: self.most] for s in slots]) for k, (first, n, slots) in rows.items()]
        columns = list(zip(*found)) if found else [()] * 7
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64()))]
        names = ["device_type", "vendor", "pattern_id", "source_id", "line_number", "support", "slots"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def slot_statistics(lines: DataFrame, open_values: int = OPEN_VALUES) -> DataFrame:
    """Per library, pattern and position; position 0 stands for the pattern itself.

    ``values`` is the exact number of different values up to ``open_values``, else
    ``open_values`` + 1. Lines are masked (unless they come from `with_marks`) and read
    once: a task keeps at most that many value hashes for each position of the patterns it
    meets, hands them on when it holds ``HELD_SLOTS`` positions, and only these sets are
    exchanged.
    """
    group, most = [*LIBRARY_KEY, "pattern_id"], open_values + 1
    marked = lines if set(MARKS) <= set(lines.columns) else with_marks(lines.filter(F.col("transformed") != ""), [])
    masked = marked.select(*group, *LINE_KEY, "hashes")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Held(most)
        for batch in batches:
            if batch.num_rows:
                task.add(batch)
            if task.slots >= HELD_SLOTS:
                yield task.release()
        yield task.release()

    partial = masked.mapInArrow(held, _PARTIAL)
    sets = F.concat(F.array(F.array(F.lit(0).cast("bigint"))), "slots")
    placed = partial.select(
        *group, *LINE_KEY, "support", F.posexplode(sets).alias("position", "hashes")
    ).select("*", F.posexplode("hashes").alias("n", "hash"))
    counted = F.when(F.col("n") == 0, F.col("support"))
    by_value = placed.groupBy(*group, "position", "hash", "source_id").agg(
        F.sum(counted).alias("support"), F.min("line_number").alias("line_number")
    )
    by_value = by_value.groupBy(*group, "position", "hash").agg(
        F.sum("support").alias("support"), F.min(F.struct(*LINE_KEY)).alias("first")
    )
    distinct = F.least(F.count(F.lit(1)), F.lit(most)).cast("bigint")
    return by_value.groupBy(*group, "position").agg(
        F.sum("support").alias("support"),
        F.min("first").alias("first"),
        distinct.alias("values"),
        (F.count(F.lit(1)) == 1).alias("single"),
    )


def mine_patterns(lines: DataFrame, open_values: int = OPEN_VALUES) -> DataFrame:
    """Patterns with support, first line, that line's text and slot statistics."""
    return with_sample(pattern_statistics(lines, open_values), lines)


def pattern_statistics(lines: DataFrame, open_values: int = OPEN_VALUES) -> DataFrame:
    """Patterns with support, first line and slot statistics."""
    key = [*LIBRARY_KEY, "pattern_id"]
    # A pattern has as many positions as one line has values.
    return (
        slot_statistics(lines, open_values)
        .groupBy(*key)
        .agg(
            F.max(F.when(F.col("position") == 0, F.col("support"))).alias("support"),
            F.min("first").alias("first"),
            F.array_sort(
                F.collect_list(
                    F.when(F.col("position") > 0, F.struct("position", "values", "single"))
                )
            ).alias("slots"),
        )
        .select(*key, "support", "first.*", "slots")
    )


def changed_statistics(
    lines: DataFrame, earlier: DataFrame, lost: DataFrame, open_values: int = OPEN_VALUES
) -> DataFrame:
    """`pattern_statistics` of ``lines`` (with ``MARKS``) from those of more lines.

    ``earlier``: the statistics before lines were taken away; ``lost``: library and id of
    the patterns they belonged to. Only what is left of those is counted again.
    """
    table = materialize(lost, "lost")
    small = bounded(table, [*LIBRARY_KEY, "pattern_id"], BROADCAST_LIMIT)

    def of_lost(rows: DataFrame, how: str) -> DataFrame:
        side = F.broadcast(table) if small else table
        same = [rows[c].eqNullSafe(table[c]) for c in [*LIBRARY_KEY, "pattern_id"]]
        return rows.join(side, same, how)

    again = pattern_statistics(of_lost(lines, "left_semi"), open_values)
    return of_lost(earlier, "left_anti").unionByName(again)


def with_sample(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``raw`` and ``transformed`` of the row's first line.

    The rows go to the lines while their keys are measured small, so that the text of
    the other lines is not exchanged.
    """
    table = materialize(rows, "rows")
    if bounded(table, [F.to_json(F.struct(*table.columns))], BROADCAST_LIMIT):
        table = F.broadcast(table)
    return lines.select(*LINE_KEY, "raw", "transformed").join(table, LINE_KEY)


def classify_slots(
    lines: DataFrame, min_support: int = BRANCH_SUPPORT, open_values: int = OPEN_VALUES
) -> DataFrame:
    """Role of each slot, with its number of different values up to ``open_values`` + 1."""
    distinct = F.least("values", F.lit(open_values + 1))
    branch = (F.col("support") >= min_support) & (distinct == 1)
    return (
        slot_statistics(lines, open_values)
        .filter("position > 0")
        .select(
            *LIBRARY_KEY,
            "pattern_id",
            "position",
            "support",
            distinct.cast("bigint").alias("distinct_values"),
            F.when(branch, "branch").otherwise("fruit").alias("role"),
        )
    )


# --- words that behave like values -------------------------------------------


_NODE = [*LIBRARY_KEY, "n1", "n2"]


def _joined(constants: Column) -> Column:
    return F.array_join(constants, SLOT)


def _spelled(patterns: DataFrame, kept_words: int) -> DataFrame:
    """Words and what stands between them, of patterns with more than ``kept_words`` words."""
    joined = _joined(constants_of(F.col("_tokens")))
    return (
        patterns.filter(~F.contains(F.col("transformed"), F.lit(SLOT)))
        # A generator stops the filter below, which would mask the lines a second time.
        .select(*LIBRARY_KEY, "pattern_id", F.explode(F.array(line_tokens(F.col("transformed")))).alias("_tokens"))
        .select(
            *LIBRARY_KEY,
            "pattern_id",
            F.regexp_extract_all(joined, F.lit(WORD), F.lit(0)).alias("words"),
            F.split(joined, WORD, -1).alias("seps"),
        )
        .filter(F.size("words") > kept_words)
    )


def _rooted(spelled: DataFrame, key: list[str], *columns: str) -> DataFrame:
    """Patterns with the node of all that agree in what stands between their words."""
    return spelled.select(
        *key, *columns, F.xxhash64(F.lit(1), "seps").alias("n1"), F.xxhash64(F.lit(2), "seps").alias("n2")
    )


def _large(rows: DataFrame, open_values: int, folder: str, name: str) -> DataFrame:
    """Rows of nodes with more than ``open_values`` patterns; only those can hold an open word."""
    sizes = rows.groupBy(*_NODE).count().filter(F.col("count") > open_values).select(*_NODE)
    return rows.join(_broadcast_if_small(sizes, folder, f"{name}_sizes"), _NODE, "left_semi")


def _broadcast_if_small(rows: DataFrame, folder: str, name: str) -> DataFrame:
    table = materialize(rows, name, folder)
    return F.broadcast(table) if bounded(table, ["device_type", "vendor"], BROADCAST_LIMIT) else table


def _spaced(patterns: DataFrame, kept_words: int) -> DataFrame:
    """The words of patterns and their root, written: masking and cutting long lines is dear."""
    spelled = _spelled(patterns, kept_words)
    return materialize(_rooted(spelled, [*LIBRARY_KEY, "pattern_id"], "words", "seps"), "spaced")


def _small_tree(active: DataFrame, open_values: int, kept_words: int) -> list[tuple]:
    """What `open_word_tree` finds below the nodes of a few patterns, on the driver.

    Each level of the tree is a few small jobs, and there are as many as words, while few
    patterns are left below the first ones.
    """
    nodes: dict[tuple, list] = {}
    for r in active.toLocalIterator():
        nodes.setdefault((r.device_type, r.vendor, f"t:{r.n1}:{r.n2}"), []).append((r.pattern_id, r.words))
    found, waiting = [], list(nodes.items())
    while waiting:
        (device, vendor, node), members = waiting.pop()
        if len(members) <= open_values:
            continue
        counts = [len({words[at] for _, words in members}) for at in range(len(members[0][1]))]
        open_words = [at for at, n in enumerate(counts) if n > open_values]
        few = min(((n, at) for at, n in enumerate(counts) if 1 < n <= open_values), default=None)
        if few is None and counts.count(1) >= max(kept_words, len(open_words)):
            split = None
        else:
            split = few or min(((counts[at], at) for at in open_words), default=None)
        if split is None:
            found += [(device, vendor, pattern, node, open_words) for pattern, _ in members]
            continue
        children: dict[str, list] = {}
        for member in members:
            children.setdefault(member[1][split[1]], []).append(member)
        waiting += [((device, vendor, f"{node}:{split[1]}={word}"), own) for word, own in children.items()]
    return found


_FOUND = "device_type string, vendor string, pattern_id string, merged string, open_words array<int>"


def open_word_tree(
    patterns: DataFrame, open_values: int = OPEN_VALUES, kept_words: int = KEPT_WORDS, spaced: DataFrame | None = None
) -> DataFrame:
    """``pattern_id, merged, open_words``: patterns whose words differ at open positions only.

    A tree over word positions, grown level by level for all libraries at once. Its roots
    are the patterns that agree in everything between their words. A node whose positions
    hold one word or more than ``open_values`` words is one template, if ``kept_words`` or
    more positions hold one word and no fewer do than are open; its patterns merge there.
    Any other node splits on the position with the fewest words (of two or more, and
    leftmost), because few words tell events apart. A node of up to ``open_values``
    patterns has no open position and is left alone. A split fixes a position, so there
    are no more levels than words. What is left when it is measured small is one job.
    ``spaced``: the written words of the patterns, if there are any yet.
    """
    spark, folder = patterns.sparkSession, scratch_dir(patterns.sparkSession)
    key = [*LIBRARY_KEY, "pattern_id"]
    roots = (_spaced(patterns, kept_words) if spaced is None else spaced).select(*_NODE, "pattern_id", "words")
    active = materialize(_large(roots, open_values, folder, "roots"), "active_0", folder)
    found = spark.createDataFrame([], _FOUND)
    level = 0
    while not active.isEmpty():
        if bounded(active, [F.array_join("words", "")], TREE_BYTES):
            rest = spark.createDataFrame(_small_tree(active, open_values, kept_words), _FOUND)
            return materialize(found.unionByName(rest), "found", folder)
        level += 1
        placed = active.select(*_NODE, F.posexplode("words").alias("at", "word"))
        values = placed.distinct().groupBy(*_NODE, "at").agg(F.count(F.lit(1)).alias("n"))
        many, few = F.col("n") > open_values, (F.col("n") > 1) & (F.col("n") <= open_values)
        nodes = values.groupBy(*_NODE).agg(
            F.count_if(F.col("n") == 1).alias("fixed"),
            F.min(F.when(few, F.struct("n", "at"))).alias("few"),
            F.min(F.when(many, F.struct("n", "at"))).alias("many"),
            F.sort_array(F.collect_list(F.when(many, F.col("at")))).alias("open_words"),
        )
        whole = F.col("few").isNull() & (F.col("fixed") >= F.greatest(F.lit(kept_words), F.size("open_words")))
        split = F.coalesce("few.at", "many.at")
        nodes = nodes.select(*_NODE, "open_words", F.when(~whole, split).alias("split"))
        nodes = _broadcast_if_small(nodes, folder, f"nodes_{level}")
        judged = active.join(nodes, _NODE)
        done = judged.filter("split is null").select(
            *key, F.concat_ws(":", F.lit("t"), "n1", "n2").alias("merged"), "open_words"
        )
        found = found.unionByName(materialize(done, f"found_{level}", folder))
        word = F.get("words", F.col("split"))
        children = judged.filter("split is not null").select(
            *key,
            "words",
            F.xxhash64("n1", "split", word).alias("n1"),
            F.xxhash64("n2", "split", word).alias("n2"),
        )
        children = materialize(children, f"children_{level}", folder)
        active = materialize(_large(children, open_values, folder, f"children_{level}"), f"active_{level}", folder)
    return found


def open_word_places(
    patterns: DataFrame, open_values: int = OPEN_VALUES, kept_words: int = KEPT_WORDS, spaced: DataFrame | None = None
) -> DataFrame:
    """``pattern_id, merged, open_words``: patterns that differ in a single open word.

    A pattern is hashed once per word with that word left out; patterns that meet
    under a hash differ in that word only, so their number is the number of
    words. No pairs of patterns are formed.
    """
    key, place = [*LIBRARY_KEY, "pattern_id"], [*LIBRARY_KEY, "n_words", "word_at", "h1", "h2"]

    def fold(seed: int) -> Column:
        tokens = F.concat(F.col("words"), F.col("seps"))
        return F.aggregate(
            F.transform(tokens, lambda t, i: F.xxhash64(F.lit(seed), i, t)),
            F.lit(0).cast("bigint"),
            lambda acc, h: acc.bitwiseXOR(h),
        )

    # Patterns that meet agree in everything between their words, like a tree's root.
    spaced = _spaced(patterns, kept_words) if spaced is None else spaced
    spelled = (
        _large(spaced, open_values, scratch_dir(patterns.sparkSession), "spaced")
        .withColumn("h1", fold(1))
        .withColumn("h2", fold(2))
        .select(
            *key,
            F.size("words").alias("n_words"),
            "h1",
            "h2",
            F.posexplode("words").alias("word_at", "word"),
        )
        .select(
            *key,
            "n_words",
            "word_at",
            F.col("h1").bitwiseXOR(F.xxhash64(F.lit(1), "word_at", "word")).alias("h1"),
            F.col("h2").bitwiseXOR(F.xxhash64(F.lit(2), "word_at", "word")).alias("h2"),
        )
    )
    # Numbers only: partial aggregation keeps a hot place small.
    open_places = (
        spelled.groupBy(*place)
        .agg(F.count(F.lit(1)).alias("n_values"))
        .filter(F.col("n_values") > open_values)
    )
    merged = F.concat_ws(":", F.lit("w"), "c.n_words", -F.col("c.col2"), "c.h1", "c.h2")
    return (
        spelled.join(open_places, place)
        .groupBy(*key)
        .agg(F.max(F.struct("n_values", -F.col("word_at"), "n_words", "h1", "h2")).alias("c"))
        .select(*key, merged.alias("merged"), F.array(-F.col("c.col2")).alias("open_words"))
    )


def generalize_words(
    patterns: DataFrame, open_values: int = OPEN_VALUES, kept_words: int = KEPT_WORDS
) -> DataFrame:
    """Merge patterns that differ in words with more than ``open_values`` values.

    The tree over word positions finds patterns with any number of open words; patterns
    it leaves alone are then compared with one word left out, which also finds a family
    that a split has taken apart. At least ``kept_words`` other words must remain.

    Adds ``open_words``, the places of the replaced words, null where nothing merged.
    Reads ``patterns`` several times: pass a materialized table.
    """
    key, place = [*LIBRARY_KEY, "pattern_id"], [*LIBRARY_KEY, "merged"]
    alike = patterns.withColumn("open_words", F.lit(None).cast("array<int>"))
    if patterns.limit(open_values + 1).count() <= open_values:
        return alike
    spaced = _spaced(patterns, kept_words)
    chosen = open_word_tree(patterns, open_values, kept_words, spaced)
    rest = patterns.join(chosen.select(*key), key, "left_anti")
    if rest.limit(open_values + 1).count() > open_values:
        left = spaced.join(chosen.select(*key), key, "left_anti")
        chosen = chosen.unionByName(open_word_places(rest, open_values, kept_words, left))
    chosen = materialize(chosen, "open_words")
    if chosen.isEmpty():
        return alike
    joined_rows = patterns.join(chosen, key, "left")
    alone = joined_rows.filter(F.col("merged").isNull()).drop("merged")
    merging = joined_rows.filter(F.col("merged").isNotNull())
    totals = merging.groupBy(*place).agg(
        F.sum("support").alias("support"), F.min(F.struct(*LINE_KEY)).alias("first")
    )
    # Slot statistics of the merged pattern: at least as open as any member's.
    slot_stats = (
        merging.select(*place, F.explode("slots").alias("s"))
        .groupBy(*place, F.col("s.position").alias("position"))
        .agg(F.max("s.values").alias("values"), F.min("s.single").alias("single"))
        .groupBy(*place)
        .agg(F.array_sort(F.collect_list(F.struct("position", "values", "single"))).alias("slots"))
    )
    leaders = merging.drop("support", "slots").join(
        totals.select(*place, "support", "first.*"), [*place, *LINE_KEY]
    )
    merged = leaders.join(slot_stats, place, "left").drop("merged")
    # A slot equal within each member may still differ between members.
    merged = merged.withColumn(
        "slots",
        F.transform(
            F.coalesce("slots", F.array().cast(patterns.schema["slots"].dataType)),
            lambda s: s.withField("single", F.lit(False)),
        ),
    )
    return alone.unionByName(merged)


def _with_word_slots(patterns: DataFrame, open_values: int) -> DataFrame:
    """``constants``, ``slot_values``, ``kinds`` and ``slots`` with merged words as slots.

    ``_origin`` lists the slots of the line in order: 0 for a value, n for the n-th word.
    """
    joined = _joined(F.col("constants"))
    opened = F.col("open_words").isNotNull()

    def is_open(i: Column) -> Column:
        return F.array_contains("open_words", i)

    words = F.transform("_words", lambda w, i: F.when(is_open(i), F.lit(SLOT)).otherwise(w))
    origin = F.flatten(
        F.transform(
            "_seps",
            lambda sep, i: F.concat(
                F.array_repeat(F.lit(0), F.length(sep) - F.length(F.replace(sep, F.lit(SLOT), F.lit("")))),
                F.when(is_open(i), F.array(i + 1)).otherwise(F.array().cast("array<int>")),
            ),
        )
    )

    def placed(of_value, of_word: Column | None = None):
        """An array over all slots from one over the values."""

        def pick(o: Column, i: Column) -> Column:
            at = F.size(F.filter(F.slice("_origin", 1, i + 1), lambda x: x == 0))
            word = F.get("_words", o - 1) if of_word is None else of_word
            return F.when(o > 0, word).otherwise(F.get(of_value, at - 1))

        return F.transform("_origin", pick)

    word_stats = F.struct(
        F.lit(0).alias("position"),
        F.lit(open_values + 1).cast("bigint").alias("values"),
        F.lit(False).alias("single"),
    )
    return (
        patterns.withColumn("_tokens", line_tokens(F.col("transformed")))
        .withColumn("constants", constants_of(F.col("_tokens")))
        .withColumn("slot_values", values_of(F.col("_tokens")))
        .withColumn("kinds", F.transform("slot_values", shape_of))
        .withColumn("_words", F.when(opened, F.regexp_extract_all(joined, F.lit(WORD), F.lit(0))))
        .withColumn("_seps", F.when(opened, F.split(joined, WORD, -1)))
        .withColumn("_origin", F.when(opened, origin))
        .withColumn("constants", F.when(opened, F.split(X.interleave(F.col("_seps"), words), SLOT, -1)).otherwise(F.col("constants")))
        .withColumn("kinds", F.when(opened, placed("kinds", F.lit("word"))).otherwise(F.col("kinds")))
        .withColumn("slots", F.when(opened, placed("slots", word_stats)).otherwise(F.col("slots")))
        .withColumn("slot_values", F.when(opened, placed("slot_values")).otherwise(F.col("slot_values")))
        .drop("_tokens", "_words", "_seps", "_origin")
    )


def _slot_texts(pinned: Column, regex: bool) -> Column:
    """Per slot its literal value where ``pinned``, else its group or placeholder."""

    def piece(i: Column) -> Column:
        name = F.concat(F.get("kinds", i), (i + 1).cast("string"))
        value = F.get("slot_values", i)
        if regex:
            return F.when(F.get(pinned, i), X.regex_literal(value)).otherwise(
                F.concat(F.lit("(?P<"), name, F.lit(">.*)"))
            )
        return F.when(F.get(pinned, i), value).otherwise(F.concat(F.lit("<"), name, F.lit(">")))

    return F.transform(slot_numbers(), piece)


def slot_numbers() -> Column:
    return F.when(
        F.size("slot_values") > 0, F.sequence(F.lit(0), F.size("slot_values") - 1)
    ).otherwise(F.array().cast("array<int>"))


def build_candidates(rows: DataFrame, pinned: Column) -> DataFrame:
    """Regex, template, variables, constants and id for slots pinned or open."""
    spelled = (
        rows.withColumn("_pinned", pinned)
        .withColumn(
            "regex",
            X.interleave(F.transform("constants", X.regex_literal), _slot_texts(F.col("_pinned"), True)),
        )
        .withColumn("template", X.interleave(F.col("constants"), _slot_texts(F.col("_pinned"), False)))
        .drop("_pinned")
    )
    values = captured_values(F.col("transformed"), F.col("mode"), F.col("capture"), F.col("names"))
    return (
        with_compiled(spelled)
        .withColumn("variables", X.template_variables(F.col("names"), values))
        .withColumn("template_constants", X.extract_constants(F.col("template")))
        .withColumn(
            "candidate_id",
            X.template_digest_id(F.col("device_type"), F.col("vendor"), F.col("template")),
        )
    )


def mine_candidates(
    lines: DataFrame,
    *,
    min_support: int = 1,
    branch_support: int = BRANCH_SUPPORT,
    open_values: int = OPEN_VALUES,
    kept_words: int = KEPT_WORDS,
) -> DataFrame:
    """One candidate template per pattern of the uncovered lines."""
    found = mine_patterns(lines, open_values).filter(F.col("support") >= min_support)
    return pattern_candidates(
        materialize(found, "patterns"), branch_support=branch_support, open_values=open_values, kept_words=kept_words
    )


def pattern_candidates(
    table: DataFrame,
    *,
    branch_support: int = BRANCH_SUPPORT,
    open_values: int = OPEN_VALUES,
    kept_words: int = KEPT_WORDS,
) -> DataFrame:
    """One candidate template per pattern of a written table of `mine_patterns`."""
    # Few bytes but much work per pattern.
    table = spread(table, SPREAD_PATTERNS)
    patterns = generalize_words(table, open_values, kept_words)
    # Slots that the candidate spells out from the start.
    branches = F.transform(
        "slots", lambda s: s["single"] & (F.col("support") >= branch_support)
    )
    rows = _with_word_slots(patterns, open_values).withColumn("branches", branches)
    return build_candidates(rows, F.col("branches"))
