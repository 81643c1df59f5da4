"""SimHash near-duplicates: pigeonhole blocks, then exact Hamming distance.

``near_duplicates`` keeps to two bits of 64. Texts whose shingles agree in 0.8 of their
union lie 10 bits apart on average and up to 20, a radius no block of useful width
survives. ``deduplicated`` takes the two-bit links of five-word fingerprints as its first
candidates, adds those of MinHash bands, which find what lies further apart, and decides
each by the exact similarity of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from thresher.llm.common import attach, components
from thresher.session import bounded, materialize, scratch_dir

DISTANCE = 2
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
GROUP_LIMIT = 128
SEED = 42
CHUNK = 200_000
WIDTH, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 32, 5  # a pair at 0.8 shares no band once in 300,000 times
MARGIN = 0.2  # a pair at 0.8 agrees in under 0.6 of its 160 marks once in 100 million times
HASHED = 512
FAN_ROWS = 256
IDS_BYTES = 128 << 20
SLICE_ROWS = 512
CELL_ROWS, CELL_BYTES = 1000, 8 << 20


_PICK = np.random.default_rng(SEED)
_FLIP, _FACTOR = _PICK.integers(0, 2**64, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
_FACTOR |= np.uint64(1)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of the ``width``-word shingles of one whole text.

    Bit i is set if it is set in over half of the shingle hashes. A text with fewer
    words is one shingle; a null text or one without words gives zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - width + 1)
    stops = ends[min(width, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, last, CHUNK):
        spans = zip(starts[at : min(at + CHUNK, last)].tolist(), stops[at : at + CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` with the fingerprint as a signed 64-bit number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.record_batch({"doc_id": batch["doc_id"], "fingerprint": values.view(np.int64)})

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, fingerprint long")


def _block(i: int) -> Column:
    return F.shiftrightunsigned("fingerprint", i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def links(values: DataFrame) -> DataFrame:
    """All pairs of distinct fingerprints at ``DISTANCE`` (2) bits or fewer.

    Two flipped bits touch at most two of four blocks, so close pairs agree in two:
    rows meet on each of the six pairs of blocks, and the distance is then checked.
    Rows of a block group above ``GROUP_LIMIT`` meet instead on every value one bit
    away from them: a close pair always has such a value in common, and no value
    has more than 65 rows. Nothing is dropped and no group emits all its pairs.
    """
    folder = scratch_dir(values.sparkSession)
    keys = [
        F.struct(F.lit(n).alias("table"), F.shiftleft(_block(i), BLOCK_BITS).bitwiseOR(_block(j)).alias("bits"))
        for n, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE))
    ]
    keyed = values.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    counts = keyed.groupBy("key").count().filter("count > 1")
    shared = materialize(keyed.join(counts, "key"), "blocks", folder)
    cold = shared.filter(F.col("count") <= GROUP_LIMIT).drop("count")
    hot = shared.filter(F.col("count") > GROUP_LIMIT).select("fingerprint").distinct()
    flips = [F.lit(0).cast("long")] + [F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)]
    near = hot.select(
        "fingerprint", F.explode(F.transform(F.array(*flips), lambda f: f.bitwiseXOR(F.col("fingerprint")))).alias("key")
    )
    found = [
        rows.join(rows.select("key", F.col("fingerprint").alias("other")), "key")
        .filter((F.col("fingerprint") > F.col("other")))
        .filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= DISTANCE)
        .select(F.col("fingerprint").alias("a"), F.col("other").alias("b"))
        for rows in (cold, near)
    ]
    return reduce(DataFrame.union, found).distinct()


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links. Copies share one
    fingerprint and are compared once. Null and wordless texts have fingerprint zero
    and link like any other. A null id keeps its row and never names a component
    (which is null if no member has an id). Repeated rows stay. Other columns are
    ignored. An empty table gives no rows.
    """
    folder = scratch_dir(documents.sparkSession)
    prints = materialize(fingerprints(documents, doc_id, text), "prints", folder)
    classes = materialize(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")), "classes", folder
    )
    roots = components(links(classes.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    rooted = classes.join(roots, "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint")
    )
    lowest = rooted.groupBy("component").agg(F.min("low").alias("component_id"))
    named = materialize(
        rooted.join(lowest, "component").select("fingerprint", "rows", "component_id"), "named", folder
    )
    return attach(prints, named, ["fingerprint"], "rows").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of one whole text.

    A text with fewer words is one shingle; one without words has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    last, digest = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    return np.unique(
        np.fromiter((digest(b" ".join(words[i : i + width]), SEED) for i in range(last)), np.uint64, last)
    )


def minima(hashes: np.ndarray) -> np.ndarray:
    """The ``BANDS * BAND_ROWS`` MinHash values of a set of shingle hashes."""
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), HASHED):
        least = np.minimum(least, ((hashes[at : at + HASHED] ^ _FLIP) * _FACTOR).min(axis=1))
    return least


def bands(least: np.ndarray) -> list[int]:
    """A key for each of ``BANDS`` groups of ``BAND_ROWS`` MinHash values; its low bits number the group."""
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, BAND_ROWS))]
    keys = np.array(keys, np.uint64) // np.uint64(BANDS) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)
    return keys.view(np.int64).tolist()


def marks(least: np.ndarray) -> bytes:
    """One byte of each MinHash value: two sets agree in about as many as their similarity."""
    return (least >> np.uint64(56)).astype(np.uint8).tobytes()


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in pieces whose Python values stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    """``row, doc_id, digest, shingles, fingerprint, marks, bands``: ``digest`` names the whole
    set of shingles, ``shingles`` is their number."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = []
            for text in batch["text"]:
                own = shingles(text.as_py(), width)
                least = minima(own)
                digest = xxhash.xxh3_128_digest(own.tobytes())
                out.append((digest, len(own), set_fingerprint(own), marks(least), bands(least) if len(own) else []))
            digests, sizes, prints, seen, keys = zip(*out) if out else ((), (), (), (), ())
            yield pa.record_batch(
                {
                    "row": batch["row"],
                    "doc_id": batch["doc_id"],
                    "digest": pa.array(digests, pa.binary()),
                    "shingles": pa.array(sizes, pa.int64()),
                    "fingerprint": pa.array(prints, pa.int64()),
                    "marks": pa.array(seen, pa.binary()),
                    "bands": pa.array(keys, pa.list_(pa.int64())),
                }
            )

    kinds = "row long, doc_id long, digest binary, shingles long, fingerprint long, marks binary, bands array<long>"
    return rows.mapInArrow(sketched, kinds)


def _sets(texts: DataFrame, nodes: DataFrame, width: int, folder: str, name: str) -> DataFrame:
    """``node, hashes``: the sorted shingle hashes of the texts of ``nodes``, written."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingles(t.as_py(), width).astype("<u8").tobytes() for t in batch["text"]]
            yield pa.record_batch({"node": batch["row"], "hashes": pa.array(sets, pa.binary())})

    wanted = materialize(nodes.select(F.col("node").alias("row")).distinct(), f"{name}_nodes", folder)
    own = texts.select("row", "text").join(_small(wanted, ["row"]), "row", "left_semi")
    return materialize(own.mapInArrow(hashed, "node long, hashes binary"), f"{name}_sets", folder)


def _small(ids: DataFrame, columns: list[str]) -> DataFrame:
    """Broadcast while its measured size allows; a shuffle join otherwise."""
    return F.broadcast(ids) if bounded(ids, columns, IDS_BYTES) else ids


def alike(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets agree in ``similarity`` of their union."""
    if min(len(one), len(two)) < similarity * max(len(one), len(two)):
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both / max(1, len(one) + len(two) - both) >= similarity


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets are alike.

    The set of ``a`` travels once for each ``FAN_ROWS`` of its partners, ahead of theirs,
    so no set travels twice in a row and no ``a`` gathers more.
    """
    fans = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / FAN_ROWS).cast("int").alias("fans"))
    first = fans.join(sets.withColumnRenamed("node", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.lit(None).cast("long").alias("b"), "hashes"
    )
    others = pairs.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), F.col("fans")).cast("int").alias("fan"), "b")
    others = others.join(sets.withColumnRenamed("node", "b"), "b").select("a", "fan", "b", "hashes")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for b, data in zip(batch["b"].to_pylist(), batch["hashes"]):
                own = np.frombuffer(data.as_py(), "<u8")
                if b is None:
                    left = own
                keep.append(b is not None and alike(left, own, similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    dealt = first.unionByName(others).repartition("a", "fan").sortWithinPartitions("a", "fan", F.asc_nulls_first("b"))
    return dealt.mapInArrow(verify, "a long, b long")


def _possible(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose marks and sizes leave ``similarity`` possible."""
    side = classes.select("node", "marks", "shingles")
    met = pairs
    for end in ("a", "b"):
        met = met.join(side.toDF(end, f"{end}_marks", f"{end}_shingles"), end)
    sizes = F.least("a_shingles", "b_shingles") >= similarity * F.greatest("a_shingles", "b_shingles")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (_matrix(batch[c].to_pylist(), np.uint8) for c in ("a_marks", "b_marks"))
            keep = (one == two).mean(axis=1) >= similarity - MARGIN if batch.num_rows else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.filter(sizes).select("a", "b", "a_marks", "b_marks").mapInArrow(near, "a long, b long")


def _matrix(rows: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


class Cell:
    """Rows of one band, or of a pair of its blocks: strays on the left, all rows on the right."""

    def __init__(self, key: int, similarity: float):
        self.at, self.similarity, self.left, self.right = key % BANDS, similarity, [], []

    def able(self) -> Iterator[tuple[dict, np.ndarray]]:
        """Each stray with the places of the rows it may be linked to, nearest first.

        They are of another group, marks and sizes leave the similarity possible, and
        this is the first band both share, so that a pair is looked at once.
        """
        nodes, groups, main, size = (np.array([r[k] for r in self.right]) for k in ("node", "component", "main", "shingles"))
        seen = _matrix([r["marks"] for r in self.right], np.uint8)
        keys = np.array([r["bands"] for r in self.right])
        for one in self.left:
            near = (seen == np.frombuffer(one["marks"], np.uint8)).mean(axis=1)
            able = (near >= self.similarity - MARGIN) & (groups != one["component"])
            able &= (nodes > one["node"]) | main
            able &= np.minimum(size, one["shingles"]) >= self.similarity * np.maximum(size, one["shingles"])
            able = np.flatnonzero(able)
            able = able[(keys[able] == np.array(one["bands"])).argmax(axis=1) == self.at]
            if len(able):
                yield one, able[np.argsort(-near[able], kind="stable")]

    def active(self) -> list[dict]:
        """Rows that may be linked to any other here."""
        met, found = set(), []
        for one, able in self.able():
            found.append(one)
            met.update(able.tolist())
        return found + [self.right[i] for i in sorted(met)]

    def joining(self) -> list[dict]:
        """Links between different groups, no more than it takes to join them."""
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        found = []
        for one, able in self.able():
            own = np.frombuffer(one["hashes"], "<u8")
            for i in able:
                two = self.right[i]
                a, b = root(one["component"]), root(two["component"])
                if a != b and alike(own, np.frombuffer(two["hashes"], "<u8"), self.similarity):
                    parent[a] = b
                    found.append({"a": one["node"], "b": two["node"]})
        return found


_CELL = ["key", "first", "second"]
_ACTIVE = "key long, first int, second int, left boolean, node long, component long, main boolean, shingles long, marks binary, bands array<long>"


def _by_cell(cells: DataFrame, similarity: float, work: str, schema: str) -> DataFrame:
    """What ``work`` finds in each cell, whose rows come together."""
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in T._parse_datatype_string(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, cell, found = None, Cell(0, similarity), []
        for batch in _slices(batches):
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns):
                row = dict(zip(batch.schema.names, values))
                if (own := tuple(row[c] for c in _CELL)) != place:
                    found += getattr(cell, work)() if cell.left and cell.right else []
                    place, cell = own, Cell(own[0], similarity)
                (cell.left if row["left"] else cell.right).append(row)
            yield pa.RecordBatch.from_pylist(found, kinds)
            found = []
        if cell.left and cell.right:
            yield pa.RecordBatch.from_pylist(getattr(cell, work)(), kinds)

    return cells.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(run, schema)


def _cells(shared: DataFrame, roots: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """Rows of the bands that still hold several groups, dealt into cells.

    Rows outside a band's largest group (strays) stand on the left, all rows on the right;
    both are dealt into blocks of bounded rows and bytes that meet pairwise, so the rows of
    the largest group travel once for each block of strays.
    """
    grouped = shared.select("key", "node").join(roots, "node", "left")
    grouped = materialize(grouped.withColumn("component", F.coalesce("component", "node")), "grouped", folder)
    parts = grouped.groupBy("key", "component").count()
    mixed = (
        parts.groupBy("key")
        .agg(F.max(F.struct("count", "component")).alias("most"), F.count("*").alias("parts"))
        .filter("parts > 1")
        .select("key", F.col("most.component").alias("_main"))
    )
    rows = grouped.join(mixed, "key").withColumn("main", F.col("component") == F.col("_main")).drop("_main")
    rows = materialize(rows.join(classes.select("node", "shingles"), "node"), "mixed", folder)
    weight = 8 * F.col("shingles")
    stray = ~F.col("main")

    def blocks(count, size):
        return F.ceil(F.greatest(count / CELL_ROWS, size / CELL_BYTES, F.lit(1.0))).cast("int")

    counts = rows.groupBy("key").agg(
        blocks(F.count_if(stray), F.sum(F.when(stray, weight).otherwise(0))).alias("rows_of"),
        blocks(F.count("*"), F.sum(weight)).alias("columns_of"),
    )
    dealt, place = rows.join(counts, "key"), F.xxhash64("node")
    left = (
        dealt.filter(stray)
        .withColumn("left", F.lit(True))
        .withColumn("first", F.pmod(place, F.col("rows_of")).cast("int"))
        .withColumn("second", F.explode(F.sequence(F.lit(0), F.col("columns_of") - 1)))
    )
    right = (
        dealt.withColumn("left", F.lit(False))
        .withColumn("second", F.pmod(place, F.col("columns_of")).cast("int"))
        .withColumn("first", F.explode(F.sequence(F.lit(0), F.col("rows_of") - 1)))
    )
    columns = [*_CELL, "left", "node", "component", "main"]
    both = left.select(*columns).unionByName(right.select(*columns))
    return both.join(classes.select("node", "shingles", "marks", "bands"), "node")


def _first_candidates(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs that a fingerprint, two linked fingerprints or a band propose, through its first row."""
    prints = classes.groupBy("fingerprint").agg(F.min("node").alias("lead"))
    equal = classes.join(prints, "fingerprint").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    close = (
        links(prints.select("fingerprint"))
        .join(prints.select(F.col("fingerprint").alias("a"), F.col("lead").alias("one")), "a")
        .join(prints.select(F.col("fingerprint").alias("b"), F.col("lead").alias("two")), "b")
        .select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    )
    banded = shared.select(F.col("lead").alias("a"), F.col("node").alias("b"))
    return equal.unionByName(close).unionByName(banded).filter("a <> b").distinct()


def _fresh(frame: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name


def deduplicated(documents: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of similar texts, all columns kept.

    Texts are linked if their ``width``-word shingle sets have a Jaccard similarity of at
    least ``similarity`` (the bands are laid out for 0.8 and more); a group is what links
    reach. Equal sets are compared once, and all wordless texts are one group. The row
    with the smallest id stays (rows without an id come last); every row has its own
    key, so an id that repeats with another text loses nothing. Extra columns of any name
    stay as they are; an empty table gives no rows.

    Candidates first meet the first row of their fingerprint, of a fingerprint at two bits
    or fewer (pigeonhole blocks), and of each of their bands. Then, in bands that still
    hold several groups, every row outside the largest one meets the rows of all other
    groups inside cells. Cells first see sketches and name the rows that may be linked;
    those come again with their shingle sets, and joining links alone are reported. No
    link between groups is missed, and a large group of copies never emits its pairs.
    """
    folder, name = scratch_dir(documents.sparkSession), _fresh(documents, "_row")
    rows = materialize(documents.withColumn(name, F.monotonically_increasing_id()), "rows", folder)
    texts = rows.select(
        F.col(name).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    sketches = materialize(_sketches(texts, width), "sketches", folder)
    rank = F.struct(F.col("doc_id").isNull().alias("lone"), "doc_id", "row")
    held = F.first(F.struct("shingles", "fingerprint", "marks", "bands")).alias("s")
    classes = sketches.groupBy("digest").agg(F.min(rank).alias("best"), held)
    classes = materialize(classes.select("digest", F.col("best.row").alias("node"), "best", "s.*"), "classes", folder)
    keyed = classes.select("node", F.explode("bands").alias("key")).repartition("key")
    leads = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = materialize(keyed.join(leads, "key"), "bands", folder)

    first = materialize(_first_candidates(classes, shared), "first", folder)
    first = materialize(_possible(first, classes, similarity), "possible", folder)
    sets = _sets(texts, first.select(F.col("a").alias("node")).union(first.select("b")), width, folder, "first")
    found = materialize(_similar(first, sets, similarity), "links", folder)
    roots = components(found)
    active = _by_cell(_cells(shared, roots, classes, folder), similarity, "active", _ACTIVE)
    active = materialize(active, "active", folder)
    sets = _sets(texts, active.select("node"), width, folder, "active")
    more = _by_cell(active.join(sets, "node"), similarity, "joining", "a long, b long")
    more = materialize(more, "more", folder)
    roots = components(found.union(more)) if more.head(1) else roots
    rooted = classes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = materialize(rooted.groupBy("component").agg(F.min("best").alias("best")), "best", folder)
    kept = best.select(F.col("best.row").alias("row"))
    gone = materialize(sketches.select("row").join(kept, "row", "left_anti"), "gone", folder)
    return rows.join(_small(gone.withColumnRenamed("row", name), [name]), name, "left_anti").select(documents.columns)
