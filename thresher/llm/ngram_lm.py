"""Language-model scoring with a log-frequency Bloom filter.

A count is stored as its level on a logarithmic scale: an n-gram of level q is put in
the filter q times, tagged 1 to q. A lookup probes tag 1, 2, ... until one is missing,
so frequent n-grams cost more probes and no count is ever read too low. The filter
holds words and word pairs, grows with the tokens and is cut into segments that tasks
build on their own. Up to ``MAX_BITS`` (64 MB) it is broadcast whole; a larger one stays
a table, and the keys of the documents go to their segments. Both read the same levels.
Probabilities interpolate the pair with
the add-one word probability, both read from the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thresher.llm.common import fold
from thresher.session import materialize, scratch_dir

BASE = 1.5
LEVELS = 96
PROBES = 4  # at 16 bits an n-gram 0.3 % of unseen ones read as seen (0.5 % with three)
BLOCK_BITS, PLACE_BITS, BLOCK_LEVELS = 512, 9, 4
BITS_PER_TOKEN = 8
MIN_BITS, MAX_BITS = 1 << 23, 1 << 29
SEGMENTS = 1024
PAIR_WEIGHT = 0.15
FREQUENT = 1 << 17
END = b"\n"
STEP_BYTES = 2 << 20
PROBED_KEYS = 1 << 16
# Keys that a task gathers for each SEGMENTS slices, and that one slice may have in all.
HELD_KEYS, SLICE_KEYS = 1 << 18, 1 << 20

# Smallest count of each level, and the mean of a level's whole counts.
LEVEL_FROM = np.unique(np.ceil(BASE ** np.arange(LEVELS)).astype(np.int64))
LEVEL_MEAN = np.concatenate(([0.0], (LEVEL_FROM + np.append(LEVEL_FROM[1:] - 1, 2 * LEVEL_FROM[-1])) / 2))


def mix(keys: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finisher)."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + after)


def cuts(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """First and last (excluded) of the whole texts that make about ``size`` bytes each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(sizes):
        end = min(int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + size)) + 1, len(sizes))
        yield start, end
        start = end


@dataclass
class Tokens:
    """Tokens of several texts, each closed by END, as numbers of distinct words: the
    lower-case (A-Z) words of a text, cut at ASCII white space; a null text has none."""

    vocabulary: pa.Array
    places: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        vocabulary = coded.dictionary.cast(pa.binary())
        places = coded.indices.to_numpy().astype(np.int64)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))
        # White space at the ends of a text leaves empty words there.
        empty = pc.index(vocabulary, pa.scalar(b"", pa.binary())).as_py()
        if empty >= 0:
            kept = places != empty
            ends = np.concatenate(([0], np.cumsum(kept)))[ends]
            places = places[kept]
            places[places > empty] -= 1
            vocabulary = pa.concat_arrays([vocabulary[:empty], vocabulary[empty + 1 :]])
        closed = ends + np.arange(1, len(ends) + 1)
        own = np.full(len(places) + len(ends), len(vocabulary), np.int64)
        inner = np.ones(len(own), bool)
        inner[closed - 1] = False
        own[inner] = places
        return cls(pa.concat_arrays([vocabulary, pa.array([END], pa.binary())]), own, closed)

    @cached_property
    def words(self) -> np.ndarray:
        return self.vocabulary.to_numpy(zero_copy_only=False)

    @cached_property
    def hashes(self) -> np.ndarray:
        return hashed(self.words)

    def before(self) -> np.ndarray:
        """The word before each token; END before the first of a text."""
        end = self.places[self.ends[0] - 1]
        shifted = np.concatenate(([end], self.places[:-1]))
        shifted[self.ends[:-1]] = end
        return shifted


def hashed(words: np.ndarray) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def steps(texts: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """Whole texts in groups of about STEP_BYTES: the first one's number, and tokens."""
    for start, end in cuts(texts, STEP_BYTES):
        yield start, Tokens.of(texts.slice(start, end - start))


class Filter:
    """The finished filter: one run of bits, read by probing."""

    def __init__(self, bits: bytes):
        self.bits, self.segment_bits = bits, len(bits) * 8 // SEGMENTS

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key; 0 if absent."""
        return probe(self.bits, keys, segment_of(keys).astype(np.int64) * self.segment_bits, self.segment_bits)


def probe(data: bytes, keys: np.ndarray, base: np.ndarray | int, segment_bits: int) -> np.ndarray:
    """Level of each key, whose segment starts at bit ``base`` of ``data``; 0 if absent.
    Probes level by level until a miss, PROBED_KEYS keys at a time."""
    found, bits = np.zeros(len(keys), np.int64), np.frombuffer(data, np.uint8)
    base = np.broadcast_to(np.asarray(base, np.int64), len(keys))
    for start in range(0, len(keys), PROBED_KEYS):
        part = slice(start, start + PROBED_KEYS)
        _probe(bits, keys[part], base[part], segment_bits, found[part])
    return found


def _probe(bits: np.ndarray, keys: np.ndarray, base: np.ndarray, segment_bits: int, found: np.ndarray) -> None:
    alive, block = np.arange(len(keys)), None
    for level in range(1, len(LEVEL_MEAN)):
        if (level - 1) % BLOCK_LEVELS == 0:
            block = base + block_start(keys, level, segment_bits)
        hit = None
        for offset in offsets(keys, level):
            at = block + offset
            bit = bits.take(at >> 3) >> (at & 7).astype(np.uint8)
            hit = bit if hit is None else hit & bit
        kept = np.flatnonzero(hit & 1)
        if not len(kept):
            break
        alive, keys, base, block = alive[kept], keys[kept], base[kept], block[kept]
        found[alive] = level


def segment_of(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(64 - SEGMENTS.bit_length() + 1)


def _tag(number: int) -> np.uint64:
    return np.uint64(number * 0xD6E8FEB86659FD93 & (2**64 - 1))


def block_start(keys: np.ndarray, level: int, segment_bits: int) -> np.ndarray:
    """First bit, within the segment, of the block for this level and the next three:
    all probes of a key fall in one block, so a lookup reads one cache line."""
    blocks = mix(keys + _tag(2 * ((level - 1) // BLOCK_LEVELS) + 1)) & np.uint64(segment_bits // BLOCK_BITS - 1)
    return blocks.astype(np.int64) * BLOCK_BITS


def offsets(keys: np.ndarray, level: int) -> list[np.ndarray]:
    """Places of the level's probes inside its block."""
    spread = mix(keys + _tag(2 * level)).view(np.int64)
    return [(spread >> (PLACE_BITS * i)) & (BLOCK_BITS - 1) for i in range(PROBES)]


def set_bits(bits: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
    """Put keys of one segment into its bits (one byte each while it is built)."""
    levels = np.searchsorted(LEVEL_FROM, counts, side="right")
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= level]
        block = block_start(own, level, len(bits))
        for offset in offsets(own, level):
            bits[block + offset] = 1


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all tokens of all texts; partial sums leave the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, t in steps(batch["text"]):
                yield pa.record_batch({"word": t.vocabulary, "n": pa.array(np.bincount(t.places, minlength=len(t.vocabulary)), pa.int64())})

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def slices_for(tokens: int) -> int:
    """Into how many ranges the keys are cut, a power of two: a task sums one at a time."""
    slices = SEGMENTS
    while slices * SLICE_KEYS < 2 * tokens:
        slices *= 2
    return slices


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, each with the sum of its counts."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return keys[starts], np.add.reduceat(n[order], starts)


def key_counts(texts: DataFrame, counts: DataFrame, slices: int) -> DataFrame:
    """``segment, slice, keys, n``: hashed words (from their counts) and word pairs of all
    texts, as partial sums: the keys of one slice that a task has met, side by side."""
    shape = "segment int, slice int, keys binary, n binary"
    held = max(HELD_KEYS, slices * HELD_KEYS // SEGMENTS)

    def sliced(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        number = (keys >> np.uint64(64 - slices.bit_length() + 1)).astype(np.int32)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1)) if len(number) else np.zeros(0, np.int64)
        ends = pa.py_buffer(np.append(starts, len(keys)).astype(np.int32) * np.int32(8))
        parts = [
            pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(x)])
            for x in (keys.astype("<u8"), n.astype("<i8"))
        ]
        own = number[starts]
        return pa.record_batch([pa.array(own // (slices // SEGMENTS), pa.int32()), pa.array(own, pa.int32()), *parts], names=["segment", "slice", "keys", "n"])

    def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for keys, n in parts:
            some.append((keys, n))
            size += len(keys)
            if size >= held:
                yield sliced(*summed(*map(np.concatenate, zip(*some))))
                some, size = [], 0
        if some:
            yield sliced(*summed(*map(np.concatenate, zip(*some))))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for _, tokens in steps(batch["text"]):
                    own, before = tokens.hashes[tokens.places], tokens.hashes[tokens.before()]
                    yield pair_keys(before, own), np.ones(len(own), np.int64)

        return gathered(met())

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                yield mix(hashed(batch["word"].to_numpy(zero_copy_only=False))), batch["n"].to_numpy()

        return gathered(met())

    return texts.mapInArrow(pairs, shape).unionByName(counts.mapInArrow(single, shape))


def admitted_from(counts: DataFrame, capacity: int) -> int:
    """The smallest level start from which all n-grams fit ``capacity`` entries."""
    level = F.size(F.filter(F.array(*[F.lit(int(x)) for x in LEVEL_FROM]), lambda x: x <= F.col("n")))
    held = dict(counts.groupBy(level.alias("level")).count().collect())
    total, at = 0, len(LEVEL_FROM)
    while at and total + held.get(at, 0) * at <= capacity:
        total += held.get(at, 0) * at
        at -= 1
    return int(LEVEL_FROM[min(at, len(LEVEL_FROM) - 1)])


def filter_bits(tokens: int) -> int:
    """Size for the words and pairs of ``tokens``, none left out: 16 bits a token, as a
    power of two; MAX_BITS as long as that leaves 2 bits a token."""
    bits = MIN_BITS
    while bits < BITS_PER_TOKEN * 2 * tokens and not tokens * 2 <= bits == MAX_BITS:
        bits *= 2
    return bits


def build_segments(texts: DataFrame, words: DataFrame, bits: int, tokens: int, folder: str) -> DataFrame:
    """``segment, bits`` of the filter with all counted n-grams, none left out.

    Rows come sorted by slice, and a segment is a run of slices, so a task sums one slice
    and holds one segment while it sets bits.
    """
    segment_bits = bits // SEGMENTS
    parts = min(SEGMENTS, max(8, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    counts = key_counts(texts, words, slices_for(tokens)).repartition(parts, "segment").sortWithinPartitions("slice")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, segment, place, keys, n = np.zeros(0, np.uint8), -1, -1, [], []

        def close() -> None:
            set_bits(space, *summed(np.frombuffer(b"".join(keys), "<u8"), np.frombuffer(b"".join(n), "<i8")))
            keys.clear()
            n.clear()

        def packed() -> pa.RecordBatch:
            data = np.packbits(space, bitorder="little").tobytes()
            return pa.record_batch({"segment": pa.array([segment], pa.int32()), "bits": pa.array([data], pa.binary())})

        for batch in batches:
            for own, at, some, times in zip(batch["segment"].to_pylist(), batch["slice"].to_pylist(), batch["keys"], batch["n"]):
                if at != place:
                    close()
                    if own != segment:
                        if segment >= 0:
                            yield packed()
                        space, segment = np.zeros(segment_bits, np.uint8), own
                    place = at
                keys.append(some.as_py())
                n.append(times.as_py())
        close()
        if segment >= 0:
            yield packed()

    return materialize(counts.mapInArrow(build, "segment int, bits binary"), "filter", folder)


def whole_filter(built: DataFrame, bits: int) -> Filter:
    """The joined segments, for a filter of at most MAX_BITS."""
    size = bits // SEGMENTS // 8
    joined = np.zeros(bits // 8, np.uint8)
    for row in built.toLocalIterator():
        joined[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return Filter(joined.tobytes())


def step_keys(t: Tokens) -> np.ndarray:
    """The keys of a step's distinct words, then those of its pairs."""
    return np.concatenate((mix(t.hashes), pair_keys(t.hashes[t.before()], t.hashes[t.places])))


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order, so by segment."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))]


def parted(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes between ``ends`` as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def answers(batches: Iterator[pa.RecordBatch], segment_bits: int) -> Iterator[pa.RecordBatch]:
    """``segment, step, levels`` of rows ``segment, step, data`` in that order: a segment's
    bits (step -1), then the keys that each step asks for. A step asks a segment for a few
    hundred keys, so the keys of all steps in a batch are probed together.
    """
    held, data = -1, b""
    for batch in batches:
        segments, asking, own = batch["segment"].to_numpy(), batch["step"].to_numpy(), batch["data"].cast(pa.binary())
        ends = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
        runs = np.concatenate(([0], np.flatnonzero(np.diff(segments)) + 1, [len(own)]))
        for start, end in zip(runs[:-1], runs[1:]):
            if asking[start] < 0:
                held, data = segments[start], own[int(start)].as_py()
                start += 1
            if start == end:
                continue
            size = int(ends[end] - ends[start]) // 8
            keys = np.frombuffer(own.buffers()[2], np.uint64, size, int(ends[start]))
            levels = probe(data, keys, 0, segment_bits) if held == segments[start] else np.zeros(size, np.int64)
            told = parted(levels.astype(np.uint8), (ends[start : end + 1] - ends[start]) // 8)
            yield pa.record_batch({"segment": segments[start:end], "step": asking[start:end], "levels": told})


def answered(rows: DataFrame, built: DataFrame, bits: int, folder: str) -> DataFrame:
    """``rows`` (row, doc_id, text) in steps, each with the levels of its keys.

    A step's keys travel to their segments (8 bytes each), the levels back (1 byte each).
    """
    segment_bits = bits // SEGMENTS
    shape = "step long, row array<long>, doc_id array<long>, text array<string>"

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, end in cuts(batch["text"], STEP_BYTES):
                whole = pa.array([0, end - start], pa.int32())
                yield pa.record_batch({"step": pa.array([at], pa.int64())} | {c: pa.ListArray.from_arrays(whole, batch[c].slice(start, end - start)) for c in ("row", "doc_id", "text")})
                at += 1

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step, texts in zip(batch["step"].to_pylist(), batch["text"]):
                keys = distinct(step_keys(Tokens.of(texts.values)))
                segments, starts = np.unique(segment_of(keys).astype(np.int32), return_index=True)
                data = parted(keys.view(np.uint8), 8 * np.append(starts, len(keys)))
                yield pa.record_batch({"segment": segments, "step": np.full(len(segments), step, np.int64), "data": data})

    held = materialize(rows.mapInArrow(stepped, shape), "steps", folder)
    questions = held.select("step", "text").mapInArrow(asked, "segment int, step long, data binary")
    filled = built.select("segment", F.lit(-1).cast("long").alias("step"), F.col("bits").alias("data"))
    parts = min(SEGMENTS, max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    met = filled.unionByName(questions).repartition(parts, "segment").sortWithinPartitions("segment", "step")
    levels = met.mapInArrow(lambda batches: answers(batches, segment_bits), "segment int, step long, levels binary")
    told = levels.groupBy("step").agg(F.sort_array(F.collect_list(F.struct("segment", "levels"))).alias("x"))
    return held.join(told.select("step", F.col("x.levels").alias("levels")), "step")


@dataclass
class Frequent:
    """The most frequent words (at most FREQUENT) with their exact log10(c + 1)."""

    logs: dict[bytes, float]
    limit: int


def frequent_words(counts: DataFrame) -> Frequent:
    """Words from a count on that at most FREQUENT words reach; the others are rare,
    and none of them occurs more than (all tokens / FREQUENT) times."""
    eighth = F.floor(8 * F.log2(F.col("n").cast("double")))
    held = sorted(counts.groupBy(eighth.alias("e")).count().collect(), reverse=True)
    total, least = 0, None
    for row in held:
        total += row["count"]
        if total > FREQUENT:
            break
        least = row["e"]
    if least is None:
        return Frequent({}, 0)
    chosen = counts.filter(eighth >= least).select("word", F.log10(F.col("n") + 1.0).alias("log"), "n").collect()
    return Frequent({bytes(r["word"]): r["log"] for r in chosen}, min(r["n"] for r in chosen))


def score(documents: DataFrame, training: DataFrame, pair_weight: float = PAIR_WEIGHT) -> DataFrame:
    """Score ``documents`` (doc_id, text) by a model of ``training`` (text).

    ``doc_id, n_tokens, n_known, train_tokens, base_score, score``. Words and one end
    token per text are scored; null texts count as empty, so each has the end token.
    ``base_score`` uses exact counts: frequent words from a bounded broadcast, rare ones
    through a join on the word, where none is hot. ``score`` is the filter's
    ``w * c(hv) / c(h) + (1 - w) * (c(v) + 1) / (N + V + 1)`` (c(hv) at most c(h) and c(v)), only the second part after
    an unseen h, and never above 0. Null ids and repeated rows stay; with nothing to
    learn from N and V are 0 and nothing is known.
    """
    spark, folder = documents.sparkSession, scratch_dir(documents.sparkSession)
    counts = materialize(word_counts(training), "words", folder)
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits = filter_bits(tokens)
    built = build_segments(training, counts, bits, tokens, folder)
    small = bits <= MAX_BITS
    model = spark.sparkContext.broadcast(whole_filter(built, bits) if small else None)
    frequent = spark.sparkContext.broadcast(frequent_words(counts))
    floor = float(np.log10(tokens + kinds + 1.0))

    def scored(t: Tokens, levels: Callable[[np.ndarray], np.ndarray], row: pa.Array, doc_id: pa.Array) -> pa.RecordBatch:
        known, kinds_here = frequent.value.logs, len(t.words)
        # Each distinct key is looked up once, in the order of the filter's segments.
        keys, at = np.unique(step_keys(t), return_inverse=True)
        found = LEVEL_MEAN[levels(keys)[at]]
        seen, pair = found[:kinds_here], found[kinds_here:]
        logs = np.array([known.get(w, -1.0) for w in t.words])
        single = (seen + 1.0) / (tokens + kinds + 1.0)
        context = seen[t.before()]
        # No pair is more frequent than its words: this also stops most false hits.
        pair = np.minimum(pair, np.minimum(context, seen[t.places]))
        share = pair / np.maximum(context, 1.0)
        chance = np.where(context > 0, pair_weight * share + (1 - pair_weight) * single[t.places], single[t.places])
        starts = np.concatenate(([0], t.ends[:-1]))
        own = logs[t.places]
        unknown = np.flatnonzero(own < 0)
        # Each document's rare words with their number of occurrences, as flat lists.
        owner = np.searchsorted(t.ends, unknown, side="right")
        pairs, times = np.unique(owner * kinds_here + t.places[unknown], return_counts=True)
        bounds = np.searchsorted(pairs, np.arange(len(starts) + 1) * kinds_here).astype(np.int32)
        rare = t.vocabulary.take(pa.array(pairs % kinds_here))
        return pa.record_batch(
            {
                "row": row,
                "doc_id": doc_id,
                "n_tokens": t.ends - starts,
                "known": np.add.reduceat((own >= 0).astype(np.int64), starts),
                "logs": np.add.reduceat(np.maximum(own, 0.0), starts),
                "score": np.add.reduceat(np.minimum(np.log10(chance), 0.0), starts),
                "rare": pa.ListArray.from_arrays(bounds, rare),
                "times": pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32())),
            }
        )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One batch out for each step: what a task holds does not grow with its input.
            for start, t in steps(batch["text"]):
                part = batch.slice(start, len(t.ends))
                yield scored(t, model.value.level, part["row"], part["doc_id"])

    def weigh_answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, texts, levels in zip(*(batch[c] for c in ("row", "doc_id", "text", "levels"))):
                t = Tokens.of(texts.values)
                told = np.frombuffer(b"".join(levels.as_py()), np.uint8)
                yield scored(t, lambda _, told=told: told, row.values, doc_id.values)

    rows = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    shape = "row long, doc_id long, n_tokens long, known long, logs double, score double, rare array<binary>, times array<int>"
    if small:
        weighed = rows.mapInArrow(weigh, shape)
    else:
        weighed = answered(rows, built, bits, folder).drop("step").mapInArrow(weigh_answered, shape)
    weighed = materialize(weighed, "weighed", folder)
    limit = frequent.value.limit
    rest = counts.filter(F.col("n") < limit) if limit else counts
    pairs = weighed.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("word"), F.col("x.times").alias("times")
    )
    added = (
        pairs.join(rest, "word")
        .groupBy("row")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    )
    return weighed.drop("rare", "times").join(added, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        "score",
    )


def held_out(doc_id: str = "doc_id"):
    return fold(doc_id, 7) == 2


def score_documents(documents: DataFrame) -> DataFrame:
    """Learn from all documents outside the held-out fold, score all of them."""
    training = documents.filter(~held_out()).select(F.col("text").cast("string").alias("text"))
    return score(documents, training).withColumn("held_out", held_out())
