"""Packing token sequences by minimum bin slack.

Documents are cut into full windows and one remainder each. Only the histogram of
the remainders' lengths (at most ``WINDOW - 1`` counts) decides the plan: the longest
length left opens a window, a subset-sum over bitsets finds the multiset of other
lengths that fills it closest to capacity, and the pattern is repeated as often as
the counts allow. The plan's rules then number the pieces of each length. A length
whose windows would stay emptier than ``SLACK`` (many copies of one text) joins
the tail instead: its pieces are laid end to end and cut where a window is full.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thresher.llm.common import BROADCAST_BYTES, numbered
from thresher.session import bounded, materialize, scratch_dir

WINDOW = 2048
END = 1
# A pattern that leaves more than this part of a window empty makes its length a tail.
SLACK = 1 / 128
SLICE_ROWS = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
RULES = ["length", "low", "high", "first", "each", "at", "total"]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """The vocabulary file's byte-level BPE, run by tiktoken (ids are merge ranks).

    Same ids as the file's own library, five times as fast. A text that spells one of the
    file's added tokens holds that token's id there, as in the library.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as source:
        content = json.load(source)
    vocabulary, added = content["model"]["vocab"], {t["content"]: t["id"] for t in content["added_tokens"]}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in word): rank for word, rank in vocabulary.items() if all(c in letters for c in word)}
    for word in added:
        ranks.pop(word.encode(), None)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return partial(own.encode, allowed_special="all")


def pieces(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of every whole document: full windows, then the remainder, if any.

    ``ids`` holds the remainder's ids (little-endian, 32 bits), in case it is cut again.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        # Small pieces: texts and ids of a whole Arrow batch would be held at once.
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = encode(text) if text else []
                ids.append(END)
                data = memoryview(array("I", ids).tobytes())
                for start in range(0, len(ids), window):
                    part = data[4 * start : 4 * (start + window)]
                    kept = bytes(part) if len(part) < 4 * window else None
                    row = (doc_id, start, len(part) // 4, zlib.crc32(part), len(ids), kept)
                    for column, value in zip(out, row):
                        column.append(value)
            numbers = [pa.array(c, pa.int64()) for c in out[:5]]
            yield pa.record_batch([*numbers, pa.array(out[5], pa.binary())], names=PIECE_COLUMNS)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of ``counts`` with the largest sum up to ``room``: (length, times).

    Bit s of ``reach`` is set if some multiset sums to s. Counts enter as powers of two,
    lengths with the most tokens left first (so that a length shared by very many texts
    is not what remains at the end), and the search ends once ``room`` is reached.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), key=lambda x: (-x * counts[x], -x)):
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left, times = left - times, times * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + times
            at -= length * times
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rules ``(length, low, high, first, each, at, total)``.

    Remainders ``low`` to ``high - 1`` of a length go to sequences from ``first`` on,
    ``each`` to a sequence, the first of them at offset ``at``; the sequence holds
    ``total`` tokens. ``each`` 0 is the tail: remainders lie one after another from
    place ``at`` of a stream of ``total`` tokens that fills sequences from ``first`` on.
    """
    left, taken, rules, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    tail: dict[int, int] = {}
    for seed in sorted(histogram, reverse=True):
        while left[seed]:
            left[seed] -= 1
            pattern = dict(fill(left, window - seed))
            left[seed] += 1
            pattern[seed] = pattern.get(seed, 0) + 1
            at, total = 0, sum(n * k for n, k in pattern.items())
            if total < window * (1 - SLACK):
                tail[seed], left[seed] = left[seed], 0
                break
            repeats = min(left[n] // k for n, k in pattern.items())
            for length, each in sorted(pattern.items(), reverse=True):
                low = taken[length]
                taken[length] += each * repeats
                left[length] -= each * repeats
                rules.append((length, low, taken[length], sequence, each, at, total))
                at += each * length
            sequence += repeats
    total, at = sum(n * k for n, k in tail.items()), 0
    for length, count in tail.items():
        rules.append((length, taken[length], taken[length] + count, sequence, 0, at, total))
        at += length * count
    return rules


def pack(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_tokens``.

    A document's ids end with id 1; null and empty texts are that id alone. Full windows
    are sequences of their own; remainders follow the plan. Equal lengths are numbered
    by id and checksum in blocks, so a length shared by a third of all documents stays
    in bounded tasks. Null and repeated ids stay documents of their own.
    """
    spark, folder = documents.sparkSession, scratch_dir(documents.sparkSession)
    parts = materialize(pieces(documents, tokenizer, window), "pieces", folder)
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    full = counts.pop(window, 0)
    rules = plan(counts, window)
    tail = any(rule[4] == 0 for rule in rules)
    if full:
        rules.append((window, 0, full, -full, 1, 0, window))
    # As Arrow the rules reach Spark without Python workers; for a list, executors would keep some more.
    columns = [pa.array([rule[i] for rule in rules], pa.int64()) for i in range(len(RULES))]
    rules = F.broadcast(spark.createDataFrame(pa.table(columns, RULES)))
    lined = numbered(parts.drop("ids"), ["length"], ["doc_id", "start", "ids_crc32"], "place")
    inside = F.col("place") - F.col("low")
    stream = F.col("at") + inside * F.col("length")
    in_tail = F.col("each") == 0
    each = F.greatest("each", F.lit(1))
    sequence = F.when(in_tail, F.floor(stream / window)).otherwise(F.floor(inside / each))
    rest = F.col("total") - F.floor(stream / window) * window
    placed = (
        lined.join(rules, "length")
        .filter("place >= low and place < high")
        .select(
            *[c for c in PIECE_COLUMNS if c != "ids"],
            (F.lit(full) + F.col("first") + sequence).alias("sequence_id"),
            F.when(in_tail, F.pmod(stream, F.lit(window)))
            .otherwise(F.col("at") + F.pmod(inside, each) * F.col("length"))
            .alias("offset"),
            F.when(in_tail, F.least(rest, F.lit(window))).otherwise(F.col("total")).alias("sequence_tokens"),
            F.when(in_tail, F.least(rest - window, F.lit(window))).alias("next_tokens"),
        )
    )
    if not tail:
        return placed.drop("next_tokens")
    placed = materialize(placed, "placed", folder)
    over = F.col("offset") + F.col("length") > window
    return placed.filter(~over).drop("next_tokens").unionByName(_cut(placed.filter(over), parts, window))


def _cut(over: DataFrame, parts: DataFrame, window: int) -> DataFrame:
    """Pieces that reach past their window as two: the end of it, and the next one's start.

    Their ids come from the stored pieces: the few keys are broadcast if measured small.
    Rows that repeat an id and its ids have one entry there and two here.
    """
    key = ["start", "length", "ids_crc32"]
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    asked = materialize(over.withColumn("name", named), "over")
    keys = asked.select("name", *key).distinct()
    if bounded(keys, ["name"], BROADCAST_BYTES):
        keys = F.broadcast(keys)
    stored = parts.select(named, *key, "ids").join(keys, ["name", *key], "left_semi").dropDuplicates(["name", *key])
    first = window - F.col("offset")
    head, rest = F.substring("ids", F.lit(1), 4 * first), F.substring("ids", 4 * first + 1, 4 * (F.col("length") - first))
    piece = F.array(
        F.struct(
            F.col("start").alias("start"), first.alias("length"), F.crc32(head).alias("ids_crc32"),
            F.col("sequence_id"), F.col("offset"), F.col("sequence_tokens"),
        ),
        F.struct(
            (F.col("start") + first).alias("start"), (F.col("length") - first).alias("length"), F.crc32(rest).alias("ids_crc32"),
            (F.col("sequence_id") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
            F.col("next_tokens").alias("sequence_tokens"),
        ),
    )
    return (
        asked.join(stored, ["name", *key])
        .select("doc_id", "doc_tokens", F.explode(piece).alias("p"))
        .select(
            "doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", "p.sequence_tokens"
        )
    )
