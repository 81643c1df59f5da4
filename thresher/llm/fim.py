"""Fill-in-middle: cut a text at unit borders into prefix, middle and suffix, and reorder.

Borders are found on words of eight bytes: the UTF-8 text is viewed as uint64, the bytes
that end a unit are marked by arithmetic on whole words, marks are counted per word, and
a running count leads to the word, and within it to the byte, of any border.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("line", "char")
RATE, SPM_RATE, SEED = 100, 50, 7
BATCH_BYTES = 8 << 20

_LOW7, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
_NEWLINES = np.uint64(0x0A0A0A0A0A0A0A0A)
_ONE, _BYTE, _TOP = np.uint64(1), np.uint64(8), np.uint64(56)


def as_words(data: bytes) -> np.ndarray:
    """The bytes as little-endian uint64, zero-filled to a whole word."""
    return np.frombuffer(data + b"\0" * (-len(data) % 8), "<u8")


def newline_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is a newline (exact: no carry leaves a byte)."""
    x = words ^ _NEWLINES
    return ~(((x & _LOW7) + _LOW7) | x) & _HIGH


def continuation_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that continues a code point (10xxxxxx)."""
    return words & ~(words << _ONE) & _HIGH


def character_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte before one that starts a code point."""
    starts = ~continuation_marks(words) & _HIGH
    following = np.append(starts[1:], _HIGH)
    return (starts >> _BYTE) | (following << _TOP)


def _kept(marks: np.ndarray, size: int) -> np.ndarray:
    """Marks without those of the zero bytes behind the text."""
    if size % 8 and len(marks):
        marks = marks.copy()
        marks[-1] &= (_ONE << np.uint64(8 * (size % 8))) - _ONE
    return marks


@dataclass
class Borders:
    """Where the units of one text end; a text's last byte always ends a unit."""

    marks: np.ndarray
    running: np.ndarray
    size: int
    units: int

    @classmethod
    def of(cls, data: bytes, unit: str = "line") -> Borders:
        words = as_words(data)
        marks = _kept(newline_marks(words) if unit == "line" else character_marks(words), len(data))
        running = np.cumsum(np.bitwise_count(marks), dtype=np.int64)
        ended = int(running[-1]) if len(running) else 0
        open_end = bool(data) and not int(marks[-1]) >> (8 * ((len(data) - 1) % 8) + 7) & 1
        return cls(marks, running, len(data), ended + open_end)

    def after(self, units: int) -> int:
        """The number of bytes in the first ``units`` units."""
        if units <= 0:
            return 0
        if units >= self.units:
            return self.size
        at = int(np.searchsorted(self.running, units))
        rest = units - (int(self.running[at - 1]) if at else 0)
        word = int(self.marks[at])
        for _ in range(rest - 1):
            word &= word - 1
        return 8 * at + ((word & -word).bit_length() - 1) // 8 + 1


def characters(data: bytes) -> int:
    """Code points of UTF-8 bytes, counted by words."""
    return len(data) - int(np.bitwise_count(_kept(continuation_marks(as_words(data)), len(data))).sum())


@dataclass
class Cut:
    """What became of one text."""

    units: int
    form: str
    output: bytes
    prefix_chars: int | None = None
    middle_chars: int | None = None


def cut(
    data: bytes, doc_id: int | None, unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED
) -> Cut:
    """Form and output of one text; the id and ``seed`` decide everything random."""
    borders = Borders.of(data, unit)
    name = "" if doc_id is None else doc_id
    digits = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    marked = any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE))
    if not data or marked or h3 % 100 >= rate:
        return Cut(borders.units, "plain", data)
    places = h1 % (borders.units + 1), h2 % (borders.units + 1)
    one, two = borders.after(min(places)), borders.after(max(places))
    prefix, middle, suffix = data[:one], data[one:two], data[two:]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    spm = h4 % 100 < spm_rate
    output = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    return Cut(borders.units, "spm" if spm else "psm", output, characters(prefix), characters(middle))


def transform(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    unit: str = "line",
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every whole text.

    ``n`` counts the units (``line``: up to and with its newline; ``char``: a code point).
    ``rate`` of a hundred texts are cut, ``spm_rate`` of those put the suffix first. A
    text that is empty or holds a marker stays plain, with null lengths. A null text is
    empty; a null id draws like an empty one. Repeated rows stay, other columns are
    ignored, an empty table gives no rows. Map-only.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("data"),
    )

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done, held = [], [], 0
            for name, data in zip(batch["doc_id"].to_pylist(), batch["data"]):
                ids.append(name)
                done.append(cut(data.as_py(), name, unit, rate, spm_rate, seed))
                held += len(done[-1].output)
                if held >= BATCH_BYTES:
                    yield _batch(ids, done)
                    ids, done, held = [], [], 0
            yield _batch(ids, done)

    made = rows.mapInArrow(
        cut_all, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    )
    return made.withColumn("output", F.col("output").cast("string"))


def _batch(ids: list, done: list[Cut]) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n": pa.array([c.units for c in done], pa.int64()),
            "form": pa.array([c.form for c in done], pa.string()),
            "prefix_chars": pa.array([c.prefix_chars for c in done], pa.int64()),
            "middle_chars": pa.array([c.middle_chars for c in done], pa.int64()),
            "output": pa.array([c.output for c in done], pa.binary()),
        }
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone.

    A text that was cut holds no marker, and no marker can arise where a piece meets
    one, so the first and last places of each marker are its own.
    """

    def between(first: str, last: str) -> Column:
        return F.substring_index(F.substring_index(output, last, 1), first, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )
