"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to ``ORDER`` bytes. The code length of
a byte is that of the longest context of the tree: ``n / (N + T)`` for a byte seen
``n`` times among ``N`` with ``T`` distinct ones, else the escape ``T / (N + T)`` and
the next shorter context, down to 1/256. The counts are frozen before scoring, so
the length of a text is the sum over its bytes, exact for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thresher.llm.common import beside, fold, fresh

ORDER = 3
TRAIN_BYTES = 6_000_000
PIECE = 1 << 18
# Texts of an Arrow batch that a task holds as Python strings at a time.
HELD_TEXTS = 1000
PAD = b" " * ORDER
INDEX_BITS = 22
UNDETERMINED = "und"
ADDED = ("_lang_pred", "_lang_score", "_lang_bits")


def _grams(data: np.ndarray) -> np.ndarray:
    """Byte and its ORDER predecessors as one 32-bit number, from the first full one on."""
    wide = data.astype(np.uint32)
    return (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of whole texts in groups of about PIECE bytes, with each gram's text.

    A text longer than a piece continues in the next one with its left context.
    """
    held, owners, size = [], [], 0
    for number, text in enumerate(texts):
        data = PAD + text.encode().lower()
        for at in range(0, max(1, len(data) - ORDER), PIECE):
            part = data[at : at + PIECE + ORDER]
            if len(part) > ORDER:
                held.append(_grams(np.frombuffer(part, np.uint8)))
                owners.append((number, len(part) - ORDER))
                size += len(part)
            if size >= PIECE:
                yield np.concatenate(held), np.array(owners)
                held, owners, size = [], [], 0
    if held:
        yield np.concatenate(held), np.array(owners)


def _at(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return place, sorted_keys[place] == keys


@dataclass
class Tree:
    """The context tree of one language: per order the coded bytes and the escapes."""

    seen: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray) -> Tree:
        seen, escapes = [], []
        for order in range(ORDER + 1):
            keys, place = np.unique(grams & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(place, counts)
            contexts, place, kinds = np.unique(keys >> np.uint32(8), return_inverse=True, return_counts=True)
            total = np.bincount(place, n)
            seen.append((keys, np.log2((total + kinds)[place] / n)))
            escapes.append((contexts, np.log2((total + kinds) / kinds)))
        return cls(seen, escapes)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the bytes before it."""
        cost = np.full(len(grams), 8.0)
        for order in range(ORDER + 1):
            keys = grams & np.uint32((1 << 8 * (order + 1)) - 1)
            context, known = _at(self.escapes[order][0], keys >> np.uint32(8))
            cost = np.where(known, cost + self.escapes[order][1][context], cost)
            place, coded = _at(self.seen[order][0], keys)
            cost = np.where(coded, self.seen[order][1][place], cost)
        return cost


class Model:
    """The trees of all languages, with a direct index of the grams of the trees."""

    def __init__(self, languages: list[str], trees: list[Tree]):
        self.languages, self.trees = languages, trees
        self._index = None

    def _prepare(self) -> None:
        self._known = np.unique(np.concatenate([t.seen[ORDER][0] for t in self.trees]))
        self._bits = np.stack([t.bits(self._known) for t in self.trees], axis=1).astype(np.float32)
        self._index = np.zeros(1 << INDEX_BITS, np.int32)
        self._index[self._slot(self._known)] = np.arange(len(self._known), dtype=np.int32)

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint32(2654435761)) >> np.uint32(32 - INDEX_BITS)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of every whole text (rows) in every language (columns)."""
        if self._index is None:
            self._prepare()
        total = np.zeros((len(texts), len(self.trees)))
        for grams, owners in _pieces(texts):
            place = self._index[self._slot(grams)]
            bits = self._bits[place]
            missed = np.flatnonzero(self._known[place] != grams)
            if len(missed):
                fresh, back = np.unique(grams[missed], return_inverse=True)
                bits[missed] = np.stack([t.bits(fresh) for t in self.trees], axis=1)[back]
            starts = np.concatenate(([0], np.cumsum(owners[:, 1])[:-1]))
            np.add.at(total, owners[:, 0], np.add.reduceat(bits, starts, axis=0, dtype=np.float64))
        return total

    def __getstate__(self):
        return {"languages": self.languages, "trees": self.trees, "_index": None}


def train(documents: DataFrame, text: str = "text", lang: str = "lang", train_bytes: int = TRAIN_BYTES) -> Model | None:
    """Fit one tree per language on a sample of about ``train_bytes`` of its text.

    The sample takes whole documents by a hash of their text, the same share within a
    language, and at least the text with the smallest hash of each. Rows without a text
    or language teach nothing; no row at all gives None.
    """
    rows = documents.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    rows = rows.filter("text <> ''")
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")), F.min(place)).collect()
    if not sizes:
        return None
    last = {k: max(least, int(1_000_000 * min(1.0, train_bytes / v))) for k, v, least in sizes}
    drawn = place <= F.create_map(*[F.lit(x) for kv in last.items() for x in kv])[F.col("lang")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, HELD_TEXTS) for b in batches for at in range(0, b.num_rows, HELD_TEXTS)):
            for name, group in batch.to_pandas().groupby("lang"):
                for grams, _ in _pieces(group["text"].tolist()):
                    keys, n = np.unique(grams, return_counts=True)
                    names = pa.repeat(pa.scalar(name, pa.string()), len(keys))
                    yield pa.record_batch({"lang": names, "gram": keys.astype(np.int64), "n": n.astype(np.int64)})

    counts = (
        rows.filter(drawn).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ).toPandas()
    if counts.empty:
        return None
    languages = sorted(counts["lang"].unique())
    groups = dict(list(counts.groupby("lang")))
    return Model(languages, [Tree.of(groups[k]["gram"].to_numpy().astype(np.uint32), groups[k]["n"].to_numpy()) for k in languages])


def tagged(
    documents: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str, str] = ADDED
) -> DataFrame:
    """The documents with the columns ``names``: language and score, as ``identify``
    defines them, and the code length in that language in bits a byte of the text (null
    if undetermined). The names are ones that the table does not have."""
    if model is None:
        none = (F.lit(UNDETERMINED), F.lit(0.0), F.lit(None).cast("double"))
        return documents.withColumns(dict(zip(names, none)))
    letters = F.coalesce(F.col(text).cast("string").rlike("\\p{L}"), F.lit(False))
    mark = fresh(documents, "_letters")
    rows = documents.withColumn(mark, letters)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def measure(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        given = np.array(batch[mark].to_pylist(), bool)
        texts = [t if g else "" for t, g in zip(batch[text].to_pylist(), given)]
        sizes = np.array([len(t.encode().lower()) if g else 1 for t, g in zip(texts, given)])
        return given, sizes, shared.value.lengths(texts)

    def predict(batch: pa.RecordBatch) -> dict:
        parts = [measure(batch.slice(at, HELD_TEXTS)) for at in range(0, max(1, batch.num_rows), HELD_TEXTS)]
        given, sizes, bits = (np.concatenate(column) for column in zip(*parts))
        rest = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)).sum(axis=1)
        found = np.array(shared.value.languages, object)[bits.argmin(axis=1)]
        columns = (
            pa.array(np.where(given, found, UNDETERMINED), pa.string()),
            pa.array(np.where(given, 1.0 / rest, 0.0)),
            pa.array(bits.min(axis=1) / sizes, mask=~given),
        )
        return dict(zip(names, columns))

    return beside(rows, [text, mark], predict, "`%s` string, `%s` double, `%s` double" % names).drop(mark)


def identify(documents: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: the language with the shortest code of the whole text.

    ``score`` is that language's share when lengths are read as probabilities. A text
    that is null or has no letter is ``und`` with score 0, as is every text without a
    model. Equal lengths go to the language first by name. Repeated rows stay.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return tagged(rows, model).select(
        "doc_id", F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score")
    )


def held_out(doc_id: str = "doc_id"):
    return fold(doc_id, 4) == 2


def predict_languages(documents: DataFrame) -> DataFrame:
    """Learn from the documents outside the held-out fold, predict all of them."""
    model = train(documents.filter(~held_out()))
    return identify(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
