"""Toxicity: logistic regression on words and their beginnings, regularised by swapped
identity terms.

Sentences of the labelled sample that name a group are written again with another
group of the same list. The loss adds ``FAIRNESS`` times the squared difference of
the two scores, so naming a group moves the score as little as any other name would.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thresher.llm.common import beside, fold
from thresher.session import materialize

THRESHOLD = 0.7
MAX_LABELLED = 20_000
MAX_WORDS = 4096
MIN_CHI2 = 40.0
MIN_TOXIC = 5
FAIRNESS = 10.0
RIDGE = 1e-5
STEPS = 400
PREFIXES = (5, 6, 7, 8)
# Texts of an Arrow batch that a task holds as Python strings at a time.
HELD_TEXTS = 1000

# Group names that can stand in for one another, per language and kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
)

_BLANKS = bytes.maketrans(bytes(range(128)), bytes(b if chr(b).isalnum() else 32 for b in range(128)))
_SENTENCE = re.compile(r"[.!?\n]+")


def words(text: str | None) -> set[bytes]:
    """Distinct lower-case words of a whole text; ASCII punctuation separates."""
    return set((text or "").lower().encode().translate(_BLANKS).split())


def features(own: set[bytes]) -> set[bytes]:
    """The words, and their first bytes (marked by ``*``) for words of one stem."""
    return own.union(*({w[:n] + b"*" for w in own if len(w) > n} for n in PREFIXES))


def swaps() -> dict[bytes, list[bytes]]:
    found: dict[bytes, list[bytes]] = {}
    for group in IDENTITY_TERMS:
        for term in group:
            found.setdefault(term.encode(), []).extend(x.encode() for x in group if x != term)
    return found


def swapped(said: set[bytes], term: bytes, partners: list[bytes]) -> set[bytes]:
    """A sentence's words with another group's name for ``term``.

    The words are swapped before features are made of them, so the beginnings of the old
    name go and those of the new one come. The partner follows from the words alone.
    """
    pick = zlib.crc32(b" ".join(sorted(said)) + b"/" + term) % len(partners)
    return (said - {term}) | {partners[pick]}


@dataclass
class Model:
    """Weights of the chosen features; a text scores by those it has at least once."""

    bias: float = 0.0
    weights: dict[bytes, float] = field(default_factory=dict)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        whole = {w for w in self.weights if not w.endswith(b"*")}
        stems = [(n, {w[:-1] for w in self.weights if w.endswith(b"*") and len(w) == n + 1}) for n in PREFIXES]
        for i, text in enumerate(texts):
            own = words(text)
            found = list(own & whole)
            for n, known in stems:
                if known:
                    found += [w[:n] + b"*" for w in {w[:n] for w in own if len(w) > n} & known]
            total[i] += sum(self.weights[w] for w in sorted(found))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def held_scores(model: Model, texts: pa.Array) -> np.ndarray:
    """``model.scores`` of a column, ``HELD_TEXTS`` texts at a time."""
    starts = range(0, max(1, len(texts)), HELD_TEXTS)
    return np.concatenate([model.scores(texts.slice(at, HELD_TEXTS).to_pylist()) for at in starts])


class Rows:
    """Sets of word numbers, one per text, as flat arrays."""

    def __init__(self, sets: list[list[int]], width: int):
        self.flat = np.concatenate([np.array(s, np.int64) for s in sets] + [np.zeros(0, np.int64)])
        self.owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.count, self.width = len(sets), width

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.flat], self.count)

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, errors[self.owner], self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: Rows, labels: np.ndarray, before: Rows, after: Rows) -> tuple[float, np.ndarray]:
    """Minimise log loss (classes weighed alike) + ridge + the counterfactual penalty.

    Adam on the whole bounded sample; starts at zero, so the fit is reproducible.
    """
    theta = np.zeros(texts.width + 1)
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, b = theta[1:], theta[0]
        error = weight * (_sigmoid(texts.dot(w) + b) - labels)
        slope = np.concatenate(([error.sum()], texts.back(error) + RIDGE * w))
        if before.count:
            p, q = _sigmoid(before.dot(w) + b), _sigmoid(after.dot(w) + b)
            gap = 2 * FAIRNESS * (p - q) / before.count
            up, down = gap * p * (1 - p), gap * q * (1 - q)
            slope[1:] += before.back(up) - after.back(down)
            slope[0] += (up - down).sum()
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return theta[0], theta[1:]


def _sample(documents: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` labelled documents by a hash of the id, joined to their texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, limit / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    return documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", "text")


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on a sample of about ``max_labelled`` labelled documents, the stated bound.

    Features enter by chi-square against the label (at most ``MAX_WORDS``) next to all
    identity terms. Several labels of one document count as toxic if one says so.
    Without labels of both kinds the model is the smoothed share of toxic ones.
    """
    rows = materialize(_sample(documents, labels, max_labelled), "sample")
    sums = rows.agg(F.count("*"), F.sum("toxic")).first()
    total, toxic = sums[0], int(sums[1] or 0)
    if toxic in (0, total):
        share = (toxic + 0.5) / (total + 1)
        return Model(float(np.log(share / (1 - share))))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for label, text in zip(batch["toxic"].to_pylist(), batch["text"]):
                for word in features(words(text.as_py())):
                    counts.setdefault(word, [0, 0])[label] += 1
            yield pa.record_batch(
                {
                    "word": pa.array(list(counts), pa.binary()),
                    "clean": pa.array([c[0] for c in counts.values()], pa.int64()),
                    "toxic": pa.array([c[1] for c in counts.values()], pa.int64()),
                }
            )

    a, b = F.col("toxic"), F.col("clean")
    c, d = toxic - a, (total - toxic) - b
    chi2 = total * (a * d - b * c) ** 2 / ((a + b) * (c + d) * float(toxic) * (total - toxic))
    chosen = (
        rows.mapInArrow(distinct, "word binary, clean long, toxic long")
        .groupBy("word")
        .agg(F.sum("clean").cast("double").alias("clean"), F.sum("toxic").cast("double").alias("toxic"))
        .filter((a >= MIN_TOXIC) & (c + d > 0))
        .select("word", chi2.alias("chi2"))
        .filter(F.col("chi2") >= MIN_CHI2)
        .orderBy(F.desc("chi2"), "word")
        .limit(MAX_WORDS)
        .collect()
    )
    others = swaps()
    place = {w: i for i, w in enumerate(sorted({bytes(r[0]) for r in chosen} | set(others)))}

    def known(said: set[bytes]) -> list[int]:
        return sorted(place[w] for w in features(said) & place.keys())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, text in zip(batch["toxic"].to_pylist(), (t.as_py() for t in batch["text"])):
                own = words(text)
                out.append((0, label, known(own), []))
                if own & others.keys():
                    for sentence in _SENTENCE.split(text):
                        said = words(sentence)
                        for term in sorted(said & others.keys()):
                            out.append((1, label, known(said), known(swapped(said, term, others[term]))))
            kinds = pa.list_(pa.int32())
            yield pa.record_batch(
                {
                    "kind": pa.array([r[0] for r in out], pa.int32()),
                    "label": pa.array([r[1] for r in out], pa.int32()),
                    "own": pa.array([r[2] for r in out], kinds),
                    "turned": pa.array([r[3] for r in out], kinds),
                }
            )

    coded = rows.mapInArrow(encode, "kind int, label int, own array<int>, turned array<int>").collect()
    coded.sort(key=lambda r: (r["kind"], r["label"], r["own"], r["turned"]))
    plain, pairs = [r for r in coded if not r["kind"]], [r for r in coded if r["kind"]]
    bias, weights = fit(
        Rows([r["own"] for r in plain], len(place)),
        np.array([r["label"] for r in plain], float),
        Rows([r["own"] for r in pairs], len(place)),
        Rows([r["turned"] for r in pairs], len(place)),
    )
    return Model(float(bias), {w: float(weights[i]) for w, i in place.items() if weights[i]})


def tagged(
    documents: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("_toxic_score", "_toxic")
) -> DataFrame:
    """The documents with score and decision, as ``score`` defines them, in the columns
    ``names`` (ones that the table does not have)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batch: pa.RecordBatch) -> dict:
        values = held_scores(shared.value, batch[text])
        return dict(zip(names, (values, (values >= THRESHOLD).astype(np.int32))))

    return beside(documents, [text], scored, "`%s` double, `%s` int" % names)


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; predicted is 1 from 0.7 on.

    Null, empty and wordless texts get the score of a text without known words.
    Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return tagged(rows, model).select(
        "doc_id", F.col("_toxic_score").alias("score"), F.col("_toxic").alias("predicted")
    )


def held_out(doc_id: str = "doc_id"):
    return fold(doc_id, 3) == 1


def predict_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled documents outside the held-out fold, score all documents."""
    model = train(documents.filter(~held_out()), labels.filter(~held_out()))
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
