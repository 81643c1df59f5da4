"""Document quality from a linear-chain conditional random field over its lines.

Each non-blank line is good or bad. A line is described by the shape of its text (shares
of character kinds, repeated words and lines, lengths) and by that of its neighbours;
a 2 x 2 table weighs what follows what. Forward and backward messages give each line's
probability of being good, and their mean, weighted by length, is the document's share
of good text, which a logistic curve turns into its score.

Only documents are labelled, so the lines' labels are found: lines of good documents are
good, and of the lines of a bad document those are bad that the model so far holds bad
(one at least).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thresher.llm.common import add_columns, fold
from thresher.session import materialize

THRESHOLD = 0.3
MAX_LABELLED = 6_000
TRAIN_LINES = 256  # consecutive lines of a drawn document that the fit sees
STEPS = 80
ROUNDS = 3
RIDGE = 1e-4
CHUNK_BYTES = 2 << 20

# Upper bounds of the bins of a share, and of counts and lengths by powers.
_SHARES = np.array([1e-9, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.6, 0.8])
_BINS = len(_SHARES) + 1
_OWN, _SEEN = 13, (0, 1, 3, 4, 5, 6)  # groups of a line, and those it also takes from each neighbour
GROUPS = _OWN + 2 * len(_SEEN)
WIDTH = GROUPS * (_BINS + 1)

_KIND = np.zeros(256, np.uint8)
_UPPER, _LOWER, _DIGIT, _POINT, _SYMBOL, _SPACE, _REST = range(1, 8)
_KIND[:] = _SYMBOL
_KIND[65:91], _KIND[97:123], _KIND[48:58] = _UPPER, _LOWER, _DIGIT
_KIND[list(b".,;:?!'\"()-")] = _POINT
_KIND[[32, *range(9, 14)]] = _SPACE
_KIND[128:192], _KIND[192:] = _REST, _LOWER  # a code point beyond ASCII counts once, as a letter


def lines_of(text: str | None) -> list[bytes]:
    """The non-blank lines of a whole text; a text without one is a single empty line."""
    return [line for line in (text or "").encode("utf-8", "replace").split(b"\n") if line.strip()] or [b""]


def _bin(values: np.ndarray) -> np.ndarray:
    return np.searchsorted(_SHARES, values)


def _log_bin(values: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(values + 1), _BINS - 1).astype(np.int64)


def describe(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (a row of ``GROUPS`` for each line), line lengths, and lines per document."""
    counts = np.array([len(d) for d in documents], np.int64)
    lines = [line for d in documents for line in d]
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate(([0], np.cumsum(size[:-1] + 1)))
    kind = _KIND[data]

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.view(np.uint8), starts, dtype=np.int64)

    upper, lower, digit, point, symbol = (total(kind == k) for k in (_UPPER, _LOWER, _DIGIT, _POINT, _SYMBOL))
    loud = total((data == 33) | (data == 124))
    ended = np.zeros(len(data), bool)
    ended[:-1] = ((kind[:-1] == _SYMBOL) | (data[:-1] == 33)) & (kind[1:] == _SPACE)
    ended = total(ended)
    words, again, distinct, copies = (np.zeros(len(lines), np.int64) for _ in range(4))
    at = 0
    for document in documents:
        same = Counter(document) if len(document) > 1 else None
        for line in document:
            own = line.split()
            words[at], distinct[at] = len(own), len(set(own))
            again[at] = sum(map(eq, own, islice(own, 1, None)))
            copies[at] = same[line] if same else 1
            at += 1
    ink = np.maximum(1, upper + lower + digit + point + symbol)
    some = np.maximum(1, words)
    last = np.concatenate((starts[1:], [len(data)])) - 2
    edge = np.where(size > 0, 1 + (kind[starts] == _UPPER) + 2 * (kind[np.maximum(last, 0)] == _POINT), 0)
    begins = np.repeat(np.cumsum(counts) - counts, counts)
    place = np.arange(len(lines)) - begins
    where = np.minimum(place, 2) + 3 * (place == np.repeat(counts, counts) - 1)
    own = np.stack(
        [
            _bin(upper / np.maximum(1, upper + lower)),
            _bin(symbol / ink),
            _bin(digit / ink),
            _bin(point / ink),
            _bin(loud / some),
            _bin(ended / some),
            _bin(again / some),
            _bin(1 - distinct / some),
            _log_bin((upper + lower + digit + point + symbol) / some),
            _log_bin(size),
            _log_bin(copies - 1),
            edge,
            where,
        ],
        axis=1,
    )
    seen = own[:, _SEEN]
    outside = np.full((1, len(_SEEN)), _BINS)
    before = np.where((place == 0)[:, None], outside, np.roll(seen, 1, axis=0))
    after = np.where((where >= 3)[:, None], outside, np.roll(seen, -1, axis=0))
    bins = np.concatenate((own, before, after), axis=1)
    return bins + np.arange(GROUPS) * (_BINS + 1), size, counts


class Chains:
    """Documents as chains of lines, longest first, so that one step serves all of them."""

    def __init__(self, counts: np.ndarray):
        begins = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        self.begins, self.counts = begins[order], counts[order]
        self.last = begins + counts - 1
        alive = np.searchsorted(-self.counts, -np.arange(counts.max(initial=0)), side="left")
        self.steps = [self.begins[:n] + t for t, n in enumerate(alive)]

    def messages(self, u: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of good from the lines up to each one (itself included), and from those behind it."""
        front, back = u.copy(), np.zeros_like(u)
        for here in self.steps[1:]:
            a = front[here - 1]
            front[here] += np.logaddexp(a + table[1, 1], table[0, 1]) - np.logaddexp(a + table[1, 0], table[0, 0])
        for here in reversed(self.steps[1:]):
            b = u[here] + back[here]
            back[here - 1] = np.logaddexp(b + table[1, 1], table[1, 0]) - np.logaddexp(b + table[0, 1], table[0, 0])
        return front, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def share_of_good(good: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean of the lines' probabilities, weighted by length, of each document."""
    starts, weight = np.cumsum(counts) - counts, np.maximum(size, 1)
    return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)


@dataclass
class Model:
    """Weights of the line features, of label pairs (``[before, after]``), and the final curve."""

    weights: np.ndarray
    table: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        front, back = Chains(counts).messages(self.weights[features].sum(axis=1), self.table)
        return _sigmoid(front + back)

    def shares(self, documents: list[list[bytes]]) -> np.ndarray:
        features, size, counts = describe(documents)
        return share_of_good(self.marginals(features, counts), size, counts)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The quality of each whole text, in chunks of bounded size."""
        found, chunk, held = [np.zeros(0)], [], 0
        for text in texts:
            chunk.append(lines_of(text))
            held += len(text or "")
            if held >= CHUNK_BYTES:
                found.append(self.shares(chunk))
                chunk, held = [], 0
        if chunk:
            found.append(self.shares(chunk))
        return _sigmoid(self.slope * np.concatenate(found) + self.offset)


class Adam:
    """Steps down a slope, from a start that may already be good."""

    def __init__(self, theta: np.ndarray, rate: float):
        self.theta, self.rate, self.step = theta, rate, 0
        self.first, self.second = np.zeros_like(theta), np.zeros_like(theta)

    def move(self, slope: np.ndarray) -> None:
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * slope
        self.second = 0.999 * self.second + 0.001 * slope**2
        up = self.first / (1 - 0.9**self.step)
        self.theta = self.theta - self.rate * up / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-9)


def slope_of(
    theta: np.ndarray, features: np.ndarray, chains: Chains, labels: np.ndarray, weight: np.ndarray, chained: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the weighted negative log likelihood of the lines' labels, and their marginals.

    Expected minus observed features, and, if ``chained``, expected minus observed pairs.
    """
    u, table = theta[:-4][features].sum(axis=1), theta[-4:].reshape(2, 2)
    front, back = chains.messages(u, table) if chained else (u, np.zeros_like(u))
    good = _sigmoid(front + back)
    error = weight * (good - labels)
    slope = RIDGE * theta
    slope[:-4] += np.bincount(features.ravel(), np.repeat(error, features.shape[1]), WIDTH)
    if chained and len(chains.steps) > 1:
        now = np.concatenate(chains.steps[1:])
        a, b, w = front[now - 1], u[now] + back[now], weight[now]
        pair = np.stack([table[0, 0] + 0 * a, table[0, 1] + b, table[1, 0] + a, table[1, 1] + a + b])
        pair = np.exp(pair - pair.max(axis=0))
        seen = 2 * labels[now - 1].astype(int) + labels[now].astype(int)
        slope[-4:] += (w * pair / pair.sum(axis=0)).sum(axis=1) - np.bincount(seen, w, 4)
    return slope, good


def fit(features: np.ndarray, size: np.ndarray, counts: np.ndarray, quality: np.ndarray) -> Model:
    """Weights from documents of known quality, both kinds weighed alike.

    The first round looks at each line by itself (neither place nor neighbours), because
    every line starts with its document's label; the next ones are chains. Starts at zero
    and uses no chance.
    """
    chains, owner = Chains(counts), np.repeat(np.arange(len(counts)), counts)
    good_document = quality[owner] == 1
    labels = good_document.astype(float)
    share = np.maximum(size, 1) / np.add.reduceat(np.maximum(size, 1), np.cumsum(counts) - counts)[owner]
    weight = share * np.where(good_document, 0.5 / max(1, quality.sum()), 0.5 / max(1, (1 - quality).sum()))
    theta = np.zeros(WIDTH + 4)
    starts = np.cumsum(counts) - counts
    for number in range(ROUNDS):
        path, seen = Adam(theta, 0.1 if number == 0 else 0.05), features if number else features[:, : _OWN - 1]
        for _ in range(STEPS):
            slope, _ = slope_of(path.theta, seen, chains, labels, weight, number > 0)
            path.move(slope)
        theta = path.theta
        _, good = slope_of(theta, seen, chains, labels, weight, number > 0)
        worst = good == np.minimum.reduceat(good, starts)[owner]
        labels = (good_document | ((good > 0.5) & ~worst)).astype(float)
    model = Model(theta[:-4], theta[-4:].reshape(2, 2))
    shares = share_of_good(model.marginals(features, counts), size, counts)
    model.slope, model.offset = curve(shares, quality)
    return model


def curve(shares: np.ndarray, quality: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and offset of the logistic curve from share to quality, with a weak ridge."""
    theta, kinds = np.array([4.0, -2.0]), quality.astype(float)
    weight = np.where(quality == 1, 0.5 / max(1, quality.sum()), 0.5 / max(1, (1 - quality).sum()))
    x = np.stack([shares, np.ones_like(shares)])
    for _ in range(50):
        p = _sigmoid(theta @ x)
        slope = x @ (weight * (p - kinds)) + np.array([1e-3, 1e-3]) * theta
        bend = (x * (weight * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(bend, slope)
    return max(0.0, float(theta[0])), float(theta[1])


def _sample(documents: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` labelled documents by a hash of the id, joined to their texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, limit / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on about ``max_labelled`` labelled documents, the stated bound.

    Of a longer document the fit sees ``TRAIN_LINES`` consecutive lines from a place its
    hash decides. Several labels of one document count as bad if one says so. Without
    labels of both kinds every document scores the smoothed share of good ones.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for quality, text, at in zip(batch["quality"].to_pylist(), batch["text"], batch["at"].to_pylist()):
                own = lines_of(text.as_py())
                features, size, counts = describe([own])
                first = at % (len(own) - TRAIN_LINES + 1) if len(own) > TRAIN_LINES else 0
                kept = slice(first, first + TRAIN_LINES)
                yield pa.record_batch(
                    {
                        "quality": pa.array([quality], pa.int32()),
                        "features": pa.array([features[kept].astype("<i2").tobytes()], pa.binary()),
                        "size": pa.array([size[kept].astype("<i8").tobytes()], pa.binary()),
                    }
                )

    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2**31)).alias("at")
    rows = _sample(documents, labels, max_labelled).select("quality", F.col("text").cast("string").alias("text"), place)
    found = materialize(rows.mapInArrow(coded, "quality int, features binary, size binary"), "sample").collect()
    found.sort(key=lambda r: (r["quality"], bytes(r["features"]), bytes(r["size"])))
    quality = np.array([r["quality"] for r in found], np.int64)
    if len(set(quality.tolist()) & {0, 1}) < 2:
        share = (quality.sum() + 0.5) / (len(quality) + 1)
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    features = np.concatenate([np.frombuffer(r["features"], "<i2").reshape(-1, GROUPS) for r in found]).astype(np.int64)
    sizes = [np.frombuffer(r["size"], "<i8") for r in found]
    return fit(features, np.concatenate(sizes), np.array([len(s) for s in sizes], np.int64), quality)


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; predicted is 1 from 0.3 on.

    Null, empty and blank texts score like one empty line. Repeated rows stay; other
    columns are ignored; an empty table gives no rows. Map-only.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batch: pa.RecordBatch) -> dict:
        values = shared.value.scores(batch["text"].to_pylist())
        return {"score": values, "predicted": (values >= THRESHOLD).astype(np.int32)}

    return add_columns(rows, scored, "score double, predicted int").drop("text")


def label_lines(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line, good`` for each non-blank line, numbered from 1, with its probability."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def labelled(batch: pa.RecordBatch) -> dict:
        out = []
        for value in batch["text"]:
            features, _, counts = describe([lines_of(value.as_py())])
            out.append(shared.value.marginals(features, counts).tolist())
        return {"goods": pa.array(out, pa.list_(pa.float64()))}

    found = add_columns(rows, labelled, "goods array<double>")
    return found.select("doc_id", F.posexplode("goods").alias("line", "good")).withColumn("line", F.col("line") + 1)


def held_out(doc_id: str = "doc_id"):
    return fold(doc_id, 5) == 0


def predict_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled documents outside the held-out fold, score all documents."""
    model = train(documents.filter(~held_out()), labels.filter(~held_out()))
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
