import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from thresher.llm import ngram_lm as lm


def plain_tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def level_mean(count):
    """Mean of the whole counts on the level of ``count``."""
    if not count:
        return 0.0
    place = np.searchsorted(lm.LEVEL_FROM, count, side="right")
    return float(lm.LEVEL_MEAN[place])


def plain_scores(training, text, weight=lm.PAIR_WEIGHT):
    """Exact counts in dictionaries, quantised the same way, no filter."""
    words, pairs = Counter(), Counter()
    for t in training:
        tokens = plain_tokens(t)
        words.update(tokens)
        pairs.update(zip([b"\n"] + tokens[:-1], tokens))
    total = words.total() + len(words)
    base = score = 0.0
    before = b"\n"
    tokens = plain_tokens(text)
    for v in tokens:
        base += math.log10((words[v] + 1) / (total + 1))
        single, context = (level_mean(words[v]) + 1) / (total + 1), level_mean(words[before])
        chance = single
        if context:
            pair = min(level_mean(pairs[before, v]), context, level_mean(words[v]))
            chance = weight * pair / context + (1 - weight) * single
        score += min(0.0, math.log10(chance))
        before = v
    return len(tokens), sum(words[v] > 0 for v in tokens), words.total(), base, score


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(f"W{int(pick.paretovariate(0.7)) % 500}" for _ in range(n))


def rows():
    found = [(i, prose(i, 5 + i * 3)) for i in range(60)]
    return found + [(100, None), (101, ""), (102, "never seen words"), (103, prose(1, 20_000)), (3, prose(3, 14)), (None, "W1 w1\x0bW2")]


def test_scores_equal_exact_counts(documents, monkeypatch):
    monkeypatch.setattr(lm, "STEP_BYTES", 300)
    training = [t for _, t in rows()[:50]]
    docs = documents(rows())
    found = lm.score(docs, documents(list(enumerate(training))).select("text")).collect()
    assert len(found) == len(rows())
    want = sorted((str(i), *plain_scores(training, t)) for i, t in rows())
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found)
    for w, g in zip(want, got):
        assert w[:4] == g[:4]
        assert g[4] == pytest.approx(w[4], abs=1e-6) and g[5] == pytest.approx(w[5], rel=1e-3)


def test_rare_words_are_joined_exactly(documents, monkeypatch):
    """With a tiny broadcast the exact counts still give the same base score."""
    monkeypatch.setattr(lm, "FREQUENT", 4)
    training = [t for _, t in rows()[:50]]
    docs = documents(rows()[:20])
    found = lm.score(docs, documents(list(enumerate(training))).select("text")).collect()
    for r in found:
        want = plain_scores(training, dict(rows()[:20])[r.doc_id])
        assert (r.n_tokens, r.n_known) == want[:2] and r.base_score == pytest.approx(want[3], abs=1e-6)


def test_filter_never_reads_too_low():
    pick = np.random.default_rng(1)
    keys = pick.integers(0, 2**64, 3000, dtype=np.uint64)
    counts = (pick.pareto(0.6, 3000) + 1).astype(np.int64).clip(1, 10**9)
    bits = lm.MIN_BITS // lm.SEGMENTS
    spaces = np.zeros((lm.SEGMENTS, bits), np.uint8)
    segments = lm.segment_of(keys).astype(int)
    for segment in np.unique(segments):
        own = segments == segment
        lm.set_bits(spaces[segment], keys[own], counts[own])
    bloom = lm.Filter(np.packbits(spaces.reshape(-1), bitorder="little").tobytes())
    level = np.searchsorted(lm.LEVEL_FROM, counts, side="right")
    assert (bloom.level(keys) >= level).all() and (bloom.level(keys) == level).mean() > 0.99
    assert (bloom.level(pick.integers(0, 2**64, 20_000, dtype=np.uint64)) == 0).mean() > 0.99


def test_levels_hold_every_count():
    assert lm.LEVEL_FROM[0] == 1 and lm.LEVEL_FROM[-1] > 10**15
    for low, high, mean in zip(lm.LEVEL_FROM, lm.LEVEL_FROM[1:], lm.LEVEL_MEAN[1:]):
        assert low <= mean < high


def test_probabilities_of_a_context_add_up(documents):
    """Over all words after one context the model gives about one in total."""
    training = [prose(i, 400) for i in range(30)]
    vocabulary = sorted({w for t in training for w in t.lower().split()})
    docs = documents([(i, f"w1 {w}") for i, w in enumerate(vocabulary)] + [(9999, "w1")])
    scores = {r.doc_id: r.score for r in lm.score(docs, documents(list(enumerate(training))).select("text")).collect()}
    words, pairs = Counter(), Counter()
    for t in training:
        tokens = plain_tokens(t)
        words.update(tokens)
        pairs.update(zip([b"\n"] + tokens[:-1], tokens))
    total = 0.0
    for i, w in enumerate(vocabulary):
        rest = plain_scores(training, f"w1 {w}")[4]
        assert scores[i] == pytest.approx(rest, rel=1e-3)
        total += level_mean(pairs[b"w1", w.encode()])
    total += level_mean(pairs[b"w1", b"\n"])
    assert 0.75 < total / level_mean(words[b"w1"]) < 1.35


def test_admission_keeps_the_most_frequent_levels(spark):
    counts = spark.createDataFrame([(1,)] * 100 + [(2,)] * 20 + [(50,)] * 3, "n long")
    fifty = int(np.searchsorted(lm.LEVEL_FROM, 50, side="right"))
    assert lm.admitted_from(counts, 10**6) == 1
    assert lm.admitted_from(counts, 3 * fifty + 45) == 2
    assert 3 <= lm.admitted_from(counts, 3 * fifty + 5) <= 50


def test_nothing_to_learn_or_score(documents):
    empty = documents([]).select("text")
    found = lm.score(documents([(1, "a b"), (2, None)]), empty).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(r.score <= 0 and math.isfinite(r.score) for r in found)
    assert lm.score(documents([]), documents([(1, "a")]).select("text")).count() == 0


def test_held_out_texts_score_above_the_base(spark):
    found = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    means = found.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert means[0] > means[1]
