import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_ngram_lm import plain_scores
from thresher.llm import ngram_lm as lm


def test_a_filter_beyond_the_broadcast_keeps_every_ngram(documents, monkeypatch):
    pick = random.Random(4)
    training = [" ".join(f"w{int(pick.paretovariate(0.5)) % 60_000}" for _ in range(3000)) for _ in range(100)]
    rows = [(i, training[i][:2000]) for i in range(40)] + [(50, None), (51, "never seen"), (3, "w1 w2"), (None, "w7")]
    learned = documents(list(enumerate(training))).select("text")
    monkeypatch.setattr(lm, "MIN_BITS", 1 << 19)
    monkeypatch.setattr(lm, "STEP_BYTES", 5000)

    def scores():
        return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(documents(rows), learned).collect())

    whole = scores()
    monkeypatch.setattr(lm, "MAX_BITS", 1 << 19)
    parted = scores()
    assert len(parted) == len(rows)
    for w, p in zip(whole, parted):
        assert w[:3] == p[:3] and p[3:] == pytest.approx(w[3:], abs=1e-9)
    exact = {str(i): plain_scores(training, t)[4] for i, t in rows if i not in (3,)}
    for p in parted:
        if p[0] in exact and p[0] != "3":
            assert p[4] == pytest.approx(exact[p[0]], rel=0.02)


def test_false_hits_at_the_planned_fill():
    pick, size = np.random.default_rng(1), 1 << 17
    space = np.zeros(size, np.uint8)
    keys = pick.integers(0, 2**54, size // 16, dtype=np.uint64)
    lm.set_bits(space, keys, np.ones(len(keys), np.int64))
    unseen = pick.integers(0, 2**54, 400_000, dtype=np.uint64)
    found = lm.probe(np.packbits(space, bitorder="little").tobytes(), unseen, np.zeros(len(unseen), np.int64), size)
    assert (found > 0).mean() < 0.004


def test_keys_travel_as_sums_of_slices(documents, monkeypatch):
    """A task's keys leave it in one row a slice, and slices multiply with the tokens."""
    pick = random.Random(5)
    texts = [" ".join(f"w{int(pick.paretovariate(0.7)) % 900}" for _ in range(2000)) for _ in range(12)]
    rows = documents(list(enumerate(texts))).select("text").coalesce(1)
    counts = lm.word_counts(rows)
    assert lm.slices_for(0) == lm.SEGMENTS and lm.slices_for(lm.SLICE_KEYS * lm.SEGMENTS) == 2 * lm.SEGMENTS
    for slices in (lm.SEGMENTS, 4 * lm.SEGMENTS):
        found = lm.key_counts(rows, counts, slices).collect()
        keys = np.concatenate([np.frombuffer(r["keys"], "<u8") for r in found])
        assert len(found) < len(keys) and all(r["slice"] // (slices // lm.SEGMENTS) == r["segment"] for r in found)
        assert all((lm.segment_of(np.frombuffer(r["keys"], "<u8")) == r["segment"]).all() for r in found)
        n = np.concatenate([np.frombuffer(r["n"], "<i8") for r in found])
        # Each token counts as a word and as the end of a pair.
        assert n.sum() == 2 * 12 * 2001


def test_a_segment_answers_all_steps_at_once(monkeypatch):
    """Not one lookup for each step and segment, whose number grows with both."""
    pick, size, keys, rows = np.random.default_rng(2), 1 << 15, {}, []
    for segment in (3, 4):
        keys[segment] = pick.integers(0, 2**54, 3000, dtype=np.uint64)
        space = np.zeros(size, np.uint8)
        lm.set_bits(space, keys[segment][:900], pick.integers(1, 50, 900))
        rows.append((segment, -1, np.packbits(space, bitorder="little").tobytes()))
        rows += [(segment, step, keys[segment][step * 50 : step * 50 + 50].tobytes()) for step in range(60)]
    rows.append((5, 7, keys[4][:2].tobytes()))  # nothing was learned there
    made = lambda some: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some), (pa.int32(), pa.int64(), pa.binary()))], names=["segment", "step", "data"])
    calls, probe = [], lm.probe
    monkeypatch.setattr(lm, "probe", lambda *a: calls.append(1) or probe(*a))
    found = [r for b in lm.answers(iter([made(rows[:20]), made(rows[20:])]), size) for r in b.to_pylist()]
    assert len(calls) == 3 and [(r["segment"], r["step"]) for r in found] == [r[:2] for r in rows if r[1] >= 0]
    data = {segment: bits for segment, step, bits in rows if step < 0}
    for r in found[:-1]:
        own = keys[r["segment"]][r["step"] * 50 : r["step"] * 50 + 50]
        want = probe(data[r["segment"]], own, np.zeros(50, np.int64), size)
        assert r["levels"] == want.astype(np.uint8).tobytes()
    assert found[-1]["levels"] == bytes(2)


def test_tokens_are_the_lower_case_words_between_ascii_white_space():
    texts = ["", None, " Two  words\t", "\x0b\x0c", "\u00c4B\u00a0c d\x1ce\r\nTWO", "two", "\n"]
    for some in ([texts, texts[2:3], ["a"], [None]]):
        t = lm.Tokens.of(pa.array([None, *some], pa.string())[1:])
        want = [(x or "").encode().lower().split() + [lm.END] for x in some]
        assert [t.words[i] for i in t.places] == sum(want, []) and t.ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
        assert len(set(t.words)) == len(t.words)
