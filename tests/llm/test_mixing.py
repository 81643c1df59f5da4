import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from thresher.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2)):
    """Share out 150 % by weight again and again until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % 3]) for i, s in enumerate(order)}
    left, target, free = Fraction(3, 2) * sum(sizes.values()), {}, set(sizes)
    while free:
        mass = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / mass > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / mass for s in free}
        target |= {s: Fraction(2 * sizes[s]) for s in over}
        left, free = left - sum(target[s] for s in over), free - over
    return target


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def check(rows, found, slack):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += words(text)
    want, taken = plain_targets(sizes), defaultdict(int)
    source_of = {i: s for i, _, _, s in rows}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(float(want[source]))
        taken[source] += r.taken
    for source in sizes:
        # Whole documents: equal sizes leave up to half a document.
        least = min([words(t) for _, t, _, s in rows if s == source and words(t)], default=0)
        assert abs(taken[source] - float(want[source])) <= max(slack, least / 2), source
    assert sorted(r.size for r in found) == sorted(words(t) for _, t, _, _ in rows)


def corpus():
    rows = [(i, "w " * (1 + i * i % 97), None, f"s{i % 5}" if i % 3 else "big") for i in range(900)]
    rows += [(1000 + i, "v " * 500, None, "copies") for i in range(300)] + [(2000, "x\x0by z" + " z" * 20_000, None, "s1")]
    return rows + [(3000 + i, "q " * (5 + i), None, None) for i in range(30)] + [(4000, None, None, "s2"), (4001, " \t", None, "empty")]


def test_targets_and_words_taken(documents):
    rows = corpus()
    found = mixing.mix(documents(rows)).collect()
    assert len(found) == len(rows)
    check(rows, found, 12)


def test_reruns_agree_on_other_partitions(documents):
    rows = corpus()
    first, second = (sorted(map(tuple, mixing.mix(documents(rows, parts)).collect())) for parts in (2, 5))
    assert first == second


def test_means_follow_the_rate(spark, monkeypatch):
    """Over many seeds a document is taken as often as its source's rate says."""
    sizes = spark.createDataFrame([(i, "a" if i < 6 else "b", 10 + i) for i in range(9)], "doc_id long, source string, size long")
    sources = mixing.targets(sizes).cache()
    total, rate = defaultdict(int), {}
    for seed in range(8):
        monkeypatch.setattr(mixing, "SEED", 1000 * seed)
        for r in mixing.copies(sizes, sources).collect():
            total[r.doc_id] += r.copies
            rate[r.doc_id] = r.target / r.source_size
    for doc_id, copies in total.items():
        assert abs(copies / 8 - rate[doc_id]) < 0.7
    assert sum(total.values()) / 8 == pytest.approx(sum(rate.values()), rel=0.12)


def test_repeated_ids_nulls_and_nothing(documents):
    rows = [(1, "a b", None, "x"), (1, "a b", None, "x"), (1, "c d e", None, "x"), (None, "f", None, "y"), (None, None, None, None)]
    found = mixing.mix(documents(rows)).collect()
    assert sorted(r.size for r in found) == [0, 1, 2, 2, 3]
    assert mixing.mix(documents([])).collect() == []
    assert mixing.mix(documents([(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


def test_documents_come_as_often_as_taken(documents):
    docs = documents(corpus())
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    assert {k for k, v in want.items() if v > 1}


def test_one_id_in_two_sources(documents):
    """Copies go to the row that earned them, so each source's words come near its target."""
    rows = [(i, f"{s} " * n, None, s) for i in range(400) for s, n in (("a", 16), ("b", 20 + i % 90))]
    docs = documents(rows)
    target = {r.source: r.target for r in mixing.targets(mixing.word_sizes(docs)).collect()}
    taken = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        taken[r.source] += words(r.text)
    assert all(abs(taken[s] - target[s]) <= 60 for s in "ab")


def test_rows_without_an_id_spread_over_blocks(documents):
    rows = [(None, f"x{i}" + " y" * 9, None, "a") for i in range(3000)] + [(None, "same words", None, "a")] * 3000
    names = mixing.placed(mixing.word_sizes(documents(rows)), mixing.scratch_dir(documents(rows).sparkSession))
    blocks = names.groupBy(F.pmod(F.xxhash64("print", "place"), F.lit(94))).count().agg(F.max("count"), F.count("*")).first()
    assert blocks[1] == 94 and blocks[0] < 130
    assert names.select("print", "place").distinct().count() == 6000
    check([(None, t, None, s) for _, t, _, s in rows], mixing.mix(documents(rows)).collect(), 12)


def test_repeated_rows_and_clashing_columns(spark, documents):
    rows = [(i % 40, "one text", None, "a") for i in range(200)] + [(None, "b " * (1 + i % 7), None, "b") for i in range(200)]
    docs = documents(rows).withColumns({c: F.lit(7) for c in ("copies", "place", "print", "row", "_turn", "_copy", "spot", "members")})
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.size] += r.copies
    for r in mixed.collect():
        got[r.doc_id, words(r.text)] += 1
        assert r.place == 7
    assert {k: v for k, v in want.items() if v} == got
