import random

import corpus_pipeline

from tests.llm.test_simhash import prose
from thresher.llm import simhash
from thresher.session import materialize


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    """Smallest id over links at a Jaccard similarity of 0.8 or more, by all pairs."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return sets[a] == sets[b] or both / (len(sets[a]) + len(sets[b]) - both) >= 0.8

    label = {}
    for start in sorted(sets):
        if start not in label:
            stack, label[start] = [start], start
            while stack:
                x = stack.pop()
                for y in sets:
                    if y not in label and linked(x, y):
                        label[y] = start
                        stack.append(y)
    return label


def changed(text, seed, times):
    words, pick = text.split(), random.Random(seed)
    for i in pick.sample(range(len(words)), times):
        words[i] = f"new{seed}"
    return " ".join(words)


def test_similar_texts_equal_brute_force(documents):
    """Copies with 1 to 8 of 200 words changed lie on both sides of 0.8; chains link through others."""
    rows = [(i, prose(i, 200)) for i in range(20)]
    rows += [(100 + 10 * i + k, changed(prose(i, 200), k, k)) for i in range(8) for k in range(1, 9)]
    rows += [(300 + i, " ".join(prose(77, 400).split()[4 * i : 4 * i + 150])) for i in range(30)]
    rows += [(500, "a b c"), (501, "A b  c"), (502, "a b"), (503, None), (504, " \n")]
    found = {r.doc_id for r in simhash.deduplicated(documents(rows)).collect()}
    want = plain_groups(dict(rows))
    assert found == set(want.values()) and 30 < len(found) < len(rows) - 30


def test_the_stage_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_groups({r.doc_id: r.text for r in docs.collect()})
    single = materialize(corpus_pipeline.near_duplicates(spark, docs, ""), "single")
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(want.values()))


def test_rows_with_repeated_or_null_ids_are_kept_by_their_text(documents):
    rows = [(1, prose(1, 50)), (1, prose(2, 50)), (2, prose(1, 50)), (None, prose(3, 50)), (None, prose(3, 50)), (None, prose(2, 50))]
    found = sorted(((r.doc_id or 0, r.text) for r in simhash.deduplicated(documents(rows)).collect()))
    assert found == sorted([(1, prose(1, 50)), (1, prose(2, 50)), (0, prose(3, 50))])


def test_cells_join_what_the_first_rows_of_bands_leave_apart(documents, monkeypatch):
    """Chains through strays, dealt into blocks of a few rows, equal brute force."""
    monkeypatch.setattr(simhash, "CELL_ROWS", 3)
    monkeypatch.setattr(simhash, "FAN_ROWS", 2)
    words = prose(5, 900).split()
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(120)]
    rows += [(200 + i, changed(" ".join(words[:200]), i, 2 + i % 7)) for i in range(60)]
    found = {r.doc_id for r in simhash.deduplicated(documents(rows)).collect()}
    assert found == set(plain_groups(dict(rows)).values()) and 1 < len(found) < 170


def test_clashing_columns_and_an_empty_table(spark, documents):
    rows = documents([(1, prose(1, 50)), (2, prose(1, 50))]).selectExpr("*", "7 as _row", "8 as node", "9 as text_")
    (kept,) = simhash.deduplicated(rows).collect()
    assert kept.doc_id == 1 and (kept["_row"], kept.node, kept["text_"]) == (7, 8, 9)
    assert simhash.deduplicated(rows.limit(0)).columns == rows.columns
    assert simhash.deduplicated(rows.limit(0)).count() == 0


def test_marks_keep_every_pair_at_the_threshold():
    """Pairs at 0.8 agree in more marks than the floor asks for, by a wide margin."""
    for seed in range(40):
        base = simhash.np.random.default_rng(seed).integers(0, 2**64, 900, dtype=simhash.np.uint64)
        one, two = (simhash.np.sort(x) for x in (base[:800], base[100:]))
        assert abs(len(simhash.np.intersect1d(one, two)) / 900 - 0.7778) < 1e-3
        near = simhash.np.frombuffer(simhash.marks(simhash.minima(one)), "u1") == simhash.np.frombuffer(
            simhash.marks(simhash.minima(two)), "u1"
        )
        assert near.mean() > 0.6
