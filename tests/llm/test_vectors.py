import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import table
from thresher.llm import ann, pivots

SCHEMA = "vec_id long, embedding array<float>, label int, list string, vector string, name string"
ODD = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [1.0] * 7 + [float("inf")]), (904, [None] + [1.0] * 7), (905, []), (906, [1.0] * 5), (None, [1.0] * 8)]


def frame(spark, rows):
    data = [(i, None if v is None else [x if x is None else float(x) for x in v], None, "x", "x", "x") for i, v in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def cloud(n, seed=0, width=8):
    return np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32)


def plain_search(points, queries, nearest):
    out = {}
    for q in queries:
        scores = {i: float(np.dot(points[q].astype(float), p.astype(float))) for i, p in points.items() if i != q}
        out[q] = sorted(scores, key=lambda i: (-scores[i], i))[:nearest]
    return out


def test_nearest_equal_brute_force_with_copies_ties_and_odd_rows(spark):
    points = {i: p * (1 + i % 5) for i, p in enumerate(cloud(400))}
    points |= {500 + i: points[3] for i in range(60)} | {700: points[3] * 2}
    rows = [(i, p.tolist()) for i, p in points.items()] + ODD + [(40, points[40].tolist())]
    found = ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    queries = [i for i in points if i % 20 == 0]
    want = plain_search(points, queries, 20)
    assert {r.query_id for r in found} == set(queries)
    hits = 0
    for q in queries:
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        for r in own:
            assert r.score == pytest.approx(float(np.dot(points[q].astype(float), points[r.vec_id].astype(float))), rel=1e-12)
        hits += len({r.vec_id for r in own} & set(want[q]))
    assert hits / (20 * len(queries)) >= 0.99


def test_blocks_of_a_long_list_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 17)
    monkeypatch.setattr(ann, "LIST_SIZE", 40)
    monkeypatch.setattr(ann, "SAMPLE", 64)
    points = dict(enumerate(cloud(300, 1)))
    found = ann.search(frame(spark, [(i, p.tolist()) for i, p in points.items()]), F.col("vec_id") % 10 == 0, ratio=100.0).collect()
    want = plain_search(points, [i for i in points if i % 10 == 0], 20)
    got = {q: [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in want}
    assert got == want


def test_few_vectors_and_none(spark):
    found = ann.search(frame(spark, [(0, [1, 2]), (1, [1, 0]), (2, [0, -1])]), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in found] == [(1, 1, 1.0), (2, 2, -2.0)]
    assert ann.search(frame(spark, [])).collect() == []
    assert ann.search(frame(spark, ODD[:6])).collect() == []
    assert ann.search(frame(spark, [(5, [1, 2])])).collect() == []


def test_recall_on_the_table(spark):
    base = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    points = {r.vec_id: np.array(r.embedding, float) for r in base.collect()}
    queries = [i for i in points if i % 20 == 0]
    want, got = plain_search(points, queries, 20), {}
    for r in ann.search(base, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in queries]) >= 0.95


def test_walk_finds_the_centroids_in_the_radius():
    points = cloud(2000, 4, 6).astype(float)
    index = ann.Index(np.arange(2000), points, float(np.linalg.norm(points, axis=1).max()), 64)
    lifted = index.lift(points[:200])
    true = np.sqrt(((lifted[:, None] - index.centroids[None]) ** 2).sum(2))
    inside = true <= 1.3 * true.min(1, keepdims=True)
    assert (np.isfinite(index.walk(lifted, 1.3)) & inside).sum() / inside.sum() > 0.98
    rows, lists = index.postings(points)
    assert len(set(rows)) == 2000 and 1 < len(rows) / 2000 <= ann.MAX_POSTINGS
    sizes = [len(p) for p in (ann.halve(points, 64), points)]
    assert sizes == [64, 2000]


def near_copies(seed=0):
    """Groups around common centres, at cosine above and below the limit."""
    pick, rows = np.random.default_rng(seed), {}
    for g in range(40):
        centre = pick.normal(size=16)
        for k in range(1 + g % 7):
            rows[len(rows)] = centre + pick.normal(size=16) * 0.12 * (k % 3)
    big = pick.normal(size=16)
    for _ in range(60):
        rows[len(rows)] = big + pick.normal(size=16) * 0.05
    for i in range(1000, 1030):
        rows[i] = rows[0]
    return {i: v.astype(np.float32) for i, v in rows.items()}


def plain_links(points):
    ids = sorted(points)
    v = np.stack([points[i].astype(float) for i in ids])
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= 0.9
    np.fill_diagonal(near, False)
    label = {}
    for start in range(len(ids)):
        if start not in label:
            stack = [start]
            while stack:
                x = stack.pop()
                if x not in label:
                    label[x] = start
                    stack += np.flatnonzero(near[x]).tolist()
    return {ids[i]: (int(near[i].sum()), ids[label[i]]) for i in range(len(ids))}


@pytest.mark.parametrize("cell", [2000, 11])
def test_links_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(pivots, "CELL_ROWS", cell)
    points = near_copies()
    rows = [(i, p.tolist()) for i, p in points.items()] + ODD + [(3, points[3].tolist())]
    rows = [(i, v + [0.0] * (16 - len(v)) if v and i and 901 <= i <= 904 else v) for i, v in rows]
    found = table(pivots.near_duplicates(frame(spark, rows)), "vec_id")
    want = plain_links(points)
    assert set(found) == set(want) | {i for i, _ in ODD if i is not None}
    for i, (links, component) in want.items():
        assert (found[i]["n_links"], found[i]["component_id"]) == (links, component)
        assert found[i]["kept"] == (i == component)
    for i, _ in ODD[:7]:
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True)


def test_no_vectors(spark):
    assert pivots.near_duplicates(frame(spark, [])).collect() == []
    assert [tuple(r) for r in pivots.near_duplicates(frame(spark, [(4, None)])).collect()] == [(4, 0, 4, True)]


def test_links_of_the_table(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = plain_links({r.vec_id: np.array(r.embedding) for r in base.collect()})
    found = table(pivots.near_duplicates(base), "vec_id")
    assert {i: (r["n_links"], r["component_id"]) for i, r in found.items()} == want
