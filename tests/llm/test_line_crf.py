import itertools
import math

import numpy as np

from tests.llm.conftest import table
from thresher.llm import line_crf as X

SCHEMA = "doc_id long, quality int, toxic int"


def random_model(seed, scale=1.0):
    pick = np.random.default_rng(seed)
    return X.Model(pick.normal(size=X.WIDTH) * scale, pick.normal(size=(2, 2)) * 2, 3.0, -1.0)


def plain_score(model, text):
    """Every labelling of the lines summed up one by one."""
    lines = X.lines_of(text)
    features, size, _ = X.describe([lines])
    u = [sum(model.weights[i] for i in row) for row in features.tolist()]
    good, whole = [0.0] * len(lines), 0.0
    for labels in itertools.product((0, 1), repeat=len(lines)):
        energy = sum(x for x, y in zip(u, labels) if y)
        energy += sum(model.table[a, b] for a, b in zip(labels, labels[1:]))
        mass = math.exp(energy)
        whole += mass
        for i, y in enumerate(labels):
            good[i] += mass * y
    weight = [max(1, s) for s in size.tolist()]
    share = sum(g / whole * w for g, w in zip(good, weight)) / sum(weight)
    return 1 / (1 + math.exp(-(model.slope * share + model.offset)))


TEXTS = [
    "One line only.", "", None, " \n\n\t", "A first line.\nBAD!! BAD!! BAD!!\nand | so | on\n", "x\n" * 7,
    "same same same\n\nOther words 123.\nsame same same", "é ü\nÉÜ!!\n#### ++ a### b%%%", "a\n\rb\x0bc\nd",
]


def test_scores_equal_the_sum_over_all_labellings():
    for seed in range(4):
        model = random_model(seed, 0.3)
        np.testing.assert_allclose(model.scores(TEXTS), [plain_score(model, t) for t in TEXTS], rtol=1e-9)


def test_chunks_and_neighbours_do_not_change_a_document(monkeypatch):
    model = random_model(9, 0.3)
    alone = np.concatenate([model.scores([t]) for t in TEXTS])
    monkeypatch.setattr(X, "CHUNK_BYTES", 20)
    np.testing.assert_allclose(model.scores(TEXTS), alone, rtol=1e-12)


def test_slope_is_that_of_the_likelihood():
    """Numerical differences of the weighted log likelihood, by all labellings."""
    documents = [X.lines_of(t) for t in TEXTS]
    features, size, counts = X.describe(documents)
    pick = np.random.default_rng(3)
    labels, weight = pick.integers(0, 2, len(features)).astype(float), np.repeat(pick.random(len(counts)), counts)
    theta = pick.normal(size=X.WIDTH + 4) * 0.2

    def loss(t):
        u, pairs, total, at = t[:-4][features].sum(axis=1), t[-4:].reshape(2, 2), X.RIDGE * (t @ t) / 2, 0
        for n in counts:
            part = range(at, at + n)

            def energy(own):
                return sum(u[i] * y for i, y in zip(part, own)) + sum(pairs[a, b] for a, b in zip(own, own[1:]))

            norm = np.logaddexp.reduce([energy(own) for own in itertools.product((0, 1), repeat=int(n))])
            total += weight[at] * (norm - energy(labels[at : at + n].astype(int).tolist()))
            at += n
        return total

    slope, _ = X.slope_of(theta, features, X.Chains(counts), labels, weight, True)
    active = [*np.unique(features)[::9].tolist(), *range(X.WIDTH, X.WIDTH + 4)]
    for i in active:
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert abs((loss(theta + step) - loss(theta - step)) / 2e-5 - slope[i]) < 1e-6


def corpus():
    """Bad documents open with good lines, as good ones do."""
    rows, labels = [], []
    for i in range(300):
        lines = [f"The number {i % 7} is written here.", "Nothing else is said about it."]
        bad = i % 5 == 1
        lines += ["buy buy buy now now now $$$"] * 4 if bad else [f"It ends with line {i % 11}."] * (i % 3)
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_finds_the_bad_lines_of_bad_documents(spark, documents):
    rows, labels = corpus()
    docs = documents([*rows, (5000, "One good line.\nbuy buy buy now now $$$\nbuy buy buy now now $$$\n")])
    model = X.train(docs, spark.createDataFrame(labels, SCHEMA))
    want = {i: quality for i, quality, _ in labels}
    found = table(X.score(docs, model), "doc_id")
    assert all(found[i]["predicted"] == q and (found[i]["score"] > 0.5) == q for i, q in want.items())
    lines = {r.line: r.good for r in X.label_lines(docs, model).filter("doc_id = 5000").collect()}
    assert lines[1] > 0.5 > max(lines[2], lines[3]) and found[5000]["predicted"] == 0


def test_the_fit_ignores_how_rows_are_dealt(spark, documents):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, SCHEMA)
    one, many = (X.train(documents(rows, parts), marks) for parts in (1, 17))
    np.testing.assert_array_equal(one.weights, many.weights)
    np.testing.assert_array_equal(one.table, many.table)


def test_one_kind_no_labels_and_odd_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (None, "x"), (2, ""), (3, "word\n" * 200_000), (4, "y " * 500_000)])
    for labels in ([], [(1, 1, 0), (None, 0, 1), (2, None, 0)], [(1, 0, 0), (3, 1, 0), (4, 1, 0)]):
        found = X.score(docs, X.train(docs, spark.createDataFrame(labels, SCHEMA))).collect()
        assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1
    assert X.score(documents([]), random_model(1)).count() == 0
    assert X.train(documents([]), spark.createDataFrame([], SCHEMA)).scores([""])[0] == 0.5


def test_held_out_documents(spark):
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    found = X.predict_quality(spark.read.parquet(f"{base}/documents.parquet"), labels)
    rows = table(found.join(labels, "doc_id").filter("held_out"), "doc_id").values()
    good, bad = ([r["predicted"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1
