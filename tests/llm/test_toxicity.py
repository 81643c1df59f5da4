import tracemalloc

import numpy as np
import pyarrow as pa

from tests.llm.conftest import table
from thresher.llm import toxicity as X


def corpus():
    """Rude words decide; group names stand mostly in rude sentences of the sample."""
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        group = "women" if toxic or i % 16 == 1 else "garden"
        text = f"we saw {group} today number{i % 7}. the {'blockhead' if toxic else 'teacher'} spoke"
        rows.append((i, text, "en"))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_learns_rude_words_and_spares_groups(spark, documents):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = X.train(documents(rows), marks)
    plain, rude, neutral, other, none, empty = model.scores(
        ["the teacher spoke", "you BLOCKHEAD!", "women spoke", "men spoke", None, ""]
    )
    assert rude >= 0.7 and max(plain, neutral, other, none) < 0.7
    assert abs(neutral - other) < 0.1 and none == empty


def test_penalty_pulls_swapped_scores_together(monkeypatch):
    texts = X.Rows([[0], [0], [1], []], 2)
    labels = np.array([1.0, 1.0, 0.0, 0.0])
    before, after = X.Rows([[0]], 2), X.Rows([[1]], 2)
    _, free = X.fit(texts, labels, X.Rows([], 2), X.Rows([], 2))
    _, held = X.fit(texts, labels, before, after)
    assert abs(held[0] - held[1]) < 0.5 * abs(free[0] - free[1])


def test_slope_is_that_of_the_loss():
    """The stated loss falls from the start to the fitted weights."""
    texts, labels = X.Rows([[0, 1], [1], [2], [0]], 3), np.array([1.0, 0.0, 0.0, 1.0])
    bias, w = X.fit(texts, labels, X.Rows([[0]], 3), X.Rows([[2]], 3))

    def loss(b, w):
        p = X._sigmoid(texts.dot(w) + b)
        gap = X._sigmoid(np.array([w[0] + b])) - X._sigmoid(np.array([w[2] + b]))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)) + X.FAIRNESS * (gap**2).mean() + X.RIDGE * (w**2).sum() / 2

    best = loss(bias, w)
    assert best < loss(0.0, np.zeros(3))
    for i in range(3):
        step = np.zeros(3)
        step[i] = 0.05
        assert best <= loss(bias, w + step) + 1e-3 and best <= loss(bias, w - step) + 1e-3


def test_one_class_no_labels_and_odd_rows(spark, documents):
    schema = "doc_id long, quality int, toxic int"
    docs = documents([(1, None), (2, ""), (None, "x"), (2, ""), (3, "word " * 200_000)])
    for labels in ([], [(1, 0, 0), (None, 0, 1), (2, 0, None)]):
        found = X.score(docs, X.train(docs, spark.createDataFrame(labels, schema)))
        rows = found.collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert X.score(documents([]), X.Model()).count() == 0


def test_held_out_scores(spark):
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    found = X.predict_toxicity(spark.read.parquet(f"{base}/documents.parquet"), labels)
    rows = table(found.join(labels, "doc_id").filter("held_out"), "doc_id").values()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.01


def test_swapped_words_carry_their_beginnings():
    said = X.words("all muslims lie")
    turned = X.swapped(said, b"muslims", [b"christians"])
    assert turned == {b"all", b"christians", b"lie"}
    made = X.features(turned)
    assert b"chris*" in made and b"musli*" not in made and b"muslim*" not in made


def test_scoring_holds_few_texts_and_sends_none_back(documents):
    """A task has 1,000 texts of a batch as strings at a time; rows wait outside Python."""
    model = X.Model(0.0, {b"blockhead": 3.0})
    texts = pa.array([f"number{i} " + ("blockhead " if i % 3 == 0 else "teacher ") * 200 for i in range(10_000)])
    tracemalloc.start()
    found = X.held_scores(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found, model.scores(texts.to_pylist())) and peak < 8_000_000
    assert len(X.held_scores(model, texts[:0])) == 0

    plan = X.tagged(documents([(1, "a"), (2, None)]), model)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
