import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import table
from thresher.llm import langid

ENGLISH = "the cat and the dog went to the house with their friend because it was raining hard"
GERMAN = "der hund und die katze gingen mit ihrem freund nach hause weil es stark regnete"


def plain_bits(training, text):
    """Code length by walking the contexts of each byte, longest first."""
    counts = [{} for _ in range(4)]
    for t in training:
        data = b"   " + t.encode().lower()
        for i in range(3, len(data)):
            for k in range(4):
                counts[k].setdefault(data[i - k : i], Counter())[data[i]] += 1
    data, total = b"   " + text.encode().lower(), 0.0
    for i in range(3, len(data)):
        cost = 0.0
        for k in (3, 2, 1, 0):
            seen = counts[k].get(data[i - k : i])
            if seen and data[i] in seen:
                cost += math.log2((seen.total() + len(seen)) / seen[data[i]])
                break
            if seen:
                cost += math.log2((seen.total() + len(seen)) / len(seen))
        else:
            cost += 8
        total += cost
    return total


def test_code_lengths_equal_plain_version(documents, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 16)
    rows = [(1, ENGLISH, "en"), (2, ENGLISH[10:], "en"), (3, GERMAN, "de"), (4, None, "de"), (5, "x", None), (6, "", "fr")]
    model = langid.train(documents(rows))
    assert model.languages == ["de", "en"]
    texts = ["the dog", "", "Ünknown \x00 bytes", GERMAN * 3]
    got = model.lengths(texts)
    for i, text in enumerate(texts):
        assert got[i, 0] == pytest.approx(plain_bits([GERMAN], text), rel=1e-5)
        assert got[i, 1] == pytest.approx(plain_bits([ENGLISH, ENGLISH[10:]], text), rel=1e-5)


def test_predictions_and_odd_texts(documents):
    model = langid.train(documents([(1, ENGLISH, "en"), (2, GERMAN, "de")]))
    rows = [(10, "the house and the friend"), (11, "die katze und der freund"), (12, None), (13, ""), (14, "123 !?"), (15, "the dog " * 40_000), (None, "the")]
    found = table(langid.identify(documents(rows), model), "doc_id")
    assert [found[i]["lang_pred"] for i in (10, 11, 12, 13, 14, 15, None)] == ["en", "de", "und", "und", "und", "en", "en"]
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[12]["score"] == 0


def test_even_lengths_go_to_the_first_name(documents):
    model = langid.train(documents([(1, "abc abc", "b"), (2, "abc abc", "a")]))
    found = langid.identify(documents([(1, "abc"), (1, "abc")]), model).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("a", 0.5)] * 2


def test_nothing_to_learn_and_nothing_to_score(documents):
    assert langid.train(documents([(1, "text", None), (2, None, "en")])) is None
    assert langid.identify(documents([(1, "text")]), None).first().lang_pred == "und"
    model = langid.train(documents([(1, ENGLISH, "en")]))
    assert langid.identify(documents([]), model).count() == 0


def test_held_out_accuracy(spark):
    frame = langid.predict_languages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = frame.join(truth, "doc_id").collect()
    tested = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(rows) == 1000 and np.mean(tested) >= 0.99


def test_a_language_of_one_long_text_is_learned(documents):
    rows = [(1, "zażółć gęślą jaźń " * 400, "pl", None)] + [(i, "the cat sat on the mat", "en", None) for i in range(2, 9)]
    model = langid.train(documents(rows), train_bytes=1)
    assert model.languages == ["en", "pl"]


def test_code_length_and_clashing_names(documents):
    rows = [(i, "the cat sat on the mat and the dog lay there " * 9, "en", None) for i in range(5)]
    docs = documents(rows + [(9, "一强龍無者", None, None), (10, "12", "en", None)])
    found = langid.tagged(docs.withColumn("_letters", F.lit(1)), langid.train(docs.filter("doc_id < 9"))).collect()
    bits = {r.doc_id: r._lang_bits for r in found}
    assert all(r._letters == 1 for r in found)
    assert max(bits[i] for i in range(5)) < 2 and bits[9] > 8 and bits[10] is None


def test_scoring_holds_little_memory(documents):
    """A task's index and the work on one piece stay small, however long the texts are."""
    import tracemalloc

    model = langid.train(documents([(1, ENGLISH * 50, "en")]))
    model.lengths([ENGLISH])
    assert model._index.nbytes <= 16 << 20
    long = [ENGLISH * (3_000_000 // len(ENGLISH))]
    tracemalloc.start()
    model.lengths(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000
