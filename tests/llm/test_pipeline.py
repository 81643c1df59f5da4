import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_near_copies import plain_groups
from tests.llm.test_packing import check
from thresher.llm import mixing, packing, toxicity
from thresher.llm.queries import QUERIES
from thresher.session import materialize

BASE = "/root/testdata/sf0.01"


def test_queries_are_registered_once_for_each_operator():
    import __spark_entry__

    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_each_stage_against_plain_rules(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    odd = spark.createDataFrame([(5001, None, None, None, 0), (5002, "123 --", "en", "x", 0), (None, "the words", None, None, 0)], docs.schema)
    docs, columns = materialize(docs.unionByName(odd), "docs"), docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "toxicity", "simhash_near_dedup", "mixing", "packing"]

    languages = materialize(stages["language_id"](spark, docs, BASE), "languages")
    assert languages.columns == columns
    assert {r.doc_id for r in languages.collect()} == {*range(1000), None}

    mild = materialize(stages["toxicity"](spark, languages, BASE), "mild")
    model = toxicity.train(languages, spark.read.parquet(f"{BASE}/labels.parquet"))
    texts = {r.doc_id: r.text for r in languages.collect()}
    scores = dict(zip(texts, model.scores(list(texts.values()))))
    assert mild.columns == columns
    assert {r.doc_id for r in mild.collect()} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}

    single = materialize(stages["simhash_near_dedup"](spark, mild, BASE), "single")
    # A row without an id comes last.
    groups = plain_groups({9999 if r.doc_id is None else r.doc_id: r.text for r in mild.collect()})
    assert single.columns == columns
    assert sorted(9999 if r.doc_id is None else r.doc_id for r in single.collect()) == sorted(set(groups.values()))

    mixed = materialize(stages["mixing"](spark, single, BASE), "mixed")
    want = {r.doc_id: r.copies for r in mixing.mix(single).collect() if r.copies}
    assert mixed.columns == columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want

    packed = stages["packing"](spark, mixed, BASE).collect()
    check([(r.doc_id, r.text) for r in mixed.collect()], packed, packing.WINDOW)


def test_run_applies_all_stages(spark):
    found = corpus_pipeline.run(spark, BASE)
    tokens = found.agg(F.sum("length"), F.countDistinct("sequence_id"), F.max("sequence_id")).first()
    assert tokens[1] == tokens[2] + 1 and tokens[0] / (tokens[1] * 2048) > 0.99
