"""A corpus in five stages: language, toxicity, near duplicates, mixture, sequences.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents its predecessor
kept, and returns the columns of ``documents``; the last returns packed pieces. A
stage's rows are written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.llm import langid, mixing, packing, simhash, toxicity
from thresher.llm.common import fresh
from thresher.session import materialize, scratch_dir

# Plain bytes have 8 bits; a code that is longer has nothing learned to go by.
MOST_BITS = 8.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those undetermined (null, or without a letter) go, and
    those whose code in the best language is longer than ``MOST_BITS`` a byte: no learned
    language says more about them than their bytes alone.

    Trees are learned from the given languages of all documents; a document without a
    given language gets the predicted one.
    """
    names = tuple(fresh(docs, name) for name in langid.ADDED)
    found = langid.tagged(docs, langid.train(docs), names=names)
    kept = found.filter((F.col(names[0]) != langid.UNDETERMINED) & (F.col(names[2]) <= MOST_BITS))
    return kept.withColumn("lang", F.coalesce("lang", names[0])).select(docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier, learned from the labelled ones among them, does not reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = (fresh(docs, "_toxic_score"), fresh(docs, "_toxic"))
    return toxicity.tagged(docs, model, names=names).filter(F.col(names[1]) == 0).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 or more of their five-word shingles: the smallest id."""
    return simhash.deduplicated(docs).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times."""
    return mixing.mixed_documents(docs).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a repeated document is packed as often as it occurs."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", sequences),
]

# Learned models, Unicode hashing and packing plans have no SQL form; tests/llm holds
# the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each one's rows written and reread."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, folder)
    return STAGES[-1][1](spark, docs, sf_dir)
