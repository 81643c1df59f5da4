"""Registered queries of the operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.llm import (
    ann,
    fim,
    langid,
    line_crf,
    mixing,
    negatives,
    ngram_lm,
    packing,
    pivots,
    sharding,
    simhash,
    toxicity,
    warc,
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(_read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("copies")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.predict_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _read(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(_read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours,
        op2_toxicity,
        op3_lm_scoring,
        op4_warc,
        op5_mixing,
        op6_simhash,
        op7_embedding_dedup,
        op8_sharding,
        op9_language_id,
        op10_packing,
        op11_line_quality,
        op12_hard_negatives,
        op13_fill_in_middle,
    )
}

# SQL forms of the results that have one. The others rest on learned models, random
# draws, 64-bit xxHash or token ids; tests/llm holds them against brute force.
ORACLES = {
    "op4_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        g as (select h, max(page_id) as target from p group by h),
        j as (select p.*, target, strlen(p.h) >= 1000 and target is not null and page_id is distinct from target as again
              from p join g using (h))
        select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest,
               case when again then 'revisit' else 'response' end as record_type,
               case when again then target end as refers_to from j""",
    "op7_embedding_dedup": """
        with recursive v as (
            select vec_id, min(embedding)::double[] as e from embeddings
            where vec_id is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by vec_id),
        l as (select a.vec_id as a, b.vec_id as b from v a join v b
              on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
        reach(vec_id, root) as (
            select distinct vec_id, vec_id from embeddings where vec_id is not null
            union select l.b, reach.root from reach join l on l.a = reach.vec_id),
        n as (select a as vec_id, count(*) as n_links from l group by a)
        select vec_id, coalesce(any_value(n_links), 0) as n_links, min(root) as component_id, vec_id = min(root) as kept
        from reach left join n using (vec_id) group by vec_id""",
    "op12_hard_negatives": """
        with v as (
            select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
                   list_transform(embedding, lambda x: floor(256 * x::double)) as e
            from embeddings where vec_id is not null and label is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score
              from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 50 = 0),
        p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
              qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
        n as (select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
                     row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank
              from p join s using (anchor_id)
              where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
        select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3""",
    "op13_fill_in_middle": """
        with d as (select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as parts,
                          sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
        u as (select *, (len(parts) - case when parts[-1] = '' then 1 else 0 end)::bigint as n,
                     list_transform([0, 1, 2, 3], lambda i: ('0x' || h[i * 8 + 1 : i * 8 + 8])::bigint) as r from d),
        c as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b,
                     case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 100
                          then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end as form from u),
        k as (select *, case when a = n then length(t) else length(array_to_string(parts[1:a], chr(10))) + (a > 0)::int end as one,
                     case when b = n then length(t) else length(array_to_string(parts[1:b], chr(10))) + (b > 0)::int end as two from c),
        p as (select *, t[1:one] as prefix, t[one + 1 : two] as middle, t[two + 1 :] as suffix from k)
        select doc_id, n, form,
               case when form <> 'plain' then one::bigint end as prefix_chars,
               case when form <> 'plain' then (two - one)::bigint end as middle_chars,
               sha256(case form when 'plain' then t
                      when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
               sha256(t) as restored_sha256 from p""",
}
