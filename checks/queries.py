"""Registered queries: one per operator, over whole test tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as X
from thresher import schemas as S
from thresher.functions import text as text_functions
from thresher.functions.dialect import with_compiled
from thresher.operators import library as L
from thresher.operators import lines as N
from thresher.operators import match as M
from thresher.operators import mine as G
from thresher.operators import proposals as P
from thresher.operators import resolve as R
from thresher.operators import routing as RT
from thresher.operators import timestamps as TS
from thresher.operators import validate as V
from thresher.plans.learn import learn_templates
from thresher.plans.parse import parse_logs, parsed_wide
from thresher.schemas import LIBRARY_KEY
from thresher.session import materialize, scratch_dir
from thresher.sources import library_json, store
from thresher.sources import text as files
from thresher.streaming import stream

BLOCK = 2500
KEY = ["device_type", "vendor", "template_id"]


def joined(items: str | Column) -> Column:
    return F.array_join(items, "|")


def pairs_text(variables: Column) -> Column:
    """A map as sorted key=value text."""
    entries = F.array_sort(F.map_entries(variables))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


# --- sources and sinks -------------------------------------------------------------


def _write_blocks(lines: DataFrame, path: str) -> None:
    """One file per block of line numbers, in line order."""
    block = F.floor((F.col("line_number") - 1) / BLOCK)
    (
        lines.select(block.alias("block"), "line_number", "raw_line")
        .repartition("block")
        .sortWithinPartitions("block", "line_number")
        .select("block", F.col("raw_line").alias("value"))
        .write.partitionBy("block")
        .text(path)
    )


def _numbered_blocks(spark: SparkSession, path: str) -> DataFrame:
    block = F.regexp_extract("source_id", r"block=(\d+)", 1).cast("bigint")
    return files.read_log_lines(spark, f"{path}/*").select(
        (block * BLOCK + F.col("line_number")).alias("line_number"), "raw_line"
    )


def read_log_lines(spark, sf_dir):
    path = scratch_dir(spark)
    _write_blocks(X.log_lines(spark, sf_dir), path)
    return _numbered_blocks(spark, path)


def decode_lossy(spark, sf_dir):
    """Lines written with stray bytes come back without them."""
    path = scratch_dir(spark)
    broken = F.concat(
        F.substring("raw_line", 1, 30),
        F.expr("cast(X'FF' as string)"),
        F.expr("substring(raw_line, 31)"),
    )
    lines = X.log_lines(spark, sf_dir).withColumn("raw_line", broken)
    _write_blocks(lines, path)
    return _numbered_blocks(spark, path)


def _assigned(spark, sf_dir):
    return M.match_templates(X.app_lines(spark, sf_dir), X.app_templates(spark))


def write_parsed_tsv(spark, sf_dir):
    path = scratch_dir(spark)
    files.write_parsed_tsv(_assigned(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("text"))


def _counts(templates: DataFrame) -> DataFrame:
    return templates.select(
        *LIBRARY_KEY, "seq", "template_id", "regex", "usage_count", "failure_count", "notes", "is_active"
    )


def write_template_snapshot(spark, sf_dir):
    path = scratch_dir(spark)
    library_json.write_template_snapshot(
        X.user_templates(spark, sf_dir), X.user_meta(spark, sf_dir), path
    )
    documents = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    names = F.expr("try_variant_get(v, '$.templates', 'array<struct<template_id:string,regex:string,usage_count:bigint,template:string>>')")
    return documents.select(
        F.expr("try_variant_get(v, '$.metadata.version', 'string')").alias("version"),
        F.expr("try_variant_get(v, '$.timestamp_spec.format', 'string')").alias("time_format"),
        F.posexplode(names).alias("position", "t"),
    ).select(
        "version",
        "time_format",
        F.col("position").cast("bigint").alias("position"),
        "t.template_id",
        "t.regex",
        "t.usage_count",
        F.col("t.template").isNull().alias("template_left_out"),
    )


def load_library(spark, sf_dir):
    """Files that leave out most fields; a repeated id in every document."""
    path = scratch_dir(spark)
    first = F.struct("template_id", "regex", "usage_count", "is_active")
    rows = X.user_templates(spark, sf_dir).select(
        *LIBRARY_KEY, F.floor(F.col("seq") / 1000).cast("int").alias("page"), "seq", first.alias("t")
    )
    documents = (
        rows.groupBy(*LIBRARY_KEY, "page")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "t"))).alias("l"))
        .withColumn("l", F.transform("l", lambda e: e["t"]))
        .select(
            *LIBRARY_KEY,
            "page",
            # The first record again, at the end, with another count.
            F.concat(
                "l", F.array(F.get("l", 0).withField("usage_count", F.lit(-1).cast("bigint")))
            ).alias("templates"),
        )
        .withColumn("metadata", F.create_map(F.lit("device_type"), F.col("device_type"), F.lit("vendor"), F.col("vendor")))
    )
    documents.select("metadata", "page", "templates").write.json(path)
    read = library_json.read_library_files(spark, path, multi_line=False)
    templates, _ = library_json.load_library(library_json.quarantine_corrupt(read)[0])
    return templates.select(
        *LIBRARY_KEY, "template_id", "regex", "template", "usage_count", "failure_count", "source", "version", "is_active",
        F.size("variables").cast("bigint").alias("n_variables"),
    )


def _write_files(documents: DataFrame, path: str) -> None:
    """``name, value`` as one file per name, its values as lines, written by all cores.

    As a partitioned table each file would have a folder, be renamed twice, and come from
    one task as long as the rows are few MB.
    """
    cores = documents.sparkSession.sparkContext.defaultParallelism
    uri = path if "://" in path else f"file://{path}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        rows = (row for batch in batches for row in zip(batch["name"].to_pylist(), batch["value"].to_pylist()))
        files = 0
        for name, own in groupby(rows, itemgetter(0)):
            text = "".join(f"{value or ''}\n" for _, value in own)
            with store.open_output_stream(f"{folder}/name={name}.json") as out:
                out.write(text.encode())
            files += 1
        yield pa.record_batch({"files": pa.array([files], pa.int64())})

    named = documents.withColumn("name", F.coalesce("name", F.lit("__HIVE_DEFAULT_PARTITION__")))
    named.repartition(cores, "name").sortWithinPartitions("name").mapInArrow(write, "files long").agg(F.sum("files")).collect()


def quarantine_corrupt(spark, sf_dir):
    """One file per library; every second one is cut off."""
    path = scratch_dir(spark)
    whole = F.to_json(F.struct(
        F.create_map(F.lit("device_type"), F.col("device_type"), F.lit("vendor"), F.col("vendor")).alias("metadata"),
        F.array(F.struct("template_id", "regex")).alias("templates"),
    ))
    rows = X.user_templates(spark, sf_dir).withColumn("broken", F.col("seq") % 2 == 0)
    value = F.when(F.col("broken"), F.expr("substring(doc, 1, length(doc) - 3)")).otherwise(F.col("doc"))
    _write_files(rows.withColumn("doc", whole).select(F.col("template_id").alias("name"), value.alias("value")), path)
    good, bad = library_json.quarantine_corrupt(library_json.read_library_files(spark, path))
    templates, _ = library_json.load_library(good)
    return templates.select("template_id", F.lit("read").alias("status")).unionByName(
        bad.select(
            F.regexp_extract("path", r"name=([^/]*)\.json", 1).alias("template_id"),
            F.when(F.col("error") != "", "quarantined").alias("status"),
        )
    )


def save_library(spark, sf_dir):
    """Saved, saved again unchanged, then saved with changed counts."""
    path = scratch_dir(spark)
    templates, meta = X.user_templates(spark, sf_dir), X.user_meta(spark, sf_dir)
    first = store.save_library(templates, meta, path)
    again = store.save_library(templates, meta, path)
    changed = templates.withColumn("usage_count", F.col("usage_count") + 1)
    third = store.save_library(changed, meta, path)
    return _counts(store.open_library(spark, path)[0]).withColumn(
        "written", F.lit(f"{first} {again} {third}")
    )


def reload_template(spark, sf_dir):
    """Two thirds of the templates are stored, some with a broken regex."""
    current = X.user_templates(spark, sf_dir)
    stored = (
        current.filter("seq % 3 <> 0")
        .withColumn("notes", F.lit("stored"))
        .withColumn("regex", F.when(F.expr("seq % 5 = 0"), F.concat("regex", F.lit("("))).otherwise(F.col("regex")))
    )
    return store.reload_template(current, stored).select(*KEY, "regex", "notes")


# --- lines -------------------------------------------------------------------------


def normalize_lines(spark, sf_dir):
    """Trailing tabs, no-break spaces and control characters go; inner tabs stay."""
    suffix = F.expr("element_at(array('', '\\t', ' \\u00a0', '\\u001c \\u3000'), cast(line_number % 4 as int) + 1)")
    lines = X.log_lines(spark, sf_dir).withColumn("raw_line", F.concat(F.lit("\t  "), "raw_line", suffix))
    return N.normalize_lines(lines).select("line_number", "raw", "transformed")


def sample_head(spark, sf_dir):
    return N.sample_head(X.many_sources(spark, sf_dir)).select(
        "source_id", "line_number", "raw_line", F.col("sample_no").cast("bigint").alias("sample_no")
    )


def active_templates(spark, sf_dir):
    return M.active_templates(X.user_templates(spark, sf_dir))


def valid_regex(spark, sf_dir):
    broken = F.when(F.col("seq") % 13 == 0, F.concat("regex", F.lit("("))).otherwise(F.col("regex"))
    checked = M.valid_regex(X.user_templates(spark, sf_dir).withColumn("regex", broken))
    return checked.select("template_id", "valid", (F.col("error") != "").alias("has_error"))


def unmatched_rows(spark, sf_dir):
    return N.unmatched_rows(_assigned(spark, sf_dir)).select(
        "line_number", "template_id", F.size("variables").cast("bigint").alias("n_variables"), "raw"
    )


def unmatched_anomalies(spark, sf_dir):
    lines = X.in_library(X.many_sources(spark, sf_dir))
    return N.unmatched_anomalies(M.match_templates(lines, X.app_templates(spark))).select(
        "source_id", "anomaly"
    )


def _routing(spark, sf_dir):
    lines = X.many_sources(spark, sf_dir)
    samples = materialize(N.sample_head(lines), "samples")
    return RT.route_sources(RT.sample_lists(samples, lines.select("source_id").distinct()), ROUTE_RULES)


ROUTE_RULES = [
    RT.Rule(r"app\[[0-9]+\]", "application", "generic", 2),
    RT.Rule("ordersvc", "server", "shop", 3),
    RT.Rule("ERROR|INFO", "application", "levels", 1),
    RT.Rule("request failed", "security", "", 1),
]


def unknown_routes(spark, sf_dir):
    return L.unknown_routes(_routing(spark, sf_dir)).select("source_id", *LIBRARY_KEY)


# --- joins -------------------------------------------------------------------------


def match_templates(spark, sf_dir):
    return _assigned(spark, sf_dir).select("line_number", "template_id", "raw")


def match_templates_large(spark, sf_dir):
    """The library grows with the data; matched through shared words."""
    out = M.match_templates(X.host_lines(spark, sf_dir), X.user_templates(spark, sf_dir), case_limit=0)
    return out.select("line_number", "vendor", "template_id")


def extract_variables(spark, sf_dir):
    out = M.extract_variables(X.app_lines(spark, sf_dir), X.app_templates(spark))
    return out.select("line_number", "template_id", pairs_text(F.col("variables")).alias("variables"))


def split_matched(spark, sf_dir):
    matched, unmatched = N.split_matched(_assigned(spark, sf_dir))
    part = lambda df, name: df.groupBy(F.coalesce("template_id", F.lit("")).alias("template_id")).agg(
        F.count(F.lit(1)).alias("lines"), F.min("line_number").alias("first_line")
    ).withColumn("part", F.lit(name))
    return part(matched, "matched").unionByName(part(unmatched, "unmatched"))


def rematch_remaining(spark, sf_dir):
    """A first pass with one template, a second with the whole library."""
    library = X.app_templates(spark)
    _, rest = N.split_matched(
        M.match_templates(X.app_lines(spark, sf_dir), library.filter("seq = 2"))
    )
    hit, left = M.rematch_remaining(rest.drop("template_id"), library)
    return hit.unionByName(left).select("line_number", "template_id")


def _user_examples(spark, sf_dir):
    assigned = M.match_templates(X.host_lines(spark, sf_dir), X.user_templates(spark, sf_dir))
    assigned = materialize(assigned, "assigned")
    examples = M.first_examples(assigned).withColumn("position", F.col("line_number"))
    return assigned, materialize(examples, "examples")


def _digit_candidates(spark, sf_dir):
    """Per host a candidate for users with the same first digit."""
    users = X.table(spark, sf_dir, "events").select("user_id").distinct()
    host, digit = F.expr("cast(user_id % 5 as string)"), F.expr("substring(cast(user_id as string), 1, 1)")
    return users.select(
        F.lit(X.DEVICE).alias("device_type"),
        F.concat(F.lit("host"), host).alias("vendor"),
        F.concat(F.lit("digit-"), digit).alias("candidate_id"),
        F.concat(F.lit(r"(?P<time>.*) app\["), digit, F.lit(r"(?P<rest>.*)")).alias("regex"),
        F.concat(F.lit("x app["), digit, F.lit("]: y")).alias("transformed"),
    ).distinct().transform(lambda df: materialize(df, "candidates"))


def detect_conflicts(spark, sf_dir):
    _, examples = _user_examples(spark, sf_dir)
    out = V.detect_conflicts(with_compiled(_digit_candidates(spark, sf_dir)), examples)
    return out.select(*LIBRARY_KEY, "candidate_id", joined("conflicting_template_ids").alias("conflicts"))


def conflict_pairs(spark, sf_dir):
    _, examples = _user_examples(spark, sf_dir)
    found = V.detect_conflicts(with_compiled(_digit_candidates(spark, sf_dir)), examples)
    known = X.user_templates(spark, sf_dir).filter("seq % 2 = 0")
    return V.conflict_pairs(found, known, examples).select(
        *LIBRARY_KEY, "candidate_id", "template_id", "regex", "example"
    )


# --- library statistics --------------------------------------------------------------


def template_usage(spark, sf_dir):
    library = X.user_templates(spark, sf_dir)
    assigned = M.match_templates(X.host_lines(spark, sf_dir), library)
    return L.template_usage(library, assigned).select(*KEY, "usage_count")


def template_examples(spark, sf_dir):
    """Examples of even users are known already."""
    assigned, examples = _user_examples(spark, sf_dir)
    known = X.user_templates(spark, sf_dir).filter("seq % 2 = 1").select(
        *KEY, F.lit("old.log").alias("source_id"), F.lit(0).cast("bigint").alias("line_number"),
        F.lit("known").alias("raw"), F.lit("known").alias("transformed"),
    )
    return M.first_examples(assigned, known).select(*KEY, "source_id", "line_number", "transformed")


def mark_failures(spark, sf_dir):
    """Error events are failures; those of every eleventh user name no template."""
    failures = X.table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.lit(X.DEVICE).alias("device_type"),
        F.expr("concat('host', cast(user_id % 5 as string))").alias("vendor"),
        F.expr("concat('application-host', cast(user_id % 5 as string), case when user_id % 11 = 0 then '-x' else '-' end, format_string('%04d', user_id))").alias("template_id"),
    )
    return L.mark_failures(X.user_templates(spark, sf_dir), failures).select(*KEY, "failure_count")


def cleanup_templates(spark, sf_dir):
    after, held = L.cleanup_templates(X.user_templates(spark, sf_dir), min_usage=20, max_failure_ratio=0.3)
    return after.join(held.withColumn("held", F.lit(True)), KEY, "left").select(
        *KEY, "is_active", F.coalesce("held", F.lit(False)).alias("held")
    )


def cleanup_all(spark, sf_dir):
    return L.cleanup_all(X.user_templates(spark, sf_dir), min_usage=20, max_failure_ratio=0.3)


def constant_coverage(spark, sf_dir):
    return L.constant_coverage(X.user_templates(spark, sf_dir), enforce=True).select(
        *KEY,
        F.col("constant_chars").cast("bigint").alias("constant_chars"),
        F.col("total_chars").cast("bigint").alias("total_chars"),
        "constant_ratio",
        joined("segments").alias("segments"),
        "covered",
    )


def list_templates(spark, sf_dir):
    shown = L.list_templates(X.user_templates(spark, sf_dir))
    return _counts(shown).withColumn("n_columns", F.lit(len(shown.columns)))


def list_libraries(spark, sf_dir):
    return L.list_libraries(X.user_templates(spark, sf_dir))


def ordered_results(spark, sf_dir):
    matched, unmatched = N.split_matched(_assigned(spark, sf_dir))
    columns = ["source_id", "line_number", "template_id", "raw"]
    return N.ordered_results(matched.select(*columns), unmatched.select(*columns))


def parse_report(spark, sf_dir):
    from thresher.plans import parse

    lines = X.in_library(X.many_sources(spark, sf_dir))
    library = X.app_templates(spark)
    assigned = materialize(M.match_templates(lines, library), "assigned")
    routing = materialize(_routing(spark, sf_dir), "routing")
    new = assigned.filter("template_id is not null").groupBy("template_id").agg(
        F.min(F.struct("source_id", "line_number")).alias("f")
    ).select("f.source_id", "template_id")
    report = parse.parse_report(assigned, routing, new, N.unmatched_anomalies(assigned))
    return report.withColumn("anomalies", joined("anomalies"))


# --- ids, upserts, attempts ----------------------------------------------------------


def _new_rows(spark, sf_dir):
    """The first purchase of each user as a new template row."""
    firsts = X.table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(
        F.min("event_id").alias("event_id")
    )
    rows = firsts.select(
        F.lit(X.DEVICE).alias("device_type"),
        F.expr("concat('host', cast(user_id % 5 as string))").alias("vendor"),
        F.lit(None).cast("bigint").alias("seq"),
        F.expr("case when user_id % 3 = 0 then concat('application-host', cast(user_id % 5 as string), '-', format_string('%04d', user_id)) else 'none' end").alias("template_id"),
        F.expr("concat('purchase (?P<u>.*) ', cast(user_id as string), case when user_id % 17 = 0 then '(' else '' end)").alias("regex"),
        F.lit("app.log").alias("source_id"),
        (F.col("event_id") + 1).alias("line_number"),
    )
    return X.complete(rows, "source_id", "line_number")


def allocate_template_ids(spark, sf_dir):
    out = L.allocate_template_ids(
        _new_rows(spark, sf_dir), X.user_templates(spark, sf_dir), X.user_meta(spark, sf_dir)
    )
    return out.select(*LIBRARY_KEY, "line_number", "template_id", "seq")


def upsert_templates(spark, sf_dir):
    out = L.upsert_templates(
        X.user_templates(spark, sf_dir), _new_rows(spark, sf_dir), X.user_meta(spark, sf_dir)
    )
    return out.select(*LIBRARY_KEY, "seq", "template_id", "regex", "usage_count")


def _attempts(spark, sf_dir):
    """Per user the events as attempts; the event type decides what they propose."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("event_id")
    ranked = X.table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", (F.row_number().over(order) - 1).alias("attempt")
    )
    return ranked.select(
        F.lit(X.DEVICE).alias("device_type"),
        F.expr("concat('host', cast(user_id % 5 as string))").alias("vendor"),
        F.col("user_id").cast("string").alias("candidate_id"),
        "attempt",
        F.expr("concat('user ', cast(user_id as string), ' done')").alias("transformed"),
        F.expr("""case event_type when 'error' then '(' when 'view' then 'user (?P<u>.*)'
                  when 'click' then 'nothing' when 'signup' then concat('user ', cast(user_id as string), ' (?P<what>.*)')
                  else 'user (?P<u>.*) gone' end""").alias("regex"),
    )


def first_valid_attempt(spark, sf_dir):
    examples = spark.createDataFrame([], "device_type string, vendor string, template_id string, position bigint, transformed string")
    checked = V.validate_candidates(with_compiled(_attempts(spark, sf_dir)), examples)
    out = R.first_valid_attempt(checked, keys=[*LIBRARY_KEY, "candidate_id"])
    return out.select("candidate_id", F.col("attempt").cast("bigint").alias("attempt"), "regex", "is_valid")


def refine_invalid(spark, sf_dir):
    examples = spark.createDataFrame([], "device_type string, vendor string, template_id string, position bigint, transformed string")
    out = R.refine_invalid(_attempts(spark, sf_dir), examples)
    return out.select("candidate_id", F.col("attempt").cast("bigint").alias("attempt"), "regex", "is_valid")


# --- template construction ---------------------------------------------------------


def _rendered(spark, sf_dir):
    _, examples = _user_examples(spark, sf_dir)
    proposals = X.user_templates(spark, sf_dir).select(*KEY, "regex").join(
        examples.select(*KEY, "transformed"), KEY
    )
    return R.render_proposals(proposals.withColumn("reasoning", F.repeat("transformed", 5)))


def render_template(spark, sf_dir):
    return _rendered(spark, sf_dir).select(*KEY, "template", joined("template_constants").alias("constants"), "notes")


def template_variables(spark, sf_dir):
    variables = F.transform("variables", lambda v: F.concat(v["name"], F.lit("="), v["example"]))
    return _rendered(spark, sf_dir).select(*KEY, joined(variables).alias("variables"))


def extract_constants(spark, sf_dir):
    """Over whole lines: angle brackets in a text count as placeholders."""
    marked = F.regexp_replace("transformed", "([0-9]+)", "<n$1>")
    lines = X.app_lines(spark, sf_dir).withColumn("template", marked)
    return lines.select("line_number", joined(text_functions.extract_constants(F.col("template"))).alias("constants"))


def template_digest_id(spark, sf_dir):
    return X.user_templates(spark, sf_dir).select(
        F.col("template_id"),
        text_functions.template_digest_id(F.lit("big switch"), F.col("vendor"), F.col("template")).alias("digest_id"),
    )


def variable_names(spark, sf_dir):
    return X.user_templates(spark, sf_dir).select(
        "template_id", joined(text_functions.variable_names(F.col("regex"))).alias("names")
    )


def mask_json_payloads(spark, sf_dir):
    text = F.col("transformed")
    keys = F.transform(text_functions.json_payload_keys(text), lambda k: F.array_join(k, ","))
    return X.app_lines(spark, sf_dir).select(
        "line_number",
        text_functions.mask_json_payloads(text).alias("masked"),
        F.size(text_functions.json_payloads(text)).cast("bigint").alias("payloads"),
        joined(keys).alias("keys"),
    )


# --- routing and time --------------------------------------------------------------


def routing_cache_key(spark, sf_dir):
    """Every document as a source of its own: copies share a key."""
    lines = X.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("source_id"),
        F.posexplode(F.split("text", "\n")).alias("line_number", "raw_line"),
    )
    keyed = RT.routing_cache_key(RT.sample_lists(N.sample_head(lines)))
    return keyed.groupBy("cache_key").agg(
        F.count(F.lit(1)).alias("sources"), F.min("source_id").alias("first_source")
    ).select("sources", "first_source")


def route_sources(spark, sf_dir):
    return _routing(spark, sf_dir)


def infer_timestamp_spec(spark, sf_dir):
    samples = N.sample_head(X.many_sources(spark, sf_dir))
    spec = TS.infer_timestamp_spec(samples, ["source_id"])
    return spec.select("source_id", "timestamp_spec.format", "timestamp_spec.has_year", "timestamp_spec.example")


def get_or_create_spec(spark, sf_dir):
    lines = X.host_lines(spark, sf_dir)
    samples = N.sample_head(lines.withColumn("source_id", F.col("vendor"))).select(
        "source_id", "line_number", "raw_line", F.lit(X.DEVICE).alias("device_type"), F.col("source_id").alias("vendor")
    )
    inferred = TS.infer_timestamp_spec(samples, LIBRARY_KEY)
    specs = TS.get_or_create_spec(X.user_templates(spark, sf_dir), X.user_meta(spark, sf_dir), inferred)
    return specs.select(*LIBRARY_KEY, "timestamp_spec.format", "timestamp_spec.has_year", "timestamp_spec.example")


def _specs(spark):
    return spark.createDataFrame(
        [(X.DEVICE, f"host{i}", (r"^(?P<ts>[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})", "%Y-%m-%d %H:%M:%S", True, None)) for i in range(3)]
        + [(X.DEVICE, "host3", (r"[0-9]{4}-(?P<ts>[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2})", "%m-%d %H:%M", False, None))],
        "device_type string, vendor string, timestamp_spec struct<regex:string,format:string,has_year:boolean,example:string>",
    )


def parse_timestamps(spark, sf_dir):
    out = TS.parse_timestamps(X.host_lines(spark, sf_dir), _specs(spark), year=2023)
    return out.select("line_number", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


TIME_FORMATS = [
    ("MMM dd HH:mm:ss", r"(?P<ts>\w{3} +\d+ [\d:]+)", "%b %d %H:%M:%S", False),
    ("EEE MMM dd HH:mm:ss yyyy", r"(?P<ts>\w{3} \w{3} +\d+ [\d:]+ \d{4})", "%a %b %d %H:%M:%S %Y", True),
    ("yyyy-MM-dd'T'HH:mm:ssxxx", r"(?P<ts>\S+T\S+)", "%Y-%m-%dT%H:%M:%S%z", True),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", r"(?P<ts>\S+T\S+)", "%Y-%m-%dT%H:%M:%S%z", True),
    (None, r"^(?P<ts>\d+)\b", "%s", True),
]


def parse_timestamps_formats(spark, sf_dir):
    """Event times written as syslog, ctime, ISO with offset or Z, and epoch seconds."""
    kind = F.col("user_id") % len(TIME_FORMATS)
    text = F.lit(None).cast("string")
    for i, (pattern, *_) in enumerate(TIME_FORMATS):
        shown = F.unix_timestamp("ts").cast("string") if pattern is None else F.date_format("ts", pattern)
        text = F.when(kind == i, shown).otherwise(text)
    lines = X.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(
        (F.col("event_id") + 1).alias("line_number"),
        F.lit(X.DEVICE).alias("device_type"),
        F.concat(F.lit("f"), kind.cast("string")).alias("vendor"),
        F.concat(text, F.lit(" up")).alias("raw"),
    )
    specs = spark.createDataFrame(
        [(X.DEVICE, f"f{i}", (regex, fmt, has_year, None)) for i, (_, regex, fmt, has_year) in enumerate(TIME_FORMATS)],
        "device_type string, vendor string, timestamp_spec struct<regex:string,format:string,has_year:boolean,example:string>",
    )
    out = TS.parse_timestamps(lines, specs, year=2024)
    return out.select("line_number", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


# --- learning ----------------------------------------------------------------------


def _mined(lines: DataFrame) -> DataFrame:
    return G.mine_candidates(lines).select(
        "line_number",
        "support",
        "template",
        "regex",
        joined("template_constants").alias("constants"),
        F.size("variables").cast("bigint").alias("n_variables"),
        "transformed",
    )


def mine_candidates(spark, sf_dir):
    return _mined(X.app_lines(spark, sf_dir))


def mine_candidates_text(spark, sf_dir):
    """Prose: nearly every line is its own pattern."""
    lines = X.in_library(X.document_lines(spark, sf_dir))
    return G.mine_patterns(lines).select("source_id", "line_number", "support")


def classify_slots(spark, sf_dir):
    lines = X.app_lines(spark, sf_dir)
    roles = G.classify_slots(lines)
    first = G.mask_lines(lines).groupBy("pattern_id").agg(F.min("line_number").alias("first_line"))
    return roles.join(first, "pattern_id").select(
        "first_line", F.col("position").cast("bigint").alias("position"), "support", "distinct_values", "role"
    )


def generalize_words(spark, sf_dir):
    return G.mine_candidates(X.nation_lines(spark, sf_dir), branch_support=10**9).select(
        "line_number", "support", "template", "regex"
    )


def generalize_two_words(spark, sf_dir):
    """Two open words next to one with few values: a template for each of those."""
    return G.mine_candidates(X.shipment_lines(spark, sf_dir), branch_support=10**9).select(
        "line_number", "support", "template", "regex"
    )


def validate_candidates(spark, sf_dir):
    _, examples = _user_examples(spark, sf_dir)
    candidates = _digit_candidates(spark, sf_dir).withColumn(
        "regex",
        F.when(F.col("candidate_id") == "digit-1", F.concat("regex", F.lit("(")))
        .when(F.col("candidate_id") == "digit-2", F.concat("regex", F.lit("zz")))
        .otherwise(F.col("regex")),
    )
    out = V.validate_candidates(with_compiled(candidates), examples)
    return out.select(
        *LIBRARY_KEY,
        "candidate_id",
        "is_valid",
        F.when(F.col("valid"), joined("reasons")).otherwise("invalid regex").alias("reasons"),
        joined("conflicting_template_ids").alias("conflicts"),
    )


def resolve_replace(spark, sf_dir):
    _, examples = _user_examples(spark, sf_dir)
    found = V.detect_conflicts(with_compiled(_digit_candidates(spark, sf_dir)), examples)
    plan = found.select(*LIBRARY_KEY, F.col("conflicting_template_ids").alias("replaced_ids"))
    library, left = R.resolve_replace(X.user_templates(spark, sf_dir), examples, plan)
    return library.join(left.select(*KEY, F.lit(True).alias("e")), KEY, "left").select(
        *KEY, "is_active", F.coalesce("e", F.lit(False)).alias("has_example")
    )


def _click_examples(spark, sf_dir):
    """One stored example that a general click candidate would swallow."""
    return X.app_lines(spark, sf_dir).filter("transformed like '%GET /click/%'").groupBy(*LIBRARY_KEY).agg(
        F.min_by("transformed", "line_number").alias("t")
    ).select(
        *LIBRARY_KEY, F.lit("old-1").alias("template_id"), F.lit(1).cast("bigint").alias("position"),
        F.regexp_replace("t", "host[0-9]", "host77").alias("transformed"),
    )


def resolve_refine(spark, sf_dir):
    """Candidates in conflict get their most constant slots pinned."""
    examples = _click_examples(spark, sf_dir)
    mined = G.mine_candidates(X.app_lines(spark, sf_dir)).withColumn("position", F.lit(100).cast("bigint"))
    checked = materialize(V.validate_candidates(mined, examples), "checked")
    return R.resolve_refine(checked.filter("not is_valid"), examples).select(
        "line_number", F.col("attempt").cast("bigint").alias("attempt"), "is_valid", "template", "regex"
    )


def _empty_examples(spark):
    return spark.createDataFrame([], "device_type string, vendor string, template_id string, position bigint, transformed string")


def _learned(spark, sf_dir):
    _, rest = N.split_matched(_assigned(spark, sf_dir))
    library = X.app_templates(spark)
    meta = spark.createDataFrame([], S.LIBRARY_META)
    return learn_templates(rest, library, meta, _empty_examples(spark))


def learn_templates_query(spark, sf_dir):
    learned = _learned(spark, sf_dir)
    return learned.matched.unionByName(
        learned.remaining.withColumn("template_id", F.lit(None).cast("string"))
    ).select("line_number", "template_id")


def learning_audit(spark, sf_dir):
    return _learned(spark, sf_dir).audit.select(
        "line_number", "candidate_id", "template_id", "outcome", "detail", F.col("round").cast("bigint").alias("round")
    )


def _learned_outcomes(spark, sf_dir):
    library, examples = X.outcome_library(spark, sf_dir)
    return learn_templates(
        X.outcome_lines(spark, sf_dir), library, spark.createDataFrame([], S.LIBRARY_META), materialize(examples, "examples")
    )


def learn_outcomes(spark, sf_dir):
    """Learning against a library with examples: some lines stay without a template."""
    learned = _learned_outcomes(spark, sf_dir)
    return learned.matched.unionByName(
        learned.remaining.withColumn("template_id", F.lit(None).cast("string"))
    ).select("line_number", "template_id")


def learning_audit_outcomes(spark, sf_dir):
    """Stored, replaced, refined and rejected candidates, with the reason."""
    return _learned_outcomes(spark, sf_dir).audit.select(
        "line_number", "template_id", "outcome", "detail", F.col("round").cast("bigint").alias("round")
    )


def learn_proposals(spark, sf_dir):
    """Turns as lines; the first answer of every second one is unusable, the next names a
    template for the turn's role."""
    turns = X.table(spark, sf_dir, "conversations")
    lines = X.in_library(turns.select(
        F.lit("chat.log").alias("source_id"),
        F.expr("conv_id * 1000 + turn + 1").alias("line_number"),
        F.expr("concat('conv ', cast(conv_id as string), ' turn ', cast(turn as string), ' role ', role)").alias("raw_line"),
    ))
    regex = F.concat(F.lit(r"conv (?P<conv>.*) turn (?P<turn>.*) role "), F.col("role"))
    answer = F.to_json(F.struct(F.lit("roles name events").alias("reasoning"), regex.alias("regex")))
    bad = F.expr("conv_id % 2 = 0")
    numbers = F.when(bad, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    proposals = turns.select(
        F.lit("chat.log").alias("source_id"),
        F.expr("conv_id * 1000 + turn + 1").alias("line_number"),
        F.explode(numbers).alias("attempt"),
        bad.alias("bad"),
        answer.alias("answer"),
    ).withColumn("text", F.when(F.col("bad") & (F.col("attempt") == 0), "no idea").otherwise(F.col("answer")))
    learned = learn_templates(
        lines, X.app_templates(spark).limit(0), spark.createDataFrame([], S.LIBRARY_META),
        _empty_examples(spark), proposals=proposals,
    )
    return learned.matched.unionByName(
        learned.remaining.withColumn("template_id", F.lit(None).cast("string"))
    ).select("line_number", "template_id")


def ingest_proposals(spark, sf_dir):
    """Answers of many shapes around the texts of a conversation."""
    answers = X.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.expr(ANSWER_EXPR.format(str="string", quote="to_json(struct(text))", cut="substring")).alias("text")
    )
    out = P.ingest_proposals(answers)
    return out.select(
        "conv_id", "turn", "regex", "reasoning", "decision", "new_regex", joined("replaced_ids").alias("replaced_ids"),
        F.col("error").isNull().alias("usable"),
    )


# The answer's shape depends on the turn; {obj} is the JSON object.
ANSWER_EXPR = """case (conv_id + turn) % 8
  when 0 then concat('{{"regex": " a.*", "reasoning": "r", "role": "', role, '"}}')
  when 1 then concat('```json\n{{"regex": "(?P<x>.*)", "reasoning": "', role, '"}}\n```')
  when 2 then concat('```\n[{{"regex": "b", "replaced_ids": ["', role, '", "2"]}}, 3]\n```')
  when 3 then concat('Sure: {{"decision": "refine_candidate", "new_regex": "', role, '"}} done')
  when 4 then '{{"regex": "cut'
  when 5 then '{{"regex": "a"}} and {{"regex": "b"}}'
  when 6 then '{{"regex": 5, "reasoning": "number"}}'
  else concat('no json, ', role) end"""


def build_proposal_requests(spark, sf_dir):
    """One request per uncovered pattern of the host libraries."""
    patterns = G.mine_patterns(X.host_lines(spark, sf_dir))
    requests = P.build_proposal_requests(patterns, _specs(spark))
    path = scratch_dir(spark)
    P.write_requests(requests, path)
    read = spark.read.schema(requests.schema).json(path)
    return read.select(
        "vendor",
        "kind",
        F.size("messages").cast("bigint").alias("n_messages"),
        F.get("messages", 1)["content"].alias("content"),
    )


def build_conflict_requests(spark, sf_dir):
    _, examples = _user_examples(spark, sf_dir)
    found = V.detect_conflicts(with_compiled(_digit_candidates(spark, sf_dir)), examples)
    pairs = V.conflict_pairs(found, X.user_templates(spark, sf_dir), examples)
    requests = P.build_conflict_requests(found, pairs)
    listed = F.substring_index(F.get("messages", 1)["content"], "In conflict: ", -1)
    return requests.select(
        *LIBRARY_KEY, "candidate_id", "kind",
        F.json_array_length(listed).cast("bigint").alias("conflicts"),
        F.get_json_object(listed, "$[0].example").alias("first_example"),
    )


def build_refinement_requests(spark, sf_dir):
    """Attempts that fail their checks, with reasons and group names."""
    checked = V.validate_candidates(with_compiled(_attempts(spark, sf_dir)), _empty_examples(spark))
    requests = P.build_refinement_requests(checked)
    return requests.select("candidate_id", "kind", F.get("messages", 1)["content"].alias("content"))


def build_source_requests(spark, sf_dir):
    """Routing and timestamp requests of every source."""
    lists = RT.sample_lists(N.sample_head(X.many_sources(spark, sf_dir)))
    return P.build_source_requests(lists).select(
        "source_id", "kind", F.get("messages", 1)["content"].alias("content")
    )


# --- whole jobs ----------------------------------------------------------------------


def _parsed(spark, sf_dir):
    lines = X.log_lines(spark, sf_dir)
    routing = spark.createDataFrame(
        [("app.log", X.DEVICE, X.VENDOR, "given")], "source_id string, device_type string, vendor string, reasoning string"
    )
    meta = spark.createDataFrame([], S.LIBRARY_META)
    return parse_logs(lines, X.app_templates(spark), meta, routing=routing)


def parse_logs_query(spark, sf_dir):
    return _parsed(spark, sf_dir).rows.select("line_number", "template_id", "raw")


def parsed_wide_query(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return parsed_wide(parsed.rows, parsed.templates).select(
        "line_number", "template_id", pairs_text(F.col("variables")).alias("variables")
    )


def parse_many_sources(spark, sf_dir):
    """All sources and libraries at once, from nothing: the report."""
    parsed = parse_logs(X.many_sources(spark, sf_dir), rules=ROUTE_RULES)
    return parsed.report.select(
        "source_id", "device_type", "vendor", "processed_lines", "matched_lines", "unmatched_lines"
    )


# --- streams -------------------------------------------------------------------------


def _event_stream(spark, sf_dir):
    schema = X.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return events.select(
        F.lit("app.log").alias("source_id"),
        (F.col("event_id") + 1).alias("line_number"),
        F.expr(X._BODY.format(**X._SPARK)).alias("raw_line"),
        F.lit(X.DEVICE).alias("device_type"),
        F.lit(X.VENDOR).alias("vendor"),
    )


def _run(writer, path: str) -> None:
    query = writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def stream_match(spark, sf_dir):
    path = scratch_dir(spark)
    columns = ["line_number", "template_id", pairs_text(F.col("variables")).alias("variables")]
    query = stream.write_matches(
        _event_stream(spark, sf_dir), X.app_templates(spark), f"{path}/out", f"{path}/cp", columns=columns
    )
    query.awaitTermination()
    schema = "line_number long, template_id string, variables string"
    return spark.read.schema(schema).parquet(f"{path}/out")


def stream_learn(spark, sf_dir):
    path = scratch_dir(spark)
    routing = spark.createDataFrame(
        [("app.log", X.DEVICE, X.VENDOR, "given")], "source_id string, device_type string, vendor string, reasoning string"
    )
    learn = stream.learn_batch(f"{path}/library", f"{path}/out", routing=routing)
    _run(_event_stream(spark, sf_dir).writeStream.foreachBatch(learn), path)
    rows = spark.read.parquet(f"{path}/out")
    return rows.select("line_number", "template_id")


def stream_usage(spark, sf_dir):
    path = scratch_dir(spark)
    specs = _specs(spark).filter("vendor = 'host0'").withColumn("vendor", F.lit(X.VENDOR))
    matched = stream.stream_match(_event_stream(spark, sf_dir), X.app_templates(spark))
    usage = stream.stream_usage(TS.parse_timestamps(matched, specs))
    _run(usage.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out"), path)
    return (
        spark.read.schema(usage.schema)
        .parquet(f"{path}/out")
        .select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "template_id", "usage")
    )


QUERIES = {
    "read_log_lines": read_log_lines,
    "decode_lossy": decode_lossy,
    "write_parsed_tsv": write_parsed_tsv,
    "write_template_snapshot": write_template_snapshot,
    "load_library": load_library,
    "quarantine_corrupt": quarantine_corrupt,
    "save_library": save_library,
    "reload_template": reload_template,
    "normalize_lines": normalize_lines,
    "sample_head": sample_head,
    "active_templates": active_templates,
    "valid_regex": valid_regex,
    "unmatched_rows": unmatched_rows,
    "unmatched_anomalies": unmatched_anomalies,
    "unknown_routes": unknown_routes,
    "match_templates": match_templates,
    "match_templates_large": match_templates_large,
    "extract_variables": extract_variables,
    "split_matched": split_matched,
    "rematch_remaining": rematch_remaining,
    "detect_conflicts": detect_conflicts,
    "conflict_pairs": conflict_pairs,
    "template_usage": template_usage,
    "template_examples": template_examples,
    "mark_failures": mark_failures,
    "cleanup_templates": cleanup_templates,
    "cleanup_all": cleanup_all,
    "parse_report": parse_report,
    "constant_coverage": constant_coverage,
    "list_templates": list_templates,
    "list_libraries": list_libraries,
    "allocate_template_ids": allocate_template_ids,
    "upsert_templates": upsert_templates,
    "first_valid_attempt": first_valid_attempt,
    "ordered_results": ordered_results,
    "render_template": render_template,
    "template_variables": template_variables,
    "extract_constants": extract_constants,
    "template_digest_id": template_digest_id,
    "variable_names": variable_names,
    "mask_json_payloads": mask_json_payloads,
    "routing_cache_key": routing_cache_key,
    "parse_timestamps_formats": parse_timestamps_formats,
    "route_sources": route_sources,
    "infer_timestamp_spec": infer_timestamp_spec,
    "get_or_create_spec": get_or_create_spec,
    "parse_timestamps": parse_timestamps,
    "mine_candidates": mine_candidates,
    "mine_patterns_prose": mine_candidates_text,
    "classify_slots": classify_slots,
    "generalize_words": generalize_words,
    "generalize_two_words": generalize_two_words,
    "validate_candidates": validate_candidates,
    "resolve_replace": resolve_replace,
    "resolve_refine": resolve_refine,
    "refine_invalid": refine_invalid,
    "learn_templates": learn_templates_query,
    "learn_outcomes": learn_outcomes,
    "learning_audit_outcomes": learning_audit_outcomes,
    "learn_proposals": learn_proposals,
    "ingest_proposals": ingest_proposals,
    "build_proposal_requests": build_proposal_requests,
    "build_conflict_requests": build_conflict_requests,
    "build_refinement_requests": build_refinement_requests,
    "build_source_requests": build_source_requests,
    "learning_audit": learning_audit,
    "parse_logs": parse_logs_query,
    "parse_many_sources": parse_many_sources,
    "parsed_wide": parsed_wide_query,
    "stream_match": stream_match,
    "stream_learn": stream_learn,
    "stream_usage": stream_usage,
}
