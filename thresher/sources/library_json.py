"""Library files: one JSON document per library (or per page of a large one).

Files are read once, as text. What is no JSON object is set aside; the fields of a
readable document are taken one by one and leniently, so an odd field costs its own
value and never the library.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher import schemas as S
from thresher.operators.library import list_templates
from thresher.operators.timestamps import usable_spec
from thresher.schemas import LIBRARY_KEY
from thresher.session import materialize, scratch_dir

PAGE_SIZE = 10_000
# What opening a file counts for when files are dealt to tasks: a task opens about a
# thousand. Spark's own 4 MB leaves four library files to a task.
OPEN_BYTES = 16 << 10


def read_library_files(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``path, text`` of each document, and its JSON as ``document`` (null if broken).

    ``multi_line``: one document per file, the layout of hand-kept libraries. Each file
    is opened once, and its text written. Snapshots written by `write_template_snapshot`
    have one document per line.
    """
    reader = spark
    if multi_line:
        # A session of its own, so that only this read has the setting.
        reader = spark.newSession()
        reader.conf.set("spark.sql.files.openCostInBytes", str(OPEN_BYTES))
    texts = (
        reader.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=multi_line)
        .filter("trim(value) <> ''")
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    if multi_line:
        written = f"{scratch_dir(spark)}/files"
        texts.write.parquet(written)
        texts = spark.read.schema(texts.schema).parquet(written)
    return texts.withColumn("document", F.try_parse_json("text"))


def _is_object(variant: str) -> Column:
    return F.coalesce(F.startswith(F.expr(f"schema_of_variant({variant})"), F.lit("OBJECT")), F.lit(False))


@F.pandas_udf(S.STRING)
def _json_error(text: pd.Series) -> pd.Series:
    def error(t):
        try:
            json.loads(t)
        except ValueError as exc:
            return str(exc)
        return "not a JSON object"

    return pd.Series([error(t) for t in text], dtype=object)


def quarantine_corrupt(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable documents, set-aside files with the error text)."""
    good = _is_object("document")
    aside = materialize(files.filter(~good).select("path", "text"), "quarantined")
    return files.filter(good), aside.select("path", _json_error(F.col("text")).alias("error"))


def _get(variant: str, field: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({variant}, '$.{field}', '{kind}')")


def _from_name(key: str) -> Column:
    """A key from the folder ``key=value`` of a snapshot, else from ``device__vendor.json``."""
    stem = F.regexp_extract("path", r"([^/]*__[^/]*)\.json\z", 1)
    part = F.split_part(stem, F.lit("__"), F.lit(LIBRARY_KEY.index(key) + 1))
    folder = F.regexp_extract("path", f"/{key}=([^/]*)/", 1)
    decoded = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    return F.coalesce(F.nullif(decoded, F.lit("")), F.nullif(part, F.lit("")))


def _library_name(files: DataFrame) -> DataFrame:
    """Library key from the metadata, else from the file's name."""
    unknown = F.lit("unknown")
    given = lambda key: F.element_at("metadata", key)
    entries = _get("document", "metadata", "map<string,variant>")
    texts = F.transform_values(entries, lambda k, v: F.try_variant_get(v, "$", "string"))
    return (
        files.withColumn("metadata", texts)
        .withColumn("page", F.coalesce(_get("document", "page", "int"), F.lit(0)))
        .withColumn("device_type", F.coalesce(given("device_type"), _from_name("device_type"), unknown))
        .withColumn("vendor", F.coalesce(given("vendor"), _from_name("vendor"), unknown))
    )


def _spec(variant: str, path: str) -> Column:
    """A timestamp spec, field by field; null where there is none."""
    there = _get(variant, path, "variant")
    fields = [
        _get(variant, f"{path}.{f.name}", f.dataType.simpleString()).alias(f.name)
        for f in S.TIMESTAMP_SPEC.fields
    ]
    return F.when(there.isNotNull(), F.struct(*fields))


def _field(field: str) -> Column:
    """A template's field; its default if absent or of another kind."""
    kind = S.STORED_TEMPLATE[field].dataType
    if field == "timestamp_hint":
        return usable_spec(_spec("t", field)).alias(field)
    value = _get("t", field, kind.simpleString())
    if field in S.TEMPLATE_DEFAULTS:
        value = F.coalesce(value, F.lit(S.TEMPLATE_DEFAULTS[field]).cast(kind))
    elif isinstance(kind, T.ArrayType):
        value = F.array_compact(F.coalesce(value, F.array().cast(kind)))
    return value.cast(kind).alias(field)


def load_library(
    files: DataFrame, quarantined: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(templates, metadata) of readable documents.

    Missing and odd fields take their defaults; of records with one id the last counts,
    at the place of the first. A library whose only file is ``quarantined`` goes on
    empty, with the file's place as ``corrupted_backup`` in its metadata.
    """
    named = _library_name(files)
    rows = named.select(
        *LIBRARY_KEY,
        "page",
        F.posexplode(_get("document", "templates", "array<variant>")).alias("pos", "t"),
    )
    fields = [f for f in S.STORED_TEMPLATE.names if f != "template_id"]
    place = F.col("page").cast("bigint") * PAGE_SIZE + F.col("pos") + 1
    templates = (
        rows.select(
            *LIBRARY_KEY,
            place.alias("_at"),
            _get("t", "template_id", "string").alias("template_id"),
            *[_field(f) for f in fields],
        )
        .filter("template_id is not null and regex is not null")
        .groupBy(*LIBRARY_KEY, "template_id")
        .agg(F.min("_at").alias("seq"), F.max_by(F.struct(*fields), "_at").alias("r"))
        .select(*LIBRARY_KEY, "seq", "template_id", "r.*")
        .select(*S.TEMPLATE.names)
    )
    given = F.coalesce("metadata", F.create_map().cast(S.VARIABLES))
    first = named.withColumn("spec", usable_spec(_spec("document", "timestamp_spec"))).groupBy(
        *LIBRARY_KEY
    ).agg(F.min_by(F.struct(given.alias("given"), "spec"), "page").alias("m"))
    meta = first.select(
        *LIBRARY_KEY, _with_base(F.col("m.given")).alias("metadata"), F.col("m.spec").alias("timestamp_spec")
    )
    if quarantined is not None:
        lost = quarantined.select(
            "path",
            F.coalesce(_from_name("device_type"), F.lit("unknown")).alias("device_type"),
            F.coalesce(_from_name("vendor"), F.lit("unknown")).alias("vendor"),
        ).groupBy(*LIBRARY_KEY).agg(F.min("path").alias("path"))
        backup = F.create_map(F.lit("corrupted_backup"), F.col("path"))
        empty = lost.join(meta.select(*LIBRARY_KEY), LIBRARY_KEY, "left_anti").select(
            *LIBRARY_KEY,
            _with_base(backup).alias("metadata"),
            F.lit(None).cast(S.TIMESTAMP_SPEC).alias("timestamp_spec"),
        )
        meta = meta.unionByName(empty)
    return templates, meta


def _with_base(given: Column) -> Column:
    base = F.create_map(
        F.lit("device_type"), F.col("device_type"), F.lit("vendor"), F.col("vendor"),
        F.lit("version"), F.lit("v1"),
    )
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(given, k)), given)


def snapshot_documents(
    templates: DataFrame, meta: DataFrame, page_size: int = PAGE_SIZE
) -> DataFrame:
    """``metadata, timestamp_spec, templates[]`` per library, in library order.

    A document holds at most ``page_size`` templates; only a larger library needs
    further pages, so no group grows without limit. A library without templates has one
    document, and one without metadata its templates.
    """
    shown = list_templates(templates)
    fields = [f for f in shown.columns if f not in (*LIBRARY_KEY, "seq")]
    pages = (
        shown.withColumn("page", F.floor((F.col("seq") - 1) / page_size).cast("int"))
        .groupBy(*LIBRARY_KEY, "page")
        .agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("t")))).alias("_t"))
        .withColumn("templates", F.transform("_t", lambda x: x["t"]))
    )
    none = F.array().cast(pages.schema["templates"].dataType)
    return pages.join(meta, LIBRARY_KEY, "full").select(
        *LIBRARY_KEY,
        F.coalesce("page", F.lit(0)).alias("page"),
        "metadata",
        "timestamp_spec",
        F.coalesce("templates", none).alias("templates"),
    )


def write_template_snapshot(
    templates: DataFrame, meta: DataFrame, path: str, page_size: int = PAGE_SIZE
) -> None:
    (
        snapshot_documents(templates, meta, page_size)
        .write.mode("overwrite")
        .partitionBy(*LIBRARY_KEY)
        .option("ignoreNullFields", "false")
        .json(path)
    )
