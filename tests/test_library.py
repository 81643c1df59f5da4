import json

from pyspark.sql import functions as F

from thresher import schemas as S
from thresher.operators import library as L
from thresher.sources import library_json, store

NEW = "device_type string, vendor string, source_id string, line_number bigint, regex string, template_id string"


def new_rows(spark, rows):
    from checks.fixtures import complete

    return complete(spark.createDataFrame(rows, NEW), "source_id", "line_number")


def meta(spark, sequence=None):
    data = {"version": "v1"} if sequence is None else {"next_sequence": sequence}
    return spark.createDataFrame([("d", "v", data, None)], S.LIBRARY_META)


def test_ids_continue_past_gaps(spark, library):
    current = library(["a", "b"]).withColumn(
        "template_id", F.when(F.col("seq") == 2, "d-v-0041").otherwise("d-v-x")
    )
    rows = new_rows(spark, [("d", "v", "s", n, f"r{n}", None) for n in (9, 3, 2_000_000)])
    out = L.allocate_template_ids(rows, current, meta(spark)).orderBy("line_number").collect()
    assert [(r.template_id, r.seq) for r in out] == [("d-v-0042", 3), ("d-v-0043", 4), ("d-v-0044", 5)]
    out = L.allocate_template_ids(rows, current, meta(spark, "10000")).orderBy("line_number").collect()
    assert out[0].template_id == "d-v-10000"
    out = L.allocate_template_ids(rows, current, meta(spark, "junk")).orderBy("line_number").collect()
    assert out[0].template_id == "d-v-0042"


def test_spaces_in_names(spark, library):
    rows = new_rows(spark, [("big switch", "palo alto", "s", 1, "r", None)])
    out = L.allocate_template_ids(rows, library(["a"]), meta(spark)).first()
    assert out.template_id == "big_switch-palo_alto-0001"


def test_upsert_replaces_in_place_and_rejects(spark, library):
    rows = new_rows(spark, [("d", "v", "s", 1, "x", "d-v-0001"), ("d", "v", "s", 2, "y", "d-v-0001"), ("d", "v", "s", 3, "(", "d-v-0002"), ("d", "v", "s", 4, "z", "other")])
    out = L.upsert_templates(library(["a", "b"]), rows, meta(spark)).orderBy("seq").collect()
    assert [(r.seq, r.template_id, r.regex) for r in out] == [
        (1, "d-v-0001", "y"), (2, "d-v-0002", "b"), (3, "d-v-0003", "z"),
    ]


def test_cleanup_boundaries(library):
    counts = [(5, 0), (0, 0), (4, 6), (3, 6), (0, 3)]
    df = library(["r"] * 5)
    usage = F.element_at(F.array(*[F.lit(u).cast("bigint") for u, _ in counts]), F.col("seq").cast("int"))
    fails = F.element_at(F.array(*[F.lit(f).cast("bigint") for _, f in counts]), F.col("seq").cast("int"))
    df = df.withColumn("usage_count", usage).withColumn("failure_count", fails)
    after, held = L.cleanup_templates(df)
    # A ratio of exactly 0.6 stays; unused ones go.
    assert sorted(r.template_id for r in held.collect()) == ["d-v-0002", "d-v-0004", "d-v-0005"]
    assert [r.is_active for r in after.orderBy("seq").collect()] == [True, False, True, False, False]
    dry, held = L.cleanup_templates(df, dry_run=True)
    assert held.count() == 3 and dry.filter("is_active").count() == 5


def test_number_rows_across_blocks(spark):
    rows = [("k", "s1", n) for n in (1, 5, 3_000_000, 3_000_007)] + [("k", "s2", 2), ("j", "s1", 9)]
    df = spark.createDataFrame(rows, "k string, source_id string, line_number bigint")
    out = {(r.k, r.source_id, r.line_number): r.n for r in L.number_rows(df, ["k"], "n").collect()}
    assert [out[("k", "s1", n)] for n in (1, 5, 3_000_000, 3_000_007)] == [1, 2, 3, 4]
    assert out[("k", "s2", 2)] == 5 and out[("j", "s1", 9)] == 1


def test_library_files(spark, tmp_path):
    good = {
        "metadata": {"device_type": "d", "vendor": "v", "next_sequence": "7"},
        "timestamp_spec": {"regex": "r", "format": "%Y"},
        "templates": [
            {"template_id": "a", "regex": "1"},
            {"template_id": "b", "regex": "2", "usage_count": 3, "is_active": False, "timestamp_hint": {"regex": "q", "format": "%m"}},
            {"template_id": "a", "regex": "3", "notes": "last"},
        ],
    }
    (tmp_path / "d__v.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "x__y.json").write_text('{"templates": [')
    (tmp_path / "p__q.json").write_text('{"templates": [{"template_id": "k", "regex": "z"}]}')
    files, bad = library_json.quarantine_corrupt(library_json.read_library_files(spark, str(tmp_path)))
    aside = bad.collect()
    assert len(aside) == 1 and aside[0].path.endswith("x__y.json") and "line 1" in aside[0].error
    templates, found = library_json.load_library(files)
    rows = {(r.vendor, r.template_id): r for r in templates.collect()}
    assert rows[("v", "a")].regex == "3" and rows[("v", "a")].seq == 1 and rows[("v", "b")].seq == 2
    assert rows[("v", "a")].source == "llm" and rows[("v", "a")].is_active and rows[("v", "a")].variables == []
    assert not rows[("v", "b")].is_active and rows[("v", "b")].timestamp_hint.has_year
    assert ("q", "k") in rows
    spec = {r.vendor: r for r in found.collect()}
    assert spec["v"].timestamp_spec.has_year and spec["v"].metadata["next_sequence"] == "7"
    assert spec["q"].timestamp_spec is None and spec["q"].metadata["version"] == "v1"


def test_snapshot_pages(spark, library, tmp_path):
    df = library([f"r{i}" for i in range(7)])
    docs = library_json.snapshot_documents(df, meta(spark), page_size=3).orderBy("page").collect()
    assert [[t.regex for t in d.templates] for d in docs] == [["r0", "r1", "r2"], ["r3", "r4", "r5"], ["r6"]]
    library_json.write_template_snapshot(df, meta(spark), str(tmp_path / "s"))
    read = library_json.read_library_files(spark, str(tmp_path / "s"), multi_line=False)
    assert library_json.load_library(read)[0].count() == 7


def test_odd_fields_cost_only_themselves(spark, tmp_path):
    odd = {"metadata": {"vendor": "v", "device_type": "d", "count": 3}, "templates": [
        {"template_id": "a", "regex": "1", "usage_count": 3.0, "variables": ["x"], "notes": 7},
        {"template_id": "b", "regex": "2", "is_active": "maybe", "constants": {"k": 1}}, "text", {"regex": "no id"}]}
    (tmp_path / "d__v.json").write_text(json.dumps(odd))
    (tmp_path / "x__y.json").write_text('["no", "object"]')
    good, bad = library_json.quarantine_corrupt(library_json.read_library_files(spark, str(tmp_path)))
    assert [r.error for r in bad.collect()] == ["not a JSON object"]
    templates, meta_rows = library_json.load_library(good, bad)
    rows = {r.template_id: r for r in templates.collect()}
    assert set(rows) == {"a", "b"} and rows["a"].usage_count == 3 and rows["a"].variables == []
    assert rows["b"].is_active and rows["b"].constants == []
    found = {r.vendor: r.metadata for r in meta_rows.collect()}
    assert found["v"]["count"] == "3" and found["y"]["corrupted_backup"].endswith("x__y.json")


def test_snapshot_of_a_library_without_templates(spark, library, tmp_path):
    empty = spark.createDataFrame([("d", "none", {"version": "v1"}, None)], S.LIBRARY_META)
    docs = library_json.snapshot_documents(library(["r"]), meta(spark).unionByName(empty))
    assert {(r.vendor, len(r.templates)) for r in docs.collect()} == {("v", 1), ("none", 0)}
    library_json.write_template_snapshot(library(["r"]), empty, str(tmp_path / "s"))
    read = library_json.read_library_files(spark, str(tmp_path / "s"), multi_line=False)
    templates, found = library_json.load_library(read)
    assert templates.count() == 1 and found.count() == 2


def test_variable_names_skip_escapes_and_classes(spark):
    from thresher.functions.text import variable_names

    regexes = {r"(?P<a>x)\(?P<b>y\)": ["a"], r"(?P<a>x)\(?P<b>y)": [], r"[(?P<c>]z(?P<d>.)": ["d"], r"\\(?P<e>.)": ["e"], "(?P<a>x)(": [], "(?P<a>x)(?P<a>y)": []}
    df = spark.createDataFrame([(r,) for r in regexes], "r string")
    assert {x.r: x.n for x in df.select("r", variable_names(F.col("r")).alias("n")).collect()} == regexes


def test_store_versions(spark, library, tmp_path):
    path = str(tmp_path / "store")
    df = library(["a", "b"])
    assert store.open_library(spark, path)[0].count() == 0
    assert store.save_library(df, meta(spark), path)
    assert not store.save_library(df, meta(spark), path)
    assert store.save_library(df.withColumn("notes", F.lit("n")), meta(spark), path)
    assert {r.notes for r in store.open_library(spark, path)[0].collect()} == {"n"}
    assert store.open_library(spark, path)[1].first().metadata == {"version": "v1"}


def test_library_files_are_opened_once(spark, tmp_path):
    """What is readable and what is set aside come from one reading of each file."""
    for i in range(40):
        (tmp_path / f"d__v{i}.json").write_text('{"templates": [{"template_id": "a", "regex": "x"}]}' if i % 2 else '{"templates": [')
    read = library_json.read_library_files(spark, str(tmp_path))
    for i in range(40):
        (tmp_path / f"d__v{i}.json").write_text("7")
    good, bad = library_json.quarantine_corrupt(read)
    assert {r.vendor for r in library_json.load_library(good)[0].collect()} == {f"v{i}" for i in range(1, 40, 2)}
    assert {r.path.rsplit("/", 1)[1] for r in bad.collect()} == {f"d__v{i}.json" for i in range(0, 40, 2)}


def test_all_cores_write_files_of_whole_names(spark, tmp_path):
    from checks.queries import _write_files

    rows = [(f"n{i % 50}", f"{i % 2}") for i in range(100)] + [(None, "x"), (None, None), ("ä b", "ü")]
    _write_files(spark.createDataFrame(rows, "name string, value string"), str(tmp_path / "files"))
    found = {p.name: sorted(p.read_text().splitlines()) for p in (tmp_path / "files").iterdir()}
    want = {f"name=n{i}.json": [f"{i % 2}"] * 2 for i in range(50)}
    assert found == want | {"name=__HIVE_DEFAULT_PARTITION__.json": ["", "x"], "name=ä b.json": ["ü"]}
