import pytest

from thresher import schemas as S
from thresher.operators import match as M
from thresher.sources import store
from thresher.streaming.stream import learn_batch, stream_match, write_matches

LINES = "source_id string, line_number bigint, raw_line string"


def test_batches_learn_once(spark, tmp_path):
    learn = learn_batch(str(tmp_path / "lib"), str(tmp_path / "out"))
    one = spark.createDataFrame([("s", i, f"get {i}") for i in range(5)], LINES)
    two = spark.createDataFrame([("s", 9, "put 3"), ("s", 10, "get 8")], LINES)
    learn(one, 0)
    learn(two, 1)
    learn(two, 1)
    templates, _ = store.open_library(spark, str(tmp_path / "lib"))
    rows = {r.regex: r.usage_count for r in templates.collect()}
    assert rows == {"get (?P<num1>.*)": 6, "put (?P<num1>.*)": 1}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_streams_on_one_store_are_their_own(spark, tmp_path):
    one = spark.createDataFrame([("s", i, f"get {i}") for i in range(5)], LINES)
    two = spark.createDataFrame([("t", i, f"put {i}") for i in range(4)], LINES)
    path = str(tmp_path / "lib")
    first, second = (learn_batch(path, str(tmp_path / name)) for name in ("one", "two"))
    first(one, 0)
    second(two, 0)
    first(one, 0)
    second(two, 0)
    assert spark.read.parquet(str(tmp_path / "one")).count() == 5
    assert spark.read.parquet(str(tmp_path / "two")).count() == 4
    usage = {r.regex: r.usage_count for r in store.open_library(spark, path)[0].collect()}
    assert usage == {"get (?P<num1>.*)": 5, "put (?P<num1>.*)": 4}


def test_second_writer_of_a_version_fails(spark, library, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    meta = spark.createDataFrame([], S.LIBRARY_META)
    assert store.save_library(library(["a"]), meta, path)
    stale = store._newest(spark, path)
    assert store.save_library(library(["b"]), meta, path)
    monkeypatch.setattr(store, "_newest", lambda *_: stale)
    with pytest.raises(store.VersionExists):
        store.save_library(library(["c"]), meta, path)
    monkeypatch.undo()
    assert [r.regex for r in store.open_library(spark, path)[0].collect()] == ["b"]


def test_old_manifest_entries_go(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "KEPT_ENTRIES", 2)
    path = str(tmp_path / "store")
    meta = spark.createDataFrame([], S.LIBRARY_META)
    for n in range(5):
        store.save_library(library([f"r{n}"]), meta, path, ("stream", n))
    assert store._versions(spark, path) == [4, 5]
    assert store.is_published(spark, path, "stream", 0) and store.is_published(spark, path, "stream", 4)
    assert not store.is_published(spark, path, "stream", 5) and not store.is_published(spark, path, "other", 0)


def test_large_library_matches_a_stream(spark, library, tmp_path):
    templates = library([f"word{i} (?P<x>.*)" for i in range(2100)])
    spark.createDataFrame([("s", i, f"word{i * 700} v{i}", "d", "v") for i in range(4)], LINES + ", device_type string, vendor string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LINES + ", device_type string, vendor string").parquet(str(tmp_path / "in"))
    query = stream_match(stream, templates).writeStream.format("memory").queryName("large").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    rows = {r.line_number: (r.template_id, r.variables) for r in spark.table("large").collect()}
    assert rows == {i: (f"d-v-{i * 700 + 1:04d}", {"x": f"v{i}"}) if i < 3 else (None, {}) for i in range(4)}


@pytest.mark.parametrize("limit", [M.TASK_INDEX_LIMIT, 0])
def test_a_library_of_any_size_matches_a_stream(spark, library, tmp_path, monkeypatch, limit):
    """Beyond what a task holds each micro-batch is matched like a table: the same rows."""
    monkeypatch.setattr(M, "TASK_INDEX_LIMIT", limit)
    monkeypatch.setattr(M, "CASE_LIMIT", 1)
    templates = library([f"word{i} (?P<x>.*)" for i in range(9)] + ["w(?P<all>.*)"])
    schema = LINES + ", device_type string, vendor string"
    for part in range(2):
        rows = [("s", 10 * part + i, f"word{i * 4} v{i}", "d", "v") for i in range(4)]
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    kept = ["line_number", "template_id", "variables"]
    query = write_matches(stream, templates, str(tmp_path / "out"), str(tmp_path / "cp"), columns=kept)
    query.awaitTermination()
    found = spark.read.schema("line_number long, template_id string, variables map<string,string>").parquet(str(tmp_path / "out"))
    want = {0: ("d-v-0001", {"x": "v0"}), 1: ("d-v-0005", {"x": "v1"}), 2: ("d-v-0009", {"x": "v2"}), 3: ("d-v-0010", {"all": "ord12 v3"})}
    assert {r.line_number: (r.template_id, r.variables) for r in found.collect()} == want | {10 + k: v for k, v in want.items()}
    if not limit:
        with pytest.raises(ValueError):
            stream_match(stream, templates)


def test_two_writers_race_and_one_wins(spark, library, tmp_path):
    """Both have written their tables under the same version; the entry is created once."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "store")
    meta = spark.createDataFrame([], S.LIBRARY_META)
    store.save_library(library(["first"]), meta, path)
    for turn in range(3):
        entries = [store.Entry(turn + 2, f"version-{turn + 2}-{i:032x}", str(i)) for i in range(6)]

        def publish(entry):
            try:
                store._publish(spark, path, entry)
            except store.VersionExists:
                return None
            return entry

        with ThreadPoolExecutor(6) as pool:
            won = [e for e in pool.map(publish, entries) if e]
        assert len(won) == 1 and store._newest(spark, path) == won[0]
    assert [f.name for f in (tmp_path / "store" / "manifest").iterdir() if f.name.startswith("_")] == []


def test_table_folders_stay_bounded(spark, library, tmp_path, monkeypatch):
    """Old folders go, a lost writer's too; a batch that changes nothing writes none."""
    monkeypatch.setattr(store, "KEPT_ENTRIES", 2)
    path = tmp_path / "store"
    meta = spark.createDataFrame([], S.LIBRARY_META)
    for n in range(4):
        store.save_library(library([f"r{n}"]), meta, str(path), ("stream", n))

    def folders():
        return sorted(f.name.split("-")[1] for f in path.iterdir() if f.name.startswith("version-"))

    assert folders() == ["3", "4"]
    for n in range(4, 8):
        store.save_library(library(["r3"]), meta, str(path), ("stream", n))
    assert folders() == ["4"] and store._versions(spark, str(path)) == [7, 8]
    assert [r.regex for r in store.open_library(spark, str(path))[0].collect()] == ["r3"]
    stale = store._newest(spark, str(path))
    store.save_library(library(["new"]), meta, str(path))
    monkeypatch.setattr(store, "_newest", lambda *_: stale)
    with pytest.raises(store.VersionExists):
        store.save_library(library(["late"]), meta, str(path))
    assert folders() == ["4", "9"]
