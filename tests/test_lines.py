import pytest
from pyspark.sql import functions as F

from thresher.operators.lines import WHITESPACE, normalize_lines, sample_head, unmatched_anomalies
from thresher.sources.text import read_log_lines, write_parsed_tsv


def test_numbering_over_splits_and_line_ends(spark, tmp_path):
    """Lines are numbered per file, whatever the splits and line ends."""
    body = "".join(f"line {i}{end}" for i, end in zip(range(1, 4001), ["\n", "\r\n", "\r", "\n"] * 1000))
    (tmp_path / "one.log").write_bytes(body.encode())
    (tmp_path / "two.log").write_bytes(b"\nx\n\ny")
    (tmp_path / "empty.log").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_log_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        got = {}
        for r in rows.collect():
            got.setdefault(r.source_id.rsplit("/", 1)[1], {})[r.line_number] = r.raw_line
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got["one.log"] == {i: f"line {i}" for i in range(1, 4001)}
    assert got["two.log"] == {1: "", 2: "x", 3: "", 4: "y"}
    assert "empty.log" not in got


def test_undecodable_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"a\xffb\n\xc3\xa9\xc3\nfine \xef\xbf\xbd\n")
    rows = read_log_lines(spark, str(tmp_path)).orderBy("line_number").collect()
    assert [r.raw_line for r in rows] == ["ab", "é", "fine �"]


def test_whitespace_is_what_python_strips(spark):
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    texts = ["a\t", "a\xa0 ", "a\x1c", "  a  b\t\tc  ", "", " \t", "a​"]
    df = spark.createDataFrame([(t,) for t in texts], "raw_line string")
    import re

    for t, r in zip(texts, normalize_lines(df).collect()):
        assert r.raw == t.rstrip()
        assert r.transformed == re.sub(" {2,}", " ", t.rstrip())


def test_samples_and_anomalies(lines):
    df = lines(["", *[f"l{i}" for i in range(20)]])
    assert [r.raw_line for r in sample_head(df).orderBy("sample_no").collect()] == [f"l{i}" for i in range(12)]
    notes = unmatched_anomalies(df.withColumn("template_id", F.lit(None).cast("string")))
    texts = [r.anomaly for r in notes.orderBy("anomaly_no").collect()]
    assert texts[0] == "21 lines remain unmatched after template learning"
    assert texts[1:] == ["Unmatched line 1: "] + [f"Unmatched line {i + 2}: l{i}" for i in range(4)]


@pytest.mark.parametrize("header", [False, True])
def test_tsv_is_ordered_and_unquoted(spark, lines, tmp_path, header):
    df = lines(['a\tb"c', "plain", "  lead"]).withColumn(
        "template_id", F.when(F.col("line_number") == 2, "t").cast("string")
    )
    write_parsed_tsv(df, str(tmp_path / "out"), header=header)
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    text = [line for p in parts for line in p.read_text().splitlines()]
    want = ['1\t\ta b"c', "2\tt\tplain", "3\t\t  lead"]
    assert [line for line in text if not line.startswith("line\t")] == want
    assert any(line == "line\ttemplate_id\traw" for line in text) == header
