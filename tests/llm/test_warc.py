import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from thresher.llm import warc
from thresher.session import scratch_dir

PAGES = "page_id long, url string, html string, digest string, target long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(3)


def expected(rows):
    """Largest id of each payload of 1000 bytes or more; other rows revisit it."""
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        ids = [i for i, _, h in rows if (h or "").encode() == data and i is not None]
        target = max(ids) if ids and len(data) >= 1000 else None
        revisit = target is not None and page_id != target
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", target if revisit else None))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark):
    big = "ü" * 600
    rows = [(i, f"http://a/{i}?q=ä b\r\n", big if i % 3 else f"page {i}") for i in range(40)]
    rows += [(50, None, None), (51, "", ""), (52, "http://b", "x" * 3_000_000), (7, "again", big), (39, "http://c", "short"), (39, "http://c", "short")]
    rows += [(None, "http://d", big), (None, None, "y" * 2000), (60, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 80), (61, "u", "z" * 999), (62, "u", "z" * 999)]
    rows += [(70, "u", "t" * 1000), (70, "v", "t" * 1000)]
    found = warc.archive_round_trip(pages(spark, rows)).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)


def test_archives_hold_one_member_per_record(spark):
    rows = [(i, "http://a", f"payload {i}" * i) for i in range(12)]
    folder = f"{scratch_dir(spark)}/archives"
    manifest = warc.write_archives(warc.mark_revisits(pages(spark, rows)), folder, archive_bytes=600)
    files = manifest.collect()
    assert sum(f.records for f in files) == 12 and len(files) > 3
    payloads = {r.record_id: bytes(r.payload) for r in warc.read_archives(spark, manifest).collect()}
    assert payloads == {f"<urn:page:{i}>": f"payload {i}".encode() * i for i in range(12)}
    for f in files:
        data = open(f.path.removeprefix("file://"), "rb").read()
        assert len(data) == f.bytes and gzip.decompress(data).count(b"WARC/1.1\r\n") == f.records


def test_reader_works_in_small_steps(monkeypatch):
    data = b"".join(warc.record(i, "u", b"text " * 50 * i, None) for i in range(4)) + warc.record(9, None, b"abc", 3)
    whole = list(warc.read_records(io.BytesIO(data)))
    monkeypatch.setattr(warc, "CHUNK", 5)
    small = list(warc.read_records(io.BytesIO(data)))
    assert small == whole and [r.offset for r in small][0] == 0
    assert [gzip.decompress(data[r.offset :])[:8] for r in small] == [b"WARC/1.1"] * 5
    assert warc.payload_of(small[4]) == (b"", 3) and small[4].fields["warc-refers-to"] == "<urn:page:3>"


def test_broken_archives_are_told():
    good = gzip.decompress(warc.record(1, "u", b"hello", None))
    for bad in (good.replace(b"hello", b"hallo"), good.replace(b"WARC/1.1", b"WORC/1.1"), good[:-4], good + b"x", good.replace(b"Content-Length: ", b"Content-Len: ")):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(warc.record(1, "u", b"hello", None)[:-9])))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(b"no gzip at all")))


def test_empty_table(spark):
    assert warc.archive_round_trip(pages(spark, [])).collect() == []


def test_archive_cut_at_a_member(spark, tmp_path):
    """An archive that ends early, between two records, does not pass."""
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(3)], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.mark_revisits(pages).coalesce(1), str(tmp_path))
    assert warc.read_archives(spark, manifest).count() == 3
    short = manifest.withColumn("records", F.col("records") + 1)
    with pytest.raises(Exception, match="holds 3 records, 4 were written"):
        warc.read_archives(spark, short).count()
