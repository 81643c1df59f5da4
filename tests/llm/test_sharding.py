import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from thresher.llm import sharding


def check(rows, found, shards, slack):
    assert len(found) == len(rows)
    given = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in found), key=str) == given
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    fair = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - fair) <= slack for s in range(shards))


def test_equal_bytes_with_a_hot_source_and_copies(documents):
    rows = [(i, "word " * (i % 83), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    rows += [(5000 + i, "copy " * 40, "en", "hot") for i in range(1500)] + [(9999, "long " * 250, None, None)]
    check(rows, sharding.shard(documents(rows)).collect(), 40, 1500)


def test_nulls_repeats_and_far_ids(documents):
    rows = [(None, None), (None, "a"), (7, "ü"), (7, "ü"), (2**62, "far"), (-(2**62), "far"), (0, "")]
    rows += [(i, f"text {i}") for i in range(200)]
    check(rows, sharding.shard(documents(rows), shards=3).collect(), 3, 40)


def test_few_rows_and_none(documents):
    rows = [(1, "only")]
    assert len(sharding.shard(documents(rows), shards=3).collect()) == 1
    assert sharding.shard(documents([]), shards=3).collect() == []
    check([(1, "a"), (2, "b")], sharding.shard(documents([(1, "a"), (2, "b")]), shards=2).collect(), 2, 1)


def test_splits_are_weighted_medians(documents):
    """Each split of the tree divides the bytes of its node in proportion to its shards."""
    rows = sharding.points(documents([(i, "w" * (i * 37 % 211), "en", f"s{i % 4}") for i in range(1200)])).cache()
    root = sharding.grow(rows, shards=7)
    seen = 0
    stack = [(root, F.lit(True))]
    while stack:
        node, inside = stack.pop()
        if not node.sides:
            continue
        low, high = node.sides
        left = inside & (F.col(node.dimension) <= F.lit(node.at))
        total, part, most = rows.filter(inside).agg(F.sum("size"), F.sum(F.when(left, F.col("size"))), F.max("size")).first()
        assert abs(part - total * low.shards / node.shards) <= most + 1
        seen += 1
        stack += [(low, left), (high, inside & (F.col(node.dimension) > F.lit(node.at)))]
    assert seen == 6


def test_rerun_on_other_partitions_is_equal(documents):
    rows = [(i, "w " * (i % 50)) for i in range(500)]
    one, two = (sorted(map(str, sharding.shard(documents(rows, p), shards=4).collect())) for p in (2, 6))
    assert one == two
