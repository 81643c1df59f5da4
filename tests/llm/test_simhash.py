import random

import xxhash

from tests.llm.conftest import table
from thresher.llm import simhash
from thresher.llm.common import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id over links at two bits or fewer, by all pairs."""
    label = dict.fromkeys(prints)
    for start in sorted(prints):
        if label[start] is None:
            stack = [start]
            while stack:
                x = stack.pop()
                if label[x] is None:
                    label[x] = start
                    stack += [y for y in prints if (prints[x] ^ prints[y]).bit_count() <= 2]
    return label


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice("one two three four five six seven eight nine ten".split()) + str(pick.randrange(40)) for _ in range(n))


def test_fingerprint_equals_plain_version(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    for text in (None, "", "  \t ", "One", "one  TWO", "a b c", "Ä ä b c d", prose(1, 500), "x " * 4000):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_equal_brute_force(spark, documents):
    rows = [(i, prose(i, 60)) for i in range(30)]
    long = prose(99, 3000)
    rows += [(100 + i, long + f" tail{i}") for i in range(20)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, long + " tail3"), (203, long + " tail3")]
    rows += [(None, long + " tail3"), (None, "alone and without id")]
    found = simhash.near_duplicates(documents(rows)).collect()
    assert len(found) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    want = plain_components(prints)
    assert len(set(want.values())) < len(want) - 15
    for row in found:
        if row.doc_id is not None:
            assert int(row.fingerprint, 16) == prints[row.doc_id]
            assert row.component_id == want[row.doc_id]
    lone = [r for r in found if r.doc_id is None]
    assert {r.component_id for r in lone} == {100, None}


def test_links_in_hot_blocks_equal_all_pairs(spark, monkeypatch):
    """Groups above the limit meet on midpoints and lose no pair."""
    monkeypatch.setattr(simhash, "GROUP_LIMIT", 5)
    pick = random.Random(3)
    values = {pick.getrandbits(20) for _ in range(60)}
    values |= {v ^ 1 << pick.randrange(64) for v in list(values)} | {v ^ 3 << pick.randrange(60) for v in list(values)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    found = {tuple(sorted((r.a, r.b))) for r in simhash.links(frame).collect()}
    want = {
        tuple(sorted((a, b)))
        for i, a in enumerate(signed)
        for b in signed[:i]
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    }
    assert found == want and want


def test_one_document_of_each_group_stays(documents):
    text = prose(5, 400)
    docs = documents([(4, text), (2, text), (2, text), (9, prose(6, 50)), (7, None), (8, "")])
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 9]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (300, 200), (200, 300)]
    found = table(components(spark.createDataFrame(edges, "a long, b long")), "node")
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 120)} | {300: 200}
    assert {k: v["component"] for k, v in found.items()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
