import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
from tokenizers import Tokenizer

from thresher.llm import packing


def all_ids(text):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, found, window, cut=False):
    """Every id in exactly one piece, sequences gapless within the window, right ids."""
    ids = {i: all_ids(t) for i, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    copies = Counter(i for i, _ in rows)
    for i, n in copies.items():
        covered = Counter(at for r in by_doc[i] for at in range(r.start, r.start + r.length))
        assert covered == Counter({at: n for at in range(len(ids[i]))})
        if not cut:
            assert sum(r.length == window for r in by_doc[i]) >= len(ids[i]) // window * n
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and all(r.sequence_tokens == at for r in parts)
    return by_sequence


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice("alpha Beta gamma, delta. Épsilon 42 don't\n\n  zeta!".split(" ")) for _ in range(n))


def test_pieces_and_sequences(documents):
    rows = [(i, prose(i, i * 7 % 400)) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "<|endoftext|> is text"), (503, prose(3, 9000)), (504, "日本語 🙂 \x00"), (7, prose(7, 49)), (7, prose(7, 49)), (None, "no id")]
    rows += [(600 + i, "same text") for i in range(200)]
    found = packing.pack(documents(rows), window=256).collect()
    sequences = check(rows, found, 256)
    assert sum(r.length for r in found) / (256 * len(sequences)) > 0.985


def test_same_ids_as_the_file_s_own_library():
    encode = packing.encoder(packing.default_tokenizer())
    for text in ("", "a", "Hello  world\t\n x", "ÄÖ ß€ 🙂", "'s 'LL 12345", "\x00\x7f\x80", "<|endoftext|>", "a <|endoftext|> b\n<|endoftext|><|endoftext", prose(1, 300), "x" * 5000):
        assert encode(text) + [1] == all_ids(text)


@pytest.mark.parametrize("seed", range(8))
def test_fill_is_the_best_multiset(seed):
    pick = random.Random(seed)
    counts = {pick.randrange(3, 40): pick.randrange(1, 4) for _ in range(5)}
    room = pick.randrange(5, 70)
    sums = {0}
    for n in range(1, 8):
        for combo in combinations_with_replacement(counts, n):
            if all(combo.count(x) <= counts[x] for x in combo) and sum(combo) <= room:
                sums.add(sum(combo))
    got = packing.fill(counts, room)
    assert sum(x * k for x, k in got) == max(sums) and all(k <= counts[x] for x, k in got)


@pytest.mark.parametrize("hot", [0, 300, 700, 1030])
def test_plan_uses_each_remainder_once(hot):
    pick = random.Random(2)
    histogram = Counter(min(2047, int(pick.expovariate(1 / 500)) + 1) for _ in range(50_000))
    histogram[hot or 9] += 30_000
    rules = packing.plan(dict(histogram))
    ranges = defaultdict(list)
    for length, low, high, *_ in rules:
        ranges[length].append((low, high))
    for length, parts in ranges.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == histogram[length]
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    tokens = sum(k * v for k, v in histogram.items())
    sequences = sum((r[2] - r[1]) // r[4] for r in rules if r[4] and not r[5])
    sequences += -(-max((r[6] for r in rules if not r[4]), default=0) // 2048)
    assert tokens / (sequences * 2048) > 0.999


def test_tail_is_cut_where_windows_are_full(documents):
    """Copies that cannot fill a window together are laid end to end and cut."""
    text = "same words in every text " * 20
    rows = [(i, text) for i in range(150)] + [(900 + i, "tiny") for i in range(3)] + [(None, text), (3, text)]
    sequences = check(rows, packing.pack(documents(rows), window=256).collect(), 256, cut=True)
    tokens = sum(len(all_ids(t)) for _, t in rows)
    assert len(sequences) == -(-tokens // 256)


def test_empty_table(documents):
    assert packing.pack(documents([])).collect() == []


def test_rules_need_no_python_workers(spark, documents, monkeypatch):
    """The plan's rules reach Spark as Arrow; a list would start Python workers of another kind."""
    rows = [(i, prose(i, 20 + i)) for i in range(30)]
    docs = documents(rows)
    monkeypatch.delattr(type(spark.sparkContext), "parallelize")
    check(rows, packing.pack(docs, window=256).collect(), 256)
