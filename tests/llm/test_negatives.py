import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thresher.llm import negatives as X

SCHEMA = "vec_id long, embedding array<float>, label int, slab string, part string, dims string, score string"


def vectors(spark, rows):
    """Rows (vec_id, embedding, label), with columns of clashing names."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def brute(rows, every, positives=5, negatives=3, low=50, high=95):
    """All scores in Python integers."""
    first = {}
    for name, vector, label in rows:
        if None in (name, vector, label) or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        key = (label, [float(np.float32(x)) for x in vector])
        first[name] = min(first.get(name, key), key)
    whole = {n: (label, [math.floor(256 * x) for x in v]) for n, (label, v) in first.items()}
    out = []
    for a in sorted(whole):
        if a % every:
            continue
        label, v = whole[a]
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w)), n, k)
            for n, (k, w) in whole.items()
            if n != a and len(w) == len(v)
        )
        for p, name, k in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p]
            out += [(a, name, i, s[1], -p, -s[0]) for i, s in enumerate(fit[:negatives], 1)]
    return sorted(out)


def found(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return sorted(rows)


def test_scan_reads_columns_until_windows_are_exact():
    """The bitmap shrinks before the last column, and what stays is right."""
    pick = np.random.default_rng(1)
    columns = np.floor(256 * pick.normal(size=(64, 2000)) * np.geomspace(1, 0.01, 64)[:, None])
    labels = np.sort(pick.integers(0, 4, 2000))
    slab = X.Slab(columns, np.arange(2000), labels)
    seen = []
    anchor = columns[:, 0]
    scores = anchor @ columns
    slab.scan(anchor, slab.same_label(0), lambda low, high: seen.append(len(low)) or highest_five(low, high))
    assert seen[0] > 10 * seen[-1]
    ids, best = slab.nearest(anchor, 0, 0, 5)
    own = [i for i in np.flatnonzero(labels == 0) if i]
    assert ids.tolist() == sorted(own, key=lambda i: (-scores[i], i))[:5] and (best == scores[ids]).all()


def highest_five(low, high):
    return high >= np.sort(low)[-5] if len(low) > 5 else np.ones(len(low), bool)


@pytest.mark.parametrize("slab_rows", [16, 16_384])
def test_equals_brute_force(spark, monkeypatch, slab_rows):
    """Random, tied, copied and skewed rows; one label holds a third."""
    monkeypatch.setattr(X, "SLAB_ROWS", slab_rows)
    monkeypatch.setattr(X, "ANCHOR_ROWS", slab_rows)
    pick = random.Random(5)
    rows = []
    for i in range(400):
        label = 0 if pick.random() < 0.33 else pick.randrange(1, 6)
        vector = [pick.gauss(1 if j == label else 0, 0.6) for j in range(12)]
        rows.append((i, vector if i % 5 else [float(round(x)) for x in vector], label))
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(60)]
    frame = vectors(spark, rows)
    assert found(X.mine(frame, F.col("vec_id") % 10 == 0)) == brute(rows, 10)
    wide = X.mine(frame, F.col("vec_id") % 40 == 0, positives=2, negatives=9, low=20, high=110)
    assert found(wide) == brute(rows, 40, 2, 9, 20, 110)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (50, [1.0, 2.0], 1), (51, [1.0, 1.0], 2), (52, [0.7, 1.4], 3), (53, [0.0, 0.0], 2),
        (54, None, 1), (55, [None, 1.0], 1), (56, [nan, 1.0], 1), (57, [inf, 1.0], 1), (58, [1.0, 1.5], None),
        (None, [1.0, 2.0], 1), (59, [], 1), (60, [1.0, 2.0, 3.0], 2), (51, [0.9, 1.2], 2), (100, [-1.0, 0.1], 1),
        (150, [0.0, 0.0], 2), (200, [5.0, 5.0], 9), (61, [3.0, 2.0, 1.0], 7), (250, [1.0, 1.0, 1.0], 7), (0, [1.0, 2.0], 1),
    ]
    assert found(X.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0)) == brute(rows, 50) != []
    assert found(X.mine(vectors(spark, []), F.col("vec_id") % 50 == 0)) == []
    assert found(X.mine(vectors(spark, rows), F.col("vec_id") == 7)) == []


def test_large_components_stay_exact(spark):
    """Scores beyond the whole numbers of a double; beyond 64 bits nothing fails."""
    rows = [(i, [1e6 + 1000.25 * i, 3e5 - 7000.5 * i, 2.0**20], i % 2) for i in range(40)]
    got = found(X.mine(vectors(spark, rows), F.col("vec_id") % 5 == 0, low=10, high=100))
    assert got == brute(rows, 5, low=10, high=100) and max(r[4] for r in got) > 2**53
    rows += [(50, [1e30, 1.0, 1.0], 0)]
    assert X.mine(vectors(spark, rows), F.col("vec_id") == 50, low=0, high=100).count() == 0
    data, kind = X.pack(np.array([[1e9, -3.5]]))
    assert kind == "<f8" and X.unpack(data, kind, 2).ravel().tolist() == [256e9, -896.0]
