"""Run registered queries next to their oracles: rows, columns and values."""

from __future__ import annotations

import sys
import time
import traceback
from collections import Counter

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES
from thresher.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    ours = Counter(tuple(r[c] for c in columns) for r in frame.collect())
    if name not in ORACLES:
        return True, f"{sum(ours.values())} rows, no oracle"
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return False, f"columns {columns} / {sorted(names)}"
    places = [names.index(c) for c in columns]
    theirs = Counter(tuple(r[i] for i in places) for r in cursor.fetchall())
    if ours == theirs:
        return True, f"{sum(ours.values())} rows equal"
    only = list((ours - theirs).elements())
    other = list((theirs - ours).elements())
    return False, f"ours {sum(ours.values())}, theirs {sum(theirs.values())}\n  {sorted(map(str, only))[:2]}\n  {sorted(map(str, other))[:2]}"


def main(sf_dir: str, names: list[str]) -> int:
    spark, con, bad = local_session(8), connect(sf_dir), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            good, note = compare(spark, con, sf_dir, name)
        except Exception:
            good, note = False, traceback.format_exc()[-900:]
        bad += not good
        print(f"{'ok ' if good else 'BAD'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
