"""Headline timings; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as X
from checks.queries import QUERIES
from thresher.operators import match as M
from thresher.operators import mine as G
from thresher.plans.parse import parse_logs, parsed_wide
from thresher.session import local_session, materialize


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def matching(count: int, case_limit: int):
    """Lines against the first templates of the per-user libraries."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines, library = tables(spark, sf_dir)
        return M.match_templates(lines, library.filter(F.col("seq") <= count), case_limit=case_limit)

    return query


def variant(change, prefilter: bool = True):
    """Matching with the first 50 templates of each library written another way."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines, library = tables(spark, sf_dir)
        changed = library.filter(F.col("seq") <= 50).withColumn("regex", change(F.col("regex")))
        compiled = M.compiled_templates(changed)
        if not prefilter:
            # The same patterns without the literal checks in front of them.
            compiled = compiled.withColumn("mode", F.lit("java"))
        return M.match_compiled(lines, compiled)

    return query


def same(regex):
    return regex


def nonlinear(regex):
    return F.regexp_replace(regex, r"\(\?P<time>\.\*\)", r"(?P<time>\\S+ \\S+)")


def python_only(regex):
    return F.concat(F.lit("(?i)"), regex)


_TABLES: dict[str, tuple[DataFrame, DataFrame]] = {}


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines and library as stored tables, so that matching alone is timed."""
    if sf_dir not in _TABLES:
        library = X.user_templates(spark, sf_dir).withColumn("is_active", F.lit(True))
        _TABLES[sf_dir] = (
            materialize(X.host_lines(spark, sf_dir).repartition(16), "lines"),
            materialize(library, "library"),
        )
    return _TABLES[sf_dir]


def mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mine_candidates(tables(spark, sf_dir)[0])


def parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log sources from nothing: route, learn, match, extract (prose: see the query)."""
    parsed = parse_logs(X.many_sources(spark, sf_dir).filter(~F.col("source_id").startswith("src")))
    return parsed_wide(parsed.rows, parsed.templates)


HEADLINES = {
    "match_5_templates": matching(5, 200),
    "match_50_templates": matching(50, 200),
    "match_200_templates": matching(200, 200),
    "match_50_no_prefilter": variant(same, prefilter=False),
    "match_50_nonlinear": variant(nonlinear),
    "match_50_python": variant(python_only),
    "match_200_by_word": matching(200, 0),
    "match_all_by_word": matching(10**9, 0),
    "extract_variables": QUERIES["extract_variables"],
    "mine_candidates": mining,
    "mine_patterns_prose": QUERIES["mine_patterns_prose"],
    "classify_slots": QUERIES["classify_slots"],
    "template_usage": QUERIES["template_usage"],
    "parse_timestamps": QUERIES["parse_timestamps"],
    "parse_logs": QUERIES["parse_logs"],
    "parse_many_sources": parsing,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    tables(spark, sf_dir)
    run(matching(5, 200)(spark, sf_dir))  # not timed: the first query loads and compiles code
    seconds: dict[str, float] = {}
    for name, query in HEADLINES.items():
        start = time.perf_counter()
        run(query(spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    lines = tables(spark, sf_dir)[0].count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "log_lines": lines,
                "lines_per_second": {
                    name: round(lines / seconds[name])
                    for name in seconds
                    if name.startswith("match_")
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
