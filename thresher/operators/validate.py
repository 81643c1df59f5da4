"""Checks a candidate template passes before it enters a library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thresher.functions import dialect
from thresher.operators.match import GRAM_MARK, line_keys, template_keys
from thresher.schemas import LIBRARY_KEY
from thresher.session import bounded, materialize

BROADCAST_LIMIT = 256 << 20
# Examples of one key that a task of the join gets.
HOT_EXAMPLES = 100_000

# The texts of the reasons.
INVALID_REGEX = "invalid regex produced by LLM ({})"
NOT_OWN_SAMPLE = "generated regex does not match the source sample"
CONFLICTS = "conflicts with existing templates: "


def detect_conflicts(
    candidates: DataFrame,
    examples: DataFrame,
    *,
    max_checks: int | None = None,
    max_conflicts: int | None = None,
) -> DataFrame:
    """Add ``conflicting_template_ids``: other templates whose example a candidate matches.

    ``candidates`` hold the compiled columns, ``candidate_id`` and, optionally,
    ``position``: then only examples before that position count. All examples of the
    library are compared and all conflicts listed, in order of position, unless a
    caller limits them: ``max_checks`` examples of other templates from the first on.

    A candidate meets the examples that hold its rarest required word or, without a
    whole word, the rarest three characters of its constants; without a gap, those that
    are its text. Only a candidate that requires none of these meets all of its library.
    """
    rows = materialize(
        candidates.withColumn("_row", F.monotonically_increasing_id()), "candidates"
    )
    shown = examples.select(*LIBRARY_KEY, "position", "template_id", "transformed")
    if max_checks is not None:
        order = Window.partitionBy(*LIBRARY_KEY).orderBy("position")
        shown = shown.withColumn("_n", F.row_number().over(order)).filter(
            F.col("_n") <= max_checks + 1
        )
    pairs = _pairs(rows, materialize(shown, "examples"))
    pairs = pairs.filter(F.col("template_id") != F.col("candidate_id"))
    if "position" in candidates.columns:
        pairs = pairs.filter(F.col("position") < F.col("_before"))
    if max_checks is not None:
        own = shown.select(
            *LIBRARY_KEY, F.col("template_id").alias("candidate_id"), F.col("_n").alias("_own")
        )
        pairs = pairs.join(own, [*LIBRARY_KEY, "candidate_id"], "left").filter(
            F.col("_n") - F.coalesce(F.col("_own") < F.col("_n"), F.lit(False)).cast("int")
            <= max_checks
        )
    text, mode = F.col("transformed"), F.col("mode")
    hits = pairs.filter(mode != "python").filter(dialect.matches(text, F.col("test")))
    kept = ["_row", "position", "template_id"]
    found = hits.select(*kept)
    if not rows.filter("mode = 'python'").isEmpty():
        slow = pairs.filter(mode == "python").filter(
            dialect.python_fullmatch(F.col("regex"), text)
        )
        found = found.unionByName(slow.select(*kept))
    ids = F.transform(
        F.array_sort(F.collect_list(F.struct("position", "template_id"))),
        lambda e: e["template_id"],
    )
    listed = found.groupBy("_row").agg(ids.alias("_ids"))
    ids = F.coalesce("_ids", F.array().cast("array<string>"))
    if max_conflicts is not None:
        ids = F.slice(ids, 1, max_conflicts)
    return (
        rows.join(listed, "_row", "left")
        .withColumn("conflicting_template_ids", ids)
        .drop("_row", "_ids")
    )


def _pairs(rows: DataFrame, examples: DataFrame) -> DataFrame:
    """Valid candidates next to the examples that may match them."""
    before = F.col("position") if "position" in rows.columns else F.lit(None).cast("bigint")
    asked = rows.filter("valid").select(
        *LIBRARY_KEY, F.col("_row").alias("seq"), "candidate_id", before.alias("_before"),
        "mode", "test", "regex", "words", "segments",
    )
    filed = materialize(template_keys(asked), "filed")
    grams = not filed.filter(F.startswith("anchor", F.lit(GRAM_MARK))).isEmpty()
    place = [*LIBRARY_KEY, "anchor"]
    wanted = _small(filed.select(*place).distinct(), place)
    keys = F.explode(line_keys(F.col("transformed"), grams)).alias("anchor")
    spelled = examples.select("*", keys).join(wanted, place, "left_semi")
    counts = materialize(spelled.groupBy(*place).agg(F.count(F.lit(1)).alias("n")), "counts")
    # A required key that no example holds rules all of them out.
    rarest = (
        filed.join(counts, place, "left")
        .groupBy(*LIBRARY_KEY, "seq")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "anchor")).alias("b"))
        .filter("b.n > 0")
        .select(*LIBRARY_KEY, "seq", F.col("b.anchor").alias("anchor"))
    )
    runs = asked.drop("words", "segments").join(rarest, [*LIBRARY_KEY, "seq"]).withColumnRenamed("seq", "_row")
    runs, small = _measured(runs, ["regex", "test", "candidate_id"])
    columns = [*examples.columns, "_row", "candidate_id", "_before", "mode", "test", "regex"]
    if not small:
        # An example's text is copied only for the keys that a candidate is filed under.
        spelled = spelled.join(_small(rarest.select(*place).distinct(), place), place, "left_semi")
        # A key that many examples share is dealt into salts; its candidates are copied.
        hot = counts.filter(F.col("n") > HOT_EXAMPLES)
        hot = _small(hot.select(*place, F.ceil(F.col("n") / HOT_EXAMPLES).cast("int").alias("salts")), place)
        salts = F.coalesce("salts", F.lit(1))
        copied = F.explode(F.sequence(F.lit(0), salts - 1))
        runs = runs.join(hot, place, "left").withColumn("salt", copied).drop("salts")
        dealt = F.pmod(F.xxhash64("template_id", "position", "transformed"), salts).cast("int")
        spelled = spelled.join(hot, place, "left").withColumn("salt", dealt).drop("salts")
        place = [*place, "salt"]
    return spelled.join(runs, place).select(*columns)


def _measured(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, bool]:
    """The rows as a table, broadcast if measured small, and whether it is."""
    table = materialize(rows, "asked")
    small = bounded(table, columns, BROADCAST_LIMIT)
    return (F.broadcast(table) if small else table), small


def _small(rows: DataFrame, columns: list[str]) -> DataFrame:
    return _measured(rows, columns)[0]


def validate_candidates(
    candidates: DataFrame, examples: DataFrame, *, shown: int | None = None, **caps
) -> DataFrame:
    """Add ``is_valid``, ``reasons`` and ``conflicting_template_ids``.

    The reason names all templates in conflict, or the first ``shown``. A regex must compile, fully match its own sample (``transformed``) and match
    no other template's example; the first failing check is the reason.
    """
    checked = detect_conflicts(with_own_sample(candidates), examples, **caps)
    ids = F.when(
        F.col("own_sample"), F.col("conflicting_template_ids")
    ).otherwise(F.array().cast("array<string>"))
    named = ids if shown is None else F.slice(ids, 1, shown)
    reason = (
        F.when(~F.col("valid"), F.format_string(INVALID_REGEX.replace("{}", "%s"), F.col("error")))
        .when(~F.col("own_sample"), F.lit(NOT_OWN_SAMPLE))
        .when(
            F.size(ids) > 0,
            F.concat(F.lit(CONFLICTS), F.array_join(named, ", ")),
        )
    )
    return (
        checked.withColumn("conflicting_template_ids", ids)
        .withColumn("reasons", F.array_compact(F.array(reason)))
        .withColumn("is_valid", F.size("reasons") == 0)
        .drop("own_sample")
    )


def with_own_sample(candidates: DataFrame) -> DataFrame:
    """Add ``own_sample``: the regex fully matches the line it came from."""
    text = F.col("transformed")
    native = F.when(
        F.col("mode").isin("linear", "java"), dialect.matches(text, F.col("test"))
    )
    if not candidates.filter("mode = 'python'").isEmpty():
        python = F.when(F.col("mode") == "python", F.col("regex"))
        native = F.coalesce(native, dialect.python_fullmatch(python, text))
    return candidates.withColumn("own_sample", F.coalesce(native, F.lit(False)))


def conflict_pairs(validated: DataFrame, templates: DataFrame, examples: DataFrame) -> DataFrame:
    """Conflicts with the template record and the example; others are dropped."""
    conflicts = validated.select(
        *LIBRARY_KEY,
        "candidate_id",
        F.posexplode("conflicting_template_ids").alias("conflict_no", "template_id"),
    )
    key = [*LIBRARY_KEY, "template_id"]
    return conflicts.join(templates.select(*key, "regex", "template"), key).join(
        examples.select(*key, F.col("transformed").alias("example")), key
    )
