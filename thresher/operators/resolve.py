"""What happens to a candidate that fails its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thresher.functions.dialect import python_render, with_compiled
from thresher.functions import text as X
from thresher.operators.mine import OPEN_VALUES, build_candidates, slot_numbers
from thresher.operators.validate import validate_candidates
from thresher.schemas import LIBRARY_KEY

PERSISTS = "conflict persists after reconciliation attempts"


def resolve_replace(
    templates: DataFrame, examples: DataFrame, resolutions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``replace_conflicting``: listed templates become inactive, their examples go."""
    key = [*LIBRARY_KEY, "template_id"]
    replaced = (
        resolutions.select(*LIBRARY_KEY, F.explode("replaced_ids").alias("template_id"))
        .distinct()
        .withColumn("_replaced", F.lit(True))
    )
    library = (
        templates.join(replaced, key, "left")
        .withColumn("is_active", F.col("is_active") & F.col("_replaced").isNull())
        .select(*templates.columns)
    )
    gone = replaced.join(templates.select(*key), key, "left_semi").drop("_replaced")
    return library, examples.join(gone, key, "left_anti")


def only_open_slots(open_values: int = OPEN_VALUES) -> Column:
    """Every slot that is not a branch is proven to have more than ``open_values`` values."""
    opened = F.transform("slots", lambda s: s["values"] > open_values)
    return F.forall(F.zip_with(opened, "branches", lambda o, b: o | b), lambda ok: ok)


def resolve_refine(
    conflicting: DataFrame,
    examples: DataFrame,
    *,
    rounds: int | None = None,
    open_values: int = OPEN_VALUES,
) -> DataFrame:
    """``refine_candidate``: pin the most constant slots to the sample's words.

    Round ``n`` pins, besides the branches, the ``n`` closed slots with the fewest
    values (ties: first slot), up to all of them or the ``rounds`` of the caller. All
    rounds are built and checked together; the first valid one stays. Candidates without
    a valid round come back with the last one's reasons.
    """
    ranked = F.transform(
        F.array_sort(
            F.filter(
                F.transform(
                    slot_numbers(),
                    lambda i: F.struct(
                        F.get("slots", i)["values"].alias("values"),
                        i.alias("slot"),
                        F.get("branches", i).alias("fixed"),
                    ),
                ),
                lambda s: ~s["fixed"] & (s["values"] <= open_values),
            )
        ),
        lambda s: s["slot"],
    )
    last = F.size("_ranked") if rounds is None else F.lit(rounds)
    base = [
        "slots", "branches", "slot_values", "constants", "kinds", "raw", "transformed", "support",
        "source_id", "line_number", "pattern_id", "position", "candidate_id",
    ]
    variants = (
        conflicting.select(*LIBRARY_KEY, *base)
        .withColumn("_ranked", ranked)
        .filter(F.size("_ranked") > 0)
        .withColumn("attempt", F.explode(F.sequence(F.lit(1), F.least(last, F.size("_ranked")))))
        .withColumn("_pins", F.slice("_ranked", 1, F.col("attempt")))
    )
    pinned = F.transform(
        slot_numbers(), lambda i: F.get("branches", i) | F.array_contains("_pins", i)
    )
    keep_id = F.col("candidate_id")
    built = build_candidates(variants.withColumn("_id", keep_id), pinned).withColumn(
        "candidate_id", F.col("_id")
    )
    checked = validate_candidates(built.drop("_id", "_pins", "_ranked"), examples)
    return first_valid_attempt(checked, keys=[*LIBRARY_KEY, "candidate_id"], limit=rounds)


def first_valid_attempt(
    attempts: DataFrame,
    *,
    keys: list[str],
    limit: int | None = None,
) -> DataFrame:
    """Of each candidate's attempts (up to ``limit``), the first valid one, else the last."""
    order = Window.partitionBy(*keys).orderBy(
        F.col("is_valid").desc(), F.when(F.col("is_valid"), F.col("attempt")).otherwise(-F.col("attempt"))
    )
    return (
        (attempts if limit is None else attempts.filter(F.col("attempt") <= limit))
        .withColumn("_n", F.row_number().over(order))
        .filter("_n = 1")
        .drop("_n")
    )


def refine_invalid(
    proposals: DataFrame, examples: DataFrame, *, rounds: int | None = None
) -> DataFrame:
    """Replace invalid proposals by the candidate's next attempts, keeping its id.

    Attempt 0 is the proposal, the later ones (up to ``rounds``) its refinements.
    """
    checked = validate_candidates(with_compiled(proposals), examples)
    return first_valid_attempt(
        checked, keys=[*LIBRARY_KEY, "candidate_id"], limit=rounds
    )


def render_proposals(proposals: DataFrame, *, note_chars: int | None = None) -> DataFrame:
    """Template text, variables, constants, id and notes of proposed regexes.

    The notes are the whole reasoning, or its first ``note_chars`` characters.
    Rows whose regex is invalid or does not match the sample get a null template.
    """
    template = F.col("_r.template")
    notes = F.coalesce("reasoning", F.lit(""))
    if note_chars is not None:
        notes = F.substring(notes, 1, note_chars)
    return (
        proposals.withColumn("_r", python_render(F.col("regex"), F.col("transformed")))
        .withColumn("template", template)
        .withColumn("variables", F.col("_r.variables"))
        .withColumn("template_constants", X.extract_constants(template))
        .withColumn(
            "candidate_id",
            X.template_digest_id(F.col("device_type"), F.col("vendor"), template),
        )
        .withColumn("notes", notes)
        .drop("_r")
    )
