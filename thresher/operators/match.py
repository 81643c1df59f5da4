"""Lines x templates: first active template in library order wins."""

from __future__ import annotations

import re
from heapq import merge
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from thresher.functions import dialect
from thresher.schemas import LIBRARY_KEY, LINE_KEY
from thresher.session import bounded, materialize

# Up to this many templates a generated CASE expression is used: no shuffle.
CASE_LIMIT = 200
BROADCAST_LIMIT = 256 << 20
# Bytes of templates that every Python task can hold.
TASK_INDEX_LIMIT = 64 << 20
RUNNABLE = ["regex", "mode", "test", "capture", "names", "segments", "words"]
WORD_SPLIT = "[^A-Za-z0-9]+"
# A template without a whole word is found by so many characters of a constant.
GRAM = 3
GRAM_MARK = "\x00"
# A template without a gap is found by a digest of its whole text.
WHOLE_MARK = "\x01"
# Lines of one key that a task of the join gets.
HOT_LINES = 100_000


def active_templates(templates: DataFrame) -> DataFrame:
    """What matching needs of a library: order, id and regex of active templates."""
    return templates.filter("is_active").select(*LIBRARY_KEY, "seq", "template_id", "regex")


def valid_regex(templates: DataFrame) -> DataFrame:
    """Templates with ``valid`` and, where the regex does not compile, ``error``."""
    return dialect.with_compiled(templates).select(*templates.columns, "valid", "error")


def compiled_templates(templates: DataFrame) -> DataFrame:
    """Active templates with a valid regex and the columns that run them."""
    return dialect.with_compiled(active_templates(templates)).filter("valid").drop("error", "valid")


def match_templates(
    lines: DataFrame,
    templates: DataFrame,
    *,
    variables: bool = False,
    case_limit: int = CASE_LIMIT,
) -> DataFrame:
    """Add ``template_id`` (null if none) and, on request, ``variables``.

    ``lines`` carry ``source_id, line_number, transformed`` and the
    ``device_type, vendor`` of their library.
    """
    return match_compiled(
        lines,
        compiled_templates(templates),
        variables=variables,
        case_limit=_limit(templates.filter("is_active"), case_limit),
    )


def _limit(templates: DataFrame, case_limit: int) -> int:
    """0 if there are more templates: known before any regex is compiled."""
    return case_limit if templates.limit(case_limit + 1).count() <= case_limit else 0


def match_compiled(
    lines: DataFrame,
    compiled: DataFrame,
    *,
    variables: bool = False,
    case_limit: int = CASE_LIMIT,
) -> DataFrame:
    """`match_templates` for a table that already has the compiled columns."""
    few = _few(compiled, case_limit)
    out = _match_by_word(lines, compiled) if few is None else _match_by_case(lines, few)
    if not variables:
        return out
    return _with_case_variables(out, few) if few is not None else _join_variables(out, compiled)


def _few(compiled: DataFrame, case_limit: int) -> list[Row] | None:
    """The templates if there are at most ``case_limit`` of them."""
    rows = compiled.limit(case_limit + 1).collect() if case_limit else []
    return rows if case_limit and len(rows) <= case_limit else None


def with_variables(
    assigned: DataFrame, templates: DataFrame, *, case_limit: int = CASE_LIMIT
) -> DataFrame:
    """Add the captured values to lines that already have their template."""
    compiled = compiled_templates(templates.withColumn("is_active", F.lit(True)))
    few = _few(compiled, _limit(templates, case_limit))
    return (
        _join_variables(assigned, compiled) if few is None else _with_case_variables(assigned, few)
    )


# --- small libraries: one generated expression ------------------------------


def _in_library(device_type: str, vendor: str) -> Column:
    return (F.col("device_type") == device_type) & (F.col("vendor") == vendor)


def _libraries(rows: list[Row]) -> dict[tuple[str, str], list[Row]]:
    groups: dict[tuple[str, str], list[Row]] = {}
    for row in sorted(rows, key=lambda r: (r.device_type, r.vendor, r.seq)):
        groups.setdefault((row.device_type, row.vendor), []).append(row)
    return groups


def _when_chain(branches: list[tuple[Column, Column]], kind: str) -> Column:
    if not branches:
        return F.lit(None).cast(kind)
    chain = F.when(*branches[0])
    for condition, value in branches[1:]:
        chain = chain.when(condition, value)
    return chain


def _match_by_case(lines: DataFrame, rows: list[Row]) -> DataFrame:
    """A generated CASE of the native templates, then one look at the Python ones.

    The CASE gives the place of the first native match in its library. Python
    templates see only lines that a native template has not already decided: those
    ahead of the native match are tried in library order, in one function.
    """
    text = F.col("transformed")
    places, ids, python = [], [], {}
    for key, group in _libraries(rows).items():
        branches = [
            (dialect.literal_matches(text, r["mode"], r.test, r.segments), F.lit(i))
            for i, r in enumerate(group)
            if r["mode"] != "python"
        ]
        places.append((_in_library(*key), _when_chain(branches, "int")))
        ids.append((_in_library(*key), F.array(*[F.lit(r.template_id) for r in group])))
        slow = [
            (i, dialect.Matcher(r["mode"], r.regex, r.segments))
            for i, r in enumerate(group)
            if r["mode"] == "python"
        ]
        if slow:
            python[key] = slow
    out = lines.withColumn("_at", _evaluated_once(_when_chain(places, "int")))
    if python:
        undecided = _when_chain(
            [(_in_library(*key), F.coalesce(F.col("_at") > slow[0][0], F.lit(True))) for key, slow in python.items()],
            "boolean",
        )
        at = F.coalesce("_at", F.lit(_LAST))
        found = _first_python(python)("device_type", "vendor", F.when(undecided, text), at)
        out = out.withColumn("_at", F.coalesce(found, "_at"))
    named = F.get(_when_chain(ids, "array<string>"), F.col("_at"))
    return out.withColumn("template_id", named).drop("_at")


_LAST = 2**31 - 1


def _first_python(python: dict):
    """The first Python template ahead of the place given; null texts are not looked at."""

    @F.pandas_udf("int")
    def find(device: pd.Series, vendor: pd.Series, text: pd.Series, at: pd.Series) -> pd.Series:
        def first(key, line, last):
            if line is None:
                return None
            return next((i for i, holds in python.get(key, ()) if i < last and holds(line)), None)

        found = [first((d, v), t, a) for d, v, t, a in zip(device, vendor, text, at)]
        return pd.Series(found, dtype="Int32")

    return find.asNondeterministic()


def _evaluated_once(column: Column) -> Column:
    """Keep the optimizer from copying a costly expression.

    A filter on a projected column is pushed below the projection with the whole
    expression in it, which here would repeat the matching and, within it, the
    normalization for every template. Filters stop at a generator.
    """
    return F.explode(F.array(column))


def _with_case_variables(assigned: DataFrame, rows: list[Row]) -> DataFrame:
    """Captures by a CASE on the template; Python templates share one function, which
    gets the texts of their own lines only."""
    text, chains, own = F.col("transformed"), [], []
    python = []
    for key, group in _libraries(rows).items():
        slow = [r for r in group if r["mode"] == "python"]
        branches = [
            (
                F.col("template_id") == r.template_id,
                dialect.literal_captured(text, r["mode"], r.capture, r.names),
            )
            for r in group
            if r["mode"] != "python"
        ]
        chains.append((_in_library(*key), _when_chain(branches, "map<string,string>")))
        places = [(F.col("template_id") == r.template_id, F.lit(len(python) + i)) for i, r in enumerate(slow)]
        own.append((_in_library(*key), _when_chain(places, "int")))
        python += [r.regex for r in slow]
    values = _when_chain(chains, "map<string,string>")
    out = assigned
    if python:
        number = _when_chain(own, "int")
        out = assigned.withColumn("_python", _python_captures(python)(number, F.when(number.isNotNull(), text)))
        values = F.coalesce(values, "_python")
    return out.withColumn("variables", F.coalesce(values, dialect.empty_map())).drop("_python")


def _python_captures(regexes: list[str]):
    """The groups of the template with the number given; null where there is none."""

    @F.pandas_udf(dialect.VARIABLES)
    def captured(number: pd.Series, text: pd.Series) -> pd.Series:
        runs = [re.compile(r) for r in regexes]

        def groups(n, t):
            found = None if t is None or pd.isna(n) else runs[int(n)].fullmatch(t)
            return None if found is None else found.groupdict()

        return pd.Series([groups(n, t) for n, t in zip(number, text)], dtype=object)

    return captured.asNondeterministic()


# --- large libraries: an index on text both sides must share ------------------


def with_anchor(compiled: DataFrame) -> DataFrame:
    """The text of each template that the fewest templates of the library share.

    ``anchor`` is a whole word of its constants. A template without one has, in
    ``literal``, a constant that stands anywhere in its lines, of two or more the one
    that fewest such templates share, then the longest; both are ``''`` if it has none.
    """
    key = [*LIBRARY_KEY, "seq"]
    words = compiled.select(*key, F.explode("words").alias("text"), F.lit(True).alias("whole"))
    pieces = compiled.filter((F.size("words") == 0) & (F.col("mode") == "linear")).select(
        *key, F.explode(F.array_distinct("segments")).alias("text"), F.lit(False).alias("whole")
    )
    texts = words.unionByName(pieces.filter("text <> ''"))
    place = [*LIBRARY_KEY, "text", "whole"]
    shared = texts.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    best = (
        texts.join(shared, place)
        .groupBy(*key)
        .agg(F.min(F.struct("n", -F.length("text"), "text", "whole")).alias("b"))
        .select(
            *key,
            F.when(F.col("b.whole"), F.col("b.text")).alias("anchor"),
            F.when(~F.col("b.whole"), F.col("b.text")).alias("literal"),
        )
    )
    return compiled.join(best, key, "left").fillna("", ["anchor", "literal"])


def _match_by_word(lines: DataFrame, compiled: DataFrame) -> DataFrame:
    # Both tables are read several times: compile and choose the words once.
    table = materialize(_first_of_regex(compiled), "compiled")
    if fits_in_tasks(table):
        return _match_in_tasks(lines, materialize(with_anchor(table), "index"))
    return _match_by_join(lines, table)


def _first_of_regex(compiled: DataFrame) -> DataFrame:
    """The first template of each regex of a library: a later one never takes a line."""
    kept = [c for c in (*RUNNABLE, "seq", "template_id") if c != "regex"]
    first = F.min_by(F.struct(*kept), F.struct("seq", "template_id")).alias("t")
    return compiled.groupBy(*LIBRARY_KEY, "regex").agg(first).select(*LIBRARY_KEY, "regex", "t.*")


def fits_in_tasks(compiled: DataFrame) -> bool:
    """Whether every task can hold the index of these templates; measured."""
    return bounded(compiled, ["regex", "regex", "template_id", F.array_join("segments", "")], TASK_INDEX_LIMIT)


class _Index:
    """A library in a task: templates by the word, or by the constant, that a line must hold."""

    def __init__(self) -> None:
        self.words: dict[str, list] = {}
        self.pieces: dict[str, list] = {}
        self.always: list = []
        self._scan = None

    def add(self, anchor: str, literal: str, entry: tuple) -> None:
        place = self.words.setdefault(anchor, []) if anchor else None
        place = self.pieces.setdefault(literal, []) if place is None and literal else place
        (self.always if place is None else place).append(entry)

    def first(self, line: str) -> str | None:
        """The first template in library order that holds."""
        lists = [self.words[w] for w in {*_SPLIT(line)} if w in self.words]
        if self.pieces:
            self._scan = self._scan or _automaton(self.pieces)
            found = {literal for _, literal in self._scan.iter(line)}
            lists += [self.pieces[literal] for literal in found]
        if self.always:
            lists.append(self.always)
        return next((name for _, name, holds in merge(*lists, key=_SEQ) if holds(line)), None)

    def __getstate__(self):
        return self.__dict__ | {"_scan": None}


def _automaton(literals):
    """One pass over a line finds all constants it holds, however many there are."""
    import ahocorasick

    scan = ahocorasick.Automaton()
    for literal in literals:
        scan.add_word(literal, literal)
    scan.make_automaton()
    return scan


def _match_in_tasks(lines: DataFrame, index: DataFrame) -> DataFrame:
    """Map-only: every task holds the measured index as text -> templates in order.

    A line looks up its words, and an automaton finds the constants that are no whole
    words; the templates filed there are merged and the first that matches is taken. No
    line is exchanged, and only templates without any constant meet every line.
    """
    table: dict[tuple[str, str], _Index] = {}
    rows = index.select(*LIBRARY_KEY, "anchor", "literal", "seq", "template_id", "mode", "regex", "segments")
    for r in sorted(rows.collect(), key=lambda r: r.seq):
        entry = (r.seq, r.template_id, dialect.Matcher(r["mode"], r.regex, r.segments))
        table.setdefault((r.device_type, r.vendor), _Index()).add(r.anchor, r.literal, entry)
    shared = lines.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("string")
    def assign(device: pd.Series, vendor: pd.Series, text: pd.Series) -> pd.Series:
        def first(key, line):
            library = shared.value.get(key)
            return None if library is None or line is None else library.first(line)

        return pd.Series([first((d, v), t) for d, v, t in zip(device, vendor, text)], dtype=object)

    return lines.withColumn(
        "template_id", assign.asNondeterministic()("device_type", "vendor", "transformed")
    )


_SEQ = itemgetter(0)
_SPLIT = re.compile(WORD_SPLIT).split


def whole_key(text: Column) -> Column:
    return F.concat(F.lit(WHOLE_MARK), F.md5(text.cast("binary")))


def line_keys(text: Column, grams: bool) -> Column:
    """What a line can be found by: its words, ``''``, its whole text and, if asked, its marked grams."""
    keys = F.array_union(F.split(text, WORD_SPLIT), F.array(F.lit(""), whole_key(text)))
    if not grams:
        return keys
    places = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    found = F.transform(places, lambda i: F.concat(F.lit(GRAM_MARK), F.substring(text, i, F.lit(GRAM))))
    return F.array_union(keys, F.when(F.length(text) >= GRAM, found).otherwise(F.array().cast("array<string>")))


def template_keys(index: DataFrame) -> DataFrame:
    """Every key a template may be filed under: its words, or the grams of its constants.

    A template without a gap has one key, its whole text.
    """
    pieces = F.filter("segments", lambda s: F.length(s) >= GRAM)
    grams = F.flatten(
        F.transform(
            pieces,
            lambda s: F.transform(
                F.sequence(F.lit(1), F.length(s) - (GRAM - 1)),
                lambda i: F.concat(F.lit(GRAM_MARK), F.substring(s, i, F.lit(GRAM))),
            ),
        )
    )
    linear = F.col("mode") == "linear"
    own = (
        F.when(linear & (F.size("segments") == 1), F.array(whole_key(F.get("segments", 0))))
        .when(F.size("words") > 0, F.col("words"))
        .when(linear & (F.size(pieces) > 0), F.array_distinct(grams))
    )
    return index.select(*LIBRARY_KEY, "seq", F.explode(F.coalesce(own, F.array(F.lit("")))).alias("anchor"))


def _match_by_join(lines: DataFrame, index: DataFrame) -> DataFrame:
    """For an index too large for a task: an equi-join on a key, then the regex.

    A template is filed under the one of its words (or, without a whole word, of its
    constants' grams) that the fewest *lines* hold; lines are counted by the keys that
    templates have, with partial sums. A line's text is copied only for the keys that a
    template is filed under, not for each of its words. A key of more than ``HOT_LINES``
    lines is dealt into salts: its lines by a hash, its templates copied, so no task gets
    them all.
    """
    text = F.col("transformed")
    filed = materialize(template_keys(index), "filed")
    grams = not filed.filter(F.startswith("anchor", F.lit(GRAM_MARK))).isEmpty()
    place = [*LIBRARY_KEY, "anchor"]
    asked = filed.select(*place).distinct()
    if bounded(asked, place, BROADCAST_LIMIT):
        asked = F.broadcast(asked)
    keyed = lines.select(
        *LINE_KEY, *LIBRARY_KEY, "transformed", F.explode(line_keys(text, grams)).alias("anchor")
    ).join(asked, place, "left_semi")
    counts = materialize(keyed.groupBy(*place).agg(F.count(F.lit(1)).alias("n")), "counts")
    chosen = (
        filed.join(counts, place, "left")
        .groupBy(*LIBRARY_KEY, "seq")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), -F.length("anchor"), "anchor")).alias("b"))
        .select(*LIBRARY_KEY, "seq", F.col("b.anchor").alias("anchor"))
    )
    chosen = materialize(chosen, "chosen")
    used = chosen.select(*place).distinct()
    if bounded(used, place, BROADCAST_LIMIT):
        used = F.broadcast(used)
    hot = counts.filter(F.col("n") > HOT_LINES).select(
        *place, F.ceil(F.col("n") / HOT_LINES).cast("int").alias("salts")
    )
    # At most one key in HOT_LINES of all words of all lines.
    hot = materialize(hot, "hot")
    if bounded(hot, place, BROADCAST_LIMIT):
        hot = F.broadcast(hot)
    salts = F.coalesce("salts", F.lit(1))
    runs = (
        index.select(*LIBRARY_KEY, "seq", "mode", "test", "regex")
        .join(chosen, [*LIBRARY_KEY, "seq"])
        .join(hot, place, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("salts")
    )
    dealt = keyed.join(used, place, "left_semi").join(hot, place, "left").withColumn(
        "salt", F.pmod(F.xxhash64(*LINE_KEY), salts).cast("int")
    )
    pairs = dealt.drop("salts").join(runs, [*place, "salt"])
    native = pairs.filter(F.col("mode") != "python").filter(dialect.matches(text, F.col("test")))
    hits = native.select(*LINE_KEY, *LIBRARY_KEY, "seq")
    if _has_python(index):
        other = pairs.filter("mode = 'python'").filter(
            dialect.python_fullmatch(F.col("regex"), text)
        )
        hits = hits.unionByName(other.select(*LINE_KEY, *LIBRARY_KEY, "seq"))
    # Only narrow columns are exchanged, after a partial minimum.
    winners = hits.groupBy(*LINE_KEY, *LIBRARY_KEY).agg(F.min("seq").alias("seq"))
    named = winners.join(
        index.select(*LIBRARY_KEY, "seq", "template_id"), [*LIBRARY_KEY, "seq"]
    ).select(*LINE_KEY, "template_id")
    return lines.join(named, LINE_KEY, "left").select(*lines.columns, "template_id")


def _has_python(compiled: DataFrame) -> bool:
    return not compiled.filter("mode = 'python'").isEmpty()


def _join_variables(assigned: DataFrame, compiled: DataFrame) -> DataFrame:
    """Captures by a join on the template; a hot template is no problem while the
    templates are broadcast, and is split by the adaptive skew join otherwise."""
    runs = compiled.select(*LIBRARY_KEY, "template_id", "mode", "capture", "names", "regex")
    if bounded(runs, ["regex", "capture", "template_id"], BROADCAST_LIMIT):
        runs = F.broadcast(runs)
    text, mode = F.col("transformed"), F.col("mode")
    values = F.when(
        mode.isin("linear", "java"),
        dialect.captured(text, mode, F.col("capture"), F.col("names")),
    )
    if _has_python(compiled):
        regex = F.when(mode == "python", F.col("regex"))
        values = F.coalesce(values, dialect.python_groups(regex, text))
    return assigned.join(runs, [*LIBRARY_KEY, "template_id"], "left").select(
        *assigned.columns, F.coalesce(values, dialect.empty_map()).alias("variables")
    )


def extract_variables(lines: DataFrame, templates: DataFrame, **options) -> DataFrame:
    """Matched lines with the captured values of their template."""
    out = match_templates(lines, templates, variables=True, **options)
    return out.filter(F.col("template_id").isNotNull())


def rematch_remaining(
    remaining: DataFrame, templates: DataFrame, **options
) -> tuple[DataFrame, DataFrame]:
    """(newly matched, still unmatched) after the library has grown."""
    out = match_templates(remaining, templates, **options)
    found = F.col("template_id").isNotNull()
    return out.filter(found), out.filter(~found)


def first_examples(assigned: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """First matching line of each template; an example already known is kept."""
    key = [*LIBRARY_KEY, "template_id"]
    matched = assigned.filter(F.col("template_id").isNotNull())
    # Numbers first (hash aggregation), then the texts of the chosen lines only.
    per_source = matched.groupBy(*key, "source_id").agg(F.min("line_number").alias("line_number"))
    first = per_source.groupBy(*key).agg(F.min(F.struct("source_id", "line_number")).alias("f"))
    chosen = materialize(first.select(*key, "f.source_id", "f.line_number"), "first_lines")
    if bounded(chosen, [*key, "source_id"], BROADCAST_LIMIT):
        chosen = F.broadcast(chosen)
    found = matched.select(*LINE_KEY, *key, "raw", "transformed").join(chosen, [*LINE_KEY, *key])
    found = found.select(*key, "source_id", "line_number", "raw", "transformed")
    if known is None:
        return found
    return known.unionByName(found.join(known, key, "left_anti"))
