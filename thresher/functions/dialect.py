"""Template regexes: Python syntax in the library, Java syntax on the executors.

A library stores Python regexes with named groups. Spark's engine rejects
``(?P<name>`` and differs from Python in several classes, so each template row is
compiled once into columns that say how Spark can run it:

``linear``  constants joined by ``.*`` groups, the usual template. Both the test
            and the capture run in linear time (see `_linear_patterns`).
``java``    anything else whose meaning is the same in both engines.
``python``  the rest; checked with Python's ``re`` in Arrow batches.
"""

from __future__ import annotations

import re
from re import _constants as ops
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher.schemas import BOOLEAN, STRING, STRINGS, VARIABLE, VARIABLES

COMPILED = T.StructType(
    [
        T.StructField("valid", BOOLEAN),
        T.StructField("error", STRING),
        T.StructField("mode", STRING),
        T.StructField("test", STRING),
        T.StructField("capture", STRING),
        T.StructField("names", STRINGS),
        T.StructField("segments", STRINGS),
        T.StructField("words", STRINGS),
    ]
)

RENDERED = T.StructType(
    [T.StructField("template", STRING), T.StructField("variables", T.ArrayType(VARIABLE))]
)

# Stands between captured values while they are cut apart; lines that contain it
# take the group-by-group path.
SEPARATOR = "\x1f"

_WORD = re.compile(r"[A-Za-z0-9]+")
# What Python's \s and \w match, as members of a Java class.
SPACE_MEMBERS = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WORD_MEMBERS = r"\p{L}\p{N}_"
_CATEGORIES = {
    ops.CATEGORY_DIGIT: r"\p{Nd}",
    ops.CATEGORY_NOT_DIGIT: r"\P{Nd}",
    ops.CATEGORY_SPACE: SPACE_MEMBERS,
    ops.CATEGORY_WORD: WORD_MEMBERS,
}
# Negated classes stand in a class of their own.
_NEGATED = {
    ops.CATEGORY_NOT_SPACE: f"[^{SPACE_MEMBERS}]",
    ops.CATEGORY_NOT_WORD: f"[^{WORD_MEMBERS}]",
}
_BOUNDARY = (
    f"(?:(?<=[{WORD_MEMBERS}])(?![{WORD_MEMBERS}])|(?<![{WORD_MEMBERS}])(?=[{WORD_MEMBERS}]))"
)
_JAVA_SPECIAL = set("\\^$.|?*+()[]{}-&~#\"'<>!=:/,;@%` ")
_REPEATS = {ops.MAX_REPEAT: "", ops.MIN_REPEAT: "?", ops.POSSESSIVE_REPEAT: "+"}
_ANCHORS = {
    ops.AT_BEGINNING: r"\A",
    ops.AT_BEGINNING_STRING: r"\A",
    ops.AT_END: r"\z",
    ops.AT_END_STRING: r"\z",
    ops.AT_BOUNDARY: _BOUNDARY,
}


_JAVA_ESCAPES = str.maketrans({c: "\\" + c for c in _JAVA_SPECIAL})


def java_literal(text: str) -> str:
    return text.translate(_JAVA_ESCAPES)


def _is_any_star(op, arg) -> bool:
    return (
        op is ops.MAX_REPEAT
        and arg[0] == 0
        and arg[1] is ops.MAXREPEAT
        and list(arg[2]) == [(ops.ANY, None)]
    )


def _literal_parts(tree, named: set[int]) -> tuple[list[str], list[bool]] | None:
    """Constants around ``.*`` gaps, and whether each gap is a named group."""
    segments, captures = [""], []
    for op, arg in tree:
        body = list(arg[3]) if op is ops.SUBPATTERN and not (arg[1] or arg[2]) else []
        if op is ops.LITERAL:
            segments[-1] += chr(arg)
        elif _is_any_star(op, arg) or (len(body) == 1 and _is_any_star(*body[0])):
            segments.append("")
            captures.append(op is ops.SUBPATTERN and arg[0] in named)
        else:
            return None
    return segments, captures


# Constants, escaped where they must be, and named gaps: all that mined templates hold.
_CONSTANT = r"(?:[^\\.^$*+?{}\[\]|()]++|\\[\\.^$*+?{}\[\]|()])*+"
_GAP = r"\(\?P<([A-Za-z_][A-Za-z0-9_]*)>\.\*\)"
_PLAIN, _GAPS = re.compile(f"{_CONSTANT}(?:{_GAP}{_CONSTANT})*+"), re.compile(_GAP)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def _plain_parts(regex: str) -> tuple[list[str], list[str]] | None:
    """Constants and names of a regex of constants and named gaps, read without Python's
    parser, which takes a step for each character; null for any other regex."""
    if not _PLAIN.fullmatch(regex):
        return None
    parts = _GAPS.split(regex)
    names = parts[1::2]
    if len({*names}) < len(names):
        return None
    return [_ESCAPED.sub(r"\1", c) if "\\" in c else c for c in parts[::2]], names


def _java(tree, named: set[int]) -> str | None:
    parts = [_java_item(op, arg, named) for op, arg in tree]
    return None if None in parts else "".join(parts)


def _java_item(op, arg, named) -> str | None:
    if op is ops.LITERAL:
        return java_literal(chr(arg))
    if op is ops.NOT_LITERAL:
        return f"[^{java_literal(chr(arg))}]"
    if op is ops.ANY:
        return "."
    if op is ops.AT:
        return _ANCHORS.get(arg)
    if op is ops.IN:
        members = [_java_member(*item) for item in arg]
        if members[0] == "^" and any(item[1] in _NEGATED for item in arg):
            return None
        return None if None in members else f"[{''.join(members)}]"
    if op is ops.BRANCH:
        branches = [_java(branch, named) for branch in arg[1]]
        return None if None in branches else f"(?:{'|'.join(branches)})"
    if op is ops.SUBPATTERN:
        group, added, removed, body = arg
        inner = _java(body, named)
        if inner is None or added or removed:
            return None
        return f"({inner})" if group in named else f"(?:{inner})"
    if op in _REPEATS:
        low, high, body = arg
        inner = _java(body, named)
        if inner is None:
            return None
        top = "" if high is ops.MAXREPEAT else int(high)
        return f"(?:{inner}){{{low},{top}}}{_REPEATS[op]}"
    return None


def _java_member(op, arg) -> str | None:
    if op is ops.NEGATE:
        return "^"
    if op is ops.LITERAL:
        return java_literal(chr(arg))
    if op is ops.RANGE:
        return f"{java_literal(chr(arg[0]))}-{java_literal(chr(arg[1]))}"
    if op is ops.CATEGORY:
        return _CATEGORIES.get(arg) or _NEGATED.get(arg)
    return None


def _always_captures(tree, named: set[int]) -> bool:
    """True when every named group takes part in every match."""
    seen = set()

    def walk(items):
        for op, arg in items:
            if op is ops.SUBPATTERN:
                seen.add(arg[0])
                walk(arg[3])
            elif op in _REPEATS and arg[0] > 0:
                walk(arg[2])

    walk(tree)
    return named <= seen


def _linear_patterns(segments: list[str], captures: list[bool]) -> tuple[str, str]:
    """Backtracking-free Java patterns for constants joined by ``.*``.

    Test: taking each middle constant at its first possible place never loses a
    match, so every step can be atomic. Capture: greedy groups put each constant
    at its last possible place, which is its first place in the reversed line;
    the capture pattern therefore runs on the reversed text.
    """
    if not captures:
        whole = rf"(?d)\A{java_literal(segments[0])}\z"
        return whole, whole
    head, *middle, tail = segments
    steps = "".join(f"(?>.*?{java_literal(c)})" for c in middle)
    test = rf"(?d)\A{java_literal(head)}{steps}.*{java_literal(tail)}\z"
    back = "".join(
        f"(?>{'(.*?)' if keep else '.*?'}{java_literal(c[::-1])})"
        for c, keep in zip(reversed(middle), reversed(captures[1:]))
    )
    first = "(.*)" if captures[0] else ".*"
    capture = rf"(?d)\A{java_literal(tail[::-1])}{back}{first}{java_literal(head[::-1])}\z"
    return test, capture


def _required_segments(tree) -> list[str]:
    """Literal texts every match holds, in order; anything else stands between them."""
    segments = [""]

    def walk(items) -> None:
        for op, arg in items:
            if op is ops.LITERAL:
                segments[-1] += chr(arg)
            elif op is ops.SUBPATTERN and not (arg[1] or arg[2]):
                walk(arg[3])
            elif op is not ops.AT:
                segments.append("")

    walk(tree)
    return segments


def _whole_words(segments: list[str]) -> list[str]:
    """Words of the constants that no captured value can lengthen."""
    words = set()
    last = len(segments) - 1
    for i, text in enumerate(segments):
        for m in _WORD.finditer(text):
            open_left = m.start() == 0 and i > 0
            open_right = m.end() == len(text) and i < last
            if not open_left and not open_right:
                words.add(m.group())
    return sorted(words)


def compile_regex(regex: str | None) -> tuple:
    """One row of `COMPILED`."""
    if regex is None:
        return (False, "missing regex", None, None, None, [], [], [])
    if plain := _plain_parts(regex):
        segments, names = plain
        test, capture = _linear_patterns(segments, [True] * len(names))
        return (True, None, "linear", test, capture, names, segments, _whole_words(segments))
    try:
        tree = _parser.parse(regex)
        names, named = list(tree.state.groupdict), set(tree.state.groupdict.values())
        default_flags = tree.state.flags == re.UNICODE
        parts = _literal_parts(tree, named) if default_flags else None
        if parts is not None:
            test, capture = _linear_patterns(*parts)
            return (True, None, "linear", test, capture, names, parts[0], _whole_words(parts[0]))
        # Some errors only show when the parsed regex is compiled.
        re.compile(regex)
    except (re.error, OverflowError, RecursionError) as exc:
        return (False, str(exc), None, None, None, [], [], [])
    words = _whole_words(_required_segments(tree)) if default_flags else []
    body = _java(tree, named) if default_flags else None
    if body is None or not _always_captures(tree, named):
        return (True, None, "python", None, None, names, [], words)
    whole = rf"(?d)\A(?:{body})\z"
    return (True, None, "java", whole, whole, names, [], words)


@F.pandas_udf(COMPILED)
def _compile_udf(regex: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compile_regex(r) for r in regex], columns=COMPILED.names)


def compiled_names(regex: Column) -> Column:
    """The ``names`` of `COMPILED` alone."""
    return _compile_udf(regex)["names"]


def with_compiled(templates: DataFrame, regex: str = "regex") -> DataFrame:
    """Add the compiled columns to a template table (one row per template).

    The function is declared non-deterministic to stay where it is written: a
    filter on ``valid`` would otherwise carry it below the joins and aggregates
    that make the template table small.
    """
    compiled = _compile_udf.asNondeterministic()(F.col(regex))
    return templates.withColumn("_c", compiled).select(
        *templates.columns, "_c.*"
    )


@F.pandas_udf(BOOLEAN)
def python_fullmatch(regex: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series(
        [
            r is not None and t is not None and re.fullmatch(r, t) is not None
            for r, t in zip(regex, text)
        ],
        dtype=bool,
    )


def literal_holds(text: str, segments: list[str]) -> bool:
    """`linear` matching without a regex: constants in order, gaps of any length."""
    if len(segments) == 1:
        return text == segments[0]
    head, *middle, tail = segments
    at, end = len(head), len(text) - len(tail)
    if at > end or not text.startswith(head) or not text.endswith(tail):
        return False
    for constant in middle:
        found = text.find(constant, at, end)
        if found < 0:
            return False
        at = found + len(constant)
    return True


class Matcher:
    """One template in a Python task, compiled at its first use."""

    def __init__(self, mode: str, regex: str, segments: list[str]):
        self.segments = list(segments) if mode == "linear" else None
        self.regex, self._run = regex, None

    def __call__(self, text: str) -> bool:
        # A gap does not cross a line break.
        if self.segments is not None and "\n" not in text:
            return literal_holds(text, self.segments)
        self._run = self._run or re.compile(self.regex).fullmatch
        return self._run(text) is not None

    def __getstate__(self):
        return self.__dict__ | {"_run": None}


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def python_matching(regex: pd.Series, texts: pd.Series) -> pd.Series:
    """Positions (0-based) of the texts a regex fully matches."""

    def positions(r, items):
        if r is None:
            return []
        compiled = re.compile(r)
        return [i for i, t in enumerate(items) if compiled.fullmatch(t)]

    return pd.Series([positions(r, items) for r, items in zip(regex, texts)], dtype=object)


@F.pandas_udf(VARIABLES)
def python_groups(regex: pd.Series, text: pd.Series) -> pd.Series:
    def groups(r, t):
        m = re.fullmatch(r, t) if r is not None and t is not None else None
        return None if m is None else m.groupdict()

    return pd.Series([groups(r, t) for r, t in zip(regex, text)], dtype=object)


@F.pandas_udf(RENDERED)
def python_render(regex: pd.Series, sample: pd.Series) -> pd.DataFrame:
    """Template text and variables of any regex, from the sample it matches."""
    rows = []
    for r, s in zip(regex, sample):
        try:
            m = re.fullmatch(r, s) if r is not None and s is not None else None
        except re.error:
            m = None
        if m is None:
            rows.append((None, None))
            continue
        names = [n for n in m.re.groupindex if m.start(n) >= 0]
        text, cursor = "", 0
        for n in names:
            text += f"{s[cursor:m.start(n)]}<{n}>"
            cursor = m.end(n)
        found = [{"name": n, "description": "", "example": m.group(n)} for n in names]
        rows.append((text + s[cursor:], found))
    return pd.DataFrame(rows, columns=RENDERED.names)


def matches(text: Column, test: Column) -> Column:
    """``text`` fully matches a compiled pattern held in a column.

    ``regexp_instr`` keeps the last compiled pattern, ``rlike`` does not when the
    pattern is a column.
    """
    return F.call_function("regexp_instr", text, test) > 0


def literal_matches(text: Column, mode: str, test: str, segments: list[str]) -> Column:
    """The same for a pattern known on the driver, behind cheap literal checks."""
    check = text.rlike(test)
    if mode != "linear":
        return check
    if len(segments) == 1:
        return text == F.lit(segments[0])
    head, *middle, tail = segments
    guards = [text.startswith(head)] if head else []
    guards += [text.contains(c) for c in sorted(set(middle), key=len)[-2:] if c]
    guards += [text.endswith(tail)] if tail else []
    for guard in reversed(guards):
        check = guard & check
    return check


def captured_values(text: Column, mode: Column, capture: Column, names: Column) -> Column:
    """Captured values, in group order, for compiled columns (``linear``, ``java``)."""
    back = F.reverse(text)
    slots = F.sequence(F.lit(1), F.size(names))
    joined = F.array_join(
        F.transform(slots, lambda i: F.concat(F.lit("$"), i.cast("string"))), SEPARATOR
    )
    quick = F.split(F.reverse(F.regexp_replace(back, capture, joined)), SEPARATOR)
    # Group k of the line is group n+1-k of the reversed pattern.
    slow = F.transform(
        slots,
        lambda i: F.when(
            mode == "linear",
            F.reverse(F.call_function("regexp_extract", back, capture, F.size(names) + 1 - i)),
        ).otherwise(F.call_function("regexp_extract", text, capture, i)),
    )
    values = F.when((mode == "linear") & ~text.contains(SEPARATOR), quick).otherwise(slow)
    return F.when(F.size(names) == 0, F.array().cast(STRINGS)).otherwise(values)


def captured(text: Column, mode: Column, capture: Column, names: Column) -> Column:
    """The same as a map."""
    return F.map_from_arrays(names, captured_values(text, mode, capture, names))


def literal_captured(text: Column, mode: str, capture: str, names: list[str]) -> Column:
    """The same for a pattern known on the driver."""
    if not names:
        return empty_map()
    keys = F.array(*[F.lit(n) for n in names])
    n = len(names)
    subject = F.reverse(text) if mode == "linear" else text
    if mode == "linear":
        slow = F.array(
            *[F.reverse(F.regexp_extract(subject, capture, n - i)) for i in range(n)]
        )
    else:
        slow = F.array(*[F.regexp_extract(subject, capture, i + 1) for i in range(n)])
    # One pass of the regex puts all groups side by side.
    joined = F.regexp_replace(
        subject, capture, SEPARATOR.join(f"${i + 1}" for i in range(n))
    )
    quick = F.split(F.reverse(joined) if mode == "linear" else joined, SEPARATOR)
    values = F.when(text.contains(SEPARATOR), slow).otherwise(quick)
    return F.map_from_arrays(keys, values)


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def java_search(regex: str | None, group: str) -> str | None:
    """A Java pattern to search for, with ``group`` as its only group."""
    if regex is None:
        return None
    try:
        compiled = re.compile(regex)
    except re.error:
        return None
    if group not in compiled.groupindex or compiled.flags != re.UNICODE:
        return None
    body = _java(_parser.parse(regex), {compiled.groupindex[group]})
    return None if body is None else f"(?d){body}"
