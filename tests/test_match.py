import random
import re

import pytest
from pyspark.sql import functions as F

from thresher.functions.dialect import compile_regex
from thresher.operators import match as M

REGEXES = [
    r"(?P<ts>.*) app\[(?P<pid>.*)\]: ERROR (?P<msg>.*)",
    r"GET (?P<path>.*) (?P<ms>.*)ms",
    r"(",
    r"opt-(?P<o>x)?",
    r"zz (?P<n>\d+)z",
    r"(?P<a>.*) (?P<b>.*)-(?P<c>.*)",
    r"\w+!(?P<rest>.*)",
    r"x(?P<one>.*)(?P<two>.*)y",
    r"plain",
]
TEXTS = [
    "t app[1]: ERROR boom", "GET a b 5ms", "opt-", "opt-x", "zz 12z", "zz 1 2-3-4", "héé!ok", "xaby",
    "plain", "nothing", "", "a\x1fb c-d", "GET ms", "x y-", "zz ١z", "xy",
]


def expected(texts, regexes, active=None):
    compiled = []
    for i, r in enumerate(regexes):
        try:
            compiled.append(re.compile(r) if active is None or active[i] else None)
        except re.error:
            compiled.append(None)
    out = []
    for t in texts:
        hit = next(((i, c.fullmatch(t)) for i, c in enumerate(compiled) if c and c.fullmatch(t)), None)
        out.append((None, {}) if hit is None else (f"d-v-{hit[0] + 1:04d}", hit[1].groupdict()))
    return out


def got(df):
    return [(r.template_id, r.variables) for r in df.orderBy("line_number").collect()]


@pytest.mark.parametrize("case_limit", [200, 0])
def test_first_active_match_and_variables(lines, library, case_limit):
    active = [True] * len(REGEXES)
    active[1] = False
    for flags in (None, active):
        out = M.match_templates(lines(TEXTS), library(REGEXES, flags), variables=True, case_limit=case_limit)
        assert got(out) == expected([t.rstrip() for t in TEXTS], REGEXES, flags)


def test_random_literal_templates_agree_with_python(lines, library):
    """Linear test and capture patterns against Python's backtracking."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab-. ") for _ in range(rng.randint(0, n)))
    regexes = []
    for _ in range(40):
        parts = [re.escape(word(3)) for _ in range(rng.randint(1, 5))]
        regexes.append("".join(p + (f"(?P<g{i}>.*)" if i < len(parts) - 1 else "") for i, p in enumerate(parts)))
    texts = [re.sub(" {2,}", " ", word(14)).rstrip() for _ in range(400)]
    want = expected(texts, regexes)
    assert got(M.match_templates(lines(texts), library(regexes), variables=True)) == want
    assert got(M.match_templates(lines(texts), library(regexes), variables=True, case_limit=0)) == want
    spread = M.match_templates(lines(texts).repartition(13), library(regexes), variables=True)
    assert got(spread) == want


def test_many_slots_stay_linear(lines, library):
    """A pattern that makes a backtracking engine explode."""
    regex = " ".join(f"(?P<n{i}>.*)" for i in range(24)) + " end"
    text = " ".join(str(i) for i in range(60))
    out = M.match_templates(lines([text + " end", text]), library([regex]), variables=True)
    first, second = out.orderBy("line_number").collect()
    assert first.template_id and second.template_id is None
    assert first.variables["n23"] == "59" and first.variables["n0"].startswith("0 1 2")


def test_compiled_modes():
    assert compile_regex("a(?P<x>.*)b")[2] == "linear"
    assert compile_regex(r"(?P<x>[0-9]+)")[2] == "java"
    assert compile_regex(r"(?P<x>\w+)")[2] == "java"
    assert compile_regex(r"(?P<x>[^\S])")[2] == "python"
    assert compile_regex(r"GET (?P<p>\S+) took (?P<n>\d+) ms")[7] == ["GET", "ms", "took"]
    assert compile_regex(r"a1(?P<p>\S+)b2 (?:c|d) (?i:x) end\b.")[7] == []
    assert compile_regex(r"(?i)a")[2] == "python"
    assert compile_regex("(")[0] is False and compile_regex(None)[0] is False


def test_examples_keep_what_is_known(spark, lines, library):
    assigned = M.match_templates(lines(["a 1", "b", "a 2"]), library(["a (?P<n>.*)", "b"]))
    known = M.first_examples(assigned).filter("template_id = 'd-v-0002'").withColumn("raw", F.lit("old"))
    rows = {r.template_id: r.raw for r in M.first_examples(assigned, known).collect()}
    assert rows == {"d-v-0001": "a 1", "d-v-0002": "old"}


def test_filters_do_not_copy_the_matching(lines, library):
    out = M.match_templates(lines(TEXTS), library(["a(?P<x>.*)", "b(?P<x>.*)"])).filter("template_id is not null")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_classes_agree_with_python(spark):
    """Every character of the basic plane against each class, alone and in a class of classes."""
    import unicodedata

    classes = [r"\w", r"\W", r"\s", r"\S", r"\d", r"\D", r"[\w-]", r"[\S\d]", r"[^\w]", r"[^\s\d]", r"[^\D]"]
    tests = {c: compile_regex(f"(?P<x>{c})") for c in classes}
    assert {t[2] for t in tests.values()} == {"java"}
    # Characters that Java's older tables know; line breaks cannot be in a line.
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    df = spark.createDataFrame([(c,) for c in chars], "t string").repartition(4)
    known = F.col("t").rlike(r"\A\P{Cn}\z")
    rows = df.filter(known).select("t", *[F.col("t").rlike(t[3]).alias(f"c{i}") for i, t in enumerate(tests.values())]).collect()
    assert len(rows) > 50_000
    for i, c in enumerate(classes):
        pattern = re.compile(c)
        assert [r.t for r in rows if r[f"c{i}"] != bool(pattern.fullmatch(r.t))] == []


def test_boundaries_agree_with_python(spark):
    regex = r"(?P<a>.*)\b(?P<b>\w+)\b-(?P<c>.*)"
    texts = ["ab cd-e", "-x", "é-", "a_b-", " - ", "a--b", "x9-y"]
    test = compile_regex(regex)
    assert test[2] == "java"
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(test[3]).alias("m")).collect()
    assert {r.t: r.m for r in rows} == {t: bool(re.fullmatch(regex, t)) for t in texts}


def test_python_templates_keep_the_order(lines, library):
    """Native and Python templates interleaved: the first in library order wins."""
    regexes = [r"a(?P<x>.*)z", r"(?i)A(?P<y>.*)", r"ab(?P<z>.*)", r"(?i)(?P<all>.*)Q", r"b(?P<w>.*)"]
    texts = ["abz", "abq", "ABX", "bq", "Bq", "none"]
    for limit in (200, 0):
        out = M.match_templates(lines(texts), library(regexes), variables=True, case_limit=limit)
        assert got(out) == expected(texts, regexes)


def test_word_matching_does_not_move_lines(lines, library):
    out = M.match_templates(lines(TEXTS), library(["alpha (?P<x>.*)", "beta"]), case_limit=0)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_large_index_is_joined(lines, library, monkeypatch):
    monkeypatch.setattr(M, "TASK_INDEX_LIMIT", 0)
    out = M.match_templates(lines(TEXTS), library(REGEXES), variables=True, case_limit=0)
    assert got(out) == expected([t.rstrip() for t in TEXTS], REGEXES)


SUBWORD = [
    "(?P<a>.*)x17y(?P<b>.*)", "(?P<a>.*)17y q(?P<b>.*)", "beta(?P<n>.*)ray", "(?P<all>.*)=(?P<v>.*)", "é(?P<x>.*)",
    "gamma (?P<g>.*)", "(?P<a>.*)x17(?P<b>.*)", r"k(?P<d>[0-9]+)", "(?P<rest>.*)zz",
]
SUBWORD_TEXTS = ["ax17yb", "a17y q", "betaxray", "betaray", "k=v", "ée", "gamma x17", "gamma", "qx17", "k12", "azz", "no", "17y", "x17y"]


@pytest.mark.parametrize("limit", [M.TASK_INDEX_LIMIT, 0])
def test_templates_without_a_whole_word(lines, library, monkeypatch, limit):
    """Found by a constant inside words, in library order, in tasks and by the join."""
    monkeypatch.setattr(M, "TASK_INDEX_LIMIT", limit)
    out = M.match_templates(lines(SUBWORD_TEXTS), library(SUBWORD), variables=True, case_limit=0)
    assert got(out) == expected(SUBWORD_TEXTS, SUBWORD)


def test_only_templates_without_constants_meet_every_line():
    index = M._Index()
    tried = []
    for seq, (anchor, literal) in enumerate([("", "x17y"), ("beta", ""), ("", "")]):
        index.add(anchor, literal, (seq, str(seq), lambda line, s=seq: tried.append(s)))
    assert index.first("a b c") is None and tried == [2]
    assert index.first("qx17yq beta") is None and tried == [2, 0, 1, 2]


@pytest.mark.parametrize("limit", [M.TASK_INDEX_LIMIT, 0])
def test_random_subword_libraries(lines, library, monkeypatch, limit):
    monkeypatch.setattr(M, "TASK_INDEX_LIMIT", limit)
    rng = random.Random(8)
    regexes = []
    for _ in range(120):
        parts = [re.escape("".join(rng.choice("abc1 -") for _ in range(rng.randint(0, 4)))) for _ in range(rng.randint(1, 4))]
        regexes.append("".join(p + (f"(?P<g{i}>.*)" if i < len(parts) - 1 else "") for i, p in enumerate(parts)))
    texts = [re.sub(" {2,}", " ", "".join(rng.choice("abc1 -") for _ in range(12))).strip() or "a" for _ in range(300)]
    out = M.match_templates(lines(texts), library(regexes), variables=True, case_limit=0)
    assert got(out) == expected(texts, regexes)


def test_common_words_are_no_anchors_and_hot_ones_are_salted(spark, lines, library, monkeypatch):
    """A word in nearly all lines leaves no task of the join with more than its share."""
    monkeypatch.setattr(M, "TASK_INDEX_LIMIT", 0)
    monkeypatch.setattr(M, "HOT_LINES", 50)
    texts = [f"common n{i} tail" if i % 10 else f"rare{i} x" for i in range(1000)]
    # `common` is rare among the templates; `tail` stands in as many lines but in more templates.
    regexes = ["common (?P<n>.*) tail", "other(?P<x>.*) tail", "(?P<y>.*)tail", "rare10 (?P<z>.*)"]
    out = M.match_templates(lines(texts), library(regexes), case_limit=0)
    found = {r.line_number: r.template_id for r in out.collect()}
    assert found == {
        i + 1: "d-v-0001" if i % 10 else ("d-v-0004" if i == 10 else None) for i in range(1000)
    }
    plan = M.match_templates(lines(texts), library(regexes), case_limit=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan


def test_template_without_a_gap_is_filed_under_its_whole_text(spark, lines, library):
    """Not under each of its words: a long line would be copied for every one of them."""
    texts = ["a long line of common words", "a long line of common things", "a long line of 7 words"]
    templates = library([texts[0].replace(" ", r"\ "), texts[1], "a long line of (?P<n>.*) words"])
    compiled = M.compiled_templates(templates)
    filed = {r.seq: r.n for r in M.template_keys(compiled).groupBy("seq").agg(F.count("*").alias("n")).collect()}
    assert filed[1] == filed[2] == 1 and filed[3] > 1
    out = M._match_by_join(lines([*texts, "a long line", ""]), compiled)
    found = {r.line_number: r.template_id for r in out.collect()}
    assert found == {1: "d-v-0001", 2: "d-v-0002", 3: "d-v-0003", 4: None, 5: None}


def test_equal_regexes_are_held_once(spark, lines, library, monkeypatch):
    """Of many templates with one regex the first takes the lines, so tasks hold that one."""
    texts = [f"conv {i} role user" for i in range(20)] + [f"conv {i} role tool" for i in range(20)]
    regexes = [r"conv (?P<c>.*) role " + ("user" if i % 3 else "tool") for i in range(300)]
    held, own = [], M._Index.add
    monkeypatch.setattr(M._Index, "add", lambda self, *entry: (held.append(entry[2][1]), own(self, *entry))[1])
    found = M.match_templates(lines(texts), library(regexes))
    assert {r.transformed.split()[-1]: r.template_id for r in found.collect()} == {"user": "d-v-0002", "tool": "d-v-0001"}
    assert sorted(held) == ["d-v-0001", "d-v-0002"]
