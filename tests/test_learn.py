import json
import re

from pyspark.sql import functions as F

from thresher import schemas as S
from thresher.functions import text as X
from thresher.functions.dialect import with_compiled
from thresher.operators import validate as V
from thresher.operators.mine import classify_slots, slot_statistics
from thresher.operators.resolve import render_proposals
from thresher.plans.learn import learn_templates
from thresher.plans.parse import parse_logs, parsed_wide

EXAMPLES = "device_type string, vendor string, template_id string, position bigint, transformed string"
DOT1X = "Jan 1 00:00:24 10.47.0.33 dot1x-proc:1[8869]: <520002> <8869> <ERRS> Authentication timeout"


def learn(spark, lines, templates=None, examples=(), **options):
    templates = spark.createDataFrame([], S.TEMPLATE) if templates is None else templates
    return learn_templates(
        lines, templates, spark.createDataFrame([], S.LIBRARY_META),
        spark.createDataFrame(list(examples), EXAMPLES), **options,
    )


def check_rows(learned, texts):
    """Every line once; a matched line satisfies its template and no earlier active one."""
    library = learned.templates.orderBy("seq").collect()
    rows = {r.line_number: r.template_id for r in learned.matched.collect()}
    rest = {r.line_number for r in learned.remaining.collect()}
    assert set(rows) | rest == set(range(1, len(texts) + 1)) and not set(rows) & rest
    for n, template_id in rows.items():
        first = next(t for t in library if t.template_id == template_id)
        assert re.fullmatch(first.regex, texts[n - 1])
    return [t.regex for t in library], rows


def test_documented_example(spark, lines):
    """The documented template from its regex, and a mined one for the same line."""
    regex = (
        r"(?P<ts>.*) (?P<ip>.*) dot1x-proc:(?P<proc_id>.*)\[(?P<pid>.*)\]: "
        r"<(?P<id1>.*)> <(?P<id2>.*)> <(?P<level>.*)> Authentication timeout"
    )
    given = lines([DOT1X]).withColumn("regex", F.lit(regex)).withColumn("reasoning", F.lit("r"))
    row = render_proposals(given).first()
    assert row.template == (
        "<ts> <ip> dot1x-proc:<proc_id>[<pid>]: <<id1>> <<id2>> <<level>> Authentication timeout"
    )
    assert [v.name for v in row.variables] == ["ts", "ip", "proc_id", "pid", "id1", "id2", "level"]
    mined = learn(spark, lines([DOT1X])).templates.first()
    assert re.fullmatch(mined.regex, DOT1X) and mined.template.startswith("<time1> <ip2> dot")
    values = {v.name: v.example for v in mined.variables}
    assert values["ip2"] == "10.47.0.33" and values["time1"] == "Jan 1 00:00:24"


def test_angle_brackets_in_lines_count_as_placeholders(spark):
    df = spark.createDataFrame([("<ts> <ip> proc:<id>[<pid>]: <a> timeout ",)], "t string")
    assert df.select(X.extract_constants(F.col("t"))).first()[0] == ["proc:", "[", "]:", "timeout"]


def test_covered_patterns_need_no_template(spark, lines):
    texts = ["x 1 y", "x 1 c 2 y", "q", ""]
    learned = learn(spark, lines(texts))
    regexes, rows = check_rows(learned, texts)
    assert regexes == [r"x (?P<num1>.*) y", "q"] and rows[2] == rows[1]


def test_conflict_is_refined(spark, lines):
    texts = ["x 1 c 2 y", "x 1 y", "x 3 y"]
    learned = learn(spark, lines(texts))
    _, rows = check_rows(learned, texts)
    outcomes = {r.line_number: r.outcome for r in learned.audit.collect()}
    assert outcomes[1] == "stored" and outcomes[2] == "refined" and len(rows) == 3


def test_open_candidate_replaces(spark, lines):
    texts = ["x 1 c 2 y"] + [f"x {i} y" for i in range(100, 190)]
    learned = learn(spark, lines(texts))
    check_rows(learned, texts)
    active = {r.regex: r.is_active for r in learned.templates.collect()}
    assert active == {r"x (?P<num1>.*) c (?P<num2>.*) y": False, r"x (?P<num1>.*) y": True}
    assert {r.outcome for r in learned.audit.collect()} == {"stored", "replaced"}


def test_words_with_many_values_become_slots(spark, lines):
    words = [f"{a}{b}" for a in "abcde" for b in "vwxyz"]
    texts = [f"user {w} left {i}" for i, w in enumerate(words)] + ["user zed came 1"]
    regexes, _ = check_rows(learn(spark, lines(texts)), texts)
    assert regexes == [r"user (?P<word1>.*) left (?P<num2>.*)", r"user zed came (?P<num1>.*)"]
    regexes, _ = check_rows(learn(spark, lines(texts[:20])), texts[:20])
    assert len(regexes) == 20


def test_constant_slots_stay_literal(spark, lines):
    texts = [f"code 200 took {i}" for i in range(12)]
    assert check_rows(learn(spark, lines(texts)), texts)[0] == [r"code 200 took (?P<num2>.*)"]


def test_second_run_learns_nothing(spark):
    raw = [f"GET /i/{i} 200" for i in range(30)] + ["", "ERROR x", "  spaced   out 5"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(raw, 1)], "source_id string, line_number bigint, raw_line string")
    first = parse_logs(df)
    assert first.rows.count() == len(raw)
    report = first.report.first()
    assert (report.processed_lines, report.unmatched_lines, report.new_templates) == (33, 1, 3)
    assert report.anomalies[0].startswith("1 lines remain")
    again = parse_logs(df.repartition(5), first.templates, first.meta)
    assert again.learned.new_templates.count() == 0
    pick = lambda p: {r.line_number: r.template_id for r in p.rows.collect()}
    assert pick(first) == pick(again)
    usage = {r.template_id: r.usage_count for r in again.templates.collect()}
    assert sum(usage.values()) == 64
    wide = {r.line_number: r.variables for r in parsed_wide(again.rows, again.templates).collect()}
    assert wide[31] == {} and wide[1] == {"num1": "0"}


def test_validation_reasons_and_limits_of_the_caller(spark):
    rows = [("d", "v", f"t{i}", i, f"ab {i}") for i in range(1, 30)]
    examples = spark.createDataFrame(rows, EXAMPLES)
    cands = with_compiled(spark.createDataFrame(
        [("d", "v", "c1", "ab (?P<n>.*)", "ab 77"), ("d", "v", "c2", "(", "x"), ("d", "v", "c3", "x", "y"),
         ("d", "v", "t2", "ab (?P<n>2)", "ab 2"), ("d", "v", "c5", r"(?i)AB (?P<n>\w+)", "ab 5")],
        "device_type string, vendor string, candidate_id string, regex string, transformed string"))
    every = [f"t{i}" for i in range(1, 30)]
    out = {r.candidate_id: r for r in V.validate_candidates(cands, examples).collect()}
    assert out["c1"].conflicting_template_ids == every and out["c5"].conflicting_template_ids == every
    assert out["c1"].reasons == ["conflicts with existing templates: " + ", ".join(every)]
    assert out["c2"].reasons[0].startswith("invalid regex") and not out["c2"].is_valid
    assert out["c3"].reasons == ["generated regex does not match the source sample"]
    assert out["t2"].is_valid
    few = {r.candidate_id: r for r in V.validate_candidates(cands, examples, max_checks=2, shown=1).collect()}
    assert few["c1"].conflicting_template_ids == ["t1", "t2"]
    assert few["c1"].reasons == ["conflicts with existing templates: t1"]
    few = {r.candidate_id: r for r in V.validate_candidates(cands, examples, max_conflicts=5).collect()}
    assert few["c1"].conflicting_template_ids == every[:5]


def test_conflict_with_a_late_example_is_found(spark):
    rows = [("d", "v", f"t{i}", i, f"other {i}") for i in range(1, 503)] + [("d", "v", "late", 503, "ab 5")]
    cands = with_compiled(spark.createDataFrame(
        [("d", "v", "c", "ab (?P<n>.*)", "ab 77")],
        "device_type string, vendor string, candidate_id string, regex string, transformed string"))
    out = V.validate_candidates(cands, spark.createDataFrame(rows, EXAMPLES)).first()
    assert out.conflicting_template_ids == ["late"]


def test_all_conflicts_are_replaced(spark, lines):
    """An open candidate against eight literal templates: none of them stays active."""
    stored = [f"item {i} ok" for i in range(8)]
    schema = "device_type string, vendor string, seq bigint, template_id string, regex string, is_active boolean"
    from checks.fixtures import complete

    library = complete(spark.createDataFrame([("d", "v", i + 1, f"d-v-{i + 1:04d}", r, True) for i, r in enumerate(stored)], schema))
    examples = [("d", "v", f"d-v-{i + 1:04d}", i + 1, r) for i, r in enumerate(stored)]
    texts = [f"item {i} ok" for i in range(100, 130)]
    learned = learn(spark, lines(texts), library, examples)
    active = [r.regex for r in learned.templates.filter("is_active").collect()]
    assert active == ["item (?P<num1>.*) ok"]
    assert learned.audit.first().detail == "replaced 8 conflicting templates"


def test_learning_goes_on_after_a_rejection(spark, lines):
    from checks.fixtures import complete

    schema = "device_type string, vendor string, seq bigint, template_id string, regex string, is_active boolean"
    regex = "job (?P<a>1 2 3) 9 9 9"
    library = complete(spark.createDataFrame([("d", "v", 1, "d-v-0001", regex, True)], schema))
    # The first line's candidate cannot be told from this example by pinning its slots.
    examples = [("d", "v", "d-v-0001", 1, "job 1 2 3 4 5 6")]
    texts = ["job 1 2 3 4 5 6", "job a b c d e f"]
    learned = learn(spark, lines(texts), library, examples)
    rows = {r.line_number for r in learned.matched.collect()}
    assert rows == {2} and {r.line_number for r in learned.remaining.collect()} == {1}
    assert {r.line_number: r.outcome for r in learned.audit.collect()}[1] == "rejected"


def test_all_closed_slots_can_be_pinned(spark, lines):
    """Five slots must be pinned before the candidate leaves the examples alone."""
    text = "a 1 b 2 c 3 d 4 e 5 f"
    near = [("d", "v", f"t{i}", i, text.replace(str(i), "9")) for i in range(1, 6)]
    learned = learn(spark, lines([text]), None, near)
    row = learned.audit.first()
    assert row.outcome == "refined" and learned.templates.first().regex == text


def test_slot_values_are_counted_exactly(spark, lines):
    for n in (19, 20, 21, 24, 30):
        found = {r.position: r.distinct_values for r in classify_slots(lines([f"x {i * 7919} y" for i in range(n)])).collect()}
        assert found == {1: min(n, 21)}
        stats = slot_statistics(lines([f"x {i * 7919} y" for i in range(n)]), open_values=100)
        assert stats.filter("position = 1").first()["values"] == n


def answers(spark, rows):
    text = [("a", n, k, t if t is None or t.startswith("no") else json.dumps(t if isinstance(t, dict) else {"regex": t})) for n, k, t in rows]
    return spark.createDataFrame(text, "source_id string, line_number bigint, attempt int, text string")


def test_model_answers_enter_the_library(spark, lines):
    """Attempts, coverage by an earlier answer, conflicts with both resolutions, and the miner for the rest."""
    from checks.fixtures import complete

    schema = "device_type string, vendor string, seq bigint, template_id string, regex string, is_active boolean"
    stored = [("item alpha ok", "d-v-0001"), ("unit alpha up", "d-v-0002")]
    library = complete(spark.createDataFrame([("d", "v", i + 1, t, r, True) for i, (r, t) in enumerate(stored)], schema))
    examples = [("d", "v", t, i + 1, r) for i, (r, t) in enumerate(stored)]
    texts = ["user bob in", "user eve in", "item beta ok", "unit beta up", "left 5 alone", "gate open now"]
    proposals = answers(spark, [
        (1, 0, "no json"), (1, 1, "user (?P<name>.*) in"), (2, 0, "user (?P<who>.*) in"),
        (3, 0, "item (?P<name>.*) ok"), (4, 0, "unit (?P<name>.*) up"), (6, 0, "gate ("), (6, 1, "does not match"),
    ])
    plans = spark.createDataFrame(
        [("a", 3, json.dumps({"decision": "replace_conflicting", "replaced_ids": ["d-v-0001", "nothing"]})),
         ("a", 4, json.dumps({"decision": "refine_candidate", "new_regex": "unit (?P<name>b.*) up"}))],
        "source_id string, line_number bigint, text string")
    learned = learn(spark, lines(texts), library, examples, proposals=proposals, resolutions=plans)
    regexes, rows = check_rows(learned, texts)
    assert set(rows) == {1, 2, 3, 4, 5, 6} and rows[1] == rows[2]
    active = {r.regex: (r.is_active, r.source) for r in learned.templates.collect()}
    assert active["user (?P<name>.*) in"] == (True, "llm") and "user (?P<who>.*) in" not in active
    assert active["item alpha ok"][0] is False and active["item (?P<name>.*) ok"][0]
    assert active["unit alpha up"][0] and active["unit (?P<name>b.*) up"][0]
    assert active["left (?P<num1>.*) alone"] == (True, "mined") and active["gate open now"] == (True, "mined")
    outcomes = {(r["round"], r.line_number): r.outcome for r in learned.audit.collect()}
    assert outcomes[1, 1] == "stored" and outcomes[1, 3] == "replaced" and outcomes[1, 4] == "refined"
    assert outcomes[1, 6] == "rejected"


def test_unresolved_conflicts_are_rejected(spark, lines):
    examples = [("d", "v", "t1", 1, "item alpha ok")]
    proposals = answers(spark, [(1, 0, "item (?P<name>.*) ok")])
    plans = spark.createDataFrame([("a", 1, json.dumps({"decision": "replace_conflicting", "replaced_ids": ["x"]}))], "source_id string, line_number bigint, text string")
    for resolutions in (None, plans):
        learned = learn(spark, lines(["item beta ok"]), None, examples, proposals=proposals, resolutions=resolutions)
        assert [r.outcome for r in learned.audit.orderBy("round").collect()] == ["rejected", "stored"]
        assert learned.templates.first().regex == "item beta ok"


def test_render_proposals(spark):
    df = spark.createDataFrame(
        [("d", "v", r"(?P<a>\d+)-(?P<b>x)?(?P<c>.*)", "12-yz", "why"), ("d", "v", "(", "q", None), ("d", "v", "no", "q", "")],
        "device_type string, vendor string, regex string, transformed string, reasoning string")
    rows = render_proposals(df).collect()
    assert rows[0].template == "<a>-<c>" and [v.name for v in rows[0].variables] == ["a", "c"]
    assert rows[0].candidate_id.startswith("d-v-") and rows[1].template is None and rows[2].template is None
