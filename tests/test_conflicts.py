import random
import re

import pytest

from thresher.functions.dialect import with_compiled
from thresher.operators import validate

EXAMPLES = "device_type string, vendor string, template_id string, position long, transformed string"
CANDIDATES = "device_type string, vendor string, candidate_id string, regex string"


def cases():
    """Candidates of whole words, of parts of words, of nothing fixed and beyond the native patterns."""
    pick = random.Random(5)
    stems = ["abc", "abcd", "xyz", "port", "po", "q"]
    texts = [f"{pick.choice(stems)}{pick.randrange(40)}{pick.choice(stems)} {pick.choice(stems)}" for _ in range(120)]
    texts += ["", "po", "abc", "a.b", "1 2"]
    examples = [("d", pick.choice("uv"), f"t{i}", i, t) for i, t in enumerate(texts)]
    regexes = [f"{a}(?P<x>.*){b} (?P<y>.*)" for a in stems for b in stems]
    regexes += [f"(?P<x>.*){a}(?P<y>.*)" for a in stems]
    regexes += ["(?P<x>.*)", r"(?P<x>\d+) (?P<y>\d+)", r"(?P<x>\w+) port", r"(?P<x>(?=a)\w*) (?P<y>.*)", "(", "abc", "none such"]
    return examples, [("d", v, f"c{i}{v}", r) for i, r in enumerate(regexes) for v in "uv"]


@pytest.mark.parametrize("limit, hot", [(validate.BROADCAST_LIMIT, validate.HOT_EXAMPLES), (0, 7)])
def test_conflicts_against_all_pairs(spark, monkeypatch, limit, hot):
    monkeypatch.setattr(validate, "BROADCAST_LIMIT", limit)
    monkeypatch.setattr(validate, "HOT_EXAMPLES", hot)
    examples, candidates = cases()
    shown = spark.createDataFrame(examples, EXAMPLES)
    found = validate.detect_conflicts(with_compiled(spark.createDataFrame(candidates, CANDIDATES)), shown)
    got = {r.candidate_id: r.conflicting_template_ids for r in found.collect()}
    assert len(got) == len(candidates)
    for _, vendor, name, regex in candidates:
        own = [(p, i, t) for _, v, i, p, t in examples if v == vendor]
        try:
            want = [i for _, i, t in sorted(own) if re.fullmatch(regex, t)]
        except re.error:
            want = []
        assert got[name] == want, regex


def test_parts_of_words_do_not_meet_all_examples(spark):
    examples = [("d", "u", f"t{i}", i, f"ab{i}cd left {i}") for i in range(50)] + [("d", "u", "z", 99, "longpart7end")]
    regexes = [("d", "u", f"c{i}", f"longpart(?P<x>.*)n{i}d") for i in range(20)] + [("d", "u", "hit", "longpart(?P<x>.*)end")]
    asked = with_compiled(spark.createDataFrame(regexes, CANDIDATES)).selectExpr("*", "monotonically_increasing_id() as _row")
    pairs = validate._pairs(asked, spark.createDataFrame(examples, EXAMPLES))
    assert pairs.count() <= 21
