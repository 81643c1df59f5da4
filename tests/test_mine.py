"""Token borders, nested payloads and open words of the miner."""

import random
import re

from pyspark.sql import functions as F

from thresher.functions import text as X
from thresher.operators import mine as G


def templates(frame):
    return {r.template: r.support for r in frame.collect()}


def test_digits_inside_a_name_belong_to_it(spark, lines):
    texts = {
        "Jan 1 00:00:24 10.47.0.33 dot1x-proc:1[8869]: <520002> <8869> <ERRS> Authentication timeout":
            "<time1> <ip2> dot1x-proc:<num3>[<num4>]: <<num5>> <<num6>> <ERRS> Authentication timeout",
        "host3 took 10ms": "host<num1> took <num2>ms",
        "up 1h30m on ab12cd34ef": "up <num1>h<num2>m on ab12cd<num3>ef",
        "mail a1b@x2y.org via v2ray8 0x1F": "mail <email1> via v2ray<num2> <hex3>",
        "mac aa:1b:cc:dd:ee:ff x_y1z": "mac <mac1> x_y<num2>z",
    }
    found = templates(G.mine_candidates(lines(list(texts))))
    assert found == dict.fromkeys(texts.values(), 1)


def test_names_with_digits_are_words(spark, lines):
    """Ids of letters and digits act as one open word."""
    texts = [f"session s{i}x opened by k{i}y now" for i in range(30)]
    assert templates(G.mine_candidates(lines(texts))) == {"session <word1> opened by <word2> now": 30}


def test_marks_in_the_text_are_no_values(spark, lines):
    a, b, c, d = (x for pair in G.EDGES for x in pair)
    texts = [f"a{a}b 7", f"a{a}b{c} 7", f"x {c}{d} 8"]
    rows = G.mask_lines(lines(texts)).orderBy("line_number").collect()
    assert [r.constants for r in rows] == [[f"a{a}b ", ""], [texts[1]], [f"x {c}{d} ", ""]]
    assert [r.slot_values for r in rows] == [["7"], [], ["8"]]


def test_nested_payloads_are_one_value(spark, lines):
    texts = [
        'got {"a": {"b": [1, {"c": "}"}]}, "d": 5} for 7',
        'got {"a": 1} for 8',
        'got {"x": "{"} for 9',
        "got {open {1} for 4",
    ]
    rows = G.mask_lines(lines(texts)).orderBy("line_number").collect()
    assert [r.slot_values for r in rows] == [
        ['{"a": {"b": [1, {"c": "}"}]}, "d": 5}', "7"], ['{"a": 1}', "8"], ['{"x": "{"}', "9"], ["{1}", "4"],
    ]
    found = templates(G.mine_candidates(lines(texts)))
    assert found == {"got <json1> for <num2>": 3, "got {open <json1> for <num2>": 1}


def plain_parts(text):
    """One character after the other; None if a brace stays open."""
    parts, own, depth, quoted, at = [], "", 0, False, 0
    while at < len(text):
        token = text[at : at + 2] if text[at] == "\\" else text[at]
        if token == "{" and not quoted:
            if not depth:
                parts.append(own)
                own = ""
            depth += 1
            own += token
        elif token == "}" and not quoted and depth:
            depth -= 1
            own += token
            if not depth:
                parts.append(own)
                own = ""
        else:
            quoted ^= token == '"' and depth > 0
            own += token
        at += len(token)
    return None if depth else [*parts, own]


def test_payloads_equal_a_plain_parser(spark):
    pick = random.Random(3)
    pieces = ["{", "}", '"', "a", "\\", "\n", " x", '{"k": {"v": "}"}}', "é"]
    texts = ["".join(pick.choice(pieces) for _ in range(pick.randrange(14))) for _ in range(3000)]
    texts += ["", '{"a": "b"} ok', '{"a":"}"}', 'x {"a":{"b":[1,{"c":2}]}} y {} z']
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(
        "t", X.payload_parts(t).alias("parts"), X.json_payloads(t).alias("found"), X.mask_json_payloads(t).alias("masked")
    )
    for r in rows.collect():
        want = plain_parts(r.t)
        assert r.parts == want
        if "\\" not in r.t:
            payloads = re.findall(r"\{[^{}]*\}", r.t) if want is None else want[1::2]
            assert r.found == payloads
            flat = re.sub(r"\{[^{}]*\}", "<json>", r.t) if want is None else None
            assert r.masked == (flat if want is None else "".join("<json>" if i % 2 else p for i, p in enumerate(want)))
    keys = spark.createDataFrame([('x {"a": {"b": 1}, "c": 2}',)], "t string").select(X.json_payload_keys(t)).first()[0]
    assert keys == [["a", "c"]]


def word(i):
    return "".join(chr(97 + int(d)) for d in str(i)) + "w"


def test_two_open_words_give_one_template(spark, lines):
    texts = [f"connection from {word(i)} to {word(1000 + i)} closed" for i in range(64)]
    found = G.mine_candidates(lines(texts)).collect()
    assert [(r.template, r.support) for r in found] == [("connection from <word1> to <word2> closed", 64)]
    assert [v.example for v in found[0].variables] == [word(0), word(1000)]


def test_open_words_among_values_and_few_words(spark, lines):
    """Slots of both kinds keep their order; a word with few values stays text."""
    texts = [f"{i} user {word(i)} {'in' if i % 2 else 'out'} at 10.0.0.{i} via {word(500 + i)} ok" for i in range(80)]
    found = templates(G.mine_candidates(lines(texts), branch_support=10**9))
    assert found == {f"<num1> user <word2> {k} at <ip3> via <word4> ok": 40 for k in ("in", "out")}
    three = [f"move {word(i)} then {word(100 + i)} then {word(200 + i)} done today" for i in range(30)]
    assert templates(G.mine_candidates(lines(three))) == {"move <word1> then <word2> then <word3> done today": 30}


def test_a_family_taken_apart_by_a_split_is_found(spark, lines):
    """Noise of the same form makes the open word the one with the fewest values."""
    family = [f"alarm {word(i)} raised here" for i in range(25)]
    noise = [f"{word(300 + i)} {word(0)} {word(400 + i)} {word(500 + i)}" for i in range(40)]
    found = templates(G.mine_candidates(lines(family + noise)))
    assert found["alarm <word1> raised here"] == 25 and len(found) == 41


def test_too_few_constant_words_stay_apart(spark, lines):
    texts = [f"{word(i)} {word(100 + i)} {word(200 + i)} end" for i in range(30)]
    assert len(templates(G.mine_candidates(lines(texts)))) == 30
    few = [f"set {word(i % 5)} for {word(50 + i)} now" for i in range(20)]
    assert len(templates(G.mine_candidates(lines(few)))) == 20


def test_libraries_do_not_mix(spark, lines):
    one = lines([f"user {word(i)} came from {word(70 + i)} today" for i in range(15)])
    two = one.withColumn("vendor", F.lit("w")).withColumn("source_id", F.lit("b"))
    assert len(G.mine_candidates(one.unionByName(two)).collect()) == 30


def test_statistics_do_not_depend_on_what_a_task_holds(spark, lines, monkeypatch):
    texts = [f"a {i % 7} b {i}" for i in range(200)] + [f"{word(i)} {i % 3}" for i in range(50)]
    rows = lines(texts)

    def found():
        frame = G.slot_statistics(rows)
        return sorted((r.pattern_id, r.position, r.support, tuple(r.first), r["values"], r.single) for r in frame.collect())

    whole = found()
    assert {(r[2], r[4]) for r in whole if r[1] and r[2] == 200} == {(200, 7), (200, 21)}
    monkeypatch.setattr(G, "HELD_SLOTS", 1)
    rows = rows.repartition(7)
    assert found() == whole


def test_only_patterns_that_lost_a_line_are_counted_again(spark, lines):
    def found(frame):
        return sorted((r.pattern_id, r.support, r.line_number, str(r.slots)) for r in frame.collect())

    marked = G.with_marks(lines([f"a {i % 7} b {i}" for i in range(60)] + [f"c {i}" for i in range(40)]), ["transformed"])
    earlier = G.pattern_statistics(marked)
    assert found(earlier) == found(G.pattern_statistics(lines([f"a {i % 7} b {i}" for i in range(60)] + [f"c {i}" for i in range(40)])))
    rest = marked.filter("line_number > 10")
    lost = marked.filter("line_number <= 10").select("device_type", "vendor", "pattern_id").distinct()
    assert found(G.changed_statistics(rest, earlier, lost)) == found(G.pattern_statistics(rest))
    # Lines of the other pattern are not read: its statistics hold.
    gone = rest.filter("transformed like 'a %'")
    assert found(G.changed_statistics(gone, earlier, lost)) == found(G.pattern_statistics(rest))


def test_plain_texts_are_masked_like_all_others(spark, lines):
    """A text without the characters of any shape but numbers gives the same tokens."""
    texts = ["order 5 placed", "dot1x 7a a7 7", "x1y2z 12_3 _a1b", "0 0", "9x9 x9x"]
    rows = G.mask_lines(lines(texts)).orderBy("line_number").collect()
    # With a colon at the end, the same text meets all shapes.
    full = G.mask_lines(lines([f"{t}:" for t in texts])).orderBy("line_number").collect()
    for short, long in zip(rows, full):
        assert short.slot_values == long.slot_values
        assert [*long.constants[:-1], long.constants[-1][:-1]] == short.constants


def test_a_small_tree_is_one_job(spark, monkeypatch):
    """Below the first levels few patterns are left: no jobs for each further word."""
    words = ["red", "blue", "grey"]
    texts = [f"unit {words[i % 3]} of {words[i % 2]} city{chr(97 + i % 26)}x{chr(97 + i // 26)} is in {words[i % 3]} use" for i in range(180)]
    texts += [f"{chr(97 + i % 26)}q{chr(97 + i // 26)} went home now" for i in range(40)] + ["unit red of red", "a b c d"]
    rows = [("d", f"v{i % 2}", f"p{i}", t) for i, t in enumerate(texts * 2)]
    patterns = spark.createDataFrame(rows, "device_type string, vendor string, pattern_id string, transformed string")
    made, write = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name, folder=None: made.append(name) or write(df, name, folder))

    def groups():
        found = {}
        for r in G.open_word_tree(patterns).collect():
            found.setdefault((r.device_type, r.vendor, r.merged, tuple(r.open_words)), []).append(r.pattern_id)
        return sorted((k[0], k[1], k[3], tuple(sorted(v))) for k, v in found.items())

    at_once = groups()
    assert at_once and not [n for n in made if n.startswith("nodes_")]
    monkeypatch.setattr(G, "TREE_BYTES", 0)
    assert groups() == at_once and [n for n in made if n.startswith("nodes_")]


def test_lines_without_any_shape_are_one_constant(spark):
    """Letters alone make a value only in a payload, url, address, uuid or mac."""
    lines = {
        "plain words, no value.": [], "a: b - c . d": [], "see http://x.y/z now": ["http://x.y/z"], "to a@b.cd": ["a@b.cd"], "{a b} c": ["{a b}"],
        "id deadbeef-dead-beef-dead-deadbeefdead": ["deadbeef-dead-beef-dead-deadbeefdead"], "mac aa:bb:cc:dd:ee:ff": ["aa:bb:cc:dd:ee:ff"], "dead-beef": [], "n 7": ["7"],
    }
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    assert {r.t: r.v for r in df.select("t", G.values_of(G.line_tokens(F.col("t"))).alias("v")).collect()} == lines


def test_mined_regexes_are_read_without_the_parser(monkeypatch):
    from thresher.functions import dialect

    regexes = [r"a\.b (?P<n>.*) \(c\)", "", "(?P<a>.*)(?P<b>.*)", r"\\(?P<a>.*)", "text, only - é\n"]
    want = [dialect.compile_regex(f"{r}(?:)") for r in regexes]
    monkeypatch.setattr(dialect, "_parser", None)
    for regex, other in zip(regexes, want):
        own = dialect.compile_regex(regex)
        assert own[0] and own[2] == "linear" and own[5] == other[5] and own[7] == other[7]
    assert dialect.compile_regex(r"a\.b (?P<n>.*) \(c\)")[6] == ["a.b ", " (c)"]
