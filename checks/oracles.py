"""DuckDB SQL for the registered queries, on the same tables."""

from __future__ import annotations

from checks import fixtures as X
from checks.fixtures import APP_CTE, APP_MATCH_CTE, DOC_SQL, HOST_CTE, MANY_SQL, USER_SQL, WS_SQL, norm_sql, plain, quoted, with_sql
from checks.queries import ANSWER_EXPR, BLOCK, ROUTE_RULES
from thresher.operators.mine import OPEN_VALUES, SHAPES
from thresher.operators.proposals import PARSE_INSTRUCTIONS  # noqa: F401

USERS = ("users", USER_SQL)
BRE = r"([\\.^$*+?{}\[\]|()])"

HOST_HIT = (
    "hhit",
    "select l.*, u.template_id, u.regex, u.re2 from hnorm l left join users u on u.vendor = l.vendor and u.is_active"
    " and regexp_full_match(l.transformed, u.re2)",
)
HOST_CTES = [USERS, *HOST_CTE, HOST_HIT]
EXAMPLES = (
    "examples",
    "select device_type, vendor, template_id, min(line_number) as line_number, arg_min(transformed, line_number) as transformed,"
    " 'app.log' as source_id from hhit where template_id is not null group by all",
)
CANDIDATES = (
    "candidates",
    "select distinct 'application' as device_type, concat('host', cast(user_id % 5 as varchar)) as vendor,"
    " concat('digit-', left(cast(user_id as varchar), 1)) as candidate_id,"
    " concat('(.*) app\\[', left(cast(user_id as varchar), 1), '(.*)') as re2 from events",
)


def conflicts(where: str = "true") -> list[tuple[str, str]]:
    return [
        *HOST_CTES,
        EXAMPLES,
        CANDIDATES,
        (
            "found",
            "select c.device_type, c.vendor, c.candidate_id, e.template_id, e.transformed as example, e.line_number,"
            " row_number() over (partition by c.vendor, c.candidate_id order by e.line_number) as k"
            f" from candidates c join examples e on c.vendor = e.vendor and regexp_full_match(e.transformed, c.re2) where {where}",
        ),
    ]


ROUTE_TABLE = (
    "rules",
    " union all ".join(
        f"select {quoted(r.pattern)} as pattern, {quoted(r.device_type or 'unknown')} as device_type,"
        f" {quoted(r.vendor or 'unknown')} as vendor, {r.weight} as weight, {i} as rule"
        for i, r in enumerate(ROUTE_RULES)
    ),
)
SAMPLES = (
    "samples",
    "select * from (select *, row_number() over (partition by source_id order by line_number) as sample_no"
    " from many where raw_line <> '') where sample_no <= 12",
)
# Sources differ in their first samples, so each is a cache key of its own.
ROUTES = [
    ("many", MANY_SQL),
    SAMPLES,
    ROUTE_TABLE,
    (
        "votes",
        "select source_id, r.device_type, r.vendor, sum(weight) as score, min(rule) as rule from samples s"
        " join rules r on regexp_matches(s.raw_line, r.pattern) group by all",
    ),
    (
        "best",
        "select * from (select *, row_number() over (partition by source_id order by score desc, rule) as k from votes) where k = 1",
    ),
    (
        "routing",
        "select s.source_id, coalesce(b.device_type, 'unknown') as device_type, coalesce(b.vendor, 'unknown') as vendor,"
        " case when b.score is null then 'no rule matched' else concat('keyword score ', cast(b.score as varchar)) end as reasoning"
        " from (select distinct source_id from many) s left join best b using (source_id)",
    ),
]
MANY_HIT = [
    ("mnorm", norm_sql("many")),
    ("mhit", X.APP_MATCH_SQL.replace("from norm", "from mnorm")),
]
ANOMALIES = (
    "anomalies",
    "select source_id, 0 as k, concat(cast(count(*) as varchar), ' lines remain unmatched after template learning') as anomaly"
    " from mhit where template_id is null group by source_id"
    " union all select source_id, k, concat('Unmatched line ', cast(line_number as varchar), ': ', substring(raw, 1, 120)) from"
    " (select *, row_number() over (partition by source_id order by line_number) as k from mhit where template_id is null) where k <= 5",
)

# Values stand between two marks; a name with digits inside (group 2) is left as it is.
_VALUE = "|".join(f"(?:{shape})" for name, shape in SHAPES.items() if name != "num")
_MASK = rf"({_VALUE})|\b([A-Za-z]+[0-9]+[A-Za-z]+)|({SHAPES['num']})"
_MARKED = rf"regexp_replace(transformed, {quoted(_MASK)}, concat('\2', chr(17), '\1\3', chr(18)), 'g')"
_TOKENS = f"regexp_split_to_array(replace({_MARKED}, concat(chr(17), chr(18)), ''), concat('[', chr(17), chr(18), ']'))"
SPLIT = f"list_filter({_TOKENS}, lambda x, i: i % 2 = 1)"
VALUES = f"list_filter({_TOKENS}, lambda x, i: i % 2 = 0)"


def kind_sql(value: str) -> str:
    return (
        "case "
        + " ".join(f"when regexp_full_match({value}, {quoted(shape)}) then '{name}'" for name, shape in SHAPES.items())
        + " else 'word' end"
    )


def mined(source: str, branch_support: int = 10) -> list[tuple[str, str]]:
    """Masked patterns, their slots and the spelled-out candidate."""
    return [
        (
            "masked",
            f"select device_type, vendor, source_id, line_number, transformed, {SPLIT} as constants, {VALUES} as vals from {source} where transformed <> ''",
        ),
        (
            "patterns",
            "select device_type, vendor, constants, count(*) as support, min(line_number) as line_number,"
            " arg_min(transformed, line_number) as transformed, arg_min(vals, line_number) as vals from masked group by all",
        ),
        (
            "slots",
            "select device_type, vendor, constants, position, count(*) as support, count(distinct val) as n from"
            " (select device_type, vendor, constants, unnest(vals) as val, unnest(range(1, len(vals) + 1)) as position from masked) group by all",
        ),
        (
            "pieces",
            "select p.device_type, p.vendor, p.constants, p.line_number, p.i, p.constants[p.i] as c, p.vals[p.i] as v,"
            f" coalesce(s.n = 1 and s.support >= {branch_support}, false) as branch, p.i > len(p.vals) as last, "
            + kind_sql("p.vals[p.i]")
            + " as kind from (select *, unnest(range(1, len(constants) + 1)) as i from patterns) p left join slots s"
            " on s.vendor = p.vendor and s.constants = p.constants and s.position = p.i",
        ),
        (
            "spelled",
            "select device_type, vendor, line_number, count(*) filter (not branch and not last) as n_variables,"
            " string_agg(concat(c, case when last then '' when branch then v else concat('<', kind, cast(i as varchar), '>') end), '' order by i) as template,"
            f" string_agg(concat(regexp_replace(c, '{BRE}', '\\\\\\1', 'g'), case when last then '' when branch then regexp_replace(v, '{BRE}', '\\\\\\1', 'g')"
            " else concat('(?P<', kind, cast(i as varchar), '>.*)') end), '' order by i) as regex from pieces group by all",
        ),
        (
            "cand",
            "select s.*, p.support, p.transformed from spelled s join patterns p on s.vendor = p.vendor and s.line_number = p.line_number",
        ),
    ]


CONSTANTS = (
    "array_to_string(list_filter(list_transform(regexp_split_to_array({t}, '<[^>]+>'), lambda x: trim(x, {ws})), lambda x: x <> ''), '|')"
)


def constants_sql(text: str) -> str:
    return CONSTANTS.format(t=text, ws=WS_SQL)


# Round 1 takes orders, shipments and the first state; each later round the next state.
OUTCOMES = [
    ("lines", X.OUTCOME_SQL),
    (
        "kinds",
        "select line_number, case when raw_line like 'order %' then 'a' when raw_line like 'ship %' then 'b'"
        " when raw_line like 'fault %' then 'd' else concat('c', split_part(raw_line, ' ', 2)) end as kind from lines",
    ),
    ("firsts", "select kind, min(line_number) as line_number from kinds group by kind"),
    ("states", "select kind, row_number() over (order by line_number) as round from firsts where kind like 'c%'"),
    (
        "audit",
        "select f.kind, f.line_number, coalesce(s.round, 1) as round,"
        " case when f.kind = 'd' then 'rejected' when f.kind = 'b' then 'replaced' when s.round < 3 then 'refined' else 'stored' end as outcome"
        " from firsts f left join states s using (kind)",
    ),
    (
        "named",
        "select kind, concat('application-generic-', printf('%04d', row_number() over (order by round, line_number))) as template_id"
        " from audit where outcome <> 'rejected'",
    ),
]

NEW_ROWS = (
    "fresh",
    "select 'application' as device_type, concat('host', cast(user_id % 5 as varchar)) as vendor, min(event_id) + 1 as line_number,"
    " case when user_id % 3 = 0 then concat('application-host', cast(user_id % 5 as varchar), '-', printf('%04d', user_id)) else 'none' end as template_id,"
    " concat('purchase (?P<u>.*) ', cast(user_id as varchar), case when user_id % 17 = 0 then '(' else '' end) as regex, user_id % 17 = 0 as broken"
    " from events where event_type = 'purchase' group by user_id",
)
NEXT = (
    "nxt",
    "select vendor, max(seq) as last_seq, case when vendor = 'host0' then 99999 else max(cast(split_part(template_id, '-', 3) as bigint)) + 1 end as next_no"
    " from users group by vendor",
)


def allocated(rows: str) -> str:
    return (
        "select device_type, vendor, line_number, regex, concat('application-', vendor, '-', lpad(cast(next_no + n - 1 as varchar),"
        " cast(greatest(4, len(cast(next_no + n - 1 as varchar))) as int), '0')) as template_id, last_seq + n as seq from"
        f" (select f.*, x.next_no, x.last_seq, row_number() over (partition by f.vendor order by f.line_number) as n from {rows} f join nxt x on x.vendor = f.vendor)"
    )


ATTEMPTS = [
    (
        "ranked",
        "select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) - 1 as attempt from events",
    ),
    (
        "attempts",
        "select cast(user_id as varchar) as candidate_id, attempt, case event_type when 'error' then '(' when 'view' then 'user (?P<u>.*)'"
        " when 'click' then 'nothing' when 'signup' then concat('user ', cast(user_id as varchar), ' (?P<what>.*)') else 'user (?P<u>.*) gone' end as regex,"
        " event_type in ('view', 'signup') as is_valid from ranked",
    ),
]


def first_attempt() -> str:
    return with_sql(*ATTEMPTS) + (
        "select candidate_id, attempt, regex, is_valid from (select *, row_number() over (partition by candidate_id order by is_valid desc,"
        f" case when is_valid then attempt else -attempt end) as k from attempts) where k = 1"
    )


def group_values(regex: str, text: str = "transformed") -> str:
    """Sorted key=value text of the named groups of a literal regex."""
    import re

    names = re.findall(r"\(\?P<(\w+)>", regex)
    p = quoted(plain(regex))
    parts = [f"'{n}=', regexp_extract({text}, {p}, {i + 1})" for i, n in enumerate(names)]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return "concat(" + ", ';', ".join(parts[i] for i in order) + ")"


APP_VALUES = (
    "case template_id "
    + " ".join(f"when {quoted(tid)} then {group_values(regex)}" for _, tid, regex, active in X.APP_TEMPLATES if active)
    + " else '' end"
)

# What learning adds to the fixture: the two kinds of INFO lines are one pattern
# each, purchases being covered already.
SIGNUP = r"(?P<time1>.*) host(?P<num2>.*) app\[(?P<num3>.*)\]: INFO new account u(?P<num4>.*) from (?P<ip5>.*)"
LEARNED = [
    *APP_MATCH_CTE,
    ("rest", "select *, 'application' as device_type, 'generic' as vendor from (select * exclude (template_id) from hit where template_id is null)"),
    *mined("rest"),
    (
        "uncovered",
        "select * from cand c where not exists (select 1 from cand e where e.line_number < c.line_number"
        " and regexp_full_match(c.transformed, e.regex))",
    ),
    (
        "numbered",
        "select *, concat('application-generic-', printf('%04d', row_number() over (order by line_number))) as new_id from uncovered",
    ),
    (
        "gained",
        "select r.source_id, r.line_number, r.raw, r.transformed, min(n.new_id) as new_id from rest r left join numbered n"
        " on regexp_full_match(r.transformed, n.regex) group by all",
    ),
]
PARSED = [
    *LEARNED,
    (
        "parsed",
        "select line_number, template_id, raw, transformed from hit where template_id is not null"
        " union all select line_number, new_id, raw, transformed from gained",
    ),
]

ANSWER = ANSWER_EXPR.format(str="varchar", quote="", cut="substring")
_SHAPE = "(conv_id + turn) % 8"

ORACLES = {
    "read_log_lines": with_sql(("log", X.LOG_SQL)) + "select line_number, raw_line from log",
    "decode_lossy": with_sql(("log", X.LOG_SQL)) + "select line_number, raw_line from log",
    "write_parsed_tsv": with_sql(*APP_MATCH_CTE)
    + "select concat(cast(line_number as varchar), chr(9), coalesce(template_id, ''), chr(9), raw) as text from hit",
    "write_template_snapshot": with_sql(USERS)
    + "select 'v1' as version, case when vendor = 'host1' then '%Y-%m-%d' end as time_format,"
    " row_number() over (partition by vendor, (seq - 1) // 10000 order by seq) - 1 as position, template_id, regex, usage_count,"
    " true as template_left_out from users",
    "load_library": with_sql(USERS)
    + "select device_type, vendor, template_id, regex, '' as template,"
    " case when row_number() over (partition by vendor, seq // 1000 order by seq) = 1 then -1 else usage_count end as usage_count,"
    " cast(0 as bigint) as failure_count, 'llm' as source, 'v1' as version, is_active, cast(0 as bigint) as n_variables from users",
    "quarantine_corrupt": with_sql(USERS)
    + "select template_id, case when seq % 2 = 0 then 'quarantined' else 'read' end as status from users",
    "save_library": with_sql(USERS)
    + "select device_type, vendor, seq, template_id, regex, usage_count + 1 as usage_count, failure_count, notes, is_active,"
    " 'True False True' as written from users",
    "reload_template": with_sql(USERS)
    + "select device_type, vendor, template_id, case when seq % 3 <> 0 and seq % 5 = 0 then null else regex end as regex,"
    " case when seq % 3 <> 0 then 'stored' else notes end as notes from users",
    "normalize_lines": with_sql(
        (
            "log",
            "select line_number, concat(chr(9), '  ', raw_line, ['', chr(9), ' ' || chr(160), chr(28) || ' ' || chr(12288)][cast(line_number % 4 as int) + 1]) as raw_line"
            f" from ({X.LOG_SQL})",
        ),
        ("norm", norm_sql("log")),
    )
    + "select line_number, raw, transformed from norm",
    "sample_head": with_sql(("many", MANY_SQL), SAMPLES) + "select source_id, line_number, raw_line, sample_no from samples",
    "active_templates": with_sql(USERS) + "select device_type, vendor, seq, template_id, regex from users where is_active",
    "valid_regex": with_sql(USERS)
    + "select template_id, seq % 13 <> 0 as valid, case when seq % 13 = 0 then true end as has_error from users",
    "unmatched_rows": with_sql(*APP_MATCH_CTE)
    + "select line_number, template_id, cast(0 as bigint) as n_variables, raw from hit where template_id is null",
    "unmatched_anomalies": with_sql(("many", MANY_SQL), *MANY_HIT, ANOMALIES) + "select source_id, anomaly from anomalies",
    "unknown_routes": with_sql(*ROUTES)
    + "select source_id, device_type, vendor from routing where device_type = 'unknown' or vendor = 'unknown'",
    "match_templates": with_sql(*APP_MATCH_CTE) + "select line_number, template_id, raw from hit",
    "match_templates_large": with_sql(*HOST_CTES) + "select line_number, vendor, template_id from hhit",
    "extract_variables": with_sql(*APP_MATCH_CTE)
    + f"select line_number, template_id, {APP_VALUES} as variables from hit where template_id is not null",
    "split_matched": with_sql(*APP_MATCH_CTE)
    + "select coalesce(template_id, '') as template_id, count(*) as lines, min(line_number) as first_line,"
    " case when template_id is null then 'unmatched' else 'matched' end as part from hit group by template_id",
    "rematch_remaining": with_sql(*APP_MATCH_CTE)
    + f"select line_number, template_id from hit where not regexp_full_match(transformed, {quoted(plain(X.APP_TEMPLATES[1][2]))})",
    "detect_conflicts": with_sql(*conflicts())
    + "select c.device_type, c.vendor, c.candidate_id, coalesce(string_agg(f.template_id, '|' order by k), '') as conflicts"
    " from candidates c left join found f using (vendor, candidate_id) group by all",
    "conflict_pairs": with_sql(*conflicts())
    + "select f.device_type, f.vendor, f.candidate_id, f.template_id, u.regex, f.example from found f join users u using (template_id) where u.seq % 2 = 0",
    "template_usage": with_sql(*HOST_CTES)
    + "select u.device_type, u.vendor, u.template_id, any_value(u.usage_count) + count(h.line_number) as usage_count"
    " from users u left join hhit h on h.template_id = u.template_id group by all",
    "template_examples": with_sql(*HOST_CTES, EXAMPLES)
    + "select device_type, vendor, template_id, 'old.log' as source_id, cast(0 as bigint) as line_number, 'known' as transformed from users where seq % 2 = 1"
    " union all select e.device_type, e.vendor, e.template_id, e.source_id, e.line_number, e.transformed from examples e join users u using (template_id) where u.seq % 2 = 0",
    "mark_failures": with_sql(USERS)
    + "select device_type, vendor, template_id, failure_count + case when user_id % 11 = 0 then 0 else failure_count end as failure_count from users",
    "cleanup_templates": with_sql(
        USERS,
        (
            "judged",
            "select *, usage_count < 20 or (case when usage_count + failure_count > 0 then failure_count / (usage_count + failure_count) else 0 end) > 0.3 as held from users",
        ),
    )
    + "select device_type, vendor, template_id, is_active and not held as is_active, held from judged",
    "cleanup_all": with_sql(
        USERS,
        (
            "judged",
            "select *, usage_count < 20 or (case when usage_count + failure_count > 0 then failure_count / (usage_count + failure_count) else 0 end) > 0.3 as held from users",
        ),
    )
    + "select l.device_type, l.vendor, j.template_id from (select distinct device_type, vendor from users) l"
    " left join judged j on j.vendor = l.vendor and j.held",
    "parse_report": with_sql(
        *ROUTES,
        *MANY_HIT,
        ANOMALIES,
        (
            "firsts",
            "select template_id, min({'s': source_id, 'l': line_number}).s as source_id from mhit where template_id is not null group by template_id",
        ),
    )
    + "select r.source_id, r.device_type, r.vendor, r.reasoning, count(*) as processed_lines, count(m.template_id) as matched_lines,"
    " count(*) - count(m.template_id) as unmatched_lines,"
    " (select count(*) from firsts f where f.source_id = r.source_id) as new_templates,"
    " coalesce((select string_agg(anomaly, '|' order by k) from anomalies a where a.source_id = r.source_id), '') as anomalies"
    " from routing r join mhit m using (source_id) group by all",
    "constant_coverage": with_sql(
        USERS,
        (
            "seg",
            "select *, list_filter(regexp_split_to_array(template, '<[^>]+>'), lambda x: trim(x) <> '') as s from users",
        ),
        (
            "m",
            "select *, len(array_to_string(s, '')) as constant_chars, len(template) as total_chars from seg",
        ),
    )
    + "select device_type, vendor, template_id, constant_chars, total_chars, constant_chars / total_chars as constant_ratio,"
    " array_to_string(s, '|') as segments, constant_chars / total_chars >= 0.2 and constant_chars >= 12 and len(s) >= 2 as covered from m",
    "list_templates": with_sql(USERS)
    + "select device_type, vendor, seq, template_id, regex, usage_count, failure_count, notes, is_active, 12 as n_columns from users",
    "list_libraries": with_sql(USERS) + "select distinct device_type, vendor from users",
    "allocate_template_ids": with_sql(USERS, NEW_ROWS, NEXT, ("a", allocated("fresh")))
    + "select device_type, vendor, line_number, template_id, seq from a",
    "upsert_templates": with_sql(
        USERS,
        NEW_ROWS,
        NEXT,
        ("usable", "select * from fresh where not broken"),
        ("new", "select * from usable where template_id not in (select template_id from users)"),
        ("a", allocated("new")),
    )
    + "select u.device_type, u.vendor, u.seq, u.template_id, coalesce(f.regex, u.regex) as regex,"
    " case when f.regex is null then u.usage_count else 0 end as usage_count from users u left join usable f on f.template_id = u.template_id"
    " union all select device_type, vendor, seq, template_id, regex, 0 from a",
    "first_valid_attempt": first_attempt(),
    "refine_invalid": first_attempt(),
    "ordered_results": with_sql(*APP_MATCH_CTE) + "select source_id, line_number, template_id, raw from hit order by line_number",
    "render_template": with_sql(*HOST_CTES, EXAMPLES)
    + f"select e.device_type, e.vendor, e.template_id, u.template, {constants_sql('u.template')} as constants,"
    " repeat(e.transformed, 5) as notes from examples e join users u using (template_id)",
    "template_variables": with_sql(*HOST_CTES, EXAMPLES)
    + "select e.device_type, e.vendor, e.template_id, concat('time=', regexp_extract(e.transformed, u.re2, 1), '|message=',"
    " regexp_extract(e.transformed, u.re2, 2)) as variables from examples e join users u using (template_id)",
    "extract_constants": with_sql(
        *APP_CTE, ("t", "select line_number, regexp_replace(transformed, '([0-9]+)', '<n\\1>', 'g') as template from norm")
    )
    + f"select line_number, {constants_sql('template')} as constants from t",
    "template_digest_id": with_sql(USERS)
    + "select template_id, concat('big_switch-', vendor, '-', left(sha1(template), 8)) as digest_id from users",
    "variable_names": with_sql(USERS)
    + "select template_id, array_to_string(regexp_extract_all(regex, '\\(\\?P<(\\w+)>', 1), '|') as names from users",
    "mask_json_payloads": with_sql(*APP_CTE)
    + "select line_number, regexp_replace(transformed, '\\{[^{}]*\\}', '<json>', 'g') as masked,"
    " cast(len(regexp_extract_all(transformed, '\\{[^{}]*\\}')) as bigint) as payloads,"
    " coalesce(array_to_string(list_transform(regexp_extract_all(transformed, '\\{[^{}]*\\}'), lambda p: array_to_string(json_keys(p), ',')), '|'), '') as keys from norm",
    "routing_cache_key": with_sql(
        (
            "dl",
            "select cast(doc_id as varchar) as source_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_number,"
            " unnest(string_split(text, chr(10))) as raw_line from documents",
        ),
        ("heads", "select *, row_number() over (partition by source_id order by line_number) as k from dl where raw_line <> ''"),
        (
            "lists",
            f"select source_id, list(trim(raw_line, {WS_SQL}) order by line_number) as samples from heads"
            f" where k <= 12 and trim(raw_line, {WS_SQL}) <> '' group by source_id",
        ),
    )
    + "select count(*) as sources, min(source_id) as first_source from lists group by samples",
    "parse_timestamps_formats": "select event_id + 1 as line_number, case when user_id % 5 = 0"
    " then make_timestamp(2024, month(ts), day(ts), hour(ts), minute(ts), second(ts)) else date_trunc('second', ts) end as event_time from events",
    "learn_proposals": "select conv_id * 1000 + turn + 1 as line_number, concat('application-generic-', printf('%04d',"
    " (select count(*) from (select role, min(conv_id * 1000 + turn) as f from conversations group by role) r"
    " where r.f <= (select min(conv_id * 1000 + turn) from conversations d where d.role = c.role)))) as template_id from conversations c",
    "route_sources": with_sql(*ROUTES) + "select source_id, device_type, vendor, reasoning from routing",
    "infer_timestamp_spec": with_sql(("many", MANY_SQL), SAMPLES)
    + "select source_id, '%Y-%m-%d %H:%M:%S' as format, true as has_year, arg_min(e, line_number) as example from"
    " (select *, regexp_extract(raw_line, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') as e from samples) where e <> '' group by source_id",
    "get_or_create_spec": with_sql(USERS, ("hlog", X.HOST_SQL))
    + "select 'application' as device_type, vendor, case when vendor = 'host1' then '%Y-%m-%d' else '%Y-%m-%d %H:%M:%S' end as format, true as has_year,"
    " case when vendor <> 'host1' then arg_min(left(raw_line, 19), line_number) end as example from hlog where raw_line <> '' group by vendor",
    "parse_timestamps": with_sql(*HOST_CTE)
    + "select line_number, case when vendor in ('host0', 'host1', 'host2') then try_strptime(regexp_extract(raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}'), '%Y-%m-%d %H:%M:%S')"
    " when vendor = 'host3' then try_strptime(concat('2023 ', regexp_extract(raw, '[0-9]{4}-([0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2})', 1)), '%Y %m-%d %H:%M') end as event_time from hnorm",
    "mine_candidates": with_sql(*APP_CTE, ("src", "select *, 'application' as device_type, 'generic' as vendor from norm"), *mined("src"))
    + f"select line_number, support, template, regex, {constants_sql('template')} as constants, n_variables, transformed from cand",
    "mine_patterns_prose": with_sql(("doc", DOC_SQL), ("dnorm", norm_sql("doc")))
    + f"select min({{'s': source_id, 'l': line_number}}).s as source_id, min({{'s': source_id, 'l': line_number}}).l as line_number, count(*) as support"
    f" from (select source_id, line_number, {SPLIT} as constants from dnorm where transformed <> '') group by constants",
    "classify_slots": with_sql(*APP_CTE, ("src", "select *, 'application' as device_type, 'generic' as vendor from norm"), *mined("src"))
    + f"select p.line_number as first_line, s.position, s.support, least(s.n, {OPEN_VALUES + 1}) as distinct_values,"
    " case when s.support >= 10 and s.n = 1 then 'branch' else 'fruit' end as role from slots s join patterns p on p.constants = s.constants",
    "generalize_words": with_sql(
        ("log", X.NATION_SQL),
        ("norm", norm_sql("log")),
        ("w", "select line_number, regexp_extract(transformed, ' in (.*) ready', 1) as word from norm"),
        ("n", "select count(distinct word) as words from w"),
        (
            "g",
            f"select line_number, case when words > {OPEN_VALUES} then null else word end as word from w, n",
        ),
    )
    + "select min(line_number) as line_number, count(*) as support, concat('shipper <num1> in ', coalesce(word, '<word2>'), ' ready') as template,"
    " concat('shipper (?P<num1>.*) in ', coalesce(word, '(?P<word2>.*)'), ' ready') as regex from g group by word",
    "generalize_two_words": with_sql(
        ("log", X.SHIPMENT_SQL),
        ("w", "select flag, min(line_number) as line_number, count(*) as support, count(distinct p_brand) as brands, count(distinct n_name) as nations from log group by flag"),
    )
    + "select line_number, support, concat('shipment <num1> of <word2> by <word3> flag ', flag) as template,"
    " concat('shipment (?P<num1>.*) of (?P<word2>.*) by (?P<word3>.*) flag ', flag) as regex"
    f" from w where brands > {OPEN_VALUES} and nations > {OPEN_VALUES}",
    "validate_candidates": with_sql(*conflicts(where="c.candidate_id not in ('digit-1', 'digit-2')"))
    + "select device_type, vendor, candidate_id, candidate_id not in ('digit-1', 'digit-2') and n = 0 as is_valid,"
    " case when candidate_id = 'digit-1' then 'invalid regex' when candidate_id = 'digit-2' then 'generated regex does not match the source sample'"
    " when n > 0 then concat('conflicts with existing templates: ', shown) else '' end as reasons, conflicts from"
    " (select c.device_type, c.vendor, c.candidate_id, count(f.template_id) as n, string_agg(f.template_id, ', ' order by f.k) as shown,"
    " coalesce(string_agg(f.template_id, '|' order by f.k), '') as conflicts"
    " from candidates c left join found f using (vendor, candidate_id) group by c.device_type, c.vendor, c.candidate_id)",
    "resolve_replace": with_sql(*conflicts())
    + "select u.device_type, u.vendor, u.template_id, u.is_active and not (u.template_id in (select template_id from found)) as is_active,"
    " u.template_id in (select template_id from examples) and not (u.template_id in (select template_id from found)) as has_example from users u",
    "resolve_refine": with_sql(
        *APP_CTE, ("click", "select min(line_number) as line_number, arg_min(transformed, line_number) as t from norm where contains(transformed, 'GET /click/')")
    )
    + "select line_number, cast(1 as bigint) as attempt, true as is_valid,"
    " concat('<time1> host', regexp_extract(t, 'host([0-9])', 1), ' app[<num3>]: GET /click/<num4> 302 <num6>ms') as template,"
    " concat('(?P<time1>.*) host', regexp_extract(t, 'host([0-9])', 1), ' app\\[(?P<num3>.*)\\]: GET /click/(?P<num4>.*) 302 (?P<num6>.*)ms') as regex from click",
    "build_conflict_requests": with_sql(*conflicts())
    + "select device_type, vendor, candidate_id, 'conflict' as kind, count(*) as conflicts, arg_min(example, k) as first_example from found group by all",
    "build_refinement_requests": with_sql(*ATTEMPTS)
    + "select candidate_id, 'refine' as kind, concat('Source: device_type=application, vendor=host', cast(cast(candidate_id as bigint) % 5 as varchar), chr(10), chr(10),"
    " 'Problems:', chr(10), '- ', case when regex = '(' then 'invalid regex produced by LLM (missing ), unterminated subpattern at position 0)'"
    " else 'generated regex does not match the source sample' end, chr(10), chr(10), 'Regex: ', regex, chr(10), chr(10),"
    " 'Groups: ', case when regex in ('nothing', '(') then '' else 'u' end, chr(10), chr(10), 'Log line: user ', candidate_id, ' done',"
    " chr(10), chr(10), 'Attempt: ', cast(attempt as varchar)) as content from attempts where not is_valid",
    "build_source_requests": with_sql(("many", MANY_SQL), SAMPLES)
    + "select source_id, kind, string_agg(trim(raw_line, " + WS_SQL + "), chr(10) order by line_number) as content"
    " from samples, (select unnest(['route', 'timestamp']) as kind) where trim(raw_line, " + WS_SQL + ") <> '' group by all",
    "learn_templates": with_sql(*LEARNED) + "select line_number, new_id as template_id from gained",
    "learning_audit": with_sql(*LEARNED)
    + "select line_number, concat('application-generic-', left(sha1(template), 8)) as candidate_id, new_id as template_id, 'stored' as outcome,"
    " 'stored template' as detail, cast(1 as bigint) as round from numbered",
    "learn_outcomes": with_sql(*OUTCOMES) + "select line_number, template_id from kinds left join named using (kind)",
    "learning_audit_outcomes": with_sql(*OUTCOMES)
    + "select line_number, template_id, outcome, round, case outcome when 'stored' then 'stored template'"
    " when 'refined' then 'refined candidate to avoid conflicts'"
    " when 'replaced' then concat('replaced ', cast((select count(*) from orders where o_orderkey % 1000 = 0) as varchar), ' conflicting templates')"
    " else 'conflict persists after reconciliation attempts: old-fault' end as detail from audit left join named using (kind)",
    "ingest_proposals": "select conv_id, turn,"
    f" case {_SHAPE} when 0 then 'a.*' when 1 then '(?P<x>.*)' when 2 then 'b' end as regex,"
    f" case {_SHAPE} when 0 then 'r' when 1 then role when 6 then 'number' else '' end as reasoning,"
    f" case {_SHAPE} when 3 then 'refine_candidate' end as decision,"
    f" case {_SHAPE} when 3 then role end as new_regex,"
    f" case {_SHAPE} when 2 then concat(role, '|2') else '' end as replaced_ids,"
    f" {_SHAPE} in (0, 1, 2, 3) as usable from conversations",
    "build_proposal_requests": with_sql(*HOST_CTE, *mined("hnorm"))
    + "select vendor, 'parse' as kind, cast(2 as bigint) as n_messages, concat('Source: device_type=application, vendor=', vendor, chr(10), chr(10),"
    " case when vendor in ('host0', 'host1', 'host2') then concat('Timestamp: ^(?P<ts>[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}) as %Y-%m-%d %H:%M:%S', chr(10), chr(10))"
    " when vendor = 'host3' then concat('Timestamp: [0-9]{4}-(?P<ts>[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}) as %m-%d %H:%M', chr(10), chr(10)) else '' end,"
    " 'Log line: ', transformed) as content from patterns",
    "parse_logs": with_sql(*PARSED) + "select line_number, template_id, raw from parsed",
    "parsed_wide": with_sql(*PARSED)
    + f"select line_number, template_id, case when template_id = 'application-generic-0001' then {group_values(SIGNUP)} else {APP_VALUES} end as variables from parsed",
    "parse_many_sources": with_sql(*ROUTES, ("mnorm", norm_sql("many")))
    + "select source_id, device_type, vendor, count(*) as processed_lines,"
    " count(*) filter (transformed <> '') as matched_lines, count(*) filter (transformed = '') as unmatched_lines"
    " from mnorm join routing using (source_id) group by source_id, device_type, vendor",
    "stream_match": with_sql(*APP_MATCH_CTE) + f"select line_number, template_id, {APP_VALUES} as variables from hit",
    "stream_learn": with_sql(*APP_CTE, ("src", "select *, 'application' as device_type, 'generic' as vendor from norm"), *mined("src"))
    + "select n.line_number, p.id as template_id from norm n left join masked m using (line_number) left join"
    " (select constants, concat('application-generic-', printf('%04d', row_number() over (order by line_number))) as id from patterns) p on p.constants = m.constants",
    "stream_usage": with_sql(
        *APP_MATCH_CTE,
        (
            "timed",
            "select *, try_strptime(regexp_extract(raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}'), '%Y-%m-%d %H:%M:%S') as t from hit where template_id is not null",
        ),
        ("mark", "select max(t) - interval 1 hour as w from timed"),
    )
    + "select date_trunc('day', t) as window_start, template_id, count(*) as usage from timed, mark"
    " where date_trunc('day', t) + interval 1 day <= w group by all",
}
