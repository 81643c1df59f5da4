"""Log lines and template libraries derived from the test tables.

Each fixture exists twice: as a DataFrame and as DuckDB SQL (the text of a common
table expression), so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher import schemas as S
from thresher.functions import text as X
from thresher.operators.lines import WHITESPACE, normalize_lines
from thresher.session import spread

DEVICE, VENDOR = "application", "generic"

_BODY = """case when event_id % 211 = 0 then '' else concat(
    {ts}, ' host', cast(user_id % 5 as {str}), ' app[', cast(user_id as {str}), ']: ',
    case event_type
      when 'error'    then concat('ERROR  request failed: user=', cast(user_id as {str}), ' cost=', {fmt}, ' payload=', props)
      when 'purchase' then concat('INFO purchase accepted for user ', cast(user_id as {str}), ' amount ', {fmt})
      when 'signup'   then concat('INFO   new account u', cast(user_id as {str}), ' from 10.0.', cast(user_id % 7 as {str}), '.', cast(user_id as {str}))
      when 'view'     then concat('GET /item/', cast(event_id % 97 as {str}), ' 200 ', {fmt}, 'ms   ')
      else                 concat('GET /click/', cast(user_id as {str}), ' 302 ', {fmt}, 'ms')
    end) end"""
_ORDER = """concat({day}, ' ordersvc: order ', cast(o_orderkey as {str}), ' customer=', cast(o_custkey as {str}),
    ' status=', o_orderstatus, ' priority=', o_orderpriority)"""
_SPARK = {
    "str": "string",
    "fmt": "format_string('%.2f', value)",
    "ts": "date_format(ts,'yyyy-MM-dd HH:mm:ss')",
    "day": "date_format(o_orderdate,'yyyy-MM-dd HH:mm:ss')",
}
_DUCK = {
    "str": "varchar",
    "fmt": "printf('%.2f', value)",
    "ts": "strftime(ts,'%Y-%m-%d %H:%M:%S')",
    "day": "strftime(o_orderdate,'%Y-%m-%d %H:%M:%S')",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# --- lines -----------------------------------------------------------------------


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source, one library."""
    return table(spark, sf_dir, "events").select(
        F.lit("app.log").alias("source_id"),
        (F.col("event_id") + 1).alias("line_number"),
        F.expr(_BODY.format(**_SPARK)).alias("raw_line"),
    )


def many_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source per host, one for orders, and one per document source."""
    hosts = table(spark, sf_dir, "events").select(
        F.expr("concat('host', cast(user_id % 5 as string), '.log')").alias("source_id"),
        (F.col("event_id") + 1).alias("line_number"),
        F.expr(_BODY.format(**_SPARK)).alias("raw_line"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.lit("orders.log").alias("source_id"),
        (F.col("o_orderkey") + 1).alias("line_number"),
        F.expr(_ORDER.format(**_SPARK)).alias("raw_line"),
    )
    return hosts.unionByName(orders).unionByName(document_lines(spark, sf_dir))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("p", "raw_line")
    ).select("source_id", (F.col("doc_id") * 1000000 + F.col("p") + 1).alias("line_number"), "raw_line")


def in_library(lines: DataFrame, device: str = DEVICE, vendor: str = VENDOR) -> DataFrame:
    return normalize_lines(lines).withColumn("device_type", F.lit(device)).withColumn(
        "vendor", F.lit(vendor)
    )


def app_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized lines of the single-source fixture, with their library."""
    return in_library(log_lines(spark, sf_dir))


def host_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines, with one library per host."""
    lines = table(spark, sf_dir, "events").select(
        F.lit("app.log").alias("source_id"),
        (F.col("event_id") + 1).alias("line_number"),
        F.expr(_BODY.format(**_SPARK)).alias("raw_line"),
        F.lit(DEVICE).alias("device_type"),
        F.expr("concat('host', cast(user_id % 5 as string))").alias("vendor"),
    )
    return normalize_lines(lines)


WS_SQL = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def norm_sql(source: str) -> str:
    return (
        f"select *, rtrim(raw_line, {WS_SQL}) as raw,"
        f" regexp_replace(rtrim(raw_line, {WS_SQL}), ' {{2,}}', ' ', 'g') as transformed from {source}"
    )


LOG_SQL = f"select 'app.log' as source_id, event_id + 1 as line_number, {_BODY.format(**_DUCK)} as raw_line from events"
HOST_SQL = (
    f"select 'app.log' as source_id, event_id + 1 as line_number, {_BODY.format(**_DUCK)} as raw_line,"
    f" '{DEVICE}' as device_type, concat('host', cast(user_id % 5 as varchar)) as vendor from events"
)
DOC_SQL = (
    "select source as source_id, doc_id * 1000000 + unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_number,"
    " unnest(string_split(text, chr(10))) as raw_line from documents"
)
MANY_SQL = (
    f"select concat('host', cast(user_id % 5 as varchar), '.log') as source_id, event_id + 1 as line_number, {_BODY.format(**_DUCK)} as raw_line from events"
    f" union all select 'orders.log', o_orderkey + 1, {_ORDER.format(**_DUCK)} from orders"
    f" union all {DOC_SQL}"
)


def with_sql(*parts: tuple[str, str]) -> str:
    return "with " + ",\n".join(f"{name} as ({body})" for name, body in parts) + "\n"


APP_CTE = [("log", LOG_SQL), ("norm", norm_sql("log"))]
HOST_CTE = [("hlog", HOST_SQL), ("hnorm", norm_sql("hlog"))]

# --- a small literal library for the single-source lines -------------------------

APP_TEMPLATES = [
    (1, "app-0001", r"(?P<ts>.*) (?P<host>.*) app\[(?P<pid>.*)\]: ERROR request failed: user=(?P<user>.*) cost=(?P<cost>.*) payload=(?P<payload>.*)", True),
    (2, "app-0002", r"(?P<ts>.*) (?P<host>.*) app\[(?P<pid>.*)\]: GET (?P<path>.*) (?P<code>.*) (?P<ms>.*)ms", True),
    (3, "app-0003", r"(?P<ts>.*) (?P<host>.*) app\[(?P<pid>.*)\]: GET /item/(?P<item>.*) 200 (?P<ms>.*)ms", True),
    (4, "app-0004", r"(?P<ts>.*) (?P<host>.*) app\[(?P<pid>.*)\]: INFO (?P<text>.*)", False),
    (5, "app-0005", r"(?P<ts>.*) host(?P<n>[0-9]) app\[(?P<pid>\d{1,9})\]: INFO purchase accepted for user (?P<user>.*) amount (?P<amount>.*)", True),
]


def app_templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(APP_TEMPLATES, "seq bigint, template_id string, regex string, is_active boolean")
    return complete(rows.withColumn("device_type", F.lit(DEVICE)).withColumn("vendor", F.lit(VENDOR)))


def plain(regex: str) -> str:
    """Named groups as plain ones, for RE2."""
    import re

    return re.sub(r"\(\?P<\w+>", "(", regex)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


APP_MATCH_SQL = (
    "select *, case "
    + " ".join(
        f"when regexp_full_match(transformed, {quoted(plain(regex))}) then {quoted(tid)}"
        for _, tid, regex, active in APP_TEMPLATES
        if active
    )
    + " end as template_id from norm"
)
APP_MATCH_CTE = [*APP_CTE, ("hit", APP_MATCH_SQL)]


def complete(rows: DataFrame, *extra: str) -> DataFrame:
    """Fill the template columns a fixture does not set."""
    fill = {
        "seq": F.lit(None),
        "template": F.lit(""),
        "variables": F.array(),
        "constants": F.array(),
        "usage_count": F.lit(0),
        "failure_count": F.lit(0),
        "timestamp_hint": F.lit(None),
        "source": F.lit("llm"),
        "notes": F.lit(""),
        "version": F.lit("v1"),
        "is_active": F.lit(True),
    }
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else fill[f.name]).cast(f.dataType).alias(f.name)
            for f in S.TEMPLATE.fields
        ],
        *extra,
    )


# --- a library that grows with the data: one template per user --------------------


def user_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host a library with a template per user; counts come from the events."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
    uid, host = F.col("user_id").cast("string"), (F.col("user_id") % 5).cast("string")
    template = F.concat(F.lit("<time> host"), host, F.lit(" app["), uid, F.lit("]: <message>"))
    rows = users.select(
        F.lit(DEVICE).alias("device_type"),
        F.concat(F.lit("host"), host).alias("vendor"),
        (F.col("user_id") + 1).alias("seq"),
        F.concat(F.lit("application-host"), host, F.lit("-"), F.format_string("%04d", F.col("user_id"))).alias("template_id"),
        template.alias("template"),
        F.concat(F.lit("(?P<time>.*) host"), host, F.lit(r" app\["), uid, F.lit(r"\]: (?P<message>.*)")).alias("regex"),
        X.extract_constants(template).alias("constants"),
        F.greatest(F.col("n") - 3 * F.col("errors"), F.lit(0)).alias("usage_count"),
        F.col("errors").alias("failure_count"),
        (F.col("user_id") % 7 != 0).alias("is_active"),
        F.concat(F.lit("user "), uid).alias("notes"),
    )
    return complete(rows)


USER_SQL = """select 'application' as device_type, concat('host', cast(user_id % 5 as varchar)) as vendor,
  user_id + 1 as seq, concat('application-host', cast(user_id % 5 as varchar), '-', printf('%04d', user_id)) as template_id,
  concat('<time> host', cast(user_id % 5 as varchar), ' app[', cast(user_id as varchar), ']: <message>') as template,
  concat('(?P<time>.*) host', cast(user_id % 5 as varchar), ' app\\[', cast(user_id as varchar), '\\]: (?P<message>.*)') as regex,
  concat('(.*) host', cast(user_id % 5 as varchar), ' app\\[', cast(user_id as varchar), '\\]: (.*)') as re2,
  cast(greatest(count(*) - 3 * count(*) filter (event_type = 'error'), 0) as bigint) as usage_count,
  count(*) filter (event_type = 'error') as failure_count,
  user_id % 7 <> 0 as is_active, concat('user ', cast(user_id as varchar)) as notes, user_id
  from events group by user_id"""


def user_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library metadata; host0 has a stored sequence, host1 a stored timestamp spec."""
    libraries = user_templates(spark, sf_dir).select("device_type", "vendor").distinct()
    return libraries.select(
        "device_type",
        "vendor",
        F.when(
            F.col("vendor") == "host0",
            F.create_map(F.lit("version"), F.lit("v1"), F.lit("next_sequence"), F.lit("99999")),
        )
        .otherwise(F.create_map(F.lit("version"), F.lit("v1")))
        .alias("metadata"),
        F.when(
            F.col("vendor") == "host1",
            F.struct(
                F.lit(r"(?P<ts>[0-9]{4}-[0-9]{2}-[0-9]{2})").alias("regex"),
                F.lit("%Y-%m-%d").alias("format"),
                F.lit(None).cast("boolean").alias("has_year"),
                F.lit(None).cast("string").alias("example"),
            ),
        )
        .cast(S.TIMESTAMP_SPEC)
        .alias("timestamp_spec"),
    )


# --- supplier lines: many values of one word ---------------------------------------


def nation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that differ in a number and in a word with 25 values."""
    suppliers = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")
    )
    lines = suppliers.select(
        F.lit("ship.log").alias("source_id"),
        (F.col("s_suppkey") + 1).alias("line_number"),
        F.expr("concat('shipper ', cast(s_suppkey as string), ' in ', translate(n_name, '0123456789', 'abcdefghij'), ' ready')").alias("raw_line"),
    )
    return in_library(lines)


NATION_SQL = (
    "select 'ship.log' as source_id, s_suppkey + 1 as line_number, concat('shipper ', cast(s_suppkey as varchar), ' in ',"
    " translate(n_name, '0123456789', 'abcdefghij'), ' ready') as raw_line from supplier join nation on s_nationkey = n_nationkey"
)


# --- shipment lines: two words with many values, one with few ------------------------

_SHIPMENT = (
    "concat('shipment ', cast(o_orderkey as {str}), ' of ', translate(p_brand, '#0123456789', '_abcdefghij'), ' by ',"
    " translate(n_name, '0123456789', 'abcdefghij'), ' flag ', o_orderstatus)"
)


def shipment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that differ in a number, a brand and a nation (25 words each), and a flag."""
    orders = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "part"), F.expr("p_partkey = o_orderkey % 200"))
    )
    lines = orders.select(
        F.lit("items.log").alias("source_id"),
        (F.col("o_orderkey") + 1).alias("line_number"),
        F.expr(_SHIPMENT.format(str="string")).alias("raw_line"),
    )
    return in_library(lines)


SHIPMENT_SQL = (
    f"select 'items.log' as source_id, o_orderkey + 1 as line_number, o_orderstatus as flag, p_brand, n_name,"
    f" {_SHIPMENT.format(str='varchar')} as raw_line from orders join customer on o_custkey = c_custkey"
    " join nation on c_nationkey = n_nationkey join part on p_partkey = o_orderkey % 200"
)


# --- lines whose candidates meet a library in every way ------------------------------

_STEP = 10**9
_OUTCOME_LINES = {
    "concat('order ', cast(o_orderkey as {str}), ' placed')": "true",
    "concat('ship ', cast(o_orderkey as {str}), ' now')": "o_orderkey % 1000 <> 0",
    "concat('state ', cast(o_orderkey % 3 as {str}), ' of order ', cast(o_orderkey as {str}))": "true",
    "concat('fault ', cast(5 + o_orderkey % 2 as {str}))": "true",
}


def _outcome_sql(kind: str) -> str:
    return " union all ".join(
        f"select 'out.log' as source_id, cast(o_orderkey + 1 + {i} * cast({_STEP} as bigint) as bigint) as line_number, {text.format(str=kind)} as raw_line"
        f" from orders where {where}"
        for i, (text, where) in enumerate(_OUTCOME_LINES.items())
    )


OUTCOME_SQL = _outcome_sql("varchar")


def outcome_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New lines; lines a stored template spells out; lines next to a stored one; lines
    whose first one is a stored template's example."""
    orders = table(spark, sf_dir, "orders")
    lines = spark.sql(_outcome_sql("string").replace("from orders", "from {orders}"), orders=orders)
    return in_library(lines)


def outcome_library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Templates and their examples: a shipment each thousand orders, a state, a fault."""
    shipped = table(spark, sf_dir, "orders").filter("o_orderkey % 1000 = 0").select(
        (F.col("o_orderkey") / 1000 + 10).cast("bigint").alias("seq"),
        F.format_string("old-ship%d", F.col("o_orderkey")).alias("template_id"),
        F.format_string("ship %d now", F.col("o_orderkey")).alias("regex"),
    )
    others = spark.createDataFrame(
        [(1, "old-state", "state 7 of order 5"), (2, "old-fault", "fault 7")], "seq bigint, template_id string, regex string"
    )
    rows = shipped.unionByName(others).withColumns({"device_type": F.lit(DEVICE), "vendor": F.lit(VENDOR)})
    examples = rows.select(
        "device_type", "vendor", "template_id", F.col("seq").alias("position"),
        F.when(F.col("template_id") == "old-fault", "fault 5").otherwise(F.col("regex")).alias("transformed"),
    )
    return complete(rows), examples
