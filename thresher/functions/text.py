"""Column expressions for template text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thresher.operators.lines import strip

PLACEHOLDER = "<[^>]+>"
JSON_PAYLOAD = r"\{[^{}]*\}"
JSON_MARK = "<json>"
# A brace inside an open one, or inside a string of it: more than the flat pattern reads.
_DEEP = r'\{[^{}]*+\{|\{(?:[^{}"]|"[^"{}]*+")*+"[^"{}]*+[{}]'
_BRACE_TOKEN = r'[^{}"\\]+|\\[\s\S]|[{}"\\]'


def extract_constants(template: Column) -> Column:
    """Constant pieces of a template text: between placeholders, trimmed, non-blank."""
    pieces = F.transform(F.split(template, PLACEHOLDER), strip)
    return F.filter(pieces, lambda piece: piece != "")


def variable_names(regex: Column) -> Column:
    """Named groups of a regex, in order; none if it does not compile."""
    from thresher.functions.dialect import compiled_names

    return compiled_names(regex)


def template_variables(names: Column, values: Column) -> Column:
    """``[{name, description, example}]`` of the groups that took part."""
    items = F.zip_with(
        names,
        values,
        lambda n, v: F.struct(
            n.alias("name"), F.lit("").alias("description"), v.alias("example")
        ),
    )
    return F.filter(items, lambda item: item["example"].isNotNull())


def id_part(name: Column) -> Column:
    return F.translate(name, " ", "_")


def template_digest_id(device_type: Column, vendor: Column, template: Column) -> Column:
    """Provisional id: names plus the first 8 hex digits of the text's SHA-1."""
    return F.concat_ws(
        "-", id_part(device_type), id_part(vendor), F.substring(F.sha1(template.cast("binary")), 1, 8)
    )


def regex_literal(text: Column) -> Column:
    """Escape constants for a regex that reads the same in every engine."""
    return F.regexp_replace(text, r"([\\.^$*+?{}\[\]|()])", r"\\$1")


def interleave(constants: Column, between: Column) -> Column:
    """constants[0] + between[0] + constants[1] + ... as one text."""
    padded = F.array_append(between, F.lit(""))
    return F.array_join(F.zip_with(constants, padded, lambda c, b: F.concat(c, b)), "")


def deep_payloads(text: Column) -> Column:
    """Whether braces stand inside a payload, as nested objects or in its strings."""
    return text.rlike(_DEEP)


def payload_parts(text: Column) -> Column:
    """Text outside (even places) and payloads (odd places) by a scan that counts depth.

    A payload runs from a brace to the one that closes it; braces in its strings do not
    count, nor does an escaped character. Null if a brace stays open: such a text has no
    well-formed payload.
    """
    tokens = F.regexp_extract_all(text, F.lit(_BRACE_TOKEN), F.lit(0))

    def step(state: Column, token: Column) -> Column:
        depth, quoted, at = state["depth"], state["quoted"], state["at"]
        opens = (token == "{") & ~quoted
        closes = (token == "}") & ~quoted & (depth > 0)
        edge = F.when(opens & (depth == 0), at).when(closes & (depth == 1), at + 1)
        return F.struct(
            (depth + opens.cast("int") - closes.cast("int")).alias("depth"),
            F.when((token == '"') & (depth > 0), ~quoted).otherwise(quoted).alias("quoted"),
            (at + 1).alias("at"),
            F.when(edge.isNotNull(), F.array_append(state["edges"], edge)).otherwise(state["edges"]).alias("edges"),
        )

    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("edges")
    )

    def cut(state: Column) -> Column:
        borders = F.concat(F.array(F.lit(0)), state["edges"], F.array(F.size(tokens)))
        spans = F.zip_with(F.slice(borders, 1, F.size(borders) - 1), F.slice(borders, 2, F.size(borders) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        parts = F.transform(spans, lambda s: F.array_join(F.slice(tokens, s["a"] + 1, s["b"] - s["a"]), ""))
        return F.when(state["depth"] == 0, parts)

    return F.aggregate(tokens, start, step, cut)


def mask_json_payloads(text: Column) -> Column:
    """JSON-like payloads, whole and with all they contain, replaced by a mark.

    A text with a brace that stays open is read by its flat payloads alone.
    """
    parts = F.when(deep_payloads(text), payload_parts(text))
    whole = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.lit(JSON_MARK)).otherwise(p)), "")
    return F.coalesce(whole, F.regexp_replace(text, JSON_PAYLOAD, JSON_MARK))


def json_payloads(text: Column) -> Column:
    parts = F.when(deep_payloads(text), payload_parts(text))
    flat = F.regexp_extract_all(text, F.lit(JSON_PAYLOAD), F.lit(0))
    return F.coalesce(F.filter(parts, lambda p, i: i % 2 == 1), flat)


def json_payload_keys(text: Column) -> Column:
    """Keys of each payload; null for a payload that is no JSON object."""
    return F.transform(json_payloads(text), F.json_object_keys)


def constant_metrics(template: Column) -> dict[str, Column]:
    """Constant characters, total characters, their ratio and the segments."""
    segments = F.filter(F.split(template, PLACEHOLDER), lambda piece: strip(piece) != "")
    chars = F.length(F.array_join(segments, ""))
    total = F.length(template)
    return {
        "constant_chars": chars,
        "total_chars": total,
        "constant_ratio": F.when(total > 0, chars / total).otherwise(F.lit(0.0)),
        "segments": segments,
    }
