"""Row types shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


STRING, LONG, INT, BOOLEAN = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
STRINGS = T.ArrayType(STRING)
VARIABLES = T.MapType(STRING, STRING)

TIMESTAMP_SPEC = _struct(
    ("regex", STRING), ("format", STRING), ("has_year", BOOLEAN), ("example", STRING)
)

VARIABLE = _struct(("name", STRING), ("description", STRING), ("example", STRING))

# A template as the snapshot and the library files store it.
STORED_TEMPLATE = _struct(
    ("template_id", STRING),
    ("template", STRING),
    ("regex", STRING),
    ("variables", T.ArrayType(VARIABLE)),
    ("constants", STRINGS),
    ("usage_count", LONG),
    ("failure_count", LONG),
    ("timestamp_hint", TIMESTAMP_SPEC),
    ("source", STRING),
    ("notes", STRING),
    ("version", STRING),
    ("is_active", BOOLEAN),
)

# ``seq`` is the library order: the first active match wins.
TEMPLATE = T.StructType(
    _struct(("device_type", STRING), ("vendor", STRING), ("seq", LONG)).fields
    + STORED_TEMPLATE.fields
)

LIBRARY_META = _struct(
    ("device_type", STRING),
    ("vendor", STRING),
    ("metadata", VARIABLES),
    ("timestamp_spec", TIMESTAMP_SPEC),
)

LIBRARY_FILE = _struct(
    ("metadata", VARIABLES),
    ("timestamp_spec", TIMESTAMP_SPEC),
    ("templates", T.ArrayType(STORED_TEMPLATE)),
)

LIBRARY_KEY = ["device_type", "vendor"]
LINE_KEY = ["source_id", "line_number"]

# Values a stored template takes when its record lacks the field (fixed values).
TEMPLATE_DEFAULTS = {
    "template": "",
    "usage_count": 0,
    "failure_count": 0,
    "source": "llm",
    "notes": "",
    "version": "v1",
    "is_active": True,
}
