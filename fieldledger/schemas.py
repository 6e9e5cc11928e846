"""Canonical record schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The tags of a field value with their payload types, and the
# template field kinds. They must match stored documents.
VALUE_TAGS = {
    "CheckBox": "BOOLEAN",
    "Rating": "BIGINT",
    "Number": "BIGINT",
    "ShortText": "STRING",
    "LongText": "STRING",
}
UNIT_FIELD_KINDS = ("Title", "CheckBox", "Number", "ShortText", "LongText")
ACTIONS = ("Add", "Delete", "Edit")
UNIT_LOG_KINDS = ("Bytes", "Schedule", "Template")
KINDS = ("Form", *UNIT_LOG_KINDS)

_TAG_TYPES = {"BOOLEAN": T.BooleanType(), "BIGINT": T.LongType(), "STRING": T.StringType()}

FIELD_VALUE = T.StructType(
    [T.StructField(tag, _TAG_TYPES[ddl]) for tag, ddl in VALUE_TAGS.items()]
)
FORM_FIELDS = T.MapType(T.StringType(), FIELD_VALUE)
TEMPLATE_FIELD = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("min", T.LongType()),
        T.StructField("max", T.LongType()),
    ]
)
SHIFT = T.StructType(
    [
        T.StructField("scouter", T.StringType()),
        T.StructField("station", T.ShortType()),
        T.StructField("match_start", T.LongType()),
        T.StructField("match_end", T.LongType()),
    ]
)

FORMS = T.StructType(
    [
        T.StructField("template", T.StringType()),
        T.StructField("generation", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("scouter", T.StringType()),
        T.StructField("team", T.LongType()),
        T.StructField("match_number", T.LongType()),
        T.StructField("event_key", T.StringType()),
        T.StructField("fields", FORM_FIELDS),
    ]
)
TEMPLATES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("year", T.LongType()),
        T.StructField("fields", T.ArrayType(TEMPLATE_FIELD)),
    ]
)
SCHEDULES = T.StructType(
    [T.StructField("event", T.StringType()), T.StructField("shifts", T.ArrayType(SHIFT))]
)
BLOBS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("key_sha256", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
CHANGE_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("template", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("new_path", T.StringType()),
    ]
)
# One row per requested change; `doc` holds the JSON of a form, schedule or
# template, `payload` the bytes of a blob. Deletes carry neither.
MUTATIONS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("template", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("doc", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("committed_at", T.TimestampType()),
    ]
)
# What a mutation taken over from another log may bring along: the id and path it was logged under.
LOGGED = T.StructType(
    [T.StructField("log_id", T.StringType()), T.StructField("logged_path", T.StringType())]
)
