"""Strict decoding of JSON documents into record columns.

`from_json` coerces or drops what a typed record must refuse, so documents are
parsed to VARIANT and every member is checked by its stored type first. Each
decoder returns a pair of columns: the record struct and the reject reason. The
record is of use only where there is no reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.schemas import (
    ACTIONS,
    FIELD_VALUE,
    SHIFT,
    TEMPLATE_FIELD,
    UNIT_FIELD_KINDS,
    UNIT_LOG_KINDS,
    VALUE_TAGS,
)

STATION_MAX = 2**8 - 1
MATCH_MAX = 2**32 - 1
UUID_PATTERN = (
    "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
)

_VALUE_DDL = FIELD_VALUE.simpleString()
_FORM_DDL = (
    "struct<id:string,scouter:string,team:bigint,match_number:bigint,event_key:string,"
    f"fields:map<string,{_VALUE_DDL}>>"
)
_SCHEDULE_DDL = f"struct<event:string,shifts:array<{SHIFT.simpleString()}>>"
_VALUE_SHAPES = tuple(f"OBJECT<{tag}: {ddl}>" for tag, ddl in VALUE_TAGS.items())


def _bracketed(doc: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), doc, F.lit("]")))


def _only_value(doc: Column, bracketed: Column) -> Column:
    alone = F.variant_get(bracketed, "$[1]", "variant").isNull()
    braced = F.try_parse_json(F.concat(F.lit('{"d":'), doc, F.lit("}"))).isNotNull()
    closed = F.when(doc.rlike(r"\}\s*\]"), braced).otherwise(F.lit(True))
    return F.when(
        F.is_valid_utf8(doc) & alone & closed, F.variant_get(bracketed, "$[0]", "variant")
    )


def string_member(parsed: Column, name: str) -> Column:
    """The string under a name of a parsed object; null for any other value."""
    kind = F.schema_of_variant(F.variant_get(parsed, f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(parsed, f"$.{name}", "string"))


def with_parsed(rows: DataFrame, doc: str, name: str = "_parsed") -> DataFrame:
    """Adds the one JSON value of a text as VARIANT; null for anything else.

    The parser stops after the first value, so the text is parsed inside
    brackets, where left-over text is an error or a second element. Only a text
    with `}]` could close the bracket itself; it is parsed inside braces too. The
    two steps keep the text from being parsed once per use of the result.
    """
    text = F.col(doc)
    return rows.withColumn(name, _bracketed(text)).withColumn(
        name, _only_value(text, F.col(name))
    )


def _type(value: Column, path: str = "$") -> Column:
    return F.schema_of_variant(F.variant_get(value, path, "variant"))


def _is(value: Column, path: str, *types: str) -> Column:
    return F.coalesce(_type(value, path).isin(*types), F.lit(False))


def _between(value: Column, path: str, high: int) -> Column:
    inside = F.try_variant_get(value, path, "bigint").between(0, high)
    return _is(value, path, "BIGINT") & F.coalesce(inside, F.lit(False))


def _members(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "map<string,variant>")


def _items(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _all(items: Column, check) -> Column:
    return F.coalesce(F.forall(items, check), F.lit(False))


def _first_failure(checks: dict[str, Column], value: Column) -> Column:
    """The reason of the first check that fails.

    No check holds for a value that is not an object, so that is only asked once
    the first one has failed.
    """
    (first, holds), *others = checks.items()
    is_object = F.coalesce(_type(value).startswith("OBJECT<"), F.lit(False))
    reason = F.when(is_object, F.lit(first)).otherwise(F.lit("not_an_object"))
    return F.coalesce(
        F.when(~holds, reason), *[F.when(~ok, F.lit(name)) for name, ok in others]
    )


def _unit_name(value: Column, path: str, names: tuple[str, ...]) -> Column:
    """Name of a payload-free union member, written `"Name"` or `{"Name":null}`."""
    plain = F.when(_is(value, path, "STRING"), F.try_variant_get(value, path, "string"))
    shape = _type(value, path)
    tagged = F.coalesce(*[F.when(shape == f"OBJECT<{name}: VOID>", F.lit(name)) for name in names])
    name = F.coalesce(plain, tagged)
    return F.when(name.isin(*names), name)


def decode_form(value: Column) -> tuple[Column, Column]:
    """Form record of a parsed document; a missing or null `id` is allowed."""
    members = _members(value, "$.fields")
    checks = {
        "bad_fields": _all(
            F.map_values(members),
            lambda item: F.coalesce(F.schema_of_variant(item).isin(*_VALUE_SHAPES), F.lit(False)),
        ),
        "bad_scouter": _is(value, "$.scouter", "STRING"),
        "bad_team": _is(value, "$.team", "BIGINT"),
        "bad_match_number": _is(value, "$.match_number", "BIGINT"),
        "bad_event_key": _is(value, "$.event_key", "STRING"),
        "bad_id": F.coalesce(_type(value, "$.id").isin("STRING", "VOID"), F.lit(True)),
    }

    return F.try_variant_get(value, "$", _FORM_DDL), _first_failure(checks, value)


def _field_kind(item: Column) -> Column:
    members = _members(item, "$.data_type")
    rating = (
        F.coalesce(F.map_keys(members) == F.array(F.lit("Rating")), F.lit(False))
        & _is(item, "$.data_type.Rating.min", "BIGINT")
        & _is(item, "$.data_type.Rating.max", "BIGINT")
    )
    return F.when(rating, F.lit("Rating")).otherwise(
        _unit_name(item, "$.data_type", UNIT_FIELD_KINDS)
    )


def decode_template(value: Column) -> tuple[Column, Column]:
    items = _items(value, "$.fields")
    checks = {
        "bad_fields": _all(
            items, lambda item: _is(item, "$.name", "STRING") & _field_kind(item).isNotNull()
        ),
        "bad_name": _is(value, "$.name", "STRING"),
        "bad_year": _is(value, "$.year", "BIGINT"),
    }

    def field(item: Column) -> Column:
        return F.struct(
            F.try_variant_get(item, "$.name", "string").alias("name"),
            _field_kind(item).alias("kind"),
            F.try_variant_get(item, "$.data_type.Rating.min", "bigint").alias("min"),
            F.try_variant_get(item, "$.data_type.Rating.max", "bigint").alias("max"),
        ).cast(TEMPLATE_FIELD)

    record = F.struct(
        F.try_variant_get(value, "$.name", "string").alias("name"),
        F.try_variant_get(value, "$.year", "bigint").alias("year"),
        F.transform(items, field).alias("fields"),
    )
    return record, _first_failure(checks, value)


def decode_schedule(value: Column) -> tuple[Column, Column]:
    items = _items(value, "$.shifts")
    shift_checks = (
        lambda item: _is(item, "$.scouter", "STRING"),
        lambda item: _between(item, "$.station", STATION_MAX),
        lambda item: _between(item, "$.match_start", MATCH_MAX),
        lambda item: _between(item, "$.match_end", MATCH_MAX),
    )
    checks = {
        "bad_event": _is(value, "$.event", "STRING"),
        "bad_shifts": _all(
            items,
            lambda item: reduce(lambda a, b: a & b, [check(item) for check in shift_checks]),
        ),
    }

    return F.try_variant_get(value, "$", _SCHEDULE_DDL), _first_failure(checks, value)


def decode_log_entry(value: Column) -> tuple[Column, Column]:
    form = _type(value, "$.data_type") == "OBJECT<Form: STRING>"
    kind = F.when(form, F.lit("Form")).otherwise(_unit_name(value, "$.data_type", UNIT_LOG_KINDS))
    id_text = F.try_variant_get(value, "$.id", "string")
    checks = {
        "bad_id": _is(value, "$.id", "STRING") & F.coalesce(id_text.rlike(UUID_PATTERN), F.lit(False)),
        "bad_data_type": kind.isNotNull(),
        "bad_action": _unit_name(value, "$.action", ACTIONS).isNotNull(),
        "bad_new_path": _is(value, "$.new_path", "STRING"),
    }
    record = F.struct(
        id_text.alias("id"),
        kind.alias("kind"),
        F.try_variant_get(value, "$.data_type.Form", "string").alias("template"),
        _unit_name(value, "$.action", ACTIONS).alias("action"),
        F.try_variant_get(value, "$.new_path", "string").alias("new_path"),
    )
    return record, _first_failure(checks, value)


DECODERS = {
    "Form": decode_form,
    "Template": decode_template,
    "Schedule": decode_schedule,
    "Log": decode_log_entry,
}


def with_decoded(
    rows: DataFrame, kind: str, doc: str, record: str = "record", reason: str = "reject_reason"
) -> DataFrame:
    """Adds the decoded record and the reject reason of the JSON text in `doc`."""
    value, failure = DECODERS[kind](F.col("_parsed"))
    unreadable = F.col("_parsed").isNull()
    return (
        with_parsed(rows, doc)
        .withColumn(reason, F.when(unreadable, F.lit("not_json")).otherwise(failure))
        .withColumn(record, F.when(F.col(reason).isNull(), value))
        .drop("_parsed")
    )
