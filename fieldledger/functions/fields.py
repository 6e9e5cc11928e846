"""Expressions over the typed fields of forms and templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldledger.schemas import FIELD_VALUE, TEMPLATE_FIELD, VALUE_TAGS


def field_value(tag: str, payload: Column) -> Column:
    """A tagged field value: the member named `tag` is set, the others are null."""
    if tag not in VALUE_TAGS:
        raise ValueError(f"unknown field tag {tag!r}")
    members = [
        (payload if name == tag else F.lit(None)).cast(ddl).alias(name)
        for name, ddl in VALUE_TAGS.items()
    ]
    return F.struct(*members).cast(FIELD_VALUE)


def tag_of(value: Column) -> Column:
    """Name of the set member of a tagged value, null for a missing value."""
    return F.coalesce(
        *[F.when(value[tag].isNotNull(), F.lit(tag)) for tag in VALUE_TAGS]
    )


def get_field(fields: Column, name: str | Column) -> Column:
    """The tagged value stored under `name`, null when absent."""
    return F.try_element_at(fields, F.lit(name) if isinstance(name, str) else name)


def put_field(fields: Column, name: str, value: Column) -> Column:
    """The fields with `name` added or overwritten."""
    others = F.map_filter(fields, lambda key, _: key != F.lit(name))
    return F.map_concat(others, F.create_map(F.lit(name), value))


def template_field(name: str, kind: str, low: int | None = None, high: int | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(kind).alias("kind"),
        F.lit(low).cast("bigint").alias("min"),
        F.lit(high).cast("bigint").alias("max"),
    ).cast(TEMPLATE_FIELD)


def append_template_field(
    fields: Column, name: str, kind: str, low: int | None = None, high: int | None = None
) -> Column:
    return F.array_append(fields, template_field(name, kind, low, high))


def follows_template(template_fields: Column, form_fields: Column) -> Column:
    """True iff each field but titles is present under the tag of its kind.

    Rating bounds are not enforced and fields the template lacks are allowed.
    """

    def holds(field: Column) -> Column:
        tag = tag_of(get_field(form_fields, field["name"]))
        return (field["kind"] == "Title") | F.coalesce(tag == field["kind"], F.lit(False))

    return F.forall(template_fields, holds)


def violations(template_fields: Column, form_fields: Column) -> Column:
    """The template fields a form breaks, in template order, with a reason."""

    def check(field: Column) -> Column:
        found = tag_of(get_field(form_fields, field["name"]))
        reason = F.when(found.isNull(), F.lit("missing")).when(
            found != field["kind"], F.lit("type_mismatch")
        )
        return F.struct(
            field["name"].alias("field"),
            field["kind"].alias("expected"),
            found.alias("found"),
            F.when(field["kind"] != "Title", reason).alias("reason"),
        )

    return F.filter(F.transform(template_fields, check), lambda item: item["reason"].isNotNull())
