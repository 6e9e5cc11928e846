"""Whole-table checks of forms against their templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.functions.fields import follows_template, violations
from fieldledger.operators.joins import BROADCAST_BYTES, join_small


def _with_template(
    forms: DataFrame, templates: DataFrame, keys: Sequence[str], spread: str, limit: int
) -> DataFrame:
    wanted = templates.select(*keys, F.col("fields").alias("template_fields"))
    return join_small(forms, wanted, keys, "left", spread=F.col(spread), limit=limit)


def validate_forms(
    forms: DataFrame,
    templates: DataFrame,
    keys: Sequence[str] = ("template",),
    *,
    fields: str = "fields",
    spread: str = "id",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Adds `template_known` and `valid`; a form of an unknown template is not valid.

    `templates` has one row per value of `keys`. `spread` names a column of the
    forms with many values; it shares out a hot template.
    """
    joined = _with_template(forms, templates, keys, spread, limit)
    known = F.col("template_fields").isNotNull()
    follows = follows_template(F.col("template_fields"), F.col(fields))
    return (
        joined.withColumn("template_known", known)
        .withColumn("valid", F.coalesce(follows, F.lit(False)))
        .drop("template_fields")
    )


def form_violations(
    forms: DataFrame,
    templates: DataFrame,
    keys: Sequence[str] = ("template",),
    *,
    spread: str = "id",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per form and broken template field; none for a valid form alone.

    A form of an unknown template has one row, with the reason `unknown_template`.
    """
    joined = _with_template(forms, templates, keys, spread, limit)
    broken = violations(F.col("template_fields"), F.col("fields"))
    none = F.lit(None).cast("string")
    unknown = F.struct(
        none.alias("field"),
        none.alias("expected"),
        none.alias("found"),
        F.lit("unknown_template").alias("reason"),
    )
    return joined.select(*keys, "id", F.inline(F.coalesce(broken, F.array(unknown))))


def accept_forms(
    forms: DataFrame, templates: DataFrame, keys: Sequence[str] = ("template",), **options
) -> tuple[DataFrame, DataFrame]:
    """The forms that may be written, and the others with a `reject_reason`."""
    checked = validate_forms(forms, templates, keys, **options)
    flags = ("template_known", "valid")
    accepted = checked.where("valid").drop(*flags)
    reason = F.when(F.col("template_known"), F.lit("breaks_template")).otherwise(
        F.lit("unknown_template")
    )
    rejected = checked.where(~F.col("valid")).withColumn("reject_reason", reason).drop(*flags)
    return accepted, rejected
