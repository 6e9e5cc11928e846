"""Template generations and the form mutations that depend on them.

A template Add or Edit opens a generation with an empty set of forms; the next
accepted change of that template closes it and archives its forms. A generation
is named by the `seq` that opened it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.operators.history import LiveKeys, decide, version_history
from fieldledger.operators.joins import BROADCAST_BYTES, join_small
from fieldledger.operators.ordered import RANGE_WIDTH, carry
from fieldledger.operators.validate import validate_forms
from fieldledger.sources.staging import Stage, unstaged

# Template changes up to this number are searched as broadcast intervals.
SPAN_LIMIT = 1024
FORM_KEYS = ("template", "generation", "key")


def template_generations(accepted: DataFrame, *, width: int | None = RANGE_WIDTH) -> DataFrame:
    """`(template, generation, seq_from, seq_to, version_id)` of accepted template mutations."""
    versions = version_history(accepted, ["template"], width=width)
    return versions.select(
        "template",
        F.col("seq").alias("generation"),
        F.col("seq").alias("seq_from"),
        F.col("superseded_by").alias("seq_to"),
        "version_id",
    )


def open_generations(generations: DataFrame) -> DataFrame:
    return generations.where(F.col("seq_to").isNull()).select("template", "generation")


def bind_generation(
    mutations: DataFrame,
    accepted_templates: DataFrame,
    *,
    open_before: DataFrame | None = None,
    span_limit: int = SPAN_LIMIT,
    width: int | None = RANGE_WIDTH,
) -> DataFrame:
    """Adds the `generation` open at the `seq` of each form mutation, else null.

    Up to `span_limit` template changes are broadcast as intervals and the
    mutations stay where they are. Beyond it the changes are merged into the
    mutations in order and the last one is carried forward, which also holds for
    one hot template.
    `open_before` names the generations open before the first row.
    """
    changes = accepted_templates.select("template", "seq", "action")
    if open_before is not None:
        first = open_before.select(
            "template", F.col("generation").alias("seq"), F.lit("Add").alias("action")
        )
        changes = first.unionByName(changes)
    if changes.limit(span_limit + 1).count() <= span_limit:
        spans = template_generations(changes, width=width).drop("version_id")
        spans = F.broadcast(spans.withColumnRenamed("template", "_template"))
        inside = (
            (F.col("template") == F.col("_template"))
            & (F.col("seq") > F.col("seq_from"))
            & (F.col("seq_to").isNull() | (F.col("seq") < F.col("seq_to")))
        )
        return mutations.join(spans, inside, "left").drop("_template", "seq_from", "seq_to")

    closed = F.lit(-1).cast("bigint")
    mark = F.when(F.col("action") == "Delete", closed).otherwise(F.col("seq"))
    marks = changes.select("template", "seq", mark.alias("_mark"))
    asked = mutations.select("template", "seq", F.lit(None).cast("bigint").alias("_mark"))
    bound = carry(
        asked.unionByName(marks), ["template"], "seq", F.col("_mark"), "generation", width=width
    )
    found = bound.where((F.col("generation") >= 0) & F.col("_mark").isNull())
    return mutations.join(found.select("seq", "generation"), "seq", "left")


def accept_form_mutations(
    mutations: DataFrame,
    accepted_templates: DataFrame,
    *,
    template_fields: DataFrame | None = None,
    fields: str = "fields",
    open_before: DataFrame | None = None,
    live_keys: LiveKeys = None,
    stage: Stage = unstaged,
    span_limit: int = SPAN_LIMIT,
    limit: int = BROADCAST_BYTES,
    width: int | None = RANGE_WIDTH,
) -> DataFrame:
    """Outcome of every form mutation: `generation`, `accepted`, `reject_reason`.

    Mutations without an open generation are refused, and, where `template_fields`
    (`template, generation, fields`) is given, so is content that breaks the
    template. Rows that come with a `reject_reason` keep it. Refused rows never count for the state of their form.
    """
    bound = bind_generation(
        mutations,
        accepted_templates,
        open_before=open_before,
        span_limit=span_limit,
        width=width,
    )
    reason = F.when(F.col("generation").isNull(), F.lit("no_template"))
    if "reject_reason" in bound.columns:
        reason = F.coalesce("reject_reason", reason)
    if template_fields is not None:
        bound = validate_forms(
            bound,
            template_fields,
            ("template", "generation"),
            fields=fields,
            spread="seq",
            limit=limit,
        )
        broken = F.col("action").isin("Add", "Edit") & ~F.col("valid")
        reason = F.coalesce(reason, F.when(broken, F.lit("breaks_template")))
    none = F.lit(-1).cast("bigint")
    checked = (
        bound.withColumn("reject_reason", reason)
        .withColumn("generation", F.coalesce("generation", none))
        .drop("valid", "template_known")
    )
    decided = decide(stage(checked, "forms"), FORM_KEYS, live_keys=live_keys, width=width)
    return decided.withColumn(
        "generation", F.when(F.col("generation") >= 0, F.col("generation"))
    )


def with_template_version(
    forms: DataFrame, generations: DataFrame, *, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Adds `template_version`, null for forms of an open generation."""
    archived = generations.select(
        "template", "generation", F.col("version_id").alias("template_version")
    )
    return join_small(
        forms, archived, ["template", "generation"], "left", spread=F.col("key"), limit=limit
    )


def live_forms(current: DataFrame, generations: DataFrame, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Current forms of the open generations; those of closed ones are archived."""
    return join_small(
        current,
        open_generations(generations),
        ["template", "generation"],
        "left_semi",
        spread=F.col("key"),
        limit=limit,
    )
