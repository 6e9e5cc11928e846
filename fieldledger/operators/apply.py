"""A batch of mixed mutations, decoded, checked and decided as a whole."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldledger.functions.documents import (
    decode_form,
    decode_schedule,
    decode_template,
    with_parsed,
)
from fieldledger.operators.cascade import FORM_KEYS, SPAN_LIMIT, accept_form_mutations
from fieldledger.operators.history import LiveKeys, assign_record_ids, decide
from fieldledger.operators.joins import BROADCAST_BYTES
from fieldledger.operators.ordered import RANGE_WIDTH
from fieldledger.schemas import ACTIONS, FORM_FIELDS, KINDS, SHIFT, TEMPLATE_FIELD
from fieldledger.sources.staging import Stage, unstaged

# Columns of an outcome; the record columns of the other kinds are null.
OUTCOME = (
    "seq",
    "kind",
    "template",
    "generation",
    "key",
    "action",
    "accepted",
    "reject_reason",
    "form",
    "template_record",
    "schedule",
    "payload",
    "committed_at",
    "log_id",
    "logged_path",
)
# What the decoded documents become.
FORM_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("scouter", T.StringType()),
        T.StructField("team", T.LongType()),
        T.StructField("match_number", T.LongType()),
        T.StructField("event_key", T.StringType()),
        T.StructField("fields", FORM_FIELDS),
    ]
)
TEMPLATE_RECORD = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("year", T.LongType()),
        T.StructField("fields", T.ArrayType(TEMPLATE_FIELD)),
    ]
)
SCHEDULE_RECORD = T.StructType(
    [T.StructField("event", T.StringType()), T.StructField("shifts", T.ArrayType(SHIFT))]
)
_TYPES = {
    "generation": T.LongType(),
    "form": FORM_RECORD,
    "template_record": TEMPLATE_RECORD,
    "schedule": SCHEDULE_RECORD,
    "payload": T.BinaryType(),
    "log_id": T.StringType(),
    "logged_path": T.StringType(),
}
_NO_TEMPLATES = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("template_record", TEMPLATE_RECORD),
    ]
)


def _unusable() -> Column:
    known = F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))
    placed = F.coalesce(F.col("seq") >= 0, F.lit(False))
    return F.when(~(known & placed), F.lit("bad_mutation"))


def _known_kind() -> Column:
    return F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))


def refuse_unknown(mutations: DataFrame) -> DataFrame:
    """Outcomes of the mutations whose kind is missing or none of the known ones."""
    return mutations.where(~_known_kind()).select(
        "seq",
        "kind",
        "template",
        "key",
        "action",
        F.lit(False).alias("accepted"),
        F.lit("bad_mutation").alias("reject_reason"),
        "committed_at",
    )


def _decoded(mutations: DataFrame, kind: str, decode, record: str) -> DataFrame:
    """Rows of one kind with the record of their document and a `reject_reason`."""
    rows = mutations.where(F.col("kind") == F.lit(kind))
    writes = F.col("action").isin("Add", "Edit")
    rows = with_parsed(rows.withColumn("doc", F.when(writes, F.col("doc"))), "doc")
    value, failure = decode(F.col("_parsed"))
    unreadable = F.when(F.col("_parsed").isNull(), F.lit("not_json")).otherwise(failure)
    return (
        rows.withColumn("reject_reason", F.coalesce(_unusable(), F.when(writes, unreadable)))
        .withColumn(record, F.when(writes & F.col("reject_reason").isNull(), value))
        .drop("_parsed", "doc")
    )


def _keyed(rows: DataFrame, key: Column) -> DataFrame:
    """Sets the key; rows without one are refused."""
    return (
        rows.withColumn("key", key)
        .withColumn(
            "reject_reason",
            F.coalesce("reject_reason", F.when(F.col("key").isNull(), F.lit("no_key"))),
        )
        .withColumn("key", F.coalesce("key", F.lit("")))
    )


def decide_templates(
    mutations: DataFrame,
    *,
    live_keys: LiveKeys = None,
    stage: Stage = unstaged,
    width: int | None = RANGE_WIDTH,
) -> DataFrame:
    """Outcomes of the template mutations; the key is the name in the document."""
    rows = _decoded(mutations, "Template", decode_template, "template_record")
    rows = stage(_keyed(rows, F.coalesce("template_record.name", "key")), "template-rows")
    return decide(rows, ["key"], live_keys=live_keys, width=width)


def decide_schedules(
    mutations: DataFrame,
    *,
    live_keys: LiveKeys = None,
    stage: Stage = unstaged,
    width: int | None = RANGE_WIDTH,
) -> DataFrame:
    """Outcomes of the schedule mutations; the key is the event in the document."""
    rows = _decoded(mutations, "Schedule", decode_schedule, "schedule")
    rows = stage(_keyed(rows, F.coalesce("schedule.event", "key")), "schedules")
    return decide(rows, ["key"], live_keys=live_keys, width=width)


def decide_blobs(
    mutations: DataFrame, *, live_keys: LiveKeys = None, width: int | None = RANGE_WIDTH
) -> DataFrame:
    """Outcomes of the blob mutations; payloads play no part and are read once."""
    rows = mutations.where(F.col("kind") == "Bytes").drop("doc")
    rows = _keyed(rows.withColumn("reject_reason", _unusable()), F.col("key"))
    writes = F.col("action").isin("Add", "Edit")
    empty = F.unhex(F.lit(""))
    return decide(rows, ["key"], live_keys=live_keys, width=width).withColumn(
        "payload", F.when(writes, F.coalesce("payload", empty))
    )


def decide_forms(
    mutations: DataFrame,
    templates: DataFrame,
    *,
    new_ids: bool = True,
    open_before: DataFrame | None = None,
    live_keys: LiveKeys = None,
    stage: Stage = unstaged,
    span_limit: int = SPAN_LIMIT,
    limit: int = BROADCAST_BYTES,
    width: int | None = RANGE_WIDTH,
) -> DataFrame:
    """Outcomes of the form mutations against the decided `templates`.

    With `new_ids` every Add gets a new id in place of the one it names.
    """
    rows = _decoded(mutations, "Form", decode_form, "form")
    if new_ids:
        rows = assign_record_ids(rows)
    rows = _keyed(rows, F.col("key"))
    rows = rows.withColumn(
        "form", F.when(F.col("form").isNotNull(), F.col("form").withField("id", F.col("key")))
    )
    changes = templates.where("accepted").select(
        F.col("key").alias("template"), "seq", "action", "template_record"
    )
    definitions = changes.where(F.col("action") != "Delete").select(
        "template",
        F.col("seq").alias("generation"),
        F.col("template_record.fields").alias("fields"),
    )
    if open_before is not None:
        definitions = open_before.select("template", "generation", "fields").unionByName(definitions)
    return accept_form_mutations(
        rows,
        changes,
        template_fields=definitions,
        fields="form.fields",
        open_before=open_before,
        live_keys=live_keys,
        stage=stage,
        span_limit=span_limit,
        limit=limit,
        width=width,
    )


def apply_mutations(
    mutations: DataFrame,
    *,
    new_ids: bool = True,
    live_keys: LiveKeys = None,
    open_before: DataFrame | None = None,
    stage: Stage = unstaged,
    kinds: Collection[str] = KINDS,
    span_limit: int = SPAN_LIMIT,
    limit: int = BROADCAST_BYTES,
    width: int | None = RANGE_WIDTH,
) -> DataFrame:
    """One outcome per mutation of any kind.

    `live_keys` (`kind, template, generation, key`) and `open_before` (`template,
    generation, fields`) describe the state in front of the batch; `live_keys` may also be a
    function of a kind and the keys asked for. With `stage` the
    mutations are read once, and documents are decoded once and written down before
    their order is looked at; without it every pass over the mutations runs and
    decodes them again. Mutations of an unknown kind are refused as `bad_mutation`. `kinds` may
    leave out known kinds of which there is no mutation.
    """
    mutations = stage(mutations, "mutations")

    def live(kind: str, *keys: str) -> LiveKeys:
        if live_keys is None:
            return None
        if callable(live_keys):
            return lambda asked: live_keys(kind, asked)
        return live_keys.where(F.col("kind") == F.lit(kind)).select(*keys)

    outcomes = [refuse_unknown(mutations)]
    templates = mutations.sparkSession.createDataFrame([], _NO_TEMPLATES)
    if "Template" in kinds:
        templates = decide_templates(
            mutations, live_keys=live("Template", "key"), stage=stage, width=width
        )
        templates = stage(templates, "templates")
        outcomes.append(templates)
    if "Schedule" in kinds:
        outcomes.append(
            decide_schedules(mutations, live_keys=live("Schedule", "key"), stage=stage, width=width)
        )
    if "Bytes" in kinds:
        outcomes.append(decide_blobs(mutations, live_keys=live("Bytes", "key"), width=width))
    if "Form" in kinds:
        forms = decide_forms(
            mutations,
            templates,
            new_ids=new_ids,
            open_before=open_before,
            live_keys=live("Form", *FORM_KEYS),
            stage=stage,
            span_limit=span_limit,
            limit=limit,
            width=width,
        )
        outcomes.append(forms)
    merged = outcomes[0]
    for rows in outcomes[1:]:
        merged = merged.unionByName(rows, allowMissingColumns=True)
    absent = {name: F.lit(None).cast(kind) for name, kind in _TYPES.items() if name not in merged.columns}
    return merged.withColumns(absent).select(*OUTCOME)
