"""The registered queries: name -> (session, folder of test tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from threading import Thread

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.functions import age as ages
from fieldledger.functions.codecs import (
    decode_blob,
    encode_blob,
    form_json,
    log_json,
    row_json,
    sha256_hex,
)
from fieldledger.functions.documents import with_decoded
from fieldledger.functions.fields import (
    append_template_field,
    field_value,
    get_field,
    put_field,
    tag_of,
)
from fieldledger.functions.locations import location
from fieldledger.operators import cascade, history, lookup, query, validate
from fieldledger.operators.apply import apply_mutations, decide_blobs, decide_schedules
from fieldledger.operators.changelog import change_log
from fieldledger.schemas import TEMPLATE_FIELD
from fieldledger.session import new_scratch
from fieldledger.sources import record_files, record_store, store_history
from fieldledger.sources import sample_views as views
from fieldledger.sources.ledger import Ledger
from fieldledger.sources.log_index import IndexedLog
from fieldledger.sources.staging import stage_in
from fieldledger.sources.store_source import drop_store
from fieldledger.streaming import change_feed, intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the filter and cursor queries, shared with their SQL.
FILTER = {"event": "20240101", "scouter": "scouter_7", "match_number": 3, "team": 7}
TEMPLATE = "view"
LEDGER_TEMPLATE = "t1"
FORM_ID = "3"
CURSOR_SEQ = 5
AS_OF = "2024-02-01 00:00:00"


def register(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _as_of() -> Column:
    return F.expr(f"TIMESTAMP'{AS_OF}Z'")


def _big(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def flat_forms(forms: DataFrame, *extra: str) -> DataFrame:
    """The members of the sample forms as scalar columns."""
    fields = F.col("fields")
    return forms.select(
        "template",
        "id",
        "scouter",
        "team",
        "match_number",
        "event_key",
        get_field(fields, "score")["Number"].alias("score_number"),
        get_field(fields, "score")["Rating"].alias("score_rating"),
        get_field(fields, "k")["Rating"].alias("k_rating"),
        get_field(fields, "big")["CheckBox"].alias("big"),
        get_field(fields, "note")["ShortText"].alias("note"),
        get_field(fields, "detail")["LongText"].alias("detail"),
        get_field(fields, "x")["Number"].alias("x"),
        _big(F.size(fields)).alias("n_fields"),
        *extra,
    )


# Filters, listings, lookups


def _filter_query(name: str, *wanted: str) -> None:
    chosen = {key: FILTER[key] for key in wanted}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat_forms(query.filter_forms(views.forms(spark, sf_dir), TEMPLATE, **chosen))

    run.__name__ = name
    register(run)


_filter_query("forms_filter_none")
_filter_query("forms_filter_event", "event")
_filter_query("forms_filter_scouter", "scouter")
_filter_query("forms_filter_match", "match_number")
_filter_query("forms_filter_team", "team")
_filter_query("forms_filter_all", *FILTER)


@register
def forms_list_ids(spark, sf_dir):
    return query.list_forms(views.forms(spark, sf_dir), TEMPLATE)


@register
def form_get(spark, sf_dir):
    forms = views.forms(spark, sf_dir)
    return flat_forms(lookup.get_record(forms, template=TEMPLATE, id=FORM_ID))


@register
def form_get_batch(spark, sf_dir):
    wanted = views.events(spark, sf_dir).select(
        F.col("event_type").alias("template"), (F.col("event_id") * 2).cast("string").alias("id")
    )
    found = lookup.get_records(views.forms(spark, sf_dir), wanted, ["template", "id"])
    return flat_forms(found, "found").drop("n_fields")


@register
def form_field_read(spark, sf_dir):
    fields = F.col("fields")
    return views.forms(spark, sf_dir).select(
        "template",
        "id",
        tag_of(get_field(fields, "score")).alias("score_tag"),
        get_field(fields, "k")["Rating"].alias("k"),
        get_field(fields, "note")["ShortText"].alias("note"),
        tag_of(get_field(fields, "x")).alias("x_tag"),
        tag_of(get_field(fields, "absent")).alias("absent_tag"),
    )


@register
def form_field_put(spark, sf_dir):
    scored = put_field(F.col("fields"), "score", field_value("Number", F.lit(0)))
    seen = put_field(scored, "seen", field_value("CheckBox", F.lit(True)))
    changed = views.forms(spark, sf_dir).withColumn("fields", seen)
    marked = changed.withColumn("seen", get_field(F.col("fields"), "seen")["CheckBox"])
    return flat_forms(marked, "seen")


@register
def template_field_append(spark, sf_dir):
    longer = append_template_field(F.col("fields"), "climb", "Rating", 1, 9)
    return views.templates(spark, sf_dir).select("name", "year", F.posexplode(longer)).select(
        "name", "year", _big("pos").alias("pos"), "col.name", "col.kind", "col.min", "col.max"
    ).toDF("name", "year", "pos", "field", "kind", "low", "high")


@register
def template_build(spark, sf_dir):
    """A new template without fields for every event type, then two fields added."""
    empty = F.array().cast(f"array<{TEMPLATE_FIELD.simpleString()}>")
    first = append_template_field(empty, "auto", "Title")
    both = append_template_field(first, "speed", "Rating", 0, 5)
    new = views.templates(spark, sf_dir).select("name", F.lit(2025).alias("year"))
    return new.select("name", _big("year").alias("year"), F.posexplode(both)).select(
        "name", "year", _big("pos"), "col.name", "col.kind", "col.min", "col.max"
    ).toDF("name", "year", "pos", "field", "kind", "low", "high")


@register
def templates_list(spark, sf_dir):
    table = query.named_table(
        spark, _view_name("templates", sf_dir), lambda: views.templates(spark, sf_dir)
    )
    return query.list_templates(table)


def _view_name(table: str, sf_dir: str) -> str:
    return f"{table}_" + "".join(c if c.isalnum() else "_" for c in sf_dir)


@register
def template_get_batch(spark, sf_dir):
    roles = views.table(spark, sf_dir, "conversations").select(F.col("role").alias("name"))
    types = views.events(spark, sf_dir).select(F.col("event_type").alias("name"))
    found = lookup.get_records(views.templates(spark, sf_dir), types.union(roles), ["name"])
    return found.select("name", "found", "year", _big(F.array_size("fields")).alias("n_fields"))


@register
def schedules_list(spark, sf_dir):
    table = query.named_table(
        spark, _view_name("schedules", sf_dir), lambda: views.schedules(spark, sf_dir)
    )
    return query.list_schedules(table)


@register
def schedule_get_batch(spark, sf_dir):
    twice = (F.col("conv_id") * 2).cast("string")
    wanted = views.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv_"), twice).alias("event")
    )
    found = lookup.get_records(views.schedules(spark, sf_dir), wanted, ["event"])
    return _shifts(found, "event", "found")


def _shifts(schedules: DataFrame, *others: str) -> DataFrame:
    return schedules.select(*others, F.posexplode_outer("shifts").alias("pos", "shift")).select(
        *others,
        _big("pos").alias("pos"),
        F.col("shift.scouter").alias("scouter"),
        _big("shift.station").alias("station"),
        F.col("shift.match_start").alias("match_start"),
        F.col("shift.match_end").alias("match_end"),
    )


@register
def blob_list_keys(spark, sf_dir):
    return query.list_blobs(views.blobs(spark, sf_dir))


@register
def blob_get_batch(spark, sf_dir):
    urls = views.table(spark, sf_dir, "pages").select(F.col("url").alias("key"))
    missing = urls.select(F.reverse("key").alias("key"))
    found = lookup.get_records(views.blobs(spark, sf_dir), urls.union(missing), ["key"])
    return found.select(
        "key",
        "found",
        "key_sha256",
        F.sha2("payload", 256).alias("payload_sha256"),
        _big(F.octet_length("payload")).alias("n_bytes"),
    )


@register
def blob_encode(spark, sf_dir):
    framed = encode_blob(F.col("key"), F.col("payload"))
    return views.blobs(spark, sf_dir).select(
        "key",
        _big(F.octet_length(framed)).alias("n_bytes"),
        F.sha2(framed, 256).alias("content_sha256"),
    )


@register
def blob_lossy_keys(spark, sf_dir):
    """Frames whose key ends in a byte that is no UTF-8."""
    key = F.concat(F.col("key").cast("binary"), F.unhex(F.lit("FF")))
    length = F.unhex(F.lpad(F.hex(F.octet_length(key).cast("bigint")), 16, "0"))
    framed = views.blobs(spark, sf_dir).select(F.concat(length, key, F.col("payload")).alias("content"))
    return framed.select(decode_blob(F.col("content")).alias("blob")).select(
        F.col("blob.key").alias("key"), F.sha2("blob.payload", 256).alias("payload_sha256")
    )


@register
def blob_roundtrip(spark, sf_dir):
    framed = views.blobs(spark, sf_dir).select(
        encode_blob(F.col("key"), F.col("payload")).alias("content")
    )
    back = framed.select(decode_blob(F.col("content")).alias("blob"))
    return back.select(
        F.col("blob.key").alias("key"),
        sha256_hex(F.col("blob.key")).alias("key_sha256"),
        F.sha2("blob.payload", 256).alias("payload_sha256"),
    )


# Documents


@register
def form_documents_decode(spark, sf_dir):
    decoded = with_decoded(views.form_documents(spark, sf_dir), "Form", "doc")
    flat = flat_forms(
        decoded.select("event_id", "template", "reject_reason", "record.*"),
        "event_id",
        "reject_reason",
    )
    return flat.drop("n_fields")


@register
def forms_to_json(spark, sf_dir):
    members = ("fields", "scouter", "team", "match_number", "event_key", "id")
    doc = form_json(*[F.col(name) for name in members])
    return views.forms(spark, sf_dir).select("id", doc.alias("doc"))


@register
def schedules_to_json(spark, sf_dir):
    rows = query.list_schedules(views.schedules(spark, sf_dir))
    return rows.select("event", row_json(F.col("event")).alias("row"))


@register
def log_union_decode(spark, sf_dir):
    entry = [F.col(c) for c in ("id", "kind", "template", "action", "new_path")]
    lines = views.log_entries(spark, sf_dir).select("seq", log_json(*entry).alias("line"))
    decoded = with_decoded(lines, "Log", "line")
    return decoded.select("seq", "reject_reason", "record.*")


# Validation


def _known_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templates but one, whose forms are of an unknown template then."""
    named = views.templates(spark, sf_dir).where(F.col("name") != "error")
    return named.withColumnRenamed("name", "template")


@register
def validate_forms(spark, sf_dir):
    checked = validate.validate_forms(views.forms(spark, sf_dir), _known_templates(spark, sf_dir))
    return checked.select("template", "id", "template_known", "valid")


@register
def validate_violations(spark, sf_dir):
    forms = views.forms(spark, sf_dir)
    return validate.form_violations(forms, _known_templates(spark, sf_dir))


@register
def validate_rejects(spark, sf_dir):
    forms = views.forms(spark, sf_dir)
    _, rejected = validate.accept_forms(forms, _known_templates(spark, sf_dir))
    return rejected.select("template", "id", "reject_reason")


# History


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.accept_mutations(views.mutations(spark, sf_dir), ["key"]).where("accepted")


@register
def mutations_accept(spark, sf_dir):
    decided = history.accept_mutations(views.mutations(spark, sf_dir), ["key"])
    return decided.select("key", "seq", "action", "live_before", "accepted")


@register
def current_state(spark, sf_dir):
    current = history.current_state(_accepted(spark, sf_dir), ["key"])
    return current.select("key", "seq", "action", "value")


@register
def version_history(spark, sf_dir):
    accepted = _staged(spark, _accepted(spark, sf_dir), "accepted")
    versions = history.version_history(accepted, ["key"])
    return versions.select("key", "seq", "action", "superseded_by", "version_id")


def _of_kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return views.ledger_mutations(spark, sf_dir).where(F.col("kind") == kind)


def _decided_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = stage_in(new_scratch(spark, "stage"))
    return decide_schedules(_of_kind(spark, sf_dir, "Schedule"), stage=stage)


@register
def schedule_mutations(spark, sf_dir):
    decided = _decided_schedules(spark, sf_dir)
    return decided.select("key", "seq", "action", "accepted", "reject_reason")


@register
def schedules_current(spark, sf_dir):
    accepted = _staged(spark, _decided_schedules(spark, sf_dir).where("accepted"), "accepted")
    current = history.current_state_stored(accepted, ["key"])
    return _shifts(current.select("key", "seq", "schedule.shifts"), "key", "seq")


@register
def blob_mutations(spark, sf_dir):
    decided = decide_blobs(_of_kind(spark, sf_dir, "Bytes"))
    return decided.select("key", "seq", "action", "accepted", "reject_reason")


@register
def blobs_current(spark, sf_dir):
    accepted = decide_blobs(_of_kind(spark, sf_dir, "Bytes")).where("accepted")
    current = history.current_state_stored(_staged(spark, accepted, "accepted"), ["key"])
    return current.select("key", "seq", F.sha2("payload", 256).alias("payload_sha256"))


def _staged(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    return stage_in(new_scratch(spark, "stage"))(rows, name)


def _accepted_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = views.template_mutations(spark, sf_dir)
    accepted = history.accept_mutations(changes, ["template"]).where("accepted")
    return _staged(spark, accepted, "templates")


@register
def template_generations(spark, sf_dir):
    return cascade.template_generations(_accepted_templates(spark, sf_dir))


def _decided_forms(spark: SparkSession, sf_dir: str, templates: DataFrame) -> DataFrame:
    return cascade.accept_form_mutations(views.form_mutations(spark, sf_dir), templates)


@register
def form_mutations(spark, sf_dir):
    return _decided_forms(spark, sf_dir, _accepted_templates(spark, sf_dir)).select(
        "template", "key", "seq", "action", "generation", "accepted", "reject_reason"
    )


@register
def forms_current(spark, sf_dir):
    templates = _accepted_templates(spark, sf_dir)
    accepted = _decided_forms(spark, sf_dir, templates).where("accepted")
    current = history.current_state(accepted, cascade.FORM_KEYS)
    generations = cascade.template_generations(templates)
    return cascade.live_forms(current, generations).select("template", "generation", "key", "seq")


@register
def forms_submit(spark, sf_dir):
    """Form adds: strict decoding, new ids, template check."""
    stage = stage_in(new_scratch(spark, "stage"))
    outcomes = apply_mutations(views.form_submissions(spark, sf_dir), stage=stage)
    return outcomes.where(F.col("kind") == "Form").select(
        "seq", "template", "generation", "key", F.col("form.id").alias("id"), "accepted",
        "reject_reason",
    )


def _outcome_columns(outcomes: DataFrame) -> DataFrame:
    return outcomes.select(
        "seq", "kind", "template", "generation", "key", "action", "accepted", "reject_reason"
    )


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = stage_in(new_scratch(spark, "stage"))
    return apply_mutations(views.ledger_mutations(spark, sf_dir), new_ids=False, stage=stage)


@register
def mixed_outcomes(spark, sf_dir):
    """All kinds of mutations decided as one batch."""
    return _outcome_columns(_mixed(spark, sf_dir))


@register
def mixed_change_log(spark, sf_dir):
    return change_log(_mixed(spark, sf_dir).where("accepted"))


def _committed(spark: SparkSession, sf_dir: str, *, snapshot_between: bool = False) -> Ledger:
    """A ledger holding the mixed mutations in two batches, cut at the middle `seq`."""
    ledger = Ledger(spark, new_scratch(spark, "ledger"))
    mutations = views.ledger_mutations(spark, sf_dir)
    middle = mutations.agg(F.expr("max(seq) div 2")).first()[0]
    ledger.commit("first", mutations.where(F.col("seq") <= middle), new_ids=False)
    if snapshot_between:
        ledger.snapshot()
    ledger.commit("second", mutations.where(F.col("seq") > middle), new_ids=False)
    return ledger


@register
def ledger_outcomes(spark, sf_dir):
    return _outcome_columns(_committed(spark, sf_dir).outcomes())


@register
def ledger_change_log(spark, sf_dir):
    return _committed(spark, sf_dir).change_log()


@register
def ledger_forms(spark, sf_dir):
    """Read from the current-state table that follows the commits."""
    ledger = _committed(spark, sf_dir)
    ledger.snapshot()
    return flat_forms(ledger.forms(), "generation")


@register
def ledger_forms_filter(spark, sf_dir):
    """A filter on the current-state table, which reads one template's folder."""
    ledger = _committed(spark, sf_dir)
    ledger.snapshot()
    rows = query.filter_forms(ledger.forms(LEDGER_TEMPLATE), LEDGER_TEMPLATE, scouter=FILTER["scouter"])
    return flat_forms(rows, "generation")


@register
def ledger_get_batch(spark, sf_dir):
    """Wanted forms looked up in their buckets, between snapshot and later mutations."""
    ledger = _committed(spark, sf_dir, snapshot_between=True)
    wanted = views.events(spark, sf_dir).select(
        views.mixed_template().alias("template"), F.col("user_id").cast("string").alias("id")
    )
    return flat_forms(ledger.get_forms(wanted), "found", "generation").drop("n_fields")


@register
def ledger_two_writers(spark, sf_dir):
    """The same blob mutations committed by two writers at once; the loser decides them anew."""
    root, mutations = new_scratch(spark, "ledger"), _of_kind(spark, sf_dir, "Bytes")
    failures: list[Exception] = []

    def write(name: str) -> None:
        try:
            Ledger(spark, root).commit(name, mutations, assign_seq=True)
        except Exception as failure:
            failures.append(failure)

    threads = [Thread(target=write, args=(name,)) for name in ("one", "two")]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    if failures:
        raise failures[0]
    return Ledger(spark, root).outcomes().select("seq", "key", "action", "accepted", "reject_reason")


@register
def ledger_intake_stream(spark, sf_dir):
    """The mixed mutations landed as files in three pieces, each taken in by a resumed stream."""
    scratch = new_scratch(spark, "intake")
    ledger, landing = Ledger(spark, f"{scratch}/ledger"), f"{scratch}/landing"
    mutations = views.ledger_mutations(spark, sf_dir)
    last = mutations.agg(F.max("seq")).first()[0]
    for piece in range(3):
        inside = F.expr(f"seq * 3 div {last + 1}") == piece
        mutations.where(inside).write.mode("append").parquet(landing)
        rows = intake.read_mutations(spark, landing)
        intake.ingest(rows, ledger, "intake", f"{scratch}/cursor", new_ids=False).awaitTermination()
    return _outcome_columns(ledger.outcomes())


@register
def ledger_feed_stream(spark, sf_dir):
    """The log files that the commits published, followed by a stream, read back."""
    ledger, out = _committed(spark, sf_dir), new_scratch(spark, "feed")
    change_feed.follow(
        spark, f"{ledger.root}/change_log", f"{out}/entries", f"{out}/cursor"
    ).awaitTermination()
    return spark.read.parquet(f"{out}/entries")


# Change feed


@register
def change_log_entries(spark, sf_dir):
    return views.log(spark, sf_dir)


def _stored_log(spark: SparkSession, sf_dir: str) -> IndexedLog:
    return IndexedLog.write(views.log(spark, sf_dir), new_scratch(spark, "log"))


@register
def sync_first(spark, sf_dir):
    return _stored_log(spark, sf_dir).sync()


def _cursor(seq: int) -> str:
    """The log id of an entry, worked out as `derived_id` does."""
    import hashlib

    h = hashlib.sha256(f"{history.LOG_IDS}:{seq}".encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-8{h[13:16]}-a{h[17:20]}-{h[20:32]}"


@register
def sync_after(spark, sf_dir):
    return _stored_log(spark, sf_dir).sync(_cursor(CURSOR_SEQ))


@register
def sync_after_unknown(spark, sf_dir):
    return _stored_log(spark, sf_dir).sync(_cursor(-1))


@register
def sync_drain(spark, sf_dir):
    return _stored_log(spark, sf_dir).drain(_cursor(CURSOR_SEQ))


@register
def sync_consumers(spark, sf_dir):
    return _stored_log(spark, sf_dir).next_entries(views.cursors(spark, sf_dir))


@register
def change_feed_stream(spark, sf_dir):
    """The log written as files, followed by a stream, read back."""
    scratch = new_scratch(spark, "feed")
    views.log(spark, sf_dir).write.parquet(f"{scratch}/log")
    change_feed.follow(
        spark, f"{scratch}/log", f"{scratch}/out", f"{scratch}/cursor", files_per_trigger=2
    ).awaitTermination()
    return spark.read.parquet(f"{scratch}/out")


# Ages, locations, files


@register
def artifact_age(spark, sf_dir):
    accepted = _staged(spark, _accepted(spark, sf_dir), "accepted")
    versions = history.version_history(accepted, ["key"])
    return versions.select(
        "key",
        "seq",
        ages.age(F.col("committed_at"), _as_of(), "days").alias("days"),
        ages.age(F.col("committed_at"), _as_of(), "timestamp").alias("created"),
    )


@register
def artifact_location(spark, sf_dir):
    """Where each version of each form lies, its template archived or not."""
    templates = _accepted_templates(spark, sf_dir)
    accepted = _decided_forms(spark, sf_dir, templates).where("accepted")
    versions = history.version_history(_staged(spark, accepted, "forms"), cascade.FORM_KEYS)
    generations = cascade.template_generations(templates)
    named = cascade.with_template_version(versions, generations)
    path = location(
        F.lit("Form"), F.col("key"), F.col("version_id"), F.col("template"), F.col("template_version")
    )
    return named.select("template", "generation", "key", "seq", path.alias("path"))


@register
def artifact_locations(spark, sf_dir):
    """Where each version of each blob, schedule and template lies, live or archived."""
    schedules = _staged(spark, _decided_schedules(spark, sf_dir).where("accepted"), "schedules")
    versions = {
        "Bytes": _staged(spark, _accepted(spark, sf_dir), "accepted"),
        "Schedule": schedules,
        "Template": _accepted_templates(spark, sf_dir).withColumnRenamed("template", "key"),
    }
    rows = [
        history.version_history(accepted, ["key"]).select(
            F.lit(kind).alias("kind"),
            "key",
            "seq",
            location(F.lit(kind), F.col("key"), F.col("version_id")).alias("path"),
        )
        for kind, accepted in versions.items()
    ]
    return reduce(DataFrame.unionByName, rows)


# Stores of one file per record


def _exported(spark: SparkSession, **tables: DataFrame) -> str:
    root = new_scratch(spark, "store")
    record_files.export_store(root, **tables)
    return root


@register
def store_forms(spark, sf_dir):
    """Forms and templates written as one file each, then read back."""
    root = _exported(
        spark, forms=views.forms(spark, sf_dir), templates=views.templates(spark, sf_dir)
    )
    templates = record_store.read_templates(spark, root)
    return flat_forms(record_store.import_forms(record_store.read_forms(spark, root), templates))


@register
def store_forms_of_one(spark, sf_dir):
    """The live forms of one template, read from its folder alone."""
    root = _exported(
        spark, forms=views.forms(spark, sf_dir), templates=views.templates(spark, sf_dir)
    )
    templates = record_store.read_templates(spark, root)
    return flat_forms(record_store.import_forms(record_store.read_forms(spark, root, TEMPLATE), templates))


@register
def store_partly_absent(spark, sf_dir):
    """What a store without forms and schedules holds: absent folders are empty."""
    root = _exported(spark, templates=views.templates(spark, sf_dir))
    tables = record_store.import_store(spark, root)
    rows = [
        tables[table].select(F.lit(table).alias("kind"), F.col(key).alias("key"))
        for table, key in (("templates", "name"), ("forms", "id"), ("schedules", "event"), ("blobs", "key"))
    ]
    return reduce(DataFrame.unionByName, rows)


@register
def store_schedules_strict(spark, sf_dir):
    """Schedules read so that one unreadable file would fail the job."""
    root = _exported(spark, schedules=views.schedules(spark, sf_dir))
    rows = record_store.accepted_records(record_store.read_schedules(spark, root), strict=True)
    return _shifts(rows.select("record.*"), "event")


@register
def store_into_ledger(spark, sf_dir):
    """The live records of a store committed as one batch; forms that break their template stay out."""
    root = _exported(
        spark,
        forms=views.forms(spark, sf_dir),
        templates=views.templates(spark, sf_dir),
        schedules=views.schedules(spark, sf_dir),
        blobs=views.blobs(spark, sf_dir),
    )
    ledger = Ledger(spark, new_scratch(spark, "ledger"))
    # Not the first batch: the store goes behind what is there.
    ledger.commit("earlier", _of_kind(spark, sf_dir, "Bytes"))
    mutations = record_store.store_mutations(spark, root)
    # They are written by now. Its files take a block of the disk each, many times what they hold.
    drop_store(spark, root)
    ledger.commit("store", mutations, new_ids=False, assign_seq=True)
    return flat_forms(ledger.forms())


def _exported_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """The mixed mutations, exported with all versions and taken in behind another batch."""
    ledger, root = Ledger(spark, new_scratch(spark, "ledger")), new_scratch(spark, "store")
    # Every version with a time of its own, as the writer of a store gives them.
    dated = F.timestamp_seconds(F.lit(1704067200) + F.col("seq"))
    mutations = views.ledger_mutations(spark, sf_dir).withColumn("committed_at", dated)
    ledger.commit("all", mutations, new_ids=False)
    store_history.export_history(ledger, root)
    other = Ledger(spark, new_scratch(spark, "ledger"))
    other.commit("earlier", mutations.where("kind = 'Bytes' AND action = 'Edit'"), assign_seq=True)
    history_rows = store_history.history_mutations(spark, root, f"{root}/log")
    other.commit("history", history_rows, new_ids=False, assign_seq=True)
    return other


@register
def store_history_versions(spark, sf_dir):
    """All versions of a ledger written as files with a log, and chained together again."""
    ledger = _exported_ledger(spark, sf_dir)
    rows = ledger.outcomes().where("batch = 'history'")
    first = rows.agg(F.min("seq")).first()[0] or 0
    content = F.coalesce(
        F.to_json("form"), F.to_json("schedule"), F.sha2("payload", 256), F.col("template_record.name")
    )
    return rows.select(
        (F.col("seq") - first).alias("place"), "kind", "template", (F.col("generation") - first).alias("generation"),
        "key", "action", "accepted", content.isNotNull().alias("content"),
        F.col("form.team").alias("team"), F.col("form.match_number").alias("match_number"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.col("schedule.shifts")[0]["match_start"].alias("match_start"),
        F.unix_seconds("committed_at").alias("committed"),
    )


@register
def store_history_log(spark, sf_dir):
    """The log that came back, ids and paths included."""
    log = _exported_ledger(spark, sf_dir).change_log()
    first = log.agg(F.min("seq")).first()[0] or 0
    return log.select((F.col("seq") - first).alias("place"), "id", "kind", "template", "action", "new_path")


@register
def store_schedules(spark, sf_dir):
    root = _exported(spark, schedules=views.schedules(spark, sf_dir))
    back = record_store.import_schedules(record_store.read_schedules(spark, root))
    return _shifts(back, "event")


@register
def store_blobs(spark, sf_dir):
    root = _exported(spark, blobs=views.blobs(spark, sf_dir))
    blobs = record_store.import_blobs(record_store.read_blob_files(spark, root))
    return blobs.select("key", "key_sha256", F.sha2("payload", 256).alias("payload_sha256"))


@register
def file_inventory(spark, sf_dir):
    """Names and sizes of the files of a store's blobs, their contents never read."""
    root = _exported(spark, blobs=views.blobs(spark, sf_dir))
    files = record_store.file_inventory(spark, root, recursive=True)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@register
def store_log(spark, sf_dir):
    """The log written as lines, then read back and numbered by line."""
    path = new_scratch(spark, "store") + "/log"
    record_files.write_log(views.log_entries(spark, sf_dir), path)
    return record_store.read_log(spark, path)


@register
def store_lists(spark, sf_dir):
    """Names in a store, read without the rest of the documents."""
    root = _exported(
        spark, schedules=views.schedules(spark, sf_dir), templates=views.templates(spark, sf_dir)
    )
    names = record_store.list_template_names(spark, root)
    events = record_store.list_schedule_events(spark, root)
    return names.select(F.lit("template").alias("kind"), "name").union(
        events.select(F.lit("schedule").alias("kind"), "event")
    )
