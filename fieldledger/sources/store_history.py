"""All versions of a store of one file per record, with its log, into a ledger and out of it.

A ledger knows the order of every version; a store knows it from its log alone. An entry of a template,
schedule or blob names the file that the version before it was archived under, so versions
are chained to files along the entries of their hash. Entries of forms name the live file only.
Their versions are placed by generation, the archived folder of their template, and within it by the
time their file was written: the n-th Add or Edit of a form in a generation wrote its n-th file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.functions.codecs import sha256_hex
from fieldledger.functions.documents import string_member, with_parsed
from fieldledger.functions.locations import FOLDERS, LIVE, location
from fieldledger.operators.cascade import FORM_KEYS, bind_generation, with_template_version
from fieldledger.operators.history import version_history
from fieldledger.operators.joins import join_small
from fieldledger.operators.ordered import carry
from fieldledger.schemas import LOGGED, MUTATIONS
from fieldledger.session import new_scratch
from fieldledger.sources import record_files, record_store
from fieldledger.sources.ledger import Ledger
from fieldledger.sources.staging import gapless, stage_in
from fieldledger.sources.store_source import exporting

_NAMED = ("Template", "Schedule", "Bytes")
# The member of a document that is its key.
_KEY_MEMBER = {"Template": "name", "Schedule": "event", "Form": "id"}


def _numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds `nth`, from 0 in the given order within the keys; a hot key is shared by many tasks."""
    placed = gapless(rows.withColumnRenamed("seq", "_seq") if "seq" in rows.columns else rows, [*keys, *order])
    firsts = placed.groupBy(*keys).agg(F.min("seq").alias("_front"))
    nth = join_small(placed, firsts, keys, "left", spread=F.col("seq"))
    nth = nth.withColumn("nth", F.col("seq") - F.col("_front")).drop("seq", "_front")
    return nth.withColumnRenamed("_seq", "seq")


def _files(spark: SparkSession, root: str) -> DataFrame:
    """Every version's file: kind, name, hash, key, content and, for forms, the template's file."""
    none = F.lit(None)
    found = []
    for kind, member in _KEY_MEMBER.items():
        documents = record_store.read_documents(spark, f"{root}/{FOLDERS[kind]}", live_only=False)
        key = string_member(F.col("_parsed"), member)
        folder = F.regexp_extract("path", record_store.FORM_PARTS, 1) if kind == "Form" else none.cast("string")
        found.append(
            with_parsed(documents, "value").select(
                F.lit(kind).alias("kind"), "hash", "version", folder.alias("template_file"), key.alias("key"),
                F.col("value").alias("doc"), none.cast("binary").alias("payload"), "modified",
            )
        )
    blobs = record_store.read_blob_files(spark, root, live_only=False)
    found.append(
        blobs.select(
            F.lit("Bytes").alias("kind"), "hash", "version", none.cast("string").alias("template_file"),
            "record.key", none.cast("string").alias("doc"), "record.payload", "modified",
        )
    )
    return reduce(DataFrame.unionByName, found)


def history_mutations(spark: SparkSession, root: str, log_path: str) -> DataFrame:
    """The log of a store as mutations with their contents, for `Ledger.commit`.

    Commit them with `new_ids=False` and `assign_seq=True`, into an empty ledger or behind what it
    holds. Entries keep their ids and paths. An entry whose file is missing comes without
    content and is refused by the commit, as is one that the log cannot have allowed.
    """
    stage = stage_in(new_scratch(spark, "store-history"))
    log = stage(record_store.read_log(spark, log_path), "log").where(F.col("reject_reason").isNull())
    log = log.withColumn("hash", F.split("new_path", r"\.")[0])
    files = stage(_files(spark, root), "files")
    writes = F.col("action").isin("Add", "Edit")
    # The key of a hash, from whichever version can be read.
    keys = files.where(F.col("key").isNotNull()).groupBy("kind", "hash").agg(F.min("key").alias("key"))

    named = log.where(F.col("kind").isin(*_NAMED))
    chained = carry(named, ["kind", "hash"], "seq", F.col("new_path"), "archived_as", backward=True)
    version = F.coalesce(F.split("archived_as", r"\.")[1], F.lit(LIVE))
    chained = chained.withColumn("version", F.when(writes, version)).drop("archived_as")
    content = files.where(F.col("kind").isin(*_NAMED)).select(
        "kind", "hash", "version", "doc", "payload", "modified"
    )
    named = chained.join(content, ["kind", "hash", "version"], "left").drop("version")

    # Forms by the hash of their template's name, which is all that a template's entries tell.
    forms = log.where(F.col("kind") == "Form").withColumn("name", F.col("template"))
    changes = log.where(F.col("kind") == "Template").select(F.col("hash").alias("template"), "seq", "action")
    bound = bind_generation(forms.withColumn("template", sha256_hex(F.col("name"))), changes)
    bound = stage(bound.drop("template").withColumnRenamed("name", "template"), "forms")
    asked = _numbered(bound.where(writes), ["generation", "hash"], ["seq"])
    generations = record_store.template_versions(log)
    own = files.where(F.col("kind") == "Form").drop("kind", "key")
    own = join_small(own, generations, ["template_file"], "left", spread=F.col("hash"))
    own = own.withColumn("live", (F.col("version") == LIVE).cast("int"))
    own = _numbered(own, ["generation", "hash"], ["modified", "live", "version"])
    own = own.select("generation", "hash", "nth", "doc", "payload", "modified")
    forms = asked.join(own, ["generation", "hash", "nth"], "left").drop("generation", "nth")
    gone = bound.where(~writes).drop("generation")

    columns = ["seq", "id", "kind", "template", "action", "new_path", "hash", "doc", "payload", "modified"]
    whole = named.select(*columns).unionByName(forms.select(*columns)).unionByName(gone, allowMissingColumns=True)
    keyed = join_small(whole, keys, ["kind", "hash"], "left", spread=F.col("seq"))
    given = {
        "committed_at": F.col("modified"),
        "log_id": F.col("id"),
        "logged_path": F.col("new_path"),
    }
    return keyed.select(
        *[
            given.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in [*MUTATIONS.fields, *LOGGED.fields]
        ]
    )


def _archived(rows: DataFrame, version: Column, template_version: Column | None = None) -> DataFrame:
    path = location(F.col("kind"), F.col("key"), version, F.col("template"), template_version)
    return rows.withColumn("path", path)


def _with_followers(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Every version ever live with the `seq` that replaced it; order is worked out on keys alone."""
    followed = version_history(versions.select(*keys, "seq", "action"), keys)
    return versions.join(followed.select("seq", "superseded_by", "version_id"), "seq")


def export_history(ledger: Ledger, root: str) -> dict[str, dict[str, int]]:
    """Writes every version and the log of a ledger as a store; returns the totals of each kind.

    The files become readable when all of them are written, and the log behind them. Files get the
    time of their commit where the file system can set it, as local disks can.
    """
    spark = ledger.spark
    kept = ledger.at(ledger.view())
    log = stage_in(new_scratch(spark, "export"))(kept.change_log(), "log")
    with exporting(spark, root) as export:
        totals = {kind: export.add(files) for kind, files in _version_files(kept, log)}
    record_files.write_log(log, f"{root}/log")
    return totals


def _version_files(kept: Ledger, log: DataFrame) -> Iterator[tuple[str, DataFrame]]:
    """By kind, the files of all versions."""
    paths = log.select("seq", "new_path")
    for kind in _NAMED:
        # The entry that replaced a version tells the name it was archived under.
        versions = _with_followers(kept.versions(kind), ["key"])
        replaced = paths.select(F.col("seq").alias("superseded_by"), F.col("new_path").alias("name"))
        rows = versions.join(replaced, "superseded_by", "left")
        version = F.coalesce(F.split("name", r"\.")[1], F.lit(LIVE))
        yield kind, _laid(_archived(rows, version), kind)
    generations = kept.generations()
    renamed = paths.select(F.col("seq").alias("seq_to"), F.split("new_path", r"\.")[1].alias("version_id"))
    generations = generations.drop("version_id").join(renamed, "seq_to", "left")
    forms = _with_followers(kept.versions("Form"), list(FORM_KEYS))
    forms = with_template_version(forms, generations)
    rows = _archived(forms, F.col("version_id"), F.col("template_version"))
    yield "Form", _laid(rows, "Form")


_RECORDS = {"Template": "template_record", "Schedule": "schedule", "Form": "form"}
_LAYOUTS = {
    "Template": record_files.template_files,
    "Schedule": record_files.schedule_files,
    "Form": record_files.form_files,
    "Bytes": record_files.blob_files,
}


def _laid(rows: DataFrame, kind: str) -> DataFrame:
    record = _RECORDS.get(kind)
    if record:
        # A template or schedule keeps the name in its document, a form gets its id.
        names = [n for n in rows.schema[record].dataType.names if n != _KEY_MEMBER[kind]]
        content = [F.col(f"{record}.{n}").alias(n) for n in names]
        key = F.col("key").alias(_KEY_MEMBER[kind])
        template = [F.col("template")] if kind == "Form" else []
        rows = rows.select(*content, key, *template, F.col("path").alias("_path"), F.col("committed_at").alias("written"))
    else:
        rows = rows.select("key", "payload", F.col("path").alias("_path"), F.col("committed_at").alias("written"))
    laid = _LAYOUTS[kind](rows, "_path", "written")
    return laid.drop("path").withColumnRenamed("_path", "path")
