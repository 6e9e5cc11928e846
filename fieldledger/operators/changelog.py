"""The change log: one entry per accepted mutation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.functions.codecs import derived_id
from fieldledger.functions.locations import file_name
from fieldledger.operators.history import LOG_IDS, VERSION_IDS


def logged_path(kind: Column, key: Column, action: Column, seq: Column) -> Column:
    """The file name an entry points at.

    Adds and all form entries name the live file, other edits and deletes the
    archived one.
    """
    names_live = (kind == "Form") | (action == "Add")
    return F.when(names_live, file_name(key)).otherwise(
        file_name(key, derived_id(VERSION_IDS, seq))
    )


def change_log(accepted: DataFrame) -> DataFrame:
    """Entries of accepted mutations with `seq, kind, template, key, action`.

    A mutation taken over from another log keeps its `log_id` and `logged_path` there.
    """
    seq, kind = F.col("seq"), F.col("kind")
    ids, path = derived_id(LOG_IDS, seq), logged_path(kind, F.col("key"), F.col("action"), seq)
    if "log_id" in accepted.columns:
        ids, path = F.coalesce("log_id", ids), F.coalesce("logged_path", path)
    return accepted.select(
        "seq",
        ids.alias("id"),
        "kind",
        F.when(kind == "Form", F.col("template")).alias("template"),
        "action",
        path.alias("new_path"),
    )
