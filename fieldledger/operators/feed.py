"""Pull reads of the change log by cursor."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.functions.documents import UUID_PATTERN
from fieldledger.operators.joins import BROADCAST_BYTES, fits_broadcast, join_small
from fieldledger.operators.ordered import RANGE_WIDTH, carry

ENTRY = ("seq", "id", "kind", "template", "action", "new_path")


def first_entry(log: DataFrame) -> DataFrame:
    return log.orderBy("seq").limit(1)


def checked_cursor(cursor: str) -> str:
    if not re.match(UUID_PATTERN, cursor):
        raise ValueError(f"malformed cursor {cursor!r}")
    return cursor


def drain(log: DataFrame, after: str | None = None) -> DataFrame:
    """All entries past the cursor; an unknown cursor gives none."""
    if after is None:
        return log
    position = log.where(F.col("id") == F.lit(checked_cursor(after))).agg(F.min("seq"))
    return log.where(F.col("seq") > position.scalar())


def entry_after(log: DataFrame, cursor: str) -> DataFrame:
    """The entry right after the cursor; no row when it is unknown or the last."""
    return first_entry(drain(log, cursor))


def sync(log: DataFrame, last_id: str | None = None) -> DataFrame:
    return first_entry(log) if last_id is None else entry_after(log, last_id)


def next_entries(
    log: DataFrame,
    cursors: DataFrame,
    *,
    limit: int = BROADCAST_BYTES,
    width: int = RANGE_WIDTH,
) -> DataFrame:
    """The next entry of each consumer; `cursors` has `consumer` and `cursor`.

    A null cursor gets the first entry; unknown and last cursors get nulls.
    Cursors are answered once each, however many consumers share one.
    """
    asked = cursors.select("cursor").distinct()
    known = asked.where(F.col("cursor").isNotNull())
    followed = carry(
        log.select("seq", "id"), [], "seq", F.col("seq"), "next_seq", backward=True, width=width
    )
    if fits_broadcast(known, limit):
        known = F.broadcast(known)
    following = followed.join(known, F.col("id") == F.col("cursor")).select("cursor", "next_seq")
    opening = log.agg(F.min("seq").alias("next_seq")).select(
        F.lit(None).cast("string").alias("cursor"), "next_seq"
    )
    answers = (
        following.unionByName(opening)
        .where(F.col("next_seq").isNotNull())
        .withColumnRenamed("next_seq", "seq")
    )
    # Each entry follows one cursor only, and the first entry none, so `seq` is unique.
    entries = answers.join(log, "seq").withColumn("_asked", F.coalesce("cursor", F.lit("")))
    consumers = cursors.select("consumer", "cursor").withColumn(
        "_asked", F.coalesce("cursor", F.lit(""))
    )
    answered = join_small(
        consumers,
        entries.drop("cursor"),
        ["_asked"],
        "left",
        spread=F.col("consumer"),
        limit=limit,
    )
    return answered.select("consumer", "cursor", *ENTRY)
