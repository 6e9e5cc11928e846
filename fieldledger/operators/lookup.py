"""Lookups by key: one key as a pushed-down filter, a table of keys as a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.operators.joins import BROADCAST_BYTES, fits_broadcast
from fieldledger.session import new_scratch
from fieldledger.sources.staging import stage_in


def get_record(current: DataFrame, **key) -> DataFrame:
    """The live record under one key; no row when there is none."""
    for name, value in key.items():
        current = current.where(F.col(name) == F.lit(value))
    return current


def get_records(
    current: DataFrame,
    wanted: DataFrame,
    keys: Sequence[str],
    *,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per distinct wanted key, with `found` and the record or nulls.

    Repeated wanted keys are collapsed before they are shuffled and `current` has
    one row per key, so no key is hot. When the wanted keys are few, the current
    records are narrowed to them where they are scanned, not after a shuffle.
    """
    keys = list(keys)
    # Written once; measured, broadcast and joined from there.
    stage = stage_in(new_scratch(current.sparkSession, "wanted"))
    distinct = stage(wanted.select(*keys).distinct(), "keys")
    if fits_broadcast(distinct, limit):
        current = current.join(F.broadcast(distinct), keys, "left_semi")
    marked = current.withColumn("found", F.lit(True))
    return distinct.join(marked, keys, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )
