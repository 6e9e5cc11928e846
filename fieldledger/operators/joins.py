"""Joins with a small side whose size is measured before it is broadcast."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
# Rows of one key that one task of a shuffled join may get.
HOT_ROWS = 2_000_000


def measured_bytes(small: DataFrame) -> int:
    """Size of the rows as text, summed on the executors."""
    width = F.octet_length(F.to_json(F.struct(*small.columns)))
    return small.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"]


def fits_broadcast(small: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return limit > 0 and measured_bytes(small) <= limit


def join_small(
    rows: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    *,
    spread: Column,
    limit: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join with a side that has one row per key.

    Within the limit it is broadcast and `rows` are not shuffled. Beyond it a key
    with more than `hot_rows` rows is cut into parts of about that size by the
    hash of `spread`, and its one row on the small side is copied once per part.
    No task gets more than a part of a key, and there are at most as many copies
    as `rows` hold multiples of `hot_rows`.
    """
    keys = list(keys)
    if fits_broadcast(small, limit):
        return rows.join(F.broadcast(small), keys, how)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    # At most one row per `hot_rows` rows of input, hence safe to broadcast.
    hot = F.broadcast(counted.select(*keys, F.ceil(F.col("_n") / hot_rows).alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    # Rows without a key match nothing and may go anywhere.
    keyless = reduce(lambda a, b: a | b, [F.col(key).isNull() for key in keys])
    hashed = F.xxhash64(spread)
    parted = rows.join(hot, keys, "left").withColumn(
        "_part", F.when(keyless, hashed).otherwise(F.pmod(hashed, parts))
    )
    first = F.lit(0).cast("bigint")
    copies = small.join(hot, keys, "left").withColumn(
        "_part", F.explode(F.sequence(first, parts - 1))
    )
    return parted.drop("_parts").join(copies.drop("_parts"), [*keys, "_part"], how).drop("_part")
