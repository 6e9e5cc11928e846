"""Ordered look-back and look-ahead per key that survive one huge key.

A window per key puts all rows of the key into one task. Here the rows of every key
are counted first, and keys with more than `width` rows are cut along `seq` into
ranges of about `width` rows, whatever the gaps in `seq` are. What enters a range
from the ranges before it comes from a summary with one row per hot key and range,
pre-aggregated on the map side. All other rows cost the one shuffle of a plain
window. Null keys are one key, hot or not, as they are for a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key and range that one window task may have to hold, give or take a tenth.
RANGE_WIDTH = 1 << 20

_BEFORE_ALL = -(1 << 62)


def _hash_of(keys: Sequence[str], seq: str) -> Column:
    # Without keys all rows have one hash; a literal would make the join on it a nested loop.
    return F.xxhash64(*keys) if keys else F.pmod(F.col(seq), F.lit(1).cast("bigint"))


def range_cuts(rows: DataFrame, keys: Sequence[str], seq: str, width: int) -> DataFrame | None:
    """`_hash` and `_cuts`, the last `seq` of all ranges but one, of keys with more rows.

    None when no key has. The cuts are fixed before the plan is made, so that all its
    parts, and all retries of their tasks, go by the same ones. They are two per
    `width` rows at most: a key gets the next power of two of the ranges it needs.
    """
    session = rows.sparkSession
    hashed = rows.select(_hash_of(keys, seq).alias("_hash"), F.col(seq).alias("_seq"))
    counts = hashed.groupBy("_hash").agg(F.count("*").alias("n")).where(F.col("n") > width)
    by_parts: dict[int, list[tuple[int]]] = {}
    for row in counts.collect():
        needed = -(-row["n"] // width)
        by_parts.setdefault(1 << (needed - 1).bit_length(), []).append((row["_hash"],))
    found = []
    for parts, hashes in sorted(by_parts.items()):
        wanted = F.broadcast(session.createDataFrame(hashes, "_hash bigint"))
        shares = [i / parts for i in range(1, parts)]
        cuts = F.percentile_approx("_seq", shares, 10 * parts)
        found += hashed.join(wanted, "_hash").groupBy("_hash").agg(cuts.alias("_cuts")).collect()
    if not found:
        return None
    cut = [(row["_hash"], sorted(set(row["_cuts"]))) for row in found]
    return session.createDataFrame(cut, "_hash bigint, _cuts array<bigint>")


def carry(
    rows: DataFrame,
    keys: Sequence[str],
    seq: str,
    value: Column,
    name: str,
    *,
    backward: bool = False,
    initial: DataFrame | None = None,
    width: int | None = RANGE_WIDTH,
) -> DataFrame:
    """Adds `name`: the nearest earlier non-null `value` of the same key.

    With `backward` it is the nearest later one. `initial` (the keys and a column
    `name`, one row per key) gives the value in front of the first row. `seq` must
    be unique within a key. Rows should be narrow, as windows hold them: bring content
    in by `seq` later. A `width` of None says that no key has too many rows for a task, as in a
    table of few rows, and saves the pass that counts them.
    """
    if width is not None and width <= 0:
        raise ValueError("width must be positive")
    if backward and initial is not None:
        raise ValueError("an initial value needs the forward direction")
    keys = list(keys)
    valued = rows.withColumn("_value", value)
    if initial is not None:
        given = initial.select(
            *keys,
            F.lit(_BEFORE_ALL).alias(seq),
            F.col(name).alias("_value"),
            F.lit(True).alias("_given"),
        )
        valued = valued.withColumn("_given", F.lit(False)).unionByName(
            given, allowMissingColumns=True
        )
    cuts = None if width is None else range_cuts(rows, keys, seq, width)
    if cuts is None:
        ranged = valued.withColumn("_range", F.lit(None).cast("int"))
    else:
        passed = F.size(F.filter("_cuts", lambda cut: cut < F.col(seq)))
        ranged = (
            valued.withColumn("_hash", _hash_of(keys, seq))
            .join(F.broadcast(cuts), "_hash", "left")
            .withColumn("_range", F.when(F.col("_cuts").isNotNull(), passed))
            .drop("_hash", "_cuts")
        )

    seq_order = F.col(seq).desc() if backward else F.col(seq).asc()
    within_range = (
        Window.partitionBy(*keys, "_range")
        .orderBy(seq_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.last("_value", ignorenulls=True).over(within_range)
    carried = ranged.withColumn(name, inside)
    if cuts is not None:
        entering = _entering(ranged, keys, seq, backward)
        same = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
        same.append(F.col("_range") == F.col("_into"))
        carried = (
            carried.join(entering.hint("shuffle_hash"), reduce(lambda a, b: a & b, same), "left")
            .withColumn(name, F.coalesce(name, "_entering"))
            .drop("_entering", "_into", *[f"_of_{key}" for key in keys])
        )
    if initial is not None:
        carried = carried.where(~F.col("_given")).drop("_given")
    return carried.drop("_range", "_value")


def _entering(ranged: DataFrame, keys: Sequence[str], seq: str, backward: bool) -> DataFrame:
    """What each range of a hot key gets from the ranges on its far side."""
    nearest = F.min_by if backward else F.max_by
    known = F.when(F.col("_value").isNotNull(), F.col(seq))
    summary = (
        ranged.where(F.col("_range").isNotNull())
        .groupBy(*keys, "_range")
        .agg(nearest("_value", known).alias("_value"))
    )
    range_order = F.col("_range").desc() if backward else F.col("_range").asc()
    over_ranges = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(range_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return summary.select(
        *[F.col(key).alias(f"_of_{key}") for key in keys],
        F.col("_range").alias("_into"),
        F.last("_value", ignorenulls=True).over(over_ranges).alias("_entering"),
    )
