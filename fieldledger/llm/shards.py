"""Shards of nearly equal size that keep equal texts together, by minimax contiguous partition.

Equal texts are one unit that no shard boundary may cut. Units are ordered by a 64-bit hash of the
text; texts that share a hash move together. A unit above the mean size of a shard comes first in
that order and has a shard of its own. For the others the smallest capacity is searched with
which a greedy walk over the units gets by with the shards that are left.

The driver never sees the units. It holds runs of neighbouring units with their sizes, at most
`runs` per round. A walk that may cut every run of several units where it likes bounds the
capacity from below, one that may cut none of them bounds it from above. Runs that any cut could
still fall into are split by another pass over the units, each time into hundreds of parts, until
all cuts fall between known units; then both walks agree, and the capacity is exact. Every cut is
put next to an even share of what is left, as far as that capacity allows, so that the last shards
are not left short.

Slots count rows of a shard in the order of tasks: only the number of rows of each task and shard
is summed up, so a hot group costs no task more than its share.

Defined results: null texts are empty and form a unit with empty texts; repeated rows are placed one
by one in one shard; ties in a shard go by the order in which a task writes its rows; a text of any
length is one unit and never cut; with fewer units than shards some shards stay empty; an empty table
has no shards; columns called `shard` and `slot` are replaced, all others are kept.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.llm.common import free_name, map_batches, staged, table, whole_text

SHARDS = 40
ROW_BYTES = 16
RUNS = 1 << 16
# Rows of one task, as `monotonically_increasing_id` numbers them.
TASK_BITS = 33
SIGN = 1 << 63
PARTS = "first decimal(20, 0), last decimal(20, 0), bytes long, units long, run long, part decimal(20, 0)"
PARTS_ARROW = pa.schema(
    [
        ("first", pa.decimal128(20, 0)),
        ("last", pa.decimal128(20, 0)),
        ("bytes", pa.int64()),
        ("units", pa.int64()),
        ("run", pa.int64()),
        ("part", pa.decimal128(20, 0)),
    ]
)


@dataclass(frozen=True)
class Run:
    """Neighbouring units: the smallest and largest hash as unsigned numbers, and their size."""

    first: int
    last: int
    bytes: int
    units: int


EVERYTHING = Run(0, 2 * SIGN - 1, 0, 2)


@dataclass(frozen=True)
class Placement:
    """Units with a shard of their own, and the first hash of every shard behind them but the first."""

    giants: tuple[int, ...]
    cuts: tuple[int, ...]
    capacity: int


def split_runs(units: DataFrame, runs: list[Run], parts: int) -> list[Run]:
    """The units of the runs again, each run in up to `parts` runs of equal width."""
    lows = np.array([r.first for r in runs], np.uint64)
    highs = np.array([r.last for r in runs], np.uint64)
    steps = np.array([(r.last - r.first) // parts + 1 for r in runs], np.uint64)

    def work(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        unit = batch.column("unit").to_numpy().view(np.uint64) ^ np.uint64(SIGN)
        size = batch.column("bytes").to_numpy()
        run = np.searchsorted(lows, unit, "right") - 1
        inside = (run >= 0) & (unit <= highs[run])
        unit, size, run = unit[inside], size[inside], run[inside]
        part = (unit - lows[run]) // steps[run]
        order = np.lexsort((unit, run))
        unit, size, run, part = unit[order], size[order], run[order], part[order]
        new = np.append(True, (run[1:] != run[:-1]) | (part[1:] != part[:-1]))
        starts = np.flatnonzero(new) if len(unit) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(unit)))
        total = np.add.reduceat(size, starts) if len(starts) else size[:0]
        columns = [unit[starts], unit[starts + counts - 1], total, counts, run[starts], part[starts]]
        return [
            pa.record_batch(
                [pa.array(c).cast(t.type) for c, t in zip(columns, PARTS_ARROW, strict=True)],
                schema=PARTS_ARROW,
            )
        ]

    found = (
        map_batches(units, work, PARTS)
        .groupBy("run", "part")
        .agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.sum("bytes").alias("bytes"),
            F.sum("units").alias("units"),
        )
    )
    # Bounded: at most `parts` rows for each of the runs, together about RUNS.
    rows = found.collect()
    return sorted((Run(int(r.first), int(r.last), r.bytes, r.units) for r in rows), key=lambda r: r.first)


class Walks:
    """Greedy walks over runs. A position is the size of all units in front of it."""

    def __init__(self, runs: list[Run], shards: int) -> None:
        self.runs, self.shards = runs, shards
        self.ends = [0, *accumulate(r.bytes for r in runs)]
        self.total = self.ends[-1]

    def run_at(self, position: int) -> int | None:
        """The run of several units that the position lies within."""
        at = bisect_right(self.ends, position) - 1
        inside = at < len(self.runs) and self.ends[at] < position
        return at if inside and self.runs[at].units > 1 else None

    def down(self, position: int, cuttable: bool) -> int:
        at = bisect_right(self.ends, position) - 1
        free = cuttable and at < len(self.runs) and self.runs[at].units > 1
        return position if free else self.ends[at]

    def up(self, position: int, cuttable: bool) -> int:
        at = bisect_left(self.ends, position)
        free = cuttable and at > 0 and self.runs[at - 1].units > 1
        return position if free else self.ends[at]

    def forward(self, capacity: int, cuttable: bool) -> list[int]:
        """How far the first, the first two and more shards reach."""
        reach = [0]
        for _ in range(self.shards):
            reach.append(self.down(min(self.total, reach[-1] + capacity), cuttable))
        return reach[1:]

    def backward(self, capacity: int, cuttable: bool) -> list[int]:
        """Where the second and further shards begin at the earliest."""
        begin = [self.total]
        for _ in range(self.shards - 1):
            begin.append(self.up(max(0, begin[-1] - capacity), cuttable))
        return begin[:0:-1]

    def least_capacity(self, cuttable: bool) -> int:
        """The smallest capacity with which the walk reaches the end."""
        low, high = -(-self.total // self.shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.forward(middle, cuttable)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def even_cuts(self, capacity: int) -> tuple[list[int], list[int]]:
        """Cuts next to even shares of what is left, and the shares' ends, within the capacity."""
        cuts, shares, start = [], [], 0
        for left, earliest in zip(range(self.shards, 1, -1), self.backward(capacity, False), strict=True):
            share = start + (self.total - start) // left
            below, above = self.down(share, False), self.up(share, False)
            near = below if share - below <= above - share else above
            latest = self.down(min(self.total, start + capacity), False)
            start = max(min(near, latest), earliest, start)
            cuts.append(start)
            shares.append(share)
        return cuts, shares

    def open_runs(self) -> list[int]:
        """Runs of several units that a cut may still fall into."""
        least, most = self.least_capacity(True), self.least_capacity(False)
        ranges = list(zip(self.forward(least, False), self.forward(most, True), strict=True))
        ranges += zip(self.backward(most, True), self.backward(least, False), strict=True)
        ranges += [(share, share) for share in self.even_cuts(most)[1]]
        found: set[int] = set()
        for low, high in ranges:
            found.update(range(bisect_right(self.ends, low) - 1, bisect_left(self.ends, high)))
        return sorted(i for i in found if self.runs[i].units > 1)


def partition(split: Callable[[list[Run], int], list[Run]], shards: int, most_runs: int = RUNS) -> tuple:
    """Exact minimax cuts of ordered units that are only seen in runs; the capacity with them.

    `split` returns the units of given runs in smaller runs.
    """
    runs = split([EVERYTHING], most_runs)
    while True:
        walks = Walks(runs, shards)
        several = [i for i, r in enumerate(runs) if r.units > 1]
        wanted = walks.open_runs()
        if wanted and 2 * len(several) <= most_runs:
            wanted = several
        if not wanted:
            break
        finer = split([runs[i] for i in wanted], max(2, most_runs // len(wanted)))
        gone = set(wanted)
        runs = sorted([r for i, r in enumerate(runs) if i not in gone] + finer, key=lambda r: r.first)
    capacity = walks.least_capacity(False)
    firsts = [r.first for r in runs] + [2 * SIGN]
    cuts = [firsts[bisect_left(walks.ends, cut)] for cut in walks.even_cuts(capacity)[0]]
    return cuts, capacity


def find_placement(units: DataFrame, shards: int, most_runs: int = RUNS) -> Placement:
    """Where shards of units (`unit`, a signed hash, and `bytes`) begin."""
    total = units.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0
    left, giants, largest = shards, [], 0
    # Bounded by the number of shards.
    for row in units.orderBy(F.desc("bytes"), "unit").limit(shards).collect():
        if row.bytes * left <= total:
            break
        giants.append(row.unit)
        total, left, largest = total - row.bytes, left - 1, max(row.bytes, largest)
    if not total:
        return Placement(tuple(giants), (), largest)
    rest = units.where(~F.col("unit").isin(giants)) if giants else units
    cuts, capacity = partition(lambda runs, parts: split_runs(rest, runs, parts), left, most_runs)
    return Placement(tuple(giants), tuple(cuts), max(capacity, largest))


def shard_of(unit: Column, placement: Placement) -> Column:
    passed = [(unit >= cut - SIGN).cast("int") for cut in placement.cuts if cut < 2 * SIGN]
    number = reduce(Column.__add__, passed, F.lit(len(placement.giants)))
    for place, giant in enumerate(placement.giants):
        number = F.when(unit == giant, place).otherwise(number)
    return number


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `slot`, the number of a row in its `shard`; written once, so numbers do not change."""
    at, task, first, before = (free_name(rows, n) for n in ("_at", "_task", "_first", "_before"))
    numbered = rows.sortWithinPartitions("shard", *order).withColumn(at, F.monotonically_increasing_id())
    placed = staged(numbered, "shard-rows").withColumn(task, F.shiftright(at, TASK_BITS))
    sizes = placed.groupBy(task, "shard").agg(F.min(at).alias(first), F.count("*").alias("n"))
    # One row for each task and shard.
    tasks = Window.partitionBy("shard").orderBy(task)
    ahead = sizes.withColumn(before, F.sum("n").over(tasks) - F.col("n")).drop("n")
    slot = (F.col(before) + F.col(at) - F.col(first)).alias("slot")
    return placed.join(ahead, [task, "shard"]).select(*rows.columns, slot)


def sharded(
    rows: DataFrame, unit: str, size: str, shards: int = SHARDS, most_runs: int = RUNS
) -> DataFrame:
    """The rows with `shard` and `slot`; rows of equal `unit`, a 64-bit hash, share a shard."""
    own = rows.select(*(c for c in rows.columns if c.lower() not in ("shard", "slot")))
    sized = own.select(F.col(unit).alias("unit"), F.col(size).cast("long").alias("bytes"))
    units = staged(sized.groupBy("unit").agg(F.sum("bytes").alias("bytes")), "shard-units")
    placement = find_placement(units, shards, most_runs)
    return with_slots(own.withColumn("shard", shard_of(F.col(unit), placement)), [unit])


def sized_texts(docs: DataFrame, unit: str, size: str, text: str = "text") -> DataFrame:
    """Documents with the hash that keeps equal texts together and the bytes that a shard counts."""
    whole = whole_text(text)
    bytes_of = (F.octet_length(whole) + ROW_BYTES).cast("long")
    return docs.withColumns({unit: F.xxhash64(whole), size: bytes_of})


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the documents with their `slot`, a folder per shard."""
    unit, size = free_name(docs, "_unit"), free_name(docs, "_size")
    placed = sharded(sized_texts(docs, unit, size), unit, size, shards)
    placed.drop(unit, size).write.partitionBy("shard").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = sized_texts(docs, "unit", "size").withColumn("text_crc32", F.crc32(whole_text().cast("binary")))
    placed = sharded(staged(whole.drop("text"), "shard-texts"), "unit", "size")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
