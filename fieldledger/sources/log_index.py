"""A change log with an index of positions, so that cursors are found without reading the log.

Log files hold ascending ranges of `seq`, which their list tells. The index has a row per entry, its
`id`, its `seq` and the `next` one, in files by a hash of the id. A cursor opens the index files of
its own bucket and the one or two log files its answer lies in. A table of cursors meets
the index as a broadcast while it fits, and its answers meet the log by `seq`.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldledger.operators.feed import ENTRY, checked_cursor
from fieldledger.operators.joins import BROADCAST_BYTES, fits_broadcast, join_small
from fieldledger.schemas import CHANGE_LOG
from fieldledger.sources.commit_log import DataFile
from fieldledger.sources.data_files import (
    FILE_ROWS,
    bucket_column,
    bucket_of,
    files_in,
    read_files,
    write_files,
)

IDS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("next", T.LongType()),
    ]
)
# Positions up to this number choose the log files that are opened.
FEW = 10_000


def write_log_files(log: DataFrame, root: str, folder: str, *, level: int = 0) -> list[DataFile]:
    """Writes entries in files of ascending, disjoint ranges of `seq`."""
    spark = log.sparkSession
    names = [f.name for f in CHANGE_LOG]
    ranged = log.select(*names).repartitionByRange("seq").sortWithinPartitions("seq")
    ranged.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{root}/{folder}")
    found = files_in(spark, root, "log", f"{root}/{folder}", CHANGE_LOG, (), level)
    return sorted(found, key=lambda f: f.first)


def write_index(
    spark: SparkSession, root: str, logged: Sequence[DataFile], attempt: str, buckets: int
) -> list[DataFile]:
    """Indexes the entries of new log files, given in order; the last entry has no `next` yet."""
    if not logged:
        return []
    log = read_files(spark, root, "log", logged, CHANGE_LOG).withColumn("_file", F.col("_metadata.file_name"))
    followers = {a.path.rpartition("/")[2]: b.first for a, b in zip(logged, logged[1:], strict=False)}
    # One row per file of at most FILE_ROWS entries, which are also all that a window holds.
    later = spark.createDataFrame([*followers.items(), ("", None)], "_file string, _follower long")
    own = Window.partitionBy("_file").orderBy("seq")
    following = log.select("id", "seq", "_file", F.lead("seq").over(own).alias("_within"))
    rows = following.join(F.broadcast(later), "_file", "left").select(
        "id",
        "seq",
        F.coalesce("_within", "_follower").alias("next"),
        bucket_column(F.col("id"), buckets).alias("bucket"),
    )
    return write_files(rows, root, "ids", attempt, ["bucket"], ["id"])


@dataclass(frozen=True)
class IndexedLog:
    """A log by its files and those of its index.

    `ranges` are the first and last `seq` of the pieces that were indexed one by one; the last
    entry of a piece has no `next` in the index.
    """

    spark: SparkSession
    root: str
    log_files: tuple[DataFile, ...]
    id_files: tuple[DataFile, ...]
    buckets: int
    ranges: tuple[tuple[int, int], ...] = ()

    @classmethod
    def write(cls, log: DataFrame, root: str, *, buckets: int = 16) -> IndexedLog:
        """Stores a log that is not part of a ledger."""
        spark = log.sparkSession
        logged = write_log_files(log, root, "log")
        ids = write_index(spark, root, logged, "log", buckets)
        return cls(spark, root, tuple(logged), tuple(ids), buckets)

    def _log(self, files: Sequence[DataFile]) -> DataFrame:
        return read_files(self.spark, self.root, "log", files, CHANGE_LOG)

    def _ids(self, files: Sequence[DataFile]) -> DataFrame:
        return read_files(self.spark, self.root, "ids", files, IDS, ["bucket"])

    def entries(self) -> DataFrame:
        return self._log(self.log_files)

    def _sorted(self) -> list[DataFile]:
        return sorted((f for f in self.log_files if f.rows), key=lambda f: f.first)

    def _behind(self, position: int) -> list[DataFile]:
        """Log files with entries behind a position, in order."""
        files = self._sorted()
        return files[bisect_right([f.last for f in files], position) :]

    def position(self, cursor: str) -> int | None:
        """The `seq` of an entry: one bucket of the index, by a pushed-down filter."""
        bucket = bucket_of(checked_cursor(cursor), self.buckets)
        rows = self._ids([f for f in self.id_files if f.bucket == bucket])
        found = rows.where(F.col("id") == F.lit(cursor)).agg(F.min("seq")).first()
        return found[0]

    def first_entry(self) -> DataFrame:
        files = self._sorted()[:1]
        return self._log(files).orderBy("seq").limit(1)

    def drain(self, after: str | None = None) -> DataFrame:
        """All entries past the cursor; an unknown cursor gives none."""
        if after is None:
            return self.entries()
        position = self.position(after)
        if position is None:
            return self._log([])
        return self._log(self._behind(position)).where(F.col("seq") > position)

    def entry_after(self, cursor: str) -> DataFrame:
        """The entry right after the cursor; no row when it is unknown or the last."""
        position = self.position(cursor)
        near = [] if position is None else self._behind(position)[:1]
        rows = self._log(near).where(F.col("seq") > F.lit(position)) if near else self._log([])
        return rows.orderBy("seq").limit(1)

    def sync(self, last_id: str | None = None) -> DataFrame:
        return self.first_entry() if last_id is None else self.entry_after(last_id)

    def _followers(self) -> DataFrame:
        """The first `seq` behind each piece, one row per piece."""
        pairs = [(a[1], b[0]) for a, b in zip(self.ranges, self.ranges[1:], strict=False)]
        return self.spark.createDataFrame([*pairs, (None, None)], "seq long, _follower long")

    def next_entries(self, cursors: DataFrame, *, limit: int = BROADCAST_BYTES) -> DataFrame:
        """The next entry of each consumer; `cursors` has `consumer` and `cursor`.

        A null cursor gets the first entry; unknown and last cursors get nulls. Cursors are
        answered once each. While they fit a broadcast, neither index nor log is shuffled.
        """
        known = cursors.select(F.col("cursor").alias("id")).where(F.col("cursor").isNotNull()).distinct()
        fits = fits_broadcast(known, limit)
        known = known.withColumn("bucket", bucket_column(F.col("id"), self.buckets))
        asked = {row[0] for row in known.select("bucket").distinct().collect()}
        index = self._ids([f for f in self.id_files if f.bucket in asked])
        found = index.join(F.broadcast(known) if fits else known, ["bucket", "id"], "left_semi")
        found = found.join(F.broadcast(self._followers()), "seq", "left")
        following = found.select(F.col("id").alias("cursor"), F.coalesce("next", "_follower").alias("seq"))
        start = [(None, f.first) for f in self._sorted()[:1]]
        opening = self.spark.createDataFrame(start, "cursor string, seq long")
        answers = following.unionByName(opening).where(F.col("seq").isNotNull())
        files = list(self.log_files)
        if fits and (places := answers.select("seq").limit(FEW + 1).collect()) and len(places) <= FEW:
            files = self._holding({row[0] for row in places})
        entries = self._log(files).join(F.broadcast(answers) if fits else answers, "seq")
        consumers = cursors.select("consumer", "cursor", F.coalesce("cursor", F.lit("")).alias("_asked"))
        answered = join_small(
            consumers,
            entries.withColumn("_asked", F.coalesce("cursor", F.lit(""))).drop("cursor"),
            ["_asked"],
            "left",
            spread=F.col("consumer"),
            limit=limit,
        )
        return answered.select("consumer", "cursor", *ENTRY)

    def _holding(self, positions: set[int]) -> list[DataFile]:
        files = self._sorted()
        firsts = [f.first for f in files]
        return [files[i] for i in sorted({bisect_right(firsts, p) - 1 for p in positions})]
