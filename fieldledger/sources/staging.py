"""Intermediate results written once as tables, to cut a plan that would repeat them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.session import new_scratch

Stage = Callable[[DataFrame, str], DataFrame]


def unstaged(rows: DataFrame, name: str) -> DataFrame:
    """Leaves the rows as part of the plan."""
    return rows


def stage_in(folder: str) -> Stage:
    """Writes the rows below `folder`, which all executors share, and reads them back."""

    def stage(rows: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    return stage


def drop_staged(spark: SparkSession, folder: str) -> None:
    """Removes what `stage_in` wrote below a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)



_TASK_BITS = 33


def gapless(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Numbers the rows from 0 in the given order, as `seq`, without a gap.

    Rows are dealt by ranges of the order and written once; a row's number is its place within its
    task plus the rows of the tasks in front, of which there is one sum per task.
    """
    others = [name for name in rows.columns if name != "seq"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*others)
    stage = stage_in(new_scratch(rows.sparkSession, "intake"))
    placed = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "rows")
    placed = placed.withColumn("_task", F.shiftright("_at", _TASK_BITS))
    sizes = placed.groupBy("_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    ahead = F.sum("_rows").over(Window.partitionBy(F.lit(0)).orderBy("_task")) - F.col("_rows")
    tasks = F.broadcast(sizes.select("_task", "_first", ahead.alias("_ahead")))
    seq = F.col("_ahead") + F.col("_at") - F.col("_first")
    return placed.join(tasks, "_task").select(seq.alias("seq"), *others)
