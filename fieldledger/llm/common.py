"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.session import new_scratch

# Characters that separate words, as a Java and Python pattern.
WHITE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once to the folder that all executors share, and read back.

    Cuts a plan that would repeat costly work. The files outlive lost executors.
    """
    path = new_scratch(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more, as all that came of them is written."""
    for rows in tables:
        context = rows.sparkSession.sparkContext
        folders = {file.rpartition("/")[0] for file in rows.inputFiles()}
        for folder in folders:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI.create(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def free_name(rows: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the rows has it."""
    while name.lower() in (column.lower() for column in rows.columns):
        name += "_"
    return name


def whole_text(text: str | Column = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def on_workers(rows: DataFrame) -> DataFrame:
    """Lets Python workers import this package from a checkout that is not installed."""
    root = str(Path(__file__).resolve().parents[2])
    rows.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", root)
    return rows


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together and in a row, over all tasks that the session allows.

    The number is given, as Python work costs more than the bytes by which tasks are merged.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys)


def map_batches(
    rows: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """`work` on every Arrow batch; it returns any number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return on_workers(rows).mapInArrow(run, schema)


def blocks_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Runs of rows with equal keys, which may reach over several batches."""
    held: dict[str, list] = {}
    last = None
    for batch in batches:
        columns = batch.to_pydict()
        marks = list(zip(*(columns[key] for key in keys), strict=True))
        start = 0
        for end in range(1, len(marks) + 1):
            if end < len(marks) and marks[end] == marks[start]:
                continue
            if held and marks[start] != last:
                yield held
                held = {}
            for name, values in columns.items():
                held.setdefault(name, []).extend(values[start:end])
            last, start = marks[start], end
    if held:
        yield held


def whole_groups(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the rows of equal keys, which lie in a row, are never apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, dtype=bool)
        for key in keys:
            column = np.asarray(batch.column(key))
            changed |= column[1:] != column[:-1]
        changes = np.flatnonzero(changed)
        if held and any(held[-1].column(key)[-1] != batch.column(key)[0] for key in keys):
            yield pa.concat_batches(held)
            held = []
        if len(changes):
            cut = int(changes[-1]) + 1
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.concat_batches(held)
