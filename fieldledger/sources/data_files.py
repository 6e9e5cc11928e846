"""Tables of immutable files in hash buckets, read by the paths that commits name."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Mapping, Sequence
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldledger.functions.codecs import sha256_hex
from fieldledger.sources.commit_log import DataFile

# Records without a template.
NO_PART = "none"
FILE_ROWS = 1 << 20
LAYOUT = {
    "accepted": T.BooleanType(),
    "store": T.StringType(),
    "part": T.StringType(),
    "bucket": T.IntegerType(),
}


def part_column(template: Column) -> Column:
    """The folder of a template: a hash, as names may be empty, long or odd."""
    return F.coalesce(F.substring(sha256_hex(template), 1, 16), F.lit(NO_PART))


def part_of(template: str | None) -> str:
    return NO_PART if template is None else sha256(template.encode()).hexdigest()[:16]


def bucket_column(key: Column, buckets: int) -> Column:
    return (F.crc32(F.coalesce(key, F.lit("")).cast("binary")) % buckets).cast("int")


def bucket_of(key: str, buckets: int) -> int:
    return zlib.crc32(key.encode()) % buckets


def write_files(
    rows: DataFrame,
    root: str,
    table: str,
    attempt: str,
    groups: Sequence[str],
    order: Sequence[str],
    *,
    level: int = 0,
    together: Sequence[str] = (),
    options: Mapping[str, object] | None = None,
) -> list[DataFile]:
    """Writes the rows of an attempt, a folder per group, and tells its files.

    Rows of a group are brought together, and large groups shared among tasks, before they are
    written, so that small batches make one file for each group they touch. Files are in `order`, so
    a filter on its first column reads few row groups. `together` tells the rows of a large group
    that should share a file. Columns that begin with `_` count for the order and are not written.
    """
    folder = f"{root}/{table}/attempt={attempt}"
    ordered = rows.hint("rebalance", *groups, *together).sortWithinPartitions(*groups, *order)
    ordered = ordered.drop(*[c for c in rows.columns if c.startswith("_")])
    writer = ordered.write.partitionBy(*groups).option("maxRecordsPerFile", FILE_ROWS)
    writer.options(**(options or {})).parquet(folder)
    return files_in(rows.sparkSession, root, table, folder, ordered.schema, groups, level)


def files_in(
    spark: SparkSession,
    root: str,
    table: str,
    folder: str,
    schema: T.StructType,
    groups: Sequence[str],
    level: int = 0,
) -> list[DataFile]:
    """The files that were just written, with their rows and ranges of `seq`."""
    written = spark.read.schema(schema).parquet(folder)
    name = F.col("_metadata.file_name").alias("_name")
    told = written.select(name, *groups, "seq").groupBy("_name", *groups)
    found = told.agg(F.count("*").alias("_rows"), F.min("seq").alias("_first"), F.max("seq").alias("_last"))
    base = folder.removeprefix(f"{root}/")
    files = []
    # One row per file.
    for row in found.collect():
        values = {group: row[group] for group in groups}
        inner = "".join(f"{k}={str(v).lower() if isinstance(v, bool) else v}/" for k, v in values.items())
        path = f"{base}/{inner}{row['_name']}"
        files.append(
            DataFile(table, path, row["_rows"], row["_first"], row["_last"], level=level, **values)
        )
    return sorted(files, key=lambda f: f.path)


def read_files(
    spark: SparkSession,
    root: str,
    table: str,
    files: Iterable[DataFile],
    schema: T.StructType,
    groups: Sequence[str] = (),
) -> DataFrame:
    """The rows of the named files alone; their groups come from the layout."""
    layout = T.StructType([T.StructField(g, LAYOUT[g]) for g in groups])
    whole = T.StructType([*schema.fields, *layout.fields])
    paths = [f"{root}/{f.path}" for f in files]
    if not paths:
        return spark.createDataFrame([], whole)
    reader = spark.read.schema(whole)
    if groups:
        reader = reader.option("basePath", f"{root}/{table}")
    return reader.parquet(*paths).select(*whole.names)
