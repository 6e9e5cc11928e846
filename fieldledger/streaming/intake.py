"""Streams of mutations that become batches of a ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldledger.schemas import MUTATIONS
from fieldledger.sources.ledger import Ledger
from fieldledger.sources.staging import gapless

def read_mutations(spark: SparkSession, path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """Mutations in new Parquet files as they appear; `seq` orders those that come together."""
    reader = spark.readStream.schema(MUTATIONS).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ingest(
    mutations: DataFrame,
    ledger: Ledger,
    name: str,
    cursor_path: str,
    *,
    order: Sequence[str] = ("seq",),
    continuous: bool = False,
    **options,
) -> StreamingQuery:
    """Commits every micro-batch of a stream; `cursor_path` remembers what has been taken.

    A micro-batch is the batch `<name>-<epoch>`. One that is run again after a failure has its old
    name and rows, so it is committed once, and its rows get the next free numbers in `order`.
    Several streams and other writers may commit to one ledger side by side.
    """

    def commit(rows: DataFrame, epoch: int) -> None:
        batch = f"{name}-{epoch:010d}"
        if not ledger.is_committed(batch):
            ledger.commit(batch, gapless(rows, order), assign_seq=True, **options)

    writer = mutations.writeStream.foreachBatch(commit).option("checkpointLocation", cursor_path)
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start()
