"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Nothing here is required by the operators; a cluster keeps its own values.
LOCAL_SETTINGS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.driver.memory": "8g",
}

# A scan of at most this many splits is small enough to shuffle for more tasks.
FEW_SPLITS = 4

_local_folders: dict[str, str] = {}


def local_session(cores: int | str = "*", app_name: str = "fieldledger") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    for name, value in LOCAL_SETTINGS.items():
        builder = builder.config(name, value)
    partitions = "8" if cores == "*" else str(cores)
    return builder.config("spark.sql.shuffle.partitions", partitions).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A temporary folder is used only in local mode with the setting unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="fieldledger-")
    return _local_folders[context.applicationId]


def new_scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/fieldledger/{purpose}-{uuid.uuid4().hex}"


def spread_small(rows: DataFrame) -> DataFrame:
    """Shares a scan of a few splits among the cores, for costly work per row.

    A table of more splits has tasks enough and stays where it lies.
    """
    splits = rows.rdd.getNumPartitions()
    cores = min(rows.sparkSession.sparkContext.defaultParallelism, 64)
    return rows.repartition(cores) if splits <= FEW_SPLITS and splits < cores else rows
