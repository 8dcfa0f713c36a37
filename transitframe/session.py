"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("transitframe")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables, reachable by every executor."""
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy.

    Used where a plan must not be evaluated twice with different outcomes (range-partition
    bounds) or would grow with each loop round. Survives the loss of executors.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def once_per_value(df: DataFrame, column: str, derived: dict[str, Column]) -> DataFrame:
    """(``column``, ``derived``...): costly expressions of one column, computed once per distinct value and in all tasks.

    Small tables are read by few tasks, and a filter on a derived column would otherwise be evaluated before the distinct.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = cut_lineage(df.select(column).distinct().repartition(parts, column))
    return cut_lineage(values.withColumns(derived))


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a new shared folder and continue from it: compressed, read by column and of measured size,
    but in no order and in other partitions."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
