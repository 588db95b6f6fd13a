"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch of records.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder is set on a local master (tests), and on a cluster nothing can be written: an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        path = sc.getCheckpointDir()
        if not path:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="tallyvine-")
            sc.setCheckpointDir(path)
    return path.rstrip("/")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches that Python workers get by rows and bytes: a worker then takes the same memory however large the tables are.

    The session's own settings are lowered, and stay so: the frames that need them are evaluated later, by the caller.
    """
    for key, most, default in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows, 10_000), ("spark.sql.execution.arrow.maxBytesPerBatch", size, 64 << 20)):
        have = spark.conf.get(key, None)
        have = default if have is None else int(have) if have.lstrip("-").isdigit() else 0
        if have <= 0 or have > most:
            spark.conf.set(key, str(most))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: iterations stay short, and a lost executor costs a reread."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tallyvine/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, rows: int = 2000) -> DataFrame:
    """df dealt by keys over tasks of about so many rows, up to four a core: a table of few row groups would leave the Python work after it to few tasks.

    The rows are counted; of a table that takes its files' footers.
    """
    spark = df.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(max(1, min(most, -(-df.count() // rows))), *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of joins that grows with the input: such joins are shuffled, and neither the planner nor adaptive execution sends it whole through the driver."""
    return df.hint("merge")
