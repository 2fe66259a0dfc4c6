"""Tables in the shared folder of spark.checkpoint.dir, which cut lineage and outlive lost executors; rows dealt over all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a task's input: no task is given less than the first where few tasks do, or much more than the second.
LEAST, MOST = 2 << 10, 8 << 20
#: Tasks a core, and at most that many where a plan's size is only guessed.
WAVES, MOST_WAVES = 4, 64


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores, for work that takes long on few bytes.

    A file has as many tasks as row groups, which may be one whatever the cores. Nothing is dropped, and results do not
    depend on where a row goes.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(WAVES * cores, size // LEAST), min(MOST_WAVES * cores, size // MOST)))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local master may do without and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cloakspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back; the folder goes when the application ends."""
    uri = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(uri)
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(uri)
