"""Shared plumbing of the training-data operators: tables in the shared folder and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z on UTF-8 bytes; no other character is touched.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, removed when the JVM ends.

    Only a local master may do without the setting (tests); it then gets a temporary folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='cloakspark-')}"
        _own[app] = f"{base.rstrip('/')}/cloakspark-{app}"
        path, fs = _fs(spark, _own[app])
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _own[app]


def _fs(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def write_table(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cloak_path = path
    return out


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of ``write_table`` that no later plan reads."""
    path, fs = _fs(spark, df._cloak_path)
    fs.delete(path, True)


def connected_components(spark: SparkSession, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) for every node but the roots; component is the least node that links reach.

    Alternates large-star and small-star steps, so the number of rounds grows with the logarithm of the
    components' diameter. Each round is two joins on the node against one row per node, whose hot side AQE splits,
    and is cut by a table in the shared folder. Nodes that no edge names are absent; nulls are ignored.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = write_table(spark, e, tag), None
    while True:
        stats = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if stats == seen or not stats[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
        large = e.join(least, e.v == least.hub).select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.select(F.col("u").alias("hub"), "m"), F.col("u") == F.col("hub")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = write_table(spark, small.union(low.select("u", F.col("m").alias("v"))).distinct(), tag)
        drop_table(spark, e)
        e, seen = new, stats


def keep_first(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with _cs_th) that are the least of their label in (doc_id, th, label); repeated rows once."""
    least = labels.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("k"))
    kept = least.select(F.col("k.doc_id").alias("_cs_id"), F.col("k.th").alias("_cs_kth"))
    on = docs.doc_id.cast("long").eqNullSafe(F.col("_cs_id")) & (docs["_cs_th"] == F.col("_cs_kth"))
    return docs.join(kept, on, "left_semi").dropDuplicates(["doc_id", "_cs_th"])


def spanning(labels, n: int, pairs) -> None:
    """Merge in place the classes of ``labels`` (numpy, one per node) that each (row, hits) of ``pairs`` joins."""
    import numpy as np

    for i, hits in pairs:
        roots = np.unique(labels[hits])
        own = labels[i]
        if len(roots) == 1 and roots[0] == own:
            continue
        roots = np.union1d(roots, own)
        labels[np.isin(labels[:n], roots).nonzero()[0]] = roots[0]
