"""Privacy and utility metrics: k-anonymity, distribution distances, text likeness, changed cells."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from math import log
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakspark.functions.expr import bucketed, let
from cloakspark.sources.scratch import stored

BINS, TINY, CUTS, ENCODED = 99, 1e-10, 64, 256


def k_anonymity(df: DataFrame, quasi: list[str]) -> DataFrame:
    """k: the least group size over the quasi-identifiers present; rows with a null in them do not count. Null if none are."""
    present = [c for c in quasi if c in df.columns]
    if not present:
        return df.sparkSession.sql("SELECT CAST(NULL AS BIGINT) AS k")
    return df.dropna(subset=present).groupBy(*present).count().agg(F.min("count").alias("k"))


def ks(df: DataFrame, a: str, b: str) -> DataFrame:
    """statistic, utility: the two-sample Kolmogorov-Smirnov distance of two columns, each with its own nulls left out.

    Values are pre-aggregated, cut into ranges at approximate quantiles, summed up within ranges, and joined with the
    sums of the ranges before, so no task holds all values.
    """
    both = df.select(F.explode(F.array(F.struct(F.col(a).cast("double").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col(b).cast("double").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("s"))
    return ks_of(both.select("s.v", "s.x", "s.y"))


def ks_of(both: DataFrame) -> DataFrame:
    """As ``ks``, from rows (v, x, y) with x = 1 for the first and y = 1 for the second."""
    both = both.where("v IS NOT NULL")
    n = max(CUTS, int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = both.agg(F.percentile_approx("v", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    counts = both.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).withColumn("r", bucketed(F.col("v"), sorted(set(cuts))))
    w = Window.partitionBy("r").orderBy("v")
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = counts.groupBy("r").agg(F.sum("x").alias("rx"), F.sum("y").alias("ry"))
    sums = sums.select("r", F.coalesce(F.sum("rx").over(before), F.lit(0)).alias("bx"), F.coalesce(F.sum("ry").over(before), F.lit(0)).alias("by"), F.sum("rx").over(Window.partitionBy()).alias("nx"), F.sum("ry").over(Window.partitionBy()).alias("ny"))
    run = counts.select("r", F.sum("x").over(w).alias("cx"), F.sum("y").over(w).alias("cy")).join(F.broadcast(sums), "r")  # a row a range
    gap = F.abs((F.col("cx") + F.col("bx")) / F.col("nx") - (F.col("cy") + F.col("by")) / F.col("ny"))
    return run.agg(F.max(F.when((F.col("nx") > 0) & (F.col("ny") > 0), gap)).alias("statistic")).withColumn("utility", F.greatest(F.lit(0.0), 1 - F.col("statistic")))


def divergences(both: DataFrame) -> DataFrame:
    """kl, js of rows (v, x, y): histograms of 99 equal bins, smoothed by a tiny density, in natural logarithms.

    Constant or missing data give 0. What leaves the executors is one row a bin.
    """
    both = both.where("v IS NOT NULL")
    lo, hi = both.agg(F.min("v"), F.max("v")).first()
    if lo is None or lo == hi:
        return both.sparkSession.sql("SELECT 0.0D AS kl, 0.0D AS js")
    width = (hi - lo) / BINS
    bins = both.select(F.least(F.floor((F.col("v") - lo) / width), F.lit(BINS - 1)).cast("int").alias("b"), "x", "y").groupBy("b").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    every = both.sparkSession.range(BINS).select(F.col("id").cast("int").alias("b")).join(F.broadcast(bins), "b", "left")  # BINS rows
    part = lambda c: F.coalesce(F.col(c), F.lit(0))
    dense = every.select(*[(part(c) / (F.sum(part(c)).over(Window.partitionBy()) * width) + TINY).alias(c) for c in ("x", "y")])
    p = dense.select(*[(F.col(c) / F.sum(c).over(Window.partitionBy())).alias(c) for c in ("x", "y")]).withColumn("m", (F.col("x") + F.col("y")) / 2)
    d = lambda a, b: F.sum(F.col(a) * F.log(F.col(a) / F.col(b)))
    return p.agg(d("x", "y").alias("kl"), ((d("x", "m") + d("y", "m")) / 2).alias("js"))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two texts' sets of lower-cased words; two empty ones are alike."""
    return let(F.struct(token_set(a).alias("a"), token_set(b).alias("b")), lambda s: let(F.size(F.array_union(s["a"], s["b"])), lambda n: F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(s["a"], s["b"])) / n)))


def cosine(a: Column, b: Column) -> Column:
    """Of two numeric arrays; null where a norm is zero or a part is missing."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def changed_columns(raw: DataFrame, masked: DataFrame, key: str) -> DataFrame:
    """column, total, changed, effectiveness: cells that differ as strings, joined by key and counted in one pass."""
    columns = [c for c in raw.columns if c in masked.columns and c != key]
    a = raw.select(F.col(f"`{key}`"), *[F.col(f"`{c}`").cast("string").alias(f"a{i}") for i, c in enumerate(columns)])
    b = masked.select(F.col(f"`{key}`"), *[F.col(f"`{c}`").cast("string").alias(f"b{i}") for i, c in enumerate(columns)])
    one = a.join(b, key).agg(F.count("*").alias("n"), *[F.count_if(~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))).alias(f"c{i}") for i in range(len(columns))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("changed")) for i, c in enumerate(columns)])).alias("s")
    out = one.select("n", rows).select("s.column", F.col("n").alias("total"), "s.changed")
    return out.withColumn("effectiveness", F.round(100.0 * F.col("changed") / F.nullif("total", F.lit(0)), 2))


def quasi_rows(raw: DataFrame, masked: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column, total, changed of quasi-identifiers present in both."""
    present = [c for c in columns if c in raw.columns and c in masked.columns]
    return changed_columns(raw.select(key, *present), masked.select(key, *present), key) if present else changed_columns(raw.select(key, key), masked.select(key, key), key).limit(0)


def same_shape(raw: DataFrame, masked: DataFrame) -> bool:
    return len(raw.columns) == len(masked.columns) and raw.count() == masked.count()


def kernel_density(df: DataFrame, column: str, points: int = 50, bins: int = 2000) -> DataFrame:
    """point, density of a Gaussian kernel with Scott's bandwidth, from counts in ``bins`` fine bins (bounded)."""
    v = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    n, lo, hi, sd = v.agg(F.count("*"), F.min("v"), F.max("v"), F.stddev("v")).first()
    if not n or not sd:
        return df.sparkSession.createDataFrame([], "point double, density double")
    width, band = (hi - lo) / bins, sd * n ** -0.2
    counts = v.groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).alias("b")).count().select((lo + (F.col("b") + 0.5) * width).alias("at"), "count")
    grid = F.explode(F.array(*[F.lit(lo + (hi - lo) * i / (points - 1)) for i in range(points)])).alias("point")
    one = F.exp(-0.5 * F.pow((F.col("point") - F.col("at")) / band, 2)) * F.col("count")
    return counts.select("at", "count", grid).groupBy("point").agg((F.sum(one) / (n * band * (2 * 3.141592653589793) ** 0.5)).alias("density"))


class Encoder(Protocol):
    """Made once per task by a factory; gives a vector for each text."""

    def __call__(self, texts: list[str]) -> Sequence[Sequence[float]]: ...


class HashingEncoder:
    """The default where no model is installed: counts of words and of letter triples by hash, in SIZE places."""

    SIZE = 512

    def __call__(self, texts: list[str]):
        out = np.zeros((len(texts), self.SIZE))
        for row, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                for x in (w, *(w[i : i + 3] for i in range(len(w) - 2))):
                    row[zlib.crc32(x.encode()) % self.SIZE] += 1
        return out


def encoded_likeness(pairs: DataFrame, a: str, b: str, factory: Callable[[], Encoder] = HashingEncoder) -> DataFrame:
    """``pairs`` with ``likeness``: the cosine of the vectors that an encoder gives two text columns, in batches of ENCODED.

    A null text counts as empty; where a vector is zero the likeness is null.
    """
    at = [pairs.columns.index(c) for c in (a, b)]
    names = [*pairs.columns, "likeness"]

    def of(batches):
        encode = factory()
        for batch in (whole.slice(k, ENCODED) for whole in batches for k in range(0, whole.num_rows, ENCODED)):
            x, y = (np.asarray(encode([t or "" for t in batch.column(i).to_pylist()]), float) for i in at)
            size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
            cosine = (x * y).sum(1) / np.where(size > 0, size, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cosine, mask=size == 0)], names=names)

    return pairs.mapInArrow(of, T.StructType([*pairs.schema.fields, T.StructField("likeness", T.DoubleType())]))


def report(raw: DataFrame, masked: DataFrame, key: str, quasi: tuple[str, ...] = ("Age", "Pincode"), encoder: Callable[[], Encoder] | None = None) -> dict:
    """All metrics of a masked table against its raw one, row by row on ``key``; one dictionary, a few jobs a column.

    The tables are joined once and the join is kept in the shared folder. ``encoder``: a factory; with it texts are also
    compared by the cosine of their vectors.
    """
    kinds = {f.name: f.dataType for f in raw.schema}
    new = {f.name: f.dataType for f in masked.schema}
    changed = [r.asDict() for r in changed_columns(raw, masked, key).orderBy("column").collect()]
    out: dict = {"same_shape": same_shape(raw, masked), "columns": changed, "numeric": [], "text": []}
    both = [c for c in kinds if c != key and c in new]
    pairs = stored(raw.sparkSession, raw.select(key, *[F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(both)]).join(masked.select(key, *[F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(both)]), key), "report")
    for i, c in enumerate(both):
        x, y = F.col(f"a{i}"), F.col(f"b{i}")
        if isinstance(kinds[c], T.NumericType) and isinstance(new[c], T.NumericType):
            v = pairs.select(F.explode(F.array(F.struct(x.cast("double").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(y.cast("double").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("s")).select("s.*")
            found = divergences(v).first().asDict()
            out["numeric"].append({"column": c, **ks_of(v).first().asDict(), **found, "js_share": found["js"] / log(2)})
        elif isinstance(kinds[c], T.StringType):
            texts = pairs.select(F.coalesce(x, F.lit("")).alias("a"), F.coalesce(y.cast("string"), F.lit("")).alias("b"))
            out["text"].append({"column": c, "jaccard": texts.agg(F.avg(jaccard(F.col("a"), F.col("b")))).first()[0]})
            if encoder:
                out["text"][-1]["cosine"] = encoded_likeness(texts, "a", "b", encoder).agg(F.avg("likeness")).first()[0]
    out["k_anonymity"] = {"raw": k_anonymity(raw, list(quasi)).first()["k"], "masked": k_anonymity(masked, list(quasi)).first()["k"]}
    strings = [r for r in changed if isinstance(kinds[r["column"]], T.StringType) and r["changed"]]
    cells = sum(r["total"] for r in strings)
    out["privacy"] = sum(r["changed"] for r in strings) / cells if cells else None
    usable = [r["utility"] for r in out["numeric"] if r["utility"] is not None]
    out["utility"] = sum(usable) / len(usable) if usable else None
    return out
