"""Column profiles from content, and the decision how each column is treated."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakspark.functions import names, spans
from cloakspark.functions.patterns import ID_LIKE, NOISY, Config

#: Above this estimate a column is not counted exactly; far above any threshold on cardinality.
EXACT_BELOW = 200


def melt(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, value) of all cells as strings, one row a cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.col(f"`{key}`").alias("key"), F.explode(cells).alias("c")).select("key", "c.column", "c.value")


def sample(df: DataFrame, key: str, columns: list[str], size: int) -> DataFrame:
    """(column, key, value): the first ``size`` non-null cells of each column by ``key``.

    The rank filter is applied before the shuffle too, so a task sends ``size`` rows a column at most.
    """
    w = Window.partitionBy("column").orderBy("key", "value")
    return melt(df, key, columns).where("value IS NOT NULL").withColumn("r", F.row_number().over(w)).where(F.col("r") <= size).drop("r")


def cardinality(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """column -> (non-null cells, distinct values). Exact up to EXACT_BELOW; beyond that an estimate, which no rule tells apart."""
    if not columns:
        return {}
    one = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)], *[F.approx_count_distinct(f"`{c}`", 0.03).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    out = {c: (one[f"n{i}"], one[f"d{i}"]) for i, c in enumerate(columns)}
    few = [c for c in columns if out[c][1] <= EXACT_BELOW]
    if few:
        exact = df.agg(*[F.size(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(f"d{i}") for i, c in enumerate(few)]).first()
        out |= {c: (out[c][0], exact[f"d{i}"]) for i, c in enumerate(few)}
    return out


def features(df: DataFrame, key: str, config: Config, columns: list[str]) -> DataFrame:
    """column, n, average_length, density, kinds, name_share of each column's sample."""
    cells = sample(df, key, columns, config.sample)
    found = spans.raw_spans(F.col("value"), config.effective(), "auto", context=True)
    stamp = F.col("value").contains("T") | F.col("value").contains(":")
    iso = [i for i, p in enumerate(config.effective()) if p.name == "DATE_OF_BIRTH_ISO"]
    credible = F.filter(found, lambda s: ~(stamp & s["ord"].isin(*(iso or [-1]))))
    cells = cells.withColumn("kinds", F.array_distinct(F.transform(credible, lambda s: spans.attribute(s["ord"], config.effective(), "name"))))
    known = F.coalesce(names.is_known(names.first_token(F.col("value"))), F.lit(False))
    return cells.groupBy("column").agg(
        F.count("*").alias("n"), F.avg(F.length("value")).alias("average_length"), F.avg((F.size("kinds") > 0).cast("double")).alias("density"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"), F.avg(known.cast("double")).alias("name_share"),
    )


def hinted(column: str, config: Config, kinds: tuple[str, ...] = ("skip", "identity", "free_text", "numeric")) -> str | None:
    """The first kind whose hints hold the column's name in any case."""
    return next((k for k in kinds if column.lower() in {h.lower() for h in config.hints.get(k, ())}), None)


def id_like(column: str, strict: bool) -> bool:
    """Whether a name looks like an identifier's: any part of it by default, whole words in strict mode."""
    low = column.lower()
    return any(w in (re.split(r"[^a-z0-9]+", low) if strict else low) for w in ID_LIKE)


def decide(column: str, dtype: T.DataType, n: int, distinct: int, f: dict | None, config: Config) -> str:
    """skip, pseudonymize, endpoint, identity, free_text, numeric or auto, by the first rule that holds."""
    if hint := hinted(column, config, ("pseudonymize", "endpoint")):
        return hint
    if not n or f is None:
        return "skip"
    numeric = isinstance(dtype, T.NumericType)
    density = 0.0 if set(f["kinds"]) <= set(NOISY) else f["density"]
    if isinstance(dtype, (T.DateType, T.TimestampType)) or isinstance(dtype, (T.BooleanType,)):
        return hinted(column, config) or ("auto" if isinstance(dtype, T.BooleanType) else "skip")
    if density >= config.density:
        return "free_text" if f["average_length"] >= config.free_text_length else "auto"
    if numeric:
        return "auto" if id_like(column, config.strict) else "numeric"
    if f["name_share"] >= config.name_share:
        return "identity"
    if distinct <= config.low_cardinality and n > 5:
        return "skip"
    if f["average_length"] >= config.free_text_length:
        return "free_text"
    return hinted(column, config) or "auto"


def classify(df: DataFrame, key: str, config: Config) -> dict[str, str]:
    """column -> type, from two small jobs: bounded samples, and counts."""
    flat = [f for f in df.schema if f.name != key and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    columns = [f.name for f in flat]
    if not columns:
        return {}
    found = {r["column"]: r.asDict() for r in features(df, key, config, columns).collect()}
    counts = cardinality(df, columns)
    return {f.name: decide(f.name, f.dataType, *counts[f.name], found.get(f.name), config) for f in flat}


