"""Detections as a table of facts, and their roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakspark.functions import spans
from cloakspark.functions.patterns import Pattern

DIMENSIONS = ("entity_type", "severity", "detector")


def detections(masked: DataFrame, key: str, columns: Sequence[str], patterns: Sequence[Pattern], prefix: str = "_m_") -> DataFrame:
    """One row a detection from the struct columns ``prefix`` + column. No raw text is carried, only a digest of it."""
    rows = F.flatten(F.array(*[_tagged(F.col(f"`{prefix}{c}`")["detections"], c) for c in columns]))
    d = masked.select(F.col(f"`{key}`").cast("string").alias("row_key"), F.explode(rows).alias("d"))
    look = lambda what: spans.attribute(F.col("d.ord"), patterns, what)
    return d.select(
        look("name").alias("entity_type"), F.lit("[REDACTED]").alias("original_value"), F.col("d.original").alias("original_digest"), F.col("d.masked").alias("masked_value"),
        F.col("d.confidence").alias("confidence"), look("detector").alias("detector"), look("severity").alias("severity"), F.col("d.column").alias("column"), "row_key", F.col("d.action").alias("action"),
    )


def _tagged(events, column: str):
    return F.transform(events, lambda d: d.withField("column", F.lit(column)))


def rollup(events: DataFrame) -> DataFrame:
    """dimension, value, found, masked: totals and counts by type, severity, detector and action in one pass."""
    dims = [*DIMENSIONS, "action"]
    cube = events.groupingSets([[F.col(c)] for c in dims] + [[]], *[F.col(c) for c in dims]).agg(F.count("*").alias("found"), F.count_if(F.col("action") != "LOG_ONLY").alias("masked"), F.grouping_id().alias("g"), *[F.grouping(c).alias(f"g_{c}") for c in dims])
    name, value = F.lit("total"), F.lit("all")
    for c in dims:
        name, value = F.when(F.col(f"g_{c}") == 0, F.lit(c)).otherwise(name), F.when(F.col(f"g_{c}") == 0, F.col(c)).otherwise(value)
    return cube.select(name.alias("dimension"), value.alias("value"), "found", "masked")


def column_summaries(events: DataFrame) -> DataFrame:
    """column, total, by_type, by_severity, by_detector (maps), top_type (most frequent, then by name)."""
    counts = events.select("column", F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("value")) for c in DIMENSIONS])).alias("x")).groupBy("column", "x.dim", "x.value").count()
    by = lambda dim: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dim") == dim, F.struct("value", "count"))))).alias(f"by_{dim.removeprefix('entity_')}")
    total = F.sum(F.when(F.col("dim") == "severity", F.col("count"))).alias("total")
    first = F.max_by(F.when(F.col("dim") == "entity_type", F.col("value")), F.when(F.col("dim") == "entity_type", F.struct(F.col("count"), F.transform(F.split("value", ""), lambda c: -F.ascii(c)))))
    return counts.groupBy("column").agg(total, *map(by, DIMENSIONS), first.alias("top_type"))


def by_count(events: DataFrame) -> DataFrame:
    """entity_type, n, ascending by count, then name."""
    return events.groupBy("entity_type").agg(F.count("*").alias("n")).orderBy("n", "entity_type")


def manifest(events: DataFrame, rows: int, columns: int, seconds: float, passes: list[dict], version: str = "1.0") -> dict:
    """The run as one dictionary; its size depends on patterns and columns, not on rows."""
    totals: dict[str, dict[str, int]] = {}
    masked = 0
    for r in rollup(events).collect():
        totals.setdefault(r["dimension"], {})[r["value"]] = r["found"]
        masked = r["masked"] if r["dimension"] == "total" else masked
    return {
        "pipeline_version": version, "total_rows": rows, "total_columns": columns, "processing_time_seconds": seconds, "total_pii_detected": totals.get("total", {}).get("all", 0),
        "total_pii_masked": masked, "detection_by_type": totals.get("entity_type", {}), "detection_by_severity": totals.get("severity", {}), "detection_by_detector": totals.get("detector", {}),
        "column_summaries": [r.asDict(True) for r in column_summaries(events).orderBy("column").collect()], "validation_passes": passes, "final_clean": bool(passes) and passes[-1]["is_clean"],
    }
