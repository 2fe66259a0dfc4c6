"""Leakage audits and a simulated attack: raw values looked up in masked tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakspark.operators.profile import melt

# The columns that an audit looks at, and the share of leaks below which its verdict is a minor one.
PII_COLUMNS = ("Name", "PAN_Number", "Aadhaar_Number", "Phone_Number", "Email")
MINOR = 5.0


def cell_values(df: DataFrame, key: str) -> DataFrame:
    """Distinct trimmed values of all cells."""
    return melt(df, key, [c for c in df.columns if c != key]).where("value IS NOT NULL").select(F.trim("value").alias("value")).distinct()


def leaks(raw: DataFrame, masked: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, value, leaked): each distinct raw value and whether a masked cell equals it."""
    values = melt(raw, key, columns).select("column", F.trim("value").alias("value")).where("value <> ''").distinct()
    seen = cell_values(masked, key).withColumn("leaked", F.lit(True))
    return values.join(seen, "value", "left").withColumn("leaked", F.coalesce("leaked", F.lit(False)))


def leakage(raw: DataFrame, masked: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column, unique_values, leaked, effectiveness (percent), status."""
    out = leaks(raw, masked, key, columns).groupBy("column").agg(F.count("*").alias("unique_values"), F.count_if("leaked").alias("leaked"))
    out = out.withColumn("effectiveness", F.round(100.0 - 100.0 * F.col("leaked") / F.col("unique_values"), 2))
    return out.withColumn("status", F.when(F.col("leaked") == 0, "SAFE").otherwise("LEAKED"))


def audit(raw: DataFrame, masked: DataFrame, key: str, columns: list[str] | None = None) -> dict:
    """Totals, a score and a verdict over all audited columns that both tables may share."""
    columns = [c for c in columns or PII_COLUMNS if c in raw.columns]
    rows = [r.asDict() for r in leakage(raw, masked, key, columns).orderBy("column").collect()] if columns else []
    every, out = sum(r["unique_values"] for r in rows), sum(r["leaked"] for r in rows)
    share = 100.0 * out / every if every else 0.0
    return {"columns": rows, "total_values": every, "total_leaks": out, "score": round(100.0 - share, 2), "verdict": "clean" if not out else "minor leaks" if share < MINOR else "leaking"}


def containment(raw: DataFrame, masked: DataFrame, key: str, columns: list[str], words: int = 4) -> DataFrame:
    """(column, value, n): raw values found inside masked cells, as whole words, and in how many cells.

    Runs of ``words`` words at most meet raw values in one hash join. Longer values are sought by their first
    ``words`` words in the same way, and the words that follow decide; nothing is compared pairwise.
    """
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    values = melt(raw, key, columns).select("column", norm(F.col("value")).alias("value")).where("value <> ''").distinct().withColumn("w", F.split("value", " "))
    tokens = F.filter(F.split(norm(F.col("value")), " "), lambda t: t != "")
    cells = melt(masked, key, [c for c in masked.columns if c != key]).where("value IS NOT NULL").select("key", F.col("column").alias("cell"), tokens.alias("t"))
    cells = cells.select("key", "cell", F.transform("t", lambda t: F.regexp_replace(t, r"^[^\w+]+|[^\w]+$", "")).alias("t"))
    places = lambda k: F.when(F.size("t") >= k, F.sequence(F.lit(1), F.size("t") - (k - 1))).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.array(*[F.transform(places(k), _run(k)) for k in range(1, words + 1)]))
    grams = cells.select(F.explode(F.array_distinct(runs)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    short = values.where(F.size("w") <= words).join(grams, "value").select("column", "value", "n")
    long = values.where(F.size("w") > words).withColumn("head", F.array_join(F.slice("w", 1, words), " "))
    heads = cells.select("key", "cell", F.explode(F.transform(places(words), lambda i: F.struct(i.alias("at"), _run(words)(i).alias("head")))).alias("h")).select("key", "cell", "h.at", "h.head")
    maybe = heads.join(long, "head").select("key", "cell", "at", "column", "value", F.size("w").alias("k"))
    found = maybe.join(cells, ["key", "cell"]).where(F.array_join(F.slice("t", F.col("at"), F.col("k")), " ") == F.col("value"))
    return short.unionByName(found.select("key", "cell", "column", "value").distinct().groupBy("column", "value").agg(F.count("*").alias("n")))


def _run(k: int):
    return lambda i: F.array_join(F.slice("t", i, k), " ")


def attack(raw: DataFrame, masked: DataFrame, key: str, columns: list[str], seed: int = 0) -> DataFrame:
    """column, digest, found: whether fields of one row, drawn by hash, occur as cells of the masked table."""
    target = raw.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(1)
    fields = melt(target, key, columns).select("column", F.trim("value").alias("value")).where("value <> ''")
    found = cell_values(masked, key).join(F.broadcast(fields.select("value").distinct()), "value", "left_semi").withColumn("found", F.lit(True))  # one row's fields
    return fields.join(found, "value", "left").select("column", F.substring(F.sha2("value", 256), 1, 12).alias("digest"), F.coalesce("found", F.lit(False)).alias("found"))


def full_audit(raw: DataFrame, masked: DataFrame, key: str, columns: list[str] | None = None, seed: int = 0) -> dict:
    names = [c for c in columns or PII_COLUMNS if c in raw.columns]
    checks = [r.asDict() for r in attack(raw, masked, key, names, seed).collect()] if names else []
    return {"leakage": audit(raw, masked, key, names), "attack": checks, "all_passed": not any(c["found"] for c in checks)}
