"""Generated fixture rows, and a Gaussian copula fitted on columns and sampled in Spark."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakspark.functions import checksum, masks, names
from cloakspark.functions.expr import let, literals, pick
from cloakspark.operators.transforms import uniform

# Statuses, platforms and comments of generated rows.
STATUSES = ("SUCCESS", "FAILED", "PENDING")
PLATFORMS = ("Direct", "Partner_A", "Partner_B", "Partner_C")
COMMENTS = (
    "FD close karna hai", "Mera interest kab aayega?", "Nominee add karna hai please", "Account balance check karo", "Mujhe loan chahiye FD par", "Kyc update kaise karein?",
    "Customer care ka number do", "Branch transfer request", "Sir, mere account se paise kat gaye", "Excellent service, thank you",
)
GRID, CATEGORIES, OTHER = 100, 1000, "(other)"


def generate(spark: SparkSession, n: int = 100, seed: str = "fixture", year: int = 2025) -> DataFrame:
    """``n`` rows of 15 columns and a row_id; every value is a function of (seed, row_id)."""
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    h = lambda tag: F.sha2(F.concat(F.lit(f"{seed}:{tag}:"), F.col("row_id").cast("string")), 256)
    u = lambda tag: uniform(F.col("row_id"), seed, tag)
    b = masks.builders(seed)
    made = lambda method, tag: let(h(tag), lambda x: b[method](F.lit(""), x))
    name = F.concat_ws(" ", pick(names.FIRST, masks.number(h("first"), 0, 8)), F.initcap(pick(names.SURNAMES, masks.number(h("last"), 0, 8))))
    g = h("id")
    uuid = F.concat_ws("-", F.substring(g, 1, 8), F.substring(g, 9, 4), F.concat(F.lit("4"), F.substring(g, 14, 3)), F.concat(F.lit("a"), F.substring(g, 18, 3)), F.substring(g, 21, 12))
    phone = F.concat(F.when(u("prefix") > 0.5, "+91 ").otherwise(""), made("phone_number", "phone"))
    rows = rows.select("row_id", uuid.alias("Transaction_ID"), name.alias("Name"), (F.lit(18) + F.floor(u("age") * 68)).cast("int").alias("Age"), made("pincode", "pin").alias("Pincode"), phone.alias("Phone_Number"), made("email", "mail").alias("Email"), made("pan", "pan").alias("PAN_Number"), made("aadhaar", "uid").alias("Aadhaar_Number"))
    comment = pick(COMMENTS, masks.number(h("comment"), 0, 8))
    return rows.select(
        "*", let(h("account"), lambda x: masks.digits(x, 0, 18)).alias("Account_Number"), pick(PLATFORMS, masks.number(h("platform"), 0, 8)).alias("Platform_Source"), F.round(u("score") * 100, 1).alias("App_Usage_Score"),
        F.round(100 + u("amount") * 49900, 2).alias("Amount"), pick(STATUSES, masks.number(h("status"), 0, 8)).alias("Status"), F.date_add(F.lit(f"{year}-01-01").cast("date"), F.floor(u("day") * 365).cast("int")).alias("Date"),
        F.when(u("kind") > 0.7, F.concat_ws(" ", comment, "PAN_Number")).when(u("other") > 0.85, F.concat(F.col("Name"), F.lit(" ka account check karo"))).otherwise(comment).alias("Comments"),
    )


@dataclass
class Copula:
    numeric: dict[str, list[float]] = field(default_factory=dict)
    integral: set[str] = field(default_factory=set)
    categorical: dict[str, tuple[list[str], list[float]]] = field(default_factory=dict)
    factor: np.ndarray | None = None
    id_column: str | None = None


def fit(df: DataFrame, id_column: str | None = None, categories: int = CATEGORIES) -> Copula:
    """Quantile grids, category shares and rank correlations; the model's size depends on columns alone.

    Numeric columns get GRID + 1 quantiles; strings get shares of their ``categories`` most frequent values, and all others
    together the share of a class of their own, OTHER. Correlations are those of grid ranks, turned into those of normal
    scores by 2 sin(pi r / 6).
    """
    out = Copula(id_column=id_column)
    fields = [f for f in df.schema if f.name != id_column]
    nums = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    out.integral = {f.name for f in fields if isinstance(f.dataType, T.IntegralType)}
    if nums:
        grids = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), [i / GRID for i in range(GRID + 1)], 10000).alias(f"q{i}") for i, c in enumerate(nums)]).first()
        out.numeric = {c: list(grids[f"q{i}"]) for i, c in enumerate(nums) if grids[f"q{i}"]}
    nums = list(out.numeric)
    if nums:
        ranks = df.select(*[_rank(F.col(f"`{c}`").cast("double"), out.numeric[c]).alias(f"r{i}") for i, c in enumerate(nums)])
        pairs = [(i, j) for i in range(len(nums)) for j in range(i)]
        r = ranks.agg(F.count("*").alias("n"), *[F.corr(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
        m = np.eye(len(nums))
        for i, j in pairs:
            c = r[f"c{i}_{j}"]
            m[i, j] = m[j, i] = 2 * math.sin(math.pi * (0.0 if c is None or math.isnan(c) else c) / 6)
        values, vectors = np.linalg.eigh(m)
        m = vectors @ np.diag(np.clip(values, 1e-6, None)) @ vectors.T
        out.factor = np.linalg.cholesky(m / np.sqrt(np.outer(np.diag(m), np.diag(m))))
    for f in fields:
        if isinstance(f.dataType, T.StringType):
            counts = df.where(F.col(f"`{f.name}`").isNotNull()).groupBy(F.col(f"`{f.name}`").alias("value")).count()
            top = [tuple(r) for r in counts.orderBy(F.desc("count"), "value").limit(categories).collect()]
            total = counts.agg(F.sum("count")).first()[0] or 0
            if (rest := total - sum(n for _, n in top)) > 0:
                top.append((OTHER, rest))
            if total:
                out.categorical[f.name] = ([v for v, _ in top], list(np.cumsum([n / total for _, n in top])))
    return out


def _rank(v: Column, grid: list[float]) -> Column:
    """Mid-rank of ``v`` in its grid, 0 to 1."""
    below, upto = F.size(F.filter(literals(grid), lambda g: g < v)), F.size(F.filter(literals(grid), lambda g: g <= v))
    return F.when(v.isNotNull(), (below + upto) / (2.0 * len(grid)))


def normal_share(z: Column) -> Column:
    """Distribution function of the normal law, by a published rational approximation (error under 1e-7)."""
    # Coefficients of approximation 26.2.17 in Abramowitz and Stegun.
    p, c = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

    def tail(t: Column) -> Column:
        poly = F.lit(0.0)
        for k in reversed(c):
            poly = (poly + k) * t
        return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly

    upper = let(1 / (1 + p * F.abs(z)), tail)
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def draw(spark: SparkSession, model: Copula, n: int, seed: str = "copula") -> DataFrame:
    """``n`` rows from the model, each a function of (seed, row number)."""
    rows = spark.range(n)
    u = lambda tag: uniform(F.col("id"), seed, tag)
    nums, cols = list(model.numeric), []
    rows = rows.withColumns({f"_z{i}": F.sqrt(-2 * F.log(u(f"a{i}"))) * F.cos(2 * math.pi * u(f"b{i}")) for i in range(len(nums))})
    for i, c in enumerate(nums):
        z = sum((F.lit(float(model.factor[i, j])) * F.col(f"_z{j}") for j in range(i + 1)), F.lit(0.0))
        g = literals(model.numeric[c])
        value = let(normal_share(z), _at(g))
        cols.append((F.round(value).cast("long") if c in model.integral else value).alias(c))
    for c, (values, shares) in model.categorical.items():
        k = F.size(F.filter(literals([float(s) for s in shares]), _less(u(f"c:{c}"))))
        cols.append(F.get(literals(values), F.least(k, F.lit(len(values) - 1))).alias(c))
    ids = [F.substring(F.sha2(F.concat(F.lit(f"{seed}:id:"), F.col("id").cast("string")), 256), 1, 32).alias(model.id_column)] if model.id_column else []
    return rows.select(*ids, *cols)


def _at(grid: Column):
    """Value of a share, between the grid's quantiles."""
    return lambda x: let(F.least(F.floor(x * GRID), F.lit(GRID - 1)).cast("int"), lambda k: F.get(grid, k) + (x * GRID - k) * (F.get(grid, k + 1) - F.get(grid, k)))


def _less(x: Column):
    return lambda s: s < x
