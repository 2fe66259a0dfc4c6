"""Whole-column transforms: noise, pseudonyms, postal codes and a basic fallback masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakspark.functions import masks
from cloakspark.functions.expr import let
from cloakspark.functions.patterns import Config
from cloakspark.operators.profile import cardinality


def uniform(key: Column, salt: str, tag: str) -> Column:
    """A number in (0, 1) from a digest of the row's key: the same whatever the partitioning."""
    h = F.sha2(F.concat(F.lit(f"{salt}:{tag}:"), key.cast("string")), 256)
    return (masks.number(h, 0, 12).cast("double") + 0.5) / float(16**12)


def laplace(value: Column, key: Column, scale: float, salt: str, tag: str) -> Column:
    """``value`` with noise of a Laplace distribution, by the inverse of its distribution function."""
    return let(uniform(key, salt, tag) - 0.5, lambda u: value.cast("double") - F.lit(float(scale)) * F.signum(u) * F.log1p(-2 * F.abs(u)))


def noisy(value: Column, dtype: T.DataType, key: Column, scale: float, config: Config, name: str) -> Column:
    """Whole numbers are rounded, others to two places; nothing falls below 0, ages stay in 18 to 100, nulls stay."""
    x = laplace(value, key, scale, config.salt, f"noise:{name}")
    if isinstance(dtype, T.IntegralType) or name.lower() == "age":
        x = F.greatest(F.round(x), F.lit(0.0))
        out = (F.least(F.greatest(x, F.lit(18.0)), F.lit(100.0)) if name.lower() == "age" else x).cast("long")
    else:
        out = F.greatest(F.round(x, 2), F.lit(0.0))
    return F.when(value.isNotNull(), out)


def protect_numeric(df: DataFrame, key: str, columns: list[str], config: Config, bounds: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, list[str]]:
    """Noise on numeric columns; whole-number columns of few values are codes and stay. Gives what was changed too.

    The scale is the range over epsilon; ranges come from ``bounds`` or else from the data, which is no formal privacy.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    counts = cardinality(df, columns)
    chosen = [c for c in columns if not (isinstance(kinds[c], T.IntegralType) and counts[c][1] <= config.low_cardinality)]
    known = dict(bounds or {})
    open_ = [c for c in chosen if c not in known and c.lower() != "age"]
    if open_:
        r = df.agg(*[f(f"`{c}`").cast("double").alias(f"{n}{i}") for i, c in enumerate(open_) for n, f in (("a", F.min), ("b", F.max))]).first()
        known |= {c: (r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(open_) if r[f"a{i}"] is not None}
    scale = lambda c: (5.0 if c.lower() == "age" else known[c][1] - known[c][0] if c in known else 1000.0) / config.epsilon
    return df.withColumns({c: noisy(F.col(f"`{c}`"), kinds[c], F.col(f"`{key}`"), scale(c), config, c) for c in chosen}), chosen


def pseudonymize(value: Column, salt: str) -> Column:
    return F.when(value.isNull() | (F.trim(value) == ""), value).otherwise(masks.hmac_id(value, salt))


def substitute_pincode(value: Column, salt: str) -> Column:
    """A postal code for another; ``560001.0`` and ``560001`` are the same."""
    plain = let(value.cast("string"), lambda v: F.when(v.rlike(r"^\s*\d+(\.0*)?\s*$"), F.regexp_extract(v, r"\d+", 0)).otherwise(v))
    return masks.mask(plain, "pincode", salt)


# What the fallback masking puts in place of ages, and after a postal code's first digits.
AGE_BAND, PIN_TAIL = "26-35", "XXX"
BASIC = {"Name": "name", "Phone_Number": "phone_number", "Email": "email", "PAN_Number": "pan", "Aadhaar_Number": "aadhaar", "Account_Number": "bank_account"}


def basic_mask(df: DataFrame, key: str, salt: str) -> DataFrame:
    """Masking by column names alone: identity columns by method, ages to a band, postal codes cut, amounts with noise."""
    new = {c: masks.mask(F.col(c).cast("string"), m, salt) for c, m in BASIC.items() if c in df.columns}
    if "Age" in df.columns:
        new["Age"] = F.when(F.col("Age").isNotNull(), F.lit(AGE_BAND))
    if "Pincode" in df.columns:
        new["Pincode"] = F.concat(F.substring(F.col("Pincode").cast("string"), 1, 3), F.lit(PIN_TAIL))
    if "Amount" in df.columns:
        new["Amount"] = F.when(F.col("Amount").isNotNull(), F.greatest(F.round(laplace(F.col("Amount"), F.col(key), 1000.0, salt, "basic"), 2), F.lit(0.0)))
    return df.withColumns(new)
