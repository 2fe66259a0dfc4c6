"""The masking pipeline: classify, mask, perturb, validate, account."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakspark.functions import masks, spans
from cloakspark.functions.patterns import Config
from cloakspark.operators import detect, manifest, profile, transforms, validate
from cloakspark.sources.scratch import spread, stored


@dataclass
class Result:
    masked: DataFrame
    detections: DataFrame
    manifest: dict
    types: dict[str, str]


def scanned(types: dict[str, str]) -> list[str]:
    """Columns whose cells are scanned for spans."""
    return [c for c, t in types.items() if t not in ("skip", "numeric", "pseudonymize")]


def alike(columns: list[str], config: Config) -> dict[tuple[int, ...], list[str]]:
    """Columns by the patterns that hints keep from them; one entry where no pattern has hints."""
    out: dict[tuple[int, ...], list[str]] = {}
    for c in columns:
        out.setdefault(config.left_out(c), []).append(c)
    return out


def project(df: DataFrame, key: str, types: dict[str, str], config: Config, model: bool = False) -> DataFrame:
    """One projection: each scanned column's result as ``_m_`` + column, pseudonyms and postal codes in place.

    Stateless once ``types`` is fixed, so it serves batches and streams alike. Scanned columns become strings.
    """
    out = df
    for n, (without, columns) in enumerate(alike(scanned(types), config).items()):
        # One expression serves all columns, as the elements of an array: the plan does not grow with their number.
        cells = [
            F.struct(
                F.col(f"`{c}`").cast("string").alias("text"), F.lit(types[c] in spans.LOOSE).alias("loose"), F.lit(config.names and types[c] == "free_text").alias("names"),
                F.lit(types[c] == "identity" and not model).alias("identity"), *([(F.col(f"`_n_{c}`") if types[c] in ("free_text", "identity", "auto") else F.lit(None).cast(spans.SPANS)).alias("more")] if model else []),
            )
            for c in columns
        ]
        some = lambda flag: any(flag(types[c]) for c in columns)  # noqa: B023, E731
        named, whole = config.names and some(lambda t: t == "free_text"), not model and some(lambda t: t == "identity")
        one = lambda x: spans.mask_text(x["text"], config, x["loose"], True, x["names"] if named else False, x["more"] if model else None, without, x["identity"] if whole else None)  # noqa: B023, E731
        out = out.withColumn(f"_all_{n}", F.transform(F.array(*cells), one))
        out = out.withColumns({f"_m_{c}": F.get(f"_all_{n}", i) for i, c in enumerate(columns)}).drop(f"_all_{n}")
    for c, t in types.items():
        if t == "pseudonymize":
            out = out.withColumn(c, transforms.pseudonymize(F.col(f"`{c}`").cast("string"), config.salt))
        elif c.lower() == "pincode":
            code = transforms.substitute_pincode(F.col(f"`{c}`"), config.salt)
            if f"_m_{c}" in made:
                out = out.withColumn(f"_m_{c}", F.col(f"`_m_{c}`").withField("masked_text", code))
            else:
                out = out.withColumn(c, code)
    return out


def process(df: DataFrame, key: str, config: Config, types: dict[str, str] | None = None, model: Callable[[], detect.Detector] | None = None) -> Result:
    """Mask a table whose rows ``key`` names. ``model``: a factory of a detector, which also scans masked text again; else dictionaries serve.

    Two small profile jobs, one projection written to the shared folder, roll-ups of it, and one to three validation
    passes. All columns stay, with their order; scanned ones are strings. Errors are not swallowed.
    """
    began = time.time()
    types = types or profile.classify(df, key, config)
    loose = [c for c in scanned(types) if types[c] in ("free_text", "identity", "auto") and dict(df.dtypes)[c] == "string"]
    rows = spread(df)
    rows = detect.with_model_spans(rows, loose, model) if model and loose else rows
    work = project(rows, key, {c: t for c, t in types.items()}, config, bool(model) and set(scanned(types)) <= set(loose))
    numeric = [c for c, t in types.items() if t == "numeric"]
    changed: list[str] = []
    if numeric:
        work, changed = transforms.protect_numeric(work, key, numeric, config)
    columns = scanned(types)
    work = stored(df.sparkSession, work.drop(*[f"_n_{c}" for c in loose]), "masked")
    events = manifest.detections(work, key, columns, config.effective()) if columns else None
    step = work.select(
        *[F.col(f"`_m_{c}`.masked_text").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns],
        *[(F.array(F.struct(F.lit(0).alias("start"), F.length(F.col(f"`_m_{c}`.masked_text")).alias("end"))) if c.lower() == "pincode" else validate.provenance(F.col(f"`_m_{c}`.detections"))).alias(f"_p_{c}") for c in columns],
    )
    clean, passes = validate.validate(step, {c: types[c] for c in columns}, config, model=model)
    clean = clean.select(*[F.col(f"`{c}`") for c in df.columns])
    if events is None:
        events = df.sparkSession.createDataFrame([], "entity_type string, original_value string, original_digest string, masked_value string, confidence double, detector string, severity string, column string, row_key string, action string")
    report = manifest.manifest(events, work.count(), len(df.columns), round(time.time() - began, 3), passes)
    report["transforms"] = {"noise": changed, "pseudonymized": [c for c, t in types.items() if t == "pseudonymize"], "pincodes": [c for c in types if c.lower() == "pincode"]}
    return Result(clean, events, report, types)


def process_dataframe(df: DataFrame, key: str, salt: str) -> DataFrame:
    """The masked table alone, with default settings."""
    return process(df, key, Config(salt=salt)).masked


def mask_column(df: DataFrame, column: str, config: Config, names: bool = False) -> DataFrame:
    """``df`` with ``masked_text``, ``detections`` and ``pii_count`` of one text column."""
    return df.withColumn("_r", spans.mask_text(F.col(column), config, with_names=names)).select(*df.columns, "_r.*")
