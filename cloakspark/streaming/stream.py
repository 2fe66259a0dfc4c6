"""Masking and counting of streams: the same projection, and windows with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakspark.functions.patterns import Config
from cloakspark.operators import transforms
from cloakspark.plans.pipeline import project, scanned


def mask_stream(stream: DataFrame, key: str, types: dict[str, str], config: Config, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """A stream (or batch) masked by fixed column types, as a batch sample's ``classify`` gives them. No state, no shuffle.

    Numeric columns get noise by the range that ``bounds`` gives, as a stream has none of its own; one without is refused.
    """
    numeric = [c for c, t in types.items() if t == "numeric"]
    if missing := [c for c in numeric if c not in (bounds or {})]:
        raise ValueError(f"bounds are needed for the noise of {', '.join(missing)}")
    out, columns = project(stream, key, types, config), scanned(types)
    kinds = {f.name: f.dataType for f in stream.schema}
    noise = {c: transforms.noisy(F.col(f"`{c}`"), kinds[c], F.col(f"`{key}`"), (bounds[c][1] - bounds[c][0]) / config.epsilon, config, c).alias(c) for c in numeric}
    return out.select(*[F.col(f"`_m_{c}`.masked_text").alias(c) if c in columns else noise.get(c, F.col(f"`{c}`")) for c in stream.columns])


def detections_by_window(stream: DataFrame, time_column: str, text: str, config: Config, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """window start, entity_type, n: detections per tumbling window; rows later than ``late`` are left out by the watermark."""
    from cloakspark.functions import spans

    patterns = config.effective()
    hits = stream.withWatermark(time_column, late).select(F.col(time_column).alias("at"), F.explode(spans.mask_text(F.col(text), config)["detections"]).alias("d"))
    kinds = hits.select("at", spans.attribute(F.col("d.ord"), patterns, "name").alias("entity_type"))
    return kinds.groupBy(F.window("at", every).alias("w"), "entity_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "entity_type", "n")
