"""Re-scanning masked text until a pass finds nothing, with what masking itself wrote set apart by position."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakspark.functions import spans
from cloakspark.functions.expr import let
from cloakspark.functions.patterns import NER_METHODS, VALIDATOR_SKIPS, Config
from cloakspark.operators import detect
from cloakspark.sources.scratch import stored

#: Where a cell's text is synthetic.
MARKS = "array<struct<start:int,end:int>>"


def provenance(described: Column) -> Column:
    """Where replacements ended up in the masked text, from events (start, end, masked) sorted by start."""

    def add(acc: Column, d: Column) -> Column:
        at = d["start"] + acc["shift"]
        n = F.length(d["masked"])
        out = F.when(d["action"] == "LOG_ONLY", acc["marks"]).otherwise(F.array_append(acc["marks"], F.struct(at.cast("int").alias("start"), (at + n).cast("int").alias("end"))))
        return F.struct(F.when(d["action"] == "LOG_ONLY", acc["shift"]).otherwise(acc["shift"] + n - (d["end"] - d["start"])).cast("int").alias("shift"), out.alias("marks"))

    return F.aggregate(described, F.struct(F.lit(0).alias("shift"), F.array().cast(MARKS).alias("marks")), add, lambda acc: acc["marks"])


def rescan(text: Column, marks: Column, config: Config, loose: Column, without: Sequence[int] = (), more: Column | None = None) -> Column:
    """struct(text, marks, found): leaks replaced, ``found`` their orders. A match that touches a synthetic stretch is no leak.

    ``loose`` says whether the column is free text or of unknown content, where some patterns are passed over; ``more``
    are spans that a model detector found in ``text``.
    """
    patterns = config.effective()
    skipped = [i for i, p in enumerate(patterns) if p.name in VALIDATOR_SKIPS]
    raw = spans.raw_spans(text, patterns, loose, without=without)
    if more is not None:
        raw = F.concat(raw, F.coalesce(more, F.array().cast(spans.SPANS)))
    raw = F.filter(raw, lambda s: ~F.exists(marks, lambda m: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    if skipped:
        raw = F.filter(raw, lambda s: ~(loose & s["ord"].isin(*skipped)))

    def out(d: Column) -> Column:
        new = F.array_sort(F.concat(F.transform(d, lambda x: F.struct(x["start"], x["end"], x["masked"])), F.transform(marks, lambda m: F.struct(m["start"], m["end"], F.substring(text, m["start"] + 1, m["end"] - m["start"]).alias("masked")))))
        events = F.transform(new, lambda x: F.struct(x["start"], x["end"], x["masked"], F.lit("REDACTED").alias("action")))
        return F.struct(spans.splice(text, d).alias("text"), provenance(events).alias("marks"), F.transform(d, lambda x: x["ord"]).alias("found"))

    same = F.struct(text.alias("text"), marks.alias("marks"), F.array().cast("array<int>").alias("found"))
    return F.when(text.isNull(), same).otherwise(let(spans.resolve(raw), lambda r: F.when(F.size(r) == 0, same).otherwise(let(spans.described(r, patterns, config), out))))


def validate(df: DataFrame, kinds: dict[str, str], config: Config, prefix: str = "_p_", model: Callable[[], detect.Detector] | None = None) -> tuple[DataFrame, list[dict]]:
    """Passes over the columns of ``kinds``, whose marks stand in ``prefix`` + column; gives the clean table and a record a pass.

    A pass writes its result to the shared folder, so the next one re-reads it. Stops at a clean pass or after
    ``config.passes``. ``model``: a factory of a detector that scans the columns too, with what masking wrote set apart.
    """
    passes: list[dict] = []
    names = dict(enumerate(p.name for p in config.effective())) | {spans.ner_ord(x): x.upper().replace(" ", "_") for x in NER_METHODS}
    columns: Sequence[str] = list(kinds)
    for n in range(1, config.passes + 1):
        if not columns:
            return df, [{"pass_number": 1, "pii_found": 0, "types_found": [], "is_clean": True}]
        seen = detect.with_model_spans(df, list(columns), model) if model else df
        step = seen
        by_hints: dict[tuple[int, ...], list[str]] = {}
        for c in columns:
            by_hints.setdefault(config.left_out(c), []).append(c)
        for k, (without, some) in enumerate(by_hints.items()):
            cells = [F.struct(F.col(f"`{c}`").alias("text"), F.col(f"`{prefix}{c}`").alias("marks"), F.lit(kinds[c] in spans.LOOSE).alias("loose"), *([F.col(f"`_n_{c}`").alias("more")] if model else [])) for c in some]
            one = lambda x: rescan(x["text"], x["marks"], config, x["loose"], without, x["more"] if model else None)  # noqa: B023, E731
            step = step.withColumn(f"_all_{k}", F.transform(F.array(*cells), one))
            step = step.withColumns({f"_v_{c}": F.get(f"_all_{k}", i) for i, c in enumerate(some)})
        new = step.select(*[F.col(f"`_v_{c}`.text").alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns if not c.startswith(prefix)], *[F.col(f"`_v_{c}`.marks").alias(prefix + c) for c in columns], F.flatten(F.array(*[F.col(f"`_v_{c}`.found") for c in columns])).alias("_found"))
        new = stored(df.sparkSession, new, "pass")
        counts = {names[r["o"]]: r["count"] for r in new.select(F.explode("_found").alias("o")).groupBy("o").count().collect()}
        passes.append({"pass_number": n, "pii_found": sum(counts.values()), "types_found": sorted(counts), "is_clean": not counts})
        df = new.drop("_found")
        if not counts:
            break
    return df, passes
