"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakspark.llm.common import WORD, write_table


def running_sums(spark: SparkSession, df: DataFrame, by: list[str], order: list[str], value: str, tag: str) -> DataFrame:
    """``df`` with ``total``: the sum of ``value`` up to and with each row, in ``order``, within equal ``by`` columns.

    Rows are range-sorted by ``by`` and ``order``, so a hot group spreads over many partitions; each partition sums its
    own rows in a stream, and sums of earlier partitions (one row per partition and group) are joined on.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, total double, part int"

    def local(batches):
        from pyspark import TaskContext

        part, last, total = TaskContext.get().partitionId(), None, 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.reset_index(drop=True)
            new = pd.Series(False, pdf.index)
            for c in by:
                now, was = pdf[c], pdf[c].shift()
                new |= ~((now == was) | (now.isna() & was.isna()))
            new[0] = last is None or any(not (a == b or (pd.isna(a) and pd.isna(b))) for a, b in zip(pdf.loc[0, by], last, strict=True))
            run = new.cumsum()
            sums = pdf[value].astype(float).groupby(run).cumsum()
            if not new[0]:
                sums[run == 0] += total
            last, total = list(pdf.loc[len(pdf) - 1, by]), float(sums.iloc[-1])
            yield pdf.assign(total=sums, part=part)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    rows = write_table(spark, df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInPandas(local, schema), tag)
    ends = rows.groupBy(*by, "part").agg(F.max("total").alias("ending"))
    w = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(c).alias(f"by_{c}") for c in by], F.col("part").alias("by_part"), F.coalesce(F.sum("ending").over(w), F.lit(0.0)).alias("before"))
    on = F.col("part") == F.col("by_part")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"by_{c}"))
    return rows.join(ends, on).withColumn("total", F.col("total") + F.col("before")).drop("before", "by_part", "part", *[f"by_{c}" for c in by])


def targets(spark: SparkSession, sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target: water filling, one row per source; weights repeat over sources in code-point order.

    target = min(cap * source_size, level * weight), the level being that at which targets sum to ``share`` of all
    sizes: the end of sharing excess again and again. Places in the order, and sums up to a source, are running sums
    over range-sorted partitions, so sources may be as many as hosts.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull()).withColumn("one", F.lit(1))
    s = running_sums(spark, s, [], ["none", "source"], "one", "places")
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("total") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * float(cap)).withColumn("full", F.col("most") / F.col("weight")).drop("total")
    order = ["full", "none", "source"]
    s = running_sums(spark, s, [], order, "most", "most").withColumnRenamed("total", "most_upto")
    s = write_table(spark, running_sums(spark, s, [], order, "weight", "weights").withColumnRenamed("total", "weight_upto"), "levels")
    every = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if every["size"] is None:
        return s.select("source", F.col("source_size").cast("long").alias("source_size"), "most").withColumnRenamed("most", "target")
    # What is left for sources from this one on, by weight, if all before it are full.
    level = (float(share) * every["size"] - F.col("most_upto") + F.col("most")) / (every["weight"] - F.col("weight_upto") + F.col("weight"))
    line = s.where(level <= F.col("full")).agg(F.min(F.struct("full", level.alias("level"))).alias("line")).first()["line"]
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), F.least("most", F.lit(line["level"]) * F.col("weight") if line else F.col("most")).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 0) -> DataFrame:
    """Documents' rows as (doc_id, row_hash, source, size, source_size, target, taken).

    Each source's documents are shuffled by hash and queued ``cap`` times over; a copy's virtual finish time is its
    source's cumulative size divided by the target. All copies are range-sorted by it and taken until the budget, the
    sum of targets, is spent; the rest is what ``taken`` (words, repeats counted) leaves out. Words are runs of other
    than ASCII white space; a null text has none. Equal rows follow each other in the queue; at the cut some of them may be taken once more than others.
    A null source is a source of its own, last in order. An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long"), "source", size.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text").alias("row_hash"))
    sized = write_table(spark, sized, "sizes")
    goal = write_table(spark, targets(spark, sized, weights, share, cap), "targets")
    queue = running_sums(spark, sized, ["source"], ["row_hash", "doc_id"], "size", "queue")
    goal = goal.withColumnRenamed("source", "of")
    queue = write_table(spark, queue.join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of"), "finish")
    copies = queue.withColumn("turn", F.explode(F.array(*map(F.lit, range(cap)))))
    finish = F.when(F.col("target") > 0, (F.col("total") + F.col("turn") * F.col("source_size")) / F.col("target")).otherwise(0.0)
    order = ["finish", "row_hash", "doc_id", "turn"]
    copies = running_sums(spark, copies.select(finish.alias("finish"), "row_hash", "doc_id", "turn", "size"), [], order, "size", "copies")
    budget = goal.agg(F.sum("target")).first()[0] or 0.0
    last = copies.where(F.col("total") <= budget).agg(F.max(F.struct("finish", "row_hash", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "turn")).alias("last")).first()["last"]

    def took(turn: int):
        if last is None:
            return F.lit(0)
        at = (F.col("total") + turn * F.col("source_size")) / F.col("target")
        here = F.struct(at.alias("finish"), "row_hash", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.lit(turn).alias("turn"))
        end = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["row_hash"]).alias("row_hash"), F.lit(last["doc_id"]).alias("doc_id"), F.lit(last["turn"]).alias("turn"))
        return F.when((F.col("target") > 0) & (here <= end), 1).otherwise(0)

    times = took(0)
    for k in range(1, cap):
        times = times + took(k)
    return queue.select("doc_id", "row_hash", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def take_mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with their own columns only.

    Texts without words take nothing of the budget and stay once each. Rows of equal id and text are taken as often as
    ``mix`` says of all of them together; where they differ, those at the cut, some get one more.
    """
    times = (F.col("taken") / F.col("size")).cast("int")
    found = mix(spark, docs, weights, share, cap, seed).where("size > 0").groupBy(F.col("doc_id").alias("_cs_id"), F.col("row_hash").alias("_cs_hash"))
    found = write_table(spark, found.agg(F.min(times).alias("_cs_low"), F.max(times).alias("_cs_high"), (F.sum(times) - F.min(times) * F.count("*")).alias("_cs_more")), "times")
    rows = docs.withColumn("_cs_row", F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_cs_id")) & (F.col("_cs_row") == F.col("_cs_hash"))
    same = rows.join(found, on, "left").where("_cs_low IS NULL OR _cs_low = _cs_high").withColumn("_cs_times", F.coalesce("_cs_low", F.lit(1)))
    cut = rows.join(found.where("_cs_low < _cs_high"), on)  # equal rows at the cut alone
    k = F.row_number().over(Window.partitionBy("_cs_id", "_cs_hash").orderBy("_cs_row")) - 1
    gap = F.col("_cs_high") - F.col("_cs_low")
    cut = cut.withColumn("_cs_times", (F.col("_cs_low") + F.greatest(F.lit(0), F.least(gap, F.col("_cs_more") - k * gap))).cast("int"))
    both = same.unionByName(cut).withColumn("_cs_turn", F.explode(F.array_repeat(F.lit(0), F.col("_cs_times"))))
    return both.select(*docs.columns)
