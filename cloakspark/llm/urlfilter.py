"""URL filters: exact membership in a rule list by a cascade of Bloom filters. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.llm.common import write_table

#: Bits that one level may have: 8 MB, the bound of what a plan carries as a literal.
MAX_BITS = 1 << 26


def url_host(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Cascade:
    """Levels of (bits, hashes, words): odd levels hold listed keys, even levels what the level before let pass in error."""

    def __init__(self, levels: list[tuple[int, int, list[int]]]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over: listed if the first level without it is an even one."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(~_holds(level, i, key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def _positions(bits: int, hashes: int, seed: int, key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), F.lit(k), key), F.lit(bits)) for k in range(hashes)]


def _holds(level: tuple[int, int, list[int]], seed: int, key: Column) -> Column:
    bits, hashes, words = level
    table = F.array(*map(F.lit, words)) if len(words) < 4096 else F.from_json(F.lit(f"[{','.join(map(str, words))}]"), "array<bigint>")
    test = [F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1 for p in _positions(bits, hashes, seed, key)]
    return reduce(lambda a, b: a & b, test)


def build_cascade(spark: SparkSession, listed: DataFrame, universe: DataFrame, error: float = 0.01) -> Cascade:
    """``listed`` and ``universe`` are frames of a string ``key``. Each level is built by one aggregate over its keys;
    only keys that pass all levels so far are carried to the next, so keys fall away by ``error`` a level.

    An empty list gives a cascade that holds nothing. Nulls are ignored.
    """
    keep = write_table(spark, listed.where("key IS NOT NULL").select("key").distinct(), "listed")
    others = universe.where("key IS NOT NULL").select("key").distinct().join(keep, "key", "left_anti")
    levels: list[tuple[int, int, list[int]]] = []
    while True:
        n = keep.count()
        if not n:
            return Cascade(levels)
        bits = min(MAX_BITS, 1 << max(6, ceil(log(max(2.0, -n * log(error) / log(2) ** 2), 2))))
        hashes = max(1, round(bits / n * log(2))) if bits == MAX_BITS else max(1, round(-log(error, 2)))
        at = keep.select(F.explode(F.array(*_positions(bits, hashes, len(levels), F.col("key")))).alias("p"))
        rows = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("b")).collect()  # MAX_BITS / 64 at most
        words = [0] * (bits // 64)
        for r in rows:
            words[r["w"]] = r["b"]
        levels.append((bits, hashes, words))
        passed = others.where(_holds(levels[-1], len(levels) - 1, F.col("key")))
        if len(levels) > 40:
            raise ValueError("the cascade does not end: more keys than MAX_BITS can tell apart")
        others, keep = keep, write_table(spark, passed, "passed")


def judge_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict. ``rules``: host, path, verdict (block or allow).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting rule decides, and
    ``default`` where none fits. The keys of a url are its host's suffixes of the label counts that rules have, each with
    its path's prefixes of the lengths that rules have, so their number is bounded by the list, not by the url. Two
    cascades, of blocked and of allowed keys, are built over all keys of the corpus. Null urls and those without
    ``://`` have an empty host and path. Equal urls get equal verdicts.
    """
    rules = rules.select(F.lower("host").alias("host"), "path", "verdict").distinct()
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().collect()  # at most the list's shapes
    urls = pages.select(F.col("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    keys = F.array_distinct(F.array(*[F.when((F.length("path") >= c) & (F.col("host") != ""), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, c))) for n, c in map(tuple, shapes)])) if shapes else F.array().cast("array<string>")
    keys = F.array_sort(F.filter(keys, lambda k: k.isNotNull()), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    universe = urls.select(F.explode(keys).alias("key"))
    ruled = rules.select(F.concat("host", "path").alias("key"), "verdict")
    blocked, allowed = (build_cascade(spark, ruled.where(F.col("verdict") == v), universe) for v in ("block", "allow"))
    fits = lambda k: F.when(blocked.contains(k), F.lit("block")).when(allowed.contains(k), F.lit("allow"))
    judged = urls.withColumn("fit", F.get(F.filter(F.transform(keys, lambda k: F.struct(k.alias("rule"), fits(k).alias("verdict"))), lambda s: s["verdict"].isNotNull()), 0))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
