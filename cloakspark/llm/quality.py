"""Quality classifier: document evidence joined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cloakspark.llm.common import LOWER, write_table

#: Labelled rows that the document classifier is fitted on.
SAMPLE = 20_000
#: Bytes that a word loses at both ends: all but digits, small letters and those of other alphabets.
_EDGES = bytes(sorted(set(range(128)) - set(b"0123456789abcdefghijklmnopqrstuvwxyz")))
_UPPER, _MARKS = np.zeros(256), np.zeros(256)
_UPPER[65:91] = 1
_MARKS[list(b"!#$%&*|<>=_~^@\\{}[]")] = 1
_LETTERS = np.zeros(256)
_LETTERS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1


def plain_words(words: list[bytes]) -> set[bytes]:
    return {w.strip(_EDGES) for w in set(words)} - {b""}


def features(text: str | None, bad_words: frozenset[bytes] = frozenset()) -> list[float]:
    """Twelve numbers of a whole text: lexicon hits, repetition, capitals, marks, shape."""
    raw = (text or "").encode()
    words = raw.translate(LOWER).split()
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
    letters = max(1.0, float(counts @ _LETTERS))
    kinds = set(words)
    hits = len(plain_words(words) & bad_words) if bad_words else 0
    twice = sum(map(eq, words, words[1:])) / max(1, n - 1)
    marks = float(counts @ _MARKS) / max(1, n)
    return [1.0, float(hits > 0), min(hits, 10) / np.log(8 + n), twice, float(twice > 0.1), float(counts @ _UPPER) / letters, min(marks, 4), float(marks > 0.25), len(kinds) / max(1, n), np.log1p(n), min(20, len(raw) / max(1, n)) / 10, float(n == 0)]


class DocumentModel:
    def __init__(self, bad_words: frozenset[bytes], weights: np.ndarray):
        self.bad_words, self.weights = bad_words, weights

    def logits(self, texts: list[str | None]) -> np.ndarray:
        return np.clip(np.array([features(t, self.bad_words) for t in texts]).reshape(len(texts), -1) @ self.weights, -12, 12)


def fit_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DocumentModel:
    """Logistic regression of good (quality 1, not toxic) against bad on ``sample`` labelled documents at most.

    Its lexicon holds all words seen far more often in bad ones, from document frequencies: each in a five-hundredth of
    the bad ones at least, so at most 500 times as many as an average document has. Without labels of both kinds every
    document gets the same evidence.
    """
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(good).alias("good"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    train = write_table(spark, docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "labelled")  # 20 000 rows of 12 bytes

    def words(batches):
        for pdf in batches:
            seen = [Counter(), Counter()]
            for t, g in zip(pdf.text, pdf.good, strict=True):
                seen[g].update(plain_words((t or "").encode().translate(LOWER).split()))
            for g in (0, 1):
                yield pd.DataFrame({"word": list(seen[g]), "good": np.int32(g), "n": list(seen[g].values())})

    sizes = {r["good"]: r["count"] for r in train.groupBy("good").count().collect()}
    if len(sizes) < 2:
        return DocumentModel(frozenset(), np.zeros(12))
    seen = train.mapInPandas(words, "word binary, good int, n long").groupBy("word").agg(F.sum(F.col("n") * F.col("good")).alias("g"), F.sum(F.col("n") * (1 - F.col("good"))).alias("b"))
    odds = F.log((F.col("b") + 0.5) / (sizes[0] + 1)) - F.log((F.col("g") + 0.5) / (sizes[1] + 1))
    least = max(3, 0.002 * sizes[0])
    chosen = seen.where((F.col("b") >= least) & (odds > 2.5)).collect()
    bad_words = frozenset(bytes(r["word"]) for r in chosen)

    def rows(batches):
        for pdf in batches:
            yield pd.DataFrame({"x": [features(t, bad_words) for t in pdf.text], "good": pdf.good})

    data = train.mapInPandas(rows, "x array<double>, good int").toPandas()  # ``sample`` rows of 12 numbers
    x, y = np.stack(data.x.to_numpy()), data.good.to_numpy(float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return DocumentModel(bad_words, w)


def _evidence(docs: DataFrame, model: DocumentModel) -> DataFrame:
    """``docs`` with ``_logit``, all other columns kept."""
    names = docs.columns
    at = names.index("text")

    def of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.logits(b.column(at).to_pylist()))], names=[*names, "_cs_logit"])

    return docs.mapInArrow(of, StructType([*docs.schema.fields, StructField("_cs_logit", DoubleType())]))


def site_sums(scored: DataFrame, host: str, path: str) -> DataFrame:
    """_cs_host, _cs_path, k, n: the sum of documents' probabilities and their number, one row a site."""
    p = 1 / (1 + F.exp(-F.col("_cs_logit")))
    return scored.groupBy(F.col(host).alias("_cs_host"), F.col(path).alias("_cs_path")).agg(F.sum(p).alias("k"), F.count("*").alias("n"))


def site_posteriors(paths: DataFrame) -> DataFrame:
    """_cs_host, _cs_path, _cs_prior: shrunken log odds of a path against the global rate, from ``site_sums``.

    A host's rate is shrunk to the global one and a path's to its host's; prior strengths follow by the method of
    moments from how much rates vary between hosts and between paths, so sparse sites stay near their parents.
    """
    hosts = paths.groupBy("_cs_host").agg(F.sum("k").alias("hk"), F.sum("n").alias("hn"))
    world = hosts.agg(F.sum("hk").alias("k"), F.sum("hn").alias("n"), F.sum(F.col("hn") * F.pow(F.col("hk") / F.col("hn"), 2)).alias("q"), F.count("*").alias("m")).first()
    if not world["n"]:
        return paths.select("_cs_host", "_cs_path", F.lit(0.0).alias("_cs_prior"))
    rate = min(max(world["k"] / world["n"], 1e-3), 1 - 1e-3)

    def strength(q: float, base: float, groups: int, n: float) -> float:
        """Beta prior strength whose variance is that seen between groups beyond what sampling gives."""
        spread, noise = max(0.0, q / n - base * base), base * (1 - base) * groups / n
        return float(np.clip(base * (1 - base) / max(spread - noise, 1e-6) - 1, 2, 1e5))

    top = strength(world["q"], rate, world["m"], world["n"])
    hosts = hosts.select("_cs_host", ((F.col("hk") + top * rate) / (F.col("hn") + top)).alias("hp"))
    both = paths.alias("p").join(hosts.alias("h"), F.col("p._cs_host").eqNullSafe(F.col("h._cs_host"))).select("p._cs_host", "_cs_path", "k", "n", "hp")
    inner = both.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("hp"), 2)).alias("q"), F.count("*").alias("m")).first()
    low = strength(inner["q"] + world["n"] * rate * rate, rate, inner["m"], world["n"])
    post = F.least(F.greatest((F.col("k") + low * F.col("hp")) / (F.col("n") + low), F.lit(1e-4)), F.lit(1 - 1e-4))
    return both.select("_cs_host", "_cs_path", (F.log(post / (1 - post)) - float(np.log(rate / (1 - rate)))).alias("_cs_prior"))


def _judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: list[str], host: str, path: str, threshold: float, sample: int) -> DataFrame:
    model = fit_documents(spark, docs, labels, sample)
    few = ["text", *dict.fromkeys([host, path])]
    sums = write_table(spark, site_sums(_evidence(docs.select(*few), model).drop("text"), host, path), "sitesums")
    sites = write_table(spark, site_posteriors(sums), "sites")
    all_of = _evidence(docs.select(*keep), model)
    on = all_of[host].eqNullSafe(F.col("_cs_host")) & all_of[path].eqNullSafe(F.col("_cs_path"))
    small = sites.count() <= 100_000
    joined = all_of.join(F.broadcast(sites) if small else sites, on)  # small: 100 000 rows at most
    return joined.withColumn("_cs_score", 1 / (1 + F.exp(-F.col("_cs_logit") - F.col("_cs_prior")))).withColumn("_cs_kept", F.col("_cs_score") >= threshold)


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, host, path, evidence, prior_logit, score, kept of each document; kept from a score of ``threshold``.

    A null text counts as empty. Null hosts or paths form sites of their own. Repeated rows get equal scores. Without
    usable labels all evidence is equal and all is kept. Labels may repeat; a document is good if all of its rows are.
    """
    out = _judged(spark, docs, labels, list(dict.fromkeys(["doc_id", "text", host, path])), host, path, threshold, sample)
    return out.select(F.col("doc_id").cast("long"), F.col(host).alias("host"), F.col(path).alias("path"), F.col("_cs_logit").alias("evidence"), F.col("_cs_prior").alias("prior_logit"), F.col("_cs_score").alias("score"), F.col("_cs_kept").alias("kept"))


def keep_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score reaches ``threshold``, with their own columns.

    Each text is scored twice, for its site and for itself; it is shuffled only beyond 100 000 sites. Cases as in
    ``score_quality``.
    """
    return _judged(spark, docs, labels, docs.columns, host, path, threshold, sample).where("_cs_kept").select(*docs.columns)
