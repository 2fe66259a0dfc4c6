"""The ten training-data operators as queries over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.llm import covertree, kneserney, mixing, pii, quality, sentencepiece, simhash, suffixarray, syncmers, urlfilter

#: Vocabulary file of the public tokenizer that op6 and the pipeline's last stage use.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Host, path and verdict of the rules of op8.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.embedding_links(spark, _read(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(spark, _read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(spark, _read(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_documents(spark, _read(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_decode(_read(spark, sf_dir, "documents"), MODEL_FILE)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.score_documents(spark, _read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge_urls(spark, _read(spark, sf_dir, "pages"), rules)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixarray.drop_repeats(spark, _read(spark, sf_dir, "documents")).drop("kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "host", "path", *[F.col(c).cast("double").alias(c) for c in ("evidence", "prior_logit", "score")], "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_neardup, op2_simhash, op3_pii, op4_mix_sources, op5_fingerprints, op6_sentencepiece, op7_lm_score, op8_url_filter, op9_suffix_dedup, op10_quality)}


_LABELS_TO = "\n".join(
    f"WHEN '.' || host LIKE '%.{h}' AND starts_with(path, '{p}') THEN '{h}{p}|{v}'" for h, p, v in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
)

ORACLES = {
    # Links as a join of equal labels; components by walking the links.
    "op1_embedding_neardup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings),
g AS (
  SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_dot_product(x, x) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
r(id, root) AS (
  SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c.root, v.vec_id))::BIGINT AS component_id,
  v.vec_id = least(v.vec_id, coalesce(c.root, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.id = v.vec_id""",
    "op8_url_filter": rf"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT *, CASE {_LABELS_TO} END AS fit FROM u)
SELECT page_id, host, path, split_part(fit, '|', 1) AS rule, coalesce(split_part(fit, '|', 2), 'allow') AS verdict FROM f""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
