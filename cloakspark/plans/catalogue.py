"""Queries over the standard tables, one or more for each operator; ``oracles.py`` has SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.functions import checksum, masks, names, spans
from cloakspark.functions.expr import pick
from cloakspark.functions.patterns import PATTERNS, Config
from cloakspark.operators import audit, detect, manifest, metrics, profile, synth, transforms, validate
from cloakspark.plans import oracles, pipeline
from cloakspark.sources import io
from cloakspark.sources.scratch import shared_folder, spread

CONFIG = Config(salt="catalogue")
SALT = CONFIG.salt
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _dealt(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table, dealt over all cores for expressions that take long on each row."""
    return spread(_read(spark, sf_dir, table).select(*columns))


def _names(customers: DataFrame) -> DataFrame:
    """Customers with an invented full name, as name columns are absent from the standard tables."""
    first, last = pick(names.FIRST, F.col("c_custkey")), F.initcap(pick(names.SURNAMES, (F.col("c_custkey") / 7).cast("long")))
    return customers.withColumn("full_name", F.concat_ws(" ", first, last))


def _masked(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return _dealt(spark, sf_dir, table, key, text).select(key, spans.mask_text(F.col(text), CONFIG).alias(f"_m_{text}"))


@_query
def manifest_rollup(spark, sf_dir):
    return manifest.rollup(manifest.detections(_masked(spark, sf_dir), "doc_id", ["text"], PATTERNS))


@_query
def column_summary(spark, sf_dir):
    out = manifest.column_summaries(manifest.detections(_masked(spark, sf_dir), "doc_id", ["text"], PATTERNS))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return out.select("column", "total", text("by_type").alias("by_type"), text("by_severity").alias("by_severity"), text("by_detector").alias("by_detector"), "top_type")


@_query
def detect_spans(spark, sf_dir):
    docs = _dealt(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(spans.raw_spans(F.col("text"), PATTERNS)).alias("s"))
    return docs.select("doc_id", spans.attribute(F.col("s.ord"), PATTERNS, "name").alias("pattern"), F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"))


@_query
def detect_counts_by_pattern(spark, sf_dir):
    docs = _dealt(spark, sf_dir, "documents", "doc_id", "text").select(F.explode(F.transform(spans.raw_spans(F.col("text"), PATTERNS), lambda s: s["ord"])).alias("o"))
    named = docs.groupBy("o").agg(F.count("*").alias("n"))
    return named.select(spans.attribute(F.col("o"), PATTERNS, "name").alias("pattern"), spans.attribute(F.col("o"), PATTERNS, "severity").alias("severity"), "n")


@_query
def resolved_spans(spark, sf_dir):
    docs = _dealt(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(spans.resolve(spans.raw_spans(F.col("text"), PATTERNS))).alias("s"))
    return docs.select("doc_id", spans.attribute(F.col("s.ord"), PATTERNS, "name").alias("pattern"), F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"))


@_query
def redact_documents(spark, sf_dir):
    return _masked(spark, sf_dir).select("doc_id", "_m_text.masked_text", F.col("_m_text.pii_count").cast("long").alias("pii_count"))


@_query
def redact_addresses(spark, sf_dir):
    one = Config(salt=SALT, patterns=tuple(replace(p, method="redact") for p in PATTERNS if p.name == "IP_ADDRESS"))
    return _dealt(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", spans.mask_text(F.col("text"), one)["masked_text"].alias("masked_text"))


@_query
def conversation_mask(spark, sf_dir):
    t = _dealt(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return t.select("conv_id", "turn", spans.mask_text(F.col("text"), CONFIG, with_names=True)["masked_text"].alias("masked_text"))


@_query
def pages_mask(spark, sf_dir):
    r = spans.mask_text(F.col("html"), CONFIG)
    return _dealt(spark, sf_dir, "pages", "page_id", "html").select("page_id", r.alias("r")).select("page_id", "r.masked_text", F.col("r.pii_count").cast("long").alias("pii_count"))


#: A text of each pattern: numbers stand for so many digits of the customer's key. Cards and tax numbers get a check digit.
VECTORS: dict[str, list[str | int]] = {
    "INDIAN_PAN": ["pan ABCDE", 4, "F here"], "AADHAAR": ["uid 2", 3, " ", 4, " ", 4], "IFSC_CODE": ["ifsc HDFC0", 6], "CREDIT_CARD": ["card ", "4", 14], "EMAIL": ["mail user", 4, "@mail.com now"],
    "UPI_ID": ["pay shop", 4, ".@ybl please"], "INDIAN_PHONE": ["call +91 98765", 5], "INDIAN_PINCODE": ["pin 56", 4], "DATE_OF_BIRTH": ["born 15/08/19", 2], "DATE_OF_BIRTH_ISO": ["born 19", 2, "-08-15"],
    "INDIAN_PASSPORT": ["passport K1", 6], "INDIAN_VEHICLE": ["car KA-01-AB-", 4], "BANK_ACCOUNT": ["account ", 11], "VOTER_ID": ["voter ABC", 7], "DRIVING_LICENSE": ["licence KA05 ", 11],
    "GSTIN": ["tax ", "27AAPFU", 4, "F1Z"], "CIN": ["firm U", 5, "KA2012PTC", 6], "UDYAM_REG": ["UDYAM-KA-03-", 7], "TAN": ["tan BLRA", 5, "B"], "EPFO_UAN": ["uan 10", 10], "IP_ADDRESS": ["from 10.0.", 1, ".", 2],
    "MAC_ADDRESS": ["mac 0A:1B:2C:3D:", 2, ":", 2], "VEHICLE_CHASSIS_VIN": ["vin MA3EYD32S00", 6], "SWIFT_BIC": ["swift HDFCIN", 2], "TRANSACTION_REF": ["ref TXN", 8], "ATTACHED_NAME": ["paid -Priya Sharma, ", 3],
    "PLAIN": ["nothing to see in ", 2, " words"],
}


def _vectors(spark, sf_dir):
    n = F.col("c_custkey") * 7919
    part = lambda x: F.lit(x) if isinstance(x, str) else F.lpad((n % 10**x).cast("string"), x, "0")
    check = {"CREDIT_CARD": checksum.luhn_digit, "GSTIN": checksum.gstin_digit}

    def text(kind, parts):
        body = F.concat(*map(part, parts[1:] if kind in check else parts))
        return F.concat(F.lit(parts[0]), body, check[kind](body)) if kind in check else body

    rows = [F.struct(F.lit(k).alias("kind"), text(k, p).alias("text")) for k, p in VECTORS.items()]
    t = _dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.explode(F.array(*rows)).alias("r"))
    return t.select(F.concat_ws(":", "c_custkey", "r.kind").alias("id"), "r.kind", "r.text")


@_query
def pattern_vectors(spark, sf_dir):
    """Every pattern on a text made for it."""
    t = _vectors(spark, sf_dir).select("id", "kind", F.explode(spans.raw_spans(F.col("text"), PATTERNS)).alias("s"))
    return t.select("kind", "id", spans.attribute(F.col("s.ord"), PATTERNS, "name").alias("pattern"), F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"))


@_query
def mask_vectors(spark, sf_dir):
    """Every pattern's replacement in its text."""
    r = spans.mask_text(F.col("text"), CONFIG)
    return _vectors(spark, sf_dir).select("id", r.alias("r")).select("id", "r.masked_text", F.col("r.pii_count").cast("long").alias("pii_count"))


@_query
def luhn_cards(spark, sf_dir):
    runs = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), F.lit(0))).alias("digits"))
    return runs.select("doc_id", "digits", checksum.luhn_valid(F.col("digits")).alias("valid"))


@_query
def verhoeff_check(spark, sf_dir):
    body = (F.lit(20000000000) + F.col("o_orderkey") * 7919).cast("string")
    t = _read(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    return t.select("o_orderkey", checksum.verhoeff_digit(F.col("body")).alias("digit"), checksum.verhoeff_valid(F.col("body")).alias("valid"))


@_query
def gstin_check(spark, sf_dir):
    body = F.concat(F.lit("27AAPFU"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("F1Z"))
    return _read(spark, sf_dir, "customer").select("c_custkey", checksum.gstin_digit(body).alias("digit"), checksum.gstin_valid(F.concat(body, F.lit("V"))).alias("valid"))


@_query
def confidence_routing(spark, sf_dir):
    t = _read(spark, sf_dir, "supplier").select(spans.action(F.abs("s_acctbal") / 10000, CONFIG).alias("action"))
    return t.groupBy("action").agg(F.count("*").alias("n"))


@_query
def profile_customer(spark, sf_dir):
    t = _read(spark, sf_dir, "customer")
    columns = ["c_name", "c_mktsegment", "c_nationkey"]
    counts = spark.createDataFrame([(c, n, d) for c, (n, d) in profile.cardinality(t.select("c_mktsegment", "c_nationkey"), columns[1:]).items()], "column string, n_rows long, n_distinct long")
    f = profile.features(t.select("c_custkey", *columns), "c_custkey", CONFIG, columns)
    return f.join(counts, "column", "left").select("column", F.col("n").alias("n_sample"), F.round("average_length", 6).alias("average_length"), F.round("name_share", 6).alias("name_share"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_rows", "n_distinct")])


@_query
def classify_tables(spark, sf_dir):
    keys = {"customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}
    rows = [(t, c, kind) for t, k in keys.items() for c, kind in profile.classify(_read(spark, sf_dir, t), k, CONFIG).items()]
    return spark.createDataFrame(rows, "table string, column string, type string")


@_query
def name_probe(spark, sf_dir):
    t = _names(_read(spark, sf_dir, "customer")).withColumn("cell", F.when(F.col("c_acctbal") > 2000, F.col("full_name")).otherwise(F.col("c_name")))
    return t.groupBy("c_mktsegment").agg(F.round(F.avg(names.is_known(names.first_token(F.col("cell"))).cast("double")), 9).alias("name_share"))


@_query
def pseudonymize_events(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", transforms.pseudonymize(F.col("user_id").cast("string"), SALT).alias("user_id"))


IDS = ("pan", "aadhaar", "ifsc", "credit_card", "phone_number", "pincode", "passport", "vehicle_registration", "bank_account", "email", "upi_id", "gstin", "date_of_birth", "date_of_birth_iso", "transaction_ref", "address", "organization")


@_query
def mask_ids(spark, sf_dir):
    return _dealt(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", *[masks.mask(F.col("c_name"), m, SALT).alias(m) for m in IDS])


@_query
def mask_obfuscate(spark, sf_dir):
    return _dealt(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", masks.mask(F.col("c_name"), "obfuscate", SALT).alias("masked"))


@_query
def mask_names(spark, sf_dir):
    return _names(_dealt(spark, sf_dir, "customer", "c_custkey")).select("c_custkey", names.gender(F.col("full_name")).alias("gender"), masks.mask(F.col("full_name"), "name", SALT).alias("masked"), masks.mask(F.lower("full_name"), "name", SALT).alias("masked_lower"))


@_query
def dp_totalprice(spark, sf_dir):
    t = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return transforms.protect_numeric(t, "o_orderkey", ["o_totalprice"], CONFIG)[0]


def _pin():
    return F.lit(110001) + F.col("c_custkey") * 37 % 745117


@_query
def pincode_substitute(spark, sf_dir):
    t = _read(spark, sf_dir, "customer")
    return t.select("c_custkey", transforms.substitute_pincode(_pin(), SALT).alias("whole"), transforms.substitute_pincode(_pin().cast("double").cast("string"), SALT).alias("fractional"))


@_query
def basic_mask(spark, sf_dir):
    t = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("Age"), _pin().alias("Pincode"), F.col("c_acctbal").alias("Amount"))
    return transforms.basic_mask(t, "c_custkey", SALT)


@_query
def validate_pass_counts(spark, sf_dir):
    m = _masked(spark, sf_dir)
    step = m.select("doc_id", F.col("_m_text.masked_text").alias("text"), validate.provenance(F.col("_m_text.detections")).alias("_p_text"))
    _, passes = validate.validate(step, {"text": "free_text"}, CONFIG)
    return spark.createDataFrame([(p["pass_number"], p["pii_found"], ",".join(p["types_found"]), p["is_clean"]) for p in passes], "pass_number long, pii_found long, types_found string, is_clean boolean")


@_query
def process_customer(spark, sf_dir):
    """The whole pipeline over a table with names, codes, prose and numbers."""
    t = _names(_read(spark, sf_dir, "customer"))
    t = t.select("c_custkey", F.col("full_name").alias("Name"), F.concat(F.lit("ABCDE"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("F")).alias("code"), F.concat(F.lit("Customer called about the account of "), "full_name", F.lit(", mail c"), "c_custkey", F.lit("@mail.com")).alias("notes"), "c_acctbal", "c_mktsegment")
    return pipeline.process(t, "c_custkey", CONFIG).masked


def _pair(spark, sf_dir):
    """Raw customers, and a version in which those in debt kept their names."""
    raw = _names(_dealt(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")).select("c_custkey", F.col("full_name").alias("Name"), F.concat(F.col("c_name"), F.lit("@mail.com")).alias("Email"), "c_acctbal", "c_mktsegment")
    masked = raw.withColumn("Name", F.when(F.col("c_acctbal") < 0, F.col("Name")).otherwise(F.concat(F.lit("X"), masks.mask(F.col("Name"), "name", SALT)))).withColumn("Email", masks.mask(F.col("Email"), "email", SALT))
    return raw, masked


@_query
def leakage_audit(spark, sf_dir):
    return audit.leakage(*_pair(spark, sf_dir), "c_custkey", ["Name", "Email"])


@_query
def leak_containment(spark, sf_dir):
    raw, masked = _pair(spark, sf_dir)
    notes = masked.select("c_custkey", F.concat(F.lit("Call from "), "Name", F.lit(", about billing")).alias("note"))
    return audit.containment(raw, notes, "c_custkey", ["Name"])


@_query
def attack_sim(spark, sf_dir):
    return audit.attack(*_pair(spark, sf_dir), "c_custkey", ["Name", "Email"])


@_query
def k_anonymity(spark, sf_dir):
    return metrics.k_anonymity(_read(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


def _balances(spark, sf_dir):
    one = lambda t, c, x: _read(spark, sf_dir, t).select(F.col(c).alias("v"), F.lit(x).alias("x"), F.lit(1 - x).alias("y"))
    return one("customer", "c_acctbal", 1).union(one("supplier", "s_acctbal", 0))


@_query
def ks_stat(spark, sf_dir):
    return metrics.ks_of(_balances(spark, sf_dir)).select(*[F.round(c, 9).alias(c) for c in ("statistic", "utility")])


@_query
def kl_js_div(spark, sf_dir):
    return metrics.divergences(_balances(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("kl", "js")])


@_query
def jaccard_utility(spark, sf_dir):
    t = _read(spark, sf_dir, "documents")
    return t.select("doc_id", F.round(metrics.jaccard(F.col("text"), F.regexp_replace("text", "[0-9]+", "#")), 9).alias("likeness"))


@_query
def embedding_cosine(spark, sf_dir):
    t = _read(spark, sf_dir, "embeddings")
    first = t.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    return t.join(first, "label").select("vec_id", F.round(metrics.cosine(F.col("embedding"), F.col("anchor")), 9).alias("cosine"))


@_query
def changed_columns(spark, sf_dir):
    return metrics.changed_columns(*_pair(spark, sf_dir), "c_custkey")


@_query
def quality_scores(spark, sf_dir):
    c = metrics.changed_columns(*_pair(spark, sf_dir), "c_custkey").where("column IN ('Name', 'Email', 'c_mktsegment')")
    return c.agg(F.round(F.sum(F.when(F.col("changed") > 0, F.col("changed"))) / F.sum(F.when(F.col("changed") > 0, F.col("total"))), 9).alias("privacy"), F.count_if(F.col("changed") > 0).alias("columns"))


@_query
def balance_density(spark, sf_dir):
    d = metrics.kernel_density(_read(spark, sf_dir, "customer"), "c_acctbal")
    return d.select(F.round("point", 6).alias("point"), F.round("density", 12).alias("density"))


@_query
def chunk_documents(spark, sf_dir):
    return detect.chunks(_read(spark, sf_dir, "documents"), "doc_id", "text")


@_query
def model_detections(spark, sf_dir):
    """Conversations with a detector plug-in's spans: the dictionary detector, routed by confidence."""
    t = detect.with_model_spans(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["text"])
    r = spans.mask_text(F.col("text"), CONFIG, more=F.col("_n_text"))
    return t.select("conv_id", "turn", r["masked_text"].alias("masked_text"), F.size(r["detections"]).cast("long").alias("pii_count"))


@_query
def generate_fixture(spark, sf_dir):
    return synth.generate(spark, 200)


@_query
def copula_sample(spark, sf_dir):
    t = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return synth.draw(spark, synth.fit(t, "o_orderkey"), 1000)


@_query
def export_roundtrip(spark, sf_dir):
    t = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    base, schema = shared_folder(spark), "c_custkey long, c_name string, c_mktsegment string"
    paths = {k: f"{base}/export-{k}-{spark.sparkContext.applicationId}-{id(t)}" for k in ("csv", "jsonl", "parquet")}
    for k, p in paths.items():
        io.write(t, p, k)
    back = [io.read_csv(spark, paths["csv"], schema), spark.read.schema(schema).json(paths["jsonl"]), spark.read.parquet(paths["parquet"])]
    rows = [b.withColumn("sink", F.lit(k)) for b, k in zip(back, paths, strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


ORACLES = oracles.build(IDS, VECTORS)
