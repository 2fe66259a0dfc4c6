"""Work that takes long on few bytes goes to all cores, whatever the files; matches keep their offsets."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cloakspark.functions import spans
from cloakspark.functions.patterns import PATTERNS, Config
from cloakspark.plans import catalogue, pipeline
from cloakspark.sources.scratch import spread, stored

DATA = "/root/testdata/sf0.1"


def tasks(df) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def test_one_row_group_goes_to_all_cores(spark):
    t = spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey")
    rows = [r["count"] for r in spread(t).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 15000 and len(rows) > 8 and max(rows) < 2 * min(rows)
    assert tasks(spread(spark.range(3))) == 1


@pytest.mark.parametrize("name", ["pattern_vectors", "mask_vectors", "mask_ids", "mask_names", "pages_mask"])
def test_queries_have_all_cores(spark, name):
    assert tasks(entry.queries()[name](spark, DATA)) > 8


def test_guards_hold_for_every_match():
    """A guard or gate that a match lacks would lose it."""
    texts = ["A B C D E 1-2 3 4 F", "5105105105105100 341111111111111 6011000990139424", "joe [at] mail dot com x@y", "pay a.b@okicici c@okhdfcbank d@axl", "+91 09876543210 9 8 7 6 5.4-3 2 1 0", "31-12-1999 01/02/2001 2001/02/03 1999-12-31"]
    texts += ["FD123456 ORD123456 TXN1234567 REF123456 UPI123456 IMPS123456 NEFT123456 RTGS123456", "KA1A1234 KA 01 ABC 1234", "KA01 20110012345 KA0120110012345", "1.2.3.4 255.255.255.255", "0a-1b:2C-3d:4e-5f", "x-Ab Cd:Ef", "ABCDEFGH ABCDEF12345"]
    texts += ["".join(x if isinstance(x, str) else "7" * x for x in v) for v in catalogue.VECTORS.values()]
    for p in PATTERNS:
        for m in (m for t in texts for m in re.finditer(p.regex, t)):
            assert p.guard is None or re.search(p.guard, m[0]), (p.name, m[0])
            assert p.gate is None or re.search(p.gate, m[0]), (p.name, m[0])


def test_offsets_are_those_of_a_plain_search(spark):
    """Many matches in a cell, neighbours, line ends, letters beyond 16 bits, and a group inside the match."""
    texts = ["é😀 " + " ".join(str(123456 + i) for i in range(400)), "-Ann Lee,Bob\n:Cy\n.Dee 😀/Eve", "123456123456 123456\n654321", "", "a@b.com,c@d.org (e@f.in)"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {(r["i"], r["ord"], r["start"], r["end"], r["text"]) for r in got.select("i", F.explode(spans.raw_spans(F.col("t"), PATTERNS)).alias("s")).select("i", "s.*").collect()}
    # Patterns with check digits, and the one that gives way to another, have tests of their own.
    plain = [(o, p) for o, p in enumerate(PATTERNS) if p.name not in ("CREDIT_CARD", "AADHAAR", "GSTIN", "UPI_ID")]
    want = {(i, o, *m.span(p.group), m[p.group]) for i, t in enumerate(texts) for o, p in plain for m in re.finditer(p.regex, t, re.ASCII)}
    assert got == want and len(want) > 400


def test_the_pipeline_masks_on_all_cores(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pipeline, "stored", lambda s, df, tag: seen.append(tasks(df)) or stored(s, df, tag))
    t = spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey", "c_name")
    out = pipeline.process(t, "c_custkey", Config(salt="test", patterns=PATTERNS[:2]), types={"c_custkey": "skip", "c_name": "auto"}).masked
    assert seen[0] > 8 and out.count() == 15000


def test_audits_have_all_cores(spark):
    assert all(tasks(t) > 8 for t in catalogue._pair(spark, DATA))


def test_masked_documents_have_all_cores(spark):
    """What manifest_rollup, column_summary, redact_documents and validate_pass_counts read."""
    assert tasks(catalogue._masked(spark, DATA)) > 8
