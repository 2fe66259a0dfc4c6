"""Patterns, check digits, masks and the span algebra."""

import re

import pytest
from pyspark.sql import functions as F

from cloakspark.functions import checksum, masks, names, spans
from cloakspark.functions.patterns import NOISY, PATTERNS, Config

CONFIG = Config(salt="test")

VECTORS = {
    "INDIAN_PAN": (["ABCDE1234F", "A B C D E 1 2 3 4 F"], ["ABCD1234F", "ABCDE12345"]),
    "AADHAAR": (["2341 2341 2346", "2341-2341-2346"], ["1341 2341 2346", "23412341234"]),
    "IFSC_CODE": (["HDFC0ABC123"], ["HDFC1ABC123", "HDF0ABC1234"]),
    "CREDIT_CARD": (["4111111111111111", "378282246310005"], ["4111111111111112", "411111111111"]),
    "EMAIL": (["a.b@mail.com", "joe (at) mail (dot) com"], ["a.b at mail", "mail.com"]),
    "UPI_ID": ([], ["someone@nobank"]),
    "INDIAN_PHONE": (["9876543210", "98765-43210"], ["5876543210", "987654321"]),
    "INDIAN_PINCODE": (["560001"], ["060001", "5600011"]),
    "DATE_OF_BIRTH": (["31/12/1999"], ["32/12/1999", "31/13/1999"]),
    "DATE_OF_BIRTH_ISO": (["1999-12-31"], ["1899-12-31", "1999-13-31"]),
    "INDIAN_PASSPORT": (["A1234567"], ["A0234567", "AA1234567"]),
    "INDIAN_VEHICLE": (["KA-01-AB-1234"], ["K-01-AB-1234"]),
    "BANK_ACCOUNT": (["123456789"], ["12345678", "1234567890123456789"]),
    "VOTER_ID": (["ABC1234567"], ["AB1234567"]),
    "DRIVING_LICENSE": (["KA01 20110012345"], ["KA01 2011001234"]),
    "GSTIN": (["27AAPFU0939F1ZV"], ["27AAPFU0939F1ZA", "27AAPFU0939F1V"]),
    "CIN": (["L17110MH1973PLC019786"], ["X17110MH1973PLC019786"]),
    "UDYAM_REG": (["UDYAM-KA-01-1234567"], ["UDYAM-KA-01-123456"]),
    "TAN": (["ABCD12345E"], ["ABC12345E"]),
    "EPFO_UAN": (["101234567890"], ["111234567890"]),
    "IP_ADDRESS": (["10.0.0.1"], ["10.0.0"]),
    "MAC_ADDRESS": (["00:1B:44:11:3A:B7"], ["00:1B:44:11:3A"]),
    "VEHICLE_CHASSIS_VIN": (["1HGCM82633A004352"], ["1HGCM82633A00435I"]),
    "SWIFT_BIC": (["DEUTDEFF", "DEUTDEFF500"], ["DEUTDE"]),
    "TRANSACTION_REF": (["TXN123456"], ["TXN12345"]),
    "ATTACHED_NAME": (["x_Rahul Verma"], ["x_rahul"]),
}


def found(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    s = spans.raw_spans(F.col("t"), PATTERNS, **more)
    rows = df.select("id", F.transform(s, lambda x: F.struct(spans.attribute(x["ord"], PATTERNS, "name").alias("n"), x["start"], x["end"], x["text"])).alias("s")).collect()
    return {r["id"]: [tuple(x) for x in r["s"]] for r in rows}


def test_vectors(spark):
    assert len(PATTERNS) == 26 and {p.name for p in PATTERNS} == set(VECTORS) and set(NOISY) <= set(VECTORS)
    cases = [(n, t, good) for n, (yes, no) in VECTORS.items() for good, ts in ((True, yes), (False, no)) for t in ts]
    got = found(spark, [f"see {t} ok" for _, t, _ in cases])
    for i, (n, t, good) in enumerate(cases):
        assert any(x[0] == n for x in got[i]) == good, (n, t)


def test_offsets_equal_python(spark):
    texts = ["é a.b@mail.com 😀 10.0.0.1 and 4111111111111111, x_Rahul Verma", "", None, "9.9.9.9" * 3, "123456789 " * 50]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        want = set()
        for p in PATTERNS:
            if p.name == "UPI_ID":
                continue
            for m in re.finditer(p.regex, t or ""):
                if p.name == "CREDIT_CARD" and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(m[0]))) % 10:
                    continue
                want.add((p.name, m.start(p.group), m.end(p.group), m[p.group]))
        assert set(got[i]) == want


def test_email_suppresses_upi(spark):
    assert {x[0] for x in found(spark, ["pay me@ybl"])[0]} == {"EMAIL"}
    strict = Config(salt="x", strict=True)
    df = spark.createDataFrame([("mail x@yahoo.co.in, pay me@ybl from 84.93.123.184",)], "t string")
    got = df.select(spans.mask_text(F.col("t"), strict).alias("r")).first()["r"]
    kinds = [strict.effective()[d["ord"]].name for d in got["detections"]]
    assert kinds == ["EMAIL", "UPI_ID", "IP_ADDRESS"] and ".in" not in got["masked_text"]


def test_pincode_needs_context(spark):
    got = found(spark, ["pin 560001", "area code 560001", "paid 560001", "pincode: 560001"], kind="free_text", context=True)
    assert [any(x[0] == "INDIAN_PINCODE" for x in got[i]) for i in range(4)] == [True, True, False, False]


def test_check_digits(spark):
    digits = [f"{i * 7919 + 10**10}" for i in range(200)]
    df = spark.createDataFrame([(d,) for d in digits], "d string")
    rows = df.select("d", checksum.luhn_digit(F.col("d")).alias("l"), checksum.verhoeff_digit(F.col("d")).alias("v")).collect()
    both = spark.createDataFrame([(r["d"] + r["l"], r["d"] + r["v"], r["d"] + str((int(r["v"]) + 1) % 10)) for r in rows], "l string, v string, w string")
    one = both.select(checksum.luhn_valid(F.col("l")).alias("l"), checksum.verhoeff_valid(F.col("v")).alias("v"), checksum.verhoeff_valid(F.col("w")).alias("w")).collect()
    assert all(r["l"] and r["v"] and not r["w"] for r in one)
    known = spark.range(1).select(checksum.verhoeff_valid(F.lit("2363")), checksum.gstin_valid(F.lit("27AAPFU0939F1ZV")), checksum.gstin_valid(F.lit("27AAPFU0939F1ZW"))).first()
    assert tuple(known) == (True, True, False)


FORMATS = {
    "pan": "INDIAN_PAN", "aadhaar": "AADHAAR", "ifsc": "IFSC_CODE", "credit_card": "CREDIT_CARD", "upi_id": "UPI_ID", "phone_number": "INDIAN_PHONE", "email": "EMAIL", "pincode": "INDIAN_PINCODE",
    "date_of_birth": None, "date_of_birth_iso": "DATE_OF_BIRTH_ISO", "passport": "INDIAN_PASSPORT", "vehicle_registration": "INDIAN_VEHICLE", "bank_account": "BANK_ACCOUNT", "gstin": "GSTIN",
}


def test_masks_keep_formats_and_salt(spark):
    values = ["Ab1-c", " x ", "9876543210", None, "", "Customer#1", "31/12/1999"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    a = df.select("v", *[masks.mask(F.col("v"), m, "s1").alias(m) for m in masks.METHODS])
    one, again, other = a.collect(), a.repartition(3).collect(), df.select("v", *[masks.mask(F.col("v"), m, "s2").alias(m) for m in masks.METHODS]).collect()
    assert sorted(map(str, one)) == sorted(map(str, again))
    regex = {p.name: p.regex for p in PATTERNS}
    for r, o in zip(one, other, strict=True):
        if not (r["v"] or "").strip():
            assert all(r[m] == r["v"] for m in masks.METHODS)
            continue
        for m, p in FORMATS.items():
            if p:
                assert re.fullmatch(regex[p], r[m]), (m, r[m])
        assert r["pan"] != o["pan"] and r["redact"] == "[REDACTED]" and re.fullmatch("ID_[0-9A-F]{12}", r["hash"])
        v = r["v"].strip()
        assert re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", v))) == re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", r["obfuscate"])))
    assert re.fullmatch(r"\d\d/\d\d/\d{4}", one[6]["date_of_birth"])


def test_hmac_equals_python(spark):
    import hashlib
    import hmac

    for salt in ("k", "long" * 40):
        got = spark.createDataFrame([("Ünï",)], "v string").select(masks.hmac_id(F.col("v"), salt).alias("h")).first()["h"]
        assert got == "ID_" + hmac.new(salt.encode(), "Ünï".encode(), hashlib.sha256).hexdigest()[:12].upper()


def test_names_are_consistent(spark):
    rows = ["Gaurav Verma", "Gaurav", "Verma", "gaurav verma", "Priya Rao", "Zzq"]
    df = spark.createDataFrame([(v,) for v in rows], "v string")
    got = {r["v"]: r for r in df.select("v", masks.mask(F.col("v"), "name", "s").alias("m"), names.gender(F.col("v")).alias("g")).collect()}
    assert got["Gaurav Verma"]["m"] == f"{got['Gaurav']['m']} {got['Verma']['m']}" == got["gaurav verma"]["m"]
    assert got["Priya Rao"]["m"].split()[0] in names.FEMALE and got["Gaurav"]["m"] in names.MALE and got["Zzq"]["g"] == "U"


def test_text_masking(spark):
    t = "Hi I'm Gaurav Verma hai, PAN ABCDE1234F, mail a.b@mail.com, call 9876543210, card 4111111111111111 😀 end"
    df = spark.createDataFrame([(1, t), (2, None), (3, " "), (4, "nothing")], "id long, t string")
    rows = {r["id"]: r["r"] for r in df.select("id", spans.mask_text(F.col("t"), CONFIG, with_names=True).alias("r")).collect()}
    assert (rows[2]["masked_text"], rows[3]["masked_text"], rows[4]["masked_text"]) == (None, " ", "nothing") and rows[2]["pii_count"] == 0
    out = rows[1]
    for secret in ("Gaurav", "ABCDE1234F", "a.b@mail", "9876543210", "4111111111111111"):
        assert secret not in out["masked_text"] and secret not in str(out["detections"])
    assert out["masked_text"].startswith("Hi I'm ") and out["masked_text"].endswith(" 😀 end") and " hai, PAN " in out["masked_text"]
    assert [d["start"] for d in out["detections"]] == sorted(d["start"] for d in out["detections"]) and out["pii_count"] == 5


def test_overlaps_and_routing(spark):
    df = spark.createDataFrame([("9876543210 and 234123412346",)], "t string")
    kinds = [PATTERNS[d["ord"]].name for d in df.select(spans.mask_text(F.col("t"), CONFIG)["detections"].alias("d")).first()["d"]]
    assert kinds == ["INDIAN_PHONE", "AADHAAR"]
    r = spark.createDataFrame([(0.9,), (0.8,), (0.5,), (0.1,)], "c double").select(spans.action(F.col("c"), CONFIG)).collect()
    assert [x[0] for x in r] == ["REDACTED", "REDACTED", "REVIEW", "LOG_ONLY"]
    more = F.array(F.struct(F.lit(1).alias("prio"), F.lit(-5).alias("neg"), F.lit(spans.ner_ord("person")).alias("ord"), F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("Aoife").alias("text"), F.lit(0.2).alias("confidence")))
    got = spark.createDataFrame([("Aoife at 10.0.0.1",)], "t string").select(spans.mask_text(F.col("t"), CONFIG, more=more).alias("r")).first()["r"]
    assert got["masked_text"].startswith("Aoife at ") and [d["action"] for d in got["detections"]] == ["LOG_ONLY", "REDACTED"] and got["detections"][0]["masked"] == "[LOGGED_NOT_MASKED]"


@pytest.mark.parametrize("text,want", [("my name is Asha Rao here and Priya Sharma-Rahul", ["Asha Rao", "Priya Sharma-Rahul"]), ("this is nothing", []), (None, [])])
def test_name_spans(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(F.transform(spans.name_spans(F.col("t")), lambda s: s["text"]).alias("n")).first()["n"]
    assert got == want
