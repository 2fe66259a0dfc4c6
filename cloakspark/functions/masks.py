"""Deterministic, salted, format-preserving replacements: one Column builder per method.

Every draw is a function of a digest of (salt, method, lower-cased value), so equal values get equal masks in any
table, partition or order. The salt is a literal of the plan and shows in ``explain``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakspark.functions import checksum, names
from cloakspark.functions.expr import let, pick

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM = UPPER + "0123456789"
#: Ages of invented dates of birth, in days before the reference date.
YOUNGEST, AGES = 18 * 366, 62 * 365
# Handles of payment addresses, as the detector knows them.
UPI_HANDLES = ("ybl", "paytm", "okhdfcbank", "okicici", "apl")
STREETS = ("Lake Road", "Station Road", "Temple Street", "Park Lane", "Market Street", "Hill View", "River Road", "Garden Street")
CITIES = ("Pune", "Delhi", "Mumbai", "Chennai", "Kolkata", "Jaipur", "Kochi", "Indore")
FIRMS = ("Traders", "Industries", "Textiles", "Logistics", "Foods", "Motors", "Finance", "Systems")


def digest(value: Column, salt: str, method: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:{method}:"), F.lower(value)), 256)


def number(h: Column, start: int, size: int) -> Column:
    """``size`` hexadecimal digits of a digest from ``start`` (0-based), as a long."""
    return F.conv(F.substring(h, start + 1, size), 16, 10).cast("long")


def byte(h: Column, i) -> Column:
    """Byte ``i`` (modulo 32; a number or a Column)."""
    if isinstance(i, int):
        return F.conv(F.substring(h, i % 32 * 2 + 1, 2), 16, 10).cast("int")
    return F.conv(F.substring(h, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def chars(h: Column, start: int, n: int, alphabet: str) -> Column:
    """``n`` characters of ``alphabet`` drawn from bytes ``start`` and on."""
    one = lambda i: F.substring(F.lit(alphabet), byte(h, i) % len(alphabet) + 1, F.lit(1))
    return one(F.lit(start)) if n == 1 else F.array_join(F.transform(F.sequence(F.lit(start), F.lit(start + n - 1)), one), "")


def digits(h: Column, start: int, n: int) -> Column:
    return chars(h, start, n, "0123456789")


def digit_run(h: Column, n: Column) -> Column:
    """As many digits as the Column ``n`` says; past 32 the digest's bytes repeat, shifted."""
    return F.when(n <= 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((byte(h, i) + (i / 32).cast("int") * 7) % 10).cast("string")), ""))


def hmac_id(value: Column, salt: str) -> Column:
    """ID_ and the first 12 digits of HMAC-SHA-256, from nested digests; the value's case counts."""
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ p for b in key)) for p in (0x36, 0x5C))
    h = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)
    return F.concat(F.lit("ID_"), F.upper(F.substring(h, 1, 12)))


def obfuscate(value: Column, h: Column) -> Column:
    """Digits to digits, letters to letters of their case; all else stays."""
    draw = lambda i, a: F.substring(F.lit(a), (byte(h, i) + (i / 32).cast("int") * 7) % len(a) + 1, F.lit(1))
    one = lambda c, i: F.when(c.rlike("^[0-9]$"), draw(i, "0123456789")).when(c.rlike("^[A-Z]$"), draw(i, UPPER)).when(c.rlike("^[a-z]$"), draw(i, UPPER.lower())).otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _aadhaar(h: Column) -> Column:
    return let(F.concat(chars(h, 0, 1, "23456789"), digits(h, 1, 10)), lambda s: F.concat(s, checksum.verhoeff_digit(s)))


def _card(h: Column) -> Column:
    return let(F.concat(F.lit("4"), digits(h, 0, 14)), lambda s: F.concat(s, checksum.luhn_digit(s)))


def _gstin(h: Column) -> Column:
    state = F.lpad((byte(h, 0) % 35 + 1).cast("string"), 2, "0")
    body = F.concat(state, chars(h, 1, 5, UPPER), digits(h, 6, 4), chars(h, 10, 1, UPPER), chars(h, 11, 1, "123456789" + UPPER), F.lit("Z"))
    return let(body, lambda b: F.concat(b, checksum.gstin_digit(b)))


def _birth(value: Column, h: Column, ref: str, fmt: str | None = None) -> Column:
    day = F.date_sub(F.lit(ref).cast("date"), (F.lit(YOUNGEST) + number(h, 0, 8) % AGES).cast("int"))
    if fmt:
        return F.date_format(day, fmt)
    iso = value.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}$") & ~value.contains("/")
    return F.when(value.contains("/") & ~value.rlike(r"^\d{4}/"), F.date_format(day, "dd/MM/yyyy")).when(iso | value.rlike(r"^\d{4}/"), F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd-MM-yyyy"))


def _first(token: Column, who: Column, salt: str) -> Column:
    return let(number(digest(token, salt, "first"), 0, 8), lambda n: F.when(who == "F", pick(names.FEMALE, n)).when(who == "M", pick(names.MALE, n)).otherwise(pick(names.FIRST, n)))


def _last(token: Column, salt: str) -> Column:
    return F.initcap(pick(names.SURNAMES, number(digest(token, salt, "last"), 0, 8)))


def fake_name(value: Column, salt: str) -> Column:
    """A name of the same gender: the first token decides the first name, the last one the family name.

    One token gives one: a family name for a known family name, else a first name. So parts of a name and the whole
    name get the same replacements wherever they stand.
    """
    tokens = F.split(F.trim(value), r"\s+")
    head, tail = F.lower(F.get(tokens, 0)), F.lower(F.element_at(tokens, -1))
    first = _first(head, names.gender(value), salt)
    single = F.when(head.isin(*names.SURNAMES) & ~head.isin(*[x.lower() for x in names.FIRST]), _last(head, salt)).otherwise(first)
    return F.when(F.size(tokens) == 1, single).otherwise(F.concat_ws(" ", first, _last(tail, salt)))


def builders(salt: str, ref_date: str = "2025-01-01") -> dict[str, Callable[[Column, Column], Column]]:
    """method -> builder of (value, digest)."""
    return {
        "pan": lambda v, h: F.concat(chars(h, 0, 5, UPPER), digits(h, 5, 4), chars(h, 9, 1, UPPER)),
        "aadhaar": lambda v, h: _aadhaar(h),
        "ifsc": lambda v, h: F.concat(chars(h, 0, 4, UPPER), F.lit("0"), chars(h, 4, 6, ALNUM)),
        "credit_card": lambda v, h: _card(h),
        "upi_id": lambda v, h: F.concat(F.lit("user"), F.substring(h, 1, 8), F.lit("@"), pick(UPI_HANDLES, byte(h, 20))),
        "phone_number": lambda v, h: F.concat(F.when(v.startswith("+91"), "+91 ").otherwise(""), chars(h, 0, 1, "6789"), digits(h, 1, 9)),
        "email": lambda v, h: F.concat(F.lit("user"), F.substring(h, 1, 10), F.lit("@example.org")),
        "pincode": lambda v, h: (F.lit(110001) + number(h, 0, 8) % 745117).cast("string"),
        "date_of_birth": lambda v, h: _birth(v, h, ref_date),
        "date_of_birth_iso": lambda v, h: _birth(v, h, ref_date, "yyyy-MM-dd"),
        "passport": lambda v, h: F.concat(chars(h, 0, 1, UPPER), chars(h, 1, 1, "123456789"), digits(h, 2, 6)),
        "vehicle_registration": lambda v, h: F.concat(chars(h, 0, 2, UPPER), F.lit("-"), digits(h, 2, 2), F.lit("-"), chars(h, 4, 2, UPPER), F.lit("-"), digits(h, 6, 4)),
        "bank_account": lambda v, h: digit_run(h, F.when(F.length(v) >= 9, F.length(v)).otherwise(12)),
        "transaction_ref": lambda v, h: F.when(v.rlike(r"^[A-Z]+\d+$"), F.concat(F.regexp_extract(v, r"^[A-Z]+", 0), digit_run(h, F.length(F.regexp_extract(v, r"\d+$", 0))))).otherwise(obfuscate(v, h)),
        "gstin": lambda v, h: _gstin(h),
        "name": lambda v, h: fake_name(v, salt),
        "person": lambda v, h: fake_name(v, salt),
        "address": lambda v, h: F.concat((number(h, 0, 4) % 899 + 1).cast("string"), F.lit(" "), pick(STREETS, byte(h, 4)), F.lit(", "), pick(CITIES, byte(h, 5))),
        "organization": lambda v, h: F.concat(F.initcap(pick(names.SURNAMES, number(h, 0, 8))), F.lit(" "), pick(FIRMS, byte(h, 6))),
        "obfuscate": obfuscate,
        "hash": lambda v, h: hmac_id(v, salt),
        "redact": lambda v, h: F.lit("[REDACTED]"),
    }


METHODS = tuple(builders(""))
#: Methods that give the same replacements.
SAME = {"person": "name"}


def mask(value: Column, method: str, salt: str, ref_date: str = "2025-01-01") -> Column:
    """The replacement of ``value``; null and blank values stay, surrounding space goes, unknown methods redact."""
    build = builders(salt, ref_date).get(method, lambda v, h: F.lit("[REDACTED]"))
    made = let(F.trim(value), lambda v: let(digest(v, salt, SAME.get(method, method)), lambda h: build(v, h)))
    return F.when(value.isNull() | (F.trim(value) == ""), value).otherwise(made)
