"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.llm.common import write_table

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts and ends at the ends of digit runs, so the look-behind changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\(?[0-9]{3}\)?[ .-])?[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SPELT_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63})+")
# What base spans cannot be: addresses whose dots are set apart or that are of the sixth version, cards with other marks between their digits.
_SPELT_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|[(\[]dot[)\]]) ?[0-9]{1,3}){3}(?![0-9.])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_MARKED_CARD = re.compile(r"(?<![0-9._/])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9._/]?[0-9])")
_STRICT = {"ip": re.compile(r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:[^0-9]+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}|(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}"), "phone": re.compile(r"(?:\([0-9]{3}\) |[0-9]{3}-)?[0-9]{3}-[0-9]{4}"), "email": re.compile(r"[^ ]+ ?[(\[]at[)\]] ?[^ ]+(?: ?[(\[]dot[)\]] ?[^ ]+)+"), "card": re.compile(r"[0-9]{16}|(?:[0-9]{4}([ ._/-]))(?:[0-9]{4}\1){2}[0-9]{4}")}
#: Gazetteers: reserved exchanges and toll-free codes; top-level domains; first parts of well-known networks; first digits of card networks.
_EXCHANGES = frozenset("555 800 888 877 866 855 844 833".split())
_DOMAINS = frozenset("com org net edu gov io co uk de fr es it in info biz example".split())
_NETS = frozenset("10 127 169 172 192 203 198 fd00 fe80 2001".split())
_NETWORKS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
_CUES = {"phone": re.compile(r"(?i)\b(?:phone|call|tel|mobile|fax|contact|reach|dial)"), "email": re.compile(r"(?i)\b(?:e-?mail|contact|write|reach)"), "card": re.compile(r"(?i)\b(?:card|visa|credit|pay)"), "ip": re.compile(r"(?i)\b(?:ip|host|server|address|from|login|ping)")}
_AGAINST = re.compile(r"(?i)\b(?:order|version|isbn|item|invoice|serial|page|code|ticket|part)\W*$")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed definitions, by start, then kind. Linear in the text's length."""
    out = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            s = m.start()
            while s > free and text[s - 1] in _LOCAL:
                s -= 1
            if s < m.start():
                out.append((s, 0, free := m.end()))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() >= 14 else ""
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, votes) of further spans that labelers judge, apart from base spans and from each other."""
    found = []
    if "at)" in text or "at]" in text:
        found += [(m.start(), 0, m.end()) for m in _SPELT_EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in _SPELT_IP.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _MARKED_CARD.finditer(text)]
    found += [(m.start(), 3, m.end()) for m in _LOCAL_PHONE.finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= sum(map(str.isdigit, m.group())) <= 19:
            found.append((m.start(), 2, m.end()))
    out, free = [], 0
    taken = spanned(base)
    k = 0
    for s, kind, e in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= free and not (k < len(taken) and taken[k][0] < e):
            out.append((s, kind, e, votes(text, s, kind, e)))
            free = e
    return out


def spanned(base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for s, _, e in sorted(base):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def votes(text: str, start: int, kind: int, end: int) -> str:
    """The kind, one vote (+, - or 0) each of the labelers, and after a bar what the span itself looks like.

    Labelers: regex, gazetteer, context, surroundings, check digit. Looks: how many digits, which marks stand between
    them, whether letters or doublings occur, what the word before ends in; only the final classifier sees these.
    """
    name, span = KINDS[kind], text[start:end]
    digits = "".join(c for c in span if c.isdigit())
    before = text[max(0, start - 40) : start]
    shape = "+" if _STRICT[name].fullmatch(span) else "0" if name in ("phone", "email") else "-"
    if name == "phone":
        known = "+" if digits[-7:-4] in _EXCHANGES or digits[:-7] in _EXCHANGES else "0"
    elif name == "email":
        known = "+" if re.split(r"[\s.()\[\]]+", span.rstrip(")]"))[-1].lower() in _DOMAINS else "-"
    elif name == "ip":
        first = re.split(r"[^0-9A-Fa-f]", span)[0].lower()
        known = "+" if first in _NETS else "-" if first in ("0", "00", "000") else "0"
    else:
        known = "+" if digits.startswith(_NETWORKS) else "-"
    context = "-" if _AGAINST.search(before) else "+" if _CUES[name].search(before) else "0"
    edge = text[start - 1 : start] + text[end : end + 1]
    around = "-" if any(c.isalnum() or c in "-_/=\"#" for c in edge) else "+" if all(c.isspace() or c in ".,;:!?()" for c in edge) else "0"
    check = ("+" if _luhn(digits) else "-") if name == "card" else "0"
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    looks = [str(min(len(digits), 20) // 2), str(len(marks)) if len(marks) < 3 else "3", str(int(any(c.isalpha() for c in span))), str(int(len(set(digits)) <= 3)), before[-2:-1].isalpha() and "a" or before[-2:-1].isdigit() and "d" or "o"]
    return f"{kind}{shape}{known}{context}{around}{check}|{''.join(looks)}"


def reliabilities(counts: dict[str, float], rounds: int = 50) -> tuple[dict[str, float], np.ndarray]:
    """Expectation-maximisation over vote patterns: each one's posterior, and each labeler's reliability by kind.

    A failing check digit is certain: such spans are known negatives.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    v = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in k[1:6]] for k in keys], float)
    kind, veto = np.array([int(k[0]) for k in keys]), np.array([k[5] == "-" for k in keys])
    right, prior = np.full((len(KINDS), v.shape[1]), 0.8), np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        logit = (v * np.log(right / (1 - right))[kind]).sum(1) + np.log(prior / (1 - prior))[kind]
        p = np.where(veto, 0.001, 1 / (1 + np.exp(-logit)))
        agree = np.where(v > 0, p[:, None], 1 - p[:, None]) * (v != 0)
        for k in range(len(KINDS)):
            own = kind == k
            right[k] = np.clip((n[own] @ agree[own] + 8) / (n[own] @ (v[own] != 0) + 10), 0.55, 0.99)
            prior[k] = np.clip((n[own] @ p[own] + 1) / (n[own].sum() + 2), 0.05, 0.95)
    return dict(zip(keys, p, strict=True)), right


def weigh(patterns: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Probability of each pattern of votes and looks: the posteriors of its votes train a logistic span classifier.

    ``patterns`` counts all candidates by pattern, of which there are 4 * 3**5 * 11 * 4 * 2 * 2 * 3 at most. The classifier
    sees kind, votes and the looks by kind, so that it can part spans on which the labelers vote alike.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    by_votes: dict[str, float] = {}
    for k, m in zip(keys, n, strict=True):
        by_votes[k[:6]] = by_votes.get(k[:6], 0) + m
    posterior, _ = reliabilities(by_votes, rounds)
    p = np.array([posterior[k[:6]] for k in keys])
    veto = np.array([k[5] == "-" for k in keys])
    named = [{f"kind {k[0]}", *(f"vote {i} {c}" for i, c in enumerate(k[1:6]) if c != "0"), *(f"look {k[0]} {i} {c}" for i, c in enumerate(k[7:]))} for k in keys]
    places = {x: i for i, x in enumerate(sorted(set().union(*named)))}
    x = np.zeros((len(keys), len(places)))
    for row, held in zip(x, named, strict=True):
        row[[places[h] for h in held]] = 1
    w = np.zeros(len(places))
    for _ in range(30):
        q = 1 / (1 + np.exp(-x @ w))
        h = (x * (n * q * (1 - q))[:, None]).T @ x + np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (n * (p - q)) - w)
    return dict(zip(keys, np.where(veto, 0.0, 1 / (1 + np.exp(-x @ w))), strict=True))


_SPAN = "array<struct<start: int, kind: int, end: int, votes: string>>"


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, base, more: spans of each whole text."""

    def of(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("votes", pa.string())]))
        for b in batches:
            base, more = [], []
            for t in b.column(1).to_pylist():
                own = base_spans(t or "")
                base.append([{"start": s, "kind": k, "end": e, "votes": None} for s, k, e in own])
                more.append([{"start": s, "kind": k, "end": e, "votes": v} for s, k, e, v in candidates(t or "", own)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(more, kind)], names=["doc_id", "base", "more"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, f"doc_id long, base {_SPAN}, more {_SPAN}")


def accepted(scanned: DataFrame, threshold: float = 0.5) -> list[str]:
    """Vote patterns that the classifier accepts, learnt from the candidates of all documents."""
    counts = scanned.select(F.explode("more.votes").alias("votes")).groupBy("votes").count()
    return [k for k, p in weigh({r["votes"]: r["count"] for r in counts.collect()}).items() if p >= threshold]


def _listed(spans):
    parts = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(parts, ",")


def find_pii(spark: SparkSession, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and accepted ones), n_added.

    A null text counts as empty; it and clean texts have zero counts and empty strings. Each row gets its own result.
    Offsets are code points. Without candidates no span is added. The scan is written once; votes are counted from it.
    """
    table = write_table(spark, _scan(docs), "spans")
    good = accepted(table, threshold)
    added = F.filter("more", lambda s: s["votes"].isin(good)) if good else F.slice("more", 1, 0)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return table.select("doc_id", *map(count, range(4)), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", added)).alias("spans"), F.size(added).cast("long").alias("n_added"))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at, over = [], 0, 0
    for s, k, e in sorted(spans):
        if s >= over:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        over = at = max(over, e)
    return "".join([*out, text[at:]])


def redact_pii(spark: SparkSession, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents with personal data replaced in ``text`` and ``n_chars`` (if there is one) renewed. Null texts stay null."""
    votes_only = _scan(docs).select("more").where(F.size("more") > 0)
    good = set(accepted(votes_only, threshold))
    names = docs.columns
    at = names.index("text")

    def of(batches):
        for b in batches:
            texts = []
            for t in b.column(at).to_pylist():
                if t is not None:
                    base = base_spans(t)
                    t = redact(t, base + [c[:3] for c in candidates(t, base) if c[3] in good])
                texts.append(t)
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.mapInArrow(of, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
