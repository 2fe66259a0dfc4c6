"""Span algebra over text columns: find, check, resolve overlaps, splice. Offsets are code points, ends exclusive."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakspark.functions import checksum, masks, names
from cloakspark.functions.expr import let
from cloakspark.functions.patterns import NER_METHODS, NER_SEVERITY, PINCODE_CONTEXT, Config, Pattern

#: prio, neg (minus the length), ord and start sort spans by precedence; ord names the pattern.
FIELDS = "prio int, neg int, ord int, start int, end int, text string, confidence double"
SPANS = f"array<struct<{FIELDS.replace(' int', ':int').replace(' string', ':string').replace(' double', ':double')}>>"
MATCHES = "array<struct<ord:int,lead:int,m:array<string>,own:array<string>,runs:array<string>>>"
TRIGGER_ORD, DICTIONARY_ORD, NER_ORD = 900, 901, 1000
PERSON = Pattern("PERSON_NAME", names.TRIGGER, "HIGH", "PERSONAL", "name")
#: Column types whose cells are prose or of unknown content.
LOOSE = ("free_text", "auto")
#: Lengths that are summed up at once.
SUMMED = 128


def _none() -> Column:
    return F.array().cast(SPANS)


def _matches(text: Column, p: Pattern, order: int, unless: Sequence[Pattern] = ()) -> Column:
    """One pattern's matched strings, with what ``_placed`` needs to find their offsets; null where there are none or one of ``unless`` matches.

    ``runs`` are the matches again, each with the text since the one before. All expressions are literals, so that none is compiled anew for a row.
    """

    def made(m: Column) -> Column:
        some = reduce(lambda a, b: a & b, [~text.rlike(b.regex) for b in unless], F.size(m) > 0)
        runs = F.regexp_extract_all(text, F.lit(rf"\G[\s\S]*?(?:{p.regex})"), F.lit(0))
        own = m if p.group == 0 else F.regexp_extract_all(text, F.lit(p.regex), F.lit(p.group))
        return F.when(some, F.struct(F.lit(order).alias("ord"), F.lit(p.lead).alias("lead"), m.alias("m"), own.alias("own"), runs.alias("runs")))

    found = let(F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)), made)
    return F.when(text.rlike(p.guard), found) if p.guard else found


def _placed(prio: int, confidence: float):
    """From matches to spans. Offsets come from the lengths of runs and of the matches at their ends."""

    def of(x: Column) -> Column:
        total = lambda a: F.aggregate(a, F.lit(0), lambda p, q: p + q)

        def in_blocks(sizes: Column) -> Column:
            """Sums of whole blocks first, so that no match adds up all before it."""
            blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / SUMMED).cast("int")), lambda b: total(F.slice(sizes, b * SUMMED + 1, SUMMED)))

            def one(t: Column, i: Column, before: Column) -> Column:
                start = before - F.length(F.get(x["m"], i)) + x["lead"]
                return let(start, lambda at: F.struct(F.lit(prio).alias("prio"), (-F.length(t)).alias("neg"), x["ord"].alias("ord"), at.alias("start"), (at + F.length(t)).alias("end"), t.alias("text"), F.lit(confidence).alias("confidence")))

            def placed(blocks: Column) -> Column:
                block = lambda i: F.floor(i / SUMMED).cast("int")
                return F.transform(x["own"], lambda t, i: one(t, i, total(F.slice(blocks, 1, block(i))) + total(F.slice(sizes, block(i) * SUMMED + 1, i - block(i) * SUMMED + 1))))

            few = F.transform(x["own"], lambda t, i: one(t, i, total(F.slice(sizes, 1, i + 1))))
            return F.when(F.size(sizes) <= SUMMED, few).otherwise(let(blocks, placed))

        return let(F.transform(x["runs"], lambda r: F.length(r)), in_blocks).cast(SPANS)

    return of


def find(text: Column, p: Pattern, order: int, prio: int = 0, confidence: float = 1.0) -> Column:
    """All matches of one pattern, leftmost first."""
    found = F.filter(F.array(_matches(text, p, order)), lambda x: x.isNotNull())
    return F.flatten(F.transform(found, _placed(prio, confidence)))


def in_pincode_context(text: Column, start: Column) -> Column:
    before = F.lower(F.rtrim(F.substring(text, F.lit(1), start)))
    return reduce(lambda a, b: a | b, [F.endswith(before, F.lit(w)) for w in PINCODE_CONTEXT])


def raw_spans(text: Column, patterns: Sequence[Pattern], kind: str | Column = "auto", context: bool = False, without: Sequence[int] = ()) -> Column:
    """Matches of all patterns that pass their check digits, not yet resolved.

    ``kind``: the column's type, or a Column that says whether it is a loose one (free text or unknown), where identity
    numbers need no check digit. ``context``:
    there, postal codes count only after a word that announces one. ``without``: orders of patterns not looked for.
    """
    at = {p.name: i for i, p in enumerate(patterns)}
    loose = kind if isinstance(kind, Column) else kind in LOOSE
    found: dict[str | None, list[Column]] = {}
    for i, p in enumerate(patterns):
        if i not in without:
            unless = [patterns[at[n]] for n in p.skip_if if at.get(n, i) < i and at[n] not in without]
            found.setdefault(p.gate, []).append(_matches(text, p, i, unless))
    if not found:
        return _none()
    groups = [F.filter(F.array(*own), lambda x: x.isNotNull()) for own in found.values()]
    groups = [F.when(text.rlike(g), own).otherwise(F.array().cast(MATCHES)) if g else own for g, own in zip(found, groups, strict=True)]
    spans = F.flatten(F.transform(F.concat(*groups), _placed(0, 1.0)))
    spans = F.when(text.isNull(), _none()).otherwise(spans)

    def passes(s: Column) -> Column:
        ok = F.lit(True)
        for i, p in enumerate(patterns):
            test = checksum.has_check(p.name)
            if test and not (p.name == "AADHAAR" and loose is True):
                passed = test(s["text"]) if p.name != "AADHAAR" or loose is False else loose | test(s["text"])
                ok = F.when(s["ord"] == i, passed).otherwise(ok)
            if context and p.name == "INDIAN_PINCODE" and loose is not False:
                here = in_pincode_context(text, s["start"])
                ok = F.when(s["ord"] == i, here if loose is True else ~loose | here).otherwise(ok)
        return ok

    return F.filter(spans, passes)


def name_spans(text: Column, confidence: float = 0.85) -> Column:
    """Names after an introduction, and runs of known capitalised names apart from those."""
    trigger = let(F.regexp_extract_all(text, F.lit(names.TRIGGER), F.lit(1)), lambda own: let(find(text, PERSON, TRIGGER_ORD, 0, confidence), lambda w: F.zip_with(w, own, _named)))
    trigger = F.filter(trigger, lambda s: F.length(s["text"]) >= 3)

    def joined(tokens: Column) -> Column:
        """Neighbours at most one character apart become one span."""
        start = F.array().cast("array<struct<start:int,end:int>>")

        def add(acc: Column, s: Column) -> Column:
            last = F.element_at(acc, -1)
            return F.when((F.size(acc) > 0) & (s["start"] - F.get(acc, F.size(acc) - 1)["end"] <= 1), F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(last["start"].alias("start"), s["end"].alias("end")))).otherwise(F.array_append(acc, F.struct(s["start"].alias("start"), s["end"].alias("end"))))

        return F.aggregate(tokens, start, add)

    single = Pattern("PERSON_NAME", names.CAPITALISED, "HIGH", "PERSONAL", "name")
    known = F.filter(find(text, single, DICTIONARY_ORD), lambda s: names.is_known(F.lower(s["text"])))
    runs = let(known, lambda k: F.when(F.size(k) == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(joined(k)))
    dictionary = F.transform(
        runs, lambda r: F.struct(F.lit(0).alias("prio"), (r["start"] - r["end"]).alias("neg"), F.lit(DICTIONARY_ORD).alias("ord"), r["start"].alias("start"), r["end"].alias("end"), F.substring(text, r["start"] + 1, r["end"] - r["start"]).alias("text"), F.lit(confidence).alias("confidence"))
    ).cast(SPANS)
    return F.when(text.isNull(), _none()).otherwise(let(trigger, lambda t: F.concat(t, F.filter(dictionary, lambda d: ~F.exists(t, lambda x: overlap(x, d))))))


def _named(s: Column, name: Column) -> Column:
    """A match of the trigger narrowed to the name at its end, without a verb that follows names."""
    own = F.regexp_replace(name, rf"(?i)(?:\s+(?:{'|'.join(names.AFTER_NAMES)}))+$", "")
    start = s["end"] - F.length(name)
    return F.struct(s["prio"].alias("prio"), (-F.length(own)).alias("neg"), s["ord"].alias("ord"), start.alias("start"), (start + F.length(own)).alias("end"), own.alias("text"), s["confidence"].alias("confidence"))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve(spans: Column) -> Column:
    """Spans without overlaps, by start: patterns before models, longer before shorter, earlier patterns first."""

    def greedy(s: Column) -> Column:
        kept = F.aggregate(F.array_sort(s), _none(), lambda acc, x: F.when(F.exists(acc, lambda k: overlap(k, x)), acc).otherwise(F.array_append(acc, x)))
        by_start = F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("at"), x.alias("s"))))
        return F.transform(by_start, lambda x: x["s"])

    def sorted_out(s: Column) -> Column:
        """Most cells have no overlaps, which neighbours in order of their starts show."""
        by_start = F.transform(F.array_sort(F.transform(s, lambda x: F.struct(x["start"].alias("at"), x.alias("s")))), lambda x: x["s"])
        return let(by_start, lambda b: F.when(F.exists(F.zip_with(b, F.slice(b, 2, F.size(b)), lambda x, y: F.coalesce(y["start"] < x["end"], F.lit(False))), lambda x: x), greedy(s)).otherwise(b))

    return let(spans, lambda s: F.when(F.size(s) < 2, s).otherwise(sorted_out(s)))


def action(confidence: Column, config: Config) -> Column:
    return F.when(confidence >= config.redact_from, "REDACTED").when(confidence >= config.review_from, "REVIEW").otherwise("LOG_ONLY")


def ner_ord(label: str) -> int:
    return NER_ORD + list(NER_METHODS).index(label)


def methods_of(patterns: Sequence[Pattern]) -> dict[int, str]:
    return {i: p.method for i, p in enumerate(patterns)} | {TRIGGER_ORD: "name", DICTIONARY_ORD: "name"} | {ner_ord(x): m for x, m in NER_METHODS.items()}


def replacement(span: Column, patterns: Sequence[Pattern], config: Config) -> Column:
    """The masked text of a span by its pattern's method: one digest, and one branch for each method in use."""
    used = {o: masks.SAME.get(m, m) for o, m in methods_of(patterns).items()}
    method = F.element_at(F.str_to_map(F.lit(",".join(f"{o}={m}" for o, m in used.items())), F.lit(","), F.lit("=")), span["ord"].cast("string"))
    build = masks.builders(config.salt)

    def by_method(v: Column, m: Column, h: Column) -> Column:
        out = F.lit("[REDACTED]")
        for name in sorted(set(used.values()) & set(build) - {"redact"}):
            out = F.when(m == name, build[name](v, h)).otherwise(out)
        return out

    def made(x: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{config.salt}:"), x["m"], F.lit(":"), F.lower(x["v"])), 256)
        return let(digest, lambda h: by_method(x["v"], x["m"], h))

    masked = let(F.struct(F.trim(span["text"]).alias("v"), method.alias("m")), made)
    return F.when(F.trim(span["text"]) == "", span["text"]).otherwise(masked)


def described(spans: Column, patterns: Sequence[Pattern], config: Config) -> Column:
    """Spans with their replacement (none where only logged)."""
    return F.transform(spans, lambda s: F.struct(s["ord"].alias("ord"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["confidence"].alias("confidence"), F.when(s["confidence"] >= config.review_from, replacement(s, patterns, config)).alias("masked")))


def splice(text: Column, spans: Column) -> Column:
    """``text`` with each described span replaced; logged ones stay. Spans are apart and sorted by start."""
    after = lambda i: F.coalesce(F.get(spans, i)["end"], F.lit(0))
    parts = F.transform(spans, lambda s, i: F.concat(F.substring(text, after(i - 1) + 1, s["start"] - after(i - 1)), F.coalesce(s["masked"], s["text"])))
    tail = F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(parts, ""), tail))


def attribute(order: Column, patterns: Sequence[Pattern], what: str) -> Column:
    """name, severity, category or detector of a span's ``ord``, looked up in a literal map."""
    table = {i: getattr(p, what) if what != "detector" else "regex" for i, p in enumerate(patterns)}
    fixed = {"name": "PERSON_NAME", "severity": "HIGH", "category": "PERSONAL", "detector": "heuristic"}[what]
    table |= {TRIGGER_ORD: fixed, DICTIONARY_ORD: fixed}
    for label in NER_METHODS:
        table[ner_ord(label)] = {"name": label.upper().replace(" ", "_"), "severity": NER_SEVERITY[label], "category": "MODEL", "detector": "ner"}[what]
    return F.element_at(F.str_to_map(F.lit(",".join(f"{k}={v}" for k, v in table.items())), F.lit(","), F.lit("=")), order.cast("string"))


def mask_text(text: Column, config: Config, kind: str | Column = "auto", context: bool = False, with_names: bool | Column = False, more: Column | None = None, without: Sequence[int] = (), identity: Column | None = None) -> Column:
    """struct(masked_text, detections, pii_count) of a text column; null and blank texts stay as they are.

    ``with_names`` adds name heuristics, ``more`` spans of a model detector; patterns of the orders ``without`` are not
    looked for. Where ``identity`` holds, a text without any span is a name as a whole. Raw text never leaves the
    expression: detections hold a digest of the original.
    """
    patterns = config.effective()
    found = raw_spans(text, patterns, kind, context, without)
    if with_names is not False:
        found = F.concat(found, name_spans(text) if with_names is True else F.when(with_names, name_spans(text)).otherwise(_none()))
    if more is not None:
        found = F.concat(found, F.coalesce(more, _none()))

    def result(spans: Column) -> Column:
        events = F.transform(
            spans,
            lambda s: F.struct(
                s["ord"].alias("ord"), s["start"].alias("start"), s["end"].alias("end"), F.substring(F.sha2(F.concat(F.lit(config.salt), s["text"]), 256), 1, 12).alias("original"),
                F.coalesce(s["masked"], F.lit("[LOGGED_NOT_MASKED]")).alias("masked"), s["confidence"].alias("confidence"), action(s["confidence"], config).alias("action"),
            ),
        )
        return F.struct(splice(text, spans).alias("masked_text"), events.alias("detections"), F.size(spans).alias("pii_count"))

    def whole_name(name: Column) -> Column:
        event = F.struct(F.lit(TRIGGER_ORD).alias("ord"), F.lit(0).alias("start"), F.length(text).alias("end"), F.substring(F.sha2(F.concat(F.lit(config.salt), F.trim(text)), 256), 1, 12).alias("original"), name.alias("masked"), F.lit(1.0).alias("confidence"), F.lit("REDACTED").alias("action"))
        return F.struct(name.alias("masked_text"), F.array(event).alias("detections"), F.lit(1).alias("pii_count"))

    def spliced(raw: Column) -> Column:
        return let(resolve(raw), lambda r: let(described(r, patterns, config), result))

    def decided(raw: Column) -> Column:
        return F.when(identity & (F.size(raw) == 0), let(masks.mask(text, "name", config.salt), whole_name)).otherwise(spliced(raw))

    empty = F.struct(text.alias("masked_text"), F.array().cast("array<struct<ord:int,start:int,end:int,original:string,masked:string,confidence:double,action:string>>").alias("detections"), F.lit(0).alias("pii_count"))
    return F.when(text.isNull() | (F.trim(text) == ""), empty).otherwise(spliced(found) if identity is None else let(found, decided))
