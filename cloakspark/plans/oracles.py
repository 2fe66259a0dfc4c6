"""SQL for DuckDB that gives the catalogue's rows, written apart from the Column expressions it is held against."""

from __future__ import annotations

from cloakspark.functions import checksum, masks, names
from cloakspark.functions.patterns import PATTERNS

SALT = "catalogue"
# Verhoeff's tables as published (product in the dihedral group of ten, powers of the permutation, inverses).
PRODUCT = [
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 0, 6, 7, 8, 9, 5, 2, 3, 4, 0, 1, 7, 8, 9, 5, 6, 3, 4, 0, 1, 2, 8, 9, 5, 6, 7, 4, 0, 1, 2, 3, 9, 5, 6, 7, 8,
    5, 9, 8, 7, 6, 0, 4, 3, 2, 1, 6, 5, 9, 8, 7, 1, 0, 4, 3, 2, 7, 6, 5, 9, 8, 2, 1, 0, 4, 3, 8, 7, 6, 5, 9, 3, 2, 1, 0, 4, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0,
]
POWERS = [
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 5, 7, 6, 2, 8, 3, 0, 9, 4, 5, 8, 0, 3, 7, 9, 6, 1, 4, 2, 8, 9, 1, 6, 0, 4, 3, 5, 2, 7,
    9, 4, 5, 3, 1, 2, 6, 8, 7, 0, 4, 2, 8, 6, 5, 7, 3, 9, 0, 1, 2, 7, 9, 3, 8, 0, 6, 4, 1, 5, 7, 0, 4, 6, 9, 1, 3, 2, 5, 8,
]
INVERSE = [0, 4, 3, 2, 1, 5, 6, 7, 8, 9]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ",".join(_q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def _ascii_words(name: str, text: str = "text") -> str:
    """DuckDB's word boundary knows ASCII alone, so other letters become an ASCII word character that the pattern does not take."""
    mark = "_" if name == "ATTACHED_NAME" else "q"
    return f"regexp_replace({text}, '[\\x{{00AA}}\\x{{00B5}}\\x{{00BA}}\\x{{00C0}}-\\x{{00D6}}\\x{{00D8}}-\\x{{00F6}}\\x{{00F8}}-\\x{{02C1}}\\x{{0370}}-\\x{{052F}}\\x{{0900}}-\\x{{1FFF}}\\x{{3041}}-\\x{{318E}}\\x{{3400}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7A3}}]', '{mark}', 'g')"


def _digits_at(s: str, i: str) -> str:
    return f"(substr({s}, (length({s}) - {i})::INT, 1))::BIGINT"


def luhn(s: str, shift: int = 0) -> str:
    d = _digits_at(s, "i")
    return f"list_sum(list_transform(generate_series(0, length({s}) - 1), lambda i: CASE WHEN (i + {shift}) % 2 = 1 THEN CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END ELSE {d} END))"


def verhoeff(s: str, shift: int = 0) -> str:
    return f"list_reduce(generate_series(0, length({s}) - 1), lambda c, i: ({_list(PRODUCT)})[(c * 10 + ({_list(POWERS)})[((i + {shift}) % 8) * 10 + {_digits_at(s, 'i')} + 1] + 1)::INT]::BIGINT, 0::BIGINT)"


def gstin(b: str) -> str:
    v = f"((instr('{checksum.BASE36}', substr({b}, (i + 1)::INT, 1)) - 1) * (i % 2 + 1))"
    total = f"list_sum(list_transform(generate_series(0, 13), lambda i: {v} // 36 + {v} % 36))"
    return f"substr('{checksum.BASE36}', ((36 - {total} % 36) % 36 + 1)::INT, 1)"


def _digest(value: str, method: str) -> str:
    return f"sha256('{SALT}:{method}:' || lower({value}))"


def _byte(h: str, i) -> str:
    return f"('0x' || substr({h}, {i % 32 * 2 + 1}, 2))::INT"


def _chars(h: str, start: int, n: int, alphabet: str) -> str:
    return " || ".join(f"substr('{alphabet}', {_byte(h, start + k)} % {len(alphabet)} + 1, 1)" for k in range(n))


def _digits(h: str, start: int, n: int) -> str:
    return _chars(h, start, n, "0123456789")


def _number(h: str, start: int, size: int) -> str:
    return f"('0x' || substr({h}, {start + 1}, {size}))::BIGINT"


def _run(h: str, n: str) -> str:
    return f"array_to_string(list_transform(generate_series(0, {n} - 1), lambda i: (((('0x' || substr({h}, (i % 32 * 2 + 1)::INT, 2))::INT) + (i // 32) * 7) % 10)::VARCHAR), '')"


def _draw(h: str, i: str, alphabet: str) -> str:
    return f"substr('{alphabet}', (((('0x' || substr({h}, (({i}) % 32 * 2 + 1)::INT, 2))::INT) + (({i}) // 32) * 7) % {len(alphabet)} + 1)::INT, 1)"


def obfuscate(v: str, h: str) -> str:
    c = f"substr({v}, (i + 1)::INT, 1)"
    one = f"CASE WHEN {c} SIMILAR TO '[0-9]' THEN {_draw(h, 'i', '0123456789')} WHEN {c} SIMILAR TO '[A-Z]' THEN {_draw(h, 'i', masks.UPPER)} WHEN {c} SIMILAR TO '[a-z]' THEN {_draw(h, 'i', masks.UPPER.lower())} ELSE {c} END"
    return f"array_to_string(list_transform(generate_series(0, length({v}) - 1), lambda i: {one}), '')"


def _pick(values, n: str) -> str:
    return f"({_list(values)})[(({n}) % {len(values)} + 1)::INT]"


def _cap(s: str) -> str:
    return f"(upper(substr({s}, 1, 1)) || substr({s}, 2))"


def _full_name() -> str:
    return f"{_pick(names.FIRST, 'c_custkey')} || ' ' || {_cap(_pick(names.SURNAMES, 'c_custkey // 7'))}"


def gender(t: str) -> str:
    ends = lambda xs: " OR ".join(f"(ends_with({t}, '{x}') AND length({t}) > {len(x) + 1})" for x in xs)
    return f"CASE WHEN {t} IN ({','.join(map(_q, names.KNOWN_MALE))}) THEN 'M' WHEN {t} IN ({','.join(map(_q, names.KNOWN_FEMALE))}) THEN 'F' WHEN {ends(names.FEMALE_ENDS)} THEN 'F' WHEN {ends(names.MALE_ENDS)} THEN 'M' ELSE 'U' END"


def fake_name(head: str, tail: str, who: str) -> str:
    """Of a name of two tokens."""
    n = _number(_digest(head, "first"), 0, 8)
    first = f"CASE {who} WHEN 'F' THEN {_pick(names.FEMALE, n)} WHEN 'M' THEN {_pick(names.MALE, n)} ELSE {_pick(names.FIRST, n)} END"
    return f"({first}) || ' ' || {_cap(_pick(names.SURNAMES, _number(_digest(tail, 'last'), 0, 8)))}"


def hmac_id(v: str) -> str:
    key = SALT.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in key).hex() for p in (0x36, 0x5C))
    return f"'ID_' || upper(substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({v})))), 1, 12))"


def _uniform(key: str, tag: str) -> str:
    return f"((('0x' || substr(sha256('{SALT}:{tag}:' || {key}::VARCHAR), 1, 12))::BIGINT + 0.5::DOUBLE) / {16**12}::DOUBLE)"


def _laplace(value: str, key: str, scale: str, tag: str) -> str:
    u = f"({_uniform(key, tag)} - 0.5)"
    return f"({value} - ({scale}) * sign({u}) * ln(1 - 2 * abs({u})))"


def _spans(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """key, o, pattern, severity, start_at, end_at of all matches with valid check digits."""
    parts = []
    for i, p in enumerate(PATTERNS):
        re, t = _q(p.regex), _ascii_words(p.name, text)
        email = next(x for x in PATTERNS if x.name == "EMAIL")
        where = f"WHERE NOT regexp_matches({_ascii_words('EMAIL', text)}, {_q(email.regex)})" if p.skip_if else ""
        ok = {"CREDIT_CARD": f"{luhn('x')} % 10 = 0", "GSTIN": f"{gstin('x')} = right(x, 1)"}.get(p.name, "true")
        parts.append(f"""
SELECT {key}, {i} AS o, '{p.name}' AS pattern, '{p.severity}' AS severity, s + {p.lead} AS start_at, s + length(x) AS end_at FROM (
  SELECT {key}, m[k] AS x, (list_sum(list_transform(g[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda y: length(y))), 0))::BIGINT AS s
  FROM (SELECT {key}, regexp_extract_all(t, {re}) AS m, regexp_split_to_array(t, {re}) AS g, unnest(generate_series(1, len(regexp_extract_all(t, {re})))) AS k
        FROM (SELECT {key}, {t} AS t FROM {source} {where}))) WHERE {ok}""")
    return "\nUNION ALL".join(parts)


def _resolved(source: str = "documents", key: str = "doc_id", text: str = "text", more: str = "") -> str:
    """As ``_spans`` and the rows of ``more``, without overlaps: patterns before models (o from 1000), longer spans first, then earlier patterns, then earlier places."""
    one = "{'o': o, 's': start_at, 'e': end_at, 'pattern': pattern, 'severity': severity}"
    return f"""SELECT {key}, r.o AS o, r.pattern AS pattern, r.severity AS severity, r.s AS start_at, r.e AS end_at FROM (
  SELECT {key}, unnest(list_reduce(list([{one}] ORDER BY o >= 1000, start_at - end_at, o, start_at),
    lambda acc, y: CASE WHEN len(list_filter(acc, lambda k: k.s < y[1].e AND y[1].s < k.e)) > 0 THEN acc ELSE list_concat(acc, y) END)) AS r
  FROM ({_spans(source, key, text)}{more and f' UNION ALL {more}'}) GROUP BY {key})"""


def _replaced() -> str:
    """CASE over m (method) of the replacement of v, whose digest is h; uid, card and body are prepared from h."""
    v = "h"
    birth = f"(DATE '2025-01-01' - ({masks.YOUNGEST} + {_number('h', 0, 8)} % {masks.AGES})::INT)"
    made = {
        "pan": f"{_chars('h', 0, 5, masks.UPPER)} || {_digits('h', 5, 4)} || {_chars('h', 9, 1, masks.UPPER)}",
        "aadhaar": f"uid || ({_list(INVERSE)})[({verhoeff('uid', 1)} + 1)::INT]",
        "ifsc": f"{_chars('h', 0, 4, masks.UPPER)} || '0' || {_chars('h', 4, 6, masks.ALNUM)}",
        "credit_card": f"card || ((10 - {luhn('card', 1)} % 10) % 10)::BIGINT",
        "phone_number": f"CASE WHEN starts_with(v, '+91') THEN '+91 ' ELSE '' END || {_chars('h', 0, 1, '6789')} || {_digits('h', 1, 9)}",
        "pincode": f"(110001 + {_number('h', 0, 8)} % 745117)::VARCHAR",
        "passport": f"{_chars('h', 0, 1, masks.UPPER)} || {_chars('h', 1, 1, '123456789')} || {_digits('h', 2, 6)}",
        "vehicle_registration": f"{_chars(v, 0, 2, masks.UPPER)} || '-' || {_digits(v, 2, 2)} || '-' || {_chars(v, 4, 2, masks.UPPER)} || '-' || {_digits(v, 6, 4)}",
        "bank_account": _run("h", "CASE WHEN length(v) >= 9 THEN length(v) ELSE 12 END"),
        "email": "'user' || substr(h, 1, 10) || '@example.org'",
        "upi_id": f"'user' || substr(h, 1, 8) || '@' || {_pick(masks.UPI_HANDLES, _byte('h', 20))}",
        "gstin": f"body || {gstin('body')}",
        "date_of_birth": f"CASE WHEN contains(v, '/') AND NOT regexp_matches(v, '^[0-9]{{4}}/') THEN strftime({birth}, '%d/%m/%Y') WHEN regexp_matches(v, '^[0-9]{{4}}[-/]') THEN strftime({birth}, '%Y-%m-%d') ELSE strftime({birth}, '%d-%m-%Y') END",
        "date_of_birth_iso": f"strftime({birth}, '%Y-%m-%d')",
        "transaction_ref": f"CASE WHEN regexp_matches(v, '^[A-Z]+[0-9]+$') THEN regexp_extract(v, '^[A-Z]+') || {_run('h', 'length(regexp_extract(v, $$[0-9]+$$))')} ELSE {obfuscate('v', 'h')} END",
        "address": f"({_number('h', 0, 4)} % 899 + 1)::VARCHAR || ' ' || {_pick(masks.STREETS, _byte('h', 4))} || ', ' || {_pick(masks.CITIES, _byte('h', 5))}",
        "organization": f"{_cap(_pick(names.SURNAMES, _number('h', 0, 8)))} || ' ' || {_pick(masks.FIRMS, _byte('h', 6))}",
        "obfuscate": obfuscate("v", "h"),
        "name": _any_name(),
        "redact": "'[REDACTED]'",
    }
    return "CASE m " + "\n  ".join(f"WHEN '{k}' THEN {x}" for k, x in made.items()) + " END"


def _any_name() -> str:
    """The replacement of a name v of one token or more."""
    head, tail = "lower(regexp_split_to_array(v, '[ \\t\\n]+')[1])", "lower(regexp_split_to_array(v, '[ \\t\\n]+')[-1])"
    pair, n = fake_name(head, tail, gender(head)), _number(_digest(head, "first"), 0, 8)
    first = f"CASE {gender(head)} WHEN 'F' THEN {_pick(names.FEMALE, n)} WHEN 'M' THEN {_pick(names.MALE, n)} ELSE {_pick(names.FIRST, n)} END"
    last = _cap(_pick(names.SURNAMES, _number(_digest(head, "last"), 0, 8)))
    only = sorted(set(names.SURNAMES) - {x.lower() for x in names.FIRST})
    return f"CASE WHEN NOT regexp_matches(v, '[ \\t\\n]') THEN CASE WHEN {head} IN ({','.join(map(_q, only))}) THEN {last} ELSE {first} END ELSE {pair} END"


def _with_digests(rows: str) -> str:
    """``rows`` (v, m, ...) with h, uid, card and body."""
    uid = f"{_chars('h', 0, 1, '23456789')} || {_digits('h', 1, 10)}"
    body = f"lpad(({_byte('h', 0)} % 35 + 1)::VARCHAR, 2, '0') || {_chars('h', 1, 5, masks.UPPER)} || {_digits('h', 6, 4)} || {_chars('h', 10, 1, masks.UPPER)} || {_chars('h', 11, 1, '123456789' + masks.UPPER)} || 'Z'"
    return f"SELECT *, {uid} AS uid, '4' || {_digits('h', 0, 14)} AS card, {body} AS body FROM (SELECT *, sha256('{SALT}:' || m || ':' || lower(v)) AS h FROM ({rows}))"


def _found(re: str, source: str, key: str, group: int = 0) -> str:
    """key, s, x, own: where an expression matches, what, and one of its groups. Letters beyond ASCII count as word characters."""
    t, q = _ascii_words("ATTACHED_NAME"), _q(re)
    return f"""SELECT {key}, m[k] AS x, own[k] AS own, (list_sum(list_transform(g[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda y: length(y))), 0))::BIGINT AS s
  FROM (SELECT {key}, regexp_extract_all(t, {q}) AS m, regexp_extract_all(t, {q}, {group}) AS own, regexp_split_to_array(t, {q}) AS g, unnest(generate_series(1, len(regexp_extract_all(t, {q})))) AS k FROM (SELECT {key}, {t} AS t FROM {source}))"""


def _name_spans(source: str, key: str) -> str:
    """Names after an introduction, and runs of known names apart from those, as rows of ``_spans``."""
    after = f"(?i)(?:\\s+(?:{'|'.join(names.AFTER_NAMES)}))+$"
    known = ",".join(map(_q, sorted(names.KNOWN)))
    return f"""SELECT {key}, 900 AS o, 'PERSON_NAME' AS pattern, 'HIGH' AS severity, a AS start_at, b AS end_at FROM (
  SELECT {key}, s + length(x) - length(own) AS a, s + length(x) - length(own) + length(regexp_replace(own, {_q(after)}, '')) AS b FROM ({_found(names.TRIGGER, source, key, 1)})) WHERE b - a >= 3
UNION ALL SELECT {key}, 901, 'PERSON_NAME', 'HIGH', a, b FROM (
  SELECT {key}, min(s) AS a, max(e) AS b FROM (
    SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY s) AS run FROM (
      SELECT {key}, s, s + length(x) AS e, (s - coalesce(lag(s + length(x)) OVER (PARTITION BY {key} ORDER BY s), -9) > 1)::INT AS new FROM ({_found(names.CAPITALISED, source, key)}) WHERE lower(x) IN ({known})))
  GROUP BY {key}, run) d
WHERE NOT EXISTS (SELECT 1 FROM ({_found(names.TRIGGER, source, key, 1)}) t WHERE t.{key} = d.{key} AND length(regexp_replace(own, {_q(after)}, '')) >= 3
  AND s + length(x) - length(own) < d.b AND d.a < s + length(x) - length(own) + length(regexp_replace(own, {_q(after)}, '')))"""


def _person_runs(source: str, key: str) -> str:
    """What the dictionary detector finds: runs of capitalised words with a known one, as rows of ``_spans``."""
    known = ",".join(map(_q, sorted(names.KNOWN)))
    return f"""SELECT {key}, 1000 AS o, 'PERSON' AS pattern, 'HIGH' AS severity, s AS start_at, s + length(x) AS end_at
FROM ({_found(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\b", source, key)}) WHERE len(list_filter(string_split(lower(x), ' '), lambda w: w IN ({known}))) > 0"""


_TURNS = "conv AS (SELECT conv_id || ':' || turn AS id, conv_id, turn, text FROM conversations)"


def _processed() -> str:
    """The pipeline over customers: a name, a code, prose that names both, and a balance with noise."""
    code, mail = "'ABCDE' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || 'F'", "'c' || c_custkey || '@mail.com'"
    pan = f"{_chars('h', 0, 5, masks.UPPER)} || {_digits('h', 5, 4)} || {_chars('h', 9, 1, masks.UPPER)}"
    return f"""WITH n AS ({_names()}), c AS (SELECT *, {_digest(code, 'pan')} AS h, min(c_acctbal) OVER () AS lo, max(c_acctbal) OVER () AS hi FROM customer)
SELECT c_custkey, masked AS "Name", {pan} AS code, 'Customer called about the account of ' || masked || ', mail user' || substr({_digest(mail, 'email')}, 1, 10) || '@example.org' AS notes,
  greatest(round({_laplace('c_acctbal', 'c_custkey', 'hi - lo', 'noise:c_acctbal')}, 2), 0) AS c_acctbal, c_mktsegment FROM c JOIN n USING (c_custkey)"""


def _masking(source: str, key: str, text: str, more: str = "") -> str:
    """Common table expressions found, cut, put (each span with its replacement) and joined (texts put together again)."""
    method = "CASE o " + " ".join(f"WHEN {i} THEN '{p.method}'" for i, p in enumerate(PATTERNS)) + " ELSE 'name' END"
    return f"""found AS MATERIALIZED ({_resolved(source, key, text, more)}),
cut AS (SELECT {key}, start_at, end_at, trim(substr({text}, start_at + 1, end_at - start_at)) AS v, {method} AS m, {text} AS whole, coalesce(lag(end_at) OVER (PARTITION BY {key} ORDER BY start_at), 0) AS after FROM found JOIN {source} USING ({key})),
put AS (SELECT {key}, start_at, end_at, whole, after, CASE WHEN v = '' THEN substr(whole, start_at + 1, end_at - start_at) ELSE {_replaced()} END AS new FROM ({_with_digests('SELECT * FROM cut')})),
joined AS (SELECT {key}, string_agg(substr(whole, after + 1, start_at - after) || new, '' ORDER BY start_at) || substr(first(whole), max(end_at) + 1) AS masked_text, count(*) AS n FROM put GROUP BY {key})"""


def _masked(source: str = "documents", key: str = "doc_id", text: str = "text", more: str = "") -> str:
    """key, masked_text, pii_count of every row: resolved spans replaced."""
    return f"""WITH {_masking(source, key, text, more)}
SELECT {key}, coalesce(masked_text, {text}) AS masked_text, coalesce(n, 0)::BIGINT AS pii_count FROM {source} LEFT JOIN joined USING ({key})"""


def _rollup() -> str:
    r = f"found AS MATERIALIZED ({_resolved()})"
    dims = {"entity_type": "pattern", "severity": "severity", "detector": "'regex'", "action": "'REDACTED'", "total": "'all'"}
    return f"WITH {r}\n" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {c} AS value, count(*) AS found, count(*) AS masked FROM found GROUP BY ALL" for d, c in dims.items())


def _summary() -> str:
    by = lambda c: f"(SELECT string_agg(x || ':' || n, ',' ORDER BY x) FROM (SELECT {c} AS x, count(*) AS n FROM found GROUP BY ALL))"
    return f"""WITH found AS MATERIALIZED ({_resolved()})
SELECT 'text' AS "column", count(*) AS total, {by('pattern')} AS by_type, {by('severity')} AS by_severity, {by("'regex'")} AS by_detector, (SELECT pattern FROM found GROUP BY pattern ORDER BY count(*) DESC, pattern LIMIT 1) AS top_type FROM found"""


def vector_text(parts: list[str | int], digits: str, tail: str = "''") -> str:
    """A text of the pattern table: strings, and numbers of so many digits."""
    made = " || ".join(_q(x) if isinstance(x, str) else f"lpad(({digits} % {10**x})::VARCHAR, {x}, '0')" for x in parts)
    return f"{made} || {tail}"


def _vectors(vectors: dict[str, list[str | int]]) -> str:
    """Common table expression vec (id, kind, text): one text of each pattern for each customer."""
    rows = []
    for kind, parts in vectors.items():
        text = vector_text(parts, "n")
        tail = {"CREDIT_CARD": f"((10 - {luhn('b', 1)} % 10) % 10)::BIGINT::VARCHAR", "GSTIN": gstin("b")}.get(kind)
        rows.append(f"SELECT c_custkey || ':{kind}' AS id, '{kind}' AS kind, {text} AS text FROM k" if tail is None else f"SELECT c_custkey || ':{kind}' AS id, '{kind}' AS kind, {_q(parts[0])} || b || {tail} AS text FROM (SELECT c_custkey, {vector_text(parts[1:], 'n')} AS b FROM k)")
    return "WITH k AS (SELECT c_custkey, c_custkey * 7919 AS n FROM customer), vec AS MATERIALIZED (" + "\nUNION ALL ".join(rows) + ")"


def _chunks(size: int, overlap: int, snap: int) -> str:
    """Chunk by chunk: an end moves back to a line end, else to a space; a start moves on to one within the overlap."""
    last = lambda mark: f"{size} - strpos(reverse(substr(text, a + {size - snap} + 1, {snap})), {mark})"  # noqa: E731  offset from a
    end = f"CASE WHEN length(text) - a <= {size} THEN length(text) WHEN contains(substr(text, a + {size - snap} + 1, {snap}), chr(10)) THEN a + {last('chr(10)')} + 1 WHEN contains(substr(text, a + {size - snap} + 1, {snap}), ' ') THEN a + {last(chr(39) + ' ' + chr(39))} + 1 ELSE a + {size} END"
    lap = f"substr(text, e - {overlap} + 1, {overlap})"
    start = f"CASE WHEN e - {overlap} <= a THEN e WHEN contains({lap}, chr(10)) THEN e - {overlap} + strpos({lap}, chr(10)) WHEN contains({lap}, ' ') THEN e - {overlap} + strpos({lap}, ' ') ELSE e - {overlap} END"
    return f"""WITH RECURSIVE c AS (
  SELECT doc_id, text, 0::BIGINT AS chunk, 0::BIGINT AS a, {end.replace('a +', '0 +').replace('- a', '- 0')} AS e FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, chunk + 1, a, {end} AS e FROM (SELECT doc_id, text, chunk, {start} AS a, e AS was FROM c WHERE e < length(text)) WHERE a < length(text))
SELECT doc_id, chunk, a AS start, (e - a)::BIGINT AS length FROM c"""


def _density() -> str:
    return """WITH v AS (SELECT c_acctbal::DOUBLE AS v FROM customer WHERE c_acctbal IS NOT NULL), r AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * count(*) ** -0.2 AS band FROM v),
b AS (SELECT least(floor((v - lo) / ((hi - lo) / 2000)), 1999) AS b, count(*) AS k FROM v, r GROUP BY 1),
p AS (SELECT lo + (hi - lo) * i / 49 AS point FROM range(50) t(i), r)
SELECT round(point, 6) AS point, round(sum(exp(-0.5 * ((point - (lo + (b + 0.5) * ((hi - lo) / 2000))) / band) ** 2) * k) / (any_value(n) * any_value(band) * sqrt(2 * pi())), 12) AS density FROM p, b, r GROUP BY point"""


def _first_pass() -> str:
    """What the first validation pass finds in masked documents: matches that touch no replacement, but for those passed over in free text."""
    return f"""WITH {_masking("documents", "doc_id", "text")},
marks AS (SELECT doc_id, start_at + coalesce(sum(length(new) - (end_at - start_at)) OVER (PARTITION BY doc_id ORDER BY start_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(new) AS n FROM put),
again AS (SELECT doc_id, coalesce(masked_text, text) AS text FROM documents LEFT JOIN joined USING (doc_id)),
leaks AS (SELECT pattern FROM ({_spans("again")}) s WHERE pattern NOT IN ('INDIAN_PINCODE', 'VOTER_ID', 'ATTACHED_NAME')
  AND NOT EXISTS (SELECT 1 FROM marks m WHERE m.doc_id = s.doc_id AND s.start_at < m.a + m.n AND m.a < s.end_at))
SELECT 1::BIGINT AS pass_number, count(*) AS pii_found, coalesce(string_agg(DISTINCT pattern, ','), '') AS types_found, count(*) = 0 AS is_clean FROM leaks"""


#: What the rules make of the standard tables' columns: keys of other tables, balances, prices, values and lengths are numbers without a name
#: like an identifier's; columns of at most 30 values are skipped; order dates look like birth dates; short strings of many values stay open.
TYPES = {
    "customer": {"c_name": "auto", "c_nationkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": "skip"},
    "supplier": {"s_name": "auto", "s_nationkey": "numeric", "s_acctbal": "numeric"},
    "orders": {"o_custkey": "numeric", "o_orderstatus": "skip", "o_totalprice": "numeric", "o_orderdate": "auto", "o_orderpriority": "skip"},
    "events": {"ts": "skip", "user_id": "pseudonymize", "event_type": "skip", "value": "numeric", "props": "auto"},
    "documents": {"text": "free_text", "lang": "skip", "source": "skip", "n_chars": "numeric"},
}


def _ids(methods) -> str:
    """One column for each method, of customers' names; the general replacement, pivoted."""
    rows = " UNION ALL ".join(f"SELECT c_custkey, c_name AS v, '{m}' AS m FROM customer" for m in methods)
    made = f"SELECT c_custkey, m, {_replaced()} AS new FROM ({_with_digests(rows)})"
    return f"SELECT c_custkey, {', '.join(f'max(new) FILTER (m = {_q(m)}) AS {m}' for m in methods)} FROM ({made}) GROUP BY c_custkey"


def _names() -> str:
    n = f"SELECT c_custkey, lower({_pick(names.FIRST, 'c_custkey')}) AS head, {_pick(names.SURNAMES, 'c_custkey // 7')} AS tail FROM customer"
    g = f"SELECT *, {gender('head')} AS gender FROM ({n})"
    made = fake_name("head", "tail", "gender")
    return f"SELECT c_custkey, gender, {made} AS masked, {made} AS masked_lower FROM ({g})"


def _pair() -> str:
    """Common table expressions raw and masked, as the catalogue makes them."""
    made = fake_name("head", "tail", "gender")
    n = f"SELECT *, lower({_pick(names.FIRST, 'c_custkey')}) AS head, {_pick(names.SURNAMES, 'c_custkey // 7')} AS tail FROM customer"
    return f"""raw AS (SELECT c_custkey, {_full_name()} AS "Name", c_name || '@mail.com' AS "Email", c_acctbal, c_mktsegment FROM customer),
m AS (SELECT c_custkey, {made} AS fake FROM (SELECT *, {gender('head')} AS gender FROM ({n}))),
masked AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN "Name" ELSE 'X' || fake END AS "Name", 'user' || substr({_digest('"Email"', 'email')}, 1, 10) || '@example.org' AS "Email", c_acctbal, c_mktsegment FROM raw JOIN m USING (c_custkey))"""


_CELLS = 'SELECT trim("Name") AS v FROM masked UNION SELECT trim("Email") FROM masked UNION SELECT c_acctbal::VARCHAR FROM masked UNION SELECT trim(c_mktsegment) FROM masked'
_BALANCES = "SELECT c_acctbal AS v, 1 AS x, 0 AS y FROM customer WHERE c_acctbal IS NOT NULL UNION ALL SELECT s_acctbal, 0, 1 FROM supplier WHERE s_acctbal IS NOT NULL"


def _profile() -> str:
    one = lambda c, exact: f"""
SELECT '{c}' AS "column", count(*) AS n_sample, round(avg(length(v)), 6) AS average_length, round(avg((lower(split_part(trim(v), ' ', 1)) IN ({','.join(map(_q, sorted(names.KNOWN)))}))::INT), 6) AS name_share,
  {f'(SELECT count({c}) FROM customer)' if exact else '0::BIGINT'} AS n_rows, {f'(SELECT count(DISTINCT {c}) FROM customer)' if exact else '0::BIGINT'} AS n_distinct
FROM (SELECT {c}::VARCHAR AS v FROM customer WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 100)"""  # noqa: E731
    return " UNION ALL ".join([one("c_name", False), one("c_mktsegment", True), one("c_nationkey", True)])


def build(ids, vectors) -> dict[str, str]:
    body = "(20000000000 + o_orderkey * 7919)::VARCHAR"
    gst = "'27AAPFU' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || 'F1Z'"
    pin = "(110001 + c_custkey * 37 % 745117)"
    low = "regexp_split_to_array(lower({}), '[ \\t\\n\\x0B\\f\\r]+')"
    words = lambda t: f"list_distinct(list_filter({low.format(t)}, lambda w: w <> ''))"
    ip = next(p for p in PATTERNS if p.name == "IP_ADDRESS").regex
    bins = f"""WITH b AS ({_BALANCES}), r AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 99 AS w FROM b),
h AS (SELECT least(floor((v - lo) / w), 98)::INT AS k, sum(x) AS x, sum(y) AS y FROM b, r GROUP BY ALL),
e AS (SELECT coalesce(x, 0) / (sum(coalesce(x, 0)) OVER () * w) + 1e-10 AS x, coalesce(y, 0) / (sum(coalesce(y, 0)) OVER () * w) + 1e-10 AS y FROM range(99) t(k) LEFT JOIN h USING (k), r),
p AS (SELECT x / sum(x) OVER () AS x, y / sum(y) OVER () AS y FROM e)
SELECT round(sum(x * ln(x / y)), 6) AS kl, round((sum(x * ln(2 * x / (x + y))) + sum(y * ln(2 * y / (x + y)))) / 2, 6) AS js FROM p"""
    changed = "".join(
        f"""{'' if i == 0 else ' UNION ALL '}SELECT '{c}' AS "column", count(*) AS total, count(*) FILTER (a."{c}" IS DISTINCT FROM b."{c}") AS changed FROM raw a JOIN masked b USING (c_custkey)""" for i, c in enumerate(("Name", "Email", "c_acctbal", "c_mktsegment"))
    )
    return {
        "detect_spans": f"SELECT doc_id, pattern, start_at, end_at FROM ({_spans()})",
        "detect_counts_by_pattern": f"SELECT pattern, severity, count(*) AS n FROM ({_spans()}) GROUP BY ALL",
        "resolved_spans": f"SELECT doc_id, pattern, start_at, end_at FROM ({_resolved()})",
        "redact_documents": _masked(),
        "pages_mask": _masked("pages", "page_id", "html"),
        "manifest_rollup": _rollup(),
        "column_summary": _summary(),
        "pattern_vectors": f"{_vectors(vectors)} SELECT kind, id, pattern, start_at, end_at FROM ({_spans('vec', 'id')}) JOIN vec USING (id)",
        "mask_vectors": f"{_vectors(vectors)} SELECT id, masked_text, pii_count FROM ({_masked('vec', 'id')})",
        "conversation_mask": f"WITH {_TURNS} SELECT conv_id, turn, masked_text FROM ({_masked('conv', 'id', 'text', _name_spans('conv', 'id'))}) JOIN conv USING (id)",
        "model_detections": f"WITH {_TURNS} SELECT conv_id, turn, masked_text, pii_count FROM ({_masked('conv', 'id', 'text', _person_runs('conv', 'id'))}) JOIN conv USING (id)",
        "process_customer": _processed(),
        "validate_pass_counts": _first_pass(),
        "classify_tables": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', '{k}')" for t, cs in TYPES.items() for c, k in cs.items()) + ') AS x("table", "column", "type")',
        "chunk_documents": _chunks(1200, 250, 100),
        "balance_density": _density(),
        "redact_addresses": f"SELECT doc_id, regexp_replace(text, {_q(ip)}, '[REDACTED]', 'g') AS masked_text FROM documents",
        "luhn_cards": f"SELECT doc_id, digits, {luhn('digits')} % 10 = 0 AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{13,19}}')) AS digits FROM documents)",
        "verhoeff_check": f"SELECT o_orderkey, (({_list(INVERSE)})[({verhoeff('body', 1)} + 1)::INT])::VARCHAR AS digit, {verhoeff('body')} = 0 AS valid FROM (SELECT o_orderkey, {body} AS body FROM orders)",
        "gstin_check": f"SELECT c_custkey, {gstin('body')} AS digit, {gstin('body')} = 'V' AS valid FROM (SELECT c_custkey, {gst} AS body FROM customer)",
        "confidence_routing": "SELECT CASE WHEN abs(s_acctbal) / 10000 >= 0.8 THEN 'REDACTED' WHEN abs(s_acctbal) / 10000 >= 0.4 THEN 'REVIEW' ELSE 'LOG_ONLY' END AS action, count(*) AS n FROM supplier GROUP BY ALL",
        "profile_customer": _profile(),
        "name_probe": f"SELECT c_mktsegment, round(avg((lower(split_part(cell, ' ', 1)) IN ({','.join(map(_q, sorted(names.KNOWN)))}))::INT), 9) AS name_share FROM (SELECT c_mktsegment, CASE WHEN c_acctbal > 2000 THEN {_full_name()} ELSE c_name END AS cell FROM customer) GROUP BY ALL",
        "pseudonymize_events": f"SELECT event_id, {hmac_id('user_id::VARCHAR')} AS user_id FROM events",
        "mask_ids": _ids(ids),
        "mask_obfuscate": f"SELECT c_custkey, {obfuscate('c_name', 'h')} AS masked FROM (SELECT *, {_digest('c_name', 'obfuscate')} AS h FROM customer)",
        "mask_names": _names(),
        "dp_totalprice": f"SELECT o_orderkey, greatest(round({_laplace('o_totalprice', 'o_orderkey', 'hi - lo', 'noise:o_totalprice')}, 2), 0) AS o_totalprice FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)",
        "pincode_substitute": f"SELECT c_custkey, p AS whole, p AS fractional FROM (SELECT c_custkey, (110001 + {_number(_digest(pin + '::VARCHAR', 'pincode'), 0, 8)} % 745117)::VARCHAR AS p FROM customer)",
        "basic_mask": f"""SELECT c_custkey, '26-35' AS "Age", substr({pin}::VARCHAR, 1, 3) || 'XXX' AS "Pincode", greatest(round({_laplace('c_acctbal', 'c_custkey', '1000.0::DOUBLE', 'basic')}, 2), 0) AS "Amount" FROM customer""",
        "leakage_audit": f"""WITH {_pair()}, cells AS ({_CELLS}), l AS (SELECT 'Name' AS "column", trim("Name") AS v FROM raw UNION SELECT 'Email', trim("Email") FROM raw)
SELECT "column", count(*) AS unique_values, count(*) FILTER (v IN (SELECT v FROM cells)) AS leaked, round(100.0 - 100.0::DOUBLE * count(*) FILTER (v IN (SELECT v FROM cells)) / count(*), 2) AS effectiveness,
  CASE WHEN count(*) FILTER (v IN (SELECT v FROM cells)) = 0 THEN 'SAFE' ELSE 'LEAKED' END AS status FROM l GROUP BY 1""",
        "leak_containment": f"""WITH {_pair()}, v AS (SELECT DISTINCT lower("Name") AS value FROM raw), t AS (SELECT c_custkey, 'call from ' || lower("Name") || ' about billing' AS note FROM masked)
SELECT 'Name' AS "column", value, count(*) AS n FROM v JOIN t ON contains(' ' || note || ' ', ' ' || value || ' ') GROUP BY ALL""",
        "attack_sim": f"""WITH {_pair()}, cells AS ({_CELLS}), t AS (SELECT * FROM raw ORDER BY sha256('0:' || c_custkey), c_custkey LIMIT 1), f AS (SELECT 'Name' AS "column", "Name" AS v FROM t UNION ALL SELECT 'Email', "Email" FROM t)
SELECT "column", substr(sha256(v), 1, 12) AS digest, v IN (SELECT v FROM cells) AS found FROM f""",
        "k_anonymity": "SELECT min(n) AS k FROM (SELECT count(*) AS n FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY c_nationkey, c_mktsegment)",
        "ks_stat": f"""WITH b AS ({_BALANCES}), c AS (SELECT v, sum(x) AS x, sum(y) AS y FROM b GROUP BY v), r AS (SELECT sum(x) OVER (ORDER BY v) / sum(x) OVER () AS fx, sum(y) OVER (ORDER BY v) / sum(y) OVER () AS fy FROM c)
SELECT round(max(abs(fx - fy)), 9) AS statistic, round(greatest(0, 1 - max(abs(fx - fy))), 9) AS utility FROM r""",
        "kl_js_div": bins,
        "jaccard_utility": f"SELECT doc_id, round(CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE i::DOUBLE / u END, 9) AS likeness FROM (SELECT doc_id, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM (SELECT doc_id, {words('text')} AS a, {words("regexp_replace(text, '[0-9]+', '#', 'g')")} AS b FROM documents))",
        "embedding_cosine": "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), a AS (SELECT label, arg_min(x, vec_id) AS y FROM e GROUP BY label) SELECT vec_id, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 9) AS cosine FROM e JOIN a USING (label)",
        "changed_columns": f"WITH {_pair()} SELECT *, round(100.0::DOUBLE * changed / total, 2) AS effectiveness FROM ({changed})",
        "quality_scores": f"""WITH {_pair()} SELECT round(sum(changed) FILTER (changed > 0) / sum(total) FILTER (changed > 0), 9) AS privacy, count(*) FILTER (changed > 0) AS columns FROM ({changed}) WHERE "column" IN ('Name', 'Email', 'c_mktsegment')""",
        "export_roundtrip": "SELECT c_custkey, c_name, c_mktsegment, unnest(['csv', 'jsonl', 'parquet']) AS sink FROM customer",
    }
