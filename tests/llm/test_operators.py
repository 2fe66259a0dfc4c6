"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cloakspark.llm import covertree, kneserney, mixing, pii, quality, sentencepiece, simhash, suffixarray, syncmers, urlfilter
from cloakspark.llm.queries import MODEL_FILE, URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, total string"
WORDS = "the of and to in a is that for it was on as with be by at from this data model text große naïve 東京 page-1 x".split()


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def make_docs(seed=1, n=60):
    """Rows of DOCS: random prose with copies, shared passages, private data and awkward texts."""
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(60))
    texts = [None, "", " \t\n", "One", "one two", "ONE two three", "a" * 900, "ab " * 700, "ÀÉ\u2003x \u00a0y", "▁ under ▁▁", "tab\tnew\nline  two  spaces ", "\x00\x01 odd", "😀" * 70]
    for i in range(n):
        body = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 160)))
        if i % 5 == 0:
            body = f"{body[: len(body) // 2]} {passage} {body[len(body) // 2 :]}"
        if i % 7 == 0:
            body += f" mail User.{i}@mail{i}.example.com, ip 10.2.{i}.255 or 300.1.1.1, card 4111 1111 1111 1111, call +1 (555) 010-{1000 + i}."
        texts.append(body)
    texts += [texts[20], texts[20].upper(), texts[21] + " tail", texts[22], texts[22], " ".join([passage] * 3)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", "c", None][min(3, i % 5)], len(t) if t else None, "k", "s", "t") for i, t in enumerate(texts)]
    return [*rows, rows[25], rows[25], (None, "an orphan text without id", "en", "b", 25, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def components(n, links):
    low = list(range(n))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


# ---------------------------------------------------------------- 1


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    out = []
    for i in range(260):
        x = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.02, 0.08, 0.14, 0.5])
        out.append((i, [float(e) for e in x * rng.uniform(0.1, 9)], int(i % 3) if i % 17 else None))
    bad = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    out += [(300 + i, x, 1) for i, x in enumerate(bad)]
    out += [(400 + i, out[5][1], out[5][2]) for i in range(40)] + [(500, out[6][1], 99), (501, [2.0, 4.0], 1)]
    return out


def brute_links(rows, threshold):
    ok = [x is not None and len(x) and label is not None and all(e is not None and math.isfinite(e) for e in x) and any(x) for _, x, label in rows]
    links = set()
    for i, (_, x, lx) in enumerate(rows):
        for j, (_, y, ly) in enumerate(rows[:i]):
            if ok[i] and ok[j] and lx == ly and len(x) == len(y):
                a, b = np.array(x), np.array(y)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links.add((i, j))
    return links


@pytest.mark.parametrize("block,labels", [(4096, 256), (16, 256), (16, 1)])
def test_embedding_links(spark, monkeypatch, block, labels):
    monkeypatch.setattr(covertree, "LEAF", 4)
    monkeypatch.setattr(covertree, "TOPS", 5)
    monkeypatch.setattr(covertree, "LABELS", labels)
    data = vectors()
    links = brute_links(data, 0.98)
    comp, n = components(len(data), links), Counter(x for p in links for x in p)
    want = {r[0]: (n[i], data[comp[i]][0]) for i, r in enumerate(data)}
    df = spark.createDataFrame([(*r, "x", "y") for r in data], "vec_id long, embedding array<double>, label int, rep string, x string")
    got = covertree.embedding_links(spark, df, 0.98, block).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want and len(got) == len(data)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_embedding_links_through_null_ids(spark):
    turn = lambda a: [math.cos(a), math.sin(a)]
    step = math.acos(0.985)
    data = [(2, turn(0), 1), (None, turn(step), 1), (1, turn(2 * step), 1), (None, turn(2), 1), (None, None, 1), (5, turn(4), None)]
    got = covertree.embedding_links(spark, spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    rows = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got)
    assert rows == Counter([(2, 1, 1, False), (None, 2, 1, False), (1, 1, 1, True), (None, 0, None, True), (None, 0, None, True), (5, 0, 5, True)])


def test_simhash_links_through_null_ids(spark, monkeypatch):
    by_text = {"a": 0b0, "b": 0b11, "c": 0b1111, "d": 1 << 40 | 0b111000000}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: docs.join(spark.createDataFrame(list(by_text.items()), "text string, fp long"), "text").select("doc_id", "fp"))
    docs = spark.createDataFrame([(7, "a"), (None, "b"), (3, "c"), (None, "d")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(spark, docs).collect()}
    assert got == {(7, 3), (None, 3), (3, 3), (None, None)}


def test_embedding_links_empty(spark):
    assert covertree.embedding_links(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---------------------------------------------------------------- 2


def brute_simhash(text):
    w = [lower(x) for x in words_of(text)]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tile", [8192, 3])
def test_simhash(spark, docs, rows, tile):
    got = simhash.simhash_components(spark, docs, tile=tile).collect()
    fps = [brute_simhash(r[1]) for r in rows]
    assert sorted((r["doc_id"] is None, r["doc_id"], r["fingerprint"]) for r in got) == sorted((r[0] is None, r[0], f"{f:016x}") for r, f in zip(rows, fps, strict=True))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    comp = components(len(rows), links)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {r[0]: rows[comp[i]][0] for i, r in enumerate(rows) if r[0] is not None}


@pytest.mark.parametrize("tile", [64, 7])
def test_near_links_of_random_fingerprints(spark, tile):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)} | set(base))
    reps = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    got = components(len(fps), [(r["a"], r["b"]) for r in simhash.near_links(spark, reps, 2, tile).collect()])
    assert got == components(len(fps), links)


def test_simhash_empty_and_dropping(spark, docs, empty):
    assert simhash.simhash_components(spark, empty).count() == 0 and simhash.drop_near_duplicates(spark, empty).count() == 0
    kept = simhash.drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


# ---------------------------------------------------------------- 3

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum((int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    t, out = t or "", []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


AWKWARD = [
    "a@b.c@d.e x@y.z..w @q.r .@-.- a%+@b-.c-d.e", "1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256 9.1.2.3.4", "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112 4111 1111  1111 1111",
    "+1 (555) 010-2222 +12 +123456789012345 +1234567890123456 + 1 555 ++49 30 123456 78", "😀 a@b.co 😀 10.0.0.1", "1" * 5000, "a." * 3000 + "@", "+1" + "(" * 3000, "1.2." * 2000,
    "call 555-3824 or (800) 555-0199, joe (at) mail (dot) com; order 555-1234; joe [at] x.org",
]


def test_pii_base_spans(spark, docs, rows):
    more = [(1000 + i, t, "en", "a", 1, "", "", "") for i, t in enumerate(AWKWARD)]
    got = pii.find_pii(spark, docs.union(spark.createDataFrame(more, DOCS))).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    assert len(got) == len(rows) + len(more)
    for r in [*rows, *more]:
        want = brute_pii(r[1])
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        for g in by_id[r[0]]:
            assert g["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), r[1]
            assert [g[f"n_{k}"] for k in BASE] == [sum(x[3] == k for x in want) for k in BASE]
            assert set(filter(None, listed.split(","))) <= set(filter(None, g["spans"].split(",")))
    assert by_id[1009][0]["n_added"] > 0


def test_pii_reliabilities_and_redaction(spark, docs, empty):
    p = pii.weigh({"3+++++": 400, "30-0-0": 300, "3000+0": 5, "2+++--": 50, "2++0+-": 10})
    assert p["3+++++"] > 0.9 and p["30-0-0"] < 0.2 and p["2+++--"] == 0.0
    assert pii.weigh({}) == {}
    assert pii.redact("a@b.co and 10.0.0.1!", [(0, 0, 6), (11, 1, 19)]) == "[EMAIL] and [IP]!"
    out = pii.redact_pii(spark, docs).collect()
    assert len(out) == docs.count() and not any(brute_pii(r["text"]) for r in out)
    assert all((r["n_chars"] or 0) == len(r["text"] or "") for r in out)
    assert pii.find_pii(spark, empty).count() == 0 and pii.redact_pii(spark, empty).count() == 0


# ---------------------------------------------------------------- 4


def brute_targets(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, open_ = share * sum(sizes.values()), {s: 0.0 for s in names}, set(names)
    while open_ and budget > 1e-9:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if target[s] + budget * w[s] / total > cap * sizes[s]}
        if not over:
            for s in open_:
                target[s] += budget * w[s] / total
            break
        for s in over:
            target[s], open_ = float(cap * sizes[s]), open_ - {s}
        budget = share * sum(sizes.values()) - sum(target[s] for s in names if s not in open_)
        for s in open_:
            target[s] = 0.0
    return target


def test_mix(spark, docs, rows, empty):
    got = mixing.mix(spark, docs).collect()
    again = mixing.mix(spark, docs.repartition(5)).collect()
    order = lambda g: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in g)
    assert order(got) == order(again) and len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    want, taken = brute_targets(sizes, (3, 1, 2), 1.5, 2), Counter()
    most = max(r["size"] for r in got)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + r["target"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * most for s in sizes) and sum(taken.values()) <= 1.5 * sum(sizes.values()) + 1e-6
    out = mixing.take_mix(spark, docs)
    assert out.columns == docs.columns and out.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(taken.values())
    assert mixing.mix(spark, empty).count() == 0 and mixing.take_mix(spark, empty).count() == 0


def test_mix_of_many_sources_and_of_repeated_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), f"host{rng.randrange(90)}" if i % 50 else None) for i in range(900)]
    rows += [(7000, "the very same words again and again", "host1")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2)
    got = mixing.mix(spark, docs).collect()
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + r["target"]) for r in got)
    out = mixing.take_mix(spark, docs).collect()
    assert sum(len(words_of(r["text"])) for r in out) == sum(r["taken"] for r in got) <= 1.5 * sum(sizes.values()) + 1e-6


# ---------------------------------------------------------------- 5


def test_fingerprints(spark, docs, rows, empty):
    few = {r[0]: r for r in rows if r[0] is not None}
    data = spark.createDataFrame(list(few.values()), DOCS).repartition(4)
    got = {r["doc_id"]: r for r in syncmers.fingerprint_documents(spark, data).collect()}
    ids = sorted(few)
    assert sorted(got) == ids
    by_text = defaultdict(set)
    for k, i in enumerate(ids):
        t, nxt = few[i][1] or "", few[ids[(k + 1) % len(ids)]][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        by_text[t].add(r["fingerprint"])
        by_text[edited].add(r["edited_fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == t:
            assert r["near_edited"] == 1
    assert all(len(x) == 1 for x in by_text.values())
    long = [r for i, r in got.items() if len(few[i][1] or "") > 400]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.2
    assert syncmers.fingerprint_documents(spark, empty).count() == 0
    assert syncmers.fingerprint_documents(spark, docs).count() == len(rows)


def brute_anchors(text):
    """(hash, place) of closed syncmers by comparing all inner substrings of each k-mer."""
    h = lambda t: xxhash.xxh64_intdigest(t.encode("utf-32-be"), 42)
    signed = lambda x: x - 2**64 if x >> 63 else x
    k, w = syncmers.K, syncmers.S
    if len(text) < k:
        return [(xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFFFFFF, 0)] if text else []
    out = []
    for i in range(len(text) - k + 1):
        inner = [signed(h(text[i + j : i + j + w])) for j in range(k - w + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((h(text[i : i + k]) & 0xFFFFFFFF, i))
    return out


def brute_likeness(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_brute_force(spark):
    """Texts of every length, edited and next to each other; recall of edited texts by a likeness above those of strangers."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcde fghij klmno" if i % 3 else "東京都 大阪府ä😀") for _ in range(i)) for i in range(0, 130)]
    texts += [" ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(rng.randrange(20, 400))) for _ in range(40)] + [None, "", texts[50], texts[50]]
    got = syncmers.fingerprint_documents(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    hexed = lambda anchors: "".join(f"{h:08x}{p - (anchors[i - 1][1] if i else 0):x}" for i, (h, p) in enumerate(anchors))
    found = strangers = 0
    for r in got:
        i = r["doc_id"]
        t, nxt = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, e, n = map(brute_anchors, (t, edited, nxt))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (hexed(a), hexed(e)), i
        assert abs(r["near_edited"] - brute_likeness(a, e)) < 1e-12 and abs(r["near_next"] - brute_likeness(a, n)) < 1e-12
        found += r["near_edited"] >= 0.2
        strangers += r["near_next"] >= 0.2 and t != nxt
    long = [r for r in got if r["n_chars"] >= 24]
    assert sum(r["near_edited"] >= 0.2 for r in long) >= 0.9 * len(long) and strangers <= 3


def test_ranges_split_a_hot_id(spark):
    """A third of the rows have no id and a third the same: they fill several ranges, and each text still meets its next."""
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {rng.random()} of row {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    d = docs.withColumn("id", F.coalesce("doc_id", F.lit(syncmers.NO_ID))).withColumn("th", F.xxhash64("text"))
    sizes = [r["count"] for r in d.groupBy(syncmers.ranges(spark, d).alias("b")).count().collect()]
    assert max(sizes) < 60
    order = sorted(d.collect(), key=lambda r: (r["id"], r["th"]))
    want = {r["text"]: order[(k + 1) % len(order)]["text"] for k, r in enumerate(order)}
    assert {r["text"]: r["next_text"] for r in syncmers.with_next(spark, docs).collect()} == want


def test_syncmers_are_context_free(spark):
    rng = random.Random(2)
    mid = " ".join(str(rng.randrange(10**6)) for _ in range(40))
    a, b = f"x y z {mid} p q", f"some other words before {mid} and after it"
    got = spark.createDataFrame([(a, b, mid)], "a string, b string, m string").select(*[syncmers.anchors(F.col(c)).alias(c) for c in "abm"]).first()
    assert set(got["m"]) and set(got["m"]) <= set(got["a"]) and set(got["m"]) <= set(got["b"])


# ---------------------------------------------------------------- 6


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL_FILE)


def test_sentencepiece(spark, docs, rows, empty):
    codec, same = sentencepiece.Codec(MODEL_FILE), library()
    got = sentencepiece.encode_decode(docs, MODEL_FILE).collect()
    assert len(got) == len(rows) and all(r["exact"] and r["n_ids"] == len(r["ids"]) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    for r in rows:
        t, ids = r[1] or "", by_id[r[0]]["ids"]
        assert codec.decode(np.array(ids, np.int32)) == t
        if sentencepiece.SPACE not in t and "\0" not in t:
            assert ids == same.encode(t)
    assert sentencepiece.encode_decode(empty, MODEL_FILE).count() == 0


def test_sentencepiece_ids_are_the_librarys(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    codec, same = sentencepiece.Codec(MODEL_FILE), library()
    assert len(texts) == 1000 and all(codec.encode(t).tolist() == same.encode(t) for t in texts)


def test_sentencepiece_workers_keep_few_chunks():
    codec, same = sentencepiece.Codec(MODEL_FILE), library()
    text = " ".join(map(str, range(250_000))) + " the end"
    ids = codec.encode(text)
    assert codec.decode(ids) == text and codec.encode(text).tolist() == ids.tolist()
    assert sum(len(x) for x in vars(codec).values() if isinstance(x, dict)) <= 200_000  # of 250 000 chunks
    assert codec.encode("7 the end 249999 end").tolist() == same.encode("7 the end 249999 end")


def test_sentencepiece_of_odd_strings():
    rng, codec, same = random.Random(6), sentencepiece.Codec(MODEL_FILE), library()
    parts = [*WORDS, " ", "   ", "\n", "\t", "...", "2²³4½", "🤖", "ß", "\u0301", "internationalization", "aaaaaaaa", "</s>", "<0x0A>", "Z͑ͫ", "漢字かな", "_x_", "((("]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))
        assert codec.encode(t).tolist() == same.encode(t), t
        assert codec.decode(codec.encode(t)) == t


def toy(bpe):
    pieces = "a b c aa ab ba aaa abc bab cab aab aabb".split() if not bpe else "a b c ab aa bb abb aab caa abab".split()
    return sentencepiece.Lattice({p: (i, -float(i * 7 % 5 + 1) * len(p) ** 0.5 if not bpe else -float(i)) for i, p in enumerate(pieces)}, bpe)


@pytest.mark.parametrize("bpe", [False, True])
def test_viterbi_against_brute_force(bpe):
    lattice, rng = toy(bpe), random.Random(1)
    names = {i: p for p, (i, _) in lattice.pieces.items()}
    for _ in range(300):
        text = "".join(rng.choice("aaabbc?") for _ in range(rng.randrange(0, 60)))
        runs = [list(sentencepiece.viterbi_stream(text, lattice, commit=k)) for k in (1, 4, 10**6)]
        assert runs[0] == runs[1] == runs[2]
        cut = [names[i] if i >= 0 else chr(~i) for i in runs[0]]
        assert "".join(cut) == text
        if bpe:
            assert cut == lattice.merged(text)
            continue
        price = lambda p: -lattice.pieces[p][1] if p in lattice.pieces else lattice.unknown if len(p) == 1 else math.inf
        best = [0.0]
        for end in range(1, len(text) + 1):
            best.append(min(best[s] + price(text[s:end]) for s in range(max(0, end - 4), end)))
        assert abs(sum(map(price, cut)) - best[-1]) < 1e-9


def test_viterbi_commits_within_the_window():
    lattice = toy(True)
    out = sentencepiece.viterbi_stream("abcab?" * 100_000, lattice, commit=4)
    assert len([next(out) for _ in range(50)]) == 50  # ids come long before the end of the text


# ---------------------------------------------------------------- 7


def brute_tokens(t):
    return [*[lower(w) for w in words_of(t)], "\n</s>"]


def brute_score(rows, order):
    """Scores by recursion over plain dictionaries of n-grams, each level counted from the one above."""
    mark = "\n<s>"
    pad = lambda d: [mark] * (order - 1) + d
    train = [pad(brute_tokens(t)) for i, t in rows if not (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)]
    uni = Counter(w for d in train for w in d[order - 1 :])
    n, v = sum(uni.values()), len(uni)
    level = {order: Counter(tuple(d[i : i + order]) for d in train for i in range(len(d) - order + 1))}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    cuts = {k: kneserney._discounts(np.array([sum(c == j for c in level[k].values()) for j in (1, 2, 3, 4)])) for k in level}
    off = lambda c, d: 0 if c == 0 else d[min(c, 3) - 1]
    after = defaultdict(lambda: [0, 0.0])
    for k in level:
        for g, c in level[k].items():
            after[g[:-1]][0] += c
            after[g[:-1]][1] += cuts[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        low = 1 / (v + 1) if k == 1 else p(g[1:])
        total, spare = after[g[:-1]] if g[:-1] in after else (0, 0.0)
        return max(level[k][g] - off(level[k][g], cuts[k]), 0) / total + spare / total * low if total else low

    for context in [(mark,) * (order - 1), ("the",) * (order - 1), ("of", "the")[-(order - 1) :], ("never seen",) * (order - 1)]:
        assert abs(sum(p((*context, w)) for w in uni) + p((*context, "\nunknown")) - 1) < 1e-9
    out = {}
    for i, t in rows:
        d = brute_tokens(t)
        grams = [tuple(pad(d)[j : j + order]) for j in range(len(d))]
        out[i] = (len(d), sum(uni[w] > 0 for w in d), n, sum(math.log10((uni[w] + 1) / (n + 1 * (v + 1))) for w in d), sum(math.log10(p(g)) for g in grams))
    return out


@pytest.mark.parametrize("order,chunk,chars,least", [(3, 10**6, 10**6, 2000), (3, 500, 300, 2000), (2, 500, 300, 2000), (3, 500, 300, 1)])
def test_lm_score(spark, monkeypatch, docs, rows, empty, order, chunk, chars, least):
    """Few and many shards and chunks; words spread as hot or not; any split gives the same counts."""
    for name, value in (("CHUNK", chunk), ("SHARD_CHARS", chars), ("LEAST", least)):
        monkeypatch.setattr(kneserney, name, value)
    got = kneserney.score_documents(spark, docs, order).collect()
    want = brute_score([(r[0], r[1]) for r in rows], order)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert abs(r["base_score"] - base) < 1e-6 * (1 + abs(base)) and abs(r["score"] - score) < 1e-6 * (1 + abs(score))
    assert kneserney.score_documents(spark, empty, order).count() == 0


def test_lm_tables_hold_counts_above_32_bits(tmp_path):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**64, 5000, np.uint64))
    count, other = rng.integers(1, 4, len(keys)), rng.integers(0, 2, len(keys))
    count[::100] = 2**40 + np.arange(len(count[::100]))
    kneserney.Table.of(keys, count, other).save(f"file://{tmp_path}", "t")
    table = kneserney.Table.load(f"file://{tmp_path}", "t")
    assert (table.find(keys) == np.stack((count, other), 1)).all()
    absent = np.setdiff1d(rng.integers(0, 2**64, 3000, np.uint64), keys)
    assert not table.find(absent).any() and kneserney.Table.load(f"file://{tmp_path}", "none") is None
    p = kneserney._unpack(kneserney._pack(a=np.array([2**40, 3]), b=keys, c=np.zeros(0, np.int64)))
    assert p["a"].tolist() == [2**40, 3] and (p["b"] == keys).all() and len(p["c"]) == 0


# ---------------------------------------------------------------- 8


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    fit = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://a.NET/x", "http://net/", "http://net", "https://www.example.net/en/1?q#f", "http://example.net/fr/", "http://notexample.com/de/", "x://example.com/de", "http://a.b.example.com/de/2", "http://k.org/fr/", "http://k.org/fr", "HTTP://Org/fr/x://y", "http://?q", "http://xnet/", "ftp://é.net/ü", "http://a.net:80/", "http://h/\n://x"]
    urls += [f"http://h{i % 30}.{t}/{p}/{i}" for i, (t, p) in enumerate((t, p) for t in ("net", "org", "example.com", "example.net", "co.uk") for p in ("en", "de", "fr", "") for _ in range(9))]
    rows = [(i, u, "h", "p") for i, u in enumerate(urls)] + [(3, urls[3], None, None)]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = urlfilter.judge_urls(spark, spark.createDataFrame(rows, "page_id long, url string, host string, key string"), rules).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_url(urls[r["page_id"]]), urls[r["page_id"]]
    none = urlfilter.judge_urls(spark, spark.createDataFrame([], "page_id long, url string"), rules)
    assert none.count() == 0
    assert {r["verdict"] for r in urlfilter.judge_urls(spark, spark.createDataFrame(rows, "page_id long, url string, a string, b string"), rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    listed = spark.range(700).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    universe = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = urlfilter.build_cascade(spark, listed, universe, error=0.2)
    assert len(cascade.levels) > 2
    got = universe.select("key", cascade.contains(F.col("key")).alias("c")).collect()
    assert all(r["c"] == (int(r["key"][1:]) % 7 == 0 and int(r["key"][1:]) < 4900) for r in got)


# ---------------------------------------------------------------- 9


def brute_repeats(texts, length=200):
    at = Counter()
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        for i in range(len(r) - length + 1):
            at[r[i : i + length]] += 1
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if at[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((len(r), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("tile", [2000, 2])
def test_suffix_dedup(spark, monkeypatch, docs, rows, empty, tile):
    monkeypatch.setattr(suffixarray, "TILE", tile)
    got = suffixarray.drop_repeats(spark, docs).collect()
    want = brute_repeats([r[1] for r in rows])
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted((str(r[0]), *w) for r, w in zip(rows, want, strict=True))
    assert suffixarray.drop_repeats(spark, empty).count() == 0


def test_suffix_ranks_and_prefixes():
    rng = random.Random(3)
    text = bytes(rng.choice(b"ab") for _ in range(400))
    starts = np.arange(400 - 32 + 1)
    rank = suffixarray.refine(np.frombuffer(text, np.uint8), starts, 32)
    keys = [text[i : i + 32] for i in starts]
    assert [sorted(keys).index(k) for k in keys] == [sorted(rank.tolist()).index(r) for r in rank.tolist()]
    order = np.argsort(rank, kind="stable")
    lcp = suffixarray.common_prefixes(np.frombuffer(text, np.uint8), starts[order], 32)
    for i in range(1, len(order)):
        a, b = (text[starts[order[j]] :] for j in (i, i - 1))
        k = 0
        while k < 32 and k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        assert lcp[i] == k


# ---------------------------------------------------------------- 10


def test_quality(spark, empty):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [rng.choice(["spam", "win", "$$$", "CLICK"] if bad and rng.random() < 0.4 else WORDS) for _ in range(rng.randrange(20, 90))]
        rows.append((i, " ".join(w), "en" if i % 9 else None, "s1" if i % 3 else None, 1, "", "", ""))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(700, None, None, None, 1, "", "", ""), (701, "", "en", "rare", 1, "", "", ""), rows[4], (None, "no id", "en", "s1", 1, "", "", "")]
    labels += [(None, 1, 0), (5, None, None), (labels[0][0], labels[0][1], 0)]
    docs = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score_quality(spark, docs, lab).collect()
    assert len(got) == len(rows)
    unseen = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 2]
    assert np.mean([r["kept"] == (r["doc_id"] % 4 != 0) for r in unseen]) > 0.97
    kept = quality.keep_quality(spark, docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.score_quality(spark, empty, lab).count() == 0
    assert all(r["kept"] for r in quality.score_quality(spark, docs, lab.limit(0)).collect())


def test_sparse_sites_shrink(spark):
    from cloakspark.llm.quality import site_posteriors, site_sums

    rows = [("good", "p", 4.0)] * 300 + [("bad", "p", -4.0)] * 300 + [("tiny", "p", -4.0)] + [("mid", "p", 4.0)] * 20 + [("mid", "q", -4.0)] * 20
    got = {(r["_cs_host"], r["_cs_path"]): r["_cs_prior"] for r in site_posteriors(site_sums(spark.createDataFrame(rows, "h string, p string, _cs_logit double"), "h", "p")).collect()}
    assert got["good", "p"] > 1 and got["bad", "p"] < -1 and got["bad", "p"] < got["tiny", "p"] < 0 and got["mid", "q"] < got["mid", "p"]


def test_quality_scores_against_brute_force(spark):
    """Features, host and path posteriors and scores of every row, recomputed in plain Python from the fitted weights."""
    rng = random.Random(7)
    rows = []
    for i in range(500):
        w = [rng.choice(["*spam", "\"win\"", "$$$"]) if i % 3 == 0 and rng.random() < 0.3 else rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(w), ["en", "fr", None][i % 3 if i % 7 else 2], ["h1", "h2", "h3", None][min(3, i % 5)], 1, "", "", ""))
    rows += [(900, None, "en", "h9", 1, "", "", ""), (901, "", None, None, 1, "", "", ""), rows[3]]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 500, 2)], "doc_id long, quality int, toxic int")
    model = quality.fit_documents(spark, docs, lab)
    assert {b"spam", b"win"} <= model.bad_words  # marks at either end do not hide a word, here and when it is looked up
    assert quality.features("*spam", model.bad_words)[1] == quality.features("spam.", model.bad_words)[1] == 1.0
    logit = [float(np.clip(np.dot(quality.features(r[1], model.bad_words), model.weights), -12, 12)) for r in rows]
    p = [1 / (1 + math.exp(-x)) for x in logit]
    sites, hosts = defaultdict(list), defaultdict(list)
    for r, x in zip(rows, p, strict=True):
        sites[r[3], r[2]].append(x)
        hosts[r[3]].append(x)
    n, rate = len(rows), sum(p) / len(p)

    def strength(groups, base):
        between = sum(len(g) * (sum(g) / len(g) - b) ** 2 for g, b in zip(groups, base, strict=True)) / n
        return min(max(rate * (1 - rate) / max(max(0, between) - rate * (1 - rate) * len(groups) / n, 1e-6) - 1, 2), 1e5)

    top = strength(list(hosts.values()), [rate] * len(hosts))
    hp = {h: (sum(g) + top * rate) / (len(g) + top) for h, g in hosts.items()}
    low = strength(list(sites.values()), [hp[h] for h, _ in sites])
    post = {k: min(max((sum(g) + low * hp[k[0]]) / (len(g) + low), 1e-4), 1 - 1e-4) for k, g in sites.items()}
    got = {r["doc_id"]: r for r in quality.score_quality(spark, docs, lab).collect()}
    for r, x in zip(rows, logit, strict=True):
        q = post[r[3], r[2]]
        prior = math.log(q / (1 - q)) - math.log(rate / (1 - rate))
        g = got[r[0]]
        assert abs(g["evidence"] - x) < 1e-9 and abs(g["prior_logit"] - prior) < 1e-6 and abs(g["score"] - 1 / (1 + math.exp(-x - prior))) < 1e-6 and g["kept"] == (g["score"] >= 0.5)


def test_merging_by_binary_search():
    rng = random.Random(9)
    make = lambda: bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(12, 60)))
    for _ in range(30):
        left, right = [make() for _ in range(5)], [make() for _ in range(6)]
        left[0] = right[2] + left[0]
        got = suffixarray.found_in(left, right, 12)
        for own, other, hits in ((left, right, got[0]), (right, left, got[1])):
            held = {o[i : i + 12] for o in other for i in range(len(o) - 11)}
            assert [h.tolist() for h in hits] == [[p[i : i + 12] in held for i in range(len(p) - 11)] for p in own]


def test_pii_added_spans_of_every_kind(spark):
    """Spelt addresses, marked cards and local numbers are added; the same digits as codes, or with a failing check digit, are not."""
    rng = random.Random(5)
    card = lambda: (lambda b: b + next(str(d) for d in range(10) if luhn(b + str(d))))("4" + "".join(rng.choice("0123456789") for _ in range(14)))
    dotted = lambda c: ".".join(c[i : i + 4] for i in range(0, 16, 4))
    good, bad = [], []
    for _ in range(120):
        c = card()
        wrong = c[:-1] + str((int(c[-1]) + 1) % 10)
        good += [f"please charge card {dotted(c)} today", f"login from server 10[.]{rng.randrange(255)}[.]{rng.randrange(255)}[.]7 failed", f"call me at 555-{rng.randrange(1000, 9999)}, thanks", f"write to joe{rng.randrange(99)} (at) mail (dot) com now"]
        bad += [f"serial {dotted(wrong)}-x", f"version {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}-beta"]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    got = {r["doc_id"]: r for r in pii.find_pii(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, kind in enumerate(("card", "ip", "phone", "email")):
        share = np.mean([got[k]["n_added"] > 0 and kind in got[k]["spans"] for k in range(i, len(good), 4)])
        assert share > 0.9, (kind, share)
    assert np.mean([got[k]["n_added"] == 0 for k in range(len(good), len(rows))]) > 0.9


def test_pii_reliabilities_tell_good_labelers_from_bad():
    """Votes drawn from known reliabilities: expectation-maximisation finds their order, the classifier the truth."""
    rng = random.Random(2)
    right, counts, truth = (0.95, 0.8, 0.9, 0.6), Counter(), Counter()
    for _ in range(20_000):
        real = rng.random() < 0.6
        v = "".join("+" if (rng.random() < r) == real else "-" for r in right)
        key = f"3{v}0|{'a' if real or rng.random() < 0.1 else 'b'}"
        counts[key] += 1
        truth[key] += real
    by_votes = Counter()
    for k, m in counts.items():
        by_votes[k[:6]] += m
    _, found = pii.reliabilities(by_votes)
    assert found[3][0] > found[3][2] > found[3][1] > found[3][3]
    p = pii.weigh(dict(counts))
    hit = sum(truth[k] if p[k] >= 0.5 else counts[k] - truth[k] for k in counts)
    assert hit > 0.95 * 20_000
    assert p["3++++0|a"] > p["3++++0|b"] or p["3----0|a"] > p["3----0|b"]  # looks part spans of equal votes
