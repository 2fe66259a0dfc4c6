"""Whole-job checks that came out of review."""

import random

import numpy as np
import pytest

import corpus_pipeline
from cloakspark.llm import simhash, syncmers


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def word_sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stage_drops_edited_copies(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        w = prose(rng, rng.randrange(150, 400))
        rows.append((10 * i, " ".join(w)))
        for j, share in enumerate((0.01, 0.03, 0.06, 0.2)):
            e = [f"e{rng.randrange(10**6)}" if rng.random() < share else x for x in w]
            rows.append((10 * i + 1 + j, " ".join(e)))
    sets = [word_sets(t) for _, t in rows]
    low = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i // 5 * 5, i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                low = [low[j] if x == low[i] else x for x in low] if low[i] != low[j] else low
    # The least row of each component stays.
    want = {min(rows[k][0] for k in range(len(rows)) if low[k] == c) for c in set(low)}
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert len(want) < len(rows) - 40 and got == want


def test_wide_fingerprints_at_the_threshold():
    """Recall of pairs of likeness 0.8 exactly, sets of 20 to 2000; strangers stay far apart."""
    rng = np.random.default_rng(1)
    hits, n, strangers = 0, 0, 0
    for size in (20, 45, 220, 2000):
        for _ in range(500):
            x = rng.integers(0, 2**64, size * 10 // 9, np.uint64)
            k = len(x) // 10
            a, b = np.unique(x[: len(x) - k]), np.unique(x[k:])  # 8 of 10 in common
            apart = lambda p, q: sum((np.int64(i) ^ np.int64(j)).view(np.uint64).item().bit_count() for i, j in zip(p, q, strict=True))
            fa, fb = simhash.wide_fingerprint(a), simhash.wide_fingerprint(b)
            n += 1
            hits += apart(fa, fb) <= simhash.FAR
            strangers += apart(fa, simhash.wide_fingerprint(rng.integers(0, 2**64, size, np.uint64))) <= simhash.FAR
    assert hits >= 0.995 * n and strangers == 0


@pytest.mark.parametrize("tile,block", [(32_768, 256), (7, 3)])
def test_near_copies_in_tiles_and_blocks(spark, monkeypatch, tile, block):
    """A group of copies most of which are not alike enough among themselves: exact components by brute force."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "wide_links", lambda s, n, links=simhash.wide_links: links(s, n, tile=tile))
    rng = random.Random(21)
    base = prose(rng, 300)
    texts = [" ".join(base)]
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(300), rng.choice((2, 5, 9, 14, 30))):
            w[k] = f"z{i}x{k}"
        texts.append(" ".join(w))
    texts += [" ".join(prose(rng, 30)) for _ in range(30)] + ["", None, " "]
    sets = [word_sets(t or "") if (t or "").split() else set() for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8) or not (sets[i] or sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, th string")
    got = {r["doc_id"] for r in simhash.drop_near_duplicates(spark, docs).collect()}
    assert got == {min(i for i in range(len(texts)) if label[i] == x) for x in set(label)}


def test_population_tiles():
    tiles = simhash.population_tiles({60: 5, 61: 4, 62: 30, 63: 3, 64: 8}, 10)
    assert tiles == {60: (0, 1), 61: (0, 1), 62: (1, 3), 63: (4, 1), 64: (5, 1)}


def read_fingerprint(text):
    """(hash, position) of each anchor."""
    out, at = [], 0
    for i in range(0, len(text), 9):
        at += int(text[i + 8], 16)
        out.append((text[i : i + 8], at))
    return out


def test_fingerprints_hold_all_anchors_and_positions(spark):
    rng = random.Random(8)
    passage = " ".join(prose(rng, 60))
    a, b = (" ".join([*prose(rng, 3000), passage, *prose(rng, 3000)]) for _ in range(2))
    wide = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(300))
    texts = [a, b, wide, "x" + wide, "😀東" * 30, "short text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [read_fingerprint(r["fingerprint"]) for r in syncmers.fingerprint_documents(spark, docs).orderBy("doc_id").collect()]
    x, y = ({(h, p - t.index(passage)) for h, p in g if 0 <= p - t.index(passage) <= len(passage) - syncmers.K} for g, t in zip(got[:2], texts, strict=False))
    assert len(x) > 40 and x == y  # the shared passage is found whole, in place
    assert {(h, p + 1) for h, p in got[2]} <= set(got[3])  # no cut depends on where a run starts
    for g, t in zip(got, texts, strict=True):
        at = [p for _, p in g]
        assert at == sorted(set(at)) and all(v - u <= syncmers.K - syncmers.S for u, v in zip(at, at[1:], strict=False)) and len(t) - syncmers.K - at[-1] < syncmers.K - syncmers.S


def test_short_edited_texts_stay_near(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(prose(rng, 40))[: 49 + i % 50]) for i in range(60)]
    got = syncmers.fingerprint_documents(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["near_edited"] > 0 for r in got) and np.mean([r["near_edited"] for r in got]) > 0.4


def test_dropping_goes_by_rows_not_ids(spark):
    rng = random.Random(11)
    a, b, c = (" ".join(prose(rng, 80)) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (None, c), (None, c), (None, b)], "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(spark, docs).collect()]
    assert len(got) == 3 and set(got) == {(1, a), (1, b), (None, c)}


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, total string, th string, label string, prior_logit double, node long, c long, taken long, target double"


def chain(spark, docs, folder):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        out[name] = rows
    return out


def test_pipeline_stages_in_turn(spark, tmp_path):
    """Nulls, empty and repeated rows, columns named like those used inside: each stage against a plain reading of what it does."""
    rng = random.Random(4)
    spark.createDataFrame([(i, i % 4 and 1, 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = []
    for i in range(400):
        w = prose(rng, 30 + i % 50)
        if i % 4 == 0:
            w = [rng.choice(["spam", "$$$", "CLICK"]) if rng.random() < 0.5 else x for x in w]
        rows.append((i, " ".join(w) + (f" mail me at u{i}@mail.org" if i % 5 == 1 else ""), "en", "ab"[i % 2], None))
    rows += [(i + 1000, rows[i][1] + " tail", "fr", None, 3) for i in range(1, 60, 2)] + [rows[1], rows[1], (None, "no id at all, plain words of prose", None, None, None), (2000, None, None, "a", None), (2001, "", "en", "b", 0)]
    full = [(*r, "k", "s", "t", "th", "label", 0.5, 7, 8, 9, 1.0) for r in rows]
    docs = spark.createDataFrame(full, CLASHING)
    got = chain(spark, docs, str(tmp_path))
    first = got["quality"]
    assert docs.columns == list(first[0].asDict()) == list(got["mix"][0].asDict()) and set(first) <= set(map(tuple, full))
    good = [r for r in full if r[0] is not None and r[0] < 400 and r[0] % 4]
    assert sum(tuple(g) in set(map(tuple, first)) for g in good) >= 0.97 * len(good)
    ids = lambda rs: {r["doc_id"] for r in rs}
    assert not any(i is not None and 1000 < i < 1100 and i - 1000 in ids(got["near_duplicates"]) for i in ids(got["near_duplicates"]))
    assert len(got["near_duplicates"]) == len(got["pii"]) and not any("@mail.org" in (r["text"] or "") for r in got["pii"])
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in got["pii"])
    counts = {}
    for r in got["mix"]:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert set(counts.values()) <= {1, 2} and ids(got["mix"]) <= ids(got["pii"])
    words = lambda rs: sum(len((r["text"] or "").split()) for r in rs)
    assert 1.4 * words(got["pii"]) <= words(got["mix"]) <= 1.5 * words(got["pii"])
    assert len(got["encode"]) == len(got["mix"]) and all(r["exact"] for r in got["encode"])


def test_pipeline_of_an_empty_table_and_a_run(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], CLASHING)
    assert all(not rows for rows in chain(spark, empty, str(tmp_path)).values())
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
