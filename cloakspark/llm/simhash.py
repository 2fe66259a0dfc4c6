"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.llm.common import LOWER, connected_components, keep_first, spanning, write_table

#: A fingerprint's class is the four bit counts of its 16-bit parts.
BASE = 17
TILE = 8192
#: Rows of the tile plan, of 12 bytes, that may be broadcast.
PLAN = 500_000
#: Near copies of likeness 0.8 differ in 19.4 of 128 bits on average (deviation 4.1), strangers in 64 (5.7).
FAR, WIDE_TILE, BLOCK = 32, 32_768, 256


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a whole text's word shingles, with repeats; a text of fewer words is one shingle. Null counts as empty."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(ends + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return np.array(hashes, np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 without words. Null counts as empty."""
    h = shingle_hashes(text, shingle)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of each row of documents."""

    def of(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, fp long")


def _near_classes(radius: int) -> list[tuple[int, ...]]:
    return [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]


def tile_plan(counts: dict[int, int], radius: int, tile: int) -> list[tuple[int, int, int]]:
    """(class, home, k): members of class are compared in the home class's tile pairs, k x k of them.

    Bit counts of parts differ by at most the distance, so other classes cannot hold a partner. ``counts`` has one
    entry per class, 17**4 at most. k makes both sides of a tile pair about ``tile`` rows at most.
    """
    homes, total = [], {}
    for c, n in counts.items():
        p = (c // BASE**3, c // BASE**2 % BASE, c // BASE % BASE, c % BASE)
        for d in _near_classes(radius):
            q = [x + y for x, y in zip(p, d, strict=True)]
            if min(q) < 0 or max(q) >= BASE:
                continue
            h = ((q[0] * BASE + q[1]) * BASE + q[2]) * BASE + q[3]
            if h <= c and h in counts:
                homes.append((c, h))
                total[h] = total.get(h, 0) + n
    return [(c, h, -(-total[h] // tile)) for c, h in homes if total[h] > 1]


def near_links(spark: SparkSession, reps: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that span the classes of (fp, rep) rows at most ``radius`` bits apart; fp must be distinct."""
    part = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF))
    reps = reps.withColumn("c", ((part(3) * BASE + part(2)) * BASE + part(1)) * BASE + part(0))
    counts = {r["c"]: r["count"] for r in reps.groupBy("c").count().collect()}  # 83 521 rows at most
    plan = spark.createDataFrame(pd.DataFrame(tile_plan(counts, radius, tile), columns=["c", "home", "k"]).astype("int32"), "c int, home int, k int") if counts else spark.createDataFrame([], "c int, home int, k int")
    rows = reps.join(F.broadcast(plan) if plan.count() <= PLAN else plan, "c")
    salt, every = F.pmod(F.xxhash64("fp"), "k").cast("int"), F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    left = rows.where("c = home").withColumn("s", salt).withColumn("j", every)
    right = rows.withColumn("j", salt).withColumn("s", every)
    cols = ["home", "s", "j", "fp", "rep"]
    both = left.select(*cols, F.lit(True).alias("own")).union(right.select(*cols, F.lit(False).alias("own")))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.own.to_numpy()
        fp, rep = pdf.fp.to_numpy().view(np.uint64), pdf.rep.to_numpy()
        fp, at = np.unique(fp, return_inverse=True)
        ids = np.empty(len(fp), np.int64)
        ids[at] = rep
        a, b = np.unique(at[own]), np.unique(at[~own])
        labels = np.arange(len(fp))
        for k in range(0, len(a), 256):
            x = fp[a[k : k + 256], None] ^ fp[None, b]
            near = np.bitwise_count(x) <= radius
            near &= x != 0
            some = near.any(1).nonzero()[0]
            spanning(labels, len(fp), ((a[k + i], b[near[i]]) for i in some))
        low = np.full(len(fp), np.iinfo(np.int64).max)
        np.minimum.at(low, labels, ids)
        to = low[labels]
        return pd.DataFrame({"a": ids, "b": to})[to != ids]

    return both.groupBy("home", "s", "j").applyInPandas(compare, "a long, b long")


def simhash_components(spark: SparkSession, docs: DataFrame, radius: int = 2, shingle: int = 3, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that links of ``radius`` bits reach.

    Whole texts, lower-cased, ``shingle``-word shingles with repeats. Each distinct fingerprint is compared once, with
    those in classes of near bit counts only, in tile pairs of bounded size; a pair hands on a spanning forest, never
    all its links. Texts without words (null, empty, blank) share fingerprint zero and link as others do. Repeated rows
    each get a row. A null doc_id links as others do; a component has the least id that is not null, or null if there
    is none. An empty table gives an empty result.
    """
    fps = write_table(spark, fingerprints(docs, shingle), "fingerprints")
    reps = write_table(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    # A fingerprint is its own node, so that one without an id takes part.
    comp = connected_components(spark, near_links(spark, reps.select("fp", F.col("fp").alias("rep")), radius, tile), "simhash")
    named = reps.join(comp, reps.fp == comp.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    names = named.groupBy("c").agg(F.min("least").alias("component_id"))
    # Written first, so that the last join stands alone and a very common fingerprint can be split.
    named = write_table(spark, named.select("fp", "c").join(names, "c").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct shingle hashes of a whole text, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def wide_fingerprint(held: np.ndarray) -> tuple[int, int]:
    """128-bit SimHash of a shingle set as two signed words; the second one's bits come from the hashes, mixed."""
    mixed = (held ^ (held >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    words = []
    for h in (held, mixed ^ (mixed >> np.uint64(32))):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(h), 1 << 15):
            ones += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        words.append(int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]))
    return words[0], words[1]


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, th, node, f0, f1, words) of each row; a node is a distinct shingle set, words whether it has any."""

    def of(batches):
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            f = np.array([wide_fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), pa.array([len(s) > 0 for s in sets])], names=["doc_id", "th", "node", "f0", "f1", "words"])

    return docs.select(F.col("doc_id").cast("long"), "th", "text").mapInArrow(of, "doc_id long, th long, node long, f0 long, f1 long, words boolean")


def population_tiles(counts: dict[int, int], tile: int) -> dict[int, tuple[int, int]]:
    """population count -> (first tile, how many tiles): neighbours share a tile, a count of over ``tile`` rows has several."""
    out, at, held = {}, 0, 0
    for p in sorted(counts):
        k = -(-counts[p] // tile)
        if k > 1 or held + counts[p] > tile:
            at, held = at + (held > 0), 0
        out[p] = at, k
        at, held = (at + k, 0) if k > 1 else (at, held + counts[p])
    return out


def wide_links(spark: SparkSession, nodes: DataFrame, radius: int = FAR, tile: int = WIDE_TILE) -> DataFrame:
    """Edges (a, b) that span the classes of (node, f0, f1) rows at most ``radius`` of 128 bits apart.

    Rows are dealt to tiles by population count; all pairs of tiles whose counts lie within the radius are compared.
    """
    nodes = nodes.withColumn("pop", (F.bit_count("f0") + F.bit_count("f1")).cast("int"))
    counts = {r["pop"]: r["count"] for r in nodes.groupBy("pop").count().collect()}  # 129 rows at most
    tiles = population_tiles(counts, tile)
    span: dict[int, list[int]] = {}
    for p, (first, k) in tiles.items():
        for t in range(first, first + k):
            span.setdefault(t, []).append(p)
    near = {t: [u for u in sorted(span) if min(span[u]) - radius <= max(span[t]) and min(span[t]) - radius <= max(span[u])] for t in span}
    plan = spark.createDataFrame([(p, first, k) for p, (first, k) in tiles.items()], "pop int, first int, k int")
    meets = spark.createDataFrame([(t, u) for t in near for u in near[t]], "tile int, other int")
    dealt = nodes.join(F.broadcast(plan), "pop").withColumn("tile", F.col("first") + F.pmod(F.xxhash64("node"), "k").cast("int"))  # 129 rows
    dealt = dealt.join(F.broadcast(meets) if meets.count() <= PLAN else meets, "tile")
    dealt = dealt.select("node", "f0", "f1", (F.col("tile") <= F.col("other")).alias("own"), F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own, ids = pdf.own.to_numpy(), pdf.node.to_numpy()
        f = pdf[["f0", "f1"]].to_numpy().astype(np.int64).view(np.uint64)
        same = pdf.i.iloc[0] == pdf.j.iloc[0]
        a, b = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(own), np.flatnonzero(~own))
        labels = np.arange(len(ids))
        right = [np.ascontiguousarray(f[b, k]) for k in (0, 1)]
        for at in range(0, len(a), 8):
            rows, low = a[at : at + 8], at if same else 0
            apart = np.bitwise_count(f[rows, 0, None] ^ right[0][None, low:]) + np.bitwise_count(f[rows, 1, None] ^ right[1][None, low:])
            hits = apart <= radius
            if hits.sum() > (len(rows) if same else 0):
                spanning(labels, len(ids), ((rows[i], b[low:][hits[i]]) for i in np.flatnonzero(hits.any(1))))
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, labels, ids)
        to = low[labels]
        return pd.DataFrame({"a": ids, "b": to})[to != ids]

    return dealt.groupBy("i", "j").applyInPandas(compare, "a long, b long")


def _verified(own: DataFrame, members: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (a, b) of likeness ``similarity`` between ``own`` and ``members`` (g, node, c, held) of equal g, a spanning choice.

    Both sides are dealt to blocks of about ``block`` sets, and each task holds one block of either; rows of equal c are
    joined already and not compared.
    """
    size = lambda d, n: d.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    sizes = size(own, "ko").join(size(members, "km"), "g")
    salt = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    cols = ["g", "i", "j", "node", "c", "held"]
    left = own.join(sizes, "g").withColumn("i", salt("ko")).withColumn("j", every("km")).select(*cols, F.lit(True).alias("own"))
    right = members.join(sizes, "g").withColumn("j", salt("km")).withColumn("i", every("ko")).select(*cols, F.lit(False).alias("own"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(h, np.uint64) for h in pdf.held]
        node, own, label = pdf.node.to_numpy(), pdf.own.to_numpy(), pdf.c.to_numpy().copy()
        other = np.flatnonzero(~own)
        size = np.array([len(s) for s in sets])
        found = []
        if len(other):
            keys, of = np.concatenate([sets[k] for k in other]), np.repeat(np.arange(len(other)), size[other])
            order = np.argsort(keys, kind="stable")
            keys, of = keys[order], of[order]
            for i in np.flatnonzero(own):
                low, high = np.searchsorted(keys, sets[i], "left"), np.searchsorted(keys, sets[i], "right")
                n = high - low
                hit = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                both = np.bincount(of[hit], minlength=len(other))
                near = both >= similarity * (size[i] + size[other] - both) - 1e-9
                for k in other[near & (label[other] != label[i])]:
                    if label[k] != label[i]:
                        found.append((node[i], node[k]))
                        label[label == label[k]] = label[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return left.union(right).groupBy("g", "i", "j").applyInPandas(compare, "a long, b long")


def near_copy_components(spark: SparkSession, docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, th, label) of each row of ``docs``, which has th; rows have one label that links of ``similarity`` join.

    Texts of equal shingle sets are one node. Nodes whose 128-bit SimHashes differ in FAR bits at most make up groups;
    within a group the likeness (Jaccard) of the whole sets decides: every node is held against the group's least one
    first, then those not linked to it against all of the group.
    """
    rows = write_table(spark, _signed(docs, shingle), "wide")
    nodes = write_table(spark, rows.where("words").groupBy("node").agg(F.min("th").alias("th"), F.first("f0").alias("f0"), F.first("f1").alias("f1")), "nodes")
    groups = connected_components(spark, wide_links(spark, nodes), "groups")
    groups = write_table(spark, groups.select("node", F.col("component").alias("g")).union(groups.select(F.col("component"), F.col("component")).distinct()), "members")

    def sets(batches):
        for b in batches:
            held = pa.array([shingle_set(t, shingle).tobytes() for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), held], names=["g", "node", "held"])

    named = nodes.select("node", "th").join(groups, "node").select("g", "node", "th")
    texts = docs.select("th", "text").join(named, "th").groupBy("g", "node").agg(F.first("text").alias("text"))
    held = write_table(spark, texts.mapInArrow(sets, "g long, node long, held binary"), "sets").withColumn("c", F.col("node"))
    links = write_table(spark, _verified(held.where("node = g"), held.where("node <> g"), similarity, BLOCK), "near")
    linked = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    known = write_table(spark, held.drop("c").join(linked, "node", "left").withColumn("c", F.coalesce("root", "node")).drop("root"), "known")
    more = _verified(known.where("c = node AND node <> g"), known, similarity, BLOCK)
    found = connected_components(spark, links.union(more), "nearcopies")
    return rows.join(found, "node", "left").select("doc_id", "th", F.coalesce("component", "node").alias("label"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of each component of near copies, all columns kept: the least by (doc_id with nulls last, text hash).

    Texts without words (null, empty, blank) are alike. Of repeated rows one stays, also without an id. An empty table
    gives an empty result.
    """
    docs = docs.withColumn("_cs_th", F.xxhash64(F.coalesce("text", F.lit(""))))
    plain = docs.select("doc_id", "text", F.col("_cs_th").alias("th"))
    return keep_first(docs, near_copy_components(spark, plain, similarity, shingle)).drop("_cs_th")
