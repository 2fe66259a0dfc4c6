"""Suffix-array dedup: bytes covered by a string of fixed length that also starts elsewhere."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.llm.common import drop_table, write_table

LENGTH, GRAM = 200, 32
#: Segments of a shard, and of one anchor beyond which it gets tiles of its own.
SHARD, TILE = 20_000, 2000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def windows_by_anchor(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first, last, anchor, hash: runs of window starts whose least GRAM-byte string is the same one.

    Equal windows have equal least strings at equal offsets, whatever stands around them.
    """
    n = len(raw)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    v = np.ndarray((n - 7,), "<u8", raw, 0, (1,)).astype(np.uint64)
    m = n - GRAM + 1
    h = v[:m] * _MIX[0]
    for k in (1, 2, 3):
        h ^= h >> np.uint64(29)
        h += v[8 * k : 8 * k + m] * _MIX[k]
        h *= _MIX[0]
    h ^= h >> np.uint64(32)
    h *= _MIX[1]
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    span, size = length - GRAM + 1, 1
    while 2 * size <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    return first, last, at[first], h[at[first]]


def refine(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes at ``starts`` by their first ``length`` bytes; equal ones share the least place.

    Larsson-Sadakane: ranks of 8 bytes are doubled, and each round sorts only suffixes that still share a rank.
    ``text`` is long enough for every start.
    """
    n = len(text) - 7
    word = np.ndarray((n,), ">u8", text.tobytes(), 0, (1,)).astype(np.uint64)
    order = np.argsort(word)
    sorted_ = word[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    head = np.flatnonzero(new)
    rank = np.zeros(n + length, np.int64)
    place = np.repeat(head, np.diff(np.concatenate((head, [n]))))
    rank[order] = place
    tied = np.repeat(np.diff(np.concatenate((head, [n]))) > 1, np.diff(np.concatenate((head, [n]))))
    todo = order[tied]
    depth = 8
    while depth < length and len(todo):
        step = min(depth, length - depth)
        key = rank[todo].astype(np.uint64) << np.uint64(32) | rank[todo + step].astype(np.uint64)
        o = np.argsort(key)
        key, todo = key[o], todo[o]
        group = key >> np.uint64(32)
        g = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        s = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((s, [len(key)])))
        gs = np.repeat(g, np.diff(np.concatenate((g, [len(key)]))))
        rank[todo] = group.astype(np.int64) + np.repeat(s, size) - gs
        todo = todo[np.repeat(size > 1, size)]
        depth += step
    return rank[starts]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefixes of neighbours in ``order`` (suffix starts), up to ``most``; the first has 0.

    All runs of consecutive starts advance in step: a suffix keeps what its predecessor in the text shared, less one, if
    the place that predecessor shared with moves on to one before it in ``order``, which ends of texts and ties prevent.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    place = np.argsort(order)
    here = order[place]
    before = np.where(place > 0, order[place - 1], -1)
    follower = np.concatenate(([-1], before[:-1] + 1))
    at = np.minimum(np.searchsorted(here, follower), n - 1)
    kept = (here[at] == follower) & (place[at] < place) if n else np.zeros(0, bool)
    begin = np.flatnonzero(np.concatenate(([True], np.diff(here) != 1)))
    size = np.diff(np.concatenate((begin, [n])))
    keep = np.zeros(len(begin), np.int64)
    padded = np.concatenate((text, np.zeros(most + 8, np.uint8)))
    for t in range(int(size.max()) if n else 0):
        live = np.flatnonzero(size > t)
        i = begin[live] + t
        a, b = here[i], before[i]
        h = np.where((b >= 0) & kept[i], np.maximum(keep[live] - 1, 0), 0)
        grow = np.flatnonzero((b >= 0) & (h < most))
        while len(grow):
            same = padded[a[grow] + h[grow]] == padded[b[grow] + h[grow]]
            grow = grow[same]
            h[grow] += 1
            grow = grow[h[grow] < most]
        keep[live] = h
        out[place[i]] = h
    return out


def repeated_windows(pieces: list[bytes], length: int = LENGTH, kasai: bool = True) -> list[np.ndarray]:
    """For each piece which of its windows also starts in another place of the pieces."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    counts = sizes - length + 1
    starts = np.concatenate([np.arange(b, b + c) for b, c in zip(begin, counts, strict=True)]) if len(pieces) else np.zeros(0, np.int64)
    rank = refine(text, starts, length)
    order = np.argsort(rank, kind="stable")
    if kasai:
        equal = common_prefixes(text, starts[order], length)[1:] >= length
    else:
        equal = rank[order][1:] == rank[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    return np.split(twice, np.cumsum(counts)[:-1])


def suffix_order(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces joined, and the starts of all their windows in the order of the windows' bytes."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    starts = np.concatenate([np.arange(b, b + n - length + 1) for b, n in zip(begin, sizes, strict=True)])
    return text, starts[np.argsort(refine(text, starts, length), kind="stable")]


def occurs(windows: np.ndarray, text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which rows of ``windows`` stand somewhere in a shard, by binary search in its suffix ``order``."""
    held = np.lib.stride_tricks.sliding_window_view(text, length)
    out = np.zeros(len(windows), bool)
    for k in range(0, len(windows), 4096):
        w = windows[k : k + 4096]
        low, high = np.zeros(len(w), np.int64), np.full(len(w), len(order))
        while len(live := np.flatnonzero(low < high)):
            mid = (low[live] + high[live]) >> 1
            there, own = held[order[mid]], w[live]
            apart = there != own
            at = apart.argmax(1)
            i = np.arange(len(live))
            differs, less = apart[i, at], there[i, at] < own[i, at]
            out[k + live[~differs]] = True
            low[live] = np.where(~differs, high[live], np.where(less, mid + 1, low[live]))
            high[live] = np.where(differs & ~less, mid, high[live])
    return out


def found_in(pieces: list[bytes], others: list[bytes], length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Merging two shards: windows of each that occur in the other, by binary search in the other's suffix order."""
    found = []
    for own, other in ((pieces, others), (others, pieces)):
        windows = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(p, np.uint8), length) for p in own]
        hits = occurs(np.concatenate(windows), *suffix_order(other, length), length)
        found.append(np.split(hits, np.cumsum([len(w) for w in windows])[:-1]))
    return found[0], found[1]


def _key(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumn("key", F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").cast("binary"))))


def repeated_spans(spark: SparkSession, keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, spans array<struct<s, e>>), keys being 128-bit digests of id and text: windows that start elsewhere too, as byte ranges of each keyed text."""
    runs_schema = "anchor long, seg long, key binary, p1 int, p2 int"

    def runs(batches):
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                out = [[], [], [], [], []]
                for key, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = t.encode()
                    first, last, _, h = windows_by_anchor(raw, length)
                    if len(first):
                        digest = xxhash.xxh3_64_intdigest
                        out[0].append(h.view(np.int64))
                        out[1].append(np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64).view(np.int64))
                        out[2] += [key] * len(first)
                        out[3].append(first.astype(np.int32))
                        out[4].append(last.astype(np.int32))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) if i == 2 else pa.array(np.concatenate(x)) for i, x in enumerate(out)], names=["anchor", "seg", "key", "p1", "p2"])

    # Counts by anchor are tables of their own, so that the joins with them stand alone and a very common anchor is split.
    every = write_table(spark, keyed.select("key", "text").mapInArrow(runs, runs_schema), "everyrun")
    often = write_table(spark, every.groupBy("anchor").count().where("count > 1").select("anchor"), "often")
    again = write_table(spark, every.join(often, "anchor", "left_semi"), "runs")
    drop_table(spark, every)
    segs = again.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("key", "p1", "p2")).alias("at"))
    segs = write_table(spark, segs.select("anchor", "seg", "n", "at.key", "at.p1", "at.p2"), "segments")
    copies = again.join(segs.where("n > 1").select("anchor", "seg"), ["anchor", "seg"], "left_semi").select("key", F.col("p1").alias("s"), (F.col("p2") + length).alias("e"))
    # Segments that occur once may share windows with other segments of their anchor.
    many = write_table(spark, segs.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1"), "many")
    shards = max(1, -(-segs.count() // SHARD))
    cut = segs.join(many, "anchor").withColumn("k", F.ceil(F.col("m") / TILE).cast("int"))
    cut = cut.groupBy("key").agg(F.collect_list(F.struct("anchor", "seg", "n", "p1", "p2", "k")).alias("segs"))

    def slices(batches):
        for b in batches:
            for k in range(0, b.num_rows, 64):
                rows = []
                for r in b.slice(k, 64).to_pylist():
                    raw = r["text"].encode()
                    for s in r["segs"]:
                        rows.append((s["anchor"], s["seg"], s["n"], r["key"], s["p1"], s["k"], raw[s["p1"] : s["p2"] + length]))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["anchor", "seg", "n", "key", "p1", "k", "piece"])

    named = "anchor long, seg long, n long, key binary, p1 int, k int, piece binary"
    pieces = keyed.dropDuplicates(["key"]).select("key", "text").join(cut, "key").mapInArrow(slices, named)
    salt = F.pmod(F.xxhash64("seg"), "k").cast("int")
    i = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    dealt = pieces.withColumn("own", salt).withColumn("other", i)
    one = F.col("k") == 1
    dealt = dealt.withColumn("g", F.when(one, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(F.col("anchor")))
    dealt = dealt.withColumn("i", F.when(one, -1).otherwise(F.least("own", "other"))).withColumn("j", F.when(one, -1).otherwise(F.greatest("own", "other")))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.i.iloc[0] == pdf.j.iloc[0]:
            hits = repeated_windows(list(pdf.piece), length)
        else:
            left = (pdf.own == pdf.i).to_numpy()
            if left.all() or not left.any():
                hits = [np.zeros(len(p) - length + 1, bool) for p in pdf.piece]
            else:
                a, b = found_in(list(pdf.piece[left]), list(pdf.piece[~left]), length)
                ia, ib = iter(a), iter(b)
                hits = [next(ia) if x else next(ib) for x in left]
        key, s, e = [], [], []
        for k, p1, n, hit in zip(pdf.key, pdf.p1, pdf.n, hits, strict=True):
            if n == 1 and hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                key += [k] * (len(edge) // 2)
                s += (p1 + edge[::2]).tolist()
                e += (p1 + edge[1::2] - 1 + length).tolist()
        return pd.DataFrame({"key": np.array(key, object), "s": np.array(s, np.int32), "e": np.array(e, np.int32)})

    partly = dealt.groupBy("g", "i", "j").applyInPandas(compare, "key binary, s int, e int")
    return copies.union(partly).groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def drop_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of each whole text as UTF-8.

    A byte goes if a string of ``length`` bytes over it also starts elsewhere in the input, in this text or another;
    matches stay within texts. A null text counts as empty; texts shorter than ``length`` stay whole. Repeated rows are
    texts of their own and lose what they share. Windows with equal least strings meet in one shard, where suffix
    ranks and common prefixes tell equal ones; equal segments are counted, not compared; an anchor of very many
    segments is cut into tiles that are merged by binary search.
    """
    keyed = _key(docs)
    spans = write_table(spark, repeated_spans(spark, keyed, length), "repeats")

    def of(batches):
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                rows = []
                for t, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = t.encode()
                    cut = _merged((x["s"], x["e"]) for x in spans or [])
                    kept, at = [], 0
                    for s, e in cut:
                        kept.append(raw[at:s])
                        at = e
                    kept = b"".join([*kept, raw[at:]])
                    rows.append((len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept))
                n, gone, m, sha, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(m, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    both = keyed.join(spans, "key", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(of, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
