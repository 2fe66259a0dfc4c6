"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, mapped by workers."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.llm.common import LOWER, drop_table, new_path, write_table

END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\n</s>", b"\n<s>"))  # no word holds a line break
ORDER = 3
#: Tokens that a counting task holds at most, tokens scored at a time, characters for which one shard is made, the share
#: of documents (and their least number) in which common words are sought, and how many may be called hot and common.
CHUNK, PART, SHARD_CHARS, SHARE, LEAST, HOT, COMMON = 2_000_000, 400_000, 12_000_000, 1e-4, 2000, 100_000, 65_536
#: What a row of the merge holds: sums of a word, of a context of hot words, of what follows a hot word, or how many entries
#: occur once to four times.
WORD, CONTEXT, AFTER, TIMES = 0, 1, 2, 3
#: A context of one n-gram that occurs once: total, followers seen once, twice, more.
ONCE = (1, 1, 0, 0)


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words and of its end."""
    words = (text or "").encode().translate(LOWER).split()
    digest = xxhash.xxh3_64_intdigest
    return np.array([*map(digest, words), int(END)], np.uint64)


def _pair(w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    x = w1 * np.uint64(0x9E3779B97F4A7C15) + (w2 ^ (w2 >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB)


def _stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word before each, the one before that, and where texts begin."""
    parts = [tokens(t) for t in texts]
    sizes = np.array([len(p) for p in parts])
    z = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    y = np.concatenate(([START], z[:-1])).astype(np.uint64)
    y[starts] = START
    x = np.concatenate(([START], y[:-1])).astype(np.uint64)
    x[starts] = START
    return z, y, x, starts


def _batches(batch, column: int, most: int):
    """Slices of a batch of about ``most`` characters' worth of whole texts."""
    size = np.cumsum([len(t or "") + 1 for t in batch.column(column).to_pylist()])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _spread(key: np.ndarray, n: int) -> np.ndarray:
    return ((key * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _shard(y: np.ndarray, yz: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """By the middle word, where all it stands between meets; n-grams around hot words are spread by their last two words."""
    return np.where(_among(y, hot), _spread(yz, n), _spread(y, n))


def _among(y: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether words are hot; ``hot`` is sorted and holds START at least."""
    return hot[np.minimum(np.searchsorted(hot, y), len(hot) - 1)] == y


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, which compress better than whole numbers do."""
    head, body = [], []
    for k, a in arrays.items():
        if a.dtype.kind == "i":
            a = a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)
        head.append((k, a.dtype.str, len(a)))
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    h = json.dumps(head).encode()
    return len(h).to_bytes(4, "little") + h + zstandard.compress(b"".join(body), 1)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    body, at, out = zstandard.decompress(blob[4 + n :]), 0, {}
    for k, kind, size in json.loads(blob[4 : 4 + n]):
        d = np.dtype(kind)
        planes = np.frombuffer(body, np.uint8, size * d.itemsize, at).reshape(d.itemsize, size)
        out[k] = np.ascontiguousarray(planes.T).view(d).ravel()
        at += size * d.itemsize
    return out


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of values by key."""
    order = np.argsort(keys)
    k = keys[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return (k[at], *(np.add.reduceat(v[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for v in values))


class Table:
    """A sorted hash array with values, as one file that workers map.

    Keys are uniform 64-bit hashes. The upper bits of a key name its bucket (about 16 keys), the next 32 are kept, so an
    absent key is taken for one that is there with a chance of 4e-9. A key's values are a code into the distinct tuples
    of values, which are 64-bit and few.
    """

    def __init__(self, bits: int, index: np.ndarray, rest: np.ndarray, codes: np.ndarray, tuples: np.ndarray):
        self.bits, self.index, self.rest, self.codes, self.tuples = bits, index, rest, codes, tuples

    @staticmethod
    def _cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64), (keys << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def of(cls, keys: np.ndarray, *values: np.ndarray) -> Table:
        """Of ascending distinct keys."""
        bits = max(0, len(keys).bit_length() - 4)
        bucket, rest = cls._cut(keys, bits)
        mixed = np.zeros(len(keys), np.uint64)
        for v in values:
            mixed = _pair(mixed, v.astype(np.int64).view(np.uint64))
        _, at, codes = np.unique(mixed, return_index=True, return_inverse=True)
        tuples = np.stack([v.astype(np.int64)[at] for v in values], 1).reshape(-1, len(values))
        return cls(bits, np.searchsorted(bucket, np.arange((1 << bits) + 1)).astype(np.uint32), rest, codes.astype(np.min_scalar_type(max(0, len(at) - 1))), tuples)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """A row of values for each key, zeros where absent."""
        bucket, rest = self._cut(keys, self.bits)
        low, high = self.index[bucket].astype(np.int64), self.index[bucket + 1].astype(np.int64)
        end = high
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            less = open_ & (self.rest[np.minimum(mid, len(self.rest) - 1)] < rest)
            low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
        out = np.zeros((len(keys), self.tuples.shape[1]), np.int64)
        hit = np.flatnonzero(low < end)
        hit = hit[self.rest[low[hit]] == rest[hit]]
        out[hit] = self.tuples[self.codes[low[hit]]]
        return out

    def save(self, folder: str, name: str) -> None:
        """Under a name of its own first, then under ``name``: a repeated task replaces a file by an equal one."""
        from pyarrow import fs

        f, path = fs.FileSystem.from_uri(folder)
        arrays = (self.index, self.rest, self.codes, self.tuples)
        head = json.dumps([self.bits, [(a.dtype.str, a.shape) for a in arrays]]).encode()
        with f.open_output_stream(tried := f"{path}/{name}-{uuid.uuid4().hex}") as out:
            out.write((len(head).to_bytes(8, "little") + head).ljust(1024))
            for a in arrays:
                out.write(np.ascontiguousarray(a).tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0"))
        f.move(tried, f"{path}/{name}")

    @classmethod
    def load(cls, folder: str, name: str) -> Table | None:
        """The mapped file, or None if no shard of that name was written."""
        path = _local_path(folder, name)
        if path is None:
            return None
        with open(path, "rb") as f:
            head = f.read(1024)
        bits, shapes = json.loads(head[8 : 8 + int.from_bytes(head[:8], "little")])
        at, arrays = 1024, []
        for kind, shape in shapes:
            size = int(np.prod(shape)) * np.dtype(kind).itemsize
            arrays.append(np.memmap(path, kind, "r", at, tuple(shape)) if size else np.zeros(shape, kind))
            at += -(-size // 8) * 8
        return cls(bits, *arrays)


_copies: list[tempfile.TemporaryDirectory] = []


def _local_path(folder: str, name: str) -> str | None:
    """Where the file can be mapped; from a remote store it is copied to a folder that goes with this worker."""
    from pyarrow import fs

    f, path = fs.FileSystem.from_uri(f"{folder}/{name}")
    if f.get_file_info(path).type != fs.FileType.File:
        return None
    if isinstance(f, fs.LocalFileSystem):
        return urlparse(folder).path + "/" + name
    if not _copies:
        _copies.append(tempfile.TemporaryDirectory())
    local = os.path.join(_copies[0].name, uuid.uuid4().hex)
    with f.open_input_stream(path) as src, open(local, "wb") as out:
        while chunk := src.read(1 << 22):
            out.write(chunk)
    return local


def _discounts(counts: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney from the numbers of entries that occur once to four times."""
    n1, n2, n3, n4 = map(float, counts)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0)
    return tuple(float(np.clip(x, 0.01, most)) for x, most in zip(d, (0.99, 1.99, 2.99), strict=True))


def _off(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(n > 2, d[2], np.where(n == 2, d[1], np.where(n == 1, d[0], 0.0)))


class Model:
    """Looks up the tables of ``train``. ``meta`` holds totals and the hot words, nothing for each shard."""

    MAPS = 8192

    def __init__(self, meta: dict):
        self.meta, self.hot = meta, np.array(meta["hot"], np.uint64)
        self.held: dict[tuple[str, int], Table | None] = {}

    def _find(self, kind: str, shard: np.ndarray, key: np.ndarray, values: int) -> np.ndarray:
        out = np.zeros((len(key), values), np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) != 0))) if len(order) else []
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            at = order[a:b]
            name = kind, int(shard[at[0]])
            if name not in self.held:
                if len(self.held) >= self.MAPS:
                    self.held.clear()
                self.held[name] = Table.load(self.meta["folder"], f"{kind}-{name[1]}")
            if (table := self.held[name]) is not None:
                out[at] = table.find(key[at])
        return out

    def words(self, w: np.ndarray) -> np.ndarray:
        """How often each word occurs, and after how many others."""
        u, back = np.unique(w, return_inverse=True)
        return self._find("words", _spread(u, self.meta["shards"]), u, 2)[back]

    def contexts(self, kind: str, hot_kind: str, last: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Total, followers once, twice, more of contexts that end in the words ``last``."""
        u, at, back = np.unique(key, return_index=True, return_inverse=True)
        warm, out = _among(last[at], self.hot), np.zeros((len(u), 4), np.int64)
        for name, some, by in ((kind, ~warm, last[at]), (hot_kind, warm, u)):
            out[some] = self._find(name, _spread(by[some], self.meta["shards"]), u[some], 4)
        return out[back]

    def logs(self, z: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of the model's and of the base probability of each word, and its count."""
        m, shards = self.meta, self.meta["shards"]
        c, cc = self.words(z).T
        every, v = max(1, m["pairs"]), m["vocabulary"]
        spare = sum(a * b for a, b in zip(m["d1"], m["kinds"], strict=True)) / every if m["pairs"] else 1.0
        p = np.maximum(cc - _off(cc, m["d1"]), 0) / every + spare / (v + 1)
        yz = _pair(y, z)
        u, at, back = np.unique(yz, return_index=True, return_inverse=True)
        n = self._find("pairs", _shard(y[at], u, self.hot, shards), u, 1)[back, 0]
        p = _interpolated(n, self.contexts("after", "afterhot", y, y), m["d2"], p)
        if m["order"] > 2:
            # A pair that was seen is a context too, as no text ends before its end mark; the tables leave out those seen once.
            known = np.concatenate(([False], n[:-1] > 0))
            known[y == START] = m["n"] > 0
            xy = _pair(x, y)
            seen = self.contexts("contexts", "hot", y, xy)
            seen[known & (seen[:, 0] == 0)] = ONCE
            u, at, first = np.unique(_pair(xy, z), return_index=True, return_inverse=True)
            n = self._find("triples", _shard(y[at], yz[at], self.hot, shards), u, 1)[first, 0]
            p = _interpolated(n, seen, m["d3"], p)
        return np.log10(p), np.log10((c + 1) / (m["n"] + v + 1)), c


def _interpolated(n: np.ndarray, context: np.ndarray, d: tuple[float, float, float], low: np.ndarray) -> np.ndarray:
    """Discounted share of n-grams seen n times after a context (total, followers once, twice, more), the rest by ``low``."""
    total = context[:, 0]
    t = np.maximum(total, 1)
    return np.where(total > 0, np.maximum(n - _off(n, d), 0) / t + context[:, 1:] @ np.array(d) / t * low, low)


def _followers(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, the sums of n, and how many n are one, two and more."""
    return _sums(keys, n, n == 1, n == 2, n > 2)


def train(spark: SparkSession, docs: DataFrame, order: int = ORDER) -> dict:
    """Count n-grams of all ``docs``, up to ``order`` (2 or 3), and write the model's tables; gives what locates and completes them.

    Tasks count their own texts and send packed counts to shards by the middle word, at most a row for each shard that
    they have n-grams of and never more rows than n-grams. A shard sums them and writes its tables: n-grams, what
    stands before and behind its words. Sums of words, and of contexts of hot words, which are spread, go through one
    ordinary shuffle of rows. Hot and common words are sought in a share of the documents; any choice gives the same counts.
    The driver gets totals alone. All counts have 64 bits.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    folder = new_path(spark, "ngrams")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    size = docs.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).first()
    shards = max(8, -(-(size["chars"] or 0) // SHARD_CHARS))

    def frequent(batches):
        for b in batches:
            w, n = np.unique(_stream(b.column(0).to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n"])

    some = docs.select("text").sample(min(1.0, max(SHARE, LEAST / max(1, size["n"]))), 0)
    seen = write_table(spark, some.mapInArrow(frequent, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "frequent")
    total = seen.agg(F.sum("n")).first()[0] or 1
    top = seen.orderBy(F.desc("n"), "w").limit(max(HOT, COMMON)).collect()  # 100 000 hashes at most
    drop_table(spark, seen)
    hashes = lambda rows: np.unique(np.array([int(np.int64(r["w"]).view(np.uint64)) for r in rows] + [int(START)], np.uint64))
    hot = hashes(r for r in top[:HOT] if r["n"] > 1.5 * total / shards)
    shared = spark.sparkContext.broadcast(hashes(top[:COMMON]))  # half a MB: words that blobs name by number

    def count(batches):
        held, size = [], 0

        def flush():
            z, y, x = (np.concatenate([h[i] for h in held]) for i in range(3))
            if order == 2:
                x[:] = 0
            yz = _pair(y, z)
            shard = _shard(y, yz, hot, shards)
            key = _pair(_pair(x, y), z)
            by = np.lexsort((key, shard)) if shards > 1 << 16 else np.argsort(shard.astype(np.uint64) << np.uint64(48) | key >> np.uint64(16))
            k, s = key[by], shard[by]
            new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]))))
            n = np.diff(np.concatenate((new, [len(by)])))
            at, s = by[new], s[new]
            del k, key, yz, shard, by
            vocabulary, ids = np.unique(np.concatenate((x[at], y[at], z[at])), return_inverse=True)
            ids = ids.reshape(3, -1)
            common = shared.value
            place = np.minimum(np.searchsorted(common, vocabulary), len(common) - 1)
            rare = common[place] != vocabulary
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(s) != 0)))
            names, blobs = [], []
            for a, b in zip(cuts, [*cuts[1:], len(s)], strict=True):
                part = ids[:, a:b]
                own = np.zeros(len(vocabulary), bool)
                own[part.ravel()] = True
                own = np.flatnonzero(own & rare)
                place[own] = len(common) + np.arange(len(own))
                part = place[part]
                order_ = np.argsort(part[1], kind="stable")
                i, j, k = part[:, order_]
                names.append(int(s[a]))
                blobs.append(_pack(words=np.diff(vocabulary[own], prepend=np.uint64(0)), i=i, j=np.diff(j, prepend=0), k=k, n=n[a:b][order_]))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

        for b in batches:
            for part in _batches(b, 0, 2_000_000):
                held.append(_stream(part.column(0).to_pylist())[:3])
                size += len(held[-1][0])
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, parts = int(pdf.shard.iloc[0]), []
        for b in pdf.blob:
            p = _unpack(b)
            words = np.concatenate((shared.value, np.cumsum(p["words"], dtype=np.uint64)))
            parts.append((words[p["i"]], words[np.cumsum(p["j"], dtype=np.int64)], words[p["k"]], p["n"].astype(np.int64)))
        x, y, z, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
        del parts
        key = _pair(_pair(x, y), z)
        by = np.argsort(key)
        key, x, y, z, n = key[by], x[by], y[by], z[by], n[by]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, x, y, z, n = key[at], x[at], y[at], z[at], np.add.reduceat(n, at)
        rows = []

        def times(level: int, counts: np.ndarray) -> None:
            rows.append(pd.DataFrame({"kind": [TIMES], "shard": [level], "key": [0], **{f"v{k}": [int((counts == k + 1).sum())] for k in range(4)}}))

        def sums(kind: int, keys: np.ndarray, *columns: np.ndarray) -> None:
            rows.append(pd.DataFrame({"kind": kind, "shard": _spread(keys, shards), "key": keys.view(np.int64), **dict(zip(VALUES, columns, strict=False))}))

        if order == 3:
            times(3, n)
            Table.of(key, n).save(folder, f"triples-{shard}")
            warm = _among(y, hot)
            if warm.any():  # their contexts are spread over shards
                h, *v = _followers(_pair(x[warm], y[warm]), n[warm])
                sums(CONTEXT, h, *v)
            k, *v = _followers(_pair(x[~warm], y[~warm]), n[~warm])
            more = v[0] > 1
            if more.any():
                Table.of(k[more], *[c[more] for c in v]).save(folder, f"contexts-{shard}")
        yz = _pair(y, z)
        by = np.argsort(yz)
        at = np.flatnonzero(np.concatenate(([True], yz[by][1:] != yz[by][:-1])))
        first, c = by[at], np.add.reduceat(n[by], at)
        kinds = np.diff(np.concatenate((at, [len(by)]))) if order == 3 else c
        times(2, kinds)
        Table.of(yz[first], kinds).save(folder, f"pairs-{shard}")
        w, *v = _sums(z[first], c, np.ones(len(first), np.int64))
        sums(WORD, w, *v)
        w, *v = _followers(y[first], kinds)
        warm = _among(w, hot)
        sums(AFTER, w[warm], *[c[warm] for c in v])
        if not warm.all():
            Table.of(w[~warm], *[c[~warm] for c in v]).save(folder, f"after-{shard}")
        return pd.concat(rows).reindex(columns=COLUMNS).fillna(0).astype({"kind": "int32", **dict.fromkeys(COLUMNS[1:], "int64")})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums of a shard's words or contexts, written as a table; a row of totals of level 1, or those of higher levels."""
        kind, shard = int(pdf.kind.iloc[0]), int(pdf.shard.iloc[0])
        keys, *values = _sums(pdf.key.to_numpy().view(np.uint64), *[pdf[v].to_numpy() for v in (VALUES[:2] if kind == WORD else VALUES)])
        if kind == CONTEXT:
            more = values[0] > 1
            if more.any():
                Table.of(keys[more], *[v[more] for v in values]).save(folder, f"hot-{shard}")
            made = [0] * 9
        elif kind == AFTER:
            Table.of(keys, *values).save(folder, f"afterhot-{shard}")
            made = [0] * 9
        elif kind == WORD:
            Table.of(keys, *values).save(folder, f"words-{shard}")
            c, cc = values
            made = [1, c.sum(), (c > 0).sum(), cc.sum(), *((cc == k).sum() for k in (1, 2, 3, 4)), (cc > 2).sum()]
        else:
            made = [shard, 0, 0, 0, *(v[0] for v in values), 0]
        return pd.DataFrame([[int(x) for x in made]], columns=TOTALS)

    schema = "kind int, " + ", ".join(f"{c} long" for c in COLUMNS[1:])
    sent = docs.select("text").mapInArrow(count, "shard long, blob binary")
    made = sent.groupBy("shard").applyInPandas(merge, schema).groupBy("kind", "shard").applyInPandas(gather, ", ".join(f"{t} long" for t in TOTALS))
    made = write_table(spark, made, "ngramtables")
    rows = {r["level"]: r.asDict() for r in made.groupBy("level").agg(*[F.sum(k).alias(k) for k in TOTALS[1:]]).collect()}  # a row a level
    drop_table(spark, made)
    t = rows.get(1, dict.fromkeys(TOTALS, 0))
    levels = {k: np.array([r[f"k{i}"] for i in (1, 2, 3, 4)]) for k, r in rows.items()}
    nothing = np.zeros(4)
    return {
        "folder": folder, "order": order, "shards": shards, "hot": [int(h) for h in hot], "n": t["n"], "vocabulary": t["v"], "pairs": t["pairs"], "kinds": [t["k1"], t["k2"], t["more"]],
        "d1": _discounts(levels.get(1, nothing)), "d2": _discounts(levels.get(2, nothing)), "d3": _discounts(levels.get(3, nothing)),
    }


VALUES = [f"v{i}" for i in range(4)]
COLUMNS = ["kind", "shard", "key", *VALUES]
TOTALS = ["level", "n", "v", "pairs", "k1", "k2", "k3", "k4", "more"]


def held_out(doc_id, parts: int = 7, which: int = 2):
    """A null id counts as training."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == which, F.lit(False))


def score_documents(spark: SparkSession, docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each whole text.

    The model learns from all documents that are not held out; a text begins with as many start marks as contexts are
    long. Below the highest order an n-gram counts once for each word before it. A null text counts as empty and holds its end alone.
    Without training documents every probability is that of the uniform distribution over one unknown word. Repeated
    rows count as often as they occur and are scored alike.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    meta = train(spark, d.where(~F.col("held_out")), order)

    def of(batches):
        model = Model(meta)
        for b in batches:
            for part in _batches(b, 1, 6 * PART):
                w, y, x, starts = _stream(part.column(1).to_pylist())
                score, base, c = model.logs(w, y, x)
                add = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                n = np.diff(np.concatenate((starts, [len(w)])))
                s = add(score)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *map(pa.array, (n, add((c > 0).astype(np.int64)), np.full(len(n), meta["n"], np.int64), add(base), s, 10 ** np.minimum(300, -s / n)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return d.mapInArrow(of, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
