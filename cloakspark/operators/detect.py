"""Model detectors: chunking of long texts, and an adapter that runs a plug-in on Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Callable, Iterable
from functools import partial
from importlib.util import find_spec
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakspark.functions import names, spans
from cloakspark.functions.patterns import NER_METHODS

CHUNK, OVERLAP, SNAP = 1200, 250, 100
#: Chunks that a detector with ``batch`` gets at once, and rows whose chunks are gathered.
BATCH, ROWS = 32, 256


class Detector(Protocol):
    """Made once per task by a factory; finds (label, start, end, confidence) in one chunk. ``batch`` may take several at once."""

    def __call__(self, chunk: str) -> Iterable[tuple[str, int, int, float]]: ...


def chunk_bounds(text: str, size: int = CHUNK, overlap: int = OVERLAP, snap: int = SNAP) -> list[tuple[int, int]]:
    """(start, end) of chunks of about ``size`` characters that overlap; both ends are moved to line ends, else spaces.

    An end moves back ``snap`` at most; a start moves forward within the overlap. Every chunk starts after the one before.
    """
    out, start, n = [], 0, len(text)
    while n - start > size:
        floor = max(start, start + size - snap)
        cut = max(text.rfind("\n", floor, start + size), -1)
        cut = cut if cut >= 0 else text.rfind(" ", floor, start + size)
        end = cut + 1 if cut > start else start + size
        out.append((start, end))
        nxt = end - overlap
        if nxt > start:
            for mark in "\n ":
                if (at := text.find(mark, nxt, end)) >= 0:
                    nxt = at + 1
                    break
        start = nxt if nxt > start else end
    if start < n:
        out.append((start, n))
    return out


def scan_chunks(detector: Detector, chunks: list[str]) -> list[list[tuple[str, int, int, float]]]:
    """Findings of each chunk: BATCH chunks at a time where the detector has ``batch``, else one by one."""
    if not hasattr(detector, "batch"):
        return [list(detector(c)) for c in chunks]
    return [list(f) for k in range(0, len(chunks), BATCH) for f in detector.batch(chunks[k : k + BATCH])]


def detect_texts(texts: list[str | None], detector: Detector, threshold: float) -> list[list[tuple[str, int, int, float]]]:
    """Spans of each text over all of its chunks; the first of overlapping ones stays. Chunks of all texts go together."""
    bounds = [chunk_bounds(t or "") for t in texts]
    found = iter(scan_chunks(detector, [t[a:b] for t, own in zip(texts, bounds, strict=True) for a, b in own]))
    out = []
    for own in bounds:
        starts: list[int] = []
        kept: list[tuple[str, int, int, float]] = []
        for a, _ in own:
            for label, s, e, c in next(found):
                s, e = s + a, e + a
                k = bisect(starts, s)
                if c >= threshold and not (k and kept[k - 1][2] > s) and not (k < len(kept) and kept[k][1] < e):
                    starts.insert(k, s)
                    kept.insert(k, (label, s, e, float(c)))
        out.append(kept)
    return out


def detect_text(text: str | None, detector: Detector, threshold: float) -> list[tuple[str, int, int, float]]:
    return detect_texts([text], detector, threshold)[0]


def available(module: str = "gliner") -> bool:
    """Whether the package of a model detector is installed here."""
    return find_spec(module) is not None


class ModelDetector:
    """A span model of the optional package ``gliner``, by name or folder, as a detector that takes batches of chunks."""

    def __init__(self, model: str, labels: tuple[str, ...] = tuple(NER_METHODS), threshold: float = 0.4):
        if not available():
            raise RuntimeError("the package gliner is not installed; use DictionaryDetector or another detector")
        from gliner import GLiNER

        self.model, self.labels, self.threshold = GLiNER.from_pretrained(model), list(labels), threshold

    def batch(self, chunks: list[str]):
        for found in self.model.batch_predict_entities(chunks, self.labels, threshold=self.threshold):
            yield [(x["label"], x["start"], x["end"], x["score"]) for x in found if x["label"] in NER_METHODS]

    def __call__(self, chunk: str):
        return next(iter(self.batch([chunk])))


def detector_factory(model: str | None = None) -> Callable[[], Detector]:
    """What makes a detector in each task: of ``model`` if one is named and its package is there, else the dictionary."""
    return DictionaryDetector if model is None or not available() else partial(ModelDetector, model)


class DictionaryDetector:
    """The default where no model is installed: runs of capitalised words with a known name, as persons."""

    _run = re.compile(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\b")

    def __call__(self, chunk: str):
        for m in self._run.finditer(chunk):
            known = [w for w in m[0].split() if w.lower() in names.KNOWN]
            if known:
                yield "person", m.start(), m.end(), 0.9 if len(known) > 1 else 0.6


def with_model_spans(df: DataFrame, columns: list[str], factory: Callable[[], Detector] = DictionaryDetector, threshold: float = 0.4, prefix: str = "_n_") -> DataFrame:
    """``df`` with an array of spans for each text column, found on the raw text. The factory runs once a task."""
    at = [df.columns.index(c) for c in columns]
    names_out = [*df.columns, *[prefix + c for c in columns]]
    kind = pa.list_(pa.struct([("prio", pa.int32()), ("neg", pa.int32()), ("ord", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("confidence", pa.float64())]))
    orders = {x: spans.ner_ord(x) for x in NER_METHODS}

    def of(batches):
        detector = factory()
        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            made = []
            for i in at:
                texts = b.column(i).to_pylist()
                rows = [
                    [{"prio": 1, "neg": s - e, "ord": orders[label], "start": s, "end": e, "text": t[s:e], "confidence": c} for label, s, e, c in found]
                    for t, found in zip(texts, detect_texts(texts, detector, threshold), strict=True)
                ]
                made.append(pa.array(rows, kind))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=names_out)

    schema = df.limit(0).select("*", *[F.lit(None).cast(spans.SPANS).alias(prefix + c) for c in columns]).schema
    return df.mapInArrow(of, schema)


def chunks(df: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk, start, length of every text's chunks; a null or empty text has none."""

    def of(batches):
        for b in batches:
            rows = [(k, i, a, e - a) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, (a, e) in enumerate(chunk_bounds(t or "", size, overlap))]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[key, "chunk", "start", "length"])

    return df.select(F.col(key).cast("long"), text).mapInArrow(of, f"`{key}` long, chunk long, start long, length long")
