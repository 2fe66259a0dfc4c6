"""SentencePiece encoding and decoding: streaming Viterbi over a given vocabulary."""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Chunks kept with their ids by each worker (as many new ones and as many of before), their greatest length, and pairs of pieces kept with whether they may meet.
MEMO, MEMO_CHARS, PAIRS = 100_000, 48, 1_000_000
#: The library's kinds of model and of pieces (fixed values of its file format), and what it adds to the least score of an unknown character.
UNIGRAM, BPE = 1, 2
NORMAL, BYTE = 1, 6
PENALTY = 10.0
#: Stands for the start of a text, where a piece is asked for.
START = 1 << 21


class Lattice:
    """Which pieces a text may be cut into, and at what cost. A piece is its id, or ~code point of a character without one.

    Unigram: any pieces may meet, each costs its negative log probability. BPE: every prefix of a text has one encoding,
    and a sequence of pieces is the encoding of its text just if any two neighbours alone stay as they are when merged;
    so at each boundary one piece survives, the one that may follow the survivor at its start, and costs play no part.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], bpe: bool):
        from ahocorasick import Automaton

        self.pieces, self.bpe = pieces, bpe
        self.text = {i: x for x, (i, _) in pieces.items()} | {START: ""}
        self.ends = Automaton()  # finds all pieces that end at a character
        for x, (i, score) in pieces.items():
            self.ends.add_word(x, (len(x), i, -score))
        self.ends.make_automaton()
        self.longest = max(map(len, pieces), default=1)
        self.unknown = PENALTY - min((s for _, s in pieces.values()), default=0.0)
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Characters merged as long as two neighbours make a piece: best score first, then leftmost."""
        parts, worst = list(text), (0, -math.inf)
        score = lambda i: self.pieces.get(parts[i] + parts[i + 1], worst)[1]
        gain = [score(i) for i in range(len(parts) - 1)]
        while gain and (top := max(gain)) > -math.inf:
            i = gain.index(top)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gain[i]
            if i:
                gain[i - 1] = score(i - 1)
            if i < len(gain):
                gain[i] = score(i)
        return parts

    def meet(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (START: nothing) in a BPE encoding."""
        both = [chr(~i) if i < 0 else self.text[i] for i in (left, right)]
        ok = self.merged("".join(both)) == [x for x in both if x]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[left << 22 | right & 0x3FFFFF] = ok
        return ok


def viterbi_stream(text: str, lattice: Lattice, commit: int = 64):
    """Yield the pieces of the best segmentation of ``text``; of equal costs that whose last pieces are longest.

    Only boundaries that a later piece can start at survive. Every ``commit`` characters their backpointers are
    followed; what lies before the boundary on which they converge is final, is yielded and forgotten.
    """
    n, bpe, pairs, meet = len(text), lattice.bpe, lattice.pairs, lattice.meet
    # Of the boundaries from ``base`` on: the piece that ends there, its start, the cost so far.
    last, start, cost, base, goal = [START], [0], [0.0], 0, commit

    def lone() -> None:
        at = len(last) - 1
        last.append(~ord(text[base + at]))
        start.append(at)
        if not bpe:
            cost.append(cost[at] + lattice.unknown)

    for at, (size, piece, c) in lattice.ends.iter(text):  # of those with one end the longest first
        end = at + 1 - base
        if len(last) <= end:
            while len(last) < end:
                lone()
            if end > goal:
                alive = set(range(max(0, end - lattice.longest), end))
                while len(alive) > 1:
                    alive.remove(top := max(alive))
                    alive.add(start[top])
                if (done := alive.pop()) > 0:
                    yield from _path(last, start, done)
                    base, end = base + done, end - done
                    start = [max(0, x - done) for x in start[done:]]
                    del last[:done], cost[:done]
                goal = end + commit
            if not bpe and text[at] not in lattice.pieces:
                lone()
        elif bpe:
            continue
        if bpe:
            left = last[end - size]
            if (ok := pairs.get(left << 22 | piece)) is None:
                ok = meet(left, piece)
            if ok:
                last.append(piece)
                start.append(end - size)
        elif len(last) <= end or cost[end - size] + c < cost[end]:
            last[end:], start[end:], cost[end:] = [piece], [end - size], [cost[end - size] + c]
    while len(last) <= n - base:
        lone()
    yield from _path(last, start, n - base)


def _path(last: list[int], start: list[int], end: int) -> list[int]:
    steps = []
    while end > 0:
        steps.append(last[end])
        end = start[end]
    return steps[::-1]


class Codec:
    """Encoder and decoder for one vocabulary file of the sentencepiece library; nothing is trained.

    Both kinds of model with normal and byte pieces are known; a file with pieces of other kinds is refused, as its
    ids could differ from the library's.
    """

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(SentencePieceProcessor(model_file=model_file).serialized_model_proto())
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE) or {p.type for p in proto.pieces} - {NORMAL, BYTE, 2, 3}:  # 2, 3: unknown and control
            raise ValueError(f"{model_file}: only unigram and BPE models of normal and byte pieces are known")
        self.byte_ids = [0] * 256
        self.table = [b""] * len(proto.pieces)
        pieces: dict[str, tuple[int, float]] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.table[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == NORMAL:
                x = p.piece.replace(SPACE, " ")
                pieces[x] = i, p.score
                self.table[i] = x.encode()
        self.lattice = Lattice(pieces, proto.trainer_spec.model_type == BPE)
        # A text may be cut where no piece joins the two sides: around line breaks, after spaces, between letters and others.
        apart = not any("\n" in x or " " in x.lstrip(" ") for x in pieces)
        other = "".join(sorted({c for x in pieces for c in x if c.isalnum() and not c.isalpha()}))
        letter = rf"[^\W\d_{re.escape(other)}]"
        mixed = any(re.search("a[^ a]|[^ a]a", re.sub(f"{letter}+", "a", x)) for x in pieces)
        self.chunks = re.compile(r"(?s).+" if not apart else r"\n| *[^ \n]+| +" if mixed else rf"\n| *{letter}+| *(?:(?!{letter})[^ \n])+| +")
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _ids(self, chunk: str) -> bytes:
        """Ids of a chunk that ``memo`` lacks. A full memo becomes ``before``, from which chunks that are met again come back."""
        if (ids := self.before.get(chunk)) is None:
            out = array("i")
            for i in viterbi_stream(chunk, self.lattice):
                if i >= 0:
                    out.append(i)
                else:
                    out.extend([self.byte_ids[x] for x in chr(~i).encode()])
            ids = out.tobytes()
        if len(chunk) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.before = self.memo.copy()
                self.memo.clear()  # stays the same object, which encode looks into
            self.memo[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """int32 ids of the text after a dummy space; none for an empty text."""
        if not text:
            return np.zeros(0, np.int32)
        memo, fresh = self.memo.get, self._ids
        return np.frombuffer(b"".join([memo(c) or fresh(c) for c in self.chunks.findall(" " + text)]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def _codec(model_file: str) -> Codec:
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def encode_decode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_chars, n_ids, ids (array of int), exact: whether decoding the ids gives the text back.

    Ids are those of the library for the same file without normalisation; only U+2581, which the library takes for a space,
    is spelt in byte pieces like other characters without a piece, so that decoding is exact. A null text counts as empty
    and has no ids. Rows are independent, repeated ones included; an empty table gives an empty result. Each worker keeps
    ids of at most twice MEMO short chunks.
    """

    def of(batches):
        codec = _codec(model_file)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [codec.encode(t) for t in texts]
                sizes = np.array([len(x) for x in ids], np.int32)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                exact = [codec.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(exact)],
                    names=["doc_id", "n_chars", "n_ids", "ids", "exact"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, n_chars long, n_ids long, ids array<int>, exact boolean")
