"""N-best segmentation into SentencePiece pieces, and decoding.

A text is a lattice: its pieces are edges between positions. Forward Viterbi gives the best score from
the start to every position; those scores are exact heuristics for an A-star search from the end
backwards, so complete segmentations leave the queue best first and each step of the search is on
one of the best paths.

Where no piece of the vocabulary runs from a character over into a following space, which is looked
up when it is loaded, a text falls into units (spaces and a word) whose segmentations are independent:
units are searched on their own and kept in a bounded table, and a second exact search joins their
alternatives to the N best of the whole text, however long it is.

Characters without a piece, and a literal U+2581, become byte pieces, so decoding gives back the text
exactly. Scores are the model's log probabilities; where the model's scores are merge ranks (BPE
files), a piece of rank r counts as log 1/(r + 1), up to a constant (Zipf's law).

``encode`` gives the ids of the library itself, with the model's own merges and normalisation; ``decode``
takes either's ids.

Defined cases: null counts as empty; an empty text has one segmentation, of no pieces, with score 0;
ties (scores within 1e-9): in a unit the longer last piece comes first, then the longer one before it, and so on; in a
text of several units the segmentations stand in the order of their changes from the best, listed from the
left as (number of the unit, rank among its alternatives); a text with fewer than N
segmentations has them all; repeated rows get equal answers; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, ship, steps

SPACE = "▁"
N_BEST = 3
#: Bytes, about, of each of the two generations of units that a worker keeps, and what an entry takes besides its unit's characters.
CACHE_BYTES, ENTRY_BYTES = 200_000_000, 400
_UNIT = re.compile(r" *[^ ]+| +")


class _Path:
    """Pieces from a position to the end; of two, the one whose last pieces are longer comes first.

    ``jump`` leads to an earlier node, as far as a node's depth alone decides, so that two long
    paths are compared in a logarithm of their lengths.
    """

    __slots__ = ("depth", "ids", "jump", "rest", "start")

    def __init__(self, start: int, ids: tuple, rest: _Path | None):
        self.start, self.ids, self.rest = start, ids, rest
        self.depth, self.jump = 0, self
        if rest is not None:
            far = rest.jump
            self.depth = rest.depth + 1
            self.jump = far.jump if rest.depth - far.depth == far.depth - far.jump.depth else rest

    def up_to(self, depth: int) -> _Path:
        p = self
        while p.depth > depth:
            p = p.jump if p.jump.depth >= depth else p.rest
        return p

    def __lt__(self, other: _Path) -> bool:
        depth = min(self.depth, other.depth)
        a, b = self.up_to(depth), other.up_to(depth)
        if a is b:
            return self.depth < other.depth
        while a.rest is not b.rest:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.rest, b.rest)
        return a.start < b.start


class Lattice:
    """Segmentation under one SentencePiece model file."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = self.processor = SentencePieceProcessor(model_file=model_file)
        size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        raw = [sp.get_score(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranks = min(raw[i] for i in plain) < -1000
        score = (lambda s: -math.log(1 - s)) if ranks else (lambda s: s)
        self.pieces = {names[i].replace(SPACE, " "): (i, score(raw[i])) for i in plain if raw[i] > -1e8 or not ranks}
        self.longest = max(map(len, self.pieces))
        self.matches = ahocorasick.Automaton()
        for p, (i, s) in self.pieces.items():
            self.matches.add_word(p, (len(p), i, s))
        self.matches.make_automaton()
        self.byte = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_score = min(s for _, s in self.pieces.values()) - 2
        self.raw = {i: p.encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.unk = sp.unk_id()
        self.kind, self.code = ("<u2", "H") if size <= 1 << 16 else ("<u4", "I")
        self.by_unit = not any(re.search("[^ ] ", p) for p in self.pieces)
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.held = 0  # bytes of known

    def edges(self, text: str) -> tuple[list[list[tuple]], list[float]]:
        """Edges (start, score, ids) by end, and the best score from the start to each position. " " stands for U+2581."""
        n, get, longest = len(text), self.pieces.get, self.longest
        into: list[list[tuple]] = [[] for _ in range(n + 1)]
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            b = best[i]
            for j in range(i + 1, min(n, i + longest) + 1):
                hit = get(text[i:j])
                if hit is not None:
                    into[j].append((i, hit[1], (hit[0],)))
                    if b + hit[1] > best[j]:
                        best[j] = b + hit[1]
            if not into[i + 1] or into[i + 1][-1][0] != i:  # the character itself is no piece
                raw = text[i].encode("utf-8", "replace")
                ids = tuple(self.byte.get(x, self.unk) for x in raw)
                into[i + 1].append((i, self.byte_score * len(ids), ids))
                best[i + 1] = max(best[i + 1], b + self.byte_score * len(ids))
        return into, best

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids), best first."""
        into, best = self.edges(text)
        queue, out = [(-round(best[-1], 9), _Path(len(text), (), None), 0.0)], []
        while queue and len(out) < n:
            _, path, behind = heapq.heappop(queue)
            if path.start == 0:
                ids: list[int] = []
                p: _Path | None = path
                while p is not None:
                    ids += p.ids
                    p = p.rest
                out.append((behind, tuple(ids)))
                continue
            for start, s, ids in into[path.start]:
                heapq.heappush(queue, (-round(behind + s + best[start], 9), _Path(start, ids, path), behind + s))
        return out

    def unit(self, u: str) -> tuple[bytes, float, float]:
        """(packed ids, score, loss of the second best), by the two best scores from the start to each position."""
        n, low = len(u), -math.inf
        first, second, via = [low] * (n + 1), [low] * (n + 1), [None] * (n + 1)
        first[0] = 0.0
        found = list(self.matches.iter(u))  # by end, longest first
        k, count = 0, len(found)
        for end in range(1, n + 1):
            f = g = low
            v, alone = None, True
            while k < count and found[k][0] < end:
                size, i, s = found[k][1]
                k += 1
                if size == 1:
                    alone = False
                at = end - size
                x = first[at] + s
                if x > f + 1e-9:
                    y = second[at] + s
                    g = f if f > y else y
                    f, v = x, (at, i)
                elif x > g:
                    g = x
            if alone:  # the character itself is no piece
                ids = [self.byte.get(x, self.unk) for x in u[end - 1].encode("utf-8", "replace")]
                s = self.byte_score * len(ids)
                x = first[end - 1] + s
                if x > f + 1e-9:
                    y = second[end - 1] + s
                    g = f if f > y else y
                    f, v = x, (end - 1, ids)
                elif x > g:
                    g = x
            first[end], second[end], via[end] = f, g, v
        ids, at = [], n
        while at:
            at, x = via[at]
            if type(x) is int:
                ids.append(x)
            else:
                ids += x[::-1]
        return self.pack(ids[::-1]), first[n], max(0.0, first[n] - second[n])

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def others(self, u: str, n: int) -> list[tuple[float, int, bytes]]:
        """The n - 1 best (loss, rank, packed ids) besides the best of a unit."""
        best, score, _ = self._entry(u)
        found = ((score - s, self.pack(ids)) for s, ids in self.n_best(u, n))
        return [(loss, r, x) for r, (loss, x) in enumerate(f for f in found if f[1] != best)][: n - 1]

    def segment(self, text: str, n: int = N_BEST) -> list[tuple[float, bytes]]:
        """The n best (score, packed ids) of a whole text."""
        if not text:
            return [(0.0, b"")]
        spaced = " " + text
        units: list = []
        for k, part in enumerate(spaced.split(SPACE)):  # a literal U+2581 stands apart, as bytes
            units += [None] * bool(k)
            units += _UNIT.findall(part) if self.by_unit else [part] * bool(part)
        mark = (self.pack([self.byte.get(x, self.unk) for x in SPACE.encode()]), 3 * self.byte_score, math.inf)
        entries = [mark if u is None else self._entry(u) for u in units]
        total = math.fsum([e[1] for e in entries])
        out = [(total, b"".join([e[0] for e in entries]))]
        if n > 1:
            # the n - 1 cheapest alternatives are all that can be among the n best, and of equal ones those on the left
            loss = np.round(np.fromiter((e[2] for e in entries), float, len(entries)), 9)
            near = [int(i) for i in np.argsort(loss, kind="stable")[: n - 1] if loss[i] < math.inf]
            cheap = sorted((round(x, 9), i, r, packed, x) for i in near for x, r, packed in self.others(units[i], n))[: n - 1]
            ways: list[tuple] = [(0.0, ())]
            for a in cheap:
                more = [(x + a[4], (*w, a)) for x, w in ways if all(a[1] != b[1] for b in w)]
                ways = sorted([*ways, *more], key=lambda w: (round(w[0], 9), sorted((b[1], b[2]) for b in w[1])))[:n]
            for x, way in ways[1:]:
                swap = {a[1]: a[3] for a in way}
                out.append((total - x, b"".join([swap.get(i, e[0]) for i, e in enumerate(entries)])))
        return out

    def _entry(self, u: str) -> tuple[bytes, float, float]:
        e = self.known.get(u)
        if e is None:
            if self.held >= CACHE_BYTES:
                self.older, self.known, self.held = self.known, {}, 0
            e = self.known[u] = self.older.get(u) or self.unit(u)
            self.held += ENTRY_BYTES + 4 * len(u)
        return e

    def decode(self, packed: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(packed, self.kind).tolist()))
        return raw.decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def loaded(model_file: str) -> Lattice:
    """One for each worker process, whose tables its tasks share."""
    return Lattice(model_file)


def segment(df: DataFrame, model_file: str, n: int = N_BEST, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each text and rank: key, rank, score, n_pieces, ids_crc32, decoded_crc32, and the ids if ``with_ids``."""

    def run(batches):
        lattice = loaded(model_file)
        width = np.dtype(lattice.kind).itemsize
        for b in steps(batches, text, 1_000_000):
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for rank, (score, packed) in enumerate(lattice.segment(t or "", n), 1):
                    decoded = zlib.crc32(lattice.decode(packed).encode("utf-8", "replace")) if rank == 1 else None
                    ids = np.frombuffer(packed, lattice.kind)
                    row = (k, rank, score, len(packed) // width, zlib.crc32(ids.astype("<u4").tobytes()), decoded)
                    out.append((*row, ids.tolist()) if with_ids else row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["key", "rank", "score", "n_pieces", "ids_crc32", "decoded_crc32", "ids"][: 6 + with_ids]
    kinds = [to_arrow_type(df.schema[key].dataType), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    kind = df.schema[key].dataType.simpleString()
    ship(df.sparkSession)
    made = df.select(key, text).mapInArrow(run, f"key {kind}, rank int, score double, n_pieces long, ids_crc32 long, decoded_crc32 long" + ", ids array<int>" * with_ids)
    return made.withColumnRenamed("key", key)


def encode(df: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids): the library's own encoding of each text; a null text has no ids."""

    def run(batches):
        processor = loaded(model_file).processor
        for b in steps(batches, text, 1_000_000):
            ids = processor.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    ship(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, model_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, text) from lists of ids; null ids give null."""

    def run(batches):
        lattice = loaded(model_file)
        for b in batches:
            texts = [None if x is None else lattice.decode(np.array(x, lattice.kind).tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    ship(df.sparkSession)
    return df.select(key, ids).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def model_file() -> str:
    """The public model file that the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every document."""
    return segment(documents(spark, sf_dir), model_file())
