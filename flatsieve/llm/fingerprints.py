"""Document fingerprints by one-permutation MinHash.

The 64-bit hashes of a text's word shingles are dealt to BINS bins by their top bits, once, and
each bin keeps its least. An empty bin takes the value of the bin that a fixed sequence of hashes
of its own number finds first among the filled ones (optimal densification), so any two texts take
from the same bins. BITS low-order bits of each bin are packed; the likeness of two fingerprints
corrects the share of equal bins for the 2^-BITS by which unlike bins agree.

Defined cases: words are runs of what isn't ASCII white space, lower-cased; a text with fewer words
than a shingle is one shingle; null and blank texts are one empty shingle, so they are alike among
themselves; equal texts have equal fingerprints; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_steps, ship, steps

BINS = 256
BITS = 8
WORDS = 5
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _turns(n: int, tries: int) -> np.ndarray:
    """try x bin: where an empty bin looks next."""
    at = np.arange(tries, dtype=np.uint64)[:, None] * np.uint64(n) + np.arange(n, dtype=np.uint64) + np.uint64(1)
    return (_mixed(at) % np.uint64(n)).astype(np.int32)


_TURNS: dict[int, np.ndarray] = {}


def word_hashes(text: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 7) for w in text.lower().encode("utf-8", "replace").split()] or [0], np.uint64)


def shingles_of(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of runs of ``words`` words, or of all words where they are fewer."""
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _MULTIPLIERS[i % len(_MULTIPLIERS)]
        out ^= out >> np.uint64(29)
    return _mixed(out)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    return shingles_of(word_hashes(text), words)


def fingerprint(text: str, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> bytes:
    """``bins`` x ``bits`` packed bits; ``bins`` is a power of two."""
    h = np.sort(shingle_hashes(text, words))
    of = (h >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int32)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    least, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    least[of[first]], filled[of[first]] = h[first], True
    if not filled.all():
        if bins not in _TURNS:
            _TURNS[bins] = _turns(bins, 16 * bins)
        empty, source = np.flatnonzero(~filled), np.full(bins, -1)
        for a, b in ((0, 24), (24, 16 * bins)):
            hit = filled[_TURNS[bins][a:b, empty]]
            got = hit.argmax(0)
            done = hit[got, np.arange(len(empty))]
            source[empty[done]] = _TURNS[bins][a:b, empty][got, np.arange(len(empty))][done]
            empty = empty[~done]
            if not len(empty):
                break
        if len(empty):  # about exp(-16) of the bins of a text with one shingle
            source[empty] = of[first[0]]
        take = np.flatnonzero(~filled)
        least[take] = least[source[take]]
    low = (least & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return low.tobytes() if bits == 8 else np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - bits :]).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimate of the Jaccard similarity of two texts' shingles, 0 to 1."""
    x, y = (np.frombuffer(v, np.uint8) if bits == 8 else np.packbits(np.unpackbits(np.frombuffer(v, np.uint8)).reshape(-1, bits), axis=1) for v in (a, b))
    chance = 2.0**-bits
    return float(max(0.0, ((x == y).mean() - chance) / (1 - chance)))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fingerprint): packed bytes, for texts as they stand."""
    def make():
        return lambda c: c | {"fingerprint": [fingerprint(t or "") for t in c[text]]}

    return map_steps(df.select(key, text), make, f"`{key}` {df.schema[key].dataType.simpleString()}, fingerprint binary", text)


def with_next(df: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """Rows (_part, _edge, _key, key, text), each range of keys in one sorted partition that ends with the next range's first row.

    That copied row (``_edge`` 1) lets a stream over a partition see every row's successor; the last
    range ends with the first row of all. The ranges start at quantiles of the key, which are keys
    that occur; texts are shuffled once. A null key sorts first.
    """
    ship(df.sparkSession)
    low = -(1 << 63)
    rows = df.select(F.coalesce(F.col(key), F.lit(low)).alias("_key"), key, F.coalesce(F.col(text), F.lit("")).alias(text))
    ends = df.agg(F.min(F.coalesce(F.col(key), F.lit(low))), F.percentile_approx(F.col(key), [i / parts for i in range(1, parts)] or [0.5], 10 * max(1000, parts)).alias("q")).first()
    if ends[0] is None:
        return rows.select(F.lit(0).alias("_part"), F.lit(0).alias("_edge"), "*")
    starts = np.array(sorted({ends[0], *(ends["q"] or [])}), np.int64)

    def deal(batches):
        import pyarrow as pa

        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            part = np.searchsorted(starts, k, "right") - 1
            edge = starts[part] == k
            before = (part[edge] - 1) % len(starts)
            rows = pa.Table.from_batches([b])
            for at, flag, some in ((part, 0, rows), (before, 1, rows.filter(pa.array(edge)))):
                for x in pa.table([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), flag, np.int32)), *some.columns], names=["_part", "_edge", *b.schema.names]).to_batches():
                    yield x

    dealt = rows.mapInArrow(deal, f"_part int, _edge int, _key long, `{key}` {df.schema[key].dataType.simpleString()}, `{text}` string")
    return dealt.repartitionById(len(starts), F.col("_part")).sortWithinPartitions("_part", "_edge", "_key", F.xxhash64(text))


def compare_with_next(df: DataFrame, parts: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows as of ``op9_fingerprints``, for any key and text column."""

    def run(batches):
        import pyarrow as pa

        held = None  # (part, key, text, fingerprint) of the row whose successor comes next

        def told(successor: str, other: bytes) -> tuple:
            _, k, t, own = held
            n = len(t)
            edited = t[: n - n // 4] + successor[: n // 4]
            changed = fingerprint(edited)
            return k, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), own.hex(), changed.hex(), likeness(own, changed), likeness(own, other)

        for b in steps(batches, text):
            c, out = b.to_pydict(), []
            for part, edge, k, t in zip(c["_part"], c["_edge"], c[key], c[text]):
                own = fingerprint(t)
                if held is not None and held[0] == part:
                    out.append(told(t, own))
                held = None if edge else (part, k, t, own)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [to_arrow_type(df.schema[key].dataType), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    return with_next(df, key, text, parts).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and how alike they and the next document's are."""
    return compare_with_next(documents(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions")))
