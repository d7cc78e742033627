"""Fuzzy line deduplication: one occurrence of each group of nearly equal lines stays.

Lines are normalised (lower case, ASCII punctuation and white space as one space, ASCII digits as 0).
Equal normalised lines are one node from the start; their identity is 128 bits of hash. Other lines
meet by equal runs of characters (grams), are verified by edit similarity in characters of SIMILARITY or
more, and the first line of each connected group stays, in the order of (key, line number).

Grams carry equal information, not equal length: a gram goes on until the surprise of its bytes, each after
the two before it, reaches the bits of GRAMS. The surprises come from counts over all lines. So chance
meetings are as rare in a language of few syllables as in random letters, and the candidates grow
with the lines. GRAMS gives the bits by the longer line's length; of the grams of a line those with
the least hashes are taken, about as many as GRAMS says. Lines of under 32 characters take part with all their
grams, of fixed length; under 16 they always meet, as so few edits can't touch all of them.

A gram's lines stand in the order of their hash, in parts of PAIRED. Lines are compared within their part and
with the gram's first line. Where a gram has more than one part, a second step compares all its pairs of lines that aren't
in one group yet and have the gram at places that the similarity allows, block by block (BLOCK). So every pair of
lines that has a gram in common is compared or in one group already. The second step's work grows with the square of
the lines that share a gram and not a group; its rows grow with the lines and the root of the gram's blocks, as half of that are dealt out
together (up to DEALT).

Texts are read three times and never shuffled whole: for hashes, for grams, and for the lines that a
candidate pair or the second step names (the tasks have the names where these are few, see BROADCAST_ROWS, beyond
that a table of bits that leaves most others out, and a join follows). Gram rows are shuffled once, many packed into one row of a bucket of grams, and put in order bucket by bucket (in ranges of a temporary file beyond SORTED rows). Line numbers to drop meet the documents by a join that
broadcasts them only where they are few (BROADCAST_ROWS). Scratch tables go when nothing reads them any more.

Defined cases: null texts stay null, blank lines stay and aren't compared; a text whose lines all go
is empty; rows that are equal in key and text keep the same lines; a null key sorts first; unlike lines with equal
64-bit names: those of one 128-bit identity take part, the others stay; an
empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, STEP_BYTES, Scratch, documents, eased, steps
from .components import components

SIMILARITY = 0.8
#: Lines of a gram that are compared with each other at once.
PAIRED = 16
#: For the longer line of a pair: least length, length from which the next row holds, bits of a gram, grams of a line.
GRAMS = [(32, 64, 24, 14), (64, 128, 28, 14), (128, 1 << 31, 36, 14)]
#: The same for short lines: least length, next length, bytes of a gram; all grams are taken.
SHORT = [(5, 6, 2), (6, 16, 3), (16, 32, 5)]
#: Parts of a gram that the second step compares at once with each other or with as many others.
BLOCK = 64
#: Characters, about, of a gram's lines up to which blocks are dealt out together.
DEALT = 10_000_000
#: Bits, as a power of two, of the largest table that tells which lines aren't named; up to it, 16 for each name.
NAMED_BITS = 28
#: Characters of the longer line up to which pairs are verified many at a time.
BANDED = 4096
#: Characters, or edits, times pairs that are worked on at a time in verification.
GROUPED = 400_000
#: Pairs that are verified at a time.
POOLED = 100_000
#: Bytes of texts of the first step's pairs that are verified at a time.
HELD_BYTES = 10 * STEP_BYTES
#: Rows of grams that are put in order in memory, and rows that are paired at a time.
SORTED, STEPPED = 2_000_000, 50_000
#: Parts of a bit in which surprises are counted, as whole numbers add up alike everywhere.
PARTS = 256
#: Sizes of the tables that count three bytes in sequence, by hash.
SEEN = 1 << 17


_FOLD = bytes(48 if 48 <= b <= 57 else 32 if b < 128 and b != 10 and not chr(b).isalpha() else b for b in range(256))
_RANDOM = np.random.default_rng(23).integers(1, 1 << 63, 256, np.uint64, endpoint=True) | np.uint64(1)
_BASE, _LINE_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_LINE_BASE), -1, 1 << 64))
#: A byte's bits as eight counters of a byte each, the first bit lowest.
_LANES = np.array([sum((b >> (7 - i) & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _polynomial(values: np.ndarray, sizes: np.ndarray, base: np.uint64) -> np.ndarray:
    """A 64-bit hash of each run of ``sizes`` values, in their order."""
    at = np.cumsum(sizes) - sizes
    powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(int(sizes.max()), base, np.uint64))])
    return _mixed(np.add.reduceat(values * powers[np.arange(len(values)) - np.repeat(at, sizes)], at))


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of each run of ``sizes`` word hashes: bits that over half of them have.

    Bits are counted in lanes of a byte, over chunks of at most 255 words.
    """
    chunks = -(-sizes // 255)
    first = np.cumsum(chunks) - chunks
    starts = np.repeat(np.cumsum(sizes) - sizes, chunks) + 255 * (np.arange(int(chunks.sum())) - np.repeat(first, chunks))
    lanes = np.add.reduceat(_LANES[hashes.astype(">u8").view(np.uint8).reshape(-1, 8)], starts, axis=0)
    counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > sizes[:, None], axis=1).view(">i8")[:, 0].astype(np.int64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^(n - 1); they are kept, up to the longest asked for."""
    held = _powers.held.get(int(base))
    if held is None or len(held) < n:
        held = _powers.held[int(base)] = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n, 1 << 20), base, np.uint64))])
    return held[:n]


_powers.held = {}


class Lines:
    """The lines with words of some texts.

    ``text`` and ``at``: which line of which; ``h`` and ``check``: 128 bits of hash; ``n``: characters of the normalised
    line; ``sim``: its SimHash of words, if asked for.
    """

    def __init__(self, texts: list[str], simhash: bool = True):
        folded = [t.lower().encode("utf-8", "replace").translate(_FOLD) for t in texts]
        a = np.frombuffer(b"\n".join(folded), np.uint8)
        letter = a > 32
        kept = letter | (a == 10)
        kept[1:] |= letter[:-1]  # the first space after a word
        lines = a[kept].tobytes().replace(b" \n", b"\n").rstrip(b" ").split(b"\n")
        held = np.fromiter(map(len, lines), np.int64, len(lines))
        line = np.flatnonzero(held)
        if not len(line):
            self.text = self.at = self.h = self.check = self.sim = self.n = self.start = np.zeros(0, np.int64)
            self.unit = np.zeros(0, np.uint8)
            return
        lines = list(filter(None, lines))
        per_text = np.fromiter((t.count(b"\n") + 1 for t in folded), np.int64, len(folded))
        start = np.cumsum(per_text) - per_text
        self.text = np.searchsorted(start, line, "right") - 1
        self.at = line - start[self.text]
        hashes = np.frombuffer(b"".join([blake2b(x, digest_size=16).digest() for x in lines]), "<i8").reshape(-1, 2).astype(np.int64)
        self.h, self.check = hashes[:, 0].copy(), hashes[:, 1].copy()
        # the normalised lines one after another, their words parted by one space
        self.unit = np.frombuffer(b"".join(lines), np.uint8)
        self.start = np.concatenate([[0], np.cumsum(held[line])])
        self.n = np.fromiter((len(x) if x.isascii() else len(_decoded(x)) for x in lines), np.int64, len(lines))
        if simhash:
            words = [x.split() for x in lines]
            lengths = np.array([len(w) for x in words for w in x])
            self.sim = _majority(_polynomial(_RANDOM[self.unit[self.unit != 32]], lengths, _BASE), np.array([len(x) for x in words]))

    def words(self, i: int) -> list[bytes]:
        """The words of the i-th line."""
        return self.normalised(i).split()

    def normalised(self, i: int) -> bytes:
        return self.unit[self.start[i] : self.start[i + 1]].tobytes()

    def followed(self) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of the lines: where the two bytes before it are counted, and where these with it."""
        u = self.unit.astype(np.uint32)
        before = np.zeros(len(u), np.uint32)
        before[1:] = u[:-1] << np.uint32(8)
        before[2:] |= u[:-2] << np.uint32(16)
        place = lambda x: ((x * np.uint32(0x9E3779B1)) >> np.uint32(15)).astype(np.int64)
        return place(before + np.uint32(1 << 24)), place(before | u)

    def seen(self) -> np.ndarray:
        """SEEN counts of two bytes that another one follows, and of three bytes in sequence, by hash."""
        before, three = self.followed()
        return np.bincount(before, minlength=SEEN) + np.bincount(three, minlength=SEEN)

    def grams(self, on: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lines ``on`` (ascending): line, hash and place of the grams that they take part with; ``counts`` as of ``seen``, of all lines."""
        u, out = self.unit, [(np.zeros(0, np.int64),) * 3]
        if not len(on):
            return out[0]
        before, three = self.followed()
        told, characters = np.cumsum(np.maximum(_parts(counts, 32)[before] - _parts(counts, 1)[three], 0)), np.cumsum(u & 0xC0 != 0x80)
        ahead = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_RANDOM[u] * _powers(_LINE_BASE, len(u)))])
        back, n = _powers(_INVERSE, len(u)), self.n[on]
        for kind, (low, high, size, kept) in enumerate([(*s, 1 << 31) for s in SHORT] + GRAMS):
            some = on[(n >= SIMILARITY * low - 1e-9) & (n < high)]
            start, end = self.start[some], self.start[some + 1]
            # grams are whole that begin before this place
            end = end - size + 1 if kind < len(SHORT) else np.searchsorted(told, told[end - 1] - size * PARTS, "right")
            some, start, held = some[end > start], start[end > start], (end - start)[end > start]
            if not len(some):
                continue
            i = np.arange(int(held.sum())) + np.repeat(start - (np.cumsum(held) - held), held)
            after = i + size if kind < len(SHORT) else np.searchsorted(told, told[i] + size * PARTS) + 1
            h = _mixed((ahead[after] - ahead[i]) * back[i] + np.uint64(kind))
            if kept < held.max():
                least = np.where(kept < held, kept / held * 2.0**64, 0).astype(np.uint64) - np.uint64(1)  # 2^64 - 1 where all are taken
                take = np.flatnonzero(h <= np.repeat(least, held))
                i, h, line = i[take], h[take], some[np.searchsorted(np.cumsum(held), take, "right")]
            else:
                line = np.repeat(some, held)
            out.append((line, h.view(np.int64), characters[i] - characters[self.start[line]]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _parts(counts: np.ndarray, more: int) -> np.ndarray:
    """Logarithms of ``counts`` with ``more`` added, in whole PARTS of a bit; those of the last counts are kept."""
    held = _parts.held.get(more)
    if held is None or held[0] is not counts:
        held = _parts.held[more] = counts, np.round(np.log2(counts + more) * PARTS).astype(np.int64)
    return held[1]


_parts.held = {}


def _fingerprinted(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, whole, at, h, check) for lines that aren't blank; whole: the text's hash, at: the line's number.

    With ``at`` -1, rows of counts: h is a place in the table of ``Lines.seen`` and check what the task has counted there.
    """
    names = [key, "whole", "at", "h", "check"]

    def run(batches):
        seen, kind = np.zeros(SEEN, np.int64), pa.null()
        for b in steps(batches, "text", 1_000_000):
            x = Lines(b.column(2).to_pylist(), simhash=False)
            if not len(x.h):
                continue
            take, kind, seen = pa.array(x.text), b.column(0).type, seen + x.seen()
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(x.at.astype(np.int32)), pa.array(x.h), pa.array(x.check)], names=names)
        if len(met := np.flatnonzero(seen)):
            none = lambda t: pa.nulls(len(met), t)
            yield pa.RecordBatch.from_arrays([none(kind), none(pa.int64()), pa.array(np.full(len(met), -1, np.int32)), pa.array(met), pa.array(seen[met])], names=names)

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(text).isNotNull()).select(key, F.xxhash64(text).alias("whole"), F.col(text).alias("text"))
    return rows.mapInArrow(eased(run), f"`{key}` {kind}, whole long, at int, h long, check long")


def _packed(rows: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows (bucket, rows) of arrays with columns gram, h and z: a gram's rows are in one bucket, as 24 bytes each."""
    rows = np.concatenate(rows)
    of = ((rows[:, 0].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    held = np.bincount(of, minlength=buckets)
    some = np.flatnonzero(held)
    ends = np.concatenate([[0], np.cumsum(held[some] * 24)]).astype(np.int64)
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(rows[np.argsort(of, kind="stable")].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), packed.cast(pa.binary())], names=["bucket", "rows"])


def _buckets(spark: SparkSession) -> int:
    return min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 30)


def _gathered(df: DataFrame, text: str, counts: np.ndarray) -> DataFrame:
    """Rows (bucket, rows), see ``_packed``, of the grams of lines; z: 2^32 x the line's characters + the gram's place."""
    buckets = _buckets(df.sparkSession)

    def run(batches):
        held, n = [], 0
        for b in steps(batches, "text", 250_000):
            x = Lines(b.column(0).to_pylist(), simhash=False)
            line, gram, at = x.grams(np.sort(np.unique(x.h, return_index=True)[1]), counts)
            held.append(np.stack([gram, x.h[line], x.n[line] << 32 | at], 1))
            n += len(gram)
            if n >= 100_000:
                yield _packed(held, buckets)
                held, n = [], 0
        if n:
            yield _packed(held, buckets)

    return df.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(eased(run), "bucket int, rows binary")


def _ordered(rows: np.ndarray, whole: bool) -> np.ndarray:
    """Columns of the distinct ``rows``, in their order; where all rows of their grams are there (``whole``), without grams of one row."""
    if whole:
        order = np.argsort(rows[:, 0])
        g = rows[order, 0]
        same = np.concatenate([[False], g[1:] == g[:-1], [False]])
        rows = rows[order[same[1:] | same[:-1]]]
    rows = rows[np.lexsort(rows.T[::-1])].T
    return rows[:, np.concatenate([np.ones(min(1, rows.shape[1]), bool), (rows[:, 1:] != rows[:, :-1]).any(axis=0)])]


def _ranges(rows: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """``rows``, more than fit into memory, in ranges of (gram, h) of about ``limit`` rows each."""
    some = np.array(rows[:: max(1, len(rows) // 20_000), :2])
    some = some[np.lexsort((some[:, 1], some[:, 0]))]
    cuts = np.unique(some[:: max(1, len(some) * limit // len(rows))][1:], axis=0).tolist()
    for low, high in zip([None, *cuts], [*cuts, None]):
        found = []
        for start in range(0, len(rows), limit):
            part = np.array(rows[start : start + limit])
            for cut, way in ((low, True), (high, False)):
                if cut:
                    part = part[((part[:, 0] > cut[0]) | (part[:, 0] == cut[0]) & (part[:, 1] >= cut[1])) == way]
            found.append(part)
        yield np.concatenate(found)


def _texts(df: DataFrame, text: str, named: DataFrame) -> DataFrame:
    """Rows (h, unit): of the lines named in ``named`` (h), what edit similarity compares."""
    n, wanted, bits, table = named.count(), None, 0, None
    if n <= BROADCAST_ROWS:
        wanted = df.sparkSession.sparkContext.broadcast(np.sort(named.toArrow()["h"].to_numpy()))
    else:
        bits = min(max(6, (16 * n - 1).bit_length()), NAMED_BITS)
        table = df.sparkSession.sparkContext.broadcast(_bit_table(named, bits))

    def run(batches):
        given = set()
        for b in steps(batches, "text", 1_000_000):
            x = Lines(b.column(0).to_pylist(), simhash=False)
            on = np.flatnonzero(_among(x.h, wanted.value) if wanted is not None else _maybe(x.h, table.value, bits))
            units = {h: int(i) for i in on if (h := int(x.h[i])) not in given}
            given = given | units.keys() if len(given) < 100_000 else set(units)
            out = [pa.array(list(units), pa.int64()), pa.array([_decoded(x.normalised(i)) for i in units.values()], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["h", "unit"])

    found = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(eased(run), "h long, unit string")
    found = found.groupBy("h").agg(F.min("unit").alias("unit"))
    return found if wanted is not None else found.join(named, "h", "left_semi")


def _bit_table(named: DataFrame, bits: int) -> np.ndarray:
    """2^``bits`` bits, in words: those are set that the first ``bits`` bits of a name (h) count. To the driver come its words that aren't 0."""
    place = F.shiftrightunsigned("h", 64 - bits)
    rows = named.select(F.shiftrightunsigned(place, 6).alias("word"), F.expr("1L").alias("one"), (place.bitwiseAND(63)).cast("int").alias("bit"))
    found = rows.groupBy("word").agg(F.expr("bit_or(shiftleft(one, bit))").alias("held")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[found["word"].to_numpy()] = found["held"].to_numpy()
    return out


def _maybe(h: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``h`` the table of ``_bit_table`` doesn't leave out: all that are named, and a few others."""
    place = (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return table[place >> 6] >> (place & 63) & 1 == 1


def _among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``h`` are in ``ordered``."""
    at = np.searchsorted(ordered, h)
    return (at < len(ordered)) & (np.append(ordered, 0)[np.minimum(at, len(ordered))] == h)


def _decoded(unit: bytes) -> str:
    return unit.decode("utf-8", "replace")


def _unit(words: list[bytes]) -> str:
    return _decoded(b" ".join(words))


def _may(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of z values of two lines with one gram: whether SIMILARITY allows its places. Edits before and after it are at least the differences of places."""
    n, m, p, q = x >> 32, y >> 32, x & 0xFFFFFFFF, y & 0xFFFFFFFF
    return np.abs(p - q) + np.abs((n - p) - (m - q)) <= np.floor(np.maximum(n, m) * (1 - SIMILARITY) + 1e-9)


def shared(grams: DataFrame, paired: int) -> DataFrame:
    """Rows (gram, h, z, part) of the grams that over ``paired`` rows have: ``part`` counts these by ``paired``. See ``first_pairs`` for those with ``part`` -1.

    ``grams``: rows (gram, h, z), or of ``_gathered``. A bucket's rows are put in the order of (gram, h, z), by way of a temporary file where they are more than SORTED.
    A part is compared when it is whole, so only the rows of one part wait for the next step.
    """
    names, buckets, limit = ["gram", "h", "z", "part"], _buckets(grams.sparkSession), SORTED

    def pack(batches):
        for b in batches:
            if b.num_rows:
                yield _packed([np.stack([b.column(i).to_numpy() for i in range(3)], 1)], buckets)

    def run(batches):
        waiting, of, gone, first = np.zeros((3, 0), np.int64), None, 0, (0, 0)  # of, gone, first: the run that was read last, its rows that don't wait any more, and their first

        def met(rows, ended):
            nonlocal waiting, of, gone, first
            g, h, z = rows
            begins = np.concatenate([[True], g[1:] != g[:-1]])
            starts, run_of = np.flatnonzero(begins), np.cumsum(begins) - 1
            before, firsts = np.zeros(len(starts), np.int64), rows[1:, starts]
            if gone and g[0] == of:
                before[0], firsts[:, 0] = gone, first
            sizes, at = np.diff(starts, append=len(g)) + before, np.arange(len(g)) - (starts - before)[run_of]
            whole = sizes[-1] // paired * paired if sizes[-1] > paired else before[-1]  # rows of the last run, which may go on
            end = len(g) if ended else int(starts[-1] + whole - before[-1])
            waiting, of, gone, first = rows[:, end:], g[-1], whole, firsts[:, -1]
            run_of, part, h, z = run_of[:end], at[:end] // paired, h[:end], z[:end]
            several = sizes[run_of] > paired
            out = [np.stack([g[:end], h, z, part])[:, several]]
            pairs = [(firsts[0, run_of], h, (part > 0) & (firsts[0, run_of] != h) & _may(firsts[1, run_of], z))]
            for d in range(1, paired):
                close = (run_of[d:] == run_of[:-d]) & (part[d:] == part[:-d])
                if not close.any():
                    break
                pairs.append((h[:-d], h[d:], close & (h[:-d] < h[d:]) & _may(z[:-d], z[d:])))
            out += [np.stack([a[on], b[on], np.zeros(on.sum(), np.int64), np.full(on.sum(), -1)]) for a, b, on in pairs]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.concatenate(out, axis=1)], names=names)

        def of_bucket(held, file):
            if not held and not file:
                return
            if file:
                file.write(b"".join(held))
                file.flush()
                ranges = (_ordered(rows, False) for rows in _ranges(np.memmap(file, np.int64, "r").reshape(-1, 3), limit))
            else:
                ranges = [_ordered(np.frombuffer(b"".join(held), np.int64).reshape(-1, 3), True)]
            for rows in ranges:
                for start in range(0, rows.shape[1], STEPPED):
                    yield met(np.concatenate([waiting, rows[:, start : start + STEPPED]], axis=1), False)
            if waiting.shape[1]:
                yield met(waiting, True)

        with contextlib.ExitStack() as files:
            bucket, held, size, file = None, [], 0, None
            for b in batches:
                for k, rows in zip(b.column(0).to_pylist(), b.column(1)):
                    if k != bucket:
                        yield from of_bucket(held, file)
                        bucket, held, size, file = k, [], 0, None
                        files.close()
                    held.append(rows.as_buffer().to_pybytes())
                    size += len(held[-1])
                    if size > 24 * limit:
                        file = file or files.enter_context(tempfile.TemporaryFile())
                        file.write(b"".join(held))
                        held, size = [], 0
            yield from of_bucket(held, file)

    if grams.columns != ["bucket", "rows"]:
        grams = grams.mapInArrow(pack, "bucket int, rows binary")
    return grams.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(eased(run), ", ".join(f"{n} long" for n in names))


def first_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a below b, that have a gram at places that SIMILARITY allows: all of a part, and the gram's first line with those of other parts."""
    return rows.where("part < 0").select(F.col("gram").alias("a"), F.col("h").alias("b")).distinct()


def _meetings(b: pa.RecordBatch, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one block, or of blocks ``low`` and ``high``, whose lines are in different components and have the gram at places that SIMILARITY allows."""
    block, h, n, at, c = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("block", "h", "n", "at", "c"))
    one, other = np.flatnonzero(block == low), np.flatnonzero(block == high)
    most = np.floor(np.arange(int(n.max()) + 1) * (1 - SIMILARITY) + 1e-9).astype(np.int64)[n]
    found = [np.zeros((0, 2), np.int64)]
    for start in range(0, len(one), 256):
        i, j = one[start : start + 256, None], other[None, :]
        apart = np.abs(at[i] - at[j]) + np.abs((n - at)[i] - (n - at)[j])
        x, y = np.nonzero((apart <= np.maximum(most[i], most[j])) & (c[i] != c[j]))
        found.append(np.stack([i[x, 0], j[0, y]], 1))
    found = np.concatenate(found)
    ordered, first, of = np.unique(h, return_index=True, return_inverse=True)  # a line may have a gram at several places
    found = np.sort(of[found], axis=1)
    found = np.unique(found[:, 0] * len(ordered) + found[:, 1])
    return first[found // len(ordered)], first[found % len(ordered)]


def other_links(rows: DataFrame, of: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components of ``of`` (node, component; a line that isn't there is its own), made by lines with a gram of several parts in common: all pairs are compared.

    A gram's lines stand in blocks of BLOCK parts, and each block meets itself and each other block of the gram. Groups have the
    lines of two spans of blocks, each of half the root of the gram's blocks, or as many as DEALT characters hold, so that a line's rows
    grow with the root of the blocks; within a group, two blocks meet at a time. A pair that surely meets in a lesser
    gram too is left to that one. ``texts``: (h, unit) of these lines.
    """
    rows = rows.where("part >= 0")
    full = rows.groupBy("gram").agg(F.max("part").alias("last"), F.avg(F.shiftright("z", 32)).alias("wide")).where("last > 0")
    most = F.floor(F.lit(DEALT) / (BLOCK * PAIRED * F.col("wide")))
    full = full.select("gram", F.expr(f"last div {BLOCK}").alias("last"), F.greatest(F.lit(1), F.least(F.floor(F.sqrt(F.expr(f"last div {BLOCK} + 1")) / 2), most)).cast("long").alias("span"))
    full = scratch.write(full, "full")
    crowd = rows.join(full, "gram").join(of.withColumnsRenamed({"node": "h", "component": "c"}), "h", "left").withColumn("c", F.coalesce("c", "h"))
    crowd = scratch.write(crowd.select("gram", "h", F.expr("shiftright(z, 32) AS n"), F.expr("z & 4294967295L AS at"), F.expr(f"part div {BLOCK} AS block"), F.expr(f"part div {BLOCK} div span AS of"), F.expr("last div span AS last"), "c"), "crowd")
    apart = crowd.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("gram")
    apart = scratch.write(apart, "apart")
    crowd = crowd.join(apart, "gram", "left_semi")
    lines = texts.join(crowd.groupBy("h").agg(F.collect_list(F.struct("gram", "at")).alias("held")), "h").select("h", "unit", "held")
    dealt = crowd.join(lines, "h").withColumn("less", F.filter("held", lambda x: x["gram"] < F.col("gram"))).withColumn("other", F.explode(F.expr("sequence(0L, last)")))
    dealt = dealt.select("gram", F.least("of", "other").alias("low"), F.greatest("of", "other").alias("high"), "block", "of", "h", "n", "at", "c", "unit", F.col("less.gram").alias("grams"), F.col("less.at").alias("ats"))

    def run(batches):
        group, held, pool, place, size, count = None, [], [], {}, 0, 0  # place: of the lines of the pool

        def tiles():
            """The rows of every two blocks that meet in the group, and these blocks."""
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            block, of = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("block", "of"))
            rows = {k: np.flatnonzero(block == k) for k in np.unique(block).tolist()}
            low, high = ([k for k, r in rows.items() if of[r[0]] == span] for span in group[1:])
            for x in low:
                for y in high:
                    if x <= y:
                        yield b.take(pa.array(np.concatenate([rows[x], rows[y]]) if x != y else rows[x])), x, y

        def met(b, low, high):
            i, j = _meetings(b, low, high)
            if not len(i):
                return np.zeros((0, 2), np.int64), [], [], []
            named = np.unique(np.concatenate([i, j]))
            h, size, c, unit, grams, ats = (b.column(x).take(pa.array(named)).to_pylist() for x in (5, 6, 8, 9, 10, 11))
            less = [dict(zip(*e)) for e in zip(grams, ats)]  # where lines have the gram elsewhere too, one place
            x, y = np.searchsorted(named, i), np.searchsorted(named, j)
            some = np.array([bool(e) for e in less])
            for p in np.flatnonzero(some[x] & some[y]).tolist():
                u, v = x[p], y[p]
                most = int(max(size[u], size[v]) * (1 - SIMILARITY) + 1e-9)
                if any(abs(p - (q := less[v][g])) + abs(size[u] - p - size[v] + q) <= most for g, p in less[u].items() if g in less[v]):
                    x[p] = -1
            return np.stack([x, y], 1)[x >= 0], h, c, unit

        def links():
            units, c = [u for _, _, u in place.values()], np.array([c for _, c, _ in place.values()], np.int64)
            pairs = np.concatenate(pool)
            pairs = pairs[alike_of(units, pairs[:, 0], pairs[:, 1])]
            return pa.RecordBatch.from_arrays([pa.array(c[pairs[:, k]], pa.int64()) for k in (0, 1)], names=["a", "b"])

        def pooled(b, low, high):
            """Puts the pairs of two blocks of the group into the pool, and yields the links of a full one."""
            nonlocal pool, place, size, count
            pairs, h, c, unit = met(b, low, high)
            for start in range(0, len(pairs), POOLED):
                some = pairs[start : start + POOLED]
                named, at = np.unique(some, return_inverse=True)
                of = []
                for v in named.tolist():
                    if h[v] not in place:
                        place[h[v]] = (len(place), c[v], unit[v])
                        size += len(unit[v])
                    of.append(place[h[v]][0])
                pool.append(np.array(of, np.int64)[at].reshape(-1, 2))
                count += len(some)
                if size > 2 * STEP_BYTES or count >= POOLED:
                    yield links()
                    pool, place, size, count = [], {}, 0, 0

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if held and tuple(keys[start]) != group:
                    for tile in tiles():
                        yield from pooled(*tile)
                    held = []
                group = tuple(keys[start])
                held.append(b.slice(start, end - start))
        if held:
            for tile in tiles():
                yield from pooled(*tile)
        if pool:
            yield links()

    return dealt.repartition("gram", "low", "high").sortWithinPartitions("gram", "low", "high").mapInArrow(eased(run), "a long, b long").distinct()


def _similar(x: Column, y: Column) -> Column:
    """Edit similarity of at least SIMILARITY: 1 - distance / longer length."""
    most = F.floor(F.greatest(F.length(x), F.length(y)) * F.lit(1 - SIMILARITY) + F.lit(1e-9)).cast("int")
    return F.call_function("levenshtein", x, y, most) >= 0


def _alike(x: str, y: str) -> int:
    """Characters that both begin with."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid - 1)
    return low


def _bigrams(x: str) -> np.ndarray:
    """Counts of two characters in sequence, by hash."""
    codes = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount((codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)) >> np.uint32(20), minlength=1 << 12)


def within(x: str, y: str, most: int) -> bool:
    """Whether at most ``most`` edits of a character lead from ``x`` to ``y``; exact, whatever their lengths.

    Equal ends cost nothing. An edit alters at most two bigrams of either text, so texts with more
    differences there are apart. What remains goes through the distance matrix by columns, whose differences are bits.
    """
    if abs(len(x) - len(y)) > most:
        return False
    i = _alike(x, y)
    x, y = x[i:], y[i:]
    i = _alike(x[::-1], y[::-1])
    x, y = sorted((x[: len(x) - i], y[: len(y) - i]), key=len)
    if len(y) <= most:
        return True
    if not x:
        return False
    if len(x) > 64:
        apart = _bigrams(x) - _bigrams(y)
        if max(int(np.maximum(apart, 0).sum()), int(np.maximum(-apart, 0).sum())) > 2 * most:
            return False
    held: dict[str, int] = {}
    for i, c in enumerate(x):
        held[c] = held.get(c, 0) | 1 << i
    full, last, distance, left = (1 << len(x)) - 1, 1 << len(x) - 1, len(x), len(y)
    up, down = full, 0  # where a column's distance is one more, or one less, than in the row before
    for c in y:
        same = held.get(c, 0)
        free = (((same & up) + up) ^ up | same | down) & full
        right, back = down | full ^ (free | up), up & free
        left -= 1
        if right & last:
            distance += 1
        elif back & last:
            distance -= 1
        if distance - left > most:
            return False
        right = right << 1 | 1
        up, down = (back << 1 | full ^ ((same | down) | right) & full) & full, right & (same | down) & full
    return distance <= most


def _banded(codes: np.ndarray, starts: list[np.ndarray], sizes: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """``within`` for many pairs at once, in the order of their summed lengths; the first of a pair is the longer, by at most ``most``.

    ``starts`` and ``sizes``: of the first and of the second texts in ``codes``, see ``_coded``. The distance matrix goes by
    antidiagonals, a column for each pair, over the diagonals that a path of at most ``most`` edits can touch. Distances
    count up to one more than that. Pairs whose whole band is above their bound leave early.
    """
    nx, ny = sizes
    ends, n, k = nx + ny, len(nx), int(most.max())
    back, ahead = int((most - nx + ny).max()) // 2, int((most + nx - ny).max()) // 2
    rows = (int(ends[-1]) + ahead + back) // 2 + 2
    both = []
    for start, size, none in zip(starts, sizes, (0, 1)):
        t = np.full((n, rows), none, codes.dtype)
        wide = min(int(size.max()), rows - 1)
        t[:, 1 : wide + 1] = _runs(codes, start, wide)
        t[:, 1 : wide + 1][np.arange(wide) >= size[:, None]] = none
        both.append(t.T)
    x, y = both[0].copy(), both[1][::-1].copy()  # a row for each place; in y from the last to the first
    cut = 16  # steps after which distances are cut down to k + 1, as they grow by half as much
    kind = next(t for t in (np.uint8, np.uint16, np.int32) if k + 2 + cut <= np.iinfo(t).max)
    middle = back + 2 & ~1
    bands = [np.full(((middle + ahead) // 2 + 4, n), k + 1, kind) for _ in range(2)]  # even and odd diagonals
    bands[0][middle // 2] = 0
    near, of, one, done = np.zeros(n, bool), np.arange(n), kind(1), 0
    for s in range(1, int(ends[-1]) + 1):
        odd = s & 1
        low, high = -min(back, s), min(ahead, s)
        low, high = low + (s + low & 1), high - (s + high & 1)
        i, j, m, at = (s + low) // 2, rows - 1 - (s - low) // 2, (high - low) // 2 + 1, (low + middle - odd) // 2
        own, others = bands[odd][at : at + m], bands[1 - odd]
        own += (x[i : i + m] != y[j : j + m]).view(np.uint8)
        beside = np.minimum(others[at - 1 + odd : at - 1 + odd + m], others[at + odd : at + odd + m])
        beside += one
        np.minimum(own, beside, out=own)
        if ends[done] == s:
            now, done = done, int(np.searchsorted(ends, s, "right"))
            last = (nx - ny)[now:done]
            near[of[now:done]] = bands[odd][(last + middle - odd) // 2, np.arange(now, done)] <= most[now:done]
            if done == len(of):
                break
        if s % cut == 0:
            for band in bands:
                np.minimum(band, kind(k + 1), out=band)
        if s % (2 * cut) == 0:
            live = np.minimum(bands[0].min(axis=0), bands[1].min(axis=0)) <= most
            live[:done] = False
            if live.sum() < 0.85 * len(live):
                x, y, *bands = (np.compress(live, v, axis=1) for v in (x, y, *bands))
                of, nx, ny, most, ends = (v[live] for v in (of, nx, ny, most, ends))
                done = 0
                if not len(of):
                    break
    return near


def _coded(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all texts as small numbers from 2, with room before and after them, and where each text starts and how long it is."""
    n = np.fromiter(map(len, units), np.int64, len(units))
    ends = np.cumsum(n)
    cuts = np.searchsorted(ends, np.arange(0, int(n.sum()), STEP_BYTES // 4), "right").tolist() + [len(units)]

    def read():  # few texts at a time, as four bytes a character are more than is kept
        for start, end in zip(cuts, cuts[1:]):
            yield np.frombuffer("".join(units[start:end]).encode("utf-32-le", "surrogatepass"), np.uint32)

    found = np.zeros(0x110000, bool)
    for part in read():
        found[part] = True
    letters = np.cumsum(found[: int(np.flatnonzero(found)[-1]) + 1 if found.any() else 0], dtype=np.uint32) + 1  # 0 and 1 stand for no character
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if letters[-1:].max(initial=1) <= np.iinfo(t).max)
    letters, room = letters.astype(kind), int(min(n.max(initial=0), BANDED)) + 1
    codes, at = np.zeros(int(n.sum()) + 2 * room, kind), room
    for part in read():
        codes[at : at + len(part)] = letters[part]
        at += len(part)
    return codes, ends - n + room, n


def _runs(codes: np.ndarray, starts: np.ndarray, wide: int) -> np.ndarray:
    """A row of ``wide`` codes from each of ``starts`` on."""
    return np.lib.stride_tricks.sliding_window_view(codes, wide)[starts]


def _common(codes: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many codes, up to ``most``, are equal from places ``x`` and ``y`` on (``way`` 1), or before these (-1)."""
    wide = max(int(most.max()), 1)
    apart = (_runs(codes, x - wide * (way < 0), wide) != _runs(codes, y - wide * (way < 0), wide))[:, ::way]
    return np.minimum(np.where(apart.any(axis=1), apart.argmax(axis=1), wide), most)


def alike_of(units: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of texts, numbers ``x`` and ``y`` in ``units``, have an edit similarity of at least SIMILARITY; exact, whatever their lengths.

    Equal ends cost nothing. Pairs of few edits show in a narrow band, so a quarter of the bound is tried first.
    """
    codes, at, n = _coded(units)
    x, y = np.where(n[x] >= n[y], x, y), np.where(n[x] >= n[y], y, x)
    most, near = np.floor(n[x] * (1 - SIMILARITY) + 1e-9).astype(np.int64), np.zeros(len(x), bool)
    for p in np.flatnonzero(n[x] > BANDED).tolist():
        near[p] = within(units[x[p]], units[y[p]], int(most[p]))
    left = np.flatnonzero((n[x] <= BANDED) & (n[x] - n[y] <= most))
    left = left[np.argsort(n[y[left]], kind="stable")]
    ahead, behind = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    start = 0
    while start < len(left):  # few at a time, of about one length
        end = min(int(np.searchsorted(n[y[left]], 1.3 * n[y[left[start]]] + 64, "right")), start + max(1, GROUPED // int(n[y[left[start]]] + 64)))
        p = left[start:end]
        i, j = x[p], y[p]
        ahead[p] = _common(codes, at[i], at[j], n[j], 1)
        behind[p] = _common(codes, at[i] + n[i], at[j] + n[j], n[j] - ahead[p], -1)
        start = end
    nx, ny = n[x] - ahead - behind, n[y] - ahead - behind
    near[left] = nx[left] <= most[left]
    left = left[~near[left] & (ny[left] > 0)]
    for part in (4, 1):
        tried = left[(nx - ny)[left] <= most[left] // part]
        of, total = (3 * np.log2(most[tried] // part + 4)).astype(np.int64), (nx + ny)[tried]
        order = np.lexsort((total, of))
        tried, of, total, start = tried[order], of[order], total[order], 0
        while start < len(tried):
            end = min(int(np.searchsorted(of, of[start], "right")), start + max(17, GROUPED // int(most[tried[start]] // part + 4)))
            end = start + int(np.searchsorted(total[start:end], 1.3 * total[start] + 64, "right"))
            p = tried[start:end]
            if len(p) > 16:
                near[p] = _banded(codes, [at[x[p]] + ahead[p], at[y[p]] + ahead[p]], [nx[p], ny[p]], most[p] // part)
            elif part == 1:
                near[p] = [within(units[i], units[j], k) for i, j, k in zip(x[p].tolist(), y[p].tolist(), most[p].tolist())]
            start = end
        left = left[~near[left]]
    return near


def alike(xs: list[str], ys: list[str]) -> np.ndarray:
    """Which pairs of texts have an edit similarity of at least SIMILARITY."""
    place: dict[str, int] = {}
    x, y = (np.fromiter((place.setdefault(t, len(place)) for t in ts), np.int64, len(ts)) for ts in (xs, ys))
    return alike_of(list(place), x, y)


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines are similar."""
    met = pairs.join(texts.withColumnsRenamed({"h": "a", "unit": "x"}), "a").join(texts.withColumnsRenamed({"h": "b", "unit": "y"}), "b")

    def run(batches):
        held, size, count = [], 0, 0

        def links():
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            units = pa.concat_arrays([b.column(2), b.column(3)]).dictionary_encode()
            x, y = np.split(units.indices.to_numpy().astype(np.int64), 2)
            return b.select([0, 1]).filter(pa.array(alike_of(units.dictionary.to_pylist(), x, y)))

        for b in steps(batches, "x", 2 * STEP_BYTES):
            if not b.num_rows:
                continue
            held.append(b)
            size, count = size + b.nbytes, count + b.num_rows
            if size > HELD_BYTES or count >= POOLED:
                yield links()
                held, size, count = [], 0, 0
        if held:
            yield links()

    # the more pairs a task has, the more of about one length are verified at a time
    tasks = max(met.sparkSession.sparkContext.defaultParallelism, -(-2 * pairs.count() // POOLED))
    return met.select("a", "b", "x", "y").coalesce(tasks).mapInArrow(eased(run), "a long, b long")


def duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Rows (key, whole, drop): the numbers, from 0, of the lines to drop in the texts that lose any."""
    scratch = scratch or Scratch(df.sparkSession, "lines")
    both = scratch.write(_fingerprinted(df, key, text), "lines")
    counts, seen = np.zeros(SEEN, np.float32), both.where("at < 0").groupBy("h").agg(F.sum("check").alias("n")).toArrow()  # at most SEEN rows
    counts[seen["h"].to_numpy()] = seen["n"].to_numpy()
    held = both.where("at >= 0").select(key, "whole", "at", "h", "check")
    # where unlike lines have one name, those with the least check have it
    own = F.min(F.struct("check", F.struct(F.col(key), "at", "whole").alias("first"))).alias("own")
    nodes = both.where("at >= 0").groupBy("h").agg(F.count("*").alias("copies"), own).select("h", "copies", "own.check", "own.first")
    nodes = scratch.write(nodes, "nodes")
    met = shared(_gathered(df, text, counts), PAIRED)
    rows = scratch.write(met, "parts")
    pairs = scratch.write(first_pairs(rows), "pairs")
    # lines of a gram with several parts are all needed by the second step
    named = pairs.select(F.explode(F.array("a", "b")).alias("h")).unionAll(rows.where("part >= 0").select("h"))
    names = scratch.write(named.distinct(), "named")
    texts = scratch.write(_texts(df, text, names), "texts")
    linked = scratch.write(_linked(pairs, texts), "linked")
    of = components(linked, scratch)
    scratch.drop(pairs, names, linked)
    nodes = nodes.join(of.withColumnsRenamed({"node": "h", "component": "c"}).hint("shuffle_hash"), "h", "left").withColumn("linked", F.col("c").isNotNull()).withColumn("c", F.coalesce("c", "h"))
    if rows.where("part > 0").head(1):
        more = components(scratch.write(other_links(rows, of, texts, scratch), "more"), scratch)
        nodes = nodes.join(more.withColumnsRenamed({"node": "c", "component": "d"}).hint("shuffle_hash"), "c", "left")
        nodes = nodes.withColumn("linked", F.col("linked") | F.col("d").isNotNull()).withColumn("c", F.coalesce("d", "c")).drop("d")
    scratch.drop(rows, texts)
    nodes = nodes.where("linked OR copies > 1")  # others are groups of one line
    kept = nodes.groupBy("c").agg(F.min("first").alias("kept"), F.sum("copies").alias("copies")).where("copies > 1").drop("copies")
    kept = nodes.join(kept, "c").select("h", "check", "kept").hint("shuffle_hash")
    drop = held.join(kept, ["h", "check"]).where(~F.struct(F.col(key), "at", "whole").eqNullSafe(F.col("kept")))
    return drop.groupBy(key, "whole").agg(F.array_sort(F.collect_set("at")).alias("drop"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """``df`` without repeated lines in ``text``; ``removed`` names a column for the number of lines that went."""
    scratch = Scratch(df.sparkSession, "lines")
    drop = scratch.write(duplicates(df, key, text, scratch), "drop")
    scratch.drop_but(drop)
    drop = drop.select(F.col(key).alias("__fs_key"), F.col("whole").alias("__fs_whole"), F.col("drop").alias("__fs_drop"))
    numbers = drop.agg(F.coalesce(F.sum(F.size("__fs_drop") + 4), F.lit(0))).first()[0]
    # beyond, by hash, as a merge would sort whole texts
    drop = F.broadcast(drop) if numbers <= 4 * BROADCAST_ROWS else drop.hint("shuffle_hash")
    met = df.join(drop, df[key].eqNullSafe(drop["__fs_key"]) & (F.xxhash64(df[text]) == drop["__fs_whole"]), "left")
    # an array of one holds the lines, so that they are split once
    stays = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__fs_drop"))
    left = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(stays(lines), lambda i: F.get(lines, i)), "\n"))[0]
    out = met.withColumn(text, F.when(F.col("__fs_drop").isNull(), F.col(text)).otherwise(left))
    return (out.withColumn(removed, F.coalesce(F.size("__fs_drop"), F.lit(0))) if removed else out).drop("__fs_drop", "__fs_key", "__fs_whole")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without lines that stand elsewhere, and how many went."""
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), removed="n_removed")
    return out.select("doc_id", "text", "n_removed")
