"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens, cut into packets of at most PACKET tokens. In each
round a source's credit grows by its share of a window; it sends packets while its credit covers
them and carries the rest (the deficit) to the next round. A packet whose last token is the c-th of
its queue is thus sent in round ceil(c / (share x window)) - 1, whatever partition it lies in: rounds
come from prefix sums over the queue, so deficits carry over windows and partitions without one task
walking the corpus. The packets in order of (round, source, place in the queue) are one stream of
tokens, cut into windows at every ``window`` tokens; only the last window has padding. Every window
holds its round's packets up to the deficits, so its mixture follows the shares.

By default a source's share is its part of all tokens, so that all queues end together. With given
weights, sources that run out leave their part of the later windows to the others.

Texts are tokenized once, into a written table; counts and places are computed on narrow rows;
the pieces of each document then meet its tokens in one join.

Defined cases: null and empty texts are the end token alone; null sources are one queue; repeated
rows are packed one by one; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, prefix_sums, steps

WINDOW = 2048
PACKET = 512
END_ID = 1
#: Distinct stretches (white space and a word) whose ids a task keeps; beyond it starts anew.
CACHE_UNITS = 400_000
_UNIT = re.compile(r"\s*\S+|\s+")


class Ids:
    """The ids of a byte-level BPE vocabulary file, as packed little-endian numbers.

    No token of such a vocabulary's split pattern reaches from a character over white space to the next
    word, so a text's ids are those of its stretches of white space and a word, in order. Words
    recur, so most stretches come from a bounded table; the others go to the library's encoder.
    With ``added``, the file's added tokens are cut out of texts first and have their own ids, as by
    the tokenizer library's defaults.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.added = {x["content"]: x["id"] for x in file.get("added_tokens", [])} if added else {}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        stand_ins = self._stand_ins()
        self.ranks = {bytes(stand_ins[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in stand_ins for c in piece) and not (piece.startswith("<|") and piece.endswith("|>"))}
        import public_tokenizers

        self.encoder = tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.kind = "<u2" if max(*self.ranks.values(), *self.added.values()) < 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _stand_ins() -> dict[str, int]:
        """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in set(plain))
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def pack(self, text: str) -> bytes:
        if self.added and self.cuts.search(text):
            return b"".join(np.array([self.added[t]], self.kind).tobytes() if t in self.added else self._plain(t) for t in self.cuts.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        known, units = self.known, _UNIT.findall(text)
        try:
            return b"".join([known[u] for u in units])
        except KeyError:
            pass
        if len(known) > CACHE_UNITS:
            known.clear()
        encode, kind = self.encoder.encode_ordinary, self.kind
        for u in units:
            if u not in known:
                known[u] = np.array(encode(u), kind).tobytes()
        return b"".join([known[u] for u in units])


@lru_cache(maxsize=2)
def loaded(path: str) -> Ids:
    """One for each worker process, whose table its tasks share."""
    return Ids(path, added=True)


def tokenized(df: DataFrame, tokenizer: str, key: str, text: str, source: str, scratch: Scratch) -> tuple[DataFrame, str]:
    """A written table (row, key, source, n, ids) and the ids' numpy type; ``row`` numbers the rows, whatever their keys."""
    kind = loaded(tokenizer).kind

    def run(batches):
        ids, end = loaded(tokenizer), np.array([END_ID], kind).tobytes()
        width = len(end)
        for b in steps(batches, text):
            packed = [ids.pack(t or "") + end for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(p) // width for p in packed], pa.int64()), pa.array(packed, pa.binary())], names=["row", key, "source", "n", "ids"])

    rows = df.select(F.monotonically_increasing_id().alias("row"), key, F.col(source).cast("string").alias("source"), text)
    return scratch.write(rows.mapInArrow(run, f"row long, `{key}` {df.schema[key].dataType.simpleString()}, source string, n long, ids binary"), "tokens"), kind


def places(counts: DataFrame, scratch: Scratch, key: str, window: int = WINDOW, packet: int = PACKET, weights: dict[str, float] | None = None) -> DataFrame:
    """Rows (row, start, length, sequence_id, offset), a row for each piece, from (row, key, source, n) rows."""
    queue = prefix_sums(counts.select("source", key, "row", "n"), ["source", key, "row"], "n", scratch, "queues")
    of = queue.groupBy("source").agg(F.min("start").alias("queue_start"), F.sum("n").alias("queue_n"))
    if weights:
        given = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
        share = F.coalesce(F.try_element_at(given, "source"), F.lit(min(weights.values()))) / sum(weights.values())
    else:
        share = F.col("queue_n") / F.col("total")
    queue = queue.join(of, queue["source"].eqNullSafe(of["source"])).drop(of["source"]).withColumn("share", share)
    packets = queue.select("source", "row", "share", (F.col("start") - F.col("queue_start")).alias("at"), "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(packet)).cast("array<long>")).alias("start"))
    packets = packets.withColumn("n", F.least(F.lit(packet), F.col("n") - F.col("start"))).withColumn("at", F.col("at") + F.col("start") + F.col("n"))
    turn = (F.ceil(F.col("at") / (F.col("share") * window)) - 1).cast("long")
    sent = scratch.write(packets.select(turn.alias("turn"), F.coalesce("source", F.lit("")).alias("source"), "at", "row", F.col("start").alias("doc_start"), "n"), "packets")
    stream = prefix_sums(sent, ["turn", "source", "at"], "n", scratch, "stream")
    cut = stream.select("row", "doc_start", "start", "n", F.explode(F.sequence(F.expr(f"start div {window}"), F.expr(f"(start + n - 1) div {window}"))).alias("sequence_id"))
    begin = F.greatest(F.col("start"), F.col("sequence_id") * window)
    end = F.least(F.col("start") + F.col("n"), (F.col("sequence_id") + 1) * window)
    return cut.select("row", (F.col("doc_start") + begin - F.col("start")).alias("start"), (end - begin).alias("length"), "sequence_id", (begin - F.col("sequence_id") * window).alias("offset"))


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", source: str = "source", window: int = WINDOW, packet: int = PACKET, weights: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, and the piece's ids if ``with_ids``."""
    scratch = Scratch(df.sparkSession, "packing")
    tokens, kind = tokenized(df, tokenizer, key, text, source, scratch)
    pieces = places(tokens.select("row", key, "source", "n"), scratch, key, window, packet, weights)
    cuts = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("cuts"))
    met = tokens.join(cuts.hint("shuffle_hash"), "row").select(key, "source", "n", "ids", "cuts")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                c = b.slice(at, 256).to_pydict()
                for k, s, n, ids, cut in zip(c[key], c["source"], c["n"], c["ids"], c["cuts"]):
                    wide = np.frombuffer(ids, kind).astype("<u4")
                    for x in cut:
                        piece = wide[x["start"] : x["start"] + x["length"]]
                        out.append((k, x["start"], x["length"], zlib.crc32(piece.tobytes()), n, x["sequence_id"], x["offset"], s, piece.tolist())[: 8 + with_ids])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"][: 8 + with_ids]
    kinds = [to_arrow_type(df.schema[key].dataType), *[pa.int64()] * 6, pa.string(), pa.list_(pa.int32())]
    return met.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids array<int>" * with_ids)


def vocabulary() -> str:
    """The public vocabulary file that the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, mixed as the sources are in the whole corpus."""
    return pack(documents(spark, sf_dir), vocabulary())
