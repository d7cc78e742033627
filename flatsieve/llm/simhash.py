"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of BITS bits is cut into SEGMENTS segments, so few that of two fingerprints within 2 x
SEGMENTS - 1 bits one segment differs by at most one bit. Every segment is indexed by its
one-wildcard variants (the segment with one bit deleted, once for each bit); fingerprints that share
a variant are joined by equality and verified by their full distance. Equal fingerprints are one row
throughout, and results come back to the documents at the end.

``links`` is exact for two segments and distance 2: variants with many fingerprints, whose pairs would
grow with the square of their number, are taken out of the join, and their fingerprints are linked
through the 64-bit centres that lie one bit or none away instead. Two fingerprints differ by at most
two bits just if they share such a centre, and a centre has at most 65 of them, so no link is lost.

``near_copies`` serves corpora: similarity of 0.8 or more of five-word shingles. See there.

Defined cases: words are runs of what isn't ASCII white space, A-Z lower-cased; fewer words than a
shingle: the whole sequence; null and blank texts have fingerprint zero and are linked like any other;
repeated rows and equal texts are one group; an empty table gives an empty result; other columns
are kept by ``near_copies`` and ignored by ``groups``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fingerprints as shingling
from .common import Scratch, documents, map_steps, without
from .components import components

BITS = 64
SEGMENTS = 2
#: Fingerprints of a variant that are joined in pairs; variants with more go the other way.
PAIRED = 32


def word_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's word shingles, repeats included."""
    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    return np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)


def signed_bits(h: np.ndarray, words64: int = 1) -> np.ndarray:
    """Bits, most significant first: 1 where over half of the hashes have it. More than 64 bits: of further mixes of each hash."""
    if not len(h):
        return np.zeros(64 * words64, bool)
    out = []
    for k in range(words64):
        x = h
        if k:
            x = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 14):  # bounds the bits of a very long text
            counts += np.unpackbits(x[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint16)
        out.append(counts * 2 > len(x))
    return np.concatenate(out)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Rows (key, f): 64-bit fingerprints as signed longs."""

    def make():
        return lambda c: c | {"f": [int(np.packbits(signed_bits(word_hashes(t or "", words))).view(">i8")[0]) for t in c[text]]}

    return map_steps(df.select(key, text), make, f"`{key}` {df.schema[key].dataType.simpleString()}, f long", text)


def links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) among distinct 64-bit fingerprints ``f``: enough of those within two bits to join all that such links connect."""
    bits = F.expr("transform(sequence(0, 63), i -> struct(i AS bit, IF(i < 32, f & 4294967295L, shiftrightunsigned(f, 32)) & ~shiftleft(1L, i % 32) AS rest))")
    variants = prints.select("f", F.explode(bits).alias("v")).select(F.shiftleft(F.col("v.bit").cast("long"), 32).bitwiseOR(F.col("v.rest")).alias("v"), "f")
    counted = variants.withColumn("n", F.count("*").over(W.partitionBy("v"))).where("n > 1")
    counted = scratch.write(counted, "variants")
    few = counted.where(F.col("n") <= PAIRED).select("v", "f")
    pairs = few.alias("x").join(few.alias("y"), "v").where("x.f < y.f AND bit_count(x.f ^ y.f) <= 2").select(F.col("x.f").alias("a"), F.col("y.f").alias("b"))
    many = counted.where(F.col("n") > PAIRED).select("f").distinct()
    centres = many.select("f", F.explode(F.expr("concat(array(f), transform(sequence(0, 63), i -> f ^ shiftleft(1L, i)))")).alias("c"))
    stars = centres.withColumn("b", F.min("f").over(W.partitionBy("c"))).where("f <> b").select(F.col("f").alias("a"), "b")
    return pairs.unionAll(stars)


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """Rows (key, f, component): component is the least key that links of at most two bits reach."""
    scratch = scratch or Scratch(df.sparkSession, "simhash")
    prints = scratch.write(fingerprints(df, key, text, words), "prints")
    least = scratch.write(prints.groupBy("f").agg(F.min(key).alias("least")), "distinct")
    reached = components(links(least.select("f"), scratch), scratch)
    # a component's name is the least key of its fingerprints, not the least fingerprint
    named = least.join(reached.withColumnRenamed("node", "f"), "f", "left").withColumn("c", F.coalesce("component", "f"))
    by_c = named.groupBy("c").agg(F.min("least").alias("component_key"))
    of = scratch.write(named.select("f", "c").join(by_c, "c").select("f", F.col("component_key").alias("component")), "named")
    return prints.join(of, "f").select(key, "f", "component")


#: Of near_copies: similarity, segments and their bits (of two-word shingles), 64-bit words that verify (five-word shingles), and nodes of a bucket that are compared in pairs.
SIMILARITY = 0.8
NEAR_SEGMENTS, NEAR_BITS = 10, 28
CHECK_WORDS = 8
NEAR_PAIRED = 8


def sketch(text: str) -> tuple[list[int], list[int]]:
    """Segments for the index, as ints, and signed longs of the fingerprint that verifies."""
    h = shingling.word_hashes(text)
    index = signed_bits(shingling.shingles_of(h, 2), -(-NEAR_SEGMENTS * NEAR_BITS // 64))[: NEAR_SEGMENTS * NEAR_BITS].reshape(NEAR_SEGMENTS, NEAR_BITS)
    check = np.packbits(signed_bits(shingling.shingles_of(h, 5), CHECK_WORDS)).view(">i8")
    return (index @ (1 << np.arange(NEAR_BITS))).tolist(), check.tolist()


def allowed_bits(similarity: float, bits: int) -> int:
    """Bits by which fingerprints of texts of that Jaccard similarity differ, and one standard deviation."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + np.sqrt(bits * p * (1 - p)))


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Rows (key, whole, component) of all rows: ``whole`` is the text's hash, ``component`` the least hash of its group.

    Texts are linked at an estimated Jaccard similarity of SIMILARITY of five-word shingles. That leaves
    up to a seventh of a fingerprint's bits different, for which segments that always meet would be too
    short to tell texts apart. Instead, the indexed fingerprint is of two-word shingles, which an
    edit touches less, in ten segments of 28 bits: at similarity 0.8 a segment differs by at most one
    bit with probability 0.24, so 94 % of such pairs meet, and 99.7 % at 0.9. Pairs that meet
    are verified by 512 bits of five-word shingles.

    Buckets of up to NEAR_PAIRED nodes are compared in pairs. In fuller ones, which only large groups
    make, each node is first compared with the least one and with three neighbours in an order that differs from
    bucket to bucket; a node is in up to 280 buckets, so groups come together. Then all pairs of full buckets
    that aren't in one group yet are compared, so that only pairs are left out that can't change a group.
    """
    scratch = scratch or Scratch(df.sparkSession, "near")

    def make():
        def step(c: dict) -> dict:
            made = [sketch(t or "") for t in c[text]]
            return c | {"segments": [m[0] for m in made], "check": [m[1] for m in made]}

        return step

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.xxhash64(text).alias("whole"), text)
    held = scratch.write(map_steps(rows, make, f"`{key}` {kind}, whole long, segments array<int>, check array<long>", text), "sketches")
    nodes = scratch.write(held.groupBy("whole").agg(F.first("segments").alias("segments"), F.first("check").alias("check")), "nodes")
    each = "flatten(transform(segments, (s, i) -> transform(sequence(0, 27), b -> shiftleft(i * 32L + b, 28) | (s & ~shiftleft(1, b)))))"
    rows = nodes.select("whole", F.explode(F.expr(each)).alias("bucket"))
    rows = scratch.write(rows.withColumn("n", F.count("*").over(W.partitionBy("bucket"))).where("n > 1"), "buckets")
    few = rows.where(F.col("n") <= NEAR_PAIRED).select("bucket", "whole")
    pairs = few.alias("x").join(few.alias("y"), "bucket").where("x.whole < y.whole").select(F.col("x.whole").alias("a"), F.col("y.whole").alias("b"))
    order = W.partitionBy("bucket").orderBy(F.xxhash64("bucket", "whole"))
    ahead = F.array(*(F.lag("whole", i).over(order) for i in (1, 2, 3)), F.min("whole").over(W.partitionBy("bucket")))
    crowd = rows.where(F.col("n") > NEAR_PAIRED).select("whole", ahead.alias("others")).select("whole", F.explode("others").alias("other")).where("whole <> other")
    pairs = scratch.write(pairs.unionAll(crowd.select(F.least("whole", "other").alias("a"), F.greatest("whole", "other").alias("b"))).distinct(), "pairs")
    side = lambda n: nodes.select(F.col("whole").alias(n), F.col("check").alias(f"check_{n}"))
    far = F.aggregate(F.zip_with("check_a", "check_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    alike = lambda p: p.join(side("a"), "a").join(side("b"), "b").where(far <= allowed_bits(SIMILARITY, 64 * CHECK_WORDS)).select("a", "b")
    linked = scratch.write(alike(pairs), "linked")
    of = components(linked, scratch)
    full = rows.where(F.col("n") > NEAR_PAIRED)
    if full.head(1):
        apart = full.join(of.withColumnsRenamed({"node": "whole", "component": "c"}), "whole", "left").withColumn("c", F.coalesce("c", "whole"))
        by = W.partitionBy("bucket")
        apart = apart.withColumn("more", F.min("c").over(by) != F.max("c").over(by)).where("more").select("bucket", "whole", "c")
        others = apart.alias("x").join(apart.alias("y"), "bucket").where("x.whole < y.whole AND x.c <> y.c").select(F.col("x.whole").alias("a"), F.col("y.whole").alias("b"))
        others = scratch.write(others.distinct().join(pairs, ["a", "b"], "left_anti"), "others")
        of = components(linked.unionAll(alike(others)), scratch)
    named = scratch.write(of.withColumnRenamed("node", "whole"), "groups")
    return held.select(key, "whole").join(named, "whole", "left").select(key, "whole", F.coalesce("component", "whole").alias("component"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df``, with all its columns, less all rows of each group of near copies but the one with the least key.

    Rows that repeat key and text are one document, of which one row stays.
    """
    scratch = Scratch(df.sparkSession, "near")
    rows = scratch.write(near_copies(df, key, text, scratch), "rows")
    kept = rows.groupBy("component").agg(F.min(F.struct(key, "whole")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    gone = rows.join(kept, "component").where(~F.struct(F.col(key), "whole").eqNullSafe(F.col("kept"))).select(key, "whole").distinct()
    out = without(df, scratch.write(gone, "gone"), key, text)
    repeats = rows.groupBy(key, "whole").count().where("count > 1")
    return out.dropDuplicates([key, text]) if repeats.head(1) else out


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and group."""
    out = groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
