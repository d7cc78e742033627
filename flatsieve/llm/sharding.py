"""Contiguous shards of near equal bytes from global byte-size prefix sums.

Rows are ordered by (hash of the text, key), so that equal texts stand side by side. Each range
partition adds up its own sizes; the totals of the partitions (a row for each partition) give every
partition its offset, and an offset plus a prefix inside the partition is a row's place among all
bytes. The places are cut at equal targets. Only (key, hash, size, checksum) is shuffled, never texts.

A run of equal texts that is small against a shard (``slack``) goes whole to the shard of its
middle; a larger run, such as a third of the corpus, is cut like other rows.

Defined cases: a null text has no bytes and the checksum of the empty text; an empty table gives an
empty result; repeated rows are placed one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, prefix_sums

#: Bytes that each row takes besides its text.
OVERHEAD = 16


def shard_by_bytes(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slack: float = 0.02, scratch: Scratch | None = None) -> DataFrame:
    """Rows (key, size, text_crc32, shard, slot): shards 0 to ``shards`` - 1 are contiguous in the order of (text hash, key).

    ``slack``: the part of a shard's target up to which a run of equal texts stays whole.
    """
    scratch = scratch or Scratch(df.sparkSession, "shards")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = scratch.write(df.select(F.col(key), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("text_hash")), "sizes")
    at = prefix_sums(rows, ["text_hash", key], "size", scratch, "placed")
    runs = at.groupBy("text_hash").agg(F.count("*").alias("copies"), F.sum("size").alias("run_bytes"), F.min("start").alias("run_start")).where("copies > 1")
    at = at.join(runs, "text_hash", "left")
    whole = F.col("run_bytes") <= F.col("total") / shards * slack
    middle = F.when(whole, F.col("run_start") + F.expr("run_bytes div 2")).otherwise(F.col("start") + F.expr("size div 2"))
    at = at.withColumn("shard", F.least(F.lit(shards - 1), (middle.cast("decimal(38,0)") * shards / F.col("total")).cast("int")))
    first = at.groupBy("shard").agg(F.min("index").alias("first"))  # a row for each shard
    return at.join(F.broadcast(first), "shard").select(key, "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    out = shard_by_bytes(documents(spark, sf_dir), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
