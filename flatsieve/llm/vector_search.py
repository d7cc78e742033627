"""Nearest neighbours by largest inner product, from randomly rotated one-bit codes.

Index: every vector is turned by one fixed random rotation into EXPAND times its dimensions and kept as
the signs of its coordinates (packed bits) with two scalars: its norm, and how well the signs point
its way. Search: a query's inner product with a vector is estimated from bits and scalars, with an
error bound that holds with high probability (Z standard deviations). Vectors whose upper bound
reaches the query's k-th best lower bound or exact value so far are reranked by the exact inner
product of the original vectors in double precision.

Queries and vectors meet in blocks of bounded size: a block of vectors is sent once for each block of
queries and the reverse, so no task holds more than a block of each. Equal vectors are one row with
their k + 1 least ids, as no more can be in a result; a vector that a third of all rows share thus
costs as much as any other.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part;
vectors of other lengths than the query's aren't its candidates; fewer candidates than k are all
returned; ties go to the smaller id; rows that repeat an id and a vector are one candidate, an id with several vectors is a
candidate by each; of query rows that repeat an id the one with the least vector is asked; no queries or
an empty table give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

EXPAND = 4
Z = 2.5
#: Vectors and queries in a block, and pairs that are reranked at a time.
BLOCK = 4096
PAIRS = 100_000


def rotation(dim: int) -> np.ndarray:
    """dim x D with orthonormal rows, D the multiple of 8 from EXPAND x dim on; the same on every machine."""
    d = -(-EXPAND * dim // 8) * 8
    q, _ = np.linalg.qr(np.random.default_rng(17).normal(size=(d, dim)))
    return q.T.astype(np.float32)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norms, and the cosine between each rotated vector and its signs."""
    turned = vectors.astype(np.float32) @ rotation(vectors.shape[1])
    norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    fit = np.abs(turned).sum(1, dtype=np.float64) / (math.sqrt(turned.shape[1]) * norm)
    return np.packbits(turned > 0, axis=1), norm, fit


def valid(c: Column) -> Column:
    finite = F.forall(c, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    return c.isNotNull() & finite & F.exists(c, lambda x: x != 0)


def index(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Rows (vector, dim, ids, code, norm, fit): distinct vectors, with their k + 1 least ids."""
    few = df.where(valid(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double") + 0.0).alias("vector")).distinct()
    few = few.withColumn("r", F.row_number().over(W.partitionBy("vector").orderBy("id"))).where(F.col("r") <= k + 1)
    distinct = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            dims = np.array([len(v) for v in t["vector"].to_pylist()], np.int32)
            for dim in np.unique(dims):
                some = t.filter(pa.array(dims == dim))
                v = np.array(some["vector"].to_pylist(), np.float64)
                code, norm, fit = encode(v)
                yield from pa.table([some["vector"], pa.array(np.full(len(v), dim, np.int32)), some["ids"], pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(fit)], names=["vector", "dim", "ids", "code", "norm", "fit"]).to_batches()

    return distinct.mapInArrow(run, "vector array<double>, dim int, ids array<long>, code binary, norm double, fit double")


def best_of_block(queries: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, vector, score) of each query's k nearest in the block, ties to the smaller ``least``; and the number of pairs reranked."""
    turn = rotation(queries.shape[1])
    d = turn.shape[1]
    turned, lengths = queries.astype(np.float32) @ turn, np.sqrt((queries**2).sum(1))
    kept_q, kept_v, kept_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor, pairs = np.full(len(queries), -np.inf), 0
    for at in range(0, len(vectors), 512):
        part = slice(at, at + 512)
        signs = np.unpackbits(codes[part], axis=1, count=d).astype(np.float32) * 2 - 1
        guess = (signs @ turned.T) * (norm[part] / (math.sqrt(d) * fit[part]))[:, None].astype(np.float32)
        slack = (norm[part] * np.sqrt(np.maximum(0, 1 - fit[part] ** 2)) / fit[part] * Z / math.sqrt(d - 1))[:, None] * lengths[None]
        if len(guess) >= k:
            np.maximum(floor, np.partition(guess - slack, len(guess) - k, axis=0)[len(guess) - k], out=floor)
        row, q = np.nonzero(guess + slack >= floor)
        pairs += len(row)
        score = np.concatenate([np.einsum("ij,ij->i", vectors[at + row[i : i + PAIRS]], queries[q[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)] or [np.zeros(0)])
        kept_q, kept_v, kept_s = np.concatenate([kept_q, q]), np.concatenate([kept_v, at + row]), np.concatenate([kept_s, score])
        order = np.lexsort((least[kept_v], -kept_s, kept_q))
        kept_q, kept_v, kept_s = kept_q[order], kept_v[order], kept_s[order]
        first = np.searchsorted(kept_q, np.arange(len(queries)))
        rank = np.arange(len(kept_q)) - first[kept_q]
        full = kept_q[rank == k - 1]
        floor[full] = np.maximum(floor[full], kept_s[rank == k - 1])
        kept_q, kept_v, kept_s = (x[rank < k] for x in (kept_q, kept_v, kept_s))
    return kept_q, kept_v, kept_s, pairs


def search(queries: DataFrame, df: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of ``queries`` its k nearest of ``df`` whose id is another."""
    scratch = Scratch(df.sparkSession, "vectors")
    found = scratch.write(index(df, key, vector, k), "index")
    asked = queries.where(valid(F.col(vector))).select(F.col(key).cast("long").alias("query_id"), F.transform(F.col(vector), lambda x: x.cast("double") + 0.0).alias("vector")).groupBy("query_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    asked = scratch.write(asked, "queries")
    n_q, n_v = max(1, -(-asked.count() // block)), max(1, -(-found.count() // block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn("v", spread(n_v)).select("q", "v", "dim", "query_id", "vector")
    right = found.withColumn("v", F.pmod(F.xxhash64("code"), F.lit(n_v)).cast("int")).withColumn("q", spread(n_q)).select("q", "v", "dim", "vector", "ids", "code", "norm", "fit")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "ids", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.float64())], names=names)
        matrix = lambda t: t["vector"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        codes = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(right.num_rows, -1)
        ids = right["ids"].to_pylist()
        q, v, s, _ = best_of_block(matrix(left), matrix(right), codes, right["norm"].to_numpy(), right["fit"].to_numpy(), np.array([x[0] for x in ids]), k + 1)
        return pa.table([pa.array(left["query_id"].to_numpy()[q]), right["ids"].combine_chunks().take(pa.array(v)), pa.array(s)], names=names)

    met = left.groupBy("q", "v", "dim").cogroup(right.groupBy("q", "v", "dim")).applyInArrow(run, "query_id long, ids array<long>, score double")
    rows = met.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return rows.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(df.where("vec_id % 20 = 0"), df, 20)
