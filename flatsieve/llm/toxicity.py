"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams and itself; its vector is their mean. A segment of
SEGMENT words is the mean of its words' vectors, and a linear softmax gives the segment's odds of
toxic against clean. Embeddings and softmax are trained jointly in numpy on the driver, on a bounded sample of labelled
rows, where a document's odds are the sum of its segments' odds. A document is scored by the greatest odds of its
segments, at every word, so that neither a long clean text nor a repeated one gathers odds, and one bad segment in a
long text is not averaged away. Words that training never saw, such as misspellings, share n-grams with words it saw.

As everything before the softmax is a mean, the trained model folds into one number for each n-gram
bucket, which is all that tasks get. Tasks keep the numbers of at most CACHE_WORDS words.

Defined cases: null and empty texts are one empty segment and get the model's bias, a number between
0 and 1; with one class or no rows to learn from the score is the labels' share of toxic (0 for
none); a row whose label or key is null isn't learned from, nor a key that has both labels; of rows that repeat a key the
least text is learned from; a null key isn't held out; repeated rows get equal answers; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, held_out, map_steps, without

N_BUCKETS = 1 << 17
DIM = 4
SEGMENT = 2
GRAMS = (3, 4, 5)
#: Labelled rows of each class that are fitted at most, those with the smallest hash of key.
FIT_ROWS = 1200
#: Training documents that a bucket must occur in to get a vector.
MIN_DOCS = 4
#: Of training: weight decay of embeddings by epoch, their rate, and what a segment's mean is multiplied by before the softmax.
DECAY = 0.002
RATE = 1.0
SCALE = 16.0
CACHE_WORDS = 400_000
WORD = re.compile(r"\w+")


def grams(word: str, buckets: int = N_BUCKETS) -> list[int]:
    """Buckets of the word with its bounds marked, and of its n-grams."""
    w = f"<{word}>"
    return [zlib.crc32(w.encode("utf-8", "replace")) % buckets] + [zlib.crc32(w[i : i + n].encode("utf-8", "replace")) % buckets for n in GRAMS for i in range(len(w) - n + 1) if n < len(w)]


def bags(words: list[str], buckets: int = N_BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all words, one after another, and how many each has."""
    out = [np.array(grams(w, buckets), np.int32) for w in words]
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.array([len(b) for b in out], np.int64)


@dataclass
class Model:
    """value: the softmax's log odds by n-gram bucket; bias: those of an empty segment."""

    value: np.ndarray
    bias: float

    def words(self, words: list[str]) -> list[float]:
        out: list[float] = []
        for at in range(0, len(words), 20_000):
            flat, sizes = bags(words[at : at + 20_000], len(self.value))
            out += (np.add.reduceat(self.value[flat], np.cumsum(sizes) - sizes) / sizes).tolist()
        return out

    def greatest(self, values: np.ndarray) -> float:
        """The greatest mean of SEGMENT words in sequence, from their values in order; 0 without words."""
        size = min(SEGMENT, len(values))
        if not size:
            return 0.0
        sums = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
        return float((sums[size:] - sums[:-size]).max()) / size

    def score(self, values: np.ndarray) -> float:
        """The document's probability, from its words' values in order."""
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.greatest(values) + self.bias))))


def fit(rows: list[tuple[str, int]], prior: float, epochs: int = 40) -> Model:
    """Fit on (text, 0 or 1) rows; ``prior`` is the share of 1 among all labelled rows, which the sample of each class hides."""
    labels = np.array([y for _, y in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        return Model(np.zeros(N_BUCKETS, np.float32), math.log(max(prior, 1e-9) / max(1 - prior, 1e-9)) if rows else -30.0)
    index: dict[str, int] = {}
    docs = [[index.setdefault(w, len(index)) for w in WORD.findall(t.lower())] for t, _ in rows]
    tokens = np.array([w for d in docs for w in d], np.int32)
    sizes = [n for d in docs for n in ([SEGMENT] * (len(d) // SEGMENT) + [len(d) % SEGMENT] * bool(len(d) % SEGMENT))]
    owner = np.repeat(np.arange(len(docs)), [-(-len(d) // SEGMENT) for d in docs])
    segment_of, sizes = np.repeat(np.arange(len(sizes)), sizes), np.array(sizes, np.float32)
    gram, lengths = bags(list(index))
    starts, docs = np.cumsum(lengths) - lengths, [np.array(d, np.int32) for d in docs]
    in_docs = np.zeros(N_BUCKETS, np.int32)
    for d in docs:
        d = np.unique(d)
        at = np.repeat(starts[d] - (np.cumsum(lengths[d]) - lengths[d]), lengths[d])
        in_docs[np.unique(gram[at + np.arange(len(at))])] += 1
    of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    used, gram = np.unique(np.where(in_docs[gram] >= MIN_DOCS, gram, N_BUCKETS), return_inverse=True)  # the last stands for all rare ones, and for those not seen at all
    gram, n_words, lengths = gram.astype(np.int32), len(lengths), lengths.astype(np.float32)

    rng = np.random.default_rng(5)
    e, w, b = rng.normal(0, 0.01, (len(used), DIM)).astype(np.float32), rng.normal(0, 1, (DIM, 2)).astype(np.float32), np.array([0, -4], np.float32)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (e, w, b)]
    mean = lambda values, groups, n: np.stack([np.bincount(groups, values[:, k], n) for k in range(values.shape[1])], 1).astype(np.float32)
    for t in range(1, epochs + 1):
        words = mean(e[gram], of, n_words) / lengths[:, None]
        bag = mean(words[tokens], segment_of, len(sizes)) / sizes[:, None]
        z = SCALE * bag @ w + b
        odds = np.exp(np.clip(z[:, 1] - z[:, 0], -60, 60))
        total = np.bincount(owner, odds, len(labels))
        g = ((total / (1 + total) - labels) / len(labels))[owner] * odds / np.maximum(total, 1e-30)[owner]
        g = np.stack([-g, g], 1).astype(np.float32)
        gbag = SCALE * g @ w.T / sizes[:, None]
        gwords = mean(gbag[segment_of], tokens, n_words) / lengths[:, None]
        for x, grad, (m, v), rate in zip((e, w, b), (mean(gwords[of], gram, len(used)), SCALE * bag.T @ g, g.sum(0)), state, (RATE, 0.02, 0.1)):
            m += 0.1 * (grad - m)
            v += 0.01 * ((grad**2).max() - v)  # of the largest: steps follow how much a bucket tells, so rare ones stay small
            x -= rate * math.sqrt(1 - 0.99**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-9)
        e *= 1 - DECAY
    told = SCALE * e @ (w[:, 1] - w[:, 0])
    value = np.full(N_BUCKETS + 1, told[-1] if used[-1] == N_BUCKETS else 0, np.float32)
    value[used] = told
    value = value[:-1]
    share = float(labels.mean())
    return Model(value, float(b[1] - b[0]) + math.log(prior / (1 - prior)) - math.log(share / (1 - share)))


def training_rows(df: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", rows: int = FIT_ROWS) -> tuple[list[tuple[str, int]], float]:
    """At most ``rows`` (text, label) of each class, those whose key has the smallest hash, and the share of label 1 in ``labels``.

    Keys are chosen on the narrow label rows; only the texts of the chosen ones, at most 2 x ``rows``,
    are fetched.
    """
    told = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("most"))
    known = told.where("y = most").select("k", "y", F.xxhash64(F.col("k").cast("string")).alias("h"))
    share = known.agg(F.avg("y")).first()[0]
    few = known.where("y = 0").orderBy("h", "k").limit(rows).unionAll(known.where("y = 1").orderBy("h", "k").limit(rows))
    chosen = {r["k"]: r["y"] for r in few.collect()}
    if not chosen:
        return [], share or 0.0
    kind = df.schema[key].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame([(k,) for k in chosen], f"k {kind}")
    texts = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(wanted), "k", "left_semi").groupBy("k").agg(F.min("t").alias("t"))
    return sorted((r["t"], chosen[r["k"]]) for r in texts.collect()), share or 0.0


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", passed: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, passed columns, score, predicted)."""

    def make():
        known: dict[str, float] = {}

        def step(c: dict) -> dict:
            docs = [WORD.findall((t or "").lower()) for t in c[text]]
            if len(known) > CACHE_WORDS:
                known.clear()
            new = list({w for d in docs for w in d if w not in known})
            known.update(zip(new, model.words(new)))
            p = [model.score(np.array([known[w] for w in d], np.float32)) for d in docs]
            return c | {"score": p, "predicted": [int(x >= 0.5) for x in p]}

        return step

    kinds = "".join(f"`{x}` {df.schema[x].dataType.simpleString()}, " for x in (key, *passed))
    return map_steps(df.select(key, *passed, text), make, f"{kinds}score double, predicted int", text)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels that are not held out."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(0, 5))
    model = fit(*training_rows(docs, labels))
    return score(docs.withColumn("held_out", held_out(0, 5)), model, passed=("held_out",))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, with all its columns, less the rows that the model rejects; it is fitted on ``labels`` of rows outside the held-out fifth."""
    model = fit(*training_rows(docs, labels.where(~held_out(0, 5)), text, key=key))
    rows = docs.select(key, text, F.xxhash64(text).alias("whole"))
    bad = score(rows, model, key, text, ("whole",)).where("predicted = 1").select(key, "whole").distinct()
    return without(docs, Scratch(docs.sparkSession, "toxicity").write(bad, "rejected"), key, text)
