"""Language identification by error-correcting output codes over hashed character n-grams.

Each language has a codeword of bits. A linear classifier for each bit, trained in numpy on byte
n-gram frequencies, predicts that bit of the codeword; the prediction is the codeword with the
least loss-weighted distance (logistic loss of each bit's margin, weighted by the bit's accuracy in
training). A small gap between the two nearest codewords flags the text as ambiguous.

Prediction reads whole texts in steps of bounded size, with the fitted weights (N_BUCKETS x bits
floats) in the task's closure.

Defined cases: a null text or one without a letter (Unicode's categories L*) is ``und`` with score 0; of rows that repeat
a key and language the least text is learned from; a null key isn't learned from and not held out; with no rows to learn
from all texts are ``und``; with one language all lettered texts get it, with score 1; repeated
rows get equal answers; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, map_steps

N_BUCKETS = 1 << 13
#: Rows that are fitted at most for each language, those with the smallest hash of key.
FIT_ROWS = 300
AMBIGUOUS_GAP = 0.1
#: A letter of any script: Unicode's categories L*.
LETTER = regex.compile(r"\p{L}")


def codewords(n: int) -> np.ndarray:
    """A row of bits for each of n classes.

    Up to 7 classes: all 2^(n-1) - 1 ways to part the classes. Beyond: random balanced columns, the
    best by least distance of 50 draws.
    """
    if n <= 7:
        columns = [(1, *(rest >> i & 1 for i in range(n - 1))) for rest in range(2 ** (n - 1) - 1)] if n > 1 else [(1,)]
        return np.array(columns, dtype=np.int8).T
    rng, bits = np.random.default_rng(11), max(16, int(10 * np.log2(n)))
    draws = (np.array([rng.permutation(np.arange(n) % 2) for _ in range(bits)], dtype=np.int8).T for _ in range(50))
    return max(draws, key=lambda c: min((c[a] != c[b]).sum() for a, b in itertools.combinations(range(n), 2)))


def features(raw: bytes, buckets: int = N_BUCKETS) -> np.ndarray:
    """Root frequencies of the hashed byte n-grams of 1 to 4 bytes, scaled to length 1."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    counts = np.zeros(buckets, np.int64)
    code = np.zeros(len(a), np.uint32)
    for n in range(4):
        if len(a) <= n:
            break
        code = code[: len(a) - n] * np.uint32(0x01000193) + a[n:] + np.uint32(1)
        mixed = code * np.uint32(0x9E3779B1)
        if n:  # single bytes say little
            counts += np.bincount(mixed >> np.uint32(32 - (buckets.bit_length() - 1)), minlength=buckets)
    x = np.sqrt(counts, dtype=np.float32)
    return x / max(1e-9, float(np.sqrt(counts.sum())))


def _folded(text: str) -> bytes:
    """Lower case, white space and digits folded; the bounds of words are a space."""
    return b" " + re.sub(rb"[\s\d]+", b" ", text.lower().encode("utf-8", "replace")) + b" "


@dataclass
class Model:
    """languages: names by class; code: class x bit; weights: bucket x bit; bias and trust by bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, score and gap to the second nearest codeword, by row."""
        sign = self.code.astype(np.float32) * 2 - 1
        loss = (np.logaddexp(0, -margins[:, None, :] * sign[None]) * self.trust).sum(2) / self.trust.sum()
        p = np.exp(-loss * 4)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        return best, top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


def fit(rows: list[tuple[str, str]], epochs: int = 80) -> Model | None:
    """Fit on (text, language) rows by full-batch Adam on the logistic loss of every bit together."""
    if not rows:
        return None
    languages = sorted({y for _, y in rows})
    code = codewords(len(languages))
    x = np.stack([features(_folded(t)) for t, _ in rows])
    y = code[[languages.index(y) for _, y in rows]].astype(np.float32)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, epochs + 1):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(x)
        gw, gb = x.T @ g + 1e-6 * w, g.sum(0)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        c = 0.1 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w, b = w - c * m / (np.sqrt(v) + 1e-8), b - c * mb / (np.sqrt(vb) + 1e-8)
    right = (((x @ w + b) > 0) == (y > 0.5)).mean(0)
    return Model(languages, code, w, b, np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999))).astype(np.float32))


def training_rows(df: DataFrame, text: str, lang: str, key: str, rows: int = FIT_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` texts of each language, those whose key has the smallest hash (the bound on what the driver holds).

    Keys are ranked as narrow rows; only the texts of the chosen ones are fetched.
    """
    from pyspark.sql import Window as W

    near = df.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).rlike(LETTER.pattern)).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    few = near.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("h", "k"))).where(F.col("r") <= rows).select("k", "l").distinct().collect()
    if not few:
        return []
    wanted = df.sparkSession.createDataFrame([(r["k"], r["l"]) for r in few], f"k {df.schema[key].dataType.simpleString()}, l string")
    found = df.where(F.col(text).rlike(LETTER.pattern)).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    return sorted((x["t"], x["l"]) for x in found.join(F.broadcast(wanted), ["k", "l"], "left_semi").groupBy("k", "l").agg(F.min("t").alias("t")).collect())


def predict(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", passed: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, passed columns, lang_pred, score, ambiguous)."""

    def make():
        def step(c: dict) -> dict:
            texts = c[text]
            live = [i for i, t in enumerate(texts) if t is not None and model is not None and LETTER.search(t)]
            lang, score, gap = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            for at in range(0, len(live), 512):
                some = live[at : at + 512]
                best, p, g = model.decode(model.margins(np.stack([features(_folded(texts[i])) for i in some])))
                score[some], gap[some] = p, g
                for i, k in zip(some, best):
                    lang[i] = model.languages[k]
            return c | {"lang_pred": lang, "score": score, "ambiguous": gap < AMBIGUOUS_GAP}

        return step

    kinds = "".join(f"`{x}` {df.schema[x].dataType.simpleString()}, " for x in (key, *passed))
    return map_steps(df.select(key, *passed, text), make, f"{kinds}lang_pred string, score double, ambiguous boolean", text)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir).withColumn("held_out", held_out(2, 4))
    model = fit(training_rows(docs.where(~F.col("held_out")), "text", "lang", "doc_id"))
    return predict(docs, model, passed=("held_out",))
