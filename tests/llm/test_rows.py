"""Sharding, fingerprints, vector search and pseudonyms: brute force, bounds and odd rows."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_words import words
from pyspark.sql import functions as F

from flatsieve.llm import fingerprints, pii, sharding, vector_search
from flatsieve.llm.common import STEP_BYTES, Scratch


def test_shards(docs, edges, none):
    rows = [(i, words(i, 30 + i % 40)) for i in range(400)] + [(1000 + i, "a copy of one text") for i in range(200)] + [(2000 + i, words(7000 + i // 2, 10)) for i in range(100)]
    out = sharding.shard_by_bytes(docs(rows), 8).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, _ in rows)
    texts = dict(rows)
    assert all(r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in out)
    sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8 + 2 * max(r["size"] for r in out)
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    of = {}
    for r in out:
        if r["doc_id"] >= 2000:
            of.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(x) == 1 for x in of.values())  # small groups stay whole
    got = {(r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.shard_by_bytes(edges, 3).collect()}
    assert {(1, 16, 0), (2, 16, 0), (None, 22, zlib.crc32(b"no key"))} <= got
    assert sharding.shard_by_bytes(edges, 3).count() == 12 and sharding.shard_by_bytes(none, 3).count() == 0


def shingles(t):
    w = (t or "").lower().encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_fingerprints_with_next(docs, edges, none):
    base = words(1, 400)
    rows = [(i, base if i % 3 == 0 else base[: 700 + i] + words(i, 100)) for i in range(60)]
    out = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs(rows), 5).collect()}
    assert len(out) == 60
    errors = []
    for i, t in rows:
        after, q = rows[(i + 1) % 60][1], len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert out[i]["n_chars"] == len(t) and out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [out[i]["near_edited"] - near(t, edited), out[i]["near_next"] - near(t, after)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    assert len({out[i]["fingerprint"] for i in range(0, 60, 3)}) == 1
    got = fingerprints.compare_with_next(edges, 4).collect()
    assert len(got) == 12 and len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3, 10)}) == 1
    one = {r["doc_id"]: r for r in got}
    assert one[1]["near_next"] == 1 and one[10]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    assert fingerprints.compare_with_next(none, 4).count() == 0
    alone = fingerprints.compare_with_next(docs([(3, "just one text here")]), 4).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
@pytest.mark.parametrize("share", [0.0, 0.3, 0.8, 1.0])
def test_likeness_has_no_bias(bits, share):
    errors = []
    for k in range(30):
        a = words(k, 300).split()
        b = [*a[: int(300 * share)], *words(k + 999, 300 - int(300 * share)).split()]
        x, y = (fingerprints.fingerprint(" ".join(t), bits=bits) for t in (a, b))
        assert len(x) == fingerprints.BINS * bits // 8
        errors.append(fingerprints.likeness(x, y, bits) - near(" ".join(a), " ".join(b)))
    assert abs(np.mean(errors)) < (0.06 if bits == 1 else 0.03)


def test_few_shingles_fill_all_bins():
    assert fingerprints.likeness(fingerprints.fingerprint("one two"), fingerprints.fingerprint("one two")) == 1
    assert fingerprints.likeness(fingerprints.fingerprint("one two"), fingerprints.fingerprint("three four")) < 0.1


def test_search(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(600, 16)).astype(np.float32)
    v[100:200] = v[0]  # a vector that many rows share
    ids = np.arange(600)
    rows = [(int(i), [float(x) for x in v[i]]) for i in ids] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, [1.0, 2.0]), (1005, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit("y"))
    for k, block in ((7, 4096), (5, 100)):
        out = vector_search.search(df.where("vec_id % 20 = 0"), df, k, block=block).collect()
        w = v.astype(float)
        got = {}
        for x in out:
            got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
        assert set(got) == set(range(0, 600, 20))
        hits = 0
        for q, found in got.items():
            s = w @ w[q]
            want = [i for i in np.lexsort((ids, -np.round(s, 12))) if i != q][:k]
            found.sort()
            assert [f[0] for f in found] == list(range(1, k + 1))
            assert [f[2] for f in found] == pytest.approx([s[f[1]] for f in found], abs=1e-12)
            hits += len(set(want) & {f[1] for f in found})
        assert hits / (30 * k) > 0.97
    few = vector_search.search(df.where("vec_id = 0"), df.where("vec_id in (0, 1, 2, 1000)"), 20).collect()
    assert len(few) == 2
    assert vector_search.search(df.limit(0), df, 5).count() == 0 and vector_search.search(df.where("vec_id = 0"), df.limit(0), 5).count() == 0


def test_error_bounds_hold():
    r = np.random.default_rng(2)
    v, q = r.normal(size=(400, 32)), r.normal(size=(50, 32))
    codes, norm, fit = vector_search.encode(v)
    turn = vector_search.rotation(32)
    d = turn.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(float) * 2 - 1
    guess = signs @ (q @ turn).T * (norm / (math.sqrt(d) * fit))[:, None]
    slack = (norm * np.sqrt(1 - fit**2) / fit * vector_search.Z / math.sqrt(d - 1))[:, None] * np.sqrt((q**2).sum(1))
    assert (np.abs(guess - v @ q.T) <= slack).mean() > 0.97
    assert abs((guess - v @ q.T).mean()) < 0.05


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def made(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["text"], [x["kind"] for x in r["found"]] if r["found"] is not None else []) for r in pii.pseudonymize(df, key=key, found="found").orderBy("doc_id").collect()]


def test_pseudonyms(spark):
    texts = [
        "card 4465 7583 8288 9437 end", "card 4539578763621486.", "no card 4539578763621487", "call +1 (663) 555-6869 or (663) 555-6869", "ssn 123-45-6789, not 000-45-6789",
        "ip 10.0.0.255 not 300.1.1.1 nor 1.2.3.4.5", "born 2001-02-28, not 2001-02-30", "on 31/12/1999 or 12/31/1999 or 24.12.2020", "mail ann.lee42@mail.example.com!", "DE89 3704 0044 0532 0130 00",
        "x4539578763621486 4539578763621486x 45395787636214860000", "", "nothing", "+44 20 7946 0958",
    ]
    out = made(spark, texts)
    kinds = [k for _, k in out]
    assert kinds[2] == kinds[11] == kinds[12] == kinds[10] == [] and out[2][0] == texts[2] and out[10][0] == texts[10]
    assert kinds[1] == ["card"] and kinds[3] == ["phone", "phone"] and kinds[4] == ["ssn"] and kinds[5] == ["ip"] and kinds[6] == ["date"] and kinds[7] == ["date"] * 3 and kinds[8] == ["email"] and kinds[9] == ["iban"] and kinds[13] == ["phone"]
    assert luhn(re.search(r"\d{16}", out[1][0]).group()) and out[1][0] != texts[1]
    a, b = re.findall(r"\(\d{3}\) \d{3}-\d{4}", out[3][0])
    assert a == b != "(663) 555-6869" and out[3][0].startswith("call +1 (")
    assert "000-45-6789" in out[4][0] and "123-45-6789" not in out[4][0]
    assert "300.1.1.1" in out[5][0] and "1.2.3.4.5" in out[5][0] and "10.0.0.255" not in out[5][0]
    assert "2001-02-30" in out[6][0] and "2001-02-28" not in out[6][0]
    assert re.fullmatch(r"on \d\d/\d\d/\d{4} or \d\d/\d\d/\d{4} or \d\d\.\d\d\.\d{4}", out[7][0])
    assert out[8][0].endswith("@mail.example.com!") and re.fullmatch(r"mail [a-z]{3}\.[a-z]{3}\d\d@.*", out[8][0])
    moved = out[9][0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1
    assert made(spark, texts) == out and made(spark, texts, "other") != out


def test_cards_are_validated(spark):
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    r = random.Random(1)
    numbers = ["".join(r.choice("0123456789") for _ in range(16)) for _ in range(200)]
    for n, (text, kinds) in zip(numbers, made(spark, numbers)):
        assert (kinds == ["card"]) == luhn(n) and (text == n) == (not luhn(n)) and luhn(text) == luhn(n)


def test_permutations(spark):
    """One-to-one on a whole format, and undone by the inverse."""
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = df.select("d", pii.feistel(F.col("d"), "k", "t").alias("e")).select("d", "e", pii.feistel(F.col("e"), "k", "t", inverse=True).alias("b")).collect()
    assert len({r["e"] for r in out}) == 1000 and all(r["b"] == r["d"] and len(r["e"]) == 3 for r in out)
    days = spark.range(0, 73049, 37).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    moved = [r["text"] for r in pii.pseudonymize(days).collect()]
    assert len(set(moved)) == len(moved) and all("1900-01-01" <= d <= "2099-12-31" for d in moved)


def test_pii_edges(edges, none, docs):
    out = pii.pseudonymize(edges)
    assert out.columns == edges.columns and {(r["doc_id"], r["text"]) for r in out.collect()} == {(r["doc_id"], r["text"]) for r in edges.collect()}
    assert pii.pseudonymize(none).count() == 0
    many = " ".join(["mail a1@b.co"] * 5000)
    assert "a1@b.co" not in pii.pseudonymize(docs([(1, many)])).head()["text"]


def test_pii_runs_no_python(edges):
    plan = pii.pseudonymize(edges)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pii_layouts(spark):
    whole = "453957876362148627"
    whole += next(c for c in "0123456789" if luhn(whole + c))
    grouped = " ".join([whole[:4], whole[4:8], whole[8:12], whole[12:16], whole[16:]])
    texts = ["+33 1 23 45 67 89", "+33 6 12 34 56 78", "+61 2 9374 4000", "1-555-123-4567", "+44 20 7946 0958 2024", "at 2024-05-03T12:00:00Z", "not 2024-05-03Tea", grouped, "4465 7583 8288 9437 123"]
    out = made(spark, texts)
    assert [k for _, k in out] == [["phone"]] * 5 + [["date"], [], ["card"], ["card"]]
    assert all((a == b) == (b == texts[6]) for (a, _), b in zip(out, texts))
    assert out[5][0].endswith("T12:00:00Z") and out[4][0].endswith(" 2024") and luhn(out[7][0].replace(" ", "")) and out[8][0].endswith(" 123") and luhn(out[8][0][:19].replace(" ", ""))


def python_feistel(digits, key, kind):
    """The permutation anew, in plain Python."""
    import hashlib

    u = len(digits) // 2
    a, b = digits[:u], digits[u:]
    for i in range(pii.ROUNDS):
        told = int(hashlib.sha256(f"{key}|{kind}|{i}|{b}".encode()).hexdigest()[:15], 16) % min(10 ** len(a), 10**12)
        a, b = b, str((int(a) + told) % 10 ** len(a)).zfill(len(a))
    return a + b


def python_luhn(body):
    total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(body)))
    return body + str(-total % 10)


def test_pseudonyms_by_brute_force(docs):
    """Cards and SSNs in running text, by an implementation of its own."""
    import random
    import re

    r, key, rows, want = random.Random(8), "another secret", [], []
    for k in range(60):
        card = python_luhn("4" + "".join(r.choice("0123456789") for _ in range(14)))
        ssn = f"{r.randint(1, 665):03}-{r.randint(1, 99):02}-{r.randint(1, 9999):04}"
        spaced = " ".join(re.findall("....", card))
        rows.append((k, f"pay {spaced}, or {card}; no. {ssn} (mine)"))
        moved = python_luhn(python_feistel(card[:-1], key, "card"))
        number = ssn.replace("-", "")
        while True:
            number = python_feistel(number, key, "ssn")
            if re.fullmatch(r"(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}", number):
                break
        want.append((k, f"pay {' '.join(re.findall('....', moved))}, or {moved}; no. {number[:3]}-{number[3:5]}-{number[5:]} (mine)"))
    assert sorted(map(tuple, pii.pseudonymize(docs(rows), key=key).select("doc_id", "text").collect())) == want


@pytest.mark.parametrize("part", ["a@b.c", ".c", "a@", "GB29 ", "1234 ", "1-", "+1 ", "(555) ", "12/", "1.", "@b", "AB12"])
def test_long_repeats_end(docs, part):
    """Long runs of each pattern's parts don't use up the stack."""
    text = "mail a@b" + part * 100_000 + " end"
    out = pii.pseudonymize(docs([(1, text)]), key="k").head()["text"]
    assert out.endswith(" end")


def test_exhausted_walks_are_masked(docs, monkeypatch):
    monkeypatch.setattr(pii, "_ssn_ok", lambda d: d == "123456789")
    monkeypatch.setattr(pii, "WALKS", 2)
    assert pii.pseudonymize(docs([(1, "no. 123-45-6789.")]), key="k").head()["text"] == "no. 000-00-0000."


def test_key_of_the_corpus(spark, docs):
    df = docs([(1, "call +1 212 555 0123 or +351 912 345 678")])
    a, b = (pii.pseudonymize(df).head()["text"] for _ in range(2))
    assert a == b and "555 0123" not in a and "+351 " in a and "912 345 678" not in a
    spark.conf.set(pii.KEY_SETTING, "given")
    try:
        assert pii.pseudonymize(df).head()["text"] == pii.pseudonymize(df, key="given").head()["text"] != a
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_repeated_queries_and_candidates(spark):
    """A query row that is there twice gives the same k neighbours, and a candidate row that is there often is one."""
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(rows + [rows[0]] + [rows[9]] * 30, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vector_search.search(df.where("vec_id = 0"), df, 5).collect()))
    score = {i: sum(a * b for a, b in zip(rows[0][1], v)) for i, v in rows[1:]}
    want = sorted(score, key=lambda i: (-score[i], i))[:5]
    assert [(q, k, i) for q, k, i, _ in got] == [(0, k, i) for k, i in enumerate(want, 1)]


def test_written_batches_are_bounded(spark):
    name, rows = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("word "), 4000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])

    scratch, before = Scratch(spark, "batches"), spark.conf.get(name)
    got = scratch.write(rows.mapInArrow(sizes, "size long, n long"), "sizes").collect()
    assert sum(r["n"] for r in got) == 2000 and max(r["size"] for r in got) < 2 * STEP_BYTES
    assert spark.conf.get(name) == before and spark.conf.get(name, None) is None
    spark.conf.set(name, "1m")  # a session's own bound stays
    try:
        got = scratch.write(rows.mapInArrow(sizes, "size long, n long"), "sizes").collect()
        assert max(r["size"] for r in got) < 2_000_000 and spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)
    scratch.close()


def test_shuffles_of_written_tables_go(spark):
    """Without waiting for the driver's garbage collection; other actions keep the session's setting."""

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).endswith(".data")}

    scratch, before = Scratch(spark, "shuffles"), shuffles()
    rows = scratch.write(spark.range(0, 1000, 1, 4).repartition(4, "id"), "rows")
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left and rows.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    scratch.close()
