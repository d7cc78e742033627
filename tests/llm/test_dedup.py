"""SimHash groups, near copies, line deduplication and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from conftest_words import words

from pyspark.sql import functions as F

from flatsieve.llm import line_dedup, simhash
from flatsieve.llm.common import Scratch
from flatsieve.llm.components import components


def joined(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(300 + i, 301 + i) for i in range(40)] + [(400, x) for x in range(401, 450)]
    want = joined(450, pairs)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: want[x] for p in pairs for x in p if p[0] != p[1]} | {x: want[x] for p in pairs for x in p if x in got}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_links_lose_none(spark, monkeypatch):
    """Clusters of fingerprints around few centres, paired and through centres."""
    r = random.Random(2)
    prints = set()
    for _ in range(6):
        c = r.getrandbits(64)
        for _ in range(120):
            x = c
            for b in r.sample(range(64), r.choice([0, 1, 1, 2, 3])):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(int(np.uint64(x).astype(np.int64)) for x in prints)
    f = np.array(prints, np.int64).view(np.uint64)
    want = joined(len(f), [(i, j) for i in range(len(f)) for j in range(i) if int(np.bitwise_count(f[i] ^ f[j])) <= 2])
    df = spark.createDataFrame([(x,) for x in prints], "f long")
    for most in (4, 10_000):
        monkeypatch.setattr(simhash, "PAIRED", most)
        s = Scratch(spark, "t")
        got = {x["node"]: x["component"] for x in components(simhash.links(df, s), s).collect()}
        groups = {}
        for i, p in enumerate(prints):
            groups.setdefault(got.get(p, p), set()).add(want[i])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_groups(spark, edges, none):
    rows = simhash.groups(edges).collect()
    assert len(rows) == edges.count()
    texts = {(r["doc_id"], r["text"]) for r in edges.collect()}
    assert sorted((str(r["doc_id"]), r["f"] & (1 << 64) - 1) for r in rows) == sorted((str(i), fingerprint(t)) for i, t in texts for _ in range(1 + ((i, t) == (5, "the same text as others"))))
    of = {r["doc_id"]: r["component"] for r in rows}
    assert of[1] == of[2] == of[3] == of[10] == 1 and of[5] == of[6] == 5 and of[7] == 7
    assert simhash.groups(none).count() == 0


def jaccard(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_near_copies(spark, docs):
    """Edited copies above 0.85 are caught, clean documents and half-alike ones stay."""
    r, rows = random.Random(3), []
    for k in range(30):
        base = words(1000 + k, 300).split()
        rows.append(" ".join(base))
        for edits in (1, 3):
            w = list(base)
            for i in r.sample(range(300), edits):
                w[i] = f"edit{k}{i}"
            rows.append(" ".join(w))
        rows.append(" ".join(base[:150]) + " " + words(5000 + k, 150))
    df = docs(list(enumerate(rows)))
    kept = {x["doc_id"] for x in simhash.keep_one(df).collect()}
    for k in range(30):
        assert 4 * k in kept and 4 * k + 3 in kept
        for e in (1, 2):
            assert jaccard(rows[4 * k], rows[4 * k + e]) > 0.85
            assert 4 * k + e not in kept


def test_near_copies_edges(edges, none):
    out = simhash.keep_one(edges)
    assert out.columns == edges.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert kept.count(5) == 1 and 6 not in kept and {None, 4, 7, 8, 9} <= set(kept)
    assert len({1, 2, 3, 10} & set(kept)) <= 3  # equal texts: one stays
    assert simhash.keep_one(none).count() == 0


def test_large_group(docs):
    """Hundreds of copies of one text, each edited once: buckets beyond the paired ones."""
    base = words(9, 400).split()
    rows = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(300)]
    assert simhash.keep_one(docs(list(enumerate(rows)))).count() == 1


def test_lines(docs, edges, none):
    a, b, c = words(1, 20), words(2, 20), words(3, 20)
    typo = a.replace(a.split()[4], a.split()[4] + "x", 1)
    df = docs([(1, f"{a}\n{b}"), (2, f"{a.upper()}!\n\n{c}"), (3, f"{typo}\n{b}"), (4, b), (5, "page 12\nend"), (6, "Page 97.\nother")])
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert out[1] == f"{a}\n{b}" and out[2] == f"\n{c}" and out[4] == "" and out[5] == "page 12\nend" and out[6] == "other"
    assert typo not in out[3]
    got = line_dedup.dedup_lines(edges, removed="gone")
    assert got.columns == [*edges.columns, "gone"] and got.count() == edges.count()
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[1] is None and texts[2] == "" and texts[3] == " \n\t " and texts[6] == ""
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_full_buckets(docs, monkeypatch):
    """The ways of full buckets give the same groups here as pairing everything."""
    base = words(11, 60).split()
    rows = [(i, " ".join([*base[:i], f"v{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}", *base[i + 1 :]])) for i in range(60)]
    whole = line_dedup.dedup_lines(docs(rows)).where("text <> ''").count()
    monkeypatch.setattr(line_dedup, "PAIRED", 3)
    assert line_dedup.dedup_lines(docs(rows)).where("text <> ''").count() == whole == 1


def test_line_fingerprints():
    lines = [words(i, 1 + 40 * i) for i in range(20)]
    got = line_dedup.Lines(["\n".join(lines[:7]), "", "\n\n" + "\n".join(lines[7:])])
    assert got.text.tolist() == [0] * 7 + [2] * 13 and got.at.tolist() == [*range(7), *range(2, 15)]
    one = lambda w: int(line_dedup.Lines([w]).sim[0]) & (1 << 64) - 1
    known = {w: one(w) for line in lines for w in line.split()}
    for k, line in enumerate(lines):
        h = [known[w] for w in line.split()]
        assert int(got.sim[k]) & (1 << 64) - 1 == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert got.n[k] == len(line) and b" ".join(got.words(k)).decode() == line
    assert len(set(got.h.tolist())) == 20 and len(set(known.values())) == len(known)


@pytest.mark.parametrize(("a", "b", "near"), [("abcdefghij", "abcdefghxx", True), ("abcdefghij", "abcdefgxxx", False), ("w " * 600 + "a", "w " * 600 + "b", True)])
def test_edit_similarity(spark, a, b, near):
    from pyspark.sql import functions as F

    a, b = (line_dedup._unit(x.encode().split()) for x in (a, b))
    assert spark.createDataFrame([(a, b)], "a string, b string").select(line_dedup._similar(F.col("a"), F.col("b"))).head()[0] is near


def test_normalised():
    x = line_dedup.Lines(["  Héllo, WORLD -- 12/34!  \n\n\tÉ."])
    assert [x.words(i) for i in range(2)] == [["héllo".encode(), b"world", b"00", b"00"], ["é".encode()]] and x.at.tolist() == [0, 2]
    assert line_dedup.Lines([]).h.tolist() == line_dedup.Lines(["", " \n."]).h.tolist() == []


def test_lines_straddle_80_bytes(docs):
    a = words(21, 40)[:80].strip().ljust(80, "e")
    df = docs([(1, a), (2, a + "x"), (3, (b := words(22, 60)[:200].strip())), (4, b[:20] + "q" + b[20:60] + "q" + b[60:100] + "q" + b[100:])])
    assert {r["doc_id"] for r in line_dedup.dedup_lines(df).where("text <> ''").collect()} == {1, 3}


def edited(r, line, edits):
    y = list(line)
    for _ in range(edits):
        at = r.randrange(len(y))
        r.choice([lambda: y.__setitem__(at, "q"), lambda: y.insert(at, "q"), lambda: y.pop(at)])()
    return "".join(y)


@pytest.mark.parametrize(("low", "high", "share", "least"), [(5, 15, 0.2, 1.0), (16, 31, 0.2, 0.95), (32, 63, 0.2, 0.9), (64, 127, 0.2, 0.85), (128, 400, 0.2, 0.75), (16, 400, 0.1, 0.97), (20, 400, 0.0, 1.0)])
def test_line_recall(docs, low, high, share, least):
    """Planted edits: letters anywhere, up to ``share`` of the line (0: one letter)."""
    r, rows = random.Random(low), []
    for k in range(120):
        line = "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(low, high)))
        rows += [(2 * k, line), (2 * k + 1, edited(r, line, max(1, int(share * (len(line) - 1)))))]
    left = line_dedup.dedup_lines(docs(rows)).where("text <> ''").count()
    near = [1 for k in range(120) if distance(rows[2 * k][1], rows[2 * k + 1][1]) <= 0.2 * max(len(rows[2 * k][1]), len(rows[2 * k + 1][1])) + 1e-9]
    assert len(near) > 100 and 240 - left >= least * len(near)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_without_spaces(docs):
    a = "".join(chr(0x4E00 + 7 * i) for i in range(40))
    assert line_dedup.dedup_lines(docs([(1, a), (2, a[:20] + "漢" + a[21:])])).where("text <> ''").count() == 1


def test_lines_full_buckets_lose_none(docs, monkeypatch):
    """Template lines that aren't alike, with copies among them: far neighbours are compared too."""
    r, rows = random.Random(5), []
    for k in range(40):
        line = "the common passage of all" + "".join(r.choice("abcdefghijklmnop") for _ in range(60))
        rows += [(k, line), (100 + k, edited(r, line, 8))]
    want = line_dedup.dedup_lines(docs(rows)).where("text <> ''").count()
    monkeypatch.setattr(line_dedup, "PAIRED", 2)
    assert line_dedup.dedup_lines(docs(rows)).where("text <> ''").count() == want == 40


def test_near_copies_in_a_family(docs):
    """Texts alike at about 0.6 fill their buckets; planted copies among them are all found."""
    shared, rows, r = words(40, 150).split(), [], random.Random(4)
    for k in range(150):
        own = shared + words(7000 + k, 50).split()
        copy = list(own)
        copy[150 + r.randrange(48)] = "changed"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(copy))]
    out = {x["doc_id"]: x["component"] for x in simhash.near_copies(docs(rows)).collect()}
    assert sum(out[2 * k] == out[2 * k + 1] for k in range(150)) == 150


def test_lines_recall_on_a_table(spark):
    """Of all pairs of lines of a whole table that are alike, by brute force over a fifth of the lines against all: 0.9 or more are in one group."""
    table = "/root/testdata/sf0.001/documents.parquet"
    texts = [r["text"] for r in spark.read.parquet(table).select("text").collect() if r["text"]]
    x = line_dedup.Lines(texts, simhash=False)
    lines = sorted({x.normalised(i).decode() for i in range(len(x.h))} , key=len)
    lines = [s for s in lines if 5 <= len(s) <= 400]
    df = spark.createDataFrame(list(enumerate(lines)), "i long, s string")
    asked, all_ = df.where("i % 5 = 0").alias("x"), df.alias("y")
    near = asked.join(all_, F.expr("x.i <> y.i AND least(length(x.s), length(y.s)) >= 0.8 * greatest(length(x.s), length(y.s))")).where(line_dedup._similar(F.col("x.s"), F.col("y.s")))
    pairs = [(r[0], r[1]) for r in near.select("x.i", "y.i").collect()]
    kept = {r["i"]: r["t"] for r in line_dedup.dedup_lines(df.withColumn("t", F.col("s")), "i", "t").select("i", "t").collect()}
    # one line of a pair may be its group's first; both can't stay
    assert pairs and sum(kept[a] == "" or kept[b] == "" for a, b in pairs) >= 0.9 * len(pairs)


def test_edits_of_lines_against_the_whole_matrix():
    from flatsieve.llm.line_dedup import within

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            new = [i]
            for j, b in enumerate(y, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
            row = new
        return row[-1]

    r = random.Random(1)
    for t in range(600):
        letters, n = r.choice(["ab", "abcdefgh", "aé😀漢z"]), r.choice([0, 1, 3, 10, 30, 70, 130])
        x = "".join(r.choice(letters) for _ in range(n))
        y = list(x)
        for _ in range(r.randrange(1 + n // 3)):
            i = r.randrange(len(y) + 1)
            y[i : i + r.randrange(2)] = r.choice(letters) * r.randrange(2)
        y = "".join(y) if t % 10 else "".join(r.choice(letters) for _ in range(n))
        d = distance(x, y)
        for most in {0, d - 1, d, d + 1, max(len(x), len(y)) // 5} - {-1}:
            assert within(x, y, most) == within(y, x, most) == (d <= most)


def one_passage():
    """40 lines with a copy each, with which they share only a passage that all 80 have, and 1000 other lines."""
    r, rows = random.Random(19), []
    letters = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    passage = letters(40)
    for k in range(40):
        rest = letters(90)
        edits = list(rest)
        for at in range(2, 90, 4):  # no run of over three letters of the rest is left
            edits[at] = "z"
        rows += [(k, passage + rest), (100 + k, passage + "".join(edits))]
    assert sum(line_dedup.within(x, y, 26) for i, (_, x) in enumerate(rows) for _, y in rows[:i]) == 40
    return rows + [(1000 + k, letters(120)) for k in range(1000)]


def test_lines_with_one_common_passage_all_meet(docs, monkeypatch):
    """Such lines mostly hold other grams; the second step compares them too."""
    monkeypatch.setattr(line_dedup, "PAIRED", 2)
    monkeypatch.setattr(line_dedup, "BLOCK", 2)
    assert line_dedup.dedup_lines(docs(one_passage())).where("text <> ''").count() == 40 + 1000


def test_the_pipelines_lines_with_one_common_passage_all_meet(spark, docs):
    """The stage of the pipeline, with the parts and blocks that it runs with."""
    import corpus_pipeline

    assert corpus_pipeline.repeated_lines_out(spark, docs(one_passage()), "").where("text <> ''").count() == 40 + 1000


def test_many_pairs_at_once_as_one_by_one():
    r, xs, ys = random.Random(23), [], []
    for _ in range(3000):
        letters = r.choice(["ab", "abcdefgh", "aé漢😀"])
        x = [r.choice(letters) for _ in range(r.choice([0, 1, 5, 30, 80, 300]))]
        y = list(x)
        for _ in range(r.randint(0, len(x) // 3 + 1)):
            at = r.randint(0, len(y))
            y[at : at + r.randint(0, 1)] = r.choice(["", r.choice(letters)])
        xs.append("".join(x))
        ys.append("".join(y))
    xs += ["q" * 2000, "a" * 5000]  # the first has a bound above 255, the second is verified alone
    ys += ["q" * 1601 + "r", "a" * 4001]
    want = [line_dedup.within(x, y, int(max(len(x), len(y)) * 0.2 + 1e-9)) for x, y in zip(xs, ys)]
    assert line_dedup.alike(xs, ys).tolist() == want and 500 < sum(want) < 2700


def test_second_step_verifies_lines_once_each():
    """A text that many pairs name is coded once; results are those of the pairs one by one."""
    r = random.Random(29)
    units = ["".join(r.choice("abcdefgh") for _ in range(r.choice([1, 6, 40, 200, 900, 4200]))) for _ in range(60)]
    units += [edited(r, u, max(1, int(len(u) * r.choice([0.02, 0.19, 0.2, 0.21])))) for u in units] + ["", "é漢😀" * 20, "é漢😀" * 19 + "z"]
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(units)), np.arange(len(units))))
    near = np.array([abs(len(units[i]) - len(units[j])) <= 0.25 * max(len(units[i]), len(units[j])) + 1 for i, j in zip(x, y)])
    x, y = x[near], y[near]
    some = np.array([max(len(units[i]), len(units[j])) < 1000 or i % 60 == j % 60 for i, j in zip(x, y)])
    x, y = x[some], y[some]
    got = line_dedup.alike_of(units, x, y)
    want = [line_dedup.within(units[i], units[j], int(max(len(units[i]), len(units[j])) * 0.2 + 1e-9)) for i, j in zip(x, y)]
    assert got.tolist() == want and 100 < sum(want) < len(want) - 100


def test_links_of_the_second_step_are_all_of_a_gram(spark):
    """Against brute force: all similar lines that have a gram in common at places that allow it are in one group, with parts of two lines and blocks of two parts."""
    r = random.Random(31)
    passage, lines = "the passage that they all have in common", []
    for _ in range(30):
        rest = "".join(r.choice("abcdefghijklmnop") for _ in range(90))
        lines += [passage + rest, passage + edited(r, rest, 14), passage + edited(r, rest, 24)]
    x = line_dedup.Lines(lines, simhash=False)
    line, gram, at = x.grams(np.arange(len(lines)), x.seen().astype(np.float32))
    rows = sorted({(int(g), int(x.h[i]), int(x.n[i]) << 32 | int(p)) for i, g, p in zip(line, gram, at)})
    df = spark.createDataFrame(rows, "gram long, h long, z long")
    texts = spark.createDataFrame([(int(h), u) for h, u in zip(x.h, map(line_dedup._decoded, (x.normalised(i) for i in range(len(lines)))))], "h long, unit string")
    own, by = {int(h): i for i, h in enumerate(x.h)}, {}
    for g, h, z in rows:
        by.setdefault(g, []).append((own[h], z >> 32, z & 0xFFFFFFFF))
    want = set()
    for held in by.values():
        for i, n, p in held:
            for j, m, q in held:
                most = int(max(n, m) * 0.2 + 1e-9)
                if i < j and abs(p - q) + abs(n - p - m + q) <= most and line_dedup.within(x.normalised(i).decode(), x.normalised(j).decode(), most):
                    want.add((i, j))
    scratch, block = Scratch(spark, "lines"), line_dedup.BLOCK
    line_dedup.BLOCK = 2
    try:
        parts = scratch.write(line_dedup.shared(df, 2), "parts")
        none = spark.createDataFrame([], "node long, component long")  # each line is its own component
        got = line_dedup.other_links(parts, none, texts, scratch).collect()
    finally:
        line_dedup.BLOCK = block
    full = {g for g, held in by.items() if len(held) > 2}
    assert len(full) > 20 and {tuple(sorted((own[a], own[b]))) for a, b in got} | {p for p in want if not any(p[0] in (e[0] for e in by[g]) and p[1] in (e[0] for e in by[g]) for g in full)} == want
    assert len(want) > 30


def test_rows_of_the_second_step_grow_with_the_root_of_the_blocks(spark, monkeypatch):
    """A gram's blocks are dealt out in spans, as long as these hold few characters."""
    monkeypatch.setattr(line_dedup, "BLOCK", 2)
    monkeypatch.setattr(line_dedup, "PAIRED", 2)
    rows, seen = [(7, h, 200 << 32, h // 2) for h in range(400)], {}
    parts = spark.createDataFrame(rows, "gram long, h long, z long, part long")
    none, texts = spark.createDataFrame([], "node long, component long"), spark.createDataFrame([(h, f"{h:03d}" * 60) for h in range(400)], "h long, unit string")
    for most in (10_000_000, 3 * 4 * 200):  # of 100 blocks 5 make a span, or 3
        monkeypatch.setattr(line_dedup, "DEALT", most)
        scratch = Scratch(spark, "lines")
        monkeypatch.setattr(scratch, "write", lambda df, name, w=scratch.write: seen.setdefault((most, name), w(df, name)))  # noqa: B023
        seen[most] = sorted(map(tuple, line_dedup.other_links(parts, none, texts, scratch).collect()))
    assert [seen[most, "crowd"].selectExpr("sum(last + 1)").first()[0] for most in (10_000_000, 2400)] == [400 * 20, 400 * 34]
    assert seen[10_000_000] == seen[2400] and all(line_dedup.within(f"{a:03d}" * 60, f"{b:03d}" * 60, 36) for a, b in seen[2400])


def test_lines_that_no_pair_names_are_left_out_by_bits(spark):
    r = np.random.default_rng(5)
    h = r.integers(-(1 << 63), 1 << 63, 50_000)
    named = spark.createDataFrame([(int(x),) for x in h[:10_000]], "h long")
    for bits, most in ((18, 0.05), (6, 1.0)):
        held = line_dedup._maybe(h, line_dedup._bit_table(named, bits), bits)
        assert held[:10_000].all() and held[10_000:].mean() <= most


def test_lines_beyond_what_is_broadcast(spark, docs, monkeypatch):
    """The same lines go, by a join that doesn't sort texts, and only the numbers of lines stay in the scratch folder."""
    want = sorted(map(tuple, line_dedup.dedup_lines(docs(one_passage())).collect()), key=repr)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    got = line_dedup.dedup_lines(docs(one_passage()))
    assert len(Scratch.opened[-1].written) == 1
    assert sorted(map(tuple, got.collect()), key=repr) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_parts_and_pairs_of_grams(spark):
    """Against brute force, with grams of one row to several parts over batches of any size, and rows that repeat; pairs come from the stream that reads the grams, so no join follows."""
    r, rows = random.Random(8), []
    for g, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 12, 13, 40, 1, 1, 200, 4, 2]):
        lines = [r.randrange(-(1 << 62), 1 << 62) for _ in range(n)]
        held = [(g - 5, h, r.randrange(60, 90) << 32 | r.randrange(0, 30)) for h in lines]
        rows += held + held[:2] + [(x, h, z + 1) for x, h, z in held[: n // 3]]
    df = spark.createDataFrame(rows, "gram long, h long, z long").repartition(3)
    by, want, several = {}, set(), set()
    for row in sorted(set(rows)):
        by.setdefault(row[0], []).append(row)
    may = lambda x, y: abs((x & 0xFFFF) - (y & 0xFFFF)) + abs((x >> 32) - (x & 0xFFFF) - (y >> 32) + (y & 0xFFFF)) <= int(max(x >> 32, y >> 32) * 0.2 + 1e-9)
    for held in by.values():
        several |= {(*row, i // 4) for i, row in enumerate(held) if len(held) > 4}
        want |= {(a[1], b[1]) for i, a in enumerate(held) for j, b in enumerate(held) if i < j and a[1] != b[1] and (i // 4 == j // 4 or i == 0) and may(a[2], b[2])}
    for size in (1, 3, 17, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            met = line_dedup.shared(df, 4)
            assert {tuple(x) for x in met.where("part >= 0").collect()} == several
            pairs = line_dedup.first_pairs(met)
            assert sorted(map(tuple, pairs.collect())) == sorted(want) and "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lines_are_those_of_the_rule():
    """Against plain Python: letters and other characters' bytes stay, ASCII digits are 0, all else parts words; equal lines alone have one hash, in whatever text."""
    r = random.Random(41)
    texts = ["".join(r.choice(" \t\r\x0b.,-  \nabZ09é漢🙂\u2028") for _ in range(r.choice([0, 1, 40, 300]))) for _ in range(200)]
    want = []
    for k, t in enumerate(texts):
        for at, line in enumerate(t.lower().split("\n")):
            unit = " ".join("".join("0" if c in "0123456789" else c if ord(c) > 127 or c.isalpha() else " " for c in line).split(" ")).split(" ")
            if unit := " ".join(w for w in unit if w):
                want.append((k, at, unit))
    x = line_dedup.Lines(texts, simhash=False)
    assert list(zip(x.text.tolist(), x.at.tolist(), [x.normalised(i).decode() for i in range(len(x.h))])) == want
    assert x.n.tolist() == [len(u) for _, _, u in want] and len(set(x.h.tolist())) == len(set(x.check.tolist())) == len({u for _, _, u in want})
    assert line_dedup.Lines([texts[3]], simhash=False).h.tolist() == x.h[x.text == 3].tolist()


def test_grams_are_shuffled_in_buckets(spark, docs):
    """The grams of many lines go to the shuffle as few rows, and come out of it as the parts and pairs of all of them."""
    rows = [(k, "\n".join(words(50 * k + i, 30) for i in range(50))) for k in range(40)]
    rows += [(100 + k, t) for k, t in rows[:20]] + [(200 + k, t.replace(" ", " x", 9)) for k, t in rows]
    counts = line_dedup.Lines([t for _, t in rows], simhash=False).seen().astype(np.float32)
    packed = line_dedup._gathered(docs(rows).coalesce(2), "text", counts)
    held = packed.collect()
    every = np.concatenate([np.frombuffer(x["rows"], np.int64).reshape(-1, 3) for x in held])
    assert len(every) > 20_000 and packed.columns == ["bucket", "rows"] and len({(int(g), x["bucket"]) for x in held for g in np.frombuffer(x["rows"], np.int64)[::3]}) == len(set(every[:, 0].tolist()))
    assert len(held) <= 3 * line_dedup._buckets(spark)
    plain = spark.createDataFrame([tuple(map(int, x)) for x in every], "gram long, h long, z long")
    want, got = (sorted(map(tuple, line_dedup.shared(x, 4).collect())) for x in (plain, packed))
    assert want == got
    assert len(got) > 300


def test_grams_of_more_rows_than_memory_holds(spark, monkeypatch):
    """Rows that go by way of files: ranges hold all of them once, in ascending order, and make the same parts and pairs."""
    r = np.random.default_rng(43)
    rows = np.stack([r.integers(0, 3, 5000), r.integers(-400, 400, 5000) * (1 << 52), r.integers(0, 9, 5000) | 60 << 32], 1)
    distinct = sorted(map(list, {tuple(x) for x in rows.tolist()}))
    ranges = [line_dedup._ordered(x, False).T for x in line_dedup._ranges(rows, 700)]
    assert len(ranges) > 4 and np.concatenate(ranges).tolist() == distinct
    df = spark.createDataFrame(rows.tolist(), "gram long, h long, z long").repartition(3)
    want = sorted(map(tuple, line_dedup.shared(df, 4).collect()))
    monkeypatch.setattr(line_dedup, "SORTED", 300)
    assert sorted(map(tuple, line_dedup.shared(df, 4).collect())) == want and [list(x[:3]) for x in want if x[3] >= 0] == distinct
