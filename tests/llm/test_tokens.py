"""Packing and segmentation: exact round trips, mixtures, and N-best lists against enumeration."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_words import words
from tokenizers import Tokenizer

from flatsieve.llm import packing, segmentation


@pytest.fixture(scope="module")
def lattice():
    return segmentation.Lattice(segmentation.model_file())


TEXTS = ["", "a", "Hello  world\n\n it's 12,345 done.\t x ", "  lead", "é漢🙂 ▁ok <|endoftext|>", "don't   stop\r\n\r\n  now", "x" * 500, words(1, 300), " nbsp em  ", "a\x00b"]


def test_ids_are_the_library_s():
    t = Tokenizer.from_file(packing.vocabulary())
    t.encode_special_tokens = True
    ids = packing.Ids(packing.vocabulary())
    for text in TEXTS:
        want = t.encode(text, add_special_tokens=False).ids
        for _ in range(2):  # from the encoder, then from the table
            assert np.frombuffer(ids.pack(text), ids.kind).tolist() == want, text


def holds(rows, texts, window):
    """Every id in one piece, no gaps in documents or sequences, all windows full but the last."""
    t = Tokenizer.from_file(packing.vocabulary())
    t.encode_special_tokens = True
    left = {}
    for i, text in texts:
        left.setdefault(i, []).append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(left)
    for i, docs in left.items():
        assert sum(r["length"] for r in pieces[i]) == sum(map(len, docs))
        if len(docs) == 1:
            for r in pieces[i]:
                own = np.array(docs[0][r["start"] : r["start"] + r["length"]], "<u4")
                assert r["doc_tokens"] == len(docs[0]) and r["ids_crc32"] == zlib.crc32(own.tobytes()) and r["length"] == len(own) > 0
            assert sorted(x for r in pieces[i] for x in range(r["start"], r["start"] + r["length"])) == list(range(len(docs[0])))
    for k, own in sequences.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == window or k == max(sequences) and at < window


def test_packing(docs, edges, none):
    texts = [(i, words(i, 20 + 13 * i % 400)) for i in range(120)]
    rows = packing.pack(docs(texts), packing.vocabulary(), window=256, packet=64).collect()
    holds(rows, texts, 256)
    total = sum(r["length"] for r in rows)
    for s in {r["source"] for r in rows}:
        share, sent = sum(r["length"] for r in rows if r["source"] == s) / total, 0
        for k in range(max(r["sequence_id"] for r in rows)):
            sent += sum(r["length"] for r in rows if r["source"] == s and r["sequence_id"] == k)
            assert abs(sent - share * 256 * (k + 1)) <= 64 * 4  # a packet for each source
    holds(packing.pack(edges, packing.vocabulary()).collect(), [(r["doc_id"], r["text"]) for r in edges.collect()], 2048)
    assert packing.pack(none, packing.vocabulary()).count() == 0


def test_packing_by_weights(docs):
    texts = [(i, words(i, 200)) for i in range(90)]
    rows = packing.pack(docs(texts), packing.vocabulary(), window=512, packet=64, weights={"s0": 6, "s1": 1, "s2": 1}, with_ids=True).collect()
    holds(rows, texts, 512)
    early = [r for r in rows if r["sequence_id"] < 8]
    assert sum(r["length"] for r in early if r["source"] == "s0") > 0.6 * sum(r["length"] for r in early)
    assert all(len(r["ids"]) == r["length"] for r in rows)


def listed(lattice, text):
    out = []

    def go(i, s, ids):
        if i == len(text):
            out.append((s, tuple(ids)))
            return
        hits = [(j, lattice.pieces[text[i:j]]) for j in range(i + 1, min(len(text), i + lattice.longest) + 1) if text[i:j] in lattice.pieces]
        for j, (k, x) in hits:
            go(j, s + x, [*ids, k])
        if not any(j == i + 1 for j, _ in hits):
            raw = [lattice.byte[b] for b in text[i].encode()]
            go(i + 1, s + lattice.byte_score * len(raw), ids + raw)

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the cat", "a  b", " x", "thé 漢", "\n\n a", "aaaa", "of an", "é"])
def test_n_best(lattice, text):
    want = listed(lattice, " " + text)
    for n in (1, 2, 5, 9):
        got = lattice.segment(text, n)
        assert len(got) == min(n, len(want))
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:n]])
        assert len({p for _, p in got}) == len(got) and all(lattice.decode(p) == text for _, p in got)
        known = {ids: s for s, ids in want}
        assert all(known[tuple(np.frombuffer(p, lattice.kind).tolist())] == pytest.approx(s) for s, p in got)


def test_units_are_the_whole(lattice):
    """Without units, the search over the whole text finds the same scores."""
    text = "then one of  the others"
    parts = lattice.segment(text, 6)
    whole = [s for s, _ in lattice.n_best(" " + text, 6)]
    assert [s for s, _ in parts] == pytest.approx(whole)


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(lattice, text):
    assert all(lattice.decode(p) == text for _, p in lattice.segment(text, 3))


def test_segments_of_tables(edges, none):
    file = public_tokenizers.path("piece_bpe_32k.model")
    out = segmentation.segment(edges, file, with_ids=True)
    rows = out.collect()
    texts = {r["doc_id"]: r["text"] or "" for r in edges.collect()}
    for r in rows:
        assert r["rank"] > 1 or r["decoded_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["n_pieces"] == len(r["ids"])
    assert sum(r["doc_id"] == 2 for r in rows) == 1 and sum(r["doc_id"] == 5 for r in rows) == 6
    back = segmentation.decode(out.where("rank = 2"), file)
    assert all(r["text"] == texts[r["doc_id"]] for r in back.collect())
    assert segmentation.segment(none, file).count() == 0
    bare = segmentation.segment(edges, file)
    assert sorted(map(tuple, bare.collect()), key=repr) == sorted((tuple(r)[:6] for r in rows), key=repr)


def test_added_tokens_as_by_default():
    t, ids = Tokenizer.from_file(packing.vocabulary()), packing.loaded(packing.vocabulary())
    for text in [*TEXTS, "a<|endoftext|>b", "a <|endoftext|> \n b<|endoftext|><|endoftext|>"]:
        assert np.frombuffer(ids.pack(text), ids.kind).tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert 50256 in np.frombuffer(ids.pack("a<|endoftext|>b"), ids.kind)
