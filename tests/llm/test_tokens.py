"""Encoding, packing and token shards against the library itself."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from policylake.llm import packing, token_output, tokenization
from policylake.llm.queries import TOKENIZER
from policylake.llm.tokenization import Encoder, utf8_buffers


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENIZER)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_encoder_is_the_library(library):
    rnd = random.Random(4)
    alphabet = [*"ab'sS1.,! \n\t\r", " ", "　", "é", "×", "中", "😀", " 's", "'ll", "\x1c", "<|endoftext|>", "٣"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(5000)] + ["", None, " ", "  a", "a  "]
    ids, counts = Encoder(TOKENIZER, most_units=200).encode(*utf8_buffers(pa.array(texts)))
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [library(t) for t in texts]


def test_long_texts_are_cut_where_no_piece_spans(library, monkeypatch):
    monkeypatch.setattr(tokenization, "BLOCK_BYTES", 60)
    rnd = random.Random(6)
    pieces = ["word", " ", "  ", "\n", ", ", "it's", "12 ", "　", "中 文", "<|endoftext|>", "x" * 70, "é è"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(400))) for _ in range(60)] + ["", "y" * 500, None, "one"]
    ids, counts = Encoder(TOKENIZER).encode(*utf8_buffers(pa.array(texts)))
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [library(t) for t in texts]


def test_blocks_cut_as_the_whole():
    """Cuts settled block by block are those of one program over all places."""
    rnd = random.Random(8)
    for _ in range(40):
        places = [0]
        while len(places) < 300:
            places.append(places[-1] + rnd.randrange(1, 12))
        penalties = [0] + [rnd.choice((0, 2, 2, 2, 8)) for _ in places[1:]]
        cutter, found, at = packing.Cutter(40), [0], 1
        while at < len(places):
            n = rnd.randrange(1, 30)
            cutter.extend(places[at : at + n], penalties[at : at + n])
            some = cutter.settled(False)
            assert some[0] == found[-1]
            found, at = found + some[1:], at + n
        some = cutter.settled(True)
        assert some[0] == found[-1] and found + some[1:] == packing.cuts(places, penalties, 40)


def test_stores_by_their_names():
    assert token_output.open_store("file:///a/b")[1] == token_output.open_store("/a/b")[1] == token_output.open_store("file:/a/b")[1] == "/a/b"
    assert token_output.open_store("dbfs:/x/y")[1] == "/dbfs/x/y"
    with pytest.raises(ValueError):
        token_output.open_store("nosuch://a/b")


def test_cuts_are_the_best():
    """Against all ways to cut a small stream."""
    rnd = random.Random(2)
    for _ in range(60):
        places = sorted({0, 14, *(rnd.randrange(15) for _ in range(6)), 5, 10})
        penalties = [0] + [rnd.randrange(4) for _ in places[1:]]

        def cost(chosen, penalties=penalties, places=places):
            return sum(5 - (b - a) + penalties[places.index(b)] for a, b in zip(chosen[:-1], chosen[1:]))

        ways = [[0]]
        whole = []
        while ways:
            w = ways.pop()
            whole += [w] if w[-1] == 14 else []
            ways += [[*w, p] for p in places if 0 < p - w[-1] <= 5]
        found = packing.cuts(places, penalties, 5)
        assert found in whole and cost(found) == min(map(cost, whole))


@pytest.mark.parametrize("size", [16, 1024])
def test_packing(docs, rows, library, size):
    pieces = packing.pack(docs, TOKENIZER, size=size, block_bytes=2000).collect()
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append(p)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    # Each id of each document in exactly one piece: whole documents come back, repeated ones as often as given.
    want, got = Counter(), Counter()
    for i, t in rows:
        want[i, raw([*library(t), 0])] += 1
    for i, ps in by_doc.items():
        starts = defaultdict(list)
        for p in ps:
            starts[p.start, p.doc_tokens].append(bytes(p.ids))
        if len({p.doc_tokens for p in ps}) == 1 and sum(p.start == 0 for p in ps) == 1:
            got[i, b"".join(x for (_, _), xs in sorted(starts.items()) for x in xs)] += 1
    assert all(want[k] >= 1 for k in got) and len(got) > 40
    assert sum(p.length for p in pieces) == sum(len(k[1]) // 4 * n for k, n in want.items())
    used = [sum(n for _, n in s) for s in sequences.values()]
    padded = sum(size - u for u in used if u & (u - 1))
    assert size < 1000 or padded < 0.03 * sum(used)


def test_packing_edges(empty, spark):
    assert packing.pack(empty, TOKENIZER).count() == 0
    one = packing.pack(spark.createDataFrame([(None, None)], "doc_id long, text string"), TOKENIZER).collect()
    assert [(p.doc_id, p.start, p.length, p.doc_tokens, bytes(p.ids)) for p in one] == [(None, 0, 1, 1, raw([0]))]


def test_perfect_hash():
    rnd = np.random.default_rng(3)
    h1, h2 = rnd.integers(0, 1 << 63, 5000).astype(np.uint64), rnd.integers(0, 1 << 63, 5000).astype(np.uint64)
    made = token_output.PerfectHash.build(h1, h2)
    assert sorted(made.slots(h1, h2)) == list(range(5000)) and len(made) == 5000
    with pytest.raises(ValueError):
        token_output.PerfectHash.build(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))
    assert len(token_output.PerfectHash.build(h1[:0], h2[:0])) == 0


def test_token_store(docs, rows, library, spark):
    store = token_output.write_tokens(docs, TOKENIZER, shards=3, keys_per_bucket=20, block_bytes=3000)
    got = store.read(docs).collect()
    assert len(got) == len(rows)
    want = Counter((i, raw([*library(t), 2])) for i, t in rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and 4 * r.n_tokens == len(r.ids)
        at += r.n_tokens
    keys = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    asked = spark.createDataFrame([(403,), (403,), (987654,)], "doc_id long")
    assert [(r.doc_id, zlib.crc32(bytes(r.ids))) for r in store.read(asked).collect()] == [(403, zlib.crc32(raw([*library("one"), 2])))]


def test_token_store_empty(empty):
    store = token_output.write_tokens(empty, TOKENIZER, shards=2)
    assert store.read(empty).count() == 0


def test_keys_of_other_types(spark, library):
    d = spark.createDataFrame([("b", "x", 1), ("a", "y", 2)], "name string, body string, start int")
    got = token_output.write_tokens(d, TOKENIZER, id_col="name", text_col="body").read(d).orderBy("start").collect()
    assert [(r.name, r.start, r.n_tokens) for r in got] == [("a", 0, 2), ("b", 2, 2)]
    assert d.select(F.col("start")).count() == 2
