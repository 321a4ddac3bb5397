"""Sets that share a shingle by chance, also one that very many share, are no candidates; those that are alike stay together."""

import random

import numpy as np
import pyarrow as pa

from policylake.llm import ngram_join
from policylake.llm.components import Union
from policylake.llm.shingles import shingle_sets, word_buckets
from policylake.llm.tokenization import utf8_buffers
from tests.llm import brute


def test_stars_are_the_components_of_all_pairs():
    rnd = np.random.default_rng(5)
    for num, left in ((85, False), (80, True), (40, True)):
        base = [rnd.integers(0, 1 << 60, size=k, dtype=np.uint64) for k in (3, 50, 60, 64, 66, 130, 250, 300)]
        sets = [np.unique(np.concatenate([b[rnd.random(len(b)) > 0.03], rnd.integers(0, 1 << 60, size=rnd.integers(1, 4), dtype=np.uint64)])) for b in base for _ in range(12)]
        bits = ngram_join._bitmaps(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
        n, s = np.array([len(x) for x in sets]), rnd.permutation(len(sets)) + 100
        side = rnd.random(len(sets)) < 0.5 if left else np.ones(len(sets), dtype=bool)
        want, got = Union(len(sets)), Union(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if (not left or side[i] != side[j]) and 100 * min(n[i], n[j]) >= num * max(n[i], n[j]) and ngram_join._difference(bits[i], bits[j]) <= n[i] + n[j] - 2 * ngram_join.required(int(n[i]), int(n[j]), num, 100):
                    want.join(i, j)
        place = {int(x): k for k, x in enumerate(s)}
        a, b = ngram_join._stars(s, n, bits, side, num, 100)
        for x, y in zip(a.tolist(), b.tolist()):
            got.join(place[x], place[y])
        assert [want.find(i) for i in range(len(sets))] == [got.find(i) for i in range(len(sets))] and len(a) < len(sets)


def test_a_shared_shingle_makes_no_group(spark, monkeypatch):
    """An order that tells nothing apart lets prefixes meet by chance: 120 unlike texts with one passage, and copies of some."""
    rnd = random.Random(2)
    flat = np.zeros(1 << ngram_join.SKETCH_BITS, np.int64)
    monkeypatch.setattr(ngram_join, "_sketch", lambda *_: ngram_join.Order(flat, flat))
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 50)
    kept = {}
    monkeypatch.setattr(ngram_join, "materialize", lambda df, tag, f=ngram_join.materialize: kept.setdefault(tag, f(df, tag)))
    passage = " ".join(f"w{k}" for k in range(30))
    texts = [passage + " " + " ".join(f"x{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30, 36))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[i] + " end") for i in range(0, 120, 10)]
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=4, num=85, den=100).collect()
    want = brute.jaccard_components(rows, 4, 85, 100)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((rows[i][0], n, c) for i, (n, c) in want.items())
    assert kept["jaccard-groups"].groupBy("root").count().where("count > 2").count() == 0  # chained, all 132 were one group


def test_rare_words_come_first_where_all_buckets_are_full():
    words = np.full(1 << ngram_join.SKETCH_BITS, 3, np.int64)
    data, offsets = utf8_buffers(pa.array(["the of and to seldom rarely hardly ever"]))
    grams, _ = shingle_sets(data, offsets, 1)
    common, _, costs = shingle_sets(*utf8_buffers(pa.array(["the of and to"])), 4, np.zeros_like(words))
    seen = np.zeros_like(words)
    shingle_sets(*utf8_buffers(pa.array(["the of and to"] * 1000)), 4, None, seen)
    assert seen.sum() == 4000 and np.count_nonzero(seen) == 4 and len(word_buckets(grams, 18)) == 8
    order = ngram_join.Order(np.full(1 << ngram_join.SKETCH_BITS, 5000, np.int64), words + seen)
    hashes, _, costs = shingle_sets(data, offsets, 4, order.costs)
    ranks = order.rank(hashes, costs)
    assert hashes[np.argmax(ranks)] == common[0] and len(hashes) == 5
    assert len(shingle_sets(*utf8_buffers(pa.array([""])), 4, order.costs)) == 3
