"""The Jaccard join, line dedup and decontamination against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from policylake.llm import decontamination, line_dedup, ngram_join
from policylake.llm.components import Union, components
from tests.llm import brute


@pytest.mark.parametrize("size, num, block", [(4, 85, 10**6), (5, 80, 400)])
def test_components_of_documents(docs, rows, size, num, block):
    got = ngram_join.similar_components(docs, size=size, num=num, den=100, block_shingles=block).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.col("text").isNull().alias("none"), "n_shingles", "component_id").collect()
    import hashlib

    want = brute.jaccard_components(rows, size, num, 100)
    expected = sorted(((i, hashlib.sha256((t or "").encode()).hexdigest(), t is None, *want[k]) for k, (i, t) in enumerate(rows)), key=str)
    assert sorted(((r.doc_id, r.h, r.none, r.n_shingles, r.component_id) for r in got), key=str) == expected


def test_large_groups(spark):
    """Many near copies of one text: chains, blocks and tries, where some copies link only through others."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.jaccard_components(rows, 4, 85, 100)
    for block in (10**6, 1500):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(d, size=4, num=85, den=100, block_shingles=block).collect()}
        assert got == want


def test_trie_is_all_pairs():
    rnd = np.random.default_rng(1)
    for _ in range(20):
        pool = rnd.integers(0, 60, 400)
        sets = [np.unique(rnd.choice(pool, rnd.integers(3, 25))).astype(np.uint64) for _ in range(40)]
        union, plain = ngram_join.join_block(sets, list(range(40)), [], 6, 10), Union(40)
        for i in range(40):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 10 * o >= 6 * (len(sets[i]) + len(sets[j]) - o):
                    plain.join(i, j)
        assert [union.find(i) for i in range(40)] == [plain.find(i) for i in range(40)]


def test_join_edges(empty, spark):
    assert ngram_join.similar_components(empty).count() == 0
    with pytest.raises(ValueError):
        ngram_join.similar_components(empty.withColumn("n_shingles", F.lit(1)))


@pytest.mark.parametrize("small", [10**6, 0])
def test_components(spark, small):
    edges = [(i, i + 1) for i in range(100, 300)] + [(1, k) for k in range(2, 40)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6), small=small).collect()}
    assert got == {**{i: 100 for i in range(100, 301)}, **{i: 1 for i in range(1, 40)}}


def test_line_dedup(docs, rows):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "removed"]
    want = brute.line_dedup(rows, line_dedup.MIN_WORDS, line_dedup.DIVISOR, line_dedup.ROLL, line_dedup.LONG_LINE, line_dedup.SEED_WORDS)
    expected = sorted(((i, None if t is None else want[i, t]) for i, t in rows), key=str)
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == expected
    assert sum(a != b for a, b in zip(expected, sorted(rows, key=str))) > 5


def test_line_dedup_edges(empty, spark):
    assert line_dedup.dedup_lines(empty).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(empty.withColumnRenamed("lang", "removed"))
    odd = "A first line of words here. A second line.\x01 More of it.\nThird\x01 line. " * 3
    d = spark.createDataFrame([(1, odd), (2, odd)], "doc_id long, text string")
    assert [r.text for r in line_dedup.dedup_lines(d, min_words=1000).orderBy("doc_id").collect()] == [odd, odd]


def plain_words(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination(spark, docs, rows, monkeypatch):
    by_id = dict(rows)
    w = plain_words(by_id[406])
    items = [(1, " ".join(w[50:90])), (2, "two words"), (3, None), (4, "..."), (5, "not there at all in any text of these"), (6, by_id[300]), (None, "one")]
    table = spark.createDataFrame(items, "item_id long, text string")

    def expected(text):
        words, hit, found = plain_words(text), set(), set()
        for key, item in items:
            iw = plain_words(item)
            wins = {tuple(iw[k : k + 10]) for k in range(max(len(iw) - 9, 1))} if iw else set()
            for win in wins:
                for k in range(len(words) - len(win) + 1):
                    if tuple(words[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        found.add(str(key) if key is not None else None)
        return len(words), len(hit), sorted(x for x in found if x is not None)

    for few in (decontamination.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", few)
        got = decontamination.contamination(docs, table).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_words, r.n_hit, r["items"]) == expected(r.text)
            assert r.contaminated == (r.n_hit > 0)


def test_decontamination_edges(empty, spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs, none).where("contaminated").count() == 0
    assert decontamination.contamination(empty, none).count() == 0
    with pytest.raises(ValueError):
        decontamination.contamination(empty.withColumn("items", F.lit(1)), none)
