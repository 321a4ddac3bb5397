"""One row of each group of near duplicates, counted as rows and not as a set."""

import random
from collections import Counter

import corpus_pipeline
from policylake.llm import ngram_join
from tests.llm import brute
from tests.llm.conftest import SCHEMA, text


def test_one_row_of_each_group(spark):
    rnd = random.Random(11)
    a, b, c, d, e = (text(rnd, 20) for _ in range(5))
    rows = [(3, a), (3, a), (4, a + " more"), (5, b), (5, b + " more"), (None, b), (None, c), (None, c), (None, c + " more"), (None, d), (6, e), (7, ""), (7, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    groups = [{(3, a)}, {(5, b), (5, b + " more")}, {(None, c), (None, c + " more")}, {(None, d)}, {(6, e)}]
    assert [sum(got[r] for r in g) for g in groups] == [1] * 5
    assert got[7, ""] == 2 and got[None, None] == 1 and got.total() == 8


def test_components_that_hold_most_rows(spark, monkeypatch):
    """The broadcast of large components and the shuffle of the others give what brute force does."""
    monkeypatch.setattr(ngram_join, "HOT", 4)
    rows = [(i, " ".join(f"w{k}" for k in range(40)) + f" end{i % 7}") for i in range(40)] + [(100 + i, f"other text number {i} of its own, {i} and {i * 7}") for i in range(20)] + [(None, "w1"), (200, None)]
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), size=4, num=85, den=100).collect()
    want = brute.jaccard_components(rows, 4, 85, 100)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(rows[i][0]), n, str(c)) for i, (n, c) in want.items())
