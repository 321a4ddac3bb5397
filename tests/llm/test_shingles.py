"""Shingles of blocks that hold fewer words than a shingle has."""

import numpy as np
import pytest

from policylake.llm import ngram_join
from policylake.llm.shingles import shingle_sets


@pytest.mark.parametrize("size", [4, 5])
@pytest.mark.parametrize("n", range(7))
@pytest.mark.parametrize("around", [0, 2])
def test_few_words(size, n, around):
    texts = [b""] * around + [b" ".join(b"w%d" % k for k in range(n))] + [b" "] * around
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    grams, edges = shingle_sets(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets, size)
    want = [0] * around + [0 if n == 0 else max(n - size + 1, 1)] + [0] * around
    assert list(np.diff(edges)) == want and len(grams) == sum(want)


@pytest.mark.parametrize("size", [4, 5])
def test_alone_in_a_table(spark, size):
    """Two and three words, alone in their partitions; the copies are found."""
    rows = [(1, "two words"), (2, "Two  words"), (3, "now three words")]
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    got = ngram_join.similar_components(d, size=size, num=80, den=100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 1, 3)]
