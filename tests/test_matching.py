import difflib
import random

import pytest
from pyspark.sql import functions as F

from policylake.operators import comparison, matching


def texts(n=300):
    rnd = random.Random(11)
    out = [("", ""), ("", "a"), ("a", ""), ("same text", "same text"), ("a" * 250, "a" * 250), ("ab" * 200, "ba" * 200), ("\U0001f600x", "x\U0001f600")]
    while len(out) < n:
        letters = rnd.choice(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n"])
        a = "".join(rnd.choice(letters) for _ in range(rnd.choice([1, 3, 8, 20, 60, 250, 400])))
        b = list(a)
        for _ in range(rnd.randrange(7)):
            p = rnd.randrange(len(b) + 1)
            if rnd.random() < 0.5:
                b[p:p] = [rnd.choice(letters) for _ in range(rnd.randrange(5))]
            else:
                del b[p : p + rnd.randrange(6)]
        out.append((a, "".join(b) if rnd.random() < 0.6 else "".join(rnd.choice(letters) for _ in range(rnd.choice([2, 10, 30, 300])))))
    return out


@pytest.fixture(scope="module")
def pairs(spark):
    rows = texts()
    return rows, spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "at long, old string, new string").repartition(4).cache()


def merged(blocks):
    out = []
    for i, j, n in blocks:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def test_blocks_are_those_of_the_definition(pairs):
    rows, df = pairs
    got = matching.matching_blocks(df.select("at", matching.characters("old").alias("old"), matching.characters("new").alias("new")), "at", "old", "new").collect()
    assert len(got) == len(rows)
    for r in got:
        want = [tuple(m) for m in difflib.SequenceMatcher(None, *rows[r["at"]]).get_matching_blocks()][:-1]
        assert merged((m.i, m.j, m.n) for m in r.blocks) == want


def test_similarity_and_changed_words(pairs):
    rows, df = pairs
    got = {r["at"]: r for r in matching.similarity(df, "at", "old", "new").collect()}
    for k, (a, b) in enumerate(rows):
        x, y = a.split(), b.split()
        changed = [" ".join(x[i:j] + y[p:q]) for tag, i, j, p, q in difflib.SequenceMatcher(None, x, y).get_opcodes() if tag != "equal"]
        assert got[k].ratio == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio()) and got[k].changed == changed


def test_bounds_spare_comparisons(pairs):
    rows, df = pairs
    got = matching.similarity(df, "at", "old", "new", at_least=0.6, words_from=0.9).collect()
    for r in got:
        want = difflib.SequenceMatcher(None, *rows[r["at"]])
        assert r.bound == pytest.approx(want.quick_ratio())
        assert r.ratio == (pytest.approx(want.ratio()) if r.bound >= 0.6 else None)
        assert r.changed == [] or r.ratio >= 0.9


def test_lines_and_snippets(spark):
    rows = [(1, "a\nb\nc", "a\nc\nd"), (2, None, "x"), (3, "same\n", "same"), (4, "x\r\ny", "x\ny"), (5, "l\n" * 3 + "z" * 2000, "q"), (6, None, None)]
    got = {r.k: r for r in matching.line_difference(spark.createDataFrame(rows, "k long, old string, new string"), "k", "old", "new").collect()}
    assert (got[1].removed, got[1].added, got[1].old, got[1].new) == (["b"], ["d"], "b", "d")
    assert (got[2].removed, got[2].added, got[2].old) == ([], ["x"], "")
    assert (got[3].removed, got[3].added, got[3].old) == ([], [], "same")
    assert got[4].removed == got[4].added == [] and got[6].removed == []
    assert len(got[5].old) == 1200 + len("... [truncated]") and got[5].old.startswith("l\nl\nl\nzz")


def test_noise_needs_likeness_and_no_digit(spark):
    rows = [(0.9, ["teh the"]), (0.9, ["5 6"]), (0.5, []), (None, []), (0.85, [])]
    got = [r.n for r in spark.createDataFrame(rows, "ratio double, changed array<string>").select(comparison.is_ocr_noise("ratio", "changed").alias("n")).collect()]
    assert got == [True, False, False, False, True]


def test_a_key_of_any_name(spark):
    df = spark.createDataFrame([("k", ["x", "y"], ["y"])], "a string, i array<string>, token array<string>")
    assert [(r.a, [tuple(m) for m in r.blocks]) for r in matching.matching_blocks(df.select(F.col("a").alias("runs"), "i", "token"), "runs", "i", "token").select(F.col("runs").alias("a"), "blocks").collect()] == [("k", [(1, 0, 1)])]
