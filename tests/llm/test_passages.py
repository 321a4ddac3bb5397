"""Repeated passages against a brute force over runs of lines and words, not over chunks."""

import random
import re

from policylake.llm import line_dedup
from tests.llm.conftest import make_rows, sentence

SCHEMA = "doc_id long, text string"


def bare_lines(text):
    return [x.replace("\n", "").rstrip(" ") for x in re.split(r"(?<=\n)|(?<=[.!?] )", text)]


def lines_gone(rows, least):
    """{(id, text): lines in runs of ``least`` words or more that also stand in an earlier document}, within one document left out."""
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    cut = [bare_lines(t) for _, t in docs]
    out = {}
    for n, mine in enumerate(cut):
        gone = set()
        for theirs in cut[:n]:
            if not set(mine) & set(theirs):
                continue
            above = {}
            for i, x in enumerate(mine):
                above = {j: above.get(j - 1, 0) + 1 for j, y in enumerate(theirs) if x == y}
                run = max(above.values(), default=0)
                if sum(y.count(" ") + 1 for y in mine[i - run + 1 : i + 1]) >= least:
                    gone |= set(range(i - run + 1, i + 1))
        out[docs[n]] = gone
    return out


def test_passages_are_runs(spark):
    """Short lines in foreign surroundings, passages that begin at any line, common lines first seen elsewhere."""
    rnd = random.Random(5)
    common = [sentence(rnd, 7) for _ in range(6)]
    passage = [sentence(rnd, rnd.randrange(4, 12)) for _ in range(40)]
    rows = [(600 + k, " ".join(sentence(rnd, 8) for _ in range(3)) + " " + line) for k, line in enumerate(common)]
    for k in range(60):
        a = rnd.randrange(36)
        part = passage[a : a + rnd.randrange(2, 9)]
        part.insert(rnd.randrange(len(part) + 1), rnd.choice(common))
        ends = [[sentence(rnd, rnd.randrange(1, 12)) for _ in range(rnd.randrange(4))] for _ in range(2)]
        rows.append((1000 + k, " ".join(ends[0] + part + ends[1])))
    rows += [r for r in make_rows(seed=3, n=20) if r[0] not in (1, 406)]
    got = line_dedup.dedup_passages(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = lines_gone(rows, line_dedup.MIN_WORDS)
    assert len(got) == len(rows)
    whole = {r.doc_id: r.removed for r in got}
    for i, t in rows:
        if i is not None:
            assert {x for r in whole[i] for x in range(r.first, r.last + 1)} == (want[i, t] if t is not None else set()), i
    texts = dict(rows)
    for r in got:
        if r.doc_id is not None and r.text is not None:
            gone = {x for p in r.removed for x in range(p.first, p.last + 1)}
            assert r.text == "".join(x for k, x in enumerate(re.split(r"(?<=\n)|(?<=[.!?] )", texts[r.doc_id])) if k not in gone)
    assert sum(map(len, whole.values())) > 20


def test_exact_copies_go_whole(spark):
    rnd = random.Random(7)
    text = " ".join(sentence(rnd, rnd.randrange(4, 12)) for _ in range(30))
    got = line_dedup.dedup_passages(spark.createDataFrame([(1, text), (2, text), (3, "New start. " + text), (3, "New start. " + text)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, text), (2, ""), (3, "New start. "), (3, "New start. ")]


def test_within_one_document(spark):
    rnd = random.Random(9)
    p = " ".join(sentence(rnd, 9) for _ in range(4))
    rows = [(1, f"Begin here. {p} And between. {p} The end."), (2, "One line of six words each. " * 20), (3, None), (4, ""), (5, "Short. " * 3)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == f"Begin here. {p} And between. The end."
    assert got[2].count("six") == 5
    assert (got[3], got[4], got[5]) == (None, "", "Short. " * 3)


def test_nothing(empty):
    assert line_dedup.dedup_passages(empty).count() == 0
