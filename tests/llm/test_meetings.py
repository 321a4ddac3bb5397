"""What sets that share prefix shingles give: not more rows than shingles, and no pair of alike sets is missing."""

import random

import pyarrow as pa
import pytest

from policylake.llm import ngram_join


def meet(rows, size, num=85):
    """Rows (a, b, kind) of one partition, in batches of ``size``."""
    batches = [pa.RecordBatch.from_pydict(dict(zip(("token", "n", "s"), zip(*rows[i : i + size])))) for i in range(0, len(rows), size)]
    return [tuple(r.values()) for b in ngram_join._meet(num, 100)(iter(batches)) for r in b.to_pylist()]


def test_rows_grow_with_the_members():
    for m in (3, 16, 32):
        got = meet([(t, 400, s) for t in range(10) for s in range(m)], 50)
        assert len(got) <= 10 * m  # in pairs, 32 sets gave 496 rows
        assert len({b for _, b, _ in got}) == 3 and {kind for *_, kind in got} == {1}  # the first, the last, and one for all others
        assert all({a for a, b, _ in got if b == group} == set(range(m)) for _, group, _ in got)


def test_late_shingles_and_other_sizes_are_no_candidates():
    ends = [(0, 400, 1), (9, 400, 1)]  # first and last groups are kept, as they may go on elsewhere
    inner = [(1, 401, 1), (1, 401, 2), (1, 401, 3), (2, 200, 1), (2, 400, 2), (3, 400, 4), (3, 401, 5)]
    assert sorted(meet([ends[0], *inner, ends[1]], 100)) == [(1, 0, 1), (1, 9, 1), (4, 5, 0)]


@pytest.mark.parametrize("num", [85, 80, 50])
def test_alike_sets_meet(num, monkeypatch):
    """Wherever partitions and batches end, and whether groups are gathered or not."""
    rnd = random.Random(num)
    base = [rnd.sample(range(3000), rnd.choice((1, 2, 7, 30, 60))) for _ in range(12)]
    sets = sorted({tuple(sorted(set(rnd.sample(b, rnd.randrange(max(1, len(b) * 3 // 4), len(b) + 1)) + rnd.sample(range(3000), rnd.randrange(3))))) for b in base for _ in range(12)})
    rows = []
    for s, x in enumerate(sets):
        n = len(x)
        rows += [(t, 2 * n + (at > n - ngram_join.required(n, n, num, 100)), s) for at, t in enumerate(x[: ngram_join.prefix_length(n, num, 100)])]
    rows.sort()
    overlaps = {(i, j): len(set(sets[i]) & set(sets[j])) for j in range(len(sets)) for i in range(j)}
    alike = {p for p, o in overlaps.items() if 100 * o >= num * (len(sets[p[0]]) + len(sets[p[1]]) - o)}
    assert len(alike) > 50
    for held in (3, 10_000):
        monkeypatch.setattr(ngram_join, "HELD", held)
        for part in (len(rows), 97, 10):
            for size in (1, 4, 50):
                pairs, groups = set(), {}
                for k in range(0, len(rows), part):
                    for a, b, kind in meet(rows[k : k + part], size, num):
                        pairs.add((min(a, b), max(a, b))) if kind == 0 else groups.setdefault(b, set()).add(a)
                assert not [p for p in alike if p not in pairs and not any(p[0] in g and p[1] in g for g in groups.values())]
