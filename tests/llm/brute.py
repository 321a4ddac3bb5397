"""Brute-force versions of operators, in plain Python, for small fixtures."""

from __future__ import annotations

import re
from collections import defaultdict

import xxhash

MASK = (1 << 64) - 1


def _xx(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, seed=42)


def line_dedup(rows: list[tuple], min_words: int, divisor: int, roll: int, long_line: int, seed_words: int) -> dict:
    """{(id, text): text without repeated passages} for rows of (id, text)."""
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    words = lambda line: line.count(" ") + 1
    bare = lambda line: line.replace("\n", "").rstrip(" ")
    lines_of, chunks_of, seen = [], [], defaultdict(list)
    for n, doc in enumerate(docs):
        lines = re.split(r"(?<=\n)|(?<=[.!?] )", doc[1])
        clean = [bare(x) for x in lines]
        hashes = [_xx(x.encode()) for x in clean]
        ends = []
        for i in range(len(lines)):
            r = 0
            for k in range(min(roll, i + 1)):
                r ^= hashes[i - k] << k & MASK
            if i == len(lines) - 1 or words(clean[i]) >= long_line or words(clean[i + 1]) >= long_line or (_signed(r) >> 7) % divisor == 0:
                ends.append(i)
        lines_of.append((lines, clean))
        chunks_of.append(list(zip([0] + [e + 1 for e in ends[:-1]], ends)))
        for k, (a, b) in enumerate(chunks_of[n]):
            if (b > a or words(clean[a]) >= long_line) and sum(map(words, clean[a : b + 1])) >= seed_words:
                seen[tuple(clean[a : b + 1])].append((n, k))
    gone = defaultdict(set)
    found = {place: min(places) for places in seen.values() if len(places) > 1 for place in places}

    def part(n: int, k: int) -> list:
        return lines_of[n][1][chunks_of[n][k][0] : chunks_of[n][k][1] + 1] if 0 <= k < len(chunks_of[n]) else []

    for (n, k), (n0, k0) in found.items():
        if (n, k) == (n0, k0):
            continue
        up, down, size = 0, 0, sum(map(words, part(n, k)))
        for step in (-1, 1):
            if found.get((n, k + step)) == (n0, k0 + step):
                size += sum(map(words, part(n, k + step)))
                continue
            mine = part(n, k + step)[::step]
            same = _same(mine, part(n0, k0 + step)[::step])
            size += sum(map(words, mine[:same]))
            up, down = (same, down) if step < 0 else (up, same)
        if size >= min_words:
            a, b = chunks_of[n][k]
            gone[n] |= set(range(a - up, b + down + 1))
    return {doc: "".join(x for i, x in enumerate(lines_of[n][0]) if i not in gone[n]) for n, doc in enumerate(docs)}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _same(a: list, b: list) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def jaccard_components(rows: list[tuple], size: int, num: int, den: int) -> dict:
    """{row's place: (n_shingles, smallest id of its component)} for rows of (id, text)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    with_shingle = defaultdict(list)
    up = list(range(len(rows)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in with_shingle[x]:
                shared[j] += 1
            with_shingle[x].append(i)
        for j, n in shared.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                up[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        root = find(i)
        least[root] = min((k for k in (least.get(root), key) if k is not None), default=None)
    return {i: (len(sets[i]), least[find(i)]) for i in range(len(rows))}
