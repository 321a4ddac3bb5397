import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from policylake.llm import backoff, conversations, crc_resampling, prefix_sums

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TURNS = "conv_id long, turn long, role string, text string, depth long, p1 string, at long"


def by_hand(rows):
    """{(conv_id, depth): the rest of the node's row} by dictionaries of whole beginnings."""
    own, out, kids = {}, {}, {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole, nodes = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(whole[c]) + 1):
            nodes.setdefault(tuple(whole[c][:d]), []).append(c)
    for n in sorted(nodes, key=len, reverse=True):
        if n:
            kids.setdefault(n[:-1], []).append(n)
        below = kids.get(n, [])
        saved = (len(nodes[n]) - 1) * len(n[-1][1]) if n else 0
        key = lambda x: (min(nodes[x]), len(x))
        ends = ",".join(map(str, sorted(c for c in nodes[n] if len(whole[c]) == len(n))))
        leaves = sum(out[key(x)][3] for x in below) or 1
        out[key(n)] = (min(nodes[n[:-1]]) if n else None, len(nodes[n]), len(below), leaves, saved + sum(out[key(x)][4] for x in below), hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie(df):
    return conversations.prefix_trie(*conversations.rebuilt(conversations.numbered_turns(df)))


@pytest.fixture(scope="module")
def turns():
    rnd = random.Random(5)
    rows = []
    for c in [*range(40), *range(100, 130), 205, 207, 399, -3, -101, 10**12]:
        shared = rnd.choice(["a", "b", "longer text 😀"])
        rows += [(c, t, rnd.choice(["user", None, ""]), shared if t < 3 else rnd.choice(["x", "y", None])) for t in range(rnd.randrange(0, 9))]
    rows += [(c, t, "user", f"copy {t}") for c in (150, 151, 152, 153) for t in range(30)]
    rows += [(None, 1, "user", "no one's"), (7, None, "system", "first"), (7, None, "system", "first"), (205, 3, "user", "once more")]
    rnd.shuffle(rows)
    return [(*r, 5, "clash", 9) for r in dict.fromkeys(rows)] + [(7, None, "system", "first", 5, "clash", 9)]


def test_trie_against_dictionaries(spark, turns):
    got = trie(spark.createDataFrame(turns, TURNS).repartition(6)).collect()
    keyed = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(keyed) == len(got) and keyed == by_hand([r[:4] for r in turns])


def test_intervals_hold_subtrees(spark, turns):
    got = trie(spark.createDataFrame(turns, TURNS)).collect()
    assert sorted(r.preorder for r in got) == list(range(len(got)))
    at = {(r.conv_id, r.depth): r for r in got}
    inside = lambda a, b: a.preorder <= b.preorder <= a.end
    for r in got:
        if r.depth:
            assert inside(at[r.parent_conv_id, r.depth - 1], r)
        assert r.n_leaves == sum(x.n_children == 0 for x in got if inside(r, x))


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie(empty).collect() == []
    assert trie(spark.createDataFrame([(None, 1, "user", "x", 1, "", 1)], TURNS)).collect() == []
    one = trie(spark.createDataFrame([(5, 1, "user", "x", 1, "", 1)], TURNS)).collect()  # its first turns are those of 0, which isn't there
    assert by_hand([(5, 1, "user", "x")]) == {(r.conv_id, r.depth): tuple(r)[2:8] for r in one}


def test_running_splits_a_segment(spark):
    rows = [(k, i, (i * 7919) % 1000 - 300) for k, n in ((1, 500), (2, 3), (9, 2000)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    got = {(r.k, r.i): (r.at, r.sum_v, r.xor_v) for r in prefix_sums.running(df, [F.col("k"), F.col("i")], "t", "k", ("v",), ("v",)).collect()}
    sums, xors = Counter(), Counter()
    for k, i, v in rows:
        sums[k], xors[k] = sums[k] + v, xors[k] ^ v
        assert got[k, i] == (i + 1, sums[k], xors[k])
    alone = prefix_sums.running(df, [F.col("v").desc(), F.col("k"), F.col("i")], "t").orderBy("at").collect()
    assert [(r.v, r.k, r.i) for r in alone] == [(v, k, i) for k, i, v in sorted(rows, key=lambda r: (-r[2], r[0], r[1]))]


def features(text, most):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW).encode())
    return words, [zlib.crc32(b" ".join(words[i : i + k])) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("most", [1, 4])
def test_crcs_are_composed(most):
    texts = ["", "one", "Two WORDS", "Ünï cödé 中文字 x9", "a " * 300, "w" * 5000 + " tail " + "é" * 100, "...", "mixed-up words, again and again"]
    raw = [t.encode() for t in texts]
    low = crc_resampling._LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    crcs, of, words = crc_resampling.feature_crcs(low, np.concatenate([[0], np.cumsum([len(r) for r in raw])]), most)
    for i, t in enumerate(texts):
        want = features(t, most)
        assert words[i] == len(want[0]) and Counter(crcs[of == i].tolist()) == Counter(want[1])


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_by_hand(spark, docs, rows, most):
    target = spark.createDataFrame([("Then edges of the hand",), (None,), ("",), (rows[0][1],)], "text string")
    got = crc_resampling.resample(docs.withColumnsRenamed({"lang": "score", "source": "rank"}), target, most=most, buckets=97, least_words=3, share=30).collect()
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(c % 97 for c in features(text, most)[1])
    for r in target.collect():
        t.update(c % 97 for c in features(r.text, most)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 97) / ((s[b] + 1) * (t.total() + 97)))) for b in range(97)]
    want, enough = [], []
    for key, text in rows:
        words, found = features(text, most)
        weight = sum(gain[c % 97] for c in found)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        want.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
        if len(words) >= 3:
            enough.append(want[-1])
    enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = [(*r, i + 1) for i, r in enumerate(enough[: len(enough) * 30 // 100])]
    assert sorted(map(str, [tuple(r) for r in got if r["rank"]])) == sorted(map(str, drawn))
    assert Counter(tuple(r)[:4] for r in got) == Counter(want)


def test_resampling_of_nothing(spark, docs, empty):
    assert crc_resampling.resample(empty, empty).collect() == []
    assert {r.weight for r in crc_resampling.resample(empty.unionAll(docs.where("text = ''")), empty).collect()} == {0}


def model_by_hand(rows, learned, strengths):
    """Log10 probabilities of texts, token by token, from the counts of whole n-grams."""
    tokens = lambda t: ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), "</s>"]
    order = len(strengths) + 1
    c, texts = Counter(), 0
    for key, text in rows:
        if learned(key):
            w, texts = tokens(text), texts + 1
            c.update(tuple(w[i - k + 1 : i + 1]) for k in range(1, order + 1) for i in range(max(1, k - 1), len(w)))
    singles = {g: n for g, n in c.items() if len(g) == 1}
    n = sum(singles.values())

    def p(context, word):
        if not context:
            return (c[(word,)] + 1) / (n + len(singles) + 1)
        seen, less = texts if context == ("<s>",) else c[context], p(context[1:], word)
        b = strengths[len(context) - 1]
        return (c[(*context, word)] + b * less) / (seen + b) if seen else less

    def score(text, order=order):
        w = tokens(text)
        return sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w)))

    return tokens, singles, n, p, score


@pytest.mark.parametrize("strengths", [(4.0, 2.0), (30.0,), ()])
def test_scores_by_hand(spark, docs, rows, strengths):
    learned = lambda key: zlib.crc32(str("" if key is None else key).encode()) % 7 != 2
    tokens, singles, n, p, score = model_by_hand(rows, learned, strengths)
    got = backoff.score_texts(docs.withColumnRenamed("lang", "score"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2, order=len(strengths) + 1, strengths=strengths).collect()
    want = [((key, learned(key), len(tokens(text)) - 1, sum((x,) in singles for x in tokens(text)[1:]), n), score(text, 1), score(text)) for key, text in rows]
    place = lambda r: (str(r[0]), round(r[1], 6))
    for g, w in zip(sorted([((tuple(r)[:5]), r.base_score, r.score) for r in got], key=place), sorted(want, key=place), strict=True):
        assert g[0] == w[0] and g[1:] == pytest.approx(w[1:], abs=1e-7)
    for context in [("<s>",), ("thin",), ("thin", "erin")][: len(strengths)]:
        assert sum(p(context, g[0]) for g in singles) + p(context, "no such word") == pytest.approx(1)


def test_scores_of_small_blocks_are_the_same(spark, docs, monkeypatch):
    train = F.col("doc_id") % 3 != 0
    key = lambda r: (str(r[:5]), round(r[5], 6))
    run = lambda: sorted((tuple(r) for r in backoff.score_texts(docs, train, strengths=(4.0, 2.0)).collect()), key=key)
    one = run()
    monkeypatch.setattr(backoff, "RANGE_TOKENS", 50)
    many = run()
    assert [r[:5] for r in one] == [r[:5] for r in many] and all(a[6] == pytest.approx(b[6]) for a, b in zip(one, many))


def test_scores_without_training(spark, docs, empty):
    assert backoff.score_texts(empty, F.lit(True)).collect() == []
    assert {r.base_score for r in backoff.score_texts(docs, F.lit(False)).collect()} == {0.0}


def test_planes():
    x = np.array([0, 1, 255, 256, 2**40, 2**64 - 1], np.uint64)
    assert (backoff.unpacked(backoff.packed(x), np.uint64) == x).all() and (backoff._sums(backoff._steps(x)) == x).all()
