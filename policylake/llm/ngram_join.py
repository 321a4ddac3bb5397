"""N-gram Jaccard join by prefix trees.

Shingle sets are put into one global order, rare shingles first. Two sets that are similar enough share a shingle among
their first few (their prefixes), so sets linked by shared prefix shingles form candidate groups. A task gets one group, or
two blocks of a large one, stores the sets of a block in a trie and sends every set down it: what the sets of a subtree
have in common is compared once, and a subtree is left as soon as the lengths that remain can't give enough overlap.

What the corpus decides: how common shingles are and which prefixes meet (a table sorted by shingle and size, over ranges, so
that a common shingle needs no task of its own). How common a shingle is, is what its words' counts let expect, or what its
bucket of a sketch holds, where that is clearly more than others do. Both tables have a fixed size; a sketch of shingles alone
tells none apart once a bucket holds hundreds, and prefixes then meet by chance. A parity bitmap refuses pairs that differ too
much: the bits in which two bitmaps differ are never more than the shingles in which the sets do. Two sets alone with a prefix
shingle are such a pair. Of more with one shingle the bitmaps are compared in one place, in blocks, once for all shingles that
the same sets share, and only stars of those that may be alike come out. What is asked for are the connected components of the
links, so no group is ever expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .components import Union, components
from .shingles import shingle_sets
from .tokenization import mix64, spans_of_rows, utf8_buffers

#: 2 to this power counters say how common shingles are, as many more how common words are; their size is fixed, so they can go
#: to all executors.
SKETCH_BITS = 18
#: A bucket of shingles says something if it is so many times further above the median than a sixth of all is below it.
HEAVY = 3
#: Shingles of a block; a task holds two blocks.
BLOCK_SHINGLES = 1_000_000
#: Bits of the filter that keeps texts out of the exchange which no group wants: half a megabyte on the executors.
FILTER_BITS = 1 << 22
#: Up to so many sets that share a prefix shingle are gathered before their group is named.
HELD = 10_000
#: Sets of a block of those.
BLOCK_SETS = 4_000
#: A component with more than one in so many of the rows doesn't go through a shuffle by its number.
HOT = 2_000
_BLOCK_BYTES = 500_000


def required(a: int, b: int, num: int, den: int) -> int:
    """Least overlap of sets of sizes a and b whose similarity is num/den or more: den * o >= num * (a + b - o)."""
    return -(-num * (a + b) // (den + num))


def prefix_length(n: int | np.ndarray, num: int, den: int):
    return n - -(-num * n // den) + 1


class Node:
    """A path of shingles that one or more sets have in common; ``sets`` end here."""

    __slots__ = ("path", "children", "sets", "least", "most", "leaf", "united")

    def __init__(self, path: np.ndarray):
        self.path, self.children, self.sets = path, [], []
        self.least = self.most = self.leaf = 0
        self.united = False


def build(sets: list[np.ndarray], places: list[int]) -> Node:
    """The trie of ``sets[place]``, each ascending in the global order."""
    order = sorted(places, key=lambda p: sets[p].astype(">u8").tobytes())
    root = Node(np.empty(0, np.uint64))

    def grow(node: Node, group: list[int], depth: int) -> None:
        while group and len(sets[group[0]]) == depth:
            node.sets.append(group.pop(0))
        i = 0
        while i < len(group):
            a = sets[group[i]]
            j = i + 1
            while j < len(group) and sets[group[j]][depth] == a[depth]:
                j += 1
            last = sets[group[j - 1]]  # first and last of a sorted run share what all of it shares
            n = min(len(a), len(last))
            unlike = np.flatnonzero(a[depth:n] != last[depth:n]) if j - i > 1 else ()
            end = depth + int(unlike[0]) if len(unlike) else (n if j - i > 1 else len(a))
            child = Node(a[depth:end])
            node.children.append(child)
            stack.append((child, group[i:j], end))
            i = j

    stack = [(root, order, 0)]
    made = []
    while stack:
        node, group, depth = stack.pop()
        made.append(node)
        grow(node, list(group), depth)
    for node in reversed(made):  # children come after their parents
        sizes = [len(sets[p]) for p in node.sets[:1]]
        node.least = min(sizes + [c.least for c in node.children], default=0)
        node.most = max(sizes + [c.most for c in node.children], default=0)
        node.leaf = node.sets[0] if node.sets else node.children[0].leaf if node.children else -1
    return root


def links_of(sets: list[np.ndarray], trie: Node, probes: list[int], num: int, den: int, union: Union) -> None:
    """Unite each probe with the sets of the trie it is similar to. Sets united with it already are passed over, as are
    subtrees all of whose sets are."""
    for probe in probes:
        mine = sets[probe]
        size = len(mine)
        shortest, longest = -(-num * size // den), den * size // num

        def settled(node: Node) -> bool:
            """All sets below are united, with each other."""
            if not node.united:
                if all(c.united for c in node.children):
                    root = union.find(node.leaf)
                    node.united = all(union.find(s) == root for s in node.sets) and all(union.find(c.leaf) == root for c in node.children)
            return node.united

        stack = [(trie, 0, 0, 0, False)]
        while stack:
            node, depth, overlap, place, done = stack.pop()
            if done:
                settled(node)
                continue
            if node.most < shortest or node.least > longest or node.leaf < 0:
                continue
            if node.united and union.find(node.leaf) == union.find(probe):
                continue
            path = node.path
            if len(path):
                at = np.searchsorted(mine, path)
                overlap += int(np.count_nonzero(mine[np.minimum(at, size - 1)] == path))
                place = int(at[-1])  # of mine, so many come before the path's last
                depth += len(path)
            need = required(size, max(node.least, shortest), num, den)
            if overlap + min(size - place, min(node.most, longest) - depth) < need:
                continue
            for other in node.sets:
                if other != probe and overlap >= required(size, len(sets[other]), num, den):
                    union.join(probe, other)
            stack.append((node, 0, 0, 0, True))
            for child in node.children:
                stack.append((child, depth, overlap, place, False))


def join_block(sets: list[np.ndarray], left: list[int], right: list[int], num: int, den: int) -> Union:
    """Components of the links within ``left`` (if ``right`` is empty), or between ``left`` and ``right``."""
    union = Union(len(sets))
    if right:
        links_of(sets, build(sets, left), right, num, den, union)
    else:
        links_of(sets, build(sets, left), left, num, den, union)
    return union


class Order:
    """The global order of shingles, rare ones first: quarter powers of two of how often one is expected, then the hash.

    ``shingles`` and ``words`` are the counts by bucket. Any order gives the same links; a good one gives few candidates."""

    def __init__(self, shingles: np.ndarray, words: np.ndarray):
        total = max(int(words.sum()), 1)
        self.total = int(4 * np.log2(total))
        self.costs = np.round(4 * np.log2(total / np.maximum(words, 1))).astype(np.int16)  # of a word: 0 if all words are it
        low, usual = np.quantile(some, [0.16, 0.5]) if len(some := shingles[shingles > 0]) else (0, 0)
        more = shingles - usual  # what a bucket holds besides shingles that meet in it by chance, if it is beyond their scatter
        self.heavy = np.where(more > HEAVY * (usual - low), 4 * np.log2(np.maximum(more, 0) + 1.0), -(1 << 14)).astype(np.int16)

    def rank(self, hashes: np.ndarray, costs: np.ndarray) -> np.ndarray:
        """Place in the global order. Equal shingles have equal places."""
        common = np.maximum(self.total - costs, self.heavy[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)])
        return np.clip(common + 2048, 0, 4095).astype(np.uint64) << np.uint64(52) | (mix64(hashes) >> np.uint64(12))


def _sketch(docs: DataFrame, text_col: str, size: int) -> Order:
    """Counts of shingles and of words, each in 2**SKETCH_BITS buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(1 << SKETCH_BITS, np.int64), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(0))
            for i, j in spans_of_rows(offsets, _BLOCK_BYTES):
                grams, _ = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size, seen=words)
                total += np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total + words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some]), pa.array(words[some])], names=["bucket", "n", "words"])

    counts = docs.select(text_col).mapInArrow(run, "bucket long, n long, words long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toPandas()  # at most 2**SKETCH_BITS rows
    tables = np.zeros((2, 1 << SKETCH_BITS), np.int64)
    tables[:, counts["bucket"].to_numpy(np.int64)] = counts["n"], counts["words"]
    return Order(*tables)


def _sets_of(batch_column: pa.Array, size: int, order: Order):
    """(first row, row behind, hashes, edges, ranks) of blocks of rows."""
    data, offsets = utf8_buffers(batch_column)
    for i, j in spans_of_rows(offsets, _BLOCK_BYTES):
        hashes, edges, costs = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size, order.costs)
        yield i, j, hashes, edges, order.rank(hashes, costs)


def _signatures(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, as signed; 0 for an empty one."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
        n = np.diff(edges)
        name = mix64((sums[edges[1:]] - sums[edges[:-1]]) + n.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    name[n == 0] = 0
    return name.view(np.int64)


def _bitmaps(hashes: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Parity bitmaps, as many bits as a set has shingles, up to a power of two: a bit is set if an odd number fall on it."""
    n = np.diff(edges)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(n)), n)
    at = base[row] + ((hashes >> np.uint64(7)).astype(np.int64) & (bits[row] - 1))
    packed = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist())]


def _difference(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the shorter's size."""
    if len(x) < len(y):
        x, y = y, x
    bits, a = 8 * len(x), int.from_bytes(x, "little")
    while bits > 8 * len(y):
        bits //= 2
        a = (a >> bits) ^ (a & ((1 << bits) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def _meet(num: int, den: int):
    """For a partition of (token, n, s), sorted: rows (a, b, kind), not more than rows that came in. Kind 0: sets a and b, the only
    ones of their group, are a pair to look at; 1: set a is a member of group b, whose bitmaps are compared together. Here n is
    twice the size, and one more where the token is late: of two alike sets the smaller has one that both share early.

    A group shares a token, and each size is near enough to the one before. It is named after its members, so that all tokens
    that the same sets share give one group; those that may go on in other partitions, and large ones, are named by the token."""

    def useful(t: np.ndarray, n: np.ndarray, whole: int) -> np.ndarray:
        """Early rows, and late ones behind an early one that isn't too small; all of the token ``whole``, of which more came before."""
        early = n % 2 == 0
        before = np.maximum.accumulate(np.where(early, np.arange(len(n)), 0))
        return early | (t == whole) | (early[before] & (t[before] == t) & (den * (n[before] // 2) >= num * (n // 2)))

    def groups(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray, out: list) -> None:
        """All of whose members are here."""
        pair, more = starts[sizes == 2], sizes > 2
        out.append(np.stack([s[pair], s[pair + 1], np.zeros(len(pair), np.int64)]))
        with np.errstate(over="ignore"):
            name = mix64(np.add.reduceat(mix64(s.view(np.uint64)), starts) + sizes.astype(np.uint64)).view(np.int64)
        member = s[np.repeat(more, sizes)]
        out.append(np.stack([member, np.repeat(name[more], sizes[more]), np.ones(len(member), np.int64)]))

    def members(token: int, s: np.ndarray, out: list) -> None:
        out.append(np.stack([s, np.full(len(s), token, np.int64), np.ones(len(s), np.int64)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        # The last group so far, which may go on; by_token: it is the first one, or a part of it went out already.
        t, n, s, by_token, whole = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), True, None

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if sum(e.shape[1] for e in out) >= least and out:
                rows = np.unique(np.concatenate(out, axis=1), axis=1)
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(e) for e in rows], names=["a", "b", "kind"])

        for batch in batches:
            if not len(batch):
                continue
            t, n, s = (np.append(x, batch.column(k).to_numpy()) for k, x in enumerate((t, n, s)))
            whole = int(t[0]) if whole is None else whole
            keep = useful(t, n, whole)
            t, n, s = t[keep], n[keep], s[keep]
            if not len(t):
                continue
            starts = np.append(0, np.flatnonzero((t[1:] != t[:-1]) | (den * (n[:-1] // 2) < num * (n[1:] // 2))) + 1)
            last = int(starts[-1])
            if last:
                first = int(starts[1]) if by_token else 0
                if by_token:
                    members(int(t[0]), s[:first], out)
                inner = starts[starts >= first]
                if len(inner) > 1:
                    groups(s[first:last], inner[:-1] - first, np.diff(inner), out)
                by_token = False
            t, n, s = t[last:], n[last:], s[last:]
            if len(s) > HELD:
                by_token, whole = True, int(t[0])
                members(whole, s[:-1], out)
                t, n, s = t[-1:], n[-1:], s[-1:]
            yield from flush(400_000)
        if len(s):
            members(int(t[0]), s, out)
            yield from flush(0)

    return run


def _folded(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def _stars(s: np.ndarray, n: np.ndarray, bits: list[bytes], left: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (a, b) of the components of sets whose sizes and bitmaps let them be alike. Compared are all sets, or those marked in
    ``left`` with the others, if both kinds are there."""
    order = np.argsort(n, kind="stable")
    s, n, left, bits = s[order], n[order], left[order], [bits[k] for k in order.tolist()]
    width = np.array([len(x) for x in bits]) // 8
    row, table = np.empty(len(s), np.int64), {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        row[at] = np.arange(len(at))
        table[w] = np.frombuffer(b"".join(bits[k] for k in at.tolist()), "<u8").reshape(len(at), w)
    both, open_ = bool(left.any() and not left.all()), np.ones(len(s), dtype=bool)
    high = np.searchsorted(n, den * n // num, side="right")  # the first that is too large for each
    low = np.searchsorted(n, -(-num * n // den), side="left")
    a, b = [], []
    for seed in range(len(s)):
        if not open_[seed]:
            continue
        open_[seed] = False
        stack = [seed]
        while stack:
            i = stack.pop()
            near = low[i] + np.flatnonzero(open_[low[i] : high[i]])
            if both:
                near = near[left[near] != left[i]]
            if not len(near):
                continue
            unlike, w = np.empty(len(near), np.int64), int(width[i])
            for v in np.unique(width[near]).tolist():  # the wider ones are folded
                at = np.flatnonzero(width[near] == v)
                mine, theirs = table[w][row[i]][None], table[v][row[near[at]]]
                while mine.shape[1] != theirs.shape[1]:
                    if mine.shape[1] > theirs.shape[1]:
                        mine = _folded(mine)
                    else:
                        theirs = _folded(theirs)
                unlike[at] = np.bitwise_count(mine ^ theirs).sum(axis=1, dtype=np.int64)
            total = n[near] + n[i]
            found = near[unlike <= total - 2 * -(-num * total // (den + num))]
            open_[found] = False
            stack += found.tolist()
            a.append(np.full(len(found), s[seed]))
            b.append(s[found])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def _group_edges(members: DataFrame, sketch: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) of sets that may be alike among the members (s, token) of each token; ``sketch`` has their sizes and bitmaps.

    A group is dealt into blocks, and a task gets a block or two of them."""
    sizes = members.groupBy("token").agg(F.ceil(F.count("*") / F.lit(float(BLOCK_SETS))).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1")
    block = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    dealt = members.join(sizes, "token").withColumn("block", block).select("s", "token", "block", tasks.alias("tasks")).join(sketch, "s")
    dealt = dealt.select("token", "s", "n", "bits", "block", F.explode_outer("tasks").alias("t")).select("token", "t.i", "t.j", "s", "n", "bits", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, done, n_done = None, [], [], 0

        def solve() -> None:
            s, n, block = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("s", "n", "block"))
            done.append(_stars(s, n, [x for r in rows for x in r.column("bits").to_pylist()], block == task[1], num, den))

        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(c).to_numpy() for c in ("token", "i", "j")]
            cut = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))).tolist() + [len(batch)]
            for a, b in zip(cut[:-1], cut[1:]):
                this = tuple(int(k[a]) for k in keys)
                if this != task:
                    if rows:
                        solve()
                        n_done += len(done[-1][0])
                    task, rows = this, []
                rows.append(batch.slice(a, b - a))
            if n_done > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[k] for d in done])) for k in (0, 1)], names=["a", "b"])
                done, n_done = [], 0
        if rows:
            solve()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[k] for d in done])) for k in (0, 1)], names=["a", "b"])

    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(compare, "a long, b long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100, block_shingles: int = BLOCK_SHINGLES, node_col: str | None = None) -> DataFrame:
    """All rows of ``docs`` with n_shingles and component_id, the smallest ``id_col`` that links reach.

    A text's set: its distinct shingles of ``size`` words (runs without ASCII white space, A-Z lower-cased), or the whole
    of a shorter text as one. Sets link when their Jaccard similarity is num/den or more. Null and empty texts, and those
    of white space alone, have empty sets, link with nothing and are their own component. A null id stays null; a
    component all of whose ids are null has a null component_id. Rows given again are in one component. Very long texts
    are taken whole. An empty table gives an empty table. Other columns stay, whatever their names: only n_shingles,
    component_id and ``node_col`` may not be among them. ``node_col`` names a column to add: a number for each component, also
    where it has no id; null for empty sets.
    """
    if clash := {"n_shingles", "component_id", node_col} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    spark = docs.sparkSession
    parts = [F.col(id_col).cast("string"), F.lit("|"), F.col(text_col)]
    # The row travels as one column, so that no name of its columns meets a name used here.
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("second"), *parts).alias("k2"))
    order = _sketch(docs, text_col, size)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashes, edges, ranks in _sets_of(batch.column("text"), size, order):
                n = np.diff(edges)
                ranks = ranks[np.lexsort((ranks, np.repeat(np.arange(j - i), n)))]
                keep = prefix_length(n, num, den) * (n > 0)
                within = np.arange(len(ranks)) - np.repeat(edges[:-1], n)
                first = ranks[within < np.repeat(keep, n)].view(np.int64)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)), pa.array(first))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), part.column("id"), pa.array(n.astype(np.int64)), pa.array(_signatures(hashes, edges)), prefix, pa.array(_bitmaps(hashes, edges), pa.binary())], names=kinds.names)

    kinds = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("id", keyed.schema["id"].dataType), *T.StructType.fromDDL("n long, s long, prefix array<long>, bits binary")])
    described = materialize(keyed.select("k1", "k2", "id", "text").mapInArrow(describe, kinds), "jaccard-sets")
    # One row per distinct set; equal sets are one node.
    nodes = described.where("n > 0").groupBy("s").agg(F.min("n").alias("n"), F.min(F.struct("k1", "k2")).alias("key"), F.first("prefix").alias("prefix"))
    late = F.expr(f"CAST(at > n - ({2 * num} * n + {den + num - 1}) DIV {den + num} AS LONG)")  # behind the prefix for sets as large or larger
    tokens = nodes.select("s", "n", F.posexplode_outer("prefix").alias("at", "token")).select("token", (2 * F.col("n") + late).alias("n"), "s")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = materialize(tokens.repartitionByRange(n_parts, "token", "n", "s").sortWithinPartitions("token", "n", "s").mapInArrow(_meet(num, den), "a long, b long, kind long"), "jaccard-meetings")
    pairs = met.where("kind = 0").select("a", "b").distinct()
    sketch = described.where("n > 0").groupBy("s").agg(F.min("n").alias("n"), F.min("bits").alias("bits"))
    left, right = sketch.select(F.col("s").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), sketch.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, xa, xb = (batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))
            keep = [_difference(x, y) <= m + n - 2 * required(m, n, num, den) for m, n, x, y in zip(na, nb, xa, xb)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    alike = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(look, "a long, b long")
    edges = alike.union(_group_edges(met.where("kind = 1").select(F.col("a").alias("s"), F.col("b").alias("token")).distinct(), sketch, num, den))
    groups = materialize(components(edges), "jaccard-groups")
    # Groups into blocks, block pairs into tasks.
    sizes = materialize(groups.join(described.where("n > 0").groupBy("s").agg(F.min("n").alias("n"), F.min(F.struct("k1", "k2")).alias("key")), F.col("node") == F.col("s")).select("node", "root", "n", "key.k1", "key.k2"), "jaccard-nodes")
    blocks = sizes.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(float(block_shingles))).cast("int").alias("blocks"))
    dealt = sizes.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    block = F.col("block")
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j")))
    wanted = dealt.select("k1", "k2", "node", "root", "block", tasks.alias("tasks"))

    def rank_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, edges, ranks in _sets_of(batch.column("text"), size, order):
                ranks = ranks[np.lexsort((ranks, np.repeat(np.arange(j - i), np.diff(edges))))]
                raw, at = ranks.astype("<u8").tobytes(), (edges * 8).tolist()
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("root"), part.column("block"), part.column("tasks"), pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["node", "root", "block", "tasks", "ranks"])

    wanted = materialize(wanted, "jaccard-wanted")
    filled = np.zeros(FILTER_BITS, dtype=bool)
    filled[wanted.select(F.pmod("k1", F.lit(FILTER_BITS)).alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)] = True  # at most FILTER_BITS numbers
    packed = np.packbits(filled).tobytes()

    def maybe_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[batch.column("k1").to_numpy() % FILTER_BITS]))

    kept = keyed.select("k1", "k2", "text").mapInArrow(maybe_wanted, "k1 long, k2 long, text string")
    texts = kept.join(wanted, ["k1", "k2"]).select("node", "root", "block", "tasks", "text")
    ranked = texts.mapInArrow(rank_rows, "node long, root long, block int, tasks array<struct<i:int,j:int>>, ranks binary")
    ranked = ranked.select("node", "root", "block", "ranks", F.explode_outer("tasks").alias("t")).select("root", "t.i", "t.j", "node", "block", "ranks")
    dealt_out = ranked.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(task: tuple, rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
            node = np.concatenate([r.column("node").to_numpy() for r in rows])
            block = np.concatenate([r.column("block").to_numpy() for r in rows])
            sets = [np.frombuffer(x.as_buffer(), "<u8") for r in rows for x in r.column("ranks")]
            node, once = np.unique(node, return_index=True)  # a row given again has its node again
            sets, block = [sets[k] for k in once.tolist()], block[once]
            _, i, j = task
            places = np.arange(len(node))
            union = join_block(sets, places[block == i].tolist(), places[block == j].tolist() if i != j else [], num, den)
            root = np.array([union.find(p) for p in range(len(node))], dtype=np.int64)
            apart = root != places
            return node[apart], node[root[apart]]

        task, rows, done = None, [], []
        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(c).to_numpy() for c in ("root", "i", "j")]
            cut = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))).tolist() + [len(batch)]
            for a, b in zip(cut[:-1], cut[1:]):
                this = tuple(int(k[a]) for k in keys)
                if this != task:
                    if rows:
                        done.append(solve(task, rows))
                    task, rows = this, []
                rows.append(batch.slice(a, b - a))
            if len(done) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[k] for d in done])) for k in (0, 1)], names=["a", "b"])
                done = []
        if rows:
            done.append(solve(task, rows))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[k] for d in done])) for k in (0, 1)], names=["a", "b"])

    links = materialize(dealt_out.mapInArrow(join, "a long, b long"), "jaccard-links")
    labels = components(links)
    # Back to rows: the smallest id of each component. A component with more than one in HOT of the rows is broadcast; there
    # are fewer than HOT of those. Their rows go by a number of their own, which spreads them, through the other join.
    named = described.select("k1", "k2", "id", "n", "s").distinct().join(labels, F.col("s") == F.col("node"), "left").select("k1", "k2", "id", "n", F.when(F.col("n") > 0, F.coalesce("root", "s")).alias("c"))
    named = materialize(named, "jaccard-named")
    least = materialize(named.where("c IS NOT NULL").groupBy("c").agg(F.min("id").alias("component_id"), F.count("*").alias("rows")), "jaccard-components")
    most = named.count() / HOT
    hot = F.broadcast(least.where(F.col("rows") > most).select(F.col("c").alias("hot_c"), F.col("component_id").alias("hot_id")))
    cold = least.where(F.col("rows") <= most).select(F.col("c").alias("cold_c"), F.col("component_id").alias("cold_id"))
    spread = F.when(F.col("hot_c").isNotNull() | F.col("c").isNull(), F.xxhash64(F.lit("spread"), "k1", "k2")).otherwise(F.col("c"))
    found = named.join(hot, F.col("c") == F.col("hot_c"), "left").withColumn("by", spread).join(cold, F.col("by") == F.col("cold_c"), "left")
    own = F.when(F.col("hot_c").isNotNull(), F.col("hot_id")).when(F.col("c").isNotNull(), F.col("cold_id")).otherwise(F.col("id"))
    found = found.select("k1", "k2", "n", "c", own.alias("component_id"))
    rows = keyed.select("row", "k1", "k2").join(found, ["k1", "k2"])
    return rows.select("row.*", F.col("n").alias("n_shingles"), "component_id", *([F.col("c").alias(node_col)] if node_col else []))
