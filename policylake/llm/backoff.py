"""Log-probabilities of texts by a weighted backoff automaton over words.

The n-grams of the training texts are states and arcs: from the state of a context an arc leads on for every word that has
followed it, and a failure arc leads to the context without its first word. With counts c and a strength b for each order, an arc
has the weight log((c(context word) + b P(word | shorter context)) / (c(context) + b)) and the failure arc log(b / (c(context) +
b)); the root has an arc for every word, log((c + 1) / (N + V + 1)), and one for unknown words. Over all words and the unknown
one, the probabilities from each state sum to 1. A text is walked once, from left to right, its end included.

The n-grams of a corpus fit no task. Texts are cut into blocks of about BLOCK_TOKENS tokens; a block sends its distinct n-grams,
sorted, to ranges of their hashes; a range sums up the training counts and answers each block in the order that it asked; a block
with its answers is the part of the automaton that its texts can reach, and walks them. All n-grams are counted, none is pruned.

Words are known by 64-bit hashes, longer n-grams by 56 bits, which are what moves: among 10**10 distinct n-grams about 700 pairs
are expected to share theirs and so their counts, among 10**9 distinct words none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .tokenization import _SPACE, mix64, span_hashes, spans_of_rows, utf8_buffers

#: Tokens of a block, about: what a task holds at a time.
BLOCK_TOKENS = 1_000_000
#: Tokens whose n-grams of one order a range sums up, about.
RANGE_TOKENS = 2_000_000
#: Strengths of the orders 2, 3, ...
STRENGTHS = (4000.0, 8.0)

#: Bits of the hashes of single words, and of longer n-grams.
WORD_BITS, GRAM_BITS = 64, 56

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M = np.uint64(0xC2B2AE3D27D4EB4F)
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PLANES = pa.binary()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the number of words of each text."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    low = _LOWER[data]
    word = ~_SPACE[low]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    ends[:-1] &= ~word[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return span_hashes(low, starts, np.flatnonzero(ends) + 1), np.diff(np.searchsorted(starts, offsets))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes: what high bytes have in common, and small counts, take next to nothing."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def unpacked(raw: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def _steps(ascending: np.ndarray) -> bytes:
    return packed(np.diff(ascending, prepend=np.uint64(0)))


def _sums(raw: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


class Grams:
    """The n-grams of a block's texts: of each order the distinct hashes, ascending, and which of them ends at each place.

    A text takes a place for its start, one for each word, and one for its end."""

    def __init__(self, vocabulary: np.ndarray, words: np.ndarray, n_words: np.ndarray, order: int):
        self.sizes = n_words + 2
        edges = np.concatenate([[0], np.cumsum(self.sizes)])
        self.starts, n = edges[:-1], int(edges[-1])
        inner = np.ones(n, dtype=bool)
        inner[self.starts], inner[edges[1:] - 1] = False, False
        symbol = np.empty(n, np.uint64)
        symbol[self.starts], symbol[edges[1:] - 1] = _START, _END
        symbol[inner] = vocabulary[words]
        self.place = np.arange(n) - np.repeat(self.starts, self.sizes)
        self.distinct: list[np.ndarray] = []
        self.which: list[np.ndarray] = []
        gram = symbol
        for k in range(1, order + 1):
            if k > 1:
                with np.errstate(over="ignore"):
                    gram = np.concatenate([gram[:1], mix64(gram[:-1] * _M + symbol[1:])])
            valid = self.place >= max(1, k - 1)
            u, inverse = np.unique(gram[valid] if k == 1 else gram[valid] >> np.uint64(64 - GRAM_BITS), return_inverse=True)
            which = np.full(n, -1, np.int32)
            which[valid] = inverse
            self.distinct.append(u)
            self.which.append(which)

    def counts(self, k: int, train: np.ndarray) -> np.ndarray:
        """How often each distinct n-gram of order k ends in texts that ``train`` marks."""
        which = self.which[k - 1]
        return np.bincount(which[(which >= 0) & np.repeat(train, self.sizes)], minlength=len(self.distinct[k - 1]))


class Automaton:
    """Arcs and failure arcs of the states that a block's texts can reach, from the corpus counts of their n-grams."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, types: int, texts: int, strengths: tuple[float, ...]):
        self.grams, self.counts = grams, counts
        n = len(grams.place)
        self.base = np.log10((counts[0] + 1.0) / (tokens + types + 1.0))
        self.arcs, self.fails = [self.base], []
        for k in range(2, len(counts) + 1):
            b, which = strengths[k - 2], grams.which[k - 1]
            at = np.zeros(len(counts[k - 1]), np.int64)  # some place where each n-gram ends
            places = np.flatnonzero(which >= 0)
            at[which[places]] = places
            state = self.state_counts(k, at, texts)
            shorter = np.power(10.0, self.arcs[-1][grams.which[k - 2][at]])
            with np.errstate(divide="ignore"):
                self.arcs.append(np.where(counts[k - 1] > 0, np.log10((counts[k - 1] + b * shorter) / (state + b)), -np.inf))
            fail = np.zeros(n)
            state = self.state_counts(k, places, texts)
            fail[places] = np.where(state > 0, np.log10(b / (state + b)), 0.0)
            self.fails.append(fail)

    def state_counts(self, k: int, at: np.ndarray, texts: int) -> np.ndarray:
        """How often the state of k - 1 symbols before each place has been left."""
        which = self.grams.which[k - 2][at - 1]
        known = np.where(which >= 0, self.counts[k - 2][which] if len(self.counts[k - 2]) else 0, 0)
        return np.where((self.grams.place[at] == k - 1) & (k == 2), texts, known)

    def walk(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the summed weights, the summed weights from the root alone, and its known tokens.

        The state before a word is the longest context that the corpus has; it hangs on the words alone, not on weights, so all
        places take their step at once: along the arc of their word if the state has it, else along failure arcs to where it is."""
        g = self.grams
        weight, left = np.zeros(len(g.place)), g.place >= 1
        for k in range(len(self.arcs), 1, -1):
            here = np.flatnonzero(left & (g.place >= k - 1))
            arc = self.arcs[k - 1][g.which[k - 1][here]]
            found = arc > -np.inf
            weight[here[found]] += arc[found]
            left[here[found]] = False
            weight[here[~found]] += self.fails[k - 2][here[~found]]
        weight[left] += self.base[g.which[0][left]]
        inner = g.place >= 1
        base, known = np.zeros(len(weight)), np.zeros(len(weight), np.int64)
        base[inner] = self.base[g.which[0][inner]]
        known[inner] = self.counts[0][g.which[0][inner]] > 0
        total = lambda x: np.add.reduceat(x, g.starts) if len(g.starts) else x
        return total(weight), total(base), total(known)


def blocks_of(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """Texts as blocks of word numbers, written to the shared folder: a block's name has to stay the same when it is asked again."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("train", T.ArrayType(T.BooleanType())), T.StructField("n_words", T.ArrayType(T.LongType()))]
        + [T.StructField(c, T.BinaryType()) for c in ("vocabulary", "words")]
        + [T.StructField(c, T.LongType()) for c in ("n_tokens", "train_tokens", "train_texts")]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, have = TaskContext.get().partitionId(), 0, 0
        ids, train_of, sizes, hashes = [], [], [], []

        def block() -> pa.RecordBatch:
            vocabulary, words = np.unique(np.concatenate(hashes), return_inverse=True)
            n, t = np.concatenate(sizes), np.concatenate(train_of)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [pa.array([(part << 32) + done], pa.int64()), one(pa.concat_arrays(ids)), one(pa.array(t)), one(pa.array(n))]
            columns += [pa.array([x], _PLANES) for x in (_steps(vocabulary), packed(words.astype(np.uint32)))]
            columns += [pa.array([int(x)], pa.int64()) for x in (n.sum() + len(n), (n[t] + 1).sum(), t.sum())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            data, offsets = utf8_buffers(batch.column(1))
            marks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in spans_of_rows(offsets):
                h, n = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids.append(batch.column(0).slice(i, j - i))
                train_of.append(marks[i:j])
                sizes.append(n)
                hashes.append(h)
                have += len(h) + j - i
                if have >= BLOCK_TOKENS:
                    yield block()
                    done, have = done + 1, 0
                    ids, train_of, sizes, hashes = [], [], [], []
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return materialize(rows.mapInArrow(cut, schema), "blocks")


def _grams(vocabulary: bytes, words: bytes, n_words: np.ndarray, order: int) -> Grams:
    return Grams(_sums(vocabulary), unpacked(words, np.uint32), n_words, order)


def answers(blocks: DataFrame, order: int, ranges: int) -> DataFrame:
    """(block, order, range, counts, types): for each range that a block has n-grams in, their counts in all training texts, in the
    order of their hashes. ``types`` of the rows of order 1 sum up to the number of distinct training tokens."""
    asked = "order int, range int, block long, hashes binary, counts binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = {bits: (np.arange(1, ranges, dtype=object) * (1 << bits) // ranges).astype(np.uint64) for bits in (WORD_BITS, GRAM_BITS)}
        for batch in batches:
            for row in range(batch.num_rows):
                block, train, n_words, vocabulary, words = (batch.column(k)[row] for k in range(5))
                grams = _grams(vocabulary.as_py(), words.as_py(), n_words.values.to_numpy(), order)
                marks = train.values.to_numpy(zero_copy_only=False)
                for k in range(1, order + 1):
                    u, c = grams.distinct[k - 1], grams.counts(k, marks).astype(np.uint32)
                    cuts = np.concatenate([[0], np.searchsorted(u, edges[WORD_BITS if k == 1 else GRAM_BITS]), [len(u)]])
                    some = np.flatnonzero(np.diff(cuts))
                    parts = [slice(cuts[r], cuts[r + 1]) for r in some]
                    columns = [pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array([block.as_py()] * len(some), pa.int64()), pa.array([_steps(u[p]) for p in parts], _PLANES), pa.array([packed(c[p]) for p in parts], _PLANES)]
                    yield pa.RecordBatch.from_arrays(columns, names=["order", "range", "block", "hashes", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        hashes = [_sums(x.as_py()) for x in group.column("hashes")]
        counts = np.concatenate([unpacked(x.as_py(), np.uint32) for x in group.column("counts")])
        u, which = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(u), np.int64)
        np.add.at(total, which, counts)
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in hashes])])
        types = np.zeros(group.num_rows, np.int64)
        types[0] = np.count_nonzero(total) if group.column("order")[0].as_py() == 1 else 0
        each = [packed(total[which[a:b]]) for a, b in zip(cuts, cuts[1:])]
        return pa.table({"block": group.column("block"), "order": group.column("order"), "range": group.column("range"), "counts": pa.array(each, _PLANES), "types": types})

    rows = blocks.select("block", "train", "n_words", "vocabulary", "words").mapInArrow(ask, asked)
    return materialize(rows.groupBy("order", "range").applyInArrow(answer, "block long, order int, range int, counts binary, types long"), "answers")


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 3, strengths: tuple[float, ...] = STRENGTHS) -> DataFrame:
    """(id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``train`` marks the rows that the automaton learns from, null as no. Words are runs without ASCII white space, A-Z lower-cased;
    each text has one end. ``n_known`` are the tokens that a training text has, ``train_tokens`` all tokens of training texts;
    scores are log10 probabilities, the base by single tokens.

    A null text is empty: its end alone is scored. Repeated rows count and score each, equal texts score alike. Without training
    texts each token has the probability 1. Other columns are left out, so that none can clash; an empty table gives none."""
    blocks = blocks_of(docs, id_col, text_col, train)
    size = blocks.agg(F.sum("n_tokens"), F.sum("train_tokens"), F.sum("train_texts")).first()
    n_tokens, tokens, texts = (int(x or 0) for x in size)
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // RANGE_TOKENS))
    found = answers(blocks, order, ranges)
    types = int(found.agg(F.sum("types")).first()[0] or 0)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("trained", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])

    def walk(block: pa.Table, answered: pa.Table) -> pa.Table:
        n_words = block.column("n_words").combine_chunks().values.to_numpy()
        grams = _grams(block.column("vocabulary")[0].as_py(), block.column("words")[0].as_py(), n_words, order)
        answered = answered.sort_by([("order", "ascending"), ("range", "ascending")])
        counts = [np.empty(0, np.int64)] * order
        of_order, planes = answered.column("order").to_numpy(), answered.column("counts")
        for k in range(1, order + 1):
            parts = [unpacked(planes[int(i)].as_py(), np.int64) for i in np.flatnonzero(of_order == k)]
            counts[k - 1] = np.concatenate(parts) if parts else counts[k - 1]
        score, base, known = Automaton(grams, counts, tokens, types, texts, strengths).walk()
        ids, trained = (block.column(c).combine_chunks().values for c in ("ids", "train"))
        columns = [ids, trained, pa.array(n_words + 1), pa.array(known), pa.array(np.full(len(known), tokens)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(columns, names=schema.names)

    asked = blocks.select("block", "ids", "train", "n_words", "vocabulary", "words").groupBy("block")
    return asked.cogroup(found.select("block", "order", "range", "counts").groupBy("block")).applyInArrow(walk, schema)
