"""Packing of token ids into sequences by order-preserving dynamic programming.

Documents follow each other in the order in which a partition holds them. Cuts between sequences are chosen among
document ends (free) and sentence ends (a small penalty for the truncated document); only a long sentence offers places
inside (a larger penalty). For cuts c_0 < c_1 < ... the least cost up to c_j is

    dp[j] = penalty[j] + min over c_i >= c_j - size of dp[i] + size - (c_j - c_i),

so the transition needs the minimum of dp[i] + c_i over a sliding window: a monotone queue gives it in constant time.
The program goes on from block to block; a cut is settled when all places from which later cuts can come lead back to it.
A partition needs no other partition's rows: there is no shuffle, and a lost executor costs only its own partitions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokenization import BLOCK_BYTES, encoder, spans_of_rows, utf8_buffers

SIZE = 1024
SENTENCE_PENALTY = 2
INNER_PENALTY = 8
#: A sentence of more ids offers places inside, so many ids apart.
LONG_SENTENCE, INNER_STEP = 128, 8
#: Ids that wait for a settled cut, at most; where the ways have not met by then, the best one so far is taken.
WAITING = 4_000_000
_SEQUENCES_PER_PARTITION = 1 << 32
_PIECES_PER_BATCH = 2_000


class Cutter:
    """Cuts of least cost in a growing row of places, by a monotone queue. The first place is a cut."""

    def __init__(self, size: int, first: int = 0):
        self.size = size
        self.at, self.back, self.shift = [first], [0], 0  # places from number ``shift`` on, and the best cut before each
        self.queue = deque([(first, first, 0)])  # (cost + place, place, number), increasing
        self.cost = 0

    def extend(self, places: list[int], penalties: list[int]) -> None:
        """Add increasing places. No two neighbours may lie more than ``size`` apart."""
        queue, size, at, back, cost = self.queue, self.size, self.at, self.back, self.cost
        j = self.shift + len(at)
        for p, penalty in zip(places, penalties):
            while queue[0][1] < p - size:
                queue.popleft()
            best, _, i = queue[0]
            cost = best + size - p + penalty
            at.append(p)
            back.append(i)
            key = cost + p
            while queue and queue[-1][0] >= key:
                queue.pop()
            queue.append((key, p, j))
            j += 1
        self.cost = cost

    def settled(self, whole: bool) -> list[int]:
        """The cuts from the last settled one on, as far as no later place can change them; all up to the last place, if ``whole``."""
        shift, at, back = self.shift, self.at, self.back
        ways = {shift + len(at) - 1} if whole else {i for _, _, i in self.queue}
        while len(ways) > 1:  # the latest goes back a step, until all have met
            k = max(ways)
            ways.discard(k)
            ways.add(back[k - shift] if k > shift else k)
        k = last = ways.pop()
        out = [at[k - shift]]
        while k > shift:
            k = back[k - shift]
            out.append(at[k - shift])
        self.at, self.back, self.shift = at[last - shift :], back[last - shift :], last
        return out[::-1]


def cuts(positions: list[int], penalties: list[int], size: int = SIZE) -> list[int]:
    """The cuts of least cost among increasing ``positions``; the first and the last belong to them."""
    cutter = Cutter(size, positions[0])
    cutter.extend(positions[1:], penalties[1:])
    return cutter.settled(True)


def powers(length: int) -> list[int]:
    """Powers of two, largest first, that add up to ``length``."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Packer:
    """Packs one partition's documents, a block of them at a time; what follows the last settled cut waits for the next block.

    Places count from the partition's first id; ``ids`` and ``doc_edges`` begin at ``base``, the last settled cut."""

    def __init__(self, sentence_end: np.ndarray, size: int = SIZE, first_sequence: int = 0, waiting: int = WAITING):
        self.sentence_end, self.size, self.next_sequence, self.waiting = sentence_end, size, first_sequence, waiting
        self.ids, self.base = np.empty(0, np.uint32), 0
        self.doc_edges = np.zeros(1, np.int64)  # where the waiting documents begin and end; the first may begin before base
        self.first_doc = 0  # the number of the first waiting document
        self.cutter = Cutter(size)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray] | None:
        """Add documents; the pieces that are settled: document number, start in it, first and last place in .piece_ids, its
        length, sequence, offset."""
        ends = np.cumsum(counts, dtype=np.int64)
        places, penalties = self._places(ids, ends)
        self.cutter.extend((places + (self.base + len(self.ids))).tolist(), penalties.tolist())
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.doc_edges = np.concatenate([self.doc_edges, self.doc_edges[-1] + ends])
        return self._pieces(self.cutter.settled(len(self.ids) > self.waiting))

    def finish(self) -> dict[str, np.ndarray] | None:
        """The remaining pieces. Lengths that are powers of two are not padded: the last sequence is split into such."""
        windows = self.cutter.settled(True)
        if len(windows) > 1 and windows[-1] - windows[-2] < self.size:
            windows[-1:] = (windows[-2] + np.cumsum(powers(windows[-1] - windows[-2]))).tolist()
        return self._pieces(windows)

    def _places(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(ids)
        cost = np.full(n + 1, -1, np.int32)
        cost[1:][self.sentence_end[ids]] = SENTENCE_PENALTY
        cost[ends] = 0
        cost[0] = 0
        at = np.flatnonzero(cost >= 0)
        step = min(INNER_STEP, self.size)
        for i in np.flatnonzero(np.diff(at) > min(LONG_SENTENCE, self.size)):
            cost[at[i] + step : at[i + 1] : step] = INNER_PENALTY
        at = np.flatnonzero(cost >= 0)[1:]  # the first is the last one of the block before
        return at, cost[at]

    def _pieces(self, windows: list[int]) -> dict[str, np.ndarray] | None:
        if len(windows) < 2:
            return None
        self.piece_ids = self.ids
        edge = np.array(windows, np.int64) - self.base
        end = int(edge[-1])
        docs = self.doc_edges
        begins = np.unique(np.concatenate([edge[:-1], docs[(docs > 0) & (docs < end)]]))
        of = np.searchsorted(docs, begins, side="right") - 1
        window = np.searchsorted(edge, begins, side="right") - 1
        out = {"doc": of + self.first_doc, "start": begins - docs[of], "begin": begins, "end": np.append(begins[1:], end), "doc_tokens": np.diff(docs)[of], "sequence_id": window + self.next_sequence, "offset": begins - edge[window]}
        self.next_sequence += len(edge) - 1
        keep = int(np.searchsorted(docs, end, side="right")) - 1  # the document that holds the cut, or begins there
        self.ids, self.doc_edges, self.first_doc, self.base = self.ids[end:].copy(), docs[keep:] - end, self.first_doc + keep, self.base + end
        return out


def sentence_ends(tokenizer_path: str, end_id: int) -> np.ndarray:
    """Which ids end a sentence or a line."""
    enc = encoder(tokenizer_path)
    out = np.zeros(max(enc.vocab_size, end_id + 1), dtype=bool)
    for token, i in enc.tokenizer.get_vocab().items():
        out[i] = token[-1] in ".!?Ċ"  # the last stands for a line break
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` ids.

    Each document is its text's ids and ``end_id``. Returns a row per piece: ``id_col``, start (the document's ids before
    it), length, ids (little-endian unsigned 32-bit), doc_tokens (with the end id), sequence_id (unique, ordered within a
    partition) and offset (place in its sequence, without gaps). A sequence is shorter than ``size`` by its padding; the
    last one of a partition is instead split into lengths that are powers of two. The cuts of a partition have the least
    cost of all, unless more than WAITING ids come without the ways to cut them meeting: then the best way so far stays.

    Null text counts as empty: one end id. A null id is kept as null. Rows alike in id and text are packed each. An empty
    table gives no pieces. Other columns are ignored. A very long text is cut as often as needed; nothing is truncated.
    """
    if size < 1:
        raise ValueError("size must be positive")
    key_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, key_type)] + [T.StructField(c, T.LongType()) for c in ("start", "length")] + [T.StructField("ids", T.BinaryType())] + [T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        packer = Packer(sentence_ends(tokenizer_path, end_id), size, TaskContext.get().partitionId() * _SEQUENCES_PER_PARTITION)
        keys, known = None, 0  # keys of the waiting documents, and the number of the first of them

        def out(pieces: dict[str, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
            if pieces is None:
                return
            raw = pa.py_buffer(np.ascontiguousarray(packer.piece_ids, "<u4"))
            edges = pa.py_buffer(np.append(pieces["begin"], pieces["end"][-1]).astype(np.int32) * np.int32(4))
            n = len(pieces["doc"])
            ids = pa.Array.from_buffers(pa.binary(), n, [None, edges, raw])  # pieces lie side by side
            whole = pa.RecordBatch.from_arrays(
                [keys.take(pa.array(pieces["doc"] - known)), pa.array(pieces["start"]), pa.array(pieces["end"] - pieces["begin"]), ids, *(pa.array(pieces[c]) for c in ("doc_tokens", "sequence_id", "offset"))], names=schema.names
            )
            for k in range(0, n, _PIECES_PER_BATCH):
                yield whole.slice(k, _PIECES_PER_BATCH)

        for batch in batches:
            for i, j in spans_of_rows(utf8_buffers(batch.column(1))[1], block_bytes):
                data, offsets = utf8_buffers(batch.column(1).slice(i, j - i))
                ids, counts = enc.encode(data, offsets)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                some = batch.column(0).slice(i, j - i)
                keys = pa.concat_arrays([keys, some]) if keys is not None else some
                yield from out(packer.add(ids, counts + 1))
                keys, known = keys.slice(packer.first_doc - known), packer.first_doc
        yield from out(packer.finish())

    return docs.select(id_col, text_col).mapInArrow(run, schema)
