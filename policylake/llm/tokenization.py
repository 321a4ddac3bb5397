"""Token ids of many texts with the ``tokenizers`` library, encoding each distinct unit once.

A byte-level BPE splits a text by a fixed pattern before it merges, and no piece spans from a non-space to a following
white space. A unit, one optional space and the run of non-spaces after it, therefore has the same ids alone as in its
text, also if it ends between a letter and an ASCII mark; so does a run of white space short of its last character. Units are found and hashed with numpy over whole Arrow
buffers, the library encodes those not seen before, and a gather writes the ids of all texts. Texts that hold
white space beyond ASCII, or a token that the library finds before it splits, go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: UTF-8 forms of white space beyond ASCII.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Bytes of text that are looked at together; bounds a worker's memory, together with ``most_units``.
BLOCK_BYTES = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


_P_INV = np.uint64(_inverse(int(_P)))
_powers: dict[str, np.ndarray] = {}


def _power_table(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        filled = 1
        with np.errstate(over="ignore"):
            step = base
            while filled < size:  # doubling: p^(i+filled) = p^i * p^filled
                have[filled : 2 * filled] = have[:filled] * step
                step = step * step
                filled *= 2
        _powers[name] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place on a copy."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends], from one prefix sum: sum of byte * p^i, made relative to each start."""
    n = len(data)
    with np.errstate(over="ignore"):
        prefix = np.empty(n + 1, dtype=np.uint64)
        prefix[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_P, n, "p") if n else data.astype(np.uint64), out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * _power_table(_P_INV, n + 1, "inv")[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def utf8_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy of the bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if pa.types.is_null(column.type):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def spans_of_rows(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """Row ranges of about ``most`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Encoder:
    """Ids of batches of texts. ``most_units`` bounds the memory of the units that are kept; beyond it they start afresh."""

    def __init__(self, path: str, most_units: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_units = most_units
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.id_bytes = np.zeros(self.vocab_size, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.id_bytes[i] = len(token)  # a byte-level token has one character a byte
        #: Tokens that the library finds before it splits a text: texts with one go to it whole.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)  # hashes of the known units, ascending
        self.place = np.empty(0, dtype=np.int32)  # of each in the next two
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.lengths = np.zeros(1 << 12, dtype=np.int32)
        self.flat = np.zeros(1 << 14, dtype=np.int32)
        self.used = 0

    def _add(self, at: np.ndarray, keys: np.ndarray, texts: list[str]) -> np.ndarray:
        """Encode new units; ``at`` says where their keys go. Returns their places."""
        ids, lengths = self._ids_of_units(texts)
        total, known = int(lengths.sum()), len(self.keys)
        while known + len(keys) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.lengths[known : known + len(keys)] = lengths
        self.starts[known : known + len(keys)] = self.used + np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)[:-1]])
        self.flat[self.used : self.used + total] = ids
        self.used += total
        places = np.arange(known, known + len(keys), dtype=np.int32)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, places)
        return places

    def _ids_of_units(self, units: list[str], block: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units. Blocks of them are encoded as one text, a line break before each unit that has no space of its own;
        the byte lengths of the ids tell where each unit ends."""
        blank = [i for i, u in enumerate(units) if u.isspace()]
        if blank:
            apart = set(blank)
            words = [u for i, u in enumerate(units) if i not in apart]
        else:
            words = units
        marked = [u if u[0] == " " else "\n" + u for u in words]
        encoded = self.tokenizer.encode_batch_fast(["".join(marked[i : i + block]) for i in range(0, len(marked), block)], add_special_tokens=False)
        ids = np.fromiter((i for e in encoded for i in e.ids), dtype=np.int32)
        edges = np.cumsum(np.concatenate([[0], self.id_bytes[ids]]))
        ends = np.cumsum([len(u.encode()) for u in marked], dtype=np.int64)
        last = np.searchsorted(edges, ends)
        if len(marked) and not np.array_equal(edges[last], ends):
            raise ValueError("ids of units don't end where the units end")
        extra = np.array([len(m) != len(u) for m, u in zip(marked, words)], dtype=bool)
        starts = np.concatenate([[0], last[:-1]]).astype(np.int64) if len(marked) else np.zeros(0, np.int64)
        keep = np.ones(len(ids), dtype=bool)
        keep[starts[extra]] = False
        ids, lengths = ids[keep], (last - starts - extra).astype(np.int32) if len(marked) else np.zeros(0, np.int32)
        if not blank:
            return ids, lengths
        own = [e.ids for e in self.tokenizer.encode_batch_fast([units[i] for i in blank], add_special_tokens=False)]
        pieces, k, at = [], 0, 0
        all_lengths = np.empty(len(units), dtype=np.int32)
        mine = dict(zip(blank, own))
        for i in range(len(units)):
            if i in mine:
                pieces.append(np.array(mine[i], dtype=np.int32))
                all_lengths[i] = len(mine[i])
            else:
                pieces.append(ids[at : at + lengths[k]])
                all_lengths[i] = lengths[k]
                at, k = at + lengths[k], k + 1
        return np.concatenate(pieces), all_lengths

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        n_rows = len(offsets) - 1
        if n_rows and int(np.diff(offsets).max()) > 2 * BLOCK_BYTES:
            return self._encode_long(data, offsets)
        raw = data.tobytes()
        whole = {m.start() for m in _WIDE_SPACE.finditer(raw)} if data.size and int(data.max()) >= 0x80 else set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                whole.add(at)
                at = raw.find(token, at + 1)
        if whole:
            rows = np.searchsorted(offsets, np.fromiter(whole, np.int64), side="right") - 1
            return self._encode_mixed(data, offsets, raw, set(rows.tolist()))
        return self._encode_plain(data, offsets, raw)

    def _encode_long(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts cut into parts of about a block, each before a space between ASCII non-spaces, where no piece spans."""
        clean = ~_SPACE[data] & (data < 0x80)
        cuts = np.flatnonzero(clean[:-2] & (data[1:-1] == 32) & clean[2:]) + 1
        edges = [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            while b - edges[-1] > BLOCK_BYTES:
                k = int(np.searchsorted(cuts, edges[-1] + BLOCK_BYTES))
                if k == len(cuts) or cuts[k] >= b:
                    break
                edges.append(int(cuts[k]))
            if b > edges[-1]:
                edges.append(b)
        edges = np.array(edges, np.int64)
        ids, counts = [], np.zeros(len(offsets) - 1, np.int64)
        for i, j in spans_of_rows(edges, BLOCK_BYTES):
            part = data[edges[i] : edges[j]]
            if j - i == 1 and len(part) > 2 * BLOCK_BYTES:  # no place to cut it
                some = self.tokenizer.encode(part.tobytes().decode(), add_special_tokens=False).ids
                got, n = np.array(some, np.int32), np.array([len(some)])
            else:
                got, n = self.encode(part, edges[i : j + 1] - edges[i])
            ids.append(got)
            rows = np.searchsorted(offsets, edges[i:j], side="right") - 1
            np.add.at(counts, rows, n)
        return np.concatenate(ids), counts

    def _encode_plain(self, data: np.ndarray, offsets: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        n_rows = len(offsets) - 1
        n = len(data)
        if n == 0:
            return np.empty(0, np.int32), np.zeros(n_rows, np.int64)
        space = _SPACE[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets[:-1]] = True
        first[n] = True
        before = np.empty(n, dtype=bool)  # is the byte before, in the same text, white space
        before[0] = False
        before[1:] = space[:-1]
        before[first[:-1]] = False
        after_space = np.empty(n, dtype=bool)  # is the byte after, in the same text, white space; the end of a text is none
        after_space[:-1] = space[1:]
        after_space[-1] = False
        ends_text = first[1:]
        # A white space starts a unit after a non-space, and where it is the last of its run before a non-space.
        last_of_run = space & ~after_space & ~ends_text
        starts_here = first[:-1] | (space & ~before) | last_of_run
        # A non-space starts a unit only after a white space other than the plain one.
        odd_before = np.empty(n, dtype=bool)
        odd_before[0] = False
        odd_before[1:] = space[:-1] & (data[:-1] != 32)
        starts_here |= ~space & odd_before & before
        # Nor does a piece span from a letter to an ASCII mark after it.
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        starts_here[1:] |= letter[:-1] & _MARK[data[1:]]
        starts = np.flatnonzero(starts_here)
        ends = np.append(starts[1:], n)
        hashes = span_hashes(data, starts, ends)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.most_units:
            self._clear()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        places = np.empty(len(unique), dtype=np.int32)
        places[known] = self.place[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            s, e = starts[where[new]].tolist(), ends[where[new]].tolist()
            places[new] = self._add(at[new], unique[new], [raw[a:b].decode() for a, b in zip(s, e)])
        place = places[inverse]
        lengths = self.lengths[place].astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(self.starts[place] - edges[:-1], lengths) + np.arange(edges[-1])]
        counts = edges[np.searchsorted(starts, offsets[1:], side="left")] - edges[np.searchsorted(starts, offsets[:-1], side="left")]
        return ids, counts

    def _encode_mixed(self, data, offsets, raw, wide) -> tuple[np.ndarray, np.ndarray]:
        out, counts, i, n_rows = [], np.zeros(len(offsets) - 1, np.int64), 0, len(offsets) - 1
        while i < n_rows:
            j = i
            if i in wide:
                ids = self.tokenizer.encode(raw[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids
                out.append(np.array(ids, dtype=np.int32))
                counts[i] = len(ids)
                i += 1
                continue
            while j < n_rows and j not in wide:
                j += 1
            ids, some = self.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out.append(ids)
            counts[i:j] = some
            i = j
        return np.concatenate(out) if out else np.empty(0, np.int32), counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
