"""Word shingles of whole Arrow buffers as sorted 64-bit hashes, with numpy."""

from __future__ import annotations

import numpy as np

from .tokenization import _SPACE, mix64, span_hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M = np.uint64(0xC2B2AE3D27D4EB4F)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the edges of the texts."""
    n = len(data)
    low = _LOWER[data]
    word = ~_SPACE[low]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    starts_at = word.copy()
    starts_at[1:] &= ~word[:-1] | first[1:-1]
    ends_at = word.copy()
    ends_at[:-1] &= ~word[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at) + 1
    return span_hashes(low, starts, ends), np.searchsorted(starts, offsets)


def word_buckets(h: np.ndarray, bits: int) -> np.ndarray:
    """Places of hashed words in a table of 2**bits."""
    return (mix64(h) >> np.uint64(64 - bits)).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 4, costs: np.ndarray | None = None, seen: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct shingles of ``size`` words of each text, hashed, ascending within a text; and the edges of the texts.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words, but not none, is one shingle. With
    ``costs``, a table by word bucket, the third result is the sum of the words' costs for each shingle. Words are counted in
    ``seen``, a table by word bucket too."""
    n_rows, n = len(offsets) - 1, len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(n_rows + 1, np.int64), *([] if costs is None else [np.empty(0, np.int64)])
    h, edges = _words(data, offsets)  # edges in words
    counts = np.diff(edges)
    if seen is not None:
        seen += np.bincount(word_buckets(h, len(seen).bit_length() - 1), minlength=len(seen))
    paid = None if costs is None else np.concatenate([[0], np.cumsum(costs[word_buckets(h, len(costs).bit_length() - 1)], dtype=np.int64)])
    with np.errstate(over="ignore"):
        gram = h.copy()
        for k in range(1, min(size, len(h))):
            gram[: len(h) - k] = mix64(gram[: len(h) - k] * _M + h[k:])
        row = np.repeat(np.arange(n_rows), counts)
        left = edges[1:][row] - np.arange(len(h))  # words from here to the end of the text
        keep = left >= size
        for i in np.flatnonzero((counts > 0) & (counts < size)):  # the whole of a short text, with its length
            a, b = edges[i], edges[i + 1]
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = mix64(np.array([whole * _M + x], dtype=np.uint64))[0]
            gram[a], keep[a] = whole, True
    if paid is not None:
        at = np.arange(len(h))
        cost = (paid[np.minimum(at + size, edges[1:][row])] - paid[:-1])[keep]
    gram, row = gram[keep], row[keep]
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    out = gram[new], np.searchsorted(row[new], np.arange(n_rows + 1))
    return out if paid is None else (*out, cost[order][new])
