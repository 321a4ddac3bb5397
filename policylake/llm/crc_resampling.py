"""Importance resampling towards a target distribution, over n-gram features that are named by their CRC-32.

Each word's CRC is computed once. That of an n-gram follows from those of its words: a CRC is linear over GF(2), so that
crc(a + b) = shift(crc(a), len(b)) xor crc(b), where shift by a length is a 32 x 32 matrix of bits; it is applied as the product
of the matrices of the length's powers of two, each kept as four tables of 256 entries. No n-gram is ever put together as text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .prefix_sums import running
from .tokenization import spans_of_rows, utf8_buffers

#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Words of more bytes are looked at one by one.
LONG_WORD = 48
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), c >> np.uint32(1))
    return c


BYTE = _byte_table()


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The matrix whose ``tables`` these are, times each of ``c``."""
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


@cache
def shift_tables(power: int) -> np.ndarray:
    """Tables (4, 256) of the matrix that appends 2**power zero bytes to what a CRC was made of."""
    if power:
        half = shift_tables(power - 1)
        return np.stack([_apply(half, half[k]) for k in range(4)])
    place = np.arange(256, dtype=np.uint32)
    one = [place << np.uint32(8 * k) for k in range(4)]
    return np.stack([(c >> np.uint32(8)) ^ BYTE[c & 255] for c in one])


def shifted(c: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs ``c`` moved over ``lengths`` bytes each."""
    c, left, power = c.copy(), lengths.astype(np.int64), 0
    while (left >> power).any():
        on = np.flatnonzero((left >> power) & 1)
        c[on] = _apply(shift_tables(power), c[on])
        power += 1
    return c


def word_crcs(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and length of all words of all (lower-cased) texts, and the edges of the texts in words."""
    n = len(low)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = _WORD[low]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    ends[:-1] &= ~word[1:] | first[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lengths = stops - starts
    order = np.argsort(-np.minimum(lengths, LONG_WORD), kind="stable")  # those that still have a byte stand first
    at, left = starts[order], lengths[order]
    c = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    alive = np.searchsorted(-left.clip(max=LONG_WORD), -np.arange(1, LONG_WORD + 1), side="right")
    for k in range(LONG_WORD):
        m = int(alive[k])
        if not m:
            break
        c[:m] = BYTE[(c[:m] ^ low[at[:m] + k]) & 255] ^ (c[:m] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = zlib.crc32(low[starts[i] : stops[i]])
    return out, lengths, np.searchsorted(starts, offsets)


def feature_crcs(low: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to ``most`` words joined by a space, the text of each, and the words of each text."""
    words, lengths, edges = word_crcs(low, offsets)
    counts = np.diff(edges)
    text = np.repeat(np.arange(len(counts)), counts)
    crcs, texts = [words], [text]
    run, space = words, np.uint32(zlib.crc32(b" "))
    for k in range(1, most):
        if len(words) <= k:
            break
        # run + " " + word: the run moves over 1 + len(word) bytes, the space over len(word).
        run = shifted(run[:-1], lengths[k:] + 1) ^ shifted(np.full(len(words) - k, space), lengths[k:]) ^ words[k:]
        within = text[: len(text) - k] == text[k:]
        crcs.append(run[within])
        texts.append(text[k:][within])
    return np.concatenate(crcs), np.concatenate(texts), counts


@dataclass
class Gains:
    """The gain of each bucket, for features of up to ``most`` words."""

    gain: np.ndarray
    most: int


def _buckets(column: pa.Array, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = utf8_buffers(column)
    for i, j in spans_of_rows(offsets):
        low = _LOWER[data[offsets[i] : offsets[j]]]
        crcs, texts, words = feature_crcs(low, offsets[i : j + 1] - offsets[i], most)
        yield crcs % np.uint32(buckets), texts, words


def bucket_counts(texts: DataFrame, text_col: str = "text", most: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket. A task hands on a row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b, _, _ in _buckets(batch.column(0), most, buckets):
                total += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(raw: DataFrame, target: DataFrame, text_col: str = "text", most: int = 1, buckets: int = 10_000) -> Gains:
    """Gains of all buckets: floor(1000 ln) of how much likelier the target's model has it, both smoothed by one."""
    counts = []
    for side in (raw, target):
        n = np.zeros(buckets, np.int64)
        for r in bucket_counts(side, text_col, most, buckets).collect():  # at most ``buckets`` rows
            n[r["bucket"]] = r["n"]
        counts.append(n.tolist())
    s_all, t_all = (sum(c) for c in counts)
    return Gains(np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(*counts)], dtype=np.int64), most)


def gumbel(id_col: str | Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u in (0, 1) from the first 32 bits of sha256 of "seed:id". A null id is the empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def weigh(docs: DataFrame, gains: Gains, text_col: str = "text") -> DataFrame:
    """Rows with n_words, n_features and weight, the sum of the gains of a text's features, and the text's column left out."""
    rest = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*[docs.schema[c] for c in rest], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    buckets = len(gains.gain)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for b, texts, words in _buckets(batch.column(batch.num_columns - 1), gains.most, buckets):
                n_words.append(words)
                n_features.append(np.bincount(texts, minlength=len(words)))
                sums = np.zeros(len(words), np.int64)
                np.add.at(sums, texts, gains.gain[b])
                weight.append(sums)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(np.concatenate(x)) for x in (n_words, n_features, weight)]], names=schema.names)

    return docs.select(*rest, F.col(text_col).cast("string").alias(text_col)).mapInArrow(walk, schema)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1, buckets: int = 10_000, seed: int = 2024, share: int = 10, least_words: int = 20) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document: of the N with ``least_words`` or more, the floor(share * N / 100)
    highest scores have a rank from 1, ties to the smaller id, null last; all others have none.

    Null and empty texts have no features and weight 0. Repeated rows count each, one after the other. Other columns are left
    out, so that none can clash. An empty table gives an empty result, an empty target only its smoothing."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = materialize(weigh(narrow, fit(docs, target, text_col, most, buckets)).withColumn("score", F.col("weight") + gumbel("id", seed)), "weights")
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * share // 100
    # Rows alike in score and id differ in their hash of weight at most: their order doesn't show.
    placed = running(scored.where(enough), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight"), F.col("n_features")], "ranks")
    ranked = placed.withColumn("rank", F.when(F.col("at") <= drawn, F.col("at"))).drop("at")
    out = ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
