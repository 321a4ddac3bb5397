"""Quality by importance resampling.

Two generative models over hashed n-grams, one of target text and one of all raw text, give each document a log importance
weight: the sum, over its n-grams, of the log ratio of their probabilities less a margin. Documents are sampled by Gumbel
top-k: noise from a Gumbel distribution is added to each weight and the k largest stay, which samples without replacement
in proportion to the weights.

N-grams are words, and one to three shapes in a row: lower, title or upper case, digits, marks as they are, and whether a
word repeats one of the two before it. The target is text labelled good, from a bounded sample of the labels; the raw model
counts all documents. The margin is where the sample's labels are told apart best by weight per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .tokenization import _SPACE, mix64, span_hashes, spans_of_rows, utf8_buffers

#: Buckets of hashed n-grams: the models' fixed size.
BUCKETS = 1 << 16
#: Labelled documents that the target model and the margin are fitted on, at most.
LABELLED = 20_000
#: Weight of a text without any n-gram.
NO_WEIGHT = -1e9
_BLOCK = 500_000

_KIND = np.full(256, 4, np.uint8)  # 0 space, 1 lower, 2 upper, 3 digit, 4 mark
_KIND[_SPACE] = 0
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[128:] = 1
_SEEDS = [np.uint64(x) for x in (0x9AE16A3B2F90404F, 0xC949C7DEFEFE3D29, 0xB492B66FBE98F273, 0x87C37B91114253D5)]


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, and the edges of the texts."""
    n, n_rows = len(data), len(offsets) - 1
    if not n:
        return np.empty(0, np.int64), np.zeros(n_rows + 1, np.int64)
    kind = _KIND[data]
    upper = (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[:-1] == 0xC3)  # accented capitals
    kind[1:][upper] = 2
    kind[:-1][upper] = 2
    token = np.where(kind == 0, 0, np.where(kind == 4, 2, 1))
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    change = first[:-1].copy()
    change[1:] |= token[1:] != token[:-1]
    starts = np.flatnonzero(change & (token > 0))
    if not len(starts):
        return np.empty(0, np.int64), np.zeros(n_rows + 1, np.int64)
    after = np.flatnonzero(np.append(change, True))
    ends = after[np.searchsorted(after, starts, side="right")]
    h = span_hashes(data, starts, ends)
    sums = lambda mask: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(mask)]))
    word = token[starts] == 1
    lower, upper_n, digits = sums(kind == 1) > 0, sums(kind == 2), sums(kind == 3) > 0
    shape = np.where(digits, 3, np.where(upper_n == 0, 0, np.where(lower | (upper_n == 1), 1, 2))).astype(np.uint64)
    edges = np.searchsorted(starts, offsets)
    row_start = np.repeat(edges[:-1], np.diff(edges))
    at = np.arange(len(h))
    again = np.zeros(len(h), dtype=bool)
    for k in (1, 2):
        again[k:] |= (h[k:] == h[:-k]) & (at[k:] - k >= row_start[k:]) & word[k:]
    with np.errstate(over="ignore"):
        s = np.where(word, shape + np.uint64(8) * again, h * np.uint64(2) + np.uint64(1))
        grams = [mix64(h ^ _SEEDS[0]), mix64(s ^ _SEEDS[1])]
        two = mix64(grams[1][:-1] * _SEEDS[2] + s[1:])
        three = mix64(two[:-1] * _SEEDS[3] + s[2:])
    keep2, keep3 = at[1:] > row_start[1:], at[2:] - 1 > row_start[2:]
    places = np.concatenate([at, at, at[1:][keep2], at[2:][keep3]])
    buckets = np.concatenate([*grams, two[keep2], three[keep3]]) % np.uint64(BUCKETS)
    order = np.argsort(places, kind="stable")
    per_token = np.bincount(places, minlength=len(h))
    totals = np.concatenate([[0], np.cumsum(per_token)])
    return buckets[order].astype(np.int64), totals[edges]


@dataclass
class Model:
    """Log ratios of the buckets, and the margin an n-gram has to make up on average."""

    ratio: np.ndarray
    margin: float = 0.0


def _sample_of(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids with their label, those with the smallest hashes."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("_label_id")).agg(F.max(label_col).cast("int").alias("_label"))
    return ids.orderBy(F.xxhash64("_label_id"), "_label_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Model:
    """Fit both models and the margin. Without labelled good text, or without any text, all ratios are 0: nothing is told apart."""
    sample = _sample_of(labels, id_col, label_col, labelled).toPandas()  # bounded by ``labelled``
    good = F.broadcast(docs.sparkSession.createDataFrame(sample if len(sample) else [], "_label_id string, _label int"))
    marked = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).join(good, F.col("_id") == F.col("_label_id"), "left").select("_text", "_label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(0))
            is_good = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False) == 1
            for i, j in spans_of_rows(offsets, _BLOCK):
                buckets, edges = ngram_buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[np.repeat(is_good[i:j], np.diff(edges))], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    counts = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts["bucket"].to_numpy(np.int64)
    raw[at], target[at] = counts["raw"], counts["target"]
    model = Model(np.zeros(BUCKETS))
    if target.sum():
        model.ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
        known = weigh(marked.where("_label IS NOT NULL"), model, "_text").where("n_grams > 0").select(((F.col("log_ratio")) / F.col("n_grams")).alias("mean"), "_label").toPandas()  # rows of the sample
        model.margin = _best_cut(known["mean"].to_numpy(np.float64), known["_label"].to_numpy(np.int64))
    return model


def _best_cut(mean: np.ndarray, label: np.ndarray) -> float:
    """Where the rates of good and bad labels on their own sides add up to most; the middle between the values around it."""
    if not len(mean) or label.min() == label.max():
        return float(mean.min()) - 1.0 if len(mean) else 0.0
    order = np.argsort(mean, kind="stable")
    mean, label = mean[order], label[order]
    below_bad = np.concatenate([[0], np.cumsum(label == 0)]) / (label == 0).sum()
    below_good = np.concatenate([[0], np.cumsum(label == 1)]) / (label == 1).sum()
    gain = below_bad - below_good
    ends = np.append(True, np.append(mean[1:] != mean[:-1], True))
    k = int(np.argmax(np.where(ends, gain, -1)))
    return float(mean[0] - 1e-6) if k == 0 else float(mean[-1] + 1e-6) if k == len(mean) else float((mean[k - 1] + mean[k]) / 2)


def weigh(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add log_ratio and n_grams; all columns of ``df`` stay."""
    ratio = model.ratio
    schema = T.StructType([*df.schema, T.StructField("log_ratio", T.DoubleType()), T.StructField("n_grams", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(text_col))
            for i, j in spans_of_rows(offsets, _BLOCK):
                buckets, edges = ngram_buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                # Whole numbers add up alike in any order, so that equal texts have equal weights.
                sums = np.concatenate([[0], np.cumsum(np.round(ratio[buckets] * (1 << 20)).astype(np.int64))])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array((sums[edges[1:]] - sums[edges[:-1]]) / (1 << 20)), pa.array(np.diff(edges))], names=schema.names)

    return df.mapInArrow(run, schema)


def add_keys(df: DataFrame, model: Model, text_col: str = "text", temperature: float = 1.0) -> DataFrame:
    """Add log_ratio, n_grams, log_weight (less the margin) and gumbel_key (log_weight and Gumbel noise that the text's hash draws)."""
    u = (F.pmod(F.xxhash64(F.lit("gumbel"), F.coalesce(F.col(text_col), F.lit(""))), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    weight = F.when(F.col("n_grams") > 0, F.col("log_ratio") - F.col("n_grams") * F.lit(model.margin)).otherwise(F.lit(NO_WEIGHT))
    return weigh(df, model, text_col).withColumn("log_weight", weight).withColumn("gumbel_key", F.col("log_weight") - F.lit(temperature) * F.log(-F.log(u)))


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value, exactly: counts in ever narrower bins, a few thousand numbers on the driver each time."""
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return low
    above = 0  # values over ``high``
    while low < high:
        width = (high - low) / bins
        inside = df.where((F.col(col) >= low) & (F.col(col) <= high))
        place = F.least(F.greatest(F.floor((F.col(col) - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(bins - 1))
        found = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).orderBy(F.desc("bin")).collect()
        for row in found:
            if above + row.n >= k:
                low, high = row.low, row.high
                break
            above += row.n
    return low


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED, temperature: float = 1.0) -> DataFrame:
    """All rows of ``docs`` with log_ratio, n_grams, log_weight, gumbel_key and kept: the k largest keys.

    ``k``: as many documents as have a positive weight, if not given; all documents then stay where the labels have no good
    text, as no model can be fitted. Ties on the k-th key are all kept, so rows with equal
    texts share their fate. Texts without n-grams (null, empty, white space) have weight NO_WEIGHT: they go before any
    other. Null ids have no label. An empty table gives an empty table. Other columns stay; none may have an added name.
    """
    added = ["log_ratio", "n_grams", "log_weight", "gumbel_key", "kept"]
    if clash := set(added) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    model = fit(docs, labels, id_col, text_col, label_col, labelled)
    keys = materialize(add_keys(docs.select(F.col(text_col).alias("_text")), model, "_text", temperature).select("log_weight", "gumbel_key"), "quality-keys")
    if k is None:
        k = keys.where("log_weight > 0").count()
        least = kth_largest(keys, "gumbel_key", k) if model.ratio.any() else float("-inf")
    else:
        least = kth_largest(keys, "gumbel_key", k)
    return add_keys(docs, model, text_col, temperature).withColumn("kept", F.col("gumbel_key") >= F.lit(least))
