"""Positions, running sums and running exclusive ors over a whole table in a given order.

The table is dealt out by ranges of the order and each task walks its part once; what a part inherits from the parts before it
is settled from one summary row a part and added by a broadcast join. No task holds more than its range, whatever the key that
the rows share, as the ranges split inside a segment too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize


def _accumulated(values: np.ndarray, new: np.ndarray, start: int, op: np.ufunc, inverse: np.ufunc) -> np.ndarray:
    """Inclusive running ``op`` that begins afresh where ``new`` is set; rows before the first such one go on from ``start``."""
    total = op.accumulate(values)
    heads = np.flatnonzero(new)
    before = np.concatenate([[0], total[:-1]]).astype(values.dtype)
    base = np.zeros(len(values), values.dtype)
    if len(heads):
        base[heads[0] :] = np.repeat(before[heads], np.diff(np.append(heads, len(values))))
    out = inverse(total, base)
    open_rows = heads[0] if len(heads) else len(values)
    out[:open_rows] = op(out[:open_rows], values.dtype.type(start))
    return out


def running(df: DataFrame, order: list[Column], tag: str, segment: str | None = None, sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """Add ``at`` (1, 2, 3 ...), ``sum_<name>`` and ``xor_<name>`` (inclusive) to the rows of ``df``, in ``order``.

    With ``segment``, a long column without nulls that the order begins with, all begin afresh for each of its values. ``sums``
    and ``xors`` name long columns; null counts as 0. The result is written to the shared folder. Rows that tie in the whole
    order follow each other in any way; an empty table stays empty."""
    spark, rest = df.sparkSession, df.columns
    added = ["at", *[f"sum_{c}" for c in sums], *[f"xor_{c}" for c in xors]]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in added], T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_open", T.BooleanType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, last, is_open = TaskContext.get().partitionId(), 0, None, True
        carry = [0] * len(added)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            if segment is not None:
                key = batch.column(rest.index(segment)).to_numpy(zero_copy_only=False)
                new[1:] = key[1:] != key[:-1]
                new[0] = last is not None and key[0] != last
                last = key[-1]
            columns = [np.ones(n, np.int64)]
            columns += [batch.column(rest.index(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in (*sums, *xors)]
            done = []
            for k, values in enumerate(columns):
                xor = k > len(sums)
                done.append(_accumulated(values, new, carry[k], np.bitwise_xor if xor else np.add, np.bitwise_xor if xor else np.subtract))
                carry[k] = int(done[-1][-1])
            opened = np.zeros(n, dtype=bool)
            if is_open:
                opened[: int(np.argmax(new)) if new.any() else n] = True
                is_open = not new.any()
            extra = [*done, np.full(n, part, np.int32), np.arange(row + 1, row + n + 1), opened]
            row += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, extra)], names=schema.names)

    local = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, schema), tag)
    head = F.col(segment) if segment else F.lit(0)
    summary = local.groupBy("_part").agg(F.min_by(head, "_row").alias("first"), F.max_by(head, "_row").alias("last"), F.max_by("_open", "_row").alias("single"), *[F.max_by(c, "_row").alias(c) for c in added])
    inherited, tail, key = [], [0] * len(added), None
    for r in sorted(summary.collect(), key=lambda r: r["_part"]):  # one row a partition
        carry = tail if key is not None and r["first"] == key else [0] * len(added)
        if any(carry):
            inherited.append((r["_part"], *carry))
        tail = [_join(c, a, b) for c, a, b in zip(added, [r[c] for c in added], carry if r["single"] else [0] * len(added))]
        key = r["last"]
    if not inherited:
        return local.select(*rest, *added)
    offsets = F.broadcast(spark.createDataFrame(inherited, T.StructType([T.StructField("_part", T.IntegerType()), *[T.StructField(f"_{c}", T.LongType()) for c in added]])))
    whole = lambda c: (F.col(c).bitwiseXOR(_carried(c)) if c.startswith("xor_") else F.col(c) + _carried(c)).alias(c)
    return local.join(offsets, "_part", "left").select(*rest, *[whole(c) for c in added])


def _carried(c: str) -> Column:
    return F.when(F.col("_open"), F.coalesce(F.col(f"_{c}"), F.lit(0))).otherwise(F.lit(0).cast("long"))


def _join(name: str, a: int, b: int) -> int:
    return a ^ b if name.startswith("xor_") else a + b
