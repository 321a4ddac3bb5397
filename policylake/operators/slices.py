"""Windows over keys that may hold any share of the rows: in two steps, so that no key is too large for a task.

What a row needs of the rows before it comes from its own slice of the key, and from one row for each earlier slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Arrival numbers of a slice: a task takes so many rows of a key at most.
SLICE = 1_000_000
#: Groups of the rows that share a key, where the rows have no order to cut them by.
SALTS = 256


def with_first(df: DataFrame, keys: list[str], seq: str, name: str, salts: int = SALTS) -> DataFrame:
    """Add ``name``: is the row its keys' first by ``seq`` (whole numbers, no two alike). Null keys are a key.

    The first of each salted group is found before the firsts of a key meet; the rest is settled by then."""
    salt = F.pmod(F.xxhash64(seq), F.lit(salts))
    near = F.row_number().over(Window.partitionBy(*keys, salt).orderBy(seq)) == 1
    df = df.withColumn(name, near)
    far = F.row_number().over(Window.partitionBy(*keys, F.when(F.col(name), -1).otherwise(salt)).orderBy(seq)) == 1
    return df.withColumn(name, F.col(name) & far)


def with_running(df: DataFrame, key: str, seq: str, last: dict[str, Column], newest: dict[str, Column] | None = None, number: str | None = None, size: int = SLICE) -> DataFrame:
    """Add columns that look along a key's rows in order of ``seq`` (whole numbers, no two of a key alike).

    ``last``: names and expressions; the expression's last value that isn't null, of the rows before. ``newest``: the same
    over all rows of the key. ``number``: the row's place in its key, from 1. Null keys are a key."""
    newest = newest or {}
    asked = {**{f"_l{i}": e for i, e in enumerate(last.values())}, **{f"_n{i}": e for i, e in enumerate(newest.values())}}
    df = df.withColumns({"_slice": F.floor(F.col(seq) / F.lit(size)), **asked})
    within = Window.partitionBy(key, "_slice").orderBy(seq)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    near = df.withColumns({f"_near{i}": F.last(f"_l{i}", ignorenulls=True).over(before) for i in range(len(last))} | ({"_place": F.row_number().over(within)} if number else {}))
    # A row for each slice of a key: with these the slices are looked along.
    per = df.groupBy(F.col(key).alias("_key"), F.col("_slice").alias("_s")).agg(F.count("*").alias("_rows"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in asked])
    along = Window.partitionBy("_key").orderBy("_s")
    earlier, whole = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    far = per.select("_key", "_s", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"), *[F.last(f"_l{i}", ignorenulls=True).over(earlier).alias(f"_far{i}") for i in range(len(last))], *[F.last(f"_n{i}", ignorenulls=True).over(whole).alias(f"_new{i}") for i in range(len(newest))])
    out = near.join(far, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_s")))
    added = [F.coalesce(f"_near{i}", f"_far{i}").alias(n) for i, n in enumerate(last)] + [F.col(f"_new{i}").alias(n) for i, n in enumerate(newest)] + ([(F.col("_place") + F.col("_offset")).alias(number)] if number else [])
    return out.select(*[c for c in df.columns if c not in asked and c != "_slice"], *added)
