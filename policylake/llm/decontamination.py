"""Benchmark decontamination: a prefix-filtered set join of item windows with document words, DataFrame functions only.

A window, ``window`` consecutive words of an item (a shorter item is one window), must occur whole, so the prefix that any
match has to share with it is a single word: its rarest. Words of the benchmark are counted over all documents, each
window keeps its rarest word and that word's place, and document words meet windows on that word alone. Length and
position bounds (the window must begin and end inside the document) come before the comparison of the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: The prefix table goes to all executors only up to so many windows, and words in them; a larger one is joined by a shuffle on its words.
BROADCAST_WINDOWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII other than digits and letters (after lower-casing).
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: str | Column) -> Column:
    """Lower-cased words of a text as an array; null and empty texts have none."""
    parts = F.split(F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _UPPER, _LOWER), _BETWEEN)
    return F.array_remove(parts, "")


def item_windows(items: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of items: win (its words) and item."""
    w = items.select(F.col(item_col).alias("item"), words(text_col).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return w.select("item", "w", F.explode(starts).alias("at")).select(F.slice("w", F.col("at") + 1, window).alias("win"), "item").distinct()


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Occurrences of item windows: k1 and k2 (the row's key), start (place of the first word), length, item. Distinct."""
    wins = item_windows(items, window, item_col, item_text_col)
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    few = max(vocabulary.count(), wins.count()) <= BROADCAST_WINDOWS  # the benchmark decides, whatever the documents' size
    small = F.broadcast if few else (lambda df: df)
    # posexplode_outer: a plain explode would make Spark split each text a second time, to see whether it has words.
    found = docs.select(words(text_col).alias("w")).select(F.explode_outer("w").alias("word"))
    counts = found.join(small(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    ranked = (
        wins.select("win").distinct().select("win", F.posexplode("win").alias("offset", "word")).join(counts, "word", "left")
        .groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("rarest"))
        .where("rarest.n > 0")  # a word that no document has: the window occurs nowhere
        .select("win", F.col("rarest.word").alias("word"), F.col("rarest.offset").alias("offset"))
    )
    # Generate, join and comparison stay in one generated loop, so that the words of a row are not copied for each of them.
    here = docs.select(*_key(id_col, text_col), words(text_col).alias("w")).select("k1", "k2", "w", F.posexplode_outer("w").alias("at", "word"))
    if not few:  # the words go by shuffle, without the texts
        met = here.select("k1", "k2", "at", "word").join(ranked, "word")
        here = met.join(docs.select(*_key(id_col, text_col), words(text_col).alias("w")).dropDuplicates(["k1", "k2"]), ["k1", "k2"]).select("k1", "k2", "w", "at", "word")
    at, offset, length = F.col("at"), F.col("offset"), F.size("win")
    bounds = (at >= offset) & (at - offset + length <= F.size("w"))
    same = F.slice("w", F.greatest(at - offset, F.lit(0)) + 1, length) == F.col("win")
    hits = here.join(small(ranked), "word").where(bounds & same)
    hits = hits.select("k1", "k2", (at - offset).alias("start"), length.alias("length"), "win")
    return hits.join(small(wins) if few else wins, "win").select("k1", "k2", "start", "length", "item").distinct()


def _key(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that name a row by its id and text, also where either is null."""
    parts = [F.col(id_col).cast("string"), F.lit("|"), F.col(text_col)]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("second"), *parts).alias("k2")]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with n_words, n_hit (words inside any occurrence of a window), items (sorted ids, as strings, of
    items with occurring windows), spans (occurrences as start and length, sorted) and contaminated.

    Null and empty texts have no words and no hits; null ids are kept. Rows alike in id and text get the same result each.
    Items alike in text are all reported; items without words never are. With no items or no documents nothing is hit.
    Other columns stay; if one has the name of an added column it is an error.
    """
    added = ["n_words", "n_hit", "items", "spans", "contaminated"]
    if clash := {"k1", "k2", *added} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    found = find_windows(docs, items, window, id_col, text_col, item_col, item_text_col)
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    hits = (
        found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
        .withColumn("n_hit", F.size(F.array_distinct(places)).cast("long")).withColumn("spans", F.sort_array("spans"))
    )
    base = docs.select("*", *_key(id_col, text_col), F.size(words(text_col)).cast("long").alias("n_words"))
    out = base.join(hits, ["k1", "k2"], "left")
    none = F.coalesce("n_hit", F.lit(0))
    return out.select(*docs.columns, "n_words", none.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"), (none > 0).alias("contaminated"))
