"""Matching blocks of two sequences, and what follows from them: similarity and differences of texts, lines and words.

The blocks are those of the recursive definition: the longest run that both have, the earliest in the first sequence and then in
the second; then the same on either side of it. Equal places are found by grouping on the elements, and runs of them along
diagonals by a window; what is left is a choice among few runs, a fold over one row. A second sequence of AUTOJUNK elements or
more has popular ones, more than 1 % of it: a run may not rest on them alone, it is only continued by them. Where no run is left,
what both sides begin with is a block.

A sequence is a cell of its row, so that whatever is gathered for a row is of the size of what the row holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a second sequence from which on its popular elements start no run.
AUTOJUNK = 200
_RUN = "struct<i:int,d:int,n:int>"
_SEGMENT = f"struct<al:int,ah:int,bl:int,bh:int,runs:array<{_RUN}>>"
_STATE = f"struct<todo:array<{_SEGMENT}>,done:array<struct<i:int,j:int,n:int>>>"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def characters(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))


def _common(a: Column, b: Column, i: Column, j: Column, most: Column) -> Column:
    """How many elements, up to ``most``, are equal from a[i] and b[j] on (from 0): found by halves, comparing slices."""
    n_powers = F.log2(F.greatest(most, F.lit(1))).cast("int") + 1
    powers = F.slice(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), -n_powers, n_powers)

    def step(n: Column, p: Column) -> Column:
        return F.when((n + p <= most) & (F.slice(a, i + n + 1, p) == F.slice(b, j + n + 1, p)), n + p).otherwise(n)

    return F.aggregate(powers, F.lit(0), step)


def runs(pairs: DataFrame) -> DataFrame:
    """(_key, runs) of (_key, a, b): maximal runs (i, d, n) of equal elements that may start a block, a[i + k] = b[i - d + k]."""
    key = "_key"
    placed = lambda c, side: F.transform(c, lambda t, at: F.struct(t.alias("token"), F.lit(side).alias("side"), at.alias("at")))
    tokens = pairs.select(key, F.size("b").alias("n_b"), F.explode(F.concat(placed("a", 0), placed("b", 1))).alias("t")).select(key, "n_b", "t.*")
    places = lambda side, name: F.collect_list(F.when(F.col("side") == side, F.col("at"))).alias(name)
    shared = tokens.groupBy(key, "token").agg(F.first("n_b").alias("n_b"), places(0, "is"), places(1, "js"))
    shared = shared.where((F.size("is") > 0) & (F.size("js") > 0) & ((F.col("n_b") < AUTOJUNK) | (F.size("js") <= F.floor(F.col("n_b") / 100) + 1)))
    met = shared.select(key, "js", F.explode("is").alias("i")).select(key, "i", F.explode("js").alias("j")).select(key, "i", (F.col("i") - F.col("j")).alias("d"))
    island = (F.col("i") - F.row_number().over(Window.partitionBy(key, "d").orderBy("i"))).alias("island")
    found = met.select(key, "d", "i", island).groupBy(key, "d", "island").agg(F.min("i").alias("i"), F.count("*").cast("int").alias("n"))
    return found.groupBy(key).agg(F.collect_list(F.struct("i", "d", "n")).alias("runs"))


def _chosen(segment: Column, state: Column, a: Column, b: Column, back: tuple[Column, Column]) -> Column:
    """The state after a segment: its best run, carried on as far as it goes, is a block; what lies beside it is to do."""
    low = lambda r: F.greatest(r["i"], segment["al"], segment["bl"] + r["d"])
    high = lambda r: F.least(r["i"] + r["n"], segment["ah"], segment["bh"] + r["d"])
    best = F.array_max(F.transform(segment["runs"], lambda r: F.struct((high(r) - low(r)).alias("n"), (-low(r)).alias("early"), r["d"].alias("d"))))
    rest = F.slice(state["todo"], 1, F.size(state["todo"]) - 1)

    def part(al: Column, ah: Column, bl: Column, bh: Column) -> Column:
        inside = lambda r: F.least(r["i"] + r["n"], ah, bh + r["d"]) > F.greatest(r["i"], al, bl + r["d"])
        return F.struct(al.alias("al"), ah.alias("ah"), bl.alias("bl"), bh.alias("bh"), F.filter(segment["runs"], inside).alias("runs"))

    def grown(r: Column) -> Column:
        i, e = -r["early"], r["n"] - r["early"]
        left = _common(*back, F.size(a) - i, F.size(b) - i + r["d"], F.least(i - segment["al"], i - r["d"] - segment["bl"]))
        right = _common(a, b, e, e - r["d"], F.least(segment["ah"] - e, segment["bh"] - e + r["d"]))
        return F.struct((i - left).alias("i"), (i - left - r["d"]).alias("j"), (left + r["n"] + right).alias("n"))

    def split(m: Column) -> Column:
        sides = F.array(part(segment["al"], m["i"], segment["bl"], m["j"]), part(m["i"] + m["n"], segment["ah"], m["j"] + m["n"], segment["bh"]))
        return F.struct(F.concat(rest, F.filter(sides, _whole)).alias("todo"), F.concat(state["done"], F.array(m)).alias("done")).cast(_STATE)

    def begun(n: Column) -> Column:
        block = F.struct(segment["al"].alias("i"), segment["bl"].alias("j"), n.alias("n"))
        return F.struct(rest.alias("todo"), F.when(n > 0, F.concat(state["done"], F.array(block))).otherwise(state["done"]).alias("done")).cast(_STATE)

    alike = _common(a, b, segment["al"], segment["bl"], F.least(segment["ah"] - segment["al"], segment["bh"] - segment["bl"]))
    return let(best, lambda r: F.when(r["n"] > 0, let(grown(r), split)).otherwise(let(alike, begun)))


def _whole(segment: Column) -> Column:
    return (segment["ah"] > segment["al"]) & (segment["bh"] > segment["bl"])


def matching_blocks(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, a, b, blocks) of rows with arrays ``a`` and ``b``: blocks (i, j, n), in order, are a[i:i+n] = b[j:j+n], places from 0.

    ``key`` names a row. Null arrays are empty; empty ones have no block."""
    none = F.array().cast("array<string>")
    pairs = pairs.select(F.col(key).alias("_key"), F.coalesce(a, none).alias("a"), F.coalesce(b, none).alias("b"))
    rows = pairs.join(runs(pairs), "_key", "left")
    x, y = F.col("a"), F.col("b")
    rows = rows.withColumns({"ra": F.reverse("a"), "rb": F.reverse("b"), "runs": F.coalesce("runs", F.array().cast(f"array<{_RUN}>"))})
    whole = F.struct(F.lit(0).alias("al"), F.size(x).alias("ah"), F.lit(0).alias("bl"), F.size(y).alias("bh"), F.col("runs").alias("runs"))
    start = F.struct(F.filter(F.array(whole), _whole).alias("todo"), F.array().alias("done")).cast(_STATE)
    step = lambda s, _: F.when(F.size(s["todo"]) == 0, s).otherwise(let(F.element_at(s["todo"], -1), lambda g: _chosen(g, s, x, y, (F.col("ra"), F.col("rb")))))
    done = F.aggregate(F.sequence(F.lit(0), 4 * F.size("runs") + 2), start, step)["done"]
    return rows.select(F.col("_key").alias(key), "a", "b", F.array_sort(done).alias("blocks"))


def ratio(blocks: Column, a: Column, b: Column) -> Column:
    """Twice the matched elements over all elements; 1 if there are none."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.aggregate(blocks, F.lit(0), lambda s, m: s + m["n"]) / total)


def gaps(blocks: Column, a: Column, b: Column) -> Column:
    """What lies between the blocks: structs of the elements of a and of b there, empty on one side at most."""
    end = F.struct(F.size(a).alias("i"), F.size(b).alias("j"), F.lit(0).alias("n"))
    first = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))
    cut = F.zip_with(F.concat(F.array(first), blocks), F.concat(blocks, F.array(end)), lambda p, q: F.struct(*[F.slice(s, p[k] + p["n"] + 1, q[k] - p[k] - p["n"]).alias(name) for name, s, k in (("old", a, "i"), ("new", b, "j"))]))
    return F.filter(cut, lambda g: F.size(g["old"]) + F.size(g["new"]) > 0)


def ratio_bound(a: str, b: str) -> Column:
    """An upper bound of the ratio of two texts: what their characters have in common, wherever they stand."""
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(characters(a)), F.lit(0), lambda s, c: s + F.least(count(F.col(a), c), count(F.col(b), c)))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * shared / total)


def similarity(texts: DataFrame, key: str, old: str, new: str, at_least: float = 0.0, words_from: float = 0.0) -> DataFrame:
    """(key, bound, ratio, changed) of rows with two texts: the similarity from 0 to 1, and the words between matching words, a
    string for each place, where the ratio is ``words_from`` or more (else none).

    ``key`` names a row. Where the bound of a ratio is below ``at_least`` the texts aren't compared: the ratio is null. Null
    texts are empty; two empty texts have the ratio 1."""
    texts = texts.select(key, *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((old, "old"), (new, "new"))])
    near = texts.withColumn("bound", ratio_bound("old", "new") if at_least > 0 else F.lit(1.0))
    words = lambda c: F.filter(F.split(c, "\\s+"), lambda w: w != "")
    # Characters and words of a pair are two rows, matched in one go; texts that aren't asked for are empty there.
    levels = [F.struct(F.lit(k).alias("level"), cut("old").alias("a"), cut("new").alias("b")) for k, cut in enumerate((characters, words))]
    asked = F.when(F.col("bound") >= at_least, F.array(*levels[: 1 if words_from > 1 else 2])).otherwise(F.array(levels[0].withField("a", F.array().cast("array<string>")).withField("b", F.array().cast("array<string>"))))
    rows = near.select(key, "bound", F.explode(asked).alias("l")).select(F.struct(F.col(key).alias("key"), "bound", "l.level").alias("at"), "l.a", "l.b")
    found = matching_blocks(rows, "at", "a", "b").select("at.*", "a", "b", "blocks")
    between = F.transform(gaps(F.col("blocks"), F.col("a"), F.col("b")), lambda g: F.array_join(F.concat(g["old"], g["new"]), " "))
    of_chars = (F.col("level") == 0) & (F.col("bound") >= at_least)
    found = found.select(F.col("key").alias(key), "bound", F.when(of_chars, ratio(F.col("blocks"), F.col("a"), F.col("b"))).alias("ratio"), F.when(F.col("level") == 1, between).alias("changed"))
    out = found.groupBy(key).agg(F.max("bound").alias("bound"), F.max("ratio").alias("ratio"), F.first("changed", ignorenulls=True).alias("changed"))
    return out.withColumn("changed", F.when(F.col("ratio") >= words_from, F.coalesce("changed", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))


def line_difference(texts: DataFrame, key: str, old: str, new: str, most: int = 1200) -> DataFrame:
    """(key, removed, added, old, new): the lines that only one of two texts has, in order, and both as snippets of ``most``
    characters, the whole text where no line of it differs. Texts are trimmed first; null ones are empty and have no line."""
    trimmed = texts.select(key, *[F.trim(F.coalesce(F.col(c), F.lit("")), F.lit(" \t\n\r\x0b\x0c")).alias(n) for c, n in ((old, "old"), (new, "new"))])
    lines = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\r\n|[\n\r\x0b\x0c]")).alias(c)
    found = matching_blocks(trimmed.select(key, lines("old"), lines("new")), key, "old", "new")
    sides = found.select(key, gaps(F.col("blocks"), F.col("a"), F.col("b")).alias("g")).select(key, F.flatten("g.old").alias("removed"), F.flatten("g.new").alias("added"))
    cut = lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("... [truncated]"))).otherwise(t)
    part = lambda lines, text: cut(F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.col(text))).alias(text)
    return trimmed.join(sides, key).select(key, "removed", "added", part("removed", "old"), part("added", "new"))
