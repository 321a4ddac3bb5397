"""Line dedup by content-defined chunks of lines, DataFrame functions only.

A text falls into lines: physical lines, cut again after sentence ends. Each line has a hash; a rolling hash over the last
few line hashes decides whether a chunk ends there, so that a passage is cut alike wherever it stands, but for its first
lines. Chunks found in more than one document are repeated. Each occurrence but the first (smallest id, then place) is
compared byte by byte with the first; where it is equal, the lines on both sides are compared too, up to the next chunk,
which recovers the ends of a passage that fell into chunks with foreign lines. What is equal goes, if it is long enough.

Only hashes are counted over the corpus. Texts move once, by row; Spark reuses that exchange for comparing and for removing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A chunk ends where the rolling hash is 0 modulo this.
DIVISOR = 2
#: Line hashes in the rolling hash.
ROLL = 2
#: A line of so many words is a chunk of its own.
LONG_LINE = 25
#: Shortest run that is removed, in words.
MIN_WORDS = 25
#: Shortest chunk that is looked up in other documents, in words.
SEED_WORDS = 6
#: Stands for an anchor that a text has twice.
TWICE = -1
#: Groups of the rows that share an anchor or a run.
SALTS = 256
#: Repeated anchors of a text beyond which all of its runs are looked up.
MANY_ANCHORS = 300
_CUT = "(?<=\\n)|(?<=[.!?] )"
_MARK = "\x01"


def split_lines(text: Column) -> Column:
    """Lines of a text, cut after line breaks and sentence ends; they join to the text again.

    Literal replacements and a split at one character are far cheaper than the pattern, which stays for texts with that character.
    A search is cheaper than a replacement: the rarer ends are replaced where a text has them."""

    def mark(marked: Column, *ends: str) -> Column:
        for end in ends:
            marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
        return marked

    most = mark(text, "\n", ". ")
    marked = F.when(F.contains(text, F.lit("! ")) | F.contains(text, F.lit("? ")), mark(most, "! ", "? ")).otherwise(most)
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, _CUT)).otherwise(F.split(marked, _MARK))


def _bare(line: Column) -> Column:
    """A line's bytes without what ends it: its line break and blanks, which differ where a passage ends a text or not.

    A line break is always a line's last character."""
    return F.rtrim(F.when(F.endswith(line, F.lit("\n")), F.replace(line, F.lit("\n"), F.lit(""))).otherwise(line))


def _n_words(line: Column) -> Column:
    """Spaces and 1: cheap, and alike for equal lines."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _sum_words(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda a, x: a + _n_words(_bare(x)))


def chunks(df: DataFrame, text_col: str = "text", divisor: int = DIVISOR, roll: int = ROLL, long_line: int = LONG_LINE) -> DataFrame:
    """Add lines (array of strings that join to the text), h (their hashes) and ch (chunks as first, last, hash)."""
    df = df.withColumn("lines", split_lines(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn("h", F.transform("lines", lambda x: F.xxhash64(_bare(x))))
    df = df.withColumn("long", F.transform("lines", lambda x: F.when(F.octet_length(x) < 2 * long_line - 1, F.lit(False)).otherwise(_n_words(_bare(x)) >= long_line)))

    def rolled(i: Column) -> Column:
        r = F.col("h")[i]
        for k in range(1, roll):
            r = r.bitwiseXOR(F.when(i >= k, F.shiftleft(F.get("h", i - k), k)).otherwise(F.lit(0)))
        return F.pmod(F.shiftright(r, 7), F.lit(divisor)) == 0

    n = F.size("lines")
    last = lambda i: (i == n - 1) | F.col("long")[i] | F.coalesce(F.get("long", i + 1), F.lit(False)) | rolled(i)
    df = df.withColumn("ends", F.filter(F.sequence(F.lit(0), n - 1), last))
    first = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("ends", k - 1) + 1)
    ch = F.transform("ends", lambda e, k: F.struct(first(k).alias("first"), e.alias("last"), F.xxhash64(F.slice("h", first(k) + 1, e - first(k) + 1)).alias("hash")))
    return df.withColumn("ch", ch).drop("ends")


def _row_key(id_col: str, text_col: str) -> list[Column]:
    parts = [F.col(id_col).cast("string"), F.lit("|"), F.col(text_col)]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("second"), *parts).alias("k2")]


def _common(mine: str, theirs: str) -> Column:
    """Number of equal leading lines of two arrays."""
    n = F.least(F.size(mine), F.size(theirs))
    unlike = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.col(mine)[i] != F.col(theirs)[i])
    return F.when(F.size(unlike) > 0, unlike[0]).otherwise(n)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, divisor: int = DIVISOR, roll: int = ROLL, long_line: int = LONG_LINE, seed_words: int = SEED_WORDS) -> DataFrame:
    """All rows of ``docs``, their texts without repeated passages, and removed (line ranges as first and last, merged).

    A chunk of two lines or more, or of one long line, with ``seed_words`` words is looked up in all documents. Order of
    documents: ``id_col`` ascending, a null id last; the first occurrence of a passage stays, also within a document. Rows
    alike in id and text are one document given again: all keep the same text. Null texts stay null, empty ones empty; a
    text all of which goes becomes empty. Runs under ``min_words`` words stay. Other columns stay as they are; none may be
    called removed. An empty table gives an empty table.
    """
    if clash := {"removed", "k1", "k2", "lines", "h", "ch", "long"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    settings = (text_col, divisor, roll, long_line)
    # Chunks worth looking up, as hashes. The outer form of explode keeps Spark from adding a filter that would be pushed
    # down and compute every array again for each of its elements.
    cut = chunks(docs.select(id_col, text_col, *_row_key(id_col, text_col)), *settings)
    worth = lambda c: ((c["last"] > c["first"]) | F.col("long")[c["first"]]) & (_sum_words(F.slice("lines", c["first"] + 1, c["last"] - c["first"] + 1)) >= seed_words)
    seeds = F.filter(F.transform("ch", lambda c, k: F.struct(k.alias("k"), F.when(worth(c), c["hash"]).alias("hash"))), lambda s: s["hash"].isNotNull())
    some = materialize(cut.withColumn("seeds", seeds).select(id_col, "k1", "k2", F.explode_outer("seeds").alias("s")).select(id_col, "k1", "k2", "s.k", "s.hash"), "line-seeds").where("hash IS NOT NULL")
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("k1"), F.col("k2"), F.col("k"))
    repeated = some.groupBy("hash").agg(F.min(place).alias("kept"), F.max(place).alias("top")).where("kept <> top").select("hash", F.col("kept.k1").alias("o1"), F.col("kept.k2").alias("o2"), F.col("kept.k").alias("o"))
    met = some.select(id_col, "k1", "k2", "k", "hash").join(repeated, "hash")
    seen = F.sort_array(F.collect_set(F.struct("k", "hash", "o1", "o2", "o")))
    marked = materialize(met.groupBy("k1", "k2").agg(F.min(id_col).alias("id"), seen.alias("seen")), "line-repeats")
    # Bytes of the repeated chunks. Those around them come along where they aren't looked up against the same place.
    keyed = docs.select(*docs.columns, *_row_key(id_col, text_col))
    # Both joins by row have the same keys, the id too, so that the exchange of the texts can be one.
    on = lambda a, b: (a["k1"] == b["k1"]) & (a["k2"] == b["k2"]) & a[id_col].eqNullSafe(b["id"])
    texts = keyed.select(id_col, text_col, "k1", "k2")
    cut = chunks(texts.join(marked, on(texts, marked)).select(texts["k1"], texts["k2"], "id", text_col, "seen"), *settings)
    span = lambda c: F.slice("lines", c["first"] + 1, c["last"] - c["first"] + 1)
    bare = lambda part: F.transform(part, lambda x: _bare(x))
    none = F.array().cast("array<string>")

    def part(s: Column, i: Column) -> Column:
        c = F.get("ch", s["k"])
        kept = (s["o1"] == F.col("k1")) & (s["o2"] == F.col("k2")) & (s["o"] == s["k"])
        beside = {}
        for name, step in (("before", -1), ("after", 1)):
            other = F.get("ch", s["k"] + step)
            there = F.when(s["k"] + step < 0, False).otherwise(other.isNotNull())
            next_seen = F.when(i + step < 0, F.lit(None)).otherwise(F.get("seen", i + step))
            # The neighbour is looked up at the neighbouring place itself: only its size counts here.
            along = ~kept & F.coalesce((next_seen["k"] == s["k"] + step) & (next_seen["o"] == s["o"] + step) & (next_seen["o1"] == s["o1"]) & (next_seen["o2"] == s["o2"]), F.lit(False))
            lines = bare(span(other))
            beside[name] = F.when(~there | along, none).otherwise(F.reverse(lines) if step < 0 else lines)
            beside[name + "_words"] = F.when(there & along, _sum_words(span(other))).otherwise(0)
        return F.struct(s["hash"].alias("hash"), kept.alias("kept"), c["first"].alias("first"), c["last"].alias("last"), bare(span(c)).alias("body"), *[v.alias(k) for k, v in beside.items()])

    one = cut.withColumn("parts", F.transform("seen", part)).select("k1", "k2", "id", F.explode_outer("parts").alias("p")).select("k1", "k2", "id", "p.*")
    first_ones = one.where("kept").groupBy("hash").agg(F.first(F.struct("body", "before", "after")).alias("o"))  # rows given again have it more than once
    others = one.where("NOT kept").join(first_ones, "hash").where("body = o.body")
    others = others.withColumn("up", _common("before", "o.before")).withColumn("down", _common("after", "o.after"))
    size = _sum_words(F.col("body")) + F.col("before_words") + F.col("after_words") + _sum_words(F.slice("before", 1, F.col("up"))) + _sum_words(F.slice("after", 1, F.col("down")))
    others = others.select("k1", "k2", "id", "first", "last", "up", "down", size.alias("words"))
    gone = others.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.collect_set(F.when(F.col("words") >= min_words, F.struct((F.col("first") - F.col("up")).alias("first"), (F.col("last") + F.col("down")).alias("last")))).alias("ranges"))
    gone = gone.withColumn("removed", _merged("ranges")).select("k1", "k2", "id", "removed")
    out = keyed.join(gone, on(keyed, gone), "left").select(*(keyed[c] for c in docs.columns), "removed")
    return _without_removed(out, text_col, docs.columns)


_RANGES = "array<struct<first:int,last:int>>"


def _merged(ranges: str | Column) -> Column:
    """Ranges in order, those that touch or overlap as one."""
    joined = lambda a, r: F.when(F.size(a) == 0, F.array(r)).when(F.element_at(a, -1)["last"] + 1 >= r["first"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["first"].alias("first"), F.greatest(F.element_at(a, -1)["last"], r["last"]).alias("last"))))).otherwise(F.concat(a, F.array(r)))
    return F.aggregate(F.sort_array(ranges), F.array().cast(_RANGES), joined)


def _without_removed(out: DataFrame, text_col: str, columns: list[str]) -> DataFrame:
    """Texts of what lies between the ranges of removed, which is an empty array where it was null."""

    def kept_of(lines: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform("removed", lambda r: r["last"] + 1))
        stops = F.concat(F.transform("removed", lambda r: r["first"]), F.array(F.size(lines)))
        return F.array_join(F.transform(F.arrays_zip(begins.alias("b"), stops.alias("e")), lambda z: F.array_join(F.slice(lines, z["b"] + 1, F.greatest(z["e"] - z["b"], F.lit(0))), "")), "")

    left = F.transform(F.array(split_lines(F.col(text_col))), kept_of)[0]  # a lambda's variable is computed once
    text = F.when(F.coalesce(F.size("removed"), F.lit(0)) <= 0, F.col(text_col)).otherwise(left)
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in columns], F.coalesce("removed", F.array().cast(_RANGES)).alias("removed"))


def _lines_of(df: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """Add bare (lines in their bare forms), of and begins (the line of each word, and the first word of each line) and anchors.

    A line's anchor names the shortest run of lines with ``min_words`` words that begins there: the rolling hash of its
    first two lines, or the hash of its one line; null where too few words are left."""
    df = df.withColumn("bare", F.transform(split_lines(F.coalesce(F.col(text_col), F.lit(""))), lambda x: _bare(x)))
    df = df.withColumn("h", F.transform("bare", lambda x: F.xxhash64(x)))
    # With the line of each word sums of words are looked up. More words of a line than asked for make no difference.
    df = df.withColumn("of", F.flatten(F.transform("bare", lambda x, i: F.array_repeat(i, F.least(_n_words(x), F.lit(min_words)).cast("int")))))
    df = df.withColumn("begins", F.array_compact(F.transform("of", lambda i, p: F.when((p == 0) | (i != F.get("of", p - 1)), p))))
    last = lambda b: F.get("of", b + (min_words - 1))
    anchor = lambda b, i: F.when(last(b) == i, F.get("h", i)).when(last(b).isNotNull(), F.xxhash64(F.get("h", i), F.get("h", i + 1)))
    return df.withColumn("anchors", F.transform("begins", anchor)).drop("h")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows of ``docs``, their texts without repeated passages, and removed (line ranges as first and last, merged).

    Each line that is in a run of lines of ``min_words`` words or more that stands at an earlier place goes, however the run
    lies in either text. Lines are equal if their bytes are, but for the line break and blanks that end them. Order of
    places: ``id_col`` ascending, a null id last, then by line; the first occurrence stays, also within a document, where
    only what lies behind it goes. Rows alike in id and text are one document given again: all keep the same text. Null
    texts stay null, empty ones empty; a text all of which goes becomes empty. Other columns stay as they are. An empty
    table gives an empty table.

    Anchors of runs are looked up first. Only runs whose anchor is repeated are gathered, one of each kind in a text, by 128
    bits of the SHA-256 of their bytes. Places meet in two steps, first in one of SALTS groups of an anchor or a run, where
    all but the first are settled, then the first ones of all groups: so no line is too common for a task.
    """
    if clash := {"removed", "k1", "k2", "bare", "h", "of", "begins", "anchors", "seen", "again", "g1", "g2"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    keyed = docs.select(*docs.columns, *_row_key(id_col, text_col))
    # A row for each distinct anchor of a text, and one with TWICE where an anchor stands twice in it. k1 alone names the
    # text here: two texts with one k1 would only be looked at more closely than needed.
    runs = _lines_of(docs.select(text_col, _row_key(id_col, text_col)[0]), text_col, min_words).select("k1", F.array_compact("anchors").alias("all"))
    runs = runs.withColumn("distinct", F.array_distinct("all"))
    runs = runs.select("k1", F.when(F.size("distinct") < F.size("all"), F.concat(F.array(F.lit(TWICE)), "distinct")).otherwise(F.col("distinct")).alias("anchors"))
    # The outer form of explode keeps Spark from adding a filter that computes every array again.
    some = runs.select("k1", F.explode_outer("anchors").alias("anchor")).where("anchor IS NOT NULL")
    salt = F.pmod("k1", F.lit(SALTS))
    near = Window.partitionBy("anchor", salt).orderBy("k1")
    some = some.select("*", F.lag("k1").over(near).isNotNull().alias("again"), F.lead("k1").over(near).isNotNull().alias("more"))
    far = Window.partitionBy("anchor", F.when(F.col("again"), salt).otherwise(-1)).orderBy("k1")
    met = some.select("k1", "anchor", (F.col("again") | F.col("more") | F.coalesce(F.lag("k1").over(far), F.lead("k1").over(far)).isNotNull()).alias("repeated"))
    met = met.where(F.col("repeated") | (F.col("anchor") == TWICE)).groupBy("k1").agg(F.collect_set("anchor").alias("seen"))
    marked = materialize(met, "line-repeats")
    # Runs whose anchor is repeated. Of texts with very many repeated anchors all runs are taken: a lookup in a long array is slow.
    texts = keyed.select(id_col, text_col, "k1", "k2")
    runs = texts.join(marked, "k1").select("k1", "k2", id_col, text_col, "seen", F.array_contains("seen", F.lit(TWICE)).alias("again"))
    runs = _lines_of(runs, text_col, min_words)
    runs = runs.withColumn("met", F.transform("anchors", lambda a: a.isNotNull() & (F.col("again") | (F.size("seen") > MANY_ANCHORS) | F.array_contains("seen", a))))
    # The shortest runs from each line on, and those up to each line that are none of them: their union covers every longer
    # run, wherever it begins. What a run is depends on its own lines alone.
    down = lambda i: F.get("of", F.get("begins", i) + (min_words - 1))
    up = lambda i: F.get("of", F.coalesce(F.get("begins", i + 1), F.size("of")) - min_words)
    from_line = F.filter(F.transform("met", lambda m, i: F.when(m, F.struct(i.alias("first"), down(i).alias("last")))), lambda s: s.isNotNull())
    to_line = F.filter(F.transform("begins", lambda b, i: F.struct(up(i).alias("first"), i.alias("last"))), lambda s: F.coalesce(F.get("met", s["first"]), F.lit(False)) & (down(s["first"]) != s["last"]))
    wanted = F.concat(from_line, to_line)
    body = lambda s: F.array_join(F.slice("bare", s["first"] + 1, s["last"] - s["first"] + 1), "\n")
    digest = lambda body: F.unhex(F.substring(F.sha2(body, 256), 1, 32))
    wanted = F.transform(wanted, lambda s: F.struct(digest(body(s)).alias("digest"), s["first"].alias("first"), s["last"].alias("last")))
    mark = F.unhex(F.sha2(F.concat_ws("/", "k1", "k2"), 256))  # of no run: these entries needn't meet
    entry = lambda s, own: F.struct(*([s[c].alias(c) for c in ("digest", "first", "last")] if s is not None else [mark.alias("digest"), *[F.lit(None).cast("int").alias(c) for c in ("first", "last")]]), own.alias("own"))

    def once(runs: Column) -> Column:
        """The first run of each kind in the text, and an entry of what later ones cover behind the one before them."""

        def split(r: Column) -> Column:
            again = lambda s, i: F.when(i == 0, False).otherwise(s["digest"] == F.get(r, i - 1)["digest"])
            behind = F.transform(r, lambda s, i: F.when(again(s, i), F.struct(F.greatest(s["first"], F.get(r, i - 1)["last"] + 1).alias("first"), s["last"].alias("last"))))
            behind = F.filter(behind, lambda x: x["first"] <= x["last"])
            return F.concat(F.transform(F.filter(r, lambda s, i: ~again(s, i)), lambda s: entry(s, F.lit(None).cast(_RANGES))), F.array(entry(None, _merged(behind))))

        return F.transform(F.array(F.sort_array(runs)), split)[0]

    wanted = F.when(F.col("again"), once(wanted)).otherwise(F.transform(wanted, lambda s: entry(s, F.lit(None).cast(_RANGES))))
    run = runs.withColumn("wanted", wanted).select(F.col(id_col).alias("id"), "k1", "k2", F.explode_outer("wanted").alias("s")).where("s IS NOT NULL").select("id", "k1", "k2", "s.*")
    # Places come in order of documents: a text has one entry of a kind of run.
    order = (F.col("id").asc_nulls_last(), "k1", "k2")
    run = run.withColumn("later", F.rank().over(Window.partitionBy("digest", salt).orderBy(*order)) > 1)
    run = run.withColumn("later", F.col("later") | (F.rank().over(Window.partitionBy("digest", F.when(F.col("later"), salt).otherwise(-1)).orderBy(*order)) > 1))
    run = run.where("later OR own IS NOT NULL")
    gone = run.groupBy("k1", "k2").agg(F.collect_set(F.when(F.col("own").isNull(), F.struct("first", "last"))).alias("ranges"), F.collect_set("own").alias("own"))
    gone = gone.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), _merged(F.concat("ranges", F.flatten("own"))).alias("removed"))
    # Dealt by k1 alone, as above, so that the exchange of the texts is the same.
    same = (F.col("k1") == F.col("g1")) & (F.col("k2").bitwiseXOR(F.col("g2")) == 0)
    out = keyed.join(gone, same, "left").select(*docs.columns, "removed")
    return _without_removed(out, text_col, docs.columns)
