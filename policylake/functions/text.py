"""Text functions as columns: cleaning, usability, reliability, form labels, names, dates and versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lex

#: White space of any kind: as Unicode has it, and the information separators.
WIDE_SPACE = "(?U:[\\s\\x1c-\\x1f])"


#: The characters of WIDE_SPACE.
SPACES = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\x1c\x1d\x1e\x1f\x85"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it: a lambda's variable is, a column's expression isn't."""
    return F.transform(F.array(value), f)[0]


def any_of(words: list[str]) -> str:
    """A pattern of literal alternatives, as a tree of their beginnings: at each place of a text only the words that go on like
    it are looked at. A word that begins another one stands for both, as the pattern says whether any is there."""
    tree: dict = {}
    for w in words:
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}
    literal = lambda ch: "\\" + ch if ch in "\\.[]{}()*+-?^$|#&~" else ch

    def pattern(node: dict) -> str:
        if "" in node:
            return ""
        parts = []
        for ch, below in node.items():
            rest = literal(ch)
            while len(below) == 1 and "" not in below:  # one way on
                (ch, below), = below.items()
                rest += literal(ch)
            parts.append(rest + pattern(below))
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return pattern(tree)


def has_any(text: Column, words: list[str]) -> Column:
    """Does a (lower-cased) text contain any of the words."""
    return text.rlike(any_of(words))


def word_list(text: str | Column) -> Column:
    """Words between white space of any kind; none in an empty text."""
    return F.filter(F.split(F.trim(col(text)), WIDE_SPACE + "+"), lambda w: w != "")


def clean_title(text: str | Column) -> Column:
    """White space of any kind becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), WIDE_SPACE + "+", " "))


def stripped(text: str | Column) -> Column:
    """Nothing blank at the ends; null is empty."""
    return F.btrim(F.coalesce(col(text), F.lit("")), F.lit(SPACES))


def clean_page(text: str | Column) -> Column:
    """No control characters but tab and line ends, at most one blank line in a row, nothing blank at the ends."""
    t = F.replace(F.coalesce(col(text), F.lit("")), F.lit(" "), F.lit(" "))
    t = F.regexp_replace(t, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    t = F.regexp_replace(t, f"\\n{WIDE_SPACE}*\\n{WIDE_SPACE}*\\n+", "\n\n")
    return stripped(t)


def count_of(text: Column, literal: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))


def number_of(text: Column, characters: str) -> Column:
    """Number of characters of a class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))


def usability(text: str | Column, min_words: int = 10) -> Column:
    """A struct of the clean text, its number of words, and usable: enough words, and not mostly replacement characters."""

    def of(t: Column) -> Column:
        broken, words = count_of(t, "\ufffd"), F.size(word_list(t))
        enough = lambda n: F.struct(t.alias("clean"), n.alias("words"), ((n >= min_words) & ~((broken > 10) & (broken > 0.1 * F.length(t)))).alias("usable"))
        return once(words, enough)

    return once(clean_page(text), of)


def is_usable(text: str | Column, min_words: int = 10) -> Column:
    return usability(text, min_words)["usable"]


def reliability(text: str | Column, min_words: int = 10, vocabulary: list[str] | None = None, min_native: int = 25) -> Column:
    """A struct: reliable, score, action, encoding_issue and reasons (codes: empty, few_words, symbols, ligatures, vocabulary, ambiguous).

    Cascade: empty; too few words; enough native script; signals of a broken encoding; known words; else to be reviewed.
    What the cascade asks for is counted once for each text."""
    vocabulary = lex.COMMON_WORDS if vocabulary is None else vocabulary
    verdict = lambda ok, score, action, bad, *why: F.struct(
        F.lit(ok).alias("reliable"), (score if isinstance(score, Column) else F.lit(score)).cast("double").alias("score"), F.lit(action).alias("action"), F.lit(bad).alias("encoding_issue"),
        (F.array_compact(F.array(*why)) if why else F.array().cast("array<string>")).alias("reasons"),
    )

    def counts(t: Column) -> Column:
        words = word_list(t)
        # Letters of words: all but letters and blanks is taken out of the text before it is split.
        letters = F.split(F.lower(F.regexp_replace(t, "(?U:[^a-zA-Z\\s\\x1c-\\x1f]+)", "")), WIDE_SPACE + "+")
        return F.struct(
            (t == "").alias("empty"), F.greatest(F.length(t), F.lit(1)).alias("chars"), number_of(t, "\\u0c80-\\u0cff").alias("native"), number_of(t, "~`^_{}|\\\\;:$%@*<>\\[\\]+=").alias("marks"), number_of(t, "\\p{L}\\p{N}").alias("alnum"),
            t.rlike(lex.TORN_WORDS).alias("torn"), F.size(words).alias("words"), F.size(F.filter(words, lambda w: F.length(w) >= 2)).alias("long"), F.size(F.filter(letters, lambda w: w.isin(vocabulary))).alias("known"),
        )

    def cascade(c: Column) -> Column:
        symbols = c["marks"] / c["chars"]
        dense, torn, unknown = symbols > 0.035, c["torn"], (c["long"] >= 15) & (c["known"] < 3)
        fine = (c["known"] >= 3) | ((c["words"] >= 15) & (c["alnum"] > 0.70 * c["chars"]))
        return (
            F.when(c["empty"], verdict(False, 0.0, "RUN_OCR", False, F.lit("empty")))
            .when(c["words"] < min_words, verdict(False, 0.1, "RUN_OCR", False, F.lit("few_words")))
            .when((c["native"] >= min_native) & (c["native"] >= 0.15 * c["chars"]), verdict(True, 0.98, "USE_DIGITAL_TEXT", False))
            .when(dense | torn | unknown, verdict(False, F.greatest(F.lit(0.0), F.bround(0.40 - F.least(F.lit(0.40), symbols * 8), 2)), "RUN_OCR", True, F.when(dense, "symbols"), F.when(torn, "ligatures"), F.when(unknown, "vocabulary")))
            .when(fine, verdict(True, 0.95, "USE_DIGITAL_TEXT", False))
            .otherwise(verdict(False, 0.50, "REVIEW", False, F.lit("ambiguous")))
        )

    return once(once(stripped(text), counts), cascade)


def form_fields(text: str | Column, labels: list[tuple[str, str]] | None = None) -> Column:
    """Labels of form fields that a text has, in the order of the list."""
    t = F.coalesce(col(text), F.lit(""))
    return F.array_compact(F.array(*[F.when(t.rlike("(?i)" + pattern), F.lit(name)) for name, pattern in (lex.FORM_LABELS if labels is None else labels)]))


def table_form_fields(cells: str | Column, labels: list[tuple[str, str]] | None = None) -> Column:
    """Of rows (array of struct<col0, col1>): a struct of fields (label and value, null where the cell is empty; the first of
    each label) and blanks, the number of rows whose second cell is empty."""
    rows, labels = col(cells), lex.FORM_LABELS if labels is None else labels
    value = lambda r: F.nullif(F.trim(F.coalesce(r["col1"], F.lit(""))), F.lit(""))
    hits = F.flatten(F.transform(rows, lambda r: F.array_compact(F.array(*[F.when(F.trim(F.coalesce(r["col0"], F.lit(""))).rlike("(?i)" + p), F.struct(F.lit(name).alias("label"), value(r).alias("value"))) for name, p in labels]))))
    first = once(hits, lambda h: F.filter(h, lambda x, i: F.array_position(F.transform(h, lambda y: y["label"]), x["label"]) == i + 1))
    return F.struct(first.alias("fields"), F.size(F.filter(rows, lambda r: value(r).isNull())).alias("blanks"))


def is_form(fields: Column, blanks: Column | None = None) -> Column:
    n, blanks = F.size(fields), F.lit(0) if blanks is None else blanks
    return (n >= 3) | ((n >= 2) & (blanks >= 3))


def form_confidence(fields: Column, blanks: Column | None = None) -> Column:
    return F.least(F.lit(100.0), F.size(fields) * 20.0 + F.when((F.lit(0) if blanks is None else blanks) >= 3, 15.0).otherwise(0.0))


def page_type(usable: Column, form: Column, table: Column, blocks: Column) -> Column:
    """FORM, TABLE, SCANNED, MIXED or TEXT."""
    scanned = F.when(form, "FORM").when(table, "TABLE").otherwise("SCANNED")
    return F.when(~usable, scanned).when(table & (blocks > 5), "MIXED").when(table, "TABLE").when(form, "FORM").otherwise("TEXT")


def safe_filename(url: str | Column, file_hash: str | Column) -> Column:
    """A file's name: the first digits of its hash and the last part of the URL's path, with harmless characters, as .pdf."""
    path = F.coalesce(F.try_url_decode(F.replace(F.regexp_extract(F.regexp_replace(col(url), "[?#].*$", ""), "([^/]*)$", 1), F.lit("+"), F.lit("%2B"))), F.lit(""))
    name = F.regexp_replace(path, '[\\\\/*?:"<>| ]', "_")
    name = F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
    return F.concat(F.substring(col(file_hash), 1, 8), F.lit("_"), name)


def slug(name: str | Column) -> Column:
    text = F.trim(F.regexp_replace(F.lower(col(name)), "[^\\p{L}\\p{N}_\\s-]", ""))
    return F.coalesce(F.nullif(F.regexp_replace(text, "[\\s_-]+", "-"), F.lit("")), F.lit("unnamed-scheme"))


def find_date(text: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(text), "\\b(\\d{1,2}[-/.]\\d{1,2}[-/.]\\d{4}|\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2})\\b", 1), F.lit(""))


def iso_date(text: str | Column) -> Column:
    """d-m-Y, Y-m-d or d-m-y, with - or /, as a date; dots are not read."""
    t = F.replace(F.trim(col(text)), F.lit("/"), F.lit("-"))
    forms = [("^\\d{1,2}-\\d{1,2}-\\d{4}$", "d-M-yyyy"), ("^\\d{4}-\\d{1,2}-\\d{1,2}$", "yyyy-M-d"), ("^\\d{1,2}-\\d{1,2}-\\d{2}$", "d-M-yy")]
    return F.coalesce(*[F.when(t.rlike(p), F.try_to_date(t, f)) for p, f in forms])


def version_label(title: str | Column, url: str | Column, published: str | Column | None = None) -> Column:
    """Financial year, version, year, year of publication, or Initial."""
    t = F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(url), F.lit("")))
    found = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    year = F.lit(None).cast("string") if published is None else F.year(iso_date(published)).cast("string")
    return F.coalesce(F.translate(found("\\b(20\\d{2}[-_/]\\d{2,4})\\b"), "_/", "--"), F.replace(found("(?i)\\b(v(?:er)?\\.?\\s*\\d+(?:\\.\\d+)?)\\b"), F.lit(" "), F.lit("")), found("\\b(20[1-3]\\d)\\b"), year, F.lit("Initial"))


def word_jaccard(a: str | Column, b: str | Column) -> Column:
    """Similarity of the sets of lower-cased words; 0 if either has none."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))

    def of(w: Column) -> Column:
        shared = lambda n: F.when((F.size(w["x"]) == 0) | (F.size(w["y"]) == 0), 0.0).otherwise(n / (F.size(w["x"]) + F.size(w["y"]) - n))
        return once(F.size(F.array_intersect(w["x"], w["y"])), shared)

    return once(F.struct(words(a).alias("x"), words(b).alias("y")), of)
