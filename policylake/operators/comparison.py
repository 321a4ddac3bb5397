"""Document comparison: pages and metadata by full joins, similarity by matching blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lex
from ..functions.rules import names_attribute
from ..functions.text import WIDE_SPACE, col, has_any, word_jaccard
from . import matching

NOISE_RATIO = 0.85
#: Documents with different titles and a similarity below this are different documents.
DIFFERENT_RATIO = 0.25


def bare(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), WIDE_SPACE + "+", " "))


def is_ocr_noise(ratio: str | Column, changed: str | Column) -> Column:
    """Very similar texts whose differing words have no digit and name no attribute."""
    return F.coalesce(col(ratio) >= NOISE_RATIO, F.lit(False)) & ~F.exists(col(changed), lambda d: d.rlike("\\d") | names_attribute(d))


def compare_pages(old: DataFrame, new: DataFrame, pair: str = "pair") -> DataFrame:
    """Pages (pair, page_number, text) of two versions: status (added, removed, unchanged, modified), ocr_noise and ratio.

    All page numbers of either side count. Only pairs of pages that differ meet the costly matcher: others go there without text."""
    j = old.select(pair, "page_number", F.col("text").alias("old")).join(new.select(pair, "page_number", F.col("text").alias("new"), F.lit(True).alias("here")), [pair, "page_number"], "full")
    gone, come = F.col("here").isNull(), F.col("old").isNull()
    j = j.withColumn("quick", F.when(gone, "removed").when(come, "added").when(bare("old") == bare("new"), "unchanged"))
    text = lambda c: F.when(F.col("quick").isNull(), bare(c)).alias(c)
    found = matching.similarity(j.select(F.struct(pair, "page_number", "quick").alias("at"), text("old"), text("new")), "at", "old", "new", words_from=NOISE_RATIO).select("at.*", "ratio", "changed")
    hard = F.col("quick").isNull()
    noise = hard & is_ocr_noise("ratio", "changed")
    status = F.when(noise, "unchanged").when(hard, "modified").otherwise(F.col("quick"))
    return found.select(pair, "page_number", status.alias("status"), noise.alias("ocr_noise"), F.when(hard, F.col("ratio")).when(F.col("quick") == "unchanged", 1.0).otherwise(0.0).alias("ratio"))


def page_counts(pages: DataFrame, pair: str = "pair") -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(f"pages_{s}")
    return pages.groupBy(pair).agg(n("added"), n("removed"), n("modified"), n("unchanged"), F.count_if("ocr_noise").alias("pages_noise"))


def metadata_changes(old: DataFrame, new: DataFrame, pair: str = "pair", meta: str = "meta") -> DataFrame:
    """Keys of two string maps whose values differ; a key of one side alone has null on the other."""
    side = lambda df, name: df.select(pair, F.explode_outer(F.map_entries(meta)).alias("e")).where("e IS NOT NULL").select(pair, F.col("e.key").alias("key"), F.col("e.value").alias(name))
    j = side(old, "old_value").join(side(new, "new_value"), [pair, "key"], "full")
    return j.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def document_verdict(hash_equal: Column, jaccard: Column, ratio: Column, titles_differ: Column, changed: Column, noise_only: Column) -> Column:
    """identical, unchanged, different_document or possible_change, as the first that holds."""
    different = (titles_differ & (jaccard < 0.35)) | (jaccard < 0.15) | (titles_differ & (ratio < DIFFERENT_RATIO))
    return F.when(F.coalesce(hash_equal, F.lit(False)), "identical").when(~changed, "unchanged").when(different, "different_document").when(noise_only, "unchanged").otherwise("possible_change")


#: Relevance of documents and of rules, least first; the orders differ.
DOCUMENT_RELEVANCE = ["none", "uncertain", "potentially_relevant", "clearly_relevant"]
RULE_RELEVANCE = ["none", "potentially_relevant", "uncertain", "clearly_relevant"]


def strongest(values: str | Column, order: list[str]) -> Column:
    """An aggregate: the strongest of the values."""
    ranks = F.array_position(F.array(*map(F.lit, order)), col(values))
    return F.element_at(F.array(*map(F.lit, order)), F.greatest(F.max(ranks), F.lit(1)).cast("int"))


def rows_of_table(cells: DataFrame, table: str, limit: float = 15.0) -> DataFrame:
    """Cells (table, x, y, …) into rows: in order of y, a row ends where y is more than ``limit`` from the row's first cell.

    The break depends on the row's start, not on the cell before. A fold over a page's table finds the starts alone, one number
    a row; cells find their row by counting the starts up to them. Cells without y come first and are in row 0."""
    heights = cells.groupBy(table).agg(F.array_sort(F.collect_set(F.col("y").cast("double"))).alias("heights"))
    starts = F.aggregate("heights", F.array().cast("array<double>"), lambda s, y: F.when((F.size(s) == 0) | (y - F.element_at(s, -1) > limit), F.concat(s, F.array(y))).otherwise(s))
    rows = heights.select(F.col(table).alias("_table"), F.posexplode_outer(starts).alias("_row", "_start"))
    # Starts lie more than ``limit`` apart, so that a cell's is in its slice of that height or in the one before.
    slice_of = lambda c: F.floor(F.col(c) / F.lit(limit))
    near = rows.select("_table", "_row", "_start", F.explode(F.array(slice_of("_start"), slice_of("_start") + 1)).alias("_slice"))
    found = near.groupBy("_table", "_slice").agg(F.collect_list(F.struct("_start", "_row")).alias("_starts"))  # at most three
    out = cells.join(found, cells[table].eqNullSafe(F.col("_table")) & (slice_of("y") == F.col("_slice")), "left")
    row = F.array_max(F.filter("_starts", lambda s: s["_start"] <= F.col("y").cast("double")))["_row"]
    return out.select(table, F.coalesce(row, F.lit(0)).alias("row_index"), *[c for c in cells.columns if c != table])


def document_context(blocks: DataFrame, doc: str, page: str, place: str, text: str, most: int = 12_000, cut: str = "\n... [truncated]") -> DataFrame:
    """(doc, context): the texts of a document's blocks in order of page and place, a line each, a heading before each page, up to
    ``most`` characters, the block that crosses the limit cut there and marked.

    Lengths are added up by page first; blocks of pages that begin beyond the limit are never put in order, and no more text
    than the limit is gathered for a document. Null texts are empty; a document without a block has no row."""
    rows = blocks.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(place).alias("place"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    heading = F.concat(F.lit("--- Page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(" ---\n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    pages = rows.groupBy("doc", "page").agg(F.sum(F.length("text") + 1).alias("n"))
    begin = F.coalesce(F.sum(F.col("n") + F.length(heading)).over(before(Window.partitionBy("doc").orderBy("page"))), F.lit(0))
    total = F.sum(F.col("n") + F.length(heading)).over(Window.partitionBy("doc"))
    kept = pages.select(F.col("doc").alias("_doc"), F.col("page").alias("_page"), begin.alias("begin"), total.alias("total")).where(F.col("begin") < most + 1)
    some = rows.join(kept, F.col("doc").eqNullSafe(F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page"))).drop("_doc", "_page")
    in_page = Window.partitionBy("doc", "page").orderBy("place", "text")
    some = some.withColumns({"first": F.row_number().over(in_page) == 1, "at": F.col("begin") + F.coalesce(F.sum(F.length("text") + 1).over(before(in_page)), F.lit(0))})
    some = some.withColumn("at", F.when(F.col("first"), F.col("at")).otherwise(F.col("at") + F.length(heading)))
    piece = F.concat(F.when(F.col("first"), heading).otherwise(""), F.col("text"), F.lit("\n"))
    pieces = some.where(F.col("at") < most).withColumn("piece", F.substring(piece, F.lit(1), (most - F.col("at")).cast("int")))
    order = F.array_sort(F.collect_list(F.struct("at", "piece")))
    joined = pieces.groupBy("doc").agg(F.array_join(F.transform(order, lambda p: p["piece"]), "").alias("joined"), F.max("total").alias("total"))
    # The line break after the last block isn't part of the text.
    whole = F.when(F.col("total") - 1 > most, F.concat("joined", F.lit(cut))).otherwise(F.regexp_replace("joined", "\n\\z", ""))
    return joined.select(F.col("doc").alias(doc), whole.alias("context"))


def compare_documents(old: DataFrame, new: DataFrame, old_pages: DataFrame, new_pages: DataFrame, pair: str = "pair") -> DataFrame:
    """Two versions of a document each: documents (pair, sha256, title, meta), pages (pair, page_number, text). A row per pair:
    status (identical, unchanged, different_document, possible_change), counts of pages, metadata_changes, jaccard, ratio,
    relevance, review_required and semantic_comparison_required.

    Pairs with equal hashes are identical; their pages are never looked at. Whole texts meet the costly matcher only where the
    verdict depends on it: pages differ, titles too, and words alone don't decide."""
    both = old.select(pair, F.col("sha256").alias("_h0"), F.lower("title").alias("_t0")).join(new.select(pair, F.col("sha256").alias("_h1"), F.lower("title").alias("_t1")), pair)
    differ = both.where(~F.coalesce(F.col("_h0") == F.col("_h1"), F.lit(False))).select(pair, (~F.col("_t0").eqNullSafe(F.col("_t1"))).alias("titles_differ"))
    counts = page_counts(compare_pages(old_pages.join(differ.select(pair), pair, "left_semi"), new_pages.join(differ.select(pair), pair, "left_semi"), pair), pair)
    changes = metadata_changes(old, new, pair).groupBy(pair).agg(F.count("*").alias("metadata_changes"))
    joined = lambda p: F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("t")))), lambda p: p["t"]), " "))
    whole = lambda pages, name: pages.join(differ.select(pair), pair, "left_semi").groupBy(pair).agg(joined(pages).alias(name))
    out = both.select(pair, F.coalesce(F.col("_h0") == F.col("_h1"), F.lit(False)).alias("equal")).join(differ, pair, "left").join(counts, pair, "left").join(changes, pair, "left")
    out = out.join(whole(old_pages, "_old"), pair, "left").join(whole(new_pages, "_new"), pair, "left")
    numbers = ["pages_added", "pages_removed", "pages_modified", "pages_unchanged", "pages_noise", "metadata_changes"]
    out = out.na.fill(0, numbers)
    asked = (F.col("pages_added") + F.col("pages_removed") + F.col("pages_modified") + F.col("pages_noise") > 0) & F.col("_old").isNotNull() & F.col("_new").isNotNull()
    out = out.withColumn("jaccard", F.when(asked, word_jaccard("_old", "_new")))
    costly = F.col("titles_differ") & (F.col("jaccard") >= 0.35) & (F.col("_old") != "") & (F.col("_new") != "")
    text = lambda c: F.when(costly, F.col(c)).alias(c)
    measured = matching.similarity(out.select(F.struct(pair, "equal", "titles_differ", *numbers, "jaccard", F.coalesce(costly, F.lit(False)).alias("costly")).alias("at"), text("_old"), text("_new")), "at", "_old", "_new", at_least=DIFFERENT_RATIO, words_from=2.0)
    # A bound below all limits decides as the ratio would.
    out = measured.select("at.*", F.when(F.col("at.costly"), F.coalesce("ratio", "bound")).alias("ratio"))
    substantive = F.col("pages_added") + F.col("pages_removed") + F.col("pages_modified") > 0
    changed, noise_only = substantive | (F.col("pages_noise") > 0), ~substantive & (F.col("pages_noise") > 0)
    status = document_verdict(F.col("equal"), F.coalesce("jaccard", F.lit(1.0)), F.coalesce("ratio", F.lit(1.0)), F.coalesce("titles_differ", F.lit(False)), changed, noise_only)
    out = out.withColumn("status", status)
    doubt = (F.col("status") == "different_document") | ((F.col("status") == "unchanged") & noise_only)
    # A page that was taken for noise is looked at again where others have changed in earnest.
    review = doubt | ((F.col("status") == "possible_change") & (F.col("pages_noise") > 0))
    return out.select(pair, "status", *numbers, "jaccard", "ratio", F.when(doubt, "uncertain").otherwise("none").alias("relevance"), review.alias("review_required"), (F.col("status") == "possible_change").alias("semantic_comparison_required"))


def interpreted(compared: DataFrame, sections: DataFrame, ask: Callable[[str], dict], pair: str = "pair") -> DataFrame:
    """Compared documents after a model has looked at those of which a semantic comparison is required: relevance and
    review_required by its checked changes, summary, and failed.

    ``sections``: pair, page_number, removed and added (matching.line_difference of differing pages). ``ask`` gets a pair's sections
    as one text and returns summary and changes (see checked_changes). Where it fails, the relevance is uncertain and a review is
    required. A pair without sections has nothing to be asked."""
    side = lambda c, name: F.concat(F.lit(f"{name}:\n"), F.array_join(c, "\n"))
    page = F.concat_ws("\n", F.concat(F.lit("Page "), F.col("page_number").cast("string")), side("removed", "old"), side("added", "new"))
    asked = sections.join(compared.where("semantic_comparison_required").select(pair), pair, "left_semi")
    texts = asked.groupBy(pair).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", page.alias("t")))), lambda p: p["t"]), "\n\n").alias("text"))
    fields = ["category", "eligibility_relevance", "affected_attribute", "old_evidence", "new_evidence", "description"]
    change = f"array<struct<{','.join(f'{f}:string' for f in fields)}>>"
    kind = compared.schema[pair].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b[pair], b["text"]):
                try:
                    said = ask(text)
                    rows.append((key, str(said.get("summary", "")), [{f: None if c.get(f) is None else str(c[f]) for f in fields} for c in said.get("changes", [])], False))
                except Exception as error:  # a model that fails leaves the pair to a reviewer
                    rows.append((key, f"{type(error).__name__}: {error}", [], True))
            yield pd.DataFrame(rows, columns=[pair, "summary", "changes", "failed"])

    answers = texts.mapInPandas(run, f"{pair} {kind}, summary string, changes {change}, failed boolean")
    each = answers.select(pair, "summary", "failed", F.explode_outer("changes").alias("c")).select(pair, "summary", "failed", "c.*")
    order = ["none", "uncertain", "potentially_relevant", "clearly_relevant"]
    said = checked_changes(each).groupBy(pair).agg(F.first("summary").alias("summary"), F.max("failed").alias("failed"), strongest("eligibility_relevance", order).alias("_relevance"), (F.count_if(F.col("eligibility_relevance") == "uncertain") > 0).alias("_doubt"))
    out = compared.join(said, pair, "left")
    relevance = F.when(F.col("failed"), "uncertain").when(F.col("_relevance").isNotNull(), F.col("_relevance")).otherwise(F.col("relevance"))
    review = F.col("review_required") | F.coalesce("failed", F.lit(False)) | F.coalesce("_doubt", F.lit(False))
    return out.withColumns({"relevance": relevance, "review_required": review, "failed": F.coalesce("failed", F.lit(False))}).drop("_relevance", "_doubt")


def checked_changes(changes: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Changes that a model has named (category, eligibility_relevance, affected_attribute, old_evidence, new_evidence,
    description), with what it mistook put right: instructions and notes of status that name no attribute of a candidate are
    none of eligibility; others have an attribute and a relevance."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("old_evidence", "new_evidence", "description")]))
    about = F.col("category").isin("eligibility_related", "exclusion_related")
    wrong = about & has_any(text, words or lex.ADMIN_STATUS) & ~names_attribute(text)
    named = None
    for name, marks in lex.AFFECTED:
        named = F.when(has_any(text, marks), name) if named is None else named.when(has_any(text, marks), name)
    kept = about & ~wrong
    return changes.withColumns(
        {
            "category": F.when(wrong, F.when(has_any(text, lex.STATUS_WORDS), "document_status").otherwise("procedural")).otherwise(F.col("category")),
            "affected_attribute": F.when(kept & (F.coalesce("affected_attribute", F.lit("")) == ""), named).otherwise(F.col("affected_attribute")),
            "eligibility_relevance": F.when(wrong, "none").when(kept & ~F.coalesce(F.col("eligibility_relevance").isin("clearly_relevant", "potentially_relevant"), F.lit(False)), "clearly_relevant").otherwise(F.col("eligibility_relevance")),
        }
    )


def relevance_of_changes(changes: DataFrame, key: str) -> DataFrame:
    """Per document the strongest relevance of its checked changes, and whether a review is needed: one of them is uncertain."""
    order = ["none", "uncertain", "potentially_relevant", "clearly_relevant"]
    return changes.groupBy(key).agg(strongest("eligibility_relevance", order).alias("relevance"), (F.count_if(F.col("eligibility_relevance") == "uncertain") > 0).alias("review_required"))
