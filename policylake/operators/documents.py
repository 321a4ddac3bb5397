"""Scanning documents: pages are read, classified, read by OCR where their text can't be used, and searched for forms; then a
summary of each document. Readers and OCR engines are providers; all else is columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..providers import OcrEngine, read_with_retry

#: A page read by OCR with a mean confidence below this has to be reviewed.
LOW_CONFIDENCE = 60.0


def classified(pages: DataFrame, labels: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pages (path, page_number, text, blocks, has_table) with clean, words, usable, needs_ocr, form_fields and page_type.

    A null text is empty and not usable; null blocks are none, a null has_table is no table."""
    text = F.coalesce("text", F.lit(""))
    out = pages.withColumns({"_u": X.usability(text), "form_fields": X.form_fields(text, labels)})
    kind = X.page_type(F.col("_u.usable"), X.is_form(F.col("form_fields")), F.coalesce("has_table", F.lit(False)), F.coalesce("blocks", F.lit(0)))
    return out.withColumns({"clean": F.col("_u.clean"), "words": F.col("_u.words"), "usable": F.col("_u.usable"), "needs_ocr": ~F.col("_u.usable"), "page_type": kind}).drop("_u")


def read_by_ocr(needed: DataFrame, files: DataFrame, make: Callable[[], OcrEngine]) -> DataFrame:
    """(path, page_number, ocr_text, avg_confidence, low_conf_percentage) of pages (path, page_number) of files (path, content).

    A file's content moves once, beside the numbers of its pages. A page whose reading fails, a second time too, has nulls."""
    asked = needed.groupBy("path").agg(F.sort_array(F.collect_set("page_number")).alias("page_numbers")).join(files.select("path", "content"), "path")
    columns = ["path", "page_number", "ocr_text", "avg_confidence", "low_conf_percentage"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for b in batches:
            rows = []
            for path, numbers, content in zip(b["path"], b["page_numbers"], b["content"]):
                for n in numbers:
                    try:
                        got = read_with_retry(engine, content, int(n))
                        rows.append((path, int(n), got.get("text", ""), float(got["avg_confidence"]), float(got["low_conf_percentage"])))
                    except (OSError, ValueError):  # the page stays without a text, to be reviewed
                        rows.append((path, int(n), None, None, None))
            yield pd.DataFrame(rows, columns=columns)

    return asked.mapInPandas(run, "path string, page_number int, ocr_text string, avg_confidence double, low_conf_percentage double")


def understood(pages: DataFrame, files: DataFrame, make: Callable[[], OcrEngine], labels: list[tuple[str, str]] | None = None) -> DataFrame:
    """All pages after classification and OCR: classified()'s columns with full_text (as read, or by OCR), extraction_method
    (direct, ocr or failed), the confidences (100 and 0 for direct ones), form_fields of the full text, and review_required."""
    seen = classified(pages, labels)
    found = read_by_ocr(seen.where("needs_ocr").select("path", "page_number"), files, make)
    out = seen.join(found, ["path", "page_number"], "left")
    full = F.when(F.col("needs_ocr"), X.clean_page("ocr_text")).otherwise(F.col("clean"))
    method = F.when(~F.col("needs_ocr"), "direct").when(F.col("ocr_text").isNull(), "failed").otherwise("ocr")
    out = out.withColumns({"full_text": full, "extraction_method": method})
    out = out.withColumns({
        "avg_confidence": F.when(~F.col("needs_ocr"), 100.0).otherwise(F.coalesce("avg_confidence", F.lit(0.0))),
        "low_conf_percentage": F.when(~F.col("needs_ocr"), 0.0).otherwise(F.coalesce("low_conf_percentage", F.lit(100.0))),
        "form_fields": F.when(F.col("needs_ocr"), X.form_fields("full_text", labels)).otherwise(F.col("form_fields")),
    })
    return out.withColumn("review_required", (F.col("extraction_method") == "failed") | (F.col("avg_confidence") < LOW_CONFIDENCE)).drop("ocr_text")


def summaries(scanned: DataFrame) -> DataFrame:
    """A row per path of what understood() has: pages, usable_pages, scanned_pages, table_pages, form_pages, ocr_performed,
    avg_confidence of the pages read by OCR (null without any), pages_to_review and the text of all pages in order."""
    kind = lambda t: F.count_if(F.col("page_type") == t)
    ocr = F.col("extraction_method") == "ocr"
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.col("full_text").alias("t")))), lambda p: p["t"]), "\n\n")
    return scanned.groupBy("path").agg(
        F.count("*").alias("pages"), F.count_if("usable").alias("usable_pages"), kind("SCANNED").alias("scanned_pages"), F.count_if(F.col("page_type").isin("TABLE", "MIXED")).alias("table_pages"),
        F.count_if(X.is_form(F.col("form_fields"))).alias("form_pages"), (F.count_if(ocr) > 0).alias("ocr_performed"), F.bround(F.avg(F.when(ocr, F.col("avg_confidence"))), 1).alias("avg_confidence"),
        F.count_if("review_required").alias("pages_to_review"), whole.alias("text"),
    )
