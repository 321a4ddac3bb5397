"""Metrics of extraction, traces and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 4, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(F.round(a / b, digits))


def precision_recall(df: DataFrame, keys: list[str], found: Column, gold: Column) -> DataFrame:
    """True positives, false positives, false negatives, precision, recall and F1; 0 where a denominator is."""
    found, gold = F.coalesce(found, F.lit(False)), F.coalesce(gold, F.lit(False))
    out = df.groupBy(*keys).agg(F.count_if(found & gold).alias("tp"), F.count_if(found & ~gold).alias("fp"), F.count_if(~found & gold).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def ocr_stats(words: DataFrame, keys: list[str], confidence: str, least: float = 50) -> DataFrame:
    """Mean confidence and share of words below ``least``, in percent, to one digit, halves to the even one."""
    return words.groupBy(*keys).agg(F.coalesce(F.bround(F.avg(confidence), 1), F.lit(0.0)).alias("avg_confidence"), F.coalesce(F.bround(F.avg((F.col(confidence) < least).cast("int")) * 100, 1), F.lit(0.0)).alias("low_conf_percentage"))


def assemble_blocks(words: DataFrame, doc: str, block: str, place: str, text: str) -> DataFrame:
    """Words of a block joined by blanks, blocks of a document by line breaks, both in order."""
    ordered = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    blocks = words.groupBy(doc, block).agg(F.array_join(F.transform(ordered(place, text), lambda w: w[text]), " ").alias("t"))
    return blocks.groupBy(doc).agg(F.count("*").alias("blocks"), F.array_join(F.transform(ordered(block, "t"), lambda b: b["t"]), "\n").alias("text"))


def boxes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The box around cells (x0, y0, x1, y1), their number and the mean of confidences above 0."""
    return cells.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("cells"), F.round(F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)), 2).alias("confidence"))


def unnecessary_calls(trace: DataFrame, run: str, step: str, tool: str, args: str, success: str) -> DataFrame:
    """Add unnecessary: the step before had the same tool and arguments and succeeded."""
    w = Window.partitionBy(run).orderBy(step)
    same = (F.lag(tool).over(w) == F.col(tool)) & F.lag(args).over(w).eqNullSafe(F.col(args)) & F.lag(success).over(w)
    return trace.withColumn("unnecessary", F.coalesce(same, F.lit(False)))


def retries(trace: DataFrame, run: str, step: str, tool: str, success: str, most: int = 2) -> DataFrame:
    """Add failures (of this tool so far) and aborted (more than ``most``)."""
    w = Window.partitionBy(run, tool).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return trace.withColumn("failures", F.sum((~F.col(success)).cast("bigint")).over(w)).withColumn("aborted", F.col("failures") > most)


def trace_metrics(trace: DataFrame, run: str, success: str, milliseconds: str) -> DataFrame:
    """Steps, successes, failures, success rate (1 without a step) and time per run."""
    out = trace.groupBy(run).agg(F.count("*").alias("steps"), F.count_if(success).alias("successes"), F.count_if(~F.col(success)).alias("failures"), F.round(F.sum(milliseconds), 2).alias("total_ms"))
    return out.withColumn("tool_call_rate", ratio(F.col("successes"), F.col("steps"), 2, 1.0))


def batch_metrics(runs: DataFrame, state: str, successes: tuple[str, ...], failures: tuple[str, ...], measures: list[str]) -> DataFrame:
    """One row: runs, successful, failed, means of the measures and the success rate. A state in neither list counts as neither."""
    out = runs.agg(F.count("*").alias("runs"), F.count_if(F.col(state).isin(*successes)).alias("successful"), F.count_if(F.col(state).isin(*failures)).alias("failed"), *[F.coalesce(F.round(F.avg(m), 2), F.lit(0.0)).alias(f"avg_{m}") for m in measures])
    return out.withColumn("success_rate", ratio(F.col("successful"), F.col("runs")))


def summary_of_pages(pages: DataFrame, key: str) -> DataFrame:
    n = lambda t: F.count_if(F.col("page_type") == t)
    return pages.groupBy(key).agg(F.count("*").alias("pages"), F.count_if("usable").alias("usable"), n("SCANNED").alias("scanned"), (F.count("*") - F.count_if("usable")).alias("needs_ocr"), (F.count_if(~F.col("usable")) > 0).alias("any_ocr"))
