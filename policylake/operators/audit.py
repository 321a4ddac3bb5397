"""Extraction audit: coercions of extracted rules, filters, evidence quality and grounding, and the document's review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import grounding, is_absence, qualification, scope, weak_evidence
from ..functions.text import col


def capped_confidence(value: str | Column) -> Column:
    """Unknown or unreadable: 0.85; 1 or more: 0.90."""
    v = col(value).try_cast("double")
    return F.when(v.isNull(), 0.85).when(v >= 1.0, 0.90).otherwise(v)


def flatten_extraction(extractions: DataFrame, key: str, eligibility: str, exclusion: str) -> DataFrame:
    """Two lists of rules as rows; a null list is empty, a rule's type is its own or its list's. Empty rules and statements
    that there are none are dropped."""
    tagged = lambda c, kind: F.transform(F.coalesce(col(c), F.array().cast(extractions.schema[c].dataType)), lambda r: r.withField("type", F.coalesce(r["type"], F.lit(kind))))
    rows = extractions.select(key, F.posexplode_outer(F.concat(tagged(eligibility, "eligibility"), tagged(exclusion, "exclusion"))).alias("seq", "r")).where("r IS NOT NULL").select(key, "seq", "r.*")
    text = F.lower(F.trim(F.coalesce("rule", F.lit(""))))
    return rows.where(~text.isin("", "null", "none") & ~is_absence("rule") & ~is_absence("evidence"))


def audit_rules(rules: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """Rules (rule, type, category, evidence, ocr_confidence, semantic_confidence) that qualify, with scope, consistency,
    stage, semantic_confidence, review_required and review_reasons (distinct, in order)."""
    df = rules.withColumn("_q", qualification("rule", "evidence")).where("_q = 'valid'").drop("_q")
    df = df.withColumns({"_weak": weak_evidence("evidence", "ocr_confidence", "category", None, 60.0, vocabulary), "_g": grounding("rule", "evidence", "type", vocabulary), "rule_scope": scope("rule", "evidence")})
    confidence = capped_confidence("semantic_confidence")
    reasons = F.array_distinct(F.array_compact(F.array(F.when(F.col("_weak").isNotNull(), F.concat(F.lit("weak:"), F.col("_weak"))), F.when(F.col("_g.status") != "SUPPORTED", F.concat(F.lit("grounding:"), F.col("_g.stage"))), F.when(F.col("rule_scope") == "beneficiary_limit", "limit"))))
    return df.withColumns({"semantic_confidence": F.when(F.col("_weak").isNotNull(), F.least(confidence, F.lit(0.70))).otherwise(confidence), "consistency": F.col("_g.status"), "stage": F.col("_g.stage"), "review_reasons": reasons, "review_required": F.col("_weak").isNotNull() | (F.col("_g.status") != "SUPPORTED")}).drop("_weak", "_g")


def document_review(rules: DataFrame, pages: DataFrame, key: str, least: float = 60.0) -> DataFrame:
    """Per document: rules, rules to review, distinct reasons, and whether scanned pages were read with low confidence."""
    scans = pages.groupBy(key).agg(F.avg(F.when(F.col("page_type").isin("SCANNED", "TABLE"), F.col("avg_confidence"))).alias("scan_confidence"))
    per = rules.groupBy(key).agg(F.count("*").alias("rules"), F.count_if("review_required").alias("rule_review_count"), F.size(F.array_distinct(F.flatten(F.collect_set("review_reasons")))).alias("reasons"))
    out = scans.join(per, key, "left").na.fill(0, ["rules", "rule_review_count", "reasons"])
    return out.withColumn("review_required", (F.col("rule_review_count") > 0) | F.coalesce(F.col("scan_confidence") < least, F.lit(False)))
