"""Functions of rules as columns: normal form, category, thresholds, filters, evidence and grounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lex
from .text import col, has_any, number_of, once, reliability, word_list

WORD = "[\\p{L}\\p{N}_]+"


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")


def normal_form(rule: str | Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(col(rule), F.lit("")))), "[.,;:!?`'\"]", " ")
    t = F.trim(F.regexp_replace(t, "\\s+", " "))
    for old, new in lex.REPLACEMENTS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def category(rule: str | Column, given: str | Column, evidence: str | Column | None = None) -> Column:
    """A known category as given, else that of the first test that the rule, its category or its evidence meets."""
    own = F.lower(F.trim(F.coalesce(col(given), F.lit(""))))
    t = F.lower(F.concat_ws(" ", col(rule), F.coalesce(col(given), F.lit("")), F.lit("") if evidence is None else F.coalesce(col(evidence), F.lit(""))))
    out = F.when(own.isin(lex.CATEGORIES), own)
    for name, pattern in lex.CATEGORY_TESTS:
        out = out.when(t.rlike(pattern), F.lit(name))
    return out.otherwise("other")


def threshold(rule: str | Column, kind: str | Column) -> Column:
    """Income in rupees, age in years, land in hectares."""
    t, kind = F.replace(F.lower(col(rule)), F.lit(","), F.lit("")), col(kind)
    income = F.coalesce(_number(t, "(\\d+(?:\\.\\d+)?)\\s*(?:lakh|lac)") * 100000.0, _number(t, "(?:rs|₹)?\\s*(\\d{5,7})"))
    age = F.coalesce(_number(t, "(\\d{1,2})\\s*(?:years|वर्ष|ವಯಸ್ಸು)"), _number(t, "between\\s*(\\d{1,2})\\s*and\\s*\\d{1,2}"))
    land = F.coalesce(_number(t, "(\\d+(?:\\.\\d+)?)\\s*(?:hectare|ha|ಹೆಕ್ಟೇರ್)"), _number(t, "(\\d+(?:\\.\\d+)?)\\s*(?:acre|ಎಕರೆ)") * 0.404686)
    return F.when(kind == "income", income).when(kind == "age", age).when(kind == "landholding", land)


def threshold_impact(kind: str | Column, old: str | Column, new: str | Column) -> Column:
    """A higher ceiling lets more people in; a higher least age fewer."""
    kind, change = col(kind), F.signum(col(new) - col(old))
    direction = F.when(kind == "age", -1).when(kind.isin("income", "landholding"), 1)
    way = change * direction
    return F.when(way > 0, "eligibility_less_restrictive").when(way < 0, "eligibility_more_restrictive").when(way == 0, "no_eligibility_impact").otherwise("uncertain")


def money(text: str | Column) -> Column:
    t = F.replace(F.lower(col(text)), F.lit(","), F.lit(""))
    return F.coalesce(_number(t, "(\\d+(?:\\.\\d+)?)\\s*(?:lakh|lac|ಲಕ್ಷ)") * 100000.0, _number(t, "(?:rs\\.?|₹|inr|ರೂ\\.?)\\s*(\\d+)"), _number(t, "\\b(\\d{4,8})\\b"))


def first_number(text: str | Column) -> Column:
    """The first number that isn't a year from 2020 to 2026."""
    found = F.transform(F.regexp_extract_all(F.replace(col(text), F.lit(","), F.lit("")), F.lit("\\b\\d+(?:\\.\\d+)?\\b"), F.lit(0)), lambda x: x.cast("double"))
    return F.try_element_at(F.filter(found, lambda x: ~x.isin([float(y) for y in range(2020, 2027)])), F.lit(1))


def numbers(text: str | Column) -> Column:
    """Runs of at most 8 digits after commas, points, slashes and hyphens are taken out."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(col(text), F.lit("")), "[,./-]", ""), F.lit("\\b\\d+\\b"), F.lit(0))
    return F.transform(F.filter(found, lambda x: F.length(x) <= 8), lambda x: x.cast("bigint"))


def names_attribute(text: str | Column) -> Column:
    t = F.lower(F.coalesce(col(text), F.lit("")))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    return has_any(t, lex.ATTRIBUTE_PHRASES + lex.ATTRIBUTE_PARTS) | F.arrays_overlap(words, F.array(*map(F.lit, lex.ATTRIBUTE_WORDS)))


def is_administrative(text: str | Column, words: list[str] | None = None) -> Column:
    return has_any(F.lower(F.coalesce(col(text), F.lit(""))), words or lex.ADMIN_STATUS)


def is_absence(text: str | Column, words: list[str] | None = None) -> Column:
    t = F.lower(F.trim(F.coalesce(col(text), F.lit(""))))
    return has_any(t, words or lex.ABSENCE) | t.rlike("^no (exclusion|eligibility|specific exclusion|candidate exclusion)")


def is_funding(rule: str | Column, evidence: str | Column) -> Column:
    r, e = (F.lower(F.trim(F.coalesce(col(x), F.lit("")))) for x in (rule, evidence))
    return has_any(F.concat_ws(" ", r, e), lex.FUNDING) & ~(has_any(e, lex.ENTITIES) & has_any(e, lex.QUALIFYING))


def qualification(rule: str | Column, evidence: str | Column) -> Column:
    """Why a rule isn't a candidate's qualification (empty, absence, funding, amendment, handling, committee, no_condition), or valid."""
    r, e = (F.trim(F.coalesce(col(x), F.lit(""))) for x in (rule, evidence))
    t = F.lower(F.concat_ws(" ", r, e))
    return (
        F.when(F.lower(r).isin("", "null", "none"), "empty").when(is_absence(r) | is_absence(e), "absence").when(is_funding(r, e), "funding").when(has_any(t, lex.AMENDMENT), "amendment")
        .when(has_any(t, lex.HANDLING) & ~has_any(t, lex.BENEFICIARIES), "handling")
        .when(has_any(t, lex.COMMITTEE) & ~has_any(t, lex.APPLICANTS), "committee")
        .when(~has_any(t, lex.CANDIDATE), "no_condition").otherwise("valid")
    )


def weak_evidence(evidence: str | Column, ocr_confidence: str | Column, kind: str | Column, value: str | Column | None = None, least: float = 60.0, vocabulary: list[str] | None = None) -> Column:
    """Why evidence is weak (none, ocr, short, garbled, noise, criteria), or null."""
    marks = "$;%^~{}|\\\\&_`"
    quantity = F.coalesce(col(kind).isin("income", "age", "land_size") | F.coalesce((F.lit(None).cast("string") if value is None else col(value)).rlike("\\d"), F.lit(False)), F.lit(False))

    def of(e: Column) -> Column:
        shares = F.struct(reliability(e, 3, vocabulary).alias("rel"), word_list(e).alias("words"))

        def verdict(c: Column) -> Column:
            noisy = F.size(F.filter(c["words"], lambda w: w.rlike(f"[{marks}]") & w.rlike("\\p{L}")))
            return (
                F.when(c["rel"]["encoding_issue"] | ~c["rel"]["reliable"], "garbled").when((number_of(e, marks) >= 3) | e.rlike(f"[{marks}]{{2}}") | (noisy >= 0.25 * F.size(c["words"])), "noise")
                .when(quantity & ~has_any(F.lower(e), lex.CRITERIA), "criteria")
            )

        return F.when(F.length(e) < 10, "short").otherwise(once(shares, verdict))

    return F.when(col(evidence).isNull(), "none").when(col(ocr_confidence) < least, "ocr").otherwise(once(F.trim(col(evidence)), of))


def scope(rule: str | Column, evidence: str | Column) -> Column:
    t = F.lower(F.concat_ws(" ", F.coalesce(col(rule), F.lit("")), F.coalesce(col(evidence), F.lit(""))))
    return (
        F.when(has_any(t, lex.HOUSEHOLD_LIMITS), "beneficiary_limit").when(has_any(t, lex.HOUSEHOLD_INCOME), "household")
        .when(has_any(t, lex.OFFICE_WORDS), "administrative").otherwise("candidate")
    )


def grounding(rule: str | Column, evidence: str | Column, kind: str | Column, vocabulary: list[str] | None = None) -> Column:
    """A struct of status (SUPPORTED, CONTRADICTED, INSUFFICIENT, REVIEW_REQUIRED), stage and confidence."""
    r, e = F.lower(F.trim(F.coalesce(col(rule), F.lit("")))), F.trim(F.coalesce(col(evidence), F.lit("")))
    low = F.lower(e)
    bare = F.regexp_replace(F.regexp_replace(low, "[`'\"=_~^]+", ""), "\\s+", " ")
    rel = reliability(e, 2, vocabulary)
    verdict = lambda status, stage, c: F.struct(F.lit(status).alias("status"), F.lit(stage).alias("stage"), F.lit(c).alias("confidence"))
    out = F.when(col(evidence).isNull() | (col(evidence) == ""), verdict("INSUFFICIENT", "none", 1.0)).when(F.length(e) < 10, verdict("INSUFFICIENT", "brief", 0.9))
    out = out.when(rel["encoding_issue"] | ~rel["reliable"], verdict("REVIEW_REQUIRED", "garbled", 0.85))
    negated = has_any(low, lex.NEGATIONS)
    for name, only, markers, conflicts in lex.CONTRADICTIONS:
        if name == "landless_vs_landowner":
            continue  # this check has no verdict of its own
        hit = has_any(r, markers) & (has_any(low, conflicts) | has_any(bare, conflicts))
        if only:
            hit &= F.coalesce(col(kind) == only, F.lit(False))
        if name == "exclusion_polarity_inversion":
            hit &= ~negated
        out = out.when(hit, verdict("CONTRADICTED", name, 1.0 if name == "landowner_vs_landless" else 0.95))
    out = out.when(r.contains("both") & has_any(low, lex.EITHER) & ~low.contains(lex.BOTH), verdict("CONTRADICTED", "both_or", 0.90))
    major = lambda c: F.filter(numbers(c), lambda n: (n >= 50) & ~n.between(2021, 2026))
    mine, theirs = major(r), major(e)
    out = out.when((F.size(mine) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(mine, theirs), verdict("CONTRADICTED", "numbers", 0.90))
    out = out.when(has_any(r, lex.TAXPAYERS) & ~low.contains(lex.INCOME_TAX) & has_any(low, lex.SALES_TAX), verdict("REVIEW_REQUIRED", "generalised", 0.85))
    missing = sum((F.when(r.contains(word) & ~has_any(low, support), 1).otherwise(0) for word, support in lex.CONCEPTS.items()), F.lit(0))
    return out.when(missing >= 2, verdict("REVIEW_REQUIRED", "unsupported", 0.80)).otherwise(verdict("SUPPORTED", "supported", 0.95))


def worth_extracting(text: str | Column, page: str | Column, markers: list[str], rescue: list[str], triggers: list[str]) -> Column:
    """Pages worth an expensive reading: long enough, no short routing page, and beyond page 3 only with a trigger term."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    routing = (F.length(t) < 600) & has_any(t, markers) & ~has_any(t, rescue)
    return (F.length(t) >= 50) & ~routing & ((col(page) <= 3) | has_any(t, triggers))
