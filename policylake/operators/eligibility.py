"""Eligibility of citizens under rules. Which predicate a rule asks for, and with which limit, is computed once per rule;
the join with citizens then evaluates it, and one aggregate per citizen and scheme decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lex
from ..functions.citizens import annual_income
from ..functions.rules import first_number, money
from ..functions.text import has_any
from .versions import contained

MATCH, NO_MATCH, UNKNOWN, REVIEW, NOT_APPLICABLE = "MATCH", "NO_MATCH", "UNKNOWN", "REVIEW_REQUIRED", "NOT_APPLICABLE"

# Words that tell which predicate a rule asks for, in order.
PREDICATES = [
    ("limit", ["one woman per household", "one per household", "one per family"]),
    ("woman_head", ["head of the family", "woman who is the head", "ಕುಟುಂಬದ ಯಜಮಾನಿ", "ration card"]),
    ("income", ["income", "annual income", "salary", "earnings", "ಆದಾಯ"]),
    ("land", ["agricultural land", "owns land", "landowner", "landless", "ಕೃಷಿ ಜಮೀನು", "ಹಿಡುವಳಿ"]),
    ("failure", ["failed", "failing", "repeat", "repeating", "ಅನುತ್ತೀರ್ಣ", "ಪುನರಾವರ್ತನೆ"]),
    ("completed", ["completed a higher education", "already completed a course", "different course", "ಸ್ನಾತಕೋತ್ತರ"]),
    ("tax", ["taxpayer", "tax payers", "income tax", "gst", "ಜಿಎಸ್‌ಟಿ"]),
    ("residency", ["resident", "karnataka", "ವಾಸ"]),
]
# Words of an upper limit, and of a postgraduate course.
UPPER = ["<=", "less than", "up to", "not exceed", "maximum", "within"]
POSTGRADUATE = ["postgraduate", "master", "msc", "m.sc", "ma", "m.a", "mtech", "mba", "ಸ್ನಾತಕೋತ್ತರ"]

#: A citizen's attributes; all may be null, which means unknown.
CITIZEN = {
    "gender": "string", "household_head": "boolean", "is_woman_head_of_household": "boolean", "listed_as_head_in_ration_card": "boolean", "ration_card_type": "string", "annual_income": "double",
    "income": "double", "owns_agricultural_land": "boolean", "landholding_acres": "double", "failed_semester": "boolean", "repeating_year": "boolean", "already_completed_equivalent_or_higher_course": "boolean",
    "previous_course": "string", "current_course": "string", "income_tax_payer": "boolean", "gst_return_filer": "boolean", "gst_registered": "boolean", "spouse_is_gst_filer": "boolean",
    "is_karnataka_resident": "boolean", "state": "string", "household_members": "array<struct<relationship:string,already_received_benefit:boolean>>",
}


def with_all_attributes(citizens: DataFrame) -> DataFrame:
    """Attributes that are not there are unknown."""
    return citizens.withColumns({c: F.lit(None).cast(kind) for c, kind in CITIZEN.items() if c not in citizens.columns})


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Add predicate, rule_limit, and flags to rules (scheme_key, rule_id, rule, type, rule_scope, consistency, review_required)."""
    t = F.lower(F.coalesce("rule", F.lit("")))
    kind = F.when(F.col("rule_scope") == "administrative", "administrative").when((F.coalesce("consistency", F.lit("SUPPORTED")) != "SUPPORTED") | F.coalesce("review_required", F.lit(False)), "quarantined").when(F.col("rule_scope") == "beneficiary_limit", "limit")
    for name, words in PREDICATES:
        kind = kind.when(has_any(t, words), F.lit(name))
    scope, type_ = F.coalesce("rule_scope", F.lit("candidate")), F.lower(F.coalesce("type", F.lit("")))
    bucket = F.when(F.trim(t) == "", None).when(scope.isin("household", "beneficiary_limit"), "household").when((scope == "candidate") & type_.isin("eligibility", "exclusion"), type_)
    return rules.withColumns({"predicate": kind.otherwise("generic"), "rule_limit": F.coalesce(money("rule"), first_number("rule")), "upper": has_any(t, UPPER), "landless": has_any(t, ["landless", "without land"]), "asks_gst": has_any(t, ["gst", "ಜಿಎಸ್‌ಟಿ"]), "exclusion": type_ == "exclusion", "bucket": bucket})


def _truth(known: Column) -> Column:
    return F.when(known.isNull(), UNKNOWN).when(known, MATCH).otherwise(NO_MATCH)


def _either(a: Column, b: Column) -> Column:
    """True if either is; unknown only if both are: what is unknown beside a known value counts as false."""
    return F.when(a.isNull() & b.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))


def _facts(compat: bool) -> dict[str, Column]:
    """What the predicates ask of a citizen and a prepared rule: booleans, null where unknown."""
    c = F.col
    gender = F.lower("gender")
    head = F.coalesce("is_woman_head_of_household", F.when(c("household_head").isNotNull(), c("household_head") & (F.coalesce(gender, F.lit("")) == "female")))
    income = annual_income("annual_income", "income")
    fits = income <= c("rule_limit")
    over = F.when(c("upper"), ~fits).otherwise(fits) if compat else ~fits
    owns = F.coalesce("owns_agricultural_land", c("landholding_acres") > 0)
    done = lambda x: has_any(F.lower(c(x)), POSTGRADUATE)
    both = (c("previous_course") != "") & (c("current_course") != "")
    others = F.size(F.filter("household_members", lambda m: ~m["relationship"].eqNullSafe(F.lit("self")) & m["already_received_benefit"].eqNullSafe(F.lit(True))))
    return {
        "man": ~F.coalesce(gender.isin("female", "woman"), F.lit(True)), "head": head, "listed": c("listed_as_head_in_ration_card"), "card": F.upper(F.coalesce("ration_card_type", F.lit(""))).isin("", "BPL", "APL", "ANTYODAYA", "AAY"),
        "income": income, "income_met": F.when(c("exclusion"), over).otherwise(fits), "owns": owns, "land_met": F.when(c("landless"), ~owns).otherwise(owns), "failure": _either(c("failed_semester"), c("repeating_year")),
        "completed": F.coalesce("already_completed_equivalent_or_higher_course", F.when(both, done("previous_course") & done("current_course"))),
        "tax": F.when(c("asks_gst"), _either(F.coalesce("gst_return_filer", "gst_registered"), c("spouse_is_gst_filer"))).otherwise(c("income_tax_payer")), "resident": F.coalesce("is_karnataka_resident", F.lower("state").contains("karnataka")),
        "household": F.coalesce(F.size("household_members"), F.lit(-1)) > 0, "others": others,
    }


def evaluate(compat: bool = False) -> Column:
    """The status of a prepared rule for a citizen. ``compat``: an exclusion by income without words of an upper limit takes
    incomes up to it, as it once did, and not those above it."""
    f = _facts(compat)
    woman = F.when(f["man"], NO_MATCH).when(f["head"].isNull() | f["listed"].isNull(), UNKNOWN).when(f["head"] & f["listed"] & f["card"], MATCH).otherwise(NO_MATCH)
    limit = F.when(~f["household"], UNKNOWN).when(f["others"] > 0, NO_MATCH).otherwise(MATCH)
    out = F.when(F.col("predicate") == "administrative", NOT_APPLICABLE).when(F.col("predicate") == "quarantined", REVIEW)
    for name, value in (("limit", limit), ("woman_head", woman), ("income", _truth(f["income_met"])), ("land", _truth(f["land_met"])), ("failure", _truth(f["failure"])), ("completed", _truth(f["completed"])), ("tax", _truth(f["tax"])), ("residency", _truth(f["resident"]))):
        out = out.when(F.col("predicate") == name, value)
    return out.otherwise(UNKNOWN)


def reason(compat: bool = False) -> Column:
    """Why a prepared rule has its status for a citizen; null for rules that aren't asked."""
    f, c = _facts(compat), F.col
    said = lambda key, *values: F.format_string(lex.REASONS[key], *values) if values else F.lit(lex.REASONS[key])
    by = lambda fact, unknown, yes, no: F.when(fact.isNull(), said(unknown)).when(fact, yes).otherwise(no)
    listing = lambda *pairs: F.concat_ws(", ", *[F.when(test, F.lit(text) if isinstance(text, str) else text) for test, text in pairs])
    amounts = (F.format_number(f["income"], 0), F.format_number(c("rule_limit"), 0))
    income = (
        F.when(f["income"].isNull(), said("income_unknown")).when(c("rule_limit").isNull(), said("income_limit"))
        .when(c("exclusion"), F.when(f["income_met"], said("income_excluded", *amounts)).otherwise(said("income_not_excluded", *amounts))).when(f["income_met"], said("income_fits", *amounts)).otherwise(said("income_exceeds", *amounts))
    )
    land = F.when(f["owns"].isNull(), said("land_unknown")).when(c("landless"), F.when(f["owns"], said("landowner")).otherwise(said("landless"))).when(f["owns"], said("land_owns")).otherwise(said("land_owns_not"))
    failed = said("failure", listing((c("failed_semester"), "failed semester"), (c("repeating_year"), "repeating academic year")))
    limit = F.when(~f["household"], said("limit_unknown")).when(f["others"] > 0, said("limit_reached", f["others"].cast("string"))).otherwise(said("limit_free"))
    missing = listing((f["head"].isNull(), "household head status"), (f["listed"].isNull(), "listed as head in ration card"), (c("gender").isNull(), "gender"))
    lacking = listing((~f["head"], "not head of family"), (~f["listed"], "not listed as head in ration card"), (~f["card"], F.format_string("ineligible ration card type '%s'", F.upper("ration_card_type"))))
    woman = (
        F.when(f["man"], said("woman_gender", c("gender"))).when(f["head"].isNull() | f["listed"].isNull(), said("woman_unknown", missing))
        .when(f["head"] & f["listed"] & f["card"], said("woman")).otherwise(said("woman_not", lacking))
    )
    tax = F.when(f["tax"].isNull(), F.when(c("asks_gst"), said("gst_unknown")).otherwise(said("tax_unknown"))).when(f["tax"], said("tax")).otherwise(said("tax_none"))
    out = F.when(c("predicate").isin("administrative", "quarantined"), F.lit(None).cast("string"))
    for name, value in (
        ("limit", limit), ("woman_head", woman), ("income", income), ("land", land), ("failure", by(f["failure"], "failure_unknown", failed, said("failure_none"))), ("completed", by(f["completed"], "completed_unknown", said("completed"), said("completed_not"))),
        ("tax", tax), ("residency", by(f["resident"], "residency_unknown", said("resident"), said("resident_not"))),
    ):
        out = out.when(c("predicate") == name, value)
    return out.otherwise(said("generic", F.substring("rule", 1, 60)))


def evaluate_rules(citizens: DataFrame, rules: DataFrame, compat: bool = False, on: str | None = None) -> DataFrame:
    """A row per citizen and rule: status and reason. ``on``: citizens are asked about the schemes of this column only; else
    about all, which makes as many rows as there are citizens and rules.

    The rules are the small side. Spark broadcasts them up to its own limit for a join; a larger table is dealt out by its
    schemes, which the citizens are then asked about one by one."""
    prepared = prepare_rules(rules)
    asked = with_all_attributes(citizens)
    if on is None:
        on = "scheme_key"
        schemes = prepared.agg(F.collect_set("scheme_key").alias("_schemes"))  # names only, one row
        asked = asked.join(F.broadcast(schemes), F.lit(True)).withColumn(on, F.explode("_schemes")).drop("_schemes")
    joined = asked.join(prepared, on)
    return joined.withColumns({"status": evaluate(compat), "reason": reason(compat)})


def decide(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """ELIGIBLE, NOT_ELIGIBLE or NEEDS_REVIEW per citizen and scheme, with counts and the rules that were looked at."""
    n = lambda bucket, *status: F.count_if((F.col("bucket") == bucket) & F.col("status").isin(*status))
    trusted = F.count_if((F.col("bucket") == "eligibility") & ~F.col("predicate").isin("quarantined"))
    out = evaluated.groupBy(*keys).agg(
        n("exclusion", MATCH).alias("excluded"), trusted.alias("trusted"), n("eligibility", NO_MATCH).alias("failed"), n("eligibility", MATCH).alias("passed"), n("household", NO_MATCH).alias("household_failed"),
        (n("eligibility", REVIEW, UNKNOWN) + n("exclusion", REVIEW, UNKNOWN) + n("household", REVIEW, UNKNOWN)).alias("open"),
        F.sort_array(F.collect_list(F.when(F.col("bucket") == "exclusion", F.struct("rule_id", "status")))).alias("exclusion_results"),
        F.sort_array(F.collect_list(F.when(F.col("bucket") == "eligibility", F.struct("rule_id", "status")))).alias("_eligibility"),
        F.sort_array(F.collect_list(F.when(F.col("bucket") == "household", F.struct("rule_id", "status")))).alias("_household"),
    )
    c = F.col
    decision = F.when(c("excluded") > 0, "NOT_ELIGIBLE").when(c("trusted") == 0, "NEEDS_REVIEW").when((c("failed") > 0) | (c("household_failed") > 0), "NOT_ELIGIBLE").when(c("open") > 0, "NEEDS_REVIEW").when((c("passed") > 0) & (c("passed") == c("trusted")), "ELIGIBLE").otherwise("NEEDS_REVIEW")
    # What an earlier decision made needless was never looked at: those lists stay empty.
    none = F.array().cast("array<struct<rule_id:bigint,status:string>>")
    looked = (c("excluded") == 0) & (c("trusted") > 0)
    return out.withColumns({"decision": decision, "eligibility_results": F.when(looked, c("_eligibility").cast("array<struct<rule_id:bigint,status:string>>")).otherwise(none), "household_results": F.when(looked & (c("failed") == 0), c("_household").cast("array<struct<rule_id:bigint,status:string>>")).otherwise(none)}).drop("_eligibility", "_household")


def guard(decisions: DataFrame, version_status: str = "version_status", asked_label: str = "asked_label") -> DataFrame:
    """Without a version asked for by its label, only the active one decides."""
    stale = F.col(asked_label).isNull() & F.col(version_status).isin("ARCHIVED", "REVIEW")
    return decisions.withColumn("decision", F.when(stale, "NEEDS_REVIEW").otherwise(F.col("decision")))


def explain(evaluated: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """``decisions`` with the reasons that led to them: summary_reasons (of the rules that decided), review_reasons,
    missing_information, and evidence (rule_id, type and the rule's evidence, page and source, where the rules have them).

    A decision by an exclusion, a failed requirement or the household has the reasons of those rules; an eligible one those of
    what was met; an open one what is to be reviewed and what is missing."""
    have = [c for c in ("evidence", "page_number", "source_url") if c in evaluated.columns]
    entry = F.struct("rule_id", "bucket", "status", "reason", *have)
    rules = evaluated.where("bucket IS NOT NULL").groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_rules"))
    out = decisions.join(rules, keys, "left")
    of = lambda bucket, *status: F.transform(F.filter("_rules", lambda r: (r["bucket"] == bucket) & r["status"].isin(*status)), lambda r: r["reason"])
    led = lambda prefix, a: F.transform(a, lambda x: F.concat(F.lit(prefix), F.coalesce(x, F.lit("")))) if prefix else a
    none = F.array().cast("array<string>")
    review = F.concat(led("Eligibility rule requires review: ", of("eligibility", REVIEW)), led("Exclusion rule requires review: ", of("exclusion", REVIEW)))
    missing = F.concat(of("eligibility", UNKNOWN), led("Exclusion verification needed: ", of("exclusion", UNKNOWN)), led("Household constraint verification needed: ", of("household", UNKNOWN, REVIEW)))
    c = F.col
    still = (c("excluded") == 0) & (c("trusted") > 0) & (c("failed") == 0) & (c("household_failed") == 0)
    why = (
        F.when(c("excluded") > 0, of("exclusion", MATCH)).when(c("trusted") == 0, none).when(c("failed") > 0, of("eligibility", NO_MATCH)).when(c("household_failed") > 0, of("household", NO_MATCH))
        .when(c("open") > 0, F.concat(review, missing)).when(c("decision") == "ELIGIBLE", of("eligibility", MATCH)).otherwise(none)
    )
    untrusted = F.array(F.lit("No trusted candidate eligibility rules available in active knowledge base."))
    out = out.withColumns({"summary_reasons": F.coalesce(why, none), "review_reasons": F.coalesce(F.when((c("excluded") == 0) & (c("trusted") == 0), untrusted).when(still, review), none), "missing_information": F.coalesce(F.when(still, missing), none)})
    if "evidence" in have:
        looked = lambda r: r["evidence"].isNotNull() & ((r["bucket"] == "exclusion") | ((r["bucket"] == "eligibility") & (F.col("excluded") == 0) & (F.col("trusted") > 0)))
        out = out.withColumn("evidence", F.transform(F.filter("_rules", looked), lambda r: F.struct(r["rule_id"].alias("rule_id"), r["bucket"].alias("type"), *[r[x].alias(x) for x in have])))
    return out.drop("_rules")


def safety_counters(evaluated: DataFrame) -> DataFrame:
    """One row: rules that were used although contradicted, or although marked for review. Both are 0 if all is well."""
    used = F.col("bucket").isin("eligibility", "exclusion") & F.col("status").isin(MATCH, NO_MATCH)
    return evaluated.agg(F.count_if(used & (F.col("consistency") == "CONTRADICTED")).alias("contradicted_rules_used"), F.count_if(used & F.coalesce("review_required", F.lit(False))).alias("review_rules_used"))


def scheme_rules(asked: DataFrame, stored: DataFrame, files: DataFrame) -> DataFrame:
    """Rules of the schemes that are asked about (scheme_key, version_label or null), with version_label, version_status and origin.

    ``stored``: rules of versions (scheme_key, version_label, version_status, and the rules' columns). The version with the
    label asked for counts, without one the active version. A scheme without such a version has the rules of a file:
    ``files`` (file_name and the rules' columns), the first whose name holds the scheme's key, else the file that is known for
    it. Rules without a text are passed over. A scheme with neither has no row."""
    stored = stored.where(F.trim(F.coalesce("rule", F.lit(""))) != "")
    wants = asked.select("scheme_key", F.col("version_label").alias("_label")).distinct()
    right = F.when(F.col("_label").isNull(), F.col("version_status") == "ACTIVE").otherwise(F.col("version_label") == F.col("_label"))
    own = wants.join(stored, "scheme_key").where(right).drop("_label").withColumn("origin", F.lit("knowledge_base"))
    left = wants.join(own.select("scheme_key").distinct(), "scheme_key", "left_anti").select("scheme_key").distinct()
    names = files.select("file_name").distinct()
    named = contained(left.select(F.col("scheme_key").alias("needle")).distinct(), names.select(F.lower("file_name").alias("text"), "file_name"), ["file_name"]).groupBy("needle").agg(F.min("file_name").alias("_named"))
    # The files that are known for a scheme are a handful; the first of a key's that is there counts.
    alias = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("key"), F.lit(f).alias("file_name")) for n, (k, f, _) in enumerate(lex.SCHEME_FILES)])
    told = left.select("scheme_key", F.explode(F.filter(alias, lambda k: F.col("scheme_key").contains(k["key"]) | k["key"].contains(F.col("scheme_key")))).alias("a")).select("scheme_key", "a.n", "a.file_name")
    other = told.join(names, "file_name").groupBy("scheme_key").agg(F.min_by("file_name", "n").alias("_other"))
    chosen = left.join(named, F.col("scheme_key") == F.col("needle"), "left").join(other, "scheme_key", "left")
    chosen = chosen.select("scheme_key", F.coalesce("_named", "_other").alias("file_name")).where("file_name IS NOT NULL")
    rest = [c for c in stored.columns if c not in ("scheme_key", "version_label", "version_status")]
    filed = files.where(F.trim(F.coalesce("rule", F.lit(""))) != "").select("file_name", *rest)
    filed = chosen.join(filed, "file_name").select("scheme_key", F.lit("G.O. 2023").alias("version_label"), F.lit("ACTIVE").alias("version_status"), *rest, F.lit("file").alias("origin"))
    return own.select(filed.columns).unionByName(filed)
