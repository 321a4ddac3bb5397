"""Rule comparison. Matching is greedy and depends on order: each old rule, in order, takes the first free new rule that any of
the cases lets it match. What the cases need of a rule is computed in columns before; the matching itself is a fold over the old
rules of a pair, which are what one document holds. Rules that are left over may be paired by the verdicts of a provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import category, is_administrative, normal_form, threshold
from .comparison import RULE_RELEVANCE

LIMITS = ("income", "age", "landholding")
STATES = ("residency", "government_employee", "farmer_category", "institutional_landholder")


def describe(rules: DataFrame) -> DataFrame:
    """Add norm, cat, admin and limit to rules (rule, type, category, evidence)."""
    out = rules.withColumns({"norm": normal_form("rule"), "cat": category("rule", "category", "evidence"), "admin": is_administrative("rule"), "type": F.coalesce("type", F.lit("eligibility"))})
    return out.withColumn("limit", threshold("rule", "cat"))


def dedupe(rules: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The first of rules with one type, category and normal form. ``rules`` are described."""
    w = Window.partitionBy(*keys, "type", "cat", "norm").orderBy(seq)
    return rules.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


_RULE = "struct<seq:bigint,type:string,norm:string,cat:string,admin:boolean,limit:double,evidence:string>"
RESULT = ["pair", "old_seq", "new_seq", "change_type", "category", "impact", "confidence", "review_required", "reason"]


def _cases(old: Column, new: Column) -> dict[str, Column]:
    """The cases in which two rules match, the first that holds counts."""
    same = (old["type"] == new["type"]) & (old["cat"] == new["cat"])
    return {
        "equal": (old["type"] == new["type"]) & (old["norm"] == new["norm"]),
        "administrative": (old["admin"] & new["admin"]) | ((old["admin"] | new["admin"]) & (old["cat"] == "other") & (new["cat"] == "other")),
        "limit": same & old["cat"].isin(*LIMITS) & old["limit"].isNotNull() & new["limit"].isNotNull(),
        "state": same & old["cat"].isin(*STATES),
    }


def _any(cases: dict[str, Column]) -> Column:
    out = F.lit(False)
    for c in cases.values():
        out = out | F.coalesce(c, F.lit(False))
    return out


def matched(rules: DataFrame) -> DataFrame:
    """(pair, old, new): described rules as structs, matched one to one; a rule that matches none stands alone."""
    rule = F.struct(F.col("seq").cast("long").alias("seq"), "type", "norm", "cat", "admin", "limit", "evidence").cast(_RULE)
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, rule))).alias(name)
    sets = rules.groupBy("pair").agg(side("old"), side("new"))
    state = f"struct<taken:array<bigint>,out:array<struct<old:{_RULE},new:{_RULE}>>>"

    def step(s: Column, o: Column) -> Column:
        free = F.filter("new", lambda n: _any(_cases(o, n)) & ~F.array_contains(s["taken"], n["seq"]))
        first = F.get(free, F.lit(0))
        taken = F.when(first.isNull(), s["taken"]).otherwise(F.concat(s["taken"], F.array(first["seq"])))
        return F.struct(taken.alias("taken"), F.concat(s["out"], F.array(F.struct(o.alias("old"), first.alias("new")))).alias("out")).cast(state)

    done = sets.withColumn("done", F.aggregate("old", F.struct(F.array().alias("taken"), F.array().alias("out")).cast(state), step))
    left = F.transform(F.filter("new", lambda n: ~F.array_contains(F.col("done.taken"), n["seq"])), lambda n: F.struct(F.lit(None).cast(_RULE).alias("old"), n.alias("new")))
    return done.select("pair", F.explode(F.concat("done.out", left)).alias("m")).select("pair", "m.old", "m.new")


def _changes(found: DataFrame) -> DataFrame:
    """What became of each rule, in words of RESULT, by the case that matched it."""
    old, new = F.col("old"), F.col("new")
    cases = {k: F.coalesce(c, F.lit(False)) for k, c in _cases(old, new).items()}
    both, equal_norm, longer = old.isNotNull() & new.isNotNull(), old["norm"] == new["norm"], (old["cat"] == "residency") & new["norm"].contains("year") & ~old["norm"].contains("year")
    way = (new["limit"] > old["limit"]) != (old["cat"] == "age")
    impact = F.when(old["limit"] == new["limit"], "no_eligibility_impact").when(way, "eligibility_less_restrictive").otherwise("eligibility_more_restrictive")
    one = F.coalesce(old, new)
    change = F.when(new.isNull(), "removed").otherwise("added")
    alone = F.when(one["admin"], "no_eligibility_impact").when(one["type"] == "exclusion", F.concat(F.lit("exclusion_"), change)).when(new.isNull(), "eligibility_less_restrictive").otherwise("eligibility_more_restrictive")
    bare = F.coalesce(one["evidence"] == "", F.lit(True))

    def verdict(change: Column | str, cat: Column, impact: Column | str, confidence: float, review: Column | bool, reason: str | Column | None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(change).alias("change_type"), cat.alias("category"), lit(impact).alias("impact"), F.lit(confidence).alias("confidence"), lit(review).alias("review_required"), lit(reason).cast("string").alias("reason"))

    out = F.when(~both, verdict(change, one["cat"], alone, 0.90, bare, F.when(bare, "evidence")))
    out = out.when(cases["equal"], verdict("unchanged", old["cat"], "no_eligibility_impact", 0.95, False, None))
    out = out.when(cases["administrative"], verdict(F.when(equal_norm, "unchanged").otherwise("modified"), F.lit("other"), "no_eligibility_impact", 0.90, True, "administrative"))
    out = out.when(cases["limit"], verdict(F.when(old["limit"] == new["limit"], "unchanged").otherwise("modified"), old["cat"], impact, 0.95, False, F.when(old["limit"] != new["limit"], "threshold")))
    out = out.when(longer, verdict("modified", old["cat"], "eligibility_more_restrictive", 0.95, False, "duration"))
    out = out.otherwise(verdict("unchanged", old["cat"], "no_eligibility_impact", 0.90, False, None))
    rows = found.select("pair", F.col("old.seq").alias("old_seq"), F.col("new.seq").alias("new_seq"), "old", "new", out.alias("v")).select("pair", "old_seq", "new_seq", "old", "new", "v.*")
    unproved = (F.col("change_type") == "modified") & (F.col("impact") != "no_eligibility_impact") & (F.col("old.evidence") == "") & (F.col("new.evidence") == "")
    return rows.withColumn("review_required", F.col("review_required") | F.coalesce(unproved, F.lit(False)))


def compare_rules(rules: DataFrame, verdicts: Callable[[list[tuple[str, str]]], list[dict | None]] | None = None) -> DataFrame:
    """Changes between the old and new rules (pair, side, seq, rule, type, category, evidence) of each pair: RESULT.

    Rules that match nothing are removed and added, unless ``verdicts`` pairs them (see paired_by_verdict)."""
    described = dedupe(describe(rules), ["pair", "side"]).select("pair", "side", "seq", "type", "norm", "cat", "admin", "limit", F.coalesce("evidence", F.lit("")).alias("evidence"))
    changes = _changes(matched(described))
    if verdicts is not None:
        alone = F.col("old").isNull() | F.col("new").isNull()
        changes = changes.where(~alone).select(*RESULT).unionByName(paired_by_verdict(changes.where(alone), verdicts))
    return changes.select(*RESULT)


#: Pairs of rules that a provider is asked about at a time.
VERDICTS_AT_A_TIME = 20


def paired_by_verdict(alone: DataFrame, verdicts: Callable[[list[tuple[str, str]]], list[dict | None]]) -> DataFrame:
    """RESULT rows of rules without a match, some of them paired by a provider's verdicts.

    Candidates are removed and added rules of one type and category. ``verdicts`` gets pairs of normal forms, VERDICTS_AT_A_TIME
    at most, and returns for each a dict with "same", and where that holds change_type, impact, confidence and reason; None or an
    error leaves the pair unmatched. Of the accepted pairs each old rule, in order, gets its first free one. What stays alone is
    removed and added, as it came."""
    gone = alone.where("new IS NULL").select("pair", "old_seq", F.col("old.type").alias("type"), F.col("old.cat").alias("cat"), F.col("old.norm").alias("old_norm"))
    come = alone.where("old IS NULL").select("pair", "new_seq", F.col("new.type").alias("type"), F.col("new.cat").alias("cat"), F.col("new.norm").alias("new_norm"))
    asked = gone.join(come, ["pair", "type", "cat"]).select("pair", "old_seq", "new_seq", "cat", "old_norm", "new_norm")
    kind = alone.schema["pair"].dataType.simpleString()
    schema = f"pair {kind}, old_seq long, new_seq long, category string, change_type string, impact string, confidence double, reason string"
    names = [c.split()[0] for c in schema.split(", ")]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for at in range(0, len(b), VERDICTS_AT_A_TIME):
                part = b.iloc[at : at + VERDICTS_AT_A_TIME]
                try:
                    said = verdicts(list(zip(part["old_norm"], part["new_norm"])))
                except Exception:  # a provider that fails decides nothing: the rules stay removed and added
                    said = [None] * len(part)
                rows += [(r.pair, r.old_seq, r.new_seq, r.cat, v.get("change_type", "modified"), v.get("impact", "uncertain"), float(v.get("confidence", 0.5)), v.get("reason", "verdict")) for r, v in zip(part.itertuples(), said) if v and v.get("same")]
            yield pd.DataFrame(rows, columns=names)

    accepted = asked.mapInPandas(ask, schema)
    offer = F.struct("new_seq", "category", "change_type", "impact", "confidence", "reason")
    offers = accepted.groupBy("pair", "old_seq").agg(F.array_sort(F.collect_list(offer)).alias("offers"))
    rows = offers.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("old_seq", "offers"))).alias("olds"))
    of_offer = "struct<new_seq:bigint,category:string,change_type:string,impact:string,confidence:double,reason:string>"
    state = f"struct<taken:array<bigint>,out:array<struct<old_seq:bigint,o:{of_offer}>>>"

    def step(s: Column, o: Column) -> Column:
        first = F.get(F.filter(o["offers"], lambda x: ~F.array_contains(s["taken"], x["new_seq"])), F.lit(0))
        taken = F.struct(F.concat(s["taken"], F.array(first["new_seq"])).alias("taken"), F.concat(s["out"], F.array(F.struct(o["old_seq"].alias("old_seq"), first.alias("o")))).alias("out")).cast(state)
        return F.when(first.isNull(), s).otherwise(taken)

    done = rows.select("pair", F.explode(F.aggregate("olds", F.struct(F.array().alias("taken"), F.array().alias("out")).cast(state), step)["out"]).alias("m"))
    doubt = (F.col("impact") == "uncertain") | (F.col("confidence") < 0.7)
    both = done.select("pair", "m.old_seq", "m.o.*").withColumn("review_required", doubt).select(*RESULT)
    # One row names the rules of either side that are paired now.
    taken = both.select("pair", F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("old_seq").alias("seq")), F.struct(F.lit("new").alias("side"), F.col("new_seq").alias("seq")))).alias("t")).select("pair", "t.*")
    rest = alone.withColumns({"side": F.when(F.col("old").isNull(), "new").otherwise("old"), "seq": F.coalesce("old_seq", "new_seq")}).join(taken, ["pair", "side", "seq"], "left_anti")
    return both.unionByName(rest.select(*RESULT))


def summarise(changes: DataFrame) -> DataFrame:
    """Per pair: numbers of changes, relevance, whether a review is needed, and a sentence."""
    n = lambda c: F.count_if(F.col("change_type") == c)
    real = F.col("impact").isin("eligibility_more_restrictive", "eligibility_less_restrictive", "exclusion_added", "exclusion_removed") & (F.col("change_type") != "unchanged")
    out = changes.groupBy("pair").agg(*[n(c).alias(c) for c in ("added", "removed", "modified", "unchanged")], F.count_if(real).alias("_real"), F.count_if(F.col("impact") == "uncertain").alias("_uncertain"), (F.count_if(F.col("review_required") | F.col("reason").isNotNull()) > 0).alias("review_required"))
    relevance = F.when(F.col("_real") > 0, RULE_RELEVANCE[3]).when(F.col("_uncertain") > 0, RULE_RELEVANCE[2]).when(F.col("modified") > 0, RULE_RELEVANCE[1]).otherwise(RULE_RELEVANCE[0])
    parts = F.concat_ws(", ", *[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" rule(s) {c}"))) for c in ("added", "removed", "modified", "unchanged")])
    return out.withColumn("relevance", relevance).withColumn("summary", F.when(parts == "", "No changes detected").otherwise(parts)).drop("_real", "_uncertain")
