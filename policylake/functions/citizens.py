"""Functions of citizens as columns. Null means unknown, never false or zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lex
from .text import col, has_any


def annual_income(annual: str | Column, income: str | Column) -> Column:
    """The annual income, else twelve times a monthly one (up to 50000), else the income as given."""
    return F.coalesce(col(annual).cast("double"), F.when(col(income) <= 50000, col(income) * 12.0).otherwise(col(income).cast("double")))


def parse_profile(text: str | Column) -> Column:
    """A struct of what free text says of a citizen; what it doesn't say is null."""
    t = F.lower(col(text))
    number = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).try_cast("double")
    in_thousands, raw = number(lex.CITIZEN_AMOUNTS["thousands"]) * 1000.0, number(lex.CITIZEN_AMOUNTS["monthly"])
    lakhs, acres = number(lex.CITIZEN_AMOUNTS["lakhs"]) * 100000.0, number(lex.CITIZEN_AMOUNTS["acres"])
    monthly = F.coalesce(raw, in_thousands)
    words = lambda name: has_any(t, lex.CITIZEN_WORDS[name])
    gender, head, landless = F.when(words("female"), "female").when(words("male"), "male"), F.when(words("head"), True), words("landless")
    card = F.coalesce(*[F.when(t.contains(mark), name) for mark, name in lex.RATION_CARDS])
    return F.struct(
        monthly.alias("income"),
        F.when(in_thousands.isNull() & lakhs.isNotNull(), lakhs).otherwise(monthly * 12.0).alias("annual_income"),
        gender.alias("gender"), head.alias("household_head"), F.when(head & (gender == "female"), True).alias("is_woman_head_of_household"),
        card.alias("ration_card_type"), F.when(words("listed"), True).alias("listed_as_head_in_ration_card"),
        F.coalesce(acres, F.when(landless, 0.0)).alias("landholding_acres"), F.coalesce(acres > 0, F.when(landless, False)).alias("owns_agricultural_land"),
        F.when(t.contains("fail"), True).when(t.contains("passed"), False).alias("failed_semester"), F.when(t.contains("repeat"), True).alias("repeating_year"),
        F.when(words("gst"), True).alias("gst_return_filer"), F.when(words("tax"), True).alias("income_tax_payer"),
        F.when(t.contains("karnataka"), "Karnataka").alias("state"), F.when(t.contains("karnataka"), True).alias("is_karnataka_resident"),
    )
