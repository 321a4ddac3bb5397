import pytest
from pyspark.sql import functions as F

from policylake.functions import citizens, rules, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]).select(column.alias("r")).first().r


def test_clean_page_and_title(spark):
    raw = "a\x00 b\x07\n \n\n\n c d\t"
    assert one(spark, text.clean_page("t"), t=raw) == "a b\n\n c d"
    assert one(spark, text.clean_title("t"), t="  x\n y  ") == "x y"
    assert one(spark, text.clean_title("t"), t="") == ""


def test_usable(spark):
    assert not one(spark, text.is_usable("t"), t="too few words")
    assert one(spark, text.is_usable("t"), t="w " * 10)
    assert not one(spark, text.is_usable("t"), t="w " * 10 + "�" * 30)


@pytest.mark.parametrize(
    "words, action, reasons",
    [
        ("", "RUN_OCR", ["empty"]),
        ("only four words here", "RUN_OCR", ["few_words"]),
        ("the state of the order is dated and read in the district office", "USE_DIGITAL_TEXT", []),
        ("ರೈತರು " * 12, "USE_DIGITAL_TEXT", []),
        ("x~y{z} ^_^ ;;; |||" * 10, "RUN_OCR", ["symbols", "ligatures", "vocabulary"]),
        ("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore", "RUN_OCR", ["vocabulary"]),
        ("alpha beta gamma delta epsilon zeta eta theta iota kappa", "REVIEW", ["ambiguous"]),
    ],
)
def test_reliability(spark, words, action, reasons):
    r = one(spark, text.reliability("t"), t=words)
    assert (r.action, r.reasons) == (action, reasons)


def test_names_dates_versions(spark):
    assert one(spark, text.slug("t"), t="PM  Kisan_Scheme (new)!") == "pm-kisan-scheme-new"
    assert one(spark, text.slug("t"), t="!!!") == "unnamed-scheme"
    assert one(spark, text.safe_filename("t", F.lit("0123456789")), t="https://x/a/My%20File?.pdf?x=1") == "01234567_My_File.pdf"
    assert str(one(spark, text.iso_date("t"), t="7/8/2021")) == "2021-08-07"
    assert one(spark, text.iso_date("t"), t="7.8.2021") is None
    assert one(spark, text.find_date("t"), t="dated 29.01.2026 or so") == "29.01.2026"
    assert one(spark, text.version_label("t", F.lit("u")), t="guidelines 2024_25") == "2024-25"
    assert one(spark, text.version_label("t", F.lit("u")), t="Rules v 2.1") == "v2.1"
    assert one(spark, text.version_label("t", F.lit("u"), F.lit("01-02-2019")), t="Rules") == "2019"
    assert one(spark, text.version_label("t", F.lit("u")), t="Rules") == "Initial"


def test_forms_and_pages(spark):
    fields = text.form_fields("t")
    assert one(spark, fields, t="Applicant name: ... Gender: ... Mobile no: ...") == ["Applicant Name", "Gender", "Mobile Number"]
    kind = text.page_type(F.col("u"), F.col("f"), F.col("tb"), F.col("b"))
    assert one(spark, kind, u=True, f=False, tb=True, b=6) == "MIXED"
    assert one(spark, kind, u=False, f=True, tb=True, b=0) == "FORM"


def test_rule_functions(spark):
    assert one(spark, rules.normal_form("t"), t="Income SHALL NOT exceed  Rupees 5, lakhs.") == "income must not exceed rs 5 lakh"
    assert one(spark, rules.category("t", F.lit(None).cast("string")), t="Must own land") == "landholding"
    assert one(spark, rules.category("t", F.lit(" AGE ")), t="Must own land") == "age"
    limit = lambda t, k: one(spark, rules.threshold("t", F.lit(k)), t=t)
    assert limit("up to 2.5 lakh", "income") == 250000.0 and limit("Rs 3,00,000", "income") == 300000.0
    assert limit("21 years", "age") == 21.0 and limit("between 18 and 40", "age") == 18.0
    assert limit("2 ha", "landholding") == 2.0 and limit("5 acres", "landholding") == pytest.approx(2.02343)
    assert limit("2 ha", "gender") is None
    impact = lambda k, a, b: one(spark, rules.threshold_impact(F.lit(k), F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert impact("income", 1.0, 2.0) == "eligibility_less_restrictive" and impact("age", 18.0, 21.0) == "eligibility_more_restrictive"
    assert impact("income", 1.0, None) == "uncertain" and impact("age", 1.0, 1.0) == "no_eligibility_impact"
    assert one(spark, rules.money("t"), t="₹2,50,000") == 250000.0 and one(spark, rules.first_number("t"), t="in 2024, 18 years") == 18.0
    assert one(spark, rules.numbers("t"), t="2.5 and 18-60 and 123456789") == [25, 1860]


@pytest.mark.parametrize(
    "rule, evidence, verdict",
    [
        ("", "x", "empty"), ("No exclusion rules provided", "", "absence"), ("State share", "funding pattern of the state", "funding"),
        ("Farmers of the state", "budget allocation; farmers residing in the district are eligible", "valid"), ("No change in the rule", "", "amendment"),
        ("Forwarded to the office", "", "handling"), ("To be nominated by the minister", "", "committee"), ("Some text", "", "no_condition"), ("Income below 1 lakh", "", "valid"),
    ],
)
def test_qualification(spark, rule, evidence, verdict):
    assert one(spark, rules.qualification("r", "e"), r=rule, e=evidence) == verdict


def test_grounding(spark):
    fine = "ಭೂಮಿ ಹೊಂದಿರುವ ರೈತ ವಿದ್ಯಾರ್ಥಿ ಶಿಷ್ಯವೇತನ ಪಡೆಯಲು ಕುಟುಂಬದ ವಾರ್ಷಿಕ ಆದಾಯ 5000 ಮೀರಬಾರದು"
    check = lambda r, e, k="eligibility": one(spark, rules.grounding("r", "e", F.lit(k)), r=r, e=e).asDict()
    assert check("student farmer", fine)["status"] == "SUPPORTED"
    assert check("x", "")["status"] == "INSUFFICIENT" and check("x", "abc")["stage"] == "brief"
    assert check("landless farmer", fine + " ಜಮೀನಿನ ಒಡೆಯ")["stage"] == "landowner_vs_landless"
    assert check("is eligible", fine + " ಅನರ್ಹ")["stage"] == "eligibility_polarity_inversion"
    assert check("is eligible", fine + " ಅನರ್ಹ", "exclusion")["status"] == "SUPPORTED"
    assert check("not eligible", fine + " ಅರ್ಹರು ಅನರ್ಹ", "exclusion")["status"] == "SUPPORTED"
    assert check("both parents", fine + " ಅಥವಾ")["stage"] == "both_or"
    assert check("income up to 9000", fine)["stage"] == "numbers"
    assert check("woman with ration card", fine)["stage"] == "unsupported"


def test_evidence_and_scope(spark):
    weak = lambda e, c=90.0, k="other": one(spark, rules.weak_evidence("e", F.lit(c), F.lit(k)), e=e)
    good = "the income of the state order is read and dated for the officer under the plan"
    assert weak(good) is None and weak(good, 40.0) == "ocr" and weak("short") == "short"
    assert weak("the order of the state is $$$ in the plan and read") is not None
    assert one(spark, rules.scope("r", F.lit("")), r="Only one per household") == "beneficiary_limit"
    assert one(spark, rules.scope("r", F.lit("")), r="family income below") == "household"
    assert one(spark, rules.scope("r", F.lit("")), r="apply on the portal") == "administrative"


def test_citizens(spark):
    assert one(spark, citizens.annual_income(F.lit(None).cast("double"), F.lit(20000.0))) == 240000.0
    assert one(spark, citizens.annual_income(F.lit(None).cast("double"), F.lit(90000.0))) == 90000.0
    p = one(spark, citizens.parse_profile("t"), t="Woman head, earns 20k a month, landless, passed, from Karnataka")
    assert (p.annual_income, p.gender, p.is_woman_head_of_household, p.owns_agricultural_land, p.failed_semester, p.state) == (240000.0, "female", True, False, False, "Karnataka")
    assert p.repeating_year is None and one(spark, citizens.parse_profile("t"), t="nothing said").gender is None
