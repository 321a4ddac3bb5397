"""Windows in slices, and operators that have no table to run on."""

import random

from pyspark.sql import functions as F

from policylake.functions import text as X
from policylake.operators import comparison, discovery, eligibility, slices, versions


def test_slices_are_one_window(spark):
    """One scheme holds nearly all rows; small slices; null schemes and values."""
    rnd = random.Random(3)
    rows = [("a" if rnd.random() < 0.9 else rnd.choice(["b", None]), i, rnd.choice([None, "x", "y", "z"])) for i in rnd.sample(range(5000), 600)]
    got = slices.with_running(spark.createDataFrame(rows, "k string, seq long, v string").repartition(5), "k", "seq", {"last": F.col("v")}, {"newest": F.col("v")}, "place", size=40).collect()
    seen, place = {}, {}
    newest = {k: next((v for kk, _, v in sorted(rows, key=lambda r: -r[1]) if kk == k and v is not None), None) for k in ("a", "b", None)}
    want = {}
    for k, seq, v in sorted(rows, key=lambda r: r[1]):
        place[k] = place.get(k, 0) + 1
        want[seq] = (k, v, seen.get(k), newest[k], place[k])
        seen[k] = v if v is not None else seen.get(k)
    assert {r.seq: (r.k, r.v, r["last"], r.newest, r.place) for r in got} == want


def test_first_of_a_common_key(spark):
    rows = [("same" if i % 3 else None, i) for i in range(300)] + [("other", 1000)]
    got = slices.with_first(spark.createDataFrame(rows, "k string, seq long").repartition(6), ["k"], "seq", "first", salts=4)
    assert {r.seq for r in got.where("first").collect()} == {0, 1, 1000} and got.count() == 301


def test_timeline_over_slices(spark):
    rnd = random.Random(5)
    rows = [("s", i, rnd.choice("abcdefgh") + str(i // 40), rnd.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame(rows, "scheme string, seq long, hash string, review boolean")
    fields = lambda d: {(r.seq, r.status, r.change_type, r.old_active) for r in d.collect()}
    assert fields(versions.version_timeline(df, "scheme", "seq", "hash", "review", slice_rows=7)) == fields(versions.version_timeline(df, "scheme", "seq", "hash", "review"))


def test_reasons_for_review(spark):
    rows = [(1, None, None, None), (2, "r", True, "SUPPORTED"), (3, "r", False, "CONTRADICTED"), (4, "r", False, None), (4, "q", None, "SUPPORTED")]
    got = versions.needs_review(spark.createDataFrame(rows, "u long, rule string, review_required boolean, consistency string"), "u").collect()
    assert {r.u: (r.review, r.reasons) for r in got} == {1: (True, ["no_rules"]), 2: (True, ["marked"]), 3: (True, ["unsupported"]), 4: (False, [])}


def test_status_changes(spark):
    v = spark.createDataFrame([(1, 7, "ACTIVE"), (2, 7, "ARCHIVED"), (3, 7, "REVIEW"), (4, 8, "ACTIVE"), (5, 9, "ACTIVE")], "id long, scheme_id long, status string")
    after = versions.set_status(v, spark.createDataFrame([(2, "ACTIVE"), (4, "ARCHIVED")], "id long, status string"))
    assert {r.id: r.status for r in after.collect()} == {1: "ARCHIVED", 2: "ACTIVE", 3: "REVIEW", 4: "ARCHIVED", 5: "ACTIVE"}
    assert after.where("status = 'ACTIVE'").groupBy("scheme_id").count().where("count > 1").count() == 0


def test_insert_if_absent(spark):
    known = spark.createDataFrame([("a",)], "slug string")
    wanted = spark.createDataFrame([("a", "A", "x", 1), ("b", "B", "y", 3), ("b", "B2", "z", 2)], "slug string, name string, department string, seq long")
    assert [tuple(r) for r in versions.schemes_to_add(wanted, known).select("slug", "name", "seq").collect()] == [("b", "B2", 2)]


def test_evidence_and_texts(spark):
    rules = spark.createDataFrame([(1, (3, "words", 80.0)), (2, (None, " ", None)), (3, None), (4, (None, "more", None))], "id long, evidence struct<page_number:int,source_text:string,ocr_confidence:double>")
    assert {(r.rule_id, r.page_number, r.evidence_text) for r in versions.evidence_rows(rules).collect()} == {(1, 3, "words"), (4, None, "more")}
    v = spark.createDataFrame([(1, 10, "old"), (2, 11, "kept"), (3, None, None)], "id long, document_id long, extracted_text string")
    t = spark.createDataFrame([(10, "new")], "document_id long, extracted_text string")
    assert {r.id: r.extracted_text for r in versions.with_texts(v, t).collect()} == {1: "new", 2: "kept", 3: None}


def test_rules_of_a_scheme(spark):
    stored = spark.createDataFrame([("a", "v1", "ARCHIVED", 1, "old"), ("a", "v2", "ACTIVE", 2, "now"), ("a", "v2", "ACTIVE", 3, " ")], "scheme_key string, version_label string, version_status string, rule_id long, rule string")
    files = spark.createDataFrame([("x_my-scheme_rules.json", 8, "filed"), ("1333e107_Allocation2021-22_rules.json", 9, "known")], "file_name string, rule_id long, rule string")
    asked = spark.createDataFrame([("a", None), ("my-scheme", None), ("rkvy", None), ("nowhere", None)], "scheme_key string, version_label string")
    got = {(r.scheme_key, r.version_label, r.rule, r.origin) for r in eligibility.scheme_rules(asked, stored, files).collect()}
    assert got == {("a", "v2", "now", "knowledge_base"), ("my-scheme", "G.O. 2023", "filed", "file"), ("rkvy", "G.O. 2023", "known", "file")}
    labelled = spark.createDataFrame([("a", "v1")], "scheme_key string, version_label string")
    assert [r.rule for r in eligibility.scheme_rules(labelled, stored, files).collect()] == ["old"]


def test_reasons_name_what_is_missing(spark):
    rules = spark.createDataFrame([("s", 1, "Must be a woman who is the head of the family", "eligibility", "candidate", "SUPPORTED", False), ("s", 2, "Students who have failed or repeat are excluded", "exclusion", "candidate", "SUPPORTED", False)], "scheme_key string, rule_id long, rule string, type string, rule_scope string, consistency string, review_required boolean")
    rows = [(1, "male", None, None, None, False, None), (2, None, None, None, None, None, None), (3, "female", True, True, "BPL", True, True), (4, "female", True, False, "XYZ", None, False)]
    people = spark.createDataFrame(rows, "who long, gender string, household_head boolean, listed_as_head_in_ration_card boolean, ration_card_type string, failed_semester boolean, repeating_year boolean")
    got = {(r.who, r.rule_id): r.reason for r in eligibility.evaluate_rules(people, rules).collect()}
    assert got[1, 1] == "Citizen gender is 'male', scheme requires woman head of household."
    assert got[2, 1] == "Required information unknown: household head status, listed as head in ration card, gender."
    assert got[3, 1] == "Citizen is confirmed as woman head of family listed in ration card."
    assert got[4, 1] == "Citizen does not satisfy criteria: not listed as head in ration card, ineligible ration card type 'XYZ'."
    assert got[3, 2] == "Citizen triggers exclusion: failed semester, repeating academic year."
    assert got[2, 2] == "Academic pass/fail or course repetition status is unknown."


def test_table_forms(spark):
    df = spark.createDataFrame([([("Full Name:", " "), ("Mail", "a@b"), ("name again", None)],), ([],)], "rows array<struct<col0:string,col1:string>>")
    got = [r.f for r in df.select(X.table_form_fields("rows", [("Name", "name"), ("Mail", "mail")]).alias("f")).collect()]
    assert [(x.label, x.value) for x in got[0].fields] == [("Name", None), ("Mail", "a@b")] and got[0].blanks == 2
    assert got[1].fields == [] and got[1].blanks == 0


def test_changes_are_checked(spark):
    rows = [(1, "eligibility_related", None, None, "Annual income limit raised to rs. 50000"), (1, "procedural", "none", None, "x"), (2, "eligibility_related", "clearly_relevant", None, "sent to the treasury")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "doc long, category string, eligibility_relevance string, affected_attribute string, description string, old_evidence string, new_evidence string")
    got = comparison.checked_changes(df, ["treasury"])
    assert {(r.doc, r.category, r.eligibility_relevance, r.affected_attribute) for r in got.collect()} == {(1, "eligibility_related", "clearly_relevant", "income"), (1, "procedural", "none", None), (2, "procedural", "none", None)}
    assert {r.doc: (r.relevance, r.review_required) for r in comparison.relevance_of_changes(got, "doc").collect()} == {1: ("clearly_relevant", False), 2: ("none", False)}


def test_verdicts_of_documents(spark):
    long = "The applicant must live in the state and own land of his own in it."
    pairs = {1: ("h", "h", "a", "a", "x", "y"), 2: ("h", "g", "a", "a", long, long), 3: ("h", "g", "a", "b", long, "Nothing at all is alike here"), 4: ("h", "g", "a", "a", "word" + long, "werd" + long), 5: ("h", "g", "a", "a", long, long + " And 5 more.")}
    doc = lambda i: spark.createDataFrame([(k, v[i], v[2 + i], {"m": "1"}) for k, v in pairs.items()], "pair long, sha256 string, title string, meta map<string,string>")
    page = lambda i: spark.createDataFrame([(k, 1, v[4 + i]) for k, v in pairs.items()], "pair long, page_number int, text string")
    got = {r.pair: r.status for r in comparison.compare_documents(doc(0), doc(1), page(0), page(1)).collect()}
    assert got == {1: "identical", 2: "unchanged", 3: "different_document", 4: "unchanged", 5: "possible_change"}


def test_references_of_a_page(spark):
    """The examples of RFC 3986 for a base of http://a/b/c/d;p?q, and what is left of real pages."""
    want = {"g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "g#s": "http://a/b/c/g#s", ";x": "http://a/b/c/;x", ".": "http://a/b/c/"}
    want |= {"..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h"}
    html = "".join(f'<a href="{h}">x</a>' for h in want)
    got = [r.url for r in discovery.page_links(spark.createDataFrame([(1, "http://a/b/c/d;p?q", html)], "page_id long, url string, html string")).orderBy("pos").collect()]
    assert got == list(dict.fromkeys(want.values()))
    pages = {
        1: ("https://x.org", '<a href="a.html">A</a><a href="?p=2">2</a><a href="">none</a><a href="http://[bad">bad</a>'),
        2: ("https://x.org/d/p.html", '<base href="/e/"><base href="/f/"><a href=b.html title=" T&eacute; ">b <i>c</i><br>d</a>'),
        3: ("https://x.org/d/p.html", "<!-- <a href='no'>no</a> --><style>a{}</style><a href='y?a=1&amp;b=2'>y<script>z()</script></a><a name=n>n</a><a href='ftp://x/y'>f</a>"),
        4: (None, "<a href='/rel'>lost</a><a href='https://ok.org/'>ok</a>"),
        5: ("https://x.org", None),
    }
    df = spark.createDataFrame([(k, *v) for k, v in pages.items()], "page_id long, url string, html string")
    got = sorted((r.page_id, r.url, r.text, r.title) for r in discovery.page_links(df).collect())
    assert got == [(1, "https://x.org/a.html", "A", ""), (1, "https://x.org?p=2", "2", ""), (2, "https://x.org/e/b.html", "b c d", "T\u00e9"), (3, "https://x.org/d/y?a=1&b=2", "y", ""), (4, "https://ok.org/", "ok", "")]


def test_names_that_share_a_word(spark):
    """A word that all of 30 000 schemes have, words of one scheme, short ones, and none."""
    known = spark.range(30_000).select("id", F.concat(F.lit("common-"), F.hex("id")).alias("slug"), F.concat(F.lit("Common programme No "), F.col("id").cast("string")).alias("name"))
    asked = spark.createDataFrame([(1, "the COMMON scheme"), (2, "common-7530"), (3, "programme 29999"), (4, "xyz of nothing"), (5, "no"), (6, None), (7, ""), (8, "unheard common")], "query_id long, query string")
    got = {r.query_id: r.id for r in versions.find_scheme(asked, known).collect()}
    assert got == {1: 0, 2: 0x7530 if 0x7530 < 30_000 else 0, 3: 0, 8: 0}


def test_contained_is_containment(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abc ") for _ in range(rnd.randrange(0, 14))) for _ in range(300)]
    needles = sorted({"".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 6))) for _ in range(80)}) + ["zzz", "abz"]
    t = spark.createDataFrame([*enumerate(texts), (999, None)], "id long, text string")
    got = versions.contained(spark.createDataFrame([(n,) for n in [*needles, None, ""]], "needle string"), t, ["id"]).collect()
    assert sorted((r.needle, r.id) for r in got) == sorted((n, i) for n in needles for i, x in enumerate(texts) if n in x)
