"""Reviews, downloads, sources of a scheme, and the stages that ask a model."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from policylake import providers
from policylake.operators import comparison, discovery, matching, versions


def test_review_reasons(spark):
    rules = spark.createDataFrame([(1, "r", False, "SUPPORTED"), (2, None, None, None), (3, "r", True, None), (4, "r", None, "CONTRADICTED"), (5, "r", False, None), (6, "r", None, None), (None, "r", None, None)], "id long, rule string, review_required boolean, consistency string")
    said = spark.createDataFrame([(1, None, "none"), (5, True, "none"), (6, None, "uncertain"), (None, True, None), (9, True, None)], "id long, review_required boolean, relevance string")
    got = {r.id: (r.reasons, r.review) for r in versions.needs_review(rules, "id", F.col("id") == 4, said).collect()}
    assert got == {1: ([], False), 2: (["no_rules"], True), 3: (["marked"], True), 4: (["forced", "unsupported"], True), 5: (["comparison"], True), 6: (["uncertain"], True), None: (["comparison"], True)}
    assert not versions.needs_review(rules.where("id = 1"), "id").first().review


def test_last_text_counts(spark):
    v = spark.createDataFrame([(1, 10, "old")], "id long, document_id long, extracted_text string")
    t = spark.createDataFrame([(10, 1, "zzz"), (10, 2, "aaa"), (10, 3, None)], "document_id long, seq long, extracted_text string")
    assert versions.with_texts(v, t).first().extracted_text == "aaa"


def test_document_beside_version(spark):
    v = spark.createDataFrame([(1, "h", "own"), (2, "g", "own"), (3, None, "own")], "id long, document_hash string, source_url string")
    d = spark.createDataFrame([(7, "h", "p7", "u7"), (8, "h", "p8", "u8"), (9, "g", "p9", None), (10, None, "p", "u")], "id long, sha256 string, local_path string, source_url string")
    got = {r.id: (r.document_id, r.local_path, r.source_url) for r in versions.versions_with_documents(v, d).collect()}
    assert got == {1: (8, "p8", "u8"), 2: (9, "p9", "own"), 3: (None, None, "own")}


def test_sources_of_a_scheme(spark):
    df = spark.createDataFrame([("Raitha Mitra", "x"), ("Farm", "Agriculture"), ("Power", "Energy Dept"), (None, None)], "source_name string, department string")
    names = lambda **k: sorted(str(r.source_name) for r in discovery.sources_for(df, **k).collect())
    assert names(department="energy") == ["Power"] and len(names(department="none such")) == 4
    assert names(scheme="PM-Kisan") == ["Farm", "Raitha Mitra"] and names(scheme="gruha jyothi") == ["Power"]
    assert len(names(scheme="anna bhagya")) == 4 and len(names(scheme="else")) == 4 and len(names()) == 4


class Fetched:
    def fetch(self, url):
        if "lost" in url:
            raise OSError(url)
        return {"http://a": b"one", "http://b": b"one", "http://c": b"known"}.get(url, b"")


def test_downloads(spark):
    known = spark.createDataFrame([(hashlib.sha256(b"known").hexdigest(), "http://old")], "file_hash string, document_url string")
    urls = spark.createDataFrame([("http://a",), ("http://b",), ("http://b",), ("http://c",), ("http://lost",), (None,)], "url string")
    got = {r.url: (r.status, r.document_url) for r in providers.download_and_register(urls, Fetched, known).collect()}
    assert got == {"http://a": ("new", "http://a"), "http://b": ("unchanged", "http://a"), "http://c": ("unchanged", "http://old"), "http://lost": ("download_failed", None), None: ("download_failed", None)}


@pytest.mark.parametrize(
    "answer, want",
    [
        ('{"a": [1, 2}', {"a": [1, 2]}),
        ('Sure:\n```json\n{"a": "b"}\n```', {"a": "b"}),
        ('{"a": "he said "yes" to it", "b": 1,}', {"a": 'he said "yes" to it', "b": 1}),
        ('{"a": "line\nbreak", "b": [1, 2,', {"a": "line\nbreak", "b": [1, 2]}),
        ('{"a": {"b": "c', {"a": {"b": "c"}}),
        ('{"a": "x\\"y"} and {"more": 1}', {"a": 'x"y'}),
        ('{"exclusion_rules": [{"rule": "r1"}, {"rule": "the "best" one"', {"exclusion_rules": [{"rule": "r1"}, {"rule": 'the "best" one'}]}),
        ('{"excluded": [{"rule": "r1"}], "others": [{"rule": "r2", "evidence": "e"}', {"eligibility_rules": [{"type": "eligibility", "evidence": "e", "rule": "r2"}], "exclusion_rules": [{"type": "exclusion", "evidence": "", "rule": "r1"}]}),
        ('{bad {"rule": "r3"} worse', {"eligibility_rules": [{"type": "eligibility", "evidence": "", "rule": "r3"}], "exclusion_rules": []}),
    ],
)
def test_answers_are_mended(answer, want):
    assert providers.repair_json(answer) == want


def test_closing_is_idempotent():
    for text in ('{"a": [1, {"b": "c"', '{"a": "x"y", "z": ]}', "{", '{"a": 1}}}'):
        once = providers.closed_json(text)
        json.loads(once) if text != '{"a": "x"y", "z": ]}' else None
        assert providers.closed_json(once) == once


def compared(spark):
    long = "The applicant must live in the state and own land of his own in it."
    texts = {1: [(1, long, long + " And 5 more."), (2, "word" + long, "werd" + long)], 2: [(1, long, long + " Or 6 more.")], 3: [(1, "word" + long, "werd" + long)], 4: [(1, long, long + " Send 3 copies to the office.")]}
    doc = lambda h: spark.createDataFrame([(k, f"{h}{k}", "t", {"m": "1"}) for k in texts], "pair long, sha256 string, title string, meta map<string,string>")
    page = lambda i: spark.createDataFrame([(k, p[0], p[i]) for k, ps in texts.items() for p in ps], "pair long, page_number int, text string")
    pages = spark.createDataFrame([(k, *p) for k, ps in texts.items() for p in ps], "pair long, page_number int, old string, new string")
    lines = matching.line_difference(pages.select(F.struct("pair", "page_number").alias("at"), "old", "new"), "at", "old", "new").select("at.*", "removed", "added")
    return comparison.compare_documents(doc("a"), doc("b"), page(1), page(2)).cache(), lines


def test_noise_beside_changes_and_a_model(spark):
    out, lines = compared(spark)
    got = {r.pair: r for r in out.collect()}
    assert (got[1].status, got[1].pages_noise, got[1].review_required, got[1].semantic_comparison_required) == ("possible_change", 1, True, True)
    assert (got[2].status, got[2].review_required) == ("possible_change", False)
    assert (got[3].status, got[3].review_required, got[3].semantic_comparison_required) == ("unchanged", True, False)

    def ask(text):
        if "6 more" in text:
            raise ValueError("no answer")
        assert text.startswith("Page 1\nold:")
        relevant = "5 more" in text
        return {"summary": "s", "changes": [{"category": "eligibility_related" if relevant else "procedural", "eligibility_relevance": "clearly_relevant" if relevant else "none", "new_evidence": "land"}]}

    said = {r.pair: r for r in comparison.interpreted(out, lines, ask).collect()}
    assert (said[1].relevance, said[1].summary, said[1].failed) == ("clearly_relevant", "s", False)
    assert (said[2].relevance, said[2].review_required, said[2].failed) == ("uncertain", True, True)
    assert (said[3].relevance, said[3].summary) == (got[3].relevance, None) and (said[4].relevance, said[4].review_required) == ("none", False)
