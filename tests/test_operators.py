import json
import random

import pytest
from pyspark.sql import functions as F

from policylake import schemas
from policylake.operators import audit, comparison, discovery, eligibility, metrics, rules_diff, versions

HTML = """<html><body><a href="#top">up</a><a href="javascript:x()">x</a><a href="/a/scheme.html" title="t">Scheme page</a>
<a href="https://x.org/g.pdf?v=1">Guidelines  PDF</a><a href="/a/scheme.html">again</a><a href="mailto:a@b">mail</a>
<table><tr><td>1</td><td>Order of the scheme</td><td>29-01-2026</td><td><a href="o.pdf">Download</a></td></tr></table>
<p>dated 07/08/2021 <a href="/n.docx">Tender notice</a></p></body></html>"""


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_links(spark):
    pages = spark.createDataFrame([(1, "https://s.in/d/list.html", HTML), (2, "https://s.in/", None)], "page_id long, url string, html string")
    links = discovery.page_links(pages)
    assert set(rows(links, "url", "text")) == {("https://s.in/a/scheme.html", "Scheme page"), ("https://x.org/g.pdf?v=1", "Guidelines PDF"), ("https://s.in/d/o.pdf", "Download"), ("https://s.in/n.docx", "Tender notice")}
    kinds = dict(rows(links.withColumn("k", discovery.link_category("text", F.lit(""), "url")), "url", "k"))
    assert kinds["https://x.org/g.pdf?v=1"] == "document" and kinds["https://s.in/a/scheme.html"] == "scheme_page"
    docs = {r.document_url: r for r in discovery.page_documents(pages).collect()}
    order = docs["https://s.in/d/o.pdf"]
    assert (order.title, order.document_type, order.published_date, order.is_scheme_document) == ("Order of the scheme", "order", "29-01-2026", True)
    assert not docs["https://s.in/n.docx"].is_scheme_document and docs["https://s.in/n.docx"].published_date == "07/08/2021"
    assert discovery.page_documents(pages, scheme_only=True).count() == 2


def test_filter_or_all(spark):
    df = spark.range(5)
    assert discovery.filter_or_all(df, F.col("id") > 3).count() == 1
    assert discovery.filter_or_all(df, F.col("id") > 9).count() == 5


def knowledge_base(arrivals):
    """The state machine as a loop."""
    active, seen, out = {}, set(), {}
    for scheme, seq, h, review in sorted(arrivals, key=lambda a: a[1]):
        old = active.get(scheme)
        if h and (scheme, h) in seen:
            out[seq] = ("already_exists", None, old)
            continue
        seen.add((scheme, h))
        if review:
            out[seq] = ("REVIEW", "REVIEW_REQUIRED", old)
        else:
            if old is not None:
                out[old] = ("ARCHIVED", *out[old][1:])
            out[seq] = ("ACTIVE", "INITIAL_ACTIVE" if old is None else "MODIFIED", old)
            active[scheme] = seq
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_timeline_is_the_loop(spark, seed):
    rnd = random.Random(seed)
    arrivals = [(f"s{rnd.randrange(6)}", i, rnd.choice(["", None, *"abcdefgh"]), rnd.random() < 0.2) for i in range(300)]
    df = spark.createDataFrame(arrivals, "scheme string, seq long, hash string, review boolean")
    got = versions.version_timeline(df, "scheme", "seq", "hash", "review")
    assert {r.seq: (r.status, r.change_type, r.old_active) for r in got.collect()} == knowledge_base(arrivals)
    assert versions.broken_invariants(got.where("hash <> ''"), "scheme", "hash").count() == 0


def test_detect_versions_is_the_loop(spark):
    rnd = random.Random(5)
    arrivals = [(f"s{rnd.randrange(5)}", i, rnd.choice("abc")) for i in range(300)]
    active, want = {}, {}
    for scheme, seq, h in arrivals:
        want[seq] = "NEW_SCHEME" if scheme not in active else "UNCHANGED" if active[scheme] == h else "NEW_VERSION"
        active[scheme] = h
    got = versions.detect_versions(spark.createDataFrame(arrivals, "scheme string, seq long, hash string"), "scheme", "seq", "hash")
    assert dict(rows(got, "seq", "change")) == want
    assert got.where("version_status = 'ACTIVE'").groupBy("scheme").count().where("count <> 1").count() == 0


def test_registry(spark):
    e = spark.createDataFrame([("u1", 1, "a", True), ("u2", 2, "b", True), ("u1", 3, "c", False)], "official_url string, seq long, department string, active boolean")
    assert sorted(rows(versions.registry(e), "official_url", "id", "department", "active")) == [("u1", 1, "c", False), ("u2", 2, "b", True)]
    s = spark.createDataFrame([("x", "X", "d", 1), ("x", "X2", None, 2)], "slug string, name string, department string, seq long")
    assert rows(versions.schemes(s), "id", "name", "department") == [(1, "X2", "d")]
    r = spark.createDataFrame([(1, "r", "t", None, 1), (1, "r", "t", "other", 2), (2, "r", "t", None, 3)], "version_id long, rule string, type string, category string, seq long")
    assert sorted(rows(versions.store_rules(r), "version_id", "seq")) == [(1, 1), (2, 3)]


def test_scheme_lookup(spark):
    known = spark.createDataFrame([(1, "pm-kisan", "PM Kisan"), (2, "gruha-lakshmi", "Gruha Lakshmi"), (3, "kisan-credit", "Credit")], "id long, slug string, name string")
    asked = spark.createDataFrame([(1, "gruha-lakshmi"), (2, "the kisan scheme"), (3, "credit card"), (4, "nothing")], "query_id long, query string")
    assert sorted(rows(versions.find_scheme(asked, known), "query_id", "id")) == [(1, 2), (2, 1), (3, 3)]


def test_pages(spark):
    old = spark.createDataFrame([(1, 1, "same  text"), (1, 2, "the annual income is 5000 rupees in all cases of this page"), (1, 3, "a long page of words that were read by a machine once"), (1, 5, "gone")], "pair long, page_number int, text string")
    new = spark.createDataFrame([(1, 1, "same text"), (1, 2, "the annual income is 9000 rupees in all cases of this page"), (1, 3, "a long page of words that were read by a machlne once"), (1, 9, "new")], "pair long, page_number int, text string")
    got = {r.page_number: (r.status, r.ocr_noise) for r in comparison.compare_pages(old, new).collect()}
    assert got == {1: ("unchanged", False), 2: ("modified", False), 3: ("unchanged", True), 5: ("removed", False), 9: ("added", False)}
    meta = spark.createDataFrame([(1, {"a": "1", "b": "2"})], "pair long, meta map<string,string>")
    other = spark.createDataFrame([(1, {"a": "1", "c": "3"})], "pair long, meta map<string,string>")
    assert sorted(rows(comparison.metadata_changes(meta, other), "key", "old_value", "new_value")) == [("b", "2", None), ("c", None, "3")]


def test_relevance_orders(spark):
    df = spark.createDataFrame([("uncertain",), ("potentially_relevant",)], "r string")
    assert df.select(comparison.strongest("r", comparison.DOCUMENT_RELEVANCE)).first()[0] == "potentially_relevant"
    assert df.select(comparison.strongest("r", comparison.RULE_RELEVANCE)).first()[0] == "uncertain"


def test_table_rows(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0, "a"), (1, 5.0, 12.0, "b"), (1, 0.0, 20.0, "c"), (1, 9.0, 34.0, "d")], "t long, x double, y double, text string")
    assert sorted(rows(comparison.rows_of_table(cells, "t"), "text", "row_index")) == [("a", 0), ("b", 0), ("c", 1), ("d", 1)]


def compare(spark, old, new):
    data = [(1, side, i, *r, None, "p1") for side, rs in (("old", old), ("new", new)) for i, r in enumerate(rs)]
    df = spark.createDataFrame(data, "pair long, side string, seq long, rule string, type string, category string, evidence string")
    return rules_diff.compare_rules(df)


def test_rules_diff(spark):
    el = "eligibility"
    got = compare(spark, [("Income must not exceed 2 lakh", el), ("Age 18 years", el), ("Must be a resident", el), ("Pension holders are excluded", "exclusion"), ("Age 18 years!", el)], [("Income shall not exceed 3 lakh", el), ("Age 21 years", el), ("Must be a resident for 5 years", el), ("Engineer by trade", el)])
    found = {(r.old_seq, r.new_seq): (r.change_type, r.impact) for r in got.collect()}
    assert found[(0, 0)] == ("modified", "eligibility_less_restrictive") and found[(1, 1)] == ("modified", "eligibility_more_restrictive")
    assert found[(3, None)] == ("removed", "exclusion_removed") and found[(None, 3)] == ("added", "eligibility_more_restrictive")
    total = rules_diff.summarise(got).first()
    assert total.relevance == "clearly_relevant" and total.review_required and total.added == 1


def test_greedy_order(spark):
    """An earlier rule of the same category takes the match before an equal text later on."""
    el = "eligibility"
    got = compare(spark, [("Age 18 years", el)], [("Age 21 years", el), ("Age 18 years", el)])
    assert {(r.old_seq, r.new_seq): r.change_type for r in got.collect()} == {(0, 0): "modified", (None, 1): "added"}


def test_audit(spark):
    good = "the farmer of the state is read in the order and dated for the plan"
    rule = "struct<rule:string,type:string,category:string,evidence:string,ocr_confidence:double,semantic_confidence:string>"
    df = spark.createDataFrame([(1, [("Farmer of the state", None, "other", good, 90.0, "1.0"), ("null", None, None, None, None, None)], [("No exclusions mentioned", None, None, "x", 1.0, "x")]), (2, None, None)], f"doc long, el array<{rule}>, ex array<{rule}>")
    flat = audit.flatten_extraction(df, "doc", "el", "ex")
    assert rows(flat, "doc", "rule", "type") == [(1, "Farmer of the state", "eligibility")]
    r = audit.audit_rules(flat).first()
    assert (r.semantic_confidence, r.consistency, r.review_required) == (0.90, "SUPPORTED", False)
    weak = audit.audit_rules(flat.withColumn("ocr_confidence", F.lit(10.0))).first()
    assert weak.semantic_confidence == 0.70 and weak.review_reasons == ["weak:ocr"]


RULE_COLUMNS = "scheme_key string, rule_id long, rule string, type string, rule_scope string, consistency string, review_required boolean"


def decide(spark, rules, **citizen):
    kinds = {k: v for k, v in eligibility.CITIZEN.items() if k in citizen}
    c = spark.createDataFrame([(1, *citizen.values())], "citizen long" + "".join(f", {k} {kinds[k]}" for k in citizen))
    r = spark.createDataFrame([("s", i, *x) for i, x in enumerate(rules)], RULE_COLUMNS)
    evaluated = eligibility.evaluate_rules(c, r)
    return eligibility.decide(evaluated, ["citizen", "scheme_key"]).first(), [x.status for x in evaluated.orderBy("rule_id").collect()]


def rule(text, kind="eligibility", scope="candidate", consistency="SUPPORTED", review=False):
    return text, kind, scope, consistency, review


def test_decisions(spark):
    income, tax = rule("Annual income must not exceed Rs 50000"), rule("GST return filers", "exclusion")
    d, s = decide(spark, [income, tax], annual_income=40000.0, gst_return_filer=False)
    assert d.decision == "ELIGIBLE" and s == ["MATCH", "NO_MATCH"]
    d, s = decide(spark, [income, tax], annual_income=40000.0, gst_return_filer=True)
    assert d.decision == "NOT_ELIGIBLE" and not d.eligibility_results and len(d.exclusion_results) == 1
    assert decide(spark, [income, tax], annual_income=60000.0, gst_return_filer=False)[0].decision == "NOT_ELIGIBLE"
    assert decide(spark, [income, tax], annual_income=40000.0)[0].decision == "NEEDS_REVIEW"
    assert decide(spark, [rule("Is a resident", consistency="CONTRADICTED")], is_karnataka_resident=True)[0].decision == "NEEDS_REVIEW"
    limit = rule("Only one per household", scope="beneficiary_limit")
    claimed = [("self", True), (None, True)]
    assert decide(spark, [income, limit], annual_income=1.0, household_members=claimed)[0].decision == "NOT_ELIGIBLE"
    assert decide(spark, [income, limit], annual_income=1.0, household_members=[("self", True)])[0].decision == "ELIGIBLE"
    assert decide(spark, [income, limit], annual_income=1.0, household_members=[])[0].decision == "NEEDS_REVIEW"


def test_predicates(spark):
    status = lambda text, kind="eligibility", **c: decide(spark, [rule(text, kind)], **c)[1][0]
    assert status("woman who is the head", gender="male", household_head=True) == "NO_MATCH"
    assert status("woman who is the head", gender="female", household_head=True, listed_as_head_in_ration_card=True) == "MATCH"
    assert status("woman who is the head", gender="female", household_head=True) == "UNKNOWN"
    assert status("landless", landholding_acres=0.0) == "MATCH" and status("agricultural land", landholding_acres=0.0) == "NO_MATCH"
    assert status("failed the exam", "exclusion", repeating_year=False) == "NO_MATCH"
    assert status("income above 5 lakh", "exclusion", annual_income=600000.0) == "MATCH"
    assert status("something else", gender="male") == "UNKNOWN"
    assert status("different course", "exclusion", previous_course="MSc", current_course="MBA") == "MATCH"


def test_metrics(spark):
    t = spark.createDataFrame([("r", 1, "a", "x", False), ("r", 2, "a", "x", True), ("r", 3, "a", "x", True), ("r", 4, "b", "x", False)], "run string, step int, tool string, args string, ok boolean")
    assert [r.unnecessary for r in metrics.unnecessary_calls(t, "run", "step", "tool", "args", "ok").orderBy("step").collect()] == [False, False, True, False]
    assert [r.failures for r in metrics.retries(t, "run", "step", "tool", "ok").orderBy("step").collect()] == [1, 1, 1, 1]
    none = spark.createDataFrame([], "k string, f boolean, g boolean")
    assert metrics.precision_recall(none, [], F.col("f"), F.col("g")).first().asDict() == {"tp": 0, "fp": 0, "fn": 0, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    assert metrics.batch_metrics(none, "k", ("a",), ("b",), []).first().success_rate == 0.0


def test_schemas(spark):
    for name in schemas.TABLES:
        assert spark.createDataFrame([], schemas.schema(name)).count() == 0
    good = spark.createDataFrame([(1, " active ")], "id long, status string")
    assert schemas.checked(good, "scheme_versions").first().status == "ACTIVE"
    with pytest.raises(Exception, match="can't be"):
        schemas.checked(spark.createDataFrame([(1, "gone")], "id long, status string"), "scheme_versions").collect()


def test_sources(spark, tmp_path):
    from policylake import sources

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "12345678_b.pdf").write_bytes(b"no")
    files = sources.file_hashes(spark, str(tmp_path), "*.pdf")
    assert sorted(rows(files, "file_size", "is_pdf")) == [(2, False), (10, True)]
    failed = spark.createDataFrame([("u", "b.pdf"), ("v", "c.pdf")], "url string, file_name string")
    assert {r.url: bool(r.file_path) for r in sources.local_fallback(failed, files).collect()} == {"u": True, "v": False}
    doc = {"document": {"filename": "f"}, "pages": [{"page_number": 1, "full_text": "", "blocks": [{"text": "a"}, {"text": "b"}]}, {"page_number": 2, "full_text": "c"}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    assert sorted(rows(sources.structured_documents(spark, str(tmp_path / "d.json")), "page_number", "text")) == [(1, "a\nb"), (2, "c")]
    with pytest.raises(ValueError):
        sources.structured_documents(spark, "x.txt")
    (tmp_path / "x_rules.json").write_text(json.dumps({"scheme_name": "s", "eligibility_rules": [{"rule": "r"}], "exclusion_rules": None}))
    assert rows(sources.rule_files(spark, str(tmp_path)), "scheme_name", "list", "rule") == [("s", "eligibility", "r")]
    root = str(tmp_path / "kb")
    sources.publish(spark.range(3), root)
    sources.publish(spark.range(5), root)
    assert sources.current(spark, root).count() == 5 and sources.current(spark, root, 1).count() == 3


def test_publication(spark, tmp_path, monkeypatch):
    """Two writers on one state are told apart, a refused snapshot isn't named, readers find one at every step."""
    from policylake import sources

    root = str(tmp_path / "kb")
    with pytest.raises(FileNotFoundError):
        sources.current(spark, root)
    total = {"total": F.sum("id")}
    assert sources.publish(spark.range(4), root, "first", base=0, counts=total, valid=lambda f: f["rows"] == 4 and f["total"] == 6) == 1
    assert sources.published(spark, root) == {"snapshot": sources.published(spark, root)["snapshot"], "note": "first", "found": {"rows": 4, "total": 6}}
    with pytest.raises(ValueError):
        sources.publish(spark.range(9), root, counts=total, valid=lambda f: f["total"] < 9)
    assert sources.version(spark, root) == 1
    assert sources.publish(spark.range(5), root, base=1) == 2
    with pytest.raises(sources.Conflict):
        sources.publish(spark.range(6), root, base=1)
    create, seen = sources._create, []

    def raced(spark, folder, name, content):  # another writer takes the number between the look and the naming
        seen.append(sources.current(spark, root).count())
        if len(seen) == 1:
            create(spark, folder, name, bytearray(json.dumps({"snapshot": sources.published(spark, root, 1)["snapshot"], "note": "", "found": {}}).encode()))
        create(spark, folder, name, content)

    monkeypatch.setattr(sources, "_create", raced)
    with pytest.raises(sources.Conflict):
        sources.publish(spark.range(7), root, base=2)
    seen.clear()
    assert sources.publish(spark.range(8), root) == 5 and seen == [4, 4]
    assert [sources.current(spark, root, k).count() for k in (1, 2, 3, 4, 5)] == [4, 5, 4, 4, 8]
    assert not [f for f in (tmp_path / "kb" / "versions").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_providers(spark):
    from policylake import providers

    class Ocr:
        name = "fake"

        def __init__(self, *confidences):
            self.confidences = confidences

        def is_available(self):
            return True

        def extract(self, content, page, attempt):
            return {"avg_confidence": self.confidences[attempt - 1], "low_conf_percentage": 0.0, "attempt": attempt}

    assert providers.read_with_retry(Ocr(60, 90), b"", 1)["attempt"] == 1
    assert providers.read_with_retry(Ocr(40, 50), b"", 1)["attempt"] == 2
    assert providers.read_with_retry(Ocr(40, 30), b"", 1)["attempt"] == 1
    providers.register_engine("fake", lambda: Ocr(1, 1))
    assert providers.engine("missing", "fake").name == "fake"
    assert providers.repair_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert providers.repair_json('text {"a": 2} more') == {"a": 2}
    assert providers.repair_json('{"x": [{"rule": "r1", "type": "exclusion"}, {"rule": "r2"}, }')["exclusion_rules"][0]["rule"] == "r1"
    with pytest.raises(ValueError):
        providers.repair_json("nothing")
    tools = providers.Tools()
    tools.register("add", lambda a, b: a + b)
    assert tools.call("add", a=1, b=2)["result"] == 3 and not tools.call("sub")["success"] and not tools.call("add", a=1)["success"]


def test_stream(spark, tmp_path):
    """Out of order, in triggers of one file, with a restart and a file given again: as the batch has it."""
    from policylake import streaming

    rnd, root = random.Random(9), str(tmp_path / "stream")
    schema = "scheme string, seq long, hash string, review boolean"
    arrivals = [(rnd.choice(["s0", "s1", "s2", None]), i, rnd.choice(["a", "b", "c", "d", None, ""]), rnd.choice([True, False, False, None])) for i in range(90)]
    given = sorted(arrivals, key=lambda r: r[1] + rnd.randrange(60))
    for k, part in enumerate([given[:30], given[30:60], given[60:], given[20:40]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        if k in (1, 3):  # the second run goes on from the checkpoint of the first
            streaming.start(streaming.timeline_stream(streaming.arrivals_stream(spark, f"{root}/in", schema)), root).awaitTermination()
    got = streaming.upserted(spark, root, ["scheme", "seq"], streaming.TIMELINE)
    df = spark.createDataFrame(arrivals, schema)
    want = versions.version_timeline(df, "scheme", "seq", "hash", "review")
    cols = ["seq", "scheme", "status", "change_type", "old_active"]
    assert sorted(map(str, rows(got, *cols))) == sorted(map(str, rows(want, *cols)))
    detected = versions.detect_versions(df, "scheme", "seq", "hash")
    assert dict(rows(got, "seq", "detected")) == dict(rows(detected, "seq", "change"))
    assert len(list((tmp_path / "stream" / "out").glob("trigger=*"))) > 3


def test_first_arrivals_are_not_forgotten(spark, tmp_path):
    from policylake import streaming

    schema = "scheme string, hash string, at timestamp"
    for day in ("2024-01-01", "2024-06-01", "2024-01-02"):
        spark.createDataFrame([("s", "a", None)], schema).withColumn("at", F.lit(day).cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = streaming.first_arrivals(streaming.arrivals_stream(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 1


def greedy_by_loop(olds, news):
    """Pairs of rules as a loop over the old ones finds them; rules are (type, norm, cat, admin, limit)."""

    def fits(o, n):
        same = o[0] == n[0] and o[2] == n[2]
        return (o[0] == n[0] and o[1] == n[1]) or (o[3] and n[3]) or ((o[3] or n[3]) and o[2] == n[2] == "other") or (same and o[2] in ("income", "age", "landholding") and None not in (o[4], n[4])) or (same and o[2] in rules_diff.STATES)

    free, out = dict(news), {}
    for seq, o in olds:
        out[seq] = next((k for k, n in free.items() if fits(o, n)), None)
        free.pop(out[seq], None)
    return {*out.items(), *((None, k) for k in free)}


def test_matching_against_a_loop(spark):
    rnd, data, want = random.Random(2), [], {}
    for pair in range(60):
        sides = {}
        for side in ("old", "new"):
            sides[side] = [(k, (rnd.choice(["eligibility", "exclusion"]), rnd.choice("abc"), rnd.choice(["income", "residency", "other", "age"]), rnd.random() < 0.2, rnd.choice([None, 1.0, 2.0]))) for k in range(rnd.randrange(9))]
            data += [(pair, side, k, *r, "e") for k, r in sides[side]]
        if sides["old"] or sides["new"]:
            want[pair] = greedy_by_loop(sides["old"], sides["new"])
    df = spark.createDataFrame(data, "pair long, side string, seq long, type string, norm string, cat string, admin boolean, limit double, evidence string")
    got = {}
    for r in rules_diff.matched(df).collect():
        got.setdefault(r.pair, set()).add((r.old and r.old.seq, r.new and r.new.seq))
    assert got == want


def test_verdicts_pair_what_is_left(spark):
    el, old, new = "eligibility", ["Weavers of the village", "Widows of the village", "Orphans of the town"], ["Village weavers", "Town orphans", "Village widows"]
    data = [(1, side, i, r, el, "other", "p1") for side, rs in (("old", old), ("new", new)) for i, r in enumerate(rs)]
    df = spark.createDataFrame(data, "pair long, side string, seq long, rule string, type string, category string, evidence string")

    def verdicts(pairs):
        return [{"same": a[:4] in b or ("village" in a and "village" in b), "impact": "no_eligibility_impact", "confidence": 0.9, "change_type": "unchanged"} for a, b in pairs]

    got = {(r.old_seq, r.new_seq): r.change_type for r in rules_diff.compare_rules(df, verdicts).collect()}
    assert got == {(0, 0): "unchanged", (1, 2): "unchanged", (2, 1): "unchanged"}
    asked = rules_diff.compare_rules(df).collect()
    assert len(asked) == 6 and {r.change_type for r in asked} == {"removed", "added"}

    def fails(pairs):
        raise OSError("no model")

    assert sorted(map(str, rules_diff.compare_rules(df, fails).collect())) == sorted(map(str, asked))


def test_table_rows_by_a_loop(spark):
    rnd, cells, want = random.Random(4), [], {}
    for t in range(30):
        ys = sorted(round(rnd.uniform(-50, 200), 1) for _ in range(rnd.randrange(1, 60)))
        start, row = ys[0], 0
        for i, y in enumerate(ys):
            if y - start > 15:
                start, row = y, row + 1
            want[t, i] = row
            cells.append((t, rnd.uniform(0, 9), y, i))
    got = comparison.rows_of_table(spark.createDataFrame(cells, "t long, x double, y double, i long"), "t").collect()
    assert {(r.t, r.i): r.row_index for r in got} == want and len(got) == len(cells)
    odd = spark.createDataFrame([(None, 1.0, None, 1), (None, 1.0, 5.0, 2), (1, 1.0, None, 3)], "t long, x double, y double, i long")
    assert {r.i: r.row_index for r in comparison.rows_of_table(odd, "t").collect()} == {1: 0, 2: 0, 3: 0}


def test_context_is_cut_where_it_is_full(spark):
    rows = [("d", p, i, f"block {p}.{i} " + "x" * 20) for p in range(1, 6) for i in range(4)] + [("e", 1, 0, None), ("f", 1, 0, "short"), ("f", 2, 0, "")]
    df = spark.createDataFrame(rows, "doc string, page long, i long, text string").repartition(3)
    for most in (5, 17, 40, 131, 200, 10_000):
        got = {r.doc: r.context for r in comparison.document_context(df, "doc", "page", "i", "text", most).collect()}
        for d in "def":
            whole = "\n".join(f"--- Page {p} ---\n" + "\n".join(t or "" for dd, pp, _, t in rows if (dd, pp) == (d, p)) for p in sorted({r[1] for r in rows if r[0] == d}))
            assert got[d] == (whole if len(whole) <= most else whole[:most] + "\n... [truncated]")
