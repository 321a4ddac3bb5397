"""Toxicity, secrets, quality, revisits and media."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from policylake.llm import media, quality, secrets, toxicity, warc


def test_grammar():
    g = toxicity.Grammar({"idiot": 1.0, "fool": 1.0})
    w = lambda t: sum(x for _, _, x in g.clauses(t))
    assert w("An idiot.") == 1.0 and w("You are an idiot.") == 1.5 and w("An idiot, you know") == 1.5
    assert w("He is not an idiot.") == pytest.approx(0.25 * 1.5) and w("They said idiot.") < 1.5
    assert w('"Idiot" is a word.') == pytest.approx(0.4)
    assert w("We will kill you.") == 3.0 and w("Kill the process.") == 0.0
    assert w("idiotic words") == 0.0 and w("") == 0.0 and w(None) == 0.0
    assert len(g.clauses("An idiot. Nothing. A fool!\nIdiot")) == 3
    assert w("not here. An idiot") == 1.0  # a negation ends with its clause


def test_toxicity(spark, docs, empty):
    train = [(i, "the " * 20 + ("blarg " if i % 4 == 0 else "") + "end.") for i in range(200)]
    d = spark.createDataFrame(train, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    g = toxicity.train(d, labels)
    assert set(g.stems) == {"blar"}
    got = {r.doc_id: r for r in toxicity.score(d, g).collect()}
    assert all((got[i].predicted == 1) == (i % 4 == 0) and 0 <= got[i].score <= 1 for i in got)
    plain = toxicity.score(docs, g)
    assert plain.count() == docs.count() and plain.where("score IS NULL").count() == 0 and plain.where("predicted = 1").count() == 0
    assert toxicity.score(empty, g).count() == 0
    assert toxicity.train(d, labels.limit(0)).insults.keys() == dict.fromkeys(toxicity.INSULTS).keys()
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumn("score", F.lit(1)), g)


def test_composed_machine_against_brute_force():
    """Random clauses: each insult and threat by its distance to others, without states."""
    rnd = random.Random(12)
    g = toxicity.Grammar({"idiot": 1.0, "fool": 0.7}, {"achli": 1.3})
    words = ["idiot", "fool", "achlichkeit", "kill", "you", "not", "said", '"', "word", "other", "thing", "more"]
    for _ in range(3000):
        clause = [rnd.choice(words) for _ in range(rnd.randrange(1, 14))]
        total = 0.0
        for i, w in enumerate(clause):
            weight = {"idiot": 1.0, "fool": 0.7, "achlichkeit": 1.3, "kill": toxicity.THREAT_WEIGHT}.get(w, 0.0)
            aimed = "you" in clause[max(0, i - 4) : i] or "you" in clause[i + 1 : i + 5]
            if weight and (w != "kill" or aimed):
                weight *= toxicity.FACTORS["aimed"] if aimed else 1
                weight *= toxicity.FACTORS["negated"] if "not" in clause[max(0, i - 4) : i] else 1
                weight *= toxicity.FACTORS["reported"] if "said" in clause[:i] or clause[:i].count('"') % 2 else 1
                total += weight
        assert g.clause_weight(" ".join(clause)) == pytest.approx(total), clause


def test_ids_of_any_type_and_long_texts(spark):
    rows = [(f"k{i}", ("calm words. " * 30) + ("calm blargish words. " if i % 3 == 0 else "")) for i in range(90)] + [("long", "calm words. " * 60_000 + "a blarg. "), (None, None), ("k0", "calm")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"k{i}", int(i % 3 == 0)) for i in range(90)], "doc_id string, toxic int")
    got = {(r.doc_id, r.text): r.predicted for r in toxicity.score(d, toxicity.train(d, labels, insults={})).collect()}
    assert all(got[k] == ("blarg" in (k[1] or "")) for k in got) and len(got) == len(rows)
    kept = quality.resample(d, labels, label_col="toxic")
    assert kept.count() == len(rows)


def test_learned_lexicon_alone(spark):
    """Held-out documents with nothing but what labels teach."""
    sf = "/root/testdata/sf0.1"
    d, l = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    g = toxicity.train(d, l.where(~held_out), insults={})
    r = toxicity.score(d.join(l.where(held_out), "doc_id"), g).groupBy("toxic", "predicted").count().toPandas().set_index(["toxic", "predicted"])["count"]
    assert r[1, 1] / (r[1, 1] + r[1, 0]) > 0.85 and r.get((0, 1), 0) / r[0, 0] < 0.01


def test_clauses_and_quotations():
    g = toxicity.Grammar({"idiot": 1.0})
    weigh = lambda text: [round(w, 3) for _, _, w in g.clauses(text)]
    assert weigh("they said hello\nyou are an idiot") == weigh("they said hello. you are an idiot") == [1.5]
    assert weigh('"I am fine. All is well." you are an idiot') == [1.5]
    assert weigh('"I am fine. You are an idiot." So it is.') == [0.6]
    assert weigh('A 5" pipe.\nyou are an idiot') == [1.5]
    assert weigh("they said hello, and you are an idiot") == [0.6]


@pytest.mark.parametrize("name, least", [("toxic", 0.94)])
def test_held_out_toxicity(spark, name, least):
    sf = "/root/testdata/sf0.01"
    from policylake.llm.queries import op1_toxicity

    r = op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (r.predicted == r[name]).mean() >= least


def test_quality(spark, docs, empty):
    good = [(i, f"The word number {i} of this text is fine, and it goes on for a while.") for i in range(60)]
    bad = [(1000 + i, "SHOUT!! LOUD!! WORDS!! " * 5) for i in range(20)]
    d = spark.createDataFrame(good + bad + [(None, "The last text is fine as well, and on it goes."), (3000, None), (3001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(1000 + i, 0) for i in range(0, 20, 2)] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = quality.resample(d, labels).collect()
    assert {r.doc_id for r in got if r.kept} == set(range(60)) | {None}
    again = quality.resample(d.repartition(7), labels).select("doc_id", "gumbel_key").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in quality.resample(d, labels).select("doc_id", "gumbel_key").collect())
    assert sum(r.kept for r in quality.resample(d, labels, k=10).collect()) == 10
    assert quality.resample(empty, labels).count() == 0
    flat = quality.resample(docs, labels.limit(0))
    assert flat.count() == docs.count() and flat.where("log_ratio <> 0").count() == 0
    with pytest.raises(ValueError):
        quality.resample(d.withColumn("kept", F.lit(1)), labels)


def test_gumbel_top_k_follows_the_weights(spark):
    """Of two texts, the one with a weight larger by log 3 is drawn first three times of four."""
    u = np.random.default_rng(1).random((20000, 2))
    first = (math.log(3) - np.log(-np.log(u[:, 0])) > -np.log(-np.log(u[:, 1]))).mean()
    assert first == pytest.approx(0.75, abs=0.01)
    df = spark.range(1000).select((F.pmod(F.xxhash64("id"), F.lit(997)) / 7.0).alias("v"))
    values = sorted((r.v for r in df.collect()), reverse=True)
    for k in (1, 17, 999, 1000):
        assert quality.kth_largest(df, "v", k, bins=10) == values[k - 1]
    assert quality.kth_largest(df, "v", 0) == math.inf


def test_ngrams_by_hand():
    import pyarrow as pa

    from policylake.llm.tokenization import utf8_buffers

    texts = ["Ab ab AB 12, é!", "", None, "Te Te Te", "  "]
    buckets, edges = quality.ngram_buckets(*utf8_buffers(pa.array(texts)))
    n = [7, 0, 0, 3, 0]  # tokens
    assert np.diff(edges).tolist() == [k and 2 * k + (k - 1) + (k - 2) for k in n]
    alone, _ = quality.ngram_buckets(*utf8_buffers(pa.array(["Te Te Te"])))
    assert sorted(alone) == sorted(buckets[edges[3] : edges[4]])


def test_secrets(spark, empty):
    findings = secrets.labelled_findings(spark, 1500)
    train, held = findings.where("xxhash64(candidate) % 4 <> 0"), findings.where("xxhash64(candidate) % 4 = 0")
    model = secrets.train(train)
    from pyspark.ml.feature import VectorAssembler

    p = model.transform(VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(secrets.features(held))).toPandas()
    assert (p.prediction == p.secret).mean() > 0.9
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    text = f'Some é words. token = "{key}" more. sha256:{key} and commit {key[::-1]}, see 123e4567-e89b-12d3-a456-426614174000.'
    d = spark.createDataFrame([(1, text, "src/a", 5), (2, None, None, 5), (3, "", "x", 5), (None, text, None, 5), (1, text, "src/a", 5)], "doc_id long, text string, file string, score int")
    got = secrets.scan(d, model, path_col="file").collect()
    assert len(got) == 12 and all(text[r.start : r.start + len(r.candidate)] == r.candidate for r in got)
    first = min((r for r in got if r.doc_id is None), key=lambda r: r.start)
    assert first.secret and first.candidate == key
    assert sum(r.secret for r in got if r.doc_id is None) == 1
    assert secrets.scan(empty, model).count() == 0


T0 = 1_700_000_000
REC = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>, digest string"


def revisits(spark, rows, **options):
    df = spark.createDataFrame(rows, REC).withColumn("ts", F.timestamp_seconds("ts"))
    return {r.record_id: r for r in warc.resolve_revisits(df, **options).collect()}


def test_revisits(spark):
    rows = [
        (1, "http://A.org/x?utm_s=1#f", T0, "response", 200, '"a"', "m1", {"Content-Type": "t", "Date": "d1"}, "D1"), (2, "https://a.org/x", T0 + 10, "response", 500, '"b"', None, None, "D2"),
        (3, "a.org/x/", T0 + 20, "revisit", 304, 'W/"a"', None, {"DATE": "d2", "X": "y"}, None), (4, "http://a.org/x", T0 + 90000, "revisit", 304, '"z"', "m1", {"Date": "d3"}, None),
        (5, "http://a.org/x", T0 + 90000, "revisit", 304, None, "m1", None, None), (6, "http://a.org/x", T0 + 90001, "revisit", 304, "", None, None, None),
        (7, "http://b.org/", T0, "revisit", 304, None, None, None, None), (8, None, T0, "revisit", 304, None, None, None, None), (9, "http://a.org/x", None, "revisit", 304, '"a"', None, None, None),
        (10, "http://a.org/x", T0 - 5, "revisit", 304, '"a"', None, None, None), (0, "http://a.org/x", T0, "revisit", 304, '"a"', None, None, None),
    ]
    for width in (warc.SLICE, 15, 10**7):
        got = revisits(spark, rows, slice_seconds=width)
        assert {k: r.outcome for k, r in got.items()} == {3: "resolved", 4: "mismatch", 5: "resolved", 6: "unvalidated", 7: "missing", 8: "missing", 9: "missing", 10: "missing", 0: "missing"}
        assert got[3].headers == {"content-type": "t", "date": "d2"} and got[3].digest == "D1" and got[3].response_id == 1
        assert got[4].headers == {"date": "d3"} and got[4].digest is None
    assert revisits(spark, []) == {}


def test_many_captures_of_one_url(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, "http://h/x", T0 + rnd.randrange(400_000), rnd.choice(["response", "revisit"]), 200, '"e"', None, {"a": "b"}, f"D{i}") for i in range(400)]
    got = revisits(spark, rows)
    full = sorted((r[2], r[0]) for r in rows if r[3] == "response")
    for r in rows:
        if r[3] == "revisit":
            before = [x for x in full if x < (r[2], r[0])]
            assert got[r[0]].response_id == (before[-1][1] if before else None)


def wav(samples):
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0;"
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + struct.pack("<iiHHIIiiII", 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd12\xff\x0034\xff\xd9"
PDF = b"%PDF-1.4\nbody\nstartxref\n0\n%%EOF"
ZIP = b"PK\x03\x04" + b"x" * 30 + b"PK\x01\x02" + b"y" * 42 + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, 46, 34, 0)
GZIP = zlib.compressobj(9, zlib.DEFLATED, 31)
GZIP = GZIP.compress(b"hello" * 50) + GZIP.flush()
PNG = media.png(media.payload_of(b"some text"))
OGG = b"OggS\0" + b"\0" * 21 + b"\x01\x05" + b"hello"
FLAC = b"fLaC\x80\0\0\x22" + b"\0" * 34 + b"frames"


@pytest.mark.parametrize("kind, blob", [("image/png", PNG), ("audio/wav", wav(b"abcd")), ("image/gif", GIF), ("image/bmp", BMP), ("image/jpeg", JPEG), ("application/pdf", PDF), ("application/zip", ZIP), ("application/gzip", GZIP), ("audio/ogg", OGG), ("audio/flac", FLAC)])
def test_sniff(kind, blob):
    assert media.sniff(blob) == [(kind, 0, len(blob))]
    if kind != "audio/flac":  # its frames reach to the end
        found = media.sniff(b"text BM PK " + blob + b" tail")
        assert (kind, 11, len(blob)) in found and len(found) == 1
        assert media.sniff(blob[:-1]) == []  # cut short


def test_broken_media():
    assert media.sniff(PNG[:40] + b"X" + PNG[41:]) == []
    assert media.sniff(b"") == [] and media.sniff(b"GIF89a") == [] and media.sniff(b"BM" * 50) == []
    assert [k for k, _, _ in media.sniff(PNG + b"--" + GIF + wav(b"zz"))] == ["image/png", "image/gif", "audio/wav"]


def test_media_columns(spark, docs, rows, empty):
    stored = media.text_to_media(docs)
    sniffed = media.sniff_media(stored)
    assert sniffed.where("NOT (confirmed AND corrected AND media_type = 'image/png' AND n_media = 1)").count() == 0
    got = media.sample_features(sniffed).collect()
    want = sorted((i, len((t or "").encode()), media.payload_of((t or "").encode())) for i, t in rows if i is not None)
    assert sorted((r.doc_id, r.n_bytes, bytes(r.payload)) for r in got if r.doc_id is not None) == want
    assert all(len(r.payload) % 576 == 0 and len(r.payload) for r in got)
    odd = spark.createDataFrame([(1, bytearray(b"junk" + GIF), "image/png"), (2, None, "a/b"), (3, bytearray(GIF), "image/gif")], "doc_id long, media binary, declared_type string")
    r = {x.doc_id: x for x in media.sniff_media(odd).collect()}
    assert (r[1].media_type, r[1].confirmed, r[1].carved[0].offset, bytes(r[1].carved[0].media)) == ("image/png", False, 4, GIF)
    assert not r[2].n_media and r[2].media_type == "a/b" and r[3].confirmed and not r[3].corrected
    assert media.sniff_media(media.text_to_media(empty)).count() == 0
    with pytest.raises(ValueError):
        media.sniff_media(odd.withColumn("carved", F.lit(1)))


def test_repeated_magic_numbers_are_read_once():
    import io
    import time
    import zipfile

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("a", "b")
    pdf = b"%PDF-1.4 x startxref 0 %%EOF"
    blob = b"junk" + made.getvalue() + b" " + pdf + b"\n" + pdf
    assert [(k, blob[a : a + n]) for k, a, n in media.sniff(blob)] == [("application/zip", made.getvalue()), ("application/pdf", pdf), ("application/pdf", pdf)]
    began = time.time()
    for magic in (b"PK\x03\x04", b"%PDF-1.4", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04ab"):
        assert media.sniff(magic * 100_000) == []
    assert time.time() - began < 20


def test_quality_scores_by_hand(spark):
    """log_ratio, log_weight and gumbel_key from the counts themselves, in plain Python."""
    good = [(i, f"The fine text number {i} goes on.") for i in range(30)]
    bad = [(100 + i, "LOUD!! WORDS!! 77") for i in range(12)]
    rows, labelled = good + bad, {i: 1 for i in range(0, 30, 2)} | {100 + i: 0 for i in range(0, 12, 2)}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.resample(d, spark.createDataFrame(list(labelled.items()), "doc_id long, quality int")).collect()}
    grams = {}
    for i, t in rows:
        raw = t.encode()
        grams[i] = quality.ngram_buckets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()
    raw_n, target_n = {}, {}
    for i, gs in grams.items():
        for x in gs:
            raw_n[x] = raw_n.get(x, 0) + 1
            if labelled.get(i) == 1:
                target_n[x] = target_n.get(x, 0) + 1
    ratio = lambda x: math.log((target_n.get(x, 0) + 1) / (sum(target_n.values()) + quality.BUCKETS)) - math.log((raw_n[x] + 1) / (sum(raw_n.values()) + quality.BUCKETS))
    means = {}
    for i, gs in grams.items():
        want = sum(ratio(x) for x in gs)
        assert got[i].n_grams == len(gs) and got[i].log_ratio == pytest.approx(want, abs=1e-3)
        means[i] = want / len(gs)
    margins = {(r.log_ratio - r.log_weight) / r.n_grams for r in got.values()}
    assert max(margins) - min(margins) < 1e-6
    margin = margins.pop()
    assert max(means[i] for i, y in labelled.items() if not y) < margin < min(means[i] for i, y in labelled.items() if y)
    keys = sorted((r.gumbel_key for r in got.values()), reverse=True)
    k = sum(r.log_weight > 0 for r in got.values())
    assert all(r.kept == (r.gumbel_key >= keys[k - 1]) for r in got.values())


def test_revisits_given_twice(spark):
    rows = [(1, "http://h/a", 0, "response", 200, "x", None, {"Vary": "a"}, "d"), (2, "http://h/a", 10, "revisit", 304, "x", None, None, None)]
    df = spark.createDataFrame([*rows, rows[1]], "record_id long, url string, s long, kind string, status int, etag string, last_modified string, headers map<string,string>, digest string").withColumn("ts", F.timestamp_seconds("s")).withColumn("canonical_note", F.lit(1))
    got = warc.resolve_revisits(df).collect()
    assert [(r.record_id, r.response_id, r.outcome, r.digest) for r in got] == [(2, 1, "resolved", "d")] * 2


def test_forest_uses_what_the_method_names(spark):
    """Path, quotes, transitions and letter pairs matter; findings the forest hasn't seen, and look-alikes in documents."""
    from pyspark.ml.feature import VectorAssembler

    model = secrets.train(secrets.labelled_findings(spark))
    weight = dict(zip(secrets.FEATURES, model.featureImportances.toArray()))
    assert all(weight[f] > 0 for f in ("length", "transitions", "pairs", "covered", "test_path", "quoted", "key_before"))
    unseen = secrets.features(secrets.labelled_findings(spark, 2000, first=50_000))
    r = model.transform(VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(unseen)).selectExpr("avg(double(prediction = secret))").first()[0]
    assert r > 0.97
    key = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"
    texts = [("src/app", f'token = "{key}" and'), ("test/data", f'token = "{key}" and'), ("src/app", f"sha256:{key} more"), ("src/app", 'token = "your_token_here_value_1234"'), ("src/app", "long. " * 50_000 + f'api_key = "{key}"')]
    d = spark.createDataFrame([(i, t, p, 0) for i, (p, t) in enumerate(texts)], "doc_id long, text string, path string, start int")
    assert {r.doc_id: r.secret for r in secrets.scan(d, model, path_col="path").collect()} == {0: True, 1: False, 2: False, 3: False, 4: True}
