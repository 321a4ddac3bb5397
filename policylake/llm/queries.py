"""The registered queries of this subpackage: thin wrappers that apply an operator to its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, conversations, crc_resampling, decontamination, line_dedup, media, ngram_join, packing, quality, secrets, token_output, toxicity, warc
from .common import materialize, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = lambda c: F.crc32(F.col(c).cast("string")) % 5 == 0
    grammar = toxicity.train(docs, labels.where(~held_out("doc_id")))
    scored = toxicity.score(docs.select("doc_id", "text"), grammar)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "heaviest", "matched")


def op2_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.crawl_of(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    seconds = lambda c: F.unix_seconds(F.col(c))
    return found.select("record_id", "canonical", seconds("ts").alias("ts"), "response_id", seconds("response_ts").alias("response_ts"), "outcome", headers.alias("headers"), "digest")


OP2_SQL = r"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS d, 1700000000 + (page_id % 1000) * 60 AS t FROM pages),
forms AS (SELECT *, regexp_replace(url, '^https?://', 'http://') || '#again' AS other FROM p),
rec AS (
  SELECT page_id * 4 AS id, url, t AS ts, 'response' AS kind, '"' || d || '"' AS etag, 'day 0' AS modified, MAP {'content-type': 'text/html', 'cache-control': 'max-age=60', 'content-length': '32'} AS h, d AS digest FROM forms
  UNION ALL SELECT page_id * 4 + 1, other, t + 86400, 'revisit', 'W/"' || d || '"', NULL, MAP {'cache-control': 'max-age=600', 'content-length': '0', 'expires': 'never'}, NULL FROM forms
  UNION ALL SELECT page_id * 4 + 2, url, t + 172800, 'response', '"' || d || '-2"', 'day 2', MAP {'content-type': 'text/html', 'vary': 'accept'}, d FROM forms
  UNION ALL SELECT page_id * 4 + 3, other, t + 259200, 'revisit', CASE WHEN ascii(d) < 56 THEN '"' || d || '-2"' WHEN ascii(d) < 99 THEN '"' || d || '"' END, CASE WHEN ascii(d) < 101 THEN 'day 2' END, MAP {'cache-control': 'no-store', 'set-cookie': 'x'}, NULL FROM forms),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM rec),
v AS (SELECT *, regexp_extract(u, '^([^/?]*)(.*)$', 1) AS host, regexp_replace(regexp_replace(regexp_extract(u, '^([^/?]*)(.*)$', 2), '([?&])(utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '\1', 'g'), '&&+', '&', 'g') AS r FROM u),
c AS (SELECT *, regexp_replace(lower(host), ':(80|443)$', '') || regexp_replace(regexp_replace(regexp_replace(r, '\?&+', '?', 'g'), '[?&]+$', ''), '/+(\?|$)', '\1') AS canonical FROM v),
j AS (
  SELECT v.*, last_value(CASE WHEN kind = 'response' THEN {'id': id, 'ts': ts, 'etag': etag, 'modified': modified, 'h': h, 'digest': digest} END IGNORE NULLS)
    OVER (PARTITION BY canonical ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM c v),
o AS (
  SELECT *, CASE WHEN f IS NULL THEN 'missing'
    WHEN etag IS NOT NULL AND f.etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL AND f.modified IS NOT NULL THEN CASE WHEN modified = f.modified THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unvalidated' END AS outcome FROM j WHERE kind = 'revisit'),
e AS (
  SELECT *, CASE WHEN outcome IN ('resolved', 'unvalidated') THEN list_concat(
      list_filter(map_entries(f.h), lambda x: NOT list_contains(list_filter(map_keys(h), lambda k: k IN ('cache-control', 'content-location', 'date', 'etag', 'expires', 'last-modified', 'vary')), x.key)),
      list_filter(map_entries(h), lambda x: x.key IN ('cache-control', 'content-location', 'date', 'etag', 'expires', 'last-modified', 'vary'))) ELSE map_entries(h) END AS es FROM o)
SELECT id AS record_id, canonical, ts, f.id AS response_id, f.ts AS response_ts, outcome, array_to_string(list_sort(list_transform(es, lambda x: x.key || '=' || x.value)), ';') AS headers,
  CASE WHEN outcome IN ('resolved', 'unvalidated') THEN f.digest END AS digest FROM e
"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op4_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(media.text_to_media(table(spark, sf_dir, "documents")), "media")
    described = media.sample_features(media.sniff_media(stored))
    return described.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 31, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    found = secrets.scan(table(spark, sf_dir, "documents"), model, path_col="source")
    return found.select("doc_id", "start", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "secret")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_OP7_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_OP7_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_OP7_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, p, p + 9) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS l FROM iw),
dw AS (SELECT doc_id, p, l, list_slice(w, p, p + l - 1) AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, sizes)),
hit AS (SELECT DISTINCT doc_id, p, l, item_id FROM dw JOIN iw USING (win)),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n_items, 0) AS BIGINT) AS n_items, coalesce(hi.s, sha256('')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resample(docs, table(spark, sf_dir, "labels")).select("doc_id", "n_grams", "log_ratio", "log_weight", "gumbel_key", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_passages(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return kept.select("doc_id", gone.alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = token_output.write_tokens(docs, TOKENIZER)
    return store.read(docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt from their hundreds' first ones, as a trie. Rows without conv_id are left out, null roles and texts
    are empty, repeated rows are turns of their own, an empty table has no node; other columns aren't read."""
    turns, ids = conversations.rebuilt(conversations.numbered_turns(table(spark, sf_dir, "conversations")))
    return conversations.prefix_trie(turns, ids).drop("preorder", "end")


#: CRC-32 of a list of bytes ``b`` with the byte table ``tab``, bit by bit, as DuckDB has none.
_CRC_TABLE = "SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))"
_CRC = "xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"
OP11_SQL = f"""
WITH crc AS ({_CRC_TABLE}),
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {_CRC} % 6 AS h FROM (SELECT DISTINCT c, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM turns), crc),
parts AS (SELECT ids.c, 0 AS own, t.p, t.role, t.text FROM ids JOIN turns t ON t.c = ids.c - ids.c % 100 AND t.p <= ids.h UNION ALL SELECT ids.c, 1, t.p, t.role, t.text FROM ids JOIN turns t ON t.c = ids.c AND t.p > ids.h),
paths AS (SELECT ids.c, coalesce(list(md5(md5(role) || md5(text)) ORDER BY own, p) FILTER (WHERE p IS NOT NULL), []) AS path, list(length(text) ORDER BY own, p) AS lens FROM ids LEFT JOIN parts ON parts.c = ids.c GROUP BY ids.c),
each AS (SELECT c, path, lens, unnest(range(0, len(path) + 1)) AS d FROM paths),
nodes AS (SELECT path[1:d] AS node, d, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN lens[d] ELSE 0 END) AS pts, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(path) = d), '')) AS ends FROM each GROUP BY path[1:d], d),
kids AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY node[1:d - 1]),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.node = nodes.node),
up AS (SELECT node[1:e] AS top, n_children, n_convs, pts FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM own)),
sums AS (SELECT top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * pts) AS saved FROM up GROUP BY top),
tree AS (SELECT own.*, sums.n_leaves, sums.saved, p.conv_id AS parent FROM own JOIN sums ON sums.top = own.node LEFT JOIN own p ON p.d = own.d - 1 AND p.node = own.node[1:own.d - 1])
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256 FROM tree
"""


def op12_backoff_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all texts under the n-grams of those of which crc32(doc_id) % 7 isn't 2. A null id counts as an empty
    one and trains, a null text is empty, repeated rows count and score each; an empty table gives no row; other columns aren't
    read."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    scored = backoff.score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's distribution of words. Null and empty texts have no features, a null id has the
    noise of an empty one and comes last among ties, repeated rows are ranked each; an empty benchmark leaves its smoothing."""
    return crc_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH crc AS ({_CRC_TABLE}),
d AS (SELECT doc_id, {_OP7_WORDS} AS w FROM documents),
b AS (SELECT {_OP7_WORDS} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS w FROM d),
bw AS (SELECT unnest(w) AS w FROM b),
words AS (SELECT w, {_CRC} % 10000 AS k FROM (SELECT w, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i - 1, 2) AS BIGINT)) AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw)), crc),
s AS (SELECT k, count(*) AS n FROM dw JOIN words USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM bw JOIN words USING (w) GROUP BY k),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000) / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (k)),
x AS (SELECT doc_id, sum(gain) AS weight FROM dw JOIN words USING (w) JOIN g USING (k) GROUP BY doc_id),
r AS (SELECT doc_id, len(w) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS score FROM d LEFT JOIN x USING (doc_id)),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM r WHERE n >= 20)
SELECT r.doc_id, CAST(r.n AS BIGINT) AS n_features, CAST(r.weight AS BIGINT) AS weight, CAST(r.score AS BIGINT) AS score, CASE WHEN place <= (SELECT count(*) FROM o) * 10 // 100 THEN place END AS rank FROM r LEFT JOIN o ON o.doc_id = r.doc_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_revisit_resolution, op3_ngram_jaccard, op4_signature_sniffing, op5_secret_scan, op6_packing, op7_decontamination, op8_quality, op9_line_dedup, op10_token_output, op11_prefix_trie, op12_backoff_score, op13_target_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op2_revisit_resolution": OP2_SQL, "op7_decontamination": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op13_target_resampling": OP13_SQL}
