"""Registered queries over the tables at hand, each with its SQL where SQL can express it.

The tables stand in for the domain's: documents are arrivals (their language is the scheme), events are traces and checks,
customers are citizens, pages are crawled pages. Keyword operators get a profile of words that the data have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers, session, sources, streaming
from ..functions import citizens as C
from ..functions import rules as R
from ..functions import text as X
from ..operators import audit, comparison, discovery, documents, eligibility, matching, metrics, rules_diff, slices, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Words of the data at hand.
FORMS = [("License", r"licensed|license"), ("Token", r"token ="), ("Mail", r"@mail[0-9]"), ("Rights", r"all rights reserved"), ("Shouting", r"!!")]
TYPES = [("guideline", r"apache"), ("order", r"creative|cc by"), ("circular", r"gnu"), ("notification", r"mit license"), ("application_form", r"rights")]
EXCLUDED = [r"idiot|moron|scum", r"token ="]
RELEVANT = [r"(?:^|[^\p{L}\p{N}_])(?:the|and|der|que)(?:$|[^\p{L}\p{N}_])"]

ARRIVALS = "SELECT doc_id, lang AS scheme, sha256(text) AS hash, coalesce(text, '') AS text FROM documents"
_WS_WORDS = "list_filter(string_split_regex(trim({t}), '\\s+'), lambda w: w <> '')"
_CLEAN = "trim(regexp_replace(regexp_replace(replace({t}, chr(160), ' '), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"
CLEAN_TEXT = _CLEAN.format(t="text")
USABLE = f"(len({_WS_WORDS.format(t=CLEAN_TEXT)}) >= 10 AND NOT (length({CLEAN_TEXT}) - length(replace({CLEAN_TEXT}, chr(65533), '')) > 10 AND length({CLEAN_TEXT}) - length(replace({CLEAN_TEXT}, chr(65533), '')) > 0.1 * length({CLEAN_TEXT})))"

TIMELINE = f"""
WITH a AS (SELECT doc_id, lang AS scheme, sha256(text) AS hash, NOT {USABLE} AS review FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)),
b AS (SELECT *, row_number() OVER (PARTITION BY scheme, hash ORDER BY doc_id) = 1 AS fresh FROM a),
c AS (SELECT *, CASE WHEN fresh AND NOT review THEN doc_id END AS acc FROM b),
d AS (SELECT *, last_value(acc IGNORE NULLS) OVER (PARTITION BY scheme ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_active, max(acc) OVER (PARTITION BY scheme) AS newest FROM c),
t AS (SELECT doc_id, scheme, hash, old_active, CASE WHEN NOT fresh THEN 'already_exists' WHEN review THEN 'REVIEW' WHEN doc_id = newest THEN 'ACTIVE' ELSE 'ARCHIVED' END AS status,
  CASE WHEN NOT fresh THEN NULL WHEN review THEN 'REVIEW_REQUIRED' WHEN old_active IS NULL THEN 'INITIAL_ACTIVE' ELSE 'MODIFIED' END AS change_type FROM d)
"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("scheme"), F.sha2(text, 256).alias("hash"), (~X.is_usable(text)).alias("review"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.version_timeline(arrivals(spark, sf_dir), "scheme", "doc_id", "hash", "review").drop("review")


@query(TIMELINE + "SELECT doc_id, scheme, hash, old_active, status, change_type FROM t")
def version_timeline(spark, sf_dir):
    return timeline(spark, sf_dir)


@query(TIMELINE + """SELECT t.doc_id, t.scheme, t.hash, t.old_active, t.status, t.change_type, CASE WHEN n = 1 THEN 'NEW_SCHEME' WHEN before = t.hash THEN 'UNCHANGED' ELSE 'NEW_VERSION' END AS detected
FROM t JOIN (SELECT doc_id, row_number() OVER w AS n, lag(hash) OVER w AS before FROM a WINDOW w AS (PARTITION BY scheme ORDER BY doc_id)) USING (doc_id)""")
def stream_timeline(spark, sf_dir):
    """The timeline from a stream: arrivals come in six files, dealt without regard to their order, one a trigger."""
    root = session.shared_folder(spark, "stream-timeline")
    a = arrivals(spark, sf_dir).select("scheme", F.col("doc_id").alias("seq"), "hash", "review")
    a.repartition(6, F.xxhash64("seq")).write.parquet(f"{root}/in")
    schema = "scheme string, seq long, hash string, review boolean"
    streaming.start(streaming.timeline_stream(streaming.arrivals_stream(spark, f"{root}/in", schema)), root).awaitTermination()
    out = streaming.upserted(spark, root, ["scheme", "seq"], streaming.TIMELINE)
    return out.select(F.col("seq").alias("doc_id"), "scheme", "hash", "old_active", "status", "change_type", "detected")


@query(TIMELINE + "SELECT doc_id, scheme, hash, old_active, status, change_type FROM t")
def published_timeline(spark, sf_dir):
    """The timeline as readers find it: published with counts that have to fit, and read again by its number."""
    root = session.shared_folder(spark, "knowledge-base")
    state = lambda name: F.count_if(F.col("status") == name)  # noqa: E731
    counts = {"active": state("ACTIVE"), "known": state("already_exists"), "logged": F.count("change_type")}
    number = sources.publish(timeline(spark, sf_dir), root, base=0, counts=counts, valid=lambda f: f["logged"] + f["known"] == f["rows"])
    return sources.current(spark, root, number)


@query(TIMELINE.replace(f"NOT {USABLE} AS review FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)", """coalesce(marked, true) OR n_chars % 7 = 0 OR n_chars % 11 = 0 OR doc_id % 13 = 0 AS review FROM (SELECT doc_id, lang, n_chars, coalesce(text, '') AS text FROM documents)
  LEFT JOIN (SELECT doc_id, bool_or(toxic = 1) AS marked FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)""") + "SELECT doc_id, scheme, status, change_type, old_active FROM t")
def reviewed_timeline(spark, sf_dir):
    """The timeline where reviews are worked out: labels stand for extracted rules, lengths for what comparisons have said."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rules = d.select("doc_id").join(lab, "doc_id", "left").select("doc_id", F.when(F.col("quality").isNotNull(), "rule").alias("rule"), (F.col("toxic") == 1).alias("review_required"), F.lit("SUPPORTED").alias("consistency"), (F.col("doc_id") % 13 == 0).alias("force"))
    said = d.select("doc_id", F.when(F.col("n_chars") % 7 == 0, True).alias("review_required"), F.when(F.col("n_chars") % 11 == 0, "uncertain").otherwise("none").alias("relevance"))
    reviews = versions.needs_review(rules, "doc_id", "force", said).select("doc_id", "review")
    arrived = arrivals(spark, sf_dir).drop("review").join(reviews, "doc_id")
    return versions.version_timeline(arrived, "scheme", "doc_id", "hash", "review").select("doc_id", "scheme", "status", "change_type", "old_active")


@query(TIMELINE + "SELECT scheme, doc_id, hash FROM t WHERE status = 'ACTIVE'")
def active_versions(spark, sf_dir):
    return versions.active_versions(timeline(spark, sf_dir)).select("scheme", "doc_id", "hash")


@query(TIMELINE + "SELECT scheme, doc_id, status, row_number() OVER (PARTITION BY scheme ORDER BY doc_id) AS place FROM t WHERE status <> 'already_exists'")
def version_history(spark, sf_dir):
    return versions.version_history(timeline(spark, sf_dir), "scheme", "doc_id").select("scheme", "doc_id", "status", F.col("place").cast("bigint").alias("place"))


@query(TIMELINE + "SELECT scheme, old_active AS old_version_id, doc_id AS new_version_id, change_type FROM t WHERE change_type IS NOT NULL")
def update_log(spark, sf_dir):
    return versions.update_log(timeline(spark, sf_dir), "scheme", "doc_id")


@query(TIMELINE + "SELECT scheme, count(*) FILTER (status = 'ACTIVE') AS active, count(*) FILTER (status <> 'already_exists') - count(DISTINCT hash) AS repeated FROM t GROUP BY scheme")
def one_active_invariant(spark, sf_dir):
    return timeline(spark, sf_dir).groupBy("scheme").agg(F.count_if(F.col("status") == "ACTIVE").alias("active"), (F.count_if(F.col("status") != "already_exists") - F.count_distinct("hash")).alias("repeated"))


@query("""
WITH a AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, CASE WHEN n = 1 THEN 'NEW_SCHEME' WHEN before = event_type THEN 'UNCHANGED' ELSE 'NEW_VERSION' END AS change FROM a)
SELECT user_id, event_id, change, CASE WHEN change = 'UNCHANGED' THEN NULL WHEN event_id = max(CASE WHEN change <> 'UNCHANGED' THEN event_id END) OVER (PARTITION BY user_id) THEN 'ACTIVE' ELSE 'ARCHIVED' END AS version_status FROM b
""")
def version_detect(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return versions.detect_versions(e, "user_id", "event_id", "event_type").select("user_id", "event_id", "change", "version_status")


@query("SELECT doc_id, CASE WHEN row_number() OVER w = 1 THEN 'new' ELSE 'unchanged' END AS status, first_value(doc_id) OVER w AS document_id FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) WINDOW w AS (PARTITION BY h ORDER BY doc_id)")
def dedupe_first_seen(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return versions.first_seen(d, "h", "doc_id").select("doc_id", "status", "document_id")


@query("SELECT source, count(*) AS documents, count(DISTINCT sha256(text)) AS hashes, count(*) = count(DISTINCT sha256(text)) AS idempotent FROM documents GROUP BY source")
def duplicate_hash_audit(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_distinct(F.sha2("text", 256)).alias("hashes"))
    return d.withColumn("idempotent", F.col("documents") == F.col("hashes"))


@query("SELECT sha256(text) AS hash, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY 1")
def document_by_hash(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id", "source")
    return versions.latest(d, ["hash"], "doc_id")


@query("SELECT host, max(page_id) AS page_id, arg_max(url, page_id) AS url FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, page_id, url FROM pages) GROUP BY host")
def latest_by_url(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), "page_id", "url")
    return versions.latest(p, ["host"], "page_id")


@query("SELECT 'user' || user_id AS official_url, min(event_id) AS id, arg_max(event_type, event_id) AS source_type, arg_max(event_type <> 'error', event_id) AS active FROM events GROUP BY user_id")
def registry_upsert(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("official_url"), F.col("event_id").alias("seq"), F.col("event_type").alias("source_type"), (F.col("event_type") != "error").alias("active"))
    return versions.registry(e)


@query("""WITH e AS (SELECT 'user' || user_id % 700 AS official_url, event_id AS seq, event_type AS source_type, event_id % 23 = 0 AS gone FROM events), t AS (SELECT official_url, max(seq) FILTER (gone) AS last FROM e GROUP BY 1)
SELECT official_url, min(seq) AS id, arg_max(source_type, seq) AS source_type FROM e JOIN t USING (official_url) WHERE last IS NULL OR seq > last GROUP BY official_url""")
def registry_deleted(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("user"), (F.col("user_id") % 700).cast("string")).alias("official_url"), F.col("event_id").alias("seq"), F.col("event_type").alias("source_type"), (F.col("event_id") % 23 == 0).alias("gone"))
    return versions.registry(e, "gone")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)")
def sources_by_id(spark, sf_dir):
    known = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return versions.sources_by_id(known, read(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("id")))


@query("""SELECT c_custkey AS id, coalesce(s, 'unknown') AS last_status, CASE WHEN s IS NULL THEN c_custkey % 2 = 0 ELSE s <> 'inactive' END AS active
FROM customer LEFT JOIN (SELECT o_custkey, arg_max(CASE WHEN o_orderkey % 4 = 0 THEN 'inactive' ELSE 'ok' END, o_orderkey) AS s FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) ON o_custkey = c_custkey""")
def source_status(spark, sf_dir):
    known = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2 == 0).alias("active"), F.lit("unknown").alias("last_status"))
    updates = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 4 == 0, "inactive").otherwise("ok").alias("status"))
    return versions.status_updates(known, updates).select("id", "last_status", "active")


@query("SELECT regexp_replace(url, '[?#].*$', '') AS address, max(page_id) AS page_id, arg_max(url, page_id) AS url FROM pages GROUP BY 1")
def document_by_url(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("address"), "page_id", "url")
    return versions.latest(p, ["address"], "page_id")


@query("SELECT user_id AS id, source_type FROM (SELECT user_id, arg_max(event_type, event_id) AS source_type FROM events GROUP BY user_id) WHERE source_type <> 'error' ORDER BY id")
def active_sources(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("source_type"))
    return versions.latest(e, ["user_id"], "seq").where("source_type <> 'error'").select(F.col("user_id").alias("id"), "source_type").orderBy("id")


@query("SELECT user_id AS source_id, max(ts) AS last_checked, max(ts) FILTER (event_type <> 'error') AS last_successful_check FROM events GROUP BY user_id")
def source_checks(spark, sf_dir):
    return versions.source_checks(read(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") != "error")


# Each page is given anchors whose addresses are known from its own: unquoted, in capitals, with entities, above its folder,
# without scheme, given twice (one with a host of its own stays as it is; a scheme unlike the page's keeps its capitals); and what is no link: comments, scripts, mail, fragments, anchors without an address.
_TAIL = [
    ("<a href=plain{k}.html title=\"T &amp; {k}\">not quoted</a>", "top || dir || 'plain' || page_id || '.html'", "'not quoted'", "'T & ' || page_id"),
    ("<!-- <a href=\"/hidden\">hidden</a> --><A CLASS=x HREF='?p=2&amp;q={k}'>a\n query</A>", "top || path || '?p=2&q=' || page_id", "'a query'", "''"),
    ("<a name=x>none</a><a href = \"../up/{k}.pdf\" title=' the order '>Up &lt;{k}&gt;</a>", "top || regexp_replace(dir, '[^/]+/$', '') || 'up/' || page_id || '.pdf'", "'Up <' || page_id || '>'", "'the order'"),
    ("<a href=\"//other.example/{k}/./a/../b\"><b>net</b>path</a>", "regexp_extract(url, '^[a-z]+:') || '//other.example/' || page_id || '/./a/../b'", "'net path'", "''"),
    ("<script>var s = '<a href=\"/s\">s</a>';</script><a href=mailto:x@y.z>mail</a>", None, None, None),
    ("<a href=plain{k}.html>again</a><a href=#top>Top</a><a href=\"JavaScript:void(0)\">x</a><a href='HTTP://Host.example/?{k}#f'>far</a>", "CASE WHEN url LIKE 'http:%' THEN 'http' ELSE 'HTTP' END || '://Host.example/?' || page_id || '#f'", "'far'", "''"),
]  # fmt: skip
_TAIL_POS = [0, 1, 2, 3, 4, 8]
_ANCHORS = r"""'(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>'"""
_LINKS = rf"""
WITH l AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, {_ANCHORS}, 1)) AS href, unnest(regexp_extract_all(html, {_ANCHORS}, 2)) AS inner_html, generate_subscripts(regexp_extract_all(html, {_ANCHORS}, 1), 1) - 1 AS pos FROM pages),
m AS (SELECT page_id, pos, trim(href) AS href, trim(regexp_replace(regexp_replace(inner_html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text, regexp_extract(page_url, '^([a-zA-Z]+://[^/?#]+)', 1) AS base FROM l),
u AS (SELECT page_id, pos, text, '' AS title, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href ELSE base || href END AS url FROM m WHERE href <> '' AND href NOT LIKE '#%' AND lower(href) NOT LIKE 'javascript:%'),
g AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir, (SELECT count(*) FROM l WHERE l.page_id = x.page_id) AS before FROM (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS top, coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), ''), '/') AS path FROM pages) x),
v AS (SELECT * FROM u {" ".join(f"UNION ALL SELECT page_id, before + {at}, {text}, {title}, {url} FROM g" for at, (_, url, text, title) in zip(_TAIL_POS, _TAIL) if url)}),
links AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, url, text, title FROM v WHERE regexp_matches(url, '(?i)^https?://') QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1)
"""


def _links(spark, sf_dir):
    tail = F.concat(*[F.replace(F.lit(html), F.lit("{k}"), F.col("page_id").cast("string")) for html, *_ in _TAIL])
    return discovery.page_links(read(spark, sf_dir, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), tail)))


@query(_LINKS + "SELECT page_id, pos, url, text, title FROM links")
def page_links(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", "url", "text", "title")


_CATEGORY = r"CASE WHEN regexp_matches(url, '(?i)^[^?#]*\.(pdf|doc|docx)([?#].*)?$') THEN 'document' WHEN regexp_matches(text || ' ' || title || ' ' || url, '(?i)(?:^|[^\p{L}\p{N}_])(?:the|and|der|que)(?:$|[^\p{L}\p{N}_])') THEN 'scheme_page' END"


@query(_LINKS + f"SELECT page_id, url, {_CATEGORY} AS category FROM links")
def link_categories(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "url", discovery.link_category("text", "title", "url", RELEVANT).alias("category"))


@query(_LINKS + f"SELECT coalesce({_CATEGORY}, 'dropped') AS category, count(*) AS links, count(DISTINCT page_id) AS pages FROM links GROUP BY 1")
def link_counts(spark, sf_dir):
    kind = F.coalesce(discovery.link_category("text", "title", "url", RELEVANT), F.lit("dropped"))
    return _links(spark, sf_dir).groupBy(kind.alias("category")).agg(F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"))


@query("""WITH d AS (SELECT p_partkey, 'https://site.example/a/b' || (p_partkey % 7) || '/list.html' AS page FROM part)
SELECT p_partkey, 'https://site.example/a/docs/' || p_partkey || '.pdf' AS document_url, page AS source_page_url, 'Order about ' || p_name AS title, '0' || (1 + p_partkey % 9) || '-06-2023' AS published_date FROM d JOIN part USING (p_partkey)
UNION ALL SELECT p_partkey, 'https://site.example/x/' || p_partkey || '.doc', page, 'Guidelines of ' || p_partkey, NULL FROM d WHERE p_partkey % 2 = 0""")
def page_documents(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    row = F.format_string('<table><tr><td>%s</td><td>Order about %s</td><td>0%s-06-2023</td><td><a href="../docs/%s.pdf">\u0cb5\u0cc0\u0c95\u0ccd\u0cb7\u0ca3\u0cc6</a></td></tr></table>', k, F.col("p_name"), (1 + F.col("p_partkey") % 9).cast("string"), k)
    more = F.when(F.col("p_partkey") % 2 == 0, F.format_string('<p><a href="/x/%s.doc">Guidelines of %s</a> <a href="#top">Top</a></p>', k, k)).otherwise("")
    pages = read(spark, sf_dir, "part").select("p_partkey", F.format_string("https://site.example/a/b%s/list.html", (F.col("p_partkey") % 7).cast("string")).alias("url"), F.concat(row, more).alias("html"))
    return discovery.page_documents(pages, "p_partkey").select("p_partkey", "document_url", "source_page_url", "title", "published_date")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)apache') THEN 'guideline' WHEN regexp_matches(t, '(?i)creative|cc by') THEN 'order' WHEN regexp_matches(t, '(?i)gnu') THEN 'circular' WHEN regexp_matches(t, '(?i)mit license') THEN 'notification' WHEN regexp_matches(t, '(?i)rights') THEN 'application_form' ELSE 'other' END AS document_type,
  NOT regexp_matches(t, '(?i)idiot|moron|scum|token =') AS is_scheme_document FROM (SELECT doc_id, coalesce(text, '') || ' ' || coalesce(source, '') AS t FROM documents)""")
def document_type_class(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", discovery.document_type("text", "source", TYPES).alias("document_type"), discovery.is_scheme_document("text", "source", EXCLUDED).alias("is_scheme_document"))


@query(r"""SELECT page_id, substr(md5(url), 1, 8) || '_' || CASE WHEN lower(n) LIKE '%.pdf' THEN n ELSE n || '.pdf' END AS file_name FROM (SELECT page_id, url, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '[\\/*?:"<>| ]', '_', 'g') AS n FROM pages)""")
def safe_filename(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.safe_filename("url", F.md5("url")).alias("file_name"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(trim(regexp_replace(lower(url), '[^\p{L}\p{N}_\s-]', '', 'g')), '[\s_-]+', '-', 'g'), ''), 'unnamed-scheme') AS slug FROM pages""")
def slug(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.slug("url").alias("slug"))


@query(r"""WITH o AS (SELECT o_orderkey, 'order of ' || CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'no date' END AS title FROM orders),
f AS (SELECT o_orderkey, nullif(regexp_extract(title, '\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2})\b', 1), '') AS found FROM o)
SELECT o_orderkey, found AS found_date, CAST(coalesce(try_strptime(replace(found, '/', '-'), '%d-%m-%Y'), try_strptime(replace(found, '/', '-'), '%Y-%m-%d')) AS DATE) AS iso_date FROM f""")
def date_extract(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    when = F.when(k == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("no date")
    o = o.select("o_orderkey", X.find_date(F.concat(F.lit("order of "), when)).alias("found_date"))
    return o.withColumn("iso_date", X.iso_date("found_date"))


@query(r"""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'guidelines ' || strftime(o_orderdate, '%Y') || '-' || substr(CAST(year(o_orderdate) + 1 AS VARCHAR), 3) WHEN 1 THEN 'circular v' || (o_orderkey % 3) || '.1' WHEN 2 THEN 'order 2024 final' ELSE 'notice' END AS t, strftime(o_orderdate, '%d-%m-%Y') AS p, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, coalesce(replace(replace(nullif(regexp_extract(t || ' u', '\b(20\d{2}[-_/]\d{2,4})\b', 1), ''), '_', '-'), '/', '-'), replace(nullif(regexp_extract(t || ' u', '(?i)\b(v(?:er)?\.?\s*\d+(?:\.\d+)?)\b', 1), ''), ' ', ''), nullif(regexp_extract(t || ' u', '\b(20[1-3]\d)\b', 1), ''), CAST(y AS VARCHAR)) AS version_label FROM o""")
def version_label(spark, sf_dir):
    o, k, year = read(spark, sf_dir, "orders"), F.col("o_orderkey") % 5, F.year("o_orderdate")
    title = F.when(k == 0, F.concat(F.lit("guidelines "), year.cast("string"), F.lit("-"), F.substring((year + 1).cast("string"), 3, 2))).when(k == 1, F.concat(F.lit("circular v"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".1"))).when(k == 2, "order 2024 final").otherwise("notice")
    return o.select("o_orderkey", X.version_label(title, F.lit("u"), F.date_format("o_orderdate", "dd-MM-yyyy")).alias("version_label"))


@query(f"SELECT doc_id, CAST(length({CLEAN_TEXT}) AS BIGINT) AS clean_chars, CAST(length(trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g'))) AS BIGINT) AS title_chars, sha256({CLEAN_TEXT}) AS clean_hash FROM documents")
def clean_text_stats(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", X.clean_page("text").alias("clean"), F.length(X.clean_title("text")).cast("bigint").alias("title_chars"))
    return d.select("doc_id", F.length("clean").cast("bigint").alias("clean_chars"), "title_chars", F.sha2("clean", 256).alias("clean_hash"))


@query(f"SELECT doc_id, {USABLE} AS usable, CAST(len({_WS_WORDS.format(t=CLEAN_TEXT)}) AS BIGINT) AS words FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def text_usable(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", X.usability("text").alias("u"))
    return d.select("doc_id", "u.usable", F.col("u.words").cast("bigint").alias("words"))


_COMMON = ", ".join(f"'{w}'" for w in X.lex.COMMON_WORDS)
RELIABILITY = rf"""
WITH a AS (SELECT doc_id, lang, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents),
b AS (SELECT *, {_WS_WORDS.format(t='t')} AS w, greatest(length(t), 1) AS chars FROM a),
c AS (SELECT *, list_transform(list_filter(w, lambda x: length(x) >= 2), lambda x: lower(regexp_replace(x, '[^a-zA-Z]', '', 'g'))) AS latin, length(regexp_replace(t, '[^~`^_{{}}|\;:$%@*<>\[\]+=]', '', 'g')) / chars AS symbols, length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum, regexp_matches(t, '[;~`_]{{2,}}|[a-zA-Z]{{1,3}}[;~`^]{{1,3}}[a-zA-Z]{{1,3}}') AS torn FROM b),
d AS (SELECT *, len(list_filter(latin, lambda x: x IN ({_COMMON}))) AS known FROM c),
r AS (SELECT doc_id, lang, CASE WHEN t = '' THEN 'RUN_OCR' WHEN len(w) < 10 THEN 'RUN_OCR' WHEN symbols > 0.035 OR torn OR (len(latin) >= 15 AND known < 3) THEN 'RUN_OCR' WHEN known >= 3 OR (len(w) >= 15 AND alnum > 0.70 * chars) THEN 'USE_DIGITAL_TEXT' ELSE 'REVIEW' END AS action,
  t <> '' AND len(w) >= 10 AND (symbols > 0.035 OR torn OR (len(latin) >= 15 AND known < 3)) AS encoding_issue, t <> '' AND len(w) >= 10 AND NOT (symbols > 0.035 OR torn OR (len(latin) >= 15 AND known < 3)) AND (known >= 3 OR (len(w) >= 15 AND alnum > 0.70 * chars)) AS reliable,
  CASE WHEN t = '' THEN 0.0 WHEN len(w) < 10 THEN 0.1 WHEN symbols > 0.035 OR torn OR (len(latin) >= 15 AND known < 3) THEN greatest(0.0, round_even(0.40 - least(0.40, symbols * 8), 2)) WHEN known >= 3 OR (len(w) >= 15 AND alnum > 0.70 * chars) THEN 0.95 ELSE 0.5 END AS score,
  CASE WHEN t = '' THEN 'empty' WHEN len(w) < 10 THEN 'few_words' WHEN symbols > 0.035 OR torn OR (len(latin) >= 15 AND known < 3) THEN concat_ws(',', CASE WHEN symbols > 0.035 THEN 'symbols' END, CASE WHEN torn THEN 'ligatures' END, CASE WHEN len(latin) >= 15 AND known < 3 THEN 'vocabulary' END) WHEN known >= 3 OR (len(w) >= 15 AND alnum > 0.70 * chars) THEN '' ELSE 'ambiguous' END AS reasons FROM d)
"""


@query(RELIABILITY + "SELECT doc_id, action, encoding_issue, reliable, CAST(score AS DOUBLE) AS score, reasons FROM r")
def text_reliability(spark, sf_dir):
    r = read(spark, sf_dir, "documents").select("doc_id", X.reliability("text").alias("r"))
    return r.select("doc_id", "r.action", "r.encoding_issue", "r.reliable", "r.score", F.array_join("r.reasons", ",").alias("reasons"))


@query(RELIABILITY + "SELECT lang, count(*) AS pages, count(*) FILTER (reliable) AS reliable, count(*) FILTER (action = 'RUN_OCR') AS run_ocr, count(*) FILTER (action = 'REVIEW') AS review FROM r GROUP BY lang")
def reliability_summary(spark, sf_dir):
    r = read(spark, sf_dir, "documents").select("lang", X.reliability("text").alias("r"))
    return r.groupBy("lang").agg(F.count("*").alias("pages"), F.count_if("r.reliable").alias("reliable"), F.count_if(F.col("r.action") == "RUN_OCR").alias("run_ocr"), F.count_if(F.col("r.action") == "REVIEW").alias("review"))


_FORMS = " || ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n};' ELSE '' END" for n, p in FORMS)


@query(f"SELECT doc_id, f AS fields, n >= 3 AS is_form, CAST(least(100, n * 20) AS DOUBLE) AS confidence FROM (SELECT doc_id, {_FORMS} AS f, length({_FORMS}) - length(replace({_FORMS}, ';', '')) AS n FROM documents)")
def form_fields(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", X.form_fields("text", FORMS).alias("f"))
    return d.select("doc_id", F.array_join(F.transform("f", lambda x: F.concat(x, F.lit(";"))), "").alias("fields"), X.is_form(F.col("f")).alias("is_form"), X.form_confidence(F.col("f")).alias("confidence"))


@query(f"""SELECT doc_id, CASE WHEN NOT u THEN CASE WHEN f THEN 'FORM' WHEN tb THEN 'TABLE' ELSE 'SCANNED' END WHEN tb AND bl > 5 THEN 'MIXED' WHEN tb THEN 'TABLE' WHEN f THEN 'FORM' ELSE 'TEXT' END AS page_type FROM (
SELECT doc_id, {USABLE} AS u, length({_FORMS}) - length(replace({_FORMS}, ';', '')) >= 3 AS f, length(text) - length(replace(text, ' | ', '  ')) >= 4 AS tb, length(text) - length(replace(text, chr(10), '')) + 1 AS bl FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""")
def page_classification(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", X.page_type(X.is_usable("text"), X.is_form(X.form_fields("text", FORMS)), F.length("text") - F.length(F.replace("text", F.lit(" | "), F.lit("  "))) >= 4, X.count_of(F.col("text"), "\n") + 1).alias("page_type"))


_PAIRS = "SELECT source, doc_id, text, lang, n_chars, lag(doc_id) OVER w AS old_id, lag(text) OVER w AS old, lag(lang) OVER w AS old_lang, lag(n_chars) OVER w AS old_chars FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)"


def _pairs(spark, sf_dir, *columns: tuple[str, str]):
    """Documents beside the one before of their source. The order is found by ids alone; then the old columns are joined."""
    d = read(spark, sf_dir, "documents")
    order = slices.with_running(d.select("source", "doc_id"), "source", "doc_id", {"old_id": F.col("doc_id")}).where("old_id IS NOT NULL").select("doc_id", "old_id")
    old = d.select(F.col("doc_id").alias("old_id"), *[F.col(c).alias(n) for c, n in columns])
    return order.join(old, "old_id").join(d.select("doc_id", *[c for c, _ in columns]), "doc_id")


@query(rf"""WITH p AS ({_PAIRS}), q AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(old, '')), '[\p{{L}}\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS b FROM p WHERE old_id IS NOT NULL)
SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS jaccard FROM q""")
def token_jaccard(spark, sf_dir):
    return _pairs(spark, sf_dir, ("text", "old")).select("doc_id", F.round(X.word_jaccard("old", "text"), 6).alias("jaccard"))


def _lines(df, key, text):
    return df.select(F.col(key).alias("pair"), F.posexplode_outer(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n", "text")).select("pair", (F.col("n") + 1).alias("page_number"), "text")


@query(rf"""WITH p AS ({_PAIRS}), o AS (SELECT doc_id, unnest(string_split(coalesce(old, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(old, ''), chr(10)), 1) AS n FROM p WHERE old_id IS NOT NULL),
c AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM p WHERE old_id IS NOT NULL)
SELECT doc_id AS pair, count(*) FILTER (o.t IS NULL) AS pages_added, count(*) FILTER (c.t IS NULL) AS pages_removed, count(*) FILTER (trim(regexp_replace(o.t, '\s+', ' ', 'g')) = trim(regexp_replace(c.t, '\s+', ' ', 'g'))) AS pages_unchanged,
  count(*) FILTER (trim(regexp_replace(o.t, '\s+', ' ', 'g')) <> trim(regexp_replace(c.t, '\s+', ' ', 'g'))) AS pages_differing FROM o FULL JOIN c USING (doc_id, n) GROUP BY doc_id""")
def page_diff(spark, sf_dir):
    p = _pairs(spark, sf_dir, ("text", "old"))
    j = _lines(p, "doc_id", "old").withColumnRenamed("text", "o").join(_lines(p, "doc_id", "text").withColumnRenamed("text", "c"), ["pair", "page_number"], "full")
    same = comparison.bare("o") == comparison.bare("c")
    both = F.col("o").isNotNull() & F.col("c").isNotNull()
    return j.groupBy("pair").agg(F.count_if(F.col("o").isNull()).alias("pages_added"), F.count_if(F.col("c").isNull()).alias("pages_removed"), F.count_if(both & same).alias("pages_unchanged"), F.count_if(both & ~same).alias("pages_differing"))


@query(f"""WITH p AS ({_PAIRS}) SELECT doc_id AS pair, 'lang' AS key, old_lang AS old_value, lang AS new_value FROM p WHERE old_id IS NOT NULL AND old_lang IS DISTINCT FROM lang
UNION ALL SELECT doc_id, 'n_chars', CAST(old_chars AS VARCHAR), CAST(n_chars AS VARCHAR) FROM p WHERE old_id IS NOT NULL AND old_chars IS DISTINCT FROM n_chars""")
def metadata_diff(spark, sf_dir):
    p = _pairs(spark, sf_dir, ("lang", "old_lang"), ("n_chars", "old_chars"))
    meta = lambda a, b: F.create_map(F.lit("lang"), F.col(a), F.lit("n_chars"), F.col(b).cast("string")).alias("meta")  # noqa: E731
    return comparison.metadata_changes(p.select(F.col("doc_id").alias("pair"), meta("old_lang", "old_chars")), p.select(F.col("doc_id").alias("pair"), meta("lang", "n_chars")))


def _item_pairs(spark, sf_dir, back: int):
    """Items beside the one whose id is smaller by ``back``."""
    b = read(spark, sf_dir, "benchmark").select("item_id", "text")
    return b.join(b.select((F.col("item_id") + back).alias("item_id"), F.col("text").alias("old")), "item_id").where("old IS NOT NULL")


_LCP = "coalesce(nullif(list_position(list_transform(range(0, greatest({m}, 0)), lambda x: {x} <> {y}), true), 0) - 1, greatest({m}, 0))"


def _blocks_sql(name: str, source: str) -> str:
    """Common table expressions of the matching blocks (k, i, j, n) of ``source`` (k, a, b), by recursion over segments."""
    right = _LCP.format(m="least(ah - i - n, bh - j - n)", x="a[i + n + x + 1]", y="b[j + n + x + 1]")
    left = _LCP.format(m="least(i - al, j - bl)", x="a[i - x]", y="b[j - x]")
    begun = _LCP.format(m="least(ah - al, bh - bl)", x="a[al + x + 1]", y="b[bl + x + 1]")
    best = f"""SELECT k, al, ah, bl, bh, any_value(a) AS a, any_value(b) AS b, max(CASE WHEN r.d IS NOT NULL THEN [least(r.i + r.n, ah, bh + r.d) - greatest(r.i, al, bl + r.d), -greatest(r.i, al, bl + r.d), r.d] END) AS m
      FROM (SELECT s.*, p.a, p.b FROM {{seg}} s JOIN {source} p USING (k)) LEFT JOIN {name}_runs r USING (k) WHERE ah > al AND bh > bl GROUP BY k, al, ah, bl, bh"""
    found = f"""SELECT k, al, ah, bl, bh, i - {left} AS i, j - {left} AS j, n + {left} + {right} AS n FROM (SELECT *, -m[2] AS i, -m[2] - m[3] AS j, m[1] AS n FROM ({best}) WHERE m[1] > 0)
      UNION ALL SELECT k, al, ah, bl, bh, al, bl, {begun} FROM ({best}) WHERE coalesce(m[1], 0) <= 0"""
    return f"""{name}_b AS (SELECT k, unnest(b) AS t, generate_subscripts(b, 1) - 1 AS j, len(b) AS n FROM {source}),
{name}_met AS (SELECT k, i, j FROM (SELECT k, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS i FROM {source}) JOIN (SELECT *, count(*) OVER (PARTITION BY k, t) AS c FROM {name}_b) USING (k, t) WHERE n < 200 OR c <= n // 100 + 1),
{name}_runs AS (SELECT k, i - j AS d, min(i) AS i, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY k, i - j ORDER BY i) AS g FROM {name}_met) GROUP BY k, i - j, g),
{name}_seg AS (SELECT k, CAST(0 AS BIGINT) AS al, CAST(len(a) AS BIGINT) AS ah, CAST(0 AS BIGINT) AS bl, CAST(len(b) AS BIGINT) AS bh FROM {source}
  UNION ALL SELECT k, unnest([al, i + n]), unnest([i, ah]), unnest([bl, j + n]), unnest([j, bh]) FROM ({found.format(seg=f"{name}_seg")}) WHERE n > 0),
{name} AS (SELECT k, i, j, n FROM ({found.format(seg=f"{name}_seg")}) WHERE n > 0)"""


_ITEMS = r"SELECT a.item_id AS k, trim(regexp_replace(b.text, '\s+', ' ', 'g')) AS old, trim(regexp_replace(coalesce(a.text, ''), '\s+', ' ', 'g')) AS new FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - 20 WHERE b.text IS NOT NULL"


@query(f"""WITH RECURSIVE t AS ({_ITEMS}), p AS (SELECT k, string_split(old, '') AS a, string_split(new, '') AS b FROM t), {_blocks_sql("m", "p")}
SELECT k AS item_id, round(2 * coalesce((SELECT sum(n) FROM m WHERE m.k = p.k), 0) / (len(a) + len(b)), 9) AS ratio FROM p""")
def item_similarity(spark, sf_dir):
    b = _item_pairs(spark, sf_dir, 20).select("item_id", comparison.bare("old").alias("old"), comparison.bare("text").alias("text"))
    return matching.similarity(b, "item_id", "old", "text", words_from=2.0).select("item_id", F.round("ratio", 9).alias("ratio"))


# The words of an item beside the same with every seventh word left out and every ninth another: most pairs are noise or nearly so.
_WORDS_CHANGED = "list_filter(list_transform(w, lambda x, i: CASE WHEN i % 9 = k % 9 THEN x || 'e' ELSE x END), lambda x, i: i % 17 <> k % 17)"


@query(rf"""WITH RECURSIVE t AS (SELECT item_id AS k, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM benchmark), p AS (SELECT k, w AS a, {_WORDS_CHANGED} AS b FROM t), {_blocks_sql("m", "p")},
o AS (SELECT k, i, j, n FROM m UNION ALL SELECT k, len(a), len(b), 0 FROM p), g AS (SELECT k, i, j, coalesce(lag(i + n) OVER w, 0) AS pi, coalesce(lag(j + n) OVER w, 0) AS pj FROM o WINDOW w AS (PARTITION BY k ORDER BY i, j, n DESC)),
d AS (SELECT k, pi, pj, array_to_string(list_concat(a[pi + 1:i], b[pj + 1:j]), ' ') AS words FROM g JOIN p USING (k) WHERE i > pi OR j > pj)
SELECT k AS item_id, count(d.words) AS places, coalesce(string_agg(d.words, '|' ORDER BY pi, pj), '') AS changed FROM p LEFT JOIN d USING (k) GROUP BY k""")
def changed_words(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda w: w != "").alias("w"))
    other = F.filter(F.transform("w", lambda x, i: F.when((i + 1) % 9 == F.col("k") % 9, F.concat(x, F.lit("e"))).otherwise(x)), lambda x, i: (i + 1) % 17 != F.col("k") % 17)
    found = matching.matching_blocks(b.withColumn("v", other), "k", "w", "v")
    between = F.transform(matching.gaps(F.col("blocks"), F.col("a"), F.col("b")), lambda g: F.array_join(F.concat(g["old"], g["new"]), " "))
    return found.select(F.col("k").alias("item_id"), F.size(between).cast("long").alias("places"), F.array_join(between, "|").alias("changed"))


@query(rf"""WITH RECURSIVE t AS (SELECT doc_id AS k, trim(coalesce(old, ''), E' 	

') AS old, trim(coalesce(text, ''), E' 	

') AS new FROM ({_PAIRS}) WHERE old_id IS NOT NULL),
p AS (SELECT k, CASE WHEN old = '' THEN [] ELSE string_split_regex(old, E'
|[

]') END AS a, CASE WHEN new = '' THEN [] ELSE string_split_regex(new, E'
|[

]') END AS b FROM t), {_blocks_sql("m", "p")},
c AS (SELECT p.k, len(a) - coalesce(sum(n), 0) AS removed, len(b) - coalesce(sum(n), 0) AS added, list(i) AS is_, list(j) AS js, list(n) AS ns, any_value(a) AS a, any_value(b) AS b FROM p LEFT JOIN m ON m.k = p.k GROUP BY p.k, len(a), len(b)),
l AS (SELECT k, removed, added, list_filter(a, lambda x, i: NOT list_contains(flatten(list_transform(range(1, len(ns) + 1), lambda q: range(is_[q] + 1, is_[q] + ns[q] + 1))), i)) AS gone, list_filter(b, lambda x, i: NOT list_contains(flatten(list_transform(range(1, len(ns) + 1), lambda q: range(js[q] + 1, js[q] + ns[q] + 1))), i)) AS come FROM c)
SELECT k AS doc_id, CAST(removed AS BIGINT) AS removed, CAST(added AS BIGINT) AS added, md5(array_to_string(gone, chr(10))) AS removed_md5, md5(array_to_string(come, chr(10))) AS added_md5 FROM l""")
def line_diff(spark, sf_dir):
    d = matching.line_difference(_pairs(spark, sf_dir, ("text", "old")), "doc_id", "old", "text")
    side = lambda c: [F.size(c).cast("long").alias(c), F.md5(F.array_join(c, "\n")).alias(f"{c}_md5")]  # noqa: E731
    return d.select("doc_id", *side("removed"), *side("added"))


@query(r"""WITH p AS (SELECT a.item_id, a.text, b.text AS old FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - 2 WHERE b.text IS NOT NULL),
o AS (SELECT item_id, unnest(string_split(old, chr(10))) AS t, generate_subscripts(string_split(old, chr(10)), 1) AS n FROM p), c AS (SELECT item_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM p),
j AS (SELECT item_id AS pair, o.t AS x, c.t AS y, trim(regexp_replace(o.t, '\s+', ' ', 'g')) = trim(regexp_replace(c.t, '\s+', ' ', 'g')) AS same FROM o FULL JOIN c USING (item_id, n))
SELECT pair, count(*) FILTER (x IS NULL) AS pages_added, count(*) FILTER (y IS NULL) AS pages_removed, count(*) FILTER (same) AS pages_same, count(*) FILTER (NOT same) AS pages_differing FROM j GROUP BY pair""")
def item_page_comparison(spark, sf_dir):
    b = _item_pairs(spark, sf_dir, 2)
    n = comparison.page_counts(comparison.compare_pages(_lines(b, "item_id", "old"), _lines(b, "item_id", "text")))
    return n.select("pair", "pages_added", "pages_removed", (F.col("pages_unchanged") - F.col("pages_noise")).alias("pages_same"), (F.col("pages_modified") + F.col("pages_noise")).alias("pages_differing"))


# Rules, rendered from parts: a limit of income, age or land each, or another condition.
def _rule_text():
    k, size, price = F.col("p_partkey") % 6, F.col("p_size").cast("string"), F.col("p_retailprice")
    return (
        F.when(k == 0, F.concat(F.lit("Annual income shall not exceed Rs "), (F.floor(price) * 100).cast("string"), F.lit(".")))
        .when(k == 1, F.concat(F.lit("Applicant must be above "), (18 + F.col("p_size") % 50).cast("string"), F.lit(" years of age")))
        .when(k == 2, F.concat(F.lit("Owns up to "), size, F.lit(" hectares of cultivable land")))
        .when(k == 3, F.concat(F.lit("Family salary below "), size, F.lit(" lakh")))
        .when(k == 4, F.lit("Must be a  permanent resident of Karnataka!")).otherwise(F.concat(F.lit("Must own "), size, F.lit(" acres")))
    )  # fmt: skip


_RULE = """CASE p_partkey % 6 WHEN 0 THEN 'Annual income shall not exceed Rs ' || CAST(CAST(floor(p_retailprice) AS BIGINT) * 100 AS VARCHAR) || '.' WHEN 1 THEN 'Applicant must be above ' || (18 + p_size % 50) || ' years of age' WHEN 2 THEN 'Owns up to ' || p_size || ' hectares of cultivable land'
  WHEN 3 THEN 'Family salary below ' || p_size || ' lakh' WHEN 4 THEN 'Must be a  permanent resident of Karnataka!' ELSE 'Must own ' || p_size || ' acres' END"""


def _norm_sql(c: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower(trim({c})), '[.,;:!?`''\"]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for old, new in R.lex.REPLACEMENTS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _category_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{p}') THEN '{n}'" for n, p in R.lex.CATEGORY_TESTS) + " ELSE 'other' END"


_NUM = lambda t, p: f"TRY_CAST(nullif(regexp_extract({t}, '{p}', 1), '') AS DOUBLE)"  # noqa: E731


def _threshold_sql(c: str, kind: str) -> str:
    t = f"replace(lower({c}), ',', '')"
    lakh, raw, age, ha, acre = (_NUM(t, p) for p in (r"(\d+(?:\.\d+)?)\s*(?:lakh|lac)", r"(?:rs|₹)?\s*(\d{5,7})", r"(\d{1,2})\s*(?:years)", r"(\d+(?:\.\d+)?)\s*(?:hectare|ha)", r"(\d+(?:\.\d+)?)\s*(?:acre)"))
    return f"CASE {kind} WHEN 'income' THEN coalesce({lakh} * 100000.0, {raw}) WHEN 'age' THEN {age} WHEN 'landholding' THEN coalesce({ha}, {acre} * 0.404686) END"


RULES = f"WITH r AS (SELECT p_partkey, {_RULE} AS rule FROM part), n AS (SELECT p_partkey, rule, {_norm_sql('rule')} AS norm, {_category_sql('rule')} AS cat FROM r), h AS (SELECT *, {_threshold_sql('rule', 'cat')} AS lim FROM n)\n"


def _rules(spark, sf_dir):
    r = read(spark, sf_dir, "part").select("p_partkey", _rule_text().alias("rule"))
    r = r.withColumns({"norm": R.normal_form("rule"), "cat": R.category("rule", F.lit(None).cast("string"))})
    return r.withColumn("lim", R.threshold("rule", "cat"))


@query(RULES + "SELECT p_partkey, norm, cat FROM h")
def normalize_rules(spark, sf_dir):
    return _rules(spark, sf_dir).select("p_partkey", "norm", "cat")


@query(RULES + "SELECT p_partkey, cat AS category FROM h")
def rule_category(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", R.category(_rule_text(), F.lit(None).cast("string")).alias("category"))


@query(RULES + "SELECT cat, norm, min(p_partkey) AS first_seq, count(*) AS copies FROM h GROUP BY cat, norm")
def rule_dedupe(spark, sf_dir):
    return _rules(spark, sf_dir).groupBy("cat", "norm").agg(F.min("p_partkey").alias("first_seq"), F.count("*").alias("copies"))


@query(RULES + "SELECT p_partkey, cat, round(lim, 4) AS lim FROM h")
def numeric_threshold(spark, sf_dir):
    return _rules(spark, sf_dir).select("p_partkey", "cat", F.round("lim", 4).alias("lim"))


@query(RULES + """, p AS (SELECT p_partkey, cat, lim, lag(lim) OVER (PARTITION BY cat ORDER BY p_partkey) AS old FROM h)
SELECT p_partkey, CASE WHEN cat NOT IN ('income', 'landholding', 'age') OR old IS NULL OR lim IS NULL THEN 'uncertain' WHEN lim = old THEN 'no_eligibility_impact' WHEN (lim > old) = (cat <> 'age') THEN 'eligibility_less_restrictive' ELSE 'eligibility_more_restrictive' END AS impact FROM p""")
def threshold_impact(spark, sf_dir):
    r = slices.with_running(_rules(spark, sf_dir), "cat", "p_partkey", {"before": F.struct("lim")})
    return r.select("p_partkey", R.threshold_impact("cat", "before.lim", "lim").alias("impact"))


def _rule_pairs(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 24).alias("pair"), F.when(F.floor(F.col("p_partkey") / 12) % 2 == 0, "old").otherwise("new").alias("side"), F.col("p_partkey").alias("seq"), _rule_text().alias("rule"), F.lit("eligibility").alias("type"), F.lit(None).cast("string").alias("category"), F.lit("page 1").alias("evidence"))


# Matched one old rule after the other, each with the first new one that isn't taken; no rule of these is administrative.
_MATCHED = """, WITH_ AS (SELECT p_partkey // 24 AS pair, p_partkey // 12 % 2 AS side, p_partkey AS seq, norm, cat, lim FROM h QUALIFY row_number() OVER (PARTITION BY p_partkey // 24, p_partkey // 12 % 2, cat, norm ORDER BY p_partkey) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY seq) AS k FROM WITH_ WHERE side = 0), nn AS (SELECT * FROM WITH_ WHERE side = 1),
e AS (SELECT o.pair, o.k, o.seq AS old_seq, list(n.seq ORDER BY n.seq) AS cand FROM o JOIN nn n ON n.pair = o.pair AND (n.norm = o.norm OR (n.cat = o.cat AND (o.cat = 'residency' OR (o.cat IN ('income', 'age', 'landholding') AND o.lim IS NOT NULL AND n.lim IS NOT NULL)))) GROUP BY o.pair, o.k, o.seq),
m AS (SELECT pair, CAST(0 AS BIGINT) AS k, []::BIGINT[] AS taken, NULL::BIGINT AS new_seq FROM (SELECT DISTINCT pair FROM o)
  UNION ALL SELECT pair, k + 1, CASE WHEN f IS NULL THEN taken ELSE list_append(taken, f) END, f FROM (SELECT m.pair, m.k, m.taken, list_filter(e.cand, lambda x: NOT list_contains(m.taken, x))[1] AS f FROM m JOIN o ON o.pair = m.pair AND o.k = m.k + 1 LEFT JOIN e ON e.pair = o.pair AND e.k = o.k)),
c AS (SELECT o.pair, o.seq AS old_seq, n.seq AS new_seq, CASE WHEN n.seq IS NULL THEN 'removed' WHEN n.norm = o.norm OR o.cat = 'residency' OR n.lim = o.lim THEN 'unchanged' ELSE 'modified' END AS change_type,
    CASE WHEN n.seq IS NULL THEN 'eligibility_less_restrictive' WHEN n.norm = o.norm OR o.cat = 'residency' OR n.lim = o.lim THEN 'no_eligibility_impact' WHEN (n.lim > o.lim) <> (o.cat = 'age') THEN 'eligibility_less_restrictive' ELSE 'eligibility_more_restrictive' END AS impact
    FROM o JOIN m ON m.pair = o.pair AND m.k = o.k LEFT JOIN nn n ON n.pair = o.pair AND n.seq = m.new_seq
  UNION ALL SELECT pair, NULL, seq, 'added', 'eligibility_more_restrictive' FROM nn n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pair = n.pair AND m.new_seq = n.seq))
"""
_MATCHED = RULES.replace("WITH r AS", "WITH RECURSIVE r AS", 1).rstrip() + _MATCHED.replace("WITH_", "ru")


@query(_MATCHED + "SELECT pair, old_seq, new_seq, change_type, impact FROM c")
def rule_matches(spark, sf_dir):
    return rules_diff.compare_rules(_rule_pairs(spark, sf_dir)).select("pair", "old_seq", "new_seq", "change_type", "impact")


@query(_MATCHED + """, t AS (SELECT pair, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'removed') AS removed, count(*) FILTER (change_type = 'modified') AS modified, count(*) FILTER (change_type = 'unchanged') AS unchanged, count(*) FILTER (change_type <> 'unchanged' AND impact <> 'no_eligibility_impact') AS real FROM c GROUP BY pair)
SELECT pair, added, removed, modified, unchanged, modified > 0 AS review_required, CASE WHEN real > 0 THEN 'clearly_relevant' WHEN modified > 0 THEN 'potentially_relevant' ELSE 'none' END AS relevance,
  array_to_string(list_filter([CASE WHEN added > 0 THEN added || ' rule(s) added' END, CASE WHEN removed > 0 THEN removed || ' rule(s) removed' END, CASE WHEN modified > 0 THEN modified || ' rule(s) modified' END, CASE WHEN unchanged > 0 THEN unchanged || ' rule(s) unchanged' END], lambda x: x IS NOT NULL), ', ') AS summary FROM t""")
def rule_compare(spark, sf_dir):
    return rules_diff.summarise(rules_diff.compare_rules(_rule_pairs(spark, sf_dir)))


def _same_words(pairs: list[tuple[str, str]]) -> list[dict]:
    """A provider that needs no model: rules are the same where they begin or end alike."""
    return [{"same": a.split()[0] == b.split()[0] or a.split()[-1] == b.split()[-1], "change_type": "modified", "impact": "uncertain", "confidence": 0.8} for a, b in pairs]


@query(f"""WITH RECURSIVE w AS (SELECT p_partkey // 24 AS pair, p_partkey // 12 % 2 AS side, p_partkey AS seq, {_norm_sql("p_name")} AS norm FROM part),
ru AS (SELECT *, split_part(norm, ' ', 1) AS w1, list_extract(string_split(norm, ' '), -1) AS w2 FROM w QUALIFY row_number() OVER (PARTITION BY pair, side, norm ORDER BY seq) = 1),
eq AS (SELECT o.pair, o.seq AS old_seq, n.seq AS new_seq FROM ru o JOIN ru n ON n.pair = o.pair AND n.norm = o.norm AND o.side = 0 AND n.side = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY seq) AS k FROM ru WHERE side = 0 AND NOT EXISTS (SELECT 1 FROM eq WHERE eq.pair = ru.pair AND eq.old_seq = ru.seq)),
nn AS (SELECT * FROM ru WHERE side = 1 AND NOT EXISTS (SELECT 1 FROM eq WHERE eq.pair = ru.pair AND eq.new_seq = ru.seq)),
e AS (SELECT o.pair, o.k, list(n.seq ORDER BY n.seq) AS cand FROM o JOIN nn n ON n.pair = o.pair AND (n.w1 = o.w1 OR n.w2 = o.w2) GROUP BY o.pair, o.k),
m AS (SELECT pair, CAST(0 AS BIGINT) AS k, []::BIGINT[] AS taken, NULL::BIGINT AS new_seq FROM (SELECT DISTINCT pair FROM o)
  UNION ALL SELECT pair, k + 1, CASE WHEN f IS NULL THEN taken ELSE list_append(taken, f) END, f FROM (SELECT m.pair, m.k, m.taken, list_filter(e.cand, lambda x: NOT list_contains(m.taken, x))[1] AS f FROM m JOIN o ON o.pair = m.pair AND o.k = m.k + 1 LEFT JOIN e ON e.pair = o.pair AND e.k = o.k))
SELECT pair, old_seq, new_seq, 'unchanged' AS change_type, 'no_eligibility_impact' AS impact FROM eq
UNION ALL SELECT o.pair, o.seq, m.new_seq, CASE WHEN m.new_seq IS NULL THEN 'removed' ELSE 'modified' END, CASE WHEN m.new_seq IS NULL THEN 'eligibility_less_restrictive' ELSE 'uncertain' END FROM o JOIN m ON m.pair = o.pair AND m.k = o.k
UNION ALL SELECT pair, NULL, seq, 'added', 'eligibility_more_restrictive' FROM nn WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pair = nn.pair AND m.new_seq = nn.seq)""")
def rule_verdicts(spark, sf_dir):
    rules = _rule_pairs(spark, sf_dir).drop("rule", "category").join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("rule")), "seq").withColumn("category", F.lit("disability"))
    return rules_diff.compare_rules(rules, _same_words).select("pair", "old_seq", "new_seq", "change_type", "impact")


# Rules and their evidence whose verdicts are known beforehand; {n} and {m} are a part's numbers, equal for even keys.
_GOOD = "the farmer of the state is read in the order and dated for the plan"
_CASES = [
    # rule, evidence, type; qualification, scope, grounding, its stage; funding, absence
    ("Applicant must be a farmer of the state", _GOOD, "eligibility", "valid", "candidate", "SUPPORTED", "supported", False, False),
    ("null", _GOOD, "eligibility", "empty", "candidate", "SUPPORTED", "supported", False, False),
    ("No exclusions mentioned", _GOOD, "exclusion", "absence", "candidate", "SUPPORTED", "supported", False, True),
    ("State-wise allocation of the farmer fund", "state-wise allocation of the funds for the plan of the state", "eligibility", "funding", "candidate", "SUPPORTED", "supported", True, False),
    ("The member is to be nominated by the farmer group", "to be nominated by the government of the state for the order", "eligibility", "committee", "candidate", "SUPPORTED", "supported", False, False),
    ("Farmer of {n} acres", "the farmer of the state is read in the order for {n} acres", "eligibility", "valid", "candidate", "SUPPORTED", "supported", False, False),
    ("Farmer of {n} acres", "the farmer of the state is read in the order for {m} acres", "eligibility", "valid", "candidate", None, None, False, False),
    ("Farmer of the state", "", "eligibility", "valid", "candidate", "INSUFFICIENT", "none", False, False),
    ("Farmer of the state", "farmer", "eligibility", "valid", "candidate", "INSUFFICIENT", "brief", False, False),
    ("Farmer of the state", "x~~y;;z ^^ farmer ~~~ q;;w ___ ||", "eligibility", "valid", "candidate", "REVIEW_REQUIRED", "garbled", False, False),
    ("Family income below the limit", "the family income of the farmer is read in the order of the state", "eligibility", "valid", "household", "SUPPORTED", "supported", False, False),
    ("Documents required for the farmer", "the documents required of the farmer are read in the order of the state", "eligibility", "valid", "administrative", "SUPPORTED", "supported", False, False),
    ("Income tax payer is excluded as a farmer", "the farmer of the state that files a gst return is read in the order", "exclusion", "valid", "candidate", "REVIEW_REQUIRED", "generalised", False, False),
    ("A student of a scholarship", _GOOD, "eligibility", "valid", "candidate", "REVIEW_REQUIRED", "unsupported", False, False),
]  # fmt: skip


def _cases(spark, sf_dir):
    case, odd = F.col("p_partkey") % len(_CASES), F.col("p_partkey") % 2
    n, m = (F.col("p_size") + 100).cast("string"), (F.col("p_size") + 100 + odd * 60).cast("string")
    filled = lambda k: F.replace(F.replace(F.get(F.array(*[F.lit(c[k]) for c in _CASES]), case.cast("int")), F.lit("{n}"), n), F.lit("{m}"), m)  # noqa: E731
    return read(spark, sf_dir, "part").select("p_partkey", filled(0).alias("rule"), filled(1).alias("evidence"), filled(2).alias("type"))


def _known(columns: str, *places: int) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"  # noqa: E731
    rows = ", ".join(f"({k}, {', '.join(lit(c[p]) for p in places)})" for k, c in enumerate(_CASES))
    return f"(SELECT * FROM (VALUES {rows}) AS v(k, {columns}))"


@query(f"SELECT p_partkey, qualification, scope, funding, absence FROM part JOIN {_known('qualification, scope, funding, absence', 3, 4, 7, 8)} ON k = p_partkey % {len(_CASES)}")
def rule_qualification(spark, sf_dir):
    c = _cases(spark, sf_dir)
    return c.select("p_partkey", R.qualification("rule", "evidence").alias("qualification"), R.scope("rule", "evidence").alias("scope"), R.is_funding("rule", "evidence").alias("funding"), R.is_absence("rule").alias("absence"))


@query(f"SELECT p_partkey, coalesce(status, CASE WHEN p_partkey % 2 = 0 THEN 'SUPPORTED' ELSE 'CONTRADICTED' END) AS status, coalesce(stage, CASE WHEN p_partkey % 2 = 0 THEN 'supported' ELSE 'numbers' END) AS stage FROM part JOIN {_known('status, stage', 5, 6)} ON k = p_partkey % {len(_CASES)}")
def rule_grounding(spark, sf_dir):
    g = _cases(spark, sf_dir).select("p_partkey", R.grounding("rule", "evidence", "type").alias("g"))
    return g.select("p_partkey", "g.status", "g.stage")


@query(f"""WITH a AS (SELECT p_partkey % 40 AS doc, coalesce(status, CASE WHEN p_partkey % 2 = 0 THEN 'SUPPORTED' ELSE 'CONTRADICTED' END) AS status FROM part JOIN {_known('qualification, status', 3, 5)} ON k = p_partkey % {len(_CASES)} WHERE qualification = 'valid')
SELECT doc, count(*) AS rules, count(*) FILTER (status <> 'SUPPORTED') AS unsupported, count(*) FILTER (status = 'CONTRADICTED') AS contradicted FROM a GROUP BY doc""")
def extraction_audit(spark, sf_dir):
    """Extractions of forty documents: their two lists as rows, what doesn't qualify dropped, the rest audited."""
    rule = F.struct("rule", "type", F.lit("other").alias("category"), "evidence", F.lit(90.0).alias("ocr_confidence"), F.lit("0.9").alias("semantic_confidence"))
    pick = lambda kind: F.collect_list(F.when(F.col("type") == kind, rule)).alias(kind)  # noqa: E731
    docs = _cases(spark, sf_dir).withColumn("doc", F.col("p_partkey") % 40).groupBy("doc").agg(pick("eligibility"), pick("exclusion"))
    rows = audit.audit_rules(audit.flatten_extraction(docs, "doc", "eligibility", "exclusion"))
    return rows.groupBy("doc").agg(F.count("*").alias("rules"), F.count_if(F.col("consistency") != "SUPPORTED").alias("unsupported"), F.count_if(F.col("consistency") == "CONTRADICTED").alias("contradicted"))


@query("""SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN (p_size * 10 + 5) * 10000 ELSE 3000 + p_size END AS DOUBLE) AS money, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN 3000 + p_size ELSE p_size + 100 END AS DOUBLE) AS first_number,
  CASE p_partkey % 3 WHEN 0 THEN (p_size * 10 + 5) || ',2023' WHEN 1 THEN (3000 + p_size) || ',' || p_partkey ELSE '2024,' || (p_size + 100) || ',' || (3000 + p_size) END AS numbers FROM part""")
def rule_numbers(spark, sf_dir):
    k, size, big = F.col("p_partkey") % 3, F.col("p_size").cast("string"), (F.col("p_size") + 3000).cast("string")
    text = F.when(k == 0, F.concat(size, F.lit(".5 lakh in 2023"))).when(k == 1, F.concat(F.lit("Rs. "), big, F.lit(" for part "), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("in 2024, "), (F.col("p_size") + 100).cast("string"), F.lit(" of ₹"), big))
    p = read(spark, sf_dir, "part").select("p_partkey", text.alias("t"))
    return p.select("p_partkey", R.money("t").alias("money"), R.first_number("t").alias("first_number"), F.array_join(F.transform(R.numbers("t"), lambda n: n.cast("string")), ",").alias("numbers"))


@query("""SELECT page_id, length(t) >= 50 AND NOT (length(t) < 600 AND t LIKE '%<nav>%' AND t NOT LIKE '%article%') AND (page_id % 6 + 1 <= 3 OR t LIKE '% the %') AS worth FROM (SELECT page_id, substr(lower(coalesce(html, '')), 200, 30 + page_id % 900) AS t FROM pages)""")
def page_skip(spark, sf_dir):
    t = F.lower(F.coalesce("html", F.lit("")))
    p = read(spark, sf_dir, "pages").select("page_id", F.substring(t, F.lit(200), (30 + F.col("page_id") % 900).cast("int")).alias("t"))
    return p.select("page_id", R.worth_extracting("t", F.col("page_id") % 6 + 1, ["<nav>"], ["article"], [" the "]).alias("worth"))


@query("""SELECT page_id, CASE WHEN page_id % 3 < 2 THEN url || '/' || page_id || CASE WHEN page_id % 3 = 0 THEN '-GO.PDF' ELSE '.pdf' END END AS document_url, CASE page_id % 3 WHEN 0 THEN 'order' WHEN 1 THEN 'guideline' END AS document_type
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)""")
def direct_documents(spark, sf_dir):
    k, base = F.col("page_id") % 3, F.regexp_replace("url", "[?#].*$", "")
    url = F.concat(base, F.lit("/"), F.col("page_id").cast("string"), F.when(k == 0, "-GO.PDF").when(k == 1, ".pdf").otherwise(".html"))
    d = read(spark, sf_dir, "pages").select("page_id", discovery.direct_document(url).alias("d"))
    return d.select("page_id", "d.document_url", "d.document_type")


_SCHEMES = "SELECT 'scheme-' || user_id % 300 AS slug, event_id AS seq, event_type AS name, CASE WHEN user_id % 3 <> 0 THEN 'dept' || event_id % 7 END AS department FROM events"


def _scheme_events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("scheme-"), (F.col("user_id") % 300).cast("string")).alias("slug"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("dept"), (F.col("event_id") % 7).cast("string"))).alias("department"))


@query(f"SELECT slug, min(seq) AS id, arg_max(name, seq) AS name, arg_max(department, seq) FILTER (department IS NOT NULL) AS department FROM ({_SCHEMES}) GROUP BY slug")
def schemes(spark, sf_dir):
    return versions.schemes(_scheme_events(spark, sf_dir))


@query(f"SELECT slug, min(seq) AS seq, arg_min(name, seq) AS name FROM ({_SCHEMES}) WHERE CAST(split_part(slug, '-', 2) AS INTEGER) % 4 <> 0 GROUP BY slug")
def schemes_to_add(spark, sf_dir):
    known = _scheme_events(spark, sf_dir).where(F.split_part("slug", F.lit("-"), F.lit(2)).cast("int") % 4 == 0).select("slug").distinct()
    return versions.schemes_to_add(_scheme_events(spark, sf_dir), known).select("slug", "seq", "name")


@query("""WITH v AS (SELECT o_orderkey AS id, o_custkey AS scheme_id, CASE WHEN o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'ACTIVE' ELSE 'ARCHIVED' END AS status FROM orders),
c AS (SELECT v.*, CASE id % 9 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'ARCHIVED' END AS go FROM v), r AS (SELECT *, max(CASE WHEN go = 'ACTIVE' THEN id END) OVER (PARTITION BY scheme_id) AS risen FROM c)
SELECT id, scheme_id, CASE WHEN id = risen THEN 'ACTIVE' WHEN risen IS NOT NULL AND (status = 'ACTIVE' OR go = 'ACTIVE') THEN 'ARCHIVED' WHEN go = 'ARCHIVED' THEN 'ARCHIVED' ELSE status END AS status FROM r""")
def status_changes(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("scheme_id"))
    newest = o.groupBy("scheme_id").agg(F.max("id").alias("newest"))
    v = o.join(newest, "scheme_id").select("id", "scheme_id", F.when(F.col("id") == F.col("newest"), "ACTIVE").otherwise("ARCHIVED").alias("status"))
    changes = o.where("id % 9 < 2").select("id", F.when(F.col("id") % 9 == 0, "ACTIVE").otherwise("ARCHIVED").alias("status"))
    return versions.set_status(v, changes)


@query("SELECT l_orderkey AS version_id, 'rule ' || l_suppkey % 5 AS rule, l_returnflag AS type, CASE WHEN l_suppkey % 2 = 0 THEN 'other' ELSE l_linestatus END AS category, min(l_linenumber) AS seq FROM lineitem GROUP BY ALL")
def stored_rules(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    rules = l.select(F.col("l_orderkey").alias("version_id"), F.concat(F.lit("rule "), (F.col("l_suppkey") % 5).cast("string")).alias("rule"), F.col("l_returnflag").alias("type"), F.when(F.col("l_suppkey") % 2 != 0, F.col("l_linestatus")).alias("category"), F.col("l_linenumber").alias("seq"))
    return versions.store_rules(rules)


@query("SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS page_number, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE ' ' END AS evidence_text FROM part WHERE p_partkey % 5 <> 0 AND (p_partkey % 3 = 0 OR p_partkey % 2 = 0)")
def evidence_rows(spark, sf_dir):
    k = F.col("p_partkey")
    found = F.struct(F.when(k % 3 == 0, F.col("p_size")).cast("int").alias("page_number"), F.when(k % 2 == 0, F.col("p_name")).otherwise(" ").alias("source_text"))
    rules = read(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 5 != 0, found).alias("evidence"))
    return versions.evidence_rows(rules).select("rule_id", "page_number", "evidence_text")


@query("SELECT c_custkey AS id, coalesce(t, CASE WHEN c_custkey % 2 = 0 THEN 'kept' END) AS extracted_text FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS t FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def extracted_texts(spark, sf_dir):
    v = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("document_id"), F.when(F.col("c_custkey") % 2 == 0, "kept").alias("extracted_text"))
    t = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("extracted_text"))
    return versions.with_texts(v, t).select("id", "extracted_text")


@query("""SELECT p_partkey % 50 AS doc, CASE max(CASE p_partkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 0 END) WHEN 3 THEN 'clearly_relevant' WHEN 1 THEN 'uncertain' ELSE 'none' END AS relevance, count(*) FILTER (p_partkey % 7 = 2) > 0 AS review_required,
  count(*) FILTER (p_partkey % 7 = 1) AS put_right, count(*) FILTER (p_partkey % 7 = 0) AS about_income FROM part WHERE p_partkey % 11 < 3 GROUP BY 1""")
def semantic_filter(spark, sf_dir):
    """Changes as a model names them: some of eligibility, some that are notes of status mistaken for it, some uncertain."""
    k = F.col("p_partkey") % 7
    changes = read(spark, sf_dir, "part").where("p_partkey % 11 < 3").select(
        (F.col("p_partkey") % 50).alias("doc"), k.alias("k"), F.when(k < 2, "eligibility_related").otherwise("procedural").alias("category"), F.when(k == 1, "clearly_relevant").when(k == 2, "uncertain").when(k == 0, "none").otherwise("none").alias("eligibility_relevance"),
        F.lit(None).cast("string").alias("affected_attribute"), F.lit("").alias("old_evidence"), F.when(k == 0, F.concat(F.lit("income limit of Rs "), F.col("p_size").cast("string"))).otherwise("this notification is hereby issued").alias("new_evidence"), F.lit("").alias("description"),
    )  # fmt: skip
    checked = comparison.checked_changes(changes, ["notification"])
    told = comparison.relevance_of_changes(checked, "doc")
    right = checked.groupBy("doc").agg(F.count_if((F.col("k") == 1) & (F.col("category") == "document_status") & (F.col("eligibility_relevance") == "none")).alias("put_right"), F.count_if(F.col("affected_attribute") == "income").alias("about_income"))
    return told.join(right, "doc").select("doc", "relevance", "review_required", "put_right", "about_income")


_ABS, _ADM = ["no ", "all rights"], ["licensed under", "token ="]


@query("SELECT doc_id, regexp_matches(lower(trim(text)), 'no |all rights') OR regexp_matches(lower(trim(text)), '^no (exclusion|eligibility|specific exclusion|candidate exclusion)') AS absence, regexp_matches(lower(text), 'licensed under|token =') AS administrative FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def text_filters(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", R.is_absence("text", _ABS).alias("absence"), R.is_administrative("text", _ADM).alias("administrative"))


@query(RELIABILITY.replace("(SELECT doc_id, lang, trim(", "(SELECT doc_id, lang, trim(").replace("len(w) < 10", "len(w) < 3").replace("len(w) >= 10", "len(w) >= 3") + r"""
SELECT doc_id, CASE WHEN l.quality = 0 THEN 'ocr' WHEN length(d.t) < 10 THEN 'short' WHEN NOT r.reliable THEN 'garbled'
  WHEN length(regexp_replace(d.t, '[^$;%^~{}|\\&_`]', '', 'g')) >= 3 OR regexp_matches(d.t, '[$;%^~{}|\\&_`]{2}') OR len(list_filter(d.w, lambda x: regexp_matches(x, '[$;%^~{}|\\&_`]') AND regexp_matches(x, '\p{L}'))) >= 0.25 * len(d.w) THEN 'noise' END AS weakness
FROM labels l JOIN d USING (doc_id) JOIN r USING (doc_id)""")
def evidence_quality(spark, sf_dir):
    j = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    return j.select("doc_id", R.weak_evidence(F.coalesce("text", F.lit("")), F.when(F.col("quality") == 0, 40.0).otherwise(90.0), F.lit("other")).alias("weakness"))


@query("""SELECT l_orderkey AS o_orderkey, count(*) AS evidence, first(l_returnflag ORDER BY l_linenumber, l_returnflag) AS first_flag FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
UNION ALL SELECT o_orderkey, 0, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def rules_with_evidence(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    r = versions.rules_with_evidence(o, e, "o_orderkey", ["l_linenumber", "l_returnflag"])
    return r.select("o_orderkey", F.size("evidence").cast("bigint").alias("evidence"), F.get("evidence", F.lit(0))["l_returnflag"].alias("first_flag"))


@query("""WITH v AS (SELECT event_id AS id, md5(CAST(user_id % 900 AS VARCHAR)) AS h, 'own' || event_id AS url FROM events), d AS (SELECT md5(CAST(c_custkey % 500 AS VARCHAR)) AS h, max(c_custkey) AS id FROM customer GROUP BY 1)
SELECT v.id, d.id AS document_id, 'path' || d.id AS local_path, CASE WHEN d.id IS NULL OR d.id % 3 = 0 THEN v.url ELSE 'doc' || d.id END AS source_url FROM v LEFT JOIN d USING (h)""")
def versions_with_documents(spark, sf_dir):
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))  # noqa: E731
    v = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.md5((F.col("user_id") % 900).cast("string")).alias("document_hash"), text("own", "event_id").alias("source_url"))
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.md5((F.col("c_custkey") % 500).cast("string")).alias("sha256"), text("path", "c_custkey").alias("local_path"), F.when(F.col("c_custkey") % 3 != 0, text("doc", "c_custkey")).alias("source_url"))
    return versions.versions_with_documents(v, d).select("id", "document_id", "local_path", "source_url")


class _ByHost:
    """A fetcher that needs no network: a page's content is its host, hosts with a dash can't be reached."""

    def fetch(self, url: str) -> bytes:
        host = url.split("/")[2]
        if "m." in host:
            raise OSError(host)
        return host.encode()


_HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


@query(f"""WITH u AS (SELECT DISTINCT url, {_HOST} AS host FROM pages), k AS (SELECT {_HOST} AS host, min(url) AS held FROM pages WHERE page_id % 10 = 0 GROUP BY 1),
f AS (SELECT u.*, k.held, min(url) OVER (PARTITION BY u.host) AS first FROM u LEFT JOIN k USING (host))
SELECT url, CASE WHEN host LIKE '%m.%' THEN 'download_failed' WHEN held IS NOT NULL OR url <> first THEN 'unchanged' ELSE 'new' END AS status, CASE WHEN host LIKE '%m.%' THEN NULL ELSE sha256(host) END AS file_hash, CASE WHEN host LIKE '%m.%' THEN NULL ELSE coalesce(held, first) END AS document_url FROM f""")
def download_register(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    known = p.where("page_id % 10 = 0").select(F.sha2(host, 256).alias("file_hash"), F.col("url").alias("document_url"))
    return providers.download_and_register(p.select("url"), _ByHost, known).select("url", "status", "file_hash", "document_url")


@query("SELECT c_custkey, count(o_orderkey) AS documents, max(o_orderdate) AS newest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def versions_left_join_documents(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("documents"), F.max("o_orderdate").alias("newest"))


@query("""WITH k AS (SELECT n_nationkey AS id, lower(n_name) AS slug, 'nation of ' || n_name AS name FROM nation), q AS (SELECT n_nationkey AS query_id, lower('the ' || n_name || ' scheme') AS q FROM nation),
t AS (SELECT query_id, unnest(regexp_split_to_array(q, '[^\\p{L}\\p{N}]+')) AS token, generate_subscripts(regexp_split_to_array(q, '[^\\p{L}\\p{N}]+'), 1) - 1 AS pos FROM q),
m AS (SELECT query_id, id, slug, pos, CASE WHEN contains(slug, token) THEN 0 ELSE 1 END AS weight FROM t JOIN k ON contains(slug, token) OR contains(lower(name), token) WHERE length(token) >= 3 AND token NOT IN ('the', 'and', 'scheme', 'yojana', 'for'))
SELECT query_id, id, slug FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos, weight, id) = 1""".replace("\\\\", "\\"))
def scheme_lookup(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    known = n.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("slug"), F.concat(F.lit("nation of "), F.col("n_name")).alias("name"))
    asked = n.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("the "), F.col("n_name"), F.lit(" scheme")).alias("query"))
    return versions.find_scheme(asked, known).select("query_id", "id", "slug")


# Rules of three schemes.
SCHEME_RULES = [
    ("income", 1, "Annual income must not exceed Rs 50000", "eligibility", "candidate", "SUPPORTED", False), ("income", 2, "Income tax payers are excluded", "exclusion", "candidate", "SUPPORTED", False),
    ("land", 3, "Must own agricultural land", "eligibility", "candidate", "SUPPORTED", False), ("land", 4, "Applicant is a resident of the state", "eligibility", "candidate", "SUPPORTED", False),
    ("land", 5, "Members with a gst return are excluded", "exclusion", "candidate", "SUPPORTED", False), ("land", 6, "Only one per household", "eligibility", "beneficiary_limit", "SUPPORTED", False),
    ("doubt", 7, "Applicant is a resident of the state", "eligibility", "candidate", "CONTRADICTED", True), ("doubt", 8, "Send the form to the office", "eligibility", "administrative", "SUPPORTED", False),
]  # fmt: skip
_RULE_SCHEMA = "scheme_key string, rule_id long, rule string, type string, rule_scope string, consistency string, review_required boolean"


def _citizens(spark, sf_dir):
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    member = lambda r, b: F.struct(F.lit(r).alias("relationship"), b.alias("already_received_benefit"))  # noqa: E731
    return c.select(
        "c_custkey", F.when(k % 7 != 0, F.round(F.col("c_acctbal") * 10, 2)).alias("annual_income"), F.when(k % 5 != 0, k % 3 == 0).alias("income_tax_payer"), F.when(k % 4 != 0, (k % 4).cast("double") - 1).alias("landholding_acres"),
        F.when(k % 6 != 0, F.col("c_nationkey") < 20).alias("is_karnataka_resident"), F.when(k % 3 != 0, k % 11 == 0).alias("gst_return_filer"),
        F.when(k % 8 != 0, F.array(member("self", k % 2 == 0), member("spouse", k % 9 == 0))).alias("household_members"),
    )  # fmt: skip


def _evaluated(spark, sf_dir):
    rules = spark.createDataFrame(SCHEME_RULES, _RULE_SCHEMA)
    return eligibility.evaluate_rules(_citizens(spark, sf_dir), rules)


ELIGIBILITY = """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN round(c_acctbal * 10, 2) END AS income, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 3 = 0 END AS tax, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 - 1 END AS acres,
  CASE WHEN c_custkey % 6 <> 0 THEN c_nationkey < 20 END AS resident, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 11 = 0 END AS gst, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 9 = 0 END AS claimed FROM customer),
e AS (
  SELECT c_custkey, 'income' AS scheme_key, 1 AS rule_id, 'eligibility' AS bucket, true AS trusted, CASE WHEN income IS NULL THEN 'UNKNOWN' WHEN income <= 50000 THEN 'MATCH' ELSE 'NO_MATCH' END AS status FROM c
  UNION ALL SELECT c_custkey, 'income', 2, 'exclusion', true, 'UNKNOWN' FROM c
  UNION ALL SELECT c_custkey, 'land', 3, 'eligibility', true, CASE WHEN acres IS NULL THEN 'UNKNOWN' WHEN acres > 0 THEN 'MATCH' ELSE 'NO_MATCH' END FROM c
  UNION ALL SELECT c_custkey, 'land', 4, 'eligibility', true, CASE WHEN resident IS NULL THEN 'UNKNOWN' WHEN resident THEN 'MATCH' ELSE 'NO_MATCH' END FROM c
  UNION ALL SELECT c_custkey, 'land', 5, 'exclusion', true, CASE WHEN gst IS NULL THEN 'UNKNOWN' WHEN gst THEN 'MATCH' ELSE 'NO_MATCH' END FROM c
  UNION ALL SELECT c_custkey, 'land', 6, 'household', true, CASE WHEN claimed IS NULL THEN 'UNKNOWN' WHEN claimed THEN 'NO_MATCH' ELSE 'MATCH' END FROM c
  UNION ALL SELECT c_custkey, 'doubt', 7, 'eligibility', false, 'REVIEW_REQUIRED' FROM c
  UNION ALL SELECT c_custkey, 'doubt', 8, NULL, true, 'NOT_APPLICABLE' FROM c),
s AS (SELECT c_custkey, scheme_key, count(*) FILTER (bucket = 'exclusion' AND status = 'MATCH') AS excluded, count(*) FILTER (bucket = 'eligibility' AND trusted) AS trusted, count(*) FILTER (bucket = 'eligibility' AND status = 'NO_MATCH') AS failed,
  count(*) FILTER (bucket = 'eligibility' AND status = 'MATCH') AS passed, count(*) FILTER (bucket = 'household' AND status = 'NO_MATCH') AS household_failed, count(*) FILTER (bucket IS NOT NULL AND status IN ('UNKNOWN', 'REVIEW_REQUIRED')) AS open FROM e GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN excluded > 0 THEN 'NOT_ELIGIBLE' WHEN trusted = 0 THEN 'NEEDS_REVIEW' WHEN failed > 0 OR household_failed > 0 THEN 'NOT_ELIGIBLE' WHEN open > 0 THEN 'NEEDS_REVIEW' WHEN passed > 0 AND passed = trusted THEN 'ELIGIBLE' ELSE 'NEEDS_REVIEW' END AS decision FROM s)
"""


@query(ELIGIBILITY + "SELECT c_custkey, CAST(rule_id AS BIGINT) AS rule_id, status FROM e")
def eligibility_rules_eval(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("c_custkey", "rule_id", "status")


@query(ELIGIBILITY + "SELECT c_custkey, scheme_key, decision, passed, failed, open FROM d")
def eligibility_decision(spark, sf_dir):
    return eligibility.decide(_evaluated(spark, sf_dir), ["c_custkey", "scheme_key"]).select("c_custkey", "scheme_key", "decision", "passed", "failed", "open")


@query(ELIGIBILITY + "SELECT c_custkey, status FROM e WHERE rule_id = 6")
def household_limit(spark, sf_dir):
    return _evaluated(spark, sf_dir).where("rule_id = 6").select("c_custkey", "status")


@query(ELIGIBILITY + """SELECT count(*) FILTER (rule_id = 4 AND bucket IN ('eligibility', 'exclusion') AND status IN ('MATCH', 'NO_MATCH')) AS contradicted_rules_used,
  count(*) FILTER (c_custkey % 2 = 0 AND bucket IN ('eligibility', 'exclusion') AND status IN ('MATCH', 'NO_MATCH')) AS review_rules_used FROM e""")
def safety_counters(spark, sf_dir):
    """As if rule 4 were contradicted and every second citizen's rules marked for review, and yet they were used."""
    marked = _evaluated(spark, sf_dir).withColumns({"consistency": F.when(F.col("rule_id") == 4, "CONTRADICTED").otherwise("SUPPORTED"), "review_required": F.col("c_custkey") % 2 == 0})
    return eligibility.safety_counters(marked)


_AMOUNT = "format('{:,}', CAST(round_even(income, 0) AS BIGINT))"
REASONS = ELIGIBILITY + f"""
, r AS (SELECT c_custkey, scheme_key, rule_id, bucket, status, CASE rule_id
    WHEN 1 THEN CASE WHEN income IS NULL THEN 'Annual income is unknown (not specified in citizen profile).' WHEN income <= 50000 THEN 'Annual income ₹' || {_AMOUNT} || ' satisfies required income limit ₹50,000.' ELSE 'Annual income ₹' || {_AMOUNT} || ' exceeds required income limit ₹50,000.' END
    WHEN 2 THEN CASE WHEN income IS NULL THEN 'Annual income is unknown (not specified in citizen profile).' ELSE 'Could not parse numerical income threshold from scheme rule.' END
    WHEN 3 THEN CASE WHEN acres IS NULL THEN 'Agricultural land ownership information is unknown.' WHEN acres > 0 THEN 'Citizen owns agricultural land as required.' ELSE 'Citizen does not own agricultural land as required.' END
    WHEN 4 THEN CASE WHEN resident IS NULL THEN 'Karnataka residency / state information is unknown.' WHEN resident THEN 'Citizen is a resident of Karnataka.' ELSE 'Citizen is not a resident of Karnataka.' END
    WHEN 5 THEN CASE WHEN gst IS NULL THEN 'GST return filing status for self or spouse is unknown.' WHEN gst THEN 'Citizen triggers tax/GST disqualification condition.' ELSE 'Citizen does not trigger tax/GST disqualification condition.' END
    WHEN 6 THEN CASE WHEN claimed IS NULL THEN 'Household member details not provided; cannot verify whether another household member has already claimed the benefit.' WHEN claimed THEN 'Beneficiary limit reached: 1 other member(s) in household already received benefit.' ELSE 'Beneficiary quota available in household (no other member has claimed the benefit).' END END AS reason FROM e JOIN c USING (c_custkey)),
n AS (SELECT d.c_custkey, d.scheme_key, d.decision,
    string_agg(reason, ' | ' ORDER BY rule_id) FILTER (CASE WHEN excluded > 0 THEN bucket = 'exclusion' AND status = 'MATCH' WHEN trusted = 0 THEN false WHEN failed > 0 THEN bucket = 'eligibility' AND status = 'NO_MATCH' WHEN household_failed > 0 THEN bucket = 'household' AND status = 'NO_MATCH' WHEN decision = 'ELIGIBLE' THEN bucket = 'eligibility' AND status = 'MATCH' ELSE false END) AS why,
    string_agg(CASE bucket WHEN 'eligibility' THEN '' WHEN 'exclusion' THEN 'Exclusion verification needed: ' ELSE 'Household constraint verification needed: ' END || reason, ' | ' ORDER BY CASE bucket WHEN 'eligibility' THEN 0 WHEN 'exclusion' THEN 1 ELSE 2 END, rule_id)
      FILTER (excluded = 0 AND trusted > 0 AND failed = 0 AND household_failed = 0 AND bucket IS NOT NULL AND status = 'UNKNOWN') AS missing
  FROM d JOIN r USING (c_custkey, scheme_key) GROUP BY ALL)
SELECT c_custkey, scheme_key, decision, coalesce(why, missing, '') AS summary, coalesce(missing, '') AS missing, CASE WHEN scheme_key = 'doubt' THEN 1 ELSE 0 END AS reviews FROM n"""


@query(REASONS)
def decision_reasons(spark, sf_dir):
    keys = ["c_custkey", "scheme_key"]
    evaluated = _evaluated(spark, sf_dir)
    out = eligibility.explain(evaluated, eligibility.decide(evaluated, keys), keys)
    return out.select(*keys, "decision", F.array_join("summary_reasons", " | ").alias("summary"), F.array_join("missing_information", " | ").alias("missing"), F.size("review_reasons").alias("reviews"))


_VERSIONS = "v AS (SELECT n_nationkey * 2 + i AS id, n_nationkey AS scheme_id, CASE WHEN i = 1 AND n_nationkey % 5 <> 0 THEN 'ACTIVE' ELSE 'ARCHIVED' END AS status FROM nation, (SELECT unnest([0, 1]) AS i))"


@query("""WITH k AS (SELECT n_nationkey AS id, lower(n_name) AS slug, 'nation of ' || n_name AS name FROM nation), q AS (SELECT n_nationkey AS query_id, lower('the ' || n_name || ' scheme') AS q FROM nation),
t AS (SELECT query_id, unnest(regexp_split_to_array(q, '[^\\p{L}\\p{N}]+')) AS token, generate_subscripts(regexp_split_to_array(q, '[^\\p{L}\\p{N}]+'), 1) - 1 AS pos FROM q),
m AS (SELECT query_id, id, slug, pos, CASE WHEN contains(slug, token) THEN 0 ELSE 1 END AS weight FROM t JOIN k ON contains(slug, token) OR contains(lower(name), token) WHERE length(token) >= 3 AND token NOT IN ('the', 'and', 'scheme', 'yojana', 'for')),
f AS (SELECT query_id, id, slug FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos, weight, id) = 1), """.replace("\\\\", "\\") + _VERSIONS + """
SELECT query_id, slug AS scheme_key, CAST(v.id AS BIGINT) AS version_id, CASE WHEN v.id IS NULL THEN 0 ELSE 2 END AS eligibility, CASE WHEN v.id IS NULL THEN 0 ELSE 1 END AS exclusions, CASE WHEN v.id IS NULL THEN 0 ELSE 1 END AS with_evidence
FROM f LEFT JOIN v ON v.scheme_id = f.id AND v.status = 'ACTIVE'""")
def current_rules(spark, sf_dir):
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey").cast("bigint")
    known = n.select(k.alias("id"), F.lower("n_name").alias("slug"), F.concat(F.lit("nation of "), F.col("n_name")).alias("name"))
    asked = n.select(k.alias("query_id"), F.concat(F.lit("the "), F.col("n_name"), F.lit(" scheme")).alias("query"))
    v = n.select(k.alias("scheme_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    v = v.select((F.col("scheme_id") * 2 + F.col("i")).alias("id"), "scheme_id", F.concat(F.lit("v"), F.col("i").cast("string")).alias("version_label"), F.when((F.col("i") == 1) & (F.col("scheme_id") % 5 != 0), "ACTIVE").otherwise("ARCHIVED").alias("status"))
    rules = v.select(F.col("id").alias("scheme_version_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("j")).select((F.col("scheme_version_id") * 10 + F.col("j")).alias("id"), "scheme_version_id", F.concat(F.lit("rule "), F.col("j").cast("string")).alias("rule"), F.when(F.col("j") < 2, "eligibility").otherwise("exclusion").alias("type"), F.lit("other").alias("category"))
    evidence = rules.where("id % 10 = 0").select(F.col("id").alias("rule_id"), F.lit(1).alias("page_number"), F.lit("text").alias("evidence_text"), F.lit(None).cast("string").alias("source_url"))
    out = versions.current_rules(asked, known, v, rules, evidence)
    backed = F.size(F.filter(F.concat("eligibility_rules", "exclusion_rules"), lambda r: F.size(r["evidence"]) > 0))
    return out.select("query_id", "scheme_key", "version_id", F.size("eligibility_rules").alias("eligibility"), F.size("exclusion_rules").alias("exclusions"), backed.alias("with_evidence"))


@query(f"""WITH p AS (SELECT p_partkey, {_RULE} AS old FROM part), x AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN old WHEN 1 THEN old || ' and 7 more' ELSE 'nothing alike 3' END AS new, p_partkey % 3 = 2 AS titles FROM p),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(old), '[\\p{{L}}\\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower(new), '[\\p{{L}}\\p{{N}}_]+')) AS b FROM x), j AS (SELECT *, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS jac FROM w)
SELECT p_partkey AS pair, CASE WHEN old = new THEN 'identical' WHEN jac < 0.15 OR (titles AND jac < 0.35) THEN 'different_document' ELSE 'possible_change' END AS status, CAST(CASE WHEN old = new THEN 0 ELSE 1 END AS BIGINT) AS pages_modified, CASE WHEN old <> new AND (jac < 0.15 OR (titles AND jac < 0.35)) THEN true ELSE false END AS review_required FROM j""")
def diff_verdict(spark, sf_dir):
    k = F.col("p_partkey") % 3
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair"), _rule_text().alias("old"), k.alias("k"))
    p = p.withColumn("new", F.when(F.col("k") == 0, F.col("old")).when(F.col("k") == 1, F.concat("old", F.lit(" and 7 more"))).otherwise("nothing alike 3"))
    doc = lambda c, title: p.select("pair", F.sha2(c, 256).alias("sha256"), title.alias("title"), F.create_map(F.lit("lang"), F.lit("en")).alias("meta"))  # noqa: E731
    page = lambda c: p.select("pair", F.lit(1).alias("page_number"), F.col(c).alias("text"))  # noqa: E731
    out = comparison.compare_documents(doc("old", F.lit("a")), doc("new", F.when(F.col("k") == 2, "b").otherwise("a")), page("old"), page("new"))
    return out.select("pair", "status", "pages_modified", "review_required")


@query(ELIGIBILITY + "SELECT scheme_key, decision, count(*) AS citizens FROM d GROUP BY 1, 2")
def decision_summary(spark, sf_dir):
    return eligibility.decide(_evaluated(spark, sf_dir), ["c_custkey", "scheme_key"]).groupBy("scheme_key", "decision").agg(F.count("*").alias("citizens"))


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Woman, salary 20000 per month, 2.5 acres' WHEN 1 THEN 'male farmer, ' || (c_custkey % 9) || '.5 lakh per year, landless' WHEN 2 THEN 'earns ' || (10 + c_custkey % 30) || 'k per month, BPL card, failed' ELSE 'from Karnataka, passed, taxpayer' END AS s FROM customer)
SELECT c_custkey, CAST(CASE c_custkey % 4 WHEN 0 THEN 240000.0 WHEN 1 THEN (c_custkey % 9 + 0.5) * 100000.0 WHEN 2 THEN (10 + c_custkey % 30) * 12000.0 END AS DOUBLE) AS annual_income, CASE c_custkey % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender,
  CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS owns_land, CASE c_custkey % 4 WHEN 2 THEN true WHEN 3 THEN false END AS failed, CASE c_custkey % 4 WHEN 2 THEN 'BPL' END AS card, CASE c_custkey % 4 WHEN 3 THEN 'Karnataka' END AS state FROM t""")
def citizen_text_parse(spark, sf_dir):
    k = F.col("c_custkey")
    said = F.when(k % 4 == 0, "Woman, salary 20000 per month, 2.5 acres").when(k % 4 == 1, F.concat(F.lit("male farmer, "), (k % 9).cast("string"), F.lit(".5 lakh per year, landless"))).when(k % 4 == 2, F.concat(F.lit("earns "), (10 + k % 30).cast("string"), F.lit("k per month, BPL card, failed"))).otherwise("from Karnataka, passed, taxpayer")
    p = read(spark, sf_dir, "customer").select("c_custkey", C.parse_profile(said).alias("p"))
    return p.select("c_custkey", "p.annual_income", "p.gender", F.col("p.owns_agricultural_land").alias("owns_land"), F.col("p.failed_semester").alias("failed"), F.col("p.ration_card_type").alias("card"), "p.state")


@query("""WITH j AS (SELECT lang, quality = 1 AS f, toxic = 0 AS g FROM labels JOIN documents USING (doc_id)), s AS (SELECT lang, count(*) FILTER (f AND g) AS tp, count(*) FILTER (f AND NOT g) AS fp, count(*) FILTER (NOT f AND g) AS fn FROM j GROUP BY lang)
SELECT lang, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn), 4) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(2 * tp / (2 * tp + fp + fn), 4) END AS f1 FROM s""")
def precision_recall_f1(spark, sf_dir):
    j = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.precision_recall(j, ["lang"], F.col("quality") == 1, F.col("toxic") == 0)


@query("SELECT user_id, count(*) AS steps, count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS failures, round(sum(value), 2) AS total_ms, round(count(*) FILTER (event_type <> 'error') / count(*), 2) AS tool_call_rate FROM events GROUP BY user_id")
def trace_metrics(spark, sf_dir):
    return metrics.trace_metrics(_trace(spark, sf_dir), "user_id", "success", "value")


def _trace(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("success", F.col("event_type") != "error")


@query("WITH r AS (SELECT user_id, arg_max(event_type, event_id) AS state, count(*) AS steps, avg(value) AS ms FROM events GROUP BY user_id) SELECT count(*) AS runs, count(*) FILTER (state IN ('purchase', 'view')) AS successful, count(*) FILTER (state = 'error') AS failed, round(avg(steps), 2) AS avg_steps, round(avg(ms), 2) AS avg_ms, round(count(*) FILTER (state IN ('purchase', 'view')) / count(*), 4) AS success_rate FROM r")
def batch_metrics(spark, sf_dir):
    runs = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.count("*").alias("steps"), F.avg("value").alias("ms"))
    return metrics.batch_metrics(runs, "state", ("purchase", "view"), ("error",), ["steps", "ms"])


@query("SELECT user_id, count(*) FILTER (u) AS unnecessary FROM (SELECT user_id, coalesce(lag(event_type) OVER w = event_type AND lag(CAST(value > 50 AS VARCHAR)) OVER w IS NOT DISTINCT FROM CAST(value > 50 AS VARCHAR) AND lag(event_type) OVER w <> 'error', false) AS u FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id")
def unnecessary_calls(spark, sf_dir):
    t = _trace(spark, sf_dir).withColumn("args", (F.col("value") > 50).cast("string"))
    return metrics.unnecessary_calls(t, "user_id", "event_id", "event_type", "args", "success").groupBy("user_id").agg(F.count_if("unnecessary").alias("unnecessary"))


@query("SELECT event_id, CAST(sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failures, sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) OVER w > 2 AS aborted FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def retry_counter(spark, sf_dir):
    t = read(spark, sf_dir, "events").withColumn("ok", ~(F.col("value") < 5))
    return metrics.retries(t, "user_id", "event_id", "event_type", "ok").select("event_id", "failures", "aborted")


@query("SELECT l_returnflag, round_even(avg(l_quantity), 1) AS avg_confidence, round_even(avg(CASE WHEN l_quantity < 25 THEN 1 ELSE 0 END) * 100, 1) AS low_conf_percentage FROM lineitem GROUP BY l_returnflag")
def ocr_stats(spark, sf_dir):
    return metrics.ocr_stats(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 25)


@query("SELECT conv_id, count(*) AS blocks, string_agg(t, chr(10) ORDER BY role) AS text FROM (SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def block_assembly(spark, sf_dir):
    return metrics.assemble_blocks(read(spark, sf_dir, "conversations"), "conv_id", "role", "turn", "text")


_BOX = "SELECT label, CAST(floor(embedding[1] * 100) AS BIGINT) AS x0, CAST(floor(embedding[2] * 100) AS BIGINT) AS y0, CAST(floor(embedding[1] * 100) AS BIGINT) + 10 AS x1, CAST(floor(embedding[2] * 100) AS BIGINT) + 10 AS y1, floor(embedding[3] * 100) AS confidence FROM embeddings"


@query(f"SELECT label, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS cells, round(coalesce(avg(confidence) FILTER (confidence > 0), 0), 2) AS confidence FROM ({_BOX}) GROUP BY label")
def table_bbox(spark, sf_dir):
    e, at = read(spark, sf_dir, "embeddings"), lambda i: F.floor(F.col("embedding")[i] * 100)
    cells = e.select("label", at(0).alias("x0"), at(1).alias("y0"), (at(0) + 10).alias("x1"), (at(1) + 10).alias("y1"), at(2).cast("double").alias("confidence"))
    return metrics.boxes(cells, ["label"])


@query("""WITH RECURSIVE c AS (SELECT vec_id // 20 AS t, vec_id, CAST(embedding[2] * 100 AS DOUBLE) AS y FROM embeddings), s AS (SELECT t, min(y) AS y, CAST(0 AS BIGINT) AS n FROM c GROUP BY t
UNION ALL SELECT s.t, (SELECT min(c.y) FROM c WHERE c.t = s.t AND c.y - s.y > 15), s.n + 1 FROM s WHERE (SELECT min(c.y) FROM c WHERE c.t = s.t AND c.y - s.y > 15) IS NOT NULL)
SELECT c.t AS table_id, CAST(max(s.n) AS INTEGER) AS row_index, vec_id FROM c JOIN s ON s.t = c.t AND s.y <= c.y GROUP BY c.t, vec_id""")
def row_grouping(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("table_id"), (F.col("embedding")[0] * 100).cast("double").alias("x"), (F.col("embedding")[1] * 100).cast("double").alias("y"), "vec_id")
    return comparison.rows_of_table(e, "table_id").select("table_id", "row_index", "vec_id")


@query("SELECT lang, count(*) AS rules, count(*) FILTER (toxic = 1 OR quality = 0) AS rule_review_count, CAST((count(*) FILTER (toxic = 1) > 0) AS BIGINT) + CAST((count(*) FILTER (quality = 0) > 0) AS BIGINT) AS reasons FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def extraction_counts(spark, sf_dir):
    j = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    j = j.withColumns({"review_reasons": F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "quality"))), "review_required": (F.col("toxic") == 1) | (F.col("quality") == 0)})
    pages = j.select("lang").distinct().select("lang", F.lit("TEXT").alias("page_type"), F.lit(90.0).alias("avg_confidence"))
    return audit.document_review(j, pages, "lang").select("lang", "rules", "rule_review_count", F.col("reasons").cast("bigint").alias("reasons"))


@query(r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS bs FROM documents), b AS (SELECT doc_id, (i - 1) // 5 + 1 AS page, i, bs[i] AS t FROM (SELECT doc_id, bs, unnest(range(1, len(bs) + 1)) AS i FROM d)),
p AS (SELECT doc_id, page, '--- Page ' || page || ' ---' || chr(10) || string_agg(t, chr(10) ORDER BY i) AS t FROM b GROUP BY doc_id, page), w AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY page) AS t FROM p GROUP BY doc_id)
SELECT doc_id, length(t) > 1200 AS truncated, md5(CASE WHEN length(t) > 1200 THEN substr(t, 1, 1200) || chr(10) || '... [truncated]' ELSE t END) AS context_md5 FROM w""")
def document_context(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\. ")).alias("i", "t"))
    d = d.withColumn("page", F.floor(F.col("i") / 5) + 1)
    out = comparison.document_context(d, "doc_id", "page", "i", "t", 1200)
    return out.select("doc_id", F.col("context").endswith("... [truncated]").alias("truncated"), F.md5("context").alias("context_md5"))


@query("""WITH p AS (SELECT doc_id % 150 AS doc, avg(CASE WHEN doc_id % 3 = 0 THEN 40 + doc_id % 45 END) AS scan FROM documents GROUP BY 1), r AS (SELECT doc_id % 150 AS doc, count(*) AS rules, count(*) FILTER (toxic = 1) AS marked FROM labels GROUP BY 1)
SELECT doc, round(scan, 6) AS scan_confidence, coalesce(rules, 0) AS rules, coalesce(marked, 0) AS rule_review_count, coalesce(marked, 0) > 0 OR coalesce(scan < 60, false) AS review_required FROM p LEFT JOIN r USING (doc)""")
def scan_review(spark, sf_dir):
    """Documents of which pages were scanned with more or less confidence, and rules of some."""
    doc = (F.col("doc_id") % 150).alias("doc")
    pages = read(spark, sf_dir, "documents").select(doc, F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "SCANNED").otherwise("TABLE")).otherwise("TEXT").alias("page_type"), (F.col("doc_id") % 45 + 40).cast("double").alias("avg_confidence"))
    rules = read(spark, sf_dir, "labels").select(doc, (F.col("toxic") == 1).alias("review_required"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("review_reasons"))
    out = audit.document_review(rules, pages, "doc")
    return out.select("doc", F.round("scan_confidence", 6).alias("scan_confidence"), "rules", "rule_review_count", "review_required")


@query(f"SELECT lang, count(*) AS pages, count(*) FILTER ({USABLE}) AS usable, count(*) FILTER (NOT {USABLE}) AS needs_ocr FROM (SELECT lang, coalesce(text, '') AS text FROM documents) GROUP BY lang")
def document_summary(spark, sf_dir):
    usable = X.is_usable("text")
    d = read(spark, sf_dir, "documents").select("lang", usable.alias("usable"), F.when(usable, "TEXT").otherwise("SCANNED").alias("page_type"))
    return metrics.summary_of_pages(d, "lang").select("lang", "pages", "usable", "needs_ocr")


class _Reader:
    """A reader of documents that are their pages' texts between form feeds, a table where a text has bars."""

    def pages(self, content: bytes) -> list[dict]:
        texts = content.decode().split("\f")
        return [{"page_number": n + 1, "text": t, "blocks": [{}] * (t.count("\n") + 1), "has_table": t.count(" | ") >= 4} for n, t in enumerate(texts)]


class _Ocr:
    """An engine that reads a page as its number, in words; the second reading is better, on page 3 it fails."""

    name = "counting"

    def is_available(self) -> bool:
        return True

    def extract(self, content: bytes, page: int, attempt: int) -> dict:
        if page % 4 == 3:
            raise OSError("no reading")
        return {"text": f"page {page} of the document, read {attempt}", "avg_confidence": 40.0 + page * 10 + 5 * attempt, "low_conf_percentage": 20.0}


@query(f"""WITH d AS (SELECT doc_id // 8 AS doc, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS n, coalesce(text, '') AS text FROM documents),
u AS (SELECT *, {USABLE} AS usable, length(text) - length(replace(text, ' | ', '  ')) >= 4 AS tab, length(text) - length(replace(text, chr(10), '')) + 1 > 5 AS many, {_FORMS} AS f FROM d),
p AS (SELECT *, length(f) - length(replace(f, ';', '')) >= 3 AS form, CASE WHEN usable THEN 'direct' WHEN n % 4 = 3 THEN 'failed' ELSE 'ocr' END AS method, CASE WHEN usable THEN 100 WHEN n % 4 = 3 THEN 0 WHEN 45 + n * 10 >= 55 THEN 45 + n * 10 ELSE 50 + n * 10 END AS conf FROM u)
SELECT 'doc' || doc AS path, count(*) AS pages, count(*) FILTER (usable) AS usable_pages, count(*) FILTER (NOT usable AND NOT form AND NOT tab) AS scanned_pages, count(*) FILTER (tab AND (usable OR NOT form)) AS table_pages, count(*) FILTER (usable AND form) AS form_pages, count(*) FILTER (method = 'ocr') > 0 AS ocr_performed,
  count(*) FILTER (method = 'failed' OR conf < 60) AS pages_to_review, sum(conf) AS confidence FROM p GROUP BY doc""")
def document_scan(spark, sf_dir):
    """Eight documents in a file: the files are read into pages, classified, read again by OCR where that is needed, and summed up."""
    text = F.struct("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda p: p["t"]), "\f")
    files = read(spark, sf_dir, "documents").groupBy(F.concat(F.lit("doc"), F.floor(F.col("doc_id") / 8).cast("string")).alias("path")).agg(joined.cast("binary").alias("content"))
    pages = documents.understood(providers.scan_pages(files, _Reader), files, _Ocr, FORMS)
    confidence = pages.groupBy("path").agg(F.sum("avg_confidence").cast("bigint").alias("confidence"))
    return documents.summaries(pages).drop("text", "avg_confidence").join(confidence, "path")


@query("SELECT event_id, props, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, json_keys(props)[1] AS k FROM events)")
def json_props(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "props", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", "props", F.try_element_at("m", F.get(F.map_keys("m"), F.lit(0))).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
