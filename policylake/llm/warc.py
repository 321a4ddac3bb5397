"""Not-modified revisits of web captures, resolved to the full responses they stand for.

A revisit answers a conditional request with status 304 and has no body. Its response is the latest earlier full response
of the same canonical URL: an as-of join. It is a last-value window over a URL's captures in order of time, in two steps, so
that one URL's captures need not meet in one task: within slices of time, then over the last response of each slice.
Validators (entity tags, else the time of last modification) have to agree; headers that a 304 may update are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a 304 that replace those of the stored response (HTTP Semantics, sections 8.8 and 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Seconds of a slice.
SLICE = 6 * 3600


def canonical_url(url: str | Column) -> Column:
    """Host in lower case without scheme and default port, path, and the query without tracking parameters and fragment."""
    u = F.regexp_replace(F.regexp_replace(F.trim(F.col(url) if isinstance(url, str) else url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host, rest = F.regexp_extract(u, "^([^/?]*)(.*)$", 1), F.regexp_extract(u, "^([^/?]*)(.*)$", 2)
    rest = F.regexp_replace(F.regexp_replace(rest, "([?&])(utm_[a-z]+|ref|gclid|fbclid)=[^&]*", "$1"), "&&+", "&")
    rest = F.regexp_replace(F.regexp_replace(rest, "\\?&+", "?"), "[?&]+$", "")
    return F.concat(F.regexp_replace(F.lower(host), ":(80|443)$", ""), F.regexp_replace(rest, "/+(\\?|$)", "$1"))


def strong(etag: Column) -> Column:
    """An entity tag without its mark of weakness: a revisit is compared weakly. An empty one is none."""
    return F.nullif(F.regexp_replace(F.trim(etag), "^W/", ""), F.lit(""))


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """A row for each revisit of ``records`` (record_id, url, ts, kind, status, etag, last_modified, headers, digest).

    ``kind`` is response or revisit; a response counts as full with status 200. Returns record_id, canonical, ts,
    response_id, response_ts, outcome, headers and digest (of the response's body). Outcomes: resolved; unvalidated (a
    response, but no validator on both sides to compare: accepted); mismatch (validators differ: no digest, headers as
    they came); missing (no earlier response). Header names are compared in lower case.

    Ties: a response at the very time of a revisit is earlier if its record_id is smaller; of several the largest id
    counts. Null urls or times are missing. Null headers count as none. Repeated records give repeated rows. Other
    columns are ignored; no record, no row.
    """
    fields = ["record_id", "ts", "etag", "last_modified", "headers", "digest"]
    base = records.where(F.col("kind").isin("response", "revisit")).select("record_id", "url", "ts", "kind", "status", "etag", "last_modified", "headers", "digest")
    base = base.withColumn("canonical", canonical_url("url")).withColumn("slice", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(slice_seconds * 1_000_000)))
    lower = F.map_from_entries(F.array_sort(F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    base = base.withColumn("headers", lower)
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("url").isNotNull() & F.col("ts").isNotNull()
    base = base.withColumn("full", F.when(full, F.struct(*fields)))
    # Step 1: the last full response within the slice. Step 2: that of the earlier slices, a row for each slice.
    within = Window.partitionBy("canonical", "slice").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = base.withColumn("near", F.last("full", ignorenulls=True).over(within)).where("kind = 'revisit'").drop("full")
    order = F.struct(F.col("ts"), F.col("record_id"))
    slices = base.where("full IS NOT NULL OR kind = 'revisit'").groupBy("canonical", "slice").agg(F.max_by("full", F.when(F.col("full").isNotNull(), order)).alias("newest"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("far", F.last("newest", ignorenulls=True).over(before)).select("canonical", "slice", "far").where("far IS NOT NULL")
    found = near.join(slices, ["canonical", "slice"], "left").withColumn("r", F.coalesce("near", "far"))
    usable = F.col("url").isNotNull() & F.col("ts").isNotNull() & F.col("r").isNotNull()
    mine, theirs = strong(F.col("etag")), strong(F.col("r.etag"))
    both_tags, both_times = mine.isNotNull() & theirs.isNotNull(), F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull()
    outcome = (
        F.when(~usable, "missing").when(both_tags, F.when(mine == theirs, "resolved").otherwise("mismatch"))
        .when(both_times, F.when(F.col("last_modified") == F.col("r.last_modified"), "resolved").otherwise("mismatch")).otherwise("unvalidated")
    )
    found = found.withColumn("outcome", outcome)
    good = F.col("outcome").isin("resolved", "unvalidated")
    allowed = F.map_filter("headers", lambda k, v: k.isin(*permitted))
    kept = F.map_filter("r.headers", lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(allowed), k), F.lit(False)))
    merged = F.when(good, F.map_concat(kept, allowed)).otherwise(F.col("headers"))
    return found.select("record_id", "canonical", "ts", F.when(usable, F.col("r.record_id")).alias("response_id"), F.when(usable, F.col("r.ts")).alias("response_ts"), "outcome", merged.alias("headers"), F.when(good, F.col("r.digest")).alias("digest"))


def crawl_of(pages: DataFrame) -> DataFrame:
    """Captures made from pages (page_id, url, html): a response, a revisit a day later by another form of the URL, a
    response with a new entity tag, and a last revisit whose validators the page's digest chooses."""
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("d"))
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("page_id", F.lit(1000)) * 60)
    day = lambda n: start + F.expr(f"INTERVAL {n} DAYS")
    tag = lambda end: F.concat(F.lit('"'), F.col("d"), F.lit(end + '"'))
    which = F.ascii(F.substring("d", 1, 1))
    other = F.concat(F.regexp_replace("url", "^https?://", "http://"), F.lit("#again"))
    rec = lambda n, url, kind, status, etag, modified, headers: F.struct(
        (F.col("page_id") * 4 + n).alias("record_id"), url.alias("url"), day(n).alias("ts"), F.lit(kind).alias("kind"), F.lit(status).alias("status"), etag.alias("etag"),
        modified.alias("last_modified"), headers.alias("headers"), (F.col("d") if kind == "response" else F.lit(None).cast("string")).alias("digest"),
    )
    none = F.lit(None).cast("string")
    head = lambda *pairs: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in pairs))
    rows = F.array(
        rec(0, F.col("url"), "response", 200, tag(""), F.lit("day 0"), head("Content-Type", "text/html", "Cache-Control", "max-age=60", "Content-Length", F.length("d").cast("string"))),
        rec(1, other, "revisit", 304, F.concat(F.lit("W/"), tag("")), none, head("Cache-Control", "max-age=600", "Content-Length", "0", "Expires", "never")),
        rec(2, F.col("url"), "response", 200, tag("-2"), F.lit("day 2"), head("Content-Type", "text/html", "Vary", "accept")),
        rec(3, other, "revisit", 304, F.when(which < 56, tag("-2")).when(which < 99, tag("")).otherwise(none), F.when(which < 101, F.lit("day 2")), head("Cache-Control", "no-store", "Set-Cookie", "x")),
    )
    return p.select(F.explode(rows).alias("r")).select("r.*")
