"""Registry, documents and scheme versions as views over append-only arrivals.

State machines that go row by row are windows here: what a key's state was before a row is a lag, a running last or a
first occurrence. A writer appends arrivals; every state is a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from .slices import SLICE, with_first, with_running


def latest(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*key, "r.*").select(df.columns)


def registry(events: DataFrame, deleted: str | None = None) -> DataFrame:
    """Sources from upserts (official_url, seq and attributes): a URL's id is its first upsert's, attributes are its last's.

    ``deleted``: a boolean column of tombstones; an upsert after one makes a new source."""
    if deleted:
        tombs = events.groupBy("official_url").agg(F.max(F.when(F.col(deleted), F.col("seq"))).alias("_gone"))
        events = events.join(tombs, "official_url").where("_gone IS NULL OR seq > _gone").drop("_gone", deleted)
    rest = [c for c in events.columns if c not in ("official_url", "seq")]
    return events.groupBy("official_url").agg(F.min("seq").alias("id"), *[F.max_by(c, "seq").alias(c) for c in rest])


def sources_by_id(sources: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The sources whose id is wanted, once each; an id that isn't there, or null, has no row."""
    return sources.join(wanted.select(key).distinct(), key, "left_semi")


def status_updates(sources: DataFrame, updates: DataFrame) -> DataFrame:
    """Sources (id, active, last_status and more) after updates (id, seq, status): the last status of each, and active as long as
    that isn't inactive. Others stay as they are; updates of unknown sources do nothing."""
    last = updates.groupBy("id").agg(F.max_by("status", "seq").alias("_status"))
    out = sources.join(last, "id", "left")
    return out.withColumns({"last_status": F.coalesce("_status", "last_status"), "active": F.when(F.col("_status").isNotNull(), F.col("_status") != "inactive").otherwise(F.col("active"))}).select(sources.columns)


def source_checks(checks: DataFrame, source: str, at: str, success: str | Column) -> DataFrame:
    """last_checked of all checks, last_successful_check of those that succeeded."""
    return checks.groupBy(col(source).alias("source_id")).agg(F.max(at).alias("last_checked"), F.max(F.when(col(success), F.col(at))).alias("last_successful_check"))


def first_seen(arrivals: DataFrame, hash_col: str, seq: str) -> DataFrame:
    """Add status: new for a hash's first arrival, unchanged for later ones, and the arrival that holds the document."""
    first = arrivals.groupBy(F.col(hash_col).alias("_hash")).agg(F.min(seq).alias("document_id"))
    out = arrivals.join(first, F.col(hash_col).eqNullSafe(F.col("_hash"))).drop("_hash")
    return out.withColumn("status", F.when(F.col(seq) == F.col("document_id"), "new").otherwise("unchanged"))


def detect_versions(arrivals: DataFrame, scheme: str, seq: str, hash_col: str, slice_rows: int = SLICE) -> DataFrame:
    """Each arrival against the scheme's active hash only: NEW_SCHEME, UNCHANGED or NEW_VERSION; and the status of the version it makes.

    An unchanged arrival never changes the active hash, so that is the hash of the arrival before. ``seq``: whole numbers."""
    out = with_running(arrivals, scheme, seq, {"_before": F.struct(F.col(hash_col).alias("hash"))}, size=slice_rows)
    out = out.withColumn("change", F.when(F.col("_before").isNull(), "NEW_SCHEME").when(F.col("_before.hash") == F.col(hash_col), "UNCHANGED").otherwise("NEW_VERSION")).drop("_before")
    newest = out.where("change <> 'UNCHANGED'").groupBy(F.col(scheme).alias("_scheme")).agg(F.max(seq).alias("_newest"))
    out = out.join(newest, F.col(scheme).eqNullSafe(F.col("_scheme")))
    return out.withColumn("version_status", F.when(F.col("change") == "UNCHANGED", F.lit(None).cast("string")).when(F.col(seq) == F.col("_newest"), "ACTIVE").otherwise("ARCHIVED")).drop("_scheme", "_newest")


def needs_review(rules: DataFrame, key: str, force: str | Column | None = None, comparisons: DataFrame | None = None) -> DataFrame:
    """Per update (``key``) whether it has to be reviewed, and why: forced, no rules, a rule marked for review, a rule whose
    evidence doesn't support it, or what its comparison with the version before says. ``rules``: rule, review_required,
    consistency; an update without rules is a row whose rule is null. ``comparisons``: key, review_required, relevance, a row for
    each update at most; one that asks for a review or is of uncertain relevance is a reason. Null marks count as unset."""
    forced = F.lit(False) if force is None else F.coalesce(col(force), F.lit(False))
    given = F.col("rule").isNotNull()
    why = F.array(
        F.when(F.max(forced), "forced"), F.when(F.count_if(given) == 0, "no_rules"), F.when(F.count_if(given & F.coalesce("review_required", F.lit(False))) > 0, "marked"),
        F.when(F.count_if(given & (F.coalesce("consistency", F.lit("SUPPORTED")) != "SUPPORTED")) > 0, "unsupported"),
    )
    out = rules.groupBy(key).agg(F.array_compact(why).alias("reasons"))
    if comparisons is not None:
        doubt = F.when(F.coalesce("review_required", F.lit(False)), "comparison").when(F.col("relevance") == "uncertain", "uncertain")
        said = comparisons.select(F.col(key).alias("_key"), doubt.alias("_why")).where("_why IS NOT NULL")
        out = out.join(said, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("reasons", F.array_compact(F.concat("reasons", F.array("_why")))).drop("_key", "_why")
    return out.withColumn("review", F.size("reasons") > 0)


def version_timeline(arrivals: DataFrame, scheme: str, seq: str, hash_col: str, review: str | Column, slice_rows: int = SLICE) -> DataFrame:
    """The knowledge base's updates. Adds status (ACTIVE, ARCHIVED, REVIEW, already_exists), change_type and old_active.

    A hash seen before for its scheme changes nothing; an arrival to be reviewed leaves the active version; any other one
    replaces it. A null or empty hash is never known before. ``seq``: whole numbers, no two of a scheme alike."""
    df = arrivals.withColumn("_review", F.coalesce(col(review), F.lit(True)))
    known = F.col(hash_col).isNotNull() & (F.col(hash_col) != "")
    df = with_first(df, [scheme, hash_col], seq, "_new").withColumn("_new", ~known | F.col("_new"))
    accepted = F.when(F.col("_new") & ~F.col("_review"), F.col(seq))
    df = with_running(df, scheme, seq, {"old_active": accepted}, {"_last": accepted}, size=slice_rows)
    status = F.when(~F.col("_new"), "already_exists").when(F.col("_review"), "REVIEW").when(F.col(seq) == F.col("_last"), "ACTIVE").otherwise("ARCHIVED")
    change = F.when(~F.col("_new"), F.lit(None).cast("string")).when(F.col("_review"), "REVIEW_REQUIRED").when(F.col("old_active").isNull(), "INITIAL_ACTIVE").otherwise("MODIFIED")
    return df.withColumn("status", status).withColumn("change_type", change).drop("_review", "_new", "_last")


def version_history(timeline: DataFrame, scheme: str, seq: str, slice_rows: int = SLICE) -> DataFrame:
    """Versions of each scheme, with their place in it."""
    return with_running(timeline.where("status <> 'already_exists'"), scheme, seq, {}, number="place", size=slice_rows)


def active_versions(timeline: DataFrame) -> DataFrame:
    return timeline.where("status = 'ACTIVE'")


def update_log(timeline: DataFrame, scheme: str, seq: str) -> DataFrame:
    """A row for each change: scheme, old_version_id, new_version_id, change_type."""
    return timeline.where("change_type IS NOT NULL").select(F.col(scheme).alias("scheme"), F.col("old_active").alias("old_version_id"), F.col(seq).alias("new_version_id"), "change_type")


def schemes(events: DataFrame) -> DataFrame:
    """Schemes from upserts (slug, name, department, seq): the last name, the last department that isn't null, the first seq as id."""
    return events.groupBy("slug").agg(F.min("seq").alias("id"), F.max_by("name", "seq").alias("name"), F.max_by("department", F.when(F.col("department").isNotNull(), F.col("seq"))).alias("department"))


def store_rules(rules: DataFrame, seq: str = "seq") -> DataFrame:
    """One row for each (version_id, rule, type, category); a later one is the earlier one again."""
    key = ["version_id", "rule", "type", "category"]
    rules = rules.withColumn("category", F.coalesce("category", F.lit("other")))
    rest = [c for c in rules.columns if c not in key]
    return rules.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("r")).select(*key, "r.*")


def rules_with_evidence(rules: DataFrame, evidence: DataFrame, rule_id: str, columns: list[str]) -> DataFrame:
    """Rules with their evidence as a sorted array, an empty one where there is none."""
    lists = evidence.groupBy(rule_id).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("evidence"))
    kind = lists.schema["evidence"].dataType
    return rules.join(lists, rule_id, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(kind)))


def contained(needles: DataFrame, texts: DataFrame, keep: list[str], size: int = 3) -> DataFrame:
    """(needle and the columns ``keep`` of the texts) of all pairs of a needle and a text (text and more) that contains it.

    Texts are found by the rarest of the needle's pieces of ``size`` characters, then searched; a needle with a piece that no
    text has meets none. A piece that many texts have is a hot key that Spark may split, as each side is a plain row. Needles
    are distinct rows; null and empty ones are in no text."""
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    # Short needles are pieces themselves.
    all_pieces = F.array_distinct(F.concat(*[pieces(F.col("text"), n) for n in range(1, size + 1)]))
    spelled = texts.where(F.length("text") > 0).select(*keep, "text", F.explode(all_pieces).alias("piece"))
    counts = spelled.groupBy("piece").agg(F.count("*").alias("n"))
    asked = needles.where(F.length("needle") > 0).select("needle", F.explode(F.array_distinct(pieces(F.col("needle"), size))).alias("piece"))
    rarest = asked.join(counts, "piece", "left").groupBy("needle").agg(F.min_by("piece", "n").alias("piece"), F.count_if(F.col("n").isNull()).alias("lost")).where("lost = 0")
    return rarest.select("needle", "piece").join(spelled, "piece").where(F.col("text").contains(F.col("needle"))).select("needle", *keep)


def find_scheme(queries: DataFrame, known: DataFrame, stop: tuple[str, ...] = ("the", "and", "scheme", "yojana", "for"), least: int = 3) -> DataFrame:
    """The scheme that a query (query_id, query) means: its slug, else the first of its tokens that a slug or name contains;
    slugs before names, then the smaller id. ``known``: id, slug, name.

    Each distinct token is looked up once, by its rarest piece, and has one best scheme, so that a word that all schemes have
    costs one pass over them and not one for each query."""
    q = F.lower(F.trim("query"))
    tokens = queries.select("query_id", q.alias("q"), F.posexplode_outer(F.split(q, "[^\\p{L}\\p{N}]+")).alias("pos", "token"))
    tokens = tokens.where((F.length("token") >= least) & ~F.col("token").isin(*stop)).select("query_id", "pos", "token")
    exact = queries.select("query_id", q.alias("q")).join(known, F.col("q") == F.col("slug")).select("query_id", "id", "slug", "name", F.lit(-1).alias("pos"), F.lit(0).alias("weight"))
    spelled = lambda c, weight: known.where(F.col(c).isNotNull()).select(F.lower(c).alias("text"), F.struct(F.lit(weight).alias("weight"), "id", "slug", "name").alias("found"))
    met = contained(tokens.select(F.col("token").alias("needle")).distinct(), spelled("slug", 0).unionAll(spelled("name", 1)), ["found"])
    best = met.groupBy(F.col("needle").alias("token")).agg(F.min("found").alias("f"))
    fuzzy = tokens.join(best, "token").select("query_id", "f.id", "f.slug", "f.name", "pos", "f.weight")
    best = exact.unionByName(fuzzy).groupBy("query_id").agg(F.min(F.struct("pos", "weight", "id", "slug", "name")).alias("b"))
    return best.select("query_id", "b.id", "b.slug", "b.name")


def broken_invariants(versions: DataFrame, scheme: str, hash_col: str) -> DataFrame:
    """Schemes with more than one active version, and (scheme, hash) pairs with more than one version: none, if all is well."""
    active = versions.where("status = 'ACTIVE'").groupBy(scheme).agg(F.count("*").alias("n")).where("n > 1").select(F.col(scheme).cast("string").alias("what"), F.lit("active").alias("broken"), "n")
    again = versions.where(f"status <> 'already_exists' AND {hash_col} IS NOT NULL").groupBy(scheme, hash_col).agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws("/", scheme, hash_col).alias("what"), F.lit("hash").alias("broken"), "n")
    return active.unionByName(again)


def schemes_to_add(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Insert if absent: wanted schemes (slug, name, department, seq) whose slug isn't known; the first of each."""
    rest = [c for c in wanted.columns if c not in ("slug", "seq")]
    first = wanted.groupBy("slug").agg(F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in rest])
    return first.join(known.select("slug"), "slug", "left_anti")


def set_status(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Versions (id, scheme_id, status) after changes (id, status), one for each id at most: ARCHIVED or ACTIVE.

    A version that becomes active archives its scheme's active one. Of several that become so in one scheme the largest id does."""
    change = changes.select("id", F.col("status").alias("_to"))
    out = versions.join(change, "id", "left")
    risen = out.where("_to = 'ACTIVE'").groupBy("scheme_id").agg(F.max("id").alias("_active"))
    out = out.join(risen, "scheme_id", "left")
    status = F.when(F.col("id") == F.col("_active"), "ACTIVE").when(F.col("_active").isNotNull() & ((F.col("status") == "ACTIVE") | (F.col("_to") == "ACTIVE")), "ARCHIVED").when(F.col("_to") == "ARCHIVED", "ARCHIVED").otherwise(F.col("status"))
    return out.withColumn("status", status).select(versions.columns)


def evidence_rows(rules: DataFrame) -> DataFrame:
    """A row of evidence for each rule (id, evidence) that has a page or a text: rule_id, page_number, section, evidence_text,
    source_url, ocr_confidence."""
    e = F.col("evidence")
    out = rules.where(e.isNotNull() & (e["page_number"].isNotNull() | (F.trim(F.coalesce(e["source_text"], F.lit(""))) != "")))
    have = rules.schema["evidence"].dataType.fieldNames()
    pick = lambda name, kind: (e[name] if name in have else F.lit(None)).cast(kind)
    return out.select(F.col("id").alias("rule_id"), pick("page_number", "int").alias("page_number"), pick("section", "string").alias("section"), pick("source_text", "string").alias("evidence_text"), pick("source_url", "string").alias("source_url"), pick("ocr_confidence", "double").alias("ocr_confidence"))


def with_texts(versions: DataFrame, texts: DataFrame) -> DataFrame:
    """Versions with the text extracted from their document (document_id, extracted_text), the last by seq where there is one;
    without a text they keep theirs."""
    order = "seq" if "seq" in texts.columns else "extracted_text"
    new = texts.where("extracted_text IS NOT NULL").groupBy("document_id").agg(F.max_by("extracted_text", order).alias("_text"))
    return versions.join(new, "document_id", "left").withColumn("extracted_text", F.coalesce("_text", "extracted_text")).select(versions.columns)


def current_rules(asked: DataFrame, known: DataFrame, versions: DataFrame, rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """The active rules of the schemes that queries (query_id, query) mean: a row per query with the scheme, its active version
    (null if it has none) and arrays of eligibility_rules and exclusion_rules with their evidence. A query that means no scheme
    has no row.

    ``known``: id, slug, name; ``versions``: id, scheme_id, version_label, status; ``rules``: id, scheme_version_id, rule,
    type, category; ``evidence``: rule_id, page_number, evidence_text, source_url."""
    found = find_scheme(asked, known).select("query_id", F.col("id").alias("scheme_id"), F.col("slug").alias("scheme_key"), F.col("name").alias("scheme_name"))
    active = versions.where("status = 'ACTIVE'").select("scheme_id", F.col("id").alias("version_id"), "version_label")
    full = rules_with_evidence(rules.withColumnRenamed("id", "rule_id"), evidence, "rule_id", ["page_number", "evidence_text", "source_url"])
    rule = F.struct("rule_id", "rule", "category", "evidence")
    lists = full.groupBy(F.col("scheme_version_id").alias("version_id")).agg(*[F.sort_array(F.collect_list(F.when(F.col("type") == t, rule))).alias(f"{t}_rules") for t in ("eligibility", "exclusion")])
    out = found.join(active, "scheme_id", "left").join(lists, "version_id", "left")
    kinds = lists.schema
    return out.withColumns({f"{t}_rules": F.coalesce(f"{t}_rules", F.array().cast(kinds[f"{t}_rules"].dataType)) for t in ("eligibility", "exclusion")})


def versions_with_documents(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Versions (document_hash, source_url and more) beside their document (sha256, id, local_path, source_url): document_id and
    local_path, null where there is none, and the document's source_url before the version's own. Of several documents with one
    hash the last by id counts, so a version stays one row; a null hash has no document."""
    found = documents.groupBy(F.col("sha256").alias("_hash")).agg(F.max_by(F.struct("id", "local_path", "source_url"), "id").alias("_d"))
    out = versions.join(found, F.col("document_hash") == F.col("_hash"), "left")
    return out.withColumns({"document_id": F.col("_d.id"), "local_path": F.col("_d.local_path"), "source_url": F.coalesce("_d.source_url", "source_url")}).drop("_hash", "_d")
