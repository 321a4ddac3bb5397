"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

A candidate is a run of key characters with letters and digits in it. The forest sees its length, its character
transitions, how much of it dictionary words cover, the path the text came from and the neighbouring words. It is trained
from labelled findings: those given, or a table made by rule from digests (keys in assignments on one side; checksums,
identifiers, versions, addresses and placeholders on the other).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of key characters, 16 or longer, with a digit and a letter.
CANDIDATE = "(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{16,}"
#: Labelled findings that the rule makes.
FINDINGS = 6_000
TREES, DEPTH, SEED = 30, 7, 11

#: Fixed word lists of the features.
KEY_WORDS = "token|secret|api_?key|apikey|key|password|passwd|pwd|auth|bearer|credential|private"
HARMLESS_WORDS = "sha1|sha256|md5|checksum|digest|commit|hash|etag|uuid|guid|version|revision|integrity|image|base64|href|src|id"
DICTIONARY = "example|sample|test|dummy|changeme|placeholder|your|here|version|release|image|index|article|page|item|user|name|file|data|http|www|com|org|the|and|ing|tion|ment|ent|ver|lich"
#: Frequent pairs of letters; text made of words has many of them, a key has few.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
FEATURES = ["length", "transitions", "pairs", "digits", "capitals", "variety", "hex", "vowels", "covered", "key_before", "harmless_before", "assigned", "quoted", "in_path", "test_path", "dashes"]


def features(df: DataFrame) -> DataFrame:
    """Add the features to rows of candidate, before and after (their neighbours) and path."""
    c, before, after = F.col("candidate"), F.lower(F.coalesce("before", F.lit(""))), F.coalesce("after", F.lit(""))
    n = F.length(c).cast("double")
    share = lambda keep: F.length(F.regexp_replace(c, f"[^{keep}]", "")) / n
    # Kinds of characters; a kind after another is a transition.
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "1"), "[A-Z]", "A"), "[a-z]", "a"), "[^1Aa]", "-")
    runs = F.length(F.regexp_replace(kinds, "(.)\\1*", "$1"))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    near = F.substring(before, -24, 24)
    return df.withColumns(
        {
            "length": n, "transitions": (runs - 1) / n, "pairs": F.regexp_count(F.lower(c), F.lit(f"(?=(?:{'|'.join(PAIRS)}))")) / n, "digits": share("0-9"), "capitals": share("A-Z"),
            "variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40.0)),
            "hex": flag(c.rlike("^[0-9a-fA-F]+$")), "vowels": share("aeiouAEIOU"),
            "covered": (n - F.length(F.regexp_replace(F.lower(c), DICTIONARY, ""))) / n,
            "key_before": flag(near.rlike(f"({KEY_WORDS})[^a-z]{{0,6}}$")), "harmless_before": flag(near.rlike(f"(^|[^a-z])({HARMLESS_WORDS})[^a-z]{{0,6}}$")),
            "assigned": flag(near.rlike("[=:]\\s*[\"']?$")), "quoted": flag(near.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
            "in_path": flag(near.rlike("(/|\\.|://\\S*)$") | after.rlike("^(\\.[a-z]|/)")), "test_path": flag(F.lower(F.coalesce("path", F.lit(""))).rlike("test|example|doc|fixture")),
            "dashes": share("_+/=-"),
        }
    )


def labelled_findings(spark: SparkSession, n: int = FINDINGS, first: int = 0) -> DataFrame:
    """Findings made by rule from numbers ``first`` on: before, candidate, after, path, secret. Deterministic; about half secrets.

    Harmless ones are look-alikes, and also the very keys of the other side: in the paths of tests and guides, and where prose
    speaks of one without assigning or quoting it."""
    i = F.col("id")
    d = F.sha2(i.cast("string"), 256)
    mixed = F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("k"), i.cast("string")), 256))), "=", "")
    pick = lambda *xs, by=7: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (F.pmod(F.floor(i / by), F.lit(len(xs))) + 1).cast("int"))
    word = pick("and of the", "reading this, ", "il est la", "der von ", "que los ", "x | y |", by=3)
    key = pick("token", "secret", "api_key", "password", "auth", "access_key", "client_secret", "private key", by=5)
    sep = pick(' = "', ': "', "=", ": ", " = ", "='", by=11)
    value = pick(F.substring(d, 1, 40), F.substring(d, 1, 32), F.substring(mixed, 1, 40), F.substring(mixed, 1, 24), F.concat(F.lit("AKIA"), F.upper(F.substring(d, 1, 16))), d, by=1)
    own, tests = pick("src/app", "web", "config/prod", by=13), pick("test/data", "docs/guide", "src/fixtures", by=13)
    anywhere = pick("src/app", "docs/guide", "test/data", "web", by=13)
    finding = lambda before, candidate, after, path: F.struct(before.alias("before"), candidate.alias("candidate"), after.alias("after"), path.alias("path"))
    after = pick('" the', '", ', "\n", " next", by=2)
    assigned = F.concat(word, F.lit(" "), key, sep)
    good = finding(assigned, value, F.when(sep.rlike("[\"']$"), F.concat(F.substring(sep, -1, 1), F.lit(" end"))).otherwise(after), own)
    uuid = F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.substring(d, 13, 4), F.substring(d, 17, 4), F.substring(d, 21, 12))
    bad = pick(
        F.struct(F.concat(word, pick(" sha256:", " commit ", " md5 = ", ' integrity="', " etag: ", by=5)).alias("before"), F.substring(d, 1, 40).alias("candidate"), F.lit(" more").alias("after"), anywhere.alias("path")),
        F.struct(F.concat(word, pick(" id=", " uuid: ", ' "', " see ", by=5)).alias("before"), uuid.alias("candidate"), F.lit('" and').alias("after"), anywhere.alias("path")),
        F.struct(F.concat(word, F.lit(" https://site.example/a/")).alias("before"), F.concat(F.lit("article-about-the-item-"), F.substring(F.conv(F.substring(d, 1, 6), 16, 10), 1, 4)).alias("candidate"), F.lit(".html").alias("after"), anywhere.alias("path")),
        F.struct(F.concat(word, F.lit(" "), key, sep).alias("before"), F.concat(pick("your_token_here_", "example-key-sample-", "xxxxxxxxxxxxxxxx", "changeme_changeme_", "test-secret-test-", "placeholder_name_", "dummy-password-", by=1), pick("", "value_", "data-", "item_", by=2), F.substring(F.conv(F.substring(d, 1, 8), 16, 10), 1, 4)).alias("candidate"), F.lit('"').alias("after"), anywhere.alias("path")),
        F.struct(F.concat(word, F.lit(" data:image/png;base64,")).alias("before"), F.concat(mixed, mixed, F.lit("A1")).alias("candidate"), F.lit('" alt').alias("after"), anywhere.alias("path")),
        F.struct(word.alias("before"), F.concat(pick("thtionndoner", "gebeverlichung", "ciónmenteque", "version_release_"), pick("eranthnd", "keitschen", "mentelle", "index_page_"), F.substring(F.conv(F.substring(d, 1, 8), 16, 10), 1, 5)).alias("candidate"), F.lit(", and").alias("after"), anywhere.alias("path")),
        finding(assigned, value, after, tests),
        finding(F.concat(word, F.lit(" the "), key, F.lit(" ")), value, F.lit(" was rotated"), anywhere),
        by=1,
    )
    secret = F.pmod(F.xxhash64(i), F.lit(2)) == 0
    return spark.range(first, first + n).select(F.when(secret, good).otherwise(bad).alias("f"), secret.cast("int").alias("secret")).select("f.*", "secret")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    """A forest from labelled findings (before, candidate, after, path, secret); rows without candidate or label are passed over."""
    rows = features(findings.where("candidate IS NOT NULL AND secret IS NOT NULL AND candidate <> ''"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(featuresCol="features", labelCol="secret", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def candidates(docs: DataFrame, text_col: str = "text", path_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``keep`` columns, start (characters before it), candidate, before, after and path for each candidate, in any number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    base = docs.select(*keep, path.alias("path"), F.monotonically_increasing_id().alias("row"), text.alias("t"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"))
    base = base.withColumn("between", F.when(F.size("found") > 0, F.split("t", CANDIDATE, -1)))
    parts = F.transform("found", lambda c, i: F.struct(c.alias("candidate"), F.length(F.get("between", i)).alias("gap"), F.substring(F.get("between", i), -48, 48).alias("before"), F.substring(F.get("between", i + 1), 1, 24).alias("after")))
    # The outer form: a plain explode would add a filter that searches each text again.
    each = base.withColumn("parts", parts).select(*keep, "path", "row", F.posexplode_outer("parts").alias("i", "p")).where("p IS NOT NULL").select(*keep, "path", "row", "i", "p.*")
    past = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("candidate")).over(past)
    return each.select(*keep, (end - F.length("candidate")).cast("long").alias("start"), "candidate", "before", "after", "path")


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """A row per candidate of ``docs``: id, start, candidate, before, after, path, score (the forest's share for a secret) and secret.

    Null and empty texts have no candidates. Null ids and null paths are kept. Rows given again give their findings again.
    Very long texts are searched whole. An empty table gives no rows. Other columns are ignored.
    """
    found = features(candidates(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *([F.col(path_col).alias("_path")] if path_col else [])), "_text", "_path" if path_col else None, ("_id",)))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(F.col("_id").alias(id_col), "start", "candidate", "before", "after", "path", "score", (F.col("score") >= threshold).alias("secret"))
