"""Readers and writers of files."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, file_size, file_hash and whether the content begins as a PDF does."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_hash"), (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))


def structured_documents(spark: SparkSession, path: str) -> DataFrame:
    """Pages of structured documents in JSON: path, filename, page_number, page_type, avg_confidence and text, which falls
    back to the blocks' texts. A file that isn't JSON is an error; a folder may have any name."""
    if not path.rstrip("/*").endswith((".json", "/")) and "." in path.rsplit("/", 1)[-1]:
        fs, target = _fs(spark, path)
        if not (fs.exists(target) and fs.getFileStatus(target).isDirectory()):
            raise ValueError(f"not a structured document: {path}")
    schema = f"document struct<filename:string,source_url:string,total_pages:int>, sha256 string, pages array<{schemas.STRUCTURED_PAGE}>"
    docs = spark.read.schema(schema).json(path, multiLine=True).withColumn("path", F.input_file_name())
    pages = docs.select("path", F.col("document.filename").alias("filename"), F.explode_outer("pages").alias("p")).where("p IS NOT NULL")
    blocks = F.array_join(F.transform("p.blocks", lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    return pages.select("path", "filename", "p.page_number", "p.page_type", "p.avg_confidence", F.coalesce(F.nullif("p.full_text", F.lit("")), blocks, F.lit("")).alias("text"))


def rule_files(spark: SparkSession, path: str, glob: str = "*_rules.json") -> DataFrame:
    """Rules of extraction files, a row each: path, scheme_name, list (eligibility or exclusion), seq and the rule's fields."""
    schema = f"scheme_name string, eligibility_rules array<{schemas.RULE}>, exclusion_rules array<{schemas.RULE}>"
    docs = spark.read.schema(schema).option("pathGlobFilter", glob).json(path, multiLine=True).withColumn("path", F.input_file_name())
    part = lambda name: docs.select("path", "scheme_name", F.lit(name).alias("list"), F.posexplode_outer(f"{name}_rules").alias("seq", "r")).where("r IS NOT NULL").select("path", "scheme_name", "list", "seq", "r.*")
    return part("eligibility").unionByName(part("exclusion"))


def local_fallback(failed: DataFrame, files: DataFrame) -> DataFrame:
    """Failed downloads (url, file_name) with the first file kept before under a name that ends like theirs, or null."""
    kept = files.select(F.col("path").alias("file_path"), F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "^[^_]*_", "").alias("file_name"))
    return failed.join(kept, "file_name", "left").groupBy("url", "file_name").agg(F.min("file_path").alias("file_path"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


class Conflict(Exception):
    """Another writer has published since the state that a snapshot was made from."""


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _fs(spark, f"{root}/versions")
    if not fs.exists(folder):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit())


def version(spark: SparkSession, root: str) -> int:
    """The number of the last published snapshot, 0 before the first."""
    return max(_versions(spark, root), default=0)


def publish(df: DataFrame, root: str, note: str = "", base: int | None = None, counts: dict[str, Column] | None = None, valid: Callable[[dict], bool] | None = None) -> int:
    """Write a snapshot and name it by the next number, whose file is made only if it isn't there: readers see all of a
    snapshot or none of it, at any time, and of two writers on one state the second gets a Conflict. Returns the number.

    ``base``: the number that the snapshot was made from, if another one since then is a conflict; without it the next free number
    is taken. ``counts``: aggregates that the writing pass gathers; ``valid`` refuses by them, and then nothing is named. They are
    kept with the note."""
    spark = df.sparkSession
    name = f"snapshot-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    seen = Observation(name)
    whole = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in (counts or {}).items()])
    whole.write.parquet(f"{root}/{name}")
    found = seen.get
    if valid is not None and not valid(found):
        raise ValueError(f"the snapshot isn't published: {found}")
    taken = version(spark, root)
    if base is not None and taken != base:
        raise Conflict(f"{taken} has been published since {base}")
    content = bytearray(json.dumps({"snapshot": name, "note": note, "found": found}, default=str).encode())
    while True:
        taken += 1
        try:
            _create(spark, f"{root}/versions", str(taken), content)
            return taken
        except FileExistsError:
            if base is not None:
                raise Conflict(f"{taken} was published by another writer") from None


def _create(spark: SparkSession, folder: str, name: str, content: bytearray) -> None:
    """A file with ``content``, made whole under its name or not at all; FileExistsError where it is there."""
    fs, target = _fs(spark, f"{folder}/{name}")
    _, made = _fs(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    fs.mkdirs(made.getParent())
    out = fs.create(made, False)
    out.write(content)
    out.close()
    try:  # without the overwriting option a rename fails where the target is there
        context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(fs.makeQualified(made), fs.makeQualified(target), none)
    except Py4JJavaError as e:
        fs.delete(made, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise FileExistsError(f"{folder}/{name}") from None
        raise


def published(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """snapshot, note and found of a published number, the last if none is given."""
    number = number or version(spark, root)
    if not number:
        raise FileNotFoundError(f"nothing is published in {root}")
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/versions/{number}").collect()))  # one small file


def current(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The snapshot of a published number, the last if none is given."""
    return spark.read.parquet(f"{root}/{published(spark, root, number)['snapshot']}")
