"""A training corpus from raw documents: STAGES, each an operator of policylake.llm, applied one after the other.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. The tables
that a stage keeps in the shared folder are removed when the next one begins, as its result is written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policylake.llm import common, decontamination, line_dedup, ngram_join, packing, quality
from policylake.llm.queries import TOKENIZER

#: The columns that stages work with; others are carried under names that meet no operator's.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_of_stage: set[str] = set()


def _stage(function):
    """Remove what the stage before kept, and remember what this one keeps. Further columns of docs come out as they went in."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.small_batches(spark)
        common.release(spark, _of_stage & common.scratch_paths())
        _of_stage.clear()
        before = common.scratch_paths()
        others = {c: f"_other_{i}" for i, c in enumerate(c for c in docs.columns if c not in COLUMNS)}
        out = function(spark, docs.withColumnsRenamed(others), sf_dir)
        _of_stage.update(common.scratch_paths() - before)
        return out.withColumnsRenamed({v: k for k, v in others.items() if v in out.columns})

    run_stage.__name__, run_stage.__doc__ = function.__name__, function.__doc__
    return run_stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps.

    Null and empty texts weigh least and go first; rows with equal texts share their fate; without good labels all stay."""
    return quality.resample(docs, common.table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


@_stage
def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages, n_chars as they are then; documents of which nothing is left go.

    Null and empty texts stay as they are; of a row given again the first by id keeps its passages."""
    kept = line_dedup.dedup_passages(docs).where("text IS NULL OR text <> '' OR size(removed) = 0")
    return kept.select(*[F.length("text").cast(kept.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, a similarity of 0.8 or more.

    It is the one with the smallest id, a null id last, then with the least hashes of text and row. Documents without words
    are in no group and stay."""
    found = ngram_join.similar_components(docs, size=5, num=80, den=100, node_col="component_node")
    order = Window.partitionBy("component_node").orderBy(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.xxhash64(*docs.columns))
    first = found.where("n_shingles > 0").withColumn("place", F.row_number().over(order)).where("place = 1")
    return first.select(docs.columns).unionAll(found.where("n_shingles = 0").select(docs.columns))


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Null and empty texts hold none and stay; an empty benchmark too
    lets all stay; rows given again stay or go together."""
    return decontamination.contamination(docs, common.table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(docs.columns)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids. A null or empty text is its end id alone; rows given again are packed each;
    columns of docs but doc_id and text are left out."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, function in STAGES:
        path = common.scratch_path(spark, f"stage-{name}")
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            common.release(spark, {last})
        last = path
    return docs


#: Models, tokenizers and graph components are not for SQL: the stages are tested against brute-force versions.
ORACLE_SQL = None
