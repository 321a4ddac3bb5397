"""The pipeline's stages on a small corpus with nulls, copies and a benchmark, stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from policylake.llm import decontamination, queries
from tests.llm import brute


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{root}/documents.parquet")
    ids = [i for i, t in rows if i is not None and t]
    bad = [(5000 + i, "LOUD!! NOISE!! HERE!! " * 6, None, None, None) for i in range(12)]
    spark.createDataFrame(bad, docs.schema).write.mode("append").parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in ids[::2]] + [(5000 + i, 0) for i in range(0, 12, 2)], "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, dict(rows)[7])], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id, r.text) for r in docs.collect()} if name != "packing" else None
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert after.agg(F.sum("length")).first()[0] > 0 and {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect()}
            break
        assert after.columns == columns
        seen[name] = {(r.doc_id, r.text) for r in after.collect()}
        ids = {i for i, _ in seen[name]}
        assert ids <= {i for i, _ in before}
        if name == "quality_classifier":
            assert not any(i and i >= 5000 for i in ids) and set(range(40)) <= ids
        if name == "near_duplicates":
            rows = sorted(before, key=str)
            want = brute.jaccard_components(rows, 5, 80, 100)
            assert seen[name] == {r for k, r in enumerate(rows) if r[0] is None or want[k][0] == 0 or want[k][1] == r[0]}
        if name == "decontamination":
            found = decontamination.contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").collect()
            assert 7 in {r.doc_id for r in found} and seen[name] == before - {(r.doc_id, r.text) for r in found}
        docs = after


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "start", "length", "ids", "sequence_id", "offset"}
    assert 3 < len(corpus_pipeline.STAGES) < 6


def test_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline_of_nothing(spark, docs, tmp_path):
    root = str(tmp_path / "none")
    docs.limit(0).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0


def test_stages_with_clashing_columns(spark, folder, tmp_path):
    """Extra columns that have the names of inner ones stay as they are, and labels may name an id again."""
    names = ["n", "c", "k1", "k2", "s", "node", "row", "place", "component_id", "n_shingles", "id", "block", "bits", "hot_c", "cold_c", "by", "kept", "removed", "contaminated", "items", "lines", "hash", "_label", "bucket"]
    root = str(tmp_path / "sf")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.select("*", *[F.concat_ws("|", F.lit(c), "doc_id").alias(c) for c in names])
    docs.write.parquet(f"{root}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    labels.unionAll(labels.limit(5)).write.parquet(f"{root}/labels.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{root}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, root).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[5:] == names
        for r in docs.collect():
            assert all(r[c] == c + ("" if r.doc_id is None else f"|{r.doc_id}") for c in names)
    assert docs.count() > 20
    assert corpus_pipeline.STAGES[-1][1](spark, docs, root).count() > 0
