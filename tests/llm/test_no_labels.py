"""Resampling where no model can be fitted."""

from pyspark.sql import functions as F

from policylake.llm import quality


def test_all_are_kept(spark, docs, rows):
    labels = spark.createDataFrame([(0, 0), (2, 0)], "doc_id long, quality int")
    for none in (labels.limit(0), labels, labels.select((F.col("doc_id") + 10**6).alias("doc_id"), F.lit(1).alias("quality"))):
        assert quality.resample(docs, none).where("kept").count() == len(rows)
