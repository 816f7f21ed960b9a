"""The labelled sample is as large as it was before its rows were built in slices."""

from pyspark.sql import functions as F

from tokiwa.llm import toxicity


def test_sample_takes_six_thousand_rows(spark):
    labels = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 9 == 0).cast("int").alias("toxic"))
    texts, toxic = toxicity.sample(labels.select("doc_id", F.lit("stone water").alias("text")), labels, toxicity.Settings())
    assert 5700 < len(texts) == len(toxic) <= 6000 and 500 < sum(toxic) < 850


def test_sample_is_bounded_in_bytes(spark):
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 9 == 0).cast("int").alias("toxic"))
    docs = labels.select("doc_id", F.repeat(F.lit("stone water "), 100).alias("text"))
    texts, _ = toxicity.sample(docs, labels, toxicity.Settings(most_bytes=600_000))
    assert 350 < len(texts) < 650
    assert toxicity.sample(docs, labels, toxicity.Settings(longest=1_000))[0] == []
