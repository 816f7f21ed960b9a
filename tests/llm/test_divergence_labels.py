"""Which texts divergence keeps against their labels, by length."""

import pytest
from pyspark.sql import functions as F

from tokiwa.llm import divergence
from tokiwa.llm.common import table

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def judged(spark):
    rows = divergence.judge(table(spark, LARGER, "documents")).where("not base_failed").join(table(spark, LARGER, "labels"), "doc_id")
    band = F.when(F.col("n_words") < 80, 50).when(F.col("n_words") < 120, 80).otherwise(120)
    return {(r["band"], r["quality"]): r["share"] for r in rows.groupBy(band.alias("band"), "quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}


@pytest.mark.parametrize("band", [50, 80, 120])
def test_kept_by_length(judged, band):
    assert judged[band, 0] < 0.2 and judged[band, 1] > 0.98


def test_short_word_soup_goes(spark):
    prose = "the stone is in the river and the water of the house was green with light for a thing that they have on it"
    rows = [(i, " ".join([prose] * 8) + f" {i}", "en") for i in range(40)]
    clean = " ".join(f"{w} {w}x" if i % 2 else w for i, w in enumerate((prose + " and it is as the river was").split() + prose.split()[::-1]))
    soup = " ".join(f"erorea{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    found = {r["doc_id"]: r for r in divergence.judge(spark.createDataFrame([*rows, (100, soup, "en"), (101, clean, "en")], "doc_id long, text string, lang string")).collect()}
    assert not found[100]["base_failed"] and found[100]["n_words"] == 60 and not found[100]["kept"]
    assert 50 <= found[101]["n_words"] < 120 and found[101]["kept"]
