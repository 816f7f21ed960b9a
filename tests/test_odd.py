"""The engine's queries over tables on nulls, empty and very long texts, repeated rows, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

from tokiwa.plans import registry

LONG = "the stone of 3.5 rivers, mail x@y.org! " * 3000
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (None, "no id at 50%"), (None, None), (4, "same words here"), (4, "same words here"), (5, LONG), (6, "私は本を読んだ"), (7, "é ñ 😀 ﾞ"), (-8, "negative id v1.2.3")]
TABLES = {
    "documents": ("doc_id", "text"), "benchmark": ("item_id", "text"), "pages": ("page_id", "html"),
}


def written(spark, folder, rows):
    for name, (key, column) in TABLES.items():
        df = spark.createDataFrame(rows, f"{key} long, {column} string")
        for clash in ("surface", "morphemes", "tag", "tags", "start", "m", "_text", "_closed", "token_index", "pos"):
            df = df.withColumn(clash, F.lit("clash"))
        df.write.parquet(f"{folder}/{name}.parquet")
    spark.createDataFrame([(i, 0, "user", t) for i, t in rows], "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(t,) for _, t in rows], "p_name string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([("2024-01-01 00:00:00" if i else None, t) for i, t in rows], "t string, event_type string").select(F.col("t").cast("timestamp").alias("ts"), "event_type").write.parquet(f"{folder}/events.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("odd"))
    written(spark, out, TEXTS)
    return out


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    written(spark, out, [])
    return out


#: How many rows each query gives on the odd tables; those not named give a row for each row of documents.
PER_DOCUMENT = ("normalize_width", "char_type_profile", "char_type_runs", "utf8_offsets", "pretoken_tiles", "sentence_boundaries")


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_odd_tables(spark, odd, name):
    rows = registry.QUERIES[name](spark, odd).collect()
    if name in PER_DOCUMENT:
        assert sorted((r["doc_id"] for r in rows), key=repr) == sorted((i for i, _ in TEXTS), key=repr)
        assert all(r[1] is None for r in rows if r["doc_id"] == 1)
        twice = [tuple(r) for r in rows if r["doc_id"] == 4]
        assert len(twice) == 2 and twice[0] == twice[1]


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    rows = registry.QUERIES[name](spark, empty).collect()
    assert rows == [] or name in ("dict_stats", "dict_dups", "dict_import")  # those that read no table


def test_what_odd_rows_give(spark, odd):
    found = {(r["doc_id"], r["tag"]): r["tf"] for r in registry.postings_tf(spark, odd).collect()}
    assert found[4, "same"] == 2 and found[None, "no"] == 1 and found[None, "50%"] == 1 and found[6, "読ん"] == 1 and found[5, "x@y.org"] == 3000
    tags = [(r["tag"], r["tag_rank"]) for r in registry.tags_noun_min2_dedup(spark, odd).where("doc_id = 5").collect()]
    assert tags == [("the", 1), ("stone", 2), ("of", 3), ("3.5", 4), ("rivers", 5), ("mail", 6), ("x@y.org", 7)]
    assert registry.latin_tokens(spark, odd).where("doc_id in (1, 2, 3)").collect() == []
