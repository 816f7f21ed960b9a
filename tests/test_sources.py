"""Readers, writers, SQL functions and the stream."""

import pytest

from tokiwa.operators import analyze, lattice
from tokiwa.sources import readers, writers
from tokiwa.streaming import counts


def test_user_dictionary(spark, tmp_path):
    (tmp_path / "u.csv").write_text('# names\n\n東京,NOUN,100,とうきょう\n"a,""b""",Noun\n走る\tVERB\t走る\nonly\n')
    rows = {r["surface"]: r for r in readers.user_dictionary(spark, str(tmp_path / "u.csv")).collect()}
    assert rows["東京"]["lemma"] == "とうきょう" and rows['a,"b"']["pos"] == "NOUN" and rows["走る"]["lemma"] == "走る" and len(rows) == 3


@pytest.mark.parametrize("bad", ["東京,CITY\n", ",NOUN\n", '"x,NOUN\n'])
def test_bad_dictionaries_fail_whole(spark, tmp_path, bad):
    (tmp_path / "u.csv").write_text("良い,ADJ\n" + bad)
    with pytest.raises(readers.DictionaryError):
        readers.user_dictionary(spark, str(tmp_path / "u.csv")).collect()


def test_dictionary_tsv_and_parquet(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("# c\n書く\tVERB\tGODAN_KA\r\n本\tNOUN\n")
    df = readers.dictionary_tsv(spark, str(tmp_path / "d.tsv"))
    assert [(r["surface"], r["pos"], r["conj_type"]) for r in df.orderBy("line").collect()] == [("書く", "VERB", "GODAN_KA"), ("本", "NOUN", "")]
    writers.write_dictionary(df, str(tmp_path / "d.parquet"))
    assert len(analyze.dictionary_entries(spark.read.parquet(str(tmp_path / "d.parquet")))) == 2


def test_whole_texts_and_golden(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo\n")
    assert [r["text"] for r in readers.whole_texts(spark, str(tmp_path / "t")).collect()] == ["one\ntwo"]
    (tmp_path / "g.json").write_text('{"version":"1","cases":[{"id":"x","input":"本","expected":[{"surface":"本","pos":"Noun","lemma":"本"}],"tags":[]}]}')
    assert [tuple(r) for r in readers.golden_cases(spark, str(tmp_path / "g.json")).collect()] == [("x", "本", 0, "本", "NOUN", "本")]


def test_invalid_utf8_is_null(spark):
    df = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff"),)], "data binary")
    assert [r["text"] for r in readers.valid_texts(df).collect()] == ["ok", None]


def test_sql_functions(spark):
    analyze.register(spark, [lattice.Entry("は", "PARTICLE")])
    assert [r["surface"] for r in spark.sql("select m.surface from (select explode(analyze('私は')) as m)").collect()] == ["私", "は"]
    assert [r["surface"] for r in spark.sql("select t.surface from values ('abc de') v(x), lateral tokenize(x) t order by token_index").collect()] == ["abc", "de"]
    assert spark.sql("select analyze(cast(null as string)) as m").first()["m"] is None


def test_stream_counts_as_the_table(spark, tmp_path):
    source = spark.createDataFrame([("2024-01-01 00:01:00", "a b a"), ("2024-01-01 00:12:00", "a")], "t string, text string").selectExpr("cast(t as timestamp) as ts", "text")
    source.write.parquet(str(tmp_path / "in"))
    stream = counts.token_counts(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, counts.token_counts(source).collect()))
