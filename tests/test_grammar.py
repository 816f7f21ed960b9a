"""Conjugation, inflection, dictionaries, the analyzer's words and its engine, in plain Python where Spark has no part."""

import time

import pytest
from pyspark.sql import functions as F

from tokiwa.functions import pretokens
from tokiwa.grammar import candidates, categories, conjugation, inflection, words
from tokiwa.operators import analyze, dictionary, lattice, tokens
from tokiwa.plans import golden, samples
from tokiwa.sources import readers, writers


def surfaces(text, **options):
    return [m.surface for m in lattice.Analyzer(options=lattice.Options(**options)).analyze(text)]


@pytest.mark.parametrize("line", samples.GOLDEN.strip().splitlines())
def test_golden(line):
    text, expected = line.split(" = ")
    assert " ".join(f"{m.surface}/{m.pos}" for m in lattice.Analyzer().analyze(text)) == expected


def test_built_in_words_are_categorised():
    rows = words.built_in()
    assert all(name in categories.COST and (pos == categories.POS_OF[name] or name == "UNKNOWN") for _, pos, name, _ in rows)
    assert len(categories.COST) == 67 and sum(categories.POS_OF[n] == "AUX" for n in categories.COST) == 22
    assert all(a in categories.COST and b in categories.COST for a, b in categories.links())


def test_forms_lead_back_to_their_verbs():
    """Each form of a verb whose type its ending shows is among the readings of that form."""
    for base in ("書く", "泳ぐ", "話す", "立つ", "遊ぶ", "読む", "走る", "買う", "食べる", "勉強する", "高い"):
        kind = conjugation.detect_type(base)
        for suffix in conjugation.suffixes(kind)[1:]:
            form = conjugation.stem(base, kind) + suffix
            if len(form) > 2 and suffix != "できる":  # a verb of its own
                assert base in {r.base for r in inflection.inflect(form)}, form


def test_confidence_is_in_bounds_and_short_surfaces_have_none():
    assert inflection.inflect("あ") == () and inflection.inflect("") == ()
    for line in samples.INFLECTED.strip().splitlines():
        found = [r.confidence for r in inflection.inflect(line.split()[0])]
        assert found and found == sorted(found, reverse=True) and all(0.3 <= c <= 0.95 for c in found)


def test_options():
    assert surfaces("田中さん。", remove_symbols=False) == ["田中", "さん", "。"]
    assert surfaces("a 田中さん", least_bytes=4) == ["田中", "さん"]
    assert surfaces("東京都庁前駅で", mode="search") == ["東京都庁前駅", "で"]
    assert [m.conj_form for m in lattice.Analyzer(options=lattice.Options(lemmatize=False)).analyze("書いた")] == [None, None]
    assert not any(m.is_dictionary for m in lattice.Analyzer(options=lattice.Options(built_in=False)).analyze("私は本です"))


@pytest.mark.parametrize("bad", [("", "NOUN", ""), ("x", "CITY", ""), ("x", "UNKNOWN", ""), ("x", "NOUN", "NOUN_無")])
def test_bad_entries_are_refused(bad):
    with pytest.raises(ValueError):
        lattice.Entry(bad[0], bad[1], extended_pos=bad[2])


def test_every_text_has_a_path():
    engine = lattice.Analyzer()
    for text in ("ゃゅょ", "々", "っっっ", "ーー", "𠮷野家", "ﾞ", "漢字かなカナabc123!?。😀é", "んんん"):
        assert engine.valid(engine.edges(text)) and "".join(e.surface for e in engine.path(text)) == text


def test_candidates_stay_in_the_text():
    text = "書かなかった新しい本を読みながら静かな町でバズった"
    for at in range(len(text)):
        kind = "KANJI" if candidates.KANJI.match(text[at]) else "KATAKANA" if "ァ" <= text[at] <= "ー" else "HIRAGANA"
        for c in candidates.candidates(text, at, kind, lambda w: False):
            assert at < c.end <= len(text) and c.category in categories.COST and c.lemma


def test_user_words_win(spark):
    entries = [lattice.Entry("東京スカイツリー", "NOUN", user=True)]
    assert [(m.surface, m.is_user_dict) for m in lattice.Analyzer(entries).analyze("東京スカイツリーへ")] == [("東京スカイツリー", True), ("へ", False)]


def test_dictionaries_are_sent_only_if_small(spark):
    df = spark.createDataFrame([("本", "NOUN"), ("木", "NOUN")], "surface string, pos string")
    assert len(analyze.dictionary_entries(df)) == 2
    for limits in ({"most": 1}, {"most_bytes": 5}):
        with pytest.raises(ValueError):
            analyze.dictionary_entries(df, **limits)


def test_latin_rows_stay_in_the_jvm_with_a_japanese_dictionary(spark):
    df = spark.createDataFrame([(1, "the stone"), (2, "推しの本"), (3, None), (4, "")], "doc_id int, text string")
    found = {r["doc_id"]: r["morphemes"] and [m["surface"] for m in r["morphemes"]] for r in analyze.arrays(df, [lattice.Entry("推し", "NOUN")]).collect()}
    assert found == {1: ["the", "stone"], 2: ["推し", "の", "本"], 3: None, 4: []}
    with_latin = {r["doc_id"]: r["morphemes"] and [m["surface"] for m in r["morphemes"]] for r in analyze.arrays(df, [lattice.Entry("the stone", "NOUN", user=True)]).collect()}
    assert with_latin[1] == ["the stone"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert analyze.morphemes(none).collect() == [] and none.select(pretokens.pretokens(F.col("text"))).collect() == []
    assert none.select(analyze.analyzer()("text")).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r[0] for r in nulls.select(analyze.analyzer()("text")).collect()] == [None, []] and [r[0] for r in nulls.select(pretokens.pretokens(F.col("text"))).collect()] == [None, []]


def test_compiled_surfaces_are_unique(spark):
    rows = [(0, "書く", "VERB", ""), (1, "書き", "NOUN", ""), (2, "書き", "NOUN", ""), (3, "高い", "ADJ", "I_ADJ"), (4, "くる", "VERB", "KURU"), (5, "描く", "VERB", "GODAN_KA")]
    found = {r["surface"]: r for r in dictionary.compiled(spark.createDataFrame(rows, "line int, surface string, pos string, conj_type string")).collect()}
    assert found["書き"]["pos"] == "NOUN" and found["書い"]["extended_pos"] == "VERB_音便" and found["高かっ"]["lemma"] == "高い" and "くこ" in found
    longer = [(0, "ない", "ADJ", "NA_ADJ"), (1, "なくない", "ADJ", "I_ADJ"), (2, "な", "VERB", "")]
    assert len(dictionary.compiled(spark.createDataFrame(longer, "line int, surface string, pos string, conj_type string")).collect()) > 5


def test_several_files_with_a_repeat_fail(spark):
    one = spark.createDataFrame([(1, "東京", "NOUN", "")], "line int, surface string, pos string, conj_type string")
    with pytest.raises(ValueError, match="dictionary 2"):
        dictionary.compiled_files(one, one)


@pytest.mark.parametrize(("surface", "is_trivial"), [("経済成長", True), ("テスト", True), ("ありがとう", True), ("東京", False), ("二次エロ", False), ("東京 都", False), ("", False), ("ABC", True), ("ABC123", False), ("!!!", True)])
def test_trivial(spark, surface, is_trivial):
    assert spark.createDataFrame([(surface,)], "s string").select(dictionary.trivial(F.col("s"))).first()[0] is is_trivial


def test_all_names_of_dictionaries(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("速い\tADJECTIVE\tI_ADJ\nとても\tADVERB\n彼\tPRONOUN\nある\tADNOMINAL\n。\tSYM\n優木\tPROPN\tFAMILY\nなるほど\tPHRASE\n")
    found = readers.dictionary_tsv(spark, str(tmp_path / "d.tsv"))
    assert {r["surface"]: r["pos"] for r in found.collect()} == {"速い": "ADJ", "とても": "ADV", "彼": "PRON", "ある": "DET", "。": "SYMBOL", "優木": "NOUN", "なるほど": "OTHER"}
    entries = analyze.dictionary_entries(dictionary.compiled(found))
    assert [m.surface for m in lattice.Analyzer(entries).analyze("優木は速かった")] == ["優木", "は", "速かっ", "た"]
    writers.write_dictionary_tsv(found, str(tmp_path / "out"))
    again = readers.dictionary_rows(spark.read.text(str(tmp_path / "out")).withColumn("line", F.monotonically_increasing_id().cast("int")))
    assert sorted(r["surface"] for r in again.collect()) == sorted(r["surface"] for r in found.collect())


def test_golden_file_and_report(spark, tmp_path):
    (tmp_path / "sample.json").write_text(samples.GOLDEN_JSON)
    cases = golden.compared(readers.golden_table(spark, str(tmp_path / "sample.json")))
    assert golden.report(cases).first().asDict() == {"file": "sample.json", "n": 6, "surfaces": 3, "pos": 2, "lemmas": 2}
    assert {r["id"] for r in golden.with_tag(cases, "verb").collect()} == {"a1"}


def test_scorer_configuration():
    assert readers.scorer_options('{"bigram": {"verb_to_verb": 2}}').connection == {("VERB", "VERB"): 2.0}
    for bad in ('{"colour": {}}', '{"bigram": {"noun_to_moon": 1}}'):
        with pytest.raises(ValueError):
            readers.scorer_options(bad)
    with pytest.raises(ValueError):
        analyze.from_options({"colour": 1})


def seconds(df):
    df.collect()
    began = time.time()
    df.collect()
    return time.time() - began


@pytest.mark.parametrize(
    ("name", "column"),
    [("pretokens", lambda t: F.size(pretokens.pretokens(t))), ("matches", lambda t: F.size(pretokens.matches(t)))],
)
def test_time_grows_with_the_length(spark, name, column):
    """A text ten times as long takes not over twelve times as long, but for what any run takes."""
    run = lambda n: seconds(spark.createDataFrame([("a1.b2 x " * n,)], "text string").select(column(F.col("text"))))
    assert run(40_000) < 12 * run(4_000) + 1


def test_the_closed_form_is_judged_fast(spark):
    """A text of a megabyte without the end of a sentence."""
    df = spark.createDataFrame([("some words of a text. " * 50_000,)], "text string").select(tokens.closed_form(F.col("text")))
    assert df.first()[0] is False and seconds(df) < 3


def test_prefix_matches_of_a_long_text(spark):
    entries = spark.createDataFrame([("stone", "NOUN", 1), ("to", "PARTICLE", 1)], "surface string, pos string, layer int")
    docs = spark.createDataFrame([(1, "a stone to " * 2000), (2, None), (3, "")], "doc_id int, text string")
    found = dictionary.prefix_matches(docs, entries, 6).groupBy("surface").count().collect()
    assert {r["surface"]: r["count"] for r in found} == {"stone": 2000, "to": 4000}
