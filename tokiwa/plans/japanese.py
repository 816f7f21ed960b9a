"""Queries on samples of Japanese, dictionaries, conjugation and the analyzer's options; see `tokiwa.plans.samples`.

The driver's tables have no Japanese text, so these run over fixed samples. Their SQL is computed where SQL can compute it;
otherwise it is a list of what is expected (a golden check).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokiwa.functions import kana, names, pretokens, text
from tokiwa.grammar import categories, words
from tokiwa.operators import analyze, conjugation, dictionary, lattice, rewrites, tokens
from tokiwa.plans import golden, samples
from tokiwa.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Samples of kana and of words for the predicates.
KANA = ("ｶﾞｷﾞｸﾞ ﾊﾟﾋﾟﾌﾟ", "ｳﾞｧｲｵﾘﾝ", "ヴァイオリンとヴェール", "ＡＢＣ１２３ｘｙｚ", "ﾜﾞ ﾜｰﾙﾄﾞ", "ゔぁいおりん ゔ", "ｱﾞ ﾟ ﾞ", "カﾞキﾞハﾟ", "ヴ ヴヮ", "plain text")
WORDS = ("人", "し", "が", "終わる", "すぎる", "つづけた", "から", "でした", "物", "今日", "書く", "カタカナ", "漢字", "ひらがな", "々", "食べ", "テスト用", "abc", "")
JAPANESE = ("私は東京の学生です。", "API開発を3時間", "図書館で本を読む", "新宿駅の前", "カフェでコーヒーーを飲む", "3億5000万円", "数ヶ月", "２０２４年12月23日")
SEGMENTED = (("東京スカイツリーに行く", 1), ("推しがググる", 2), ("東京都に住む", 3))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rows(spark: SparkSession, values: tuple, name: str = "text") -> DataFrame:
    """(sample_id, name): samples in their order."""
    return spark.createDataFrame(list(enumerate(values)), f"sample_id int, {name} string")


def code_points(spark: SparkSession, *ranges: tuple[int, int]) -> DataFrame:
    """(cp, c): every code point of some ranges, both ends included."""
    return spark.createDataFrame([(i, chr(i)) for a, b in ranges for i in range(a, b + 1)], "cp int, c string")


# characters


@query
def normalize_kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, KANA).select("sample_id", text.normalize(F.col("text")).alias("normal"), text.normalize(F.col("text"), preserve_vu=False).alias("without_vu"))


@query
def normalize_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ASCII, full-width and half-width character by itself."""
    return code_points(spark, (0x20, 0x7E), (0xFF01, 0xFF9F)).select("cp", kana.normalize_char(F.col("c")).alias("normal"))


@query
def kana_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, vowels and particle-like kana of the hiragana block."""
    c = F.col("c")
    found = code_points(spark, (0x3041, 0x3096))
    return found.select(
        "cp", *[kana.in_row(c, v).alias(f"row_{n}") for n, v in zip("aiueo", kana.ROWS, strict=True)], kana.vowel(c).alias("vowel"), kana.among(c, kana.COMMON_PARTICLES).alias("common_particle"),
        kana.among(c, kana.EXTENDED_PARTICLES).alias("extended_particle"), kana.among(c, kana.NEVER_VERB_AFTER_KANJI).alias("never_verb"), kana.among(c, kana.NEVER_VERB_FIRST).alias("never_first"),
        kana.among(c, kana.NEVER_ADJECTIVE_AFTER_KANJI).alias("never_adjective"), kana.among(c, kana.SMALL_KANA).alias("small"),
    )


@query
def char_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emoji modifiers, regional indicators, iteration and prolonged marks, kanji and counters."""
    c = F.col("c")
    found = code_points(spark, (0x2FDE, 0x3010), (0x30F8, 0x30FF), (0x4DBE, 0x4E10), (0x5186, 0x5186), (0x9FFE, 0xA001), (0x200C, 0x200E), (0x20E2, 0x20E4), (0xFE0D, 0xFE10), (0x1F1E5, 0x1F200), (0x1F3FA, 0x1F400), (0xE001F, 0xE0021), (0x2A6DE, 0x2A6E1))
    return found.select("cp", kana.is_emoji_modifier(c).alias("emoji_modifier"), kana.is_regional_indicator(c).alias("regional"), kana.is_iteration_mark(c).alias("iteration"), kana.is_prolonged_mark(c).alias("prolonged"), kana.is_kanji(c).alias("kanji"))


@query
def counter_kanji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kanji that count, of all in the commonest block."""
    return code_points(spark, (0x4E00, 0x9FFF)).where(kana.is_counter(F.col("c"))).select("c")


@query
def can_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of every two classes may stand in one run."""
    classes = spark.createDataFrame([(n,) for n in (*text.CLASS_RANGES, text.OTHER_CLASS)], "a string")
    both = classes.withColumn("b", F.explode(F.array(*[F.lit(n) for n in (*text.CLASS_RANGES, text.OTHER_CLASS)])))
    return both.select("a", "b", kana.can_combine(F.col("a"), F.col("b")).alias("can_combine"))


@query
def word_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts, stem endings and closed classes of words."""
    w = F.col("text")
    ends = [kana.ends_in_row(w, r).alias(f"ends_{n}") for r, n in (("あ", "a"), ("い", "i"), ("え", "e"), ("onbin", "onbin"))]
    return rows(spark, WORDS).select("text", kana.script_of(w).alias("s"), kana.word_class(w).alias("k"), *ends, kana.is_demonstrative(w).alias("demonstrative")).select("text", "s.*", "k.*", "ends_a", "ends_i", "ends_e", "ends_onbin", "demonstrative")


@query
def demonstratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct first two letters of hiragana that begin as demonstratives do."""
    found = code_points(spark, (0x3041, 0x3093)).select(F.col("c").alias("a")).withColumn("b", F.explode(F.array(*[F.lit(chr(i)) for i in range(0x3041, 0x3094)])))
    return found.select(F.concat("a", "b").alias("text")).where(kana.is_demonstrative(F.col("text")))


@query
def utf8_offset_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where characters begin in bytes: how many offsets a benchmark text has, their sum and the last."""
    found = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", kana.byte_offsets(F.concat(F.lit("あé"), F.col("text"))).alias("o"))
    return found.select("item_id", F.size("o").alias("n"), F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.get("o", F.size("o") - 1).alias("last"))


@query
def utf8_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte sequences, valid and not; what isn't becomes a null text."""
    data = ("e38182", "c3a9", "ff", "c0af", "e380", "eda080", "f09f9880", "f4908080", "61", "")
    found = rows(spark, data, "hex").withColumn("data", F.unhex("hex"))
    return readers.valid_texts(found.withColumn("is_valid", text.valid_utf8(F.col("data")))).select("sample_id", "is_valid", F.col("text").isNull().alias("no_text"), F.length("text").alias("n_chars"))


# names


@query
def category_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 67 categories with part of speech and cost."""
    found = spark.createDataFrame([(n,) for n in categories.COST], "category string")
    return found.select("category", names.pos_of(F.col("category")).alias("pos"), names.category_cost(F.col("category")).alias("cost"))


@query
def default_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.createDataFrame([(n,) for n in names.POS], "pos string")
    return found.select("pos", names.default_category(F.col("pos")).alias("category"), names.is_taggable(F.col("pos")).alias("taggable"))


@query
def pos_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.createDataFrame([(n,) for k, v in names.POS.items() for n in (k, *v)] + [("nonsense",)], "name string").withColumn("pos", names.parse_pos(F.col("name")))
    return found.select("name", "pos", names.pos_ja(F.col("pos")).alias("pos_ja"), names.is_content(F.col("pos")).alias("is_content"), names.is_function(F.col("pos")).alias("is_function"))


@query
def dictionary_pos_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name that dictionaries use; null where there is no such part of speech."""
    given = ("NOUN", "PROPN", "PROPER_NOUN", "VERB", "ADJECTIVE", "ADJ", "ADVERB", "ADV", "PARTICLE", "AUXILIARY", "AUX", "CONJUNCTION", "CONJ", "DETERMINER", "DET", "ADNOMINAL", "PRONOUN", "PRON", "INTJ", "INTERJECTION", "SYMBOL", "SYM", "OTHER", "PHRASE", "SUFFIX", "PREFIX", "動詞", "CITY", " NOUN ")
    return rows(spark, given, "name").select("name", names.dictionary_pos(F.col("name")).alias("pos"))


@query
def conjugation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in (*names.TYPE_NAMES, "NONE")], "name string").select("name", names.type_name(F.col("name")).alias("en"), names.type_name(F.col("name"), True).alias("ja"), F.lit("type").alias("of"))
    forms = spark.createDataFrame([(k,) for k in (*names.FORM_NAMES, "NONE")], "name string").select("name", names.form_name(F.col("name")).alias("en"), names.form_name(F.col("name"), True).alias("ja"), F.lit("form").alias("of"))
    return kinds.unionByName(forms)


@query
def category_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What some categories cost after others."""
    table = categories.links()
    pairs = [("VERB_連用", "AUX_丁寧"), ("VERB_未然", "AUX_否定"), ("VERB_音便", "AUX_過去"), ("VERB_終止", "AUX_過去"), ("VERB_仮定", "PART_接続"), ("ADJ_連用", "AUX_否定"), ("ADJ_語幹", "AUX_様態"), ("ADJ_かっ", "AUX_過去"), ("ADJ_NA", "AUX_断定"), ("DET", "NOUN"), ("PART_格", "PART_格"), ("NOUN", "PART_副"), ("AUX_過去", "DET"), ("PART_接続", "AUX_継続"), ("NOUN", "AUX_接近"), ("NOUN", "PART_格"), ("PREFIX", "NOUN"), ("AUX_否定", "AUX_過去"), ("AUX_可能", "AUX_否定"), ("NOUN_形式", "ADJ_終止")]
    return spark.createDataFrame([(a, b, float(table.get((a, b), 0.0))) for a, b in pairs], "before string, after string, cost double")


@query
def built_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many built-in words each category of particles, prefixes, suffixes, conjunctions and the like has."""
    found = spark.createDataFrame(words.built_in(), "surface string, pos string, category string, lemma string")
    return found.where(F.col("pos").isin("PARTICLE", "PREFIX", "SUFFIX", "CONJ", "DET", "PRON", "INTJ", "NOUN")).groupBy("pos", "category").agg(F.count("*").alias("n"), F.min("surface").alias("least"))


# lexical extraction


@query
def pretoken_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, times, amounts, addresses, tags and the rest of the sequential extractor."""
    found = rows(spark, samples.LEXICAL).select("sample_id", F.posexplode(pretokens.pretokens(F.col("text"))).alias("place", "p"))
    return found.select("sample_id", "place", "p.kind", "p.surface", "p.start", "p.end", "p.type")


@query
def number_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ("123", "１２３円", "1,234", "3.14", "1,234.5円", "5.", "7,a", "abc", "０.5", "")
    return rows(spark, given).select("text", kana.parse_integer(F.col("text")).alias("whole"), kana.parse_number(F.col("text")).alias("number"), kana.parse_size(F.col("text")).alias("size"))


# conjugation


def verbs(spark: SparkSession) -> DataFrame:
    return rows(spark, samples.VERBS, "surface").select("surface").withColumn("conj_type", conjugation.detect_type(F.col("surface")))


@query
def detect_verb_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verbs(spark).select("surface", "conj_type", conjugation.stem(F.col("surface"), F.col("conj_type")).alias("stem"))


@query
def conjugate_godan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conjugation.conjugated(verbs(spark).where(F.col("conj_type").startswith("GODAN"))).select("surface", "conj_type", "form_id", "form")


@query
def conjugate_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame([("静か", "NA_ADJ"), ("本", None)], "surface string, conj_type string")
    return conjugation.conjugated(verbs(spark).where(~F.col("conj_type").startswith("GODAN")).unionByName(odd)).select("surface", "conj_type", "form_id", "form")


@query
def dictionary_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms that a dictionary keeps, with their categories."""
    return conjugation.entry_forms(verbs(spark)).select("surface", "form", "extended_pos")


@query
def verb_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conjugation.stem_forms(verbs(spark).where("conj_type <> 'I_ADJ'")).select("surface", "form_name", "form")


@query
def verb_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endings of verbs by type and form."""
    return conjugation.endings(spark)


@query
def auxiliary_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of the auxiliaries that conjugate as one-step verbs, generated from their bases."""
    return conjugation.auxiliaries(spark).where(F.col("lemma").isin("れる", "られる", "せる", "させる", "すぎる", "みる", "くれる") & F.col("makes").isin("BASE", "KATEIKEI", "MEIREIKEI")).select("surface", "lemma", "after", "makes").distinct()


@query
def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("RENYOKEI", "ます"), ("MIZENKEI", "ない"), ("ONBINKEI", "た"), ("OUT_TE", "いる"), ("OUT_BASE", "た"), ("BASE", "EOS"), ("ONBINKEI", "ます"), ("MIZENKEI", "た"), ("RENYOKEI", "た"), ("BASE", "ない"), ("X", "Y")]
    return conjugation.connection_costs(spark.createDataFrame(pairs, "left string, right string")).select("left", "right", "cost", "can_connect")


@query
def verb_and_adjective_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ("書いたら", "書いて", "読んで", "書けば", "書いた", "読ん", "書い", "食べろ", "書く", "食べる", "かい", "高かっ", "高けれ", "高く", "高い", "高", "飲んだら", "よっ", "")
    w = F.col("text")
    return rows(spark, given).select("text", conjugation.verb_form(w).alias("verb_form"), conjugation.adjective_form(w).alias("adjective_form"), conjugation.adjective_form(w, F.lit(True)).alias("na_form"))


@query
def negative_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ("書かない", "食べない", "しない", "高い", "食べられなく", "書かせなく", "されなく", "書かれなくなった", "食べられなくなった", "いかなく", "書かなく", "少ない", "ない")
    return rows(spark, given).select("text", conjugation.negative_patterns(F.col("text")).alias("p")).select("text", "p.*")


def inflected(spark: SparkSession) -> DataFrame:
    return rows(spark, tuple(x.split()[0] for x in samples.INFLECTED.strip().splitlines()))


@query
def inflect_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary form of conjugated surfaces, and whether they look conjugated."""
    found = inflected(spark).withColumn("r", conjugation.inflect(F.col("text")))
    return found.select("text", F.get("r", F.lit(0))["base"].alias("base"), (F.size("r") > 0).alias("any"))


@query
def inflect_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence falls from the first reading on and stays in bounds; surfaces of one character have no reading."""
    found = rows(spark, (*[x.split()[0] for x in samples.INFLECTED.strip().splitlines()], "あ", "")).withColumn("c", F.transform(conjugation.inflect(F.col("text")), lambda r: r["confidence"]))
    falling = F.coalesce(F.col("c") == F.reverse(F.array_sort("c")), F.lit(True))
    return found.select("text", falling.alias("falling"), F.forall("c", lambda x: x.between(0.3, 0.95)).alias("in_bounds"), (F.size("c") > 0).alias("any"))


@query
def looks_conjugated(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ("食べた", "書いている", "読めなかった", "あ", "本", "猫")
    return rows(spark, given).select("text", conjugation.looks_conjugated(F.col("text")).alias("looks"))


# dictionaries


def lines(spark: SparkSession, given: tuple) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(given, 1)], "line int, value string")


@query
def user_dictionary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a user dictionary with commas, tabs and quotes."""
    return readers.user_rows(lines(spark, samples.USER_LINES)).select("line", "surface", "pos", "lemma")


@query
def dictionary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a dictionary to be compiled."""
    return readers.dictionary_rows(lines(spark, samples.COMPILED_LINES)).select("line", "surface", "pos", "conj_type")


@query
def dict_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary compiled from plain and conjugating rows, one entry a surface."""
    return dictionary.compiled(readers.dictionary_rows(lines(spark, samples.COMPILED_LINES)))


@query
def dict_compile_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files compiled as one, trivial entries left out."""
    first, second = ("書く\tVERB\tGODAN_KA", "経済成長\tNOUN"), ("書き\tNOUN", "食べ物\tNOUN", "テスト\tNOUN")
    return dictionary.compiled_files(readers.dictionary_rows(lines(spark, first)), readers.dictionary_rows(lines(spark, second)), drop_trivial=True)


@query
def dict_decompile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.decompiled(dictionary.compiled(readers.dictionary_rows(lines(spark, samples.COMPILED_LINES))))


@query
def dict_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that can't be compiled."""
    bad = [(1, "本", "NOUN"), (2, "", "NOUN"), (3, "本", "NOUN"), (4, "本", "VERB"), (5, None, "ADJ"), (6, "本", "NOUN")]
    return dictionary.problems(spark.createDataFrame(bad, "line int, surface string, pos string"))


def small(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("本", "NOUN", 1), ("本", "VERB", 2), ("木", "NOUN", 1), ("読む", "VERB", 1), ("は", "PARTICLE", 1), ("の", "PARTICLE", 2)], "surface string, pos string, layer int")


@query
def dict_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries added, removed and changed, each on a copy."""
    entries = small(spark)
    out = {
        "added": dictionary.added(entries, spark.createDataFrame([("森", "NOUN", 3)], entries.schema)), "removed": dictionary.removed(entries, spark.createDataFrame([("本", None), ("木", "VERB"), ("の", "PARTICLE")], "surface string, pos string")),
        "updated": dictionary.updated(entries, spark.createDataFrame([("木", "SUFFIX")], "surface string, pos string")), "limited": dictionary.listed(entries, limit=3), "layered": dictionary.layered(entries.where("layer = 2"), entries.where("layer = 1")),
    }
    found = None
    for name, df in out.items():
        df = df.select(F.lit(name).alias("edit"), "surface", "pos", "layer")
        found = df if found is None else found.unionByName(df)
    return found


@query
def dict_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which surfaces a dictionary has: at all, as a particle, as anything but a verb."""
    entries, asked = small(spark), rows(spark, ("本", "読む", "は", "森"), "surface")
    out = None
    for name, pos, without in (("any", None, None), ("particle", "PARTICLE", None), ("no_verb", None, "VERB")):
        found = dictionary.existing(asked, entries, pos, without).select("surface", F.lit(name).alias("what"), "has_entry")
        out = found if out is None else out.unionByName(found)
    return out


# rewrites and tags

MORPHEMES = (
    ("東京", "NOUN", "東京", False), ("に", "PARTICLE", "に", False), ("行っ", "VERB", "行く", False), ("た", "AUX", "た", False), ("そして", "CONJ", "そして", False), ("こと", "NOUN", "こと", True), ("。", "SYMBOL", "。", False), ("美しく", "ADJ", "美しい", False),
    ("東京", "PRON", "東京", False), ("とても", "ADV", "とても", False), ("木", "NOUN", "木", False), ("行き", "VERB", "行く", False),
)


@query
def tag_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of one row of morphemes under ten sets of options."""
    option = tokens.TagOptions
    sets = {
        "default": option(), "particles": option(exclude_particles=False, min_tag_length=1), "auxiliaries": option(exclude_auxiliaries=False, min_tag_length=1), "formal": option(exclude_formal_nouns=False), "surface": option(use_lemma=False),
        "nouns": option(pos_filter=1, min_tag_length=1), "verbs_adverbs": option(pos_filter=10), "no_basic": option(exclude_basic=True), "repeats": option(remove_duplicates=False), "two": option(max_tags=2),
    }
    m = F.array(*[F.struct(F.lit(s).alias("surface"), F.lit(p).alias("pos"), F.lit(lemma).alias("lemma"), F.lit(formal).alias("is_formal_noun"), F.lit(False).alias("is_low_info")) for s, p, lemma, formal in MORPHEMES])
    one = spark.range(1).withColumn("m", m)
    out = None
    for name, options in sets.items():
        found = one.select(F.lit(name).alias("options"), F.posexplode(tokens.tags(F.col("m"), options)).alias("place", "t")).select("options", "place", "t.tag", "t.pos")
        out = found if out is None else out.unionByName(found)
    return out


@query
def prefix_verb_to_noun(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [("a", 0, "お", "PREFIX", "お"), ("a", 1, "願い", "VERB", "願う"), ("a", 2, "し", "VERB", "する"), ("b", 0, "本", "NOUN", "本"), ("b", 1, "読む", "VERB", "読む"), ("c", 0, "ご", "PREFIX", "ご"), ("c", 1, "覧", "VERB", "覧る")]
    return rewrites.prefixed_verbs(spark.createDataFrame(given, "doc_id string, token_index int, surface string, pos string, lemma string"))


@query
def prolonged_sound_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [("a", 0, "すご", "ADJ", "すご"), ("a", 1, "ー", "NOUN", "ー"), ("a", 2, "ーー", "NOUN", "ー"), ("a", 3, "い", "AUX", ""), ("b", 0, "。", "SYMBOL", "。"), ("b", 1, "ー", "NOUN", "ー"), ("c", 0, "ー", "NOUN", "ー")]
    return rewrites.prolonged(spark.createDataFrame(given, "doc_id string, token_index int, surface string, pos string, lemma string"))


# the analyzer


def japanese(spark: SparkSession) -> DataFrame:
    return rows(spark, JAPANESE).withColumnRenamed("sample_id", "doc_id")


def analyzed(spark: SparkSession, **options) -> DataFrame:
    run = analyze.analyzer(options=lattice.Options(**options))
    return japanese(spark).select("doc_id", "text", run("text").alias("morphemes"))


def exploded(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "doc_id", F.posexplode("morphemes").alias("token_index", "m"))


@query
def golden_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and parts of speech of texts whose segmentation is known, without a dictionary."""
    found = rows(spark, tuple(x.split(" = ")[0] for x in samples.GOLDEN.strip().splitlines())).withColumn("m", analyze.analyzer()("text"))
    return found.select("text", F.array_join(F.transform("m", lambda x: F.concat_ws("/", x["surface"], x["pos"])), " ").alias("tokens"))


@query
def golden_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of a golden file, some of them wrong on purpose, against the engine: what differs, and what is right."""
    own = "own_expected"
    cases = spark.createDataFrame([(samples.GOLDEN_JSON,)], "j string").select(F.explode(F.from_json("j", readers.golden_schema(own))["cases"]).alias("c"), F.lit("sample.json").alias("file"))
    return golden.compared(readers.golden_columns(cases, own)).select("id", "input", "difference", "surfaces_right", "pos_right", "lemmas_right")


@query
def golden_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports over a golden file: right cases by file, expected parts of speech, repeated ids, cases of a tag."""
    own = "own_expected"
    cases = spark.createDataFrame([(samples.GOLDEN_JSON,)], "j string").select(F.explode(F.from_json("j", readers.golden_schema(own))["cases"]).alias("c"), F.lit("sample.json").alias("file"))
    cases = readers.golden_columns(cases, own)
    right = golden.report(golden.compared(cases)).select(F.lit("right").alias("report"), F.col("file").alias("key"), F.concat_ws("/", "surfaces", "pos", "lemmas", "n").alias("value"))
    by_pos = golden.positions(cases).select(F.lit("pos").alias("report"), F.coalesce("pos", F.lit("none")).alias("key"), F.col("n").cast("string").alias("value"))
    again = golden.repeated_ids(cases).select(F.lit("again").alias("report"), F.col("id").alias("key"), F.col("n").cast("string").alias("value"))
    tagged = golden.with_tag(cases, "basic").select(F.lit("basic").alias("report"), F.col("id").alias("key"), F.col("input").alias("value"))
    return right.unionByName(by_pos).unionByName(again).unionByName(tagged)


@query
def tag_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only one of two sets of tags has."""
    found = spark.createDataFrame([(1, ["a", "b", "c"], ["b", "d"]), (2, [], ["x"]), (3, ["y"], ["y"])], "id int, expected array<string>, actual array<string>")
    return found.select("id", golden.missing_and_extra(F.col("expected"), F.col("actual")).alias("d")).select("id", F.array_join("d.missing", ",").alias("missing"), F.array_join("d.extra", ",").alias("extra"))


@query
def candidate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest conjugated or derived candidate at the start of words: verbs, adjectives, compounds, nouns, adverbs."""
    found = rows(spark, samples.CANDIDATES).select("text", F.inline(analyze.explained()("text")))
    made = found.where((F.col("start") == 0) & ~F.col("known") & (F.length("surface") > 1)).where((F.col("extended_pos") != "NOUN") | (F.col("cost") < 0.6)).where(F.col("extended_pos") != "OTHER")
    best = made.groupBy("text").agg(F.min_by(F.struct("surface", "extended_pos", "lemma"), F.struct("cost", "edge_id")).alias("b"))
    return best.select("text", "b.*")


@query
def lattice_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(analyzed(spark)).select("doc_id", "token_index", "m.surface", "m.pos", "m.start", "m.end", "m.is_dictionary", "m.extended_pos")


@query
def lattice_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three modes side by side."""
    out = None
    for mode in ("normal", "search", "split"):
        found = analyzed(spark, mode=mode).select(F.lit(mode).alias("mode"), "doc_id", F.array_join(F.transform("morphemes", lambda m: m["surface"]), "/").alias("surfaces"))
        out = found if out is None else out.unionByName(found)
    return out


@query
def morpheme_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas, conjugation types and forms of verbs and adjectives."""
    given = ("書かなかった", "食べよう", "高かった", "勉強すれば", "泳いで", "話した", "静かな町", "飲みもの", "見ろ", "行こう")
    found = rows(spark, given).withColumnRenamed("sample_id", "doc_id").withColumn("morphemes", analyze.analyzer()("text"))
    return exploded(found, "text").where(F.col("m.pos").isin("VERB", "ADJ", "NOUN")).select("text", "token_index", "m.surface", "m.lemma", "m.conj_type", "m.conj_form")


@query
def numbers_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with their units, and what does not join."""
    given = ("3億5000万円", "100票", "第2話", "10章", "5時間", "3週間半", "2対1", "20メートル", "数回", "何度", "3人目", "1万2000人")
    found = rows(spark, given).withColumn("m", analyze.analyzer()("text"))
    return found.select("text", F.array_join(F.transform("m", lambda x: x["surface"]), "/").alias("surfaces"))


@query
def japanese_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyzed(spark).select("doc_id", F.posexplode(analyze.tagged(F.col("morphemes"), tokens.TagOptions(exclude_basic=True, pos_filter=3))).alias("place", "t"))
    return found.select("doc_id", "place", "t.tag", "t.pos")


@query
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """analyze and tags as SQL functions, tokenize as a table function."""
    analyze.register(spark)
    japanese(spark).createOrReplaceTempView("tokiwa_samples")
    return spark.sql(
        "select doc_id, 'tags' as what, array_join(transform(tags(text), t -> t.tag), ' ') as found from tokiwa_samples union all "
        "select doc_id, 'analyze', array_join(transform(analyze(text), m -> m.surface), ' ') from tokiwa_samples union all "
        "select s.doc_id, 'tokenize', array_join(transform(array_sort(collect_list(struct(t.token_index, t.surface))), x -> x.surface), ' ') from tokiwa_samples s, lateral tokenize(s.text) t group by s.doc_id"
    )


@query
def with_without_dict_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morphemes that only one of two analyses has, with a user dictionary and without, by place."""
    user = readers.user_rows(lines(spark, samples.USER_LINES)).select("surface", "pos", "lemma")
    found = spark.createDataFrame(list(SEGMENTED), "text string, doc_id int")
    run = lambda engine, name: exploded(found.withColumn("morphemes", engine.analyze(F.col("text")))).select("doc_id", "m.start", "m.end", F.col("m.surface").alias(name))
    both = run(analyze.Engine().with_user_dictionary(user), "with_dictionary").join(run(analyze.Engine(), "without"), ["doc_id", "start", "end"], "full_outer")
    return both.where(~F.col("with_dictionary").eqNullSafe(F.col("without")))


@query
def engine_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine with layers: user dictionaries add up, a table replaces the one before, a bad dictionary is a warning."""
    words_of = lambda *ws: spark.createDataFrame([(w, p) for w, p in ws], "surface string, pos string")
    base = analyze.Engine()
    two = base.with_user_dictionary(words_of(("東京スカイ", "NOUN"))).with_user_dictionary(words_of(("スカイツリー", "NOUN")))
    table = base.with_dictionary_table(words_of(("東京スカイツリー", "NOUN")))
    engines = {
        "base": base, "two": two, "table": table, "replaced": table.with_dictionary_table(words_of(("ツリー", "NOUN"))), "lenient": base.with_user_dictionary(words_of(("東京", "CITY")), lenient=True), "search": base.with_mode("search"),
        "missing": base.with_dictionaries(spark, ["/nonexistent/a.parquet"]),
    }
    one = spark.createDataFrame([("東京スカイツリー展望台",)], "text string")
    out = None
    for name, engine in engines.items():
        found = one.select(F.lit(name).alias("engine"), F.array_join(F.transform(engine.analyze(F.col("text")), lambda m: m["surface"]), "/").alias("surfaces"), F.lit(len(engine.entries)).alias("n_entries"), F.lit(len(engine.warnings)).alias("n_warnings"))
        out = found if out is None else out.unionByName(found)
    return out


@query
def named_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags under options as other languages name them."""
    given = {
        "default": {}, "nouns": {"pos": ["noun"]}, "unknown_pos": {"pos": ["nonsense"]}, "short": {"minLength": 1}, "surface": {"useLemma": False, "pos": ["verb"]}, "one": {"maxTags": 1}, "search": {"mode": "search"}, "no_basic": {"excludeBasic": True}, "merged": {"mergeCompounds": True, "pos": ["noun"]},
    }
    one = spark.createDataFrame([("Web開発を東京で頼んだ",)], "text string")
    out = None
    for name, options in given.items():
        found = one.select(F.lit(name).alias("options"), F.array_join(F.transform(analyze.from_options(options).tags(F.col("text")), lambda t: t["tag"]), " ").alias("tags"))
        out = found if out is None else out.unionByName(found)
    return out


@query
def scorer_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text under configurations that change what its joins and connections cost."""
    given = {"none": "{}", "idle": '{"unary": {"x": 1}}', "letters": '{"join": {"alpha_kanji_bonus": 5}}', "suffix": '{"bigram": {"noun_to_suffix": 5}}'}
    one = spark.createDataFrame([("API開発の田中さん",)], "text string")
    out = None
    for name, config in given.items():
        run = analyze.analyzer(options=readers.scorer_options(config))
        found = one.select(F.lit(name).alias("configuration"), F.array_join(F.transform(run("text"), lambda m: m["surface"]), "/").alias("surfaces"))
        out = found if out is None else out.unionByName(found)
    return out


@query
def long_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text over the longest piece: tokens don't span pieces, and offsets go on."""
    one = spark.createDataFrame([(i, ("東京に行く。" * 3000)[:n]) for i, n in enumerate((17_000, 6))], "doc_id int, text string").withColumn("morphemes", analyze.analyzer()("text"))
    return one.select("doc_id", F.size("morphemes").alias("n"), F.get("morphemes", F.size("morphemes") - 1)["end"].alias("last_end"), F.array_distinct(F.transform("morphemes", lambda m: m["surface"])).alias("s")).select("doc_id", "n", "last_end", F.array_join("s", "/").alias("surfaces"))


@query
def lattice_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of a short text, those of the dictionary among them."""
    found = spark.createDataFrame([("本を読む",)], "text string").select(F.inline(analyze.explained()("text")))
    return found.groupBy("start").agg(F.count("*").alias("n"), F.count_if("known").alias("n_known"), F.max("end").alias("furthest"))


@query
def candidates_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest candidates of a short text in their order, and whether all of them lead from its start to its end."""
    found = spark.createDataFrame([("本を読んだ",)], "text string").withColumn("e", analyze.explained(by_cost=True)("text"))
    reach = F.concat_ws("-", F.array_min(F.transform("e", lambda x: x["start"])), F.array_max(F.transform("e", lambda x: x["end"]))).alias("reach")
    rows = found.select(reach, F.inline(F.slice("e", 1, 6)))
    return rows.select("edge_id", "surface", "extended_pos", F.round(F.col("cost").cast("double"), 3).alias("cost"), "reach")


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the folder that driver and executors share; in one of this machine's where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(folder or tempfile.mkdtemp(prefix='tokiwa-')).rstrip('/')}/samples-{uuid.uuid4().hex}"


@query
def files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, dictionaries as a table and as lines, and golden cases, written and read again."""
    folder = scratch(spark)
    text_lines = lambda given, name: spark.createDataFrame([(v,) for v in given], "value string").coalesce(1).write.text(f"{folder}/{name}")
    text_lines(("一行目です。", "二行目 line two", ""), "whole")
    whole = readers.whole_texts(spark, f"{folder}/whole").select(F.lit("whole").alias("what"), F.lit("text").alias("key"), F.col("text").alias("value"))
    text_lines(samples.COMPILED_LINES, "lines")
    read = readers.dictionary_tsv(spark, f"{folder}/lines")
    writers.write_dictionary(dictionary.compiled(read), f"{folder}/table")
    table = spark.read.parquet(f"{folder}/table")
    engine = analyze.Engine().with_dictionaries(spark, [f"{folder}/none", f"{folder}/table"])
    by_pos = table.groupBy("pos").agg(F.count("*").alias("n")).select(F.lit("table").alias("what"), F.col("pos").alias("key"), F.col("n").cast("string").alias("value"))
    found = spark.createDataFrame([("優木は静かに本を書いた",)], "text string").select(F.lit("engine").alias("what"), F.lit(str(len(engine.warnings))).alias("key"), F.array_join(F.transform(engine.analyze(F.col("text")), lambda m: m["surface"]), "/").alias("value"))
    writers.write_dictionary_tsv(read, f"{folder}/again")
    again = spark.read.text(f"{folder}/again").select(F.lit("again").alias("what"), F.substring_index("value", "\t", 1).alias("key"), F.replace("value", F.lit("\t"), F.lit("/")).alias("value"))
    text_lines((samples.GOLDEN_JSON,), "golden")
    cases = readers.golden_cases(spark, f"{folder}/golden").groupBy("id").agg(F.count("*").alias("n")).select(F.lit("golden").alias("what"), F.col("id").alias("key"), F.col("n").cast("string").alias("value"))
    return whole.unionByName(by_pos).unionByName(found).unionByName(again).unionByName(cases)


@query
def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text form of the samples' morphemes."""
    found = analyzed(spark).where("doc_id in (0, 2)")
    forms = {"text": writers.as_text(found), "tsv": writers.as_tsv(found), "json": writers.as_json(found), "chasen": writers.as_chasen(found), "tags": writers.as_tags(found.withColumn("tags", analyze.tagged(F.col("morphemes"))))}
    out = None
    for name, form in forms.items():
        form = form.select(F.lit(name).alias("form"), "value")
        out = form if out is None else out.unionByName(form)
    return out
