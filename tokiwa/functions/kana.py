"""Predicates on kana, kanji and short words as Column expressions; a column of one character unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokiwa.functions.pretokens import running
from tokiwa.functions.text import ASCII_DIGITS, FULL_KANA, HALF_KANA, fold_width, java_class, only, wide

# Hiragana by vowel.
ROWS = {"あ": "あかがさざただなはばぱまやらわ", "い": "いきぎしじちぢにひびぴみり", "う": "うくぐすずつづぬふぶぷむゆる", "え": "えけげせぜてでねへべぺめれ", "お": "おこごそぞとどのほぼぽもよろを"}
SMALL_VOWELS = {"ゃ": "あ", "ゅ": "う", "ょ": "お"}
# Kana that a stem ends in, by row, and before た or て.
STEM_ENDS = {"あ": "あかがさたなばまらわ", "い": "みきぎしじちぢにびりい", "え": "べめせけげてねれえでぜへぺ", "onbin": "いっん"}
SMALL_KANA = "ょゃゅぁぃぅぇぉっョャュァィゥェォッ"
# Kana that are particles, or that never begin or continue a stem.
COMMON_PARTICLES = "をがはにへの"
EXTENDED_PARTICLES = COMMON_PARTICLES + "かねよわでとも"
NEVER_VERB_AFTER_KANJI, NEVER_VERB_FIRST, NEVER_ADJECTIVE_AFTER_KANJI = COMMON_PARTICLES + "もや", "をがへのよ", COMMON_PARTICLES + "もやてで"
DEMONSTRATIVE_FIRST, DEMONSTRATIVE_SECOND = "こそあど", "れこち"
# Words that stand alone though they are one character, and other closed classes.
SINGLE_KANJI = "人日月年時分秒本冊個枚台回件円点度番階歳国市県区町村家駅店道海山川森空雨上下中外内前後東西南北春夏秋冬朝昼夜今何誰私僕俺君彼我"
SINGLE_HIRAGANA = "がをにでとへのはもかなねよわだたてば"
SINGLE_VERB_STEMS = "し来見居い出寝得経着"
COMPOUND_AUXILIARY_FIRST = "終始過続直合出込切損返忘残掛取上下付着締詰"
HIRAGANA_COMPOUND_AUXILIARIES, HIRAGANA_COMPOUND_PREFIXES = ("おわる", "はじめる", "すぎる", "つづける"), ("おわ", "はじめ", "すぎ", "つづけ")
PARTICLES, COPULAS = ("が", "を", "に", "で", "と", "へ", "の", "は", "も", "や", "か", "から", "まで", "より", "ほど"), ("だ", "です", "だった", "でした", "でし", "である")
FORMAL_NOUNS = ("所", "物", "事", "時", "方", "為")
# Kanji that count, and ranges of kanji without the iteration mark.
COUNTERS = "円銭万億兆分秒時日月年週期世個本人台枚杯回歳才階号番匹冊件丁通発点票頭羽着足軒組曲巻畳割部面問章棟戸席食泊口束両機基隻度倍段級位種色名話連敗勝戦間紀次"
KANJI_RANGES = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{F900}-\\x{FAFF}\\x{2F00}-\\x{2FDF}"
EMOJI_MODIFIERS = "\\x{200D}\\x{FE0E}\\x{FE0F}\\x{1F3FB}-\\x{1F3FF}\\x{20E3}\\x{E0020}-\\x{E007F}"


def among(c: Column, chars: str) -> Column:
    """Whether c is one of chars."""
    return c.isin(*chars)


def in_row(c: Column, vowel: str) -> Column:
    """Whether c is a hiragana of the row of a vowel."""
    return among(c, ROWS[vowel])


def vowel(c: Column) -> Column:
    """The vowel of a hiragana; any other character stays."""
    kana = {k: v for v, row in ROWS.items() for k in row} | SMALL_VOWELS
    return F.translate(c, "".join(kana), "".join(kana.values()))


def can_combine(first: Column, second: Column) -> Column:
    """Whether characters of two classes may stand in one run: the same class, or letters and digits."""
    return (first == second) | (first.isin("ALPHABET", "DIGIT") & second.isin("ALPHABET", "DIGIT"))


def is_kanji(c: Column) -> Column:
    return c.rlike(f"^[{KANJI_RANGES}]$")


def is_counter(c: Column) -> Column:
    return among(c, COUNTERS)


def is_emoji_modifier(c: Column) -> Column:
    return c.rlike(f"^[{EMOJI_MODIFIERS}]$")


def is_regional_indicator(c: Column) -> Column:
    return c.rlike("^[\\x{1F1E6}-\\x{1F1FF}]$")


def is_iteration_mark(c: Column) -> Column:
    return c == "々"


def is_prolonged_mark(c: Column) -> Column:
    return c == "ー"


def is_demonstrative(text: Column) -> Column:
    """Whether a text begins as これ, そこ, あち and so on do."""
    return among(F.substring(text, 1, 1), DEMONSTRATIVE_FIRST) & among(F.substring(text, 2, 1), DEMONSTRATIVE_SECOND)


def ends_in_row(text: Column, row: str) -> Column:
    """Whether a text ends in a kana that stems end in: あ, い or え row, or onbin."""
    return among(F.substring(text, -1, 1), STEM_ENDS[row])


def script_of(text: Column) -> Column:
    """struct<all_kanji, has_kanji, has_katakana, pure_hiragana, pure_katakana, mixed>: which scripts a text has."""
    kanji, hiragana = text.rlike(f"[{KANJI_RANGES}]"), text.rlike(f"[{java_class('HIRAGANA')}]")
    katakana = "\\x{30A0}-\\x{30FF}"
    return F.struct(
        text.rlike(f"^[{KANJI_RANGES}]+$").alias("all_kanji"), kanji.alias("has_kanji"), text.rlike(f"[{katakana}]").alias("has_katakana"), only(text, "HIRAGANA").alias("pure_hiragana"),
        text.rlike(f"^[{katakana}]+$").alias("pure_katakana"), (kanji & hiragana).alias("mixed"),
    )


def word_class(text: Column) -> Column:
    """struct of what closed classes a short word belongs to."""
    begins = F.lit(False)
    for prefix in HIRAGANA_COMPOUND_PREFIXES:
        begins = begins | text.startswith(prefix)
    return F.struct(
        among(text, SINGLE_KANJI).alias("single_kanji"), among(text, SINGLE_HIRAGANA).alias("single_hiragana"), among(text, SINGLE_VERB_STEMS).alias("verb_stem"), among(F.substring(text, 1, 1), COMPOUND_AUXILIARY_FIRST).alias("compound_auxiliary"),
        text.isin(*HIRAGANA_COMPOUND_AUXILIARIES).alias("hiragana_auxiliary"), begins.alias("hiragana_auxiliary_begins"), text.isin(*PARTICLES).alias("particle"), text.isin(*COPULAS).alias("copula"), text.isin(*FORMAL_NOUNS).alias("formal_noun"),
    )


def normalize_char(c: Column) -> Column:
    """One character with its width folded and A-Z lowered, half-width kana widened; marks stay apart."""
    return F.translate(fold_width(c, preserve_case=False), HALF_KANA, FULL_KANA)


def byte_offsets(text: Column) -> Column:
    """Where each character of a text begins, in bytes of UTF-8, and the text's end."""
    return F.concat(running(F.transform(F.split(text, ""), lambda c: F.octet_length(c))), F.array(F.octet_length(text)))


def parse_integer(text: Column) -> Column:
    """The digits at a text's start, of either width; null if there are none."""
    return F.translate(F.regexp_extract(text, "^[0-9０-９]+", 0), wide(ASCII_DIGITS), ASCII_DIGITS).try_cast("long")


def parse_number(text: Column) -> Column:
    """The number at a text's start as it is written, narrowed: commas before a digit dropped, a point only before one; null if none."""
    found = F.regexp_extract(text, "^(?:[0-9０-９]|[.,](?=[0-9]))+", 0)
    return F.when(found.rlike("[0-9０-９]"), F.translate(F.replace(found, F.lit(",")), wide(ASCII_DIGITS), ASCII_DIGITS))


def parse_size(text: Column) -> Column:
    """A whole number of an option, without a sign; null for anything else."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))
