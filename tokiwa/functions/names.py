"""Part-of-speech names and categories."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokiwa.grammar.categories import COST, DEFAULT, POS_OF
from tokiwa.grammar.conjugation import FORM_NAMES, TYPE_NAMES

# Parts of speech as they are written out, with their Japanese names and the names of test files.
POS = {
    "NOUN": ("名詞", "Noun"), "VERB": ("動詞", "Verb"), "ADJ": ("形容詞", "Adjective"), "ADV": ("副詞", "Adverb"), "PARTICLE": ("助詞", "Particle"),
    "AUX": ("助動詞", "Auxiliary"), "CONJ": ("接続詞", "Conjunction"), "DET": ("連体詞", "Determiner"), "PRON": ("代名詞", "Pronoun"), "PREFIX": ("接頭辞", "Prefix"),
    "SUFFIX": ("接尾辞", "Suffix"), "INTJ": ("感動詞", "Interjection"), "SYMBOL": ("記号", "Symbol"), "OTHER": ("その他", "Other"),
}
# Other names by which dictionaries call parts of speech.
OTHER_NAMES = {
    "PROPN": "NOUN", "PROPER_NOUN": "NOUN", "ADJECTIVE": "ADJ", "ADVERB": "ADV", "AUXILIARY": "AUX", "CONJUNCTION": "CONJ", "DETERMINER": "DET", "ADNOMINAL": "DET", "PRONOUN": "PRON", "INTERJECTION": "INTJ", "SYM": "SYMBOL", "PHRASE": "OTHER",
}
CONTENT = ("NOUN", "VERB", "ADJ", "ADV")
FUNCTION = ("PARTICLE", "AUX")


def _mapped(value: Column, table: dict[str, str], otherwise: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), value), F.lit(otherwise))


def pos_ja(pos: Column) -> Column:
    return _mapped(pos, {k: ja for k, (ja, _) in POS.items()}, POS["OTHER"][0])


def parse_pos(name: Column) -> Column:
    """A part of speech from its written, Japanese or test-file name; anything else is OTHER."""
    return _mapped(name, {n: k for k, names in POS.items() for n in (k, *names)}, "OTHER")


def dictionary_pos(name: Column) -> Column:
    """A part of speech from any name that dictionaries use; null for no such name."""
    table = {n: k for k, names in POS.items() for n in (k, names[0])} | {n: k for k, (_, n) in POS.items()} | OTHER_NAMES
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), F.trim(name))


def pos_of(category: Column) -> Column:
    """The part of speech of a fine-grained category; OTHER for an unknown one."""
    return _mapped(category, POS_OF, "OTHER")


def default_category(pos: Column) -> Column:
    """The category of a word of which only the part of speech is known."""
    return _mapped(pos, DEFAULT, "OTHER")


def category_cost(category: Column) -> Column:
    """The cost of a word of a category; an unknown one costs 2."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*COST.items())]), category), F.lit(2.0))


def type_name(kind: Column, japanese: bool = False) -> Column:
    """A conjugation type in English or Japanese; empty for an unknown one."""
    return _mapped(kind, {k: v[japanese] for k, v in TYPE_NAMES.items()}, "")


def form_name(form: Column, japanese: bool = False) -> Column:
    """A conjugation form in English or Japanese; that of the base for an unknown one."""
    return _mapped(form, {k: v[japanese] for k, v in FORM_NAMES.items()}, FORM_NAMES["BASE"][japanese])


def is_taggable(pos: Column) -> Column:
    return pos.isin(*CONTENT)


def is_content(pos: Column) -> Column:
    return pos.isin(*CONTENT)


def is_function(pos: Column) -> Column:
    return pos.isin(*FUNCTION)
