"""Readers: texts, dictionaries and golden cases as DataFrames. All go through Spark's own readers, so any store will do."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokiwa.functions.names import dictionary_pos, parse_pos
from tokiwa.grammar.conjugation import TYPE_NAMES
from tokiwa.operators.lattice import Options

DICTIONARY = "layer int, line int, surface string, pos string, conj_type string, lemma string"


#: A field of a line with commas, after the comma before it.
FIELD = ',("(?:[^"]|"")*"|[^",]*)'
# Conjugation types that the third field of a line with tabs may hold instead of a lemma.
CONJ_TYPES = (*TYPE_NAMES, "NA_ADJ", "NONE", "FAMILY", "GIVEN", "INTERJECTION")


class DictionaryError(ValueError):
    """A dictionary that can't be read; nothing of it is used."""


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): each file one document, its lines joined by line feeds."""
    rows = spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name())
    return rows.select(F.xxhash64("_file").alias("doc_id"), F.regexp_replace("value", "\\n$", "").alias("text"))


def texts(spark: SparkSession, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) of a Parquet table."""
    return spark.read.parquet(path).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def valid_texts(df: DataFrame, data: str = "data") -> DataFrame:
    """Rows of binary data as text; what isn't valid UTF-8 becomes null."""
    return df.withColumn("text", F.expr(f"try_validate_utf8(cast({data} as string))")).drop(data)


def dictionary_tsv(spark: SparkSession, path: str, layer: int = 3) -> DataFrame:
    """Compiled-dictionary rows: surface, part of speech and, optionally, conjugation type, parted by tabs.

    Empty lines and those that begin with # are passed over, carriage returns dropped. A row without a surface or with an
    unknown part of speech makes the whole load fail, with the first such line named.
    """
    return dictionary_rows(numbered(spark, path), layer)


def dictionary_rows(lines: DataFrame, layer: int = 3) -> DataFrame:
    """As dictionary_tsv, from rows (line, value)."""
    lines = lines.where("value <> '' and not startswith(value, '#')")
    cells = lines.select("line", "value", F.split("value", "\t", -1).alias("f"))
    rows = cells.select(F.lit(layer).alias("layer"), "line", F.get("f", F.lit(0)).alias("surface"), F.get("f", F.lit(1)).alias("pos"), F.coalesce(F.get("f", F.lit(2)), F.lit("")).alias("conj_type"), F.lit("").alias("lemma"))
    return checked(rows)


def user_dictionary(spark: SparkSession, path: str, layer: int = 4) -> DataFrame:
    """User-dictionary rows: surface, part of speech and, by the number of fields, a cost (ignored) and a lemma.

    A line with a tab is parted by tabs, any other by commas, with quotes as in CSV. Lines of under two fields are passed
    over; a bad quote, an empty surface or an unknown part of speech makes the whole load fail.
    """
    return user_rows(numbered(spark, path), layer)


def user_rows(lines: DataFrame, layer: int = 4) -> DataFrame:
    """As user_dictionary, from rows (line, value)."""
    lines = lines.where("trim(value) <> '' and not startswith(value, '#')")
    tabs = F.contains("value", F.lit("\t"))
    # a line of plain fields and quoted ones, doubled quotes inside these; each match of FIELD is one with the comma before it
    fields = F.transform(F.regexp_extract_all(F.concat(F.lit(","), F.col("value")), F.lit(FIELD), 1), lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    problem = F.when(~tabs & ~F.concat(F.lit(","), F.col("value")).rlike(f"^(?:{FIELD})+$"), "unterminated or misplaced quote")
    parted = lines.select("line", F.struct(F.when(tabs, F.split("value", "\t", -1)).otherwise(fields).alias("fields"), problem.alias("problem")).alias("x"), tabs.alias("tabs"))
    bad = parted.where("x.problem is not null").select("line", "x.problem").orderBy("line").first()
    if bad:
        raise DictionaryError(f"line {bad['line']}: {bad['problem']}")
    f, n = F.col("x.fields"), F.size("x.fields")
    numeric = lambda c: F.coalesce(c.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.lit(False))
    third, fourth = F.get(f, F.lit(2)), F.get(f, F.lit(3))
    by_tabs = F.when(n >= 6, F.get(f, F.lit(5))).when((n == 4) & ~numeric(fourth), fourth).when((n == 3) & ~numeric(third) & ~third.isin(*CONJ_TYPES), third)
    lemma = F.coalesce(F.when(F.col("tabs"), by_tabs).otherwise(F.when(n >= 4, fourth)), F.lit(""))
    rows = parted.where(n >= 2).select(F.lit(layer).alias("layer"), "line", F.get(f, F.lit(0)).alias("surface"), F.get(f, F.lit(1)).alias("pos"), F.lit("").alias("conj_type"), lemma.alias("lemma"))
    return checked(rows)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a dictionary file, in order. Dictionaries are files of bounded size, read whole."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\\r?\\n", -1)).alias("line", "value")).withColumn("line", F.col("line") + 1)


def checked(rows: DataFrame) -> DataFrame:
    """rows with their parts of speech as written out; fails on the first that has none."""
    parsed = rows.withColumn("_p", dictionary_pos(F.col("pos")))
    bad = parsed.where((F.col("surface") == "") | F.col("_p").isNull()).select("line", "surface", "pos").orderBy("line").first()
    if bad:
        raise DictionaryError(f"line {bad['line']}: surface {bad['surface']!r} with part of speech {bad['pos']!r}")
    return parsed.withColumn("pos", F.col("_p")).drop("_p")


def golden_table(spark: SparkSession, path: str, own: str = "own_expected") -> DataFrame:
    """(file, id, input, expected: array<struct<surface, pos, lemma>>, tags) of golden files.

    Where a case has expectations of its engine's own, in the field `own`, they stand in for the others.
    """
    cases = spark.read.schema(golden_schema(own)).json(path, multiLine=True).select(F.input_file_name().alias("_path"), F.explode("cases").alias("c"))
    return golden_columns(cases.withColumn("file", F.regexp_extract("_path", "([^/]*)$", 1)), own)


def golden_schema(own: str) -> str:
    token = "array<struct<surface:string,pos:string,lemma:string>>"
    return f"version string, cases array<struct<id:string,input:string,expected:{token},{own}:{token},tags:array<string>>>"


def golden_columns(cases: DataFrame, own: str = "own_expected") -> DataFrame:
    """The columns of golden_table from rows (file, c), c one case."""
    chosen = F.when(F.size(f"c.{own}") > 0, F.col(f"c.{own}")).otherwise(F.col("c.expected"))
    expected = F.transform(chosen, lambda t: F.struct(t["surface"].alias("surface"), F.when(F.length(t["pos"]) > 0, parse_pos(t["pos"])).alias("pos"), t["lemma"].alias("lemma")))
    return cases.select("file", "c.id", "c.input", expected.alias("expected"), "c.tags")


def golden_cases(spark: SparkSession, path: str, own: str = "own_expected") -> DataFrame:
    """(id, input, place, surface, pos, lemma): what each case of golden files expects, token by token."""
    rows = golden_table(spark, path, own).select("id", "input", F.posexplode("expected").alias("place", "t"))
    return rows.select("id", "input", "place", "t.surface", "t.pos", "t.lemma")


# Names of connection costs in a scorer's configuration, and the parts of speech that they stand between.
SCORER_LINKS = {
    "noun_to_suffix": ("NOUN", "SUFFIX"), "prefix_to_noun": ("PREFIX", "NOUN"), "prefix_to_verb": ("PREFIX", "VERB"), "pron_to_aux": ("PRON", "AUX"), "verb_to_verb": ("VERB", "VERB"), "verb_to_noun": ("VERB", "NOUN"), "verb_to_aux": ("VERB", "AUX"),
    "adj_to_aux": ("ADJ", "AUX"), "adj_to_verb": ("ADJ", "VERB"), "adj_to_adj": ("ADJ", "ADJ"), "part_to_verb": ("PARTICLE", "VERB"), "part_to_noun": ("PARTICLE", "NOUN"), "aux_to_part": ("AUX", "PARTICLE"), "aux_to_aux": ("AUX", "AUX"),
}
#: Sections that a configuration may have without their changing anything.
IDLE_SECTIONS = ("unary", "optimal_length", "verb_candidates", "inflection", "candidates")


def scorer_options(text: str, base: Options = Options()) -> Options:
    """Options with the costs of a scorer's configuration in JSON.

    Section bigram has connection costs by the names of SCORER_LINKS; join has alpha_kanji_bonus and alpha_katakana_bonus,
    split has user_dict_bonus; the sections that never had an effect are taken and passed over. Any other section, or an
    unknown name in bigram, is an error.
    """
    given = json.loads(text)
    unknown = set(given) - {"bigram", "join", "split", *IDLE_SECTIONS}
    names = given.get("bigram", {})
    unknown |= set(names) - set(SCORER_LINKS)
    if unknown:
        raise ValueError(f"unknown in a scorer's configuration: {sorted(unknown)}")
    links = base.connection | {SCORER_LINKS[n]: float(v) for n, v in names.items()}
    joins = given.get("join", {})
    return replace(base, connection=links, letters_bonus=float(joins.get("alpha_kanji_bonus", base.letters_bonus)), user_bonus=float(given.get("split", {}).get("user_dict_bonus", base.user_bonus)))
