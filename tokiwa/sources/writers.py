"""Writers: morphemes and tags as text, JSON, TSV and a table with Japanese names. Each gives a one-column DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokiwa.functions.names import form_name, pos_ja, type_name

END = "EOS"


def _lines(morphemes: str, cells: list) -> Column:
    return F.transform(morphemes, lambda m: F.concat_ws("\t", *[c(m) for c in cells]))


def as_text(df: DataFrame, morphemes: str = "morphemes") -> DataFrame:
    """surface, part of speech and lemma, a line each."""
    return df.select(F.explode(_lines(morphemes, [lambda m: m["surface"], lambda m: m["pos"], lambda m: m["lemma"]])).alias("value"))


def as_tags(df: DataFrame, tags: str = "tags") -> DataFrame:
    """tag and part of speech, a line each."""
    return df.select(F.explode(_lines(tags, [lambda t: t["tag"], lambda t: t["pos"]])).alias("value"))


def as_tsv(df: DataFrame, morphemes: str = "morphemes") -> DataFrame:
    """surface, part of speech, lemma, start and end, a line each."""
    return df.select(F.explode(_lines(morphemes, [lambda m: m["surface"], lambda m: m["pos"], lambda m: m["lemma"], lambda m: m["start"].cast("string"), lambda m: m["end"].cast("string")])).alias("value"))


def as_json(df: DataFrame, text: str = "text", morphemes: str = "morphemes") -> DataFrame:
    """{"input", "morphemes"} a line for each document."""
    short = F.transform(morphemes, lambda m: F.struct(m["surface"].alias("surface"), m["pos"].alias("pos"), m["lemma"].alias("lemma")))
    return df.select(F.to_json(F.struct(F.col(text).alias("input"), short.alias("morphemes"))).alias("value"))


def as_chasen(df: DataFrame, morphemes: str = "morphemes") -> DataFrame:
    """surface, no reading (*), lemma, Japanese part of speech, conjugation type and form (or *); EOS after each document."""
    star = lambda m: F.lit("*")
    filled = lambda c: F.when(F.length(c) > 0, c).otherwise("*")
    kind = lambda m: filled(type_name(m["conj_type"], japanese=True))
    form = lambda m: F.when(m["conj_form"].isNull(), "*").otherwise(form_name(m["conj_form"], japanese=True))
    lines = _lines(morphemes, [lambda m: m["surface"], star, lambda m: m["lemma"], lambda m: pos_ja(m["pos"]), kind, form])
    return df.select(F.explode(F.concat(lines, F.array(F.lit(END)))).alias("value"))


def write_text(df: DataFrame, path: str) -> None:
    """One line a row, as the rows come."""
    df.select("value").write.text(path)


def write_dictionary(entries: DataFrame, path: str) -> None:
    """A dictionary table, range-dealt and sorted by surface so that readers skip what they don't look for."""
    entries.repartitionByRange("surface").sortWithinPartitions("surface", "pos").write.parquet(path)


def write_dictionary_tsv(entries: DataFrame, path: str) -> None:
    entries.select(F.concat_ws("\t", "surface", "pos", F.when(F.col("conj_type") != "", F.col("conj_type"))).alias("value")).write.text(path)
