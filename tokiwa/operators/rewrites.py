"""Rewrites over the morphemes of a document, as rows (key, token_index, surface, pos, lemma, is_formal_noun)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefixed_verbs(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """A verb after お, ご or 御 is a noun, unless a causative follows; its lemma is its surface."""
    w = Window.partitionBy(key).orderBy("token_index")
    before = (F.lag("pos").over(w) == "PREFIX") & F.lag("surface").over(w).isin("お", "ご", "御")
    causative = F.coalesce(F.lead("extended_pos").over(w) == "AUX_使役", F.lit(False)) if "extended_pos" in rows.columns else F.lit(False)
    flagged = rows.withColumn("_noun", F.coalesce(before & (F.col("pos") == "VERB") & ~causative, F.lit(False)))
    return flagged.withColumn("lemma", F.when(F.col("_noun"), F.col("surface")).otherwise(F.col("lemma"))).withColumn("pos", F.when(F.col("_noun"), "NOUN").otherwise(F.col("pos"))).drop("_noun")


def merged_runs(rows: DataFrame, joins: Column, key: str = "doc_id") -> DataFrame:
    """Merge each maximal run of rows that `joins` holds for; a row outside stays. Gaps and islands, one sort a document."""
    w = Window.partitionBy(key).orderBy("token_index")
    flagged = rows.withColumn("_in", F.coalesce(joins, F.lit(False)))
    starts = flagged.withColumn("_new", F.when(F.col("_in") & F.coalesce(F.lag("_in").over(w), F.lit(False)), 0).otherwise(1))
    islands = starts.withColumn("_island", F.sum("_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct("token_index", "surface", "lemma")))
    joined = lambda name: F.array_join(F.transform(F.col("_parts"), lambda x: x[name]), "")
    out = islands.groupBy(key, "_island").agg(F.min("token_index").alias("token_index"), F.min_by("pos", "token_index").alias("pos"), parts.alias("_parts"))
    return out.select(key, "token_index", joined("surface").alias("surface"), "pos", joined("lemma").alias("lemma"), F.size("_parts").alias("n_parts"))


def compounds(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Join neighbouring nouns that aren't formal nouns."""
    return merged_runs(rows, (F.col("pos") == "NOUN") & ~F.coalesce(F.col("is_formal_noun"), F.lit(False)), key)


def prolonged(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens wholly of ー join the token before, as a single ー, unless that is a symbol or there is none."""
    w = Window.partitionBy(key).orderBy("token_index")
    bar = F.col("surface").rlike("^ー+$")
    # the last row before this one that isn't a bar
    host = F.last(F.when(~bar, F.struct("token_index", "pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("_host", host).withColumn("_joins", bar & F.col("_host").isNotNull() & (F.col("_host.pos") != "SYMBOL"))
    longer = marked.withColumn("_long", F.coalesce(F.lead("_joins").over(w), F.lit(False)) & ~F.col("_joins")).where(~F.col("_joins"))
    add = lambda c: F.when(F.col("_long") & (F.length(c) > 0), F.concat(F.col(c), F.lit("ー"))).otherwise(F.col(c))
    return longer.withColumn("surface", add("surface")).withColumn("lemma", add("lemma")).drop("_host", "_joins", "_long")


def visible(rows: DataFrame, remove_symbols: bool = True, least_bytes: int = 1) -> DataFrame:
    """Without symbols, and without surfaces of fewer bytes; the last rewrite, so that symbols still part compounds."""
    out = rows.where(F.col("pos") != "SYMBOL") if remove_symbols else rows
    return out.where(F.octet_length("surface") >= least_bytes)
