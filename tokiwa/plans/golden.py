"""Golden cases: expected tokens beside those of an engine, what differs, and reports over files of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokiwa.functions.text import fold_width
from tokiwa.operators.analyze import Engine


def difference(expected: Column, actual: Column) -> Column:
    """How two arrays of surfaces differ: same, empty, minor (only in width), over-split, under-split or boundary."""
    narrow = lambda xs: fold_width(F.array_join(xs, " "))
    n, m = F.size(expected), F.size(actual)
    out = F.when((n < 1) | (m < 1), "empty").when(expected == actual, "same").when(narrow(expected) == narrow(actual), "minor")
    return out.when(m > n, "over-split").when(m < n, "under-split").otherwise("boundary")


def missing_and_extra(expected: Column, actual: Column) -> Column:
    """struct<missing, extra>: what only one of two sets of tags has."""
    return F.struct(F.array_except(expected, actual).alias("missing"), F.array_except(actual, expected).alias("extra"))


def with_tag(cases: DataFrame, tag: str) -> DataFrame:
    """The cases that carry a tag."""
    return cases.where(F.array_contains("tags", tag))


def compared(cases: DataFrame, engine: Engine = Engine()) -> DataFrame:
    """cases (input, expected: array<struct<surface, pos, lemma>>) with actual, difference, and whether parts of speech and lemmas are right.

    As in the cases' own rules, a part of speech or lemma counts only where a case states one.
    """
    got = cases.withColumn("actual", engine.analyze(F.col("input")))
    surfaces = lambda name: F.transform(name, lambda t: t["surface"])
    right = lambda field: F.forall(F.arrays_zip(F.col("expected").alias("e"), F.col("actual").alias("a")), lambda z: (F.coalesce(F.length(z["e"][field]), F.lit(0)) == 0) | (z["e"][field] == z["a"][field]))
    out = got.withColumn("difference", difference(surfaces("expected"), surfaces("actual"))).withColumn("surfaces_right", F.col("difference") == "same")
    return out.withColumn("pos_right", F.col("surfaces_right") & right("pos")).withColumn("lemmas_right", F.col("pos_right") & right("lemma"))


def report(compared_cases: DataFrame, by: str = "file") -> DataFrame:
    """(by, n, surfaces, pos, lemmas): cases and how many are right, by file or another column."""
    count = lambda c: F.count_if(F.col(c))
    return compared_cases.groupBy(by).agg(F.count("*").alias("n"), count("surfaces_right").alias("surfaces"), count("pos_right").alias("pos"), count("lemmas_right").alias("lemmas"))


def positions(cases: DataFrame) -> DataFrame:
    """(pos, n): expected tokens by part of speech."""
    return cases.select(F.explode("expected").alias("t")).groupBy("t.pos").agg(F.count("*").alias("n"))


def repeated_ids(cases: DataFrame) -> DataFrame:
    """(id, n) of ids that more than one case has."""
    return cases.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
