"""Conjugation and inflection as DataFrame operators: expressions and joins with small fixed tables; UDFs for the reverse."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokiwa.grammar import conjugation as tables
from tokiwa.grammar import inflection

INFLECTED = "struct<base:string,stem:string,suffix:string,kind:string,form:string,confidence:double>"


def detect_type(base: Column) -> Column:
    """The conjugation type that a dictionary form's ending suggests; UNKNOWN if none."""
    last = F.substring(base, -1, 1)
    out = F.lit("UNKNOWN")
    for ending, row in tables.BY_ENDING.items():
        out = F.when(last == ending, row.kind).otherwise(out)
    out = F.when((last == "る") & (F.length(base) > 1) & F.substring(base, -2, 1).isin(*tables.ICHIDAN_BEFORE_RU), "ICHIDAN").otherwise(out)
    out = F.when(last == "い", "I_ADJ").otherwise(out)
    return F.when(base.isin("来る", "くる"), "KURU").when(base.endswith("する"), "SURU").otherwise(out)


def stem(base: Column, kind: Column) -> Column:
    """base without its conjugating ending: one kana, or する."""
    return F.when(kind == "SURU", F.substr(base, F.lit(1), F.greatest(F.length(base) - 2, F.lit(0)))).otherwise(F.substr(base, F.lit(1), F.greatest(F.length(base) - 1, F.lit(0))))


def _joined(rows: DataFrame, table: DataFrame, base: str, kind: str) -> DataFrame:
    """rows with the table's forms of their type; a row whose type has none keeps its base form, as form 0."""
    out = rows.join(F.broadcast(table), F.col(kind) == F.col("_kind"), "left")
    return out.withColumn("form", F.coalesce(F.concat(stem(F.col(base), F.col(kind)), F.col("_suffix")), F.col(base))).withColumn("form_id", F.coalesce("form_id", F.lit(0)))


def conjugated(rows: DataFrame, base: str = "surface", kind: str = "conj_type") -> DataFrame:
    """rows with form_id, suffix and form: a row for each form. The table is fixed (under 300 rows), so it is broadcast.

    Rows of a type that doesn't conjugate, or of none, stay, with their base form alone and a null suffix.
    """
    forms = [(k, i, s) for k in tables.TYPE_NAMES for i, s in enumerate(tables.suffixes(k))]
    table = rows.sparkSession.createDataFrame(forms, "_kind string, form_id int, _suffix string")
    return _joined(rows, table, base, kind).withColumnRenamed("_suffix", "suffix").drop("_kind")


def entry_forms(rows: DataFrame, base: str = "surface", kind: str = "conj_type") -> DataFrame:
    """rows with the forms that a dictionary keeps as entries and their categories: form_id, form, extended_pos."""
    forms = [(k, i, s, e) for k in tables.TYPE_NAMES for i, (s, e) in enumerate(tables.entry_suffixes(k))]
    table = rows.sparkSession.createDataFrame(forms, "_kind string, form_id int, _suffix string, extended_pos string")
    return _joined(rows, table, base, kind).drop("_kind", "_suffix")


def stem_forms(rows: DataFrame, base: str = "surface", kind: str = "conj_type") -> DataFrame:
    """rows with the stems that take auxiliaries: form_id, form, form_name."""
    forms = [(r.kind, i, s, n) for r in tables.GODAN.values() for i, (s, n) in enumerate(((r.u, "BASE"), (r.a, "MIZENKEI"), (r.i, "RENYOKEI"), (r.onbin or r.i, "ONBINKEI")))]
    forms += [(k, i, s, n) for k, stems in tables.STEMS.items() for i, (n, s) in enumerate(stems)]
    table = rows.sparkSession.createDataFrame(forms, "_kind string, form_id int, _suffix string, form_name string")
    return _joined(rows, table, base, kind).drop("_kind", "_suffix")


def endings(spark: SparkSession) -> DataFrame:
    """(ending, base_ending, conj_type, form_name) of every verb ending."""
    return spark.createDataFrame(tables.endings(), "ending string, base_ending string, conj_type string, form_name string")


def auxiliaries(spark: SparkSession) -> DataFrame:
    """(surface, lemma, after, makes) of every form of every auxiliary."""
    return spark.createDataFrame(list(inflection.auxiliaries()), "surface string, lemma string, after string, makes string")


def connection_costs(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """pairs with their cost and whether the right may follow the left."""
    table = pairs.sparkSession.createDataFrame([(a, b, c) for (a, b), c in tables.CONNECTIONS.items()], f"{left} string, {right} string, cost int")
    out = pairs.join(F.broadcast(table), [left, right], "left")
    return out.withColumn("can_connect", F.col("cost").isNotNull()).withColumn("cost", F.coalesce("cost", F.lit(tables.INFINITE)))


def verb_form(surface: Column) -> Column:
    """The category that a verb surface's ending shows."""
    out = F.lit("VERB_連用")
    for ending, name in reversed((("て", "VERB_て形"), ("で", "VERB_て形"), ("ば", "VERB_仮定"), ("た", "VERB_た形"), ("だ", "VERB_た形"), ("たら", "VERB_たら形"), ("だら", "VERB_たら形"), ("ろ", "VERB_命令"), ("よ", "VERB_命令"), ("る", "VERB_終止"))):
        out = F.when(surface.endswith(ending), name).otherwise(out)
    out = F.when(surface.endswith("い"), F.when(surface.rlike("[\\x{4E00}-\\x{9FFF}]"), "VERB_音便").otherwise("VERB_連用")).otherwise(out)
    return F.when(surface == "", "VERB_終止").when(surface.endswith("っ") | surface.endswith("ん"), "VERB_音便").otherwise(out)


def adjective_form(surface: Column, na: Column | None = None) -> Column:
    """The category that an adjective surface's ending shows."""
    out = F.when(surface == "", "ADJ_終止").when(surface.endswith("かっ"), "ADJ_かっ").when(surface.endswith("けれ") | surface.endswith("きゃ"), "ADJ_け形").when(surface.endswith("く"), "ADJ_連用").when(surface.endswith("い"), "ADJ_終止").otherwise("ADJ_語幹")
    return out if na is None else F.when(na, "ADJ_NA").otherwise(out)


# Endings of negated verbs, of passive or causative ones in く and before なった, and of か- verbs in く.
NEGATIVE = "(?:[かがさたばまらわなべめせてねけげれ]|し)ない$"
VOICE_RENYOKEI, VOICE_BECOME, GODAN_RENYOKEI = "[せれ]なく$", "れなくなった$", "かなく$"


def negative_patterns(surface: Column) -> Column:
    """struct<negative, voice_renyokei, voice_become, godan_renyokei>: which of the negative endings a surface has."""
    patterns = {"negative": NEGATIVE, "voice_renyokei": VOICE_RENYOKEI, "voice_become": VOICE_BECOME, "godan_renyokei": GODAN_RENYOKEI}
    return F.struct(*[surface.rlike(p).alias(name) for name, p in patterns.items()])


def inflect(surface: Column) -> Column:
    """Readings of each surface, the likeliest first; null for null."""

    @F.arrow_udf(f"array<{INFLECTED}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("base", pa.string()), ("stem", pa.string()), ("suffix", pa.string()), ("kind", pa.string()), ("form", pa.string()), ("confidence", pa.float64())]))
        for batch in batches:
            yield pa.array([None if s is None else [(r.base, r.stem, r.suffix, r.kind, r.form, r.confidence) for r in inflection.inflect(s)] for s in batch.to_pylist()], kind)

    return run(surface)


def looks_conjugated(surface: Column) -> Column:
    """Whether a surface has a likely reading that isn't its own dictionary form."""

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if s is None else inflection.looks_conjugated(s) for s in batch.to_pylist()], pa.bool_())

    return run(surface)
