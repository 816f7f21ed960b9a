"""A corpus pipeline of five of the operators; each stage works on the Parquet that the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokiwa.llm import langid, mixing, packing, secrets, simhash
from tokiwa.llm.common import cut, discard, release, table
from tokiwa.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose language is less certain than this, or undetermined, go.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the texts whose language is known; those with no letter, null or empty ones, or of no one language, go.

    A null lang becomes the predicted one; any other stays. Rows with a null doc_id and repeated rows are judged like any
    other; an empty table stays empty. Columns other than COLUMNS are dropped, here as in every stage.
    """
    judged = langid.identify(docs.select(*COLUMNS))
    known = judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate class: that with the least doc_id, a null one last, then by a hash of the text.

    Rows are told apart by doc_id and text, so rows that share a doc_id, or have none, are kept or not each by itself; of
    rows equal in both one stays. Null, empty and blank texts are one class; an empty table stays empty.
    """
    found = simhash.classes(docs.select("doc_id", "text"))
    counted = found.groupBy("class_fp", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    least = counted.groupBy("class_fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")).alias("k"))
    keepers = cut(least.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"), F.col("k.n").alias("_n")), "keepers").hint("merge")  # the texts are dealt by them alike at every size
    release(spark)
    rows = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("_h"))
    kept = rows.join(keepers, (F.col("_h") == F.col("_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")))
    once, often = kept.where("_n = 1").select(*COLUMNS), kept.where("_n > 1").dropDuplicates(["doc_id", "_h"]).select(*COLUMNS)
    return once.union(often)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by a mark, and count n_chars anew where there was one.

    All rows stay; a null or empty text, or one without a secret, stays as it is, as does its n_chars. Repeated rows and
    null doc_ids are treated alike; an empty table stays empty.
    """
    scanned = secrets.scan(docs.select(*COLUMNS))
    clean = scanned.withColumn("_clean", secrets.redacted(F.col("text"), F.col("spans")))
    changed = F.size("spans") > 0
    return clean.select("doc_id", F.col("_clean").alias("text"), "lang", "source", F.when(changed, F.length("_clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring all sources to the same weight by replication, and shuffle.

    A null source is a source of its own; rows with a null text or doc_id, and repeated rows, are drawn as `mixing.mix` says;
    an empty table stays empty.
    """
    release(spark)
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left, each copy by itself: a row for each piece. A null or empty text is its end id; an empty table gives none."""
    release(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language_stage), ("dedup", dedup_stage), ("secrets", secrets_stage), ("mix", mix_stage), ("pack", pack_stage)]

#: The stages run learned models, a tokenizer and an iteration, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each stage's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done, docs = docs, cut(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(done)
    return STAGES[-1][1](spark, docs, sf_dir)
