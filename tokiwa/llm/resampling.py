"""Importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample by their ratio."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokiwa.llm.common import cut, slices
from tokiwa.llm.mixing import uniform


#: Bytes of texts whose n-grams are in memory at once.
AT_ONCE = 8 << 20


@dataclass(frozen=True)
class Settings:
    """most_sent: more good doc_ids than that meet the texts in a sort-merge join instead of going to every worker."""

    buckets: int = 10_000
    most_sent: int = 1_000_000
    smoothing: float = 1.0
    seed: str = "resample"


def ngrams(texts: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and each pair of neighbouring words of texts, and the text that it is in."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))[coded.indices.to_numpy().astype(np.int64)]
    real = np.fromiter((w != "" for w in words), dtype=bool, count=len(words))[coded.indices.to_numpy().astype(np.int64)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    hashed, owner = hashed[real], owner[real]
    with np.errstate(over="ignore"):
        pairs = (hashed[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashed[1:] >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
    same = owner[:-1] == owner[1:]
    every = np.concatenate([hashed, (pairs[same] >> np.uint64(11)) * np.uint64(2) + np.uint64(1)])
    return (every % np.uint64(settings.buckets)).astype(np.int64), np.concatenate([owner, owner[:-1][same]])


def targeted(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """docs with target: whether a label of the doc_id says good quality. All labels count, however many there are."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("target", F.lit(True))
    good = F.broadcast(good) if good.count() <= settings.most_sent else good.hint("merge")
    return docs.join(good, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))


def log_ratios(docs: DataFrame, settings: Settings) -> np.ndarray:
    """By bucket, log p(target) - log p(raw), from the counts over all rows of docs (text, target)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(settings.buckets, np.int64), np.zeros(settings.buckets, np.int64)
        for batch in (part for whole in batches for part in slices(whole, 0, AT_ONCE)):
            bucket, owner = ngrams(batch.column(0), settings)
            raw += np.bincount(bucket, minlength=settings.buckets)
            aimed = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            target += np.bincount(bucket[aimed[owner]], minlength=settings.buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    sums = docs.select("text", "target").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.full(settings.buckets, settings.smoothing), np.full(settings.buckets, settings.smoothing)
    for r in sums:  # a row for each bucket at most
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def top(rows: DataFrame, k: int, bins: int = 10_000, few: int = 1_000) -> DataFrame:
    """The k rows of the highest key (ties: least doc_id), without a global sort.

    Histograms narrow down where the k-th key lies until few rows are left there; only these are ordered.
    """
    n, lo, hi = rows.agg(F.count("*"), F.min("key"), F.max("key")).first()
    if k >= n:
        return rows
    if k <= 0:
        return rows.limit(0)
    over, inside = 0, n  # rows above hi, and from lo to hi
    while inside > few and hi > lo:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            break
        spot = F.least(F.floor((F.col("key") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).alias("bin")
        found = rows.where((F.col("key") >= lo) & (F.col("key") <= hi)).groupBy(spot).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["bin"]):
            if over + r["n"] >= k:
                break
            over += r["n"]
        if (r["lo"], r["hi"]) == (lo, hi):
            break
        lo, hi, inside = r["lo"], r["hi"], r["n"]
    band = rows.where((F.col("key") >= lo) & (F.col("key") <= hi)).orderBy(F.desc("key"), "doc_id").limit(k - over)
    return rows.where(F.col("key") > hi).union(band)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, settings: Settings = Settings()) -> DataFrame:
    """Sample k rows of docs (doc_id, text; others are ignored) in proportion to how much likelier the target model is.

    Each row's log weight is the sum over its words and pairs of words, hashed, of log p(target) - log p(raw); a Gumbel
    variable hashed from doc_id is added, and the k highest sums are the sample: a sample without replacement, the same on
    every run. labels (doc_id, quality 0 or 1): good rows make the target model. k: by default the number of rows times
    the share of good ones among the labelled. Returns doc_id, log_weight and key of the sample. A null, empty or wordless
    text has weight 1 (log 0); repeated rows are counted and may be sampled as often as they come; a null doc_id draws
    like the word null; a text of any length is weighed whole. Without labels of good quality all rows weigh alike, and k is all; an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ratios = log_ratios(targeted(docs, labels, settings), settings)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, AT_ONCE)):
            bucket, owner = ngrams(batch.column(1), settings)
            sums = np.bincount(owner, ratios[bucket], batch.num_rows).astype(np.float64)  # of no n-grams, numpy makes integers
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums)], names=["doc_id", "log_weight"])

    u = uniform(settings.seed, F.col("doc_id"))
    gumbel = -F.log(-F.log((u * float(1 << 52) + 0.5) / float(1 << 52)))
    rows = cut(docs.select("doc_id", "text").mapInArrow(weigh, "doc_id long, log_weight double").withColumn("key", F.col("log_weight") + gumbel), "weights")
    if k is None:
        good = labels.where("quality is not null").agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))).first()[0]
        k = round(rows.count() * (1.0 if not good else good))
    return top(rows, k)
