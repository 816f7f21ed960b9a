"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokiwa.llm.common import cut

#: A Poisson variable of a larger mean is drawn as the sum of several of at most this mean.
MOST_MEAN = 256.0


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float) -> DataFrame:
    """(source, rate, parts, cdf): the mean number of copies that brings each source to its weight.

    A source's size is its code points over all its rows. rate = epochs * weight / (sum of weights) * total / size; a
    source whose texts are all empty has rate 0. cdf: the cumulative Poisson probabilities of mean rate / parts.
    """
    size = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size")
    weight = F.lit(1.0) if weights is None else F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in weights.items()], F.lit(0.0))
    sizes = cut(docs.groupBy("source").agg(size).withColumn("weight", weight), "source-sizes")
    total, weight_sum = sizes.agg(F.sum("size"), F.sum("weight")).first()
    rate = F.when(F.col("size") > 0, F.lit(epochs) * (F.col("weight") / F.lit(weight_sum or 1.0)) * F.lit(float(total or 0)) / F.col("size")).otherwise(F.lit(0.0))
    rates = sizes.select("source", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("int"))
    rates = rates.withColumn("mean", F.col("rate") / F.col("parts"))
    steps = F.sequence(F.lit(1), (F.ceil(F.col("mean") + 12 * F.sqrt("mean")) + 20).cast("int"))
    zero = F.exp(-F.col("mean"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return rates.select("source", "rate", "parts", F.aggregate(steps, F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("all")), step)["all"].alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """Replicate every row of docs so that sources come to their target weights, in a globally shuffled order.

    weights: source to weight (others 0); None: all sources alike. The number of copies of a row is the inverse of the
    Poisson distribution of its source's rate at a uniform number hashed from seed, doc_id and text, so a rerun, or a lost
    executor, draws the same, and rows that share a doc_id, or have none, draw apart. Returns the columns of docs (names
    that clash with `copy` or `shuffle_key` in whatever case are replaced), copy (from 1) and shuffle_key; rows are dealt
    out by shuffle_key and sorted by it within partitions. A null source is a source of its own; a null doc_id hashes as
    the word null; rows equal in doc_id and text get as many copies each; a null or empty text adds nothing to its source's
    size but is replicated like the rest; a text of any length is only hashed and carried; an empty table gives an empty result. No source's rows are ever gathered: a hot source meets
    its rate in a join whose other side has a row per source (broadcast only while Spark finds it small, else a
    sort-merge join with skewed partitions split).
    """
    kept = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    rates = source_rates(docs, weights, epochs).withColumnRenamed("source", "_source")
    rows = docs.select(F.struct(*kept).alias("row"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))  # so that no column of docs clashes with those made here
    doc_id, digest = F.col("row.doc_id"), F.col("digest")
    drawn = rows.join(rates, F.col("row.source").eqNullSafe(F.col("_source"))).withColumn("u", uniform(seed, doc_id, digest, F.lit(1)))
    single = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    more = lambda j: F.size(F.filter("cdf", lambda c: c <= uniform(seed, doc_id, digest, j)))
    several = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, j: n + more(j))
    counted = drawn.withColumn("n", F.when(F.col("parts") == 1, single).otherwise(several)).where("n > 0")
    copies = counted.select("row", "digest", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), digest, F.col("copy").cast("string"), F.lit("order")))
    dealt = copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key", "row.doc_id", "copy")
    return dealt.select("row.*", "copy", "shuffle_key")
