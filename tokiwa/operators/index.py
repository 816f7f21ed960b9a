"""Inverted index and ranked search over tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct (query, tag) rows up to which they go to every worker; more meet the documents' tags in a sort-merge join.
MOST_SENT = 1_000_000


def postings(tokens: DataFrame, key: str = "doc_id", min_length: int = 2) -> DataFrame:
    """(tag, key, tf): how often each document has each tag."""
    return tokens.where(F.length("surface") >= min_length).groupBy(F.col("surface").alias("tag"), key).agg(F.count("*").alias("tf"))


def inverted_index(post: DataFrame, key: str = "doc_id", width: int = 65_536) -> DataFrame:
    """(tag, block, doc_ids, n): each tag's documents in order, a row for each `width` consecutive ids that has any.

    So a row is bounded however common its tag is; a null key is in a block of its own. A tag's document frequency is the
    sum of n over its blocks.
    """
    block = F.floor(F.col(key) / width).cast("long").alias("block")
    return post.groupBy("tag", block).agg(F.sort_array(F.collect_list(key)).alias("doc_ids"), F.count("*").alias("n"))


def search(query_tags: DataFrame, doc_tags: DataFrame, key: str = "doc_id", top: int | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """(query_id, key, score): a point for each of the query's distinct tags that the document has; best first.

    query_tags: (query_id, tag); doc_tags: (key, tags), tags an array without repeats. Up to most_sent query tags are sent to
    the documents, whose tags stay where they are: what is shuffled is a count for each query and document that share a
    tag, and with `top` those counts are cut to each partition's best before the last shuffle.
    """
    asked = query_tags.select("query_id", "tag").distinct()
    asked = F.broadcast(asked) if asked.count() <= most_sent else asked.hint("merge")
    tags = doc_tags.select(key, F.explode_outer("tags").alias("tag")).where(F.col("tag").isNotNull())
    scored = tags.join(asked, "tag").groupBy("query_id", key).agg(F.count("*").alias("score"))
    if top is None:
        return scored
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("search_rank", best).where(F.col("search_rank") <= top)
