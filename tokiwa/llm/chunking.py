"""Document fingerprints from content-defined chunks."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Chunking:
    """Chunk lengths in bytes; before `normal` bytes a boundary needs `strict` zero bits, from there on `loose`."""

    least: int = 24
    normal: int = 48
    most: int = 192
    strict: int = 7
    loose: int = 4
    seed: int = 20240

    def gear(self) -> np.ndarray:
        """256 random words, from a rule: splitmix64 of seed * 256 + byte."""
        with np.errstate(over="ignore"):
            z = (np.arange(256, dtype=np.uint64) + np.uint64(self.seed * 256)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: bytes, gear: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + gear[byte] after each byte, in 32 bits.

    A byte has left the hash after 32 more, so h is a sum over 32 bytes; sums over 1, 2, 4, 8, 16 and 32 bytes double.
    """
    h = gear[np.frombuffer(data, dtype=np.uint8)]
    for width in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h = longer
    return h


def boundaries(data: bytes, how: Chunking, gear: np.ndarray) -> list[int]:
    """The ends of the chunks of data."""
    h = gear_hashes(data, gear)
    top = lambda bits: (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist()
    strict, loose = top(how.strict), top(how.loose)
    ends, at, n = [], 0, len(data)
    i = j = 0
    while n - at > how.least:
        normal, most = min(at + how.normal, n), min(at + how.most, n)
        i = bisect_left(strict, at + how.least, i)
        if i < len(strict) and strict[i] < normal:
            at = strict[i]
        else:
            j = bisect_left(loose, normal, j)
            at = loose[j] if j < len(loose) and loose[j] < most else most
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunk_set(text: str, how: Chunking, gear: np.ndarray) -> dict[int, int]:
    """Digest of each distinct chunk to its length in bytes."""
    import xxhash

    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return {}
    digest, found, at = xxhash.xxh3_64_intdigest, {}, 0
    for end in boundaries(data, how, gear):
        found[digest(data[at:end])] = end - at
        at = end
    return found


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The part of a's length whose chunks are in b too; 1 if both are empty, 0 if one is."""
    if not a or not b:
        return float(a == b)
    return sum(map(a.__getitem__, a.keys() & b.keys())) / sum(a.values())


def written(chunks: dict[int, int]) -> str:
    """The set as text: a 12-digit digest and the length of each chunk, in order of digest."""
    return ",".join(f"{d >> 16:012x}:{n}" for d, n in sorted(chunks.items()))


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many code points (or all) from the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: What rows are in order of: whether there is a doc_id (nulls first), the doc_id, and a hash of the text.
PLACE = "struct<known:boolean,doc_id:bigint,hash:bigint>"


def bounds(docs: DataFrame, n: int, buckets: int) -> list[tuple[bool, int, int]]:
    """Places after which buckets end, in order: approximate quantiles of doc_id, and for a doc_id of many rows of the hash.

    How often a doc_id is among the quantiles says how many buckets its rows are worth; rows without one are counted.
    """
    if buckets < 2:
        return []
    row = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 100_000).alias("q"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    least, most = -(1 << 63), (1 << 63) - 1
    parts = lambda known, doc_id, k: [(known, doc_id, least + (i << 64) // k) for i in range(1, k)] + [(known, doc_id, most)]
    out = parts(False, 0, -(-row["nulls"] * buckets // n)) if row["nulls"] else []
    for doc_id, times in sorted(Counter(row["q"] or []).items()):
        if times > 1:  # the rows before it end apart
            out.append((True, doc_id - 1 if doc_id > least else doc_id, most if doc_id > least else least))
        out += parts(True, doc_id, times)
    return sorted(set(out))


def bucket_of(place: Column, ends: list[tuple[bool, int, int]]) -> Column:
    """How many of the sorted ends are below place, by bisection."""
    if not ends:
        return F.lit(0)
    known, doc_id, digest = (F.lit(list(x)).cast(f"array<{t}>") for x, t in zip(zip(*ends, strict=True), ("boolean", "bigint", "bigint"), strict=True))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        k, d, h = F.get(known, middle), F.get(doc_id, middle), F.get(digest, middle)
        under = (k < place["known"]) | ((k == place["known"]) & ((d < place["doc_id"]) | ((d == place["doc_id"]) & (h < place["hash"]))))
        below = F.coalesce(under, F.lit(False))
        return F.struct(F.when(below, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(ends).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(ends)).alias("hi")), halve)["lo"]


def neighbours(docs: DataFrame, per_bucket: int = 250, most_buckets: int = 20_000) -> DataFrame:
    """Rows of docs dealt to buckets of consecutive places, sorted: bucket, ahead, doc_id, text, place.

    Rows are in order of doc_id (nulls first), those of one doc_id of a hash of their texts. Bucket bounds are approximate
    quantiles of that order, so buckets are even whatever the ids, be one of them that of a third of all rows; each bucket
    also gets, with ahead = 1, the rows of the first place of the next non-empty bucket (the first bucket's for the last).
    So every row's follower is in its own bucket, and the texts are shuffled once. The driver gets a bound and a row for
    each bucket, of which there are at most about twice most_buckets; a bucket's rows are only sorted and streamed.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("hash"))
    n = docs.select("doc_id").count()
    ends = bounds(docs, n, max(1, min(most_buckets, n // per_bucket)))
    placed = docs.withColumn("place", place).withColumn("bucket", bucket_of(F.col("place"), ends))
    firsts = sorted((r["bucket"], r["least"]) for r in placed.groupBy("bucket").agg(F.min("place").alias("least")).collect())  # a row a bucket
    ahead = [(tuple(least), firsts[i - 1][0]) for i, (_, least) in enumerate(firsts)]
    more = F.broadcast(docs.sparkSession.createDataFrame(ahead, f"first {PLACE}, to int"))  # a row a bucket
    doubled = placed.join(more, placed["place"] == more["first"]).select(F.col("to").alias("bucket"), F.lit(1).alias("ahead"), "doc_id", "text", "place")
    return placed.select("bucket", F.lit(0).alias("ahead"), "doc_id", "text", "place").union(doubled)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compare(docs: DataFrame, how: Chunking = Chunking()) -> DataFrame:
    """Fingerprint every row of docs (doc_id, text; others are ignored) and compare it with its edited text and its follower.

    Returns doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. A
    fingerprint is the set of the text's distinct chunks, each a digest and a length; the likeness of x to y is the part
    of x's length whose chunks y has as well. The follower of a row is the next in order of doc_id (nulls first; rows of
    one doc_id in order of the text's XXH64, then of the text), that of the last row the first. A null text is empty: its fingerprint is the empty
    string, 1 like another empty one and 0 like any other. A text of any length is fingerprinted whole; a worker holds two. A single row follows itself; an empty table gives none.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        gear, before, out = how.gear(), None, []

        def row(doc: tuple, after: tuple) -> tuple:
            changed = edited(doc[2], after[2])
            chunks = chunk_set(changed, how, gear)
            digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            return doc[1], len(doc[2]), digest, written(doc[3]), written(chunks), containment(doc[3], chunks), containment(doc[3], after[3])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(FIELDS)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)], schema=FIELDS)

        for batch in batches:
            for bucket, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                if ahead and before is None:
                    continue  # only the first row ahead is anyone's follower
                text = text.as_py()
                doc = (bucket, doc_id, text, chunk_set(text, how, gear))
                if before is not None and before[0] == bucket:
                    out.append(row(before, doc))
                before = None if ahead else doc
                if len(out) >= 500:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    ordered = neighbours(docs).repartition("bucket").sortWithinPartitions("bucket", "ahead", "place", "text").drop("place")
    return ordered.mapInArrow(walk, SCHEMA)
