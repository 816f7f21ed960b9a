"""SimHash near-duplicate classes: meet-in-the-middle ball hashing over the halves of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokiwa.llm.common import connected_components, cut

#: Fingerprints that differ in at most this many bits are linked. The emission below is exact for 3 and less.
RADIUS = 3
#: Shingles whose bits are summed at once, so that the unpacked bits stay small for texts of any length.
AT_ONCE = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the text's word shingles; 0 if it has no word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z and splits at \x20\x09-\x0D only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = np.array([digest(b" ".join(words), 42)], dtype=np.uint64)
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
        hashes = np.fromiter((digest(s, 42) for s in shingles), dtype=np.uint64, count=len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part = hashes[at : at + AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, text_hash): fp the fingerprint as a signed long; text_hash tells rows of one doc_id apart."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return rows.mapInArrow(hashed, "doc_id long, fp long, text_hash long")


def links(fps: DataFrame, hot: int = 32) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fps (fp): every two that differ in at most 3 bits are connected.

    One half of two such fingerprints differs in at most one bit. So for each half a fingerprint emits the half itself and
    its 32 neighbours at half the radius; a half meets the neighbours of another in a join on the half, and the whole
    fingerprints that collide are verified. Where over `hot` fingerprints share a half, their other halves decide: there
    the one side emits its other half's ball of radius 1, the other side the ball of what remains of the radius, and each
    links to the least fingerprint that it met, which is verified as well, so that a group of n gives n edges, not n * n.
    Either way no link is lost: two linked fingerprints get an edge, or both an edge to a third.
    Spark's size estimates don't see how far `explode` multiplies rows, so every join here is told to sort and merge.
    """
    low32 = 0xFFFFFFFF
    half = lambda h: F.when(F.lit(h) == 0, F.col("fp").bitwiseAND(low32)).otherwise(F.shiftrightunsigned("fp", 32))
    sides = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), half(h).alias("own"), half(1 - h).alias("other")) for h in (0, 1)])).alias("s")).select("fp", "s.*")
    near = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    exact = sides.select("h", F.col("own").alias("key"), "fp", "other")
    ball = sides.select("h", "own", "fp", "other", F.explode(near).alias("flip")).select("h", F.col("own").bitwiseXOR(F.col("flip")).alias("key"), "fp", "other", F.when(F.col("flip") == 0, RADIUS).otherwise(RADIUS - 1).alias("left"))

    crowded = cut(exact.groupBy("h", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h", "key"), "hot-halves").hint("merge")
    a, b = exact.join(crowded, ["h", "key"], "left_anti").alias("a"), ball.hint("merge").alias("b")
    differ = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    pairs = a.join(b, ["h", "key"]).where((F.col("a.fp") != F.col("b.fp")) & (differ <= RADIUS)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    singles = [0, *[1 << i for i in range(32)]]
    doubles = singles + [(1 << i) | (1 << j) for i in range(32) for j in range(i)]
    flips = lambda masks: F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
    spread = lambda df, masks: df.select("h", "key", "fp", "other", flips(masks).alias("flip")).select("h", "key", F.col("other").bitwiseXOR(F.col("flip")).alias("mid"), "fp")
    centres = spread(exact.join(crowded, ["h", "key"], "left_semi"), singles).groupBy("h", "key", "mid").agg(F.min("fp").alias("centre"))
    met = ball.join(crowded, ["h", "key"], "left_semi")
    met = spread(met.where(F.col("left") == RADIUS), doubles).union(spread(met.where(F.col("left") < RADIUS), singles))
    stars = met.join(centres.hint("merge"), ["h", "key", "mid"]).where((F.col("fp") != F.col("centre")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= RADIUS))
    return pairs.union(stars.select(F.col("centre").alias("a"), F.col("fp").alias("b")))


def classes(docs: DataFrame, width: int = 3, hot: int = 32) -> DataFrame:
    """Near-duplicate classes of docs (doc_id, text; others are ignored): doc_id, fp (signed long), component_id, text_hash, class_fp.

    A row for every row of docs; class_fp, a fingerprint, names the class even where no row of it has a doc_id. Fingerprints within RADIUS bits are linked; component_id is the least doc_id among the
    rows whose fingerprints can be reached (null only if all of those are null). Null or empty texts, and texts of blanks,
    have fingerprint 0 and are linked like any other; a text of any length is hashed whole, its bits summed in runs of
    shingles; repeated rows share a class; an empty table gives an empty result.
    Equal fingerprints are one node, so a group of copies of any size costs one row beyond its own.
    """
    rows = cut(fingerprints(docs, width), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    parts = connected_components(links(nodes.select("fp"), hot), "links")
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = cut(named.join(least, "component").select("fp", "component_id", F.col("component").alias("class_fp")), "classes")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id", "text_hash", "class_fp")
