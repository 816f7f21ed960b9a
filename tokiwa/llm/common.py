"""What the operators of this subpackage share: tables, the shared folder, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tokiwa-")
    return _LOCAL[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and the work is done once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._cut_path = path
    return found


def discard(df: DataFrame) -> None:
    """Delete what cut wrote for df, as all that was made of it has been written or collected; any other df stays."""
    path = getattr(df, "_cut_path", None)
    if path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over; it does so once their plans are collected as garbage."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.2)  # for the plans' proxies to be let go
        spark.sparkContext._jvm.System.gc()


def tidy() -> None:
    """Give a Python worker's freed memory back to the system, as workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps or returns memory in its own way


def slices(batch: pa.RecordBatch, column: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows of about at_once bytes of text, so that what a worker makes of them at a time stays small."""
    at = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        size += n
        if size >= at_once:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text modulo parts; null where doc_id is null."""
    return F.crc32(doc_id.cast("string")) % parts


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of the nodes in edges (a, b), component the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes; the rounds grow with the logarithm of the
    component size. Nothing is collected but one count and one checksum a round, and each round is cut. A hub's rows
    meet only in a minimum (combined before the shuffle) and in a sort-merge join (whose skewed partitions are split).
    What a round wrote is deleted when the next is written.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        done, edges = edges, cut(small.where("a <> b").distinct(), name)
        discard(done)
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
