"""Session helpers shared by the corpus operators: lineage cuts in the shared folder, Arrow batch limits, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, `spark.checkpoint.dir`; where it is unset, a temporary one for a local
    master, else an error, since executors don't see each other's folders."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, limit: int = ARROW_BATCH_BYTES) -> None:
    """Holds Arrow batches under `limit` bytes, so that long texts can't gather in one batch (a single longer text still goes alone)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, "268435456")).lower().removesuffix("b") or 0) > limit:
        spark.conf.set(key, str(limit))


_slot: dict = {}


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library


def trim() -> None:
    """Returns freed memory to the system: allocators hold on to it, and containers are bounded by what is held. About 2 ms."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def give_back() -> None:
    """`trim` after a collection of garbage."""
    gc.collect()
    trim()


def kept(name, make: Callable[[], object]):
    """The one large object that this Python process keeps from task to task, made if it isn't there. Workers are reused by one
    operator after another; each one's object takes the place of the last, so they don't add up."""
    if name not in _slot:
        _slot.clear()
        give_back()
        _slot[name] = make()
    return _slot[name]


def let_go() -> None:
    """Frees the large object that this process keeps, for tasks that have no use for it but come to the same worker."""
    if _slot:
        _slot.clear()
        give_back()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and rows that df's plan reads, as the optimizer knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def few(df: DataFrame, for_each_core: int = 4, file_bytes: int = 64 << 20) -> DataFrame:
    """df in at most so many partitions for each core of the cluster, or one for each `file_bytes` of input where that is more, so
    that no task grows with the input; a task takes its partitions one after the other."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(for_each_core * cores, min(input_bytes(df) // file_bytes, 1_000_000)))


def cut(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back: later stages restart from that table, not from df's lineage.

    files: at most so many files, for a table known to be small; else a few for each core.
    """
    spark = df.sparkSession
    df = few(df) if files is None else df.coalesce(min(files, 2 * spark.sparkContext.defaultParallelism))
    path = f"{shared_folder(spark).rstrip('/')}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the table of a `cut` that nothing reads any more."""
    path = getattr(df, "_quill_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row.n, row.h


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a > b): links each node's neighbours to the smallest label it sees.

    The smallest neighbour comes from a map-side-combined aggregate and goes back by an inner join that adaptive execution
    may split, so a node of very high degree never gathers in one task.
    """
    if large:
        ways = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ways = edges
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = ways.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select("b", "m").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b: bigint): one row (node, root) for each node that has an edge, root the smallest node.

    Alternates large-star and small-star steps until the edge set stands still. Every step is written to the shared folder,
    so a lost executor repeats one step at most; nothing is collected but a count and a checksum.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = _fingerprint(now)
    while seen[0]:
        grown = cut(_star(_star(now, True), False), name, 2 + seen[0] // 50_000)  # steps never add edges
        mark = _fingerprint(grown)
        discard(now)
        now = grown
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
