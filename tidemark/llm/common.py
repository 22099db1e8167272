"""Shared plumbing of the text operators: scratch tables, table access, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of code points other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, read by Spark only (the path may be in any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables: spark.checkpoint.dir. A single-machine session without that
    setting, as in tests, gets a temporary folder; on a cluster its absence is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Spark then drops a query's shuffle files when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write `df` as a Parquet table in the shared scratch folder and return a reader of it.

    This cuts lineage (a lost executor costs no recomputation of what is above) and, unlike an RDD
    checkpoint, keeps column pruning and sizes for the optimizer.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    _forget_at_exit(spark, path)
    return out


_paths: list[tuple[SparkSession, str]] = []


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    if not _paths:
        atexit.register(lambda: [_delete(*p) for p in list(_paths)])
    _paths.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session may have ended; the folder is the cluster's scratch space
        pass


def forget(*frames: DataFrame) -> None:
    """Delete the scratch tables behind `frames`, which nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            _delete(df.sparkSession, path)
            _paths[:] = [p for p in _paths if p[1] != path]


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted: np.unique hashes integers, which takes far longer than sorting them."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def trim() -> None:
    """Give a Python worker's freed memory back, since workers outlive the stage that needed it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Links that a task of a components round handles at least, where there are so many.
LINKS = 50_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph, by alternating large-star and small-star.

    `edges` holds two long columns. Returns (node, component), the component named by its smallest
    node, for every node that has an edge and is not that smallest one. Links never leave the executors. Each round halves
    distances, minima are combined before the shuffle, and the joins are plain sort-merge joins that
    adaptive execution may split, so a node with very many links does not end in one task.
    """
    cur = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    while True:
        before = cur.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before["n"] == 0:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
        # few links are dealt to few tasks, whatever the number of shuffle partitions
        few = max(4, before["n"] // LINKS)
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the joins have plain exchanges on either side, which can be split
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).coalesce(few), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct().coalesce(few), "large")
        down = materialize(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few), "least")
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        nxt = materialize(small.coalesce(few), "edges")
        after = nxt.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        forget(cur, least, large, down)
        cur = nxt
        if (before["n"], before["x"]) == (after["n"], after["x"]):
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
