"""Helpers shared by the training-data operators: shared-folder tables, numbering, components, block pairs."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of one Arrow batch handed to Python, so that a batch of very long texts stays within a worker's memory.
ARROW_ROWS = 1000
#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Texts may hold 100 KB and more; the default of 10,000 rows a batch would be a GB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release_memory() -> None:
    """Gives what this process has freed back to the system: Arrow's pool and the C library keep it otherwise, until a worker or the driver ends."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the GNU C library only
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (tests) one of our own where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        found = sc.getCheckpointDir()
    return found


def settle(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: cuts lineage, and lost executors lose none of it.

    What was shuffled for it is deleted as soon as it is written, instead of when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that settle() wrote and that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    for f in df.inputFiles()[:1]:
        path = hadoop.Path(f).getParent()
        if path.getName().startswith("table-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """Input columns named like an output column give way to it (case-insensitively, as Spark resolves names)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def number_rows(df: DataFrame, key: str, ident: list[str], counts: DataFrame, out: str, chunk_rows: int = 1000) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each ``key`` (not null), gapless, the same at every run.

    counts has (key, n) for every key, n its rows. A key's rows are dealt into
    chunks of about chunk_rows by a hash of ``ident``; each chunk is numbered on
    its own and starts where the chunks before it end. So no task ever holds a
    whole key, however hot.
    """
    df = df.join(counts.select(F.col(key), F.col("n").alias("__n")), key)
    chunk = F.pmod(F.xxhash64(*ident), F.greatest(F.lit(1), F.ceil(F.col("__n") / chunk_rows))).cast("long")
    df = df.withColumn("__chunk", chunk).drop("__n")
    sizes = df.groupBy(key, "__chunk").agg(F.count(F.lit(1)).alias("__m"))
    base = sizes.select(key, "__chunk", (F.sum("__m").over(W.partitionBy(key).orderBy("__chunk")) - F.col("__m")).alias("__base"))
    rank = F.row_number().over(W.partitionBy(key, "__chunk").orderBy(*ident))
    return df.join(base, [key, "__chunk"]).withColumn(out, F.col("__base") + rank - 1).drop("__base", "__chunk")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id that occurs in edges (u, v; longs): component is the smallest id reachable.

    Alternating large-star and small-star rounds (each one aggregation and one
    join), settled in the shared folder after each, until no edge changes. Nothing
    is collected but a checksum.
    """
    e = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    stamp = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hop.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = settle(small)
        row = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(e)
        e = new
        if tuple(row) == stamp:
            break
        stamp = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("u"), F.col("v")).distinct()
    return e.unionByName(roots).select(F.col("u").alias("id"), F.col("v").alias("component"))


def count_of(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def block_pairs(touch: DataFrame, group: list[str]) -> DataFrame:
    """(a, b): the different pairs of blocks (a <= b, of any type) that meet in some ``group``; touch has group and ``block``.

    A join streams them, so that the pairs of a group's many blocks are never one row.
    """
    met = touch.select(*group, "block").distinct()
    pairs = met.withColumnRenamed("block", "a").join(met.withColumnRenamed("block", "b"), group).filter("a <= b")
    return pairs.select("a", "b").distinct()


def paired_rows(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """members (with ``block``) once for each pair that its block is part of, with ``pair`` and ``side`` (0 or 1)."""
    pair = F.struct("a", "b").alias("pair")
    sides = pairs.select(pair, F.lit(0).alias("side"), F.col("a").alias("block")).unionByName(pairs.filter("a <> b").select(pair, F.lit(1).alias("side"), F.col("b").alias("block")))
    return members.join(sides, "block")


def summarize_links(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, component, class_id, n_links) for each class (key, copies, ident) of equal members.

    found: (u, v, links): ``links`` more members are linked with each of u's, and v
    is a key in u's component (or u). class_id: the smallest ident in the component.
    """
    found = settle(found)
    links = found.groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("links"))
    parts = components(found.select("u", "v")).withColumnRenamed("id", "key")
    both = classes.join(parts, "key", "left").join(links, "key", "left")
    both = settle(both.select("key", "copies", "ident", F.coalesce("component", "key").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    low = both.groupBy("component").agg(F.min("ident").alias("class_id"))
    return both.join(low, "component").select("key", "component", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
