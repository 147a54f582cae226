"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of the warehouse, which is shared too, where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back: the lineage ends there, and a lost executor
    costs a read, not a second computation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames made by cut() that nothing reads any more."""
    for df in frames:
        hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def beside(df: DataFrame, size: Column, limit: int = 16_000_000) -> DataFrame:
    """A frame to join a large one with, cut first: broadcast when its measured size (the sum of `size`, bytes a row)
    is within the limit, joined by a shuffle otherwise."""
    df = cut(df)
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; links has a and b (long). component: the smallest reachable node.

    Large-star and small-star rounds: each node's neighbours are hung under their least node until nothing moves.
    Every step is a join or an aggregation on a node; minima combine before the shuffle, joins with a busy node
    can be split. Rounds grow with the logarithm of the longest chain.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.join(least, edges["a"] == least["u"]).select("m", "b").where("m < b")
        large = large.select(F.col("m").alias("a"), "b").distinct()
        top = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(top, large["b"] == top["u"])
        hung = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b")
        last, edges = edges, cut(hung.distinct())
        discard(last)
        after = _mark(edges)
        if after == before:
            break
        before = after
    leaves = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return leaves.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
