"""Proportional stratified interleaving of rows over shards, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import cut
from shelfmark.llm.merkle import _ranked

LAW = "rows"
HASH_BITS = 60


def interleave(docs: DataFrame, shards: int = 8, seed: int = 20240201, id_col: str = "doc_id",
               text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """Every row of docs gets a shard and a slot; shard sizes are at most one row apart.

    Rows of a stratum are put in an order drawn from the seed (hash of seed, id and text checksum). The k-th of n
    rows lies at (k - 1/2) / n of the unit interval; all rows are laid out by that fraction and cut into equal runs.
    A shard so holds each stratum in its share, within a row. Null strata form one stratum; null and empty texts
    have size 1 and checksum 0; repeated rows each get a slot of their own. Other columns are not read.

    Texts are read once, for their size and checksum. Both rankings are range partitionings of the narrow rows that are
    left, with ties spread too, so neither a stratum with most of the rows nor any number of strata of one row each
    (which all lie at one half) is ordered in one task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum"))
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                              F.col("text_crc32").cast("string")))
    base = base.withColumn("drawn", F.conv(F.substring(drawn, 1, HASH_BITS // 4), 16, 10).cast("long"))
    base = cut(base)
    rows = max(base.count(), 1)
    order = ["drawn", "doc_id", "size"]
    ranked = _ranked(base.withColumnRenamed("stratum", "tree"), order)
    placed = ranked.select(F.lit("").alias("tree"), ((F.col("rank") + 0.5) / F.col("n")).alias("fraction"),
                           F.col("tree").alias("stratum"), *order, "text_crc32")
    placed = _ranked(placed, ["fraction", "stratum", *order]).withColumn("place", F.col("rank") + 1)
    placed = placed.withColumn("shard", F.expr(f"CAST((place - 1) * {shards} DIV {rows} AS INT)"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        F.expr(f"place - 1 - (shard * {rows}L + {shards - 1}) DIV {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
