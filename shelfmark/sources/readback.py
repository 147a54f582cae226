"""Reading the canonical state back: child rows beside their parents, and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def child_rows(parents: DataFrame, children: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Parents with their children as rows, one per child and one for a parent without any.

    ``order`` numbers the children of a parent; sort by it where order matters. Nothing is gathered by parent, so a
    parent may have any number of children, and a short list of parents meets the children without grouping them.
    """
    own = children.select(key, *dict.fromkeys([order, *fields]))
    return parents.join(own, key, "left")


def metadata_state() -> Column:
    """Three states of a file's metadata: failed, read, or never probed."""
    return (
        F.when(F.col("media_info_error").isNotNull(), "ERROR")
        .when(F.col("media_info_probed_at").isNotNull(), "OK")
        .otherwise("NOT_PROBED")
    )


def canonical_files(files: DataFrame, tracks: DataFrame | None = None, fields: list[str] = ()) -> DataFrame:
    """ACTIVE files with their metadata state and, from a flat track table, a row per track.

    A state table that nests tracks on the file row needs no ``tracks`` and no join.
    """
    active = files.where(F.col("state") == "ACTIVE").withColumn("metadata_state", metadata_state())
    if tracks is None:
        return active
    return child_rows(active, tracks, "media_file_id", "track_index", ["kind", *fields])


def report_totals(files: DataFrame) -> DataFrame:
    """Files and bytes per category."""
    return files.groupBy("category").agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"))


def write_report(files: DataFrame, path: str, category: str | None = None) -> None:
    """The inventory report as JSON lines, one folder per category, with its totals beside it.

    A category can hold most of the library, so its files are never gathered into one JSON
    document; readers take the folder of the category they want.
    """
    scope = files if category is None else files.where(F.col("category") == category)
    scope.write.mode("overwrite").partitionBy("category").json(f"{path}/files")
    report_totals(scope).write.mode("overwrite").json(f"{path}/totals")
