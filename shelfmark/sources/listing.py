"""Library listings: the media files below each category root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions import paths


def is_listed(relative_path: Column) -> Column:
    """A media file with no hidden, temporary or metadata segment on its path."""
    name = paths.file_name(relative_path)
    folders = F.split(paths.parent_directory(F.concat(F.lit("/"), relative_path)), "/")
    ignored = F.exists(folders, lambda d: F.startswith(d, F.lit(".")) | d.isin(*schemas.IGNORED_DIRECTORIES))
    return paths.is_media_extension(paths.suffix(name)) & ~name.rlike("^[.~]") & ~ignored


def listed_files(listing: DataFrame, roots: DataFrame) -> DataFrame:
    """Media files of a listing table (category, relative_path, size_bytes, ...).

    ``roots`` (category, root_path) supplies the root; categories outside it are out of scope.
    """
    relative = F.col("relative_path")
    absolute = F.concat_ws("/", F.rtrim(F.col("root_path"), F.lit("/")), relative)
    return (
        listing.where(is_listed(relative))
        .join(roots.select("category", "root_path"), "category")
        .withColumns({
            "absolute_path": absolute,
            "filename": paths.file_name(relative),
            "extension": paths.suffix(paths.file_name(relative)),
            "parent_directory": paths.parent_directory(absolute),
            "layout": paths.layout(F.col("category"), relative),
        })
        .drop("root_path")
    )


def plain_path(path: Column) -> Column:
    """One form for a path: local files without their scheme, no doubled slashes after it, none at the end."""
    local = F.regexp_replace(path, "^[Ff][Ii][Ll][Ee]:/+", "/")
    return F.regexp_replace(F.regexp_replace(local, "(?<!:)/{2,}", "/"), "(?<=.)/+$", "")


def place_paths(paths_: DataFrame, categories: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """A table of paths (path, length, modified) against the configured roots, in their order.

    Returns listing rows (category, relative_path, size_bytes, mtime) of the paths below a root, and those below
    none. A path below nested roots goes to the root configured last. A path listed twice counts once, as last
    modified. Zero-byte files and any name are kept; null paths are among those below no root.
    """
    path = plain_path(F.col("path"))
    placed = F.lit(None).cast("struct<category: string, root: string>")
    for category, root in categories.items():
        base = F.concat(plain_path(F.lit(root)), F.lit("/")) if root.strip("/") else F.lit("/")
        placed = F.when(F.startswith(F.col("__path"), base), F.struct(F.lit(category).alias("category"), base.alias("root"))).otherwise(placed)
    rows = paths_.withColumn("__path", path).withColumn("__at", placed)
    below = rows.where(F.col("__at").isNotNull()).groupBy("__path").agg(
        F.max_by(F.struct("__at", "length", "modified"), F.struct("modified", "length")).alias("r"))
    listing = below.select(
        F.col("r.__at.category").alias("category"),
        F.expr("substring(__path, length(r.__at.root) + 1)").alias("relative_path"),
        F.col("r.length").alias("size_bytes"), F.col("r.modified").cast("double").alias("mtime"))
    return listing, rows.where(F.col("__at").isNull()).drop("__path", "__at")


def scoped(df: DataFrame, roots: DataFrame, category: str | None = None) -> DataFrame:
    """Restrict rows to the configured categories, or to one of them."""
    scope = roots if category is None else roots.where(F.col("category") == category)
    return df.join(scope.select("category"), "category", "left_semi")


def roots_with_files(listing: DataFrame, roots: DataFrame) -> DataFrame:
    """Every configured root with its exists flag, file count and bytes."""
    totals = listing.groupBy("category").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_size_bytes"))
    return roots.join(totals, "category", "left").select(
        "category", "root_path", "exists",
        F.when(F.col("exists"), F.coalesce("file_count", F.lit(0))).otherwise(0).alias("file_count"),
        F.when(F.col("exists"), F.coalesce("total_size_bytes", F.lit(0))).otherwise(0).alias("total_size_bytes"),
    )
