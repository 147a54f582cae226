"""Configuration as small dimensions: category roots, incoming roots, destination kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Destination kind to category key, when the configuration names none.
DEFAULT_DESTINATIONS = {"movie": "movies", "tv": "tv", "kids_movie": "kids_movies", "kids_tv": "kids_shows"}
# Destination kinds each media type may use.
KINDS_BY_MEDIA = {"MOVIE": ("movie", "kids_movie"), "EPISODE": ("tv", "kids_tv")}


def incoming_categories(roots: list[str]) -> dict[str, str]:
    """Each incoming root as a category of its own, numbered when there are several."""
    if len(roots) == 1:
        return {"incoming": roots[0]}
    return {f"incoming_{i}": root for i, root in enumerate(roots, start=1)}


def category_roots(spark: SparkSession, categories: dict[str, str], incoming: list[str] = ()) -> DataFrame:
    rows = [(c, r, False) for c, r in categories.items()]
    rows += [(c, r, True) for c, r in incoming_categories(list(incoming)).items()]
    return spark.createDataFrame(rows, "category string, root_path string, is_incoming boolean")


def destination_kinds(spark: SparkSession, categories: dict[str, str], overrides: dict[str, str] | None = None) -> DataFrame:
    """Destination kind, its category and that category's root (null when not configured)."""
    chosen = {**DEFAULT_DESTINATIONS, **(overrides or {})}
    rows = [(media, kind, chosen[kind], categories.get(chosen[kind]))
            for media, kinds in KINDS_BY_MEDIA.items() for kind in kinds]
    return spark.createDataFrame(
        rows, "media_type string, destination_kind string, category_key string, destination_root string")
