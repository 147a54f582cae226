"""Provider catalogs: payload normalisation, lookups as joins, and the response cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Payload members that are read, by kind.
MOVIE_DDL = "id bigint, title string, original_title string, release_date string, original_language string, popularity double, runtime double"
SERIES_DDL = "id bigint, name string, original_name string, first_air_date string, original_language string, popularity double"
EPISODE_DDL = "id bigint, season_number bigint, episode_number bigint, name string, air_date string, runtime double"


def optional_text(value: Column) -> Column:
    return F.when(value != "", value)


def year_from_date(value: Column) -> Column:
    return F.when(F.length(value) >= 4, F.substring(value, 1, 4).try_cast("int"))


def seconds_from_minutes(minutes: Column) -> Column:
    return F.when(minutes > 0, (minutes * 60).cast("long"))


def movie_fields(p: Column) -> list[Column]:
    return [
        p["id"].alias("provider_id"), F.coalesce(p["title"], F.lit("")).alias("title"),
        optional_text(p["original_title"]).alias("original_title"),
        year_from_date(p["release_date"]).alias("release_year"),
        optional_text(p["original_language"]).alias("original_language"),
        p["popularity"].alias("popularity"),
        seconds_from_minutes(p["runtime"]).alias("runtime_seconds"),
    ]


def series_fields(p: Column) -> list[Column]:
    return [
        p["id"].alias("provider_id"), F.coalesce(p["name"], F.lit("")).alias("title"),
        optional_text(p["original_name"]).alias("original_title"),
        year_from_date(p["first_air_date"]).alias("first_air_year"),
        optional_text(p["original_language"]).alias("original_language"),
        p["popularity"].alias("popularity"),
    ]


def episode_fields(p: Column) -> list[Column]:
    return [
        p["id"].alias("provider_id"), p["season_number"].alias("season_number"),
        p["episode_number"].alias("episode_number"),
        optional_text(p["name"]).alias("episode_title"), optional_text(p["air_date"]).alias("air_date"),
        seconds_from_minutes(p["runtime"]).alias("runtime_seconds"),
    ]


def _members(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (m.split() for m in ddl.split(", ")))


def details(df: DataFrame, kind: str, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per detail payload; a payload without an id is dropped as malformed."""
    ddl, fields = {"MOVIE": (MOVIE_DDL, movie_fields), "SERIES": (SERIES_DDL, series_fields),
                   "EPISODE": (EPISODE_DDL, episode_fields)}[kind]
    parsed = df.withColumn("__p", F.from_json(F.col(payload), ddl)).where(F.col("__p.id").isNotNull())
    return parsed.select(*keep, *fields(F.col("__p")))


def search_results(df: DataFrame, kind: str, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per search hit of each response page, with its position on the page."""
    ddl, fields = {"MOVIE": (MOVIE_DDL, movie_fields), "SERIES": (SERIES_DDL, series_fields)}[kind]
    page = F.from_json(F.col(payload), f"struct<results: array<struct<{_members(ddl)}>>>")
    # The outer form keeps Spark from filtering on the array first, which would parse it twice.
    hits = df.select(*keep, F.posexplode_outer(page["results"]).alias("position", "__p"))
    return hits.where(F.col("__p.id").isNotNull()).select(*keep, "position", *fields(F.col("__p")))


def get_movies(requests: DataFrame, movies: DataFrame) -> DataFrame:
    return requests.join(movies, "provider_id")


def get_episodes(requests: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes by (series, season, episode)."""
    return requests.join(episodes, ["series_provider_id", "season_number", "episode_number"])


def is_fresh(run_ts: Column) -> Column:
    """Expiry is strict: an entry that expires at ``run_ts`` has expired."""
    return F.col("expires_at") > run_ts


def cache_read(cache: DataFrame, run_ts: Column) -> DataFrame:
    return cache.where(is_fresh(run_ts) & F.col("response_json").isNotNull())


def cache_purge(cache: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """The entries that stay, and those removed."""
    return cache.where(is_fresh(run_ts)), cache.where(~is_fresh(run_ts))


def cache_stats(cache: DataFrame, run_ts: Column) -> DataFrame:
    return cache.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(is_fresh(run_ts)).alias("fresh_count"),
        F.count_if(~is_fresh(run_ts)).alias("expired_count"),
    )


def cache_upsert(cache: DataFrame, fetches: DataFrame, ttl_seconds: int) -> DataFrame:
    """The last fetch per (provider, request_key) wins and starts its own lifetime.

    ``max_by`` combines map-side, so a request key holding most of the fetches sends one row
    per task.
    """
    incoming = fetches.withColumn(
        "expires_at", F.timestamp_add("SECOND", F.lit(ttl_seconds), F.col("fetched_at")))
    columns = [c for c in cache.columns if c not in ("provider", "request_key")]
    every = cache.select(*cache.columns, F.lit(0).alias("__order")).unionByName(
        incoming.select(*cache.columns, F.lit(1).alias("__order")))
    latest = every.groupBy("provider", "request_key").agg(
        F.max_by(F.struct(*columns), F.struct("__order", "fetched_at", "response_json")).alias("__row"))
    return latest.select("provider", "request_key", *[F.col(f"__row.{c}").alias(c) for c in columns]).select(*cache.columns)
