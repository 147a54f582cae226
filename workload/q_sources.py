"""Listings, probe payloads, provider catalogs, caches and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.plans.browse import file_records
from shelfmark.sources import config, listing, probe, provider, readback
from workload.registry import PARTS, query, run_ts




@query("s01_listing", """
SELECT l.media_file_id, l.category, '/nas/' || l.category || '/' || l.relative_path AS absolute_path,
  regexp_extract(l.relative_path, '[^/]*$') AS filename,
  lower(regexp_extract(l.relative_path, '[.][^./]+$')) AS extension,
  rtrim(regexp_replace('/nas/' || l.category || '/' || l.relative_path, '[^/]*$', ''), '/') AS parent_directory, l.size_bytes
FROM {listing} l
WHERE lower(regexp_extract(l.relative_path, '[^/][.]([^./]+)$', 1)) IN ('mkv','mp4','m4v','mov','avi','mpg','mpeg','ts','m2ts','vob','wmv')
  AND regexp_extract(l.relative_path, '[^/]*$') NOT LIKE '.%' AND regexp_extract(l.relative_path, '[^/]*$') NOT LIKE '~%'
  AND '/' || l.relative_path NOT LIKE '%/.%' AND '/' || l.relative_path NOT LIKE '%/@eaDir/%' AND '/' || l.relative_path NOT LIKE '%/#recycle/%'
""")
def _(c):
    return listing.listed_files(c.listing, c.roots).select(
        "media_file_id", "category", "absolute_path", "filename", "extension", "parent_directory", "size_bytes")


_ROOTS = {"movies": "/nas/movies", "tv": "file:///nas/tv/", "deep": "/nas/tv/deep", "kids_shows": "/nas/kids_shows"}
PARTS["placed_paths"] = """
SELECT path, length, modified, regexp_replace(path, '^file:/+', '/') AS plain,
  CASE WHEN regexp_replace(path, '^file:/+', '/') LIKE '/nas/tv/deep/%' THEN '/nas/tv/deep/' WHEN regexp_replace(path, '^file:/+', '/') LIKE '/nas/tv/%' THEN '/nas/tv/'
    WHEN regexp_replace(path, '^file:/+', '/') LIKE '/nas/movies/%' THEN '/nas/movies/' WHEN regexp_replace(path, '^file:/+', '/') LIKE '/nas/kids_shows/%' THEN '/nas/kids_shows/' END AS root FROM {paths}"""


@query("s01_place_paths", """
SELECT CASE root WHEN '/nas/tv/deep/' THEN 'deep' ELSE replace(replace(root, '/nas/', ''), '/', '') END AS category, substr(plain, length(root) + 1) AS relative_path, arg_max(length, modified) AS size_bytes, max(modified) AS mtime
FROM {placed_paths} WHERE root IS NOT NULL GROUP BY root, plain
""")
def _(c):
    return listing.place_paths(c.paths, _ROOTS)[0].select("category", "relative_path", "size_bytes", "mtime")


@query("s01_unplaced_paths", "SELECT path, length FROM {placed_paths} WHERE root IS NULL")
def _(c):
    return listing.place_paths(c.paths, _ROOTS)[1].select("path", "length")


@query("s02_roots_with_files", """
SELECT r.category, r.root_path, r."exists", CASE WHEN r."exists" THEN count(f.media_file_id) ELSE 0 END AS file_count,
  CAST(CASE WHEN r."exists" THEN coalesce(sum(f.size_bytes), 0) ELSE 0 END AS BIGINT) AS total_size_bytes
FROM {roots} r LEFT JOIN {files} f ON f.category = r.category GROUP BY r.category, r.root_path, r."exists"
""")
def _(c):
    return listing.roots_with_files(c.files, c.roots)


@query("s03_scoped_listing", """
SELECT media_file_id, category, relative_path FROM {files} WHERE category = 'kids_shows'
""")
def _(c):
    return listing.scoped(c.files, c.roots, "kids_shows").select("media_file_id", "category", "relative_path")


_TRACKS = """CASE WHEN json_type(payload, '$.media.track') = 'OBJECT' THEN '[' || json_extract(payload, '$.media.track') || ']'
      ELSE json_extract(payload, '$.media.track') END"""
_PARSED = f"""
SELECT media_file_id, payload, probe_error, ok, CASE WHEN ok AND json_type(payload, '$.media.track') IS NOT NULL THEN {_TRACKS} END AS tracks
FROM (SELECT media_file_id, payload, probe_error, coalesce(json_valid(payload), FALSE) AND payload <> 'not json' AS ok0,
  coalesce(payload LIKE '{{{{%', FALSE) AS ok FROM {{payloads}})
"""


@query("s04_probe_decode", f"""
SELECT media_file_id, trim(json_extract_string(tracks, '$[0].Format')) AS container,
  CAST(json_extract_string(tracks, '$[0].Duration') AS DOUBLE) AS duration_seconds,
  CAST(floor(CAST(json_extract_string(tracks, '$[0].OverallBitRate') AS DOUBLE)) AS BIGINT) AS overall_bitrate,
  CASE WHEN json_array_length(tracks) = 1 THEN 0 ELSE 1 END AS video_tracks, CASE WHEN json_array_length(tracks) = 1 THEN 0 ELSE 2 END AS audio_tracks,
  CASE WHEN json_array_length(tracks) = 1 THEN 0 ELSE 1 END AS subtitle_tracks,
  CASE WHEN json_array_length(tracks) > 1 THEN CAST(json_extract_string(tracks, '$[1].Width') AS BIGINT) END AS width,
  CAST(NULL AS BIGINT) AS height,
  CASE WHEN json_array_length(tracks) > 1 THEN CAST(json_extract_string(tracks, '$[1].FrameRate') AS DOUBLE) END AS frame_rate,
  json_extract_string(tracks, '$[1].DisplayAspectRatio') AS aspect_ratio,
  CAST(NULL AS VARCHAR) AS hdr_format,
  CASE WHEN json_array_length(tracks) > 1 THEN CAST(json_extract_string(tracks, '$[2].Channels') AS BIGINT) END AS channels,
  CASE WHEN json_array_length(tracks) > 1 THEN TRUE END AS first_default,
  CASE WHEN json_array_length(tracks) > 1 THEN FALSE END AS second_default,
  CASE WHEN json_array_length(tracks) > 1 THEN TRUE END AS forced
FROM ({_PARSED}) WHERE probe_error IS NULL AND json_extract_string(tracks, '$[0]."@type"') = 'General'
""")
def _(c):
    d = probe.decode(c.payloads, "payload", "probe_error").where("video_tracks IS NOT NULL")
    video, audio, text = F.get("video_tracks", F.lit(0)), F.col("audio_tracks"), F.get("subtitle_tracks", F.lit(0))
    return d.select(
        "media_file_id", "container", "duration_seconds", "overall_bitrate",
        *[F.size(k).alias(k) for k in ("video_tracks", "audio_tracks", "subtitle_tracks")],
        *[video[k].alias(k) for k in ("width", "height", "frame_rate", "aspect_ratio", "hdr_format")],
        F.get(audio, F.lit(0))["channels"].alias("channels"), F.get(audio, F.lit(0))["default"].alias("first_default"),
        F.get(audio, F.lit(1))["default"].alias("second_default"), text["forced"].alias("forced"))


@query("s05_probe_outcome", """
SELECT CASE WHEN media_file_id % 39 = 0 THEN 'exit status 1'
    WHEN payload IS NULL THEN NULL
    WHEN payload = 'not json' OR payload = '{{"media":null}}' THEN 'unreadable probe output: no media object'
    WHEN payload NOT LIKE '%General%' THEN 'unreadable probe output: no General track' END AS media_info_error,
  payload LIKE '%General%' AND media_file_id % 39 <> 0 AS has_metadata, count(*) AS files
FROM (SELECT media_file_id, coalesce(payload, NULL) AS payload FROM {payloads}) GROUP BY 1, 2
""")
def _(c):
    d = probe.decode(c.payloads, "payload", "probe_error")
    has = F.when(F.col("payload").isNotNull() | (F.col("media_file_id") % 39 == 0) & F.col("payload").isNotNull(), F.col("video_tracks").isNotNull())
    has = F.when(F.col("payload").isNull() & F.col("probe_error").isNull(), F.lit(None)).when(
        F.col("payload").isNull(), F.lit(False)).otherwise(has)
    return d.groupBy("media_info_error", has.alias("has_metadata")).agg(F.count(F.lit(1)).alias("files"))


@query("s06_provider_details", """
SELECT p_partkey AS provider_id, p_name AS title, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS original_title,
  CAST(CASE WHEN p_partkey % 4 = 3 THEN 1950 + p_partkey % 70 END AS INT) AS release_year, CAST(NULL AS VARCHAR) AS original_language,
  p_size + 0.5e0 AS popularity, CASE WHEN p_partkey % 5 <> 0 AND p_size % 9 > 0 THEN CAST(p_size % 9 * 60 AS BIGINT) END AS runtime_seconds
FROM {part}
""")
def _(c):
    return provider.details(c.provider_payloads, "MOVIE")


@query("s06_provider_search_pages", """
SELECT s_suppkey, 0 AS position, CAST(s_suppkey AS BIGINT) AS provider_id, s_name AS title, CAST(2001 AS INT) AS first_air_year, CAST(NULL AS DOUBLE) AS popularity FROM {supplier}
UNION ALL SELECT s_suppkey, 1, CAST(s_suppkey + 1000 AS BIGINT), '', NULL, 1.5 FROM {supplier}
""")
def _(c):
    return provider.search_results(c.search_pages, "SERIES", keep=("s_suppkey",)).select(
        "s_suppkey", "position", "provider_id", "title", "first_air_year", "popularity")


@query("s07_provider_lookups", """
SELECT c.media_file_id, e.series_provider_id, e.season_number, e.episode_number, e.provider_id, e.episode_title, e.runtime_seconds
FROM {candidates} c JOIN {episodes} e ON e.series_provider_id = c.media_file_id % (SELECT count(*) FROM {part})
  AND e.season_number = c.season_number AND e.episode_number = c.episode_number
""")
def _(c):
    parts = c.part.agg(F.count(F.lit(1))).scalar()
    wanted = c.candidates.withColumn("series_provider_id", F.col("media_file_id") % parts).select(
        "media_file_id", "series_provider_id", "season_number", "episode_number")
    return provider.get_episodes(wanted, c.episodes)


@query("s07_provider_movies", """
SELECT l.l_orderkey AS media_file_id, l.l_linenumber, m.provider_id, m.title, m.runtime_seconds FROM {lineitem} l JOIN {movies} m ON m.provider_id = l.l_partkey
""")
def _(c):
    wanted = c.lineitem.select(F.col("l_orderkey").alias("media_file_id"), "l_linenumber", F.col("l_partkey").alias("provider_id"))
    return provider.get_movies(wanted, c.movies).select("media_file_id", "l_linenumber", "provider_id", "title", "runtime_seconds")


@query("s08_cache_read", """
SELECT provider, request_key, response_json FROM {cache} WHERE expires_at > TIMESTAMP '2024-02-01 00:00:00' AND response_json IS NOT NULL
""")
def _(c):
    return provider.cache_read(c.cache, run_ts()).select("provider", "request_key", "response_json")


@query("s09_cache_purge", """
SELECT expires_at > TIMESTAMP '2024-02-01 00:00:00' AS kept, count(*) AS entries FROM {cache} GROUP BY 1
""")
def _(c):
    stay, gone = provider.cache_purge(c.cache, run_ts())
    count = lambda df, kept: df.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(kept).alias("kept"), "entries")
    return count(stay, True).unionByName(count(gone, False))


@query("a11_cache_stats", """
SELECT count(*) AS total_count, count(*) FILTER (WHERE expires_at > TIMESTAMP '2024-02-01 00:00:00') AS fresh_count,
  count(*) FILTER (WHERE expires_at <= TIMESTAMP '2024-02-01 00:00:00') AS expired_count FROM {cache}
""")
def _(c):
    return provider.cache_stats(c.cache, run_ts())


@query("r18_cache_upsert", """
SELECT provider, request_key, response_json, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires FROM (
  SELECT *, row_number() OVER (PARTITION BY provider, request_key ORDER BY o DESC, fetched_at DESC, response_json DESC) AS n FROM (
    SELECT provider, request_key, response_json, fetched_at, expires_at, 0 AS o FROM {cache}
    UNION ALL
    SELECT 'TMDB', 'movie?' || CAST(user_id + 20 AS VARCHAR), props, ts, ts + INTERVAL 3600 SECOND, 1 FROM {events}))
WHERE n = 1
""")
def _(c):
    fetches = c.events.select(
        F.lit("TMDB").alias("provider"), F.concat(F.lit("movie?"), (F.col("user_id") + 20).cast("string")).alias("request_key"),
        F.col("ts").cast("timestamp").alias("fetched_at"), F.col("props").alias("response_json"))
    cache = c.cache.withColumns({"fetched_at": F.col("fetched_at").cast("timestamp"), "expires_at": F.col("expires_at").cast("timestamp")})
    merged = provider.cache_upsert(cache, fetches, 3600)
    return merged.select("provider", "request_key", "response_json", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("s10_canonical_readback", """
SELECT f.media_file_id, CASE WHEN f.media_info_error IS NOT NULL THEN 'ERROR' WHEN f.media_info_probed_at IS NOT NULL THEN 'OK' ELSE 'NOT_PROBED' END AS metadata_state,
  t.kind, t.track_index, t.codec
FROM {files} f LEFT JOIN {tracks} t ON t.media_file_id = f.media_file_id WHERE f.state = 'ACTIVE'
""")
def _(c):
    return readback.canonical_files(c.files, c.tracks, ["codec", "language"]).select(
        "media_file_id", "metadata_state", "kind", "track_index", "codec")


@query("s11_report_rows", """
SELECT category, '{{"category":"' || category || '","relative_path":"' || relative_path || '","size_bytes":' || size_bytes || ',"layout":"' || layout || '"}}' AS report_row
FROM {files} WHERE state = 'ACTIVE'
""")
def _(c):
    rows = readback.canonical_files(c.files)
    return rows.select("category", F.to_json(F.struct("category", "relative_path", "size_bytes", "layout")).alias("report_row"))


@query("s11_report_totals", """
SELECT category, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes FROM {files} GROUP BY category
""")
def _(c):
    return readback.report_totals(c.files)


@query("s12_config_dimensions", """
SELECT k.destination_kind, k.category_key, k.destination_root, count(f.media_file_id) AS files
FROM (VALUES ('movie', 'movies', '/nas/movies'), ('kids_movie', 'kids_movies', '/nas/kids_movies'), ('tv', 'tv', '/nas/tv'), ('kids_tv', 'kids_shows', NULL)) k(destination_kind, category_key, destination_root)
LEFT JOIN {files} f ON f.category = k.category_key GROUP BY 1, 2, 3
""")
def _(c):
    kinds = config.destination_kinds(c.spark, {"movies": "/nas/movies", "kids_movies": "/nas/kids_movies", "tv": "/nas/tv"})
    per = c.files.groupBy("category").agg(F.count(F.lit(1)).alias("files"))
    return kinds.join(per, kinds["category_key"] == per["category"], "left").select(
        "destination_kind", "category_key", "destination_root", F.coalesce("files", F.lit(0)).alias("files"))


@query("p03_file_records", """
SELECT f.media_file_id, f.category, f.state, f.video_track_count, f.audio_track_count, f.subtitle_track_count FROM {files} f
""")
def _(c):
    bare = c.files.drop("category", "video_track_count", "audio_track_count", "subtitle_track_count")
    return file_records(bare, c.libraries, c.tracks).select(
        "media_file_id", "category", "state", "video_track_count", "audio_track_count", "subtitle_track_count")
