"""Catalog-shaped inputs derived from the test tables.

Each input is one portable SELECT. Spark runs it over the parquet files; the check SQL of a
query carries the same text as a common table expression. Names in braces are other inputs or
test tables.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

RUN_TS = "TIMESTAMP '2024-02-01 00:00:00'"

INPUTS: dict[str, str] = {
    "libraries": """
SELECT CAST(library_id AS BIGINT) AS library_id, category, '/nas/' || category AS root_path FROM (VALUES
  (1, 'movies'), (2, 'kids_movies'), (3, 'tv'), (4, 'kids_shows'), (5, 'fitness'), (6, 'incoming')) AS v(library_id, category)""",
    "roots": """
SELECT category, root_path, category <> 'fitness' AS "exists" FROM {libraries}""",
    "media": """
SELECT o.o_orderkey AS media_file_id,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'movies' WHEN 1 THEN 'kids_movies' WHEN 2 THEN 'tv'
       WHEN 3 THEN 'kids_shows' ELSE 'fitness' END AS category,
  CASE WHEN o.o_orderkey % 53 = 0 THEN 'a/b/c/' ELSE '' END ||
  CASE WHEN o.o_orderkey % 5 < 2 THEN
    CASE o.o_orderkey % 3
      WHEN 0 THEN replace(p.p_name, ' ', '.') || '.' || CAST(1950 + o.o_orderkey % 70 AS STRING) || '.1080p.x264'
      WHEN 1 THEN p.p_name || ' (' || CAST(1950 + o.o_orderkey % 70 AS STRING) || ')/movie'
      ELSE 'Set ' || p.p_brand || '/' || p.p_name || ' (' || CAST(1950 + o.o_orderkey % 70 AS STRING) || ')/' || p.p_name
        || CASE o.o_orderkey % 4 WHEN 0 THEN ' Unrated' WHEN 1 THEN ' Final Cut [1999]' WHEN 2 THEN ' Part 2 WEB-DL' ELSE '' END END
  ELSE
    CASE o.o_orderkey % 3
      WHEN 0 THEN p.p_name || '/' || p.p_name || ' - S' || lpad(CAST(o.o_orderkey % 4 AS STRING), 2, '0') || 'E' || lpad(CAST(o.o_orderkey % 13 + 1 AS STRING), 2, '0')
        || CASE WHEN o.o_orderkey % 8 = 0 THEN '-E' || lpad(CAST(o.o_orderkey % 13 + 2 AS STRING), 2, '0') ELSE '' END || ' - ' || p.p_type
      WHEN 1 THEN p.p_name || '/Season ' || lpad(CAST(o.o_orderkey % 4 AS STRING), 2, '0') || '/' || CAST(o.o_orderkey % 4 + o.o_orderkey % 7 % 2 AS STRING) || 'x' || lpad(CAST(o.o_orderkey % 13 + 1 AS STRING), 2, '0')
      ELSE p.p_name || CASE WHEN o.o_orderkey % 6 = 5 THEN '/Trailer ' ELSE '/Notes ' END || CAST(o.o_orderkey AS STRING) END
  END || CASE WHEN o.o_orderkey % 41 = 0 THEN '.iso' ELSE '.mkv' END AS relative_path,
  CASE WHEN o.o_orderkey % 97 = 0 THEN 0 ELSE CAST(floor(o.o_totalprice * 1000) AS BIGINT) END AS size_bytes,
  CASE WHEN o.o_orderkey % 23 = 0 THEN 'MISSING' ELSE 'ACTIVE' END AS state,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST(o.o_orderdate AS TIMESTAMP) END AS probed_at,
  CASE WHEN o.o_orderkey % 17 = 0 AND o.o_orderkey % 13 <> 0 THEN 'exit status 1' END AS media_info_error,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(1200 + o.o_orderkey % 6000 AS DOUBLE) END AS duration_seconds
FROM {orders} o JOIN {part} p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM {part})""",
    "tracks": """
SELECT l_orderkey AS media_file_id, CAST(l_linenumber AS BIGINT) AS track_index,
  CASE l_linenumber % 3 WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'subtitle' END AS kind,
  max(CASE l_returnflag WHEN 'A' THEN 'eng' WHEN 'N' THEN 'fra' END) AS language,
  max(CASE l_linestatus WHEN 'O' THEN 'HEVC' ELSE 'AVC' END) AS codec,
  CAST(max(l_quantity) AS BIGINT) AS channels
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    # Full file records. A folder per file above the category path keeps absolute paths unique.
    "files": """
SELECT m.media_file_id, l.library_id, m.category,
  '/nas/' || m.category || '/disk' || CAST(m.media_file_id AS STRING) || '/' || m.relative_path AS absolute_path,
  m.relative_path, regexp_extract(m.relative_path, '[^/]+$', 0) AS filename,
  lower(regexp_extract(m.relative_path, '[.][^./]+$', 0)) AS extension,
  regexp_replace('/nas/' || m.category || '/disk' || CAST(m.media_file_id AS STRING) || '/' || m.relative_path, '/[^/]+$', '') AS parent_directory,
  CASE WHEN m.media_file_id % 53 = 0 THEN 'unknown'
    WHEN m.media_file_id % 5 < 2 THEN CASE m.media_file_id % 3 WHEN 0 THEN 'movie_flat' WHEN 1 THEN 'movie_folder' ELSE 'movie_collection_folder' END
    ELSE CASE m.media_file_id % 3 WHEN 1 THEN 'tv_season_folder' ELSE 'tv_series_folder' END END AS layout,
  m.size_bytes, CAST(1000000000 + m.media_file_id * 7 AS DOUBLE) AS mtime, m.state,
  CASE m.media_file_id % 9 WHEN 0 THEN 'MPEG-4' WHEN 1 THEN NULL WHEN 2 THEN 'Ogg' ELSE 'Matroska' END AS container,
  m.duration_seconds, CAST(m.media_file_id % 20000 AS BIGINT) AS overall_bitrate,
  m.media_info_error, m.probed_at AS media_info_probed_at,
  coalesce(t.video_track_count, 0) AS video_track_count, coalesce(t.audio_track_count, 0) AS audio_track_count,
  coalesce(t.subtitle_track_count, 0) AS subtitle_track_count,
  CAST(m.media_file_id % 7 + 1 AS BIGINT) AS first_seen_scan_id,
  CAST(CASE m.state WHEN 'MISSING' THEN 20 ELSE 30 END AS BIGINT) AS last_seen_scan_id,
  CAST(CASE m.state WHEN 'MISSING' THEN 21 END AS BIGINT) AS missing_since_scan_id
FROM {media} m JOIN {libraries} l ON l.category = m.category
LEFT JOIN (SELECT media_file_id,
  CAST(sum(CASE WHEN kind = 'video' THEN 1 ELSE 0 END) AS BIGINT) AS video_track_count,
  CAST(sum(CASE WHEN kind = 'audio' THEN 1 ELSE 0 END) AS BIGINT) AS audio_track_count,
  CAST(sum(CASE WHEN kind = 'subtitle' THEN 1 ELSE 0 END) AS BIGINT) AS subtitle_track_count
  FROM {tracks} GROUP BY media_file_id) t ON t.media_file_id = m.media_file_id""",
    "changes": """
SELECT event_id, CAST(dayofmonth(ts) AS BIGINT) AS scan_run_id, user_id AS media_file_id, CAST(user_id % 7 AS BIGINT) AS library_id,
  CASE event_type WHEN 'signup' THEN 'ADDED' WHEN 'error' THEN 'MISSING' WHEN 'purchase' THEN 'RESTORED' ELSE 'UPDATED' END AS change_type,
  '/lib/' || CAST(user_id AS STRING) AS absolute_path
FROM {events}""",
    "runs": """
SELECT CAST(dayofmonth(ts) AS BIGINT) AS scan_run_id,
  CASE dayofmonth(ts) % 10 WHEN 0 THEN 'FAILED' ELSE 'COMPLETE' END AS status,
  CASE dayofmonth(ts) % 9 WHEN 2 THEN 'EXECUTION' ELSE 'SCAN' END AS triggered_by
FROM {events} GROUP BY dayofmonth(ts)""",
    "movies": """
SELECT p_partkey AS provider_id, p_name AS title,
  CASE WHEN p_partkey % 4 = 0 THEN 'The ' || p_name || ' ' || p_type END AS original_title,
  CAST(CASE WHEN p_partkey % 15 = 0 THEN NULL ELSE 1950 + p_partkey % 70 END AS INT) AS release_year,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice END AS popularity,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(1200 + p_partkey % 6000 AS BIGINT) END AS runtime_seconds
FROM {part}""",
    "series": """
SELECT p_partkey AS provider_id, p_name AS title, p_retailprice AS popularity FROM {part}""",
    "episodes": """
SELECT min(o_orderkey) AS provider_id, o_orderkey % (SELECT count(*) FROM {part}) AS series_provider_id,
  CAST(o_orderkey % 4 AS INT) AS season_number, CAST(o_orderkey % 13 + 1 AS INT) AS episode_number,
  CASE WHEN min(o_orderkey) % 5 = 0 THEN NULL ELSE max(o_orderpriority) END AS episode_title,
  CAST(1200 + min(o_orderkey) % 3000 AS BIGINT) AS runtime_seconds
FROM {orders} GROUP BY o_orderkey % (SELECT count(*) FROM {part}), o_orderkey % 4, o_orderkey % 13""",
    "candidates": """
SELECT o.o_orderkey AS media_file_id, o.o_orderkey * 3 AS candidate_id,
  CASE WHEN o.o_orderkey % 5 < 2 THEN CASE WHEN o.o_orderkey % 16 = 0 THEN 'UNKNOWN' ELSE 'MOVIE' END
    WHEN o.o_orderkey % 3 = 2 THEN 'EXTRA' WHEN o.o_orderkey % 4 = 0 THEN 'SPECIAL' ELSE 'EPISODE' END AS candidate_type,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'UNKNOWN' END AS confidence,
  1 AS parser_version,
  CASE WHEN o.o_orderkey % 5 < 2 THEN p.p_name END AS parsed_title,
  CAST(CASE WHEN o.o_orderkey % 5 < 2 AND o.o_orderkey % 9 <> 0 THEN 1950 + o.o_orderkey % 70 END AS INT) AS parsed_year,
  CASE WHEN o.o_orderkey % 5 >= 2 THEN p.p_name END AS parsed_series_title,
  CAST(CASE WHEN o.o_orderkey % 5 >= 2 THEN o.o_orderkey % 4 END AS INT) AS season_number,
  CAST(CASE WHEN o.o_orderkey % 5 >= 2 AND o.o_orderkey % 21 <> 0 THEN o.o_orderkey % 13 + 1 END AS INT) AS episode_number,
  CASE WHEN o.o_orderkey % 5 >= 2 AND o.o_orderkey % 2 = 0 THEN o.o_orderpriority END AS episode_title,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(1200 + o.o_orderkey % 6000 AS DOUBLE) END AS local_seconds
FROM {orders} o JOIN {part} p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM {part})""",
    # Search hits the provider returned per file: one page of a few rows.
    "hits": """
SELECT c.media_file_id, c.parsed_title, c.parsed_year, c.candidate_type, c.local_seconds, l.position,
  m.provider_id, m.title, m.original_title, m.release_year, m.popularity, m.runtime_seconds
FROM {candidates} c
JOIN (SELECT l_orderkey, l_partkey, min(l_linenumber) AS position FROM {lineitem} GROUP BY l_orderkey, l_partkey) l ON l.l_orderkey = c.media_file_id
JOIN {movies} m ON m.provider_id = l.l_partkey
WHERE c.candidate_type = 'MOVIE'""",
    "findings": """
SELECT event_id AS media_file_id,
  CASE user_id % 9 WHEN 0 THEN 'missing_file' WHEN 1 THEN 'metadata_error' WHEN 2 THEN 'metadata_not_probed' WHEN 3 THEN 'unknown_layout'
    WHEN 4 THEN 'zero_byte_file' WHEN 5 THEN 'suspiciously_small_media' WHEN 6 THEN 'no_video_track' WHEN 7 THEN 'no_audio_track' ELSE 'unexpected_extension' END AS rule_code,
  CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'ERROR' WHEN 'signup' THEN 'INFO' ELSE 'WARNING' END AS severity,
  CASE event_id % 4 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'IGNORED' ELSE 'ACTIVE' END AS status,
  CAST(event_id % 8 AS BIGINT) AS library_id, event_type AS summary
FROM {events}""",
    "attempts": """
SELECT o_orderkey AS attempt_id, o_orderkey % 5000 AS media_file_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'REVIEW_REQUIRED' WHEN 2 THEN 'NO_MATCH' WHEN 3 THEN 'FAILED' ELSE 'SKIPPED' END AS status,
  CAST(o_orderdate AS TIMESTAMP) AS started_at,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey * 100 + 1 END AS selected_match_id,
  CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey * 2 END AS override_id
FROM {orders}""",
    "matches": """
SELECT l_orderkey * 100 + l_linenumber AS match_id, l_orderkey AS attempt_id, CAST(l_linenumber AS BIGINT) AS rank,
  max(l_partkey) AS provider_id, round(max(l_discount) * 9, 4) AS score, l_linenumber = 1 AS selected
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "identities": """
SELECT p_partkey AS identity_id, CASE WHEN p_partkey % 2 = 0 THEN 'MOVIE' ELSE 'EPISODE' END AS media_type, p_partkey AS provider_id,
  p_name || CASE p_partkey % 7 WHEN 0 THEN ': The/Cut. ' WHEN 1 THEN '  ' ELSE '' END AS title,
  CAST(CASE WHEN p_partkey % 2 = 0 AND p_partkey % 10 <> 0 THEN 1950 + p_partkey % 70 END AS INT) AS release_year,
  CAST(CASE WHEN p_partkey % 2 = 1 AND p_partkey % 9 <> 0 THEN p_size % 12 END AS INT) AS season_number,
  CAST(CASE WHEN p_partkey % 2 = 1 THEN p_size END AS INT) AS episode_number,
  CASE WHEN p_partkey % 6 = 1 THEN p_type END AS episode_title
FROM {part}""",
    "assignments": """
SELECT o_orderkey * 10 AS assignment_id, o_orderkey AS media_file_id, o_orderkey * 3 AS candidate_id,
  o_orderkey % (SELECT count(*) FROM {part}) AS identity_id, o_orderkey AS attempt_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'MANUAL' ELSE 'AUTO' END AS assignment_method,
  CASE o_orderkey % 4 WHEN 0 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
  CASE o_orderkey % 8 WHEN 6 THEN 'SUPERSEDED' WHEN 7 THEN 'REVOKED' ELSE 'ACTIVE' END AS status,
  CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) AS updated_at,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS confirmed_for_ingest_at,
  CASE WHEN o_orderkey % 6 = 0 THEN 'first' END AS confirmed_by
FROM {orders}""",
    "plans": """
SELECT o.o_orderkey + 1 AS plan_id, o.o_orderkey AS media_file_id, o.o_orderkey * 3 AS candidate_id, o.o_orderkey * 10 AS assignment_id,
  CASE o.o_orderkey % 11 WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'SUPERSEDED' WHEN 2 THEN 'EXECUTED' WHEN 3 THEN 'REVIEW_REQUIRED' WHEN 4 THEN 'READY_FOR_REVIEW'
    WHEN 5 THEN 'EXECUTING' ELSE 'APPROVED' END AS status,
  CAST(o.o_orderkey % 3 + 1 AS BIGINT) AS plan_version, CAST(o.o_orderdate AS TIMESTAMP) AS updated_at,
  CASE WHEN o.o_orderkey % 10 < 8 THEN '/nas/movies' END AS destination_library,
  CASE WHEN o.o_orderkey % 10 < 8 THEN CASE WHEN o.o_orderkey % 37 = 0 THEN '/tmp/' ELSE '/nas/movies/' END || p.p_name || ' (' || CAST(1950 + o.o_orderkey % 700 AS STRING) || ')' END AS destination_directory,
  CASE WHEN o.o_orderkey % 10 < 8 THEN p.p_name || ' (' || CAST(1950 + o.o_orderkey % 700 AS STRING) || ').mkv' END AS destination_filename
FROM {orders} o JOIN {part} p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM {part})""",
    "executions": """
SELECT o_orderkey AS execution_id, o_custkey AS plan_id,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'EXECUTING' ELSE 'RECOVERY_REQUIRED' END AS status,
  CASE o_orderkey % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'PARTIAL_DESTINATION_SOURCE_INTACT' WHEN 2 THEN 'SOMETHING_NEW' WHEN 3 THEN NULL ELSE 'INVENTORY_REFRESH_INCOMPLETE' END AS recovery_status,
  '/incoming/f' || CAST(o_orderkey AS STRING) || '.mkv' AS source_path,
  '/nas/movies/m' || CAST(o_orderkey % 4000 AS STRING) || '/m' || CAST(o_orderkey % 4000 AS STRING) || '.mkv' AS destination_path,
  't' || CAST(o_orderkey AS STRING) AS lock_token
FROM {orders}""",
    "steps": """
SELECT l_orderkey AS execution_id, CAST(l_linenumber AS BIGINT) AS step_order,
  max(CASE l_returnflag WHEN 'A' THEN 'SUCCEEDED' WHEN 'N' THEN 'PENDING' ELSE 'FAILED' END) AS step_status
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "cache": """
SELECT 'TMDB' AS provider, 'movie?' || CAST(user_id AS STRING) AS request_key, max(ts) AS fetched_at,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE max(props) END AS response_json,
  CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' WHEN user_id % 3 = 1 THEN TIMESTAMP '2024-02-01 00:00:01' ELSE TIMESTAMP '2024-01-31 00:00:00' END AS expires_at
FROM {events} GROUP BY user_id""",
    "listing": """
SELECT m.media_file_id, m.category,
  CASE m.media_file_id % 19 WHEN 1 THEN '.hidden/' WHEN 2 THEN '@eaDir/' WHEN 3 THEN 'x/#recycle/' ELSE '' END
  || regexp_replace(m.relative_path, '[^/]+$', '')
  || CASE m.media_file_id % 29 WHEN 1 THEN '.' WHEN 2 THEN '~$' ELSE '' END
  || CASE m.media_file_id % 31 WHEN 1 THEN upper(regexp_extract(m.relative_path, '[^/]+$', 0)) WHEN 2 THEN replace(regexp_extract(m.relative_path, '[^/]+$', 0), '.', '') ELSE regexp_extract(m.relative_path, '[^/]+$', 0) END AS relative_path,
  m.size_bytes
FROM {media} m""",
    # Absolute paths as a store lists them: with and without a scheme, some twice, some below no root.
    "paths": """
SELECT CASE media_file_id % 3 WHEN 0 THEN 'file:///nas/' WHEN 1 THEN '/nas/' ELSE 'file:/nas/' END || category || CASE WHEN media_file_id % 4 = 0 THEN '/deep/' ELSE '/' END
  || CASE WHEN media_file_id % 5 = 0 THEN '_' ELSE '' END || relative_path AS path, CASE WHEN media_file_id % 7 = 0 THEN 0 ELSE size_bytes END AS length, CAST(media_file_id AS DOUBLE) AS modified
FROM {media}""",
    "payloads": """
SELECT o_orderkey AS media_file_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'not json' WHEN o_orderkey % 19 = 0 THEN '{{"media":null}}'
  WHEN o_orderkey % 7 = 0 THEN '{{"media":{{"track":{{"@type":"General","Format":" Matroska ","Duration":"' || CAST(o_orderkey AS STRING) || '.5"}}}}}}'
  WHEN o_orderkey % 11 = 0 THEN '{{"media":{{"track":[{{"@type":"Video","Format":"AVC"}}]}}}}'
  ELSE '{{"media":{{"@ref":"x","track":[{{"@type":"General","Format":"MPEG-4","Duration":"' || CAST(o_orderkey AS STRING) || '.25","OverallBitRate":"' || CAST(o_orderkey * 3 AS STRING) || '.9"}},'
    || '{{"@type":"Video","Format":"HEVC","Width":"1920","Height":"x","FrameRate":"23.976","HDR_Format":"","DisplayAspectRatio":"1.778"}},'
    || '{{"@type":"Audio","Format":"AC3","Language":"eng","Channels":"' || CAST(o_orderkey % 8 AS STRING) || '","Default":"Yes"}},'
    || '{{"@type":"Audio","Format":"AAC","Default":"No"}},{{"@type":"Text","Language":"fra","Forced":" yes "}}]}}}}' END AS payload,
  CASE WHEN o_orderkey % 39 = 0 THEN 'exit status 1' END AS probe_error
FROM {orders}""",
    "provider_payloads": """
SELECT p_partkey, '{{"id":' || CAST(p_partkey AS STRING) || ',"title":"' || p_name || '","original_title":"' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END
  || '","release_date":"' || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '19' WHEN 2 THEN 'soon' ELSE CAST(1950 + p_partkey % 70 AS STRING) || '-05-01' END
  || '","popularity":' || CAST(p_size AS STRING) || '.5,"runtime":' || CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE CAST(p_size % 9 AS STRING) END || '}}' AS payload
FROM {part}""",
    "search_pages": """
SELECT s_suppkey, '{{"page":1,"results":[{{"id":' || CAST(s_suppkey AS STRING) || ',"name":"' || s_name || '","first_air_date":"2001-01-01"}},{{"id":' || CAST(s_suppkey + 1000 AS STRING)
  || ',"name":null,"popularity":1.5}},{{"name":"no id"}}]}}' AS payload
FROM {supplier}""",
    "snap_old": """
SELECT * FROM {files} WHERE media_file_id % 31 <> 0""",
    "snap_new": """
SELECT media_file_id, library_id, category, absolute_path, relative_path, filename, extension, parent_directory, layout,
  CASE WHEN media_file_id % 19 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes,
  CASE WHEN media_file_id % 57 = 0 THEN mtime + 1 ELSE mtime END AS mtime,
  CASE WHEN media_file_id % 43 = 0 THEN 'AVI' ELSE container END AS container, duration_seconds, overall_bitrate,
  CASE WHEN media_file_id % 61 = 0 THEN 'exit status 2' ELSE media_info_error END AS media_info_error
FROM {files} WHERE media_file_id % 29 <> 0 AND category <> 'fitness'""",
    "override_log": """
SELECT event_id AS entry_id, user_id AS media_file_id, CAST(ts AS TIMESTAMP) AS entry_at,
  CASE event_type WHEN 'error' THEN 'CLEAR' ELSE 'CREATE' END AS action,
  CASE event_id % 3 WHEN 0 THEN 'EPISODE' WHEN 1 THEN 'MOVIE' ELSE CASE WHEN event_id % 7 = 0 THEN 'EXTRA' ELSE 'MOVIE' END END AS candidate_type,
  CASE WHEN event_id % 10 = 1 THEN ' ' ELSE 'Title ' || CAST(event_id AS STRING) END AS title,
  CAST(1990 + event_id % 30 AS INT) AS year,
  CASE WHEN event_id % 3 = 0 THEN 'Series ' || CAST(event_id % 50 AS STRING) END AS series_title,
  CAST(CASE WHEN event_id % 9 <> 0 THEN event_id % 5 END AS INT) AS season_number,
  CASE WHEN event_id % 12 <> 0 THEN array(CAST(event_id % 20 AS INT)) END AS episode_numbers,
  CAST(NULL AS STRING) AS episode_title
FROM {events}""",
    "decisions": """
SELECT event_id AS decision_id, CAST(ts AS TIMESTAMP) AS decided_at, user_id AS key_id, event_type, 'reviewer' || CAST(event_id % 5 AS STRING) AS decided_by
FROM {events}""",
    "transfer_events": """
SELECT user_id AS plan_id, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'SUCCEED' WHEN 'error' THEN 'FAIL' ELSE 'START' END AS event,
  CASE WHEN event_id % 2 = 0 THEN 'SAME_FILESYSTEM_ATOMIC_RENAME' ELSE 'CROSS_FILESYSTEM_COPY_VERIFY_REMOVE' END AS strategy,
  CASE event_id % 6 WHEN 0 THEN 'CREATE_DESTINATION_DIRECTORY' WHEN 1 THEN 'REMOVE_SOURCE' WHEN 2 THEN 'ATOMIC_RENAME' WHEN 3 THEN 'FINAL_RENAME'
    WHEN 4 THEN 'VERIFY_DESTINATION_MEDIA' ELSE 'REFRESH_INVENTORY' END AS step
FROM {events}""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_NAME = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


class Catalog:
    """Inputs of one run as DataFrames, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._built = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._table(name) if name in TABLES else self.sql(INPUTS[name])
        return self._built[name]

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text.replace('"exists"', "`exists`"), **{n: getattr(self, n) for n in needs(text)})


def check_sql(body: str, extra: dict[str, str] | None = None) -> str:
    """The body with every input it uses, directly or not, as common table expressions."""
    texts = {**INPUTS, **(extra or {})}
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in needs(sql):
            if name in texts and name not in ordered:
                visit(texts[name])
                ordered.append(name)

    visit(body)
    plain = lambda sql: _NAME.sub(r"\1", sql).replace("{{", "{").replace("}}", "}").strip()
    ctes = ",\n".join(f"{n} AS ({_duck(plain(texts[n]))})" for n in ordered)
    return (f"WITH {ctes}\n" if ctes else "") + plain(body)


def _duck(sql: str) -> str:
    """The few spellings that differ between the two engines."""
    return sql.replace("array(CAST(event_id % 20 AS INT))", "[CAST(event_id % 20 AS INT)]")
