"""Finding rules, name parsers, verification, readiness, constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import checks, findings, naming
from workload.q_functions import clean_release_sql
from workload.registry import PARTS, query

PARTS["found"] = """
SELECT media_file_id, library_id, r.* FROM (SELECT media_file_id, library_id, unnest(list_filter([
  CASE WHEN state = 'MISSING' THEN {{'rule_code': 'missing_file', 'severity': 'ERROR', 'summary': 'File is no longer found on the NAS: ' || relative_path,
    'evidence_json': '{{"last_seen_scan_id":' || last_seen_scan_id || ',"missing_since_scan_id":' || coalesce(CAST(missing_since_scan_id AS VARCHAR), 'null') || '}}'}} END,
  CASE WHEN state = 'ACTIVE' AND media_info_error IS NOT NULL THEN {{'rule_code': 'metadata_error', 'severity': 'ERROR', 'summary': 'MediaInfo failed to probe this file.', 'evidence_json': '{{"error":"' || media_info_error || '"}}'}} END,
  CASE WHEN state = 'ACTIVE' AND media_info_probed_at IS NULL AND media_info_error IS NULL THEN {{'rule_code': 'metadata_not_probed', 'severity': 'WARNING', 'summary': 'Technical metadata has not been extracted for this file yet.', 'evidence_json': NULL}} END,
  CASE WHEN state = 'ACTIVE' AND layout = 'unknown' THEN {{'rule_code': 'unknown_layout', 'severity': 'WARNING', 'summary': 'File does not match a recognized layout for its category (' || category || ').', 'evidence_json': '{{"layout":"unknown"}}'}} END,
  CASE WHEN state = 'ACTIVE' AND size_bytes = 0 THEN {{'rule_code': 'zero_byte_file', 'severity': 'ERROR', 'summary': 'File is zero bytes.', 'evidence_json': '{{"size_bytes":0}}'}} END,
  CASE WHEN state = 'ACTIVE' AND size_bytes > 0 AND size_bytes < 10485760 AND extension = '.mkv' THEN {{'rule_code': 'suspiciously_small_media', 'severity': 'WARNING',
    'summary': 'File is unusually small for a media file (' || size_bytes || ' bytes).', 'evidence_json': '{{"size_bytes":' || size_bytes || ',"threshold_bytes":10485760}}'}} END,
  CASE WHEN state = 'ACTIVE' AND media_info_probed_at IS NOT NULL AND media_info_error IS NULL AND video_track_count = 0 THEN {{'rule_code': 'no_video_track', 'severity': 'ERROR', 'summary': 'No video track detected despite a successful MediaInfo probe.', 'evidence_json': '{{"video_track_count":0}}'}} END,
  CASE WHEN state = 'ACTIVE' AND media_info_probed_at IS NOT NULL AND media_info_error IS NULL AND audio_track_count = 0 THEN {{'rule_code': 'no_audio_track', 'severity': 'WARNING', 'summary': 'No audio track detected despite a successful MediaInfo probe.', 'evidence_json': '{{"audio_track_count":0}}'}} END,
  CASE WHEN state = 'ACTIVE' AND extension <> '.mkv' THEN {{'rule_code': 'unexpected_extension', 'severity': 'WARNING', 'summary': 'File extension ''' || extension || ''' is outside the configured supported-media extension set.',
    'evidence_json': '{{"extension":"' || extension || '","supported_extensions":[".avi",".m2ts",".m4v",".mkv",".mov",".mp4",".mpeg",".mpg",".ts",".vob",".wmv"]}}'}} END
], lambda x: x IS NOT NULL)) AS r FROM {files})"""


@query("g01_finding_rules", "SELECT media_file_id, library_id, rule_code, severity, summary, evidence_json FROM {found}")
def _(c):
    return findings.evaluate(c.files).drop("recommendation")


# --- parsers --------------------------------------------------------------------------

_STEM = "regexp_replace(filename, '[.][^.]+$', '')"
_PARENT = "list_extract(string_split(absolute_path, '/'), -2)"
_GRAND = "list_extract(string_split(absolute_path, '/'), -3)"
PARTS["file_texts"] = f"""
SELECT media_file_id, category, layout, {_STEM} AS raw, {_STEM} AS stem FROM {{files}}"""
PARTS["parent_texts"] = f"""
SELECT media_file_id, CASE WHEN layout IN ('movie_folder', 'movie_collection_folder', 'tv_series_folder') THEN {_PARENT} WHEN layout = 'tv_season_folder' THEN {_GRAND} ELSE '' END AS raw FROM {{files}}"""
PARTS["file_clean"] = clean_release_sql("{file_texts}", "media_file_id, category, layout")
PARTS["parent_clean"] = clean_release_sql("{parent_texts}", "media_file_id")
_WEAK = "(length(trim({0})) < 2 OR regexp_matches(trim({0}), '^[0-9]+$'))"
PARTS["movie_parse"] = f"""
SELECT *, CASE WHEN title IS NULL THEN 'UNKNOWN' ELSE 'MOVIE' END AS candidate_type,
  CASE WHEN title IS NULL THEN 'UNKNOWN' WHEN clash OR {_WEAK.format('title')} THEN 'LOW' WHEN year IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
FROM (SELECT *, CASE source WHEN 'filename' THEN ft WHEN 'parent_directory' THEN pt END AS title, CASE source WHEN 'filename' THEN fy WHEN 'parent_directory' THEN py END AS year,
    CASE source WHEN 'filename' THEN fm WHEN 'parent_directory' THEN pm END AS year_match,
    coalesce(fy <> py, FALSE) OR (fok AND pok AND NOT (contains(lower(ft), lower(pt)) OR contains(lower(pt), lower(ft)))) AS clash
  FROM (SELECT *, CASE WHEN fok AND fy IS NOT NULL THEN 'filename' WHEN pok AND py IS NOT NULL THEN 'parent_directory' WHEN fok THEN 'filename' WHEN pok THEN 'parent_directory' END AS source
    FROM (SELECT f.media_file_id, f.category, f.title AS ft, f.year AS fy, f.year_match AS fm, p.title AS pt, p.year AS py, p.year_match AS pm,
        coalesce(f.edition, p.edition) AS edition, coalesce(nullif(f.part_number, 0), p.part_number) AS part_number,
        list_sort(list_distinct(list_concat(f.removed_tokens, p.removed_tokens))) AS removed_tokens,
        f.title <> '' AND lower(trim(f.title)) NOT IN ('movie', 'movies', 'video', 'film', 'untitled', 'download') AS fok,
        p.title <> '' AND lower(trim(p.title)) NOT IN ('movie', 'movies', 'video', 'film', 'untitled', 'download') AS pok
      FROM {{file_clean}} f JOIN {{parent_clean}} p ON p.media_file_id = f.media_file_id WHERE f.category IN ('movies', 'kids_movies'))))"""


@query("g02_movie_parser", """
SELECT media_file_id, candidate_type, confidence, title AS parsed_title, year AS parsed_year, edition, part_number, source AS title_source,
  nullif(ft, '') AS filename_title, fy AS filename_year, nullif(pt, '') AS folder_title, py AS folder_year, array_to_string(removed_tokens, '|') AS removed_tokens,
  CASE WHEN clash THEN 'title_or_year_mismatch_between_filename_and_folder' END AS conflict, CASE WHEN year IS NOT NULL THEN year_match END AS year_match
FROM {movie_parse}
""")
def _(c):
    e = F.col("evidence.movie")
    return naming.parse(c.files.where(F.col("category").isin("movies", "kids_movies"))).select(
        "media_file_id", "candidate_type", "confidence", "parsed_title", "parsed_year", "edition", "part_number",
        *[e[n].alias(n) for n in ("title_source", "filename_title", "filename_year", "folder_title", "folder_year", "conflict", "year_match")],
        F.array_join(e["removed_tokens"], "|").alias("removed_tokens"))


_SXX = "(?i)S([0-9]{{1,2}})E([0-9]{{1,3}})(?:-?E[0-9]{{1,3}})*"
_X = "(?i)([0-9]{{1,2}})x([0-9]{{1,3}})"
_BONUS = r"(?i)\b(behind the scenes|deleted scenes|deleted scene|gag reel|bloopers|featurette|interview|trailer|extras|extra)\b"
PARTS["tv_texts"] = rf"""
SELECT *, CASE WHEN form IS NOT NULL THEN left(stem, strpos(stem, hit) - 1) ELSE '' END AS head, CASE WHEN form IS NOT NULL THEN substr(stem, strpos(stem, hit) + length(hit)) ELSE '' END AS tail
FROM (SELECT *, CASE form WHEN 'SxxExx' THEN regexp_extract(stem, '{_SXX}') WHEN 'NxNN' THEN regexp_extract(stem, '{_X}') END AS hit
  FROM (SELECT media_file_id, {_STEM} AS stem, layout, {_PARENT} AS parent, CASE WHEN regexp_matches({_STEM}, '{_SXX}') THEN 'SxxExx' WHEN regexp_matches({_STEM}, '{_X}') THEN 'NxNN' END AS form,
      nullif(regexp_extract({_STEM}, '{_BONUS}'), '') AS bonus FROM {{files}} WHERE category IN ('tv', 'kids_shows', 'fitness')))"""
PARTS["head_texts"] = "SELECT media_file_id, head AS raw FROM {tv_texts}"
PARTS["tail_texts"] = "SELECT media_file_id, tail AS raw FROM {tv_texts}"
PARTS["head_clean"] = clean_release_sql("{head_texts}", "media_file_id")
PARTS["tail_clean"] = clean_release_sql("{tail_texts}", "media_file_id")
PARTS["tv_parse"] = rf"""
SELECT *, CASE WHEN form IS NOT NULL THEN CASE WHEN season = 0 THEN 'SPECIAL' ELSE 'EPISODE' END WHEN bonus IS NOT NULL THEN 'EXTRA' ELSE 'UNKNOWN' END AS candidate_type,
  CASE WHEN form IS NOT NULL THEN CASE WHEN series IS NULL OR clash THEN 'LOW' WHEN file_title IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END
    WHEN bonus IS NOT NULL THEN CASE WHEN folder_title IS NOT NULL THEN 'MEDIUM' ELSE 'LOW' END ELSE 'UNKNOWN' END AS confidence
FROM (SELECT *, CASE WHEN form IS NOT NULL THEN coalesce(file_title, folder_title) ELSE folder_title END AS series, coalesce(folder_season <> season, FALSE) AS clash
  FROM (SELECT t.media_file_id, t.form, t.hit, t.bonus, CAST(nullif(regexp_extract(t.hit, '[0-9]+'), '') AS INT) AS season,
      CASE WHEN t.layout = 'tv_season_folder' THEN CAST(nullif(regexp_extract(t.parent, '(?i)^season[\s_-]*([0-9]{{{{1,2}}}})$', 1), '') AS INT) END AS folder_season,
      CASE WHEN form = 'SxxExx' THEN regexp_extract_all(t.hit, '(?i)E([0-9]+)', 1) WHEN form IS NOT NULL THEN [regexp_extract(t.hit, '[0-9]+$')] END AS numbers,
      CASE WHEN p.title <> '' AND NOT {_WEAK.format('p.title')} THEN p.title END AS folder_title,
      CASE WHEN h.title <> '' AND NOT {_WEAK.format('h.title')} THEN h.title END AS file_title,
      CASE WHEN e.title <> '' AND NOT {_WEAK.format('e.title')} THEN e.title END AS episode_title
    FROM {{tv_texts}} t JOIN {{parent_clean}} p ON p.media_file_id = t.media_file_id JOIN {{head_clean}} h ON h.media_file_id = t.media_file_id JOIN {{tail_clean}} e ON e.media_file_id = t.media_file_id))"""


@query("g03_tv_parser", """
SELECT media_file_id, candidate_type, confidence, series AS parsed_series_title, season AS season_number, CAST(numbers[1] AS INT) AS episode_number,
  array_to_string(list_transform(numbers, lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS episode_numbers, episode_title,
  CASE WHEN season = 0 THEN 'season_zero' WHEN form IS NULL THEN lower(bonus) END AS special_type, coalesce(form, CASE WHEN bonus IS NOT NULL THEN 'extra_keyword' END) AS pattern,
  coalesce(hit, bonus) AS matched_text, folder_season, CASE WHEN clash THEN 'season_mismatch_between_filename_and_season_folder' END AS conflict
FROM {tv_parse}
""")
def _(c):
    e = F.col("evidence.tv")
    return naming.parse(c.files.where(~F.col("category").isin("movies", "kids_movies"))).select(
        "media_file_id", "candidate_type", "confidence", "parsed_series_title", "season_number", "episode_number",
        F.array_join("episode_numbers", ",").alias("episode_numbers"), "episode_title", "special_type",
        *[e[n].alias(n) for n in ("pattern", "matched_text", "folder_season", "conflict")])


PARTS["parsed"] = """
SELECT media_file_id, candidate_type, confidence, title AS parsed_title, year AS parsed_year, NULL AS parsed_series_title, CAST(NULL AS INT) AS season_number, CAST(NULL AS INT) AS episode_number FROM {movie_parse}
UNION ALL SELECT media_file_id, candidate_type, confidence, NULL, NULL, series, season, CAST(numbers[1] AS INT) FROM {tv_parse}"""


@query("g04_parser_routing", "SELECT * FROM {parsed}")
def _(c):
    return naming.parse(c.files).select(
        "media_file_id", "candidate_type", "confidence", "parsed_title", "parsed_year", "parsed_series_title", "season_number", "episode_number")


@query("g04_unclassified", """
SELECT f.media_file_id, CASE WHEN t.form IS NOT NULL OR t.bonus IS NOT NULL THEN 'TV' WHEN m.year IS NOT NULL THEN 'MOVIE' ELSE 'TV' END AS parser
FROM (SELECT media_file_id, raw AS stem FROM {file_texts}) f JOIN (SELECT media_file_id, year FROM {file_clean}) m USING (media_file_id)
JOIN (SELECT media_file_id, CASE WHEN regexp_matches(stem, '(?i)S([0-9]{{1,2}})E([0-9]{{1,3}})') OR regexp_matches(stem, '(?i)(^|[^0-9])[0-9]{{1,2}}x[0-9]{{1,3}}([^0-9]|$)') THEN 1 END AS form,
  CASE WHEN regexp_matches(stem, '(?i)\\btrailer\\b') THEN 1 END AS bonus FROM {file_texts}) t USING (media_file_id)
""")
def _(c):
    loose = c.files.withColumns({"category": F.lit("incoming"), "layout": F.lit("unknown")})
    return naming.parse(loose).select("media_file_id", F.when(F.col("evidence.movie").isNotNull(), "MOVIE").otherwise("TV").alias("parser"))


_Q = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
_N = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'null')"


@query("f23_candidate_evidence", f"""
SELECT media_file_id, '{{{{' || CASE WHEN clash THEN '"conflict":"title_or_year_mismatch_between_filename_and_folder",' ELSE '' END || '"filename_title":' || {_Q("nullif(ft, '')")} || ',"filename_year":' || {_N('fy')}
  || ',"folder_title":' || {_Q("nullif(pt, '')")} || ',"folder_year":' || {_N('py')} || ',"removed_tokens":[' || array_to_string(list_transform(removed_tokens, lambda x: '"' || x || '"'), ',') || '],"title_source":' || {_Q('source')}
  || CASE WHEN year IS NOT NULL THEN ',"year_match":' || {_Q('year_match')} ELSE '' END || ',"year_source":' || CASE WHEN year IS NULL THEN 'null' ELSE {_Q('source')} END || '}}}}' AS evidence_json FROM {{movie_parse}}
UNION ALL SELECT media_file_id, CASE WHEN form IS NOT NULL THEN '{{{{' || CASE WHEN clash THEN '"conflict":"season_mismatch_between_filename_and_season_folder",' ELSE '' END || '"filename_season":' || {_N('season')}
    || ',"folder_season":' || {_N('folder_season')} || ',"matched_text":' || {_Q('hit')} || ',"pattern":' || {_Q('form')} || ',"series_title_source":' || CASE WHEN file_title IS NOT NULL THEN '"filename"' WHEN folder_title IS NOT NULL THEN '"parent_directory"' ELSE 'null' END || '}}}}'
  WHEN bonus IS NOT NULL THEN '{{{{"matched_text":' || {_Q('bonus')} || ',"pattern":"extra_keyword"}}}}'
  ELSE '{{{{' || CASE WHEN folder_season IS NULL THEN '' ELSE '"folder_season":' || folder_season || ',' END || CASE WHEN folder_title IS NULL THEN '' ELSE '"folder_series_title":' || {_Q('folder_title')} || ',' END || '"pattern":null}}}}' END FROM {{tv_parse}}
""")
def _(c):
    return naming.parse(c.files).select("media_file_id", naming.evidence_text(F.col("evidence")).alias("evidence_json"))


# --- verification ---------------------------------------------------------------------

_BLOCKING = "(SELECT media_file_id, count(*) AS n FROM {findings} WHERE status = 'ACTIVE' AND severity IN ('ERROR', 'CRITICAL') GROUP BY media_file_id)"
PARTS["verified"] = f"""
SELECT f.*, CASE WHEN never THEN 'NOT_PROBED' WHEN len(failed) > 0 THEN 'FAIL' WHEN len(warned) > 0 THEN 'WARNING' ELSE 'PASS' END AS verification_status
FROM (SELECT f.*, media_info_error IS NULL AND media_info_probed_at IS NULL AS never,
    list_filter([CASE WHEN state <> 'ACTIVE' THEN 'source_active' END, CASE WHEN media_info_error IS NULL AND media_info_probed_at IS NULL OR coalesce(media_info_error, '') <> '' THEN 'metadata_probed' END,
      CASE WHEN NOT never AND size_bytes = 0 THEN 'non_zero_size' END, CASE WHEN NOT never AND coalesce(duration_seconds, 0) <= 0 THEN 'duration_present' END,
      CASE WHEN NOT never AND video_track_count = 0 THEN 'video_track_present' END, CASE WHEN NOT never AND coalesce(b.n, 0) > 0 THEN 'no_blocking_findings' END], lambda x: x IS NOT NULL) AS failed,
    list_filter([CASE WHEN NOT never AND audio_track_count = 0 THEN 'audio_track_present' END,
      CASE WHEN NOT never AND (container = 'Matroska' AND extension <> '.mkv' OR container = 'MPEG-4') THEN 'container_extension_plausible' END], lambda x: x IS NOT NULL) AS warned,
    coalesce(b.n, 0) AS blocking
  FROM {{files}} f LEFT JOIN {_BLOCKING} b ON b.media_file_id = f.media_file_id) f"""


@query("g11_verify_media", """
SELECT media_file_id, verification_status, array_to_string(failed, '|') AS failed, array_to_string(warned, '|') AS warned FROM {verified}
""")
def _(c):
    blocking = findings.blocking_counts(c.findings)
    df = c.files.join(blocking, "media_file_id", "left").withColumn("blocking_finding_count", F.coalesce("blocking_finding_count", F.lit(0)))
    v = checks.verify_media(df)
    return v.select("media_file_id", "verification_status",
                    F.array_join(checks.codes_with(F.col("checks"), "FAIL"), "|").alias("failed"),
                    F.array_join(checks.codes_with(F.col("checks"), "WARNING"), "|").alias("warned"))


PARTS["transfers"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity > 3 AS destination_exists, l_quantity <> 10 AS destination_is_regular_file, 'p' || l_suppkey AS destination_path,
  'p' || CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE l_suppkey END AS plan_destination_path, l_suppkey % 50 AS destination_size_bytes, CASE WHEN l_suppkey % 8 = 0 THEN l_suppkey % 49 ELSE l_suppkey % 50 END AS expected_size_bytes,
  l_linenumber <> 7 AS media_info_probed, CASE WHEN l_partkey % 12 = 0 THEN 'bad' WHEN l_partkey % 12 = 1 THEN '' END AS media_info_error, CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'AVI' ELSE 'Matroska' END AS container,
  CASE WHEN l_partkey % 14 <> 0 THEN CAST(l_partkey AS DOUBLE) END AS duration_seconds, l_partkey % 6 AS video_track_count, l_partkey % 4 AS audio_track_count, '.MKV' AS extension, l_returnflag = 'A' AS checksum_required,
  CASE WHEN l_tax > 0.01 THEN 'd' || l_suppkey END AS source_checksum, 'd' || CASE WHEN l_discount > 0.08 THEN 1 ELSE l_suppkey END AS destination_checksum
FROM {lineitem}"""


@query("g18_transfer_verification", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT media_info_probed THEN 'NOT_PROBED' WHEN len(failed) > 0 THEN 'FAIL' WHEN len(warned) > 0 THEN 'WARNING' ELSE 'PASS' END AS verification_status,
  len(failed) AS failed, len(warned) AS warned
FROM (SELECT *, list_filter([NOT destination_exists, NOT (destination_exists AND destination_is_regular_file), destination_path <> plan_destination_path, NOT (destination_exists AND destination_size_bytes > 0),
    NOT (destination_exists AND destination_size_bytes = expected_size_bytes), NOT media_info_probed OR coalesce(media_info_error, '') <> '', media_info_probed AND container IS NULL, media_info_probed AND duration_seconds IS NULL,
    media_info_probed AND coalesce(duration_seconds, 1) <= 0, media_info_probed AND video_track_count = 0, media_info_probed AND checksum_required AND coalesce(source_checksum <> destination_checksum, TRUE)], lambda x: x) AS failed,
  list_filter([media_info_probed AND audio_track_count = 0, media_info_probed AND coalesce(container = 'AVI', FALSE)], lambda x: x) AS warned FROM {transfers})
""")
def _(c):
    t = c.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity > 3 AS destination_exists", "l_quantity <> 10 AS destination_is_regular_file",
        "concat('p', l_suppkey) AS destination_path", "concat('p', CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE l_suppkey END) AS plan_destination_path",
        "l_suppkey % 50 AS destination_size_bytes", "CASE WHEN l_suppkey % 8 = 0 THEN l_suppkey % 49 ELSE l_suppkey % 50 END AS expected_size_bytes",
        "l_linenumber <> 7 AS media_info_probed", "CASE WHEN l_partkey % 12 = 0 THEN 'bad' WHEN l_partkey % 12 = 1 THEN '' END AS media_info_error",
        "CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'AVI' ELSE 'Matroska' END AS container",
        "CASE WHEN l_partkey % 14 <> 0 THEN CAST(l_partkey AS DOUBLE) END AS duration_seconds", "l_partkey % 6 AS video_track_count",
        "l_partkey % 4 AS audio_track_count", "'.MKV' AS extension", "l_returnflag = 'A' AS checksum_required",
        "CASE WHEN l_tax > 0.01 THEN concat('d', l_suppkey) END AS source_checksum",
        "concat('d', CASE WHEN l_discount > 0.08 THEN 1 ELSE l_suppkey END) AS destination_checksum")
    v = checks.verify_transfer(t)
    count = lambda s: F.size(checks.codes_with(F.col("checks"), s)).cast("long")
    return v.select("l_orderkey", "l_linenumber", "l_partkey", "verification_status", count("FAIL").alias("failed"), count("WARNING").alias("warned"))


@query("g05_value_constraints", """
SELECT CAST(media_file_id AS VARCHAR) AS row_key, 'state in vocabulary' AS rule, state AS value FROM {files} WHERE state NOT IN ('ACTIVE')
UNION ALL SELECT CAST(media_file_id AS VARCHAR), 'size_bytes in range', CAST(size_bytes AS VARCHAR) FROM {files} WHERE size_bytes < 1 OR size_bytes > 400000000
UNION ALL SELECT CAST(media_file_id AS VARCHAR), 'duration_seconds required', NULL FROM {files} WHERE duration_seconds IS NULL
""")
def _(c):
    return checks.violations(c.files, "media_file_id", {"state": ("ACTIVE",), "layout": schemas.LAYOUTS}, {"size_bytes": (1, 400000000)}, ["duration_seconds"])


@query("g05_unique_constraints", """
SELECT relative_path AS row_key, 'relative_path unique' AS rule, CAST(count(*) AS VARCHAR) AS value FROM {files} GROUP BY relative_path HAVING count(*) > 1
UNION ALL SELECT CAST(plan_id AS VARCHAR), 'one executing per plan', CAST(count(*) AS VARCHAR) FROM {executions} WHERE status = 'EXECUTING' GROUP BY plan_id HAVING count(*) > 1
""")
def _(c):
    return checks.repeated(c.files, ["relative_path"], "relative_path unique").unionByName(
        checks.repeated(c.executions, ["plan_id"], "one executing per plan", F.col("status") == "EXECUTING"))


def _orphans(column: str, table: str, parent: str, key: str, name: str) -> str:
    return (f"SELECT CAST(x.{column} AS VARCHAR) AS row_key, '{column} refers to {name}' AS rule, CAST(count(*) AS VARCHAR) AS value "
            f"FROM {{{table}}} x LEFT JOIN {{{parent}}} p ON p.{key} = x.{column} WHERE x.{column} IS NOT NULL AND p.{key} IS NULL GROUP BY x.{column}")


@query("g05_references", " UNION ALL ".join([
    _orphans("identity_id", "assignments", "identities", "identity_id", "identities"),
    _orphans("attempt_id", "matches", "attempts", "attempt_id", "attempts"),
    _orphans("override_id", "attempts", "attempts", "attempt_id", "attempts"),
    _orphans("media_file_id", "attempts", "files", "media_file_id", "files"),
    _orphans("series_provider_id", "episodes", "series", "provider_id", "series")]))
def _(c):
    parents = {"identities": (c.identities, "identity_id"), "attempts": (c.attempts, "attempt_id"), "files": (c.files, "media_file_id"),
               "series": (c.series, "provider_id")}
    return checks.orphans(parents, [
        (c.assignments, "identity_id", "identities"), (c.matches, "attempt_id", "attempts"), (c.attempts, "override_id", "attempts"),
        (c.attempts, "media_file_id", "files"), (c.episodes, "series_provider_id", "series")])
