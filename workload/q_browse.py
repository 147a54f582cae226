"""Listings, look-ups, joins, rankings and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import findings as rules
from shelfmark.operators import inventory, linkage, reconcile
from shelfmark.plans import browse, stats
from shelfmark.sources import readback
from workload.registry import PARTS, query

_FILE = "media_file_id, category, relative_path, state, layout, media_info_error"


def _files(df):
    return df.select(*_FILE.split(", "))


@query("p01_list_files", f"SELECT {_FILE} FROM {{files}} WHERE category = 'movies' AND state = 'ACTIVE' AND layout = 'movie_flat' AND media_info_error IS NULL")
def _(c):
    return _files(browse.list_files(c.files, category="movies", state="ACTIVE", layout="movie_flat", metadata_error=False))


@query("p01_list_files_with_errors", f"SELECT {_FILE} FROM {{files}} WHERE media_info_error IS NOT NULL")
def _(c):
    return _files(browse.list_files(c.files, metadata_error=True))


@query("p01_get_file", f"SELECT {_FILE} FROM {{files}} WHERE media_file_id = 77")
def _(c):
    return _files(browse.get_file(c.files, 77))


@query("w07_ordered_limit", f"SELECT {_FILE} FROM {{files}} ORDER BY category, relative_path, media_file_id LIMIT 50")
def _(c):
    return _files(browse.list_files(c.files, limit=50))


@query("p02_search_files", f"""
SELECT {_FILE} FROM {{files}} WHERE state = 'ACTIVE' AND (lower(filename) LIKE '%red%(19_7)%' OR lower(relative_path) LIKE '%red%(19_7)%' OR lower(absolute_path) LIKE '%red%(19_7)%')
""")
def _(c):
    return _files(browse.search_files(c.files, "RED%(19_7)", state="ACTIVE"))


_CHANGE = "event_id, scan_run_id, media_file_id, change_type, absolute_path, category"


@query("p04_changes_in_range", """
SELECT event_id, scan_run_id, media_file_id, change_type, absolute_path, l.category FROM {changes} c LEFT JOIN {libraries} l ON l.library_id = c.library_id
WHERE scan_run_id > 3 AND scan_run_id <= 17 AND change_type = 'UPDATED'
""")
def _(c):
    return browse.list_changes(c.changes, c.libraries, from_scan=3, to_scan=17, change_type="UPDATED").select(*_CHANGE.split(", "))


@query("p04_changes_of_category", """
SELECT event_id, scan_run_id, media_file_id, change_type, absolute_path, l.category FROM {changes} c JOIN {libraries} l ON l.library_id = c.library_id WHERE l.category = 'tv'
""")
def _(c):
    return browse.list_changes(c.changes, c.libraries, category="tv").select(*_CHANGE.split(", "))


@query("p05_latest_scan_changes", """
SELECT event_id, scan_run_id, media_file_id, change_type, absolute_path, l.category FROM {changes} c LEFT JOIN {libraries} l ON l.library_id = c.library_id
WHERE scan_run_id = (SELECT max(scan_run_id) FROM {runs} WHERE status = 'COMPLETE')
""")
def _(c):
    return browse.select_changes(c.changes, c.libraries, c.runs).select(*_CHANGE.split(", "))


@query("p05_latest_scan_by_trigger", """
SELECT max(scan_run_id) AS scan_run_id FROM {runs} WHERE status = 'COMPLETE' AND triggered_by = 'SCAN'
""")
def _(c):
    return browse.latest_complete_scan(c.runs, "SCAN")


_FINDING = "media_file_id, rule_code, severity, status, category, relative_path"


@query("p06_list_findings", """
SELECT f.media_file_id, rule_code, severity, status, l.category, m.relative_path FROM {findings} f
LEFT JOIN {libraries} l ON l.library_id = f.library_id LEFT JOIN {media} m ON m.media_file_id = f.media_file_id WHERE status = 'ACTIVE' AND severity = 'ERROR'
""")
def _(c):
    files = c.files.drop("category", "library_id")
    return browse.list_findings(c.findings, files, c.libraries, status="ACTIVE", severity="ERROR").select(*_FINDING.split(", "))


@query("p06_top_findings", """
SELECT f.media_file_id, rule_code, severity, status, l.category, m.relative_path FROM {findings} f
LEFT JOIN {libraries} l ON l.library_id = f.library_id LEFT JOIN {media} m ON m.media_file_id = f.media_file_id
ORDER BY coalesce(l.category, ''), coalesce(m.relative_path, ''), CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END,
  CASE rule_code WHEN 'missing_file' THEN 0 WHEN 'metadata_error' THEN 1 WHEN 'metadata_not_probed' THEN 2 WHEN 'unknown_layout' THEN 3 WHEN 'zero_byte_file' THEN 4
    WHEN 'suspiciously_small_media' THEN 5 WHEN 'no_video_track' THEN 6 WHEN 'no_audio_track' THEN 7 ELSE 8 END, f.media_file_id LIMIT 40
""")
def _(c):
    return browse.list_findings(c.findings, c.files.drop("category", "library_id"), c.libraries, limit=40).select(*_FINDING.split(", "))


@query("p07_list_candidates", """
SELECT c.media_file_id, f.category, c.candidate_type, c.confidence, c.parsed_title, c.parsed_year FROM {candidates} c JOIN {files} f ON f.media_file_id = c.media_file_id
WHERE c.candidate_type = 'MOVIE' AND c.confidence = 'HIGH' AND c.parsed_year IS NOT NULL AND f.category = 'kids_movies'
""")
def _(c):
    return browse.list_candidates(c.candidates, c.files, "MOVIE", "HIGH", "kids_movies", has_year=True).select(
        "media_file_id", "category", "candidate_type", "confidence", "parsed_title", "parsed_year")


@query("p07_candidates_of_season", """
SELECT c.media_file_id, f.category, c.candidate_type, c.parsed_series_title FROM {candidates} c JOIN {files} f ON f.media_file_id = c.media_file_id
WHERE c.season_number = 2 AND c.parsed_year IS NULL
""")
def _(c):
    return browse.list_candidates(c.candidates, c.files, season_number=2, has_year=False).select(
        "media_file_id", "category", "candidate_type", "parsed_series_title")


@query("p08_list_attempts", """
SELECT a.attempt_id, a.status, f.category, f.absolute_path, m.rank, m.provider_id FROM {attempts} a LEFT JOIN {files} f ON f.media_file_id = a.media_file_id
LEFT JOIN {matches} m ON m.attempt_id = a.attempt_id WHERE a.status = 'REVIEW_REQUIRED'
""")
def _(c):
    listed = browse.list_attempts(c.attempts, c.files, status="REVIEW_REQUIRED")
    return readback.child_rows(listed, c.matches, "attempt_id", "rank", ["provider_id"]).select(
        "attempt_id", "status", "category", "absolute_path", "rank", "provider_id")


@query("p08_newest_attempts", """
SELECT attempt_id, status FROM {attempts} ORDER BY started_at DESC, attempt_id DESC LIMIT 25
""")
def _(c):
    return browse.list_attempts(c.attempts, c.files, limit=25).select("attempt_id", "status")


@query("p09_list_plans", """
SELECT p.plan_id, p.status, f.category FROM {plans} p LEFT JOIN {files} f ON f.media_file_id = p.media_file_id WHERE p.status = 'APPROVED' AND f.category = 'movies'
""")
def _(c):
    return browse.list_plans(c.plans, c.files, status="APPROVED", category="movies").select("plan_id", "status", "category")


@query("p09_current_plans", "SELECT plan_id, media_file_id, status FROM {plans} WHERE status <> 'SUPERSEDED'")
def _(c):
    return browse.current_plans(c.plans).select("plan_id", "media_file_id", "status")


@query("p10_list_executions", """
SELECT e.execution_id, e.plan_id, e.status, s.step_order, s.step_status FROM {executions} e LEFT JOIN {steps} s ON s.execution_id = e.execution_id
WHERE e.recovery_status = 'PARTIAL_DESTINATION_SOURCE_INTACT'
""")
def _(c):
    listed = browse.list_executions(c.executions, recovery_status="PARTIAL_DESTINATION_SOURCE_INTACT")
    return readback.child_rows(listed, c.steps, "execution_id", "step_order", ["step_status"]).select(
        "execution_id", "plan_id", "status", "step_order", "step_status")


@query("p10_latest_execution", """
SELECT plan_id, max(execution_id) AS execution_id, arg_max(status, execution_id) AS status FROM {executions} GROUP BY plan_id
""")
def _(c):
    return browse.latest_execution(c.executions).select("plan_id", "execution_id", "status")


@query("p11_active_assignments", """
SELECT a.assignment_id, a.media_file_id, i.media_type, i.title FROM {assignments} a LEFT JOIN {identities} i ON i.identity_id = a.identity_id WHERE a.status = 'ACTIVE'
""")
def _(c):
    return browse.active_assignments(c.assignments, c.identities).select("assignment_id", "media_file_id", "media_type", "title")


@query("j01_library_join", "SELECT f.media_file_id, l.category, l.root_path FROM {files} f JOIN {libraries} l ON l.library_id = f.library_id")
def _(c):
    return c.files.drop("category").join(c.libraries, "library_id").select("media_file_id", "category", "root_path")


@query("j02_left_enrichment", """
SELECT f.media_file_id, f.rule_code, l.category, m.state FROM {findings} f LEFT JOIN {libraries} l ON l.library_id = f.library_id LEFT JOIN {media} m ON m.media_file_id = f.media_file_id
""")
def _(c):
    return browse.list_findings(c.findings, c.files.select("media_file_id", "absolute_path", "relative_path", F.col("state")).drop("state"), c.libraries).join(
        c.files.select("media_file_id", "state"), "media_file_id", "left").select("media_file_id", "rule_code", "category", "state")


@query("j03_track_counts", """
SELECT media_file_id, count(*) FILTER (WHERE kind = 'video') AS video_track_count, count(*) FILTER (WHERE kind = 'audio') AS audio_track_count,
  count(*) FILTER (WHERE kind = 'subtitle') AS subtitle_track_count FROM {tracks} GROUP BY media_file_id
""")
def _(c):
    return browse.track_counts(c.tracks)


@query("j04_tracks_of_active", """
SELECT t.media_file_id, t.track_index, t.kind FROM {tracks} t WHERE media_file_id IN (SELECT media_file_id FROM {files} WHERE state = 'ACTIVE')
""")
def _(c):
    active = c.files.where("state = 'ACTIVE'").select("media_file_id")
    return c.tracks.join(active, "media_file_id", "left_semi").select("media_file_id", "track_index", "kind")


@query("j05_unattempted", """
SELECT media_file_id, candidate_type FROM {candidates} WHERE media_file_id NOT IN (SELECT media_file_id FROM {attempts})
""")
def _(c):
    return linkage.unattempted(c.candidates, c.attempts).select("media_file_id", "candidate_type")


@query("j06_keyed_reconcile", """
SELECT media_file_id, CASE WHEN o.media_file_id IS NULL THEN 'new' WHEN n.media_file_id IS NULL THEN 'old'
  WHEN o.size_bytes IS NOT DISTINCT FROM n.size_bytes AND o.container IS NOT DISTINCT FROM n.container AND o.media_info_error IS NOT DISTINCT FROM n.media_info_error THEN 'same' ELSE 'changed' END AS outcome
FROM {snap_old} o FULL OUTER JOIN {snap_new} n USING (media_file_id)
""")
def _(c):
    both = reconcile.pair(c.snap_old, c.snap_new, ["media_file_id"])
    outcome = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "old").when(
        reconcile.same(["size_bytes", "container", "media_info_error"]), "same").otherwise("changed")
    return both.select("media_file_id", outcome.alias("outcome"))


# Attempts folded to a few parents, so that some have over 1,000 children.
@query("j08_ordered_children", """
SELECT p.parent_id, m.match_id, m.provider_id FROM (SELECT range AS parent_id FROM range(8)) p LEFT JOIN {matches} m ON m.attempt_id % 5 = p.parent_id
""")
def _(c):
    children = c.matches.withColumn("parent_id", F.col("attempt_id") % 5)
    return readback.child_rows(c.spark.range(8).toDF("parent_id"), children, "parent_id", "match_id", ["provider_id"])


# --- statistics -----------------------------------------------------------------------

LIBRARY_STATS = """
SELECT l.category, l.root_path, count(*) FILTER (WHERE f.state = 'ACTIVE') AS active_count, count(*) FILTER (WHERE f.state = 'MISSING') AS missing_count,
  CAST(coalesce(sum(f.size_bytes) FILTER (WHERE f.state = 'ACTIVE'), 0) AS BIGINT) AS active_total_size_bytes
FROM {libraries} l LEFT JOIN {files} f ON f.library_id = l.library_id GROUP BY l.category, l.root_path"""


@query("a01_library_stats", LIBRARY_STATS)
def _(c):
    return stats.library_stats(c.files, c.libraries)


_HISTOGRAMS = """
SELECT 'layout' AS metric, layout AS key, count(*) AS n FROM {files} WHERE state = 'ACTIVE' GROUP BY layout
UNION ALL SELECT 'extension', extension, count(*) FROM {files} WHERE state = 'ACTIVE' GROUP BY extension"""


@query("a02_histograms", _HISTOGRAMS)
def _(c):
    return stats.union(stats.layout_counts(c.files), stats.extension_counts(c.files))


_METADATA = """
SELECT count(*) FILTER (WHERE media_info_error IS NULL AND media_info_probed_at IS NOT NULL) AS success_count, count(*) FILTER (WHERE media_info_error IS NOT NULL) AS error_count,
  count(*) FILTER (WHERE media_info_probed_at IS NULL) AS not_probed_count FROM {files} WHERE state = 'ACTIVE'"""


@query("a03_metadata_counts", _METADATA)
def _(c):
    return stats.metadata_counts(c.files)


_TRACKS = """
SELECT count(*) FILTER (WHERE kind = 'video') AS video_count, count(*) FILTER (WHERE kind = 'audio') AS audio_count, count(*) FILTER (WHERE kind = 'subtitle') AS subtitle_count
FROM {tracks} t JOIN {files} f ON f.media_file_id = t.media_file_id WHERE f.state = 'ACTIVE'"""


@query("a04_track_totals", _TRACKS)
def _(c):
    return stats.track_totals(c.files, c.tracks)


PARTS["lib_stats"], PARTS["meta_stats"], PARTS["track_stats"] = LIBRARY_STATS, _METADATA, _TRACKS


@query("a05_inventory_stats", f"""
SELECT 'library_active_count' AS metric, category AS key, active_count AS n FROM {{lib_stats}} UNION ALL SELECT 'library_missing_count', category, missing_count FROM {{lib_stats}}
UNION ALL SELECT 'library_active_total_size_bytes', category, active_total_size_bytes FROM {{lib_stats}}
UNION ALL SELECT 'total', 'active_count', CAST(sum(active_count) AS BIGINT) FROM {{lib_stats}} UNION ALL SELECT 'total', 'missing_count', CAST(sum(missing_count) AS BIGINT) FROM {{lib_stats}}
UNION ALL SELECT 'total', 'active_total_size_bytes', CAST(sum(active_total_size_bytes) AS BIGINT) FROM {{lib_stats}}
UNION ALL {_HISTOGRAMS}
UNION ALL SELECT 'metadata', 'success_count', success_count FROM {{meta_stats}} UNION ALL SELECT 'metadata', 'error_count', error_count FROM {{meta_stats}}
UNION ALL SELECT 'metadata', 'not_probed_count', not_probed_count FROM {{meta_stats}}
UNION ALL SELECT 'tracks', 'video_count', video_count FROM {{track_stats}} UNION ALL SELECT 'tracks', 'audio_count', audio_count FROM {{track_stats}}
UNION ALL SELECT 'tracks', 'subtitle_count', subtitle_count FROM {{track_stats}}
UNION ALL SELECT 'most_recent_scan', 'scan_run_id', max(scan_run_id) FROM {{runs}}
""")
def _(c):
    return stats.inventory_stats(c.files, c.libraries, c.runs, c.tracks)


@query("a06_change_counts", """
SELECT scan_run_id, count(*) FILTER (WHERE change_type = 'ADDED') AS added_count, count(*) FILTER (WHERE change_type = 'MISSING') AS missing_count,
  count(*) FILTER (WHERE change_type = 'RESTORED') AS restored_count, count(*) FILTER (WHERE change_type = 'UPDATED') AS updated_count FROM {changes} GROUP BY scan_run_id
""")
def _(c):
    return inventory.change_counts(c.changes)


@query("a07_diff_counts", """
SELECT 'change_type' AS metric, change_type AS key, count(*) AS n FROM {changes} WHERE scan_run_id > 3 AND scan_run_id <= 17 GROUP BY change_type
UNION ALL SELECT 'total', 'total_changes', count(*) FROM {changes} WHERE scan_run_id > 3 AND scan_run_id <= 17
""")
def _(c):
    return stats.diff_counts(browse.list_changes(c.changes, c.libraries, from_scan=3, to_scan=17))


@query("a08_findings_stats", """
SELECT 'status' AS metric, status AS key, count(*) AS n FROM {findings} GROUP BY status UNION ALL SELECT 'total', 'findings', count(*) FROM {findings}
UNION ALL SELECT 'severity', severity, count(*) FROM {findings} WHERE status = 'ACTIVE' GROUP BY severity UNION ALL SELECT 'rule', rule_code, count(*) FROM {findings} WHERE status = 'ACTIVE' GROUP BY rule_code
""")
def _(c):
    return stats.findings_stats(c.findings)


@query("a09_candidate_stats", """
SELECT 'type' AS metric, candidate_type AS key, count(*) AS n FROM {candidates} GROUP BY candidate_type UNION ALL SELECT 'confidence', confidence, count(*) FROM {candidates} GROUP BY confidence
UNION ALL SELECT 'year', CASE WHEN parsed_year IS NULL THEN 'without_year' ELSE 'with_year' END, count(*) FROM {candidates} GROUP BY 2 UNION ALL SELECT 'total', 'candidates', count(*) FROM {candidates}
""")
def _(c):
    return stats.candidate_stats(c.candidates)


@query("a10_status_stats", """
SELECT 'status' AS metric, status AS key, count(*) AS n FROM {attempts} GROUP BY status UNION ALL SELECT 'total', 'attempts', count(*) FROM {attempts}
UNION ALL SELECT 'status', status, count(*) FROM {plans} GROUP BY status UNION ALL SELECT 'total', 'plans', count(*) FROM {plans}
""")
def _(c):
    return stats.union(stats.status_stats(c.attempts, "attempts"), stats.status_stats(c.plans, "plans"))


@query("a12_listing_rollup", """
SELECT category, 'file_count' AS metric, count(*) AS n FROM {files} GROUP BY category UNION ALL SELECT category, 'total_size_bytes', CAST(sum(size_bytes) AS BIGINT) FROM {files} GROUP BY category
UNION ALL SELECT category, 'layout:' || layout, count(*) FROM {files} GROUP BY category, layout
UNION ALL SELECT category, 'metadata_extracted', count(*) FILTER (WHERE media_info_probed_at IS NOT NULL AND media_info_error IS NULL) FROM {files} GROUP BY category
UNION ALL SELECT category, 'metadata_errors', count(*) FILTER (WHERE media_info_error IS NOT NULL) FROM {files} GROUP BY category
""")
def _(c):
    return stats.listing_rollup(c.files.withColumn("probed", F.col("media_info_probed_at").isNotNull()))


@query("a13_blocking_counts", """
SELECT media_file_id, count(*) AS blocking_finding_count FROM {findings} WHERE status = 'ACTIVE' AND severity IN ('ERROR', 'CRITICAL') GROUP BY media_file_id
""")
def _(c):
    return rules.blocking_counts(c.findings)


@query("w06_latest_per_key", """
SELECT media_file_id, attempt_id, status FROM (SELECT *, row_number() OVER (PARTITION BY media_file_id ORDER BY started_at DESC, attempt_id DESC) AS n FROM {attempts}) WHERE n = 1
""")
def _(c):
    return browse.latest_attempt(c.attempts).select("media_file_id", "attempt_id", "status")
