"""Reconciles of state with a new snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import findings, inventory, naming, reconcile
from shelfmark.sources.store import written
from workload.registry import PARTS, query, run_ts

SCAN = 31
TRACKS = ("video_tracks", "audio_tracks", "subtitle_tracks")


def _with_tracks(df, extra: str):
    """Nested tracks by count; none where the file was not probed or its probe failed."""
    read = "media_info_error IS NULL AND media_file_id % 13 <> 0"
    types = {f.name: f.dataType.simpleString() for f in schemas.LISTED_FILE.fields}
    return df.withColumns({t: _tracks(types[t], read, extra if t == "audio_tracks" else "") for t in TRACKS})


def _tracks(kind: str, read: str, extra: str):
    element = kind[len("array<"):-1]
    members = [m.split(":")[0] for m in element[len("struct<"):-1].split(",")]
    one = ", ".join(f"'{m}', {chr(39) + 'x' + chr(39) if m in ('codec', 'language') else 'NULL'}" for m in members)
    return F.expr(f"CASE WHEN {read} THEN array_repeat(named_struct({one}), CAST(media_file_id % 3 {extra} AS INT)) END").cast(kind)


def _state(c):
    df = _with_tracks(c.snap_old, "")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.FILE_STATE.fields])


def _listing(c):
    df = _with_tracks(c.snap_new, "+ CASE WHEN media_file_id % 47 = 0 THEN 1 ELSE 0 END")
    return df.select("media_file_id", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.LISTED_FILE.fields])


def reconciled(c):
    scanned = c.libraries.where("category <> 'fitness'").select("library_id")
    return inventory.reconcile_listing(_state(c), _listing(c).drop("media_file_id"), SCAN, run_ts(), scanned)


# The listing seen through the probe rules: a failure or no probe keeps the stored metadata.
PARTS["next_files"] = """
SELECT coalesce(o.absolute_path, n.absolute_path) AS absolute_path, o.media_file_id AS old_id, n.media_file_id AS new_id, o.state AS old_state, coalesce(o.category, n.category) AS category,
  n.media_file_id IS NOT NULL AND (n.media_info_error IS NOT NULL OR n.media_file_id % 13 <> 0) AS probed,
  n.media_file_id IS NOT NULL AND n.media_info_error IS NULL AND n.media_file_id % 13 <> 0 AS was_read,
  CASE WHEN n.media_file_id IS NULL OR n.media_info_error IS NOT NULL OR n.media_file_id % 13 = 0 THEN o.container ELSE n.container END AS container,
  o.container AS old_container, CASE WHEN n.media_file_id IS NULL OR (n.media_info_error IS NULL AND n.media_file_id % 13 = 0) THEN o.media_info_error ELSE n.media_info_error END AS media_info_error, o.media_info_error AS old_error,
  o.size_bytes AS old_size, n.size_bytes AS new_size, o.mtime AS old_mtime, n.mtime AS new_mtime, coalesce(o.size_bytes, 0) AS osz,
  CASE WHEN o.media_info_error IS NULL AND o.media_file_id % 13 <> 0 THEN o.media_file_id % 3 ELSE 0 END AS old_audio, n.media_file_id % 3 + CASE WHEN n.media_file_id % 47 = 0 THEN 1 ELSE 0 END AS new_audio
FROM {snap_old} o FULL OUTER JOIN {snap_new} n ON n.absolute_path = o.absolute_path"""
PARTS["file_changes"] = """
SELECT *, CASE WHEN old_id IS NULL THEN 'ADDED' WHEN new_id IS NULL AND old_state = 'ACTIVE' AND category <> 'fitness' THEN 'MISSING' WHEN new_id IS NOT NULL AND old_state = 'MISSING' THEN 'RESTORED'
  WHEN new_id IS NOT NULL AND fields <> '' THEN 'UPDATED' END AS change_type
FROM (SELECT *, CASE WHEN old_id IS NULL OR new_id IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN old_size <> new_size THEN 'size_bytes' END, CASE WHEN old_mtime <> new_mtime THEN 'mtime' END,
    CASE WHEN container IS DISTINCT FROM old_container THEN 'container' END, CASE WHEN media_info_error IS DISTINCT FROM old_error THEN 'media_info_error' END,
    CASE WHEN was_read AND old_audio = 0 AND new_id % 3 > 0 THEN 'video_tracks' END,
    CASE WHEN was_read AND old_audio <> new_audio THEN 'audio_tracks' END, CASE WHEN was_read AND old_audio = 0 AND new_id % 3 > 0 THEN 'subtitle_tracks' END], lambda x: x IS NOT NULL), '|') END AS fields FROM {next_files})"""


@query("r02_snapshot_reconcile", """
SELECT category, change_type, count(*) AS events FROM {file_changes} WHERE change_type IS NOT NULL GROUP BY category, change_type
""")
def _(c):
    events = inventory.change_events(reconciled(c), SCAN).join(c.libraries, "library_id")
    return events.groupBy("category", "change_type").agg(F.count(F.lit(1)).alias("events"))


@query("r02_change_events", "SELECT absolute_path, change_type, nullif(fields, '') AS fields FROM {file_changes} WHERE change_type IS NOT NULL")
def _(c):
    events = inventory.change_events(reconciled(c), SCAN)
    return events.select("absolute_path", "change_type", F.array_join(F.transform("details", lambda d: d["field"]), "|").alias("fields"))


@query("r03_missing_files", """
SELECT absolute_path, old_id AS media_file_id, CASE WHEN new_id IS NOT NULL THEN 'ACTIVE' WHEN change_type = 'MISSING' THEN 'MISSING' ELSE old_state END AS state,
  CAST(CASE WHEN change_type = 'MISSING' THEN 31 WHEN new_id IS NULL AND old_state = 'MISSING' THEN 21 END AS BIGINT) AS missing_since_scan_id
FROM {file_changes} WHERE old_id IS NOT NULL
""")
def _(c):
    nxt = inventory.next_state(reconciled(c))
    return nxt.where(F.col("first_seen_scan_id") < SCAN).select("absolute_path", "media_file_id", "state", "missing_since_scan_id")


@query("r04_metadata_update", """
SELECT absolute_path, container, media_info_error, probed FROM {next_files}
""")
def _(c):
    nxt = inventory.next_state(reconciled(c))
    return nxt.select("absolute_path", "container", "media_info_error", F.coalesce(F.col("media_info_probed_at") == run_ts(), F.lit(False)).alias("probed"))


@query("r05_track_diff", """
SELECT absolute_path, CAST(old_audio AS VARCHAR) AS old_count, CAST(new_audio AS VARCHAR) AS new_count FROM {next_files} WHERE old_id IS NOT NULL AND new_id IS NOT NULL AND was_read AND old_audio <> new_audio
""")
def _(c):
    events = inventory.change_events(reconciled(c), SCAN).select("absolute_path", F.inline("details")).where("field = 'audio_tracks'")
    return events.select("absolute_path", F.col("old").alias("old_count"), F.col("new").alias("new_count"))


@query("r06_relocate", """
SELECT media_file_id, '/nas/movies/moved/' || filename AS absolute_path, absolute_path AS previous_absolute_path,
  array_to_string(list_filter([CASE WHEN library_id <> 1 THEN 'library_id' END, 'size_bytes', 'absolute_path'], lambda x: x IS NOT NULL), '|') AS fields, first_seen_scan_id
FROM {snap_old} WHERE media_file_id % 10 = 3
""")
def _(c):
    state = _state(c)
    moves = state.where("media_file_id % 10 = 3").select(
        "media_file_id", F.lit(1).cast("long").alias("library_id"), F.concat(F.lit("/nas/movies/moved/"), "filename").alias("absolute_path"),
        (F.col("size_bytes") + 5).alias("size_bytes"))
    nxt, events = inventory.relocate(state, moves, SCAN, run_ts())
    return events.join(nxt.select("media_file_id", "first_seen_scan_id"), "media_file_id").select(
        "media_file_id", "absolute_path", "previous_absolute_path", F.array_join(F.transform("details", lambda d: d["field"]), "|").alias("fields"), "first_seen_scan_id")


@query("r01_sync_libraries", """
SELECT s_name AS category, CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 3 = 0 THEN '/new/' ELSE '/lib/' END || s_name AS root_path,
  CASE WHEN s_suppkey % 5 = 0 THEN 'CREATED' WHEN s_suppkey % 7 <> 0 AND s_suppkey % 3 = 0 THEN 'UPDATED' ELSE 'UNCHANGED' END AS outcome
FROM {supplier} WHERE s_suppkey % 5 <> 0 OR s_suppkey % 7 <> 0
""")
def _(c):
    name = F.col("s_name")
    stored = c.supplier.where("s_suppkey % 5 <> 0").select(
        F.col("s_suppkey").alias("library_id"), name.alias("category"), F.concat(F.lit("/lib/"), name).alias("root_path"), run_ts().alias("updated_at"))
    configured = c.supplier.where("s_suppkey % 7 <> 0").select(
        name.alias("category"), F.concat(F.when(F.expr("s_suppkey % 3 = 0"), "/new/").otherwise("/lib/"), name).alias("root_path"))
    return inventory.sync_libraries(stored, configured, run_ts()).select("category", "root_path", "outcome")


def _doubled(c):
    """The listing with some files listed under a second library as well, as nested roots do."""
    once = _listing(c).drop("media_file_id")
    again = once.where("size_bytes % 3 = 0").withColumns({"library_id": F.col("library_id") - 1, "size_bytes": F.col("size_bytes") + 7})
    return once.unionByName(again.where("library_id > 0"))


def _scan(c):
    return inventory.scan(_state(c), _doubled(c), c.libraries.withColumn("exists", F.col("category") != "fitness"), SCAN, run_ts())


@query("r07_run_record", """
SELECT CAST(31 AS BIGINT) AS scan_run_id, 'COMPLETE' AS status, (SELECT count(*) FROM {snap_new}) AS file_count, (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM {snap_new}) AS total_size_bytes,
  count(*) FILTER (WHERE change_type = 'ADDED') AS added_count, count(*) FILTER (WHERE change_type = 'MISSING') AS missing_count,
  count(*) FILTER (WHERE change_type = 'RESTORED') AS restored_count, count(*) FILTER (WHERE change_type = 'UPDATED') AS updated_count FROM {file_changes}
""")
def _(c):
    return inventory.run_row(_scan(c), SCAN, run_ts()).select(
        "scan_run_id", "status", "file_count", "total_size_bytes", "added_count", "missing_count", "restored_count", "updated_count")


@query("r02_nested_roots", """
SELECT coalesce(o.absolute_path, n.absolute_path) AS absolute_path, coalesce(n.size_bytes, o.size_bytes) AS size_bytes FROM {snap_old} o FULL OUTER JOIN {snap_new} n ON n.absolute_path = o.absolute_path
""")
def _(c):
    return inventory.next_state(_scan(c)).select("absolute_path", "size_bytes")


@query("r02_duplicate_ids", "SELECT CAST(NULL AS BIGINT) AS media_file_id, CAST(NULL AS BIGINT) AS row_count FROM {snap_old} WHERE FALSE")
def _(c):
    return inventory.duplicate_ids(_scan(c))


# New files' ids squeezed into few numbers, so that most clash with each other and some with stored ones.
@query("r02_settled_ids", """
SELECT count(*) AS files, count(*) AS ids, count(o.absolute_path) AS stored_ids_kept FROM {snap_old} o FULL OUTER JOIN {snap_new} n ON n.absolute_path = o.absolute_path
""")
def _(c):
    added = F.col("change_type") == "ADDED"
    crowded = written(_scan(c).withColumn("next", F.when(added, F.col("next").withField(
        "media_file_id", F.pmod(F.col("next.media_file_id"), F.lit(500)))).otherwise(F.col("next"))))
    settled = inventory.settled_ids(crowded, SCAN)
    before = crowded.where(~F.coalesce(added, F.lit(False))).select("absolute_path", F.col("next.media_file_id").alias("kept"))
    return settled.join(before, "absolute_path", "left").agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct("next.media_file_id").alias("ids"),
        F.count_if(F.col("next.media_file_id") == F.col("kept")).alias("stored_ids_kept"))


# --- findings and candidates ----------------------------------------------------------

PARTS["stored_findings"] = """
SELECT rule_code, media_file_id, severity, library_id, CASE WHEN media_file_id % 10 = 0 THEN 'older text' ELSE summary END AS summary, evidence_json,
  CASE media_file_id % 4 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'IGNORED' ELSE 'ACTIVE' END AS status FROM {found} WHERE media_file_id % 6 <> 0"""
PARTS["finding_outcomes"] = """
SELECT rule_code, media_file_id, CASE WHEN o.status IS NULL THEN 'CREATED' WHEN n.severity IS NULL THEN CASE o.status WHEN 'ACTIVE' THEN 'RESOLVED' ELSE 'LEFT' END
    WHEN o.status = 'IGNORED' THEN 'IGNORED_TOUCHED' WHEN o.status = 'RESOLVED' THEN 'REACTIVATED' WHEN o.summary = n.summary THEN 'UNCHANGED' ELSE 'UPDATED' END AS outcome,
  CASE WHEN o.status IS NULL THEN 'ACTIVE' WHEN n.severity IS NULL THEN CASE o.status WHEN 'ACTIVE' THEN 'RESOLVED' ELSE o.status END WHEN o.status = 'IGNORED' THEN 'IGNORED' ELSE 'ACTIVE' END AS status,
  CASE WHEN n.severity IS NULL OR o.status = 'IGNORED' THEN o.summary ELSE n.summary END AS summary
FROM {stored_findings} o FULL OUTER JOIN (SELECT * FROM {found} WHERE media_file_id % 5 <> 0) n USING (rule_code, media_file_id)"""


def _findings_run(c):
    then = F.lit("2024-01-01 00:00:00").cast("timestamp")
    stored = findings.evaluate(c.files.where("media_file_id % 6 <> 0")).withColumns({
        "summary": F.when(F.expr("media_file_id % 10 = 0"), "older text").otherwise(F.col("summary")),
        "status": F.expr("CASE media_file_id % 4 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'IGNORED' ELSE 'ACTIVE' END"),
        "first_detected_at": then, "last_detected_at": then, "resolved_at": F.lit(None).cast("timestamp"), "updated_at": then})
    return findings.reconcile_findings(stored, findings.evaluate(c.files.where("media_file_id % 5 <> 0")), run_ts())


@query("r08_findings_reconcile", "SELECT rule_code, media_file_id, outcome, status, summary FROM {finding_outcomes}")
def _(c):
    return _findings_run(c).select("rule_code", "media_file_id", "outcome", "status", "summary")


PARTS["candidate_outcomes"] = """
SELECT media_file_id, CASE WHEN o.confidence IS NULL THEN 'CREATED' WHEN n.confidence IS NULL THEN 'LEFT' WHEN o.parsed_year IS NOT DISTINCT FROM n.parsed_year THEN 'UNCHANGED' ELSE 'UPDATED' END AS outcome,
  CASE WHEN n.confidence IS NULL THEN o.parsed_year ELSE n.parsed_year END AS parsed_year
FROM (SELECT * FROM {candidates} WHERE media_file_id % 8 <> 0) o
FULL OUTER JOIN (SELECT media_file_id, confidence, CAST(CASE WHEN media_file_id % 9 = 1 THEN parsed_year + 1 ELSE parsed_year END AS INT) AS parsed_year FROM {candidates} WHERE media_file_id % 5 <> 0) n USING (media_file_id)"""
_FIELDS = ["candidate_type", "confidence", "parsed_title", "parsed_year", "parsed_series_title", "season_number", "episode_number", "episode_title"]


def _candidates_run(c):
    stored = c.candidates.where("media_file_id % 8 <> 0").withColumns({"created_at": run_ts(), "updated_at": run_ts()})
    fresh = c.candidates.where("media_file_id % 5 <> 0").withColumn(
        "parsed_year", F.expr("CAST(CASE WHEN media_file_id % 9 = 1 THEN parsed_year + 1 ELSE parsed_year END AS INT)"))
    return naming.reconcile_candidates(stored, fresh, run_ts(), _FIELDS)


@query("r09_candidate_reconcile", "SELECT media_file_id, outcome, parsed_year FROM {candidate_outcomes}")
def _(c):
    return _candidates_run(c).select("media_file_id", "outcome", "parsed_year")


@query("a14_outcome_counters", """
SELECT 'findings' AS run, count(*) FILTER (WHERE outcome = 'CREATED') AS created, count(*) FILTER (WHERE outcome = 'UPDATED') AS updated, count(*) FILTER (WHERE outcome = 'UNCHANGED') AS unchanged FROM {finding_outcomes}
UNION ALL SELECT 'candidates', count(*) FILTER (WHERE outcome = 'CREATED'), count(*) FILTER (WHERE outcome = 'UPDATED'), count(*) FILTER (WHERE outcome = 'UNCHANGED') FROM {candidate_outcomes}
""")
def _(c):
    count = lambda df, run: reconcile.outcome_counts(df, ["CREATED", "UPDATED", "UNCHANGED"]).select(F.lit(run).alias("run"), "created", "updated", "unchanged")
    return count(_findings_run(c), "findings").unionByName(count(_candidates_run(c), "candidates"))
