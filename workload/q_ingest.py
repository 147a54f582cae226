"""Destinations, collisions, plans, audits and execution triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import checks, execution, findings, ingest
from shelfmark.sources import config
from workload.registry import PARTS, query, run_ts

CATEGORIES = {"movies": "/nas/movies", "kids_movies": "/nas/kids_movies", "tv": "/nas/tv"}
_SAFE = "nullif(rtrim(trim(regexp_replace(replace({0}, '/', '-'), ' +', ' ', 'g')), '. '), '')"
_TAG = "'S' || lpad(CAST(season_number AS VARCHAR), 2, '0') || 'E' || lpad(CAST(episode_number AS VARCHAR), 2, '0')"
_MOVIE_STEM = "title || ' (' || release_year || ')'"
_SHOW_STEM = f"title || ' - ' || {_TAG} || coalesce(' - ' || episode_title, '')"


@query("g12_movie_destination", f"""
SELECT identity_id, CASE WHEN release_year IS NOT NULL THEN '/nas/movies/' || {_SAFE.format(_MOVIE_STEM)} END AS directory,
  CASE WHEN release_year IS NOT NULL THEN {_SAFE.format(f"{_MOVIE_STEM} || CASE WHEN identity_id % 4 = 0 THEN ' - Final Cut' ELSE '' END")} || '.mkv' END AS filename,
  CASE WHEN release_year IS NULL THEN 'movie destination requires a positive release year' END AS destination_error
FROM {{identities}} WHERE media_type = 'MOVIE'
""")
def _(c):
    df = c.identities.where("media_type = 'MOVIE'").withColumns({
        "extension": F.lit("MKV"), "destination_root": F.lit("/nas/movies/"), "edition": F.expr("CASE WHEN identity_id % 4 = 0 THEN 'Final Cut' END")})
    return ingest.movie_destination(df, edition="edition").select("identity_id", "directory", "filename", "destination_error")


@query("g12_episode_destination", f"""
SELECT identity_id, '/nas/tv/' || {_SAFE.format('title')} || '/Season ' || lpad(CAST(season_number AS VARCHAR), 2, '0') || '/' || {_SAFE.format(
    f"title || ' - ' || {_TAG} || CASE WHEN identity_id % 3 = 0 THEN '-E' || lpad(CAST(episode_number + 1 AS VARCHAR), 2, '0') ELSE '' END || coalesce(' - ' || episode_title, '')")} || '.mkv' AS full_path
FROM {{identities}} WHERE media_type = 'EPISODE' AND season_number IS NOT NULL
""")
def _(c):
    df = c.identities.where("media_type = 'EPISODE' AND season_number IS NOT NULL").withColumns({
        "extension": F.lit(".mkv"), "destination_root": F.lit("/nas/tv"),
        "episode_numbers": F.expr("CASE WHEN identity_id % 3 = 0 THEN array(episode_number, episode_number + 1) ELSE array(episode_number) END")})
    return ingest.episode_destination(df).select("identity_id", "full_path")


# Requests: a destination kind per file, none for some, a wrong or unconfigured one for others.
PARTS["requests"] = """
SELECT media_file_id, CASE media_file_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'tv' WHEN 2 THEN 'kids_tv' WHEN 3 THEN 'kids_movie' WHEN 4 THEN 'tv' ELSE 'movie' END AS destination_kind FROM {files}"""
_KIND = "CASE WHEN media_file_id % 7 = 0 THEN NULL WHEN media_file_id % 7 IN (1, 4) THEN 'tv' WHEN media_file_id % 7 = 2 THEN 'kids_tv' WHEN media_file_id % 7 = 3 THEN 'kids_movie' ELSE 'movie' END AS destination_kind"


def _kinds(c):
    return config.destination_kinds(c.spark, CATEGORIES)


PARTS["resolved_destinations"] = f"""
SELECT *, CASE WHEN destination_error IS NULL THEN root END AS destination_library, CASE WHEN destination_error IS NULL AND destination_kind IS NOT NULL THEN CASE media_type WHEN 'MOVIE' THEN root || '/' || {_SAFE.format(_MOVIE_STEM)}
    ELSE root || '/' || {_SAFE.format('title')} || '/Season ' || lpad(CAST(season_number AS VARCHAR), 2, '0') END END AS destination_directory,
  CASE WHEN destination_error IS NULL AND destination_kind IS NOT NULL THEN CASE media_type WHEN 'MOVIE' THEN {_SAFE.format(_MOVIE_STEM)} ELSE {_SAFE.format(_SHOW_STEM)} END || extension END AS destination_filename
FROM (SELECT *, CASE WHEN destination_kind IS NULL THEN NULL WHEN (media_type = 'MOVIE') <> (destination_kind IN ('movie', 'kids_movie')) THEN 'destination category ''' || destination_kind || ''' is not valid for a ' || media_type || ' identity'
      WHEN destination_kind = 'kids_tv' THEN 'no NAS root configured for destination category ''kids_shows''' WHEN media_type = 'MOVIE' AND release_year IS NULL THEN 'resolved identity has no release year; cannot build a movie destination'
      WHEN media_type = 'EPISODE' AND (season_number IS NULL OR episode_number IS NULL) THEN 'resolved identity has no season/episode number; cannot build an episode destination'
      WHEN extension <> '.mkv' THEN 'destination naming failed: unsupported extension for a destination path: ' || extension END AS destination_error,
    CASE destination_kind WHEN 'movie' THEN '/nas/movies' WHEN 'kids_movie' THEN '/nas/kids_movies' WHEN 'tv' THEN '/nas/tv' END AS root
  FROM (SELECT q.media_file_id, q.destination_kind, f.extension, i.media_type, i.title, i.release_year, i.season_number, i.episode_number, i.episode_title
    FROM {{requests}} q JOIN {{files}} f ON f.media_file_id = q.media_file_id JOIN {{assignments}} a ON a.media_file_id = q.media_file_id JOIN {{identities}} i ON i.identity_id = a.identity_id))"""


@query("g13_destination_resolution", """
SELECT media_file_id, destination_error, destination_directory, destination_filename FROM {resolved_destinations} WHERE destination_kind IS NOT NULL
""")
def _(c):
    df = c.files.select("media_file_id", "extension", F.expr(_KIND)).where("destination_kind IS NOT NULL")
    df = df.join(c.assignments.select("media_file_id", "identity_id"), "media_file_id").join(c.identities, "identity_id")
    return ingest.resolve_destination(df, _kinds(c)).select("media_file_id", "destination_error", "destination_directory", "destination_filename")


@query("j09_inventory_existence", """
SELECT p.plan_id, f.absolute_path IS NOT NULL AS occupied FROM (SELECT plan_id, media_file_id, '/nas/' || CASE WHEN media_file_id % 2 = 0 THEN 'movies' ELSE 'tv' END || '/disk' || media_file_id AS prefix FROM {plans}) p
LEFT JOIN (SELECT absolute_path, '/nas/' || category || '/disk' || media_file_id AS prefix FROM {files} WHERE state = 'ACTIVE') f ON f.prefix = p.prefix
""")
def _(c):
    held = c.files.where("state = 'ACTIVE'").select(F.regexp_extract("absolute_path", "^/nas/[^/]+/[^/]+", 0).alias("absolute_path"))
    root = F.when(F.expr("media_file_id % 2 = 0"), "movies").otherwise("tv")
    plans = c.plans.select("plan_id", F.concat(F.lit("/nas/"), root, F.lit("/disk"), "media_file_id").alias("path"))
    return ingest.with_holder(plans, held.withColumn("held", F.lit(True)), "path", {"held": "occupied"}, spread="plan_id").select("plan_id", "occupied")


PARTS["live_claims"] = "SELECT * FROM {plans} WHERE status NOT IN ('EXECUTED', 'SUPERSEDED')"


@query("j10_competing_plans", """
SELECT p.plan_id, (SELECT min(l.plan_id) FROM {live_claims} l WHERE l.destination_directory = p.destination_directory AND l.destination_filename = p.destination_filename AND l.media_file_id <> p.media_file_id) AS competing_plan_id FROM {plans} p
""")
def _(c):
    return ingest.with_competitor(c.plans, c.plans).select("plan_id", "competing_plan_id")


@query("g14_collisions", """
SELECT p.plan_id, array_to_string(list_filter([CASE WHEN d.absolute_path IS NOT NULL THEN 'destination path already exists on disk: ' || p.path WHEN g.absolute_path IS NOT NULL THEN 'destination directory path is occupied by a file: ' || p.destination_directory END,
  CASE WHEN f.absolute_path IS NOT NULL THEN 'destination path already exists in canonical inventory' END, CASE WHEN p.rival IS NOT NULL THEN 'another active plan (#' || p.rival || ') targets the same destination' END], lambda x: x IS NOT NULL), '; ') AS collisions
FROM (SELECT *, destination_directory || '/' || destination_filename AS path, (SELECT min(l.plan_id) FROM {live_claims} l WHERE l.destination_directory = p.destination_directory AND l.destination_filename = p.destination_filename AND l.media_file_id <> p.media_file_id) AS rival FROM {plans} p) p
LEFT JOIN (SELECT DISTINCT destination_directory || '/' || destination_filename AS absolute_path FROM {plans} WHERE plan_id % 9 = 0) d ON d.absolute_path = p.path
LEFT JOIN (SELECT DISTINCT destination_directory AS absolute_path FROM {plans} WHERE plan_id % 13 = 0) g ON g.absolute_path = p.destination_directory
LEFT JOIN (SELECT DISTINCT destination_directory || '/' || destination_filename AS absolute_path FROM {plans} WHERE plan_id % 17 = 0) f ON f.absolute_path = p.path
""")
def _(c):
    path = F.concat_ws("/", "destination_directory", "destination_filename")
    placed = c.plans.where("destination_directory IS NOT NULL")
    disk = placed.where("plan_id % 9 = 0").select(path.alias("absolute_path")).unionByName(
        placed.where("plan_id % 13 = 0").select(F.col("destination_directory").alias("absolute_path")))
    held = placed.where("plan_id % 17 = 0 OR plan_id % 19 = 0").select(
        path.alias("absolute_path"), F.expr("CASE WHEN plan_id % 17 = 0 THEN 'ACTIVE' ELSE 'MISSING' END AS state"))
    df = c.plans.withColumn("destination_path", F.when(F.col("destination_directory").isNotNull(), path)).withColumn("absolute_path", F.lit("/incoming/x"))
    return ingest.with_collisions(df, held, c.plans, disk, by="plan_id").select("plan_id", F.array_join("collisions", "; ").alias("collisions"))


def _generated(c):
    requests = c.files.select("media_file_id", F.expr(_KIND))
    files = c.files.drop("category", "library_id")
    return ingest.generate(requests, files, c.candidates.where("media_file_id % 25 <> 0"), c.assignments, c.identities,
                           findings.blocking_counts(c.findings), c.plans, _kinds(c))


# Destinations of this catalogue lie outside every disk folder, so only plans compete.
PARTS["generated"] = """
SELECT *, CASE WHEN len(blocks) > 0 THEN 'BLOCKED' WHEN len(reviews) > 0 THEN 'REVIEW_REQUIRED' ELSE 'READY_FOR_REVIEW' END AS status
FROM (SELECT media_file_id, verification_status, dir, fn, len(gate) = 0 AS clear, absolute_path,
    list_filter(list_concat(gate, [CASE WHEN len(gate) = 0 AND destination_kind IS NOT NULL THEN destination_error END,
      CASE WHEN len(gate) = 0 AND rival IS NOT NULL THEN 'another active plan (#' || rival || ') targets the same destination' END]), lambda x: x IS NOT NULL) AS blocks,
    list_filter([CASE WHEN unresolved THEN NULL WHEN assignment_method = 'MANUAL' AND confirmed_by IS NULL THEN 'identity was manually selected and has not yet been confirmed for ingest' END,
      CASE WHEN verification_status = 'WARNING' THEN 'media verification produced warnings' END, CASE WHEN len(gate) = 0 AND destination_kind IS NULL THEN 'destination category not specified' END], lambda x: x IS NOT NULL) AS reviews
  FROM (SELECT v.media_file_id, v.absolute_path, v.verification_status, a.assignment_method, a.confirmed_by, a.assignment_id IS NULL AS unresolved, r.destination_kind, r.destination_error, r.destination_directory AS dir, r.destination_filename AS fn,
      CASE WHEN c1.first_file = v.media_file_id THEN c1.second_id ELSE c1.first_id END AS rival,
      list_filter([CASE WHEN v.media_file_id % 25 = 0 THEN 'no local identification candidate exists for this file' END, CASE WHEN a.assignment_id IS NULL THEN 'no resolved ACTIVE external identity assignment exists for this file' END,
        CASE WHEN v.verification_status IN ('FAIL', 'NOT_PROBED') THEN 'media verification did not pass (status=' || v.verification_status || ')' END], lambda x: x IS NOT NULL) AS gate
    FROM {verified} v LEFT JOIN {assignments} a ON a.media_file_id = v.media_file_id AND a.status = 'ACTIVE' LEFT JOIN {resolved_destinations} r ON r.media_file_id = v.media_file_id
    LEFT JOIN (SELECT destination_directory AS d, destination_filename AS f, min(plan_id) AS first_id, arg_min(media_file_id, plan_id) AS first_file, list_sort(list(plan_id))[2] AS second_id FROM {live_claims} GROUP BY 1, 2) c1
      ON c1.d = r.destination_directory AND c1.f = r.destination_filename))"""


@query("g15_generate_plan", """
SELECT media_file_id, status, verification_status, CASE WHEN clear THEN dir END AS destination_directory, CASE WHEN clear THEN fn END AS destination_filename, array_to_string(list_concat(blocks, reviews), '; ') AS blocking_reasons,
  CASE status WHEN 'BLOCKED' THEN 'Blocked: ' || array_to_string(blocks, '; ') WHEN 'REVIEW_REQUIRED' THEN 'Review required: ' || array_to_string(reviews, '; ') ELSE 'Ready for review; no blocking issues found.' END AS summary
FROM {generated}
""")
def _(c):
    return _generated(c).select("media_file_id", "status", "verification_status", "destination_directory", "destination_filename",
                                F.array_join("blocking_reasons", "; ").alias("blocking_reasons"), "summary")


_ASKED = "CASE media_file_id % 6 WHEN 0 THEN 'movies' WHEN 1 THEN 'tv' WHEN 2 THEN 'books' END"
_UNFIT = (
    "CASE WHEN f.media_file_id IS NULL THEN 'no such media file' "
    "WHEN f.absolute_path NOT LIKE '/nas/movies/%' AND f.absolute_path NOT LIKE '/nas/tv/%' THEN 'the file is not below an incoming root' "
    "WHEN a.kind NOT IN ({kinds}) THEN 'unknown destination category ''' || a.kind || '''' END")
PARTS["asked"] = f"SELECT media_file_id + CASE WHEN media_file_id % 50 = 0 THEN 100000000 ELSE 0 END AS media_file_id, {_ASKED} AS kind FROM {{files}}"
_KNOWN_KINDS = ", ".join(f"'{k}'" for kinds in config.KINDS_BY_MEDIA.values() for k in kinds)
_UNFIT = _UNFIT.replace("{kinds}", _KNOWN_KINDS)


def _admitted(c):
    asked = c.files.select(F.expr("media_file_id + CASE WHEN media_file_id % 50 = 0 THEN 100000000 ELSE 0 END AS media_file_id"), F.expr(f"{_ASKED} AS destination_kind"))
    return ingest.admit(asked, c.files, _kinds(c), ["/nas/movies/", "/nas/tv"])


@query("g15_admitted", f"SELECT media_file_id, kind AS destination_kind FROM (SELECT a.*, {_UNFIT} AS r FROM {{asked}} a LEFT JOIN {{files}} f ON f.media_file_id = a.media_file_id) WHERE r IS NULL")
def _(c):
    return _admitted(c)[0].select("media_file_id", "destination_kind")


@query("g15_rejects", f"SELECT a.media_file_id, {_UNFIT} AS reject_reason FROM {{asked}} a LEFT JOIN {{files}} f ON f.media_file_id = a.media_file_id WHERE {_UNFIT} IS NOT NULL")
def _(c):
    return _admitted(c)[1].select("media_file_id", "reject_reason")


@query("g16_plan_actions", """
SELECT media_file_id, CASE WHEN clear AND dir IS NOT NULL THEN 'VALIDATE_SOURCE|VERIFY_MEDIA|CREATE_DIRECTORY|MOVE|REFRESH_INVENTORY|REQUEST_PLEX_REFRESH' ELSE 'VALIDATE_SOURCE|VERIFY_MEDIA' END AS actions FROM {generated}
""")
def _(c):
    return _generated(c).select("media_file_id", F.array_join(F.transform("actions", lambda a: a["action_type"]), "|").alias("actions"))


@query("w08_ordered_actions", """
SELECT plan_id, n AS action_order, CASE n WHEN 1 THEN 'VALIDATE_SOURCE' WHEN 2 THEN 'VERIFY_MEDIA' WHEN 3 THEN 'CREATE_DIRECTORY' WHEN 4 THEN 'MOVE' WHEN 5 THEN 'REFRESH_INVENTORY' ELSE 'REQUEST_PLEX_REFRESH' END AS action_type,
  CASE n WHEN 3 THEN destination_directory WHEN 4 THEN destination_directory || '/' || destination_filename END AS destination_path
FROM {plans}, (VALUES (1), (2), (3), (4), (5), (6)) v(n) WHERE n <= 2 OR destination_filename IS NOT NULL
""")
def _(c):
    full = F.when(F.col("destination_filename").isNotNull(), F.concat_ws("/", "destination_directory", "destination_filename"))
    df = c.plans.withColumn("actions", ingest.actions(F.concat(F.lit("/incoming/"), "media_file_id"), F.col("destination_directory"), full))
    return ingest.action_rows(df, "plan_id").select("plan_id", "action_order", "action_type", "destination_path")


PARTS["old_plans"] = """
SELECT plan_id, media_file_id, candidate_id, status, plan_version, '/src/' || media_file_id AS source_path, CASE WHEN media_file_id % 12 = 0 THEN 'older' ELSE 'text' END AS summary FROM {plans}"""
_NEW = "CASE WHEN media_file_id % 8 = 0 THEN 'BLOCKED' ELSE 'READY_FOR_REVIEW' END"


@query("r15_plan_reconcile", f"""
SELECT media_file_id, status, plan_version, outcome FROM (
  SELECT *, CASE WHEN old_status = 'SUPERSEDED' THEN 'LEFT' WHEN media_file_id % 9 = 0 THEN 'LEFT'
      WHEN old_status = 'APPROVED' THEN CASE WHEN summary = 'text' AND fresh = 'READY_FOR_REVIEW' THEN 'UNTOUCHED' ELSE 'SUPERSEDED' END WHEN summary = 'text' AND old_status = fresh THEN 'UNTOUCHED' ELSE 'UPDATED' END AS outcome,
    CASE outcome WHEN 'LEFT' THEN old_status WHEN 'UNTOUCHED' THEN old_status WHEN 'SUPERSEDED' THEN 'SUPERSEDED' ELSE fresh END AS status, CASE outcome WHEN 'UPDATED' THEN old_version + 1 ELSE old_version END AS plan_version
  FROM (SELECT media_file_id, status AS old_status, plan_version AS old_version, summary, {_NEW} AS fresh FROM {{old_plans}}))
UNION ALL SELECT media_file_id, {_NEW}, CASE status WHEN 'SUPERSEDED' THEN 1 ELSE plan_version + 1 END, 'INSERTED' FROM {{old_plans}}
  WHERE media_file_id % 9 <> 0 AND (status = 'SUPERSEDED' OR status = 'APPROVED' AND (summary <> 'text' OR {_NEW} <> 'READY_FOR_REVIEW'))
""")
def _(c):
    content = ["candidate_id", "source_path", "summary"]
    stored = c.plans.select(
        "plan_id", "media_file_id", "candidate_id", "status", "plan_version", F.concat(F.lit("/src/"), "media_file_id").alias("source_path"),
        F.expr("CASE WHEN media_file_id % 12 = 0 THEN 'older' ELSE 'text' END AS summary"), "updated_at", F.col("updated_at").alias("created_at"))
    fresh = c.plans.where("media_file_id % 9 <> 0").select(
        "media_file_id", "candidate_id", F.concat(F.lit("/src/"), "media_file_id").alias("source_path"), F.lit("text").alias("summary"), F.expr(f"{_NEW} AS status"))
    return ingest.reconcile_plans(stored, fresh, run_ts(), content).select("media_file_id", "status", "plan_version", "outcome")


def _approvals(c):
    return c.decisions.select((F.col("key_id") + 1).alias("plan_id"), "decided_by", "decided_at", "decision_id")


@query("r16_approve", """
SELECT p.plan_id, CASE WHEN d.key_id IS NOT NULL AND p.status = 'READY_FOR_REVIEW' THEN 'APPROVED' ELSE p.status END AS status, CASE WHEN p.status = 'READY_FOR_REVIEW' THEN d.decided_by END AS approved_by
FROM {plans} p LEFT JOIN {first_decisions} d ON d.key_id + 1 = p.plan_id
""")
def _(c):
    return ingest.approve(_unapproved(c), _approvals(c), run_ts())[0].select("plan_id", "status", "approved_by")


def _unapproved(c):
    return c.plans.withColumns({"approved_at": F.lit(None).cast("timestamp"), "approved_by": F.lit(None).cast("string")})


@query("r16_approve_rejects", """
SELECT d.decision_id, d.key_id + 1 AS plan_id, CASE WHEN p.plan_id IS NULL THEN 'no such plan' WHEN p.status = 'READY_FOR_REVIEW' THEN 'plan is APPROVED, not READY_FOR_REVIEW' ELSE 'plan is ' || p.status || ', not READY_FOR_REVIEW' END AS reject_reason
FROM {decisions} d LEFT JOIN {plans} p ON d.key_id + 1 = p.plan_id LEFT JOIN {first_decisions} f ON f.decision_id = d.decision_id
WHERE p.plan_id IS NULL OR p.status <> 'READY_FOR_REVIEW' OR f.decision_id IS NULL
""")
def _(c):
    return ingest.approve(_unapproved(c), _approvals(c), run_ts())[1].select("decision_id", "plan_id", "reject_reason")


# --- audit ----------------------------------------------------------------------------

_ACTIONS = "CASE WHEN media_file_id % 16 = 0 THEN 0 WHEN media_file_id % 18 = 0 THEN 1 WHEN media_file_id % 20 = 0 THEN 2 ELSE 3 END"
PARTS["open_overrides"] = "SELECT media_file_id, entry_id AS override_id FROM {override_rows} WHERE action = 'CREATE' AND cleared_at IS NULL"
PARTS["audit_rows"] = f"""
SELECT p.plan_id, p.status, list_filter([CASE WHEN p.status <> 'APPROVED' THEN 'plan_status_approved' END, CASE WHEN p.status = 'SUPERSEDED' THEN 'plan_not_superseded' END,
    CASE WHEN f.media_file_id IS NULL THEN 'source_media_file_exists' END, CASE WHEN coalesce(f.state, '') <> 'ACTIVE' THEN 'source_state_active' END,
    CASE WHEN f.media_file_id IS NULL THEN 'source_path_matches_plan_snapshot' END, CASE WHEN f.media_file_id IS NULL OR p.media_file_id % 33 = 0 THEN 'source_size_matches_plan_snapshot' END,
    CASE WHEN f.media_file_id IS NULL THEN 'source_mtime_matches_plan_snapshot' END,
    CASE WHEN c.candidate_id IS NULL OR t.override_id IS DISTINCT FROM o.override_id THEN 'current_candidate_matches_plan' END,
    CASE WHEN a.assignment_id IS NULL THEN 'active_assignment_matches_plan' END, CASE WHEN p.media_file_id % 5 = 3 THEN 'external_identity_exists' END,
    CASE WHEN p.media_file_id % 27 = 0 THEN 'verification_snapshot_present' END, CASE WHEN p.media_file_id % 27 = 0 OR p.media_file_id % 15 = 1 THEN 'verification_snapshot_passed' END,
    CASE WHEN b.media_file_id IS NOT NULL THEN 'no_current_blocking_findings' END,
    CASE WHEN p.destination_library IS NULL THEN 'destination_category_valid' END, CASE WHEN p.destination_library IS NULL THEN 'destination_root_configured' END,
    CASE WHEN p.destination_library IS NULL OR p.destination_directory LIKE '/tmp/%' THEN 'destination_path_inside_root' END,
    CASE WHEN x.path IS NOT NULL THEN 'destination_still_unoccupied' END,
    CASE WHEN (SELECT min(l.plan_id) FROM {{live_claims}} l WHERE l.destination_directory = p.destination_directory AND l.destination_filename = p.destination_filename AND l.media_file_id <> p.media_file_id) IS NOT NULL THEN 'no_competing_current_plan' END,
    CASE WHEN p.kind = 0 THEN 'proposed_actions_present' END, CASE WHEN p.kind = 1 THEN 'action_order_valid' END, CASE WHEN p.kind = 2 THEN 'action_types_supported_by_future_executor' END,
    CASE WHEN p.kind = 1 THEN 'every_action_state_is_proposed_not_executed' END, CASE WHEN p.kind = 2 THEN 'overwrite_not_requested' END, CASE WHEN p.kind = 2 THEN 'no_unknown_or_unsupported_action' END], lambda x: x IS NOT NULL) AS failed
FROM (SELECT *, {_ACTIONS} AS kind FROM {{plans}}) p LEFT JOIN (SELECT * FROM {{files}} WHERE media_file_id % 35 <> 0) f ON f.media_file_id = p.media_file_id
LEFT JOIN (SELECT * FROM {{candidates}} WHERE media_file_id % 25 <> 0) c ON c.media_file_id = p.media_file_id LEFT JOIN {{assignments}} a ON a.media_file_id = p.media_file_id AND a.status = 'ACTIVE'
LEFT JOIN {{attempts}} t ON t.attempt_id = p.media_file_id LEFT JOIN {{open_overrides}} o ON o.media_file_id = p.media_file_id
LEFT JOIN (SELECT DISTINCT media_file_id FROM {{findings}} WHERE status = 'ACTIVE' AND severity IN ('ERROR', 'CRITICAL')) b ON b.media_file_id = p.media_file_id
LEFT JOIN (SELECT DISTINCT destination_directory || '/' || destination_filename AS path FROM {{plans}} WHERE plan_id % 21 = 0) x ON x.path = p.destination_directory || '/' || p.destination_filename"""
_IN = lambda group: "list_has_any(failed, [" + ", ".join(f"'{x}'" for x in checks.READINESS_GROUPS[group]) + "])"


@query("g17_readiness_audit", f"""
SELECT plan_id, CASE WHEN {_IN('BLOCKED')} THEN 'BLOCKED' WHEN {_IN('STALE')} THEN 'STALE' WHEN {_IN('INCOMPLETE')} THEN 'INCOMPLETE' ELSE 'READY_FOR_EXECUTOR' END AS readiness_status, array_to_string(failed, '|') AS failed, CAST(25 AS BIGINT) AS checks
FROM {{audit_rows}}
""")
def _(c):
    files = c.files.where("media_file_id % 35 <> 0")
    snapshot = c.files.select("media_file_id", F.col("absolute_path").alias("source_path"), F.expr("size_bytes + CASE WHEN media_file_id % 33 = 0 THEN 1 ELSE 0 END AS source_size_bytes"), F.col("mtime").alias("source_mtime"))
    action = "named_struct('action_order', {0}, 'action_type', '{1}', 'execution_state', {2}, 'overwrite_requested', {3})"
    good = action.format(1, "VALIDATE_SOURCE", f"'{schemas.PROPOSED}'", "false")
    plans = c.plans.join(snapshot, "media_file_id").withColumns({
        "verification_status": F.expr("CASE WHEN media_file_id % 27 = 0 THEN NULL WHEN media_file_id % 15 = 1 THEN 'WARNING' ELSE 'PASS' END"),
        "actions": F.expr(f"CASE {_ACTIONS} WHEN 0 THEN slice(array({good}), 1, 0) WHEN 1 THEN array({action.format(2, 'MOVE', 'CAST(NULL AS STRING)', 'false')})"
                          f" WHEN 2 THEN array({good}, {action.format(2, 'ERASE', chr(39) + schemas.PROPOSED + chr(39), 'true')}) ELSE array({good}) END")})
    from shelfmark.operators import identity

    overrides = identity.active_overrides(identity.override_history(c.override_log)[0])
    listing = c.plans.where("plan_id % 21 = 0 AND destination_directory IS NOT NULL").select(F.concat_ws("/", "destination_directory", "destination_filename").alias("absolute_path"))
    # Identities known are those of files not in every fifth place.
    known = c.assignments.where("media_file_id % 5 <> 3").select(F.col("assignment_id").alias("identity_id"))
    assignments = c.assignments.withColumn("identity_id", F.col("assignment_id"))
    audited = ingest.audit(plans, files, c.candidates.where("media_file_id % 25 <> 0"), overrides, assignments, c.attempts, known,
                           findings.blocking_counts(c.findings), c.libraries, listing)
    return audited.select("plan_id", "readiness_status", F.array_join(checks.codes_with(F.col("checks"), "FAIL"), "|").alias("failed"), F.size("checks").cast("long").alias("checks"))


# --- execution ------------------------------------------------------------------------

_RECOVERY = """CASE step WHEN 'CREATE_DESTINATION_DIRECTORY' THEN 'NONE' WHEN 'REFRESH_INVENTORY' THEN 'INVENTORY_REFRESH_INCOMPLETE'
    WHEN 'VERIFY_DESTINATION_MEDIA' THEN CASE WHEN strategy LIKE 'SAME%' THEN 'DESTINATION_UNVERIFIED_SOURCE_REMOVED' ELSE 'DESTINATION_VERIFIED_SOURCE_NOT_REMOVED' END
    WHEN 'ATOMIC_RENAME' THEN CASE WHEN strategy LIKE 'SAME%' THEN 'PARTIAL_DESTINATION_SOURCE_INTACT' ELSE 'OTHER_REQUIRES_MANUAL_INSPECTION' END
    WHEN 'FINAL_RENAME' THEN CASE WHEN strategy LIKE 'CROSS%' THEN 'PARTIAL_DESTINATION_SOURCE_INTACT' ELSE 'OTHER_REQUIRES_MANUAL_INSPECTION' END
    ELSE CASE WHEN strategy LIKE 'CROSS%' THEN 'DESTINATION_VERIFIED_SOURCE_NOT_REMOVED' ELSE 'OTHER_REQUIRES_MANUAL_INSPECTION' END END"""
PARTS["event_starts"] = """
SELECT e.plan_id, min(e.seq) AS seq FROM {transfer_events} e JOIN {plans} p ON p.plan_id = e.plan_id AND p.status = 'APPROVED' WHERE e.event = 'START' GROUP BY e.plan_id"""
PARTS["event_ends"] = """
SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.plan_id ORDER BY e.seq) AS n FROM {transfer_events} e JOIN {event_starts} s ON s.plan_id = e.plan_id AND e.seq > s.seq WHERE e.event <> 'START') WHERE n = 1"""


@query("r17_status_transitions", f"""
SELECT p.plan_id, CASE WHEN e.event = 'SUCCEED' THEN 'EXECUTED' WHEN r = 'NONE' THEN 'EXECUTION_FAILED' WHEN r IS NOT NULL THEN 'RECOVERY_REQUIRED' WHEN s.seq IS NOT NULL THEN 'EXECUTING' ELSE p.status END AS status,
  CASE WHEN e.event = 'SUCCEED' THEN 'NONE' ELSE r END AS recovery_status
FROM {{plans}} p LEFT JOIN {{event_starts}} s ON s.plan_id = p.plan_id LEFT JOIN (SELECT *, CASE WHEN event = 'FAIL' THEN {_RECOVERY} END AS r FROM {{event_ends}}) e ON e.plan_id = p.plan_id
""")
def _(c):
    return execution.fold_events(c.plans, c.transfer_events)[0].select("plan_id", "status", "recovery_status")


@query("r17_illegal_transitions", """
SELECT e.plan_id, e.seq, CASE WHEN p.plan_id IS NULL THEN 'no such plan' WHEN e.event = 'START' THEN 'plan is not APPROVED' ELSE 'plan is not EXECUTING' END AS reject_reason
FROM {transfer_events} e LEFT JOIN {plans} p ON p.plan_id = e.plan_id LEFT JOIN {event_starts} s ON s.seq = e.seq LEFT JOIN {event_ends} x ON x.seq = e.seq WHERE s.seq IS NULL AND x.seq IS NULL
""")
def _(c):
    return execution.fold_events(c.plans, c.transfer_events)[1].select("plan_id", "seq", "reject_reason")


# The same log where some entries lost their number or their kind: those are illegal whatever else they say.
PARTS["torn_events"] = """
SELECT plan_id, CASE WHEN seq % 11 = 3 THEN NULL ELSE seq END AS seq, CASE WHEN seq % 13 = 5 THEN NULL ELSE event END AS event, strategy, step FROM {transfer_events}"""


@query("r17_torn_log", """
SELECT e.plan_id, CASE WHEN p.plan_id IS NULL THEN 'no such plan' ELSE 'no seq or event' END AS reject_reason, count(*) AS entries
FROM {torn_events} e LEFT JOIN {plans} p ON p.plan_id = e.plan_id WHERE e.seq IS NULL OR e.event IS NULL GROUP BY 1, 2
""")
def _(c):
    torn = c.transfer_events.withColumns({"event": F.expr("CASE WHEN seq % 13 = 5 THEN NULL ELSE event END"), "__seq": F.expr("CASE WHEN seq % 11 = 3 THEN NULL ELSE seq END")})
    torn = torn.withColumn("seq", F.col("__seq")).drop("__seq")
    rejects = execution.fold_events(c.plans, torn)[1].where("seq IS NULL OR event IS NULL")
    return rejects.groupBy("plan_id", "reject_reason").agg(F.count(F.lit(1)).alias("entries"))


PARTS["on_disk"] = """
SELECT source_path AS absolute_path FROM {executions} WHERE execution_id % 3 = 0 UNION ALL SELECT destination_path FROM {executions} WHERE execution_id % 4 = 0
UNION ALL SELECT regexp_replace(destination_path, '[^/]+$', '') || '.' || regexp_extract(destination_path, '[^/]+$') || '.partial-t' || execution_id FROM {executions} WHERE execution_id % 6 = 0"""


@query("g19_recovery_triage", """
SELECT e.execution_id, CASE WHEN e.status = 'EXECUTING' AND NOT coalesce(l.token = e.lock_token, FALSE) THEN 'INTERRUPTED_STATE_UNKNOWN' ELSE e.recovery_status END AS recovery_status,
  e.execution_id % 3 = 0 AS source_exists, d.path IS NOT NULL AS destination_exists, coalesce(x.n, 0) AS partial_file_count, l.token IS NOT NULL AS lock_held, coalesce(l.token = e.lock_token, FALSE) AS lock_matches_execution
FROM {executions} e LEFT JOIN (SELECT plan_id, 't' || max(execution_id) AS token FROM {executions} WHERE execution_id % 2 = 0 GROUP BY plan_id) l ON l.plan_id = e.plan_id
LEFT JOIN (SELECT DISTINCT destination_path AS path FROM {executions} WHERE execution_id % 4 = 0) d ON d.path = e.destination_path
LEFT JOIN (SELECT destination_path AS path, count(*) AS n FROM {executions} WHERE execution_id % 6 = 0 GROUP BY 1) x ON x.path = e.destination_path
""")
def _(c):
    locks = c.executions.where("execution_id % 2 = 0").groupBy("plan_id").agg(F.concat(F.lit("t"), F.max("execution_id").cast("string")).alias("token"))
    partial = F.concat(F.regexp_replace("destination_path", "[^/]+$", ""), F.lit("."), F.regexp_extract("destination_path", "[^/]+$", 0), F.lit(".partial-t"), "execution_id")
    e = c.executions
    listing = (
        e.where("execution_id % 3 = 0").select(F.col("source_path").alias("absolute_path"))
        .unionByName(e.where("execution_id % 4 = 0").select(F.col("destination_path").alias("absolute_path")))
        .unionByName(e.where("execution_id % 6 = 0").select(partial.alias("absolute_path"))))
    return execution.triage(e, locks, listing).select(
        "execution_id", "recovery_status", "source_exists", "destination_exists", "partial_file_count", "lock_held", "lock_matches_execution")


@query("g19_partial_files", """
SELECT destination_path, regexp_replace(destination_path, '[^/]+$', '') || '.' || regexp_extract(destination_path, '[^/]+$') || '.partial-t' || execution_id AS partial_path FROM {executions} WHERE execution_id % 6 = 0
""")
def _(c):
    partial = F.concat(F.regexp_replace("destination_path", "[^/]+$", ""), F.lit("."), F.regexp_extract("destination_path", "[^/]+$", 0), F.lit(".partial-t"), "execution_id")
    files = c.executions.where("execution_id % 6 = 0").select(partial.alias("absolute_path")).unionByName(c.executions.select(F.col("source_path").alias("absolute_path")))
    return execution.partial_files(files, "partial")
