"""Identities, assignments, reviews and overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import identity, ingest, linkage
from shelfmark.sources.store import written
from workload import q_linkage
from workload.registry import PARTS, query, run_ts


@query("r10_identity_upsert", """
SELECT media_type, provider_id, coalesce(n.title, o.title) AS title, CASE WHEN n.provider_id IS NULL THEN 'LEFT' WHEN o.provider_id IS NULL THEN 'CREATED' WHEN o.title IS NOT DISTINCT FROM n.title THEN 'UNCHANGED' ELSE 'UPDATED' END AS outcome
FROM (SELECT media_type, provider_id, title FROM {identities} WHERE identity_id % 3 <> 0) o
FULL OUTER JOIN (SELECT media_type, provider_id, title FROM (
    SELECT i.media_type, i.provider_id, CASE WHEN l.l_linenumber > 5 THEN i.title || ' II' ELSE i.title END AS title, row_number() OVER (PARTITION BY i.media_type, i.provider_id ORDER BY l.l_orderkey DESC, l.l_linenumber DESC) AS n
    FROM {lineitem} l JOIN {identities} i ON i.identity_id = l.l_partkey) WHERE n = 1) n USING (media_type, provider_id)
""")
def _(c):
    fields = ["title", "release_year"]
    stored = c.identities.where("identity_id % 3 <> 0").select("identity_id", "media_type", "provider_id", *fields, run_ts().alias("updated_at"))
    seen = c.lineitem.join(c.identities, F.col("l_partkey") == F.col("identity_id")).select(
        "media_type", "provider_id", F.when(F.col("l_linenumber") > 5, F.concat("title", F.lit(" II"))).otherwise(F.col("title")).alias("title"),
        "release_year", "l_orderkey", "l_linenumber")
    return identity.upsert_identities(stored, seen, run_ts(), ["l_orderkey", "l_linenumber"], fields).select(
        "media_type", "provider_id", "title", "outcome")


def _assigned(c):
    stored = c.assignments.select(
        F.col("assignment_id").alias("id"), "media_file_id", "identity_id", "assignment_method", "confidence", "status", "created_at", "updated_at")
    incoming = c.assignments.where("media_file_id % 2 = 0").select(
        "media_file_id", F.expr("CASE WHEN media_file_id % 10 = 0 THEN identity_id + 1 ELSE identity_id END AS identity_id"),
        "assignment_method", F.expr("CASE WHEN media_file_id % 14 = 0 THEN 'LOW' ELSE confidence END AS confidence"))
    return identity.assign(stored, incoming, run_ts())


@query("r12_assign_identity", """
SELECT media_file_id, identity_id, confidence, status, 'KEPT' AS outcome FROM {assignments} WHERE status <> 'ACTIVE' OR media_file_id % 2 = 1 OR (media_file_id % 10 <> 0 AND media_file_id % 14 <> 0)
UNION ALL SELECT media_file_id, identity_id, confidence, 'SUPERSEDED', 'CLOSED' FROM {assignments} WHERE status = 'ACTIVE' AND media_file_id % 2 = 0 AND (media_file_id % 10 = 0 OR media_file_id % 14 = 0)
UNION ALL SELECT media_file_id, CASE WHEN media_file_id % 10 = 0 THEN identity_id + 1 ELSE identity_id END, CASE WHEN media_file_id % 14 = 0 THEN 'LOW' ELSE confidence END, 'ACTIVE', 'OPENED' FROM {assignments}
  WHERE media_file_id % 2 = 0 AND (status <> 'ACTIVE' OR media_file_id % 10 = 0 OR media_file_id % 14 = 0)
""")
def _(c):
    return _assigned(c).select("media_file_id", "identity_id", "confidence", "status", "outcome")


# From matches to assignments. New identities get ids of their own, so a check names them by their provider.
PARTS["open_assignments"] = """
SELECT a.*, i.media_type, i.provider_id FROM {assignments} a JOIN {identities} i ON i.identity_id = a.identity_id"""
PARTS["run_choices"] = """
SELECT e.media_file_id, CASE WHEN c.candidate_type = 'MOVIE' THEN 'MOVIE' ELSE 'EPISODE' END AS media_type, x.provider_id, 'AUTO' AS assignment_method, 'HIGH' AS confidence
FROM {evaluated} e JOIN {candidates} c ON c.media_file_id = e.media_file_id
JOIN (SELECT media_file_id, provider_id FROM {exact_matches} WHERE rank = 1 UNION ALL SELECT media_file_id, provider_id FROM {episode_matches} WHERE rank = 1) x ON x.media_file_id = e.media_file_id
WHERE e.status = 'RESOLVED'"""
# A review of a file's attempt: a click selects one of its first three matches, the last valid decision of the file counts.
PARTS["review_choices"] = """
SELECT media_file_id, media_type, provider_id, assignment_method, CASE WHEN total_score >= 0.9 THEN 'HIGH' WHEN total_score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (
  SELECT e.media_file_id, CASE WHEN c.candidate_type = 'MOVIE' THEN 'MOVIE' ELSE 'EPISODE' END AS media_type, x.provider_id, 'MANUAL' AS assignment_method, x.total_score,
    row_number() OVER (PARTITION BY e.media_file_id ORDER BY d.decided_at DESC, d.decision_id DESC) AS n
  FROM {decisions} d JOIN {evaluated} e ON e.media_file_id = d.key_id AND d.event_type = 'click' AND e.status NOT IN ('SKIPPED', 'FAILED') JOIN {candidates} c ON c.media_file_id = e.media_file_id
  JOIN (SELECT media_file_id, provider_id, rank, total_score FROM {exact_matches} UNION ALL SELECT media_file_id, provider_id, rank, total_score FROM {episode_matches}) x
    ON x.media_file_id = e.media_file_id AND x.rank = d.decision_id % 3 + 1) WHERE n = 1"""
_CHAIN = """
SELECT a.media_file_id, a.media_type, a.provider_id, a.assignment_method, a.confidence, CASE WHEN a.status <> 'ACTIVE' OR n.media_file_id IS NULL OR same THEN a.status ELSE 'SUPERSEDED' END AS status,
  CASE WHEN a.status <> 'ACTIVE' OR n.media_file_id IS NULL OR same THEN 'KEPT' ELSE 'CLOSED' END AS outcome
FROM (SELECT a.*, n.media_file_id IS NOT NULL AND n.media_type = a.media_type AND n.provider_id = a.provider_id AND n.assignment_method = a.assignment_method AND n.confidence = a.confidence AS same
  FROM {open_assignments} a LEFT JOIN {%s} n ON n.media_file_id = a.media_file_id) a LEFT JOIN {%s} n ON n.media_file_id = a.media_file_id
UNION ALL
SELECT n.media_file_id, n.media_type, n.provider_id, n.assignment_method, n.confidence, 'ACTIVE', 'OPENED'
FROM {%s} n LEFT JOIN {open_assignments} a ON a.media_file_id = n.media_file_id AND a.status = 'ACTIVE' AND a.media_type = n.media_type AND a.provider_id = n.provider_id AND a.assignment_method = n.assignment_method AND a.confidence = n.confidence
WHERE a.media_file_id IS NULL
"""


def _resolved(c, chosen):
    fields = ["title", "release_year", "season_number", "episode_number", "episode_title"]
    stored = c.identities.select("identity_id", "media_type", "provider_id", *fields, run_ts().alias("updated_at"))
    held = c.assignments.select(
        F.col("assignment_id").alias("id"), "media_file_id", "identity_id", "attempt_id", "assignment_method", "confidence", "status", "created_at", "updated_at")
    held = held.join(c.identities.select("identity_id"), "identity_id").select(held.columns)
    identities, assignments = identity.resolve(chosen, stored, held, run_ts(), fields)
    named = identities.select("identity_id", "media_type", "provider_id")
    return assignments.join(named, "identity_id").select("media_file_id", "media_type", "provider_id", "assignment_method", "confidence", "status", "outcome")


@query("r12_chain_of_a_run", _CHAIN % ("run_choices", "run_choices", "run_choices"))
def _(c):
    attempts = q_linkage.attempted(c)
    return _resolved(c, identity.chosen_by_run(attempts, linkage.selected_matches(attempts)))


@query("r12_chain_of_reviews", _CHAIN % ("review_choices", "review_choices", "review_choices"))
def _(c):
    attempts = q_linkage.attempted(c)
    asked = c.decisions.where("event_type = 'click'").select(
        F.col("key_id").alias("media_file_id"), (F.col("decision_id") % 3 + 1).cast("int").alias("rank"), "decided_at", "decision_id")
    looked_at = attempts.join(asked.select("media_file_id").distinct(), "media_file_id", "left_semi")
    candidates = c.candidates.join(looked_at.select("media_file_id"), "media_file_id", "left_semi")
    _, movies, series, episodes, errors = q_linkage._searched(c)
    listed = written(linkage.first_listed(candidates, series, episodes, 3, errors))
    shown = linkage.matches_at(looked_at, asked, listed, written(linkage.shared_matches(candidates, movies, errors, ranks=3)))
    log = asked.join(shown.select("media_file_id", "rank", "attempt_id", "match_id"), ["media_file_id", "rank"]).select(
        "attempt_id", "match_id", F.lit("SELECT").alias("action"), "decided_at", "decision_id")
    reviewed, _rejects = identity.review_attempts(looked_at, log, shown)
    matches = identity.review_matches(shown, reviewed)
    return _resolved(c, identity.chosen_by_review(reviewed, matches, log))


# Events of a user are decisions on the attempt, assignment or plan of that number; every one is checked by itself.
PARTS["reviews"] = """
SELECT d.decision_id, d.decided_at, d.key_id * 3 AS attempt_id, a.attempt_id IS NOT NULL AS known,
  CASE d.event_type WHEN 'click' THEN 'SELECT' WHEN 'view' THEN 'REJECT' WHEN 'error' THEN 'SELECT' ELSE 'OTHER' END AS action,
  CASE WHEN d.event_type = 'click' THEN d.key_id * 300 + 2 + CASE WHEN d.decision_id % 7 = 0 THEN 50 ELSE 0 END END AS match_id,
  EXISTS (SELECT 1 FROM {matches} m WHERE m.attempt_id = d.key_id * 3 AND d.event_type = 'click' AND m.match_id = d.key_id * 300 + 2 + CASE WHEN d.decision_id % 7 = 0 THEN 50 ELSE 0 END) AS own
FROM {decisions} d LEFT JOIN {attempts} a ON a.attempt_id = d.key_id * 3"""
PARTS["last_reviews"] = """
SELECT attempt_id, action, match_id FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY decided_at DESC, decision_id DESC) AS n
  FROM {reviews} WHERE known AND (action = 'REJECT' OR (action = 'SELECT' AND own))) WHERE n = 1"""


@query("r13_review_decisions", """
SELECT a.attempt_id, CASE d.action WHEN 'SELECT' THEN 'RESOLVED' WHEN 'REJECT' THEN 'NO_MATCH' ELSE a.status END AS status,
  CASE d.action WHEN 'SELECT' THEN d.match_id WHEN 'REJECT' THEN NULL ELSE a.selected_match_id END AS selected_match_id
FROM {attempts} a LEFT JOIN {last_reviews} d ON d.attempt_id = a.attempt_id
""")
def _(c):
    reviewed, _rejects = identity.review_attempts(c.attempts, _reviews(c), c.matches)
    return reviewed.select("attempt_id", "status", "selected_match_id")


def _reviews(c):
    action = F.expr("CASE event_type WHEN 'click' THEN 'SELECT' WHEN 'view' THEN 'REJECT' WHEN 'error' THEN 'SELECT' ELSE 'OTHER' END")
    return c.decisions.select(
        (F.col("key_id") * 3).alias("attempt_id"), action.alias("action"),
        F.expr("CASE WHEN event_type = 'click' THEN key_id * 300 + 2 + CASE WHEN decision_id % 7 = 0 THEN 50 ELSE 0 END END").alias("match_id"),
        "decided_at", "decision_id")


@query("r13_review_rejects", """
SELECT decision_id, attempt_id, CASE WHEN NOT known THEN 'no such attempt' WHEN action = 'OTHER' THEN 'unknown action' WHEN match_id IS NULL THEN 'no match named' ELSE 'the match is not one of the attempt' END AS reject_reason
FROM {reviews} WHERE NOT known OR action = 'OTHER' OR (action = 'SELECT' AND NOT own)
""")
def _(c):
    return identity.review_attempts(c.attempts, _reviews(c), c.matches)[1].select("decision_id", "attempt_id", "reject_reason")


@query("r13_reviewed_matches", """
SELECT m.match_id, coalesce(m.match_id = CASE d.action WHEN 'SELECT' THEN d.match_id WHEN 'REJECT' THEN NULL ELSE a.selected_match_id END, FALSE) AS selected,
  CASE WHEN m.score >= 0.9 THEN 'HIGH' WHEN m.score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS manual_confidence
FROM {matches} m LEFT JOIN {attempts} a ON a.attempt_id = m.attempt_id LEFT JOIN {last_reviews} d ON d.attempt_id = a.attempt_id
""")
def _(c):
    reviewed, _rejects = identity.review_attempts(c.attempts, _reviews(c), c.matches)
    return identity.review_matches(c.matches, reviewed).select("match_id", "selected", "manual_confidence")


def _on_assignments(c):
    return c.decisions.select((F.col("key_id") * 10).alias("assignment_id"), "decided_by", "decided_at", "decision_id")


@query("r13_revoke", """
SELECT a.assignment_id, CASE WHEN d.key_id IS NOT NULL AND a.status = 'ACTIVE' THEN 'REVOKED' ELSE a.status END AS status
FROM {assignments} a LEFT JOIN (SELECT DISTINCT key_id FROM {decisions}) d ON d.key_id * 10 = a.assignment_id
""")
def _(c):
    return identity.revoke(c.assignments, _on_assignments(c), run_ts())[0].select("assignment_id", "status")


PARTS["first_decisions"] = """
SELECT key_id, decision_id, decided_by FROM (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY decided_at, decision_id) AS n FROM {decisions}) WHERE n = 1"""
_UNCONFIRMABLE = "CASE WHEN a.assignment_id IS NULL THEN 'no such assignment' WHEN a.status <> 'ACTIVE' THEN 'assignment is ' || a.status || ', not ACTIVE' WHEN a.assignment_method <> 'MANUAL' THEN 'assignment was made automatically; nothing to confirm' END"


@query("r13_confirm", """
SELECT a.assignment_id, CASE WHEN a.confirmed_by IS NULL AND a.status = 'ACTIVE' AND a.assignment_method = 'MANUAL' THEN d.decided_by ELSE a.confirmed_by END AS confirmed_by
FROM {assignments} a LEFT JOIN {first_decisions} d ON d.key_id * 10 = a.assignment_id
""")
def _(c):
    return identity.confirm(c.assignments, _on_assignments(c), run_ts())[0].select("assignment_id", "confirmed_by")


@query("r13_confirm_rejects", f"""
SELECT decision_id, assignment_id, reject_reason FROM (SELECT d.decision_id, d.key_id * 10 AS assignment_id, {_UNCONFIRMABLE} AS reject_reason
  FROM {{decisions}} d LEFT JOIN {{assignments}} a ON d.key_id * 10 = a.assignment_id) WHERE reject_reason IS NOT NULL
""")
def _(c):
    return identity.confirm(c.assignments, _on_assignments(c), run_ts())[1].select("decision_id", "assignment_id", "reject_reason")


# Plans made against an assignment that has been replaced since, and plans without one.
PARTS["bound_plans"] = """
SELECT plan_id, media_file_id, CASE WHEN plan_id % 17 = 0 THEN NULL WHEN plan_id % 13 = 0 THEN assignment_id + 1 ELSE assignment_id END AS assignment_id FROM {plans}"""
PARTS["plan_confirms"] = f"""
SELECT d.decision_id, d.decided_at, d.decided_by, d.key_id + 1 AS plan_id, p.assignment_id AS bound_id,
  CASE WHEN p.plan_id IS NULL THEN 'no such plan' WHEN p.assignment_id IS NULL THEN 'plan has no resolved identity assignment to confirm'
    WHEN c.assignment_id IS DISTINCT FROM p.assignment_id THEN 'the plan''s assignment is no longer the current one of its file' ELSE {_UNCONFIRMABLE} END AS reject_reason
FROM {{decisions}} d LEFT JOIN {{bound_plans}} p ON p.plan_id = d.key_id + 1 LEFT JOIN {{assignments}} c ON c.media_file_id = p.media_file_id AND c.status = 'ACTIVE'
LEFT JOIN {{assignments}} a ON a.assignment_id = p.assignment_id"""


def _by_plan(c):
    bound = c.plans.select("plan_id", "media_file_id", F.expr(
        "CASE WHEN plan_id % 17 = 0 THEN NULL WHEN plan_id % 13 = 0 THEN assignment_id + 1 ELSE assignment_id END").alias("assignment_id"))
    asked = c.decisions.select((F.col("key_id") + 1).alias("plan_id"), "decided_by", "decided_at", "decision_id")
    return identity.confirm_by_plan(c.assignments, bound, asked, run_ts())


@query("r13_confirm_by_plan", """
SELECT a.assignment_id, CASE WHEN a.confirmed_by IS NULL THEN d.decided_by ELSE a.confirmed_by END AS confirmed_by FROM {assignments} a
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY bound_id ORDER BY decided_at, decision_id) AS n FROM {plan_confirms} WHERE reject_reason IS NULL) d ON d.bound_id = a.assignment_id AND d.n = 1
""")
def _(c):
    return _by_plan(c)[0].select("assignment_id", "confirmed_by")


@query("r13_confirm_by_plan_rejects", "SELECT decision_id, plan_id, reject_reason FROM {plan_confirms} WHERE reject_reason IS NOT NULL")
def _(c):
    return _by_plan(c)[1].select("decision_id", "plan_id", "reject_reason")


PARTS["override_rows"] = """
SELECT *, lead(entry_at) OVER (PARTITION BY media_file_id ORDER BY entry_at, entry_id) AS cleared_at FROM (
  SELECT * FROM {override_log} WHERE action = 'CLEAR' OR (candidate_type = 'MOVIE' AND trim(title) <> '')
    OR (candidate_type = 'EPISODE' AND series_title IS NOT NULL AND season_number IS NOT NULL AND episode_numbers IS NOT NULL))"""


@query("r14_override_history", """
SELECT entry_id AS override_id, media_file_id, cleared_at IS NULL AS is_open, strftime(cleared_at, '%Y-%m-%d %H:%M:%S') AS cleared FROM {override_rows} WHERE action = 'CREATE'
""")
def _(c):
    history, _rejects = identity.override_history(c.override_log)
    return history.select("override_id", "media_file_id", F.col("cleared_at").isNull().alias("is_open"), F.date_format("cleared_at", "yyyy-MM-dd HH:mm:ss").alias("cleared"))


@query("r14_override_rejects", """
SELECT entry_id, CASE WHEN candidate_type = 'MOVIE' THEN 'a MOVIE override requires a non-empty title' WHEN candidate_type <> 'EPISODE' THEN 'unsupported override candidate_type' WHEN series_title IS NULL THEN 'an EPISODE override requires a non-empty series title'
  WHEN season_number IS NULL THEN 'an EPISODE override requires a season number' ELSE 'an EPISODE override requires at least one episode number' END AS reject_reason
FROM {override_log} WHERE entry_id NOT IN (SELECT entry_id FROM {override_rows})
""")
def _(c):
    return identity.override_history(c.override_log)[1].select("entry_id", "reject_reason")


@query("p11_active_overrides", "SELECT media_file_id, entry_id AS override_id, candidate_type FROM {override_rows} WHERE action = 'CREATE' AND cleared_at IS NULL")
def _(c):
    return identity.active_overrides(identity.override_history(c.override_log)[0]).select("media_file_id", "override_id", "candidate_type")


@query("j11_effective_candidate", """
SELECT media_file_id, CASE WHEN o.entry_id IS NULL THEN 'PARSED' ELSE 'MANUAL_OVERRIDE' END AS source, CASE WHEN o.entry_id IS NULL THEN p.candidate_type ELSE o.candidate_type END AS candidate_type,
  CASE WHEN o.entry_id IS NULL THEN p.confidence ELSE 'HIGH' END AS confidence, CASE WHEN o.entry_id IS NULL THEN p.parsed_title ELSE o.title END AS parsed_title,
  CASE WHEN o.entry_id IS NULL THEN p.episode_number ELSE o.episode_numbers[1] END AS episode_number, p.candidate_id, o.entry_id AS override_id
FROM {candidates} p FULL OUTER JOIN (SELECT * FROM {override_rows} WHERE action = 'CREATE' AND cleared_at IS NULL) o USING (media_file_id)
""")
def _(c):
    parsed = c.candidates.withColumn("episode_numbers", F.when(F.col("episode_number").isNotNull(), F.array("episode_number")))
    return identity.effective(parsed, identity.override_history(c.override_log)[0]).select(
        "media_file_id", "source", "candidate_type", "confidence", "parsed_title", "episode_number", "candidate_id", "override_id")


@query("j12_override_lineage", """
SELECT a.assignment_id, t.override_id AS plan_override_id FROM {assignments} a LEFT JOIN {attempts} t ON t.attempt_id = a.attempt_id
""")
def _(c):
    return ingest.override_lineage(c.assignments, c.attempts).select("assignment_id", "plan_override_id")
