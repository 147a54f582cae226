"""Identities, assignments and overrides: histories driven by runs and decision logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import scores
from shelfmark.operators import reconcile
from shelfmark.operators.naming import PARSER_VERSION

IDENTITY_FIELDS = [
    "title", "original_title", "release_year", "release_date", "series_provider_id",
    "season_number", "episode_number", "episode_title", "runtime_seconds", "original_language",
]


def upsert_identities(stored: DataFrame, incoming: DataFrame, run_ts: Column, order: list[str],
                      fields: list[str] = IDENTITY_FIELDS) -> DataFrame:
    """Identities by (media_type, provider_id); a row is touched only when a field changed.

    Several incoming rows of a key collapse to the last by ``order`` before the join.
    """
    key = ["media_type", "provider_id"]
    last = reconcile.latest(incoming, key, order)
    both = reconcile.pair(stored, last, key)
    new, old = F.col("new").isNotNull(), F.col("old").isNotNull()
    outcome = (
        F.when(~new, "LEFT").when(~old, "CREATED").when(reconcile.same(fields), "UNCHANGED").otherwise("UPDATED"))
    both = both.withColumn("outcome", outcome)
    return both.select(
        F.coalesce("old.identity_id", reconcile.surrogate_key(*[F.col(k) for k in key])).alias("identity_id"),
        *key, *[F.when(new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in fields],
        F.when(F.col("outcome").isin("CREATED", "UPDATED"), run_ts).otherwise(F.col("old.updated_at")).alias("updated_at"),
        "outcome")


def identities_of(matches: DataFrame) -> DataFrame:
    """Identity columns of match rows, in front of whatever else the rows carry about the choice."""
    movie = F.col("provider_media_type") == "MOVIE"
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    carried = [c for c in ("attempt_id", "media_file_id", "candidate_id", "assignment_method", "confidence", "chosen_at") if c in matches.columns]
    return matches.select(
        F.col("provider_media_type").alias("media_type"), "provider_id",
        F.when(movie, F.col("title")).otherwise(F.col("series_title")).alias("title"),
        text.alias("original_title"), "release_year", text.alias("release_date"), "series_provider_id",
        "season_number", "episode_number", F.when(~movie, F.col("title")).alias("episode_title"),
        number.alias("runtime_seconds"), text.alias("original_language"), *carried)


def chosen_by_run(attempts: DataFrame, selected: DataFrame) -> DataFrame:
    """The matches a run resolved by itself (``linkage.selected_matches``), as choices to assign."""
    own = attempts.select("attempt_id", *[c for c in ("candidate_id", "confidence") if c in attempts.columns], F.col("started_at").alias("chosen_at"))
    return selected.drop("confidence").join(own, "attempt_id").withColumn("assignment_method", F.lit("AUTO"))


def chosen_by_review(attempts: DataFrame, reviewed: DataFrame, decisions: DataFrame) -> DataFrame:
    """The matches reviewers selected, as choices to assign: rows of ``review_matches`` that a SELECT decision names and
    that are still the attempt's selected one. Confidence follows the match's own score."""
    last = decisions.where((F.col("action") == "SELECT") & F.col("match_id").isNotNull()).groupBy("attempt_id", "match_id").agg(
        F.max("decided_at").alias("chosen_at"))
    found = reviewed.where("selected").join(last, ["attempt_id", "match_id"])
    origin = attempts.select("attempt_id", "candidate_id") if "candidate_id" in attempts.columns else None
    found = found if origin is None else found.drop("candidate_id").join(origin, "attempt_id")
    return found.withColumns({"assignment_method": F.lit("MANUAL"), "confidence": F.col("manual_confidence")})


def resolve(chosen: DataFrame, identities: DataFrame, assignments: DataFrame, run_ts: Column,
            fields: list[str] = IDENTITY_FIELDS) -> tuple[DataFrame, DataFrame]:
    """From choices to state, for the run's and the reviewers' alike: every chosen match upserts its identity, and
    the identity's id is assigned to the file. Returns both tables with ``outcome``.

    The last choice of a file counts, and of an identity the last description (by time, then attempt). A choice of
    a match without a provider id assigns nothing. Running again on what a run returned changes nothing. Ids of new
    identities derive from their key, so they are the same wherever they are computed.
    """
    order = ["chosen_at", "attempt_id"]
    incoming = identities_of(chosen).where(F.col("provider_id").isNotNull())
    key = ["media_type", "provider_id"]
    stored = upsert_identities(identities, incoming.select(*key, *fields, *order), run_ts, order, fields)
    extra = [c for c in ("attempt_id", "candidate_id") if c in assignments.columns and c in incoming.columns]
    given = incoming.join(stored.select(*key, "identity_id"), key).select(
        "media_file_id", "identity_id", "assignment_method", "confidence", *extra,
        F.struct(*order).alias("__order"))
    last = reconcile.latest(given, ["media_file_id"], ["__order"]).drop("__order")
    return stored, assign(assignments, last, run_ts)


def assign(assignments: DataFrame, incoming: DataFrame, run_ts: Column, order: list[str] | None = None) -> DataFrame:
    """Give files their identity, the last incoming row per file (by ``order``, else by identity): a repeat of identity, method and confidence changes nothing;
    anything else supersedes the open row and opens a new one.

    Closed rows pass through untouched. Returns all rows with ``outcome``.
    """
    still_open = F.col("status") == "ACTIVE"
    incoming = reconcile.latest(incoming, ["media_file_id"], order or ["identity_id", "assignment_method", "confidence"])
    new_id = F.xxhash64(F.lit("assignment"), "media_file_id", F.col("new.identity_id"), F.col("new.assignment_method"), run_ts.cast("timestamp"))
    current = reconcile.scd2(
        assignments.where(still_open), incoming, ["media_file_id"],
        ["identity_id", "assignment_method", "confidence"], run_ts, "SUPERSEDED", new_id)
    closed = assignments.where(~still_open).withColumn("outcome", F.lit("KEPT"))
    return current.unionByName(closed)


def review_attempts(attempts: DataFrame, decisions: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply SELECT (a match of the attempt) and REJECT (all of them) decisions to attempts, the latest valid one last.

    Decisions: attempt_id, action, match_id, decided_at, decision_id.
    """
    own = matches.select("attempt_id", "match_id", F.lit(True).alias("__own"))
    flagged = decisions.join(own, ["attempt_id", "match_id"], "left")
    action = F.col("decision.action")
    selects = action == "SELECT"
    invalid = (
        F.when(F.col("state").isNull(), "no such attempt")
        .when(~F.coalesce(action.isin("SELECT", "REJECT"), F.lit(False)), "unknown action")
        .when(selects & F.col("decision.match_id").isNull(), "no match named")
        .when(selects & F.col("decision.__own").isNull(), "the match is not one of the attempt"))
    pairs, rejects = reconcile.apply_decisions(attempts, flagged, ["attempt_id"], invalid)
    changed = {
        "status": F.when(selects, "RESOLVED").when(action == "REJECT", "NO_MATCH").otherwise(F.col("state.status")),
        "selected_match_id": F.when(selects, F.col("decision.match_id")).when(
            action.isNull(), F.col("state.selected_match_id")),
    }
    return pairs.select(*[changed[c].alias(c) if c in changed else F.col(f"state.{c}") for c in attempts.columns]), rejects.drop("__own")


def review_matches(matches: DataFrame, attempts: DataFrame) -> DataFrame:
    """Match rows with ``selected`` following their reviewed attempt, and the confidence a
    manual choice of that match carries."""
    chosen = attempts.select("attempt_id", "selected_match_id")
    selected = F.coalesce(F.col("match_id") == F.col("selected_match_id"), F.lit(False))
    return (
        matches.drop("selected").join(chosen, "attempt_id", "left")
        .withColumns({"selected": selected, "manual_confidence": scores.confidence_for(F.col("score"))})
        .drop("selected_match_id"))


def revoke(assignments: DataFrame, decisions: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Revoke ACTIVE assignments; a row that is not ACTIVE stays as it is."""
    invalid = F.when(F.col("state").isNull(), "no such assignment")
    pairs, rejects = reconcile.apply_decisions(assignments, decisions, ["assignment_id"], invalid)
    hit = F.col("decision").isNotNull() & (F.col("state.status") == "ACTIVE")
    changed = {
        "status": F.when(hit, "REVOKED").otherwise(F.col("state.status")),
        "updated_at": F.when(hit, run_ts).otherwise(F.col("state.updated_at")),
    }
    return pairs.select(*[changed[c].alias(c) if c in changed else F.col(f"state.{c}") for c in assignments.columns]), rejects


def confirm(assignments: DataFrame, decisions: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Confirm ACTIVE, manually chosen assignments for ingest. The first valid decision counts; a later one, or one on
    an assignment confirmed before, changes nothing."""
    status, method = F.col("state.status"), F.col("state.assignment_method")
    invalid = (
        F.when(F.col("state").isNull(), "no such assignment")
        .when(status != "ACTIVE", F.format_string("assignment is %s, not ACTIVE", status))
        .when(method != "MANUAL", "assignment was made automatically; nothing to confirm"))
    pairs, rejects = reconcile.apply_decisions(assignments, decisions, ["assignment_id"], invalid, keep="first")
    hit = F.col("decision").isNotNull() & F.col("state.confirmed_for_ingest_at").isNull()
    changed = {
        "confirmed_for_ingest_at": F.when(hit, run_ts).otherwise(F.col("state.confirmed_for_ingest_at")),
        "confirmed_by": F.when(hit, F.col("decision.decided_by")).otherwise(F.col("state.confirmed_by")),
        "updated_at": F.when(hit, run_ts).otherwise(F.col("state.updated_at")),
    }
    return pairs.select(*[changed[c].alias(c) if c in changed else F.col(f"state.{c}") for c in assignments.columns]), rejects


def confirm_by_plan(assignments: DataFrame, plans: DataFrame, decisions: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Confirm the assignment behind a plan, as long as it is still the current one of the plan's file.

    Decisions name a plan_id. The rejects carry the plan and the reason.
    """
    current = assignments.where(F.col("status") == "ACTIVE").select("media_file_id", F.col("assignment_id").alias("__current"))
    named = plans.select("plan_id", "media_file_id", F.col("assignment_id").alias("__planned"), F.lit(True).alias("__known"))
    asked = decisions.join(named, "plan_id", "left").join(current, "media_file_id", "left")
    reason = (
        F.when(F.col("__known").isNull(), "no such plan")
        .when(F.col("__planned").isNull(), "plan has no resolved identity assignment to confirm")
        .when(~F.col("__current").eqNullSafe(F.col("__planned")), "the plan's assignment is no longer the current one of its file"))
    asked = asked.withColumns({"reject_reason": reason, "assignment_id": F.col("__planned")})
    kept = [*decisions.columns, "assignment_id"]
    stopped = asked.where(F.col("reject_reason").isNotNull()).select(*kept, "reject_reason")
    confirmed, rejects = confirm(assignments, asked.where(F.col("reject_reason").isNull()).select(*kept), run_ts)
    return confirmed, rejects.unionByName(stopped)


# --- overrides ------------------------------------------------------------------------

OVERRIDE_FIELDS = ["candidate_type", "title", "year", "series_title", "season_number", "episode_numbers", "episode_title"]


def override_problem() -> Column:
    """Why an override entry cannot be taken, or null."""
    c = F.col
    blank = lambda name: F.coalesce(F.trim(c(name)), F.lit("")) == ""
    kind = c("candidate_type")
    return F.when(c("action") == "CREATE", (
        F.when((kind == "MOVIE") & blank("title"), "a MOVIE override requires a non-empty title")
        .when((kind == "EPISODE") & blank("series_title"), "an EPISODE override requires a non-empty series title")
        .when((kind == "EPISODE") & c("season_number").isNull(), "an EPISODE override requires a season number")
        .when((kind == "EPISODE") & (F.coalesce(F.size("episode_numbers"), F.lit(0)) <= 0),
              "an EPISODE override requires at least one episode number")
        .when(~F.coalesce(kind.isin("MOVIE", "EPISODE"), F.lit(False)), "unsupported override candidate_type")))


def override_history(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Override rows from a log of CREATE and CLEAR entries: (history, rejects).

    Log: media_file_id, entry_id, entry_at, action and the override's fields. Each valid entry of a
    file closes the one before it, so a row's ``cleared_at`` is the time of the next entry.
    """
    unplaced = F.col("media_file_id").isNull() | F.col("entry_at").isNull()
    unknown = ~F.coalesce(F.col("action").isin("CREATE", "CLEAR"), F.lit(False))
    checked = log.withColumn("reject_reason", F.when(unplaced, "no file or time").when(unknown, "unknown action").otherwise(override_problem()))
    rejects = checked.where(F.col("reject_reason").isNotNull())
    valid = checked.where(F.col("reject_reason").isNull())
    history = (
        reconcile.next_time(valid, "media_file_id", "entry_at", "entry_id", "cleared_at")
        .where(F.col("action") == "CREATE")
        .drop("reject_reason", "action").withColumnRenamed("entry_id", "override_id").withColumnRenamed("entry_at", "created_at")
    )
    return history, rejects


def active_overrides(history: DataFrame) -> DataFrame:
    return history.where(F.col("cleared_at").isNull())


def effective(candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """What resolution should use per file: the open override, else the parsed candidate."""
    both = candidates.select("media_file_id", F.struct(*candidates.columns).alias("parsed")).join(
        active_overrides(overrides).select("media_file_id", F.struct(*overrides.columns).alias("own")),
        "media_file_id", "full_outer")
    has = F.col("own").isNotNull()
    take = lambda own, parsed: F.when(has, F.col(f"own.{own}")).otherwise(F.col(f"parsed.{parsed}")).alias(parsed)
    return both.select(
        "media_file_id",
        F.when(has, "MANUAL_OVERRIDE").otherwise("PARSED").alias("source"),
        take("candidate_type", "candidate_type"),
        F.when(has, "HIGH").otherwise(F.col("parsed.confidence")).alias("confidence"),
        F.coalesce("parsed.parser_version", F.lit(PARSER_VERSION)).alias("parser_version"),
        take("title", "parsed_title"), take("year", "parsed_year"), take("series_title", "parsed_series_title"),
        take("season_number", "season_number"),
        F.when(has, F.get("own.episode_numbers", F.lit(0))).otherwise(F.col("parsed.episode_number")).alias("episode_number"),
        take("episode_numbers", "episode_numbers"), take("episode_title", "episode_title"),
        F.col("parsed.candidate_id").alias("candidate_id"), F.col("own.override_id").alias("override_id"))
