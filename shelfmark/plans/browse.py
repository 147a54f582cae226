"""Filtered, ordered listings of the catalog tables.

Every filter is optional and all combine with AND. Orders are total, so a limit is a
deterministic top-k (TakeOrderedAndProject) and never a sample. Dimension tables are joined
without a hint: Spark broadcasts them when their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions.evidence import rank_in
from shelfmark.operators.findings import RULE_CODES
from shelfmark.operators.reconcile import latest


def _equal(df: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def _present(df: DataFrame, column: str, wanted: bool | None) -> DataFrame:
    if wanted is None:
        return df
    return df.where(F.col(column).isNotNull() if wanted else F.col(column).isNull())


def _ordered(df: DataFrame, order: list, limit: int | None) -> DataFrame:
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def track_counts(tracks: DataFrame) -> DataFrame:
    """Tracks per file and kind, in one aggregation."""
    return tracks.groupBy("media_file_id").agg(*[
        F.count_if(F.col("kind") == k).alias(f"{k}_track_count") for k in ("video", "audio", "subtitle")])


def file_records(files: DataFrame, libraries: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Flat file rows with their category and track counts.

    Nested track arrays are counted in place; a flat ``tracks`` table is counted first and
    joined once.
    """
    counts = [f"{k}_track_count" for k in ("video", "audio", "subtitle")]
    records = files.join(libraries.select("library_id", "category"), "library_id")
    if tracks is None:
        return records.withColumns({
            c: F.coalesce(F.array_size(c.replace("_track_count", "_tracks")), F.lit(0)) for c in counts})
    records = records.join(track_counts(tracks), "media_file_id", "left")
    return records.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


_FILE_ORDER = ["category", "relative_path", "media_file_id"]


def list_files(records: DataFrame, category: str | None = None, state: str | None = None, layout: str | None = None,
               metadata_error: bool | None = None, limit: int | None = None) -> DataFrame:
    df = _equal(records, category=category, state=state, layout=layout)
    return _ordered(_present(df, "media_info_error", metadata_error), _FILE_ORDER, limit)


def get_file(records: DataFrame, media_file_id: int) -> DataFrame:
    return _equal(records, media_file_id=media_file_id)


def search_files(records: DataFrame, query: str, category: str | None = None, state: str | None = None,
                 limit: int | None = None) -> DataFrame:
    """Case-insensitive substring over name, relative and absolute path; % and _ are wildcards."""
    pattern = f"%{query.lower()}%"
    hit = F.lit(False)
    for name in ("filename", "relative_path", "absolute_path"):
        hit = hit | F.lower(name).like(pattern)
    return _ordered(_equal(records, category=category, state=state).where(hit), _FILE_ORDER, limit)


def latest_complete_scan(runs: DataFrame, triggered_by: str | None = None) -> DataFrame:
    """One row: the newest COMPLETE scan, relocations included unless a trigger is named."""
    return _equal(runs, status="COMPLETE", triggered_by=triggered_by).agg(F.max("scan_run_id").alias("scan_run_id"))


def list_changes(changes: DataFrame, libraries: DataFrame, scan: int | Column | None = None,
                 from_scan: int | None = None, to_scan: int | None = None,
                 change_type: str | None = None, category: str | None = None) -> DataFrame:
    """Events of one scan, or of the half-open range (from_scan, to_scan]."""
    df = changes
    if scan is not None:
        df = df.where(F.col("scan_run_id") == scan)
    if from_scan is not None:
        df = df.where(F.col("scan_run_id") > from_scan)
    if to_scan is not None:
        df = df.where(F.col("scan_run_id") <= to_scan)
    df = _equal(df, change_type=change_type).join(libraries.select("library_id", "category"), "library_id", "left")
    return _equal(df, category=category).orderBy("scan_run_id", "change_type", "absolute_path", "media_file_id")


def select_changes(changes: DataFrame, libraries: DataFrame, runs: DataFrame, scan: int | None = None,
                   from_scan: int | None = None, to_scan: int | None = None, **filters) -> DataFrame:
    """Events of the chosen scan or range; of the newest COMPLETE scan when none is chosen."""
    if scan is not None and (from_scan is not None or to_scan is not None):
        raise ValueError("a scan cannot be combined with a scan range")
    if (from_scan is None) != (to_scan is None):
        raise ValueError("a scan range needs both ends")
    if scan is None and from_scan is None:
        scan = latest_complete_scan(runs).scalar()
    return list_changes(changes, libraries, scan, from_scan, to_scan, **filters)


def list_findings(findings: DataFrame, files: DataFrame, libraries: DataFrame, status: str | None = None,
                  severity: str | None = None, rule_code: str | None = None, category: str | None = None,
                  media_file_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Findings with path and category (kept when those are gone), gravest first per file."""
    df = _equal(findings, status=status, severity=severity, rule_code=rule_code, media_file_id=media_file_id)
    df = df.join(libraries.select("library_id", "category"), "library_id", "left").join(
        files.select("media_file_id", "absolute_path", "relative_path"), "media_file_id", "left")
    df = _equal(df, category=category).withColumns({
        "severity_rank": rank_in(F.col("severity"), schemas.SEVERITIES),
        "rule_rank": rank_in(F.col("rule_code"), RULE_CODES)})
    order = [F.coalesce("category", F.lit("")), F.coalesce("relative_path", F.lit("")), "severity_rank", "rule_rank", "media_file_id"]
    return _ordered(df, order, limit)


def list_candidates(candidates: DataFrame, records: DataFrame, candidate_type: str | None = None,
                    confidence: str | None = None, category: str | None = None, has_year: bool | None = None,
                    season_number: int | None = None, media_file_id: int | None = None, limit: int | None = None) -> DataFrame:
    df = _equal(candidates, candidate_type=candidate_type, confidence=confidence, season_number=season_number,
                media_file_id=media_file_id)
    df = _present(df, "parsed_year", has_year).join(
        records.select("media_file_id", "category", "absolute_path", "relative_path"), "media_file_id")
    return _ordered(_equal(df, category=category), _FILE_ORDER, limit)


def _beside_file(df: DataFrame, records: DataFrame) -> DataFrame:
    return df.join(records.select("media_file_id", "category", "absolute_path"), "media_file_id", "left")


def list_attempts(attempts: DataFrame, records: DataFrame, status: str | None = None, media_file_id: int | None = None,
                  category: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first. For matches join ``readback.child_rows`` to the result, so a limit applies first."""
    df = _beside_file(_equal(attempts, status=status, media_file_id=media_file_id), records)
    return _ordered(_equal(df, category=category), [F.desc("started_at"), F.desc("attempt_id")], limit)


def list_plans(plans: DataFrame, records: DataFrame, status: str | None = None, category: str | None = None,
               limit: int | None = None) -> DataFrame:
    df = _equal(_beside_file(_equal(plans, status=status), records), category=category)
    return _ordered(df, [F.desc("updated_at"), F.desc("plan_id")], limit)


def current_plans(plans: DataFrame) -> DataFrame:
    """The live plan of each file."""
    return plans.where(F.col("status") != "SUPERSEDED")


def list_executions(executions: DataFrame, status: str | None = None, recovery_status: str | None = None,
                    plan_id: int | None = None, limit: int | None = None) -> DataFrame:
    df = _equal(executions, status=status, recovery_status=recovery_status, plan_id=plan_id)
    return _ordered(df, [F.desc("execution_id")], limit)


def latest_execution(executions: DataFrame) -> DataFrame:
    return latest(executions, ["plan_id"], ["execution_id"])


def latest_attempt(attempts: DataFrame) -> DataFrame:
    return latest(attempts, ["media_file_id"], ["started_at", "attempt_id"])


def active_assignments(assignments: DataFrame, identities: DataFrame) -> DataFrame:
    """The open assignment of each file with its identity."""
    return assignments.where(F.col("status") == "ACTIVE").join(identities, "identity_id", "left")
