"""Rule findings over file records, and their lifecycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions import paths
from shelfmark.functions.evidence import canonical_json
from shelfmark.operators import reconcile

# Fixed value: below this a media file is unusually small.
SMALL_BYTES = 10 * 1024 * 1024


@dataclass(frozen=True)
class Rule:
    """A rule as columns: when it fires, what it says and the facts it rests on."""

    code: str
    severity: str
    fires: Column
    summary: Column
    evidence: Column
    recommendation: str


def rules() -> list[Rule]:
    """The rules in their declared order, which is also their rank for listing.

    Fixed values: codes, severities, summary texts and evidence keys.
    """
    c = F.col
    active = c("state") == "ACTIVE"
    probed = c("media_info_probed_at").isNotNull() & c("media_info_error").isNull()
    known = paths.is_media_extension(c("extension"))
    extensions = F.array(*[F.lit(e) for e in sorted(schemas.MEDIA_EXTENSIONS)])
    return [
        Rule("missing_file", "ERROR", c("state") == "MISSING",
             F.concat(F.lit("File is no longer found on the NAS: "), c("relative_path")),
             canonical_json({"last_seen_scan_id": c("last_seen_scan_id"), "missing_since_scan_id": c("missing_since_scan_id")}),
             "Check whether the removal was meant; rule out a mount or network fault first."),
        Rule("metadata_error", "ERROR", active & c("media_info_error").isNotNull(),
             F.lit("MediaInfo failed to probe this file."),
             canonical_json({"error": c("media_info_error")}),
             "Look into the probe error: damaged, unreadable, or an unsupported container."),
        Rule("metadata_not_probed", "WARNING",
             active & c("media_info_probed_at").isNull() & c("media_info_error").isNull(),
             F.lit("Technical metadata has not been extracted for this file yet."),
             canonical_json(),
             "Run a scan with metadata enabled."),
        Rule("unknown_layout", "WARNING", active & (c("layout") == "unknown"),
             F.format_string("File does not match a recognized layout for its category (%s).", c("category")),
             canonical_json({"layout": c("layout")}),
             "Move the file to a folder depth its category expects."),
        Rule("zero_byte_file", "ERROR", active & (c("size_bytes") == 0),
             F.lit("File is zero bytes."),
             canonical_json({"size_bytes": F.lit(0)}),
             "Find out where the file came from; the copy may have failed. Verify before deleting."),
        Rule("suspiciously_small_media", "WARNING",
             active & (c("size_bytes") > 0) & known & (c("size_bytes") < SMALL_BYTES),
             F.format_string("File is unusually small for a media file (%d bytes).", c("size_bytes")),
             canonical_json({"size_bytes": c("size_bytes"), "threshold_bytes": F.lit(SMALL_BYTES)}),
             "Confirm the copy is complete; it may be a sample, a trailer or a partial rip."),
        Rule("no_video_track", "ERROR", active & probed & (c("video_track_count") == 0),
             F.lit("No video track detected despite a successful MediaInfo probe."),
             canonical_json({"video_track_count": F.lit(0)}),
             "Confirm the file holds video; check how it was ripped or encoded."),
        Rule("no_audio_track", "WARNING", active & probed & (c("audio_track_count") == 0),
             F.lit("No audio track detected despite a successful MediaInfo probe."),
             canonical_json({"audio_track_count": F.lit(0)}),
             "Confirm the file holds audio; check how it was ripped or encoded."),
        Rule("unexpected_extension", "WARNING", active & ~known,
             F.format_string("File extension '%s' is outside the configured supported-media extension set.", c("extension")),
             canonical_json({"extension": c("extension"), "supported_extensions": extensions}),
             "Confirm the file belongs here; scans do not pick up this extension."),
    ]


RULE_CODES = (
    "missing_file", "metadata_error", "metadata_not_probed", "unknown_layout", "zero_byte_file",
    "suspiciously_small_media", "no_video_track", "no_audio_track", "unexpected_extension",
)
CONTENT = ["severity", "library_id", "summary", "evidence_json", "recommendation"]


def evaluate(files: DataFrame) -> DataFrame:
    """Every rule on every file in one pass: the findings that hold now."""
    hits = [
        F.when(rule.fires, F.struct(
            F.lit(rule.code).alias("rule_code"), F.lit(rule.severity).alias("severity"),
            rule.summary.alias("summary"), rule.evidence.alias("evidence_json"),
            F.lit(rule.recommendation).alias("recommendation")))
        for rule in rules()
    ]
    return files.select("media_file_id", "library_id", F.inline(F.array_compact(F.array(*hits))))


def reconcile_findings(stored: DataFrame, found: DataFrame, run_ts: Column) -> DataFrame:
    """Next findings table with ``outcome`` per row.

    Stored rows: rule_code, media_file_id, content, status, first_detected_at,
    last_detected_at, resolved_at, updated_at. An ignored finding stays ignored; only its
    last_detected_at moves.
    """
    both = reconcile.pair(stored, found, ["rule_code", "media_file_id"])
    seen = F.col("new").isNotNull()
    status = F.col("old.status")
    outcome = (
        F.when(F.col("old").isNull(), "CREATED")
        .when(seen & (status == "IGNORED"), "IGNORED_TOUCHED")
        .when(seen & (status == "RESOLVED"), "REACTIVATED")
        .when(seen & reconcile.same(CONTENT), "UNCHANGED")
        .when(seen, "UPDATED")
        .when(status == "ACTIVE", "RESOLVED")
        .otherwise("LEFT")
    )
    both = both.withColumn("outcome", outcome)
    o = F.col("outcome")
    rewritten = o.isin("CREATED", "REACTIVATED", "UPDATED")
    return both.select(
        "rule_code", "media_file_id",
        *[F.when(rewritten, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in CONTENT],
        F.when(rewritten, "ACTIVE").when(o == "RESOLVED", "RESOLVED").otherwise(status).alias("status"),
        F.coalesce("old.first_detected_at", run_ts).alias("first_detected_at"),
        F.when(seen, run_ts).otherwise(F.col("old.last_detected_at")).alias("last_detected_at"),
        F.when(o == "RESOLVED", run_ts).when(~rewritten, F.col("old.resolved_at")).alias("resolved_at"),
        F.when(rewritten | (o == "RESOLVED"), run_ts).otherwise(F.col("old.updated_at")).alias("updated_at"),
        "outcome",
    )


OUTCOMES = ["CREATED", "REACTIVATED", "UPDATED", "UNCHANGED", "RESOLVED", "IGNORED_TOUCHED"]


def blocking_counts(findings: DataFrame) -> DataFrame:
    """Open ERROR and CRITICAL findings per file (files without any are absent)."""
    blocking = (F.col("status") == "ACTIVE") & F.col("severity").isin("ERROR", "CRITICAL")
    return findings.where(blocking).groupBy("media_file_id").agg(F.count(F.lit(1)).alias("blocking_finding_count"))
