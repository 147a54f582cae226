"""Statistics of the catalog tables. Every group-by combines map-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(df: DataFrame, by: str, metric: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(metric).alias("metric"), F.col(by).cast("string").alias("key"), "n")


def _measures(df: DataFrame, metric: str, names: list[str]) -> DataFrame:
    """One row of measures as (metric, key, n) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("long").alias("n")) for n in names])
    return df.select(F.lit(metric).alias("metric"), F.inline(pairs))


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def library_stats(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """Active and missing counts and active bytes per library, libraries without files too.

    Files are reduced to one row per library before they meet the dimension.
    """
    active = F.col("state") == "ACTIVE"
    per = files.groupBy("library_id").agg(
        F.count_if(active).alias("active_count"), F.count_if(F.col("state") == "MISSING").alias("missing_count"),
        F.sum(F.when(active, F.col("size_bytes"))).alias("active_total_size_bytes"))
    zero = F.lit(0)
    return libraries.join(per, "library_id", "left").select(
        "category", "root_path", *[F.coalesce(c, zero).alias(c) for c in ("active_count", "missing_count", "active_total_size_bytes")])


def layout_counts(files: DataFrame) -> DataFrame:
    return _count(files.where(F.col("state") == "ACTIVE"), "layout", "layout")


def extension_counts(files: DataFrame) -> DataFrame:
    return _count(files.where(F.col("state") == "ACTIVE"), "extension", "extension")


def metadata_counts(files: DataFrame) -> DataFrame:
    """Probe outcomes of ACTIVE files. Not probed means no probe time, whatever the error."""
    failed, probed = F.col("media_info_error").isNotNull(), F.col("media_info_probed_at").isNotNull()
    return files.where(F.col("state") == "ACTIVE").agg(
        F.count_if(~failed & probed).alias("success_count"), F.count_if(failed).alias("error_count"),
        F.count_if(~probed).alias("not_probed_count"))


def track_totals(files: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Tracks of ACTIVE files by kind, from the nested arrays or from a flat table."""
    active = files.where(F.col("state") == "ACTIVE")
    kinds = ("video", "audio", "subtitle")
    if tracks is None:
        return active.agg(*[F.coalesce(F.sum(F.array_size(f"{k}_tracks")), F.lit(0)).alias(f"{k}_count") for k in kinds])
    kept = tracks.join(active.select("media_file_id"), "media_file_id", "left_semi")
    return kept.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in kinds])


def inventory_stats(files: DataFrame, libraries: DataFrame, runs: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Everything above as (metric, key, n) rows, with grand totals and the newest scan.

    The files are read once, reduced to a cube of few rows from which every count is taken.
    """
    failed, probed = F.col("media_info_error").isNotNull(), F.col("media_info_probed_at").isNotNull()
    cube = files.groupBy("library_id", "state", "layout", "extension", failed.alias("failed"), probed.alias("probed")).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    cube = cube.join(libraries.select("library_id", "category"), "library_id", "left")
    active, missing = F.col("state") == "ACTIVE", F.col("state") == "MISSING"
    known = F.col("category").isNotNull()

    def entry(when: Column, metric: str, key: Column, n: str = "files") -> Column:
        return F.when(when, F.struct(F.lit(metric).alias("metric"), key.alias("key"), F.col(n).cast("long").alias("n")))

    measures = {"active_count": (active, "files"), "missing_count": (missing, "files"), "active_total_size_bytes": (active, "bytes")}
    entries = [e for name, (when, n) in measures.items() for e in (
        entry(when & known, f"library_{name}", F.col("category"), n), entry(when & known, "total", F.lit(name), n))]
    entries += [entry(active, c, F.col(c)) for c in ("layout", "extension")]
    probes = {"success_count": ~F.col("failed") & F.col("probed"), "error_count": F.col("failed"), "not_probed_count": ~F.col("probed")}
    entries += [entry(active & when, "metadata", F.lit(name)) for name, when in probes.items()]
    counted = cube.select(F.inline(F.array_compact(F.array(*entries))))
    none = F.lit(0).cast("long").alias("n")
    zeros = union(
        libraries.select(F.explode(F.array(*[F.lit(f"library_{n}") for n in measures])).alias("metric"), F.col("category").alias("key"), none),
        *[files.sparkSession.range(1).select(F.lit(m).alias("metric"), F.explode(F.array(*map(F.lit, names))).alias("key"), none)
          for m, names in (("total", measures), ("metadata", probes))])
    newest = runs.agg(F.max("scan_run_id").alias("scan_run_id"))
    return union(
        counted.unionByName(zeros).groupBy("metric", "key").agg(F.sum("n").alias("n")),
        _measures(track_totals(files, tracks), "tracks", ["video_count", "audio_count", "subtitle_count"]),
        _measures(newest, "most_recent_scan", ["scan_run_id"]))


def diff_counts(changes: DataFrame) -> DataFrame:
    """Selected events by type, and in total."""
    return union(_count(changes, "change_type", "change_type"), _measures(
        changes.agg(F.count(F.lit(1)).alias("total_changes")), "total", ["total_changes"]))


def findings_stats(findings: DataFrame) -> DataFrame:
    """By status, and of the ACTIVE ones by severity and by rule; the table is read once."""
    cube = findings.groupBy("status", "severity", "rule_code").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array(
        F.struct(F.lit("status").alias("metric"), F.col("status").alias("key")),
        F.when(F.col("status") == "ACTIVE", F.struct(F.lit("severity").alias("metric"), F.col("severity").alias("key"))),
        F.when(F.col("status") == "ACTIVE", F.struct(F.lit("rule").alias("metric"), F.col("rule_code").alias("key"))),
        F.struct(F.lit("total").alias("metric"), F.lit("findings").alias("key")))
    return cube.select("n", F.inline(F.array_compact(entries))).groupBy("metric", "key").agg(F.sum("n").alias("n"))


def candidate_stats(candidates: DataFrame) -> DataFrame:
    """Total, by type, by confidence, with and without a year; the table is read once."""
    cube = candidates.groupBy("candidate_type", "confidence", F.col("parsed_year").isNotNull().alias("dated")).agg(
        F.count(F.lit(1)).alias("n"))
    entries = F.array(
        F.struct(F.lit("type").alias("metric"), F.col("candidate_type").alias("key")),
        F.struct(F.lit("confidence").alias("metric"), F.col("confidence").alias("key")),
        F.struct(F.lit("year").alias("metric"), F.when(F.col("dated"), "with_year").otherwise("without_year").alias("key")),
        F.struct(F.lit("total").alias("metric"), F.lit("candidates").alias("key")))
    return cube.select("n", F.inline(entries)).groupBy("metric", "key").agg(F.sum("n").alias("n"))


def status_stats(df: DataFrame, total: str) -> DataFrame:
    """Rows by status and in total (attempts, plans)."""
    per = _count(df, "status", "status")
    return union(per, per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit("total").alias("metric"), F.lit(total).alias("key"), "n"))


def listing_rollup(files: DataFrame) -> DataFrame:
    """Per category of a listing: files, bytes, files by layout, probes that worked or failed."""
    per = files.groupBy("category", "layout").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"),
        F.count_if(F.col("probed") & F.col("media_info_error").isNull()).alias("ok"),
        F.count_if(F.col("media_info_error").isNotNull()).alias("failed"))
    entries = F.array(
        F.struct(F.lit("file_count").alias("metric"), F.col("files").alias("n")),
        F.struct(F.lit("total_size_bytes").alias("metric"), F.col("bytes").alias("n")),
        F.struct(F.concat(F.lit("layout:"), "layout").alias("metric"), F.col("files").alias("n")),
        F.struct(F.lit("metadata_extracted").alias("metric"), F.col("ok").alias("n")),
        F.struct(F.lit("metadata_errors").alias("metric"), F.col("failed").alias("n")))
    return per.select("category", F.inline(entries)).groupBy("category", "metric").agg(F.sum("n").alias("n"))
