"""Execution events folded to current status, and recovery triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import reconcile

# What a failed step leaves behind, by transfer strategy.
_SHARED = {"CREATE_DESTINATION_DIRECTORY": "NONE", "REFRESH_INVENTORY": "INVENTORY_REFRESH_INCOMPLETE",
           "FINALIZE": "INVENTORY_REFRESH_INCOMPLETE"}
RECOVERY_BY_STEP = {
    "SAME_FILESYSTEM_ATOMIC_RENAME": {
        **_SHARED,
        "ATOMIC_RENAME": "PARTIAL_DESTINATION_SOURCE_INTACT",
        "VERIFY_DESTINATION_MEDIA": "DESTINATION_UNVERIFIED_SOURCE_REMOVED",
    },
    "CROSS_FILESYSTEM_COPY_VERIFY_REMOVE": {
        **_SHARED,
        "STREAM_COPY_WITH_CHECKSUM": "PARTIAL_DESTINATION_SOURCE_INTACT",
        "COMPUTE_DESTINATION_CHECKSUM": "PARTIAL_DESTINATION_SOURCE_INTACT",
        "VERIFY_CHECKSUM_MATCH": "PARTIAL_DESTINATION_SOURCE_INTACT",
        "FINAL_RENAME": "PARTIAL_DESTINATION_SOURCE_INTACT",
        "VERIFY_DESTINATION_MEDIA": "DESTINATION_VERIFIED_SOURCE_NOT_REMOVED",
        "REMOVE_SOURCE": "DESTINATION_VERIFIED_SOURCE_NOT_REMOVED",
    },
}
INTERRUPTED, OTHER = "INTERRUPTED_STATE_UNKNOWN", "OTHER_REQUIRES_MANUAL_INSPECTION"
GUIDANCE = {
    "NONE": "Nothing was changed before the failure; no recovery is needed.",
    "PARTIAL_DESTINATION_SOURCE_INTACT": "The source is untouched and a partial copy may be left behind. Remove the partial copy and make a new plan.",
    "DESTINATION_VERIFIED_SOURCE_NOT_REMOVED": "The copy is verified and the source is still there. Check the copy, then remove the source if wanted.",
    "DESTINATION_UNVERIFIED_SOURCE_REMOVED": "The file was moved in place but not verified. Play it and run an inventory scan if it is sound.",
    "INVENTORY_REFRESH_INCOMPLETE": "The transfer is complete; only the inventory lags. Keep the file and rescan it.",
    INTERRUPTED: "The run stopped without releasing its state. Inspect source, destination and partial copies by hand.",
    OTHER: "The recorded state fits no known case. Inspect by hand.",
}


def recovery_for(strategy: Column, step: Column) -> Column:
    """Recovery status of a failed step."""
    table = [F.lit(x) for s, steps in RECOVERY_BY_STEP.items() for k, v in steps.items() for x in (f"{s}/{k}", v)]
    return F.coalesce(F.try_element_at(F.create_map(*table), F.concat_ws("/", strategy, step)), F.lit(OTHER))


def fold_events(plans: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current plan status after its execution events, and the events that were not legal.

    Events: plan_id, seq, event (START, SUCCEED, FAIL), strategy, step. An APPROVED plan takes
    its first START; an executing one its first SUCCEED or FAIL after that; a finished plan
    takes nothing more. So the legal events of a plan are two minima, found by two
    aggregations that combine map-side, whatever the length of its log.
    """
    known = plans.select("plan_id", (F.col("status") == "APPROVED").alias("__approved"))
    log = events.join(known, "plan_id", "left")
    starts = log.where(F.col("__approved") & (F.col("event") == "START")).groupBy("plan_id").agg(F.min("seq").alias("start_seq"))
    log = log.join(starts, "plan_id", "left")
    after = F.col("event").isin("SUCCEED", "FAIL") & (F.col("seq") > F.col("start_seq"))
    ends = log.where(after).groupBy("plan_id").agg(
        F.min_by(F.struct("seq", "event", "strategy", "step"), "seq").alias("end"))
    log = log.join(ends.select("plan_id", F.col("end.seq").alias("end_seq")), "plan_id", "left")
    # Null where the event, its number or what it is compared with is missing: such an event is not legal.
    legal = (
        ((F.col("seq") == F.col("start_seq")) & (F.col("event") == "START"))
        | ((F.col("seq") == F.col("end_seq")) & F.col("event").isin("SUCCEED", "FAIL")))
    reason = (
        F.when(F.col("__approved").isNull(), "no such plan")
        .when(F.col("seq").isNull() | F.col("event").isNull(), "no seq or event")
        .when(F.col("event") == "START", "plan is not APPROVED")
        .otherwise("plan is not EXECUTING"))
    rejects = log.where(~F.coalesce(legal, F.lit(False))).select("plan_id", "seq", "event", reason.alias("reject_reason"))
    recovery = F.when(F.col("end.event") == "FAIL", recovery_for(F.col("end.strategy"), F.col("end.step")))
    current = (
        plans.join(starts, "plan_id", "left").join(ends, "plan_id", "left")
        .withColumn("recovery_status", F.when(F.col("end.event") == "SUCCEED", "NONE").otherwise(recovery))
        .withColumn("failure_step", F.when(F.col("end.event") == "FAIL", F.col("end.step")))
        .withColumn("execution_status",
            F.when(F.col("end.event") == "SUCCEED", "SUCCEEDED")
            .when(F.col("recovery_status") == "NONE", "FAILED")
            .when(F.col("end").isNotNull(), "RECOVERY_REQUIRED")
            .when(F.col("start_seq").isNotNull(), "EXECUTING"))
        .withColumn("status",
            F.when(F.col("execution_status") == "SUCCEEDED", "EXECUTED")
            .when(F.col("execution_status") == "FAILED", "EXECUTION_FAILED")
            .otherwise(F.coalesce("execution_status", "status")))
        .drop("start_seq", "end"))
    return current, rejects


def partial_files(listing: DataFrame, marker: str) -> DataFrame:
    """Partial copies in a listing, with the destination each was meant for.

    A partial copy sits beside its destination as ``.<name>.<marker>-<token>``.
    """
    name = paths.file_name(F.col("absolute_path"))
    # Greedy: the marker nearest the end separates name and token.
    target = F.regexp_extract(name, rf"(?s)^\.(.+)\.{marker}-.*$", 1)
    return listing.withColumn("__target", target).where(F.col("__target") != "").select(
        F.concat_ws("/", paths.parent_directory(F.col("absolute_path")), F.col("__target")).alias("destination_path"),
        F.col("absolute_path").alias("partial_path"))


def triage(executions: DataFrame, locks: DataFrame, listing: DataFrame, marker: str = "partial") -> DataFrame:
    """Recovery guidance per execution from lock rows and a listing. Reads only.

    The partial copies themselves are ``partial_files``; here they are counted.
    """
    paths_on_disk = listing.select("absolute_path").distinct()
    partial = partial_files(listing, marker).groupBy("destination_path").agg(F.count(F.lit(1)).alias("partial_file_count"))
    # What is known of a path, met once for the source and once for the destination; rows without a path are dealt out.
    facts = (
        paths_on_disk.select(F.col("absolute_path").alias("__at"), F.lit(True).alias("__there"), F.lit(0).alias("__partial"))
        .unionByName(partial.select(F.col("destination_path").alias("__at"), F.lit(False).alias("__there"), F.col("partial_file_count").alias("__partial")))
        .groupBy("__at").agg(F.bool_or("__there").alias("__there"), F.sum("__partial").alias("__partial")))

    def met(df: DataFrame, path: str, exists: str, count: str) -> DataFrame:
        keyed = df.withColumn("__key", reconcile.join_key(df, path, "execution_id"))
        held = facts.select("__at", F.col("__there").alias(exists), F.col("__partial").alias(count))
        return keyed.join(held, F.col("__key") == F.col("__at"), "left").drop("__key", "__at")

    df = (
        met(met(executions, "source_path", "source_exists", "__beside"), "destination_path", "destination_exists", "partial_file_count")
        .drop("__beside")
        .join(locks.select("plan_id", F.col("token").alias("__token")), "plan_id", "left"))
    false = F.lit(False)
    df = df.withColumns({
        "source_exists": F.coalesce("source_exists", false), "destination_exists": F.coalesce("destination_exists", false),
        "partial_file_count": F.coalesce("partial_file_count", F.lit(0)),
        "lock_held": F.col("__token").isNotNull(),
        "lock_matches_execution": F.coalesce(F.col("__token") == F.col("lock_token"), false)}).drop("__token")
    stray = (F.col("status") == "EXECUTING") & ~F.col("lock_matches_execution")
    df = df.withColumn("recovery_status", F.when(stray, INTERRUPTED).otherwise(F.col("recovery_status")))
    texts = F.create_map(*[F.lit(x) for pair in GUIDANCE.items() for x in pair])
    text = F.coalesce(F.try_element_at(texts, F.coalesce("recovery_status", F.lit("NONE"))), F.lit(GUIDANCE[OTHER]))
    return df.withColumn("guidance", text)
