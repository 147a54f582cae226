"""Check lists folded into one status: media and transfer verification, plan readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas

# Extensions that fit a container; other containers are not checked.
EXTENSIONS_BY_CONTAINER = {
    "Matroska": (".mkv",),
    "MPEG-4": (".mp4", ".m4v"),
    "QuickTime": (".mov", ".m4v"),
    "AVI": (".avi",),
    "MPEG-PS": (".mpg", ".mpeg", ".vob"),
    "MPEG-TS": (".ts", ".m2ts"),
    "Windows Media": (".wmv",),
}


def check(code: str, passed: Column, failure: str = "FAIL", applies: Column | None = None) -> Column:
    """A check as (code, status); null where it does not apply. An unknown answer is a failure."""
    status = F.when(passed, "PASS").otherwise(failure)
    entry = F.struct(F.lit(code).alias("code"), status.alias("status"))
    return entry if applies is None else F.when(applies, entry)


def check_list(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def any_status(checks: Column, status: str) -> Column:
    return F.exists(checks, lambda c: c["status"] == status)


def codes_with(checks: Column, status: str) -> Column:
    return F.transform(F.filter(checks, lambda c: c["status"] == status), lambda c: c["code"])


def fold_status(checks: Column, never_probed: Column) -> Column:
    return (
        F.when(never_probed, "NOT_PROBED").when(any_status(checks, "FAIL"), "FAIL")
        .when(any_status(checks, "WARNING"), "WARNING").otherwise("PASS"))


def _plausible() -> tuple[Column, Column]:
    """(container is known, extension fits it)."""
    pairs = [F.lit(x) for k, v in EXTENSIONS_BY_CONTAINER.items() for x in (k, ",".join(v))]
    fitting = F.try_element_at(F.create_map(*pairs), F.col("container"))
    return fitting.isNotNull(), F.array_contains(F.split(fitting, ","), F.lower("extension"))


def verify_media(files: DataFrame) -> DataFrame:
    """Add ``checks`` and ``verification_status`` to files with their blocking finding count.

    Fixed values: the check codes, here and in the functions below. Nothing past the probe check is judged for a file that was never probed.
    """
    c = F.col
    never = c("media_info_error").isNull() & c("media_info_probed_at").isNull()
    probed = ~never
    known, fits = _plausible()
    unchanged = c("source_path_unchanged") if "source_path_unchanged" in files.columns else F.lit(True)
    checks = check_list(
        check("source_active", c("state") == "ACTIVE"),
        check("metadata_probed", probed & (F.coalesce(c("media_info_error"), F.lit("")) == "")),
        check("non_zero_size", c("size_bytes") > 0, applies=probed),
        check("duration_present", c("duration_seconds") > 0, applies=probed),
        check("video_track_present", c("video_track_count") >= 1, applies=probed),
        check("audio_track_present", c("audio_track_count") >= 1, "WARNING", applies=probed),
        check("container_extension_plausible", fits, "WARNING", applies=probed & known),
        check("no_blocking_findings", c("blocking_finding_count") == 0, applies=probed),
        check("source_path_unchanged", unchanged, applies=probed),
    )
    return files.withColumn("checks", checks).withColumn("verification_status", fold_status(F.col("checks"), never))


def verify_transfer(transfers: DataFrame) -> DataFrame:
    """Add ``checks`` and ``verification_status`` to transfers joined with the probe of their
    destination and the digests of both ends.

    A transfer inside one file system keeps the file itself, so no digest is compared.
    """
    c = F.col
    there, probed = c("destination_exists"), c("media_info_probed")
    known, fits = _plausible()
    checks = check_list(
        check("destination_file_exists", there),
        check("destination_is_regular_file", there & c("destination_is_regular_file")),
        check("destination_path_matches_plan_destination", c("destination_path").eqNullSafe(c("plan_destination_path"))),
        check("destination_size_non_zero", there & (c("destination_size_bytes") > 0)),
        check("destination_size_matches_expected", there & c("destination_size_bytes").eqNullSafe(c("expected_size_bytes"))),
        check("destination_metadata_probed", probed & (F.coalesce(c("media_info_error"), F.lit("")) == "")),
        check("destination_container_present", F.coalesce(c("container"), F.lit("")) != "", applies=probed),
        check("destination_duration_present_and_positive", c("duration_seconds") > 0, applies=probed),
        check("destination_video_track_present", c("video_track_count") >= 1, applies=probed),
        check("destination_audio_track_present", c("audio_track_count") >= 1, "WARNING", applies=probed),
        check("destination_container_extension_plausible", fits, "WARNING", applies=probed & known),
        check("destination_checksum_matches_source_checksum",
              ~c("checksum_required") | (c("source_checksum") == c("destination_checksum")), applies=probed),
    )
    return transfers.withColumn("checks", checks).withColumn("verification_status", fold_status(F.col("checks"), ~probed))


# What a failed readiness check means for the plan, gravest group first.
READINESS_GROUPS = {
    "BLOCKED": (
        "plan_status_approved", "plan_not_superseded", "no_current_blocking_findings",
        "destination_still_unoccupied", "no_competing_current_plan", "overwrite_not_requested",
    ),
    "STALE": (
        "source_media_file_exists", "source_state_active", "source_path_matches_plan_snapshot",
        "source_size_matches_plan_snapshot", "source_mtime_matches_plan_snapshot",
        "current_candidate_matches_plan", "active_assignment_matches_plan",
        "external_identity_exists", "verification_snapshot_present",
        "verification_snapshot_passed", "destination_category_valid",
        "destination_root_configured", "destination_path_inside_root",
    ),
    "INCOMPLETE": (
        "proposed_actions_present", "action_order_valid",
        "action_types_supported_by_future_executor",
        "every_action_state_is_proposed_not_executed", "no_unknown_or_unsupported_action",
    ),
}


def evaluate_readiness(plans: DataFrame) -> DataFrame:
    """Add the 25 ``checks`` and ``readiness_status`` to plans beside their current world.

    Every check is always reported. The existence of the plan belongs to no group.
    """
    c = F.col
    there = c("source_media_file_exists")
    specified = c("destination_library").isNotNull() & c("destination_directory").isNotNull() & c("destination_filename").isNotNull()
    actions = c("actions")
    known_types = F.forall(actions, lambda a: a["action_type"].isin(*schemas.ACTION_TYPES))
    orders = F.transform(actions, lambda a: a["action_order"].cast("int"))
    expected = F.transform(actions, lambda a, i: (i + 1).cast("int"))
    checks = check_list(
        check("plan_exists", F.lit(True)),
        check("plan_status_approved", c("plan_status") == "APPROVED"),
        check("plan_not_superseded", c("plan_status") != "SUPERSEDED"),
        check("source_media_file_exists", there),
        check("source_state_active", there & (c("source_state") == "ACTIVE")),
        check("source_path_matches_plan_snapshot", there & c("source_absolute_path").eqNullSafe(c("plan_source_path"))),
        check("source_size_matches_plan_snapshot", there & c("source_size_bytes").eqNullSafe(c("plan_source_size_bytes"))),
        check("source_mtime_matches_plan_snapshot", there & c("source_mtime").eqNullSafe(c("plan_source_mtime"))),
        check("current_candidate_matches_plan",
              (c("plan_candidate_id") == c("current_candidate_id")) & c("plan_override_id").eqNullSafe(c("current_override_id"))),
        check("active_assignment_matches_plan", c("plan_assignment_id") == c("current_assignment_id")),
        check("external_identity_exists", c("external_identity_exists")),
        check("verification_snapshot_present", c("plan_verification_status").isNotNull()),
        check("verification_snapshot_passed", c("plan_verification_status") == "PASS"),
        check("no_current_blocking_findings", c("current_blocking_finding_count") == 0),
        check("destination_category_valid", specified),
        check("destination_root_configured", specified & c("destination_root_configured")),
        check("destination_path_inside_root", specified & c("destination_path_inside_root")),
        check("destination_still_unoccupied", c("destination_still_unoccupied")),
        check("no_competing_current_plan", c("competing_plan_id").isNull()),
        check("proposed_actions_present", F.size(actions) > 0),
        check("action_order_valid", orders == expected),
        check("action_types_supported_by_future_executor", known_types),
        check("every_action_state_is_proposed_not_executed",
              F.forall(actions, lambda a: a["execution_state"].eqNullSafe(F.lit(schemas.PROPOSED)))),
        check("overwrite_not_requested", ~F.exists(actions, lambda a: a["overwrite_requested"])),
        check("no_unknown_or_unsupported_action", known_types),
    )
    failed = codes_with(F.col("checks"), "FAIL")
    hit = lambda group: F.arrays_overlap(F.col("__failed"), F.array(*[F.lit(x) for x in READINESS_GROUPS[group]]))
    status = F.when(hit("BLOCKED"), "BLOCKED").when(hit("STALE"), "STALE").when(hit("INCOMPLETE"), "INCOMPLETE").otherwise("READY_FOR_EXECUTOR")
    return (
        plans.withColumn("checks", checks).withColumn("__failed", failed)
        .withColumn("readiness_status", status).drop("__failed"))


def violations(df: DataFrame, key: str, enums: dict[str, tuple[str, ...]] | None = None,
               ranges: dict[str, tuple[float | None, float | None]] | None = None,
               required: list[str] = ()) -> DataFrame:
    """Rows breaking a value rule, as (key, rule, value). One pass, one row per broken rule."""
    broken = []
    for name, allowed in (enums or {}).items():
        broken.append((f"{name} in vocabulary", name, F.col(name).isNotNull() & ~F.col(name).isin(*allowed)))
    for name, (low, high) in (ranges or {}).items():
        value = F.col(name)
        out = F.lit(False)
        if low is not None:
            out = out | (value < low)
        if high is not None:
            out = out | (value > high)
        broken.append((f"{name} in range", name, value.isNotNull() & out))
    for name in required:
        broken.append((f"{name} required", name, F.col(name).isNull()))
    entries = [F.when(bad, F.struct(F.lit(rule).alias("rule"), F.col(name).cast("string").alias("value")))
               for rule, name, bad in broken]
    return df.select(F.col(key).cast("string").alias("row_key"), F.inline(F.array_compact(F.array(*entries))))


def repeated(df: DataFrame, key: list[str], rule: str, where: Column | None = None) -> DataFrame:
    """Keys that should be unique (among the rows of ``where``) and are not. A key with a null repeats nothing."""
    rows = (df if where is None else df.where(where)).dropna("any", subset=key)
    return (
        rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        .select(F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("row_key"),
                F.lit(rule).alias("rule"), F.col("n").cast("string").alias("value")))


def orphans(parents: dict[str, tuple[DataFrame, str]], references: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Keys that rows refer to and no parent has, as (row_key, rule, value): the key, `<column> refers to <parent>`
    and how many rows name it.

    ``parents`` gives each parent table and its key; ``references`` are (table, column, parent). All are checked in one
    pass: keys are tagged with the parent they belong to and grouped once, combined before the shuffle, so neither a
    parent that is named by many tables nor a popular key is read or moved twice. A null refers to nothing.
    """
    rules = {i: f"{column} refers to {parent}" for i, (_, column, parent) in enumerate(references)}
    held = [df.select(F.lit(name).alias("parent"), F.col(key).cast("string").alias("row_key"), F.lit(-1).alias("rule")) for name, (df, key) in parents.items()]
    named = [df.select(F.lit(parent).alias("parent"), F.col(column).cast("string").alias("row_key"), F.lit(i).alias("rule"))
             for i, (df, column, parent) in enumerate(references)]
    rows = held[0]
    for more in [*held[1:], *named]:
        rows = rows.unionByName(more)
    counted = rows.where(F.col("row_key").isNotNull()).groupBy("parent", "row_key").agg(
        F.bool_or(F.col("rule") == -1).alias("held"),
        F.array(*[F.struct(F.lit(text).alias("rule"), F.count_if(F.col("rule") == i).alias("n")) for i, text in rules.items()]).alias("told"))
    lost = counted.where(~F.col("held")).select("row_key", F.inline(F.filter("told", lambda x: x["n"] > 0)))
    return lost.select("row_key", "rule", F.col("n").cast("string").alias("value"))
