"""Inventory state: libraries, snapshot reconcile with change events, relocation, run records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import reconcile

# Fields whose change makes an UPDATED event, in event order.
PLACE_FIELDS = ["library_id", "relative_path", "filename", "extension", "parent_directory", "layout", "size_bytes", "mtime"]
METADATA_FIELDS = ["container", "duration_seconds", "overall_bitrate"]
COMPARED_FIELDS = [*PLACE_FIELDS, *METADATA_FIELDS, "media_info_error"]
TRACK_FIELDS = ["video_tracks", "audio_tracks", "subtitle_tracks"]


def sync_libraries(stored: DataFrame, configured: DataFrame, run_ts: Column) -> DataFrame:
    """Libraries by category: the configured root wins, and a row is touched only on change."""
    both = reconcile.pair(stored, configured, ["category"])
    moved = F.col("new").isNotNull() & ~F.col("old.root_path").eqNullSafe(F.col("new.root_path"))
    return both.select(
        F.coalesce("old.library_id", reconcile.surrogate_key(F.col("category"))).alias("library_id"),
        "category",
        F.coalesce("new.root_path", "old.root_path").alias("root_path"),
        F.when(moved, run_ts).otherwise(F.col("old.updated_at")).alias("updated_at"),
        F.when(F.col("old").isNull(), "CREATED").when(moved, "UPDATED").otherwise("UNCHANGED").alias("outcome"),
    )


def track_changes(old: str = "old", new: str = "new", fields: list[str] = TRACK_FIELDS) -> Column:
    """Tracks compared by value; an event tells counts only."""
    def change(field):
        before, after = F.col(f"{old}.{field}"), F.col(f"{new}.{field}")
        before = F.coalesce(before, F.slice(after, 1, 0))
        return F.when(before != after, F.struct(
            F.lit(field).alias("field"),
            F.array_size(before).cast("string").alias("old"), F.array_size(after).cast("string").alias("new")))

    return F.array_compact(F.array(*[change(f) for f in fields]))


def metadata_update(old: str = "old", new: str = "new", fields: list[str] = METADATA_FIELDS) -> dict[str, Column]:
    """Metadata columns after a probe run: a success replaces, a failure keeps the last good values."""
    failed = F.col(f"{new}.media_info_error").isNotNull()
    return {f: F.when(failed, F.col(f"{old}.{f}")).otherwise(F.col(f"{new}.{f}")) for f in fields}


def reconcile_listing(state: DataFrame, listing: DataFrame, scan_id: int, run_ts: Column,
                      scanned_libraries: DataFrame, metadata_enabled: bool = True,
                      key: str = "absolute_path", compared: list[str] | None = None) -> DataFrame:
    """One full outer join of stored files with a listing.

    Returns one row per key: the file's ``next`` state, its ``change_type`` (null when nothing
    happened) and ``changes``. ``scanned_libraries`` (library_id, one per configured category) are
    those whose root existed; files of any other library stay as they are. Their few ids come in
    as one scalar, as a join would shuffle all files by library. The listing holds rows of
    scanned libraries.

    A listing row with neither metadata nor an error was not probed and leaves the stored
    metadata alone.
    """
    compared = COMPARED_FIELDS if compared is None else compared
    scanned = scanned_libraries.agg(F.collect_set("library_id")).scalar()
    both = reconcile.pair(state, listing, [key])
    both = both.withColumn("__lost", F.col("new").isNull() & (F.col("old.state") == "ACTIVE")
                           & F.array_contains(scanned, F.col("old.library_id")))
    old, new = F.col("old"), F.col("new")
    types = {f.name: f.dataType for f in state.schema.fields}

    probed = F.lit(metadata_enabled) & (
        F.col("new.video_tracks").isNotNull() | F.col("new.media_info_error").isNotNull())
    update = metadata_update(fields=[*METADATA_FIELDS, *TRACK_FIELDS])
    lost = F.col("__lost")

    def value(c: str) -> Column:
        if c == "media_file_id":
            made = reconcile.surrogate_key(F.col(key), F.lit(scan_id))
            return F.coalesce(F.col("old.media_file_id"), made)
        if c == "state":
            return F.when(new.isNotNull(), "ACTIVE").when(lost, "MISSING").otherwise(F.col("old.state"))
        if c == "first_seen_scan_id":
            return F.coalesce(F.col("old.first_seen_scan_id"), F.lit(scan_id))
        if c == "last_seen_scan_id":
            return F.when(new.isNotNull(), F.lit(scan_id)).otherwise(F.col("old.last_seen_scan_id"))
        if c == "missing_since_scan_id":
            return F.when(lost, F.lit(scan_id)).when(new.isNull(), F.col("old.missing_since_scan_id"))
        if c == "media_info_probed_at":
            return F.when(probed, run_ts).otherwise(F.col("old.media_info_probed_at"))
        if c == "media_info_error":
            return F.when(probed, F.col("new.media_info_error")).otherwise(F.col("old.media_info_error"))
        if c in update:
            return F.when(probed, update[c]).otherwise(F.col(f"old.{c}"))
        return F.when(new.isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))

    both = both.withColumn("next", F.struct(*[value(c).cast(types[c]).alias(c) for c in state.columns]))
    read = F.lit(metadata_enabled) & F.col("new.video_tracks").isNotNull() & F.col("new.media_info_error").isNull()
    no_changes = F.array().cast("array<struct<field: string, old: string, new: string>>")
    changes = F.when(old.isNotNull() & new.isNotNull(), F.concat(
        reconcile.field_changes(compared, "old", "next"),
        F.when(read, track_changes("old", "new")).otherwise(no_changes))).otherwise(no_changes)
    both = both.withColumn("changes", changes)
    change = (
        F.when(old.isNull(), "ADDED")
        .when(lost, "MISSING")
        .when(new.isNotNull() & (F.col("old.state") == "MISSING"), "RESTORED")
        .when(new.isNotNull() & (F.size("changes") > 0), "UPDATED")
    )
    return both.select(key, "next", change.alias("change_type"), "changes")


def next_state(reconciled: DataFrame) -> DataFrame:
    return reconciled.select("next.*")


def change_events(reconciled: DataFrame, scan_id: int) -> DataFrame:
    """The scan's events; an empty change list is null."""
    return reconciled.where(F.col("change_type").isNotNull()).select(
        F.lit(scan_id).cast("long").alias("scan_run_id"),
        F.col("next.media_file_id").alias("media_file_id"),
        F.col("next.library_id").alias("library_id"),
        "change_type",
        F.col("next.absolute_path").alias("absolute_path"),
        F.lit(None).cast("string").alias("previous_absolute_path"),
        F.when(F.size("changes") > 0, F.col("changes")).alias("details"),
    )


def relocate(state: DataFrame, moves: DataFrame, scan_id: int, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Give files a new place under the same id; one UPDATED event each.

    ``moves`` (media_file_id and the new place, optionally fresh metadata) holds one row per file.
    """
    moved = F.col("new").isNotNull()
    both = state.select("media_file_id", F.struct(*state.columns).alias("old")).join(
        moves.select("media_file_id", F.struct(*moves.columns).alias("new")), "media_file_id", "left")
    given = set(moves.columns)
    has_probe = "video_tracks" in given
    probed = (F.col("new.video_tracks").isNotNull() | F.col("new.media_info_error").isNotNull()) if has_probe else F.lit(False)
    update = metadata_update(fields=[*METADATA_FIELDS, *TRACK_FIELDS]) if has_probe else {}
    types = {f.name: f.dataType for f in state.schema.fields}

    def value(c: str) -> Column:
        stored = F.col(f"old.{c}")
        if c == "state":
            return F.when(moved, "ACTIVE").otherwise(stored)
        if c == "last_seen_scan_id":
            return F.when(moved, F.lit(scan_id)).otherwise(stored)
        if c == "missing_since_scan_id":
            return F.when(~moved, stored)
        if c in update:
            return F.when(moved & probed, update[c]).otherwise(stored)
        if c == "media_info_error" and has_probe:
            return F.when(moved & probed, F.col("new.media_info_error")).otherwise(stored)
        if c == "media_info_probed_at":
            return F.when(moved & probed, run_ts).otherwise(stored)
        if c in given and c in {*PLACE_FIELDS, "absolute_path"}:
            return F.when(moved, F.col(f"new.{c}")).otherwise(stored)
        return stored

    both = both.withColumn("next", F.struct(*[value(c).cast(types[c]).alias(c) for c in state.columns]))
    compared = [c for c in COMPARED_FIELDS if c in types]
    moved_path = F.array(F.struct(
        F.lit("absolute_path").alias("field"), F.col("old.absolute_path").alias("old"), F.col("next.absolute_path").alias("new")))
    parts = [reconcile.field_changes(compared, "old", "next")]
    if has_probe:
        none = F.array().cast("array<struct<field: string, old: string, new: string>>")
        parts.append(F.when(F.col("new.video_tracks").isNotNull(), track_changes("old", "new")).otherwise(none))
    events = both.where(moved).select(
        F.lit(scan_id).cast("long").alias("scan_run_id"),
        "media_file_id",
        F.col("next.library_id").alias("library_id"),
        F.lit("UPDATED").alias("change_type"),
        F.col("next.absolute_path").alias("absolute_path"),
        F.col("old.absolute_path").alias("previous_absolute_path"),
        F.concat(*parts, moved_path).alias("details"),
    )
    return both.select("next.*"), events


def change_counts(events: DataFrame, key: str = "scan_run_id") -> DataFrame:
    """Events by type for each scan, zero where a scan has none of a type."""
    return events.groupBy(key).agg(*[
        F.count_if(F.col("change_type") == t).alias(f"{t.lower()}_count") for t in schemas.CHANGE_TYPES])


# --- one run --------------------------------------------------------------------------

def one_per_path(listing: DataFrame, key: str = "absolute_path") -> DataFrame:
    """One row per path: nested roots list a file twice, and the last configured library has it."""
    return reconcile.latest(listing, [key], ["library_id", "mtime"])


def scan(state: DataFrame, listing: DataFrame, libraries: DataFrame, scan_id: int, run_ts: Column,
         metadata_enabled: bool = True) -> DataFrame:
    """A listing reconciled into the state: ``libraries`` (library_id, category, exists) are those in scope.

    Write the result once; ``settled_ids``, and then ``next_state``, ``change_events``, ``run_row`` and
    ``duplicate_ids``, read from what was written. Listing rows of libraries whose root is absent are left out.
    """
    scanned = libraries.where(F.col("exists")).select("library_id")
    present = one_per_path(listing.join(scanned, "library_id", "left_semi"))
    return reconcile_listing(state, present, scan_id, run_ts, scanned, metadata_enabled)


def run_row(reconciled: DataFrame, scan_id: int, run_ts: Column, scope_category: str | None = None,
            triggered_by: str = "SCAN") -> DataFrame:
    """The run's record: what was seen and what changed, as one row."""
    seen = F.col("next.last_seen_scan_id") == scan_id
    return reconciled.agg(
        F.count_if(seen).alias("file_count"),
        F.coalesce(F.sum(F.when(seen, F.col("next.size_bytes"))), F.lit(0)).alias("total_size_bytes"),
        *[F.count_if(F.col("change_type") == t).alias(f"{t.lower()}_count") for t in schemas.CHANGE_TYPES],
    ).select(
        F.lit(scan_id).cast("long").alias("scan_run_id"), F.lit("COMPLETE").alias("status"), run_ts.alias("started_at"),
        run_ts.alias("completed_at"), F.lit(triggered_by).alias("triggered_by"),
        F.lit("FULL" if scope_category is None else "CATEGORY").alias("scan_scope"),
        F.lit(scope_category).cast("string").alias("scope_category"), "*")


def duplicate_ids(reconciled: DataFrame) -> DataFrame:
    """Ids that two files share. New ids are hashes, so a run looks before it keeps them; none is the rule."""
    return reconcile.duplicate_keys(reconciled.select("next.media_file_id"), ["media_file_id"])


def settled_ids(reconciled: DataFrame, scan_id: int, key: str = "absolute_path",
                made: Callable[[int], Column] | None = None) -> DataFrame:
    """A written reconcile in which no new file shares an id: where hashes clash, the stored file keeps its id, of new
    ones the first by key, and the others are hashed again with the number of the try (``made``) until all differ.

    A run without a clash costs one count of ids and returns its input. The same input gives the same ids. Stored
    files that share an id already are left to ``duplicate_ids``.
    """
    made = made or (lambda turn: reconcile.surrogate_key(F.col(key), F.lit(scan_id), F.lit(turn)))
    new = F.col("change_type").eqNullSafe("ADDED")
    own = [key, F.col("next.media_file_id").alias("__id")]
    # Only new files move: the others are counted by id and meet no join.
    stored, added = reconciled.where(~new).select(*own), reconciled.where(new).select(*own, F.lit(False).alias("__moved"))
    turn = 0
    while True:
        held = stored.select("__id", F.lit(True).alias("__kept"), F.lit(None).cast("string").alias(key)).unionByName(
            added.select("__id", F.lit(False).alias("__kept"), key))
        twice = held.groupBy("__id").agg(F.count(F.lit(1)).alias("__n"), F.bool_or("__kept").alias("__taken"), F.min(key).alias("__first"))
        late = added.join(twice.where(F.col("__n") > 1), "__id").where(F.col("__taken") | (F.col(key) != F.col("__first")))
        late = late.select(key, F.lit(True).alias("__late"))
        if late.isEmpty():
            break
        turn += 1
        again = F.coalesce("__late", F.lit(False))
        added = added.join(late, key, "left").select(
            key, (F.col("__moved") | again).alias("__moved"), F.when(again, made(turn)).otherwise(F.col("__id")).alias("__id"))
    if not turn:
        return reconciled
    moved = added.where("__moved").select(key, "__id")
    named = F.when(F.col("__id").isNull(), F.col("next")).otherwise(F.col("next").withField("media_file_id", F.col("__id")))
    renamed = reconciled.where(new).join(moved, key, "left").withColumn("next", named).select(*reconciled.columns)
    return reconciled.where(~new).unionByName(renamed)
