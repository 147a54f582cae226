"""Ingest plans: destinations, collisions, generation, reconcile, approval, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions import paths, unicode
from shelfmark.operators import checks, reconcile

# Fixed values in this module: the wording of errors, reasons and summaries, and the statuses
# that hold no claim on a destination.
NOT_COMPETING = ("EXECUTED", "SUPERSEDED")


def _join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def movie_destination(df: DataFrame, title: str = "title", year: str = "release_year", extension: str = "extension",
                      root: str = "destination_root", edition: str | None = None) -> DataFrame:
    """Add library_root, directory, filename, full_path, or destination_error."""
    t, y, ext = F.col(title), F.col(year), paths.dotted_extension(F.col(extension))
    name = paths.movie_stem(t, y)
    stem = name
    if edition is not None:
        e = F.col(edition)
        stem = F.when(F.coalesce(e, F.lit("")) == "", name).otherwise(F.concat_ws(" - ", name, e))
    df, folder, file = _named(df, name, stem)
    error = (
        F.when(F.coalesce(F.trim(t), F.lit("")) == "", "movie destination requires a non-empty title")
        .when(F.coalesce(y, F.lit(0)) <= 0, "movie destination requires a positive release year")
        .when(ext.isNull(), F.concat(F.lit("unsupported extension for a destination path: "), F.col(extension)))
        .when(folder.isNull() | file.isNull(), "path component sanitizes to empty or reserved value"))
    return _place(df, error, F.rtrim(F.col(root), F.lit("/")), [folder], file, ext)


def episode_destination(df: DataFrame, series: str = "title", season: str = "season_number",
                        episodes: str = "episode_numbers", episode_title: str = "episode_title",
                        extension: str = "extension", root: str = "destination_root") -> DataFrame:
    """Add library_root, directory, filename, full_path, or destination_error."""
    s, ext = F.col(series), paths.dotted_extension(F.col(extension))
    tag = paths.episode_tag(F.col(season), F.col(episodes))
    df, folder, file = _named(df, s, paths.episode_stem(s, tag, F.col(episode_title)))
    error = (
        F.when(F.coalesce(F.trim(s), F.lit("")) == "", "episode destination requires a non-empty series title")
        .when(tag.isNull(), "episode destination requires at least one episode number")
        .when(ext.isNull(), F.concat(F.lit("unsupported extension for a destination path: "), F.col(extension)))
        .when(folder.isNull() | file.isNull(), "path component sanitizes to empty or reserved value"))
    folders = [folder, F.format_string("Season %02d", F.col(season))]
    return _place(df, error, F.rtrim(F.col(root), F.lit("/")), folders, file, ext)


def _named(df: DataFrame, folder: Column, stem: Column) -> tuple[DataFrame, Column, Column]:
    """The two names as columns of df, each sanitised once however often it is used."""
    df = df.withColumns({"__folder": unicode.composed(folder), "__stem": unicode.composed(stem)})
    df = df.withColumns({n: paths.safe_component(F.col(n), composed=True) for n in ("__folder", "__stem")})
    return df, F.col("__folder"), F.col("__stem")


def _place(df: DataFrame, error: Column, root: Column, folders: list[Column], stem: Column, ext: Column) -> DataFrame:
    df = df.withColumns({"destination_error": error, "__stem": stem, "__dir": _join_path(root, *folders)})
    good = F.col("destination_error").isNull()
    filename = F.concat(F.col("__stem"), ext)
    return df.withColumns({
        "library_root": F.when(good, root),
        "directory": F.when(good, F.col("__dir")),
        "filename": F.when(good, filename),
        "full_path": F.when(good, _join_path(F.col("__dir"), filename)),
    }).drop("__folder", "__stem", "__dir")


def resolve_destination(df: DataFrame, kinds: DataFrame) -> DataFrame:
    """Destination of each file from its identity and the requested kind.

    ``df`` holds identity columns (media_type, title, release_year, season_number,
    episode_number, episode_title), extension and destination_kind. ``kinds`` is the
    configuration dimension (media_type, destination_kind, category_key, destination_root).
    """
    joined = df.join(kinds.withColumn("__known", F.lit(True)), ["media_type", "destination_kind"], "left")
    movie = F.col("media_type") == "MOVIE"
    problem = (
        F.when(F.col("__known").isNull(), F.format_string(
            "destination category '%s' is not valid for a %s identity", F.col("destination_kind"), F.col("media_type")))
        .when(F.coalesce(F.col("destination_root"), F.lit("")) == "", F.format_string(
            "no NAS root configured for destination category '%s'", F.col("category_key")))
        .when(movie & F.col("release_year").isNull(), "resolved identity has no release year; cannot build a movie destination")
        .when(~movie & (F.col("season_number").isNull() | F.col("episode_number").isNull()),
              "resolved identity has no season/episode number; cannot build an episode destination"))
    # Name both kinds in one pass: a name is text from the identity, sanitised once.
    ext = paths.dotted_extension(F.col("extension"))
    title = F.coalesce("title", F.lit(""))
    tag = paths.episode_tag(F.col("season_number"), F.array("episode_number"))
    named = joined.withColumns({
        "__problem": problem,
        "__folder": F.when(movie, paths.movie_stem(title, F.col("release_year"))).otherwise(title),
        "__stem": F.when(movie, paths.movie_stem(title, F.col("release_year"))).otherwise(
            paths.episode_stem(title, tag, F.col("episode_title"))),
    })
    named = named.withColumns({"__folder": unicode.composed(F.col("__folder")), "__stem": unicode.composed(F.col("__stem"))})
    named = named.withColumns({
        "__folder": paths.safe_component(F.col("__folder"), composed=True),
        "__stem": paths.safe_component(F.col("__stem"), composed=True)})
    naming = (
        F.when(F.trim(title) == "", F.when(movie, "movie destination requires a non-empty title").otherwise(
            "episode destination requires a non-empty series title"))
        .when(movie & (F.col("release_year") <= 0), "movie destination requires a positive release year")
        .when(ext.isNull(), F.concat(F.lit("unsupported extension for a destination path: "), F.col("extension")))
        .when(F.col("__folder").isNull() | F.col("__stem").isNull(), "path component sanitizes to empty or reserved value"))
    named = named.withColumn("destination_error", F.coalesce(
        "__problem", F.concat(F.lit("destination naming failed: "), naming)))
    root = F.rtrim(F.col("destination_root"), F.lit("/"))
    directory = F.when(movie, _join_path(root, F.col("__folder"))).otherwise(
        _join_path(root, F.col("__folder"), F.format_string("Season %02d", F.col("season_number"))))
    good = F.col("destination_error").isNull()
    named = named.withColumns({
        "destination_library": F.when(good, F.col("destination_root")),
        "destination_directory": F.when(good, directory),
        "destination_filename": F.when(good, F.concat("__stem", ext))})
    return named.withColumn("destination_path", F.when(good, _join_path(
        F.col("destination_directory"), F.col("destination_filename")))).drop("__known", "__problem", "__folder", "__stem")


def claims(plans: DataFrame) -> DataFrame:
    """Per destination, the two lowest claims of different files: first_id, first_file, second_id.

    Enough to name a competitor for any file without pairing the plans of a destination. Both
    steps reduce before their shuffle.
    """
    live = plans.where(~F.col("status").isin(*NOT_COMPETING) & F.col("destination_directory").isNotNull())
    per_file = live.groupBy("destination_directory", "destination_filename", "media_file_id").agg(F.min("plan_id").alias("plan_id"))
    window = Window.partitionBy("destination_directory", "destination_filename").orderBy("plan_id")
    two = per_file.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= 2)
    at = lambda n, c: F.max(F.when(F.col("__n") == n, F.col(c)))
    return two.groupBy("destination_directory", "destination_filename").agg(
        at(1, "plan_id").alias("first_id"), at(1, "media_file_id").alias("first_file"), at(2, "plan_id").alias("second_id"))


def with_competitor(df: DataFrame, plans: DataFrame) -> DataFrame:
    """Add ``competing_plan_id``: another file's live plan on the same destination, lowest id."""
    held = claims(plans).select(F.col("destination_directory").alias("__dir"), F.col("destination_filename").alias("__file"),
                                "first_id", "first_file", "second_id")
    keyed = df.withColumn("__key", reconcile.join_key(df, "destination_directory", "media_file_id"))
    same = (F.col("__key") == F.col("__dir")) & (F.coalesce("destination_filename", F.lit("")) == F.col("__file"))
    return keyed.join(held, same, "left").withColumn("competing_plan_id", _rival()).drop(
        "__key", "__dir", "__file", "first_id", "first_file", "second_id")


def _rival() -> Column:
    return F.when(F.col("first_file") == F.col("media_file_id"), F.col("second_id")).otherwise(F.col("first_id"))


def with_holder(df: DataFrame, holders: DataFrame, path: str, flags: dict[str, str], spread: str = "media_file_id") -> DataFrame:
    """Left join ``holders`` on ``path``, with their flags renamed and false where nothing holds it. ``spread`` names
    the column by which rows without a path are dealt out."""
    held = holders.select(F.col("absolute_path").alias("__held"), *[F.col(a).alias(b) for a, b in flags.items()])
    keyed = df.withColumn("__key", reconcile.join_key(df, path, spread))
    return keyed.join(held, F.col("__key") == F.col("__held"), "left").drop("__key", "__held").withColumns(
        {b: F.coalesce(b, F.lit(False)) for b in flags.values()})


_CLAIM = "struct<first_id:bigint,first_file:bigint,second_id:bigint>"


def _claim_key(directory: Column, filename: Column) -> Column:
    return F.concat(F.lit("C"), directory, F.lit("\x00"), filename)


def place_facts(active: DataFrame, plans: DataFrame, listing: DataFrame | None) -> DataFrame:
    """What is known of each path and each destination: (key, __active, __listed, __claim), one row per key.

    ``active`` are the files of the inventory, ``listing`` what is on disk (the inventory itself, where not given).
    """
    def held(rows: DataFrame, in_inventory: bool, on_disk: bool) -> DataFrame:
        return rows.select(F.concat(F.lit("P"), "absolute_path").alias("key"), F.lit(in_inventory).alias("__active"),
                           F.lit(on_disk).alias("__listed"), F.lit(None).cast(_CLAIM).alias("__claim"))

    rows = held(active, True, listing is None)
    if listing is not None:
        rows = rows.unionByName(held(listing, False, True))
    claimed = claims(plans).where(F.col("destination_filename").isNotNull()).select(
        _claim_key(F.col("destination_directory"), F.col("destination_filename")).alias("key"), F.lit(False).alias("__active"),
        F.lit(False).alias("__listed"), F.struct("first_id", "first_file", "second_id").cast(_CLAIM).alias("__claim"))
    return rows.unionByName(claimed).where(F.col("key").isNotNull()).groupBy("key").agg(
        F.bool_or("__active").alias("__active"), F.bool_or("__listed").alias("__listed"), F.min("__claim").alias("__claim"))


def looked_up(df: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """(by, __catalogued, __on_disk, __dir_is_file, competing_plan_id) for the rows of df whose destination something
    holds or claims. df has destination_directory, destination_filename, destination_path and media_file_id.

    Only the keys asked for go to the facts, not the rows they belong to, and rows without a destination ask nothing.
    """
    def ask(role: str, key: Column) -> Column:
        return F.when(key.isNotNull(), F.struct(F.lit(role).alias("role"), key.alias("key")))

    path = lambda c: F.concat(F.lit("P"), F.col(c))
    asked = F.array_compact(F.array(
        ask("path", path("destination_path")), ask("directory", path("destination_directory")),
        ask("claim", _claim_key(F.col("destination_directory"), F.col("destination_filename")))))
    own = list(dict.fromkeys([*by, "media_file_id"]))
    met = df.select(*own, F.inline(asked)).join(facts, "key")
    told = lambda role, flag: F.coalesce(F.bool_or((F.col("role") == role) & F.col(flag)), F.lit(False))
    found = met.groupBy(*own).agg(
        told("path", "__active").alias("__catalogued"), told("path", "__listed").alias("__on_disk"),
        told("directory", "__listed").alias("__dir_is_file"), F.max(F.when(F.col("role") == "claim", F.col("__claim"))).alias("__claim"))
    return found.select("*", "__claim.*").withColumn("competing_plan_id", _rival()).select(
        *by, "__catalogued", "__on_disk", "__dir_is_file", "competing_plan_id")


def with_collisions(df: DataFrame, inventory: DataFrame, plans: DataFrame, listing: DataFrame | None = None,
                    by: str = "media_file_id") -> DataFrame:
    """Add ``collisions``, the reasons a destination cannot be used.

    ``inventory`` is the file state (a MISSING row holds nothing); ``listing`` is a fresh
    listing of the destination roots and stands for what is on disk. ``by`` names the key of df.
    """
    facts = place_facts(inventory.where(F.col("state") == "ACTIVE"), plans, listing)
    df = df.join(looked_up(df, facts, [by]), by, "left")
    c = F.col
    reasons = F.array_compact(F.array(
        F.when(c("absolute_path") == c("destination_path"), "source and destination paths are identical"),
        F.when(c("__on_disk"), F.concat(F.lit("destination path already exists on disk: "), c("destination_path")))
        .when(c("__dir_is_file"), F.concat(F.lit("destination directory path is occupied by a file: "), c("destination_directory"))),
        F.when(c("__catalogued"), "destination path already exists in canonical inventory"),
        F.when(c("competing_plan_id").isNotNull(), F.format_string(
            "another active plan (#%d) targets the same destination", c("competing_plan_id"))),
    ))
    return df.withColumn("collisions", reasons).drop("__catalogued", "__on_disk", "__dir_is_file")


def gathered(key: str, parts: dict[str, DataFrame], lists: tuple[str, ...] = ()) -> DataFrame:
    """One row per key with a struct per part, null where the part has no row of the key: one shuffle, however many
    parts. Of several rows of a part the least counts; parts in ``lists`` come as arrays of all."""
    tagged = [df.where(F.col(key).isNotNull()).select(key, F.struct(*[c for c in df.columns if c != key]).alias(name)) for name, df in parts.items()]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.groupBy(key).agg(*[
        (F.collect_list(n) if n in lists else F.min(n)).alias(n) for n in parts])


def actions(source: Column, directory: Column, full_path: Column) -> Column:
    """Proposed actions in order: two without a destination, six with one."""
    text = F.lit(None).cast("string")

    def action(kind: Column | str, src: Column = text, dst: Column = text) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("action_type"), src.alias("source_path"), dst.alias("destination_path"),
                        F.lit(schemas.PROPOSED).alias("execution_state"))

    move = F.when(paths.parent_directory(source) == directory, "RENAME").otherwise("MOVE")
    start = F.array(action("VALIDATE_SOURCE", source), action("VERIFY_MEDIA", source))
    rest = F.array(
        action("CREATE_DIRECTORY", dst=directory), action(move, source, full_path),
        action("REFRESH_INVENTORY"), action("REQUEST_PLEX_REFRESH"))
    return F.when(full_path.isNull(), start).otherwise(F.concat(start, rest))


def action_rows(plans: DataFrame, key: str = "media_file_id") -> DataFrame:
    """Actions as rows numbered from 1."""
    return plans.select(key, F.posexplode_outer("actions").alias("__p", "a")).where(F.col("__p").isNotNull()).select(
        key, (F.col("__p") + 1).alias("action_order"), "a.*")


def admit(requests: DataFrame, files: DataFrame, kinds: DataFrame, incoming_roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests that a plan can be made for, and the others with the reason: (admitted, rejects).

    A request names a known file below an incoming root, and no kind or one that is configured. Asking twice for a
    file gives one plan, for the last kind asked in text order.
    """
    below = F.lit(False)
    for root in incoming_roots:
        below = below | paths.is_under(F.col("__path"), F.lit(root))
    held = files.select(F.col("media_file_id").alias("__held"), F.col("absolute_path").alias("__path"))
    named = kinds.select(F.col("destination_kind").alias("__kind")).distinct()
    joined = requests.join(held, F.col("media_file_id") == F.col("__held"), "left").join(
        named, F.col("destination_kind") == F.col("__kind"), "left")
    reason = (
        F.when(F.col("__held").isNull(), "no such media file")
        .when(~F.coalesce(below, F.lit(False)), "the file is not below an incoming root")
        .when(F.col("destination_kind").isNotNull() & F.col("__kind").isNull(), F.format_string(
            "unknown destination category '%s'", F.col("destination_kind"))))
    checked = joined.withColumn("reject_reason", reason)
    admitted = checked.where(F.col("reject_reason").isNull()).groupBy("media_file_id").agg(
        F.max("destination_kind").alias("destination_kind"))
    return admitted, checked.where(F.col("reject_reason").isNotNull()).select(*requests.columns, "reject_reason")


def generate(requests: DataFrame, files: DataFrame, candidates: DataFrame, assignments: DataFrame,
             identities: DataFrame, blocking: DataFrame, plans: DataFrame, kinds: DataFrame,
             listing: DataFrame | None = None) -> DataFrame:
    """Fresh plans for the requested files (media_file_id, destination_kind or null), as ``admit`` passes them.

    All that belongs to a file is gathered by one grouping of the tagged tables, one row of each. Rows that something blocks, or that name no kind, get no name
    and no path, so only the others are sanitised and meet held and claimed destinations.
    """
    held = assignments.where(F.col("status") == "ACTIVE").select(
        "media_file_id", "assignment_id", "identity_id", "assignment_method", "confirmed_for_ingest_at")
    known = identities.select("identity_id", "media_type", "title", "release_year", "season_number",
                              "episode_number", "episode_title").withColumn("__identity", F.lit(True))
    all_of = gathered("media_file_id", {
        "asked": requests.select("media_file_id", "destination_kind"), "file": files,
        "candidate": candidates.select("media_file_id", "candidate_id"),
        "assigned": held.join(known, "identity_id", "left"),
        "findings": blocking.select("media_file_id", "blocking_finding_count")})
    df = all_of.where(F.col("asked").isNotNull() & F.col("file").isNotNull()).select(
        "media_file_id", "asked.*", "file.*", "candidate.*", "assigned.*",
        F.coalesce("findings.blocking_finding_count", F.lit(0)).alias("blocking_finding_count"))
    df = checks.verify_media(df)
    c, v = F.col, F.col("verification_status")
    unresolved = c("assignment_id").isNull() | c("__identity").isNull()
    df = df.withColumn("__blocks", F.array_compact(F.array(
        F.when(c("candidate_id").isNull(), "no local identification candidate exists for this file"),
        F.when(unresolved, "no resolved ACTIVE external identity assignment exists for this file"),
        F.when(v.isin("FAIL", "NOT_PROBED"), F.format_string("media verification did not pass (status=%s)", v)),
    )))
    clear = F.size("__blocks") == 0
    df = df.withColumn("__reviews", F.array_compact(F.array(
        F.when(~unresolved & (c("assignment_method") == "MANUAL") & c("confirmed_for_ingest_at").isNull(),
               "identity was manually selected and has not yet been confirmed for ingest"),
        F.when(v == "WARNING", "media verification produced warnings"),
        F.when(clear & c("destination_kind").isNull(), "destination category not specified"),
    )))
    # A row that is not to be placed goes through without a name: nothing to sanitise, and no path to look up.
    wanted = clear & c("destination_kind").isNotNull()
    df = df.withColumns({n: F.when(wanted, c(n)) for n in ("title", "episode_title", "destination_kind")})
    df = resolve_destination(df, kinds)
    for name in ("destination_library", "destination_directory", "destination_filename", "destination_path"):
        df = df.withColumn(name, F.when(wanted, c(name)))
    df = with_collisions(df, files, plans, listing)
    df = df.withColumn("__blocks", F.concat(
        "__blocks", F.array_compact(F.array(F.when(wanted, c("destination_error")))),
        F.when(wanted & c("destination_path").isNotNull(), c("collisions")).otherwise(F.array().cast("array<string>"))))
    blocked, doubtful = F.size("__blocks") > 0, F.size("__reviews") > 0
    status = F.when(blocked, "BLOCKED").when(doubtful, "REVIEW_REQUIRED").otherwise("READY_FOR_REVIEW")
    summary = (
        F.when(blocked, F.concat(F.lit("Blocked: "), F.array_join("__blocks", "; ")))
        .when(doubtful, F.concat(F.lit("Review required: "), F.array_join("__reviews", "; ")))
        .otherwise("Ready for review; no blocking issues found."))
    return df.select(
        "media_file_id", "candidate_id", "assignment_id", status.alias("status"),
        F.col("absolute_path").alias("source_path"), F.col("size_bytes").alias("source_size_bytes"),
        F.col("mtime").alias("source_mtime"), "destination_library", "destination_directory", "destination_filename",
        "verification_status", F.col("checks").alias("verification"),
        F.concat("__blocks", "__reviews").alias("blocking_reasons"), summary.alias("summary"),
        actions(c("absolute_path"), c("destination_directory"), c("destination_path")).alias("actions"))


# The columns whose change makes a new plan version.
CONTENT = [
    "candidate_id", "assignment_id", "source_path", "source_size_bytes", "source_mtime",
    "destination_library", "destination_directory", "destination_filename",
    "verification_status", "verification", "blocking_reasons", "summary",
]


def reconcile_plans(stored: DataFrame, fresh: DataFrame, run_ts: Column, content: list[str] = CONTENT) -> DataFrame:
    """Stored plans against freshly generated ones: all rows to hold, with ``outcome``.

    An equal plan is untouched, an open one is rewritten under the next version, and an
    approval that no longer holds is superseded by a new plan. History passes through.
    """
    current = F.col("status") != "SUPERSEDED"
    both = reconcile.pair(stored.where(current), fresh, ["media_file_id"])
    old, new = F.col("old"), F.col("new")
    equal = reconcile.same(content)
    approved = F.col("old.status") == "APPROVED"
    both = both.withColumn("__outcome",
        F.when(new.isNull(), "LEFT").when(old.isNull(), "INSERTED")
        .when(approved, F.when(equal & (F.col("new.status") == "READY_FOR_REVIEW"), "UNTOUCHED").otherwise("SUPERSEDED"))
        .when(equal & (F.col("old.status") == F.col("new.status")), "UNTOUCHED").otherwise("UPDATED"))
    o = F.col("__outcome")
    types = {f.name: f.dataType for f in stored.schema.fields}
    version = F.coalesce(F.col("old.plan_version"), F.lit(0)) + 1
    new_id = F.xxhash64(F.lit("plan"), "media_file_id", version)
    fresh_columns = [*content, "actions"] if "actions" in stored.columns else content

    def written(c: str, fresh_row: bool) -> Column:
        if c in fresh_columns or c == "status":
            return F.col(f"new.{c}")
        if c == "media_file_id":
            return F.col(c)
        if c == "plan_id":
            return new_id if fresh_row else F.col("old.plan_id")
        if c == "plan_version":
            return version
        if c == "updated_at" or (c == "created_at" and fresh_row):
            return run_ts
        return F.lit(None) if fresh_row else F.col(f"old.{c}")

    def row(build, outcome: Column) -> Column:
        return F.struct(*[build(c).cast(types[c]).alias(c) for c in stored.columns], outcome.alias("outcome"))

    kept = F.when(o.isin("LEFT", "UNTOUCHED"), row(lambda c: F.col(f"old.{c}"), o))
    updated = F.when(o == "UPDATED", row(lambda c: written(c, False), o))
    closed = F.when(o == "SUPERSEDED", row(
        lambda c: F.lit("SUPERSEDED") if c == "status" else run_ts if c == "updated_at" else F.col(f"old.{c}"), o))
    opened = F.when(o.isin("INSERTED", "SUPERSEDED"), row(lambda c: written(c, True), F.lit("INSERTED")))
    moved_on = both.select(F.inline(F.array_compact(F.array(kept, updated, closed, opened))))
    return moved_on.unionByName(stored.where(~current).withColumn("outcome", F.lit("LEFT")))


def approve(plans: DataFrame, decisions: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Approve READY_FOR_REVIEW plans. The first valid decision approves; later ones find the plan approved and go to
    the rejects with all others that do not apply."""
    status = F.col("state.status")
    invalid = F.when(F.col("state").isNull(), "no such plan").when(
        status != "READY_FOR_REVIEW", F.format_string("plan is %s, not READY_FOR_REVIEW", status))
    pairs, rejects = reconcile.apply_decisions(
        plans, decisions, ["plan_id"], invalid, keep="first", repeated=F.lit("plan is APPROVED, not READY_FOR_REVIEW"))
    hit = F.col("decision").isNotNull()
    changed = {"status": F.lit("APPROVED"), "approved_at": run_ts, "approved_by": F.col("decision.decided_by"), "updated_at": run_ts}
    return pairs.select(*[
        F.when(hit, changed[c]).otherwise(F.col(f"state.{c}")).alias(c) if c in changed else F.col(f"state.{c}")
        for c in plans.columns]), rejects


def override_lineage(assignments: DataFrame, attempts: DataFrame) -> DataFrame:
    """The override (if any) behind each assignment, by way of its attempt."""
    # Assignments without an attempt are left out of the join: as one key they would meet on one partition.
    own = assignments.select("assignment_id", "identity_id", "attempt_id")
    held = attempts.select("attempt_id", "override_id")
    return own.where(F.col("attempt_id").isNotNull()).join(held, "attempt_id", "left").unionByName(
        own.where(F.col("attempt_id").isNull()).withColumn("override_id", F.lit(None).cast(held.schema["override_id"].dataType))).select(
        "assignment_id", "identity_id", F.col("override_id").alias("plan_override_id"))


def audit(plans: DataFrame, files: DataFrame, candidates: DataFrame, overrides: DataFrame, assignments: DataFrame,
          attempts: DataFrame, identities: DataFrame, blocking: DataFrame, roots: DataFrame,
          listing: DataFrame | None = None) -> DataFrame:
    """Readiness of every plan against the world as it is now. Reads only.

    ``plans`` carry ``actions`` (action_order, action_type, execution_state,
    overwrite_requested); ``overrides`` are the open ones; ``roots`` lists configured roots. All that belongs to a file
    is gathered by one grouping, and plans meet it in one join.
    """
    c = F.col
    source = files.select(
        "media_file_id", c("state").alias("source_state"), c("absolute_path").alias("source_absolute_path"),
        c("size_bytes").alias("source_size_bytes"), c("mtime").alias("source_mtime"), F.lit(True).alias("source_media_file_exists"))
    renamed = {"status": "plan_status", "source_path": "plan_source_path", "source_size_bytes": "plan_source_size_bytes",
               "source_mtime": "plan_source_mtime", "candidate_id": "plan_candidate_id",
               "assignment_id": "plan_assignment_id", "verification_status": "plan_verification_status"}
    lineage = override_lineage(assignments, attempts)
    lineage = lineage.join(identities.select("identity_id", F.lit(True).alias("external_identity_exists")), "identity_id", "left").drop("identity_id")
    named = plans.where(c("assignment_id").isNotNull()).select("media_file_id", "plan_id", "assignment_id")
    lineage = named.join(lineage, "assignment_id").select("media_file_id", "plan_id", "plan_override_id", "external_identity_exists")
    known_roots = roots.select(c("root_path").alias("destination_library")).distinct().withColumn("destination_root_configured", F.lit(True))
    path = F.when(c("destination_directory").isNotNull() & c("destination_filename").isNotNull(),
                  F.concat_ws("/", "destination_directory", "destination_filename"))
    facts = place_facts(files.where(c("state") == "ACTIVE"), plans, listing)
    places = looked_up(plans.withColumn("destination_path", path), facts, ["media_file_id", "plan_id"])
    gather = gathered("media_file_id", {
        "source": source, "places": places, "lineage": lineage,
        "candidate": candidates.select("media_file_id", c("candidate_id").alias("current_candidate_id")),
        "override": overrides.select("media_file_id", c("override_id").alias("current_override_id")),
        "assigned": assignments.where(c("status") == "ACTIVE").select("media_file_id", c("assignment_id").alias("current_assignment_id")),
        "findings": blocking.select("media_file_id", c("blocking_finding_count").alias("current_blocking_finding_count")),
    }, lists=("places", "lineage"))
    own = lambda name: F.get(F.filter(name, lambda x: x["plan_id"] == c("plan_id")), F.lit(0))
    df = plans.withColumnsRenamed(renamed).join(gather, "media_file_id", "left").withColumns(
        {"places": own("places"), "lineage": own("lineage")})
    df = df.select(
        *[renamed.get(n, n) for n in plans.columns], "source.*", "candidate.*", "override.*", "assigned.*", "findings.*",
        "lineage.plan_override_id", "lineage.external_identity_exists", "places.competing_plan_id",
        *[F.coalesce(f"places.{n}", F.lit(False)).alias(n) for n in ("__catalogued", "__on_disk")])
    df = df.join(known_roots, "destination_library", "left")
    false = F.lit(False)
    df = df.withColumns({
        "source_media_file_exists": F.coalesce("source_media_file_exists", false),
        "external_identity_exists": F.coalesce("external_identity_exists", false),
        "current_blocking_finding_count": F.coalesce("current_blocking_finding_count", F.lit(0)),
        "destination_root_configured": F.coalesce("destination_root_configured", false),
        "destination_path_inside_root": F.coalesce(paths.is_under(c("destination_directory"), c("destination_library")), false),
        "destination_still_unoccupied": ~(c("__catalogued") | c("__on_disk")),
    })
    return checks.evaluate_readiness(df).drop("__catalogued", "__on_disk")
