"""Operators on small frames: literals, laws, and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import checks, execution, findings, identity, ingest, inventory, linkage, naming, reconcile, search
from shelfmark.sources import listing, probe, readback

TS = "2024-01-01 00:00:00"


def ts(text=TS):
    return F.lit(text).cast("timestamp")


def file_names(spark, rows):
    df = spark.createDataFrame(rows, "media_file_id long, category string, layout string, parent_directory string, filename string")
    return {r["media_file_id"]: r for r in naming.parse(df).collect()}


def test_movie_names(spark):
    got = file_names(spark, [
        (1, "movies", "movie_flat", "/m", "Some.Film.1999.1080p.mkv"), (2, "movies", "movie_folder", "/m/Some Film (1999)", "movie.mkv"),
        (3, "movies", "movie_folder", "/m/Other (2001)", "Some Film (1999).mkv"), (4, "movies", "movie_flat", "/m", "Some Film.mkv"),
        (5, "movies", "movie_flat", "/m", "1080p.mkv"), (6, "movies", "movie_flat", "/m", "7 (1999).mkv"),
        (7, "movies", "movie_folder", "/m/Some Film", "some film part 0 unrated.mkv"), (8, "movies", "movie_folder", "/m/Some Film Part 2", "Some Film 1999.mkv")])
    short = {k: (r.candidate_type, r.confidence, r.parsed_title, r.parsed_year) for k, r in got.items()}
    assert short == {
        1: ("MOVIE", "HIGH", "Some Film", 1999), 2: ("MOVIE", "HIGH", "Some Film", 1999), 3: ("MOVIE", "LOW", "Some Film", 1999),
        4: ("MOVIE", "MEDIUM", "Some Film", None), 5: ("UNKNOWN", "UNKNOWN", None, None), 6: ("MOVIE", "LOW", "7", 1999),
        7: ("MOVIE", "MEDIUM", "some film", None), 8: ("MOVIE", "HIGH", "Some Film", 1999)}
    assert got[2].evidence.movie.title_source == "parent_directory"
    assert (got[7].edition, got[7].part_number, got[8].part_number) == ("Unrated", None, 2)
    assert got[3].evidence.movie.conflict and not got[1].evidence.movie.conflict


def test_episode_names(spark):
    got = file_names(spark, [
        (1, "tv", "tv_season_folder", "/t/Show/Season 01", "Show - S01E02 - Pilot.mkv"), (2, "tv", "tv_season_folder", "/t/Show/Season 02", "S01E02.mkv"),
        (3, "tv", "tv_series_folder", "/t/Show", "S00E01E02.mkv"), (4, "tv", "tv_series_folder", "/t/Show", "Show Trailer.mkv"),
        (5, "tv", "unknown", "/t", "Gag Reel.mkv"), (6, "tv", "tv_series_folder", "/t/Show", "notes.mkv"),
        (7, "incoming", "unknown", "/i", "Show 1x03.mkv"), (8, "incoming", "unknown", "/i", "Pic (1999).mkv"), (9, "incoming", "unknown", "/i", "readme.mkv")])
    short = {k: (r.candidate_type, r.confidence, r.parsed_series_title, r.season_number, r.episode_numbers, r.special_type) for k, r in got.items()}
    assert short == {
        1: ("EPISODE", "HIGH", "Show", 1, [2], None), 2: ("EPISODE", "LOW", "Show", 1, [2], None), 3: ("SPECIAL", "MEDIUM", "Show", 0, [1, 2], "season_zero"),
        4: ("EXTRA", "MEDIUM", "Show", None, None, "trailer"), 5: ("EXTRA", "LOW", None, None, None, "gag_reel"), 6: ("UNKNOWN", "UNKNOWN", "Show", None, None, None),
        7: ("EPISODE", "HIGH", "Show", 1, [3], None), 8: ("MOVIE", "HIGH", None, None, None, None), 9: ("UNKNOWN", "UNKNOWN", None, None, None, None)}
    assert got[1].episode_title == "Pilot" and got[8].parsed_year == 1999


def test_paths_are_placed_under_their_roots(spark):
    rows = [("file:///tmp/lib/sub/LongFilmName.mkv", 5, 1.0), ("/tmp/lib/Empty.mkv", 0, 1.0), ("file:/tmp/lib/_private.mkv", 3, 1.0), ("/tmp/lib/_private.mkv", 4, 2.0),
            ("/tmp/library/No.mkv", 1, 1.0), ("/tmp/lib/tv/100%.mkv", 1, 1.0), ("s3a://box/films/A.mkv", 1, 1.0), ("s3a://other/films/A.mkv", 1, 1.0), (None, 1, 1.0)]
    found, other = listing.place_paths(spark.createDataFrame(rows, "path string, length long, modified double"),
                                       {"movies": "file:/tmp/lib/", "tv": "/tmp/lib/tv", "bucket": "s3a://box/films/"})
    assert {(r.category, r.relative_path, r.size_bytes) for r in found.collect()} == {
        ("movies", "sub/LongFilmName.mkv", 5), ("movies", "Empty.mkv", 0), ("movies", "_private.mkv", 4), ("tv", "100%.mkv", 1), ("bucket", "A.mkv", 1)}
    assert {r.path for r in other.collect()} == {"/tmp/library/No.mkv", "s3a://other/films/A.mkv", None}


def test_probe_payloads(spark):
    rows = [(1, '{"media":{"track":{"@type":"General","Format":"Matroska","Duration":"bad"}}}', None), (2, "{", None), (3, None, None), (4, None, "timeout"),
            (5, '{"media":{"track":[{"@type":"General","Format":" "},{"@type":"Audio","Channels":"6.9","Default":"YES"}]}}', None), (6, '{"media":{"track":[]}}', None)]
    got = {r.i: r for r in probe.decode(spark.createDataFrame(rows, "i int, payload string, e string"), "payload", "e").collect()}
    assert (got[1].container, got[1].duration_seconds, got[1].video_tracks) == ("Matroska", None, [])
    assert got[2].media_info_error and got[6].media_info_error and got[3].media_info_error is None and got[3].video_tracks is None
    assert got[4].media_info_error == "timeout" and got[4].video_tracks is None
    assert got[5].container is None and (got[5].audio_tracks[0].channels, got[5].audio_tracks[0].default) == (6, True)


# --- inventory ------------------------------------------------------------------------

LIST = [f.name for f in schemas.LISTED_FILE.fields]


def listed(spark, rows):
    """rows: (path, library, size, error, audio tracks or None)."""
    return spark.createDataFrame([
        (lib, p, p[1:], p[1:], ".mkv", "/", "movie_flat", size, 1.0, "Matroska" if tracks is not None else None, 60.0 if tracks is not None else None, None, error,
         [] if tracks is not None else None, [("AC3", "eng", 2, None, True)] * tracks if tracks is not None else None, [] if tracks is not None else None)
        for p, lib, size, error, tracks in rows], schemas.LISTED_FILE)


def step(spark, state, rows, scan, libraries=(1,), metadata=True):
    scanned = spark.createDataFrame([(x,) for x in libraries], "library_id long")
    r = inventory.reconcile_listing(state, listed(spark, rows), scan, ts(), scanned, metadata).cache()
    events = {e.absolute_path: (e.change_type, [d.field for d in e.details or []]) for e in inventory.change_events(r, scan).collect()}
    return spark.createDataFrame(inventory.next_state(r).collect(), schemas.FILE_STATE), events


def test_scan_lifecycle(spark):
    state = spark.createDataFrame([], schemas.FILE_STATE)
    rows = [("/a", 1, 10, None, 1), ("/b", 1, 10, None, 1), ("/c", 2, 10, None, 1)]
    state, events = step(spark, state, rows, 1, (1, 2))
    assert events == {p: ("ADDED", []) for p in ("/a", "/b", "/c")}
    ids = {r.absolute_path: r.media_file_id for r in state.collect()}
    state, events = step(spark, state, rows[::-1], 2, (1, 2))
    assert events == {}
    # A failed probe keeps the metadata; an unscanned library keeps its files.
    state, events = step(spark, state, [("/a", 1, 11, "boom", None)], 3, (1,))
    assert events == {"/a": ("UPDATED", ["size_bytes", "media_info_error"]), "/b": ("MISSING", [])}
    by = {r.absolute_path: r for r in state.collect()}
    assert by["/a"].container == "Matroska" and len(by["/a"].audio_tracks) == 1 and by["/c"].state == "ACTIVE"
    assert (by["/b"].state, by["/b"].missing_since_scan_id, by["/b"].last_seen_scan_id) == ("MISSING", 3, 2)
    # No probe at all leaves metadata and error alone; a return absorbs field changes.
    state, events = step(spark, state, [("/a", 1, 11, None, None), ("/b", 1, 12, None, 2)], 4, (1,))
    assert events == {"/b": ("RESTORED", ["size_bytes", "audio_tracks"])}
    by = {r.absolute_path: r for r in state.collect()}
    assert by["/a"].media_info_error == "boom" and by["/b"].missing_since_scan_id is None
    assert {p: r.media_file_id for p, r in by.items()} == ids and by["/b"].first_seen_scan_id == 1


def test_metadata_off_touches_no_metadata(spark):
    state, _ = step(spark, spark.createDataFrame([], schemas.FILE_STATE), [("/a", 1, 10, None, 1)], 1)
    state, events = step(spark, state, [("/a", 1, 10, None, 3)], 2, metadata=False)
    assert events == {} and len(state.first().audio_tracks) == 1


def test_relocation_keeps_the_file(spark):
    state, _ = step(spark, spark.createDataFrame([], schemas.FILE_STATE), [("/a", 1, 10, None, 1)], 1)
    file_id = state.first().media_file_id
    moves = spark.createDataFrame([(file_id, 2, "/z")], "media_file_id long, library_id long, absolute_path string")
    nxt, events = inventory.relocate(state, moves, 2, ts())
    row, event = nxt.first(), events.first()
    assert (row.media_file_id, row.absolute_path, row.first_seen_scan_id, row.last_seen_scan_id) == (file_id, "/z", 1, 2)
    assert (event.change_type, event.previous_absolute_path, [d.field for d in event.details]) == ("UPDATED", "/a", ["library_id", "absolute_path"])


def test_a_scan_counts_nested_roots_once(spark):
    libraries = spark.createDataFrame([(1, "movies", True), (2, "tv", True), (3, "gone", False)], "library_id long, category string, exists boolean")
    state = spark.createDataFrame([], schemas.FILE_STATE)
    done = inventory.scan(state, listed(spark, [("/a", 1, 10, None, 1), ("/a", 2, 11, None, 1), ("/b", 1, 5, None, 0), ("/c", 3, 5, None, 0)]), libraries, 1, ts())
    assert {(r.absolute_path, r.library_id) for r in inventory.next_state(done).collect()} == {("/a", 2), ("/b", 1)}
    run = inventory.run_row(done, 1, ts(), scope_category="movies").first()
    assert (run.file_count, run.total_size_bytes, run.added_count, run.updated_count, run.scan_scope) == (2, 16, 2, 0, "CATEGORY")
    assert inventory.duplicate_ids(done).count() == 0
    twice = done.select("absolute_path", F.struct(F.lit(7).alias("media_file_id")).alias("next"))
    assert inventory.duplicate_ids(twice).first().row_count == 2


# --- findings -------------------------------------------------------------------------

def records(spark, *changes):
    base = dict(media_file_id=1, library_id=1, category="movies", relative_path="a.mkv", extension=".mkv", layout="movie_flat", size_bytes=50 << 30, state="ACTIVE",
                media_info_error=None, media_info_probed_at=TS, video_track_count=1, audio_track_count=1, last_seen_scan_id=3, missing_since_scan_id=None)
    ddl = ("media_file_id long, library_id long, category string, relative_path string, extension string, layout string, size_bytes long, state string, media_info_error string, "
           "media_info_probed_at string, video_track_count long, audio_track_count long, last_seen_scan_id long, missing_since_scan_id long")
    return spark.createDataFrame([tuple({**base, "media_file_id": i, **c}.values()) for i, c in enumerate(changes)], ddl)


def test_rules_one_at_a_time(spark):
    cases = [{}, {"state": "MISSING", "size_bytes": 0, "layout": "unknown"}, {"media_info_error": "x", "video_track_count": 0}, {"media_info_probed_at": None}, {"layout": "unknown"},
             {"size_bytes": 0}, {"size_bytes": (10 << 20) - 1}, {"size_bytes": 10 << 20}, {"video_track_count": 0}, {"audio_track_count": 0}, {"extension": ".iso", "size_bytes": 5}]
    got = {}
    for r in findings.evaluate(records(spark, *cases)).collect():
        got.setdefault(r.media_file_id, []).append(r.rule_code)
    assert got == {1: ["missing_file"], 2: ["metadata_error"], 3: ["metadata_not_probed"], 4: ["unknown_layout"], 5: ["zero_byte_file"], 6: ["suspiciously_small_media"],
                   8: ["no_video_track"], 9: ["no_audio_track"], 10: ["unexpected_extension"]}
    assert [r.code for r in findings.rules()] == list(findings.RULE_CODES)


def test_findings_lifecycle(spark):
    found = findings.evaluate(records(spark, {"size_bytes": 0}, {"size_bytes": 5}))
    empty = spark.createDataFrame([], found.schema).withColumns({"status": F.lit(""), "first_detected_at": ts(), "last_detected_at": ts(), "resolved_at": ts(), "updated_at": ts()}).where("false")
    first = findings.reconcile_findings(empty, found, ts())
    assert {r.outcome for r in first.collect()} == {"CREATED"}
    stored = first.drop("outcome")
    assert {r.outcome for r in findings.reconcile_findings(stored, found, ts()).collect()} == {"UNCHANGED"}
    gone = findings.reconcile_findings(stored, found.where("media_file_id = 0"), ts("2024-01-02 00:00:00"))
    assert {(r.media_file_id, r.outcome, r.status) for r in gone.collect()} == {(0, "UNCHANGED", "ACTIVE"), (1, "RESOLVED", "RESOLVED")}
    back = {r.media_file_id: r for r in findings.reconcile_findings(gone.drop("outcome"), found, ts()).collect()}
    assert back[1].outcome == "REACTIVATED" and back[1].resolved_at is None
    ignored = stored.withColumn("status", F.lit("IGNORED"))
    assert {(r.outcome, r.status) for r in findings.reconcile_findings(ignored, found.where("false"), ts()).collect()} == {("LEFT", "IGNORED")}


# --- linkage --------------------------------------------------------------------------

def test_title_results_equal_brute_force(spark):
    rng = random.Random(7)
    movies = [(i, rng.choice(["Hot", "Hot", "Hot", "Cold", "Rare"]), rng.choice([None, None, "The Hot"]), rng.choice([None, *range(1990, 2000)]), rng.choice([None, *map(float, range(6))])) for i in range(600)]
    frame = spark.createDataFrame([(*m, None) for m in movies], "provider_id long, title string, original_title string, release_year int, popularity double, runtime_seconds long")
    queries = [("hot", 1995), ("hot", None), ("cold", 1990), ("rare", 2050), ("hot", 2001), ("rare", None)]
    got = {}
    for r in linkage.title_results(spark.createDataFrame([*queries, ("", 1990)], "block string, year int"), frame).orderBy("position").collect():
        got.setdefault((r.block, r.year), []).append(r.movie.provider_id)

    def score(year, release):
        if year is None:
            return 0.0
        return 0.5 if release is None else {0: 1.0, 1: 0.6}.get(abs(year - release), 0.0)

    for block, year in queries:
        hits = [m for m in movies if block in {m[1].lower(), (m[2] or "").lower().removeprefix("the ")}]
        hits.sort(key=lambda m: (-score(year, m[3]), -(m[4] or 0.0), m[0]))
        assert got[(block, year)] == [m[0] for m in hits]
    assert set(got) == set(queries)


def test_best_two_equal_all_matches(spark):
    rng = random.Random(5)
    movies = spark.createDataFrame([(i, rng.choice(["Hot", "Cold"]), None, rng.choice([None, 1999, 2000]), rng.choice([None, 1.0, 2.0]), rng.choice([None, 5000, 6000])) for i in range(80)],
                                   "provider_id long, title string, original_title string, release_year int, popularity double, runtime_seconds long")
    candidates = spark.createDataFrame([(i, "MOVIE", rng.choice(["hot", "Cold!", "???", None]), rng.choice([None, 1999, 2001]), rng.choice([None, 5000.0, 6100.0])) for i in range(60)],
                                       "media_file_id long, candidate_type string, parsed_title string, parsed_year int, local_seconds double")
    rows = linkage.movie_match_rows(candidates, movies)
    best = {r.media_file_id: (r.result_count, [m.provider_id for m in r.matches]) for r in linkage.match_movies(candidates, movies).collect()}
    every = {r.media_file_id: (r.result_count, [m.provider_id for m in r.matches]) for r in linkage.with_best(candidates, rows).collect()}
    assert best == every and len(best) == 60 and max(n for n, _ in best.values()) > 20


def test_no_given_hit_is_lost(spark):
    pairs = spark.createDataFrame([(1, "MOVIE", "Film", 1999, 5000.0, i, i, f"Film {i}", None, 1999, None, 5000) for i in range(30)],
                                  "media_file_id long, candidate_type string, parsed_title string, parsed_year int, local_seconds double, position int, provider_id long, title string, original_title string, release_year int, popularity double, runtime_seconds long")
    rows = linkage.match_movie_pairs(pairs).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 31))
    assert sum(r.match.runtime_score is not None for r in rows) == 3


def test_every_match_of_an_attempt_is_recorded(spark):
    movies = spark.createDataFrame([(i, "Hot", None, 2000 + i, float(i), 5000) for i in range(5)],
                                   "provider_id long, title string, original_title string, release_year int, popularity double, runtime_seconds long")
    series = spark.createDataFrame([(i, "Show") for i in range(4)], "provider_id long, title string")
    episodes = spark.createDataFrame([(i, 1, 2, 70 + i, None, 3000) for i in range(4)], "series_provider_id long, season_number int, episode_number int, provider_id long, episode_title string, runtime_seconds long")
    candidates = spark.createDataFrame(
        [(1, "MOVIE", "hot", 2000, None, None, None, None, 5000.0), (2, "EPISODE", None, None, "show", 1, 2, None, None), (3, "MOVIE", "cold", 2000, None, None, None, None, None),
         (4, "MOVIE", "hot", 2000, None, None, None, None, None), (5, "UNKNOWN", "hot", 2000, None, None, None, None, None)],
        "media_file_id long, candidate_type string, parsed_title string, parsed_year int, parsed_series_title string, season_number int, episode_number int, episode_title string, local_seconds double")
    asked = (candidates, movies, series, episodes, spark.createDataFrame([(4, "timeout")], "media_file_id long, error_message string"))
    attempts, matches = linkage.recorded(linkage.evaluate(*asked), linkage.evaluated_matches(*asked), ts())
    found, rows = {r.media_file_id: r for r in attempts.collect()}, matches.collect()
    assert sorted((r.media_file_id, r["rank"]) for r in rows) == [(1, k) for k in range(1, 6)] + [(2, k) for k in range(1, 5)]
    assert {i: r.result_count for i, r in found.items()} == {1: 5, 2: 4, 3: 0, 4: 0, 5: 0}
    assert [(r.media_file_id, r.match_id, r.provider_id) for r in rows if r.selected] == [(1, found[1].selected_match_id, 0)]
    third = next(r for r in rows if (r.media_file_id, r["rank"]) == (2, 3))
    log = _log(spark, [(third.attempt_id, "SELECT", third.match_id, "2024-01-02")], "attempt_id long, action string, match_id long")
    done, rejects = identity.review_attempts(attempts, log, matches)
    assert rejects.count() == 0 and {r.selected_match_id for r in done.where("media_file_id = 2").collect()} == {third.match_id}


@pytest.mark.parametrize("top, second, year, want", [
    (0.9, 0.8, 1999, "RESOLVED"), (0.9, 0.8001, 1999, "REVIEW_REQUIRED"), (0.8999, None, 1999, "REVIEW_REQUIRED"), (0.9, None, None, "REVIEW_REQUIRED"),
    (0.6, None, 1999, "REVIEW_REQUIRED"), (0.5999, None, 1999, "NO_MATCH"), (None, None, 1999, "NO_MATCH")])
def test_movie_thresholds(spark, top, second, year, want):
    matches = [(s, 1.0) for s in (top, second) if s is not None]
    df = spark.createDataFrame([(1, year, "MOVIE", matches)], "media_file_id long, parsed_year int, candidate_type string, matches array<struct<total_score:double,type_score:double>>")
    assert linkage.decide(df, "MOVIE").first().status == want


def test_specials_never_resolve(spark):
    df = spark.createDataFrame([(1, k, [(1.0, 1.0, 1.0, 1.0)]) for k in ("EPISODE", "SPECIAL")],
                               "media_file_id long, candidate_type string, matches array<struct<total_score:double,type_score:double,season_score:double,episode_score:double>>")
    assert [r.status for r in linkage.decide(df, "EPISODE").collect()] == ["RESOLVED", "REVIEW_REQUIRED"]


# --- decision logs --------------------------------------------------------------------

def _log(spark, rows, ddl):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{ddl}, decided_at string, decision_id int").withColumn("decided_at", F.col("decided_at").cast("timestamp"))


def test_first_approval_counts(spark):
    plans = spark.createDataFrame([(1, "READY_FOR_REVIEW", None, None, None), (2, "BLOCKED", None, None, None)],
                                  "plan_id long, status string, approved_at timestamp, approved_by string, updated_at timestamp")
    log = _log(spark, [(1, "second", "2024-01-02"), (1, "first", "2024-01-01"), (2, "x", "2024-01-01"), (9, "x", "2024-01-01"), (None, "x", "2024-01-01"), (1, "x", None)], "plan_id long, decided_by string")
    done, rejects = ingest.approve(plans, log, ts())
    assert {r.plan_id: (r.status, r.approved_by) for r in done.collect()} == {1: ("APPROVED", "first"), 2: ("BLOCKED", None)}
    assert {r.decision_id: r.reject_reason for r in rejects.collect()} == {
        0: "plan is APPROVED, not READY_FOR_REVIEW", 2: "plan is BLOCKED, not READY_FOR_REVIEW", 3: "no such plan", 4: "no key or time", 5: "no key or time"}


def test_an_invalid_review_takes_nothing_back(spark):
    attempts = spark.createDataFrame([(1, "REVIEW_REQUIRED", None), (2, "REVIEW_REQUIRED", None)], "attempt_id long, status string, selected_match_id long")
    matches = spark.createDataFrame([(1, 10), (2, 20)], "attempt_id long, match_id long")
    log = _log(spark, [(1, "SELECT", 10, "2024-01-01"), (1, "OTHER", None, "2024-01-02"), (2, "SELECT", 999, "2024-01-01"), (2, "SELECT", 10, "2024-01-02")], "attempt_id long, action string, match_id long")
    done, rejects = identity.review_attempts(attempts, log, matches)
    assert {r.attempt_id: (r.status, r.selected_match_id) for r in done.collect()} == {1: ("RESOLVED", 10), 2: ("REVIEW_REQUIRED", None)}
    assert {r.decision_id: r.reject_reason for r in rejects.collect()} == {
        1: "unknown action", 2: "the match is not one of the attempt", 3: "the match is not one of the attempt"}


def test_override_entries_without_place_are_rejects(spark):
    log = spark.createDataFrame([(None, 1, "2024-01-01"), (5, 2, None), (5, 3, "2024-01-01")], "media_file_id long, entry_id long, t string").select(
        "media_file_id", "entry_id", F.col("t").cast("timestamp").alias("entry_at"), F.lit("CREATE").alias("action"), F.lit("MOVIE").alias("candidate_type"), F.lit("T").alias("title"),
        F.lit(1).alias("year"), F.lit(None).cast("string").alias("series_title"), F.lit(None).cast("int").alias("season_number"), F.lit(None).cast("array<int>").alias("episode_numbers"), F.lit(None).cast("string").alias("episode_title"))
    history, rejects = identity.override_history(log)
    assert [r.override_id for r in history.collect()] == [3] and {r.entry_id for r in rejects.collect()} == {1, 2}


def test_report_files(spark, tmp_path):
    files = spark.createDataFrame([("movies", "a", 5), ("movies", "b", None), ("tv", "c", 7)], "category string, relative_path string, size_bytes long")
    readback.write_report(files, str(tmp_path / "r"))
    assert {(r.category, r.relative_path) for r in spark.read.json(str(tmp_path / "r/files")).collect()} == {("movies", "a"), ("movies", "b"), ("tv", "c")}
    assert {(r.category, r.file_count, r.total_size_bytes) for r in spark.read.json(str(tmp_path / "r/totals")).collect()} == {("movies", 2, 5), ("tv", 1, 7)}


# --- histories, plans, events ---------------------------------------------------------

def test_next_time_equals_a_plain_sort(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2]), i, f"2024-01-{rng.randint(1, 4):02d} {rng.randint(0, 3):02d}:00:00") for i in range(80)]
    df = spark.createDataFrame(rows, "k int, i int, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.i: r.n for r in reconcile.next_time(df, "k", "t", "i", "n").collect()}
    times = {r.i: (r.k, r.t) for r in df.collect()}
    for k in (1, 2):
        order = sorted((t, i) for i, (key, t) in times.items() if key == k)
        for (_, i), following in zip(order, [*order[1:], None]):
            assert got[i] == (following[0] if following else None)


def test_competitors_equal_brute_force(spark):
    rng = random.Random(5)
    plans = [(i, rng.randint(1, 12), rng.choice(["APPROVED", "EXECUTED", "SUPERSEDED", "BLOCKED"]), rng.choice(["/d", "/d", "/e", None]), "f") for i in range(60)]
    df = spark.createDataFrame(plans, "plan_id long, media_file_id long, status string, destination_directory string, destination_filename string")
    for r in ingest.with_competitor(df, df).collect():
        rivals = [p[0] for p in plans if r.destination_directory and p[3] == r.destination_directory and p[1] != r.media_file_id and p[2] not in ("EXECUTED", "SUPERSEDED")]
        assert r.competing_plan_id == (min(rivals) if rivals else None)


def test_event_fold_equals_a_loop(spark):
    rng = random.Random(11)
    plans = [(i, rng.choice(["APPROVED", "APPROVED", "BLOCKED"])) for i in range(12)]
    events = [(rng.randint(0, 13), s, rng.choice(["START", "SUCCEED", "FAIL"]), "CROSS_FILESYSTEM_COPY_VERIFY_REMOVE", rng.choice(["CREATE_DESTINATION_DIRECTORY", "REMOVE_SOURCE", "ODD"])) for s in range(60)]
    status, illegal = dict(plans), set()
    for plan, seq, event, _, at in events:
        now = status.get(plan)
        if event == "START" and now == "APPROVED":
            status[plan] = "EXECUTING"
        elif event == "SUCCEED" and now == "EXECUTING":
            status[plan] = "EXECUTED"
        elif event == "FAIL" and now == "EXECUTING":
            status[plan] = "EXECUTION_FAILED" if at == "CREATE_DESTINATION_DIRECTORY" else "RECOVERY_REQUIRED"
        else:
            illegal.add(seq)
    current, rejects = execution.fold_events(
        spark.createDataFrame(plans, "plan_id long, status string"), spark.createDataFrame(events, "plan_id long, seq long, event string, strategy string, step string"))
    assert {r.plan_id: r.status for r in current.collect()} == status
    assert {r.seq for r in rejects.collect()} == illegal


def test_assignment_history(spark):
    ddl = "id long, media_file_id long, identity_id long, assignment_method string, confidence string, status string, created_at timestamp, updated_at timestamp"
    stored = spark.createDataFrame([], ddl)
    new = lambda identity_id: spark.createDataFrame([(1, identity_id, "AUTO", "HIGH")], "media_file_id long, identity_id long, assignment_method string, confidence string")
    one = identity.assign(stored, new(5), ts())
    again = identity.assign(one.drop("outcome"), new(5), ts("2024-01-02 00:00:00"))
    assert [r.outcome for r in again.collect()] == ["KEPT"]
    moved = identity.assign(again.drop("outcome"), new(6), ts("2024-01-03 00:00:00"))
    assert {(r.identity_id, r.status, r.outcome) for r in moved.collect()} == {(5, "SUPERSEDED", "CLOSED"), (6, "ACTIVE", "OPENED")}
    assert moved.select("id").distinct().count() == 2


def test_destinations(spark):
    movies = spark.createDataFrame([("Film: A/B", 1999, ".MKV", "Final Cut"), ("", 1999, ".mkv", None), ("F", 0, ".mkv", None), ("F", 1999, ".iso", None)], "title string, release_year int, extension string, edition string")
    got = ingest.movie_destination(movies.withColumn("destination_root", F.lit("/nas/m")), edition="edition").collect()
    assert got[0].full_path == "/nas/m/Film: A-B (1999)/Film: A-B (1999) - Final Cut.mkv" and [r.destination_error is None for r in got] == [True, False, False, False]
    show = spark.createDataFrame([("Show", 0, [1], "", ".mkv"), ("Show", 1, [2, 3], "Pilot?", "mkv"), ("Show", 1, [], None, ".mkv")], "title string, season_number int, episode_numbers array<int>, episode_title string, extension string")
    got = ingest.episode_destination(show.withColumn("destination_root", F.lit("/nas/t"))).collect()
    assert [r.full_path for r in got] == ["/nas/t/Show/Season 00/Show - S00E01.mkv", "/nas/t/Show/Season 01/Show - S01E02-E03 - Pilot?.mkv", None]


def test_verification_precedence(spark):
    cases = [{}, {"media_info_probed_at": None}, {"audio_track_count": 0}, {"video_track_count": 0, "audio_track_count": 0}, {"media_info_error": ""}, {"media_info_error": "x"}, {"state": "MISSING"}]
    df = records(spark, *cases).withColumns({"duration_seconds": F.lit(60.0), "container": F.lit("Matroska"), "blocking_finding_count": F.lit(0)})
    got = [r.verification_status for r in checks.verify_media(df).orderBy("media_file_id").collect()]
    assert got == ["PASS", "NOT_PROBED", "WARNING", "FAIL", "PASS", "FAIL", "FAIL"]


def test_readiness_groups_cover_all_checks_but_one():
    grouped = [code for codes in checks.READINESS_GROUPS.values() for code in codes]
    assert len(grouped) == len(set(grouped)) == 24 and "plan_exists" not in grouped


def test_constraint_rows(spark):
    df = spark.createDataFrame([(1, "ACTIVE", 5), (2, "GONE", 5), (3, None, -1), (3, "ACTIVE", None)], "id long, state string, size long")
    got = {(r.row_key, r.rule) for r in checks.violations(df, "id", {"state": schemas.FILE_STATES}, {"size": (0, None)}, ["size"]).collect()}
    assert got == {("2", "state in vocabulary"), ("3", "size in range"), ("3", "size required")}
    assert [r.row_key for r in checks.repeated(df, ["id"], "unique").collect()] == ["3"]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_shuffle_counts(spark, tmp_path):
    """Rules and parsers move no rows; a reconcile moves each side once."""
    state, _ = step(spark, spark.createDataFrame([], schemas.FILE_STATE), [("/a", 1, 10, None, 1)], 1)
    state.write.parquet(f"{tmp_path}/state")
    stored = spark.read.parquet(f"{tmp_path}/state")
    libraries = spark.createDataFrame([(1,)], "library_id long")
    r = inventory.reconcile_listing(stored, stored.select(*LIST), 2, ts(), libraries)
    assert shuffles(r.select("absolute_path", "change_type")) == 2
    files = stored.withColumns({"category": F.lit("movies"), "video_track_count": F.lit(1), "audio_track_count": F.lit(1)})
    assert shuffles(naming.parse(files)) == shuffles(findings.evaluate(files)) == 0


def test_clashing_ids_are_settled(spark):
    """Stored files keep theirs, the first new file by path too; the third try is needed for one of them."""
    rows = [("/a", None, 5), ("/b", "ADDED", 5), ("/c", "ADDED", 7), ("/d", "ADDED", 7), ("/e", "ADDED", 7), ("/f", "MISSING", 9)]
    df = spark.createDataFrame([(p, (i, p), t) for p, t, i in rows], "absolute_path string, next struct<media_file_id: bigint, path: string>, change_type string")
    tries = {1: {"/b": 9, "/d": 11, "/e": 11}, 2: {"/b": 12, "/e": 11}, 3: {"/e": 13}}
    made = lambda turn: F.try_element_at(F.create_map(*[F.lit(x) for kv in tries[turn].items() for x in kv]), F.col("absolute_path")).cast("long")
    got = {r.absolute_path: (r.next.media_file_id, r.next.path, r.change_type) for r in inventory.settled_ids(df, 3, made=made).collect()}
    assert got == {"/a": (5, "/a", None), "/b": (12, "/b", "ADDED"), "/c": (7, "/c", "ADDED"), "/d": (11, "/d", "ADDED"), "/e": (13, "/e", "ADDED"), "/f": (9, "/f", "MISSING")}
    calm = df.where("absolute_path IN ('/a', '/c')")
    assert inventory.settled_ids(calm, 3) is calm
    assert inventory.duplicate_ids(inventory.settled_ids(df, 3)).count() == 0


def test_only_new_files_are_joined_to_settle_ids(spark):
    """Stored files pass through; of two new ones on a stored file's id both move, of two on a free id the second."""
    rows = [("a", 1, None), ("b", 1, "ADDED"), ("c", 1, "ADDED"), ("d", 2, "ADDED"), ("e", 2, "ADDED"), ("f", 3, "UPDATED"), ("g", 1, "MISSING")]
    df = spark.createDataFrame([(p, (i, p), t) for p, i, t in rows], "absolute_path string, next struct<media_file_id:long,path:string>, change_type string")
    settled = inventory.settled_ids(df, 3)
    plan = settled._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "Join" not in plan.children().head().toString()
    got = {r.absolute_path: r.next.media_file_id for r in settled.collect()}
    assert len(got) == 7 and {p for p, i, _ in rows if got[p] != i} == {"b", "c", "e"}
    assert len({got[p] for p in "abcdef"}) == 6


def test_a_title_search_sends_no_movies_to_the_driver(spark):
    movies = spark.createDataFrame([(1, "red sea", None, 1990, 1.0, 60)], "provider_id long, title string, original_title string, release_year int, popularity double, runtime_seconds long")
    found = search.title_search(spark.createDataFrame([("red sea", 1990)], "block string, year int"), movies)
    # One of the two joins is read twice, as ratios are worked out beside the rows.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 3
    assert found.count() == 1
