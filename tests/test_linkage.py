"""Finders, matches kept by query, and the way from a match to an assignment."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import identity, linkage, search
from shelfmark.sources.store import written

MOVIES = "provider_id long, title string, original_title string, release_year int, popularity double, runtime_seconds long"
CANDIDATES = "media_file_id long, candidate_type string, parsed_title string, parsed_year int, local_seconds double"


def ts(text="2024-01-01 00:00:00"):
    return F.lit(text).cast("timestamp")


def catalog(spark, rng, n=120):
    words = ["red", "stone", "river", "night", "house", "a", "of"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    rows = [(i, rng.choice([title(), "Hot", "The Hot", "Hot!"]), rng.choice([None, title(), "Hot"]), rng.choice([None, 1998, 1999, 2000, 2001]),
             rng.choice([None, 1.0, 2.0]), rng.choice([None, 0, 5000, 5400, 7000])) for i in range(n)]
    return rows, spark.createDataFrame(rows, MOVIES)


def asked(spark, rng, n=60):
    rows = [(i, "MOVIE", rng.choice(["hot", "red stone", "Night House", "???", None, "river of stone"]), rng.choice([None, 1999, 2001]),
             rng.choice([None, 5000.0, 5900.0])) for i in range(n)]
    return spark.createDataFrame(rows, CANDIDATES)


FINDERS = {"exact": search.exact_titles, "near": search.near_titles, "words": search.title_search}


@pytest.mark.parametrize("name, detail", [("exact", 1), ("words", 3), ("near", 3)])
def test_shared_results_and_compared_ones_make_all_matches(spark, name, detail):
    """Against every candidate meeting every result of its query, ranked in one window each."""
    rng = random.Random(len(name) + detail)
    _, movies = catalog(spark, rng)
    candidates, find = asked(spark, rng), FINDERS[name]
    keyed = linkage._queried(candidates)
    results = linkage.title_results(keyed.select("block", "year"), movies, find).withColumnsRenamed({"block": "b", "year": "y"})
    pairs = keyed.join(results, (F.col("block") == F.col("b")) & F.col("year").eqNullSafe(F.col("y")))
    runtime = F.when(F.col("position") < detail, F.col("local_seconds"))
    every = linkage._ranked(pairs.withColumn("match", linkage.movie_score(linkage._local(), F.col("movie"), F.col("title_score"), runtime)))
    want = {(r.media_file_id, r["rank"]): r.match for r in every.collect()}
    got = {(r.media_file_id, r["rank"]): r.match for r in linkage.movie_match_rows(candidates, movies, detail, find).collect()}
    assert got == want and max(k for _, k in want) > 4
    members = linkage.movie_members(candidates, movies, detail, find)
    for r in members.collect():
        mine = [want[k] for k in sorted(want) if k[0] == r.media_file_id]
        assert r.result_count == len(mine) and list(r.matches) == mine[:2]
    shared = linkage.query_results(candidates, movies, detail, find)
    one = members.withColumn("rank", (F.col("media_file_id") % 7 + 1).cast("int"))
    there = {(r.media_file_id, r["rank"]): r.match for r in linkage.at_rank(one, shared, detail).collect()}
    assert there == {k: m for k, m in want.items() if k[1] == k[0] % 7 + 1}


def test_titles_a_letter_apart_are_near(spark):
    movies = spark.createDataFrame([
        (1, "Blue Rivers", None, 1999, None, None), (2, "Blue River", None, 2003, None, None), (3, "Red River", None, 2000, None, None),
        (4, "Blue Rivers", "Blue Rivern", 2001, None, None), (5, "Blue River", "Blue Rivers", 2000, None, None), (6, "Blues", None, 2000, None, None),
        (7, "Blue Rivers", None, None, None, None)], MOVIES)
    queries = spark.createDataFrame([("blue river", 2000), ("blue river", None), ("", 2000)], "block string, year int")
    near = {(r.year, r.movie.provider_id): r.title_score for r in search.near_only(queries, movies).collect()}
    assert set(near) == {(2000, 1), (2000, 4)} and all(x > 0.9 for x in near.values())
    both = sorted((r.year is None, r.movie.provider_id, r.title_score == 1) for r in search.near_titles(queries, movies).collect())
    assert both == [(False, 1, False), (False, 2, True), (False, 4, False), (False, 5, True), (True, 2, True), (True, 5, True)]
    found = linkage.match_movies(spark.createDataFrame([(1, "MOVIE", "Blue River", 2000, None)], CANDIDATES), movies, find=search.near_titles).first()
    assert found.result_count == 4 and found.matches[0].provider_id == 5


@pytest.mark.parametrize("percent, hot", [(1, 3), (34, 20_000), (50, 3), (67, 3), (100, 20_000)])
def test_word_pairs_equal_brute_force(spark, monkeypatch, percent, hot):
    monkeypatch.setattr(search, "HOT_ROWS", hot)
    rng = random.Random(percent)
    words = ["the", "the", "the", "of", "of", *[f"w{i}" for i in range(25)]]
    titles = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(150)})
    held = spark.createDataFrame([(t,) for t in titles], "title string")
    queries = sorted({*titles[::3], "the the", "nothing here", "of"})
    got = {(r.block, r.title): (r.shared, r.words_in_all) for r in search.word_pairs(
        spark.createDataFrame([(q,) for q in queries], "block string"), held, percent).collect()}
    want = {}
    for q in queries:
        for t in titles:
            a, b = set(q.split()), set(t.split())
            if a & b and 100 * len(a & b) >= percent * len(a | b):
                want[q, t] = len(a & b), len(a | b)
    assert got == want and want


def test_search_pages(spark):
    movies = spark.createDataFrame([
        (1, "The Long Night", None, 1999, 5.0, None), (2, "Long Night", None, 2005, 9.0, None), (3, "Night", "Long Night", None, 1.0, None),
        (4, "Long Long Night Out West", None, 1999, None, None), (5, "???", None, 1999, None, None), (6, None, None, None, None, None)], MOVIES)
    requests = spark.createDataFrame([("Long night", 1999), ("Long night", 1999), ("LONG NIGHT!", None), ("", 1999), (None, None), ("absent", 1)], "title string, year int")
    pages = {}
    for r in search.search_movies(requests, movies).orderBy("position").collect():
        pages.setdefault((r.title, r.year), []).append((r.position, r.provider_id, r.found_title))
    assert {k: [x[1] for x in v] for k, v in pages.items()} == {("Long night", 1999): [1, 3, 2, 4], ("LONG NIGHT!", None): [2, 1, 3, 4]}
    assert [x[0] for x in pages["Long night", 1999]] == [0, 1, 2, 3] and pages["Long night", 1999][1][2] == "Night"
    series = movies.select("provider_id", "title", "popularity")
    shows = search.search_series(requests.select("title"), series).orderBy("title", "position").collect()
    assert [(r.title, r.series_provider_id) for r in shows] == [(t, i) for t in ("LONG NIGHT!", "Long night") for i in (2, 1, 3, 4)]
    assert search.search_movies(requests.where("false"), movies).count() == 0 == search.search_movies(requests, movies.where("false")).count()


def run_of(spark, when):
    movies = spark.createDataFrame([(i, "Hot", None, 2000 + 5 * i, float(i), 5000) for i in range(5)] + [(9, "Solo", None, 1990, None, None)], MOVIES)
    series = spark.createDataFrame([(i, "Show") for i in range(2)] + [(7, "Lone")], "provider_id long, title string")
    episodes = spark.createDataFrame([(0, 1, 2, 70, None, 3000), (1, 1, 2, 71, None, 3000), (7, 3, 4, 77, "End", 100)],
                                     "series_provider_id long, season_number int, episode_number int, provider_id long, episode_title string, runtime_seconds long")
    candidates = spark.createDataFrame(
        [(1, 10, "MOVIE", "hot", 2000, None, None, None, None, 5000.0), (2, 20, "EPISODE", None, None, "show", 1, 2, None, None), (3, 30, "EPISODE", None, None, "lone", 3, 4, "End", 100.0),
         (4, 40, "MOVIE", "solo", 1990, None, None, None, None, None), (5, 50, "UNKNOWN", "hot", 2000, None, None, None, None, None), (6, 60, "MOVIE", "solo", 1990, None, None, None, None, None)],
        "media_file_id long, candidate_id long, candidate_type string, parsed_title string, parsed_year int, parsed_series_title string, season_number int, episode_number int, episode_title string, local_seconds double")
    attempts = linkage.evaluate(candidates, movies, series, episodes)
    attempts, listed = linkage.recorded(attempts, linkage.listed_matches(candidates, series, episodes), when)
    return written(attempts), written(listed), written(linkage.shared_matches(candidates, movies))


IDENTITIES = ("identity_id long, media_type string, provider_id long, title string, original_title string, release_year int, release_date string, series_provider_id long, "
              "season_number int, episode_number int, episode_title string, runtime_seconds long, original_language string, updated_at timestamp")
ASSIGNMENTS = ("id long, media_file_id long, candidate_id long, identity_id long, attempt_id long, assignment_method string, confidence string, status string, "
               "created_at timestamp, updated_at timestamp")


def test_matches_become_identities_and_assignments(spark):
    attempts, listed, shared = run_of(spark, ts())
    chosen = identity.chosen_by_run(attempts, linkage.selected_matches(attempts))
    nobody, nothing = spark.createDataFrame([], IDENTITIES), spark.createDataFrame([], ASSIGNMENTS)
    identities, assignments = map(written, identity.resolve(chosen, nobody, nothing, ts()))
    known = {r.identity_id: r for r in identities.collect()}
    assert sorted((r.media_type, r.provider_id, r.title, r.episode_title, r.outcome) for r in known.values()) == [
        ("EPISODE", 77, "Lone", "End", "CREATED"), ("MOVIE", 0, "Hot", None, "CREATED"), ("MOVIE", 9, "Solo", None, "CREATED")]
    held = assignments.collect()
    assert sorted((r.media_file_id, r.candidate_id, known[r.identity_id].provider_id, r.assignment_method, r.confidence, r.outcome) for r in held) == [
        (1, 10, 0, "AUTO", "HIGH", "OPENED"), (3, 30, 77, "AUTO", "HIGH", "OPENED"), (4, 40, 9, "AUTO", "HIGH", "OPENED"), (6, 60, 9, "AUTO", "HIGH", "OPENED")]
    # The same run again finds nothing to do.
    again = identity.resolve(chosen, identities.drop("outcome"), assignments.drop("outcome"), ts("2024-02-02 00:00:00"))
    assert [{r.outcome for r in df.collect()} for df in again] == [{"UNCHANGED"}, {"KEPT"}]
    # A reviewer selects the second match of the show, which the run left open, and the fifth of a resolved film.
    shown = written(linkage.attempt_matches(attempts, listed, shared))
    by_rank = {(r.media_file_id, r["rank"]): r for r in shown.collect()}
    assert sorted(by_rank) == [(1, k) for k in range(1, 6)] + [(2, 1), (2, 2), (3, 1), (4, 1), (6, 1)]
    assert sorted(k for k, r in by_rank.items() if r.selected) == [(1, 1), (3, 1), (4, 1), (6, 1)]
    log = spark.createDataFrame([(by_rank[k].attempt_id, "SELECT", by_rank[k].match_id, d, t) for k, d, t in (
        ((2, 1), 1, "2024-01-02"), ((2, 2), 2, "2024-01-03"), ((1, 5), 3, "2024-01-03"))] + [(by_rank[4, 1].attempt_id, "REJECT", None, 4, "2024-01-03")],
        "attempt_id long, action string, match_id long, decision_id long, decided_at string").withColumn("decided_at", F.col("decided_at").cast("timestamp"))
    reviewed, rejects = identity.review_attempts(attempts, log, shown)
    assert rejects.count() == 0
    picked = identity.chosen_by_review(reviewed, identity.review_matches(shown, reviewed), log)
    identities, assignments = map(written, identity.resolve(picked, identities.drop("outcome"), assignments.drop("outcome"), ts("2024-01-04 00:00:00")))
    known = {r.identity_id: r.provider_id for r in identities.collect()}
    rows = sorted((r.media_file_id, known[r.identity_id], r.assignment_method, r.status, r.outcome) for r in assignments.collect())
    assert rows == [(1, 0, "AUTO", "SUPERSEDED", "CLOSED"), (1, 1, "MANUAL", "ACTIVE", "OPENED"), (2, 71, "MANUAL", "ACTIVE", "OPENED"),
                    (3, 77, "AUTO", "ACTIVE", "KEPT"), (4, 9, "AUTO", "ACTIVE", "KEPT"), (6, 9, "AUTO", "ACTIVE", "KEPT")]
    again = identity.resolve(picked, identities.drop("outcome"), assignments.drop("outcome"), ts("2024-01-05 00:00:00"))
    assert {r.outcome for r in again[1].collect()} == {"KEPT"} and {r.outcome for r in again[0].collect()} <= {"UNCHANGED", "LEFT"}


def test_an_evaluation_that_keeps_its_tables_holds_no_plan_of_all_steps(spark):
    """A driver keeps the text of a plan with every stage of it that ends."""
    rng = random.Random(8)
    _, movies = catalog(spark, rng, 40)
    films = asked(spark, rng, 20).withColumn("episode_title", F.lit(None).cast("string"))
    show = {"candidate_type": F.lit("EPISODE"), "media_file_id": F.col("media_file_id") + 100, "parsed_series_title": F.lit("hot"),
            "season_number": F.lit(1), "episode_number": (F.col("media_file_id") % 3).cast("int")}
    none = {"parsed_series_title": F.lit(None).cast("string"), "season_number": F.lit(None).cast("int"), "episode_number": F.lit(None).cast("int")}
    candidates = films.withColumns(none).unionByName(films.withColumns(show))
    series = movies.select("provider_id", "title")
    episodes = movies.select(F.col("provider_id").alias("series_provider_id"), F.lit(1).alias("season_number"), (F.col("provider_id") % 3).cast("int").alias("episode_number"),
                             (F.col("provider_id") + 500).alias("provider_id"), F.lit("x").alias("episode_title"), "runtime_seconds")
    errors = candidates.where("media_file_id % 7 = 0").select("media_file_id", F.lit("timeout").alias("error_message"))
    whole = linkage.evaluate(candidates, movies, series, episodes, errors)
    kept = []

    def keep(df):
        kept.append(df)
        return written(df)

    steps = linkage.evaluate(candidates, movies, series, episodes, errors, keep=keep)
    rows = lambda df: {r.media_file_id: r.asDict(True) for r in df.collect()}
    assert rows(steps) == rows(whole) and {r["status"] for r in rows(steps).values()} >= {"FAILED", "REVIEW_REQUIRED"}
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert max(size(df) for df in (*kept, steps)) < size(whole) / 3


def test_a_run_evaluates_its_candidates_in_steps(monkeypatch):
    from workload import q_linkage

    asked_for = {}
    monkeypatch.setattr(q_linkage, "written", lambda df: df)
    monkeypatch.setattr(q_linkage.linkage, "recorded_attempts", lambda attempts, _: attempts)
    monkeypatch.setattr(q_linkage, "run_ts", lambda: None)
    monkeypatch.setattr(q_linkage, "_errors", lambda candidates: "errors")
    monkeypatch.setattr(q_linkage.linkage, "evaluate", lambda *tables, **more: asked_for.update(more, tables=tables))
    q_linkage.attempted(type("Tables", (), {"candidates": "c", "movies": "m", "series": "s", "episodes": "e"}))
    assert asked_for["tables"] == ("c", "m", "s", "e", "errors") and asked_for["keep"] is q_linkage.written


def test_attempts_on_hits_are_evaluated_in_steps(spark, monkeypatch):
    from workload import q_linkage
    from workload.inputs import Catalog
    from workload.registry import QUERIES

    kept = []

    def keep(df):
        kept.append(df)
        return written(df)

    monkeypatch.setattr(q_linkage, "written", keep)
    c = Catalog(spark, "/root/testdata/sf0.001")
    given = c.hits.select("media_file_id", "position", "provider_id", "title", "original_title", "release_year", "popularity", "runtime_seconds")
    whole = linkage.evaluate(c.candidates, c.movies, c.series, c.episodes, movie_hits=given, series_hits=q_linkage._series_hits(c))
    steps = QUERIES["g10_attempts_on_hits"](spark, "/root/testdata/sf0.001")
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    sizes = [size(df) for df in (*kept, steps)]
    assert len(kept) == 5 and max(sizes) < size(whole) * 0.6, (sizes, size(whole))
