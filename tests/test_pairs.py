"""Results with a row per pair: ranked where the two sides meet."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.operators import episode_tops, linkage, search

SHOWS = ("media_file_id long, candidate_type string, parsed_series_title string, season_number int, episode_number int, "
         "episode_title string, local_seconds double")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("hot", [50, 4_000_000])
def test_episodes_of_a_key_are_ranked_where_they_meet(spark, monkeypatch, hot):
    monkeypatch.setattr(episode_tops, "HOT_PAIRS", hot)
    rng = random.Random(hot)
    titles = [None, "", "???", "Pilot", "The Pilot", "Pilots", "The very end"]
    series = spark.createDataFrame([(i, rng.choice(["Show", "The Show", "show!", "Other"])) for i in range(30)], "provider_id long, title string")
    runtimes = [None, 0, -5, 95, 100, 105, 106, 115, 116, 118, 85, 1000, 1050, 1053]
    episodes = spark.createDataFrame(
        [(rng.randrange(30), rng.choice([1, 2]), rng.choice([1, 2]), i, rng.choice(titles), rng.choice(runtimes)) for i in range(300)],
        "series_provider_id long, season_number int, episode_number int, provider_id long, episode_title string, runtime_seconds long")
    shows = spark.createDataFrame(
        [(i, rng.choice(["EPISODE", "SPECIAL", "MOVIE", None]), rng.choice(["show", "Other", "none", "!", None]), rng.choice([1, 2, None]),
          rng.choice([1, 2, 3, None]), rng.choice(titles), rng.choice([None, 0.0, -3.0, 100.0, 99.75, 1000.0])) for i in range(120)], SHOWS)
    met = linkage._show_keys(shows).join(linkage.episode_index(series, episodes), linkage.KEY).withColumn("similarity", F.lit(1.0))
    want = {(r.media_file_id, r["rank"]): r.match for r in linkage._episode_rows(met).collect()}
    rows = linkage.match_episodes(shows, series, episodes)
    got = rows.collect()
    assert {(r.media_file_id, r["rank"]): r.match for r in got} == want and len(got) == len(want) > 300
    narrow = linkage.episode_ranks(shows, series, episodes)
    fields = ["series_provider_id", "provider_id", "season_number", "episode_number", "episode_title_score", "runtime_score", "total_score"]
    assert {(r.media_file_id, r["rank"]): tuple(r[f] for f in fields) for r in narrow.collect()} == {k: tuple(m[f] for f in fields) for k, m in want.items()}
    for df in (rows, narrow):
        above = _plan(df).split("FlatMapCoGroups")
        assert len(above) == 2 and not any(step in above[0] for step in ("Window", "Join", "Sort", "Repartition"))


@pytest.mark.parametrize("pairs", [40, 1_000_000])
def test_results_of_a_title_are_dealt_and_every_match_keeps_its_rank(spark, monkeypatch, pairs):
    monkeypatch.setattr(search, "PART_PAIRS", pairs)
    monkeypatch.setattr(search, "YEARS_TOGETHER", 2)
    monkeypatch.setattr(linkage, "SEGMENT", 5)
    rng = random.Random(pairs)
    movies = spark.createDataFrame(
        [(i, rng.choice(["Hot", "The Hot", "Cold", "???"]), rng.choice([None, "hot!", "Warm"]), rng.choice([None, 1997, 1998, 1999, 2001]),
          rng.choice([None, 0.0, 1.0, 2.0]), rng.choice([None, 0, 5000, 5600])) for i in range(60)],
        "provider_id long, title string, original_title string, release_year int, popularity double, runtime_seconds long")
    files = spark.createDataFrame(
        [(i, "MOVIE", rng.choice(["hot", "Cold", "Warm", "none", "!", None]), rng.choice([None, 1990, 1997, 1998, 1999]), rng.choice([None, 5000.0, 5700.0])) for i in range(60)],
        "media_file_id long, candidate_type string, parsed_title string, parsed_year int, local_seconds double")
    fields = ["media_file_id", "rank", "provider_id", "total_score"]
    keyed = linkage._queried(files)
    found = search.exact_titles(linkage._asked(keyed), movies).select(F.col("block").alias("b"), F.col("year").alias("y"), "movie", "title_score")
    met = keyed.join(found, (F.col("block") == F.col("b")) & F.col("year").eqNullSafe(F.col("y")))
    bare = F.row_number().over(Window.partitionBy("media_file_id").orderBy(*linkage._order(linkage._bare())))
    local = {"year": F.col("parsed_year"), "type": F.col("candidate_type")}
    match = linkage.movie_score(local, F.col("movie"), F.col("title_score"), F.when(F.col("n") <= 3, F.col("local_seconds")))
    every = linkage._ranked(met.withColumn("n", bare).withColumn("match", match))
    want = sorted((r.media_file_id, r["rank"], r.match.provider_id, r.match.total_score) for r in every.collect())
    rows = linkage.movie_match_ranks(files, movies)
    assert sorted(tuple(r[f] for f in fields) for r in rows.collect()) == want and len(want) > 300
    queries = linkage._asked(keyed)
    place = F.row_number().over(Window.partitionBy("block", "year").orderBy(*linkage._order(linkage._bare()))) - 1
    order = lambda df: sorted((r.block, r.year or 0, r.position, r.movie.provider_id) for r in df.collect())
    assert order(linkage.title_results(queries, movies)) == order(search.exact_titles(queries, movies).withColumn("position", place))
    asked = queries.withColumnRenamed("block", "title")
    pages = {}
    for r in search.search_movies(asked, movies).collect():
        pages.setdefault((r.title, r.year), []).append(r)
    assert len(pages) > 8
    for (_, year), page in pages.items():
        page.sort(key=lambda r: r.position)
        fit = lambda r: 0.5 if year is None or r.release_year is None else {0: 1.0, 1: 0.6}.get(abs(year - r.release_year), 0.0)
        assert [r.position for r in page] == list(range(len(page)))
        assert page == sorted(page, key=lambda r: (-r.share, -fit(r), -(r.popularity or 0.0), r.provider_id))


def test_large_results_of_small_inputs_are_spread(spark):
    """By their bytes the inputs would be joined, and their results sorted, in a task or two."""
    movies = spark.createDataFrame([(i, "Hot", None, 1990 + i % 9, 1.0, None) for i in range(20)],
                                   "provider_id long, title string, original_title string, release_year int, popularity double, runtime_seconds long")
    asked = spark.createDataFrame([("hot", 1990 + i) for i in range(9)], "title string, year int")
    shows = movies.select("provider_id", "title", "popularity")
    for df in (search.search_movies(asked, movies), search.search_series(asked.select("title"), shows),
               linkage.title_results(asked.withColumnRenamed("title", "block"), movies)):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_given_pairs_are_ranked_by_ids_and_scores_alone(spark):
    rng = random.Random(4)
    titles = [None, "", "???", "Hot", "The Hot", "Hot Days", "Cold days", "Ünder"]
    pairs = spark.createDataFrame(
        [(i % 40, rng.choice(titles), rng.choice([None, 1990, 1998]), rng.choice(["MOVIE", "EPISODE", None]), rng.choice([None, 0.0, 5000.0, 5700.0]), rng.randrange(4),
          i, rng.choice(titles), rng.choice(titles), rng.choice([None, 1998, 1999, 2005]), rng.choice([None, 0.0, 1.0, 2.0]), rng.choice([None, 0, 5000, 5600])) for i in range(400)],
        "media_file_id long, parsed_title string, parsed_year int, candidate_type string, local_seconds double, position long, "
        "provider_id long, title string, original_title string, release_year int, popularity double, runtime_seconds long")
    want = sorted((r.media_file_id, r["rank"], r.match.provider_id, r.match.total_score) for r in linkage.match_movie_pairs(pairs).collect())
    rows = linkage.movie_pair_ranks(pairs)
    assert sorted(tuple(r) for r in rows.collect()) == want and len(want) == 400
    # Titles are folded above their distinct sets, so once a set and not once a pair.
    plan = _plan(rows)
    for line in (x for x in plan.splitlines() if "Filter" in x):
        assert "regexp_replace" not in line or plan.splitlines().index(line) < max(i for i, x in enumerate(plan.splitlines()) if "Aggregate" in x)


def test_rows_of_a_result_come_together(spark):
    """Files of all pairs hold a result once and not once a candidate."""
    movies = spark.createDataFrame([(i, "Hot", None, 1990, 1.0, None) for i in range(50)],
                                   "provider_id long, title string, original_title string, release_year int, popularity double, runtime_seconds long")
    files = spark.createDataFrame([(i, "MOVIE", "hot", 1990, 5000.0) for i in range(40)],
                                  "media_file_id long, candidate_type string, parsed_title string, parsed_year int, local_seconds double")
    rows = [(r.media_file_id, r["rank"], r.provider_id) for r in linkage.movie_match_ranks(files, movies).collect()]
    assert sorted(rows) == [(i, k + 1, k) for i in range(40) for k in range(50)]
    rest = [r for r in rows if r[1] > linkage.DETAIL_LOOKUPS]
    assert sum(a[2] != b[2] for a, b in zip(rest, rest[1:])) == 50 - linkage.DETAIL_LOOKUPS - 1


def test_rows_of_an_episode_come_together(spark):
    """Files of all pairs hold an episode once and not once a candidate."""
    series = spark.createDataFrame([(i, "Show") for i in range(30)], "provider_id long, title string")
    episodes = spark.createDataFrame([(i, 1, 1, 100 + i, None, 1000) for i in range(30)],
                                     "series_provider_id long, season_number int, episode_number int, provider_id long, episode_title string, runtime_seconds long")
    shows = spark.createDataFrame([(i, "EPISODE", "show", 1, 1, None, float(1000 + i % 2)) for i in range(20)], SHOWS)
    rows = [(r.media_file_id, r["rank"], r.series_provider_id) for r in linkage.episode_ranks(shows, series, episodes).collect()]
    assert sorted(rows) == [(i, k + 1, k) for i in range(20) for k in range(30)]
    assert sum(a[2] != b[2] for a, b in zip(rows, rows[1:])) == 29
