"""First matches of queries and keys that meet many rows, against all of them."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import scores
from shelfmark.operators import episode_tops, linkage

SHOWS = ("media_file_id long, candidate_type string, parsed_series_title string, season_number int, episode_number int, "
         "episode_title string, local_seconds double")


@pytest.mark.parametrize("keep, hot", [(1, 7), (2, 20_000), (3, 7)])
def test_first_episodes_equal_those_of_all_pairs(spark, monkeypatch, keep, hot):
    monkeypatch.setattr(linkage, "FEW_EPISODES", 4)
    monkeypatch.setattr(episode_tops, "HOT_ROWS", hot)
    rng = random.Random(keep)
    titles = [None, "", "???", "Pilot", "The Pilot", "Pilots", "End", "The very end"]
    series = spark.createDataFrame([(i, rng.choice(["Show", "The Show", "show!", "Other", "Rare"])) for i in range(40)], "provider_id long, title string")
    runtimes = [None, 0, -5, 95, 100, 105, 106, 115, 116, 118, 85, 80, 1000, 1050, 1053, 952, 953, 870]
    episodes = spark.createDataFrame(
        [(rng.randrange(40), rng.choice([1, 1, 2]), rng.choice([1, 2]), i, rng.choice(titles), rng.choice([*runtimes, rng.randrange(60, 1300)])) for i in range(600)],
        "series_provider_id long, season_number int, episode_number int, provider_id long, episode_title string, runtime_seconds long")
    shows = spark.createDataFrame(
        [(i, rng.choice(["EPISODE", "SPECIAL", "MOVIE"]), rng.choice(["show", "Other", "Rare", "none", "!", None]), rng.choice([1, 2, None]), rng.choice([1, 2, 3, None]),
          rng.choice(titles), rng.choice([None, 0.0, -3.0, 100.0, 1000.0, 99.75, float(rng.randrange(60, 1300))])) for i in range(250)], SHOWS)
    every = linkage.match_episodes(shows, series, episodes)
    want = {(r.media_file_id, r["rank"]): r.match for r in every.where(F.col("rank") <= keep).collect()}
    counts = {r.media_file_id: r["count"] for r in every.groupBy("media_file_id").count().collect()}
    got = linkage.first_episode_rows(shows, series, episodes, keep).collect()
    assert {(r.media_file_id, r["rank"]): r.match for r in got} == want and len(want) > 30
    assert all(r.result_count == counts[r.media_file_id] for r in got) and max(counts.values()) > 40


def test_no_compared_runtime_ties_with_the_results_not_compared():
    """What ``_exact_heads`` rests on."""
    w = scores.MOVIE_WEIGHTS
    for years in ((None,), (1.0, 0.6, 0.5, 0.0)):
        def total(year, length):
            parts = [(1.0, w["title_score"]), (year, w["year_score"]), (length, w["runtime_score"])]
            return round(sum(s * x for s, x in parts if s is not None) / sum(x for s, x in parts if s is not None), 4)

        for year in years:
            for length in scores.RUNTIME_SCORES:
                mine = total(year, length)
                assert mine >= total(year, None) or all(abs(mine - total(y, None)) > 1e-3 for y in years)


@pytest.mark.parametrize("detail", [1, 3])
def test_exact_heads_equal_those_of_all_results(spark, detail):
    rng = random.Random(detail)
    movies = spark.createDataFrame(
        [(i, rng.choice(["Hot", "The Hot", "Cold", "???"]), rng.choice([None, "hot!", "Warm"]), rng.choice([None, 1997, 1998, 1999, 2000, 2001]),
          rng.choice([None, 0.0, 1.0, 2.0]), rng.choice([None, 5000])) for i in range(300)],
        "provider_id long, title string, original_title string, release_year int, popularity double, runtime_seconds long")
    asked = spark.createDataFrame([(t, y) for t in ("hot", "cold", "warm", "none", "") for y in (None, 1990, 1998, 1999)] * 2, "block string, year int")
    want = {(r.block, r.year): r.asDict(True) for r in linkage._heads(linkage.title_results(asked, movies), detail).collect()}
    got = {(r.block, r.year): r.asDict(True) for r in linkage._exact_heads(asked, movies, detail).collect()}
    assert got == want and len(want) == 12 and any(a for r in want.values() for a in sum(r["ahead"], []))
    results = lambda df: {(r.block, r.year, r.position): r.movie for r in df.collect()}
    assert results(linkage.first_results(asked, movies, 7)) == results(linkage.title_results(asked, movies).where("position < 7"))
