"""Record linkage: candidates against provider catalogs, scored, ranked and decided.

Two ways to find the rows a candidate is compared with:

* a finder of ``operators.search``: equal folded titles, also titles near by first word and year, or a search by
  words. All results are ranked once per distinct (title, year) query; a candidate adds the few of them whose runtime is compared with its own, which are
  all that can differ between candidates of one query. Both are kept apart (``movie_members``, ``query_results``), so
  what is stored grows with queries plus candidates; ``expanded`` and ``at_rank`` put them together again;
* given pairs: the search hits a provider returned, all of them.

Results are rows with a rank and are never cut. Deciding needs the best two of an attempt only; what is recorded of an
attempt is all of its matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import scores
from shelfmark.functions.titles import fold_title, with_similarities, with_similarity
from shelfmark.operators.episode_tops import FOUND, KEY, PAIR_TASKS, first_episodes, ranked_episodes
from shelfmark.operators.search import _asked as _distinct_queries, blocked, by_title, exact_dealt, exact_firsts, exact_titles

# How many results have their runtime looked up, and how many given series their episodes.
DETAIL_LOOKUPS = 3
SERIES_LOOKUPS = 2
ALGORITHM_VERSION = 1

# Tasks that score the candidates of movies.
SCORING_TASKS = 96

# Episodes of a key that its candidates meet as rows; where there are more they are looked up.
FEW_EPISODES = 50

# Results of a query that are put together where they are spread over its candidates.
SEGMENT = 4096

# Results after the compared ones that can still be among the best two.
_SPARE = 2


Finder = Callable[[DataFrame, DataFrame], DataFrame]
# What happens to a table between two steps: ``sources.store.written`` writes it and reads it back, so that no plan holds
# more than a step. A driver keeps the text of a plan with every stage of it that ends.
Keep = Callable[[DataFrame], DataFrame]


def _as_is(df: DataFrame) -> DataFrame:
    return df


def title_results(queries: DataFrame, movies: DataFrame, find: Finder = exact_titles) -> DataFrame:
    """All results of each distinct (block, year) query as rows, best first by the score without runtime: (block,
    year, position from 0, movie, title_score). There is a row per query and result, however many candidates ask."""
    found = exact_dealt(queries, movies) if find is exact_titles else find(queries, movies)
    query = ["block", "part", "year"] if find is exact_titles else ["block", "year"]
    place = F.row_number().over(Window.partitionBy(*query).orderBy(*_order(_bare()))) - 1
    return found.select("block", "year", place.alias("position"), "movie", "title_score")


def first_results(queries: DataFrame, movies: DataFrame, count: int, find: Finder = exact_titles) -> DataFrame:
    """``title_results`` below position ``count``; where titles are equal, without ranking the others."""
    if find is exact_titles:
        find = lambda asked, held: exact_firsts(asked, held, count)
    return title_results(queries, movies, find).where(F.col("position") < count)


def _movie_total(year: Column, release_year: Column, title_score: Column, length: Column, kind: Column) -> Column:
    w = scores.MOVIE_WEIGHTS
    return F.round(scores.weighted_mean([
        (title_score, w["title_score"]), (scores.year_score(year, release_year), w["year_score"]),
        (length, w["runtime_score"])]) * kind, 4)


def movie_score(local: dict[str, Column], movie: Column, title_score: Column, runtime: Column,
                length: Column | None = None) -> Column:
    """Scored match of one provider movie; sorts best first as a struct. ``length`` sets the runtime's score."""
    year = scores.year_score(local["year"], movie["release_year"])
    length = scores.runtime_score(runtime, movie["runtime_seconds"]) if length is None else length
    right_type = local["type"] == "MOVIE"
    kind = F.when(right_type, 1.0).otherwise(scores.TYPE_MISMATCH)
    total = _movie_total(local["year"], movie["release_year"], title_score, length, kind)
    return F.struct(
        (-total).alias("sort_score"), (-F.coalesce(movie["popularity"], F.lit(0.0))).alias("sort_popularity"),
        movie["provider_id"].alias("provider_id"), movie["title"].alias("title"),
        movie["release_year"].alias("release_year"), F.round(title_score, 4).alias("title_score"),
        year.alias("year_score"), length.alias("runtime_score"), kind.alias("type_score"), total.alias("total_score"),
        scores.reasons(
            scores.title_reason("title", title_score), scores.year_reason(local["year"], movie["release_year"]),
            scores.runtime_reason(runtime, movie["runtime_seconds"]),
            scores.type_reason(right_type, local["type"], "MOVIE")).alias("reasons"),
    )


def _local() -> dict[str, Column]:
    return {"year": F.col("parsed_year"), "type": F.col("candidate_type")}


def _queried(candidates: DataFrame) -> DataFrame:
    """Candidates with their query. A title that folds to nothing gets a block of its own, which matches nothing."""
    block = fold_title(F.col("parsed_title"))
    own = F.concat(F.lit("\x00"), F.col("media_file_id").cast("string"))
    return candidates.withColumns({
        "block": F.when(F.coalesce(block, F.lit("")) != "", block).otherwise(own), "year": F.col("parsed_year").cast("int")})


def _asked(keyed: DataFrame) -> DataFrame:
    return keyed.where(~F.startswith(F.col("block"), F.lit("\x00"))).select("block", "year")


def _bare() -> Column:
    """The match of a result whose runtime is not compared: the same for all candidates of a query."""
    return movie_score({"year": F.col("year"), "type": F.lit("MOVIE")}, F.col("movie"), F.col("title_score"),
                       F.lit(None).cast("double"))


def _order(match: Column) -> list[Column]:
    """What matches of a query sort by; an id is met once in it."""
    return [match["sort_score"], match["sort_popularity"], match["provider_id"]]


def query_results(candidates: DataFrame, movies: DataFrame, detail: int = DETAIL_LOOKUPS,
                  find: Finder = exact_titles, ranks: int | None = None) -> DataFrame:
    """(block, year, position, match): results of each distinct query from position ``detail`` on, in rank order; with
    ``ranks``, those that a rank up to it can have.

    Their runtime is never compared, so every candidate of the query has them in this order with these scores.
    """
    asked = _asked(_queried(candidates))
    found = title_results(asked, movies, find) if ranks is None else first_results(asked, movies, detail + ranks, find)
    rest = found.where(F.col("position") >= detail)
    return rest.select("block", "year", "position", _bare().alias("match"))


def _heads(results: DataFrame, detail: int) -> DataFrame:
    """One row per query: result_count, ``head`` (its first results as position, movie, title_score) and ``ahead``:
    for each of the first ``detail``, by what its runtime score turns out to be, how many of the other results come
    before it. The partitioning of the ranking serves all of it."""
    entry = F.struct("position", "movie", "title_score")
    query = Window.partitionBy("block", "year")
    firsts = [F.max(F.when(F.col("position") == i, F.struct("movie", "title_score"))).over(query).alias(f"__h{i}") for i in range(detail)]
    rows = results.select("*", *firsts, F.struct(*_order(_bare())).alias("__order"))

    def before(i: int, length: float | None) -> Column:
        first = F.col(f"__h{i}")
        with_length = movie_score({"year": F.col("year"), "type": F.lit("MOVIE")}, first["movie"], first["title_score"],
                                  F.lit(None).cast("double"), F.lit(length).cast("double"))
        earlier = F.col("__order") < F.struct(*_order(with_length))
        return F.count_if((F.col("position") >= detail) & first.isNotNull() & earlier)

    ahead = F.array(*[F.array(*[before(i, length) for length in (None, *scores.RUNTIME_SCORES)]) for i in range(detail)])
    return rows.groupBy("block", "year").agg(
        F.sort_array(F.collect_list(F.when(F.col("position") < detail + _SPARE, entry))).alias("head"),
        F.count(F.lit(1)).alias("result_count"), ahead.alias("ahead"))


def _exact_heads(asked: DataFrame, movies: DataFrame, detail: int) -> DataFrame:
    """``_heads`` of ``exact_titles``, from the first results and the number of movies per title and release year, so
    that no query meets its other results as rows.

    A runtime's score lowers a total to values that no total without one has (a test holds the weights to that), so what
    comes before it is whole years; where it does not lower it, none of the others comes before it.
    """
    query, none, film = ["block", "year"], F.lit(None).cast("double"), F.lit(1.0)
    entry = F.struct("position", "movie", "title_score")
    firsts = first_results(asked, movies, detail + _SPARE).groupBy(*query).agg(F.sort_array(F.collect_list(entry)).alias("head"))
    firsts = firsts.withColumnsRenamed({"block": "__b", "year": "__y"})
    counts = by_title(movies).groupBy("block", F.col("movie.release_year").alias("came")).agg(F.count(F.lit(1)).alias("n"))
    years = counts.groupBy("block").agg(F.collect_list(F.struct("came", "n")).alias("years"), F.sum("n").alias("result_count"))
    total = lambda came, length: _movie_total(F.col("year"), came, F.lit(1.0), length, film)
    rows = _distinct_queries(asked).join(years, "block").join(firsts, (F.col("block") == F.col("__b")) & F.col("year").eqNullSafe(F.col("__y")))
    rows = rows.withColumns({
        "__totals": F.transform("years", lambda y: F.struct(total(y["came"], none).alias("total"), y["n"].alias("n"))),
        "__firsts": F.transform(F.filter("head", lambda e: e["position"] < detail), lambda e: e["movie"]["release_year"])})

    def before(came: Column, length: float) -> Column:
        mine = total(came, F.lit(length))
        all_ = F.aggregate("__totals", F.lit(0).cast("long"), lambda so_far, t: so_far + F.when(t["total"] > mine, t["n"]).otherwise(0))
        own = F.size(F.filter("__firsts", lambda other: total(other, none) > mine))
        return F.when(mine >= total(came, none), 0).otherwise(all_ - own).cast("long")

    ahead = F.transform("__firsts", lambda came: F.array(F.lit(0).cast("long"), *[before(came, length) for length in scores.RUNTIME_SCORES]))
    return rows.select(*query, "head", "result_count", ahead.alias("ahead"))


def movie_members(candidates: DataFrame, movies: DataFrame, detail: int = DETAIL_LOOKUPS,
                  find: Finder = exact_titles, keep: Keep = _as_is) -> DataFrame:
    """Candidates (movies) with their query's ``block`` and ``year`` (a block that starts with NUL asks nothing),
    ``result_count``, ``compared`` and ``matches``, the best two.

    ``compared`` holds the first ``detail`` results of the query, whose runtime is compared with the candidate's own:
    (rank, ahead, match), best first. ``ahead`` is how many of the other results come before it, counted once per
    query, so no candidate meets those as rows.
    """
    keyed = _queried(candidates)
    asked = keep(_distinct_queries(_asked(keyed)))
    heads = _exact_heads(asked, movies, detail) if find is exact_titles else _heads(title_results(asked, movies, find), detail)
    heads = keep(heads).withColumnsRenamed({"block": "__block", "year": "__year"})
    joined = keyed.join(heads, (F.col("block") == F.col("__block")) & F.col("year").eqNullSafe(F.col("__year")), "left")
    # Narrow rows that are costly to score: by their bytes they would be joined into a task or two.
    joined = joined.repartition(SCORING_TASKS, "media_file_id")

    def scored(e: Column) -> Column:
        runtime = F.when(e["position"] < detail, F.col("local_seconds"))
        return movie_score(_local(), e["movie"], e["title_score"], runtime)

    def entry(match: Column, position: Column) -> Column:
        turn = F.lit(0)
        for i, length in enumerate(scores.RUNTIME_SCORES):
            turn = F.when(match["runtime_score"] == length, i + 1).otherwise(turn)
        return F.struct(match.alias("match"), F.get(F.get("ahead", position), turn).alias("ahead"))

    # Scored once: the entries of ``head`` are in the order of their positions, from 0 on.
    joined = joined.withColumn("__scored", F.transform("head", scored))
    own = F.sort_array(F.transform(F.slice("__scored", 1, detail), entry))
    compared = F.transform(own, lambda o, i: F.struct((o["ahead"] + i + 1).alias("rank"), o["ahead"], o["match"]))
    best = F.slice(F.sort_array("__scored"), 1, 2)
    found = joined.withColumns({"compared": compared, "matches": best}).drop("__scored")
    none = {c: F.coalesce(c, F.array().cast(found.schema[c].dataType)) for c in ("compared", "matches")}
    return found.withColumns({**none, "result_count": F.coalesce("result_count", F.lit(0))}).drop(
        "__block", "__year", "head", "ahead")


def match_movies(candidates: DataFrame, movies: DataFrame, detail: int = DETAIL_LOOKUPS,
                 find: Finder = exact_titles) -> DataFrame:
    """Candidates with ``matches``, the best two (fewer when there are none), and ``result_count``."""
    return movie_members(candidates, movies, detail, find).drop("block", "year", "compared")


def _on_query(members: DataFrame, results: DataFrame, *more: Column) -> DataFrame:
    results = results.withColumnsRenamed({"block": "__block", "year": "__year"})
    on = (F.col("block") == F.col("__block")) & F.col("year").eqNullSafe(F.col("__year"))
    for condition in more:
        on = on & condition
    return members.join(results, on)


def expanded(members: DataFrame, results: DataFrame, detail: int = DETAIL_LOOKUPS) -> DataFrame:
    """(media_file_id, rank, match): all matches of the members given, as many as their queries have results."""
    own = members.select("media_file_id", F.inline("compared")).drop("ahead")
    place = F.col("position") - detail
    rank = place + 1 + F.size(F.filter("compared", lambda o: o["ahead"] <= place))
    rest = _on_query(members.select("media_file_id", "block", "year", "compared"), results)
    return own.select("media_file_id", F.col("rank").cast("int").alias("rank"), "match").union(
        rest.select("media_file_id", rank.cast("int").alias("rank"), "match"))


def at_rank(members: DataFrame, results: DataFrame, detail: int = DETAIL_LOOKUPS) -> DataFrame:
    """Members with a ``rank`` asked for, joined to the one ``match`` they have there; none beyond the last."""
    hit = F.get(F.filter("compared", lambda o: o["rank"] == F.col("rank")), F.lit(0))["match"]
    before = F.size(F.filter("compared", lambda o: o["rank"] < F.col("rank")))
    asked = members.withColumns({"__hit": hit, "__place": F.col("rank") - 1 - before + detail})
    given = asked.where(F.col("__hit").isNotNull()).withColumn("match", F.col("__hit")).drop("__hit", "__place")
    rest = _on_query(asked.where(F.col("__hit").isNull()), results, F.col("__place") == F.col("position"))
    return given.unionByName(rest.select(*given.columns))


def _ranked(rows: DataFrame) -> DataFrame:
    """(media_file_id, rank, match): all matches of an attempt, best first."""
    rank = F.row_number().over(Window.partitionBy("media_file_id").orderBy("match"))
    return rows.select("media_file_id", rank.alias("rank"), "match")


def movie_match_rows(candidates: DataFrame, movies: DataFrame, detail: int = DETAIL_LOOKUPS,
                     find: Finder = exact_titles) -> DataFrame:
    """Every match of every candidate as ranked rows: as many as an attempt has results."""
    members = movie_members(candidates, movies, detail, find)
    return expanded(members, query_results(candidates, movies, detail, find), detail)


def movie_match_ranks(candidates: DataFrame, movies: DataFrame, detail: int = DETAIL_LOOKUPS) -> DataFrame:
    """The rows of ``movie_match_rows`` by ids and scores alone: (media_file_id, rank, provider_id, total_score).

    Results and candidates of a query come as arrays of SEGMENT, which meet only as rows are read: no row of a pair is
    shuffled, sorted or spilled. A result's rows come together, the candidates in the same order each time, so files of
    them hold little more than that order.
    """
    asks = F.concat_ws("\x00", "block", "year").alias("__query")
    own = F.transform("compared", lambda o: F.struct(
        o["rank"].cast("int").alias("rank"), o["ahead"], o["match"]["provider_id"].alias("provider_id"), o["match"]["total_score"].alias("total_score")))
    members = movie_members(candidates, movies, detail).select("media_file_id", asks, own.alias("__own")).repartition(PAIR_TASKS, "__query")
    entry = F.struct("position", "match.provider_id", "match.total_score")
    results = query_results(candidates, movies, detail).withColumn("__segment", F.floor(F.col("position") / SEGMENT))
    held = results.groupBy("block", "year", "__segment").agg(F.collect_list(entry).alias("__entries")).select(asks, "__entries")
    place = F.col("position") - detail
    rank = sum((F.when(F.col(f"__a{i}") <= place, 1).otherwise(0) for i in range(detail)), place + 1)
    ahead = [F.get("__own", F.lit(i))["ahead"].alias(f"__a{i}") for i in range(detail)]
    turn = F.row_number().over(Window.partitionBy("__query").orderBy("media_file_id")) - 1
    groups = members.select("__query", F.floor(turn / SEGMENT).alias("__group"), F.struct("media_file_id", *ahead).alias("__member"))
    groups = groups.groupBy("__query", "__group").agg(F.collect_list("__member").alias("__members"))
    rest = groups.join(held.repartition(PAIR_TASKS, "__query"), "__query").select("__members", F.inline("__entries")).select(
        "position", "provider_id", "total_score", F.inline("__members"))
    return members.select("media_file_id", F.inline("__own")).drop("ahead").unionByName(
        rest.select("media_file_id", rank.cast("int").alias("rank"), "provider_id", "total_score"))


def match_movie_pairs(pairs: DataFrame, detail: int = DETAIL_LOOKUPS) -> DataFrame:
    """Every match of given pairs as ranked rows (media_file_id, rank, match).

    Pairs carry the candidate's columns and a provider row with its page position. The best ``detail`` by score
    without runtime are those whose runtime is compared.
    """
    pairs = with_similarities(pairs, {
        "__title": ("parsed_title", "title"), "__original": ("parsed_title", "original_title")})
    movie = F.struct("provider_id", "title", "original_title", "release_year", "popularity", "runtime_seconds")
    pairs = pairs.withColumn("__score", F.greatest("__title", "__original")).withColumn("movie", movie)
    bare = movie_score(_local(), F.col("movie"), F.col("__score"), F.lit(None).cast("double"))["total_score"]
    window = Window.partitionBy("media_file_id").orderBy(F.col("__bare").desc(), "position", "provider_id")
    pairs = pairs.withColumn("__bare", bare).withColumn("__n", F.row_number().over(window))
    runtime = F.when(F.col("__n") <= detail, F.col("local_seconds"))
    return _ranked(pairs.withColumn("match", movie_score(_local(), F.col("movie"), F.col("__score"), runtime)))


def movie_pair_ranks(pairs: DataFrame, detail: int = DETAIL_LOOKUPS) -> DataFrame:
    """The rows of ``match_movie_pairs`` by ids and scores alone: (media_file_id, rank, provider_id, total_score).

    Titles are compared once per distinct set of them, beside the pairs, which carry nothing but what ranks them: no
    title, reason or score of a part is shuffled with a pair or sorted.
    """
    titles = ["parsed_title", "title", "original_title"]
    # In a generator's outer form, or filters on folded titles are pushed below it and fold those of every pair.
    met = pairs.select(F.struct(*titles).alias("__t")).distinct().select(F.inline_outer(F.array("__t")))
    met = with_similarities(met, {"__title": ("parsed_title", "title"), "__original": ("parsed_title", "original_title")})
    key = F.xxhash64(*titles).alias("__titles"), *[F.col(t).alias(f"__{t}_met") for t in titles]
    scored = met.select(*key, F.greatest("__title", "__original").alias("__score"))
    same = F.xxhash64(*titles) == F.col("__titles")
    for t in titles:
        same = same & F.col(t).eqNullSafe(F.col(f"__{t}_met"))
    rows = pairs.join(scored, same).select(
        "media_file_id", "candidate_type", F.col("parsed_year"), "local_seconds", "position", "provider_id", "__score",
        F.struct("provider_id", F.lit(None).cast("string").alias("title"), "release_year", "popularity", "runtime_seconds").alias("movie"))
    match = lambda runtime: movie_score(_local(), F.col("movie"), F.col("__score"), runtime)
    bare = match(F.lit(None).cast("double"))["total_score"]
    window = Window.partitionBy("media_file_id").orderBy(F.col("__bare").desc(), "position", "provider_id")
    rows = rows.withColumn("__bare", bare).withColumn("__n", F.row_number().over(window))
    own = match(F.when(F.col("__n") <= detail, F.col("local_seconds")))
    rows = rows.select("media_file_id", *[own[f].alias(f) for f in ("sort_score", "sort_popularity", "provider_id", "total_score")])
    # Rows that these leave in a tie are alike in all that is returned.
    rank = F.row_number().over(Window.partitionBy("media_file_id").orderBy("sort_score", "sort_popularity", "provider_id"))
    return rows.select("media_file_id", rank.alias("rank"), "provider_id", "total_score")


def with_best(candidates: DataFrame, rows: DataFrame, keep: Keep = _as_is) -> DataFrame:
    """Candidates with ``matches``, the best two of their ranked rows, and ``result_count``."""
    best = rows.groupBy("media_file_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("rank") <= 2, F.col("match")))).alias("matches"),
        F.count(F.lit(1)).alias("result_count"))
    return _with_matches(candidates, keep(best))


def _with_matches(candidates: DataFrame, best: DataFrame) -> DataFrame:
    kind = best.schema["matches"].dataType
    return candidates.join(best, "media_file_id", "left").withColumns({
        "matches": F.coalesce("matches", F.array().cast(kind)), "result_count": F.coalesce("result_count", F.lit(0))})


def series_short_list(series: DataFrame, limit: int = SERIES_LOOKUPS) -> DataFrame:
    """The series a remote look-up would ask for episodes, per folded title; all tie on similarity, so by id. A
    catalog at hand needs no such limit: ``match_episodes`` compares all."""
    window = Window.partitionBy("block").orderBy("provider_id")
    return (
        series.withColumn("block", fold_title(F.col("title"))).where(F.col("block") != "")
        .withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= limit)
        .select("block", F.col("provider_id").alias("series_provider_id"), F.col("title").alias("series_title"))
    )


def rank_series(pairs: DataFrame, limit: int | None = SERIES_LOOKUPS) -> DataFrame:
    """Given series pairs: the best few per attempt by title similarity, then by id; all with no limit."""
    scored = with_similarity(pairs, "parsed_series_title", "series_title", "similarity")
    window = Window.partitionBy("media_file_id").orderBy(F.col("similarity").desc(), "series_provider_id")
    ranked = scored.withColumn("series_rank", F.row_number().over(window))
    return ranked if limit is None else ranked.where(F.col("series_rank") <= limit)


def episode_score(series_score: Column, episode_title_score: Column) -> Column:
    """Scored match of one provider episode over candidate and episode columns."""
    c = F.col
    season = scores.exact_score(c("season_number"), c("ep_season"))
    number = scores.exact_score(c("episode_number"), c("ep_episode"))
    length = scores.runtime_score(c("local_seconds"), c("ep_runtime"))
    right_type = c("candidate_type").isin("EPISODE", "SPECIAL")
    kind = F.when(right_type, 1.0).otherwise(scores.TYPE_MISMATCH)
    w = scores.EPISODE_WEIGHTS
    total = F.round(scores.weighted_mean([
        (series_score, w["title_score"]), (season, w["season_score"]), (number, w["episode_score"]),
        (episode_title_score, w["episode_title_score"]), (length, w["runtime_score"])]) * kind, 4)
    return F.struct(
        (-total).alias("sort_score"), c("series_provider_id").alias("series_provider_id"),
        c("ep_id").alias("provider_id"), c("ep_title").alias("title"), c("series_title").alias("series_title"),
        c("ep_season").alias("season_number"), c("ep_episode").alias("episode_number"),
        F.round(series_score, 4).alias("title_score"), season.alias("season_score"), number.alias("episode_score"),
        F.round(episode_title_score, 4).alias("episode_title_score"), length.alias("runtime_score"),
        kind.alias("type_score"), total.alias("total_score"),
        scores.reasons(
            scores.title_reason("series title", series_score),
            scores.number_reason("season", c("season_number"), c("ep_season")),
            scores.number_reason("episode", c("episode_number"), c("ep_episode")),
            scores.episode_title_reason(episode_title_score),
            scores.runtime_reason(c("local_seconds"), c("ep_runtime")),
            scores.type_reason(right_type, c("candidate_type"), "EPISODE")).alias("reasons"),
    )


def episode_index(series: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row per folded series title and episode: what a candidate is looked up by is its whole key (block,
    season_number, episode_number)."""
    named = blocked(series, ["title"]).select(
        "block", F.col("provider_id").alias("series_provider_id"), F.col("title").alias("series_title"))
    return named.join(_catalog(episodes), "series_provider_id")


def _catalog(episodes: DataFrame) -> DataFrame:
    return episodes.select(
        "series_provider_id", "season_number", "episode_number",
        F.col("provider_id").alias("ep_id"), F.nullif(F.col("episode_title"), F.lit("")).alias("ep_title"),
        F.col("runtime_seconds").alias("ep_runtime"))


def _complete() -> Column:
    return F.col("season_number").isNotNull() & F.col("episode_number").isNotNull()


def match_episodes(candidates: DataFrame, series: DataFrame, episodes: DataFrame) -> DataFrame:
    """Every episode match of each candidate as ranked rows: one per same-titled series that has the episode.

    The look-up is by title, season and number together, so a candidate meets none but episodes it matches, however
    many series share its title. A candidate without series title, season or episode number has none.
    """
    local = ["media_file_id", "candidate_type", "season_number", "episode_number", "episode_title", "local_seconds"]
    rows = _ranked_shows(candidates, series, episodes, local, FOUND).drop("runtime_score", "total_score")
    rows = rows.withColumns({"ep_season": F.col("season_number"), "ep_episode": F.col("episode_number")})
    match = episode_score(F.lit(1.0), F.col("similarity_of_titles"))
    return rows.select("media_file_id", "rank", match.alias("match"))


def episode_ranks(candidates: DataFrame, series: DataFrame, episodes: DataFrame) -> DataFrame:
    """The rows of ``match_episodes`` by ids and scores alone, without titles and reasons: (media_file_id, rank,
    series_provider_id, provider_id, season_number, episode_number, episode_title_score, runtime_score, total_score)."""
    key = ["season_number", "episode_number"]
    rows = _ranked_shows(candidates, series, episodes, ["media_file_id", *key], ["series_provider_id", "ep_id"])
    return rows.select("media_file_id", "rank", "series_provider_id", F.col("ep_id").alias("provider_id"), *key,
                       F.round("similarity_of_titles", 4).alias("episode_title_score"), "runtime_score", "total_score")


def _ranked_shows(candidates: DataFrame, series: DataFrame, episodes: DataFrame, local: list[str], found: list[str]) -> DataFrame:
    keyed = _show_keys(candidates).withColumn("__local", F.nullif(F.col("episode_title"), F.lit("")))
    return ranked_episodes(keyed, episode_index(series, episodes), local, found)


def match_episode_pairs(pairs: DataFrame, episodes: DataFrame, limit: int | None = SERIES_LOOKUPS) -> DataFrame:
    """Episode matches of given series hits as ranked rows: the candidate's columns with series_provider_id and
    series_title. ``limit`` is how many series per attempt have their episodes looked up, None for all."""
    listed = rank_series(pairs, limit).where(_complete())
    return _episode_rows(listed.join(_catalog(episodes), ["series_provider_id", "season_number", "episode_number"]))


def _episode_rows(found: DataFrame) -> DataFrame:
    return _ranked(_with_match(found))


def _with_match(found: DataFrame) -> DataFrame:
    found = found.withColumns({
        "ep_season": F.col("season_number"), "ep_episode": F.col("episode_number"),
        "__local": F.nullif(F.col("episode_title"), F.lit(""))})
    compared = with_similarity(found, "__local", "ep_title", "__episode")
    title_score = F.when(F.col("__local").isNotNull() & F.col("ep_title").isNotNull(), F.col("__episode"))
    return compared.withColumn("match", episode_score(F.col("similarity"), title_score))


def first_episode_rows(candidates: DataFrame, series: DataFrame, episodes: DataFrame, count: int = 2,
                       keep: Keep = _as_is) -> DataFrame:
    """The first ``count`` rows of ``match_episodes`` of each candidate, with its ``result_count``: (media_file_id, rank,
    match, result_count). A key with many episodes is looked up by ranges (``episode_tops``), others are joined."""
    local = ["media_file_id", "candidate_type", "season_number", "episode_number", "episode_title", "local_seconds"]
    keyed = _show_keys(candidates)
    index = keep(episode_index(series, episodes))
    sizes = keep(index.groupBy(*KEY).agg(F.count(F.lit(1)).alias("result_count")))
    asked = keep(keyed.select("block", *local).join(sizes, KEY).withColumn("__local", F.nullif(F.col("episode_title"), F.lit(""))))
    few = asked.where(F.col("result_count") <= FEW_EPISODES).join(index, KEY)
    many = index.join(sizes.where(F.col("result_count") > FEW_EPISODES).select(*KEY), KEY, "left_semi")
    looked_up = first_episodes(asked.where(F.col("result_count") > FEW_EPISODES), many, count)
    looked_up = looked_up.withColumns({"ep_season": F.col("season_number"), "ep_episode": F.col("episode_number")}).select(
        "media_file_id", "rank", episode_score(F.lit(1.0), F.col("similarity_of_titles")).alias("match"), "result_count")
    rows = _with_match(few.withColumn("similarity", F.lit(1.0)))
    rank = F.row_number().over(Window.partitionBy("media_file_id").orderBy("match"))
    return looked_up.unionByName(rows.select("media_file_id", rank.alias("rank"), "match", "result_count").where(F.col("rank") <= count))


def match_shows(candidates: DataFrame, series: DataFrame, episodes: DataFrame, keep: Keep = _as_is) -> DataFrame:
    """Candidates (shows) with ``matches``, the best two, and ``result_count``."""
    rows = first_episode_rows(candidates, series, episodes, keep=keep)
    best = rows.groupBy("media_file_id").agg(
        F.sort_array(F.collect_list("match")).alias("matches"), F.max("result_count").alias("result_count"))
    return _with_matches(candidates, keep(best))


def decide(attempts: DataFrame, kind: str) -> DataFrame:
    """Add top_score, gap, status, confidence and decision_reasons from ranked ``matches``.

    ``kind`` is MOVIE or EPISODE. The gap to a missing runner-up is the top score itself. A
    movie without a year, a special and an extra never resolve by themselves. Fixed values: the
    wording of reasons.
    """
    top, second = F.get("matches", F.lit(0)), F.get("matches", F.lit(1))
    score = top["total_score"]
    gap = F.round(score - F.coalesce(second["total_score"], F.lit(0.0)), 4)
    df = attempts.withColumns({"top_score": score, "gap": gap, "top_type": top["type_score"]})
    score, gap = F.col("top_score"), F.col("gap")
    clash = F.col("top_type") < 1.0
    if kind == "MOVIE":
        fit = F.col("parsed_year").isNotNull()
        praise, nothing = "known local year, no provider type conflict", "no provider search results"
        rival = "competing result too close"
        doubts = [F.when(~fit, "local year is unknown; movies without a year never auto-resolve"),
                  F.when(clash, "provider media type conflicts with the local candidate")]
    else:
        exact = F.coalesce(top["season_score"] == 1.0, F.lit(False)) & F.coalesce(top["episode_score"] == 1.0, F.lit(False))
        special = F.col("candidate_type").isin("SPECIAL", "EXTRA")
        fit = exact & ~special
        praise, nothing = "exact season/episode match, no provider type conflict", "no provider series/episode results"
        rival = "competing series/episode result"
        doubts = [F.when(~exact, "season/episode number does not exactly match"),
                  F.when(clash, "provider media type conflicts with the local candidate"),
                  F.when(special, "local candidate is SPECIAL/EXTRA; provider mapping requires review")]
    plausible, close = scores.PLAUSIBLE_MIN_SCORE, gap < scores.AUTO_MIN_GAP
    auto = (score >= scores.AUTO_MIN_SCORE) & ~close & ~clash & fit
    status = F.when(score.isNull() | (score < plausible), "NO_MATCH").when(auto, "RESOLVED").otherwise("REVIEW_REQUIRED")
    df = df.withColumn("status", status)
    why = (
        F.when(score.isNull(), F.array(F.lit(nothing)))
        .when(F.col("status") == "NO_MATCH", F.array(
            F.format_string(f"top score %.4f below minimum plausible threshold {plausible}", score)))
        .when(F.col("status") == "RESOLVED", F.array(
            F.format_string(f"top score %.4f >= {scores.AUTO_MIN_SCORE}", score),
            F.format_string(f"score gap %.4f >= {scores.AUTO_MIN_GAP}", gap), F.lit(praise)))
        .otherwise(scores.reasons(
            F.format_string("top score %.4f is plausible but did not meet the auto-resolve bar", score),
            F.when(close, F.format_string(f"score gap %.4f below {scores.AUTO_MIN_GAP} -- {rival}", gap)), *doubts))
    )
    confidence = F.when(F.col("status") == "RESOLVED", "HIGH").when(F.col("status") == "REVIEW_REQUIRED", "MEDIUM")
    return df.withColumns({"confidence": confidence, "decision_reasons": why}).drop("top_type")


COMPONENTS = ["title_score", "year_score", "runtime_score", "season_score", "episode_score", "episode_title_score", "type_score"]
MATCH_DDL = (
    "struct<provider_media_type:string, provider_id:bigint, title:string, release_year:int, "
    "series_title:string, series_provider_id:bigint, season_number:int, episode_number:int, "
    "score:double, reasons:array<string>, " + ", ".join(f"{c}:double" for c in COMPONENTS) + ">"
)


def stored_match(match: Column, kind: str) -> Column:
    """A scored match of either kind in the common form, with all its score components."""
    movie, none = kind == "MOVIE", F.lit(None)
    own = {"release_year", "year_score"} if movie else {
        "series_title", "series_provider_id", "season_number", "episode_number", "season_score", "episode_score", "episode_title_score"}
    common = {"title_score", "runtime_score", "type_score"}
    field = lambda c: match[c] if c in own | common else none
    return F.struct(
        F.lit(kind).alias("provider_media_type"), match["provider_id"], match["title"],
        *[field(c) for c in ("release_year", "series_title", "series_provider_id", "season_number", "episode_number")],
        match["total_score"], match["reasons"], *[field(c) for c in COMPONENTS]).cast(MATCH_DDL)


def _origin(df: DataFrame) -> list[Column]:
    """Where the searched candidate came from, null where its frame does not say."""
    return [(F.col(c) if c in df.columns else F.lit(None)).cast("long").alias(c) for c in ("candidate_id", "override_id")]


COMPARED_DDL = f"array<struct<rank:bigint, ahead:bigint, match:{MATCH_DDL}>>"


def _as_attempts(decided: DataFrame, kind: str) -> DataFrame:
    """Common attempt columns of either kind. Attempts that share their query's results name it (``query_block``)
    and hold the matches of their own (``compared``)."""
    movie, shares = kind == "MOVIE", "compared" in decided.columns
    stored = lambda o: F.struct(o["rank"], o["ahead"], stored_match(o["match"], kind).alias("match"))
    asks = ~F.startswith(F.col("block"), F.lit("\x00")) if shares else None
    return decided.select(
        "media_file_id", *_origin(decided), "status", "confidence",
        F.col("parsed_title" if movie else "parsed_series_title").alias("query_text"),
        (F.col("parsed_year") if movie else F.lit(None)).cast("int").alias("query_year"),
        F.lit(None).cast("string").alias("error_message"), F.col("result_count").cast("long").alias("result_count"),
        F.transform("matches", lambda m: stored_match(m, kind)).cast(f"array<{MATCH_DDL}>").alias("matches"),
        (F.when(asks, F.col("block")) if shares else F.lit(None)).cast("string").alias("query_block"),
        (F.transform("compared", stored) if shares else F.array()).cast(COMPARED_DDL).alias("compared"))


def _searchable() -> Column:
    return F.col("candidate_type").isin("MOVIE", "EPISODE", "SPECIAL")


def _with_errors(candidates: DataFrame, provider_errors: DataFrame | None) -> DataFrame:
    if provider_errors is None:
        return candidates.withColumn("error_message", F.lit(None).cast("string"))
    return candidates.join(provider_errors.select("media_file_id", "error_message"), "media_file_id", "left")


def _open(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The movies and the shows that are searched."""
    open_ = candidates.where(_searchable() & F.col("error_message").isNull()).drop("error_message")
    return open_.where(F.col("candidate_type") == "MOVIE"), open_.where(F.col("candidate_type") != "MOVIE")


def _movie_rows(films: DataFrame, movies: DataFrame, hits: DataFrame | None, keep: Keep = _as_is) -> DataFrame:
    if hits is None:
        return movie_match_rows(films, movies)
    local = ["media_file_id", "candidate_type", "parsed_title", "parsed_year", "local_seconds"]
    return match_movie_pairs(keep(films.select(*local).join(hits, "media_file_id")))


def _show_rows(shows: DataFrame, series: DataFrame, episodes: DataFrame, hits: DataFrame | None, keep: Keep = _as_is) -> DataFrame:
    local = ["media_file_id", "candidate_type", "parsed_series_title", "season_number", "episode_number", "episode_title", "local_seconds"]
    if hits is None:
        return match_episodes(shows.select(*local), series, episodes)
    return match_episode_pairs(keep(shows.select(*local).join(hits, "media_file_id")), episodes)


def evaluate(candidates: DataFrame, movies: DataFrame, series: DataFrame, episodes: DataFrame,
             provider_errors: DataFrame | None = None, movie_hits: DataFrame | None = None,
             series_hits: DataFrame | None = None, find: Finder = exact_titles, keep: Keep = _as_is) -> DataFrame:
    """One attempt per candidate: skipped, failed, or searched and decided.

    ``candidates`` carry the file's duration as ``local_seconds``; effective candidates also their override_id.
    ``provider_errors`` (media_file_id, error_message) names look-ups that failed. Where search hits are given
    (media_file_id with the provider's columns) they are what is compared, and titles need not be equal. ``keep`` is
    given the tables between the steps, each of which is a plan of its own where it writes them.
    """
    searchable, none = _searchable(), F.lit(None)
    candidates = keep(_with_errors(candidates, provider_errors))
    failed = F.col("error_message").isNotNull()
    text = F.when(F.col("candidate_type") == "MOVIE", F.col("parsed_title")).otherwise(F.col("parsed_series_title"))
    year = F.when(F.col("candidate_type") == "MOVIE", F.col("parsed_year"))
    ended = candidates.where(~searchable | failed).select(
        "media_file_id", *_origin(candidates), F.when(searchable, "FAILED").otherwise("SKIPPED").alias("status"),
        none.cast("string").alias("confidence"), F.when(searchable, text).alias("query_text"),
        F.when(searchable, year).cast("int").alias("query_year"),
        F.when(searchable, F.col("error_message")).alias("error_message"), F.lit(0).cast("long").alias("result_count"),
        F.array().cast(f"array<{MATCH_DDL}>").alias("matches"), none.cast("string").alias("query_block"),
        F.array().cast(COMPARED_DDL).alias("compared"))
    films, shows = _open(candidates)
    found = movie_members(films, movies, find=find, keep=keep) if movie_hits is None else with_best(
        films, _movie_rows(films, movies, movie_hits, keep), keep)
    decided = match_shows(shows, series, episodes, keep) if series_hits is None else with_best(
        shows, _show_rows(shows, series, episodes, series_hits, keep), keep)
    return (
        _as_attempts(decide(found, "MOVIE"), "MOVIE")
        .unionByName(_as_attempts(decide(decided, "EPISODE"), "EPISODE"))
        .unionByName(ended)
    )


def evaluated_matches(candidates: DataFrame, movies: DataFrame, series: DataFrame, episodes: DataFrame,
                      provider_errors: DataFrame | None = None, movie_hits: DataFrame | None = None,
                      series_hits: DataFrame | None = None) -> DataFrame:
    """(media_file_id, rank, m): every match of the attempts that ``evaluate`` makes of the same inputs, best first."""
    films, shows = _open(_with_errors(candidates, provider_errors))

    def stored(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select("media_file_id", "rank", stored_match(F.col("match"), kind).alias("m"))

    return stored(_movie_rows(films, movies, movie_hits), "MOVIE").unionByName(
        stored(_show_rows(shows, series, episodes, series_hits), "EPISODE"))


def unattempted(candidates: DataFrame, attempts: DataFrame, force: bool = False) -> DataFrame:
    """Candidates never tried before; all of them when forced."""
    if force:
        return candidates
    return candidates.join(attempts.select("media_file_id"), "media_file_id", "left_anti")


def shared_matches(candidates: DataFrame, movies: DataFrame, provider_errors: DataFrame | None = None,
                   find: Finder = exact_titles, ranks: int | None = None) -> DataFrame:
    """(query_block, query_year, position, m): the matches that all attempts of a query share, stored once; with
    ``ranks``, those that a rank up to it can have."""
    films, _ = _open(_with_errors(candidates, provider_errors))
    return query_results(films, movies, find=find, ranks=ranks).select(
        F.col("block").alias("query_block"), F.col("year").alias("query_year"), "position",
        stored_match(F.col("match"), "MOVIE").alias("m"))


def listed_matches(candidates: DataFrame, series: DataFrame, episodes: DataFrame,
                   provider_errors: DataFrame | None = None) -> DataFrame:
    """(media_file_id, rank, m): the episode matches, which are an attempt's own."""
    _, shows = _open(_with_errors(candidates, provider_errors))
    return _show_rows(shows, series, episodes, None).select(
        "media_file_id", "rank", stored_match(F.col("match"), "EPISODE").alias("m"))


def _show_keys(shows: DataFrame) -> DataFrame:
    keyed = shows.where(_complete()).withColumn("block", fold_title(F.col("parsed_series_title")))
    return keyed.where(F.col("block") != "")


def attempt_keys(candidates: DataFrame, provider_errors: DataFrame | None = None) -> DataFrame:
    """(media_file_id, block, season_number, episode_number): what each show that is searched is looked up by."""
    _, shows = _open(_with_errors(candidates, provider_errors))
    return _show_keys(shows).select("media_file_id", *KEY)


def shared_episodes(candidates: DataFrame, series: DataFrame, episodes: DataFrame,
                    provider_errors: DataFrame | None = None) -> DataFrame:
    """The catalog rows that all attempts of a key share, stored once: the key with series and episode. They and the
    candidates are what ``listed_matches`` puts together, which has a row for each pair."""
    asked = attempt_keys(candidates, provider_errors).select(*KEY).distinct()
    return episode_index(series, episodes).join(asked, KEY, "left_semi")


def first_listed(candidates: DataFrame, series: DataFrame, episodes: DataFrame, keep: int,
                 provider_errors: DataFrame | None = None) -> DataFrame:
    """``listed_matches`` up to rank ``keep``."""
    _, shows = _open(_with_errors(candidates, provider_errors))
    return first_episode_rows(shows, series, episodes, keep).select(
        "media_file_id", "rank", stored_match(F.col("match"), "EPISODE").alias("m"))


def _match_id(rank: Column) -> Column:
    return F.xxhash64("attempt_id", rank.cast("int"))


def recorded_attempts(attempts: DataFrame, run_ts: Column) -> DataFrame:
    """Attempt rows ready to append, without the match rows of their own (``shared_episodes`` and ``matches_at``)."""
    return _keyed_attempts(attempts, run_ts).drop("matches")


def _keyed_attempts(attempts: DataFrame, run_ts: Column) -> DataFrame:
    resolved = F.col("status") == "RESOLVED"
    keyed = attempts.withColumns({
        "attempt_id": F.xxhash64("media_file_id", run_ts.cast("timestamp")),
        "started_at": run_ts, "algorithm_version": F.lit(ALGORITHM_VERSION)})
    return keyed.withColumns({
        "selected_match_id": F.when(resolved, _match_id(F.lit(1))),
        "selected_match": F.when(resolved, F.get("matches", F.lit(0)))})


def recorded(attempts: DataFrame, ranked: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Attempt rows and the match rows of their own (``ranked``: media_file_id, rank, m), ready to append.

    Write the two (and the shared matches) and go on from the tables: reviews and assignments read them many times.
    Keys derive from the file and the run, those of a match from the attempt and its rank; a match meets its attempt
    only to learn whether it was selected, and the attempt keeps a copy of the selected one (``selected_match``). A match
    of a file without an attempt is not recorded. Where ``ranked`` are
    the listed matches only, movies' are in their attempt's ``compared`` and in the shared matches, which are appended
    as they are; ``attempt_matches`` reads both.
    """
    keyed = _keyed_attempts(attempts, run_ts)
    resolved, rows = F.col("status") == "RESOLVED", keyed.drop("matches")
    own = keyed.select("media_file_id", "attempt_id", resolved.alias("__resolved"))
    matches = ranked.join(own, "media_file_id").select(
        _match_id(F.col("rank")).alias("match_id"), "attempt_id", "media_file_id", "rank", "m.*",
        (F.col("__resolved") & (F.col("rank") == 1)).alias("selected"))
    return rows, matches


def _sharing(attempts: DataFrame) -> DataFrame:
    return attempts.where(F.col("query_block").isNotNull()).withColumnsRenamed({"query_block": "block", "query_year": "year"})


def _shared(shared: DataFrame) -> DataFrame:
    return shared.withColumnsRenamed({"query_block": "block", "query_year": "year", "m": "match"})


def attempt_matches(attempts: DataFrame, listed: DataFrame, shared: DataFrame) -> DataFrame:
    """All match rows of the recorded attempts given: their own, those they compared, and their queries' shared ones.

    As many rows as the attempts have results, so give it those that are looked at (a review's, say)."""
    members = _sharing(attempts)
    found = expanded(members, _shared(shared)).join(
        members.select("media_file_id", "attempt_id", "selected_match_id"), "media_file_id")
    id_ = _match_id(F.col("rank"))
    movies = found.select(
        id_.alias("match_id"), "attempt_id", "media_file_id", "rank", "match.*",
        F.coalesce(id_ == F.col("selected_match_id"), F.lit(False)).alias("selected"))
    return movies.unionByName(listed.join(attempts.select("attempt_id"), "attempt_id", "left_semi"))


def matches_at(attempts: DataFrame, asked: DataFrame, listed: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of ``attempt_matches`` at the ranks asked for (media_file_id, rank), with no row for the others.
    ``listed`` (media_file_id, rank, m) and ``shared`` must reach to the last of these ranks."""
    asked = asked.select("media_file_id", F.col("rank").cast("int").alias("rank")).distinct()
    own = attempts.select("media_file_id", "attempt_id", "selected_match_id")
    films = at_rank(_sharing(attempts).join(asked, "media_file_id"), _shared(shared)).select("media_file_id", "rank", F.col("match").alias("m"))
    shows = listed.join(asked, ["media_file_id", "rank"], "left_semi").select("media_file_id", "rank", "m")
    id_ = _match_id(F.col("rank"))
    return films.unionByName(shows).join(own, "media_file_id").select(
        id_.alias("match_id"), "attempt_id", "media_file_id", "rank", "m.*",
        F.coalesce(id_ == F.col("selected_match_id"), F.lit(False)).alias("selected"))


def selected_matches(attempts: DataFrame) -> DataFrame:
    """The match row of each recorded attempt that the run resolved, from the attempt itself. What a reviewer selects
    is among its ``attempt_matches``."""
    chosen = attempts.where(F.col("selected_match").isNotNull())
    return chosen.select(F.col("selected_match_id").alias("match_id"), "attempt_id", "media_file_id", F.lit(1).alias("rank"),
                         "selected_match.*", F.lit(True).alias("selected"))
