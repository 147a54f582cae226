"""Ways to find the provider titles a query meets: pairs of a distinct query and a catalog row.

A query is a folded title with a year, asked once however many candidates share it. Finders take queries (block, year)
and a movie catalog and give (block, year, movie, title_score), each pair once:

* ``exact_titles``: the folded titles are equal;
* ``near_titles``: also those that begin with the same word and came out within a year of the query's;
* ``title_search``: also those that share at least SHARED_PERCENT of all words of the two titles, in any order.

``search_movies`` and ``search_series`` give a provider's search pages for requests, by the last of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import scores
from shelfmark.functions.titles import fold_title, with_similarities

SHARED_PERCENT = 50
HOT_ROWS = 20_000  # rows of one join key that a task takes
PART_PAIRS = 1_000_000  # results of one title that are ranked together
PART_TASKS = 384
YEARS_TOGETHER = 8  # requests of one title whose pages are ranked together
MOVIE_FIELDS = ["provider_id", "title", "original_title", "release_year", "popularity", "runtime_seconds"]


def _titles(df: DataFrame, names: list[str]) -> Column:
    """The distinct folded titles of a record, the first named first; those that fold to nothing left out."""
    folded = F.array_distinct(F.array_compact(F.array(*[fold_title(F.col(t)) for t in names])))
    return F.filter(folded, lambda t: t != "")


def blocked(df: DataFrame, titles: list[str]) -> DataFrame:
    """One row per distinct folded title of the record, under ``block``.

    The outer form again: the plain one would fold every title twice.
    """
    return df.withColumn("block", F.explode_outer(_titles(df, titles))).where(F.col("block").isNotNull())


def _asked(queries: DataFrame) -> DataFrame:
    return queries.where(F.coalesce(F.col("block"), F.lit("")) != "").select(
        "block", F.col("year").cast("int").alias("year")).distinct()


def by_title(movies: DataFrame) -> DataFrame:
    """(block, movie): every movie under each of its folded titles."""
    return blocked(movies, ["title", "original_title"]).select("block", F.struct(*MOVIE_FIELDS).alias("movie"))


def exact_titles(queries: DataFrame, movies: DataFrame) -> DataFrame:
    return _asked(queries).join(by_title(movies), "block").select("block", "year", "movie", F.lit(1.0).alias("title_score"))


def exact_dealt(queries: DataFrame, movies: DataFrame) -> DataFrame:
    """``exact_titles`` with ``part``: the years asked of a title are dealt over so many parts that one holds about
    PART_PAIRS results (or one query's), so that what ranks them takes a task no more memory however many there are."""
    asked, held = _asked(queries), by_title(movies)
    count = lambda df, name: df.groupBy("block").agg(F.count(F.lit(1)).alias(name))
    parts = F.least(F.col("__a"), F.ceil(F.col("__a") * F.col("__b") / PART_PAIRS)).cast("int")
    sizes = count(asked, "__a").join(count(held, "__b"), "block").select("block", parts.alias("__parts"))
    asked = asked.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64(F.coalesce("year", F.lit(0))), "__parts").cast("int"))
    held = held.join(sizes, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    # By number: small inputs with large results would be put into a task or two by their bytes.
    met = asked.drop("__parts").repartition(PART_TASKS, "block", "part").join(
        held.drop("__parts").repartition(PART_TASKS, "block", "part"), ["block", "part"])
    return met.select("block", "part", "year", "movie", F.lit(1.0).alias("title_score"))


def exact_firsts(queries: DataFrame, movies: DataFrame, count: int) -> DataFrame:
    """Results of ``exact_titles`` that hold the first ``count`` of every query: of a title and release year, which
    score alike for it, the first so many by popularity and id."""
    order = [(-F.coalesce("movie.popularity", F.lit(0.0))).asc(), F.col("movie.provider_id").asc()]
    place = F.row_number().over(Window.partitionBy("block", "movie.release_year").orderBy(*order))
    held = by_title(movies).withColumn("__n", place).where(F.col("__n") <= count).drop("__n")
    return _asked(queries).join(held, "block").select("block", "year", "movie", F.lit(1.0).alias("title_score"))


def salted(asked: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """Inner join on ``key``, whose rows in ``held`` are dealt over parts where it has more than HOT_ROWS of them.

    Asking rows of such a key meet each of its parts; no task gets more than HOT_ROWS rows of it. ``held`` must carry
    ``place``, a number by which its rows are dealt.
    """
    hot = held.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS).select(
        *key, F.ceil(F.col("__n") / HOT_ROWS).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    held = held.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64("place"), parts).cast("int")).drop("__parts", "place")
    asked = asked.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return asked.join(held, [*key, "__part"]).drop("__part")


def _scored(pairs: DataFrame) -> DataFrame:
    """Pairs of block and ``titles`` (one or two folded ones) with the better title's similarity."""
    pairs = pairs.withColumns({"__first": F.get("titles", F.lit(0)), "__second": F.get("titles", F.lit(1))})
    pairs = with_similarities(pairs, {"__a": ("block", "__first"), "__b": ("block", "__second")})
    return pairs.withColumn("title_score", F.greatest("__a", "__b")).drop("__first", "__second", "__a", "__b", "titles")


def _catalog(movies: DataFrame) -> DataFrame:
    return movies.select(F.col("provider_id").alias("place"), F.struct(*MOVIE_FIELDS).alias("movie"),
                         _titles(movies, ["title", "original_title"]).alias("titles"))


def _first_word(title: Column) -> Column:
    return F.substring_index(title, " ", 1)


def near_only(queries: DataFrame, movies: DataFrame) -> DataFrame:
    """Pairs of the second block alone: the same first word, the years known and at most one apart, no title equal.

    The query's year is spread to its three values, so the block is an equi-join; a movie that two titles lead to is
    taken by the first of them.
    """
    asked = _asked(queries).where(F.col("year").isNotNull()).select(
        "block", "year", _first_word(F.col("block")).alias("word"),
        F.explode(F.sequence(F.col("year") - 1, F.col("year") + 1)).alias("came"))
    words = F.array_distinct(F.transform("titles", _first_word))
    held = _catalog(movies).where(F.col("movie.release_year").isNotNull()).select(
        "place", "movie", "titles", F.col("movie.release_year").alias("came"), F.explode(words).alias("word"))
    pairs = salted(asked, held, ["word", "came"]).where(~F.array_contains("titles", F.col("block")))
    return _scored(pairs.select("block", "year", "movie", "titles")).select("block", "year", "movie", "title_score")


def near_titles(queries: DataFrame, movies: DataFrame) -> DataFrame:
    return exact_titles(queries, movies).unionByName(near_only(queries, movies))


# --- search by words ------------------------------------------------------------------

def _words(title: Column) -> Column:
    return F.array_distinct(F.split(title, " "))


def _needed(size: Column, percent: int) -> Column:
    """The fewest words that a title must share with a set of this size for their share to reach the percentage."""
    return F.ceil(size * percent / F.lit(100.0)).cast("int")


def _prefixes(sets: DataFrame, ids: list[str], rarity: DataFrame, percent: int) -> DataFrame:
    """Sets (ids, words) with ``prefix``: their rarest words, as many as must include a shared one for any partner."""
    rows = sets.select(*ids, F.explode("words").alias("word")).join(rarity, "word", "left")
    entry = F.struct(F.coalesce("titles_with", F.lit(0)).alias("n"), "word")
    ordered = rows.groupBy(*ids).agg(F.sort_array(F.collect_list(entry)).alias("__e"))
    size = F.size("__e")
    prefix = F.slice(F.transform("__e", lambda e: e["word"]), F.lit(1), size - _needed(size, percent) + 1)
    return ordered.select(*ids, F.transform("__e", lambda e: e["word"]).alias("words"), prefix.alias("prefix"))


def word_pairs(asked: DataFrame, held: DataFrame, percent: int = SHARED_PERCENT) -> DataFrame:
    """(block, title, shared, words_in_all) for distinct folded titles asked (block) and held (title) that share at
    least ``percent`` of all words of the two: 100 * shared >= percent * words_in_all, words counted once.

    Two such titles have a word in common among the rarest few of each (prefix filtering), so only those words are
    indexed; a pair is taken at the first of them it shares, and its sizes are checked before its words are.
    """
    titles = held.select("title").distinct().withColumn("words", _words(F.col("title")))
    rarity = titles.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("titles_with"))
    queries = asked.select("block").distinct().withColumn("words", _words(F.col("block")))
    left = _prefixes(queries, ["block"], rarity, percent).select(
        "block", F.col("words").alias("words_a"), F.col("prefix").alias("prefix_a"), F.explode("prefix").alias("word"))
    right = _prefixes(titles, ["title"], rarity, percent).select(
        "title", F.col("words").alias("words_b"), F.col("prefix").alias("prefix_b"), F.explode("prefix").alias("word"),
        F.xxhash64("title").alias("place"))
    a, b = F.size("words_a"), F.size("words_b")
    met = salted(left, right, ["word"]).where((a * 100 >= b * percent) & (b * 100 >= a * percent)).where(
        F.col("word") == F.get(F.array_intersect("prefix_a", "prefix_b"), F.lit(0)))
    shared = F.size(F.array_intersect("words_a", "words_b"))
    met = met.select("block", "title", shared.alias("shared"), (a + b - shared).alias("words_in_all"))
    return met.where(F.col("shared") * 100 >= F.col("words_in_all") * percent)


def _movies_met(queries: DataFrame, movies: DataFrame, percent: int) -> DataFrame:
    """(block, movie, titles, share): movies by either title, each once, with the greater share of words."""
    catalog = _catalog(movies).withColumnRenamed("place", "provider_id")
    named = catalog.select("provider_id", "movie", "titles", F.explode("titles").alias("title"))
    pairs = word_pairs(queries.select("block"), named, percent)
    # Movies are shuffled: by the bytes of their file, which hold many times as many rows, they would be sent to the driver.
    found = named.hint("merge").join(pairs, "title").select(
        "block", "provider_id", "movie", "titles", (F.col("shared") / F.col("words_in_all")).alias("share"))
    once = found.groupBy("block", "provider_id").agg(
        F.max("share").alias("share"), F.any_value("movie").alias("movie"), F.any_value("titles").alias("titles"))
    return once.select("block", "movie", "titles", "share")


def title_search(queries: DataFrame, movies: DataFrame, percent: int = SHARED_PERCENT) -> DataFrame:
    asked = _asked(queries)
    scored = _scored(_movies_met(asked, movies, percent).select("block", "movie", "titles"))
    met = asked.repartition(PART_TASKS, "block").join(scored.repartition(PART_TASKS, "block").hint("merge"), "block")
    return met.select("block", "year", "movie", "title_score")


def search_movies(requests: DataFrame, movies: DataFrame, percent: int = SHARED_PERCENT) -> DataFrame:
    """(title, year, position, share, movie columns): the result page of each distinct request (title, year), whole.

    Results come by their share of words, then by how well the year fits (an unknown one of either side counts half),
    popularity and id. A title without words finds nothing. Positions start at 0.
    """
    asked = requests.select("title", F.col("year").cast("int").alias("year"), fold_title(F.col("title")).alias("block")).distinct()
    found = _movies_met(asked.where(F.col("block") != ""), movies, percent).select("block", "movie", "share")
    queries = _asked(asked)
    fit = F.coalesce(scores.year_score(F.col("year"), F.col("movie.release_year")), F.lit(0.5))
    order = [F.desc("share"), fit.desc(), F.coalesce("movie.popularity", F.lit(0.0)).desc(), F.col("movie.provider_id")]
    # A few years of a title go to a task: pages of all of them are many times what is found for it.
    parts = queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / YEARS_TOGETHER).cast("int").alias("__parts"))
    queries = queries.join(parts, "block").withColumn("__part", F.pmod(F.xxhash64(F.coalesce("year", F.lit(0))), "__parts").cast("int"))
    found = found.join(parts, "block").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    place = F.row_number().over(Window.partitionBy("block", "__part", "year").orderBy(*order)) - 1
    met = queries.drop("__parts").repartition(PART_TASKS, "block", "__part").join(
        found.drop("__parts").repartition(PART_TASKS, "block", "__part"), ["block", "__part"])
    pages = met.withColumn("position", place)
    pages = pages.withColumnsRenamed({"block": "__block", "year": "__year"})
    rows = asked.join(pages, (F.col("block") == F.col("__block")) & F.col("year").eqNullSafe(F.col("__year")))
    names = {f: "found_title" if f == "title" else f for f in MOVIE_FIELDS}
    return rows.select("title", "year", "position", "share", *[F.col(f"movie.{f}").alias(n) for f, n in names.items()])


def search_series(requests: DataFrame, series: DataFrame, percent: int = SHARED_PERCENT) -> DataFrame:
    """(title, position, share, series_provider_id, series_title): as ``search_movies``, for series and without a year."""
    asked = requests.select("title", fold_title(F.col("title")).alias("block")).distinct().where(F.col("block") != "")
    held = series.select(F.col("provider_id").alias("series_provider_id"), F.col("title").alias("series_title"),
                         "popularity", fold_title(F.col("title")).alias("title")).where(F.col("title") != "")
    pairs = word_pairs(asked, held, percent)
    found = held.join(pairs, "title").withColumn("share", F.col("shared") / F.col("words_in_all")).repartition(PART_TASKS, "block")
    order = [F.desc("share"), F.coalesce("popularity", F.lit(0.0)).desc(), F.col("series_provider_id")]
    place = F.row_number().over(Window.partitionBy("block").orderBy(*order)) - 1
    pages = found.select("block", place.alias("position"), "share", "series_provider_id", "series_title")
    return asked.join(pages, "block").drop("block")
