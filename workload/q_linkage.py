"""Record linkage: blocks, scores, ranks, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import titles
from shelfmark.operators import linkage, search
from shelfmark.sources.store import written
from workload.q_functions import FOLD
from workload.registry import PARTS, query, run_ts

_YEAR = "CASE WHEN c.parsed_year IS NULL THEN NULL WHEN m.release_year IS NULL THEN 0.5e0 WHEN c.parsed_year = m.release_year THEN 1e0 WHEN abs(c.parsed_year - m.release_year) = 1 THEN 0.6e0 ELSE 0e0 END"


def _runtime(local, other):
    return f"CASE WHEN {local} IS NULL OR coalesce({other}, 0) = 0 THEN NULL WHEN abs({local} - {other}) / {other} <= 0.05 THEN 1e0 WHEN abs({local} - {other}) / {other} <= 0.15 THEN 0.6e0 ELSE 0e0 END"


def _mean(parts: dict[str, str]) -> str:
    total = " + ".join(f"coalesce({s} * {w}, 0e0)" for s, w in parts.items())
    weight = " + ".join(f"CASE WHEN {s} IS NULL THEN 0e0 ELSE {w} END" for s, w in parts.items())
    return f"({total}) / ({weight})"


PARTS["movie_blocks"] = f"""
SELECT DISTINCT {FOLD.format('title')} AS block, * FROM {{movies}} UNION SELECT {FOLD.format('original_title')}, * FROM {{movies}} WHERE original_title IS NOT NULL"""
PARTS["exact_pairs"] = f"""
SELECT *, row_number() OVER (PARTITION BY media_file_id ORDER BY coalesce(ys, 0) DESC, coalesce(popularity, 0) DESC, provider_id) AS n
FROM (SELECT c.media_file_id, c.parsed_year, c.local_seconds, m.provider_id, m.title, m.release_year, m.popularity, m.runtime_seconds, {_YEAR} AS ys
  FROM {{candidates}} c JOIN {{movie_blocks}} m ON m.block = {FOLD.format('c.parsed_title')} WHERE c.candidate_type = 'MOVIE')"""
PARTS["exact_matches"] = f"""
SELECT *, row_number() OVER (PARTITION BY media_file_id ORDER BY total_score DESC, coalesce(popularity, 0) DESC, provider_id) AS rank
FROM (SELECT *, round({_mean({'1e0': '0.5e0', 'ys': '0.35e0', 'rs': '0.15e0'})}, 4) AS total_score
  FROM (SELECT *, CASE WHEN n <= 3 THEN {_runtime('local_seconds', 'runtime_seconds')} END AS rs FROM {{exact_pairs}}))"""


def _movies(c):
    return c.candidates.where("candidate_type = 'MOVIE'")


def _rows(df, *fields):
    return df.select("media_file_id", F.col("rank").cast("long").alias("rank"), *[F.col(f"match.{f}") for f in fields])


# Every match of every candidate.
@query("j07_record_linkage", "SELECT media_file_id, rank, provider_id, total_score FROM {exact_matches}")
def _(c):
    return linkage.movie_match_ranks(_movies(c), c.movies).withColumn("rank", F.col("rank").cast("long"))


@query("j07_shared_results", f"""
SELECT DISTINCT {FOLD.format('c.parsed_title')} AS block, c.parsed_year AS year, e.n - 1 AS position, e.provider_id, e.total_score
FROM {{exact_matches}} e JOIN {{candidates}} c ON c.media_file_id = e.media_file_id WHERE e.n > 3
""")
def _(c):
    return linkage.query_results(_movies(c), c.movies).select(
        "block", "year", F.col("position").cast("long").alias("position"), "match.provider_id", "match.total_score")


# The two put together again: what candidates compare themselves, and what they share.
@query("j07_matches_expanded", "SELECT media_file_id, rank, provider_id, total_score FROM {exact_matches}")
def _(c):
    return linkage.movie_match_ranks(_movies(c), c.movies).withColumn("rank", F.col("rank").cast("long"))


PARTS["rank_asked"] = "SELECT media_file_id, media_file_id % 40 + 1 AS rank FROM {candidates} WHERE candidate_type = 'MOVIE'"


@query("j07_match_at_rank", """
SELECT e.media_file_id, e.rank, e.provider_id, e.total_score FROM {exact_matches} e JOIN {rank_asked} a ON a.media_file_id = e.media_file_id AND a.rank = e.rank
""")
def _(c):
    asked = linkage.movie_members(_movies(c), c.movies).withColumn("rank", F.col("media_file_id") % 40 + 1)
    return _rows(linkage.at_rank(asked, linkage.query_results(_movies(c), c.movies, ranks=40)), "provider_id", "total_score")


@query("j07_best_two", """
SELECT c.media_file_id, count(e.rank) AS result_count, min(CASE WHEN e.rank = 1 THEN e.provider_id END) AS first_id, min(CASE WHEN e.rank = 2 THEN e.provider_id END) AS second_id
FROM {candidates} c LEFT JOIN {exact_matches} e ON e.media_file_id = c.media_file_id WHERE c.candidate_type = 'MOVIE' GROUP BY c.media_file_id
""")
def _(c):
    best = linkage.match_movies(_movies(c), c.movies)
    return best.select("media_file_id", "result_count", F.get("matches", F.lit(0))["provider_id"].alias("first_id"),
                       F.get("matches", F.lit(1))["provider_id"].alias("second_id"))


@query("w03_preliminary_top", f"""
SELECT DISTINCT {FOLD.format('c.parsed_title')} AS block, c.parsed_year AS year, e.provider_id, e.n - 1 AS position FROM {{exact_pairs}} e JOIN {{candidates}} c ON c.media_file_id = e.media_file_id WHERE e.n <= 3
""")
def _(c):
    queries = _movies(c).select(titles.fold_title(F.col("parsed_title")).alias("block"), F.col("parsed_year").alias("year"))
    results = linkage.first_results(queries, c.movies, linkage.DETAIL_LOOKUPS)
    return results.select("block", "year", F.col("movie.provider_id").alias("provider_id"), F.col("position").cast("long").alias("position"))


# The second block: the same first word, years at most one apart, titles unequal.
PARTS["movie_titles"] = f"""
SELECT *, {FOLD.format('title')} AS t1, CASE WHEN original_title IS NOT NULL THEN {FOLD.format('original_title')} END AS t2 FROM {{movies}}"""
PARTS["queries"] = f"""
SELECT DISTINCT {FOLD.format('parsed_title')} AS block, parsed_year AS year FROM {{candidates}} WHERE candidate_type = 'MOVIE'"""
PARTS["near_pairs"] = """
SELECT q.block, q.year, m.provider_id, m.popularity, m.release_year, m.runtime_seconds, greatest(r.ratio, coalesce(o.ratio, 0e0)) AS ts
FROM {queries} q JOIN {movie_titles} m ON abs(q.year - m.release_year) <= 1 AND q.block <> m.t1 AND q.block IS DISTINCT FROM m.t2
  AND (split_part(q.block, ' ', 1) = split_part(m.t1, ' ', 1) OR split_part(q.block, ' ', 1) = split_part(m.t2, ' ', 1))
JOIN {ratios} r ON r.a = q.block AND r.b = m.t1 LEFT JOIN {ratios} o ON o.a = q.block AND o.b = m.t2"""
PARTS["both_pairs"] = f"""
SELECT *, {_YEAR.replace('c.parsed_year', 'p.year').replace('m.', 'p.')} AS ys FROM (
  SELECT block, year, provider_id, popularity, release_year, runtime_seconds, ts FROM {{near_pairs}}
  UNION ALL SELECT q.block, q.year, m.provider_id, m.popularity, m.release_year, m.runtime_seconds, 1e0 FROM {{queries}} q JOIN {{movie_titles}} m ON q.block = m.t1 OR q.block = m.t2) p"""
PARTS["both_ranked"] = f"""
SELECT *, row_number() OVER (PARTITION BY block, year ORDER BY round({_mean({'ts': '0.5e0', 'ys': '0.35e0'})}, 4) DESC, coalesce(popularity, 0) DESC, provider_id) AS n FROM {{both_pairs}}"""
PARTS["both_matches"] = f"""
SELECT *, row_number() OVER (PARTITION BY media_file_id ORDER BY total_score DESC, coalesce(popularity, 0) DESC, provider_id) AS rank
FROM (SELECT *, round({_mean({'ts': '0.5e0', 'ys': '0.35e0', 'rs': '0.15e0'})}, 4) AS total_score
  FROM (SELECT c.media_file_id, b.*, CASE WHEN n <= 3 THEN {_runtime('c.local_seconds', 'b.runtime_seconds')} END AS rs
    FROM {{candidates}} c JOIN {{both_ranked}} b ON b.block = {FOLD.format('c.parsed_title')} AND b.year IS NOT DISTINCT FROM c.parsed_year WHERE c.candidate_type = 'MOVIE'))"""


def _queries(c):
    return _movies(c).select(titles.fold_title(F.col("parsed_title")).alias("block"), F.col("parsed_year").alias("year"))


@query("j07_second_block", "SELECT block, year, provider_id, round(ts, 6) AS title_score FROM {near_pairs}")
def _(c):
    return search.near_only(_queries(c), c.movies).select(
        "block", "year", "movie.provider_id", F.round("title_score", 6).alias("title_score"))


@query("j07_both_blocks", "SELECT media_file_id, rank, provider_id, total_score FROM {both_matches} WHERE n <= 3")
def _(c):
    members = linkage.movie_members(_movies(c), c.movies, find=search.near_titles)
    return members.select("media_file_id", F.inline("compared")).select(
        "media_file_id", "rank", "match.provider_id", "match.total_score")


@query("j07_both_blocks_best_two", """
SELECT c.media_file_id, count(e.rank) AS result_count, min(CASE WHEN e.rank = 1 THEN e.provider_id END) AS first_id, min(CASE WHEN e.rank = 2 THEN e.provider_id END) AS second_id
FROM {candidates} c LEFT JOIN {both_matches} e ON e.media_file_id = c.media_file_id WHERE c.candidate_type = 'MOVIE' GROUP BY c.media_file_id
""")
def _(c):
    best = linkage.match_movies(_movies(c), c.movies, find=search.near_titles)
    return best.select("media_file_id", "result_count", F.get("matches", F.lit(0))["provider_id"].alias("first_id"),
                       F.get("matches", F.lit(1))["provider_id"].alias("second_id"))


# Searches by words: at least half of all words of the two titles shared.
def _share(a: str, b: str) -> str:
    both = f"len(list_intersect(list_distinct(string_split({a}, ' ')), list_distinct(string_split({b}, ' '))))"
    return f"({both} / CAST(len(list_distinct(string_split({a} || ' ' || {b}, ' '))) AS DOUBLE))"


PARTS["word_hits"] = f"""
SELECT * FROM (SELECT b.block, m.*, greatest({_share('b.block', 'm.t1')}, CASE WHEN m.t2 IS NULL THEN 0e0 ELSE {_share('b.block', 'm.t2')} END) AS share
FROM (SELECT DISTINCT block FROM {{queries}}) b, {{movie_titles}} m) WHERE share >= 0.5e0"""


@query("s07_search_movies", f"""
SELECT q.block AS title, q.year, h.provider_id, h.release_year, round(h.share, 6) AS share,
  row_number() OVER (PARTITION BY q.block, q.year ORDER BY h.share DESC, coalesce({_YEAR.replace('c.parsed_year', 'q.year').replace('m.', 'h.')}, 0.5e0) DESC, coalesce(h.popularity, 0) DESC, h.provider_id) - 1 AS position
FROM {{queries}} q JOIN {{word_hits}} h ON h.block = q.block
""")
def _(c):
    found = search.search_movies(_queries(c).withColumnRenamed("block", "title"), c.movies)
    return found.select("title", "year", "provider_id", "release_year", F.round("share", 6).alias("share"), F.col("position").cast("long").alias("position"))


@query("s07_search_series", f"""
SELECT b.block AS title, s.provider_id AS series_provider_id, s.title AS series_title, round({_share('b.block', FOLD.format('s.title'))}, 6) AS share,
  row_number() OVER (PARTITION BY b.block ORDER BY {_share('b.block', FOLD.format('s.title'))} DESC, coalesce(s.popularity, 0) DESC, s.provider_id) - 1 AS position
FROM (SELECT DISTINCT {FOLD.format('parsed_series_title')} || ' ' || lower(coalesce(episode_title, '')) AS raw, trim(regexp_replace({FOLD.format('parsed_series_title')} || ' ' || lower(coalesce(episode_title, '')), '[^a-z0-9]+', ' ', 'g')) AS block
  FROM {{candidates}} WHERE parsed_series_title IS NOT NULL) b JOIN {{series}} s ON {_share('b.block', FOLD.format('s.title'))} >= 0.5e0
""")
def _(c):
    asked = c.candidates.where("parsed_series_title IS NOT NULL").select(
        titles.fold_title(F.concat_ws(" ", "parsed_series_title", "episode_title")).alias("title")).distinct()
    found = search.search_series(asked, c.series)
    return found.select("title", "series_provider_id", "series_title", F.round("share", 6).alias("share"), F.col("position").cast("long").alias("position"))


@query("j07_title_search", """
SELECT q.block, q.year, h.provider_id, round(greatest(r.ratio, coalesce(o.ratio, 0e0)), 6) AS title_score
FROM {queries} q JOIN {word_hits} h ON h.block = q.block JOIN {ratios} r ON r.a = q.block AND r.b = h.t1 LEFT JOIN {ratios} o ON o.a = q.block AND o.b = h.t2
""")
def _(c):
    return search.title_search(_queries(c), c.movies).select("block", "year", "movie.provider_id", F.round("title_score", 6).alias("title_score"))


# Given search hits, titles unequal.
_T = FOLD.format("h.parsed_title")
PARTS["hit_scores"] = f"""
SELECT h.*, greatest(r.ratio, coalesce(o.ratio, 0)) AS ts, {_YEAR.replace('c.', 'h.').replace('m.', 'h.')} AS ys
FROM {{hits}} h JOIN {{ratios}} r ON r.a = {_T} AND r.b = {FOLD.format('h.title')} LEFT JOIN {{ratios}} o ON o.a = {_T} AND o.b = {FOLD.format('h.original_title')}"""
PARTS["hit_matches"] = f"""
SELECT *, row_number() OVER (PARTITION BY media_file_id ORDER BY total_score DESC, coalesce(popularity, 0) DESC, provider_id) AS rank
FROM (SELECT *, round({_mean({'ts': '0.5e0', 'ys': '0.35e0', 'rs': '0.15e0'})}, 4) AS total_score
  FROM (SELECT *, CASE WHEN n <= 3 THEN {_runtime('local_seconds', 'runtime_seconds')} END AS rs
    FROM (SELECT *, row_number() OVER (PARTITION BY media_file_id ORDER BY round({_mean({'ts': '0.5e0', 'ys': '0.35e0'})}, 4) DESC, position, provider_id) AS n FROM {{hit_scores}})))"""


@query("w01_movie_rank", "SELECT media_file_id, rank, provider_id, total_score FROM {hit_matches}")
def _(c):
    return linkage.movie_pair_ranks(c.hits).withColumn("rank", F.col("rank").cast("long"))


@query("g06_movie_score", """
SELECT media_file_id, rank, provider_id, round(ts, 4) AS title_score, ys AS year_score, rs AS runtime_score, 1e0 AS type_score, total_score,
  CASE WHEN ts >= 0.999 THEN 'exact normalized title match' WHEN ts >= 0.8 THEN 'close title similarity' WHEN ts > 0 THEN 'weak title similarity' ELSE 'no meaningful title similarity' END AS first_reason
FROM {hit_matches}
""")
def _(c):
    return _rows(linkage.match_movie_pairs(c.hits), "provider_id", "title_score", "year_score", "runtime_score", "type_score", "total_score", "reasons").withColumn(
        "first_reason", F.get("reasons", F.lit(0))).drop("reasons")


_DECIDED = """
SELECT c.media_file_id, t.total_score AS top_score, round(t.total_score - coalesce(s.total_score, 0), 4) AS gap,
  CASE WHEN coalesce(t.total_score, 0) < 0.6 THEN 'NO_MATCH' WHEN t.total_score >= 0.9 AND round(t.total_score - coalesce(s.total_score, 0), 4) >= 0.1 AND c.parsed_year IS NOT NULL THEN 'RESOLVED' ELSE 'REVIEW_REQUIRED' END AS status, c.parsed_year
FROM {candidates} c LEFT JOIN {%s} t ON t.media_file_id = c.media_file_id AND t.rank = 1 LEFT JOIN {%s} s ON s.media_file_id = c.media_file_id AND s.rank = 2
WHERE c.candidate_type = 'MOVIE'"""
PARTS["movie_decisions"] = _DECIDED % ("exact_matches", "exact_matches")
PARTS["hit_decisions"] = _DECIDED % ("hit_matches", "hit_matches") + " AND t.media_file_id IS NOT NULL"


@query("w05_runner_up_gap", "SELECT media_file_id, top_score, gap FROM {hit_decisions}")
def _(c):
    return linkage.decide(_on_hits(c), "MOVIE").select("media_file_id", "top_score", "gap")


def _on_hits(c):
    found = c.hits.select("media_file_id").distinct()
    return linkage.with_best(_movies(c).join(found, "media_file_id", "left_semi"), linkage.match_movie_pairs(c.hits))


_MOVIE_WHY = """
SELECT media_file_id, status, CASE status WHEN 'RESOLVED' THEN 'HIGH' WHEN 'REVIEW_REQUIRED' THEN 'MEDIUM' END AS confidence,
  CASE WHEN top_score IS NULL THEN 'no provider search results' WHEN status = 'NO_MATCH' THEN printf('top score %%.4f below minimum plausible threshold 0.6', top_score)
    WHEN status = 'RESOLVED' THEN printf('top score %%.4f >= 0.9', top_score) || printf('; score gap %%.4f >= 0.1', gap) || '; known local year, no provider type conflict'
    ELSE printf('top score %%.4f is plausible but did not meet the auto-resolve bar', top_score) || CASE WHEN gap < 0.1 THEN printf('; score gap %%.4f below 0.1 -- competing result too close', gap) ELSE '' END
      || CASE WHEN parsed_year IS NULL THEN '; local year is unknown; movies without a year never auto-resolve' ELSE '' END END AS reasons
FROM {%s}"""


def _decision(df):
    return df.select("media_file_id", "status", "confidence", F.array_join("decision_reasons", "; ").alias("reasons"))


@query("g08_movie_decision", _MOVIE_WHY % "movie_decisions")
def _(c):
    return _decision(linkage.decide(linkage.match_movies(_movies(c), c.movies), "MOVIE"))


@query("g08_movie_decision_on_hits", _MOVIE_WHY % "hit_decisions")
def _(c):
    return _decision(linkage.decide(_on_hits(c), "MOVIE"))


# --- episodes -------------------------------------------------------------------------

PARTS["short_list"] = f"""
SELECT block, provider_id, title FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY provider_id) AS n FROM (SELECT *, {FOLD.format('title')} AS block FROM {{series}})) WHERE n <= 2"""
PARTS["episode_matches"] = f"""
SELECT *, row_number() OVER (PARTITION BY media_file_id ORDER BY total_score DESC, series_provider_id) AS rank
FROM (SELECT *, round({_mean({'1e0': '0.35e0', 'one': '0.4e0', 'es': '0.15e0', 'rs': '0.1e0'})}, 4) AS total_score
  FROM (SELECT c.media_file_id, c.candidate_type, s.provider_id AS series_provider_id, e.provider_id, c.season_number, c.episode_number, 1e0 AS one, r.ratio AS es, {_runtime('c.local_seconds', 'e.runtime_seconds')} AS rs
    FROM {{candidates}} c JOIN {{series}} s ON {FOLD.format('s.title')} = {FOLD.format('c.parsed_series_title')}
    JOIN {{episodes}} e ON e.series_provider_id = s.provider_id AND e.season_number = c.season_number AND e.episode_number = c.episode_number
    LEFT JOIN {{ratios}} r ON r.a = {FOLD.format('c.episode_title')} AND r.b = {FOLD.format('e.episode_title')}
    WHERE c.candidate_type IN ('EPISODE', 'SPECIAL')))"""
PARTS["episode_decisions"] = """
SELECT c.media_file_id, c.candidate_type, t.total_score AS top_score, round(t.total_score - coalesce(s.total_score, 0), 4) AS gap,
  CASE WHEN coalesce(t.total_score, 0) < 0.6 THEN 'NO_MATCH' WHEN t.total_score >= 0.9 AND round(t.total_score - coalesce(s.total_score, 0), 4) >= 0.1 AND c.candidate_type = 'EPISODE' THEN 'RESOLVED' ELSE 'REVIEW_REQUIRED' END AS status
FROM {candidates} c LEFT JOIN {episode_matches} t ON t.media_file_id = c.media_file_id AND t.rank = 1 LEFT JOIN {episode_matches} s ON s.media_file_id = c.media_file_id AND s.rank = 2
WHERE c.candidate_type IN ('EPISODE', 'SPECIAL')"""


def _shows(c):
    return c.candidates.where(F.col("candidate_type").isin("EPISODE", "SPECIAL"))


@query("w02_episode_rank", "SELECT media_file_id, rank, series_provider_id, provider_id FROM {episode_matches}")
def _(c):
    rows = linkage.episode_ranks(_shows(c), c.series, c.episodes)
    return rows.select("media_file_id", F.col("rank").cast("long").alias("rank"), "series_provider_id", "provider_id")


@query("g07_episode_score", """
SELECT media_file_id, rank, provider_id, season_number, episode_number, round(es, 4) AS episode_title_score, rs AS runtime_score, total_score FROM {episode_matches}
""")
def _(c):
    rows = linkage.episode_ranks(_shows(c), c.series, c.episodes)
    return rows.withColumn("rank", F.col("rank").cast("long")).drop("series_provider_id")


@query("w04_series_short_list", "SELECT block, provider_id AS series_provider_id, title AS series_title FROM {short_list}")
def _(c):
    return linkage.series_short_list(c.series)


@query("w04_series_rank_on_hits", f"""
SELECT media_file_id, series_provider_id, round(ratio, 6) AS similarity, series_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY media_file_id ORDER BY ratio DESC, series_provider_id) AS series_rank FROM (
    SELECT DISTINCT c.media_file_id, s.provider_id AS series_provider_id, r.ratio FROM {{candidates}} c JOIN {{lineitem}} l ON l.l_orderkey = c.media_file_id JOIN {{series}} s ON s.provider_id = l.l_partkey
    JOIN {{ratios}} r ON r.a = {FOLD.format('c.parsed_series_title')} AND r.b = {FOLD.format('s.title')})) WHERE series_rank <= 2
""")
def _(c):
    hits = c.lineitem.select(F.col("l_orderkey").alias("media_file_id"), F.col("l_partkey").alias("series_provider_id")).distinct()
    pairs = c.candidates.where("parsed_series_title IS NOT NULL").join(hits, "media_file_id").join(
        c.series.select(F.col("provider_id").alias("series_provider_id"), F.col("title").alias("series_title")), "series_provider_id")
    return linkage.rank_series(pairs).select(
        "media_file_id", "series_provider_id", F.round("similarity", 6).alias("similarity"), F.col("series_rank").cast("long").alias("series_rank"))


@query("g09_episode_decision", """
SELECT media_file_id, status, CASE status WHEN 'RESOLVED' THEN 'HIGH' WHEN 'REVIEW_REQUIRED' THEN 'MEDIUM' END AS confidence,
  CASE WHEN top_score IS NULL THEN 'no provider series/episode results' WHEN status = 'NO_MATCH' THEN printf('top score %.4f below minimum plausible threshold 0.6', top_score)
    WHEN status = 'RESOLVED' THEN printf('top score %.4f >= 0.9', top_score) || printf('; score gap %.4f >= 0.1', gap) || '; exact season/episode match, no provider type conflict'
    ELSE printf('top score %.4f is plausible but did not meet the auto-resolve bar', top_score) || CASE WHEN gap < 0.1 THEN printf('; score gap %.4f below 0.1 -- competing series/episode result', gap) ELSE '' END
      || CASE WHEN candidate_type = 'SPECIAL' THEN '; local candidate is SPECIAL/EXTRA; provider mapping requires review' ELSE '' END END AS reasons
FROM {episode_decisions}
""")
def _(c):
    return _decision(linkage.decide(linkage.match_shows(_shows(c), c.series, c.episodes), "EPISODE"))


PARTS["evaluated"] = """
SELECT c.media_file_id, CASE WHEN c.candidate_type IN ('UNKNOWN', 'EXTRA') THEN 'SKIPPED' WHEN c.media_file_id % 101 = 0 THEN 'FAILED' ELSE coalesce(m.status, e.status) END AS status,
  CASE WHEN c.candidate_type IN ('UNKNOWN', 'EXTRA') THEN NULL WHEN c.candidate_type = 'MOVIE' THEN c.parsed_title ELSE c.parsed_series_title END AS query_text,
  CASE WHEN c.candidate_type = 'MOVIE' THEN c.parsed_year END AS query_year,
  CASE WHEN c.candidate_type NOT IN ('UNKNOWN', 'EXTRA') AND c.media_file_id % 101 = 0 THEN 'timeout' END AS error_message
FROM {candidates} c LEFT JOIN {movie_decisions} m ON m.media_file_id = c.media_file_id LEFT JOIN {episode_decisions} e ON e.media_file_id = c.media_file_id"""


def _errors(candidates):
    return candidates.where("media_file_id % 101 = 0").select("media_file_id", F.lit("timeout").alias("error_message"))


def _searched(c):
    return c.candidates, c.movies, c.series, c.episodes, _errors(c.candidates)


def evaluated(c):
    return linkage.evaluate(*_searched(c))


@query("g10_attempt_status", "SELECT media_file_id, status, query_text, query_year, error_message FROM {evaluated}")
def _(c):
    return evaluated(c).select("media_file_id", "status", "query_text", "query_year", "error_message")


@query("r11_record_attempts", """
SELECT e.media_file_id, e.status, count(x.rank) AS matches, count(*) FILTER (WHERE x.rank = 1 AND e.status = 'RESOLVED') AS selected, min(CASE WHEN x.rank = 1 AND e.status = 'RESOLVED' THEN x.provider_id END) AS selected_provider_id
FROM {evaluated} e LEFT JOIN (SELECT media_file_id, rank, provider_id FROM {exact_matches} UNION ALL SELECT media_file_id, rank, provider_id FROM {episode_matches}) x ON x.media_file_id = e.media_file_id AND e.status NOT IN ('SKIPPED', 'FAILED')
GROUP BY e.media_file_id, e.status
""")
def _(c):
    attempts, episodes, shared = record(c)
    held = episodes.groupBy(*linkage.KEY).agg(F.count(F.lit(1)).alias("own"))
    own = linkage.attempt_keys(c.candidates, _searched(c)[-1]).join(held, linkage.KEY).select("media_file_id", "own")
    each = shared.groupBy(F.col("query_block").alias("block"), F.col("query_year").alias("year")).agg(F.count(F.lit(1)).alias("others"))
    on = (F.col("query_block") == F.col("block")) & F.col("query_year").eqNullSafe(F.col("year"))
    counted = attempts.join(own, "media_file_id", "left").join(each, on, "left")
    total = F.size("compared") + F.coalesce("others", F.lit(0)) + F.coalesce("own", F.lit(0))
    return counted.select("media_file_id", "status", total.alias("matches"), F.col("selected_match_id").isNotNull().cast("long").alias("selected"),
                          F.col("selected_match.provider_id").alias("selected_provider_id"))


def attempted(c):
    """Attempts of all candidates, as a run appends them. Its inputs are tables, and so is what goes from step to step."""
    candidates, movies, series, episodes = (written(df) for df in (c.candidates, c.movies, c.series, c.episodes))
    attempts = linkage.evaluate(candidates, movies, series, episodes, _errors(candidates), keep=written)
    return written(linkage.recorded_attempts(attempts, run_ts()))


def record(c):
    """Attempts of all candidates with what they share: the episodes of a key and the results of a query."""
    candidates, movies, series, episodes, errors = _searched(c)
    return attempted(c), written(linkage.shared_episodes(candidates, series, episodes, errors)), written(linkage.shared_matches(candidates, movies, errors))


# Series the provider returned per file, titles unequal: the best few by similarity have their episodes compared.
_S = FOLD.format("c.parsed_series_title")
PARTS["series_hits"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_file_id ORDER BY ratio DESC, series_provider_id) AS series_rank FROM (
  SELECT DISTINCT c.media_file_id, s.provider_id AS series_provider_id, r.ratio FROM {{candidates}} c JOIN {{lineitem}} l ON l.l_orderkey = c.media_file_id
  JOIN {{series}} s ON s.provider_id = l.l_partkey OR s.provider_id = c.media_file_id % (SELECT count(*) FROM {{part}}) JOIN {{ratios}} r ON r.a = {_S} AND r.b = {FOLD.format('s.title')}
  WHERE c.candidate_type IN ('EPISODE', 'SPECIAL'))) WHERE series_rank <= 2"""
PARTS["hit_episodes"] = f"""
SELECT *, row_number() OVER (PARTITION BY media_file_id ORDER BY total_score DESC, series_provider_id) AS rank
FROM (SELECT *, round({_mean({'ratio': '0.35e0', 'one': '0.4e0', 'es': '0.15e0', 'rs': '0.1e0'})}, 4) AS total_score
  FROM (SELECT h.media_file_id, h.series_provider_id, h.ratio, e.provider_id, 1e0 AS one, r.ratio AS es, {_runtime('c.local_seconds', 'e.runtime_seconds')} AS rs
    FROM {{series_hits}} h JOIN {{candidates}} c ON c.media_file_id = h.media_file_id
    JOIN {{episodes}} e ON e.series_provider_id = h.series_provider_id AND e.season_number = c.season_number AND e.episode_number = c.episode_number
    LEFT JOIN {{ratios}} r ON r.a = {FOLD.format('c.episode_title')} AND r.b = {FOLD.format('e.episode_title')}))"""


def _series_hits(c):
    total = c.part.count()
    given = c.lineitem.select(F.col("l_orderkey").alias("media_file_id"), F.col("l_partkey").alias("series_provider_id"))
    own = given.select("media_file_id", (F.col("media_file_id") % total).alias("series_provider_id"))
    return given.union(own).distinct().join(
        c.series.select(F.col("provider_id").alias("series_provider_id"), F.col("title").alias("series_title")), "series_provider_id")


@query("g07_episode_score_on_hits", "SELECT media_file_id, rank, series_provider_id, provider_id, round(ratio, 4) AS title_score, total_score FROM {hit_episodes}")
def _(c):
    pairs = _shows(c).where("parsed_series_title IS NOT NULL").join(_series_hits(c), "media_file_id")
    return _rows(linkage.match_episode_pairs(pairs, c.episodes), "series_provider_id", "provider_id", "title_score", "total_score")


@query("g10_attempts_on_hits", """
SELECT c.media_file_id, c.candidate_id, CASE WHEN c.candidate_type IN ('UNKNOWN', 'EXTRA') THEN 0 WHEN c.candidate_type = 'MOVIE' THEN m.n ELSE coalesce(e.n, 0) END AS result_count,
  CASE WHEN c.candidate_type = 'MOVIE' THEN m.best ELSE e.best END AS best_id
FROM {candidates} c LEFT JOIN (SELECT media_file_id, count(*) AS n, min(CASE WHEN rank = 1 THEN provider_id END) AS best FROM {hit_matches} GROUP BY media_file_id) m ON m.media_file_id = c.media_file_id
LEFT JOIN (SELECT media_file_id, count(*) AS n, min(CASE WHEN rank = 1 THEN provider_id END) AS best FROM {hit_episodes} GROUP BY media_file_id) e ON e.media_file_id = c.media_file_id
WHERE c.candidate_type <> 'MOVIE' OR m.n IS NOT NULL
""")
def _(c):
    given = c.hits.select("media_file_id", "position", "provider_id", "title", "original_title", "release_year", "popularity", "runtime_seconds")
    asked = c.candidates.join(given.select("media_file_id").distinct().withColumn("__hit", F.lit(True)), "media_file_id", "left").where(
        "candidate_type <> 'MOVIE' OR __hit").drop("__hit")
    attempts = linkage.evaluate(asked, c.movies, c.series, c.episodes, movie_hits=given, series_hits=_series_hits(c), keep=written)
    return attempts.select("media_file_id", "candidate_id", "result_count", F.get("matches", F.lit(0))["provider_id"].alias("best_id"))
