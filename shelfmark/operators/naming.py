"""File names parsed into identification candidates, and their reconcile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions import paths, release
from shelfmark.operators import reconcile

# Fixed value: stored with every candidate as an audit trail.
PARSER_VERSION = 1

COMPARED_FIELDS = [
    "candidate_type", "parsed_title", "parsed_year", "parsed_series_title", "season_number",
    "episode_number", "episode_numbers", "episode_title", "edition", "part_number",
    "special_type", "confidence", "parser_version", "evidence",
]


def _route(df: DataFrame) -> DataFrame:
    """Which parser a file goes to; neither category nor layout decides for some."""
    movie = F.col("category").isin(*schemas.CATEGORIES_MOVIE) | F.col("layout").isin(*schemas.LAYOUTS_MOVIE)
    tv = F.col("category").isin(*schemas.CATEGORIES_TV) | F.col("layout").isin(*schemas.LAYOUTS_TV)
    return df.withColumn("__route", F.when(movie, "MOVIE").when(tv, "TV").otherwise("OPEN"))


def _movie_columns(df: DataFrame) -> DataFrame:
    """Columns ``__m_*`` for rows of the movie and open routes."""
    mine = F.col("__route").isin("MOVIE", "OPEN")
    in_folder = F.col("layout").isin("movie_folder", "movie_collection_folder")
    df = df.withColumns({
        "__mf": F.when(mine, paths.stem(F.col("filename"))),
        "__mp": F.when(mine & in_folder, paths.parent_name(F.col("parent_directory"))),
    })
    df = release.clean_release(df, "__mf", "__f")
    df = release.clean_release(df, "__mp", "__p")
    f, p = (lambda c: F.col(f"__f_{c}")), (lambda c: F.col(f"__p_{c}"))
    df = df.withColumns({"__f_ok": release.has_real_title(f("title")), "__p_ok": release.has_real_title(p("title"))})
    df = df.withColumns({
        "__m_source": F.when(f("ok") & f("year").isNotNull(), "filename")
        .when(p("ok") & p("year").isNotNull(), "parent_directory")
        .when(f("ok"), "filename").when(p("ok"), "parent_directory"),
        "__m_clash": F.coalesce(f("year") != p("year"), F.lit(False))
        | (f("ok") & p("ok") & ~release.titles_similar(f("title"), p("title"))),
    })
    source, clash = F.col("__m_source"), F.col("__m_clash")
    chosen = lambda c: F.when(source == "filename", f(c)).when(source == "parent_directory", p(c))
    df = df.withColumns({"__m_title": chosen("title"), "__m_year": chosen("year")})
    title, year = F.col("__m_title"), F.col("__m_year")
    # Part number 0 counts as absent on the file side, as the folder's then applies.
    part = F.coalesce(F.nullif(f("part_number"), F.lit(0)), p("part_number"))
    return df.withColumns({
        "__m_type": F.when(title.isNull(), "UNKNOWN").otherwise("MOVIE"),
        "__m_confidence": F.when(title.isNull(), "UNKNOWN").when(clash | release.is_ambiguous(title), "LOW")
        .when(year.isNotNull(), "HIGH").otherwise("MEDIUM"),
        "__m_edition": F.coalesce(f("edition"), p("edition")),
        "__m_part": part,
        "__m_evidence": F.when(mine, F.struct(
            F.when(clash, "title_or_year_mismatch_between_filename_and_folder").alias("conflict"),
            F.nullif(f("title"), F.lit("")).alias("filename_title"), f("year").alias("filename_year"),
            F.nullif(p("title"), F.lit("")).alias("folder_title"), p("year").alias("folder_year"),
            F.sort_array(F.array_union(f("removed_tokens"), p("removed_tokens"))).alias("removed_tokens"),
            source.alias("title_source"), F.when(year.isNotNull(), chosen("year_match")).alias("year_match"),
            F.when(year.isNotNull(), source).alias("year_source"))),
    })


def _tv_columns(df: DataFrame) -> DataFrame:
    """Columns ``__t_*`` for rows of the TV and open routes."""
    mine = F.col("__route").isin("TV", "OPEN")
    layout = F.col("layout")
    parent = paths.parent_name(F.col("parent_directory"))
    series_folder = F.when(layout == "tv_series_folder", parent).when(
        layout == "tv_season_folder", paths.grandparent_name(F.col("parent_directory")))
    df = df.withColumns({
        "__stem": F.when(mine, paths.stem(F.col("filename"))),
        "__fs": F.when(mine & (layout == "tv_season_folder"), release.season_folder_number(parent)),
        "__ff": F.when(mine, series_folder),
    })
    df = df.withColumn("__form", release.season_episode_form(F.col("__stem")))
    stem, form = F.col("__stem"), F.col("__form")
    df = df.withColumns({
        "__hit": release.by_form(form, lambda p: release.first(stem, p)),
        "__head": release.by_form(form, lambda p: release.around(stem, p, "$1")),
        "__tail": release.by_form(form, lambda p: release.around(stem, p, "$2")),
        "__bonus": F.when(form.isNull(), release.first(stem, release.BONUS_PATTERN)),
    })
    for source, name in (("__ff", "__a"), ("__head", "__b"), ("__tail", "__c")):
        df = release.clean_release(df, source, name)
    good = lambda title: F.when((title != "") & ~release.is_ambiguous(title), title)
    hit, bonus, folder_season = F.col("__hit"), F.col("__bonus"), F.col("__fs")
    numbered = form.isNotNull()
    df = df.withColumns({
        "__folder_title": good(F.col("__a_title")), "__file_title": good(F.col("__b_title")),
        "__t_episode_title": F.when(numbered, good(F.col("__c_title"))),
        "__t_season": release.season_of(hit), "__t_episodes": release.episodes_of(form, hit),
    })
    folder_title, file_title, season = F.col("__folder_title"), F.col("__file_title"), F.col("__t_season")
    df = df.withColumns({
        "__t_series": F.when(numbered, F.coalesce(file_title, folder_title)).otherwise(folder_title),
        "__t_clash": F.coalesce(folder_season != season, F.lit(False)),
    })
    series, clash = F.col("__t_series"), F.col("__t_clash")
    return df.withColumns({
        "__t_type": F.when(numbered, F.when(season == 0, "SPECIAL").otherwise("EPISODE"))
        .when(bonus.isNotNull(), "EXTRA").otherwise("UNKNOWN"),
        "__t_confidence": F.when(numbered, F.when(series.isNull() | clash, "LOW").when(
            file_title.isNotNull(), "HIGH").otherwise("MEDIUM"))
        .when(bonus.isNotNull(), F.when(folder_title.isNotNull(), "MEDIUM").otherwise("LOW")).otherwise("UNKNOWN"),
        "__t_special": F.when(season == 0, "season_zero").otherwise(release.bonus_type(bonus)),
        "__t_evidence": F.when(mine, F.struct(
            F.when(clash, "season_mismatch_between_filename_and_season_folder").alias("conflict"),
            season.alias("filename_season"), folder_season.alias("folder_season"),
            F.when(~numbered & bonus.isNull(), folder_title).alias("folder_series_title"),
            F.coalesce(hit, bonus).alias("matched_text"),
            F.coalesce(form, F.when(bonus.isNotNull(), "extra_keyword")).alias("pattern"),
            F.when(numbered, F.when(file_title.isNotNull(), "filename").when(
                folder_title.isNotNull(), "parent_directory")).alias("series_title_source"))),
    })


def parse(files: DataFrame) -> DataFrame:
    """One candidate per file, beside the file's own columns.

    No shuffle: every step is a projection. Files of the other route carry nulls through it.
    An open-route file is a TV candidate when its name says so, a movie when it has a year.
    """
    df = _tv_columns(_movie_columns(_route(files)))
    route = F.col("__route")
    df = df.withColumn("__movie", (route == "MOVIE") | (
        (route == "OPEN") & (F.col("__t_type") == "UNKNOWN") & F.col("__m_year").isNotNull()))
    movie = F.col("__movie")
    either = lambda m, t: F.when(movie, F.col(m)).otherwise(F.col(t))
    of_movie, of_tv = (lambda c: F.when(movie, F.col(c))), (lambda c: F.when(~movie, F.col(c)))
    picked = {
        "candidate_type": either("__m_type", "__t_type"),
        "confidence": either("__m_confidence", "__t_confidence"),
        "parser_version": F.lit(PARSER_VERSION),
        "parsed_title": of_movie("__m_title"), "parsed_year": of_movie("__m_year"),
        "parsed_series_title": of_tv("__t_series"), "season_number": of_tv("__t_season"),
        "episode_number": F.when(~movie, F.get("__t_episodes", F.lit(0))), "episode_numbers": of_tv("__t_episodes"),
        "episode_title": of_tv("__t_episode_title"),
        "edition": of_movie("__m_edition"), "part_number": of_movie("__m_part"), "special_type": of_tv("__t_special"),
        "evidence": F.struct(of_movie("__m_evidence").alias("movie"), of_tv("__t_evidence").alias("tv")),
    }
    # A one-row generator ends the projections: without it a filter on a parsed column is pushed
    # below them and parses every name a second time.
    return df.select(*files.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in picked.items()]))))


def candidates(files: DataFrame) -> DataFrame:
    """Candidates of the ACTIVE files."""
    return parse(files.where(F.col("state") == "ACTIVE")).select("media_file_id", *COMPARED_FIELDS)


def evidence_text(evidence: Column) -> Column:
    """Canonical JSON of a candidate's evidence."""
    from shelfmark.functions.evidence import canonical_json

    m, t = evidence["movie"], evidence["tv"]
    movie = canonical_json(
        {c: m[c] for c in ("title_source", "year_source", "filename_title", "filename_year",
                           "folder_title", "folder_year", "removed_tokens")},
        {"year_match": m["year_match"], "conflict": m["conflict"]})
    shared = {c: t[c] for c in ("pattern", "matched_text", "series_title_source", "filename_season", "folder_season")}
    episode = canonical_json(shared, {"conflict": t["conflict"]})
    bonus = canonical_json({c: t[c] for c in ("pattern", "matched_text")})
    unknown = canonical_json({"pattern": t["pattern"]}, {c: t[c] for c in ("folder_series_title", "folder_season")})
    return (
        F.when(m.isNotNull(), movie)
        .when(t["pattern"] == "extra_keyword", bonus)
        .when(t["pattern"].isNotNull(), episode)
        .otherwise(unknown)
    )


def reconcile_candidates(stored: DataFrame, parsed: DataFrame, run_ts: Column, compared: list[str] = COMPARED_FIELDS) -> DataFrame:
    """Next candidates table with ``outcome``; files no longer parsed keep their row (LEFT)."""
    both = reconcile.pair(stored, parsed, ["media_file_id"])
    seen = F.col("new").isNotNull()
    both = both.withColumn(
        "outcome",
        F.when(F.col("old").isNull(), "CREATED").when(~seen, "LEFT")
        .when(reconcile.same(compared), "UNCHANGED").otherwise("UPDATED"))
    changed = F.col("outcome").isin("CREATED", "UPDATED")
    return both.select(
        "media_file_id",
        *[F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in compared],
        F.coalesce("old.created_at", run_ts).alias("created_at"),
        F.when(changed, run_ts).otherwise(F.col("old.updated_at")).alias("updated_at"),
        "outcome",
    )
