"""Release-name text: separators, years, editions, parts, technical tokens, episodes.

Each step of ``clean_release`` is its own projection, so a pattern runs once per row and the
expression tree stays small. A null text passes through every step untouched, which is how
the parsers skip rows that are not theirs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words and patterns recognised in release names. Longer tokens come first
# where one is a prefix of another.
TECHNICAL_TOKENS = (
    "2160p", "1080p", "720p", "480p", "4K", "BluRay", "BRRip", "WEB-DL", "WEBRip", "HDTV",
    "DVD", "Dolby Vision", "DV", "HDR", "x264", "x265", "HEVC", "AVC", "TrueHD", "Atmos",
    "DTS", "AAC", "Remux",
)
EDITIONS = {
    "director's cut": "Director's Cut",
    "directors cut": "Director's Cut",
    "extended edition": "Extended Edition",
    "final cut": "Final Cut",
    "theatrical cut": "Theatrical Cut",
    "unrated": "Unrated",
    "special edition": "Special Edition",
    "collector's edition": "Collector's Edition",
    "collectors edition": "Collector's Edition",
    "remastered": "Remastered",
}
BONUS_KEYWORDS = {
    "behind the scenes": "behind_the_scenes",
    "deleted scenes": "deleted_scene",
    "deleted scene": "deleted_scene",
    "gag reel": "gag_reel",
    "bloopers": "bloopers",
    "featurette": "featurette",
    "interview": "interview",
    "trailer": "trailer",
    "extras": "extra",
    "extra": "extra",
}
GENERIC_NAMES = ("movie", "movies", "video", "film", "untitled", "download")
YEAR = r"(?:19|20)\d{2}"
YEAR_FORMS = (rf"\({YEAR}\)", rf"\[{YEAR}\]", rf"(?<!\d){YEAR}(?!\d)")
PART = r"\b(?:part|pt)\.?\s*\d{1,2}\b|\bcd\s*\d{1,2}\b|\bdisc\s*\d{1,2}\b"
SEASON_EPISODE = r"S\d{1,2}E\d{1,3}(?:-?E\d{1,3})*"
SEASON_EPISODE_WORDS = r"season[\s._-]*\d{1,2}[\s._-]*episode[\s._-]*\d{1,3}"
CROSS_EPISODE = r"(?<!\d)\d{1,2}x\d{1,3}(?!\d)"
SEASON_FOLDER = r"^season[\s_-]*(\d{1,2})$"

# Case-insensitive with Unicode classes: Java's \b, \d and \s are ASCII without it.
FLAGS = "(?iU)"


def _words(words) -> str:
    return r"\b(?:" + "|".join(re.escape(w).replace(r"\-", "-").replace(r"\ ", " ") for w in words) + r")\b"


TOKEN_PATTERN = _words(TECHNICAL_TOKENS)
EDITION_PATTERN = _words(EDITIONS)
BONUS_PATTERN = _words(BONUS_KEYWORDS)


def first(text: Column, pattern: str) -> Column:
    """First match of the pattern, or null."""
    hit = F.regexp_extract(text, FLAGS + pattern, 0)
    return F.when(hit != "", hit)


def around(text: Column, pattern: str, replacement: str) -> Column:
    """Rewrite the whole text around the first match ($1 before it, $2 after it)."""
    return F.regexp_replace(text, rf"(?isU)^(.*?)(?:{pattern})(.*)$", replacement)


def without_first(text: Column, pattern: str) -> Column:
    return around(text, pattern, "$1 $2")


def lookup(key: Column, table: dict[str, str]) -> Column:
    literals = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*literals), key)


def clean_separators(text: Column) -> Column:
    spaced = F.regexp_replace(text, "[._]+", " ")
    return F.btrim(F.regexp_replace(spaced, r"(?U)\s+", " "), F.lit(" -"))


def year_match(text: Column) -> Column:
    """The substring holding the year: parenthesised, else bracketed, else the first bare one."""
    paren, bracket, bare = YEAR_FORMS
    return F.coalesce(
        F.when(F.contains(text, F.lit("(")), first(text, paren)),
        F.when(F.contains(text, F.lit("[")), first(text, bracket)),
        first(text, bare))


def year_of(match: Column) -> Column:
    return F.regexp_extract(match, r"\d{4}", 0).try_cast("int")


def without_year(text: Column, match: Column) -> Column:
    paren, bracket, bare = YEAR_FORMS
    return (
        F.when(match.isNull(), text)
        .when(F.startswith(match, F.lit("(")), without_first(text, paren))
        .when(F.startswith(match, F.lit("[")), without_first(text, bracket))
        .otherwise(without_first(text, bare))
    )


def edition_of(match: Column) -> Column:
    return lookup(F.lower(match), EDITIONS)


def part_of(match: Column) -> Column:
    return F.regexp_extract(match, r"(?U)\d{1,2}", 0).try_cast("int")


def technical_tokens(text: Column) -> Column:
    """Technical tokens in order of appearance, as written."""
    return F.regexp_extract_all(text, F.lit(FLAGS + TOKEN_PATTERN), F.lit(0))


def without_tokens(text: Column) -> Column:
    return F.regexp_replace(text, FLAGS + TOKEN_PATTERN, " ")


def clean_release(df: DataFrame, source: str, name: str) -> DataFrame:
    """Add ``<name>_title``, ``_year``, ``_year_match``, ``_edition``, ``_part_number`` and
    ``_removed_tokens`` of a text column.

    Plain columns, not a struct: Spark inlines struct members into every later use, which would
    run the patterns again each time.
    """
    t, y, e, p = (f"{name}_{x}" for x in ("text", "year_match", "edition", "part_number"))
    df = df.withColumn(t, clean_separators(F.col(source)))
    df = df.withColumn(y, year_match(F.col(t)))
    df = df.withColumn(t, without_year(F.col(t), F.col(y)))
    df = df.withColumn(e, first(F.col(t), EDITION_PATTERN))
    df = df.withColumn(t, F.when(F.col(e).isNull(), F.col(t)).otherwise(without_first(F.col(t), EDITION_PATTERN)))
    df = df.withColumn(p, first(F.col(t), PART))
    df = df.withColumn(t, F.when(F.col(p).isNull(), F.col(t)).otherwise(without_first(F.col(t), PART)))
    df = df.withColumn(f"{name}_removed_tokens", F.coalesce(technical_tokens(F.col(t)), F.array().cast("array<string>")))
    found = F.size(f"{name}_removed_tokens") > 0
    df = df.withColumn(t, F.when(found, without_tokens(F.col(t))).otherwise(F.col(t)))
    return df.withColumns({
        f"{name}_title": F.coalesce(clean_separators(F.col(t)), F.lit("")),
        f"{name}_year": year_of(F.col(y)),
        e: edition_of(F.col(e)),
        p: part_of(F.col(p)),
    }).drop(t)


def titles_similar(a: Column, b: Column) -> Column:
    """Equal, or one inside the other; a blank side never disagrees."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x == "") | (y == "") | F.contains(x, y) | F.contains(y, x)


def is_ambiguous(title: Column) -> Column:
    """Too weak to be a title: under two characters, or digits only."""
    text = F.trim(title)
    return (F.length(text) < 2) | text.rlike(r"(?U)^\d+$")


def has_real_title(title: Column) -> Column:
    return (title != "") & ~F.lower(F.trim(title)).isin(*GENERIC_NAMES)


def season_episode_form(text: Column) -> Column:
    """Which season/episode notation the text uses, in order of preference."""
    return (
        F.when(text.rlike(FLAGS + SEASON_EPISODE), "SxxExx")
        .when(text.rlike(FLAGS + SEASON_EPISODE_WORDS), "season_episode_words")
        .when(text.rlike(FLAGS + CROSS_EPISODE), "NxNN")
    )


FORM_PATTERNS = {
    "SxxExx": SEASON_EPISODE,
    "season_episode_words": SEASON_EPISODE_WORDS,
    "NxNN": CROSS_EPISODE,
}


def by_form(form: Column, build) -> Column:
    """``build(pattern)`` of the notation in ``form``; null where there is none."""
    return F.coalesce(*[F.when(form == name, build(pattern)) for name, pattern in FORM_PATTERNS.items()])


def season_of(match: Column) -> Column:
    return F.regexp_extract(match, r"(?U)\d+", 0).try_cast("int")


def episodes_of(form: Column, match: Column) -> Column:
    """Every episode number of a matched span, in order."""
    several = F.regexp_extract_all(match, F.lit(r"(?iU)E(\d{1,3})"), F.lit(1))
    single = F.array(F.regexp_extract(match, r"(?U)(\d+)$", 1))
    numbers = F.when(form == "SxxExx", several).when(form.isNotNull(), single)
    return numbers.cast("array<int>")


def season_folder_number(folder: Column) -> Column:
    return F.regexp_extract(F.trim(folder), FLAGS + SEASON_FOLDER, 1).try_cast("int")


def bonus_type(match: Column) -> Column:
    return lookup(F.lower(match), BONUS_KEYWORDS)
