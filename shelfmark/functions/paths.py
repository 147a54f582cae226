"""Path columns: parts, layout, containment, safe destination components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions import unicode


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def layout(category: Column, relative_path: Column) -> Column:
    """How a file sits below its category root, by path depth."""
    d = depth(relative_path)
    is_movie, is_tv = category.isin(*schemas.CATEGORIES_MOVIE), category.isin(*schemas.CATEGORIES_TV)
    return (
        F.when(is_movie & (d == 1), "movie_flat")
        .when(is_movie & (d == 2), "movie_folder")
        .when(is_movie & (d == 3), "movie_collection_folder")
        .when(is_tv & (d == 2), "tv_series_folder")
        .when(is_tv & (d == 3), "tv_season_folder")
        .otherwise("unknown")
    )


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def parent_directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def parent_name(directory: Column) -> Column:
    """Last segment of a directory path."""
    return file_name(directory)


def grandparent_name(directory: Column) -> Column:
    return file_name(parent_directory(directory))


def stem(name: Column) -> Column:
    """Name without its last suffix; a leading or trailing dot is no suffix."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def is_under(path: Column, root: Column) -> Column:
    """The path is the root itself or lies below it."""
    base = F.rtrim(root, F.lit("/"))
    return (path == base) | F.startswith(path, F.concat(base, F.lit("/")))


def is_media_extension(extension: Column) -> Column:
    return extension.isin(*schemas.MEDIA_EXTENSIONS)


# Device names that may not be used as a file name.
RESERVED_NAMES = (
    "CON", "PRN", "AUX", "NUL",
    *(f"COM{i}" for i in range(1, 10)),
    *(f"LPT{i}" for i in range(1, 10)),
)
# The place before a reserved name or a leading dot.
_UNUSABLE = rf"\A(?=\.|(?i:{'|'.join(RESERVED_NAMES)})\z)"


def safe_component(raw: Column, composed: bool = False) -> Column:
    """One path segment made safe for a file system; null when nothing usable is left.

    Separators become dashes, unprintables go before white space is collapsed, trailing dots
    and blanks are cut, reserved and hidden names get an underscore. ``composed`` says the
    input is in NFC already.
    """
    text = raw if composed else unicode.composed(raw)
    text = F.regexp_replace(text, r"[/\\]", "-")
    text = F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ ]]", "")
    text = F.trim(F.regexp_replace(text, " +", " "))
    text = F.rtrim(text, F.lit(". "))
    # One expression over the text, named once: every mention of it would run the steps before it again.
    return F.nullif(F.regexp_replace(text, _UNUSABLE, "_"), F.lit(""))


def dotted_extension(extension: Column) -> Column:
    """Lower-case extension with its dot; null when it is no media extension."""
    ext = F.lower(extension)
    ext = F.when(F.startswith(ext, F.lit(".")), ext).otherwise(F.concat(F.lit("."), ext))
    return F.when(is_media_extension(ext), ext)


def movie_stem(title: Column, year: Column) -> Column:
    return F.format_string("%s (%d)", title, year)


def episode_tag(season: Column, episodes: Column) -> Column:
    """S01E02, or S01E02-E04 for a file that holds several episodes."""
    first, last = F.get(episodes, F.lit(0)), F.element_at(episodes, -1)
    single = F.format_string("S%02dE%02d", season, first)
    return F.when(F.size(episodes) > 0, F.when(F.size(episodes) == 1, single).otherwise(
        F.concat(single, F.format_string("-E%02d", last))))


def episode_stem(series: Column, tag: Column, episode_title: Column) -> Column:
    base = F.concat_ws(" - ", series, tag)
    return F.when(F.coalesce(episode_title, F.lit("")) == "", base).otherwise(
        F.concat_ws(" - ", base, episode_title))
