"""Column functions over the catalog and over free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions import evidence, paths, release, scores, titles, unicode
from workload.registry import PARTS, query

# A stem of every file name and page address: dotted, dashed, bracketed and plain text.
PARTS["stems"] = """
SELECT 'f' || media_file_id AS row_id, regexp_replace(regexp_extract(relative_path, '[^/]*$'), '[.][^.]+$', '') AS raw FROM {files}
UNION ALL SELECT 'u' || page_id, url FROM {pages}"""


def _stems(c):
    files = c.files.select(F.concat(F.lit("f"), "media_file_id").alias("row_id"), paths.stem(F.col("filename")).alias("raw"))
    return files.unionByName(c.pages.select(F.concat(F.lit("u"), "page_id").alias("row_id"), F.col("url").alias("raw")))


CLEAN = "trim(regexp_replace(regexp_replace({0}, '[._]+', ' ', 'g'), '\\s+', ' ', 'g'), ' -')"
EDITIONS = r"\b(director''s cut|directors cut|extended edition|final cut|theatrical cut|unrated|special edition|collector''s edition|collectors edition|remastered)\b"
PART = r"\b(?:part|pt)\.?\s*(\d{{1,2}})\b|\bcd\s*(\d{{1,2}})\b|\bdisc\s*(\d{{1,2}})\b"
TOKENS = r"\b(2160p|1080p|720p|480p|4K|BluRay|BRRip|WEB-DL|WEBRip|HDTV|DVD|Dolby Vision|DV|HDR|x264|x265|HEVC|AVC|TrueHD|Atmos|DTS|AAC|Remux)\b"
BARE_YEAR = r"(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|$)"
EDITION_LABEL = ("CASE lower({0}) WHEN 'directors cut' THEN 'Director''s Cut' WHEN 'director''s cut' THEN 'Director''s Cut' "
                 "WHEN 'collectors edition' THEN 'Collector''s Edition' WHEN 'collector''s edition' THEN 'Collector''s Edition' "
                 "WHEN 'extended edition' THEN 'Extended Edition' WHEN 'final cut' THEN 'Final Cut' WHEN 'theatrical cut' THEN 'Theatrical Cut' "
                 "WHEN 'unrated' THEN 'Unrated' WHEN 'special edition' THEN 'Special Edition' WHEN 'remastered' THEN 'Remastered' END")


def clean_release_sql(source: str, keep: str) -> str:
    """The release-text steps as nested SELECTs over ``raw``, keeping the columns ``keep``.

    RE2 has no look-around, so the first bare year is found with its neighbours and cut out by
    position.
    """
    return rf"""
SELECT {keep}, year, year_match, {EDITION_LABEL.format('edition_hit')} AS edition,
  CAST(nullif(regexp_extract(part_hit, '[0-9]+'), '') AS INT) AS part_number,
  {CLEAN.format(f"regexp_replace(t4, '(?i){TOKENS}', ' ', 'g')")} AS title,
  regexp_extract_all(t4, '(?i){TOKENS}') AS removed_tokens
FROM (SELECT *, nullif(regexp_extract(t3, '(?i){PART}', 0), '') AS part_hit,
    CASE WHEN regexp_extract(t3, '(?i){PART}', 0) = '' THEN t3 ELSE
      left(t3, strpos(t3, regexp_extract(t3, '(?i){PART}', 0)) - 1) || ' ' || substr(t3, strpos(t3, regexp_extract(t3, '(?i){PART}', 0)) + length(regexp_extract(t3, '(?i){PART}', 0))) END AS t4
  FROM (SELECT *, nullif(regexp_extract(t2, '(?i){EDITIONS}', 0), '') AS edition_hit,
      CASE WHEN regexp_extract(t2, '(?i){EDITIONS}', 0) = '' THEN t2 ELSE
        left(t2, strpos(t2, regexp_extract(t2, '(?i){EDITIONS}', 0)) - 1) || ' ' || substr(t2, strpos(t2, regexp_extract(t2, '(?i){EDITIONS}', 0)) + length(regexp_extract(t2, '(?i){EDITIONS}', 0))) END AS t3
    FROM (SELECT *, CAST(regexp_extract(year_match, '[0-9]+') AS INT) AS year,
        CASE WHEN year_match IS NULL THEN t1
          WHEN bare THEN left(t1, spot - 1) || ' ' || substr(t1, spot + 4)
          ELSE left(t1, strpos(t1, year_match) - 1) || ' ' || substr(t1, strpos(t1, year_match) + length(year_match)) END AS t2
      FROM (SELECT *, CASE WHEN bare THEN strpos(t1, around) + strpos(around, year_match) - 1 END AS spot
        FROM (SELECT *, y1 = '' AND y2 = '' AS bare, regexp_extract(t1, '{BARE_YEAR}', 0) AS around,
            nullif(CASE WHEN y1 <> '' THEN y1 WHEN y2 <> '' THEN y2 ELSE regexp_extract(t1, '{BARE_YEAR}', 1) END, '') AS year_match
          FROM (SELECT *, regexp_extract(t1, '\((?:19|20)[0-9]{{{{2}}}}\)') AS y1, regexp_extract(t1, '\[(?:19|20)[0-9]{{{{2}}}}\]') AS y2
            FROM (SELECT *, {CLEAN.format('raw')} AS t1 FROM {source})))))))"""


PARTS["released"] = clean_release_sql("{stems}", "row_id, raw")


@query("f01_layout", "SELECT media_file_id, layout FROM {files}")
def _(c):
    return c.files.select("media_file_id", paths.layout(F.col("category"), F.col("relative_path")).alias("layout"))


@query("f02_path_parts", r"""
SELECT media_file_id, list_extract(string_split(absolute_path, '/'), -1) AS filename, list_extract(string_split(absolute_path, '/'), -2) AS parent_name,
  list_extract(string_split(absolute_path, '/'), -3) AS grandparent_name, extension AS suffix,
  left(filename, length(filename) - 4) AS stem, len(string_split(absolute_path, '/')) AS depth
FROM {files}
""")
def _(c):
    path = F.col("absolute_path")
    folder = paths.parent_directory(path)
    return c.files.select(
        "media_file_id", paths.file_name(path).alias("filename"), paths.parent_name(folder).alias("parent_name"),
        paths.grandparent_name(folder).alias("grandparent_name"), paths.suffix(paths.file_name(path)).alias("suffix"),
        paths.stem(paths.file_name(path)).alias("stem"), paths.depth(path).cast("long").alias("depth"))


@query("f03_clean_separators", "SELECT row_id, " + CLEAN.format("raw") + " AS cleaned FROM {stems}")
def _(c):
    return _stems(c).select("row_id", release.clean_separators(F.col("raw")).alias("cleaned"))


@query("f04_year", "SELECT row_id, year, year_match FROM {released}")
def _(c):
    df = _stems(c).withColumn("year_match", release.year_match(release.clean_separators(F.col("raw"))))
    return df.select("row_id", release.year_of(F.col("year_match")).alias("year"), "year_match")


@query("f05_edition", rf"""
SELECT doc_id AS row_id, nullif(regexp_extract(text, '(?i){EDITIONS}'), '') IS NOT NULL AS found FROM {{documents}}
""")
def _(c):
    hit = release.first(F.col("text"), release.EDITION_PATTERN)
    return c.documents.select(F.col("doc_id").alias("row_id"), hit.isNotNull().alias("found"))


@query("f05_edition_labels", "SELECT edition, count(*) AS n FROM {released} GROUP BY edition")
def _(c):
    df = release.clean_release(_stems(c), "raw", "r")
    return df.groupBy(F.col("r_edition").alias("edition")).agg(F.count(F.lit(1)).alias("n"))


@query("f06_part_number", "SELECT row_id, part_number FROM {released}")
def _(c):
    return release.clean_release(_stems(c), "raw", "r").select("row_id", F.col("r_part_number").alias("part_number"))


@query("f07_technical_tokens", "SELECT row_id, array_to_string(removed_tokens, '|') AS removed_tokens FROM {released}")
def _(c):
    return release.clean_release(_stems(c), "raw", "r").select("row_id", F.array_join("r_removed_tokens", "|").alias("removed_tokens"))


@query("f08_release_text", """
SELECT row_id, title, year, year_match, edition, part_number, array_to_string(removed_tokens, '|') AS removed_tokens FROM {released}
""")
def _(c):
    df = release.clean_release(_stems(c), "raw", "r")
    return df.select("row_id", *[F.col(f"r_{n}").alias(n) for n in ("title", "year", "year_match", "edition", "part_number")],
                     F.array_join("r_removed_tokens", "|").alias("removed_tokens"))


@query("f09_title_tests", r"""
SELECT l.l_orderkey, l.l_linenumber, lower(a.p_name) = lower(b.p_name) OR contains(a.p_name, b.p_type) OR contains(lower(b.p_name), lower(a.p_name)) OR contains(lower(a.p_name), lower(b.p_name)) AS similar,
  regexp_matches(trim(CAST(a.p_size AS VARCHAR)), '^[0-9]+$') AS ambiguous
FROM {lineitem} l JOIN {part} a ON a.p_partkey = l.l_partkey JOIN {part} b ON b.p_partkey = l.l_suppkey
""")
def _(c):
    a = c.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("a"), F.col("p_size").cast("string").alias("size"))
    b = c.part.select(F.col("p_partkey").alias("l_suppkey"), F.upper("p_name").alias("b"))
    return c.lineitem.join(a, "l_partkey").join(b, "l_suppkey").select(
        "l_orderkey", "l_linenumber", release.titles_similar(F.col("a"), F.col("b")).alias("similar"),
        release.is_ambiguous(F.col("size")).alias("ambiguous"))


@query("f10_generic_names", """
SELECT media_file_id, lower(left(filename, length(filename) - 4)) NOT IN ('movie', 'movies', 'video', 'film', 'untitled', 'download') AS real_title FROM {files}
""")
def _(c):
    return c.files.select("media_file_id", release.has_real_title(paths.stem(F.col("filename"))).alias("real_title"))


SXX = r"S([0-9]{{1,2}})E([0-9]{{1,3}})(?:-?E[0-9]{{1,3}})*"
WORDS = r"season[\s._-]*([0-9]{{1,2}})[\s._-]*episode[\s._-]*([0-9]{{1,3}})"
CROSS = r"(?:^|[^0-9])([0-9]{{1,2}})x([0-9]{{1,3}})(?:[^0-9]|$)"
PARTS["numbered"] = rf"""
SELECT *, CASE form WHEN 'SxxExx' THEN regexp_extract(raw, '(?i){SXX}') WHEN 'season_episode_words' THEN regexp_extract(raw, '(?i){WORDS}')
    WHEN 'NxNN' THEN regexp_extract(raw, '(?i){CROSS}', 1) || substr(regexp_extract(raw, '(?i)(?:^|[^0-9])[0-9]{{{{1,2}}}}(x)[0-9]', 1), 1, 1) || regexp_extract(raw, '(?i){CROSS}', 2) END AS hit
FROM (SELECT *, CASE WHEN regexp_matches(raw, '(?i){SXX}') THEN 'SxxExx' WHEN regexp_matches(raw, '(?i){WORDS}') THEN 'season_episode_words'
    WHEN regexp_matches(raw, '(?i){CROSS}') THEN 'NxNN' END AS form FROM {{stems}})"""


@query("f11_season_episode", r"""
SELECT row_id, form, hit, CAST(nullif(regexp_extract(hit, '[0-9]+'), '') AS INT) AS season,
  CASE WHEN form = 'SxxExx' THEN array_to_string(list_transform(regexp_extract_all(hit, '(?i)E([0-9]+)', 1), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',')
    WHEN form IS NOT NULL THEN CAST(CAST(regexp_extract(hit, '[0-9]+$') AS INT) AS VARCHAR) END AS episodes
FROM {numbered}
""")
def _(c):
    df = _stems(c).withColumn("form", release.season_episode_form(F.col("raw")))
    df = df.withColumn("hit", release.by_form(F.col("form"), lambda p: release.first(F.col("raw"), p)))
    return df.select("row_id", "form", "hit", release.season_of(F.col("hit")).alias("season"),
                     F.array_join(release.episodes_of(F.col("form"), F.col("hit")), ",").alias("episodes"))


@query("f12_season_folder", r"""
SELECT media_file_id, CAST(nullif(regexp_extract(list_extract(string_split(absolute_path, '/'), -2), '(?i)^season[\s_-]*([0-9]+)$', 1), '') AS INT) AS folder_season FROM {files}
""")
def _(c):
    return c.files.select("media_file_id", release.season_folder_number(paths.parent_name(F.col("parent_directory"))).alias("folder_season"))


@query("f13_bonus_type", r"""
SELECT media_file_id, CASE lower(regexp_extract(filename, '(?i)\b(behind the scenes|deleted scenes|deleted scene|gag reel|bloopers|featurette|interview|trailer|extras|extra)\b'))
  WHEN 'trailer' THEN 'trailer' END AS special_type FROM {files}
""")
def _(c):
    return c.files.select("media_file_id", release.bonus_type(release.first(F.col("filename"), release.BONUS_PATTERN)).alias("special_type"))


FOLD = "regexp_replace(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an) ', '')"


@query("f14_fold_title", f"""
SELECT 'u' || page_id AS row_id, {FOLD.format('url')} AS folded FROM {{pages}}
UNION ALL SELECT 'm' || provider_id, {FOLD.format("coalesce(original_title, title)")} FROM {{movies}}
UNION ALL SELECT 'd' || doc_id, {FOLD.format("regexp_replace(strip_accents(text), '[^ -~\\s]', '', 'g')")} FROM {{documents}}
""")
def _(c):
    fold = lambda df, tag, key, text: df.select(F.concat(F.lit(tag), F.col(key)).alias("row_id"), titles.fold_title(text).alias("folded"))
    return (
        fold(c.pages, "u", "page_id", F.col("url"))
        .unionByName(fold(c.movies, "m", "provider_id", F.coalesce("original_title", "title")))
        .unionByName(fold(c.documents, "d", "doc_id", F.col("text"))))


# Ratcliff-Obershelp on distinct pairs: split at the longest common block (first in a, then in
# b) until no piece has one; the matched length is the sum of the blocks.
PARTS["names"] = f"SELECT DISTINCT {FOLD.format('p_name')} AS t FROM {{part}}"
PARTS["priorities"] = f"SELECT DISTINCT {FOLD.format('o_orderpriority')} AS t FROM {{orders}}"
PARTS["title_pairs"] = f"""
SELECT x.t AS a, y.t AS b FROM {{names}} x, {{names}} y UNION SELECT x.t, y.t FROM {{priorities}} x, {{priorities}} y
UNION SELECT DISTINCT {FOLD.format('parsed_title')}, {FOLD.format('original_title')} FROM {{hits}} WHERE original_title IS NOT NULL
UNION SELECT DISTINCT n.t, {FOLD.format('m.original_title')} FROM {{names}} n JOIN {{movies}} m ON split_part(n.t, ' ', 1) = split_part({FOLD.format('m.original_title')}, ' ', 1)"""
PARTS["blocks"] = """
SELECT * FROM (WITH RECURSIVE piece(a, b, x, y, n) AS (
  SELECT a, b, a, b, 0 FROM {title_pairs}
  UNION ALL
  SELECT a, b, side.x, side.y, side.n FROM (
    SELECT a, b, x, y, unnest(CASE WHEN len(best) = 0 THEN [] ELSE [
      {{'x': left(x, best[2] - 1), 'y': left(y, best[3] - 1), 'n': best[1]}},
      {{'x': substr(x, best[2] + best[1]), 'y': substr(y, best[3] + best[1]), 'n': 0}}] END) AS side
    FROM (SELECT a, b, x, y, coalesce(list_extract(list_sort(list_filter(flatten(list_transform(range(1, length(x) + 1), lambda i:
        list_transform(range(1, length(x) - i + 2), lambda l: [l, -i, -strpos(y, substr(x, CAST(i AS INT), CAST(l AS INT)))]))), lambda t: t[3] < 0), 'DESC'), 1), []) AS raw_best,
        CASE WHEN len(raw_best) = 0 THEN [] ELSE [raw_best[1], -raw_best[2], -raw_best[3]] END AS best
      FROM piece WHERE x <> '' AND y <> '')))
SELECT a, b, sum(n) AS matched FROM piece GROUP BY a, b)"""
PARTS["ratios"] = """
SELECT a, b, CASE WHEN a = b THEN 1.0e0 ELSE 2.0e0 * CAST(matched AS DOUBLE) / (length(a) + length(b)) END AS ratio FROM {blocks}"""


@query("f15_title_similarity", f"""
SELECT h.media_file_id, h.provider_id, round(r.ratio, 6) AS similarity FROM {{hits}} h
JOIN {{ratios}} r ON r.a = {FOLD.format('h.parsed_title')} AND r.b = {FOLD.format('h.title')}
""")
def _(c):
    return titles.with_similarity(c.hits, "parsed_title", "title", "similarity").select(
        "media_file_id", "provider_id", F.round("similarity", 6).alias("similarity"))


@query("f16_year_score", """
SELECT media_file_id, provider_id, CASE WHEN parsed_year IS NULL THEN NULL WHEN release_year IS NULL THEN 0.5e0 WHEN parsed_year = release_year THEN 1.0e0
  WHEN abs(parsed_year - release_year) = 1 THEN 0.6e0 ELSE 0.0e0 END AS year_score FROM {hits}
""")
def _(c):
    return c.hits.select("media_file_id", "provider_id", scores.year_score(F.col("parsed_year"), F.col("release_year")).alias("year_score"))


@query("f17_runtime_score", """
SELECT media_file_id, provider_id, CASE WHEN local_seconds IS NULL OR coalesce(runtime_seconds, 0) = 0 THEN NULL WHEN abs(local_seconds - runtime_seconds) / runtime_seconds <= 0.05 THEN 1.0e0
  WHEN abs(local_seconds - runtime_seconds) / runtime_seconds <= 0.15 THEN 0.6e0 ELSE 0.0e0 END AS runtime_score FROM {hits}
""")
def _(c):
    return c.hits.select("media_file_id", "provider_id", scores.runtime_score(F.col("local_seconds"), F.col("runtime_seconds")).alias("runtime_score"))


@query("f18_weighted_mean", """
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN w = 0 THEN 0e0 ELSE t / w END, 9) AS score FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN l_tax > 0.01 THEN 0.5e0 ELSE 0 END) + (CASE WHEN l_discount > 0.02 THEN 0.35e0 ELSE 0 END) AS w,
    (CASE WHEN l_tax > 0.01 THEN l_tax * 0.5e0 ELSE 0 END) + (CASE WHEN l_discount > 0.02 THEN l_discount * 0.35e0 ELSE 0 END) AS t FROM {lineitem})
""")
def _(c):
    parts = [(F.when(F.col("l_tax") > 0.01, F.col("l_tax")), 0.5), (F.when(F.col("l_discount") > 0.02, F.col("l_discount")), 0.35)]
    return c.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(scores.weighted_mean(parts), 9).alias("score"))


@query("f19_safe_component", r"""
SELECT identity_id, CASE WHEN t IN ('CON', 'AUX') THEN '_' || t ELSE nullif(t, '') END AS component FROM (
  SELECT identity_id, rtrim(trim(regexp_replace(replace(title, '/', '-'), ' +', ' ', 'g')), '. ') AS t FROM {identities})
UNION ALL SELECT 100000000 + page_id, nullif(rtrim(trim(regexp_replace(replace(replace(url, '/', '-'), '\', '-'), ' +', ' ', 'g')), '. '), '') FROM {pages}
""")
def _(c):
    return c.identities.select("identity_id", paths.safe_component(F.col("title")).alias("component")).unionByName(
        c.pages.select((F.lit(100000000) + F.col("page_id")).alias("identity_id"), paths.safe_component(F.col("url")).alias("component")))


# The words of all texts with their accents taken apart.
_APART = {"é": "e\u0301", "è": "e\u0300", "ê": "e\u0302", "ç": "c\u0327", "ñ": "n\u0303", "í": "i\u0301", "ó": "o\u0301", "ä": "a\u0308", "ö": "o\u0308", "ü": "u\u0308"}


def _apart_sql(text: str) -> str:
    for whole, parts in _APART.items():
        text = f"replace({text}, '{whole}', '{parts}')"
    return text


@query("f19_composed_words", f"""
SELECT nfc_normalize(word) AS composed, count(*) AS words FROM (SELECT unnest(string_split({_apart_sql('text')}, ' ')) AS word FROM {{documents}}) GROUP BY 1
""")
def _(c):
    text = F.col("text")
    for whole, parts in _APART.items():
        text = F.replace(text, F.lit(whole), F.lit(parts))
    words = c.documents.select(F.explode(F.split(text, " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy(unicode.composed(F.col("word")).alias("composed")).agg(F.sum("n").alias("words"))


@query("f20_stems_and_tags", """
SELECT identity_id, title || ' (' || release_year || ')' AS movie_stem,
  'S' || lpad(CAST(season_number AS VARCHAR), 2, '0') || 'E' || lpad(CAST(episode_number AS VARCHAR), 2, '0') AS tag,
  title || ' - S' || lpad(CAST(season_number AS VARCHAR), 2, '0') || 'E' || lpad(CAST(episode_number AS VARCHAR), 2, '0') || coalesce(' - ' || episode_title, '') AS episode_stem
FROM {identities}
""")
def _(c):
    tag = F.when(F.col("season_number").isNotNull(), paths.episode_tag(F.col("season_number"), F.array("episode_number")))
    return c.identities.select(
        "identity_id", F.when(F.col("release_year").isNotNull(), paths.movie_stem(F.col("title"), F.col("release_year"))).alias("movie_stem"),
        tag.alias("tag"), F.when(tag.isNotNull(), paths.episode_stem(F.col("title"), tag, F.col("episode_title"))).alias("episode_stem"))


@query("f20_extension", """
SELECT media_file_id, CASE WHEN extension = '.mkv' THEN '.mkv' END AS dotted, CASE WHEN extension = '.mkv' THEN '.mkv' END AS undotted FROM {files}
""")
def _(c):
    return c.files.select("media_file_id", paths.dotted_extension(F.upper("extension")).alias("dotted"),
                          paths.dotted_extension(F.regexp_replace("extension", "[.]", "")).alias("undotted"))


@query("f21_enum_rank", """
SELECT media_file_id, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'INFO' THEN 3 ELSE 4 END AS severity_rank FROM {findings}
""")
def _(c):
    return c.findings.select("media_file_id", evidence.rank_in(F.col("severity"), schemas.SEVERITIES).alias("severity_rank"))


@query("f22_confidence_bucket", """
SELECT match_id, CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM {matches}
""")
def _(c):
    return c.matches.select("match_id", scores.confidence_for(F.col("score")).alias("confidence"))


@query("f23_canonical_json", """
SELECT media_file_id, CASE WHEN duration_seconds IS NULL AND container IS NULL THEN '{{"size":' || size_bytes || '}}' ELSE
  '{{' || CASE WHEN container IS NULL THEN '' ELSE '"container":"' || container || '",' END || CASE WHEN duration_seconds IS NULL THEN '' ELSE '"duration":' || duration_seconds || ',' END || '"size":' || size_bytes || '}}' END AS evidence,
  '{{"error":' || coalesce('"' || media_info_error || '"', 'null') || ',"tracks":[' || video_track_count || ',' || audio_track_count || ']}}' AS all_keys
FROM {files}
""")
def _(c):
    return c.files.select(
        "media_file_id",
        evidence.canonical_json({"size": F.col("size_bytes")}, {"duration": F.col("duration_seconds"), "container": F.col("container")}).alias("evidence"),
        evidence.canonical_json({"tracks": F.array("video_track_count", "audio_track_count"), "error": F.col("media_info_error")}).alias("all_keys"))


@query("f24_reasons", """
SELECT media_file_id, provider_id, array_to_string(list_filter([
  CASE WHEN parsed_year IS NULL THEN 'local year unknown' WHEN release_year IS NULL THEN 'candidate release year unknown' WHEN parsed_year = release_year THEN 'exact release year match'
    WHEN abs(parsed_year - release_year) = 1 THEN 'release year off by 1 year' ELSE 'release year mismatch (' || parsed_year || ' vs ' || release_year || ')' END,
  CASE WHEN local_seconds IS NULL OR runtime_seconds IS NULL THEN NULL WHEN abs(local_seconds - runtime_seconds) / runtime_seconds <= 0.05 THEN 'runtime closely matches'
    WHEN abs(local_seconds - runtime_seconds) / runtime_seconds <= 0.15 THEN 'runtime roughly matches' ELSE 'runtime disagrees (' || CAST(local_seconds AS BIGINT) || 's vs ' || runtime_seconds || 's)' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM {hits}
""")
def _(c):
    texts = scores.reasons(scores.year_reason(F.col("parsed_year"), F.col("release_year")),
                           scores.runtime_reason(F.col("local_seconds"), F.col("runtime_seconds")))
    return c.hits.select("media_file_id", "provider_id", F.array_join(texts, "; ").alias("reasons"))


@query("p12_path_under_root", """
SELECT plan_id, destination_directory = destination_library OR destination_directory LIKE destination_library || '/%' AS inside FROM {plans}
""")
def _(c):
    return c.plans.select("plan_id", paths.is_under(F.col("destination_directory"), F.col("destination_library")).alias("inside"))
