"""Column functions against literals and against plain Python."""

import difflib
import re
import unicodedata
from pathlib import PurePosixPath

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import evidence, paths, release, scores, titles, unicode
from shelfmark.operators import ingest


def values(spark, rows, ddl, *columns):
    df = spark.createDataFrame(rows, ddl)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_path_parts_follow_pathlib(spark):
    names = ["a.mkv", "a.b.MKV", ".hidden", "noext", "dot.", "..x", "a b.c.d", "é.Mp4"]
    got = values(spark, [(n,) for n in names], "n string", paths.stem(F.col("n")), paths.suffix(F.col("n")))
    assert got == [(PurePosixPath(n).stem, PurePosixPath(n).suffix.lower()) for n in names]


def test_layouts(spark):
    rows = [("movies", "a.mkv"), ("movies", "b/a.mkv"), ("kids_movies", "c/b/a.mkv"), ("movies", "d/c/b/a.mkv"),
            ("tv", "a.mkv"), ("tv", "b/a.mkv"), ("fitness", "c/b/a.mkv"), ("incoming", "a.mkv")]
    got = values(spark, rows, "c string, p string", paths.layout(F.col("c"), F.col("p")))
    assert [g[0] for g in got] == ["movie_flat", "movie_folder", "movie_collection_folder", "unknown", "unknown",
                                   "tv_series_folder", "tv_season_folder", "unknown"]


def test_safe_components(spark):
    raw = ["AC/DC: Live", "a\\b", "tab\there", "nb sp", "  two   spaces ", "trail. . ", "...", "", "con", "LPT1", ".hid", "été", "CON.x", "​"]
    want = ["AC-DC: Live", "a-b", "tabhere", "nbsp", "two spaces", "trail", None, None, "_con", "_LPT1", "_.hid", "été", "CON.x", None]
    assert [g[0] for g in values(spark, [(r,) for r in raw], "r string", paths.safe_component(F.col("r")))] == want


def test_path_under_root(spark):
    rows = [("/a/b", "/a/b"), ("/a/b/c", "/a/b/"), ("/a/bc", "/a/b"), ("/a", "/a/b")]
    assert [g[0] for g in values(spark, rows, "p string, r string", paths.is_under(F.col("p"), F.col("r")))] == [True, True, False, False]


def test_episode_tags(spark):
    rows = [(1, [2]), (0, [1, 2, 3]), (12, [104]), (1, [])]
    assert [g[0] for g in values(spark, rows, "s int, e array<int>", paths.episode_tag(F.col("s"), F.col("e")))] == ["S01E02", "S00E01-E03", "S12E104", None]


def test_years(spark):
    rows = ["Blade Runner 2049 2017", "x 1920x1080", "Movie 2160p", "2012 (2009)", "A [1999] 2001", "120490 2049", "(1899) 1901"]
    got = values(spark, [(r,) for r in rows], "t string", release.year_of(release.year_match(F.col("t"))))
    assert [g[0] for g in got] == [2049, 1920, None, 2009, 1999, 2049, 1901]


def test_clean_release(spark):
    rows = ["Some.Film.1999.1080p.BluRay.x264", "Two_Words - Director's Cut (2001)", "Pt. 2 of It", "Saga Part 3 cd 1", "DVD", "Final Cut Dolby Vision web-dl"]
    df = release.clean_release(spark.createDataFrame([(r,) for r in rows], "t string"), "t", "r")
    got = [tuple(r) for r in df.select("r_title", "r_year", "r_edition", "r_part_number", "r_removed_tokens").collect()]
    assert got == [
        ("Some Film", 1999, None, None, ["1080p", "BluRay", "x264"]), ("Two Words", 2001, "Director's Cut", None, []),
        ("of It", None, None, 2, []), ("Saga cd 1", None, None, 3, []), ("", None, None, None, ["DVD"]),
        ("", None, "Final Cut", None, ["Dolby Vision", "web-dl"])]


def test_season_episode_forms(spark):
    rows = ["Show S01E02", "show s1e2-e3E04 x", "Season 2 Episode 11", "season.03_episode-4", "3x07 Name", "1920x1080", "plain", "S01E02 3x04"]
    form = release.season_episode_form(F.col("t"))
    hit = release.by_form(form, lambda p: release.first(F.col("t"), p))
    got = values(spark, [(r,) for r in rows], "t string", form, release.season_of(hit), release.episodes_of(form, hit))
    assert got == [("SxxExx", 1, [2]), ("SxxExx", 1, [2, 3, 4]), ("season_episode_words", 2, [11]), ("season_episode_words", 3, [4]),
                   ("NxNN", 3, [7]), (None, None, None), (None, None, None), ("SxxExx", 1, [2])]


def _fold(title):
    text = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode().lower()
    text = re.sub("[^a-z0-9]+", " ", text).strip()
    for article in ("the ", "a ", "an "):
        if text.startswith(article):
            return text[len(article):]
    return text


def test_fold_title_literals(spark):
    rows = ["The Café", "don’t", "don't", "A The Thing", "ﬁne ½", "Ⅷ", "日本", "Ａｎ Ａｐｐｌｅ", "𝐀𝐛", "Straße"]
    assert [g[0] for g in values(spark, [(r,) for r in rows], "t string", titles.fold_title(F.col("t")))] == [_fold(r) for r in rows]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=12), min_size=20, max_size=40))
def test_fold_title_is_the_same_for_any_text(spark, texts):
    got = values(spark, list(enumerate(texts)), "i int, t string", F.col("i"), titles.fold_title(F.col("t")))
    assert dict(got) == {i: _fold(t) for i, t in enumerate(texts)}


def test_similarity(spark):
    pairs = [("Alien", "alien"), ("The Alien", "Aliens"), ("Aliens", "The Alien"), (None, "x"), ("x", ""), ("!!", "x"), ("night watch", "watch night")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in titles.with_similarity(df, "a", "b", "s").collect()}
    def want(a, b):
        if not a or not b or not _fold(a) or not _fold(b):
            return 0.0
        return difflib.SequenceMatcher(None, _fold(a), _fold(b)).ratio()
    assert got == {i: want(*p) for i, p in enumerate(pairs)}


def test_scores(spark):
    rows = [(1999, 1999, 100.0, 100), (1999, 2000, 105.0, 100), (1999, None, 115.0, 100), (None, 1999, 116.0, 100), (1999, 2005, None, 100), (1999, 1999, 100.0, 0)]
    got = values(spark, rows, "y int, p int, s double, r int", scores.year_score(F.col("y"), F.col("p")), scores.runtime_score(F.col("s"), F.col("r")))
    assert got == [(1.0, 1.0), (0.6, 1.0), (0.5, 0.6), (None, 0.0), (0.0, None), (1.0, None)]


def test_weighted_mean_leaves_missing_parts_out(spark):
    rows = [(1.0, None), (1.0, 0.0), (None, None)]
    got = values(spark, rows, "a double, b double", F.round(scores.weighted_mean([(F.col("a"), 0.5), (F.col("b"), 0.35)]), 4))
    assert [g[0] for g in got] == [1.0, 0.5882, 0.0]


def test_canonical_json(spark):
    rows = [("x", None, [1, 2]), (None, 2.5, [])]
    got = values(spark, rows, "b string, a double, c array<int>",
                 evidence.canonical_json({"b": F.col("b")}, {"a": F.col("a"), "c": F.when(F.size("c") > 0, F.col("c"))}),
                 evidence.canonical_json({}, {"a": F.col("a")}))
    assert got == [('{"b":"x","c":[1,2]}', None), ('{"a":2.5,"b":null}', '{"a":2.5}')]


def test_ratios_of_all_pairs_in_one_pass(spark):
    """Reused second titles, long ones, missing ones, and one Python step with one join for two column pairs."""
    import difflib
    import random

    rng = random.Random(4)
    words = ["red", "stone", "river", "night", "a", "of"]
    name = lambda: rng.choice(["", None, "x" * 210 + "red", *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(12)]])
    rows = [(i, name(), name(), name()) for i in range(400)]
    df = titles.with_similarities(spark.createDataFrame(rows, "i int, a string, b string, c string"), {"ab": ("a", "b"), "ac": ("a", "c")})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- ArrowEvalPython") == 1 and plan.count("Join ") == 1
    want = lambda x, y: 0.0 if not x or not y else 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()
    for r in df.collect():
        a, b, c = map(_fold, (r.a or "", r.b or "", r.c or ""))
        assert (r.ab, r.ac) == (want(a, b), want(a, c))


def test_composition_equals_nfc(spark):
    """Every character that composition may touch alone, and random runs of marks, jamo and plain letters."""
    import random

    rng = random.Random(1)
    odd = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4
           and (unicodedata.normalize("NFD", chr(c)) != chr(c) or unicodedata.combining(chr(c)))]
    pool = [*odd, *["a", "e", "\u1100", "\u1161", "\u11a8", "\uac00", "\uac01", "\u11a7", "\u0301", "\u0327", "\u0345", "\u0338", "<"] * 40]
    texts = [*odd, *["".join(rng.choice(pool) for _ in range(rng.randint(1, 7))) for _ in range(1500)], "", "plain", "\u0301x", "\u00dcn\u00ef"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", unicode.composed(F.col("t")).alias("x")).collect()}
    assert got.pop(-1) is None and got == {i: unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
    plan = df.select(paths.safe_component(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_a_name_is_sanitised_once(spark):
    """However often a name is used, the steps that make it safe stand once in the plan; ASCII texts skip the long class."""
    df = spark.createDataFrame([("Té/st. ", 1, [2], None, "mkv", "/nas/tv")],
                               "title string, season_number int, episode_numbers array<int>, episode_title string, extension string, destination_root string")
    placed = ingest.episode_destination(df)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2 * 4
    assert plan.count("octet_length") == 2
    assert placed.first().full_path == "/nas/tv/Té-st/Season 01/Té-st. - S01E02.mkv"


def test_reserved_and_hidden_names(spark):
    names = {"con": "_con", "Lpt9": "_Lpt9", "CON. ": "_CON", "CONS": "CONS", "xcon": "xcon", ".x": "_.x", " . ": None, "": None, "a\nb": "ab"}
    rows = spark.createDataFrame([(k,) for k in names], "t string").select("t", paths.safe_component(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == names
