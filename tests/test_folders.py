"""The folder source against a small tree."""

import os

import pytest

from shelfmark.sources import folders, listing


@pytest.fixture
def tree(tmp_path):
    files = {
        "movies/Alien (1979)/Alien.mkv": 10, "movies/Alien (1979)/.hidden.mkv": 1, "movies/_odd.mkv": 3, "movies/empty.MP4": 0, "movies/deep/a/b/c/d/end.avi": 7,
        "movies/@eaDir/thumb.mkv": 1, "movies/.git/x.mkv": 1, "tv/Show/S01/e1.mkv": 4, "tv/Show/S01/~e2.mkv": 4, "tv/notes.txt": 2, "tv/Ünï/ö.mkv": 5}
    for name, size in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    os.symlink(tmp_path / "tv", tmp_path / "movies" / "link")
    os.symlink(tmp_path / "tv" / "notes.txt", tmp_path / "movies" / "link.mkv")
    (tmp_path / "void").mkdir()
    return tmp_path


@pytest.mark.parametrize("shares", [1, 3, 64])
def test_files_below_the_roots(spark, tree, shares):
    roots = {"movies": f"{tree}/movies", "tv": f"{tree}/tv", "inner": f"{tree}/tv/Show", "void": f"{tree}/void", "gone": f"{tree}/gone"}
    paths, present = folders.listed(spark, roots, shares)
    got = {r.path.removeprefix(str(tree) + "/"): r.length for r in paths.collect()}
    assert got == {
        "movies/Alien (1979)/Alien.mkv": 10, "movies/Alien (1979)/.hidden.mkv": 1, "movies/_odd.mkv": 3, "movies/empty.MP4": 0, "movies/deep/a/b/c/d/end.avi": 7,
        "tv/Show/S01/e1.mkv": 4, "tv/Show/S01/~e2.mkv": 4, "tv/notes.txt": 2, "tv/Ünï/ö.mkv": 5}
    assert paths.count() == len(got)
    assert {r.category: r.exists for r in present.collect()} == {"movies": True, "tv": True, "inner": True, "void": True, "gone": False}
    placed, other = listing.place_paths(paths, roots)
    files = listing.listed_files(placed, present)
    assert sorted((r.category, r.relative_path, r.size_bytes) for r in files.collect()) == [
        ("inner", "S01/e1.mkv", 4), ("movies", "Alien (1979)/Alien.mkv", 10), ("movies", "_odd.mkv", 3), ("movies", "deep/a/b/c/d/end.avi", 7),
        ("movies", "empty.MP4", 0), ("tv", "Ünï/ö.mkv", 5)]
    assert other.count() == 0
    counts = {r.category: (r.file_count, r.exists) for r in listing.roots_with_files(files, present).collect()}
    assert counts == {"movies": (4, True), "tv": (1, True), "inner": (1, True), "void": (0, True), "gone": (0, False)}


def test_work_is_shared_out(tree):
    reader = folders._Reader([f"{tree}/movies", f"{tree}/tv"], 2)
    shares = reader.partitions()
    assert len(shares) == 2 and all(s.whole or s.flat for s in shares)
    assert folders._Reader([f"{tree}/gone"], 4).partitions() == []
