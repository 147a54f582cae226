"""A source that lists folders: every file below the roots as (path, length, modified).

    spark.dataSource.register(folders.FolderListing)
    spark.read.format("folders").option("roots", json.dumps(["/nas/movies", "/nas/tv"])).load()

The roots are on a mount that all machines see. The driver looks only as far down as it takes to find enough folders
to share out; what is below them is walked by the tasks. Zero-byte files and any name are listed (``listing`` decides
what counts as media); links are not followed, and folders that never hold media are not entered.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark import schemas

SCHEMA = "path string, length long, modified double"
BATCH = 10_000


class Share(InputPartition):
    """Folders to list: those with everything below them, and those of which only the files are still to be listed."""

    def __init__(self, whole: list[str], flat: list[str]):
        self.whole, self.flat = whole, flat


def _entered(name: str) -> bool:
    return not name.startswith(".") and name not in schemas.IGNORED_DIRECTORIES


def _entries(folder: str) -> tuple[list[str], list[os.DirEntry]]:
    """Subfolders to enter and files of a folder; nothing, where it has gone in the meantime."""
    below, files = [], []
    try:
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_symlink():
                    continue
                if entry.is_dir(follow_symlinks=False):
                    if _entered(entry.name):
                        below.append(entry.path)
                elif entry.is_file(follow_symlinks=False):
                    files.append(entry)
    except FileNotFoundError:
        pass
    return below, files


def _text(path: str) -> str:
    """A path as text; bytes of a name that are no UTF-8 become marks."""
    return os.fsencode(path).decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], shares: int):
        self.roots, self.shares = [os.path.realpath(r) for r in roots], shares

    def partitions(self) -> list[Share]:
        """Folders are opened level by level until there are several for each share; an opened one leaves its files."""
        whole, flat = sorted({r for r in self.roots if os.path.isdir(r)}), []
        inner = [r for r in whole if any(r.startswith(o.rstrip("/") + "/") for o in whole if o != r)]
        whole = [r for r in whole if r not in inner]  # a root below another is listed with it
        while whole and len(whole) < 4 * self.shares:
            level = [below for folder in whole for below in _entries(folder)[0]]
            flat += whole
            whole = level
        return [Share(whole[i::self.shares], flat[i::self.shares]) for i in range(self.shares) if whole[i::self.shares] or flat[i::self.shares]]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, float]] = []
        for entry in self._files(partition):
            try:
                stat = entry.stat(follow_symlinks=False)
            except FileNotFoundError:
                continue
            rows.append((_text(entry.path), stat.st_size, stat.st_mtime))
            if len(rows) == BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _files(partition: Share) -> Iterator[os.DirEntry]:
        for folder in partition.flat:
            yield from _entries(folder)[1]
        waiting = list(partition.whole)
        while waiting:
            below, files = _entries(waiting.pop())
            waiting += below
            yield from files

    @staticmethod
    def _batch(rows: list[tuple[str, int, float]]) -> pa.RecordBatch:
        path, length, modified = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(length, pa.int64()), pa.array(modified, pa.float64())],
                                          ["path", "length", "modified"])


class FolderListing(DataSource):
    """Options: ``roots``, a JSON list of folders, and ``shares``, how many tasks list (64)."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["roots"]), int(self.options.get("shares", 64)))


def listed(spark: SparkSession, categories: dict[str, str], shares: int = 64) -> tuple[DataFrame, DataFrame]:
    """(paths, roots): what lies below the roots, for ``listing.place_paths``, and (category, root_path, exists) of
    each configured root. A root that is missing lists nothing."""
    spark.dataSource.register(FolderListing)
    paths = spark.read.format("folders").option("roots", json.dumps(list(categories.values()))).option("shares", shares).load()
    roots = [(c, r, os.path.isdir(r)) for c, r in categories.items()]
    return paths, spark.createDataFrame(roots, "category string, root_path string, exists boolean")
