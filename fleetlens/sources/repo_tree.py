"""Data source ``repo_tree``: files of repositories on a file system mounted on all nodes.

``spark.read.format("repo_tree").load(root)`` gives files(repo, path, content) for
``root/<repo>/<path...>``. Unlike Spark's own readers it sees hidden and empty files. Excluded
folders are not entered, unreadable ones are skipped, and only regular files are taken.

Options: ``exclude`` (comma-separated names, default the fixed list), ``units`` (how many pieces
of work to cut the tree into, default 4096).
"""

import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.schemas import FILES
from .files import excluded_names

UNITS = 4096


class Folder(InputPartition):
    """A folder to read: its own files only, or with everything below it."""

    def __init__(self, path: str, deep: bool):
        self.path = path
        self.deep = deep


def _entries(folder: str, hidden):
    """(files, folders) of a folder, without excluded names; nothing if it cannot be read."""
    try:
        with os.scandir(folder) as found:
            kept = sorted((e for e in found if e.name not in hidden), key=lambda e: e.name)
            files = [e.path for e in kept if e.is_file(follow_symlinks=False)]
            folders = [e.path for e in kept if e.is_dir(follow_symlinks=False)]
    except OSError:
        return [], []
    return files, folders


class RepoTreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        named = options.get("exclude")
        self.hidden = set(named.split(",") if named is not None else excluded_names())
        self.units = int(options.get("units", UNITS))

    def partitions(self):
        """Open folders level by level until there are enough pieces.

        A huge repository is opened like any other, so its folders become pieces of their own.
        The driver holds at most one level of folders, never a list of files.
        """
        opened, closed = [], _entries(self.root, set())[1]
        while closed and len(opened) + len(closed) < self.units:
            opened += closed
            closed = [sub for folder in closed for sub in _entries(folder, self.hidden)[1]]
        return [Folder(p, False) for p in opened] + [Folder(p, True) for p in closed]

    def read(self, partition):
        waiting = [partition.path]
        while waiting:
            files, folders = _entries(waiting.pop(), self.hidden)
            if partition.deep:
                waiting += folders
            for name in files:
                try:
                    with open(name, "rb") as source:
                        content = source.read()
                except OSError:
                    continue
                repo, path = name[len(self.root) + 1 :].split("/", 1)
                yield repo, path, content.decode("utf-8", "replace")


class RepoTreeSource(DataSource):
    @classmethod
    def name(cls):
        return "repo_tree"

    def schema(self):
        return FILES

    def reader(self, schema):
        return RepoTreeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepoTreeSource)
