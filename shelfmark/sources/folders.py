"""Inventory of mounted folders as a Spark data source: sub-folders are partitions, listed by the executors.

One row per file, and one per entry that could not be listed or looked at, so that an unreadable folder does not look
like deleted files. `presence` is what `missing_tracks` and `detect_moves` ask for: `present`; `absent` for a file that
went away between listing and looking; `unknown` for an entry that raised another error, named in `error`.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

INVENTORY = "path string, size bigint, mtime_ns bigint, ctime_ns bigint, presence string, error string"


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


def _failed(path: str, error: OSError) -> tuple:
    gone = isinstance(error, FileNotFoundError)
    return (path, None, None, None, "absent" if gone else "unknown", None if gone else type(error).__name__)


def _look(path: str) -> tuple:
    try:
        s = os.stat(path)
    except OSError as e:
        return _failed(path, e)
    return (path, s.st_size, s.st_mtime_ns, s.st_ctime_ns, "present", None)


def _walk(path: str, deep: bool) -> Iterator[tuple]:
    """Files below a folder, or only those in it; folders are listed one after another, never all at once."""
    waiting = [path]
    while waiting:
        at = waiting.pop()
        try:
            entries = sorted(os.scandir(at), key=lambda e: e.name)
        except OSError as e:
            yield _failed(at, e)
            continue
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                if deep:
                    waiting.append(e.path)
            else:
                yield _look(e.path)


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self) -> list[InputPartition]:
        """The sub-folders of each root, and each root's own files."""
        out: list[InputPartition] = []
        for root in self.roots:
            out.append(_Folder(root, False))
            if os.path.isdir(root):
                try:
                    out += [_Folder(e.path, True) for e in os.scandir(root) if e.is_dir(follow_symlinks=False)]
                except OSError:
                    pass  # the executor that lists the root reports it
        return out

    def read(self, partition: _Folder) -> Iterator[tuple]:
        yield from [_look(partition.path)] if os.path.isfile(partition.path) else _walk(partition.path, partition.deep)


class FolderInventory(DataSource):
    """spark.read.format("folder_inventory").option("roots", "/a\\n/b"); a root may be one file."""

    @classmethod
    def name(cls) -> str:
        return "folder_inventory"

    def schema(self) -> str:
        return INVENTORY

    def reader(self, schema) -> DataSourceReader:
        return _Reader([r for r in self.options["roots"].split("\n") if r])


def folder_inventory(spark: SparkSession, roots: list[str]) -> DataFrame:
    """INVENTORY rows of all files below mounted roots that do not lie in each other."""
    spark.dataSource.register(FolderInventory)
    return spark.read.format("folder_inventory").option("roots", "\n".join(roots)).load()
