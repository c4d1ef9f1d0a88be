"""Listing the files of an export as rows.

Spark's file sources skip hidden, underscore and empty files, all of which an export
may hold and the catalog must keep, so a small Python data source does the listing. The
driver lists folders level by level only until there are enough of them to deal out; the
tasks list the rest. A filter on the album leaves out all other folders.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith,
)

from mediacat import fixed, schemas
from mediacat.operators import archives
from mediacat.sources.mounts import Mount

#: Listings dealt out unless told otherwise, and folders the driver lists at most for that.
_UNITS, _PLANNED = 256, 2_000


def scan_root(root: str) -> str:
    """The album folder of an export, or ``root`` itself when it is not laid out as one."""
    inside = f"{root.rstrip('/')}/{fixed.EXPORT_SUBFOLDER}"
    return inside if Mount(root).is_folder(fixed.EXPORT_SUBFOLDER) else root


class _Folders(InputPartition):
    """Folders (relative path, with all below or not) that one task lists."""

    def __init__(self, units: list[tuple[str, bool]]):
        self.units = units


class FileInventoryReader(DataSourceReader):
    """Rows of (path, album, name, size, mtime), paths relative to the root."""

    def __init__(self, root: str, units: int = _UNITS):
        self.mount = Mount(root).checked()
        self.units = units
        self.albums: list[str] | None = None
        self.beginning = ""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Notes which albums are asked for; Spark still checks every row itself."""
        for f in filters:
            if getattr(f, "attribute", None) != ("album",):
                continue
            if isinstance(f, EqualTo | In):
                albums = list(f.value) if isinstance(f, In) else [f.value]
                self.albums = albums if self.albums is None else [a for a in self.albums if a in albums]
            elif isinstance(f, StringStartsWith):
                self.beginning = max(self.beginning, f.value, key=len)
        return filters

    def _wanted(self, folder: str) -> bool:
        """A folder that holds, or lies above folders that hold, albums asked for."""
        return folder.startswith(self.beginning) or self.beginning.startswith(f"{folder}/" if folder else "")

    def partitions(self) -> list[InputPartition]:
        if self.albums is not None:
            albums = [a for a in set(self.albums) if a is not None and a.startswith(self.beginning)]
            units = [(a, False) for a in sorted(albums) if self.mount.is_folder(a)]
        else:
            units, level, planned = [], [""], 0
            while level and len(units) + len(level) < self.units and planned + len(level) <= _PLANNED:
                planned += len(level)
                units += [(folder, False) for folder in level]
                level = [sub for folder in level for sub in self._subfolders(folder)]
            units += [(folder, True) for folder in level]
        tasks = min(len(units), max(self.units, 1))
        return [_Folders(units[i::tasks]) for i in range(tasks)]

    def _subfolders(self, folder: str) -> list[str]:
        found = [self._below(folder, e) for e in self.mount.entries(folder) if e.type == fs.FileType.Directory]
        return sorted(f for f in found if self._wanted(f))

    @staticmethod
    def _below(folder: str, entry: fs.FileInfo) -> str:
        return f"{folder}/{entry.base_name}" if folder else entry.base_name

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        pending = list(partition.units)
        while pending:
            folder, deep = pending.pop()
            for entry in self.mount.entries(folder):
                path = self._below(folder, entry)
                if entry.type == fs.FileType.File:
                    yield path, folder, entry.base_name, entry.size, entry.mtime.astimezone(timezone.utc)
                elif entry.type == fs.FileType.Directory and deep and self._wanted(path):
                    pending.append((path, True))


class FileInventorySource(DataSource):
    """``spark.read.format("file_inventory").load(root)``, a folder all executors mount or a URI."""

    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return schemas.FILES

    def reader(self, schema) -> DataSourceReader:
        return FileInventoryReader(self.options["path"], int(self.options.get("units", _UNITS)))


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(FileInventorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("file_inventory").load(folder)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """All files of an export below its album folder."""
    return _listing(spark, scan_root(root))


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder that is no export, its own files included."""
    return _listing(spark, folder)


def archive_inventory(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Archives below ``root`` in name order."""
    files = _listing(spark, root)
    if not recursive:
        files = files.filter(F.col("album") == "")
    return archives.archive_inventory(files)
