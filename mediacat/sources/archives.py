"""Listing the members of archives."""

from __future__ import annotations

import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from mediacat import schemas
from mediacat.sources.content import spread_tasks
from mediacat.sources.mounts import Mount

_BATCH = 10_000


def archive_manifest(archives: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """(archive, format, member, size, crc32) of listed archives.

    Archives are spread over the tasks and their members streamed; only zip members
    carry a checksum. An archive that cannot be opened, or not read to its end, gives a
    row without member, besides those of the members found.
    """
    mount = Mount(root).checked()
    columns, full = ["archive", "format", "member", "size", "crc32"], _BATCH

    def members(path: str, kind: str) -> Iterator[tuple[str, int, int | None]]:
        if kind == "zip":
            with mount.open(path) as handle, zipfile.ZipFile(handle) as archive:
                for info in archive.infolist():
                    yield info.filename, info.file_size, info.CRC
        else:
            with mount.open(path) as handle, tarfile.open(fileobj=handle, mode="r:*") as archive:
                for info in archive:
                    yield info.name, info.size, None

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for path, kind in zip(batch["path"], batch["format"]):
                try:
                    for member in members(path, kind):
                        rows.append((path, kind, *member))
                        if len(rows) == full:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except (OSError, EOFError, zlib.error, zipfile.BadZipFile, tarfile.TarError, pa.ArrowException):
                    rows.append((path, kind, None, None, None))
        yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64", "crc32": "Int64"})

    spread = archives.select("path", "format").repartition(spread_tasks(archives, tasks), "path")
    return spread.mapInPandas(listing, schemas.ARCHIVE_MANIFEST)
