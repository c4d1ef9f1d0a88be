"""Folders that tasks read by themselves, local ones or by URI."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs


class Mount:
    """The folder below which paths are read. Travels to the tasks as its location."""

    def __init__(self, root: str):
        self.root = root

    @property
    def _opened(self) -> tuple[fs.FileSystem, str]:
        return _opened(self.root)

    def open(self, path: str):
        """A seekable file below the root. OSError if it cannot be read."""
        files, base = self._opened
        return files.open_input_file(f"{base}/{path}" if path else base)

    def entries(self, folder: str) -> list[fs.FileInfo]:
        """Files and folders directly in a folder; links to folders are not followed."""
        files, base = self._opened
        found = files.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
        if isinstance(files, fs.LocalFileSystem):
            found = [e for e in found if e.type == fs.FileType.File or not os.path.islink(e.path)]
        return found

    def is_folder(self, folder: str) -> bool:
        files, base = self._opened
        return files.get_file_info(f"{base}/{folder}" if folder else base).type == fs.FileType.Directory

    def checked(self) -> Mount:
        """This mount, if its location can be reached; else ValueError."""
        self._opened
        return self


def location_of(path: str) -> str:
    """A location for ``Mount`` of a path as Spark's file readers report it, nothing escaped."""
    if (local := re.match(r"file:(?://)?(?=/)", path)) is not None:
        return path[local.end():]
    head, sign, tail = path.partition("://")
    return head + sign + quote(tail) if sign else path


@lru_cache(maxsize=16)
def _opened(root: str) -> tuple[fs.FileSystem, str]:
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", root):
        return fs.LocalFileSystem(), os.path.abspath(root).rstrip("/")
    try:
        files, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))
    except (pa.ArrowException, OSError, ValueError) as error:
        raise ValueError(f"no way to read {root}: {error}") from error
    return files, base.rstrip("/")
