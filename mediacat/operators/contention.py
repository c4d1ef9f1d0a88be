"""Handing out sidecars in path order among names that begin with one another.

Names of one album, number and extension form trees: the root is the shortest name, and
every name below begins with it. Media and sidecars of different trees never compare, so
each tree is decided for itself, by one pass over its media in path order. The rows are
sorted by name; a tree is then a run of rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

GROUP = ["album", "number", "ext"]
_KEY = [*GROUP, "beginning"]
_OUT = "path string, album string, sidecar_path string"


def _with_beginnings(names: DataFrame, among: DataFrame) -> DataFrame:
    """``names`` with as many of their first characters as the shortest name of their group has.

    ``among`` holds the names at least. All names of a tree begin alike that far, so this
    splits a large album without cutting a tree.
    """
    shortest = among.groupBy(*GROUP).agg(F.min(F.length("base")).alias("n"))
    beginning = F.substring("base", F.lit(1), F.col("n")).alias("beginning")
    return names.join(shortest, GROUP).select(*names.columns, beginning)


class _Free:
    """Sidecars of a tree in order of their names, with those taken left out."""

    def __init__(self, sidecars: list[tuple[str, str]]):
        self.names = [name for name, _ in sidecars]
        self.paths = [path for _, path in sidecars]
        self.next = list(range(len(sidecars) + 1))
        self.first = {}
        for i, name in enumerate(self.names):
            self.first.setdefault(name, i)
        self.lengths = sorted({len(name) for name in self.first})

    def at(self, i: int) -> int:
        """The first free place from ``i`` on."""
        root = i
        while self.next[root] != root:
            root = self.next[root]
        while self.next[i] != root:
            self.next[i], i = root, self.next[i]
        return root

    def take(self, i: int) -> str:
        self.next[i] = i + 1
        return self.paths[i]

    def beginning(self, name: str) -> list[int]:
        """Up to two free places whose name begins ``name`` or equals it."""
        found = []
        for length in self.lengths:
            if length > len(name):
                break
            start = name[:length]
            i = self.first.get(start)
            while i is not None and (i := self.at(i)) < len(self.names) and self.names[i] == start:
                found.append(i)
                if len(found) == 2:
                    return found
                i += 1
        return found

    def longer(self, name: str) -> list[int]:
        """Up to two free places whose name is longer and begins with ``name``."""
        found = []
        i = self.at(bisect_right(self.names, name))
        while i < len(self.names) and self.names[i].startswith(name) and len(found) < 2:
            found.append(i)
            i = self.at(i + 1)
        return found


def _decide(rows: list[tuple[str, str, bool]]) -> Iterator[tuple[str, str | None]]:
    """(media, sidecar or None) of one tree's (name, path, is_media), sorted by name.

    At its turn a media takes its only free sidecar whose name begins its own; with none of
    those, its only free one whose name is longer; else nothing.
    """
    free = _Free([(name, path) for name, path, is_media in rows if not is_media])
    for path, name in sorted((path, name) for name, path, is_media in rows if is_media):
        options = free.beginning(name) or free.longer(name)
        yield path, free.take(options[0]) if len(options) == 1 else None


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of consecutive rows, each decided when the next begins."""
    key, tree = None, []

    def finished() -> list[tuple]:
        return [(path, key[0], sidecar) for path, sidecar in _decide(tree)]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "album", "sidecar_path"])

    for batch in batches:
        out = []
        for *group, name, path, is_media in zip(*(c.to_pylist() for c in batch.columns)):
            if group != key or not name.startswith(tree[0][0]):
                if tree:
                    out += finished()
                key, tree = group, []
            tree.append((name, path, is_media))
        yield packed(out)
    if tree:
        yield packed(finished())


def assign_in_order(media: DataFrame, sidecars: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(path, album, sidecar_path) of every media, each sidecar given away at most once.

    Both frames have path, album, number, ext and base, none of them NULL. Candidates of a
    media have its album, number and extension; of two names one begins the other. Media go
    by path: one takes its only free candidate with a name no longer than its own, or, if it
    has none of those, its only free one with a longer name, and nothing where it has several.

    A task holds one tree at a time: names of one album that begin with one another.
    ``among`` (album, number, ext, base) may name more files than these, if it is cheaper to
    read; trees are told apart by the lengths found there.
    """
    columns = [*GROUP, "base", "path"]
    names = media.select(*columns, F.lit(True).alias("is_media")).unionByName(
        sidecars.select(*columns, F.lit(False).alias("is_media"))
    )
    among = (names if among is None else among).select(*GROUP, "base")
    keyed = _with_beginnings(names, among).repartition(*_KEY).sortWithinPartitions(*_KEY, "base")
    return keyed.select(*GROUP, "base", "path", "is_media").mapInArrow(_fold, _OUT)
