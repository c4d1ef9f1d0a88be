"""JSON objects of large files, read by many tasks.

A dump is often one array on one line, which no line reader can split. It is cut into
ranges of bytes. Whether a range begins inside a text, and how deep, follows from the
ranges before it: each range tells what it does to both, for either beginning, and these
few numbers are added up by file. Then every range is read for the objects that begin in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from mediacat.sources.mounts import Mount, location_of

_PIECE = 1 << 20
_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_SIGNS = re.compile(rb'"|\\|[\[\]{}]')


def _depths(piece: np.ndarray, escaped: bool) -> tuple[int, int, int, bool]:
    """(unescaped quotes, change of depth at even places, at odd places, ends escaped).

    A place is even if an even number of quotes precedes it within the piece.
    """
    marks = piece == _BACKSLASH
    places = np.arange(len(piece), dtype=np.int32)
    plain = np.maximum.accumulate(np.where(marks, np.int32(-1), places))
    run = np.zeros(len(piece) + 1, dtype=np.int32)  # backslashes right before each place
    run[1:] = places - plain
    if escaped:  # one more before a run that begins the piece
        run[: (np.argmin(marks) if not marks.all() else len(piece)) + 1] += 1
    quotes = (piece == _QUOTE) & (run[:-1] % 2 == 0)
    odd = (np.cumsum(quotes) - quotes) % 2 == 1
    steps = ((piece == ord("{")) | (piece == ord("["))).astype(np.int8) - ((piece == ord("}")) | (piece == ord("]")))
    return int(quotes.sum()), int(steps[~odd].sum()), int(steps[odd].sum()), bool(run[-1] % 2)


def range_effect(read, length: int) -> tuple[bool, int, int]:
    """(ends in the other state, change of depth if it begins outside a text, if inside)."""
    quotes, outside, inside, escaped = 0, 0, 0, False
    while length > 0 and (piece := read(min(_PIECE, length))):
        length -= len(piece)
        n, even, odd, escaped = _depths(np.frombuffer(piece, np.uint8), escaped)
        outside, inside = (outside + even, inside + odd) if quotes % 2 == 0 else (outside + odd, inside + even)
        quotes += n
    return quotes % 2 == 1, outside, inside


def objects_from(read, length: int, in_text: bool, depth: int, level: int) -> Iterator[bytes]:
    """The objects at depth ``level`` that begin in the first ``length`` bytes.

    ``read`` goes on past them where the last object does not end there.
    """
    begun: list[bytes] = []
    at, escaped = 0, False
    while (at < length or begun) and (piece := read(_PIECE)):
        start = 0 if begun else None
        skip = 1 if escaped else 0
        escaped = False
        position = skip
        while (found := _SIGNS.search(piece, position)) is not None:
            i, sign = found.start(), found.group()
            position = i + 1
            if sign == b"\\":
                position = i + 2
                escaped = position > len(piece)
            elif sign == b'"':
                in_text = not in_text
            elif in_text:
                continue
            elif sign in b"{[":
                if sign == b"{" and depth == level:
                    if at + i >= length:
                        return
                    start = i
                depth += 1
            else:
                depth -= 1
                if sign == b"}" and depth == level and start is not None:
                    yield b"".join(begun) + piece[start:position]
                    begun, start = [], None
        if start is not None:
            begun.append(piece[start:])
        at += len(piece)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns, dtype="object")


def _opened_at(source: str, start: int):
    handle = Mount(location_of(source)).open("")
    handle.seek(start)
    return handle


def _bound(source: str, at: int) -> int:
    """``at``, moved on where it lies behind a backslash, so that no escape is cut."""
    if at == 0:
        return 0
    with _opened_at(source, at - 1) as handle:
        before = handle.read(1)
        while before == b"\\" and (before := handle.read(1)):
            at += 1
    return at


def _first_sign(source: str) -> str:
    with _opened_at(source, 0) as handle:
        return handle.read(4096).removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1")


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["source", "start", "length", "turns", "outside", "inside", "first"]
    for batch in batches:
        rows = []
        for source, start, length in zip(batch["source"], batch["start"], batch["length"]):
            begin, end = _bound(source, start), _bound(source, start + length)
            with _opened_at(source, begin) as handle:
                effect = range_effect(handle.read, end - begin)
            rows.append((source, begin, end - begin, *effect, _first_sign(source) if start == 0 else ""))
        yield _frame(rows, columns)


def _begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for source, parts in zip(batch["source"], batch["parts"]):
            in_text, depth, level = False, 0, 0
            for part in parts:
                if part["first"]:
                    level = 1 if part["first"] == "[" else 0
                rows.append((source, part["start"], part["length"], in_text, depth, level))
                depth += part["inside"] if in_text else part["outside"]
                in_text ^= part["turns"]
        yield _frame(rows, ["source", "start", "length", "in_text", "depth", "level"])


def _objects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            found: list[tuple[str, str]] = []
            with _opened_at(row.source, row.start) as handle:
                for text in objects_from(handle.read, row.length, row.in_text, row.depth, row.level):
                    found.append((row.source, text.decode("utf-8", errors="replace")))
                    if len(found) == 1000:
                        yield _frame(found, ["source", "record"])
                        found = []
            yield _frame(found, ["source", "record"])


def json_records(spark: SparkSession, location: str, range_bytes: int = 16 << 20) -> DataFrame:
    """(source, record): the JSON objects of files, each as text.

    A file holds one array of objects, or objects one after the other, on lines of their
    own or not. ``location`` may name folders and patterns. Files are read in ranges of
    ``range_bytes``; what is no object at the outer level is left out.
    """
    files = spark.read.format("binaryFile").load(location).select("path", "length").filter("length > 0")
    step = F.lit(range_bytes).cast("bigint")
    ranges = files.select(
        F.col("path").alias("source"), "length",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, step)).alias("start"),
    ).select("source", "start", F.least(step, F.col("length") - F.col("start")).alias("length"))
    tasks = 8 * spark.sparkContext.defaultParallelism
    effects = ranges.repartition(tasks, "source", "start").mapInPandas(
        _ranges, "source string, start bigint, length bigint, turns boolean, outside bigint, inside bigint, first string"
    )
    by_file = effects.groupBy("source").agg(F.sort_array(F.collect_list(
        F.struct("start", "length", "turns", "outside", "inside", "first"))).alias("parts"))
    begun = by_file.mapInPandas(
        _begin, "source string, start bigint, length bigint, in_text boolean, depth bigint, level int"
    )
    return begun.repartition(tasks, "source", "start").mapInPandas(_objects, "source string, record string")
