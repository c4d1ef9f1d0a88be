"""Embeddings of media items on whitened principal components.

The project has no vectors of its own: ``embedding`` is a column that media items are given.

Only sums leave the tasks: one number per dimension, then one per pair of dimensions. The
driver takes the components of that matrix (``spectral``), whose size is that of one vector,
and sends the few it keeps to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    BinaryType, DecimalType, DoubleType, IntegerType, LongType, StructField, StructType,
)

from mediacat.llm.registry import written
from mediacat.llm.spectral import leading_components

#: Entries of a vector as whole numbers stay within these bounds.
_BOUND = 2.0**31
_ROWS = 4096


def whole_vectors(media_items: DataFrame, scale: int = 256) -> DataFrame:
    """(media_item_id, length, x): usable embeddings as floor(scale * entry), 64 bits each.

    ``x`` has no zeros at its end, so a vector equals the same one filled up with zeros.
    Entries beyond 2^31 count as that. Embeddings that are NULL or hold NULL or non-finite
    entries have no row; an empty one is a vector of zeros.
    """
    wanted = media_items.select("media_item_id", F.col("embedding").cast("array<double>").alias("v"))
    schema = StructType(
        [wanted.schema["media_item_id"], StructField("length", IntegerType()), StructField("x", BinaryType())]
    )

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.cumsum(lengths)
            with np.errstate(over="ignore", invalid="ignore"):
                good = np.isfinite(values)
                x = np.clip(np.floor(values * scale), -_BOUND, _BOUND)
            x = np.where(good, x, 0).astype("<i8")
            bad = np.concatenate([[0], np.cumsum(~good)])
            kept = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths])
            rows = np.flatnonzero(kept)
            cells = [np.trim_zeros(x[ends[r] - lengths[r] : ends[r]], "b").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(lengths[rows], pa.int32()), pa.array(cells, pa.binary())],
                names=["media_item_id", "length", "x"],
            )

    return wanted.mapInArrow(quantise, schema)


def _matrix(cells: pa.Array, dimension: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    out = np.zeros((len(cells), dimension), dtype=np.int64)
    for row, cell in zip(out, cells.to_pylist()):
        row[: len(cell) // 8] = np.frombuffer(cell, "<i8")
    return out


def _blocks(batches: Iterator[pa.RecordBatch], name: str, dimension: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield _matrix(batch.column(name).slice(at, _ROWS), dimension)


def _totals(fit: DataFrame) -> tuple[int, int, list[int]]:
    """Number of vectors, their longest length, and the sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(0, dtype=np.int64), 0
        for batch in batches:
            longest = max((len(c) // 8 for c in batch.column("x").to_pylist()), default=0)
            if longest > len(sums):
                sums = np.pad(sums, (0, longest - len(sums)))
            for block in _blocks([batch], "x", len(sums)):
                sums += block.sum(axis=0)
            rows += batch.num_rows
        cells = {"place": np.arange(-1, len(sums)), "part": np.concatenate([[rows], sums]).astype(np.int64)}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in cells.items()})

    parts = fit.select("x").mapInArrow(partial, "place bigint, part bigint")
    sums = parts.groupBy("place").agg(F.sum(F.col("part").cast("decimal(19,0)")).alias("total"))
    found = {r.place: int(r.total) for r in sums.collect()}
    length = fit.agg(F.max("length")).first()[0] or 0
    return found.get(-1, 0), length, [found.get(i, 0) for i in range(length)]


def _products(fit: DataFrame, make, width: int) -> np.ndarray:
    """Sum over the fit list of the outer products of ``make`` of its rows, a symmetric matrix."""
    low, high = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for block in make(batches):
            total += block.T @ block
        cells = [pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(total[low, high])]
        yield pa.RecordBatch.from_arrays(cells, names=["i", "j", "part"])

    parts = fit.select("x").mapInArrow(partial, "i int, j int, part double")
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("part").alias("total")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.total
    return out


@dataclass
class Whitening:
    """What the fit list gives: its size, sums, components and how white it becomes."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    scales: np.ndarray
    explained: list[float]
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / max(self.n, 1) for s in self.sums])

    def of(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.vectors) * self.scales

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - sum)^2, in whole numbers of any size."""
        largest = max(np.abs(x).max(initial=1), 1) * max(*map(abs, self.sums), 1, 1) * max(x.shape[1], 1)
        kind = np.int64 if int(largest) < 2**62 and int(np.abs(x).max(initial=1)) ** 2 * max(x.shape[1], 1) < 2**62 else object
        y, sums = x.astype(kind), np.array(self.sums, dtype=kind)
        squares, cross = (y * y).sum(axis=1), (y * sums).sum(axis=1)
        rest = sum(s * s for s in self.sums)
        return [self.n * self.n * int(q) - 2 * self.n * int(c) + rest for q, c in zip(squares, cross)]


def fit_whitening(vectors: DataFrame, components: int = 4) -> Whitening:
    """Components of the distinct vectors of ``whole_vectors``, each counted once.

    Covariances have the divisor n and are centred first. A component without variance
    scales everything to zero.
    """
    fit = written(vectors.groupBy("x").agg(F.max("length").alias("length")))
    n, dimension, sums = _totals(fit)
    found = Whitening(n, sums, np.zeros((dimension, 0)), np.zeros(0), [])
    if n == 0 or dimension == 0:
        return found
    mean = found.mean
    centred = lambda batches: (b - mean for b in _blocks(batches, "x", dimension))
    covariance = _products(fit, centred, dimension) / n
    values, found.vectors = leading_components(covariance, components)
    trace = float(np.trace(covariance))
    spans = values > 16 * dimension * np.finfo(float).eps * trace
    found.scales = np.where(spans, 1 / np.sqrt(np.where(spans, values, 1.0)), 0.0)
    found.explained = [float(v) / trace if s else 0.0 for v, s in zip(values, spans)]
    if spans.any():
        white = lambda batches: (found.of(b)[:, spans] for b in _blocks(batches, "x", dimension))
        again = _products(fit, white, int(spans.sum())) / n
        found.identity_error = float(np.abs(again - np.eye(len(again))).max())
    return found


def whiten_embeddings(media_items: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """(media_item_id, component, n, deviation, whitened, explained, identity_error).

    ``media_items`` has media_item_id and embedding (an array of numbers); other columns do
    not matter. Each usable embedding (``whole_vectors``) gets one row per component, from 1
    by falling variance, as many as there are dimensions at most. Components are fitted on
    each distinct vector once. ``n`` is the number of those and ``deviation`` the exact sum
    of (n * x - sum of x)^2, NULL beyond 38 digits. ``whitened`` is the projection of the
    centred vector over the standard deviation of the component, and 0 where that is 0;
    ``explained`` is the component's share of the variance; ``identity_error`` is the
    largest entry of the covariance of the whitened fit list minus the identity.

    Vectors shorter than the longest are filled up with zeros. Repeated rows and NULL ids
    get their rows like others. No usable embedding, no rows.
    """
    found = fit_whitening(whole_vectors(media_items, scale), components)
    rows = whole_vectors(media_items, scale)
    dimension, width = len(found.sums), len(found.scales)
    schema = StructType([
        rows.schema["media_item_id"], StructField("component", IntegerType()), StructField("n", LongType()),
        StructField("deviation", DecimalType(38, 0)), StructField("whitened", DoubleType()),
        StructField("explained", DoubleType()), StructField("identity_error", DoubleType()),
    ])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = _matrix(part.column("x"), dimension)
                count = len(x)
                deviation = [Decimal(d) if d < 10**38 else None for d in found.deviations(x)]
                each = np.repeat(np.arange(count), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("media_item_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, width + 1), count), pa.int32()),
                        pa.array(np.full(count * width, found.n), pa.int64()),
                        pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(each)),
                        pa.array(found.of(x).ravel()),
                        pa.array(np.tile(found.explained, count), pa.float64()),
                        pa.array(np.full(count * width, found.identity_error)),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(project, schema)
