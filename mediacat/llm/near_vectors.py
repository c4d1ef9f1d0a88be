"""Media items of one album with nearly the same embedding.

The project has no vectors of its own: ``embedding`` is a column that media items are given.

Spherical-cap filters: a filter is a direction put together from one codeword per block of
the (rotated) dimensions, so a few codewords make very many directions. A vector belongs to
every filter it has a large enough inner product with. Those are listed without trying all
directions, by joining the sorted sums of the first and the second half of the blocks. How
many filters a vector exceeds varies much with one code, so several rotated ones are used:
as many as it takes for a pair at the similarity asked for to share a filter with a
probability of ``_RECALL``, whatever the size.
Vectors that share a filter are compared exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediacat.llm.components import components, lookup
from mediacat.llm.shingles import mix
from mediacat.session import checkpointed

_BLOCKS = 4
_RECALL = 0.985
_FILTERS_EACH = 4
_MANY_CODES = 32
_TRIED_CODES, _TRIED_EACH = 8, 40
_GROUP_ROWS = 512


class CapFilters:
    """The product code of one dimension and number of codewords; the same everywhere."""

    def __init__(self, dimension: int, codewords: int, seed: int = 11, threshold: float = 0.0):
        rng = np.random.default_rng(seed)
        self.width = -(-dimension // _BLOCKS)
        padded = self.width * _BLOCKS
        self.rotation = np.linalg.qr(rng.standard_normal((padded, padded)))[0][:dimension]
        code = rng.standard_normal((_BLOCKS, codewords, self.width))
        self.code = code / np.linalg.norm(code, axis=2, keepdims=True) / math.sqrt(_BLOCKS)
        self.codewords = codewords
        self.threshold = threshold

    def sums(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products with the first and with the second half of each direction."""
        x = (unit @ self.rotation).reshape(_BLOCKS, self.width)
        scores = np.einsum("bkw,bw->bk", self.code, x)
        return (scores[0][:, None] + scores[1][None, :]).ravel(), (scores[2][:, None] + scores[3][None, :]).ravel()

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Numbers of the filters that a unit vector exceeds; at least the nearest one."""
        head, tail = self.sums(unit)
        order = np.argsort(-tail)
        reach = np.searchsorted(-tail[order], head - self.threshold, side="right")
        first = np.flatnonzero(reach)
        if not len(first):
            return np.array([int(head.argmax()) * len(tail) + int(tail.argmax())])
        found = np.concatenate([i * len(tail) + order[: reach[i]] for i in first])
        return np.sort(found)


@lru_cache(maxsize=64)
def cap_filters(dimension: int, codewords: int, similarity: float) -> list[CapFilters]:
    """The codes for vectors of a dimension, the same everywhere.

    Their threshold is taken from random unit vectors, which exceed ``_FILTERS_EACH``
    filters of a code on average, and their number from random pairs at ``similarity``.
    Where that takes more than ``_MANY_CODES``, the threshold is lowered first.
    """
    rng = np.random.default_rng([dimension, codewords])
    tried = [CapFilters(dimension, codewords, seed) for seed in range(_TRIED_CODES)]
    pairs = [_pair(rng, dimension, similarity) for _ in range(_TRIED_CODES * _TRIED_EACH)]
    sums = [tried[i % _TRIED_CODES].sums(a) for i, (a, _) in enumerate(pairs)]
    sums = [(head, np.sort(tail)) for head, tail in sums]
    each, directions = _FILTERS_EACH, codewords**_BLOCKS
    while True:
        low, high = -1.01, 1.0
        while each < directions and high - low > 1e-3:
            middle = (low + high) / 2
            found = sum(len(t) * len(h) - np.searchsorted(t, middle - h).sum() for h, t in sums) / len(sums)
            low, high = (middle, high) if found > each else (low, middle)
        threshold = high if each < directions else low
        for code in tried:
            code.threshold = threshold
        met = [bool(np.intersect1d(tried[i % _TRIED_CODES].of(a), tried[i % _TRIED_CODES].of(b)).size) for i, (a, b) in enumerate(pairs)]
        missed = 1 - np.mean(met)
        codes = 1 if missed == 0 else math.inf if missed == 1 else math.ceil(math.log(1 - _RECALL) / math.log(missed))
        if codes <= _MANY_CODES or each >= directions:
            break
        each *= 2
    return [CapFilters(dimension, codewords, seed, threshold) for seed in range(codes)]


def _pair(rng: np.random.Generator, dimension: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Two random unit vectors at a cosine; in one dimension two equal ones."""
    a = _unit(rng.standard_normal(dimension))
    if dimension == 1 or similarity >= 1:
        return a, a
    b = rng.standard_normal(dimension)
    b = _unit(b - (b @ a) * a)
    cosine = max(similarity, -1.0)
    return a, cosine * a + math.sqrt(1 - cosine**2) * b


def near_vectors(media_items: DataFrame, similarity: float = 0.93, codewords: int | None = None) -> DataFrame:
    """(media_item_id, n_links, component_id, kept), one row per row of ``media_items``.

    ``media_items`` has media_item_id, album_id and embedding (an array of numbers). Items
    of one album link when the cosine of their embeddings, in double precision, is at least
    ``similarity``. ``n_links`` counts the other rows found linked directly, equal vectors
    among them; ``component_id`` is the smallest id that links reach, and an item is kept
    when that is its own. Reported links are exact; a pair at the threshold is found with a
    probability of about 0.98 at every size, nearer pairs almost always, equal vectors always.
    ``codewords`` per block is chosen from the number of rows if not given: filters get
    finer as rows get more, which keeps the groups small, and codes get more in return.

    Vectors that are NULL, empty, zero, or hold NULL or non-finite numbers, and items
    without album, link with nothing. Vectors of another length form groups of their own.
    Repeated rows are linked like other equal vectors; NULL ids take part but are no
    component's smallest id. No rows, no rows.
    """
    items = media_items.select("media_item_id", "album_id", "embedding", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    usable = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("album_id").isNotNull()
    key = F.when(usable, F.xxhash64("album_id", "v"))
    keyed = items.withColumn("key", key)
    ids = checkpointed(keyed.select("media_item_id", "key"))
    total = ids.count()
    if codewords is None:
        codewords = max(8, min(96, math.ceil(max(total, 1) ** (1 / _BLOCKS) / 2)))
    classes = keyed.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("media_item_id").alias("first_id"), F.count("*").alias("n"),
        F.first("album_id").cast("string").alias("album"), F.first("embedding").alias("v"),
    )
    kind = items.schema["media_item_id"].dataType.simpleString()
    classes = checkpointed(classes.select("first_id", "key", "n", "album", "v").mapInArrow(
        _coded(codewords, similarity), f"first_id {kind}, key bigint, n bigint, v binary, own array<bigint>"
    ))
    links = checkpointed(_links(classes.select("key", F.col("n").alias("copies"), "v", "own"), similarity))
    weights = links.groupBy(F.col("b").alias("key")).agg(F.sum("weight").alias("weight"))
    rooted = components(links.filter("a <> b").select("a", "b")).withColumnRenamed("node", "key")
    known = checkpointed(
        classes.select("key", "n", "first_id").join(rooted, "key", "left").join(weights, "key", "left")
        .select("key", "n", "first_id", F.coalesce("component", "key").alias("component"),
                (F.coalesce("weight", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    smallest = checkpointed(known.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    found = checkpointed(
        lookup(known.withColumnRenamed("n", "copies"), smallest, "component", total)
        .select("key", F.col("copies").alias("n"), "n_links", "component_id")
    )
    linked = lookup(ids.filter("key IS NOT NULL"), found, "key", total)
    alone = ids.filter("key IS NULL").select(
        "media_item_id", F.lit(0).cast("bigint").alias("n_links"), F.col("media_item_id").alias("component_id")
    )
    every = linked.select("media_item_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("media_item_id") == F.col("component_id"), F.lit(False)))


def _coded(codewords: int, similarity: float):
    """Adds to each vector the groups it belongs to: hashes of album, length, code and filter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, groups = [], []
            for album, vector in zip(batch.column(3).to_pylist(), batch.column(4)):
                v = vector.values.to_numpy()
                size = len(v)
                salt = int.from_bytes(hashlib.blake2b(f"{album}|{size}".encode(), digest_size=8).digest(), "little")
                unit = _unit(v)
                own = [mix(code.of(unit).astype(np.uint64) + np.uint64(c << 48) ^ np.uint64(salt)) for c, code in enumerate(cap_filters(size, codewords, similarity))]
                packed.append(v.tobytes() if v.dtype == np.float32 else v.astype(np.float64).tobytes() + b"d")
                groups.append(np.sort(np.concatenate(own).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(packed, pa.binary()), pa.array(groups, pa.list_(pa.int64()))],
                names=["first_id", "key", "n", "v", "own"],
            )

    return rows


def _unit(v: np.ndarray) -> np.ndarray:
    x = v.astype(np.float64)
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def _unpacked(raw: bytes) -> np.ndarray:
    """The unit vector of bytes of single precision, or of double precision with a mark."""
    return _unit(np.frombuffer(raw, np.float32) if len(raw) % 4 == 0 else np.frombuffer(raw[:-1], np.float64))


def _links(vectors: DataFrame, similarity: float) -> DataFrame:
    """(a, b, weight) of every vector that meets others: a is the smallest key it reaches in
    a group, weight the rows it links with there. A pair counts in its first common group.

    Groups above _GROUP_ROWS are cut into blocks by hash, and every two blocks meet. Only
    keys are shuffled until each knows where it goes; groups of one are left out.
    """
    places = checkpointed(vectors.select("key", F.explode("own").alias("grp")))
    sizes = places.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = checkpointed(sizes.withColumn("blocks", F.ceil(F.col("n") / _GROUP_ROWS).cast("int")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    routes = (
        lookup(places, sizes, "grp", total)
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key")
    )
    spread = routes.join(vectors, "key").select("grp", "i", "j", "block", "key", "copies", "v", "own")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if group != row[:3]:
                    if len(rows) > 1:
                        yield _compare(rows, group, similarity)
                    group, rows = row[:3], []
                rows.append(row[3:])
        if len(rows) > 1:
            yield _compare(rows, group, similarity)

    key = ["grp", "i", "j"]
    return spread.repartition(*key).sortWithinPartitions(*key, "key").mapInArrow(
        meet, "a bigint, b bigint, weight bigint"
    )


def _compare(rows: list[tuple], group: tuple, similarity: float) -> pa.RecordBatch:
    lengths = {len(r[3]) for r in rows}
    blocks = np.array([r[0] for r in rows])
    keys = np.array([r[1] for r in rows], np.int64)
    copies = np.array([r[2] for r in rows], np.int64)
    near = np.zeros((len(rows), len(rows)), bool)
    for length in lengths:  # hashes of two lengths may fall together
        at = np.flatnonzero([len(r[3]) == length for r in rows])
        x = np.stack([_unpacked(rows[i][3]) for i in at])
        near[np.ix_(at, at)] = x @ x.T >= similarity
    np.fill_diagonal(near, False)
    if group[1] != group[2]:
        near &= blocks[:, None] != blocks[None, :]
    earlier = [np.array([g for g in r[4] if g < group[0]], np.int64) for r in rows]
    names, ids = np.unique(np.concatenate(earlier), return_inverse=True)
    if len(names):
        holds = np.zeros((len(rows), len(names)), np.float32)
        holds[np.repeat(np.arange(len(rows)), [len(e) for e in earlier]), ids] = 1
        near &= holds @ holds.T == 0
    root = list(range(len(rows)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in np.argwhere(np.triu(near)).tolist():
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    weight = near @ copies
    some = np.flatnonzero(near.any(axis=1))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[[top(x) for x in some]]), pa.array(keys[some]), pa.array(weight[some])], names=["a", "b", "weight"]
    )
