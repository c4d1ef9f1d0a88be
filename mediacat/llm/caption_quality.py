"""Quality of captions by co-training two views.

One classifier sees only the text, the other only the metadata of the item. In rounds, each
labels the unlabelled items it is surest of, and the other one learns from them too. The
views are then calibrated on labels that neither has learnt from, and added up.

All unlabelled items take part where they lie. How sure is sure enough is a quantile over
all of them, and what they add to the gradient of a view is summed up on Spark; the driver
sees these sums and a bounded sample of labelled items.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mediacat.llm.caption_toxicity import fit_logistic
from mediacat.llm.components import Scratch
from mediacat.llm.shingles import word_hashes

_BUCKETS = 32
_WORD_BUCKETS = 128
_F = np.float32


def _byte_classes() -> np.ndarray:
    """Classes of bytes: each ASCII sign its own, digits, lower and upper case, others."""
    table = np.arange(256)
    table[48:58], table[97:123], table[65:91], table[128:], table[:9], table[14:32] = 48, 97, 65, 128, 0, 0
    return np.unique(table, return_inverse=True)[1]


_CLASS = _byte_classes()
_CLASSES = int(_CLASS.max()) + 1


def text_features(texts: list[str | None]) -> np.ndarray:
    """Per text: shares of byte classes, how its words repeat, and shares of hashed words and
    pairs of words. Whole texts count."""
    raw = [(t or "").encode() for t in texts]
    bounds = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(raw)), np.diff(bounds))
    counts = np.bincount(owner * _CLASSES + _CLASS[data], minlength=len(raw) * _CLASSES).reshape(len(raw), _CLASSES)
    size = np.maximum(np.diff(bounds), 1)[:, None]
    words, first = word_hashes(data, bounds)
    more, hashed = np.zeros((len(raw), 3)), np.zeros((len(raw), _WORD_BUCKETS))
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        own = words[a:b]
        n = max(1, len(own))
        more[i] = (len(np.unique(own)) / n, (own[1:] == own[:-1]).sum() / n, size[i, 0] / n / 10)
        grams = np.r_[own, own[:-1] * np.uint64(3) + own[1:]] % np.uint64(_WORD_BUCKETS)
        hashed[i] = np.bincount(grams.astype(np.int64), minlength=_WORD_BUCKETS) / (2 * n)
    return np.c_[np.sqrt(counts / size), more, np.sqrt(hashed)]


def metadata_features(columns: list[pa.Array]) -> np.ndarray:
    """Numbers as logarithms, all else hashed; NULL has a mark of its own."""
    parts = []
    for column in columns:
        values = column.to_pylist()
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
            numbers = np.array([np.nan if v is None else float(v) for v in values])
            logs = np.log1p(np.abs(np.nan_to_num(numbers, posinf=0, neginf=0))) / 10
            parts.append(np.c_[logs, logs**2, np.isnan(numbers)])
        else:
            hot = np.zeros((len(values), _BUCKETS))
            hot[np.arange(len(values)), [0 if v is None else 1 + zlib.crc32(str(v).encode()) % (_BUCKETS - 1) for v in values]] = 1
            parts.append(hot)
    return np.concatenate(parts, axis=1)


def _logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def claims(history: list[tuple], views: list[np.ndarray]) -> tuple[list[tuple], np.ndarray]:
    """What each view labels in each round (-1: nothing), and which rows none has labelled.

    A round is the weights of both views and the logits up to and from which they are sure.
    """
    left, rounds = np.ones(len(views[0]), bool), []
    for weights, cuts in history:
        sure = []
        for x, w, (low, high) in zip(views, weights, cuts):
            logits = np.round(_logits(x, w), 9)  # equal rows stay equal
            label = np.where(logits <= low, 0, np.where(logits >= high, 1, -1))
            sure.append(np.where(left & (low < high), label, -1))
        rounds.append(tuple(sure))
        left &= (sure[0] < 0) & (sure[1] < 0)
    return rounds, left


class Pool:
    """The unlabelled items: a table of the features of both views."""

    def __init__(self, table: DataFrame):
        self.table = table

    @staticmethod
    def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(batch.column(c).to_pylist()), _F).reshape(batch.num_rows, -1).astype(float) for c in ("text", "other")]

    def cuts(self, history: list[tuple], weights: list[np.ndarray], low: float, high: float) -> list[tuple] | None:
        """For each view the quantiles ``low`` and ``high`` of the rows not yet labelled; None without any."""
        views_of = self._views

        def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    views = views_of(batch)
                    left = claims(history, views)[1]
                    found = [np.round(_logits(x, w), 9)[left] for x, w in zip(views, weights)]
                    yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["a", "b"])

        found = self.table.mapInArrow(logits, "a double, b double")
        row = found.agg(*[F.percentile_approx(c, [low, high], 10_000).alias(c) for c in ("a", "b")]).first()
        return None if row.a is None else [tuple(row.a), tuple(row.b)]

    def gradients(self, history: list[tuple], weights: list[np.ndarray]) -> dict[tuple, tuple[float, np.ndarray]]:
        """(view, round, label): how many rows the other view gave that label, and their sum of
        the gradient of ``weights``."""
        views_of = self._views

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                views = views_of(batch)
                for r, labels in enumerate(claims(history, views)[0]):
                    for v in (0, 1):
                        for label in (0, 1):
                            x = views[v][labels[1 - v] == label]
                            p = 1 / (1 + np.exp(-np.clip(_logits(x, weights[v]), -30, 30)))
                            own = np.r_[len(x), (p - label) @ x, (p - label).sum()]
                            sums[v, r, label] = sums.get((v, r, label), 0) + own
            for (v, r, label), own in sums.items():
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, k, np.int32)) for k in (v, r, label)] + [pa.array(np.arange(n, dtype=np.int32)), pa.array(own)],
                    names=["v", "r", "label", "at", "x"],
                )

        found = self.table.mapInArrow(add, "v int, r int, label int, at int, x double")
        found = found.groupBy("v", "r", "label", "at").agg(F.sum("x").alias("x")).toPandas().sort_values("at")
        whole = {k: g["x"].to_numpy() for k, g in found.groupby(["v", "r", "label"])}
        return {k: (x[0], x[1:]) for k, x in whole.items()}


class CoTrained:
    """The two views and what joins them."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, pool: Pool, rounds: int, share: float, steps: int = 3):
        learn = np.arange(len(y)) % 5 != 0  # the fifth part is kept for calibration
        own, t = [v[learn] for v in views], y[learn]
        rate = min(max(float(t.mean()), 0.01), 0.99)
        weights, history = [fit_logistic(x, t, 1.0) for x in own], []
        for _ in range(rounds):
            cuts = pool.cuts(history, weights, share * (1 - rate), 1 - share * rate)
            if cuts is None:
                break
            history = [*history, (list(weights), cuts)]
            for _ in range(steps):
                given = pool.gradients(history, weights)
                weights = [self._step(v, own[v], t, weights[v], given, share, rate) for v in (0, 1)]
        self.weights = weights
        held = np.c_[tuple(_logits(v[~learn], w) for v, w in zip(views, self.weights))]
        target = y[~learn]
        if not 0 < target.sum() < len(target):
            held, target = np.c_[tuple(_logits(v, w) for v, w in zip(views, self.weights))], y
        self.single = [fit_logistic(held[:, [v]], target) for v in (0, 1)]
        both = np.c_[tuple(_logits(held[:, [v]], w) for v, w in enumerate(self.single))]
        self.joint = fit_logistic(both, target)

    @staticmethod
    def _step(view: int, x: np.ndarray, t: np.ndarray, w: np.ndarray, given: dict, share: float, rate: float) -> np.ndarray:
        """One step down the gradient of labelled rows and of rows that the other view labelled.

        The curvature is that of the labelled rows, scaled by the weight of all. The rows of
        a round weigh together as much as ``share`` of the labelled ones, however many they
        are and whatever ties took part.
        """
        x = np.c_[x, np.ones(len(x))]
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient, mass = x.T @ (p - t) + w, 1.0
        for (v, _, label), (n, total) in given.items():
            if v == view and n:
                part = share * (rate if label else 1 - rate)
                gradient += part * len(t) / n * total
                mass += part
        curvature = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(w))
        return w - np.linalg.solve(mass * curvature, gradient)

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Calibrated text score, metadata score and joint score, (item, 3)."""
        single = [_logits(_logits(x, w)[:, None], s) for x, w, s in zip((text, metadata), self.weights, self.single)]
        every = np.c_[single[0], single[1], _logits(np.c_[tuple(single)], self.joint)]
        return 1 / (1 + np.exp(-np.clip(every, -30, 30)))


def score_quality(
    media_items: DataFrame, marks: DataFrame, metadata: list[str], most_labelled: int = 8_000,
    rounds: int = 4, share: float = 0.05,
) -> DataFrame:
    """(media_item_id, text_score, metadata_score, score, predicted) of every item.

    Scores are probabilities that google_description is of good quality; ``predicted`` is 1
    from a score of 0.5. ``marks`` (media_item_id, quality 0 or 1) are the labels, of which
    at most ``most_labelled`` by hash of the id are used; all items without label are.
    ``metadata`` names the columns of the other view. In each round either view labels
    ``share`` of the unlabelled for the other; of equal rows all or none. NULL and empty
    captions and NULL metadata have features like any other. Without labels of both kinds
    all scores are the smoothed share of good ones. Repeated rows and NULL ids are kept.
    Columns not named are ignored, whatever their names. No rows, no rows.
    """
    items = media_items.select("media_item_id", "google_description", *metadata)
    labels = marks.filter(F.col("quality").isin(0, 1) & F.col("media_item_id").isNotNull())
    labels = labels.groupBy("media_item_id").agg(F.min("quality").cast("int").alias("quality"))
    labelled = labels.orderBy(F.xxhash64("media_item_id"), "media_item_id").limit(most_labelled)
    sample = items.join(F.broadcast(labelled), "media_item_id")  # at most the bound

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = text_features(part.column("google_description").to_pylist())
                other = metadata_features([part.column(c) for c in metadata])
                yield pa.RecordBatch.from_arrays(
                    [part.column("media_item_id"), part.column("quality"), pa.array([r.astype(_F).tobytes() for r in text], pa.binary()), pa.array([r.astype(_F).tobytes() for r in other], pa.binary())],
                    names=kinds.names,
                )

    id_field = T.StructField("media_item_id", media_items.schema["media_item_id"].dataType)
    kinds = T.StructType([id_field, T.StructField("quality", T.IntegerType())] + [T.StructField(n, T.BinaryType()) for n in ("text", "other")])
    found = sample.mapInArrow(features, kinds).toArrow()
    found = found.append_column("id", found.column("media_item_id").cast(pa.string())).sort_by([("id", "ascending"), ("text", "ascending")])
    y = found.column("quality").to_numpy()
    model, prior = None, 0.5
    if (y == 0).any() and (y == 1).any():
        order = np.random.default_rng(2).permutation(len(y))
        views = [np.frombuffer(b"".join(found.column(c).to_pylist()), _F).reshape(len(y), -1).astype(float)[order] for c in ("text", "other")]
        # labels may be many: features are made first, so the join shuffles them and no texts
        others = items.withColumn("quality", F.lit(-1)).mapInArrow(features, kinds).join(labels, "media_item_id", "left_anti")
        scratch = Scratch(media_items.sparkSession)
        pool = Pool(scratch.keep(others.select("text", "other")))
        model = CoTrained(views, y[order].astype(float), pool, rounds, share)
        scratch.drop_all()
    else:
        prior = float(((y == 1).sum() + 0.5) / (len(y) + 1))
    shared = media_items.sparkSession.sparkContext.broadcast(model)
    names = ["text_score", "metadata_score", "score"]
    schema = T.StructType(
        [id_field] + [T.StructField(n, T.DoubleType()) for n in names] + [T.StructField("predicted", T.IntegerType())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if shared.value is None:
                    p = np.full((part.num_rows, 3), prior)
                else:
                    text = text_features(part.column("google_description").to_pylist())
                    p = shared.value.scores(text, metadata_features([part.column(c) for c in metadata]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("media_item_id"), *(pa.array(p[:, k].copy()) for k in range(3)), pa.array((p[:, 2] >= 0.5).astype(np.int32))],
                    names=schema.names,
                )

    return items.mapInArrow(score, schema)
