"""Toxicity of captions, with disguised words restored first.

A disguised word is taken for a noisy reading of a plain one. Its characters open a lattice:
digits and signs stand for the letters they resemble, a run of one letter for one or two of
it, and between short parts a separator stands for nothing or for the end of a word. A Viterbi search finds the most probable
plain word under a character trigram model, which is counted over all captions. Words and
word beginnings that mark toxic captions are then learnt from labelled ones, and a logistic
model turns what a caption has of them into its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Letters that digits and signs stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e",
}
_SIGNS = "@$!|+€"
_OTHER = 27
_CLASSES = 28
_NOISE = math.log(0.05)  # a letter written as a lookalike, or repeated
_JOINED, _ENDED = math.log(0.7), math.log(0.3)  # a separator that means nothing, or the end of a word
_SEPARATORS = " .*_/-"
_SEPARATOR, _OTHER_SEPARATOR = re.compile(f"[{re.escape(_SEPARATORS)}]"), re.compile(f"[{re.escape(_SEPARATORS[1:])}]")
_PART = rf"[^\W_]|[{re.escape(_SIGNS)}]"
_SPELT = re.compile(rf"(?<!\S)(?:{_PART}){{1,2}}(?:[{re.escape(_SEPARATORS)}](?:{_PART}){{1,2}}){{2,}}(?![^\s.,;:!?])")
_MIXED = re.compile(rf"[^\W\d_][0-9{re.escape(_SIGNS)}]|[0-9{re.escape(_SIGNS)}][^\W\d_]|([^\W\d_])\1\1")
_WORDS = re.compile(r"[^\W_]+")
_CACHE_ENTRIES = 400_000
_CACHED_LETTERS = 64
_TAIL = "!?.,;:*#%&$|+\"')]}"
_PREFIXES = (3, 4, 5, 6)


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[97:123] = table[65:91] = np.arange(1, 27)
    table[128:] = _OTHER
    return table


def trigram_counts(captions: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all captions, as a cube of the 28 letter classes.

    Class 0 is what ends a word, 1 to 26 are a to z, 27 is any byte of other letters.
    """
    cells = _CLASSES**3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = _classes(), np.zeros(cells, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = batch.column(0).slice(at, 512).to_pylist()
                raw = np.frombuffer("  ".join(t for t in texts if t).encode(), np.uint8)
                c = np.concatenate([[0, 0], table[raw], [0, 0]]).astype(np.int32)
                code = (c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:]
                counts += np.bincount(code, minlength=cells)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(some.astype(np.int32)), "n": pa.array(counts[some])})

    found = captions.mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(cells, np.int64)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return counts.reshape(_CLASSES, _CLASSES, _CLASSES)


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a letter class after two others."""
    smooth = counts + 0.1
    return np.log(smooth / smooth.sum(axis=2, keepdims=True))


def _class_of(letter: str) -> int:
    code = ord(letter) - 96
    return code if 1 <= code <= 26 else 0 if letter == " " else _OTHER


def lattice(written: str) -> list[list[tuple[str, float]]]:
    """For each sign, or run of one letter, what it may stand for and at what cost."""
    columns: list[list[tuple[str, float]]] = []
    for run in re.finditer(r"(.)\1*", written, re.DOTALL):
        sign, length = run[1], len(run[0])
        if sign in LOOKALIKES:
            columns += [[(x, _NOISE) for x in LOOKALIKES[sign]]] * (1 if length > 2 else length)
        elif sign.isalpha():
            columns.append([(sign * length, 0.0)] if length < 3 else [(sign, _NOISE), (sign * 2, _NOISE)])
        elif sign == " ":
            columns.append([("", _JOINED), (" ", _ENDED)])
    return columns


def restore(written: str, model: np.ndarray) -> str:
    """The most probable plain form of a word in lower case.

    A space in ``written`` is a separator, which may be kept or left out.
    """
    # (score, letters so far as linked nodes) of the best way to each pair of last classes
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in [*lattice(written), [(" ", 0.0)]]:
        ahead: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, node) in paths.items():
            for letters, cost in options:
                x, y, total = a, b, score + cost
                for letter in letters:
                    z = _class_of(letter)
                    total += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in ahead or ahead[x, y][0] < total:
                    ahead[x, y] = (total, (node, letters) if letters else node)
        paths = ahead
    node, found = max(paths.values(), key=lambda p: p[0])[1], []
    while node is not None:
        node, letters = node
        found.append(letters)
    return "".join(reversed(found)).strip()


class _Marks(dict):
    """What each written word adds: the features of its plain forms, or their weight."""

    def __init__(self, model: np.ndarray, weights: dict[str, float] | None):
        self.model, self.weights = model, weights
        self.spelt: dict[str, list[str]] = {}

    def __missing__(self, word: str):
        if len(self) >= _CACHE_ENTRIES:
            self.clear()
        found: set[str] = set()
        for form in self.forms(word):
            found.add("=" + form)
            found.update(form[:n] for n in _PREFIXES if len(form) > n)
        if self.weights is None:
            value = found
        else:
            value = max((self.weights[f] for f in found if f in self.weights), default=0.0)
        self[word] = value
        return value

    def forms(self, word: str) -> list[str]:
        core = word.rstrip(_TAIL).lstrip("!?.,;:*#%&|+\"'([{")
        plain = _WORDS.findall(core)
        if not core or not _MIXED.search(core):
            return plain
        return [*plain, restore(core, self.model)]

    def joined(self, spelt: str) -> list[str]:
        """The words of a run of short parts. Spaces end words if other separators are there too."""
        if not any(c.isalpha() for c in spelt):
            return []
        if len(spelt) > _CACHED_LETTERS:
            return self._join(spelt)
        if spelt not in self.spelt:
            if len(self.spelt) >= _CACHE_ENTRIES:
                self.spelt.clear()
            self.spelt[spelt] = self._join(spelt)
        return self.spelt[spelt]

    def _join(self, spelt: str) -> list[str]:
        run = spelt.rstrip(_TAIL)
        parts = run.split(" ") if _OTHER_SEPARATOR.search(run) else [run]
        return [w for p in parts for w in restore(_SEPARATOR.sub(" ", p), self.model).split()]

    def of(self, text: str | None) -> list:
        """The values of the distinct words of a text, those spelt in parts too."""
        low = (text or "").lower()
        words = set(low.split())
        for spelt in _SPELT.finditer(low):
            words.update(self.joined(spelt[0]))
        return [self[w] for w in words]


def _summary(values: list[float]) -> tuple[float, float, float]:
    hits = [v for v in values if v]
    return (max(hits, default=0.0), math.log1p(len(hits)), math.log1p(sum(hits)))


def learn_marks(labelled: DataFrame, model, least: int = 3, ratio: float = 8.0) -> dict[str, float]:
    """Words ("=word") and word beginnings that mark toxic captions, with their log odds.

    ``labelled`` (google_description, toxic) is bounded by the caller. Marks are in at
    least ``least`` toxic captions and ``ratio`` times as often there as elsewhere.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, found = _Marks(model.value, None), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[toxic].update(set().union(*marks.of(text)))
        names = [*found[0], *(k for k in found[1] if k not in found[0])]
        yield pa.RecordBatch.from_pydict({
            "mark": pa.array(names, pa.string()),
            "clean": pa.array([found[0][k] for k in names], pa.int64()),
            "toxic": pa.array([found[1][k] for k in names], pa.int64()),
        })

    sizes = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return {}
    counted = (
        labelled.mapInArrow(count, "mark string, clean bigint, toxic bigint")
        .groupBy("mark").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    kept = counted.filter(f"toxic >= {least}").select("mark", odds.alias("odds"))
    kept = kept.filter(F.col("odds") >= math.log(ratio))
    return {r.mark: r.odds for r in kept.collect()}  # a bounded sample has bounded marks


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a logistic model, the intercept last, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(media_items: DataFrame, flags: DataFrame, label: str, most: int) -> DataFrame:
    """(google_description, label) of at most ``most`` rows of ``flags``, by hash of the id.

    NULL ids and labels other than 0 and 1 are left out; of repeated ids the first label by
    value counts. The ids, ``most`` at the most, are broadcast.
    """
    flags = flags.filter(F.col(label).isin(0, 1) & F.col("media_item_id").isNotNull())
    one = flags.groupBy("media_item_id").agg(F.min(label).cast("int").alias(label))
    some = one.orderBy(F.xxhash64("media_item_id"), "media_item_id").limit(most)
    return media_items.join(F.broadcast(some), "media_item_id").select("google_description", label)


def score_toxicity(media_items: DataFrame, flags: DataFrame, most_labelled: int = 12_000) -> DataFrame:
    """(media_item_id, score) of all rows of ``media_items``; see ``add_toxicity``."""
    return _scored(media_items, flags, most_labelled, ["media_item_id"], "score")


def add_toxicity(media_items: DataFrame, flags: DataFrame, most_labelled: int = 12_000) -> DataFrame:
    """``media_items`` with toxicity: how probable it is that each caption is marked toxic.

    ``flags`` (media_item_id, toxic 0 or 1) are the labels to learn from; the model is
    fitted on at most ``most_labelled`` of them, its letter model on all captions
    (google_description). The score depends on the caption alone. NULL and empty captions
    are scored like any caption without marks. Without labels of both kinds every score is
    the smoothed share of toxic labels. Repeated rows and NULL ids are kept. No rows, no rows.
    A column toxicity of the input is replaced.
    """
    kept = [c for c in media_items.columns if c != "toxicity"]
    return _scored(media_items, flags, most_labelled, kept, "toxicity")


def _scored(media_items: DataFrame, flags: DataFrame, most_labelled: int, kept: list[str], name: str) -> DataFrame:
    context = media_items.sparkSession.sparkContext
    captions = media_items.select("google_description")
    model = context.broadcast(trigram_model(trigram_counts(captions)))
    sample = labelled_sample(media_items, flags, "toxic", most_labelled)
    shared = context.broadcast(learn_marks(sample, model))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _Marks(model.value, shared.value)
        for batch in batches:
            rows = [_summary(marks.of(t)) for t in batch.column(0).to_pylist()]
            x = np.array(rows, float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[:, i]) for i in range(3)), batch.column(1)], names=["a", "b", "c", "toxic"]
            )

    fitted = sample.mapInArrow(summaries, "a double, b double, c double, toxic int").toPandas()
    x, y = fitted[["a", "b", "c"]].to_numpy(float), fitted["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        weights = fit_logistic(x, y)
    else:
        share = (y.sum() + 0.5) / (len(y) + 1)
        weights = np.array([0, 0, 0, math.log(share / (1 - share))])
    schema = T.StructType([*(media_items.schema[c] for c in kept), T.StructField(name, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _Marks(model.value, shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("google_description").to_pylist()
                x = np.array([_summary(marks.of(t)) for t in texts]).reshape(-1, 3)
                p = 1 / (1 + np.exp(-np.clip(x @ weights[:3] + weights[3], -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(p)], names=[*kept, name])

    read = kept if "google_description" in kept else [*kept, "google_description"]
    return media_items.select(*read).mapInArrow(score, schema)
