"""Restored words, and held-out accuracy of the toxicity score."""

import itertools
import random

import numpy as np
import pytest

from mediacat.llm import caption_toxicity as toxicity
from mediacat.llm.queries import QUERIES

WORDS = "the idiot was stupid and a loser in trash moron worthless clown pathetic scum total of this you are man".split()


@pytest.fixture(scope="module")
def model(spark):
    rows = [(" ".join(WORDS * 40),), (None,), ("",)]
    return toxicity.trigram_model(toxicity.trigram_counts(spark.createDataFrame(rows, "google_description string")))


@pytest.mark.parametrize("written,plain", [
    ("1d10t", "idiot"), ("stup1d", "stupid"), ("l0ser", "loser"), ("tr@sh", "trash"), ("m0r0n", "moron"),
    ("$tup!d", "stupid"), ("iiidiot", "idiot"), ("looooser", "loser"), ("cl0wn", "clown"), ("idiot", "idiot"),
])
def test_restore(model, written, plain):
    assert toxicity.restore(written, model) == plain


def test_spelt_words(model):
    marks = toxicity._Marks(model, {"=idiot": 3.0})
    for text in ["an i d i o t here", "i.d.i.o.t", "so I-D-I-O-T!", "idiot, really", "IDIOT!!", "1d10t###"]:
        assert 3.0 in marks.of(text), text
    assert not any(marks.of("a b or not, i do it")) and marks.of(None) == []


@pytest.mark.parametrize("written,words", [
    ("you are a s t u p i d man", {"a", "stupid"}), ("y o u i d i o t", {"you", "idiot"}), ("i d 1 o t", {"idiot"}),
    ("i/d/i/o/t", {"idiot"}), ("st.up.id", {"stupid"}), ("l 0 s e r", {"loser"}), ("so: m_o_r_o_n!", {"moron"}),
])
def test_separators(model, written, words):
    marks = toxicity._Marks(model, None)
    found = set().union(*marks.of(written))
    assert {"=" + w for w in words} <= found


def test_best_way_through_small_lattices(model):
    rnd = random.Random(6)
    for _ in range(60):
        written = "".join(rnd.choices("idotsu10!  aa", k=rnd.randint(1, 8))).strip()
        best = -np.inf
        for way in itertools.product(*toxicity.lattice(written)):
            text = "".join(x for x, _ in way) + " "
            classes = [0, 0, *map(toxicity._class_of, text)]
            score = sum(c for _, c in way) + sum(model[t] for t in zip(classes, classes[1:], classes[2:]))
            if score > best + 1e-9:
                best, want = score, text.strip()
        assert toxicity.restore(written, model) == want, written


def test_counts_cover_all_captions(spark):
    rows = [("ab",)] * 7 + [("ab cd",)]
    counts = toxicity.trigram_counts(spark.createDataFrame(rows, "google_description string"))
    assert counts[0, 1, 2] == 8 and counts[0, 3, 4] == 1 and counts[1, 2, 0] == 8


def test_held_out(spark):
    got = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    right = np.mean([r.predicted == r.toxic for r in rows])
    caught = np.mean([r.predicted for r in rows if r.toxic])
    assert right >= 0.97 and caught >= 0.8


def test_odd_rows(spark):
    schema = "media_item_id bigint, google_description string, score string"
    items = [(1, None, "x"), (2, "", "x"), (None, "an idiot", "x"), (3, "w " * 300_000, "x"), (3, "w", "x")]
    frame = spark.createDataFrame(items, schema)
    flags = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (None, 1), (9, None)], "media_item_id bigint, toxic int")
    rows = toxicity.score_toxicity(frame, flags).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.score_toxicity(frame, flags.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.score_toxicity(frame.limit(0), flags).collect() == []
