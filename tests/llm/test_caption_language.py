"""The network's gradients, and held-out accuracy of the languages."""

import numpy as np

from mediacat.llm import caption_language as language
from mediacat.llm.queries import QUERIES


def test_gradients():
    rng = np.random.default_rng(0)
    net = language.ByteNetwork(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    codes = np.stack([c := rng.integers(0, 256, (6, 5)), c[::-1]], axis=1)
    labels = rng.integers(0, 3, 5)
    language._F, kept = np.float64, language._F
    try:
        _, g = net.gradients(codes, labels)
        for k, v in net.w.items():
            where = np.unravel_index(np.argsort(-np.abs(g[k]).ravel())[:3], v.shape)
            for at in zip(*where):
                old, e = v[at], 1e-5
                v[at] = old + e
                up = net.gradients(codes, labels)[0]
                v[at] = old - e
                down = net.gradients(codes, labels)[0]
                v[at] = old
                assert abs((up - down) / (2 * e) - g[k][at]) < 1e-4 * max(1, abs(g[k][at])), k
    finally:
        language._F = kept


def test_held_out(spark):
    rows = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = rows.join(docs, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.95


def test_odd_rows(spark):
    schema = "media_item_id bigint, google_description string, language string"
    rows = [(i, t, x) for i, (t, x) in enumerate([("the of and this that with", "en"), ("der die das und nicht", "de")] * 20)]
    rows += [(100, None, "en"), (101, "12 ,.", "en"), (102, "x", None), (None, "the and", "en"), (103, "of the " * 50_000, None), (103, "der", None)]
    frame = spark.createDataFrame(rows, schema)
    net = language.learn_languages(frame)
    got = language.predict_languages(frame, net).collect()
    by = {r.media_item_id: r for r in got}
    assert len(got) == len(rows) and by[100].language == by[101].language == "und" and by[100].score == 0
    assert by[0].language == "en" and by[1].language == "de" and by[102].language in ("en", "de")
    assert {r.language for r in language.predict_languages(frame, None).collect()} == {"und"}
    assert language.learn_languages(frame.limit(0)) is None
    assert language.predict_languages(frame.limit(0), net).collect() == []


def test_all_bytes_are_learnt_from(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language.ByteNetwork, "train", lambda self, chunks, labels: seen.update(chunks=chunks))
    text = "".join(chr(97 + i % 26) + str(i) for i in range(200))
    language.learn_languages(spark.createDataFrame([(1, text, "en")], "media_item_id bigint, google_description string, language string"))
    have = {c.tobytes() for c in seen["chunks"]}
    raw, size = text.encode(), language._CHUNK
    assert have == {raw[at : at + size] for at in [*range(0, len(raw) - size, size), len(raw) - size]}


def test_fast_reading_is_the_same():
    rng = np.random.default_rng(2)
    net = language.ByteNetwork(["a", "b"])
    codes = rng.integers(0, 256, (64, 2, 7))
    assert np.allclose(net.states(codes), net.read(codes), atol=1e-5)
