"""Each stage of the pipeline against what it must keep, on its own input."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline as pipeline  # noqa: E402
from test_caption_links import brute  # noqa: E402
from test_heldout_leaks import plain  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = pipeline.registry.written(pipeline.drop_toxic(spark, docs, SF))
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    every = {r.doc_id for r in docs.collect()}
    clean = {d for d in every if labels.get(d) == 0}
    assert len(clean & left) >= 0.98 * len(clean)

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    alone = pipeline.registry.written(pipeline.drop_near_copies(spark, kept, SF))
    want = {int(k) for k, _, _, c in brute(rows, 5, 8, 10) if k == c}
    assert sorted(r.doc_id for r in alone.collect()) == sorted(want)

    rows = [(r.doc_id, r.text) for r in alone.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    short = [(k, t) for k, t in rows if len(t or "") < 3000]
    leaked = {int(f[0]) for f in plain(short, items)}
    clear = pipeline.registry.written(pipeline.drop_leaks(spark, alone, SF))
    have = {r.doc_id for r in clear.collect()}
    assert {k for k, _ in short} - leaked == have & {k for k, _ in short}

    hidden = pipeline.registry.written(pipeline.hide_private(spark, clear, SF))
    texts = {r.doc_id: r for r in hidden.collect()}
    assert set(texts) == have and hidden.columns == docs.columns
    for r in clear.collect():
        if "@mail" in (r.text or ""):
            assert "@mail" not in texts[r.doc_id].text and texts[r.doc_id].n_chars == len(texts[r.doc_id].text)
    pieces = pipeline.pack(spark, hidden, SF)
    assert {r.doc_id for r in pieces.collect()} == have


def test_odd_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, "x y z a b c", "en", "s", 11), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.registry.written(stage(spark, docs, SF))
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "None"]
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []


def test_rows_are_told_apart_whatever_their_ids(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r.text or "").split()) > 20)
    clean = "a quiet walk along the river with seven friends and two dogs on a late sunday afternoon"
    other = "nothing of this list has been said before by anyone who lives in the small house there"
    rows = [(7, clean), (7, item), (None, item), (None, other), (8, clean), (None, clean), (9, None), (9, None), (7, clean)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    clear = pipeline.drop_leaks(spark, docs, SF)
    got = sorted(((r.doc_id, r.text) for r in clear.collect()), key=str)
    assert got == sorted([r for r in rows if r[1] != item], key=str)
    alone = pipeline.drop_near_copies(spark, docs, SF)
    got = sorted(((r.doc_id, r.text) for r in alone.collect()), key=str)
    assert got == sorted([(7, clean), (7, item), (None, other), (9, None)], key=str)
