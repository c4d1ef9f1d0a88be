"""Held-out accuracy of the quality score, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from mediacat.llm import caption_quality as quality

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").alias("media_item_id"), F.col("text").alias("google_description"), F.col("source").alias("album_id"), F.col("lang").alias("language"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").select(F.col("doc_id").alias("media_item_id"), "quality")
    train = labels.filter("media_item_id % 3 <> 0")
    scored = quality.score_quality(docs, train, ["album_id", "language"])
    rows = scored.join(labels.filter("media_item_id % 3 = 0"), "media_item_id").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    kept = np.mean([r.predicted for r in rows if r.quality])
    assert right >= 0.95 and kept >= 0.97
    for single in ("text_score", "metadata_score"):
        assert right >= np.mean([(r[single] >= 0.5) == r.quality for r in rows])


def test_all_unlabelled_take_part(spark):
    """Sums over the pool equal those of its rows in one place, ties included."""
    rng = np.random.default_rng(4)
    views = [rng.normal(size=(500, 6)).round(1), rng.integers(0, 2, (500, 3)).astype(float)]
    rows = [tuple(bytearray(v[i].astype(np.float32).tobytes()) for v in views) for i in range(500)]
    pool = quality.Pool(spark.createDataFrame(rows, "text binary, other binary").repartition(7))
    weights = [rng.normal(size=7), rng.normal(size=4)]
    views = [v.astype(np.float32).astype(float) for v in views]
    history = []
    for _ in range(2):
        cuts = pool.cuts(history, weights, 0.1, 0.9)
        left = quality.claims(history, views)[1]
        for v in (0, 1):
            logits = np.sort((views[v] @ weights[v][:-1] + weights[v][-1])[left])
            assert np.allclose(cuts[v], [logits[-(-len(logits) // 10) - 1], logits[-(-9 * len(logits) // 10) - 1]])
        history.append((weights, cuts))
    got = pool.gradients(history, weights)
    labels = quality.claims(history, views)[0]
    for (v, r, label), (n, total) in got.items():
        x = views[v][labels[r][1 - v] == label]
        p = 1 / (1 + np.exp(-(x @ weights[v][:-1] + weights[v][-1])))
        assert n == len(x) and np.allclose(total, np.r_[(p - label) @ x, (p - label).sum()])


def test_odd_rows(spark):
    schema = "media_item_id bigint, google_description string, album_id string, size double, score string"
    rows = [(1, None, None, None, "x"), (2, "", "a", float("nan"), "x"), (None, "text", "a", 1.0, "x"), (3, "w " * 300_000, "b", -5.0, "x"), (3, "w", "b", 1e300, "x")]
    frame = spark.createDataFrame(rows, schema)
    marks = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (None, 1), (9, None)], "media_item_id bigint, quality int")
    got = quality.score_quality(frame, marks, ["album_id", "size"]).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = quality.score_quality(frame, marks.limit(0), ["album_id", "size"]).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(frame.limit(0), marks, ["album_id"]).collect() == []


def test_no_text_is_shuffled(spark, monkeypatch):
    """However large the labels: unlabelled items meet them by features, none is lost."""

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    pools, keep = [], quality.Scratch.keep

    def kept(self, df):
        table = keep(self, df)
        pools.append((df, table.count()))
        return table

    monkeypatch.setattr(quality.Scratch, "keep", kept)
    rows = [(i, f"word{i} " * 50, "a") for i in range(60)] + [(None, "text", "a"), (None, "text", "a"), (3, "again", "b"), (51, "again", "b")]
    items = spark.createDataFrame(rows, "media_item_id bigint, google_description string, album_id string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(70, 1), (45, None)], "media_item_id bigint, quality int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert quality.score_quality(items, marks, ["album_id"]).count() == len(rows)
        [(pool, n)] = pools
        assert n == 20 + 3
        dealt = [x.output().mkString(" ") for x in nodes(pool._jdf.queryExecution().executedPlan().initialPlan()) if x.nodeName() == "Exchange"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert dealt and not any("google_description" in x for x in dealt)
