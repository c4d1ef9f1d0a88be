"""The bucketed catalog store and the stream that feeds it."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from mediacat.schemas import MEDIA_ITEMS
from mediacat.sources import sinks
from mediacat.sources.catalog_store import CatalogStore, StaleVersion
from mediacat.streaming import ingest


def _rows(spark, rows, run="new"):
    """Media items from (path, fingerprint, seen)."""
    schema = spark.createDataFrame([], MEDIA_ITEMS).schema
    stamp = datetime.datetime.fromtimestamp
    made = []
    for path, fingerprint, seen, *status in rows:
        values = dict.fromkeys(schema.names)
        values |= {"relative_path": path, "media_item_id": path + fingerprint, "content_fingerprint": fingerprint, "album_id": "a",
                   "file_size": 1, "scan_run_id": run, "status": status[0] if status else "present",
                   "first_seen_timestamp": stamp(seen), "last_seen_timestamp": stamp(seen)}
        made.append(tuple(values[n] for n in schema.names))
    return spark.createDataFrame(made, schema)


def _seen(df):
    return {r.relative_path: (r.content_fingerprint, int(r.last_seen_timestamp.timestamp())) for r in df.collect()}


def _store(spark, tmp_path, rows, buckets=16):
    store = CatalogStore.create(spark, str(tmp_path / "store"), spark.createDataFrame([], MEDIA_ITEMS).schema, buckets=buckets)
    store.upsert(_rows(spark, rows))
    return store


def _files(tmp_path):
    return {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "store" / "data") for f in names if f.endswith(".parquet")}


def test_ingest_stream(spark, tmp_path):
    store = _store(spark, tmp_path, [("kept", "x", 10), ("edited", "x", 10)])
    landing, log, state = (str(tmp_path / d) for d in ("landing", "changes", "state"))

    def run():
        ingest.ingest_stream(spark, landing, store, log, state, "new",
                             F.timestamp_seconds(F.lit(100)), F.timestamp_seconds(F.lit(200))).awaitTermination()
        return _seen(store.read())

    _rows(spark, [("edited", "y", 150), ("fresh", "x", 150)]).write.parquet(landing)
    first = {"kept": ("x", 10), "edited": ("y", 200), "fresh": ("x", 200)}
    assert run() == first
    assert run() == first  # nothing new has landed
    _rows(spark, [("kept", "x", 160)]).write.mode("append").parquet(landing)
    assert run() == first | {"kept": ("x", 200)}
    changes = {(r.relative_path, r.change_type, r.batch_id) for r in ingest.read_changes(spark, log).collect()}
    assert changes == {("edited", "changed", 0), ("fresh", "new", 0), ("kept", "unchanged", 1)}


def test_a_batch_reads_and_writes_only_its_buckets(spark, tmp_path):
    store = _store(spark, tmp_path, [(f"p{i}", "x", 10) for i in range(200)])
    before = _files(tmp_path)
    batch = _rows(spark, [("p7", "y", 150)])
    (bucket,) = store.buckets_of(batch)
    read = store.read(buckets=[bucket])
    assert all(f"_bucket={bucket}/" in f for f in read.inputFiles()) and len(read.inputFiles()) < len(before)
    times = F.timestamp_seconds(F.lit(100)), F.timestamp_seconds(F.lit(200))
    assert ingest.take_in(store, batch, 0, str(tmp_path / "log"), "new", *times)
    added = _files(tmp_path) - before
    assert added and all(f"_bucket={bucket}/" in f for f in added)
    version = store.versions()[-1]
    assert not ingest.take_in(store, batch, 0, str(tmp_path / "log"), "new", *times)  # replayed
    assert store.versions()[-1] == version
    assert _seen(store.read()) == {f"p{i}": ("x", 10) for i in range(200)} | {"p7": ("y", 200)}


def test_repeated_paths_in_a_batch(spark, tmp_path):
    store = _store(spark, tmp_path, [("old", "x", 10)])
    batch = _rows(spark, [("old", "y", 150), ("old", "z", 160), ("new", "y", 150), ("new", "z", 160)])
    ingest.take_in(store, batch, 0, str(tmp_path / "log"), "new", F.timestamp_seconds(F.lit(100)), F.timestamp_seconds(F.lit(200)))
    assert _seen(store.read()) == {"old": ("z", 200), "new": ("y", 200)}


def test_layers_are_compacted(spark, tmp_path):
    store = _store(spark, tmp_path, [(f"p{i}", "x", 1) for i in range(8)], buckets=2)
    for n in range(2, 7):
        store.upsert(_rows(spark, [(f"p{n}", "y", n)]), max_layers=3)
    layers = [len(f) for f in store._manifest()[1]["folders"].values()]
    assert max(layers) <= 3
    want = {f"p{i}": ("y", i) if 2 <= i <= 6 else ("x", 1) for i in range(8)}
    assert _seen(store.read()) == want
    assert _seen(store.read(1)) == {f"p{i}": ("x", 1) for i in range(8)}  # earlier versions stay as they were
    store.vacuum(keep=1)
    assert store.versions() == [6] and _seen(store.read()) == want
    assert len(_files(tmp_path)) == sum(len(f) for f in store._manifest()[1]["folders"].values())


def test_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    store = _store(spark, tmp_path, [("a", "x", 1)])
    slow = CatalogStore(spark, store.location)
    manifest = slow._manifest()
    store.upsert(_rows(spark, [("b", "x", 1)]))
    monkeypatch.setattr(slow, "_manifest", lambda version=None: manifest)
    with pytest.raises(StaleVersion):
        slow.upsert(_rows(spark, [("c", "x", 1)]))
    assert set(_seen(store.read())) == {"a", "b"}


def test_rescan_rewrites_only_buckets_with_changes(spark, tmp_path):
    location = str(tmp_path / "store")
    at = lambda seconds: F.timestamp_seconds(F.lit(seconds))
    first = _rows(spark, [(f"p{i}", "x", 10) for i in range(300)] + [("lost", "x", 5, "missing")], "one")
    store = sinks.merge_catalog(first, location, "one", at(10), buckets=64)
    before = _files(tmp_path)
    reader = store.read()
    second = {f"p{i}": ("x", 20) for i in range(300)} | {"p3": ("y", 20), "added": ("x", 20)}
    scan = _rows(spark, [(p, f, t) for p, (f, t) in second.items()], "two")
    scan = scan.withColumn("first_seen_timestamp", F.when((F.col("content_fingerprint") == "x") & (F.col("relative_path") != "added"), at(10)).otherwise(at(20)))
    gone = _rows(spark, [("lost", "x", 5, "missing")], "one")
    next_items = scan.filter("relative_path <> 'p9'").unionByName(_rows(spark, [("p9", "x", 10, "missing")], "one")).unionByName(gone)
    sinks.merge_catalog(next_items, location, "two", at(20))
    rewritten = {f.split("_bucket=")[1].split("/")[0] for f in _files(tmp_path) - before}
    changed = {str(b) for b in store.buckets_of(next_items.filter("relative_path IN ('p3', 'p9', 'added')"))}
    assert rewritten == changed
    assert sorted(map(str, store.read().collect())) == sorted(map(str, next_items.collect()))
    assert sorted(map(str, reader.collect())) == sorted(map(str, first.collect()))  # a reader of the old version
    assert sorted(map(str, store.read(1).collect())) == sorted(map(str, first.collect()))
    # A row that returns and one that stays missing.
    third = next_items.withColumn("status", F.when(F.col("relative_path") == "p9", "present").otherwise(F.col("status")))
    again = F.col("status") == "present"
    third = third.withColumns({"scan_run_id": F.when(again, "three").otherwise(F.col("scan_run_id")),
                               "last_seen_timestamp": F.when(again, at(30)).otherwise(F.col("last_seen_timestamp"))})
    sinks.merge_catalog(third, location, "three", at(30))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, third.collect()))
