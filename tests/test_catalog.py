import pytest
from pyspark.sql import functions as F

from mediacat.operators import (
    archives, constraints, lookups, people, relations, reports, rescan, runs, time_match,
)
from mediacat.plans import jobs

ITEMS = """relative_path string, media_item_id string, content_fingerprint string, sidecar_fingerprint string,
    first_seen int, last_seen int, scan_run_id string, status string"""


def _at(seconds):
    return F.timestamp_seconds(F.lit(seconds))


def _items(spark, rows):
    df = spark.createDataFrame(rows, ITEMS)
    return df.select(
        "relative_path", "media_item_id", "content_fingerprint", "sidecar_fingerprint",
        F.timestamp_seconds("first_seen").alias("first_seen_timestamp"),
        F.timestamp_seconds("last_seen").alias("last_seen_timestamp"), "scan_run_id", "status")


def _state(df):
    return {r.relative_path: (r.media_item_id, r.status, r.scan_run_id, int(r.first_seen_timestamp.timestamp()),
                              int(r.last_seen_timestamp.timestamp()), r.change_type) for r in df.collect()}


STORED = [
    ("same", "1", "c", None, 10, 10, "old", "present"),
    ("back", "2", "c", "s", 10, 10, "old", "missing"),
    ("content", "3", "c", "s", 10, 10, "old", "present"),
    ("sidecar", "4", "c", "s", 10, 10, "old", "present"),
    ("gone", "5", "c", "s", 10, 10, "old", "present"),
    ("broken", "6", "c", "s", 10, 10, "old", "error"),
    ("this run", "7", "c", "s", 150, 150, "new", "present"),
    ("odd", "8", "c", "s", 10, 50, "new", "present"),
]
SCAN = [
    ("same", "1", "c", None, 0, 0, "new", "present"),
    ("back", "2", "c", "s", 0, 0, "new", "present"),
    ("content", "33", "C", "s", 0, 0, "new", "present"),
    ("sidecar", "44", "c", None, 0, 0, "new", "present"),
    ("this run", "77", "C", "s", 0, 0, "new", "present"),
    ("fresh", "9", "c", None, 0, 0, "new", "present"),
]


def test_rescan(spark):
    got = _state(jobs.rescan_catalog(_items(spark, SCAN), _items(spark, STORED), "new", _at(100), _at(200)))
    assert got == {
        "same": ("1", "present", "new", 10, 200, "unchanged"),
        "back": ("2", "present", "new", 10, 200, "unchanged"),
        "content": ("33", "present", "new", 200, 200, "changed"),
        "sidecar": ("44", "present", "new", 200, 200, "changed"),
        "gone": ("5", "missing", "old", 10, 10, "absent"),
        "broken": ("6", "error", "old", 10, 10, "absent"),
        "this run": ("7", "present", "new", 150, 150, "kept"),
        "odd": ("8", "inconsistent", "new", 10, 50, "absent"),
        "fresh": ("9", "present", "new", 200, 200, "new"),
    }
    kept = rescan.apply_changes(_items(spark, SCAN), _items(spark, STORED), "new", _at(100), _at(200), True)
    assert _state(kept)["content"][3] == 10


def test_rescan_of_the_same_state(spark):
    items = _items(spark, STORED)
    diff = rescan.rescan_diff(items, items, _at(100))
    assert {r.change_type for r in diff.collect()} == {"unchanged"}
    assert rescan.needs_processing(items, diff).count() == 0


def test_repeated_paths(spark):
    scan = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 2, "y")],
                                 "relative_path string, n int, v string")
    stored = spark.createDataFrame([("a", 1)], "relative_path string, s int").select(
        "relative_path", F.timestamp_seconds("s").alias("first_seen_timestamp"))
    rows = rescan.one_row_per_path(scan, stored, "n", _at(100)).collect()
    assert {r.relative_path: r.v for r in rows} == {"a": "y", "b": "x"}


def _media(spark, paths):
    rows = [(p, f"id {p}", None, None) for p in paths]
    return spark.createDataFrame(
        rows, "relative_path string, media_item_id string, original_media_item_id string, live_photo_pair_id string")


def test_live_photos(spark):
    media = _media(spark, ["a/IMG_1.HEIC", "a/IMG_1.MOV", "a/IMG_1.jpg", "b/IMG_1.MOV", "a/img_1.jpg", "x.JPG", "x.mov"])
    pairs = relations.live_photo_pairs(media)
    found = {(r.image_path, r.video_path): r.pair_id for r in pairs.collect()}
    assert set(found) == {("a/IMG_1.HEIC", "a/IMG_1.MOV"), ("a/IMG_1.jpg", "a/IMG_1.MOV"), ("x.JPG", "x.mov")}
    ids = {r.relative_path: r.live_photo_pair_id for r in relations.set_pair_id(media, pairs).collect()}
    assert ids["a/IMG_1.MOV"] == found["a/IMG_1.jpg", "a/IMG_1.MOV"]
    assert ids["a/IMG_1.HEIC"] != ids["a/IMG_1.MOV"] and ids["b/IMG_1.MOV"] is None
    assert tuple(relations.pair_counts(pairs).first()) == (3, 6)


def test_edited_variants(spark):
    media = _media(spark, ["a/x-edited.jpg", "a/x.jpg", "a/y-EDITED.jpg", "a/y.jpg", "b/x-edited.jpg",
                           "a/x-edited-edited.jpg", "a/z-edited(1).jpg", "a/z.jpg", "café.jpg", "café-edited.jpg"])
    variants = relations.edited_variants(media)
    assert {(r.edited_path, r.original_path) for r in variants.collect()} == {
        ("a/x-edited.jpg", "a/x.jpg"), ("a/x-edited-edited.jpg", "a/x-edited.jpg"), ("a/z-edited(1).jpg", "a/z.jpg"),
        ("café-edited.jpg", "café.jpg")}
    rows = {r.relative_path: r.original_media_item_id for r in relations.set_original_id(media, variants).collect()}
    assert rows["a/x-edited.jpg"] == "id a/x.jpg" and rows["a/x.jpg"] is None
    assert tuple(relations.variant_counts(media, variants).first()) == (4, 4, 0)
    stored = media.filter("relative_path <> 'a/x.jpg'")
    assert tuple(relations.variant_counts(stored, variants).first()) == (3, 3, 1)


def test_duplicates(spark):
    rows = [("a", 1, "x", 3), ("b", 1, "x", 2), ("c", 2, "x", 1), ("d", 1, None, 0), ("e", 1, None, 0)]
    df = spark.createDataFrame(rows, "relative_path string, file_size bigint, crc32 string, t int").withColumn(
        "first_seen_timestamp", F.timestamp_seconds("t"))
    got = {(r.relative_path, r.copies, r.first_path, r.is_first) for r in relations.duplicate_groups(df).collect()}
    assert got == {("a", 2, "b", False), ("b", 2, "b", True)}


def test_people(spark):
    names = spark.createDataFrame([("m1", ["A", "B", "A"]), ("m2", [])], "media_item_id string, people array<string>")
    stored_people = spark.createDataFrame([("p1", "A"), ("p9", "Z")], "person_id string, person_name string")
    stored = spark.createDataFrame([("m1", "p9", 0), ("m2", "p9", 0)],
                                   "media_item_id string, person_id string, tag_order int")
    everyone, tags = jobs.tag_people(names, stored_people, stored)
    ids = {r.person_name: r.person_id for r in everyone.collect()}
    assert ids["A"] == "p1" and ids["Z"] == "p9" and set(ids) == {"A", "B", "Z"}
    got = {r.media_item_id: r.names for r in people.people_of(tags, everyone).collect()}
    assert got == {"m1": ["A", "B"], "m2": ["Z"]}


def test_time_matching_boundaries(spark):
    sidecars = spark.createDataFrame([("A", "s1", 100), ("A", "s2", None), ("B", "s3", 100)],
                                     "album string, path string, taken_seconds bigint")
    media = spark.createDataFrame([("A", "m3", 102.0), ("A", "m2", 97.9), ("A", "m1", 102.1), ("A", "m0", None)],
                                  "album string, path string, t double").select(
        "album", "path", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")).alias("media_time"))
    got = {(r.sidecar_path, r.media_path) for r in time_match.match_by_time(sidecars, media, 2).collect()}
    assert got == {("s1", "m3")}


ZIP = [("z1.zip", "zip", "a", 1, 11), ("z1.zip", "zip", "b?", 2, 22), ("z2.zip", "zip", "a", 1, 11),
       ("z2.zip", "zip", "b", 2, 22), ("z2.zip", "zip", "c", 3, 33), ("t.tgz", "tgz", "../a", 1, None),
       ("t.tgz", "tgz", "b", 2, None)]
MANIFEST = "archive string, format string, member string, size bigint, crc32 bigint"
EXTRACTED = "archive string, path string, size bigint, crc32 bigint"


def test_archives(spark):
    manifest = spark.createDataFrame(ZIP, MANIFEST)
    there = spark.createDataFrame(
        [("z1.zip", "b_", 2, 0), ("z2.zip", "a", 9, 11), ("z2.zip", "b", 2, 0), ("z2.zip", "c", 3, 33), ("t.tgz", "b", 2, 5)],
        EXTRACTED)
    verified = archives.verify_archives(manifest, there)
    assert {(r.archive, r.member): r.status for r in verified.collect()} == {
        ("z1.zip", "a"): "missing", ("z1.zip", "b?"): "not_checked", ("z2.zip", "a"): "size_mismatch",
        ("z2.zip", "b"): "crc_mismatch", ("z2.zip", "c"): "ok", ("t.tgz", "../a"): "unverifiable",
        ("t.tgz", "b"): "unverifiable"}
    verdicts = {r.archive: (r.bad_members, r.extract_all, r.valid) for r in archives.archive_verdicts(verified).collect()}
    assert verdicts == {"z1.zip": (1, False, False), "z2.zip": (2, False, False), "t.tgz": (0, True, False)}
    done = spark.createDataFrame([("z2.zip", "a", 1, 11), ("z2.zip", "c", 3, 33), ("t.tgz", "b", 2, None)], EXTRACTED)
    plan = {(r.archive, r.member): r.action for r in archives.resume_plan(manifest, done, there).collect()}
    assert plan == {
        ("z1.zip", "a"): "extract", ("z1.zip", "b?"): "extract", ("z2.zip", "a"): "re-extract",
        ("z2.zip", "b"): "extract", ("z2.zip", "c"): "skip", ("t.tgz", "../a"): "unsafe", ("t.tgz", "b"): "skip"}


def test_runs(spark):
    run = runs.complete_run(
        runs.update_run(runs.start_run(spark, "r1", _at(100)), media_files_processed=50), _at(110))
    row = run.first()
    assert (row.status, row.duration_seconds, row.files_per_second) == ("completed", 10.0, 5.0)
    idle = runs.complete_run(runs.start_run(spark, "r2", _at(100)), _at(100), "failed").first()
    assert (idle.status, idle.files_per_second) == ("failed", 0.0)
    with pytest.raises(ValueError):
        runs.update_run(run, nonsense=1)
    log = run.withColumn("w", F.lit(2)).unionByName(runs.start_run(spark, "r1", _at(100)).withColumn("w", F.lit(1)))
    assert [r.status for r in runs.latest_state(log, "w").collect()] == ["completed"]
    assert runs.latest_run(run.unionByName(runs.start_run(spark, "r3", _at(300)))).first().scan_run_id == "r3"


def test_retention(spark):
    table = spark.range(15).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("scan_run_id"),
        F.timestamp_seconds("id").alias("start_timestamp"))
    errors = table.select("scan_run_id", F.lit("e").alias("message")).unionByName(
        spark.createDataFrame([("unknown", "e")], "scan_run_id string, message string"))
    kept, kept_errors, counts = runs.retain_runs(table, errors, 10)
    assert {r.scan_run_id for r in kept.collect()} == {f"r{i}" for i in range(5, 15)}
    assert kept_errors.count() == 11  # errors of a run nobody knows stay
    assert tuple(counts.first()) == (5, 5)


def test_constraints(spark):
    rows = [("ok", 1, "0" * 8, 5.0, "present", 45.0, 3), ("bad", -1, "0", 0.0, "lost", 91.0, 9)]
    df = spark.createDataFrame(rows, "relative_path string, file_size int, crc32 string, frame_rate double, "
                                     "status string, exif_gps_latitude double, exif_orientation int")
    rules = {k: v for k, v in constraints.media_rules().items() if k in df.columns}
    good, bad = constraints.check_constraints(df, rules, ["relative_path"])
    assert [r.relative_path for r in good.collect()] == ["ok"]
    assert set(bad.first().violations) == set(df.columns) - {"relative_path"}
    assert constraints.repeated_keys(df.unionByName(df), ["relative_path"]).count() == 2
    everything = runs.start_run(spark, "r", _at(1))
    assert constraints.check_table(everything, "scan_runs")[1].count() == 0
    tags = spark.createDataFrame([("m", "p", -1), ("m", "q", None)], "media_item_id string, person_id string, tag_order int")
    broken = {tuple(r.violations) for r in constraints.check_table(tags, "people_tags")[1].collect()}
    assert broken == {("tag_order",), ("tag_order_required",)}


def test_reports_on_empty_tables(spark):
    items = _items(spark, [])
    assert tuple(reports.validation_summary(items).first()) == (0, 0, 0, 0, 0)
    albums = spark.createDataFrame([], "album_folder_path string, status string, scan_run_id string")
    assert tuple(reports.album_status(albums).first()) == (0, 0, 0)
    errors = spark.createDataFrame([], "scan_run_id string, error_type string, error_category string")
    run = runs.start_run(spark, "r", _at(1))
    summary = reports.run_summary(run, errors, items, albums, "r").first()
    assert summary.errors.total == 0 and summary.file_status == {} and summary.albums.present == 0
    checks = {r.name: r["pass"] for r in reports.consistency_checks(run, items, albums).collect()}
    assert len(checks) == 5 and all(checks.values())


def test_lookups(spark):
    items = _items(spark, STORED)
    assert lookups.media_by_path(items, "back").count() == 1
    assert lookups.media_by_id(items, "3").first().relative_path == "content"
    assert lookups.media_by_status(items, "present").count() == 6
