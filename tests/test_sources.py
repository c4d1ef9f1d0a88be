import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from mediacat.operators import archives, reports
from mediacat.plans import jobs
from mediacat.schemas import EXIF_DUMP, MEDIA_ITEMS, PROBE_DUMP
from mediacat.sources import archives as archive_source, content, inventory, sinks


JPEG = bytes.fromhex("FFD8FFE000104A464946")


def _write(root, files):
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture()
def export(tmp_path):
    inner = tmp_path / "Takeout" / "Google Photos"
    taken = json.dumps({"title": "photo.jpg", "photoTakenTime": {"timestamp": "1609459200"}, "people": [{"name": "A"}]})
    _write(inner, {
        "Photos from 2021/photo.jpg": JPEG + b"1",
        "Photos from 2021/photo.jpg.supplemental-metadata.json": taken,
        "Photos from 2021/photo-edited.jpg": JPEG + b"2",
        "Photos from 2021/.hidden.jpg": JPEG,
        "Photos from 2021/_under.jpg": JPEG,
        "Photos from 2021/empty.jpg": b"",
        "Photos from 2021/bad.png": b"\x89PNG\r\n\x1a\n",
        "Photos from 2021/bad.png.json": "{oops",
        "Trip é+ 1/metadata.json": json.dumps({"title": "Trip", "access": "public"}),
        "Trip é+ 1/deep/a b.jpg": JPEG * 20_000,
        "Trip é+ 1/Thumbs.db": b"x",
        "archive_browser.html": b"x",
    })
    _write(tmp_path, {"outside.txt": b"x"})
    return tmp_path


def test_inventory(spark, export):
    rows = {r.path: r for r in jobs.catalog_files(spark, str(export)).collect()}
    assert len(rows) == 12
    assert rows["Photos from 2021/.hidden.jpg"].is_hidden and rows["Photos from 2021/empty.jpg"].size == 0
    assert rows["Trip é+ 1/deep/a b.jpg"].album == "Trip é+ 1/deep"
    kinds = {p: r.kind for p, r in rows.items()}
    assert kinds["archive_browser.html"] == "other" and kinds["Trip é+ 1/metadata.json"] == "album_metadata"
    assert kinds["Photos from 2021/_under.jpg"] == "media" and kinds["Trip é+ 1/Thumbs.db"] == "other"


def test_digests_agree_with_columns(spark, export):
    from mediacat.operators import media

    root = inventory.scan_root(str(export))
    files = inventory.file_inventory(spark, str(export))
    by_task = {r.path: tuple(r) for r in content.file_digests(files, root).collect()}
    assert len(by_task) == 12
    by_column = {r.path: tuple(r) for r in media.hash_content(content.file_content(spark, root)).collect()}
    assert by_column and all(by_task[p] == row for p, row in by_column.items())
    assert "Trip é+ 1/deep/a b.jpg" in by_column
    gone = spark.createDataFrame([("nowhere.jpg",)], "path string")
    assert content.file_digests(gone, root).first().crc32 is None


def test_content_column_is_not_read_for_listings(spark, export):
    listed = content.file_content(spark, str(export)).select("path")
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_scan_of_an_export(spark, export):
    now = F.lit("2024-01-01").cast("timestamp")
    exif = spark.createDataFrame([], EXIF_DUMP)
    probe = spark.createDataFrame([], PROBE_DUMP)
    scan = jobs.scan_export(spark, str(export), exif, probe, "run", now, now)
    items = {r.relative_path: r for r in scan.items.collect()}
    assert set(items) == {
        "Photos from 2021/photo.jpg", "Photos from 2021/photo-edited.jpg", "Photos from 2021/.hidden.jpg",
        "Photos from 2021/_under.jpg", "Photos from 2021/empty.jpg", "Photos from 2021/bad.png", "Trip é+ 1/deep/a b.jpg"}
    photo = items["Photos from 2021/photo.jpg"]
    assert photo.mime_type == "image/jpeg" and photo.capture_timestamp.timestamp() == 1609459200
    assert items["Photos from 2021/photo-edited.jpg"].title == "photo.jpg"  # shares the sidecar
    albums = {r.album_folder_path: r for r in scan.albums.collect()}
    assert albums["Trip é+ 1"].title == "Trip" and set(albums) == {"Trip é+ 1", "Photos from 2021"}
    assert photo.album_id == albums["Photos from 2021"].album_id
    assert [r.relative_path for r in scan.errors.collect()] == ["Photos from 2021/bad.png.json"]
    run = scan.run.first()
    assert (run.media_files_discovered, run.metadata_files_discovered, run.media_files_with_metadata) == (7, 2, 3)
    assert (run.media_files_processed, run.albums_total) == (7, 2)
    assert (run.media_new_files, run.media_changed_files, run.media_error_files) == (7, 0, 0)

    sinks.write_catalog(scan.items, str(export / "catalog"), 1)
    stored = sinks.read_catalog(spark, str(export / "catalog"), 1)
    later = F.lit("2024-02-01").cast("timestamp")
    (export / "Takeout/Google Photos/Photos from 2021/_under.jpg").unlink()
    (export / "Takeout/Google Photos/Photos from 2021/empty.jpg").write_bytes(b"now full")
    again = jobs.scan_export(spark, str(export), exif, probe, "run 2", later, later, stored, scan.albums)
    states = {r.relative_path: (r.status, r.scan_run_id, r.first_seen_timestamp == r.last_seen_timestamp)
              for r in again.items.collect()}
    second = again.run.first()
    assert (second.media_new_files, second.media_changed_files, second.media_unchanged_files, second.missing_files) == (0, 1, 5, 1)
    assert reports.counter_audit(again.run, again.items, again.albums, "run 2").first().media_difference == 0
    assert states["Photos from 2021/_under.jpg"] == ("missing", "run", True)
    assert states["Photos from 2021/empty.jpg"] == ("present", "run 2", True)
    assert states["Photos from 2021/photo.jpg"] == ("present", "run 2", False)
    assert reports.fs_vs_catalog(again.files, again.items).count() == 1  # Thumbs.db is never catalogued


def test_archives_on_disk(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b-001.zip", "w") as z:
        z.writestr("A/x?.jpg", b"hello")
        z.writestr("A/ü.jpg", b"")
    with tarfile.open(tmp_path / "a-002.tgz", "w:gz") as t:
        source = tmp_path / "note.txt"
        source.write_text("text")
        t.add(source, "A/note.txt")
    (tmp_path / "c.zip").write_bytes(b"not a zip")
    found = inventory.archive_inventory(spark, str(tmp_path))
    assert [r.name for r in found.collect()] == ["a-002.tgz", "b-001.zip", "c.zip"]
    rows = {(r.archive, r.member): (r.size, r.crc32) for r in
            archive_source.archive_manifest(found, str(tmp_path)).collect()}
    assert rows[("a-002.tgz", "A/note.txt")] == (4, None)
    assert rows[("b-001.zip", "A/x?.jpg")] == (5, 0x3610A686) and len(rows) == 4
    assert rows[("c.zip", None)] == (None, None)
    extracted = spark.createDataFrame([("b-001.zip", "A/x_.jpg", 5, 0x3610A686), ("b-001.zip", "A/ü.jpg", 0, 0)],
                                      "archive string, path string, size bigint, crc32 bigint")
    verdicts = archives.archive_verdicts(jobs.verify_export_archives(spark, str(tmp_path), extracted))
    assert {r.archive: r.valid for r in verdicts.collect()} == {"b-001.zip": True, "a-002.tgz": False, "c.zip": False}


def test_from_archive_and_folder_to_verdict(spark, tmp_path):
    archives_at, out = tmp_path / "archives", tmp_path / "out"
    archives_at.mkdir()
    with zipfile.ZipFile(archives_at / "one.zip", "w") as z:
        z.writestr("A/u\u0308.jpg", b"decomposed")  # extracted under its composed name
        z.writestr("A/x.jpg", b"hello")
    with zipfile.ZipFile(archives_at / "two.zip", "w") as z:
        z.writestr("B/y.jpg", b"world")
    cut = (archives_at / "two.zip").read_bytes()
    (archives_at / "cut.zip").write_bytes(cut[: len(cut) // 2])
    _write(out / "one", {"A/\u00fc.jpg": "decomposed", "A/x.jpg": "hello"})
    _write(out / "two", {"B/y.jpg": "wOrld"})
    found = jobs.extracted_files(spark, str(out / "one"), "one.zip").unionByName(
        jobs.extracted_files(spark, str(out / "two"), "two.zip"))
    verified = jobs.verify_export_archives(spark, str(archives_at), found)
    assert {(r.archive, r.member, r.status) for r in verified.collect()} == {
        ("one.zip", "A/u\u0308.jpg", "ok"), ("one.zip", "A/x.jpg", "ok"), ("two.zip", "B/y.jpg", "crc_mismatch"),
        ("cut.zip", None, "unreadable")}
    twice = found.unionByName(found.withColumn("path", F.translate("path", "\u00fc", "\u00fc")))
    assert jobs.verify_export_archives(spark, str(archives_at), twice).count() == 4


def test_resume_with_digests_of_the_library(spark):
    manifest = spark.createDataFrame(
        [("a.zip", "zip", "A/u\u0308.jpg", 5, 7), ("a.zip", "zip", "A/x.jpg", 5, 255), ("a.zip", "zip", "A/new.jpg", 1, 1)],
        "archive string, format string, member string, size bigint, crc32 bigint")
    done = spark.createDataFrame([("a.zip", "A/\u00fc.jpg", 5, 7), ("a.zip", "A/x.jpg", 5, 255)],
                                 "archive string, path string, size bigint, crc32 bigint")
    found = spark.createDataFrame([("a.zip", "A/\u00fc.jpg", 5, "00000007"), ("a.zip", "A/u\u0308.jpg", 5, "00000007"),
                                   ("a.zip", "A/x.jpg", 5, "000000fe")], "archive string, path string, size bigint, crc32 string")
    rows = sorted((r.member, r.action) for r in archives.resume_plan(manifest, done, found).collect())
    assert rows == [("A/new.jpg", "extract"), ("A/u\u0308.jpg", "skip"), ("A/x.jpg", "re-extract")]


def test_no_sidecar_is_lost(spark, tmp_path):
    text = '{"title":"T","photoTakenTime":{"timestamp":"1609459200"},"people":[{"name":"Ann"}]}'
    base = "Takeout/Google Photos/"
    _write(tmp_path, {
        base + "Trip/_x.jpg": "1", base + "Trip/_x.jpg.json": text, base + "Trip/.h.jpg": "2", base + "Trip/.h.jpg.json": text,
        base + "Trip/e.jpg": "3", base + "Trip/e.jpg.json": "", base + "_Under/metadata.json": '{"title":"Under"}', base + "_Under/a.jpg": "4",
    })
    now = F.lit("2024-01-01").cast("timestamp")
    scan = jobs.scan_export(spark, str(tmp_path), spark.createDataFrame([], EXIF_DUMP), spark.createDataFrame([], PROBE_DUMP), "run", now, now)
    items = {r.relative_path: r for r in scan.items.collect()}
    for name in ("Trip/_x.jpg", "Trip/.h.jpg"):
        assert items[name].sidecar_fingerprint and items[name].capture_timestamp.timestamp() == 1609459200
    assert [r.relative_path for r in scan.errors.collect()] == ["Trip/e.jpg.json"]
    assert [r.person_name for r in scan.people.collect()] == ["Ann"] and scan.people_tags.count() == 2
    assert {r.title for r in scan.albums.collect()} == {"Trip", "Under"}


def test_dumps_logs_and_error_sink(spark, tmp_path):
    _write(tmp_path, {
        "exif.json": json.dumps([{"SourceFile": "a.nef", "ISO": 200, "Make": "M"}]),
        "probe.json": json.dumps({"format": {"filename": "v.mov", "duration": "2.5"},
                                  "streams": [{"codec_type": "video", "width": 3, "height": 2, "r_frame_rate": "30/1"}]}),
        "scan.log": "2024 - INFO - Scanning complete\n2024 - ERROR - x\n",
    })
    assert content.exif_dump(spark, str(tmp_path / "exif.json")).first().tags == {"ISO": "200", "Make": "M"}
    probe = content.probe_dump(spark, str(tmp_path / "probe.json")).first()
    assert probe.path == "v.mov" and probe.streams[0].width == 3
    profile = reports.log_profile(content.scan_log(spark, str(tmp_path / "scan.log"))).collect()
    assert {(r.section, r.key): r["count"] for r in profile} == {
        ("lines", "total"): 2, ("level", "info"): 1, ("level", "error"): 1, ("event", "scan_complete"): 1}
    errors = spark.createDataFrame([("r", "p", "media_file", "io_error", "m")],
                                   "scan_run_id string, relative_path string, error_type string, "
                                   "error_category string, error_message string").withColumn("timestamp", F.current_timestamp())
    for _ in range(2):
        sinks.write_errors(errors, str(tmp_path / "errors"))
    assert spark.read.parquet(str(tmp_path / "errors")).count() == 2
    assert os.path.isdir(tmp_path / "errors" / "scan_run_id=r")


def _row(spark, path, fingerprint, seen):
    names = [f.split()[0] for f in MEDIA_ITEMS.split(",") if f.strip()]
    empty = spark.createDataFrame([], MEDIA_ITEMS).schema
    values = dict.fromkeys(names)
    values |= {"relative_path": path, "media_item_id": path + fingerprint, "content_fingerprint": fingerprint,
               "album_id": "a", "file_size": 1, "scan_run_id": "new", "status": "present"}
    df = spark.createDataFrame([tuple(values[n] for n in names)], empty)
    stamp = F.timestamp_seconds(F.lit(seen))
    return df.withColumns({"first_seen_timestamp": stamp, "last_seen_timestamp": stamp})
