"""Sources on exports that are large in one place, and bytes that are not plain text."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from mediacat.operators import media, reports
from mediacat.sources import content, inventory, json_records as records
from mediacat.sources.mounts import Mount


def _write(root, files):
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())


# --- listing ---------------------------------------------------------------------

def test_subfolders_of_one_folder_are_dealt_out(spark, tmp_path):
    _write(tmp_path, {f"Album/{i:03d}/x.jpg": "x" for i in range(300)} | {"Album/top.jpg": "t", "root.jpg": "r"})
    listed = inventory.listed_files(spark, str(tmp_path))
    assert listed.rdd.getNumPartitions() > 100
    rows = {r.path: (r.album, r.name, r.size) for r in listed.collect()}
    assert len(rows) == 302 and rows["Album/007/x.jpg"] == ("Album/007", "x.jpg", 1) and rows["root.jpg"][0] == ""


def test_album_filter_lists_only_that_folder(spark, tmp_path, monkeypatch):
    _write(tmp_path, {"A/x.jpg": "1", "A/deep/y.jpg": "2", "B/z.jpg": "3", "B/deep/w.jpg": "4"})
    listed = inventory.listed_files(spark, str(tmp_path))
    assert [r.path for r in listed.filter("album = 'B'").collect()] == ["B/z.jpg"]
    assert sorted(r.path for r in listed.filter("album IN ('A', 'B/deep', 'none')").collect()) == ["A/x.jpg", "B/deep/w.jpg"]
    assert sorted(r.path for r in listed.filter("startswith(album, 'B')").collect()) == ["B/deep/w.jpg", "B/z.jpg"]

    from pyspark.sql.datasource import EqualTo, StringStartsWith

    def seen_by(*filters):
        reader, asked = inventory.FileInventoryReader(str(tmp_path)), []
        entries = reader.mount.entries
        monkeypatch.setattr(reader.mount, "entries", lambda folder: asked.append(folder) or entries(folder))
        list(reader.pushFilters(list(filters)))
        for part in reader.partitions():
            list(reader.read(part))
        return set(asked)

    assert seen_by(EqualTo(("album",), "B")) == {"B"}
    assert seen_by(StringStartsWith(("album",), "B")) == {"", "B", "B/deep"}


def test_planning_is_bounded(tmp_path, monkeypatch):
    _write(tmp_path, {f"{i}/{j}/x.jpg": "x" for i in range(12) for j in range(5)})
    monkeypatch.setattr(inventory, "_PLANNED", 3)
    reader = inventory.FileInventoryReader(str(tmp_path), units=40)
    parts = reader.partitions()
    assert sum(deep for p in parts for _, deep in p.units) == 12
    assert len([r for p in parts for r in reader.read(p)]) == 60


def test_locations_by_uri(spark, tmp_path):
    _write(tmp_path, {"A é+/x y.jpg": b"\xff\xd8\xff1", "A é+/x y.jpg.json": "{}"})
    uri = tmp_path.as_uri()
    files = inventory.listed_files(spark, uri)
    assert {r.path for r in files.collect()} == {"A é+/x y.jpg", "A é+/x y.jpg.json"}
    assert {r.path: r.size for r in content.file_digests(files, uri).collect()}["A é+/x y.jpg"] == 4
    assert bytes(content.sidecar_json(files, uri).first().raw) == b"{}"
    for make in (lambda: Mount("nowhere://bucket/x").checked(), lambda: content.file_digests(files, "nowhere://bucket/x")):
        with pytest.raises(ValueError):
            make()


# --- bytes of sidecars -------------------------------------------------------------

def test_sidecars_are_hashed_and_parsed_byte_for_byte(spark, tmp_path):
    made = {
        "A/plain.json": b'{"title":"a"}', "A/lines.json": b'{\r\n"title":"b"\r\n}', "A/mark.json": b'\xef\xbb\xbf{"title":"c"}',
        "A/bad.json": b'{"title":"\xff\xfe"}', "A/empty.json": b"", "A/cut.json": b'{"title":"\xc3"}', "A/none.json": b"{oops",
    }
    _write(tmp_path, made)
    raw = content.sidecar_json(inventory.listed_files(spark, str(tmp_path)), str(tmp_path))
    parsed = {r.path: r for r in media.parse_sidecars(raw).collect()}
    assert {p: r.sidecar_fingerprint for p, r in parsed.items()} == {p: hashlib.sha256(b).hexdigest() for p, b in made.items()}
    assert {p: r.json_title for p, r in parsed.items() if r.parsed} == {"A/plain.json": "a", "A/lines.json": "b", "A/mark.json": "c"}
    errors = media.sidecar_errors(media.parse_sidecars(raw), "run", F.current_timestamp()).collect()
    assert {r.relative_path for r in errors} == {"A/bad.json", "A/empty.json", "A/cut.json", "A/none.json"}
    assert {r.error_category for r in errors} == {"parse_error"}


# --- dumps ---------------------------------------------------------------------------

def _value(rng, depth=0):
    kind = rng.random()
    if kind < 0.5 or depth > 2:
        return rng.choice(["a", '"', "\\", '\\"', "{", "}]", "é\n", "x" * 50, '\\\\"{', 3])
    if kind < 0.8:
        return [_value(rng, depth + 1) for _ in range(3)]
    return {str(_value(rng, 3)): _value(rng, depth + 1) for _ in range(2)}


@pytest.mark.parametrize("step", [3, 61, 1000, 1 << 24])
def test_objects_of_ranges(spark, tmp_path, step):
    rng = random.Random(step)
    made = {}
    for i in range(4 if step < 10 else 9):
        objects = [{f"k{n}": _value(rng) for n in range(rng.randint(0, 4))} for _ in range(rng.choice([0, 1, 3, 12]))]
        plain = rng.random() < 0.5
        text = [
            json.dumps(objects, ensure_ascii=plain), "﻿" + json.dumps(objects, indent=1, ensure_ascii=plain),
            "\n".join(json.dumps(o, ensure_ascii=plain) for o in objects),
        ][i % 3]
        made[f"d é+%41{i}.json"] = (text, objects)
    _write(tmp_path / "dumps", {n: t for n, (t, _) in made.items()})
    got = {}
    for r in records.json_records(spark, str(tmp_path / "dumps"), range_bytes=step).collect():
        got.setdefault(r.source.rsplit("/", 1)[1], []).append(r.record)
    want = {n: sorted(json.dumps(o) for o in objects) for n, (_, objects) in made.items() if objects}
    assert {n: sorted(json.dumps(json.loads(t)) for t in texts) for n, texts in got.items()} == want


def test_one_large_list_is_read_by_many_tasks(spark, tmp_path):
    objects = [{"SourceFile": f"/mnt/export/A/{i}.jpg", "ISO": i, "Make": "Mé"} for i in range(20_000)]
    (tmp_path / "exif.json").write_text(json.dumps(objects))
    found = records.json_records(spark, str(tmp_path / "exif.json"), range_bytes=50_000)
    assert found.filter("source IS NOT NULL").select(F.spark_partition_id().alias("p")).distinct().count() > 8
    tags = content.exif_dump(spark, str(tmp_path / "exif.json"), "/mnt/export/")
    assert tags.count() == 20_000
    assert tags.filter("path = 'A/77.jpg'").first().tags == {"ISO": "77", "Make": "Mé"}


def test_paths_of_dumps(spark, tmp_path):
    _write(tmp_path, {
        "exif.json": json.dumps([{"SourceFile": p, "ISO": 1} for p in ("/x/A/a.jpg", "./A/b.jpg", "A/c.jpg", "/xy/d.jpg")] + [{"ISO": 2}, 5]),
        "probe.json": json.dumps({"format": {"filename": "/x/A/v.mov", "duration": "2.5"}, "streams": []}) + '{"format": {}}',
    })
    assert {r.path for r in content.exif_dump(spark, str(tmp_path / "exif.json"), "/x").collect()} == {"A/a.jpg", "A/b.jpg", "A/c.jpg", "/xy/d.jpg"}
    assert [r.path for r in content.probe_dump(spark, str(tmp_path / "probe.json"), "file:/x/").collect()] == ["A/v.mov"]


# --- logs ------------------------------------------------------------------------------

def test_log_lines_in_order_of_files_and_places(spark, tmp_path):
    said = [f"2024 - INFO - Phase 1 (happy path): {i} matches" for i in range(4000)]
    _write(tmp_path / "logs", {"b.log": "\n".join(said[2000:]), "a.log": "\n".join(said[:2000])})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = set()
    try:
        for size in ("2000", "7001", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = content.scan_log(spark, str(tmp_path / "logs"))
            assert [r.value for r in lines.orderBy("line_no").collect()] == said
            seen.add(str(reports.log_match_statistics(lines.repartition(5)).first()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(seen) == 1
