import json

from pyspark.sql import functions as F

from mediacat.functions import exif, times
from mediacat.operators import albums, media
from mediacat.schemas import EXIF_DUMP, MEDIA_ITEMS, PROBE_DUMP, columns


def _parse(spark, *docs):
    rows = [(str(i), d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    df = media.parse_sidecars(spark.createDataFrame(rows, "path string, raw string"))
    return [r for r in df.orderBy(F.col("path").cast("int")).collect()]


def test_sidecar_times(spark):
    rows = _parse(
        spark,
        {"photoTakenTime": {"timestamp": "1609459200", "formatted": "x"}},
        {"photoTakenTime": 1609459200},
        {"photoTakenTime": "2021-05-05 text"},
        {"photoTakenTime": {"formatted": "Jan 1, 2021, 12:00:00 AM UTC"}},
        {"photoTakenTime": {"formatted": "2021-01-01 00:00:00"}},
        {"photoTakenTime": {"formatted": "2021-01-01T00:00:00Z"}},
        {"photoTakenTime": {"timestamp": "soon"}},
        {"photoTakenTime": None, "creationTime": {"timestamp": "1609459200"}},
        {"creationTime": {"timestamp": "1609459200"}},
        {"photoTakenTime": {"timestamp": "99999999999999"}},
        {},
    )
    iso = "2021-01-01T00:00:00+00:00"
    assert [r.taken for r in rows] == [
        iso, iso, "2021-05-05 text", iso, iso, "2021-01-01T00:00:00Z", None, None, None, None, None]
    assert [r.has_taken for r in rows] == [True] * 8 + [False, True, False]
    assert [r.creation for r in rows] == [None] * 8 + [iso, None, None]
    assert [r.has_creation for r in rows] == [False] * 8 + [True, False, False]


def test_sidecar_fields(spark):
    full, fallback, broken, odd = _parse(
        spark,
        {"title": "t", "description": "d", "geoData": {"latitude": 1.5, "longitude": "2.5", "altitude": "high"},
         "geoDataExif": {"latitude": 9}, "people": [{"name": "A"}, {}, {"name": "B"}], "url": "u",
         "imageViews": "7", "googlePhotosOrigin": {"mobileUpload": {}}, "appSource": {"androidPackageName": "p"}},
        {"geoDataExif": {"latitude": 9, "latitudeSpan": 0.5}},
        '{"title": ',
        '{"people": "nobody"}',
    )
    assert (full.json_title, full.latitude, full.longitude, full.altitude) == ("t", 1.5, 2.5, None)
    assert full.people == ["A", "B"] and full.image_views == "7"
    assert json.loads(full.origin) == {"mobileUpload": {}}
    assert (fallback.latitude, fallback.latitude_span, fallback.people) == (9.0, 0.5, [])
    assert not broken.parsed and broken.json_title is None and broken.people == []
    assert odd.parsed and odd.people == []


def test_filename_times(column_of):
    names = ["IMG_20130608_143022.jpg", "VID_20130608_143022.mp4", "x20130608_143022y.jpg", "2013-06-08 14.30.22.jpg",
             "2013-06-08.jpg", "IMG_20131308_143022 2013-06-09.jpg", "IMG_20130608_143060.jpg", "none.jpg"]
    iso = lambda n: times.iso_text(times.filename_time(n))
    day = "2013-06-08T14:30:22+00:00"
    assert column_of(names, iso) == [day, day, day, day, "2013-06-08T00:00:00+00:00", "2013-06-09T00:00:00+00:00",
                                     None, None]


def test_reliable_exif(column_of):
    stamps = ["2000-01-01 00:00:30", "2000-01-01 00:01:00", "2015-01-01 07:00:00", "2015-01-01 07:00:01",
              "1989-12-31 00:00:01", "2020-06-01 00:00:00", "2025-01-01 23:59:59", "2025-01-02 00:00:00", None]
    judge = lambda t: times.reliable_exif(t.cast("timestamp"), F.lit("2024-01-02").cast("timestamp"))
    # The last stamp is 366 whole days ahead, the one before it 365 and some hours.
    assert column_of(stamps, judge) == [False, True, False, True, False, True, True, False, False]
    late = lambda t: times.reliable_exif(t.cast("timestamp"), F.lit("2024-01-01").cast("timestamp"))
    # 366 whole days ahead is too far, one second less is not.
    assert column_of(["2025-01-01 12:00:00", "2025-01-01 23:59:59"], late) == [False, False]
    assert column_of(["2024-12-31 23:59:59"], late) == [True]


def test_capture_precedence(spark):
    stamp = lambda text: F.lit(text).cast("timestamp")
    none, now = F.lit(None).cast("timestamp"), stamp("2024-01-01")
    yes, no = F.lit(True), F.lit(False)
    name = F.lit("IMG_20130608_143022.jpg")
    cases = [
        (stamp("2019-05-05 01:02:03"), stamp("2018-05-05"), yes, stamp("2017-05-05"), no, none, "2019-05-05T01:02:03"),
        (stamp("2000-01-01"), stamp("2018-05-05"), yes, stamp("2017-05-05"), no, none, "2018-05-05T00:00:00"),
        (none, none, yes, stamp("2017-05-05"), no, none, "2017-05-05T00:00:00"),
        (none, none, yes, none, yes, stamp("2016-05-05"), None),
        (none, none, no, none, yes, stamp("2016-05-05"), "2016-05-05T00:00:00"),
        (none, none, no, none, no, none, "2013-06-08T14:30:22"),
    ]
    for *args, expected in cases:
        got = spark.range(1).select(times.iso_text(times.capture_time(*args, name, now))).first()[0]
        assert got == (expected + "+00:00" if expected else None)


def test_exif_values(column_of):
    text = lambda make: (lambda v: times.iso_text(make(v)))
    assert column_of(["2020:01:02 03:04:05", "2020:01:02", "2020:13:02 03:04:05", "a b c"], text(times.exif_time)) == [
        "2020-01-02T03:04:05+00:00", None, None, None]
    assert column_of(["1/2", "3", "1/0", "x", None], exif.rational) == [0.5, 3.0, None, None, None]
    assert column_of(["37 deg 30' 36.00\" S", "37 deg 30' 36.00\" N", "37.5 W", "-1.25", "x deg"], exif.gps_text) == [
        -37.51, 37.51, 37.5, -1.25, None]
    assert column_of(["10.5 m", "3 m Below Sea Level", "x"], exif.altitude_text) == [10.5, -3.0, None]
    assert column_of(["50.0 mm", "1.8", "f"], exif.number_with_unit) == [50.0, 1.8, None]
    assert column_of(["Rotate 90 CW", "6", "Horizontal"], exif.orientation) == [90, 6, None]
    assert column_of([0, 1, 8, 9], exif.valid_orientation, "v int") == [None, 1, 8, None]
    assert column_of([0, 1, 5, None], exif.flash, "v int") == [
        "Flash did not fire", "Flash fired", "Flash fired", None]
    assert column_of([0, 1], exif.white_balance, "v int") == ["Auto", "Manual"]
    assert column_of(["30000/1001", "25", "0/0"], exif.frame_rate) == [30000 / 1001, 25.0, None]
    dms = lambda p: exif.gps_dms(p, F.lit("W"))
    assert column_of([["10", "30", "36/1"], ["10", "30"]], dms, "v array<string>") == [-10.51, None]


def test_tags_and_probes(spark):
    tags = spark.createDataFrame(
        [("a", {"DateTimeOriginal": "2020:01:02 03:04:05", "CreateDate": "2019:01:01 00:00:00", "Make": " M ",
                "ISO": "100", "Flash": "1", "WhiteBalance": "Auto", "ImageWidth": "640"}),
         ("b", {"CreateDate": "2019:01:01 00:00:00"})], EXIF_DUMP)
    a, b = media.normalize_tags(tags).orderBy("path").collect()
    assert a.datetime_digitized is None and b.datetime_digitized is not None
    assert (a.camera_make, a.iso, a.flash, a.white_balance, a.exif_width) == ("M", 100, "Flash fired", "Auto", 640)
    probe = spark.createDataFrame(
        [("v", ("1.5",), [("audio", None, None, "0/0", "0/0"), ("video", 320, 240, None, "25/1"),
                          ("video", 1, 1, "1/1", "1/1")])], PROBE_DUMP)
    row = media.normalize_probe(probe).first()
    assert (row.duration_seconds, row.frame_rate, row.video_width) == (1.5, 25.0, 320)


def test_media_record_has_the_stored_columns(spark):
    links = spark.createDataFrame([("A/IMG_20130608_143022.jpg", "A", None, None)],
                                  "path string, album string, sidecar_path string, phase int")
    merged = media.merge_metadata(
        links, media.parse_sidecars(spark.createDataFrame([], "path string, raw string")),
        media.normalize_tags(spark.createDataFrame([], EXIF_DUMP)),
        media.normalize_probe(spark.createDataFrame([], PROBE_DUMP)),
    ).withColumn("album_id", F.lit("album"))
    digests = media.hash_content(
        spark.createDataFrame([("A/IMG_20130608_143022.jpg", bytearray(b"x"))], "path string, content binary"))
    items = media.media_record(merged, digests, "r", F.lit("2024-01-01").cast("timestamp"))
    assert items.columns == columns(MEDIA_ITEMS)
    row = items.first()
    assert row.title == "IMG_20130608_143022" and row.file_size == 1 and row.status == "present"
    assert items.select(times.iso_text(F.col("capture_timestamp"))).first()[0] == "2013-06-08T14:30:22+00:00"
    expected = {f.split()[0]: f.split()[1] for f in MEDIA_ITEMS.split(",")}
    assert dict(items.dtypes) == expected


def test_album_json_and_discovery(spark):
    raw = spark.createDataFrame(
        [("U/metadata.json", '{"title":"","description":"d","access":"public","date":{"timestamp":"0"}}'),
         ("Photos from 2020/metadata.json", "{bad")], "path string, raw string")
    files = spark.createDataFrame(
        [("U/a.jpg", "U", "a.jpg"), ("photos from 2019/a.jpg", "photos from 2019", "a.jpg"),
         ("Photos from 2020/a.jpg", "Photos from 2020", "a.jpg"), ("x.html", "", "x.html")],
        "path string, album string, name string")
    rows = {r.album_folder_path: r for r in
            albums.discover_albums(files, albums.parse_album_json(raw), "r").collect()}
    assert set(rows) == {"U", "photos from 2019", "Photos from 2020"}
    assert (rows["U"].title, rows["U"].album_kind, rows["U"].status) == ("U", "user", "present")
    assert rows["photos from 2019"].title == "Photos from 2019"
    assert (rows["Photos from 2020"].status, rows["Photos from 2020"].title) == ("error", "Photos from 2020")
