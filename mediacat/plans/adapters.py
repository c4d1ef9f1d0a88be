"""The driver's tables seen as an export.

Every document is a media file: its text is the content, its id decides album, name and
sidecar. Names follow 24 shapes so that every linking phase, the unmatched cases and the
contested ones occur; ``oracle_tables`` states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mediacat.functions import content, ids, names
from mediacat.operators import errors as kinds

RUN_OLD, RUN_NEW = "run-1", "run-2"
# Fixed clock of the adapted scans, as seconds since 1970.
OLD_START, OLD_SEEN, NEW_START, NEW_SEEN = 1_700_000_000, 1_700_000_500, 1_710_000_000, 1_710_000_500


def at(seconds: int) -> Column:
    return F.timestamp_seconds(F.lit(seconds))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; its zoneless times are UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def _album(doc: Column) -> Column:
    return F.concat(F.lit("Photos from "), (F.lit(2015) + doc % 10).cast("string"))


def _pad(number: Column) -> Column:
    return F.lpad(number.cast("string"), 8, "0")


# Per shape: head and tail of the media name, how far back its number reaches, and head
# and tail of its sidecar name (None: no sidecar).
_FULL = ".supplemental-metadata.json"
_SHAPES = [
    ("IMG_", ".jpg", 0, "IMG_", ".jpg" + _FULL),
    ("IMG_", ".JPG", 0, "IMG_", ".jpg.suppl.json"),
    ("IMG_", "(2).jpg", 0, "IMG_", ".jpg.supplemental-metadata(2).json"),
    ("IMG_", "-edited.jpg", 3, None, None),
    ("DSC_", ".nef", 0, "DSC_", ".nef" + _FULL),
    ("21.12.11 - ", "", 0, "21.12.11 - ", _FULL),
    ("01.04(1).12 - ", "", 0, "01.04.12 - ", ".supplemental-metadata(1).json"),
    ("Screenshot_", "a1.jpg", 0, "Screenshot_", "a.jpg" + _FULL),
    ("LIVE_", ".HEIC", 0, "LIVE_", ".HEIC" + _FULL),
    ("LIVE_", ".MOV", 1, None, None),
    ("clip_", ".mkv", 0, "clip_", ".mkv" + _FULL),
    ("PXL_", ".jpg", 0, "PXL_", ".jpg" + _FULL),
    ("IMG_", ".jpg", 0, "IMG_", ".jpg" + _FULL),
    ("IMG_", ".JPG", 0, "IMG_", ".jpg.suppl.json"),
    ("IMG_", "(2).jpg", 0, "IMG_", ".jpg.supplemental-metadata(2).json"),
    ("IMG_", "-edited.jpg", 3, None, None),
    ("scan", "", 0, "scan", "_long" + _FULL),
    ("21.12.11 - ", "", 0, "21.12.11 - ", _FULL),
    ("01.04(1).12 - ", "", 0, "01.04.12 - ", ".supplemental-metadata(1).json"),
    ("Screenshot_", "a1.jpg", 0, "Screenshot_", "a.jpg" + _FULL),
    ("LIVE_", ".HEIC", 0, "LIVE_", ".HEIC" + _FULL),
    ("LIVE_", ".MOV", 1, None, None),
    ("Burst_", "x1.jpg", 0, "Burst_", "x.jpg" + _FULL),
    ("Burst_", "x2.jpg", 1, None, None),
]


def shaped(documents: DataFrame) -> DataFrame:
    """doc_id, album, media name and sidecar names of every document (text kept)."""
    doc, k, shape = F.col("doc_id"), F.col("k"), F.col("shape")

    def of_shape(field: int) -> Column:
        return F.get(F.array(*[F.lit(s[field]) for s in _SHAPES]), shape)

    return (
        documents.withColumn("album", _album(doc))
        .withColumn("k", F.floor(doc / 10).cast("bigint"))
        .withColumn("shape", (k % len(_SHAPES)).cast("int"))
        .withColumn("pad", _pad(k))
        .withColumns(
            {
                "media_name": F.concat(of_shape(0), _pad(k - of_shape(2)), of_shape(1)),
                "sidecar_name": F.concat(of_shape(3), F.col("pad"), of_shape(4)),
                "twin_name": F.when(shape == 11, F.concat(F.lit("PXL_"), "pad", F.lit(".JPG.s.json"))),
                "junk_name": F.when(doc % 50 == 7, F.concat(F.lit("cache_"), "pad", F.lit(".tmp"))),
                "page_name": F.when(
                    doc % 100 == 3, F.concat(F.lit("page_"), doc.cast("string"), F.lit(".html"))
                ),
                "meta_name": F.when((k == 0) & (doc % 10 < 6), F.lit("metadata.json")),
            }
        )
    )


def sidecar_text(doc: Column, name: Column) -> Column:
    """The JSON written for a document; one in 41 is cut short."""
    stamp = taken_seconds(doc).cast("string")
    kind = doc % 7

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    when_taken = (
        F.when(kind <= 3, text('"photoTakenTime":{"timestamp":"', stamp, '"},'))
        .when(kind == 4, text('"photoTakenTime":', stamp, ","))
        .when(kind == 5, text('"photoTakenTime":{"formatted":"Mar ', (F.lit(1) + doc % 28).cast("string"),
                              ', 2019, 1:02:03 PM UTC"},'))
        .otherwise(text('"creationTime":{"timestamp":"', stamp, '"},'))
    )
    place = text(
        F.when(doc % 11 == 0, '"geoDataExif"').otherwise('"geoData"'),
        ':{"latitude":', (doc * 7 % 180 - 90).cast("string"), '.5,"longitude":',
        (doc * 13 % 360 - 180).cast("string"), '.25,"altitude":', (doc % 900).cast("string"), ".0},",
    )
    people = F.when(
        doc % 3 == 0,
        text('"people":[{"name":"Person ', (doc % 17).cast("string"), '"},{},{"name":"Person ',
             (doc % 5 + 20).cast("string"), '"}],'),
    ).otherwise("")
    whole = text(
        '{"title":"', name, '","description":"about ', doc.cast("string"), '",', when_taken, place,
        people, '"url":"https://photos.example/p/', doc.cast("string"), '","imageViews":"',
        (doc % 100).cast("string"), '"}',
    )
    return F.when(doc % 41 == 0, text('{"title":"', name)).otherwise(whole)


def taken_seconds(doc: Column) -> Column:
    return F.lit(1_262_304_000) + doc * 7919 % 300_000_000


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, album, name, text of media files."""
    return shaped(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.concat("album", F.lit("/"), "media_name").alias("path"),
        "album",
        F.col("media_name").alias("name"),
        "text",
    )


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, album, name, raw of sidecar files."""
    docs = shaped(table(spark, sf_dir, "documents")).select(
        "doc_id", "album", "media_name",
        F.explode(F.array("sidecar_name", "twin_name")).alias("name"),
    ).filter(F.col("name").isNotNull())
    return docs.select(
        "doc_id",
        F.concat("album", F.lit("/"), "name").alias("path"),
        "album",
        "name",
        sidecar_text(F.col("doc_id"), F.col("media_name")).alias("raw"),
    )


def files(spark: SparkSession, sf_dir: str, sizes: bool = True) -> DataFrame:
    """The inventory: media, sidecars, album metadata, temporary files and loose pages.

    Without ``sizes`` only the names are made and the texts are not read.
    """
    doc = F.col("doc_id")
    ten = F.lit(10).cast("bigint")
    text_size = F.octet_length("text").cast("bigint")
    json_size = F.octet_length(sidecar_text(doc, F.col("media_name"))).cast("bigint")

    def entry(name: str, size: Column, folder: Column) -> Column:
        fields = [folder.alias("album"), F.col(name).alias("name")]
        return F.struct(*fields, size.alias("size")) if sizes else F.struct(*fields)

    album = F.col("album")
    entries = F.array(
        entry("media_name", text_size, album),
        entry("sidecar_name", json_size, album),
        entry("twin_name", json_size, album),
        entry("junk_name", ten, album),
        entry("page_name", ten, F.lit("")),
        entry("meta_name", ten, album),
    )
    listed = (
        shaped(table(spark, sf_dir, "documents"))
        .select("doc_id", F.inline(entries))
        .filter(F.col("name").isNotNull())
    )
    slash = F.when(album == "", F.lit("")).otherwise(F.lit("/"))
    return listed.select(
        F.concat("album", slash, "name").alias("path"),
        "album",
        "name",
        *(["size"] if sizes else []),
        F.timestamp_seconds(F.lit(1_500_000_000) + doc).alias("mtime"),
    )


def album_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, raw) of the album metadata files; the one of the sixth album is cut short."""
    doc = F.col("doc_id")
    raw = F.when(doc == 5, F.lit('{"title":')).otherwise(
        F.concat(
            F.lit('{"title":"'),
            F.when(doc == 4, F.lit("")).otherwise(F.concat(F.lit("Album "), doc.cast("string"))),
            F.lit('","description":"kept since '), (F.lit(2000) + doc).cast("string"),
            F.lit('","access":"protected","date":{"timestamp":"'),
            taken_seconds(doc).cast("string"), F.lit('"}}'),
        )
    )
    return (
        shaped(table(spark, sf_dir, "documents"))
        .filter(F.col("meta_name").isNotNull())
        .select(F.concat("album", F.lit("/metadata.json")).alias("path"), raw.alias("raw"))
    )


def exif_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, tags): every second media file has tags."""
    doc = F.col("doc_id")
    stamp = F.date_format(F.timestamp_seconds(taken_seconds(doc) + 3600), "yyyy:MM:dd HH:mm:ss")

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    whole = {
        "DateTimeOriginal": F.when(doc % 8 == 0, stamp).when(doc % 8 == 4, F.lit("2000:01:01 00:00:30")),
        "CreateDate": F.when(doc % 4 == 2, stamp),
        "GPSLatitude": text((doc % 80).cast("string"), " deg ", (doc % 60).cast("string"), "' 30.00\" ",
                            F.when(doc % 3 == 0, "S").otherwise("N")),
        "GPSLongitude": text((doc % 170).cast("string"), ".5 W"),
        "GPSAltitude": text((doc % 1000).cast("string"), ".5 m ",
                            F.when(doc % 10 == 4, "Below").otherwise("Above"), " Sea Level"),
        "Make": text(" Maker", (doc % 6).cast("string"), " "),
        "Model": text("Model ", (doc % 30).cast("string")),
        "FocalLength": text((F.lit(10) + doc % 90).cast("string"), ".0 mm"),
        "FNumber": text((F.lit(1) + doc % 8).cast("string"), ".8"),
        "ExposureTime": text("1/", (F.lit(30) + doc % 500).cast("string")),
        "ISO": (F.lit(100) * (F.lit(1) + doc % 16)).cast("string"),
        "Orientation": F.when(doc % 12 == 6, F.lit("Rotate 90 CW")).otherwise((doc % 10).cast("string")),
        "Flash": F.when(doc % 12 == 0, F.lit("No Flash")).otherwise((doc % 4).cast("string")),
        "WhiteBalance": (doc % 4 - doc % 2).cast("string"),
        "ImageWidth": (F.lit(640) + doc % 4000).cast("string"),
        "ImageHeight": (F.lit(480) + doc % 3000).cast("string"),
    }
    entries = F.array_compact(
        F.array(*[
            F.when(v.isNotNull(), F.struct(F.lit(name).alias("key"), v.alias("value")))
            for name, v in whole.items()
        ])
    )
    return media(spark, sf_dir).filter(doc % 2 == 0).select(
        "path", F.map_from_entries(entries).alias("tags")
    )


def probe_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, format, streams) of the .MOV and .mkv files."""
    doc = F.col("doc_id")
    video = F.struct(
        F.lit("video").alias("codec_type"),
        (F.lit(320) + doc % 2000).cast("int").alias("width"),
        (F.lit(240) + doc % 1000).cast("int").alias("height"),
        F.when(doc % 5 == 0, F.lit(None)).when(doc % 5 == 1, F.lit("0/0"))
        .otherwise(F.lit("30000/1001")).cast("string").alias("r_frame_rate"),
        F.lit("25/1").alias("avg_frame_rate"),
    )
    audio = F.struct(
        F.lit("audio").alias("codec_type"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit("0/0").alias("r_frame_rate"),
        F.lit("0/0").alias("avg_frame_rate"),
    )
    low = names.lower_suffix(F.col("name"))
    return media(spark, sf_dir).filter(low.isin(".mov", ".mkv")).select(
        "path",
        F.struct(F.concat((doc % 600).cast("string"), F.lit(".5")).alias("duration")).alias("format"),
        F.array(audio, video).alias("streams"),
    )


def run_of(doc: Column) -> Column:
    """Run that saw a stored row last: one in ten was last seen by the old run."""
    return F.when(doc % 10 == 9, RUN_OLD).otherwise(RUN_NEW)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored media rows of an earlier scan, narrow: ids, path, hashes, stamps, status."""
    doc, text = F.col("doc_id"), F.encode("text", "UTF-8")
    return media(spark, sf_dir).select(
        ids.uuid5(F.col("path")).alias("media_item_id"),
        F.col("path").alias("relative_path"),
        F.octet_length("text").cast("bigint").alias("file_size"),
        content.crc32_hex(text).alias("crc32"),
        content.fingerprint(text).alias("content_fingerprint"),
        F.when(doc % 4 != 0, F.sha2(F.concat(F.lit("side"), doc.cast("string")), 256)).alias(
            "sidecar_fingerprint"
        ),
        F.timestamp_seconds(
            F.lit(OLD_SEEN) + F.when(doc % 13 == 0, NEW_SEEN - OLD_SEEN).otherwise(0) - doc % 100
        ).alias("first_seen_timestamp"),
        F.timestamp_seconds(
            F.when(doc % 29 == 0, NEW_START - 10).otherwise(NEW_SEEN)
        ).alias("last_seen_timestamp"),
        run_of(doc).alias("scan_run_id"),
        F.when(doc % 17 == 0, "missing").when(doc % 37 == 0, "error").otherwise("present").alias("status"),
        F.lit(None).cast("string").alias("original_media_item_id"),
        F.lit(None).cast("string").alias("live_photo_pair_id"),
    )


def rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later scan of the same files: some edited, some sidecars edited, some gone, some new."""
    doc = F.col("doc_id")
    new_text = F.when(doc % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    side = F.when(doc % 6 == 1, F.lit("edited")).otherwise(F.lit("side"))
    path = F.when(doc % 23 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))
    return media(spark, sf_dir).filter(doc % 19 != 0).select(
        ids.uuid5(F.concat(path, F.lit("|2"))).alias("media_item_id"),
        path.alias("relative_path"),
        F.octet_length(new_text).cast("bigint").alias("file_size"),
        content.crc32_hex(F.encode(new_text, "UTF-8")).alias("crc32"),
        content.fingerprint(F.encode(new_text, "UTF-8")).alias("content_fingerprint"),
        F.when(doc % 4 != 0, F.sha2(F.concat(side, doc.cast("string")), 256)).alias("sidecar_fingerprint"),
        at(NEW_SEEN).alias("first_seen_timestamp"),
        at(NEW_SEEN).alias("last_seen_timestamp"),
        F.lit(RUN_NEW).alias("scan_run_id"),
        F.lit("present").alias("status"),
        F.lit(None).cast("string").alias("original_media_item_id"),
        F.lit(None).cast("string").alias("live_photo_pair_id"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scan runs."""
    key = F.col("o_orderkey")
    start = F.col("o_orderdate") + F.make_dt_interval(secs=key % 86_400)
    files_seen = (F.col("o_totalprice") / 100).cast("bigint")

    def counter(value: Column) -> Column:
        return value.cast("bigint")

    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run-"), key.cast("string")).alias("scan_run_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running")
        .otherwise("failed").alias("status"),
        start.alias("start_timestamp"),
        F.when(
            F.col("o_orderstatus") != "O", start + F.make_dt_interval(secs=F.lit(1) + key % 1000)
        ).alias("end_timestamp"),
        counter(files_seen * 2 + F.when(key % 7 == 0, 1).otherwise(0)).alias("total_files_discovered"),
        counter(files_seen).alias("media_files_discovered"),
        counter(files_seen).alias("metadata_files_discovered"),
        counter(files_seen - key % 3).alias("media_files_with_metadata"),
        counter(F.when(key % 4 == 0, 0).otherwise(files_seen)).alias("media_files_processed"),
        counter(files_seen - F.when(key % 9 == 0, 1).otherwise(0)).alias("metadata_files_processed"),
        counter(key % 50).alias("media_new_files"),
        counter(key % 40).alias("media_unchanged_files"),
        counter(key % 30).alias("media_changed_files"),
        counter(key % 5).alias("missing_files"),
        counter(key % 6).alias("media_error_files"),
        counter(key % 2).alias("inconsistent_files"),
        counter(F.lit(10)).alias("albums_total"),
        F.lit(None).cast("double").alias("duration_seconds"),
        F.lit(None).cast("double").alias("files_per_second"),
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as processing errors of runs of ten users each."""
    event = F.col("event_type")
    kind = (
        F.when(event == "click", "PermissionDeniedError").when(event == "view", "CorruptedFileError")
        .when(event == "signup", "ToolNotFoundError").when(event == "purchase", "OSError")
        .otherwise("SurpriseError")
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), (F.col("user_id") % 10).cast("string")).alias("scan_run_id"),
        F.concat(F.lit("album/file_"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("relative_path"),
        F.when(F.col("event_id") % 3 == 0, "json_sidecar").when(F.col("event_id") % 3 == 1, "album_metadata")
        .otherwise("media_file").alias("error_type"),
        kinds.stored_category(kinds.error_category(kind)).alias("error_category"),
        F.concat(F.lit("failed at "), F.col("value").cast("string")).alias("error_message"),
        F.col("ts").alias("timestamp"),
        kind.alias("kind"),
    )


def stored_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stored albums."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        ids.album_id(F.concat(F.lit("Album "), key.cast("string"))).alias("album_id"),
        F.concat(F.lit("Album "), key.cast("string")).alias("album_folder_path"),
        F.col("c_name").alias("title"),
        F.when(key % 2 == 0, F.col("c_mktsegment")).alias("description"),
        F.lit(None).cast("timestamp").alias("creation_timestamp"),
        F.when(key % 3 == 0, "protected").alias("access_level"),
        F.when(key % 10 == 1, "missing").when(key % 10 == 2, "error").otherwise("present").alias("status"),
        at(OLD_SEEN).alias("first_seen_timestamp"),
        at(OLD_SEEN).alias("last_seen_timestamp"),
        F.when(key % 4 == 0, RUN_OLD).otherwise(RUN_NEW).alias("scan_run_id"),
    )


def found_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of even key, shifted by 100, as albums a scan found."""
    key = F.col("c_custkey") + 100
    return table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 2 == 0).select(
        ids.album_id(F.concat(F.lit("Album "), key.cast("string"))).alias("album_id"),
        F.concat(F.lit("Album "), key.cast("string")).alias("album_folder_path"),
        F.when(key % 3 != 0, F.concat(F.lit("Title "), key.cast("string"))).alias("title"),
        F.when(key % 5 == 0, F.lit("described")).alias("description"),
        F.when(key % 7 == 0, at(OLD_START)).alias("creation_timestamp"),
        F.lit(None).cast("string").alias("access_level"),
        F.when(key % 11 == 0, "error").otherwise("present").alias("status"),
        F.lit(RUN_NEW).alias("scan_run_id"),
    )


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as members of archives, 50 to an archive, every fifth archive a tar."""
    doc = F.col("doc_id")
    number = F.floor(doc / 50).cast("bigint")
    is_tar = number % 5 == 4
    member = F.concat(
        F.when(doc % 33 == 0, "AUX/").when(doc % 35 == 1, "../").otherwise("Photos/"),
        F.lit("a"), F.when(doc % 4 == 0, F.lit("?b. ")).otherwise(F.lit("_")),
        F.lit("/img_"), doc.cast("string"), F.lit(".jpg"),
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("export-"), F.lpad(number.cast("string"), 6, "0"),
                 F.when(is_tar, ".tgz").otherwise(".zip")).alias("archive"),
        F.when(is_tar, "tgz").otherwise("zip").alias("format"),
        member.alias("member"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.when(~is_tar, F.crc32(F.encode("text", "UTF-8"))).alias("crc32"),
        "doc_id",
        "text",
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("archive", "format", "member", "size", "crc32")


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies on disk: zip names made safe; some archives incomplete, some files damaged."""
    doc = F.col("doc_id")
    number = F.floor(doc / 50)
    gone = (number % 3 == 0) & (doc % 7 == 0)
    path = F.when(F.col("format") == "zip", names.sanitize_member(F.col("member"))).otherwise(F.col("member"))
    found = F.crc32(F.encode("text", "UTF-8"))
    return _members(spark, sf_dir).filter(~gone).select(
        "archive",
        path.alias("path"),
        (F.col("size") + F.when(doc % 31 == 5, 1).otherwise(0)).alias("size"),
        (found + F.when(doc % 27 == 4, 1).otherwise(0)).alias("crc32"),
    )


def done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members recorded as extracted before an interruption: two of every three."""
    doc = F.col("doc_id")
    path = F.when(F.col("format") == "zip", names.sanitize_member(F.col("member"))).otherwise(F.col("member"))
    return _members(spark, sf_dir).filter(doc % 3 != 2).select(
        "archive", path.alias("path"), "size", "crc32", at(OLD_SEEN).alias("extracted_at")
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines."""
    event, key = F.col("event_type"), F.col("event_id")
    level = F.when(event == "error", "ERROR").when(event == "view", "WARNING").when(
        event == "click", "DEBUG").when(event == "signup", "TRACE").otherwise("INFO")
    said = (
        F.when(key % 11 == 0, F.concat(F.lit("Phase 1 (Happy path): "), key.cast("string"), F.lit(" matches found")))
        .when(key % 11 == 1, F.concat(F.lit("Phase 2 (Numbered files): "), key.cast("string"), F.lit(" matches found")))
        .when(key % 11 == 2, F.concat(F.lit("Phase 3 (Edited files): "), key.cast("string"), F.lit(" matches found")))
        .when(key % 11 == 3, F.concat(F.lit("Phase 4 (Unmatched): "), key.cast("string"),
                                      F.lit(" media files, 30 sidecars")))
        .when(key % 11 == 4, F.concat((key % 100).cast("string"), F.lit(".5% match rate")))
        .when(key % 11 == 5, F.lit("Multiple sidecars for media file a.jpg"))
        .when(key % 11 == 6, F.lit("Scanning complete"))
        .otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string")))
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("2024-01-01 - "), level, F.lit(" - "), said).alias("value"),
        key.alias("line_no"),
    )
