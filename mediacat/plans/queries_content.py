"""Queries about content, parsed metadata, times, albums and people."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediacat.functions import content, exif, names, times
from mediacat.operators import albums, errors as kinds, media, people
from mediacat.plans import adapters as a, oracle_tables as o
from mediacat.plans.adapters import NEW_SEEN, OLD_SEEN, RUN_NEW
from mediacat.plans.queries_linking import _links
from mediacat.plans.registry import query


def _binary(spark, sf_dir):
    """(path, content): documents with the first bytes of some type put before the text."""
    heads = ["", "FFD8FFE0", "89504E470D0A1A0A", "0000001866747970" + "6D703431", "47494638",
             "0000001C66747970" + "71742020", "49492A00", "1A45DFA3"]
    head = F.get(F.array(*[F.lit(h) for h in heads]), (F.col("doc_id") % len(heads)).cast("int"))
    return a.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"),
        F.concat(F.unhex(head), F.encode("text", "UTF-8")).alias("content"),
    )


_CONTENT = """blobs AS (
  SELECT doc_id::VARCHAR AS path, from_hex(
    ['', 'FFD8FFE0', '89504E470D0A1A0A', '00000018667479706D703431', '47494638',
     '0000001C6674797071742020', '49492A00', '1A45DFA3'][doc_id % 8 + 1]) || encode(text) AS content
  FROM documents
)"""


@query("content_fingerprints", o.with_tables(
    _CONTENT, select=f"""SELECT path, octet_length(content) AS size,
      {o.fingerprint("content")} AS content_fingerprint,
      CASE path::BIGINT % 8 WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' WHEN 3 THEN 'video/mp4'
        WHEN 4 THEN 'image/gif' WHEN 5 THEN 'video/quicktime' WHEN 6 THEN 'image/tiff'
        ELSE 'application/octet-stream' END AS mime_type FROM blobs"""))
def content_fingerprints(spark, sf_dir):
    return media.hash_content(_binary(spark, sf_dir)).drop("crc32")


#: CRC-32 by its table of 256 remainders, over all bytes.
_CRC32 = """remainders AS (
  SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) AS n(i))
), bytes AS (
  SELECT path, octet_length(content) AS size, list_transform(range(octet_length(content)),
    lambda k: ('0x' || substr(hex(content), 2 * k + 1, 2))::BIGINT) AS b FROM blobs
)"""


@query("content_checksums", o.with_tables(
    _CONTENT, _CRC32, select="""SELECT path, size, format('{:08x}', xor(4294967295,
      list_reduce(list_prepend(4294967295::BIGINT, b),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])))) AS crc32 FROM bytes, remainders"""))
def content_checksums(spark, sf_dir):
    return media.hash_content(_binary(spark, sf_dir)).select("path", "size", "crc32")


@query("mime_families", o.with_tables(
    _CONTENT, select="""SELECT family, count(*) AS files FROM (
      SELECT CASE WHEN path::BIGINT % 8 IN (1, 2, 4, 6) THEN 'image' WHEN path::BIGINT % 8 IN (3, 5) THEN 'video'
        ELSE 'unknown' END AS family FROM blobs) GROUP BY family"""))
def mime_families(spark, sf_dir):
    mime = F.col("mime_type")
    family = F.when(content.is_image(mime), "image").when(content.is_video(mime), "video").when(
        content.is_unknown_mime(mime), "unknown")
    return (
        _binary(spark, sf_dir)
        .select(content.sniff_mime(F.col("content")).alias("mime_type"))
        .groupBy(family.alias("family"))
        .agg(F.count(F.lit(1)).alias("files"))
    )


_PARSED = f"""parsed AS (
  SELECT path, doc_id, raw, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM sidecars
), typed AS (
  SELECT path, doc_id, ok AS parsed, sha256(encode(raw)) AS sidecar_fingerprint,
    j->>'title' AS json_title, j->>'description' AS json_description,
    coalesce(json_exists(j, '$.photoTakenTime'), false) AS has_taken,
    CASE json_type(j, '$.photoTakenTime')
      WHEN 'UBIGINT' THEN (j->>'$.photoTakenTime')::BIGINT
      WHEN 'OBJECT' THEN CASE WHEN json_exists(j, '$.photoTakenTime.timestamp')
        THEN (j->>'$.photoTakenTime.timestamp')::BIGINT
        ELSE epoch(strptime(j->>'$.photoTakenTime.formatted', '%b %d, %Y, %I:%M:%S %p UTC'))::BIGINT END
      END AS taken,
    coalesce(json_exists(j, '$.creationTime'), false) AS has_creation,
    (j->>'$.creationTime.timestamp')::BIGINT AS creation,
    coalesce(j->>'$.geoData.latitude', j->>'$.geoDataExif.latitude')::DOUBLE AS latitude,
    coalesce(j->>'$.geoData.longitude', j->>'$.geoDataExif.longitude')::DOUBLE AS longitude,
    coalesce(j->>'$.geoData.altitude', j->>'$.geoDataExif.altitude')::DOUBLE AS altitude,
    CASE WHEN doc_id % 3 = 0 AND ok THEN (j->>'$.people[0].name') || ';' || (j->>'$.people[2].name') ELSE '' END AS people,
    j->>'url' AS url, j->>'imageViews' AS image_views
  FROM parsed
)"""


def _iso_seconds(column: str):
    return F.unix_seconds(times.iso_time(F.col(column)))


@query("parsed_sidecars", o.with_tables(
    o.SHAPED, o.SIDECARS, _PARSED, select="SELECT * EXCLUDE (doc_id) FROM typed"))
def parsed_sidecars(spark, sf_dir):
    return media.parse_sidecars(a.sidecars(spark, sf_dir)).select(
        "path", "parsed", "sidecar_fingerprint", "json_title", "json_description",
        "has_taken", _iso_seconds("taken").alias("taken"),
        "has_creation", _iso_seconds("creation").alias("creation"),
        "latitude", "longitude", "altitude",
        F.array_join("people", ";").alias("people"), "url", "image_views",
    )


@query("sidecar_errors", o.with_tables(
    o.SHAPED, o.SIDECARS, select=f"""SELECT '{RUN_NEW}' AS scan_run_id, path AS relative_path,
      'json_sidecar' AS error_type, 'parse_error' AS error_category FROM sidecars WHERE NOT json_valid(raw)"""))
def sidecar_errors(spark, sf_dir):
    parsed = media.parse_sidecars(a.sidecars(spark, sf_dir))
    return media.sidecar_errors(parsed, RUN_NEW, a.at(NEW_SEEN)).select(
        "scan_run_id", "relative_path", "error_type", "error_category"
    )


@query("displayed_times", """SELECT o_orderkey AS key,
    CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 3 THEN epoch(date_trunc('day', o_orderdate))::BIGINT
      ELSE epoch(o_orderdate)::BIGINT + o_orderkey % 86400 END AS seconds
  FROM orders""")
def displayed_times(spark, sf_dir):
    key = F.col("o_orderkey")
    moment = F.col("o_orderdate") + F.make_dt_interval(secs=key % 86_400)
    shown = (
        F.when(key % 5 == 0, F.concat(F.date_format(moment, "MMM d, yyyy, h:mm:ss a"), F.lit(" UTC")))
        .when(key % 5 == 1, F.date_format(moment, "MMM d, yyyy, h:mm:ss a"))
        .when(key % 5 == 2, F.concat(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))
        .when(key % 5 == 3, F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T00:00:00Z'"))
        .otherwise(F.date_format(moment, "dd/MM/yyyy"))
    )
    return a.table(spark, sf_dir, "orders").select(key.alias("key"), shown.alias("shown")).select(
        "key", F.unix_seconds(times.iso_time(times.formatted_time(F.col("shown")))).alias("seconds")
    )


_NAMED_TIMES = """named AS (
  SELECT event_id, CASE event_id % 7
    WHEN 0 THEN 'IMG_' || strftime(ts, '%Y%m%d_%H%M%S') || '.jpg'
    WHEN 1 THEN 'VID_' || strftime(ts, '%Y%m%d_%H%M%S') || '_1.mp4'
    WHEN 2 THEN strftime(ts, '%Y%m%d_%H%M%S') || '.jpg'
    WHEN 3 THEN strftime(ts, '%Y-%m-%d %H.%M.%S') || '.jpg'
    WHEN 4 THEN 'trip ' || strftime(ts, '%Y-%m-%d') || '.jpg'
    WHEN 5 THEN 'IMG_' || strftime(ts, '%Y') || '1399_' || strftime(ts, '%H%M%S') || ' ' || strftime(ts, '%Y-%m-%d') || '.jpg'
    ELSE 'IMG_' || event_id || '.jpg' END AS name, ts FROM events
)"""


@query("filename_times", o.with_tables(
    _NAMED_TIMES, select="""SELECT event_id, name, CASE event_id % 7
      WHEN 4 THEN epoch(date_trunc('day', ts))::BIGINT WHEN 5 THEN epoch(date_trunc('day', ts))::BIGINT
      WHEN 6 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT END AS seconds FROM named"""))
def filename_times(spark, sf_dir):
    key, ts = F.col("event_id"), F.col("ts")

    def shown(pattern: str):
        return F.date_format(ts, pattern)

    name = (
        F.when(key % 7 == 0, F.concat(F.lit("IMG_"), shown("yyyyMMdd_HHmmss"), F.lit(".jpg")))
        .when(key % 7 == 1, F.concat(F.lit("VID_"), shown("yyyyMMdd_HHmmss"), F.lit("_1.mp4")))
        .when(key % 7 == 2, F.concat(shown("yyyyMMdd_HHmmss"), F.lit(".jpg")))
        .when(key % 7 == 3, F.concat(shown("yyyy-MM-dd HH.mm.ss"), F.lit(".jpg")))
        .when(key % 7 == 4, F.concat(F.lit("trip "), shown("yyyy-MM-dd"), F.lit(".jpg")))
        .when(key % 7 == 5, F.concat(F.lit("IMG_"), shown("yyyy"), F.lit("1399_"), shown("HHmmss"),
                                     F.lit(" "), shown("yyyy-MM-dd"), F.lit(".jpg")))
        .otherwise(F.concat(F.lit("IMG_"), key.cast("string"), F.lit(".jpg")))
    )
    return a.table(spark, sf_dir, "events").select("event_id", name.alias("name")).select(
        "event_id", "name", F.unix_seconds(times.filename_time(F.col("name"))).alias("seconds")
    )


_RELIABLE = """timed AS (
  SELECT event_id, CASE event_id % 9
    WHEN 0 THEN ts WHEN 1 THEN ts + INTERVAL 2 YEAR WHEN 2 THEN ts + INTERVAL 300 DAY
    WHEN 3 THEN TIMESTAMP '2000-01-01 00:00:59' WHEN 4 THEN TIMESTAMP '2000-01-01 00:01:00'
    WHEN 5 THEN TIMESTAMP '1989-12-31 23:59:59' WHEN 6 THEN TIMESTAMP '2015-01-01 07:00:00'
    WHEN 7 THEN TIMESTAMP '2024-12-31 12:00:00' END AS ts FROM events
), judged AS (
  SELECT event_id, ts, coalesce(
    NOT (abs(epoch_us(ts) - epoch_us(TIMESTAMP '1970-01-01')) < 60000000
      OR abs(epoch_us(ts) - epoch_us(TIMESTAMP '1980-01-01')) < 60000000
      OR abs(epoch_us(ts) - epoch_us(TIMESTAMP '2000-01-01')) < 60000000
      OR abs(epoch_us(ts) - epoch_us(TIMESTAMP '2001-01-01')) < 60000000)
    AND year(ts) >= 1990 AND ts < TIMESTAMP '2024-01-01' + INTERVAL 366 DAY
    AND NOT (strftime(ts, '%m-%d %M:%S') = '01-01 00:00'), false) AS reliable
  FROM timed
)"""


def _timed(spark, sf_dir):
    key, ts = F.col("event_id"), F.col("ts")

    def fixed_time(text: str):
        return F.lit(text).cast("timestamp")

    moment = (
        F.when(key % 9 == 0, ts).when(key % 9 == 1, ts + F.expr("INTERVAL 2 YEAR"))
        .when(key % 9 == 2, ts + F.expr("INTERVAL 300 DAY"))
        .when(key % 9 == 3, fixed_time("2000-01-01 00:00:59"))
        .when(key % 9 == 4, fixed_time("2000-01-01 00:01:00"))
        .when(key % 9 == 5, fixed_time("1989-12-31 23:59:59"))
        .when(key % 9 == 6, fixed_time("2015-01-01 07:00:00"))
        .when(key % 9 == 7, fixed_time("2024-12-31 12:00:00"))
    )
    return a.table(spark, sf_dir, "events").select("event_id", moment.alias("ts"))


@query("reliable_times", o.with_tables(_RELIABLE, select="SELECT event_id, reliable FROM judged"))
def reliable_times(spark, sf_dir):
    now = F.lit("2024-01-01").cast("timestamp")
    return _timed(spark, sf_dir).select(
        "event_id", times.reliable_exif(F.col("ts"), now).alias("reliable")
    )


@query("capture_times", o.with_tables(
    _RELIABLE, select="""SELECT event_id, CASE
        WHEN reliable AND event_id % 2 = 0 THEN epoch(date_trunc('second', ts))::BIGINT
        WHEN reliable AND event_id % 3 = 0 THEN epoch(date_trunc('second', ts))::BIGINT
        WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 10 = 0 THEN NULL ELSE 1000000000 + event_id END
        WHEN event_id % 5 = 1 THEN 1100000000 + event_id
        WHEN event_id % 5 = 2 THEN 1370701822 END AS seconds FROM judged"""))
def capture_times(spark, sf_dir):
    key, ts = F.col("event_id"), F.col("ts")
    taken = F.when(key % 10 != 0, F.timestamp_seconds(F.lit(1_000_000_000) + key))
    name = F.when(key % 5 == 2, "IMG_20130608_143022.jpg").otherwise("photo.jpg")
    captured = times.capture_time(
        F.when(key % 2 == 0, ts), F.when(key % 3 == 0, ts),
        key % 5 == 0, taken,
        key % 5 == 1, F.timestamp_seconds(F.lit(1_100_000_000) + key),
        F.col("name"), F.lit("2024-01-01").cast("timestamp"),
    )
    return _timed(spark, sf_dir).withColumn("name", name).select(
        "event_id", F.unix_seconds(captured).alias("seconds")
    )


_TAGS = """tags AS (
  SELECT path,
    CASE WHEN doc_id % 8 = 0 THEN stamp + 3600 WHEN doc_id % 8 = 4 THEN 946684830 END AS datetime_original,
    CASE WHEN doc_id % 4 = 2 THEN stamp + 3600 END AS datetime_digitized,
    (CASE WHEN doc_id % 3 = 0 THEN -1.0 ELSE 1.0 END)::DOUBLE
      * ((doc_id % 80)::DOUBLE + (doc_id % 60)::DOUBLE / 60.0::DOUBLE + 30.0::DOUBLE / 3600.0::DOUBLE) AS gps_latitude,
    (doc_id % 170)::DOUBLE + 0.5::DOUBLE AS gps_longitude,
    CASE WHEN doc_id % 10 = 4 THEN -1 ELSE 1 END * ((doc_id % 1000)::DOUBLE + 0.5::DOUBLE) AS gps_altitude,
    'Maker' || (doc_id % 6) AS camera_make, 'Model ' || (doc_id % 30) AS camera_model,
    (10 + doc_id % 90)::DOUBLE AS focal_length,
    ((1 + doc_id % 8) || '.8')::DOUBLE AS f_number, '1/' || (30 + doc_id % 500) AS exposure_time,
    (100 * (1 + doc_id % 16))::INTEGER AS iso,
    CASE WHEN doc_id % 12 = 6 THEN 90 ELSE doc_id % 10 END::INTEGER AS orientation,
    CASE WHEN doc_id % 12 = 0 THEN 'No Flash' WHEN (doc_id % 4) % 2 = 1 THEN 'Flash fired'
      ELSE 'Flash did not fire' END AS flash,
    CASE WHEN doc_id % 4 - doc_id % 2 = 0 THEN 'Auto' ELSE 'Manual' END AS white_balance,
    (640 + doc_id % 4000)::INTEGER AS exif_width, (480 + doc_id % 3000)::INTEGER AS exif_height
  FROM media WHERE doc_id % 2 = 0
)"""

_PROBES = """probes AS (
  SELECT path, ((doc_id % 600) || '.5')::DOUBLE AS duration_seconds,
    CASE doc_id % 5 WHEN 0 THEN 25.0::DOUBLE WHEN 1 THEN NULL ELSE 30000.0::DOUBLE / 1001.0::DOUBLE END AS frame_rate,
    (320 + doc_id % 2000)::INTEGER AS video_width, (240 + doc_id % 1000)::INTEGER AS video_height
  FROM media WHERE name LIKE '%.MOV' OR name LIKE '%.mkv'
)"""


@query("exif_tags", o.with_tables(o.SHAPED, o.MEDIA, _TAGS, select="SELECT * FROM tags"))
def exif_tags(spark, sf_dir):
    tags = media.normalize_tags(a.exif_dump(spark, sf_dir))
    return tags.withColumns(
        {c: F.unix_seconds(c) for c in ("datetime_original", "datetime_digitized")}
    ).drop("lens_make", "lens_model")


@query("probe_values", o.with_tables(o.SHAPED, o.MEDIA, _PROBES, select="SELECT * FROM probes"))
def probe_values(spark, sf_dir):
    return media.normalize_probe(a.probe_dump(spark, sf_dir))


@query("exif_values", """SELECT l_orderkey AS orderkey, l_linenumber AS linenumber,
    CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_quantity / (l_suppkey % 4) END AS ratio,
    CASE WHEN l_linenumber % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END
      * (l_quantity + (l_suppkey % 60)::DOUBLE / 60.0::DOUBLE + (l_partkey % 60)::DOUBLE / 3600.0::DOUBLE) AS degrees,
    CASE WHEN l_linenumber % 3 = 1 THEN -1 ELSE 1 END * l_extendedprice AS altitude,
    '1/' || l_suppkey AS exposure,
    CASE WHEN l_partkey % 2 = 1 THEN 'Flash fired' ELSE 'Flash did not fire' END AS flash,
    CASE WHEN l_linenumber % 2 = 0 THEN 'Auto' ELSE 'Manual' END AS white_balance,
    CASE WHEN l_suppkey % 12 BETWEEN 1 AND 8 THEN (l_suppkey % 12)::INTEGER END AS orientation
  FROM lineitem""")
def exif_values(spark, sf_dir):
    line = F.col("l_linenumber")
    text = F.col("l_quantity").cast("string")
    parts = F.array(
        text,
        (F.col("l_suppkey") % 60).cast("string"),
        F.concat((F.col("l_partkey") % 60).cast("string"), F.lit("/1")),
    )
    return a.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"),
        line.alias("linenumber"),
        exif.rational(F.concat(text, F.lit("/"), (F.col("l_suppkey") % 4).cast("string"))).alias("ratio"),
        exif.gps_dms(parts, F.when(line % 2 == 0, "S").otherwise("N")).alias("degrees"),
        exif.altitude_ref(F.col("l_extendedprice").cast("string"), line % 3).alias("altitude"),
        exif.exposure(F.concat(F.lit("1/"), F.col("l_suppkey").cast("string"))).alias("exposure"),
        exif.flash(F.col("l_partkey")).alias("flash"),
        exif.white_balance(line % 2).alias("white_balance"),
        exif.valid_orientation(
            exif.orientation(F.concat(F.lit("turn "), (F.col("l_suppkey") % 12).cast("string")))
        ).alias("orientation"),
    )


_ITEM = """SELECT l.path AS relative_path,
    coalesce(nullif(s.json_title, ''), {stem}) AS title,
    strlen(m.text) AS file_size, {fingerprint} AS content_fingerprint,
    s.sidecar_fingerprint, s.json_description AS google_description,
    coalesce(p.video_width, t.exif_width) AS width, coalesce(p.video_height, t.exif_height) AS height,
    p.duration_seconds, p.frame_rate,
    CASE WHEN m.doc_id % 8 = 0 AND strftime(make_timestamp(t.datetime_original * 1000000), '%m-%d %M:%S') <> '01-01 00:00'
           THEN t.datetime_original
         WHEN m.doc_id % 4 = 2 AND strftime(make_timestamp(t.datetime_digitized * 1000000), '%m-%d %M:%S') <> '01-01 00:00'
           THEN t.datetime_digitized
         WHEN s.has_taken THEN s.taken WHEN s.has_creation THEN s.creation END AS captured,
    t.gps_latitude AS exif_gps_latitude, s.latitude AS google_geo_data_latitude,
    CASE WHEN t.orientation BETWEEN 1 AND 8 THEN t.orientation END AS exif_orientation,
    t.flash AS exif_flash, s.url AS media_google_url,
    {album_id} AS album_id, {media_id} AS media_item_id
  FROM links l JOIN media m ON m.path = l.path
  LEFT JOIN typed s ON s.path = l.sidecar_path
  LEFT JOIN tags t ON t.path = l.path LEFT JOIN probes p ON p.path = l.path"""


def _iso_sql(column: str) -> str:
    return (
        f"coalesce(strftime(make_timestamp({column} * 1000000), '%Y-%m-%dT%H:%M:%S+00:00'), '')"
    )


@query("media_items", o.with_tables(
    o.SHAPED, o.MEDIA, o.SIDECARS, o.PARSED_NAMES, o.LINKED, _PARSED, _TAGS, _PROBES,
    select=_ITEM.format(
        stem=o.stem("m.name"), fingerprint=o.fingerprint("encode(m.text)"), album_id=o.uuid5("l.album"),
        media_id=o.uuid5("l.path || '|' || " + _iso_sql("s.taken") + " || '|' || strlen(m.text) || '|' || "
                         + _iso_sql("s.creation")))))
def media_items(spark, sf_dir):
    docs = a.media(spark, sf_dir)
    links = _links(spark, sf_dir)
    found = albums.discover_albums(
        a.files(spark, sf_dir, sizes=False),
        albums.parse_album_json(a.album_json(spark, sf_dir)), RUN_NEW,
    )
    merged = media.merge_metadata(
        links,
        media.parse_sidecars(a.sidecars(spark, sf_dir)),
        media.normalize_tags(a.exif_dump(spark, sf_dir)),
        media.normalize_probe(a.probe_dump(spark, sf_dir)),
    )
    digests = media.hash_content(docs.select("path", F.encode("text", "UTF-8").alias("content")))
    items = media.media_record(
        albums.attach_album(merged, found), digests, RUN_NEW, a.at(NEW_SEEN)
    )
    return items.select(
        "relative_path", "title", "file_size", "content_fingerprint", "sidecar_fingerprint",
        "google_description", "width", "height", "duration_seconds", "frame_rate",
        F.unix_seconds("capture_timestamp").alias("captured"), "exif_gps_latitude",
        "google_geo_data_latitude", "exif_orientation", "exif_flash", "media_google_url",
        "album_id", "media_item_id",
    )


_DISCOVERED = f"""SELECT {o.uuid5("album")} AS album_id, album AS album_folder_path,
    CASE WHEN i < 4 THEN 'Album ' || i WHEN i IN (4, 5) THEN album ELSE 'Photos from ' || (2015 + i) END AS title,
    CASE WHEN i < 5 THEN 'kept since ' || (2000 + i) END AS description,
    CASE WHEN i < 5 THEN 'protected' END AS access_level,
    CASE WHEN i < 5 THEN 1262304000 + i * 7919 END AS created,
    CASE WHEN i = 5 THEN 'error' ELSE 'present' END AS status,
    CASE WHEN i < 6 THEN 'user' ELSE 'year' END AS album_kind
  FROM (SELECT DISTINCT album, right(album, 4)::BIGINT - 2015 AS i FROM shaped)"""


@query("albums_found", o.with_tables(o.SHAPED, select=_DISCOVERED))
def albums_found(spark, sf_dir):
    found = albums.discover_albums(
        a.files(spark, sf_dir, sizes=False),
        albums.parse_album_json(a.album_json(spark, sf_dir)), RUN_NEW,
    )
    return found.select(
        "album_id", "album_folder_path", "title", "description", "access_level",
        F.unix_seconds("creation_timestamp").alias("created"), "status", "album_kind",
    )


@query("album_years", """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate)::INTEGER
    WHEN o_orderkey % 3 = 1 AND o_orderkey % 9999 BETWEEN 1900 AND 2200 THEN (o_orderkey % 9999)::INTEGER END AS year
  FROM orders""")
def album_years(spark, sf_dir):
    key = F.col("o_orderkey")
    folder = (
        F.when(key % 3 == 0, F.concat(F.lit("photos FROM "), F.year("o_orderdate").cast("string"), F.lit(" (2)")))
        .when(key % 3 == 1, F.concat(F.lit("Photos from "), F.lpad((key % 9999).cast("string"), 4, "0")))
        .otherwise(F.concat(F.lit("More Photos from "), F.year("o_orderdate").cast("string")))
    )
    return a.table(spark, sf_dir, "orders").select(key.alias("key"), folder.alias("folder")).select(
        "key", names.album_year(F.col("folder")).alias("year")
    )


@query("albums_upserted", o.with_tables(
    o.ALBUMS, o.FOUND_ALBUMS, select=f"""SELECT album_folder_path, coalesce(f.title, s.title) AS title,
      coalesce(f.description, s.description) AS description, f.created, s.access_level,
      coalesce(f.status, s.status) AS status,
      (CASE WHEN s.album_folder_path IS NULL THEN {NEW_SEEN} ELSE {OLD_SEEN} END)::BIGINT AS first_seen,
      (CASE WHEN f.album_folder_path IS NULL THEN {OLD_SEEN} ELSE {NEW_SEEN} END)::BIGINT AS last_seen,
      CASE WHEN f.album_folder_path IS NULL THEN s.scan_run_id ELSE '{RUN_NEW}' END AS scan_run_id
      FROM found f FULL JOIN stored s USING (album_folder_path)"""))
def albums_upserted(spark, sf_dir):
    merged = albums.upsert_albums(
        a.found_albums(spark, sf_dir), a.stored_albums(spark, sf_dir), a.at(NEW_SEEN)
    )
    return merged.select(
        "album_folder_path", "title", "description",
        F.unix_seconds("creation_timestamp").alias("created"), "access_level", "status",
        F.unix_seconds("first_seen_timestamp").alias("first_seen"),
        F.unix_seconds("last_seen_timestamp").alias("last_seen"), "scan_run_id",
    )


# Conversations as tagged media: every turn names the role and the first word of the text.
_NAMED_PEOPLE = """named AS (
  SELECT conv_id, unnest(people) AS person_name, generate_subscripts(people, 1) AS i FROM (
    SELECT conv_id, list(role || ' ' || (strlen(text) % 97) ORDER BY turn) AS people FROM conversations
    WHERE conv_id % 5 <> 0 GROUP BY conv_id)
), firsts AS (
  SELECT conv_id, person_name, min(i) AS i FROM named GROUP BY ALL
), fresh AS (
  SELECT conv_id::VARCHAR AS media_item_id, person_name,
    (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INTEGER AS tag_order FROM firsts
), old_tags AS (
  SELECT conv_id::VARCHAR AS media_item_id, 'user ' || (conv_id % 97) AS person_name, 0 AS tag_order
  FROM conversations WHERE turn = 0
), all_tags AS (
  SELECT * FROM fresh UNION ALL
  SELECT * FROM old_tags WHERE media_item_id NOT IN (SELECT media_item_id FROM fresh)
)"""


def _tagged(spark, sf_dir):
    turns = a.table(spark, sf_dir, "conversations")
    key = F.col("conv_id").cast("string").alias("media_item_id")
    name = F.concat("role", F.lit(" "), (F.octet_length("text") % 97).cast("string"))
    names_read = (
        turns.filter(F.col("conv_id") % 5 != 0)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("turn", name.alias("name")))).alias("spoken"))
        .select("media_item_id", F.col("spoken.name").alias("people"))
    )
    known = F.concat(F.lit("user "), (F.col("conv_id") % 97).cast("string"))
    stored_people = turns.filter("turn = 0").select(known.alias("person_name")).distinct().select(
        F.concat(F.lit("old-"), "person_name").alias("person_id"), "person_name"
    )
    stored_tags = turns.filter("turn = 0").select(
        key, F.concat(F.lit("old-"), known).alias("person_id"), F.lit(0).alias("tag_order")
    )
    tags = people.name_tags(names_read)
    everyone = people.assign_person_ids(tags, stored_people)
    return everyone, people.replace_people_tags(tags, everyone, stored_tags)


@query("people_table", o.with_tables(
    _NAMED_PEOPLE, select=f"""SELECT person_name, CASE WHEN person_name IN (SELECT person_name FROM old_tags)
        THEN 'old-' || person_name ELSE {o.uuid5("'person|' || person_name")} END AS person_id
      FROM (SELECT person_name FROM fresh UNION SELECT person_name FROM old_tags)"""))
def people_table(spark, sf_dir):
    return _tagged(spark, sf_dir)[0].select("person_name", "person_id")


@query("people_tags", o.with_tables(
    _NAMED_PEOPLE, select="SELECT media_item_id, person_name, tag_order FROM all_tags"))
def people_tags(spark, sf_dir):
    everyone, tags = _tagged(spark, sf_dir)
    return tags.join(everyone, "person_id").select("media_item_id", "person_name", "tag_order")


@query("people_of_media", o.with_tables(
    _NAMED_PEOPLE, select="""SELECT media_item_id, string_agg(person_name, ';' ORDER BY tag_order) AS names
      FROM all_tags GROUP BY media_item_id"""))
def people_of_media(spark, sf_dir):
    everyone, tags = _tagged(spark, sf_dir)
    return people.people_of(tags, everyone).select(
        "media_item_id", F.array_join("names", ";").alias("names")
    )


@query("error_categories", """SELECT event_type, CASE event_type WHEN 'click' THEN 'permission' WHEN 'view' THEN 'corrupted'
      WHEN 'signup' THEN 'tool_missing' WHEN 'purchase' THEN 'io' ELSE 'unknown' END AS category,
    CASE event_type WHEN 'click' THEN 'permission_denied' WHEN 'view' THEN 'corrupted'
      WHEN 'signup' THEN 'unsupported_format' WHEN 'purchase' THEN 'io_error' ELSE 'parse_error' END AS stored,
    count(*) AS events FROM events GROUP BY ALL""")
def error_categories(spark, sf_dir):
    event = F.col("event_type")
    kind = (
        F.when(event == "click", "PermissionDeniedError").when(event == "view", "CorruptedFileError")
        .when(event == "signup", "ToolNotFoundError").when(event == "purchase", "OSError")
        .otherwise("SurpriseError")
    )
    category = kinds.error_category(kind)
    return (
        a.table(spark, sf_dir, "events")
        .groupBy("event_type", category.alias("category"), kinds.stored_category(category).alias("stored"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
