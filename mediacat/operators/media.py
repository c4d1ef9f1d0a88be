"""Content digests, parsed sidecars, tag tables and the merged media record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mediacat import schemas
from mediacat.functions import content, exif, ids, names, sidecar_json, times


def hash_content(files: DataFrame) -> DataFrame:
    """(path, size, crc32, content_fingerprint, mime_type) of files with a content column."""
    c = F.col("content")
    return files.select(
        "path",
        F.octet_length(c).cast("bigint").alias("size"),
        content.crc32_hex(c).alias("crc32"),
        content.fingerprint(c).alias("content_fingerprint"),
        content.sniff_mime(c).alias("mime_type"),
    )


def parse_sidecars(raw: DataFrame) -> DataFrame:
    """Typed columns of sidecar JSON, one row per file.

    ``raw`` has path and raw, the bytes of the file or a text. The fingerprint is that of
    the bytes. What is not JSON in UTF-8 keeps its row with parsed = false;
    ``sidecar_errors`` turns those rows into error records.
    """
    v, data = F.col("v"), F.col("raw").cast("binary")
    return raw.select(
        "path",
        F.try_parse_json(content.strict_text(data)).alias("v"),
        content.sidecar_fingerprint(data).alias("sidecar_fingerprint"),
    ).select(
        "path",
        v.isNotNull().alias("parsed"),
        "sidecar_fingerprint",
        *sidecar_json.parsed_columns(v),
    )


def sidecar_errors(parsed: DataFrame, scan_run_id: str, now: Column) -> DataFrame:
    """Error records of sidecars that are not JSON."""
    return parsed.filter(~F.col("parsed")).select(
        F.lit(scan_run_id).alias("scan_run_id"),
        F.col("path").alias("relative_path"),
        F.lit("json_sidecar").alias("error_type"),
        F.lit("parse_error").alias("error_category"),
        F.lit("sidecar is not valid JSON").alias("error_message"),
        now.alias("timestamp"),
    )


def file_errors(digests: DataFrame, scan_run_id: str, now: Column) -> DataFrame:
    """Error records of media files that could not be read."""
    return digests.filter(F.col("size").isNull()).select(
        F.lit(scan_run_id).alias("scan_run_id"),
        F.col("path").alias("relative_path"),
        F.lit("media_file").alias("error_type"),
        F.lit("io_error").alias("error_category"),
        F.lit("file cannot be read").alias("error_message"),
        now.alias("timestamp"),
    )


def normalize_tags(exif_dump: DataFrame) -> DataFrame:
    """Named tag columns per file."""
    return exif_dump.select("path", *exif.tag_columns(F.col("tags")))


def normalize_probe(probe_dump: DataFrame) -> DataFrame:
    """Duration, frame rate and size of the first video stream per file."""
    return probe_dump.select("path", *exif.probe_columns(F.col("format"), F.col("streams")))


def merge_metadata(
    links: DataFrame, sidecars: DataFrame, tags: DataFrame, probes: DataFrame
) -> DataFrame:
    """Linked media with their sidecar, tag and probe columns side by side."""
    return (
        join_sidecars(links, sidecars).join(tags, "path", "left").join(probes, "path", "left")
    )


def join_sidecars(links: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Every linked media file with the columns of its sidecar, NULL where it has none.

    Media without sidecar join under their own path, which no sidecar has, so that they
    do not all meet in one task as NULL keys would.
    """
    keyed = links.withColumn("joined", F.coalesce("sidecar_path", "path"))
    return keyed.join(sidecars.withColumnRenamed("path", "joined"), "joined", "left").drop("joined")


def media_record(
    merged: DataFrame,
    digests: DataFrame,
    scan_run_id: str,
    now: Column,
    seen_at: Column | None = None,
) -> DataFrame:
    """The stored row of every media file.

    ``merged`` is the output of ``merge_metadata`` with album_id; ``digests`` is the
    output of ``hash_content``. ``now`` judges future EXIF dates, ``seen_at`` stamps rows.
    """
    seen_at = now if seen_at is None else seen_at
    path = names.normalize_path(F.col("path"))
    has_taken = F.coalesce("has_taken", F.lit(False))
    has_creation = F.coalesce("has_creation", F.lit(False))
    name = names.base_name(F.col("path"))
    captured = times.capture_time(
        F.col("datetime_original"),
        F.col("datetime_digitized"),
        has_taken,
        times.iso_time(F.col("taken")),
        has_creation,
        times.iso_time(F.col("creation")),
        name,
        now,
    )

    def either(video: str, image: str) -> Column:
        return F.coalesce(F.nullif(F.col(video), F.lit(0)), F.col(image)).cast("int")

    values = {
        "media_item_id": ids.media_id(path, F.col("taken"), F.col("size"), F.col("creation")),
        "relative_path": path,
        "title": F.coalesce(F.nullif(F.col("json_title"), F.lit("")), names.stem(name)),
        "file_size": F.col("size"),
        "width": either("video_width", "exif_width"),
        "height": either("video_height", "exif_height"),
        "capture_timestamp": captured,
        "first_seen_timestamp": seen_at,
        "last_seen_timestamp": seen_at,
        "scan_run_id": F.lit(scan_run_id),
        "status": F.lit("present"),
        "original_media_item_id": F.lit(None).cast("string"),
        "live_photo_pair_id": F.lit(None).cast("string"),
        "exif_orientation": exif.valid_orientation(F.col("orientation")),
        "google_description": F.col("json_description"),
        "google_geo_data_latitude": F.col("latitude"),
        "google_geo_data_longitude": F.col("longitude"),
        "google_geo_data_altitude": F.col("altitude"),
        "google_geo_data_latitude_span": F.col("latitude_span"),
        "google_geo_data_longitude_span": F.col("longitude_span"),
        "media_google_url": F.col("url"),
    }
    # The remaining exif_ columns carry the tag column of the same name.
    def value(column: str) -> Column:
        if column in values:
            return values[column]
        return F.col(column.removeprefix("exif_"))

    return merged.join(digests, "path").select(
        *[value(c).alias(c) for c in schemas.columns(schemas.MEDIA_ITEMS)]
    )
