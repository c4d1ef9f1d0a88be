"""Schemas of the tables that operators read and write (Spark DDL)."""

from __future__ import annotations

FILES = "path string, album string, name string, size bigint, mtime timestamp"

SIDECARS = "path string, album string, filename string, extension string, numeric_suffix string"

MEDIA_LINKS = "path string, sidecar_path string, phase int"

ALBUMS = """
    album_id string, album_folder_path string, title string, description string,
    creation_timestamp timestamp, access_level string, status string,
    first_seen_timestamp timestamp, last_seen_timestamp timestamp, scan_run_id string
"""

MEDIA_ITEMS = """
    media_item_id string, relative_path string, album_id string, title string,
    mime_type string, file_size bigint, crc32 string, content_fingerprint string,
    sidecar_fingerprint string, width int, height int, duration_seconds double,
    frame_rate double, capture_timestamp timestamp, first_seen_timestamp timestamp,
    last_seen_timestamp timestamp, scan_run_id string, status string,
    original_media_item_id string, live_photo_pair_id string,
    exif_datetime_original timestamp, exif_datetime_digitized timestamp,
    exif_gps_latitude double, exif_gps_longitude double, exif_gps_altitude double,
    exif_camera_make string, exif_camera_model string, exif_lens_make string,
    exif_lens_model string, exif_focal_length double, exif_f_number double,
    exif_exposure_time string, exif_iso int, exif_orientation int, exif_flash string,
    exif_white_balance string, google_description string,
    google_geo_data_latitude double, google_geo_data_longitude double,
    google_geo_data_altitude double, google_geo_data_latitude_span double,
    google_geo_data_longitude_span double, media_google_url string
"""

SCAN_RUNS = """
    scan_run_id string, status string, start_timestamp timestamp, end_timestamp timestamp,
    total_files_discovered bigint, media_files_discovered bigint,
    metadata_files_discovered bigint, media_files_with_metadata bigint,
    media_files_processed bigint, metadata_files_processed bigint, media_new_files bigint,
    media_unchanged_files bigint, media_changed_files bigint, missing_files bigint,
    media_error_files bigint, inconsistent_files bigint, albums_total bigint,
    duration_seconds double, files_per_second double
"""

PEOPLE = "person_id string, person_name string"

PEOPLE_TAGS = "media_item_id string, person_id string, tag_order int"

PROCESSING_ERRORS = """
    scan_run_id string, relative_path string, error_type string, error_category string,
    error_message string, timestamp timestamp
"""

ARCHIVE_MANIFEST = "archive string, format string, member string, size bigint, crc32 bigint"

EXTRACTED = "archive string, path string, size bigint, crc32 bigint"

EXIF_DUMP = "path string, tags map<string,string>"

PROBE_DUMP = """
    path string, format struct<duration:string>,
    streams array<struct<codec_type:string,width:int,height:int,
        r_frame_rate:string,avg_frame_rate:string>>
"""

FILE_DIGESTS = "path string, size bigint, crc32 string, content_fingerprint string, mime_type string"


def columns(ddl: str) -> list[str]:
    """Column names of a DDL string whose types contain no comma."""
    return [part.split()[0] for part in ddl.split(",") if part.strip()]
