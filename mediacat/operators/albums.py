"""Albums: one per folder, described by its metadata file where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mediacat import fixed
from mediacat.functions import content, ids, names, sidecar_json


def parse_album_json(raw: DataFrame) -> DataFrame:
    """(path, parsed, title, description, access_level, creation_timestamp) of album files.

    ``raw`` has path and raw, bytes or text. What is not JSON in UTF-8 gives parsed = false
    and NULLs.
    """
    v = F.col("v")
    stamp = sidecar_json.field(v, "date.timestamp").try_cast("bigint")
    inside = stamp.between(fixed.EPOCH_SECONDS_MIN, fixed.EPOCH_SECONDS_MAX)
    return raw.select("path", F.try_parse_json(content.strict_text(F.col("raw").cast("binary"))).alias("v")).select(
        "path",
        v.isNotNull().alias("parsed"),
        sidecar_json.field(v, "title").alias("title"),
        sidecar_json.field(v, "description").alias("description"),
        sidecar_json.field(v, "access").alias("access_level"),
        F.timestamp_seconds(F.when(inside, stamp)).alias("creation_timestamp"),
    )


def discover_albums(
    files: DataFrame, album_json: DataFrame, scan_run_id: str
) -> DataFrame:
    """Albums of one scan, before they meet the stored ones.

    Every folder below the root is an album. Its title comes from its metadata file, else
    from the folder name; year folders without a metadata file get the standard title.
    """
    folder = F.split_part(F.col("album"), F.lit("/"), F.lit(1))
    folders = files.filter(F.col("album") != "").select(folder.alias("folder")).distinct()
    described = album_json.filter(
        F.size(F.split("path", "/")) == 2
    ).withColumn("folder", names.parent(F.col("path")))
    year = names.album_year(F.col("folder"))
    is_user = F.col("path").isNotNull()
    title = F.coalesce(
        F.nullif(F.col("title"), F.lit("")),
        F.when(~is_user & year.isNotNull(), F.concat(F.lit(fixed.YEAR_ALBUM_TITLE), year.cast("string"))),
        F.col("folder"),
    )
    return folders.join(described, "folder", "left").select(
        ids.album_id(F.col("folder")).alias("album_id"),
        names.normalize_path(F.col("folder")).alias("album_folder_path"),
        title.alias("title"),
        "description",
        "creation_timestamp",
        "access_level",
        F.when(is_user & ~F.col("parsed"), "error").otherwise("present").alias("status"),
        F.lit(scan_run_id).alias("scan_run_id"),
        F.when(is_user, "user").when(year.isNotNull(), "year").otherwise("folder").alias("album_kind"),
    )


def upsert_albums(found: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Stored albums brought up to date with the ones found.

    A found album is always touched; its text fields replace stored ones only where they
    have a value; its status always does. Albums not found stay as they are.
    """
    new, old = found.alias("new"), stored.alias("old")
    seen = F.col("new.album_folder_path").isNotNull()

    def newer(column: str) -> Column:
        return F.coalesce(F.col(f"new.{column}"), F.col(f"old.{column}")).alias(column)

    def touched(column: str, value: Column) -> Column:
        return F.when(seen, value).otherwise(F.col(f"old.{column}")).alias(column)

    return new.join(old, "album_folder_path", "full").select(
        F.coalesce("old.album_id", "new.album_id").alias("album_id"),
        "album_folder_path",
        newer("title"),
        newer("description"),
        newer("creation_timestamp"),
        newer("access_level"),
        newer("status"),
        F.coalesce("old.first_seen_timestamp", now).alias("first_seen_timestamp"),
        touched("last_seen_timestamp", now),
        touched("scan_run_id", F.col("new.scan_run_id")),
    )


def attach_album(media: DataFrame, albums: DataFrame) -> DataFrame:
    """``media`` with album_id; folders that are not albums get an id from their path."""
    known = albums.select(F.col("album_folder_path").alias("album"), "album_id")
    return media.join(known, "album", "left").withColumn(
        "album_id", F.coalesce("album_id", ids.album_id(F.col("album")))
    )
