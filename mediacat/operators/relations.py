"""Duplicates, live-photo pairs and edited variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mediacat import fixed
from mediacat.functions import ids, names


def present_in_run(items: DataFrame, scan_run_id: str) -> DataFrame:
    return items.filter((F.col("scan_run_id") == scan_run_id) & (F.col("status") == "present"))


_SALTS = 16


def duplicate_groups(items: DataFrame) -> DataFrame:
    """Every file that shares size and checksum with another, with its group.

    first_path is the member seen first. Groups are summarised first. One group may hold
    any share of the files (all empty ones are equal), so its summary is repeated for a few
    salts and the files are joined to it by group and salt.
    """
    order = F.struct("first_seen_timestamp", "relative_path")
    groups = (
        items.filter(F.col("crc32").isNotNull())
        .groupBy("file_size", "crc32")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first"))
        .filter(F.col("copies") > 1)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    )
    salt = F.pmod(F.xxhash64("relative_path"), F.lit(_SALTS)).cast("int").alias("salt")
    return (
        items.select("relative_path", "file_size", "crc32", "first_seen_timestamp", salt)
        .join(groups, ["file_size", "crc32", "salt"])
        .select(
            "file_size",
            "crc32",
            "copies",
            "relative_path",
            "first_seen_timestamp",
            F.col("first.relative_path").alias("first_path"),
            (F.col("first.relative_path") == F.col("relative_path")).alias("is_first"),
        )
    )


def live_photo_pairs(items: DataFrame) -> DataFrame:
    """(image_path, video_path, pair_id): same folder and stem, image with .mov.

    Folder and stem match in exact case, suffixes in any case.
    """
    path = F.col("relative_path")
    name = names.base_name(path)
    parts = items.select(
        path,
        names.parent(path).alias("folder"),
        names.stem(name).alias("stem"),
        names.lower_suffix(name).alias("low"),
    )
    images = parts.filter(F.col("low").isin(fixed.LIVE_IMAGE_SUFFIXES)).select(
        "folder", "stem", F.col("relative_path").alias("image_path")
    )
    videos = parts.filter(F.col("low") == fixed.LIVE_VIDEO_SUFFIX).select(
        "folder", "stem", F.col("relative_path").alias("video_path")
    )
    return images.join(videos, ["folder", "stem"]).select(
        "image_path", "video_path",
        ids.pair_id(F.col("image_path"), F.col("video_path")).alias("pair_id"),
    )


def set_pair_id(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """``items`` with live_photo_pair_id; an item in several pairs keeps the last one."""
    rank = F.struct("image_path", "video_path")
    last = (
        pairs.select(
            F.explode(F.array("image_path", "video_path")).alias("relative_path"),
            rank.alias("rank"),
            "pair_id",
        )
        .groupBy("relative_path")
        .agg(F.max_by("pair_id", "rank").alias("pair_id"))
    )
    return (
        items.join(last, "relative_path", "left")
        .withColumn("live_photo_pair_id", F.coalesce("pair_id", "live_photo_pair_id"))
        .select(*items.columns)
    )


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pairs_linked, files_updated): both members of each pair are written."""
    return pairs.agg(F.count(F.lit(1)).alias("pairs_linked")).select(
        "pairs_linked", (F.col("pairs_linked") * 2).alias("files_updated")
    )


def _original_path(path: Column) -> Column:
    """Path without the last ``-edited`` of its stem and all that follows it in the stem."""
    name = names.base_name(path)
    stem = names.stem(name)
    kept = F.regexp_extract(stem, rf"(?s)^(.*){fixed.EDITED_MARK}", 1)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    return F.when(
        F.contains(stem, F.lit(fixed.EDITED_MARK)), F.concat(folder, kept, names.suffix(name))
    )


def edited_variants(items: DataFrame) -> DataFrame:
    """(edited_path, original_path) where the unedited name exists in the same folder.

    Paths are compared in composed Unicode form; the mark is matched in exact case.
    """
    path = F.col("relative_path")
    wanted = items.select(
        path.alias("edited_path"),
        names.normalize_path(_original_path(path)).alias("normal_path"),
    ).filter(F.col("normal_path").isNotNull())
    existing = items.groupBy(names.normalize_path(path).alias("normal_path")).agg(
        F.max("relative_path").alias("original_path")
    )
    return wanted.join(existing, "normal_path").select("edited_path", "original_path")


def set_original_id(items: DataFrame, variants: DataFrame) -> DataFrame:
    """``items`` with original_media_item_id filled for edited variants."""
    originals = items.select(
        F.col("relative_path").alias("original_path"), F.col("media_item_id").alias("original_id")
    )
    found = variants.join(originals, "original_path").select(
        F.col("edited_path").alias("relative_path"), "original_id"
    )
    return (
        items.join(found, "relative_path", "left")
        .withColumn("original_media_item_id", F.coalesce("original_id", "original_media_item_id"))
        .select(*items.columns)
    )


def variant_counts(items: DataFrame, variants: DataFrame) -> DataFrame:
    """(variants_linked, originals_found, originals_missing) over stored items."""
    stored = items.select("relative_path", F.lit(True).alias("stored"))
    edited = stored.select(
        F.col("relative_path").alias("edited_path"), F.col("stored").alias("edited_stored")
    )
    original = stored.select(
        F.col("relative_path").alias("original_path"), F.col("stored").alias("original_stored")
    )
    joined = variants.join(original, "original_path", "left").join(edited, "edited_path", "left")
    found = F.col("original_stored").isNotNull()
    return joined.agg(
        F.count_if(found & F.col("edited_stored").isNotNull()).alias("variants_linked"),
        F.count_if(found).alias("originals_found"),
        F.count_if(~found).alias("originals_missing"),
    )
