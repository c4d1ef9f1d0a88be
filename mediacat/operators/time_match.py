"""Linking by time, for sidecars that no name rule could place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mediacat.functions import names


def media_time(original: Column, digitized: Column, video_creation: Column) -> Column:
    """Time of a media file for matching: original, then digitized, then video creation."""
    return F.coalesce(original, digitized, video_creation)


def match_by_time(sidecars: DataFrame, media: DataFrame, tolerance: int = 1) -> DataFrame:
    """(sidecar_path, media_path): first media in path order within the tolerance.

    ``sidecars`` has album, path and taken_seconds (whole seconds); ``media`` has album,
    path and media_time. Both sides shrink to one row per album and second before they
    meet, so many files of the same moment do not multiply; a band of buckets then turns
    the range condition into an equi-join.
    """
    width = tolerance + 1
    micros = F.unix_micros("media_time")
    second = F.floor(micros / F.lit(1_000_000)).cast("bigint")
    moments = (
        media.filter(F.col("media_time").isNotNull())
        .groupBy(
            "album",
            second.alias("second"),
            (F.pmod(micros, F.lit(1_000_000)) > 0).alias("past"),
        )
        .agg(F.min("path").alias("media_path"))
        .withColumn("bucket", F.floor(F.col("second") / width).cast("bigint"))
    )
    wanted = (
        sidecars.filter(F.col("taken_seconds").isNotNull())
        .select("album", "taken_seconds")
        .distinct()
        .withColumn("home", F.floor(F.col("taken_seconds") / width).cast("bigint"))
        .select(
            "album",
            "taken_seconds",
            F.explode(F.sequence(F.col("home") - 1, F.col("home") + 1)).alias("bucket"),
        )
    )
    latest = F.col("taken_seconds") + tolerance - F.when(F.col("past"), 1).otherwise(0)
    chosen = (
        wanted.join(moments, ["album", "bucket"])
        .filter(F.col("second").between(F.col("taken_seconds") - tolerance, latest))
        .groupBy("album", "taken_seconds")
        .agg(F.min("media_path").alias("media_path"))
    )
    return (
        sidecars.select("album", "taken_seconds", F.col("path").alias("sidecar_path"))
        .join(chosen, ["album", "taken_seconds"])
        .select("sidecar_path", "media_path")
    )


def match_orphans_by_title_time(
    orphans: DataFrame, media: DataFrame, tolerance: int = 1
) -> DataFrame:
    """(sidecar_path, media_path, seconds_apart) of orphans in year albums.

    The sidecar's title must be the name of a media file in the same folder whose capture
    time is within the tolerance. ``orphans``: path, album, json_title, taken_seconds;
    ``media``: relative_path, capture_timestamp.
    """
    wanted = orphans.filter(
        F.regexp_like(names.base_name(F.col("album")), F.lit(r"^Photos from \p{Nd}{4}"))
    ).select(
        F.col("path").alias("sidecar_path"),
        F.concat("album", F.lit("/"), "json_title").alias("relative_path"),
        "taken_seconds",
    )
    apart = F.abs(F.unix_micros("capture_timestamp") - F.col("taken_seconds") * 1_000_000)
    return (
        wanted.join(media.select("relative_path", "capture_timestamp"), "relative_path")
        .withColumn("seconds_apart", apart / F.lit(1_000_000))
        .filter(F.col("seconds_apart") <= tolerance)
        .select("sidecar_path", F.col("relative_path").alias("media_path"), "seconds_apart")
    )
