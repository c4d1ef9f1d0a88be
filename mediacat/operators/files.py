"""Classifying files and deriving the media and sidecar tables from an inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediacat.functions import names


def classify_files(files: DataFrame) -> DataFrame:
    """``files`` with kind, stem, suffix and hidden flag."""
    return files.select(
        "*",
        names.kind(F.col("album"), F.col("name")).alias("kind"),
        names.stem(F.col("name")).alias("stem"),
        names.suffix(F.col("name")).alias("suffix"),
        names.is_hidden(F.col("name")).alias("is_hidden"),
    )


def media_files(files: DataFrame) -> DataFrame:
    return files.filter(names.kind(F.col("album"), F.col("name")) == "media")


def sidecar_files(files: DataFrame) -> DataFrame:
    return files.filter(names.kind(F.col("album"), F.col("name")) == "sidecar")


def album_metadata_files(files: DataFrame) -> DataFrame:
    return files.filter(names.kind(F.col("album"), F.col("name")) == "album_metadata")


def parse_sidecar_names(sidecars: DataFrame, extra_exts: list[str] | None = None) -> DataFrame:
    """(path, album, filename, extension, numeric_suffix) of sidecar files.

    ``photo.jpg.supplemental-metadata(2).json`` gives (photo, jpg, (2)). The extension is
    the run of dot-separated parts that ends at the rightmost one beginning a known
    extension; parts of one character do not count, unless the name is made of nothing
    else. ``extra_exts`` adds to the known extensions.
    """
    name, core, reach, run = F.col("name"), F.col("core"), F.col("reach"), F.col("run")
    single_chars = F.regexp_like(core, F.lit(r"(?s)^[^.](?:\.[^.])+\z"))
    filename = (
        F.when(run != "", F.substring(reach, F.lit(1), F.length(reach) - F.length(run)))
        .when(single_chars, F.substring(core, F.lit(1), F.length(core) - 2))
        .otherwise(core)
    )
    extension = (
        F.when(run != "", F.regexp_replace(F.lower(run), r"^\.", ""))
        .when(single_chars, F.lower(F.right(core, F.lit(1))))
        .otherwise("")
    )
    return (
        sidecars.select("path", "album", "name", names.sidecar_core(name).alias("core"))
        .withColumn("reach", names.sidecar_reach(core, extra_exts))
        .withColumn("run", names.extension_run(reach, extra_exts))
        .select(
            "path",
            "album",
            filename.alias("filename"),
            extension.alias("extension"),
            names.sidecar_number(name).alias("numeric_suffix"),
        )
    )
