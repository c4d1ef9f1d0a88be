"""Checking archives against what was extracted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from mediacat.functions import names

MISSING, WRONG_SIZE, WRONG_CRC, OK = "missing", "size_mismatch", "crc_mismatch", "ok"
NOT_CHECKED, UNVERIFIABLE, UNREADABLE = "not_checked", "unverifiable", "unreadable"

_SALTS = 16


def archive_inventory(files: DataFrame) -> DataFrame:
    """Files that are archives by name, with their format, in name order."""
    return (
        files.withColumn("format", names.archive_format(F.col("name")))
        .filter(F.col("format").isNotNull())
        .orderBy("name", "path")
    )


def member_targets(manifest: DataFrame) -> DataFrame:
    """Manifest with target (name after extraction), changed and safe."""
    clean = names.sanitize_member(F.col("member"))
    return manifest.select(
        "*",
        names.normalize_path(clean).alias("target"),
        (clean != F.col("member")).alias("changed"),
        names.is_safe_member(F.col("member")).alias("safe"),
    )


def _checksum(files: DataFrame) -> Column:
    """crc32 as a number, whether it is one or hexadecimal text."""
    crc = F.col("crc32")
    return F.conv(crc, 16, 10).cast("bigint") if files.schema["crc32"].dataType == StringType() else crc


def _one_per_target(files: DataFrame, *values: Column) -> DataFrame:
    """(archive, target, file): of files whose names have one normal form the first by path."""
    target = names.normalize_path(F.col("path")).alias("target")
    return (
        files.select("archive", target, F.struct("path", *values).alias("file"))
        .groupBy("archive", "target").agg(F.min("file").alias("file"))
    )


def verify_archives(manifest: DataFrame, extracted: DataFrame) -> DataFrame:
    """(archive, member, status) of every member.

    When an archive has missing members only those are reported and its other members
    are not checked; otherwise size is compared, then the checksum of files whose size
    agrees. Archives other than zip carry no checksum and cannot be verified. A manifest
    row without member stands for an archive that could not be read to its end.

    ``extracted`` has crc32 as a number or as the hexadecimal text of ``file_digests``. Of
    files whose names have one normal form the first by path counts.
    """
    wanted = member_targets(manifest)
    there = _one_per_target(
        extracted, F.col("size").alias("found_size"), _checksum(extracted).alias("found_crc32")
    ).select("archive", "target", "file.found_size", "file.found_crc32", F.lit(True).alias("exists"))
    joined = wanted.join(there, ["archive", "target"], "left").withColumn(
        "missing", F.col("exists").isNull() & (F.col("format") == "zip") & F.col("member").isNotNull()
    )
    # One small row per archive instead of a window, which would gather a large archive.
    incomplete = (
        joined.filter("missing").select("archive").distinct().withColumn("incomplete", F.lit(True))
    )
    status = (
        F.when(F.col("member").isNull(), UNREADABLE)
        .when(F.col("format") != "zip", UNVERIFIABLE)
        .when(F.col("missing"), MISSING)
        .when(F.col("incomplete"), NOT_CHECKED)
        .when(F.col("found_size") != F.col("size"), WRONG_SIZE)
        .when(F.col("found_crc32") != F.col("crc32"), WRONG_CRC)
        .otherwise(OK)
    )
    # One archive may hold most members: they meet its row by archive and salt.
    salt = F.pmod(F.xxhash64("member"), F.lit(_SALTS)).cast("int")
    incomplete = incomplete.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return joined.withColumn("salt", salt).join(incomplete, ["archive", "salt"], "left").select(
        "archive", "member", status.alias("status")
    )


def archive_verdicts(verified: DataFrame) -> DataFrame:
    """Per archive: valid, number of bad members, whether to extract it again in full.

    An archive that could not be read is not valid and counts as one bad member.
    """
    bad = F.col("status").isin(MISSING, WRONG_SIZE, WRONG_CRC, UNREADABLE)
    return (
        verified.groupBy("archive")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.count_if(bad).alias("bad_members"),
            F.bool_or(F.col("status") == UNVERIFIABLE).alias("extract_all"),
        )
        .withColumn("valid", (F.col("bad_members") == 0) & ~F.col("extract_all"))
    )


def resume_plan(manifest: DataFrame, done: DataFrame, extracted: DataFrame) -> DataFrame:
    """(archive, member, action): extract, re-extract, skip or unsafe.

    A member is skipped when it is recorded as done and the extracted file still agrees:
    size from the manifest and, for zip, the recorded checksum. Members of other archives
    that would leave the target folder are never extracted. Manifest rows without member,
    of archives that could not be read, give no action.

    Names agree by their normal form, as extraction writes them; ``done`` and ``extracted``
    have crc32 as a number or as hexadecimal text.
    """
    manifest = manifest.filter(F.col("member").isNotNull())
    is_zip = F.col("format") == "zip"
    target = F.when(is_zip, names.sanitize_member(F.col("member"))).otherwise(F.col("member"))
    recorded = _one_per_target(done, _checksum(done).alias("recorded_crc32")).select(
        "archive", "target", "file.recorded_crc32", F.lit(True).alias("recorded")
    )
    there = _one_per_target(
        extracted, F.col("size").alias("found_size"), _checksum(extracted).alias("found_crc32")
    ).select("archive", "target", "file.found_size", "file.found_crc32")
    expected = F.when(is_zip, F.col("recorded_crc32"))
    agrees = (F.col("found_size") == F.col("size")) & (
        expected.isNull() | (F.col("found_crc32") == expected)
    )
    action = (
        F.when(~is_zip & ~names.is_safe_member(F.col("member")), "unsafe")
        .when(F.col("recorded").isNull(), "extract")
        .when(F.coalesce(agrees, F.lit(False)), "skip")
        .otherwise("re-extract")
    )
    return (
        manifest.withColumn("target", names.normalize_path(target))
        .join(recorded, ["archive", "target"], "left")
        .join(there, ["archive", "target"], "left")
        .select("archive", "member", action.alias("action"))
    )
