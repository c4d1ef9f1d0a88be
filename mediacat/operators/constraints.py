"""The row rules and keys of the stored tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from mediacat import fixed

c = F.col  # short, since nearly every rule names columns


def _optional(column: str, rule: Column) -> Column:
    return c(column).isNull() | rule


def _not_before(late: str, early: str) -> Column:
    return c(late) >= c(early)


def media_rules() -> dict[str, Column]:
    """Rule name -> condition that must hold, for media_items."""
    return {
        "file_size": c("file_size") >= 0,
        "crc32": _optional("crc32", F.length("crc32") == 8),
        "content_fingerprint": _optional("content_fingerprint", F.length("content_fingerprint") == 64),
        "sidecar_fingerprint": _optional("sidecar_fingerprint", F.length("sidecar_fingerprint") == 64),
        "width": _optional("width", c("width") >= 0),
        "height": _optional("height", c("height") >= 0),
        "duration_seconds": _optional("duration_seconds", c("duration_seconds") >= 0),
        "frame_rate": _optional("frame_rate", c("frame_rate") > 0),
        "status": c("status").isin(fixed.MEDIA_STATUSES),
        "exif_gps_latitude": _optional("exif_gps_latitude", c("exif_gps_latitude").between(-90, 90)),
        "exif_gps_longitude": _optional("exif_gps_longitude", c("exif_gps_longitude").between(-180, 180)),
        "exif_iso": _optional("exif_iso", c("exif_iso") >= 0),
        "exif_orientation": _optional("exif_orientation", c("exif_orientation").between(1, 8)),
        "google_geo_data_latitude": _optional(
            "google_geo_data_latitude", c("google_geo_data_latitude").between(-90, 90)
        ),
        "google_geo_data_longitude": _optional(
            "google_geo_data_longitude", c("google_geo_data_longitude").between(-180, 180)
        ),
        "seen_order": _not_before("last_seen_timestamp", "first_seen_timestamp"),
    }


def album_rules() -> dict[str, Column]:
    return {
        "status": c("status").isin(fixed.ALBUM_STATUSES),
        "seen_order": _not_before("last_seen_timestamp", "first_seen_timestamp"),
    }


def run_rules() -> dict[str, Column]:
    rules = {"status": c("status").isin(fixed.RUN_STATUSES)}
    rules |= {name: c(name) >= 0 for name in fixed.RUN_COUNTERS}
    rules |= {
        name: _optional(name, c(name) >= 0) for name in ("duration_seconds", "files_per_second")
    }
    rules["time_order"] = _optional("end_timestamp", _not_before("end_timestamp", "start_timestamp"))
    return rules


def tag_rules() -> dict[str, Column]:
    return {"tag_order": c("tag_order") >= 0}


def error_rules() -> dict[str, Column]:
    return {
        "error_type": c("error_type").isin(fixed.ERROR_TYPES),
        "error_category": c("error_category").isin(fixed.ERROR_CATEGORIES),
    }


REQUIRED = {
    "media_items": ["relative_path", "album_id", "file_size", "first_seen_timestamp",
                    "last_seen_timestamp", "scan_run_id", "status"],
    "albums": ["album_folder_path", "status", "first_seen_timestamp", "last_seen_timestamp",
               "scan_run_id"],
    "scan_runs": ["status", "start_timestamp"],
    "people": ["person_name"],
    "people_tags": ["tag_order"],
    "processing_errors": ["scan_run_id", "relative_path", "error_type", "error_category",
                          "error_message", "timestamp"],
}

KEYS = {
    "media_items": [["media_item_id"], ["relative_path"]],
    "albums": [["album_id"], ["album_folder_path"]],
    "scan_runs": [["scan_run_id"]],
    "people": [["person_id"], ["person_name"]],
    "people_tags": [["media_item_id", "person_id"], ["media_item_id", "tag_order"]],
}

RULES = {
    "media_items": media_rules,
    "albums": album_rules,
    "scan_runs": run_rules,
    "people_tags": tag_rules,
    "processing_errors": error_rules,
}


def with_violations(
    df: DataFrame, rules: Mapping[str, Column], required: list[str] | None = None
) -> DataFrame:
    """``df`` with an array of the names of the rules each row breaks."""
    broken = [F.when(~rule, F.lit(name)) for name, rule in rules.items()]
    broken += [F.when(c(name).isNull(), F.lit(f"{name}_required")) for name in required or []]
    # Joined text skips the NULLs of kept rules and, unlike array filters, stays in
    # generated code; rule names hold no commas.
    text = F.concat_ws(",", *broken)
    none = F.array().cast("array<string>")
    return df.withColumn("violations", F.when(text == "", none).otherwise(F.split(text, ",")))


def check_constraints(
    df: DataFrame, rules: Mapping[str, Column], required: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their violations)."""
    checked = with_violations(df, rules, required)
    good = checked.filter(F.size("violations") == 0).drop("violations")
    return good, checked.filter(F.size("violations") > 0)


def check_table(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """``check_constraints`` with the rules of a stored table."""
    rules = RULES[table]() if table in RULES else {}
    return check_constraints(df, rules, REQUIRED.get(table))


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, rows) for every rule that some row breaks."""
    return (
        with_violations(df, rules)
        .select(F.explode("violations").alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values that more than one row has; NULL keys never clash."""
    present = F.lit(True)
    for column in key:
        present = present & c(column).isNotNull()
    return df.filter(present).groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
