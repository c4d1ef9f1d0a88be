"""Comparing a scan with the stored catalog and producing the next catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UNCHANGED, CHANGED, NEW, KEPT, ABSENT = "unchanged", "changed", "new", "kept", "absent"


def _change_type(started: Column) -> Column:
    """Change of one row of the joined scan (``new``) and catalog (``old``)."""
    same = (
        F.col("old.content_fingerprint") == F.col("new.content_fingerprint")
    ) & F.col("old.sidecar_fingerprint").eqNullSafe(F.col("new.sidecar_fingerprint"))
    in_catalog = F.col("old.relative_path").isNotNull()
    return (
        F.when(F.col("new.relative_path").isNull(), ABSENT)
        .when(in_catalog & same, UNCHANGED)
        .when(in_catalog & (F.col("old.first_seen_timestamp") < started), CHANGED)
        .when(in_catalog, KEPT)
        .otherwise(NEW)
    )


def rescan_diff(scan: DataFrame, catalog: DataFrame, started: Column) -> DataFrame:
    """(relative_path, change_type) of every path in the scan or the catalog.

    Only the two fingerprints are needed, so this runs before anything expensive; parse
    and hash fully only what is new or changed. ``kept`` marks a differing path that was
    first seen in this very run: it counts as new but the stored row stays.
    """
    new = scan.select("relative_path", "content_fingerprint", "sidecar_fingerprint").alias("new")
    old = catalog.select(
        "relative_path", "content_fingerprint", "sidecar_fingerprint", "first_seen_timestamp"
    ).alias("old")
    return new.join(
        old, F.col("new.relative_path") == F.col("old.relative_path"), "full"
    ).select(
        F.coalesce("new.relative_path", "old.relative_path").alias("relative_path"),
        _change_type(started).alias("change_type"),
    )


def needs_processing(scan: DataFrame, diff: DataFrame) -> DataFrame:
    """Scan rows to read in full: new and changed paths."""
    todo = diff.filter(F.col("change_type").isin(NEW, CHANGED, KEPT)).select("relative_path")
    return scan.join(todo, "relative_path", "left_semi")


def one_row_per_path(scan: DataFrame, catalog: DataFrame, order: str, started: Column) -> DataFrame:
    """Scan with repeated paths settled: the last row where the path is a change, else the first."""
    row = F.struct(*[F.col(c) for c in scan.columns])
    by_path = scan.groupBy("relative_path").agg(
        F.min_by(row, F.col(order)).alias("first"), F.max_by(row, F.col(order)).alias("last")
    )
    earlier = catalog.filter(F.col("first_seen_timestamp") < started).select(
        "relative_path", F.lit(True).alias("stored")
    )
    pick = F.when(F.col("stored"), F.col("last")).otherwise(F.col("first"))
    return by_path.join(earlier, "relative_path", "left").select(pick.alias("row")).select("row.*")


def apply_changes(
    scan: DataFrame,
    catalog: DataFrame,
    scan_run_id: str,
    started: Column,
    now: Column,
    preserve_first_seen: bool = False,
) -> DataFrame:
    """Next catalog with change_type.

    ``scan`` and ``catalog`` share their columns. Unchanged rows are touched and come back
    to present; changed rows are replaced whole, first_seen included unless
    ``preserve_first_seen``; new rows are added; rows the scan did not meet stay.
    """
    new, old = scan.alias("new"), catalog.alias("old")
    change = F.col("change_type")
    replaced = change.isin(NEW, CHANGED)
    seen = change.isin(UNCHANGED, CHANGED, NEW)
    stamps = {
        "scan_run_id": F.when(seen, F.lit(scan_run_id)).otherwise(F.col("old.scan_run_id")),
        "last_seen_timestamp": F.when(seen, now).otherwise(F.col("old.last_seen_timestamp")),
        "status": F.when(change == UNCHANGED, "present")
        .when(replaced, F.col("new.status"))
        .otherwise(F.col("old.status")),
        "first_seen_timestamp": F.when(
            replaced,
            F.coalesce("old.first_seen_timestamp", now) if preserve_first_seen else now,
        ).otherwise(F.col("old.first_seen_timestamp")),
    }

    def value(column: str) -> Column:
        if column in stamps:
            return stamps[column]
        return F.when(replaced, F.col(f"new.{column}")).otherwise(F.col(f"old.{column}"))

    joined = new.join(
        old, F.col("new.relative_path") == F.col("old.relative_path"), "full"
    ).withColumn("change_type", _change_type(started))
    return joined.select(*[value(c).alias(c) for c in catalog.columns], change)


def mark_inconsistent(items: DataFrame, scan_run_id: str, started: Column) -> DataFrame:
    """Present rows of this run that were last seen before it began. Run before mark_missing."""
    odd = (
        (F.col("scan_run_id") == scan_run_id)
        & (F.col("last_seen_timestamp") < started)
        & (F.col("status") == "present")
    )
    return items.withColumn("status", F.when(odd, "inconsistent").otherwise(F.col("status")))


def mark_missing(rows: DataFrame, scan_run_id: str) -> DataFrame:
    """Present media or albums that this run did not meet become missing."""
    gone = (F.col("scan_run_id") != scan_run_id) & (F.col("status") == "present")
    return rows.withColumn("status", F.when(gone, "missing").otherwise(F.col("status")))


def touch_seen(items: DataFrame, seen: DataFrame, scan_run_id: str, now: Column) -> DataFrame:
    """Rows whose path is in ``seen`` get this run's stamps and are present again."""
    hit = seen.select("relative_path", F.lit(True).alias("hit"))
    joined = items.join(hit, "relative_path", "left")
    found = F.coalesce("hit", F.lit(False))
    fresh = {
        "scan_run_id": F.lit(scan_run_id),
        "last_seen_timestamp": now,
        "status": F.lit("present"),
    }
    return joined.select(
        *[
            F.when(found, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c)
            for c in items.columns
        ]
    )
