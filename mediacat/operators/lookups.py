"""Filters that stand for the catalog's point and list queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def media_by_path(items: DataFrame, path: str) -> DataFrame:
    return items.filter(F.col("relative_path") == path)


def media_by_id(items: DataFrame, media_item_id: str) -> DataFrame:
    return items.filter(F.col("media_item_id") == media_item_id)


def media_by_status(items: DataFrame, status: str) -> DataFrame:
    return items.filter(F.col("status") == status)


def album_by_path(albums: DataFrame, path: str) -> DataFrame:
    return albums.filter(F.col("album_folder_path") == path)


def album_by_id(albums: DataFrame, album_id: str) -> DataFrame:
    return albums.filter(F.col("album_id") == album_id)


def run_by_id(runs: DataFrame, scan_run_id: str) -> DataFrame:
    return runs.filter(F.col("scan_run_id") == scan_run_id)


def errors_of_run(errors: DataFrame, scan_run_id: str) -> DataFrame:
    """Errors of a run, oldest first."""
    return errors.filter(F.col("scan_run_id") == scan_run_id).orderBy("timestamp", "relative_path")


def errors_of_path(errors: DataFrame, path: str) -> DataFrame:
    """Errors of a file over all runs, newest first."""
    return errors.filter(F.col("relative_path") == path).orderBy(
        F.desc("timestamp"), F.desc("scan_run_id")
    )
