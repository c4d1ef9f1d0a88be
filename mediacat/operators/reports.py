"""Counts, breakdowns and checks over the catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mediacat import fixed
from mediacat.functions import names
from mediacat.operators import runs

def _count() -> Column:
    return F.count(F.lit(1)).alias("count")


def _rows(df: DataFrame) -> Column:
    """Row count of ``df`` as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


# --- discovery and linking ------------------------------------------------------------

def discovery_stats(files: DataFrame, links: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(measure, value): files per kind, media per phase and what stayed unmatched."""
    kind = names.kind(F.col("album"), F.col("name"))
    per_kind = files.groupBy(F.concat(F.lit("discovered_"), kind).alias("measure")).agg(
        F.count(F.lit(1)).alias("value")
    )
    phase = F.coalesce(
        F.concat(F.lit("matched_phase"), F.col("phase").cast("string")), F.lit("unmatched_media")
    )
    per_phase = links.groupBy(phase.alias("measure")).agg(F.count(F.lit(1)).alias("value"))
    used = links.select(F.col("sidecar_path").alias("path"))
    left = sidecars.join(used, "path", "left_anti").agg(
        F.lit("unmatched_sidecars").alias("measure"), F.count(F.lit(1)).alias("value")
    )
    return per_kind.unionByName(per_phase).unionByName(left)


def discovery_counters(files: DataFrame, links: DataFrame) -> DataFrame:
    """The four counters a run records after discovery."""
    kind = names.kind(F.col("album"), F.col("name"))
    counted = files.agg(
        F.count_if(kind == "media").alias("media_files_discovered"),
        F.count_if(kind == "sidecar").alias("metadata_files_discovered"),
    )
    return counted.select(
        (F.col("media_files_discovered") + F.col("metadata_files_discovered")).alias(
            "total_files_discovered"
        ),
        "media_files_discovered",
        "metadata_files_discovered",
        _rows(links.filter(F.col("sidecar_path").isNotNull())).alias("media_files_with_metadata"),
    )


def match_statistics(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Matches per phase, totals over phases 1-3 and 1-4 and the match rate in percent."""
    def matched(*phases: int) -> Column:
        return F.count_if(F.col("phase").isin(*phases))

    total = matched(1, 2, 3, 4)
    return links.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("media"),
        matched(1).alias("phase1"),
        matched(2).alias("phase2"),
        matched(3).alias("phase3"),
        matched(4).alias("phase4"),
        matched(1, 2, 3).alias("matched_exact"),
        total.alias("matched"),
        F.round(F.lit(100.0) * total / F.count(F.lit(1)), 1).alias("match_rate"),
    )


def tree_stats(files: DataFrame) -> DataFrame:
    """Files by album and extension with totals; here any name with .json in it is a sidecar.

    Rows with NULL extension total an album, the row with both NULL totals everything.
    """
    sidecar = F.contains("name", F.lit(".json"))
    is_album = F.col("name") == fixed.ALBUM_METADATA_NAME
    is_page = F.col("name") == fixed.EXPORT_PAGE_NAME
    return (
        files.select(
            F.split_part("album", F.lit("/"), F.lit(1)).alias("album"),
            names.lower_suffix(F.col("name")).alias("ext"),
            is_album.alias("is_album"),
            is_page.alias("is_page"),
            (sidecar & ~is_album & ~is_page).alias("is_sidecar"),
        )
        .rollup("album", "ext")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("is_album").alias("album_metadata"),
            F.count_if("is_page").alias("other"),
            F.count_if("is_sidecar").alias("sidecars"),
            F.count_if(~F.col("is_album") & ~F.col("is_page") & ~F.col("is_sidecar")).alias("media"),
        )
    )


# --- errors -------------------------------------------------------------------------------

def error_breakdown(errors: DataFrame, scan_run_id: str) -> DataFrame:
    """Counts by type and category, by type, by category and in total, in one pass."""
    kind, category = F.col("error_type"), F.col("error_category")
    level = F.grouping_id()
    return (
        errors.filter(F.col("scan_run_id") == scan_run_id)
        .groupingSets([[kind, category], [kind], [category], []], kind, category)
        .agg(level.alias("level"), _count())
        .select(
            F.when(F.col("level") == 0, "type_and_category")
            .when(F.col("level") == 1, "type")
            .when(F.col("level") == 2, "category")
            .otherwise("total")
            .alias("level"),
            "error_type",
            "error_category",
            "count",
        )
        .orderBy("level", F.desc("count"), "error_type", "error_category")
    )


def error_summary(errors: DataFrame, scan_run_id: str) -> DataFrame:
    """Errors of a run by category."""
    return errors.filter(F.col("scan_run_id") == scan_run_id).groupBy("error_category").agg(_count())


def error_count(errors: DataFrame, scan_run_id: str) -> DataFrame:
    return errors.filter(F.col("scan_run_id") == scan_run_id).agg(_count())


# --- status -------------------------------------------------------------------------------

def status_breakdown(items: DataFrame) -> DataFrame:
    return items.groupBy("status").agg(_count())


def album_status(albums: DataFrame) -> DataFrame:
    """One row: albums that are present, missing and in error; 0 where there are none."""
    return albums.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("present", "missing", "error")]
    )


def validation_summary(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("total_files"),
        *[
            F.count_if(F.col("status") == s).alias(f"{s}_files")
            for s in ("present", "missing", "inconsistent", "error")
        ],
    )


def item_count(items: DataFrame, status: str | None = None) -> DataFrame:
    """Number of media items or albums, of one status or of all."""
    return (items if status is None else items.filter(F.col("status") == status)).agg(_count())


album_count = item_count


# --- runs -----------------------------------------------------------------------------------

def run_counters(changes: DataFrame, errors: DataFrame) -> DataFrame:
    """New, changed, unchanged and written files of a run, and its errors."""
    kinds = changes.agg(
        F.count_if(F.col("change_type").isin("new", "kept")).alias("media_new_files"),
        F.count_if(F.col("change_type") == "changed").alias("media_changed_files"),
        F.count_if(F.col("change_type") == "unchanged").alias("media_unchanged_files"),
    )
    written = (
        F.col("media_new_files") + F.col("media_changed_files") + F.col("media_unchanged_files")
    )
    return kinds.select(
        "*", written.alias("media_files_processed"), _rows(errors).alias("media_error_files")
    )


def run_performance(runs: DataFrame) -> DataFrame:
    """Duration and files per second of closed runs; 0 when nothing was processed."""
    seconds = (F.unix_micros("end_timestamp") - F.unix_micros("start_timestamp")) / F.lit(1_000_000)
    rate = F.when(
        F.col("media_files_processed") > 0, F.try_divide(F.col("media_files_processed"), seconds)
    ).otherwise(F.lit(0.0))
    return runs.filter(F.col("end_timestamp").isNotNull()).select(
        "scan_run_id", seconds.alias("duration_seconds"), rate.alias("files_per_second")
    )


def run_summary(
    runs: DataFrame, errors: DataFrame, items: DataFrame, albums: DataFrame, scan_run_id: str
) -> DataFrame:
    """One nested record of a run: discovery, processing, albums, statuses, errors, speed."""
    breakdown = error_breakdown(errors, scan_run_id)

    def counts(level: str, key: Column) -> Column:
        entry = F.when(F.col("level") == level, F.struct(key.alias("key"), F.col("count").alias("value")))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    error_maps = breakdown.agg(
        F.struct(
            F.coalesce(F.max(F.when(F.col("level") == "total", F.col("count"))), F.lit(0)).alias("total"),
            counts("type", F.col("error_type")).alias("by_type"),
            counts("category", F.col("error_category")).alias("by_category"),
            counts(
                "type_and_category", F.concat_ws("/", "error_type", "error_category")
            ).alias("by_type_and_category"),
        ).alias("errors")
    )
    file_status = status_breakdown(items).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "count")))).alias("m")
    )
    album_states = album_status(albums).select(F.struct("present", "missing", "error").alias("s"))
    album_row = album_states.scalar()
    return runs.filter(F.col("scan_run_id") == scan_run_id).select(
        "scan_run_id",
        "status",
        F.struct(
            F.col("start_timestamp").alias("start"), F.col("end_timestamp").alias("end"),
            "duration_seconds",
        ).alias("timestamps"),
        F.struct(
            "total_files_discovered", "media_files_discovered", "metadata_files_discovered"
        ).alias("discovery"),
        F.struct(
            "media_files_processed", "metadata_files_processed", "media_new_files",
            "media_unchanged_files", "media_changed_files", "missing_files",
            "media_error_files", "inconsistent_files",
        ).alias("processing"),
        F.struct(
            F.col("albums_total").alias("total"),
            album_row["present"].alias("present"),
            album_row["missing"].alias("missing"),
            album_row["error"].alias("error"),
        ).alias("albums"),
        file_status.scalar().alias("file_status"),
        error_maps.scalar().alias("errors"),
        F.struct("duration_seconds", "files_per_second").alias("performance"),
    )


def counter_audit(
    runs: DataFrame, items: DataFrame, albums: DataFrame, scan_run_id: str
) -> DataFrame:
    """Counters a run reported next to what the tables hold."""
    mine = F.col("scan_run_id") == scan_run_id
    stray = items.filter((F.col("status") == "present") & (F.col("scan_run_id") != scan_run_id))
    return (
        runs.filter(mine)
        .select(
            "scan_run_id",
            F.col("media_files_processed").alias("media_reported"),
            _rows(items.filter(mine)).alias("media_actual"),
            F.col("albums_total").alias("albums_reported"),
            _rows(albums.filter(mine)).alias("albums_actual"),
            _rows(stray).alias("orphaned_present_files"),
        )
        .withColumn("media_difference", F.abs(F.col("media_reported") - F.col("media_actual")))
        .withColumn("albums_difference", F.abs(F.col("albums_reported") - F.col("albums_actual")))
    )


def consistency_checks(latest: DataFrame, items: DataFrame, albums: DataFrame) -> DataFrame:
    """Five named checks of a run's counters: expected, actual and whether they agree.

    ``latest`` is one run row. The last check is an upper bound, the others are equalities.
    """
    discovered = F.col("media_files_discovered") + F.col("metadata_files_discovered")
    checks = [
        ("total_files = media + metadata", discovered, F.col("total_files_discovered")),
        ("metadata_processed = metadata_discovered",
         F.col("metadata_files_discovered"), F.col("metadata_files_processed")),
        ("media_processed = media_items_count", F.col("items"), F.col("media_files_processed")),
        ("albums_total = albums_count", F.col("albums"), F.col("albums_total")),
        ("media_with_metadata <= media_discovered",
         F.col("media_files_discovered"), F.col("media_files_with_metadata")),
    ]
    counted = latest.select("*", _rows(items).alias("items"), _rows(albums).alias("albums"))
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                expected.cast("bigint").alias("expected"),
                actual.cast("bigint").alias("actual"),
                (actual <= expected if "<=" in name else actual == expected).alias("pass"),
            )
            for name, expected, actual in checks
        ]
    )
    return counted.select(F.inline(rows))


# --- catalog and logs ---------------------------------------------------------------------

#: Counters of a run that the catalog's statistics show.
_RUN_COUNTERS = [
    "total_files_discovered", "media_files_discovered", "metadata_files_discovered",
    "media_files_with_metadata", "media_files_processed", "metadata_files_processed",
    "media_new_files", "media_unchanged_files", "media_changed_files", "missing_files",
    "media_error_files", "inconsistent_files", "albums_total",
]


def catalog_stats(
    items: DataFrame, albums: DataFrame, errors: DataFrame, run_table: DataFrame | None = None
) -> DataFrame:
    """(section, key, count): media by MIME type, albums by folder, errors by category.

    With ``run_table`` also the totals of media, albums and errors and the counters of the
    run that started last; no runs, no counters.
    """
    def section(df: DataFrame, label: str, key: Column) -> DataFrame:
        return df.groupBy(F.lit(label).alias("section"), key.alias("key")).agg(_count())

    found = (
        section(items, "mime_type", F.coalesce("mime_type", F.lit("unknown")))
        .unionByName(section(albums, "album", F.col("album_folder_path")))
        .unionByName(section(errors, "error_category", F.col("error_category")))
    )
    if run_table is None:
        return found
    for name, table in [("media_items", items), ("albums", albums), ("processing_errors", errors)]:
        found = found.unionByName(table.agg(_count()).select(F.lit("total").alias("section"), F.lit(name).alias("key"), "count"))
    counters = F.array(*[
        F.struct(F.lit("latest_run").alias("section"), F.lit(c).alias("key"), F.col(c).cast("bigint").alias("count"))
        for c in _RUN_COUNTERS if c in run_table.columns
    ])
    return found.unionByName(runs.latest_run(run_table).select(F.inline(counters)))


def fs_vs_catalog(files: DataFrame, items: DataFrame) -> DataFrame:
    """(path, size, extension) of files that should be in the catalog and are not."""
    media = ~(
        F.col("name").isin(fixed.ALBUM_METADATA_NAME, fixed.EXPORT_PAGE_NAME)
        | F.contains("name", F.lit(".json"))
    )
    return (
        files.filter(media)
        .join(items.select(F.col("relative_path").alias("path")), "path", "left_anti")
        .select("path", "size", names.suffix(F.col("name")).alias("extension"))
    )


def fs_catalog_difference(files: DataFrame, items: DataFrame, albums: DataFrame) -> DataFrame:
    """(measure, filesystem, catalog, difference, match) for media files and albums."""
    media = ~(
        F.col("name").isin(fixed.ALBUM_METADATA_NAME, fixed.EXPORT_PAGE_NAME)
        | F.contains("name", F.lit(".json"))
    )
    folder = F.split_part("album", F.lit("/"), F.lit(1))
    counted = files.agg(
        F.count_if(media).alias("media"),
        F.count_distinct(F.when(F.col("album") != "", folder)).alias("albums"),
    ).select("*", _rows(items).alias("items"), _rows(albums).alias("stored_albums"))
    rows = F.array(
        *[
            F.struct(
                F.lit(measure).alias("measure"),
                F.col(left).alias("filesystem"),
                F.col(right).alias("catalog"),
                (F.col(left) - F.col(right)).alias("difference"),
                (F.col(left) == F.col(right)).alias("match"),
            )
            for measure, left, right in [
                ("media_files", "media", "items"), ("albums", "albums", "stored_albums"),
            ]
        ]
    )
    return counted.select(F.inline(rows))


def log_level(line: Column) -> Column:
    """Level named in a log line between spaces; NULL when none is."""
    low = F.lower(line)
    found = None
    for level in fixed.LOG_LEVELS:
        hit = F.contains(low, F.lit(f" {level} "))
        found = F.when(hit, level) if found is None else found.when(hit, level)
    return found


def log_event(line: Column) -> Column:
    """Key event a log line reports; NULL when none."""
    low = F.lower(line)
    found = None
    for event, words in fixed.LOG_EVENTS:
        hit = F.lit(True)
        for word in words:
            hit = hit & F.contains(low, F.lit(word))
        found = F.when(hit, event) if found is None else found.when(hit, event)
    return found


def log_profile(lines: DataFrame) -> DataFrame:
    """(section, key, count): lines in total, per level and per key event."""
    line = F.col("value")
    marks = F.array(
        *[
            F.struct(F.lit(section).alias("section"), key.alias("key"))
            for section, key in [
                ("lines", F.lit("total")), ("level", log_level(line)), ("event", log_event(line)),
            ]
        ]
    )
    return (
        lines.select(F.inline(marks))
        .filter(F.col("key").isNotNull())
        .groupBy("section", "key")
        .agg(_count())
    )


def log_match_statistics(lines: DataFrame) -> DataFrame:
    """Match counts that a log reports; where a line repeats, the last value in line order wins.

    ``lines`` has value and line_no.
    """
    line, event = F.col("value"), log_event(F.col("value"))

    def last(name: str, pattern: str, group: int = 1) -> Column:
        found = F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))
        return F.max_by(found, F.when((event == name) & found.isNotNull(), F.col("line_no")))

    def number(name: str, pattern: str, group: int = 1) -> Column:
        return F.coalesce(last(name, pattern, group).try_cast("bigint"), F.lit(0))

    both, matches = fixed.LOG_UNMATCHED_PATTERN, fixed.LOG_MATCHES_PATTERN
    found = lines.agg(
        number("phase_1_happy_path", matches).alias("phase1"),
        number("phase_2_numbered_files", matches).alias("phase2"),
        number("phase_3_edited_files", matches).alias("phase3"),
        number("phase_4_unmatched", both, 1).alias("unmatched_media"),
        number("phase_4_unmatched", both, 2).alias("unmatched_sidecars"),
        last("match_rate", fixed.LOG_RATE_PATTERN).alias("rate"),
        F.count_if(event == "multiple_sidecars_warning").alias("multiple_sidecars_warnings"),
    )
    return found.select(
        "phase1", "phase2", "phase3",
        (F.col("phase1") + F.col("phase2") + F.col("phase3")).alias("total_matches"),
        "unmatched_media", "unmatched_sidecars",
        F.concat(F.coalesce("rate", F.lit("0")), F.lit("%")).alias("match_rate"),
        "multiple_sidecars_warnings",
    )
