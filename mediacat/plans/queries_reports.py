"""Queries about runs, errors, reports, rules and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediacat.operators import constraints, lookups, reports, runs
from mediacat.plans import adapters as a, oracle_tables as o
from mediacat.plans.adapters import RUN_NEW
from mediacat.plans.registry import query

_BREAKDOWN = """SELECT CASE grouping_id(error_type, error_category) WHEN 0 THEN 'type_and_category' WHEN 1 THEN 'type'
      WHEN 2 THEN 'category' ELSE 'total' END AS level, error_type, error_category, count(*) AS count
    FROM errors WHERE scan_run_id = 'run-1'
    GROUP BY GROUPING SETS ((error_type, error_category), (error_type), (error_category), ())"""


@query("error_breakdown", o.with_tables(o.ERRORS, select=_BREAKDOWN))
def error_breakdown(spark, sf_dir):
    return reports.error_breakdown(a.errors(spark, sf_dir), "run-1")


@query("error_summary", o.with_tables(
    o.ERRORS, select="SELECT error_category, count(*) AS count FROM errors WHERE scan_run_id = 'run-2' GROUP BY 1"))
def error_summary(spark, sf_dir):
    return reports.error_summary(a.errors(spark, sf_dir), "run-2")


@query("error_count", o.with_tables(
    o.ERRORS, select="SELECT count(*) AS count FROM errors WHERE scan_run_id = 'run-3'"))
def error_count(spark, sf_dir):
    return reports.error_count(a.errors(spark, sf_dir), "run-3")


@query("errors_in_order", o.with_tables(
    o.ERRORS, select="""SELECT 'run' AS of, relative_path, epoch_us(ts) AS micros FROM errors WHERE scan_run_id = 'run-4'
      UNION ALL SELECT 'path', relative_path, epoch_us(ts) FROM errors WHERE relative_path = 'album/file_10.jpg'"""))
def errors_in_order(spark, sf_dir):
    table = a.errors(spark, sf_dir)
    shown = ["relative_path", F.unix_micros("timestamp").alias("micros")]
    of_run = lookups.errors_of_run(table, "run-4").select(F.lit("run").alias("of"), *shown)
    of_path = lookups.errors_of_path(table, "album/file_10.jpg").select(F.lit("path").alias("of"), *shown)
    return of_run.unionByName(of_path)


@query("latest_run", o.with_tables(
    o.RUNS, select="SELECT scan_run_id, status, started FROM runs ORDER BY started DESC, scan_run_id DESC LIMIT 1"))
def latest_run(spark, sf_dir):
    return runs.latest_run(a.runs(spark, sf_dir)).select(
        "scan_run_id", "status", F.unix_seconds("start_timestamp").alias("started")
    )


@query("run_performance", o.with_tables(
    o.RUNS, select="""SELECT scan_run_id, (ended - started)::DOUBLE AS duration_seconds,
      CASE WHEN media_files_processed > 0 THEN media_files_processed::DOUBLE / (ended - started)::DOUBLE
        ELSE 0 END::DOUBLE AS files_per_second FROM runs WHERE ended IS NOT NULL"""))
def run_performance(spark, sf_dir):
    return reports.run_performance(a.runs(spark, sf_dir))


@query("run_states", """SELECT 'run-' || o_custkey AS scan_run_id,
    arg_max(CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END, o_orderkey) AS status,
    max(o_orderkey) AS written FROM orders GROUP BY o_custkey""")
def run_states(spark, sf_dir):
    log = a.runs(spark, sf_dir).select(
        F.substring_index("scan_run_id", "-", -1).cast("bigint").alias("key"), "status"
    )
    owners = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    rows = log.join(owners, "key").select(
        F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("scan_run_id"),
        "status", F.col("key").alias("written"), F.col("key").alias("at"),
    )
    return runs.latest_state(rows, "at").select("scan_run_id", "status", "written")


@query("run_lifecycle", """SELECT 'run-9' AS scan_run_id, 'completed' AS status, 90.0::DOUBLE AS duration_seconds,
    count(*) AS media_files_processed, count(*)::DOUBLE / 90.0::DOUBLE AS files_per_second,
    count(*) FILTER (lang = 'en') AS media_new_files FROM documents""")
def run_lifecycle(spark, sf_dir):
    docs = a.table(spark, sf_dir, "documents")
    counted = docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("en"))
    begun = runs.start_run(spark, "run-9", a.at(1_000))
    updated = runs.update_run(
        begun,
        media_files_processed=counted.select("n").scalar(),
        media_new_files=counted.select("en").scalar(),
    )
    return runs.complete_run(updated, a.at(1_090)).select(
        "scan_run_id", "status", "duration_seconds", "media_files_processed", "files_per_second",
        "media_new_files",
    )


# Runs and errors of the retention queries: users as runs, started at their first event.
_USERS = """users AS (
  SELECT 'user-' || user_id AS scan_run_id, min(ts) AS started FROM events GROUP BY user_id
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY started DESC, scan_run_id DESC) AS age FROM users
)"""


def _user_runs(spark, sf_dir):
    run = F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("scan_run_id")
    events = a.table(spark, sf_dir, "events")
    table = events.groupBy(run).agg(F.min("ts").alias("start_timestamp"))
    failed = events.filter("event_type = 'error'").select(run, F.col("event_id"))
    return runs.retain_runs(table, failed, keep=10)


@query("retained_runs", o.with_tables(_USERS, select="SELECT scan_run_id FROM ranked WHERE age <= 10"))
def retained_runs(spark, sf_dir):
    return _user_runs(spark, sf_dir)[0].select("scan_run_id")


@query("retained_errors", o.with_tables(
    _USERS, select="""SELECT scan_run_id, event_id FROM events JOIN ranked ON scan_run_id = 'user-' || user_id
      WHERE event_type = 'error' AND age <= 10"""))
def retained_errors(spark, sf_dir):
    return _user_runs(spark, sf_dir)[1]


@query("retention_counts", o.with_tables(
    _USERS, select="""SELECT (SELECT count(*) FROM ranked WHERE age > 10) AS scan_runs_deleted,
      (SELECT count(*) FROM events JOIN ranked ON scan_run_id = 'user-' || user_id
        WHERE event_type = 'error' AND age > 10) AS errors_deleted"""))
def retention_counts(spark, sf_dir):
    return _user_runs(spark, sf_dir)[2]


@query("consistency_checks", o.with_tables(
    o.RUNS, o.ALBUMS, """latest AS (
      SELECT *, seen * 2 + CASE WHEN key % 7 = 0 THEN 1 ELSE 0 END AS total,
        seen - CASE WHEN key % 9 = 0 THEN 1 ELSE 0 END AS metadata_done
      FROM runs ORDER BY started DESC, scan_run_id DESC LIMIT 1)""",
    select="""SELECT unnest(rows, max_depth := 2) FROM (SELECT [
        {name: 'total_files = media + metadata', expected: seen * 2, actual: total, pass: total = seen * 2},
        {name: 'metadata_processed = metadata_discovered', expected: seen, actual: metadata_done, pass: metadata_done = seen},
        {name: 'media_processed = media_items_count', expected: items, actual: media_files_processed, pass: media_files_processed = items},
        {name: 'albums_total = albums_count', expected: albums, actual: 10::BIGINT, pass: albums = 10},
        {name: 'media_with_metadata <= media_discovered', expected: seen, actual: seen - key % 3, pass: true}] AS rows
      FROM (SELECT *, (SELECT count(*) FROM documents) AS items, (SELECT count(*) FROM customer) AS albums FROM latest))"""))
def consistency_checks(spark, sf_dir):
    latest = runs.latest_run(a.runs(spark, sf_dir))
    return reports.consistency_checks(
        latest, a.table(spark, sf_dir, "documents"), a.table(spark, sf_dir, "customer")
    )


_MINE = "scan_run_id = 'run-2'"


@query("counter_audit", o.with_tables(
    o.RUNS, o.SHAPED, o.MEDIA, o.CATALOG, o.ALBUMS, select=f"""SELECT scan_run_id,
        media_files_processed AS media_reported, media_actual, 10::BIGINT AS albums_reported, albums_actual, orphaned_present_files,
        abs(media_files_processed - media_actual) AS media_difference, abs(10 - albums_actual) AS albums_difference
      FROM (SELECT *, (SELECT count(*) FROM catalog WHERE {_MINE}) AS media_actual,
        (SELECT count(*) FROM stored WHERE {_MINE}) AS albums_actual,
        (SELECT count(*) FROM catalog WHERE status = 'present' AND NOT {_MINE}) AS orphaned_present_files
      FROM runs WHERE {_MINE})"""))
def counter_audit(spark, sf_dir):
    return reports.counter_audit(
        a.runs(spark, sf_dir), a.catalog(spark, sf_dir), a.stored_albums(spark, sf_dir), RUN_NEW
    )


@query("album_status", o.with_tables(
    o.ALBUMS, select="""SELECT count(*) FILTER (status = 'present') AS present, count(*) FILTER (status = 'missing') AS missing,
      count(*) FILTER (status = 'error') AS error FROM stored"""))
def album_status(spark, sf_dir):
    return reports.album_status(a.stored_albums(spark, sf_dir))


@query("run_summary", o.with_tables(
    o.RUNS, o.ERRORS, o.SHAPED, o.MEDIA, o.CATALOG, o.ALBUMS, select=f"""SELECT scan_run_id, status,
      started AS start_seconds, seen AS media_files_discovered, key % 50 AS media_new_files,
      (SELECT count(*) FROM stored WHERE status = 'missing') AS albums_missing,
      (SELECT string_agg(status || '=' || n, ';' ORDER BY status) FROM (SELECT status, count(*) AS n FROM catalog GROUP BY status)) AS file_status,
      (SELECT count(*) FROM errors WHERE {_MINE}) AS errors_total,
      (SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT error_category AS k, count(*) AS n FROM errors WHERE {_MINE} GROUP BY 1)) AS errors_by_category,
      (SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT error_type || '/' || error_category AS k, count(*) AS n FROM errors WHERE {_MINE} GROUP BY 1)) AS errors_by_both
      FROM runs WHERE {_MINE}"""))
def run_summary(spark, sf_dir):
    summary = reports.run_summary(
        a.runs(spark, sf_dir), a.errors(spark, sf_dir), a.catalog(spark, sf_dir),
        a.stored_albums(spark, sf_dir), RUN_NEW,
    )

    def flat(counts):
        pairs = F.transform(
            F.map_entries(counts), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
        )
        return F.array_join(F.array_sort(pairs), ";")

    return summary.select(
        "scan_run_id", "status",
        F.unix_seconds("timestamps.start").alias("start_seconds"),
        F.col("discovery.media_files_discovered"),
        F.col("processing.media_new_files"),
        F.col("albums.missing").alias("albums_missing"),
        flat(F.col("file_status")).alias("file_status"),
        F.col("errors.total").alias("errors_total"),
        flat(F.col("errors.by_category")).alias("errors_by_category"),
        flat(F.col("errors.by_type_and_category")).alias("errors_by_both"),
    )


@query("tree_stats", o.with_tables(
    o.SHAPED, o.MEDIA, o.SIDECARS, o.FILES, f"""marked AS (
      SELECT album, lower({o.suffix("name")}) AS ext, name = 'metadata.json' AS is_album,
        name = 'archive_browser.html' AS is_page, name LIKE '%.json%' AND name <> 'metadata.json' AS is_sidecar FROM files)""",
    select="""SELECT album, ext, count(*) AS total, count(*) FILTER (is_album) AS album_metadata,
      count(*) FILTER (is_page) AS other, count(*) FILTER (is_sidecar) AS sidecars,
      count(*) FILTER (NOT is_album AND NOT is_page AND NOT is_sidecar) AS media
      FROM marked GROUP BY ROLLUP (album, ext)"""))
def tree_stats(spark, sf_dir):
    return reports.tree_stats(a.files(spark, sf_dir, sizes=False))


@query("catalog_stats", o.with_tables(
    o.ALBUMS, o.ERRORS, o.RUNS, """latest AS (SELECT * FROM runs ORDER BY started DESC, scan_run_id DESC LIMIT 1)""",
    select="""SELECT 'mime_type' AS section,
        CASE doc_id % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'video/mp4' ELSE 'unknown' END AS key, count(*) AS count
      FROM documents GROUP BY ALL
      UNION ALL SELECT 'album', album_folder_path, count(*) FROM stored GROUP BY ALL
      UNION ALL SELECT 'error_category', error_category, count(*) FROM errors GROUP BY ALL
      UNION ALL SELECT 'total', 'media_items', count(*) FROM documents
      UNION ALL SELECT 'total', 'albums', count(*) FROM stored
      UNION ALL SELECT 'total', 'processing_errors', count(*) FROM errors
      UNION ALL SELECT 'latest_run', unnest(['total_files_discovered', 'media_files_discovered', 'metadata_files_discovered',
          'media_files_with_metadata', 'media_files_processed', 'metadata_files_processed', 'media_new_files',
          'media_unchanged_files', 'media_changed_files', 'missing_files', 'media_error_files', 'inconsistent_files', 'albums_total']),
        unnest([seen * 2 + CASE WHEN key % 7 = 0 THEN 1 ELSE 0 END, seen, seen, seen - key % 3, media_files_processed,
          seen - CASE WHEN key % 9 = 0 THEN 1 ELSE 0 END, key % 50, key % 40, key % 30, key % 5, key % 6, key % 2, 10])
        FROM latest"""))
def catalog_stats(spark, sf_dir):
    kind = F.col("doc_id") % 3
    items = a.table(spark, sf_dir, "documents").select(
        F.when(kind == 0, "image/jpeg").when(kind == 1, "video/mp4").alias("mime_type")
    )
    return reports.catalog_stats(
        items, a.stored_albums(spark, sf_dir), a.errors(spark, sf_dir), a.runs(spark, sf_dir)
    )


@query("files_not_in_catalog", o.with_tables(
    o.SHAPED, o.MEDIA, o.SIDECARS, o.FILES, o.CATALOG, select=f"""SELECT path, size, {o.suffix("name")} AS extension FROM files
      WHERE name NOT IN ('metadata.json', 'archive_browser.html') AND name NOT LIKE '%.json%'
        AND path NOT IN (SELECT relative_path FROM catalog WHERE scan_run_id = 'run-2')"""))
def files_not_in_catalog(spark, sf_dir):
    items = a.catalog(spark, sf_dir).filter(F.col("scan_run_id") == RUN_NEW)
    return reports.fs_vs_catalog(a.files(spark, sf_dir), items)


@query("files_and_catalog", o.with_tables(
    o.SHAPED, o.MEDIA, o.SIDECARS, o.FILES, o.ALBUMS, """counted AS (
      SELECT count(*) FILTER (name NOT IN ('metadata.json', 'archive_browser.html') AND name NOT LIKE '%.json%') AS media,
        count(DISTINCT nullif(album, '')) AS albums, (SELECT count(*) FROM documents) AS items,
        (SELECT count(*) FROM stored) AS stored_albums FROM files)""",
    select="""SELECT 'media_files' AS measure, media AS filesystem, items AS catalog, media - items AS difference, media = items AS match FROM counted
      UNION ALL SELECT 'albums', albums, stored_albums, albums - stored_albums, albums = stored_albums FROM counted"""))
def files_and_catalog(spark, sf_dir):
    return reports.fs_catalog_difference(
        a.files(spark, sf_dir, sizes=False), a.table(spark, sf_dir, "documents"),
        a.stored_albums(spark, sf_dir),
    )


@query("log_profile", o.with_tables(
    o.LOG, """marked AS (SELECT lower(regexp_extract(value, ' - ([A-Z]+) - ', 1)) AS level, line_no % 11 AS said FROM log)""",
    select="""SELECT 'lines' AS section, 'total' AS key, count(*) AS count FROM marked
      UNION ALL SELECT 'level', level, count(*) FROM marked WHERE level <> 'trace' GROUP BY level
      UNION ALL SELECT 'event', ['phase_1_happy_path', 'phase_2_numbered_files', 'phase_3_edited_files', 'phase_4_unmatched',
          'match_rate', 'multiple_sidecars_warning', 'scan_complete'][said + 1], count(*)
        FROM marked WHERE said <= 6 GROUP BY said"""))
def log_profile(spark, sf_dir):
    return reports.log_profile(a.log_lines(spark, sf_dir))


@query("log_match_statistics", o.with_tables(
    o.LOG, """last AS (SELECT line_no % 11 AS said, max(line_no) AS line_no FROM log GROUP BY 1), found AS (
      SELECT max(line_no) FILTER (said = 0) AS phase1, max(line_no) FILTER (said = 1) AS phase2,
        max(line_no) FILTER (said = 2) AS phase3, max(line_no) FILTER (said = 3) AS unmatched_media,
        max(line_no) FILTER (said = 4) % 100 || '.5%' AS match_rate FROM last)""",
    select="""SELECT phase1, phase2, phase3, phase1 + phase2 + phase3 AS total_matches, unmatched_media,
      30::BIGINT AS unmatched_sidecars, match_rate,
      (SELECT count(*) FROM log WHERE line_no % 11 = 5) AS multiple_sidecars_warnings FROM found"""))
def log_match_statistics(spark, sf_dir):
    return reports.log_match_statistics(a.log_lines(spark, sf_dir))


_ROWS = """checked AS (
  SELECT l_orderkey, l_linenumber, list_filter([
    CASE WHEN l_quantity - 5 < 0 THEN 'file_size' END,
    CASE WHEN l_suppkey % 50 = 0 THEN 'crc32' END,
    CASE WHEN l_suppkey % 21 = 0 THEN 'frame_rate' END,
    CASE WHEN l_returnflag = 'R' THEN 'status' END,
    CASE WHEN l_partkey % 200 > 180 THEN 'exif_gps_latitude' END,
    CASE WHEN l_linenumber > 6 THEN 'exif_orientation' END], lambda rule: rule IS NOT NULL) AS broken FROM lineitem
)"""


def _lines_as_items(spark, sf_dir):
    return a.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey"), F.col("l_linenumber"),
        (F.col("l_quantity") - 5).cast("bigint").alias("file_size"),
        F.when(F.col("l_suppkey") % 50 == 0, "short").otherwise("0a1b2c3d").alias("crc32"),
        (F.col("l_suppkey") % 21).cast("double").alias("frame_rate"),
        F.when(F.col("l_returnflag") == "R", "lost").otherwise("present").alias("status"),
        (F.col("l_partkey") % 200 - 90).cast("double").alias("exif_gps_latitude"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") + 2).alias("exif_orientation"),
    )


def _line_rules():
    names = ["file_size", "crc32", "frame_rate", "status", "exif_gps_latitude", "exif_orientation"]
    rules = constraints.media_rules()
    return {name: rules[name] for name in names}


@query("broken_rules", o.with_tables(
    _ROWS, select="SELECT rule, count(*) AS rows FROM (SELECT unnest(broken) AS rule FROM checked) GROUP BY rule"))
def broken_rules(spark, sf_dir):
    return constraints.violation_counts(_lines_as_items(spark, sf_dir), _line_rules())


@query("rows_breaking_rules", o.with_tables(
    _ROWS, select="""SELECT l_orderkey, l_linenumber, array_to_string(broken, ';') AS violations, count(*) AS rows
      FROM checked WHERE len(broken) > 0 GROUP BY ALL"""))
def rows_breaking_rules(spark, sf_dir):
    bad = constraints.check_constraints(_lines_as_items(spark, sf_dir), _line_rules())[1]
    return bad.groupBy(
        "l_orderkey", "l_linenumber", F.array_join("violations", ";").alias("violations")
    ).agg(F.count(F.lit(1)).alias("rows"))


@query("repeated_keys", """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def repeated_keys(spark, sf_dir):
    return constraints.repeated_keys(a.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
