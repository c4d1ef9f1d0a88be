"""Queries about rescans and the relations between stored files."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediacat.functions import ids
from mediacat.operators import lookups, relations, reports, rescan
from mediacat.plans import adapters as a, jobs, oracle_tables as o
from mediacat.plans.adapters import NEW_SEEN, NEW_START, RUN_NEW
from mediacat.plans.registry import query

_SCAN = (o.SHAPED, o.MEDIA, o.CATALOG, o.RESCAN)


def _next(spark, sf_dir):
    return jobs.rescan_catalog(
        a.rescan(spark, sf_dir), a.catalog(spark, sf_dir), RUN_NEW, a.at(NEW_START), a.at(NEW_SEEN)
    )


def _shown(items):
    return items.select(
        "relative_path", "change_type", "file_size",
        F.unix_seconds("first_seen_timestamp").alias("first_seen"),
        F.unix_seconds("last_seen_timestamp").alias("last_seen"),
        "scan_run_id", "status",
    )


@query("rescan_diff", o.with_tables(*_SCAN, select="SELECT relative_path, change_type FROM diff"))
def rescan_diff(spark, sf_dir):
    return rescan.rescan_diff(a.rescan(spark, sf_dir), a.catalog(spark, sf_dir), a.at(NEW_START))


@query("rescan_todo", o.with_tables(
    *_SCAN, select="SELECT relative_path FROM diff WHERE change_type IN ('new', 'changed', 'kept')"))
def rescan_todo(spark, sf_dir):
    scan = a.rescan(spark, sf_dir)
    diff = rescan.rescan_diff(scan, a.catalog(spark, sf_dir), a.at(NEW_START))
    return rescan.needs_processing(scan, diff).select("relative_path")


@query("rescan_applied", o.with_tables(*_SCAN, select="SELECT * FROM next_catalog"))
def rescan_applied(spark, sf_dir):
    return _shown(rescan.apply_changes(
        a.rescan(spark, sf_dir), a.catalog(spark, sf_dir), RUN_NEW, a.at(NEW_START), a.at(NEW_SEEN)
    )).select("relative_path", "change_type", "file_size", "first_seen", "last_seen", "scan_run_id", "status")


@query("rescan_catalog", o.with_tables(*_SCAN, select="SELECT * FROM marked"))
def rescan_catalog(spark, sf_dir):
    return _shown(_next(spark, sf_dir))


@query("rescan_counters", o.with_tables(
    *_SCAN, o.ERRORS, select="""SELECT count(*) FILTER (change_type IN ('new', 'kept')) AS media_new_files,
      count(*) FILTER (change_type = 'changed') AS media_changed_files,
      count(*) FILTER (change_type = 'unchanged') AS media_unchanged_files,
      count(*) FILTER (change_type <> 'absent') AS media_files_processed,
      (SELECT count(*) FROM errors WHERE scan_run_id = 'run-1') AS media_error_files FROM diff"""))
def rescan_counters(spark, sf_dir):
    diff = rescan.rescan_diff(a.rescan(spark, sf_dir), a.catalog(spark, sf_dir), a.at(NEW_START))
    return reports.run_counters(diff, a.errors(spark, sf_dir).filter("scan_run_id = 'run-1'"))


@query("repeated_scan_rows", """SELECT 'order ' || l_orderkey AS relative_path,
    CASE WHEN l_orderkey % 2 = 0 THEN arg_max(l_partkey, l_linenumber) ELSE arg_min(l_partkey, l_linenumber) END AS content
  FROM (FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1)
  GROUP BY l_orderkey""")
def repeated_scan_rows(spark, sf_dir):
    lines = a.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("content")
    )
    path = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"))
    scan = lines.select(path.alias("relative_path"), "content", "l_linenumber")
    stored = a.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("relative_path"),
        F.when(F.col("o_orderkey") % 2 == 0, a.at(a.OLD_SEEN)).otherwise(a.at(NEW_SEEN)).alias(
            "first_seen_timestamp"),
    )
    settled = rescan.one_row_per_path(scan, stored, "l_linenumber", a.at(NEW_START))
    return settled.select("relative_path", "content")


@query("touched_items", o.with_tables(
    o.SHAPED, o.MEDIA, o.CATALOG, select=f"""SELECT relative_path,
      CASE WHEN file_size % 2 = 0 THEN '{RUN_NEW}' ELSE scan_run_id END AS scan_run_id,
      CASE WHEN file_size % 2 = 0 THEN {NEW_SEEN} ELSE last_seen END AS last_seen,
      CASE WHEN file_size % 2 = 0 THEN 'present' ELSE status END AS status FROM catalog"""))
def touched_items(spark, sf_dir):
    items = a.catalog(spark, sf_dir)
    seen = items.filter(F.col("file_size") % 2 == 0)
    return rescan.touch_seen(items, seen, RUN_NEW, a.at(NEW_SEEN)).select(
        "relative_path", "scan_run_id",
        F.unix_seconds("last_seen_timestamp").alias("last_seen"), "status",
    )


@query("missing_albums", o.with_tables(
    o.ALBUMS, select=f"""SELECT album_folder_path, CASE WHEN scan_run_id <> '{RUN_NEW}' AND status = 'present'
      THEN 'missing' ELSE status END AS status FROM stored"""))
def missing_albums(spark, sf_dir):
    return rescan.mark_missing(a.stored_albums(spark, sf_dir), RUN_NEW).select("album_folder_path", "status")


@query("status_breakdown", o.with_tables(*_SCAN, select="SELECT status, count(*) AS count FROM marked GROUP BY status"))
def status_breakdown(spark, sf_dir):
    return reports.status_breakdown(_next(spark, sf_dir))


@query("validation_summary", o.with_tables(
    *_SCAN, select="""SELECT count(*) AS total_files, count(*) FILTER (status = 'present') AS present_files,
      count(*) FILTER (status = 'missing') AS missing_files,
      count(*) FILTER (status = 'inconsistent') AS inconsistent_files,
      count(*) FILTER (status = 'error') AS error_files FROM marked"""))
def validation_summary(spark, sf_dir):
    return reports.validation_summary(_next(spark, sf_dir))


@query("duplicate_files", o.with_tables(
    o.SHAPED, o.MEDIA, o.CATALOG, select="""SELECT file_size, copies, relative_path, first_seen, first_path,
        first_path = relative_path AS is_first FROM (
      SELECT file_size, relative_path, first_seen, count(*) OVER same AS copies,
        first(relative_path) OVER (PARTITION BY text ORDER BY first_seen, relative_path) AS first_path
      FROM catalog WINDOW same AS (PARTITION BY text)) WHERE copies > 1"""))
def duplicate_files(spark, sf_dir):
    return relations.duplicate_groups(a.catalog(spark, sf_dir)).select(
        "file_size", "copies", "relative_path",
        F.unix_seconds("first_seen_timestamp").alias("first_seen"), "first_path", "is_first",
    )


_PAIRS = """current AS (
  SELECT *, regexp_extract(relative_path, '^(.*)\\.[^.]+$', 1) AS trunk,
    lower(regexp_extract(relative_path, '\\.([^.]+)$', 1)) AS ext
  FROM catalog WHERE scan_run_id = 'run-2' AND status = 'present'
), pairs AS (
  SELECT i.relative_path AS image_path, v.relative_path AS video_path
  FROM current i JOIN current v ON i.trunk = v.trunk AND i.ext IN ('heic', 'jpg', 'jpeg') AND v.ext = 'mov'
)"""


def _present(spark, sf_dir):
    return relations.present_in_run(a.catalog(spark, sf_dir), RUN_NEW)


@query("live_photo_pairs", o.with_tables(
    o.SHAPED, o.MEDIA, o.CATALOG, _PAIRS,
    select=f"""SELECT image_path, video_path, {o.uuid5("image_path || '|' || video_path")} AS pair_id
      FROM pairs"""))
def live_photo_pairs(spark, sf_dir):
    return relations.live_photo_pairs(_present(spark, sf_dir))


@query("items_with_pairs", o.with_tables(
    o.SHAPED, o.MEDIA, o.CATALOG, _PAIRS, select="""SELECT relative_path, pair.image_path IS NOT NULL AS paired
      FROM catalog c LEFT JOIN (SELECT image_path, image_path AS p FROM pairs UNION ALL SELECT image_path, video_path FROM pairs) pair
        ON pair.p = c.relative_path"""))
def items_with_pairs(spark, sf_dir):
    items = a.catalog(spark, sf_dir)
    pairs = relations.live_photo_pairs(_present(spark, sf_dir))
    return relations.set_pair_id(items, pairs).select(
        "relative_path", F.col("live_photo_pair_id").isNotNull().alias("paired")
    )


@query("pair_counts", o.with_tables(
    o.SHAPED, o.MEDIA, o.CATALOG, _PAIRS,
    select="SELECT count(*) AS pairs_linked, 2 * count(*) AS files_updated FROM pairs"))
def pair_counts(spark, sf_dir):
    return relations.pair_counts(relations.live_photo_pairs(_present(spark, sf_dir)))


_VARIANTS = """current AS (
  SELECT * FROM catalog WHERE scan_run_id = 'run-2' AND status = 'present'
), variants AS (
  SELECT e.relative_path AS edited_path, b.relative_path AS original_path, b.media_item_id AS original_id
  FROM current e JOIN current b ON b.relative_path = replace(e.relative_path, '-edited', '')
  WHERE e.relative_path LIKE '%-edited%'
)"""


@query("edited_variants", o.with_tables(
    o.SHAPED, o.MEDIA, o.CATALOG, _VARIANTS, select="SELECT edited_path, original_path FROM variants"))
def edited_variants(spark, sf_dir):
    return relations.edited_variants(_present(spark, sf_dir))


@query("items_with_originals", o.with_tables(
    o.SHAPED, o.MEDIA, o.CATALOG, _VARIANTS, select="""SELECT relative_path, original_id AS original_media_item_id
      FROM catalog LEFT JOIN variants ON edited_path = relative_path"""))
def items_with_originals(spark, sf_dir):
    related = jobs.relate_media(a.catalog(spark, sf_dir), RUN_NEW)
    return related.select("relative_path", "original_media_item_id")


@query("variant_counts", o.with_tables(
    o.SHAPED, o.MEDIA, o.CATALOG, _VARIANTS, select="""SELECT count(*) AS variants_linked, count(*) AS originals_found,
      0::BIGINT AS originals_missing FROM variants"""))
def variant_counts(spark, sf_dir):
    items = a.catalog(spark, sf_dir)
    return relations.variant_counts(items, relations.edited_variants(_present(spark, sf_dir)))


@query("item_counts", o.with_tables(
    o.SHAPED, o.MEDIA, o.CATALOG, o.ALBUMS, select="""SELECT 'items' AS what, count(*) AS count FROM catalog
      UNION ALL SELECT 'missing items', count(*) FILTER (status = 'missing') FROM catalog
      UNION ALL SELECT 'albums', count(*) FROM stored
      UNION ALL SELECT 'albums in error', count(*) FILTER (status = 'error') FROM stored"""))
def item_counts(spark, sf_dir):
    items, albums = a.catalog(spark, sf_dir), a.stored_albums(spark, sf_dir)
    counts = {
        "items": reports.item_count(items),
        "missing items": reports.item_count(items, "missing"),
        "albums": reports.album_count(albums),
        "albums in error": reports.album_count(albums, "error"),
    }
    rows = [df.select(F.lit(what).alias("what"), "count") for what, df in counts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("catalog_lookups", o.with_tables(
    o.SHAPED, o.MEDIA, o.CATALOG, o.ALBUMS, select=f"""
      SELECT 'path' AS found_by, relative_path AS key FROM catalog WHERE relative_path = 'Photos from 2015/IMG_00000000.jpg'
      UNION ALL SELECT 'id', relative_path FROM catalog WHERE relative_path = 'Photos from 2016/IMG_00000000.jpg'
      UNION ALL SELECT 'status', relative_path FROM catalog WHERE status = 'missing'
      UNION ALL SELECT 'album path', album_folder_path FROM stored WHERE album_folder_path = 'Album 7'
      UNION ALL SELECT 'album id', album_folder_path FROM stored WHERE {o.uuid5("album_folder_path")} =
        {o.uuid5("'Album 9'")}"""))
def catalog_lookups(spark, sf_dir):
    items, albums = a.catalog(spark, sf_dir), a.stored_albums(spark, sf_dir)
    by_id = items.filter(F.col("media_item_id") == ids.uuid5(F.lit("Photos from 2016/IMG_00000000.jpg")))
    found = {
        "path": lookups.media_by_path(items, "Photos from 2015/IMG_00000000.jpg"),
        "id": by_id,
        "status": lookups.media_by_status(items, "missing"),
    }
    rows = [df.select(F.lit(how).alias("found_by"), F.col("relative_path").alias("key"))
            for how, df in found.items()]
    album_id = albums.filter(F.col("album_id") == ids.album_id(F.lit("Album 9")))
    for how, df in {"album path": lookups.album_by_path(albums, "Album 7"), "album id": album_id}.items():
        rows.append(df.select(F.lit(how).alias("found_by"), F.col("album_folder_path").alias("key")))
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result
