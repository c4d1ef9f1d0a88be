"""The jobs a user runs: each takes tables or an export folder and returns tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mediacat import schemas
from mediacat.functions import names
from mediacat.operators import (
    albums, archives, files as file_ops, linking, media, people, relations, reports, rescan, runs,
)
from mediacat.session import checkpointed, require_utc
from mediacat.sources import archives as archive_source, content, inventory


def catalog_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file of an export with its kind and name features."""
    return file_ops.classify_files(inventory.file_inventory(spark, root))


def sidecar_names(files: DataFrame, extra_exts: list[str] | None = None) -> DataFrame:
    """Sidecars of an inventory with the name, extension and number they point at."""
    return file_ops.parse_sidecar_names(file_ops.sidecar_files(files), extra_exts)


@dataclass
class Links:
    links: DataFrame
    orphan_media: DataFrame
    orphan_sidecars: DataFrame


def link_sidecars(
    files: DataFrame, edit_marks: list[str] | None = None, extra_exts: list[str] | None = None
) -> Links:
    """Media linked to sidecars, and what stays alone on either side."""
    sidecars = sidecar_names(files, extra_exts)
    links = linking.link_sidecars(file_ops.media_files(files), sidecars, edit_marks)
    return Links(
        links, linking.orphan_media(links), linking.orphan_sidecars(sidecars, links)
    )


def build_albums(
    files: DataFrame,
    album_json: DataFrame,
    stored: DataFrame | None,
    scan_run_id: str,
    now: Column,
) -> DataFrame:
    """Albums table after a scan; stored albums that were not found become missing."""
    found = albums.discover_albums(files, albums.parse_album_json(album_json), scan_run_id)
    if stored is None:
        stored = found.select(
            "*", now.alias("first_seen_timestamp"), now.alias("last_seen_timestamp")
        ).filter(F.lit(False))
    return rescan.mark_missing(albums.upsert_albums(found, stored, now), scan_run_id)


def build_media(
    files: DataFrame,
    links: DataFrame,
    sidecar_raw: DataFrame,
    digests: DataFrame,
    exif_dump: DataFrame,
    probe_dump: DataFrame,
    album_table: DataFrame,
    scan_run_id: str,
    now: Column,
) -> DataFrame:
    """Full media records of the files of an inventory."""
    require_utc(files.sparkSession)
    merged = media.merge_metadata(
        links,
        media.parse_sidecars(sidecar_raw),
        media.normalize_tags(exif_dump),
        media.normalize_probe(probe_dump),
    )
    return media.media_record(albums.attach_album(merged, album_table), digests, scan_run_id, now)


def rescan_catalog(
    scan: DataFrame,
    stored: DataFrame,
    scan_run_id: str,
    started: Column,
    now: Column,
    preserve_first_seen: bool = False,
) -> DataFrame:
    """Next catalog with change_type, inconsistent and missing rows marked in that order."""
    changed = rescan.apply_changes(scan, stored, scan_run_id, started, now, preserve_first_seen)
    return rescan.mark_missing(
        rescan.mark_inconsistent(changed, scan_run_id, started), scan_run_id
    )


def tag_people(
    media_names: DataFrame, stored_people: DataFrame, stored_tags: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(people, people_tags) after names were read for some media."""
    tags = people.name_tags(media_names)
    everyone = people.assign_person_ids(tags, stored_people)
    return everyone, people.replace_people_tags(tags, everyone, stored_tags)


def relate_media(items: DataFrame, scan_run_id: str) -> DataFrame:
    """Catalog with live-photo pairs and edited variants of a run filled in."""
    present = relations.present_in_run(items, scan_run_id)
    paired = relations.set_pair_id(items, relations.live_photo_pairs(present))
    return relations.set_original_id(paired, relations.edited_variants(present))


def extracted_files(spark: SparkSession, folder: str, archive: str) -> DataFrame:
    """The files below a folder into which one archive was extracted, with checksums."""
    listed = inventory.listed_files(spark, folder)
    digests = content.file_digests(listed, folder)
    return digests.select(F.lit(archive).alias("archive"), "path", "size", "crc32")


def verify_export_archives(
    spark: SparkSession, archive_root: str, extracted: DataFrame
) -> DataFrame:
    """Status of every member of the archives below a folder.

    ``extracted`` is the union of ``extracted_files`` of the archives.
    """
    found = inventory.archive_inventory(spark, archive_root)
    return archives.verify_archives(archive_source.archive_manifest(found, archive_root), extracted)


@dataclass
class ScanReport:
    summary: DataFrame
    audit: DataFrame
    checks: DataFrame
    validation: DataFrame
    statistics: DataFrame


def scan_report(
    run_table: DataFrame,
    error_table: DataFrame,
    items: DataFrame,
    album_table: DataFrame,
    scan_run_id: str,
) -> ScanReport:
    """All reports of one run."""
    run = run_table.filter(F.col("scan_run_id") == scan_run_id)
    return ScanReport(
        reports.run_summary(run_table, error_table, items, album_table, scan_run_id),
        reports.counter_audit(run_table, items, album_table, scan_run_id),
        reports.consistency_checks(run, items, album_table),
        reports.validation_summary(items),
        reports.catalog_stats(items, album_table, error_table, run_table),
    )


def _new_or_changed(
    links: DataFrame, raw: DataFrame, base: str, stored: DataFrame, started: Column
) -> DataFrame:
    """Links of the files to read in full, judged by the ends of each file alone."""
    ends = content.file_digests(links, base, checksum=False)
    prints = media.parse_sidecars(raw).select("path", "sidecar_fingerprint")
    scan = (
        media.join_sidecars(links, prints)
        .join(ends, "path")
        .withColumn("relative_path", names.normalize_path(F.col("path")))
    )
    scan = checkpointed(scan.select(*links.columns, "relative_path", "content_fingerprint",
                                    "sidecar_fingerprint"))
    diff = rescan.rescan_diff(scan, stored, started)
    return checkpointed(rescan.needs_processing(scan, diff).select(*links.columns))


@dataclass
class Scan:
    files: DataFrame
    links: DataFrame
    albums: DataFrame
    items: DataFrame
    errors: DataFrame
    run: DataFrame
    people: DataFrame
    people_tags: DataFrame


def scan_export(
    spark: SparkSession,
    root: str,
    exif_dump: DataFrame,
    probe_dump: DataFrame,
    scan_run_id: str,
    started: Column,
    now: Column,
    stored_items: DataFrame | None = None,
    stored_albums: DataFrame | None = None,
    stored_people: DataFrame | None = None,
    stored_tags: DataFrame | None = None,
) -> Scan:
    """A whole scan of an export folder: inventory, links, albums, records, run row, people.

    Media that cannot be read give an error row and stay out of the catalog.
    """
    require_utc(spark)
    base = inventory.scan_root(root)
    # Listing folders and reading files are the dear steps; each is done once and kept.
    files = checkpointed(inventory.file_inventory(spark, root))
    found = link_sidecars(files)
    links = checkpointed(found.links)
    # Read once, whole; fingerprints, records and errors all come from this.
    raw = checkpointed(content.sidecar_json(files, base))
    album_table = checkpointed(
        build_albums(files, content.album_json(files, base), stored_albums, scan_run_id, now)
    )
    todo = links
    if stored_items is not None:
        todo = _new_or_changed(links, raw, base, stored_items, started)
    digests = checkpointed(content.file_digests(todo, base))
    readable = digests.filter(F.col("size").isNotNull())
    records = build_media(
        files, todo, raw, readable, exif_dump, probe_dump, album_table, scan_run_id, now
    )
    if stored_items is None:
        changes = checkpointed(records.withColumn("change_type", F.lit("new")))
        gone = {}
    else:
        same = links.join(todo.select("path"), "path", "left_anti").select(
            names.normalize_path(F.col("path")).alias("relative_path")
        )
        unchanged = stored_items.join(same, "relative_path", "left_semi")
        scan = records.unionByName(unchanged.select(*records.columns))
        changes = checkpointed(rescan_catalog(scan, stored_items, scan_run_id, started, now))
        was_there = stored_items.filter("status = 'present'").select("relative_path")
        gone = {
            f"{state}_files": changes.filter(F.col("status") == state)
            .join(was_there, "relative_path", "left_semi").agg(F.count(F.lit(1))).scalar()
            for state in ("missing", "inconsistent")
        }
    items = changes.drop("change_type")
    parsed = checkpointed(media.parse_sidecars(raw))
    linked = todo.select(F.col("sidecar_path").alias("path"))
    unread = checkpointed(media.file_errors(digests, scan_run_id, now))
    errors = unread.unionByName(
        media.sidecar_errors(parsed.join(linked, "path", "left_semi"), scan_run_id, now)
    )
    named = (
        media.join_sidecars(todo, parsed.select("path", "people"))
        .filter(F.size("people") > 0)
        .select(names.normalize_path(F.col("path")).alias("relative_path"), "people")
        .join(items.select("relative_path", "media_item_id"), "relative_path")
    )
    if stored_people is None:
        stored_people = spark.createDataFrame([], schemas.PEOPLE)
    if stored_tags is None:
        stored_tags = spark.createDataFrame([], schemas.PEOPLE_TAGS)
    everyone, tags = tag_people(named.select("media_item_id", "people"), stored_people, stored_tags)
    counters = reports.discovery_counters(files, links)
    kinds = reports.run_counters(changes, unread)
    run = runs.complete_run(
        runs.update_run(
            runs.start_run(spark, scan_run_id, started),
            **{c: counters.select(c).scalar() for c in counters.columns},
            **{c: kinds.select(c).scalar() for c in kinds.columns},
            **gone,
            metadata_files_processed=counters.select("metadata_files_discovered").scalar(),
            albums_total=album_table.filter(F.col("scan_run_id") == scan_run_id)
            .agg(F.count(F.lit(1))).scalar(),
        ),
        now,
    )
    return Scan(files, links, album_table, items, errors, run, everyone, tags)
