"""Queries about archives and continuous ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mediacat.operators import archives
from mediacat.plans import adapters as a, oracle_tables as o
from mediacat.plans.adapters import NEW_SEEN, NEW_START, RUN_NEW
from mediacat.plans.registry import query
from mediacat.session import shared_folder
from mediacat.sources.catalog_store import CatalogStore
from mediacat.streaming import ingest

# Target of a member, part by part: characters replaced, tails cut, reserved names marked.
_TARGETS = """targets AS (
  SELECT *, array_to_string([CASE WHEN upper(string_split(rtrim(part, '. '), '.')[1]) = 'AUX'
      THEN '_' || rtrim(part, '. ') ELSE rtrim(part, '. ') END FOR part IN string_split(replace(member, '?', '_'), '/')], '/')
    AS target FROM members
)"""


@query("archive_members", o.with_tables(
    o.MANIFEST, _TARGETS, select="""SELECT archive, member, target, target <> member AS changed,
      member NOT LIKE '../%' AS safe FROM targets"""))
def archive_members(spark, sf_dir):
    return archives.member_targets(a.manifest(spark, sf_dir)).select(
        "archive", "member", "target", "changed", "safe"
    )


_STATUS = """statuses AS (
  SELECT archive, member, CASE WHEN NOT is_zip THEN 'unverifiable' WHEN gone THEN 'missing'
    WHEN bool_or(gone) OVER (PARTITION BY archive) THEN 'not_checked'
    WHEN bad_size THEN 'size_mismatch' WHEN bad_crc THEN 'crc_mismatch' ELSE 'ok' END AS status FROM members
)"""


def _verified(spark, sf_dir):
    return archives.verify_archives(a.manifest(spark, sf_dir), a.extracted(spark, sf_dir))


@query("verify_archives", o.with_tables(o.MANIFEST, _STATUS, select="SELECT * FROM statuses"))
def verify_archives(spark, sf_dir):
    return _verified(spark, sf_dir)


@query("archive_verdicts", o.with_tables(
    o.MANIFEST, _STATUS, select="""SELECT archive, count(*) AS members,
      count(*) FILTER (status IN ('missing', 'size_mismatch', 'crc_mismatch')) AS bad_members,
      bool_or(status = 'unverifiable') AS extract_all,
      bool_and(status IN ('ok', 'not_checked')) AND count(*) FILTER (status = 'missing') = 0 AS valid
      FROM statuses GROUP BY archive"""))
def archive_verdicts(spark, sf_dir):
    return archives.archive_verdicts(_verified(spark, sf_dir))


@query("resume_plan", o.with_tables(
    o.MANIFEST, select="""SELECT archive, member, CASE WHEN NOT is_zip AND member LIKE '../%' THEN 'unsafe'
      WHEN doc_id % 3 = 2 THEN 'extract' WHEN gone OR bad_size OR (is_zip AND bad_crc) THEN 're-extract'
      ELSE 'skip' END AS action FROM members"""))
def resume_plan(spark, sf_dir):
    return archives.resume_plan(
        a.manifest(spark, sf_dir), a.done(spark, sf_dir), a.extracted(spark, sf_dir)
    )


@query("archives_by_name", """SELECT name, CASE p_size % 7 WHEN 0 THEN 'zip' WHEN 1 THEN 'tar' WHEN 2 THEN 'tar.gz'
      WHEN 3 THEN 'tgz' WHEN 4 THEN 'tar.bz2' WHEN 5 THEN 'tbz2' END AS format
    FROM (SELECT p_size, p_partkey || ['.zip', '.TAR', '.tar.gz', '.tgz', '.Tar.bz2', '.tbz2', '.7z'][p_size % 7 + 1] AS name FROM part)
    WHERE p_size % 7 <> 6""")
def archives_by_name(spark, sf_dir):
    endings = F.array(*[F.lit(e) for e in (".zip", ".TAR", ".tar.gz", ".tgz", ".Tar.bz2", ".tbz2", ".7z")])
    name = F.concat(F.col("p_partkey").cast("string"), F.get(endings, F.col("p_size") % 7))
    files = a.table(spark, sf_dir, "part").select(name.alias("name"), name.alias("path"))
    return archives.archive_inventory(files).select("name", "format")


@query("ingested_catalog", o.with_tables(
    o.SHAPED, o.MEDIA, o.CATALOG, o.RESCAN,
    select="SELECT relative_path, file_size, first_seen, last_seen, scan_run_id, status FROM next_catalog"))
def ingested_catalog(spark, sf_dir):
    """The rescan rows land as manifests, a stream takes them in, the catalog is read back."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4()}"
    snapshot = a.catalog(spark, sf_dir)
    store = CatalogStore.create(spark, f"{folder}/catalog", snapshot.schema, buckets=16)
    store.upsert(snapshot)
    a.rescan(spark, sf_dir).write.parquet(f"{folder}/landing")
    ingest.ingest_stream(
        spark, f"{folder}/landing", store, f"{folder}/changes", f"{folder}/checkpoint",
        RUN_NEW, a.at(NEW_START), a.at(NEW_SEEN),
    ).awaitTermination()
    return store.read().select(
        "relative_path", "file_size",
        F.unix_seconds("first_seen_timestamp").alias("first_seen"),
        F.unix_seconds("last_seen_timestamp").alias("last_seen"),
        "scan_run_id", "status",
    )
