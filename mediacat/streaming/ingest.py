"""Continuous ingest: arriving manifests become changes of the catalog.

Manifests are Parquet files of scan rows that land in a folder. Each micro-batch reads and
writes only the buckets of the catalog store in which its paths lie. The store remembers the
last batch along with the version that holds it, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mediacat.operators import rescan
from mediacat.sources.catalog_store import CatalogStore

_BATCH, _ORDER = "batch_id", "_order"


def take_in(
    store: CatalogStore, batch: DataFrame, batch_id: int, changes_location: str,
    scan_run_id: str, started: Column, now: Column, name: str = "ingest",
) -> bool:
    """Take one batch of scan rows into the store; False if it had been taken in before.

    Of a path that comes several times in a batch the last row counts if the path is in the
    catalog already, else the first (by time last seen, then by id). What became of each
    path is written below ``changes_location``.
    """
    if store.mark(name) >= batch_id:
        return False
    stored = store.read(buckets=store.buckets_of(batch))
    ordered = batch.withColumn(_ORDER, F.struct("last_seen_timestamp", "media_item_id"))
    scan = rescan.one_row_per_path(ordered, stored, _ORDER, started).drop(_ORDER)
    outcome = rescan.apply_changes(scan, stored.select(*scan.columns), scan_run_id, started, now)
    met = outcome.filter(F.col("change_type") != rescan.ABSENT)
    met.select("relative_path", "change_type").write.mode("overwrite").parquet(f"{changes_location}/{_BATCH}={batch_id}")
    store.upsert(met.filter(F.col("change_type") != rescan.KEPT).drop("change_type"), mark=(name, batch_id))
    return True


def read_changes(spark: SparkSession, changes_location: str) -> DataFrame:
    """(relative_path, change_type, batch_id) of all batches."""
    fields = [StructField("relative_path", StringType()), StructField("change_type", StringType())]
    return spark.read.schema(StructType([*fields, StructField(_BATCH, LongType())])).parquet(changes_location)


def ingest_stream(
    spark: SparkSession,
    landing: str,
    store: CatalogStore,
    changes_location: str,
    checkpoint_location: str,
    scan_run_id: str,
    started: Column,
    now: Column,
) -> StreamingQuery:
    """Process the manifests that have arrived and stop; run again to go on from there.

    The checkpoint remembers finished files, the store finished batches.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        own = CatalogStore(batch.sparkSession, store.location)
        take_in(own, batch, batch_id, changes_location, scan_run_id, started, now)

    return (
        spark.readStream.schema(store.read().schema)
        .parquet(landing)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint_location)
        .trigger(availableNow=True)
        .start()
    )
