"""Writing and reading the stored tables as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mediacat.sources.catalog_store import CatalogStore


def write_catalog(df: DataFrame, location: str, version: int) -> None:
    """One snapshot of a table per run; earlier versions stay readable meanwhile."""
    df.write.mode("overwrite").parquet(f"{location}/version={version}")


def read_catalog(spark: SparkSession, location: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{location}/version={version}")


def merge_catalog(items: DataFrame, location: str, scan_run_id: str, now: Column, buckets: int = 256) -> CatalogStore:
    """Make the outcome of a whole scan the next version of the store at ``location``.

    The first scan creates the store. Later ones rewrite only the buckets in which rows
    were added, changed or went missing; readers see the version before or this one.
    """
    spark = items.sparkSession
    items = items.drop("change_type")
    store = CatalogStore(spark, location)
    if not store.versions():
        store = CatalogStore.create(spark, location, items.schema, buckets=buckets)
        store.upsert(items)
        return store
    store.replace(items, scan_run_id, spark.range(1).select(now).first()[0])
    return store


def write_errors(errors: DataFrame, location: str) -> None:
    """Append error rows, in folders by run so that dropping a run drops folders."""
    errors.write.mode("append").partitionBy("scan_run_id").parquet(location)


def append_run(run: DataFrame, location: str, written: int) -> None:
    """Append the current row of a run; ``runs.latest_state`` reads the log back."""
    run.withColumn("written", F.lit(written)).write.mode("append").parquet(location)
