"""Queries of this folder, added by ``__spark_entry__`` when the folder is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediacat.session import shared_folder

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query, with the SQL that must give the same rows where there is one."""

    def register(build: Build) -> Build:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captions(documents: DataFrame) -> DataFrame:
    """Documents as captions of media items: (media_item_id, google_description)."""
    return documents.select(
        F.col("doc_id").alias("media_item_id"), F.col("text").alias("google_description")
    )


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in a new folder below the shared one."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
