"""A catalog table in buckets, of which a change rewrites only those it touches.

Rows lie in buckets by the hash of their path. A version is a small file that lists, for
each bucket, the folders with its rows: the first holds all of them, later ones what has
changed since. A new version adds one folder and is published by one rename, so readers see
the old one or the new one. A bucket with many folders is written anew as one.

A scan stamps every row it finds again. Those stamps are not written row by row: a version
carries one, which holds for all present rows in folders that are no younger.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from mediacat.sources.storage import Storage

_BUCKET, _AGE = "_bucket", "_age"
_STAMPED = ("scan_run_id", "last_seen_timestamp")


class StaleVersion(Exception):
    """Another writer has published a version in the meantime; nothing was changed."""


class CatalogStore:
    """Media items or albums below one location, by the path in ``key``."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")
        self._files = Storage(spark, self.location)

    @classmethod
    def create(
        cls, spark: SparkSession, location: str, schema: StructType, key: str = "relative_path", buckets: int = 256
    ) -> CatalogStore:
        """An empty store. ``buckets`` is fixed from here on; aim at some 100 MB in each."""
        store = cls(spark, location)
        store._publish(0, {"key": key, "buckets": buckets, "schema": schema.jsonValue(), "folders": {}, "marks": {}, "stamp": None})
        return store

    # --- versions ------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._files.names("versions") if n.endswith(".json")]

    def _manifest(self, version: int | None = None) -> tuple[int, dict]:
        version = max(self.versions()) if version is None else version
        return version, json.loads(self._files.read(f"versions/{version:010d}.json"))

    def _publish(self, version: int, manifest: dict) -> None:
        if not self._files.publish(f"versions/{version:010d}.json", json.dumps(manifest)):
            raise StaleVersion(f"version {version} of {self.location} exists")

    def mark(self, name: str) -> int:
        """The number last stored under a name by ``upsert``, -1 before that."""
        return self._manifest()[1]["marks"].get(name, -1)

    # --- reading -------------------------------------------------------------------

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that hold the paths of some rows; there are no more than the store has."""
        manifest = self._manifest()[1]
        return [r[0] for r in rows.select(_bucket(manifest)).distinct().collect()]

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, as of a version (the latest unless given)."""
        return self._read(self._manifest(version)[1], buckets)

    def _read(self, manifest: dict, buckets: list[int] | None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        wanted = manifest["folders"] if buckets is None else {str(b): manifest["folders"].get(str(b), []) for b in buckets}
        single = [(b, f[0]) for b, f in wanted.items() if len(f) == 1]
        several = [(b, folder) for b, f in wanted.items() if len(f) > 1 for folder in f]
        table = self._rows(manifest, schema, single)
        if several:
            layered = self._rows(manifest, schema, several)
            last = F.max_by(F.struct(*schema.names), F.col(_AGE)).alias("row")
            layered = layered.groupBy(manifest["key"]).agg(last).select("row.*")
            table = layered.unionByName(table.drop(_AGE)) if single else layered
        return table.select(*schema.names)

    def _rows(self, manifest: dict, schema: StructType, folders: list[tuple[str, str]]) -> DataFrame:
        """Rows of some (bucket, folder) with the number of the version that wrote them."""
        paths = [f"{self.location}/data/{folder}/{_BUCKET}={bucket}" for bucket, folder in folders]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn(_AGE, F.lit(0))
        written_by = F.regexp_extract("_metadata.file_path", r"/data/(\d+)-[^/]*/[^/]*/[^/]*$", 1).cast("int")
        rows = self.spark.read.schema(schema).parquet(*paths).withColumn(_AGE, written_by)
        stamp = manifest["stamp"]
        if stamp is None:
            return rows
        again = (F.col("status") == "present") & (F.col(_AGE) <= stamp["version"])
        return rows.withColumns({
            "scan_run_id": F.when(again, F.lit(stamp["scan_run_id"])).otherwise(F.col("scan_run_id")),
            "last_seen_timestamp": F.when(again, F.timestamp_micros(F.lit(stamp["seen_micros"]))).otherwise(F.col("last_seen_timestamp")),
        })

    # --- writing -------------------------------------------------------------------

    def upsert(
        self, rows: DataFrame, max_layers: int = 8, mark: tuple[str, int] | None = None,
        seen: tuple[str, datetime] | None = None,
    ) -> int:
        """Put rows in place of those with their paths, or add them; returns the new version.

        Paths must not repeat. Buckets that come to more than ``max_layers`` folders are
        written anew; with 1 that is every bucket touched, and reading needs no merging.
        ``mark`` is stored with the version, so a repeated piece of work can be told. With
        ``seen`` (run, time) all present rows that were there before carry that stamp.
        """
        before, manifest = self._manifest()
        version = before + 1
        folders = {b: list(f) for b, f in manifest["folders"].items()}
        if seen is not None:
            manifest["stamp"] = {"version": before, "scan_run_id": seen[0], "seen_micros": round(seen[1].timestamp() * 1_000_000)}
        folder = self._write(manifest, rows, version)
        touched = [n.split("=")[1] for n in self._files.names(f"data/{folder}") if n.startswith(f"{_BUCKET}=")]
        for bucket in touched:
            folders.setdefault(bucket, []).append(folder)
        manifest["folders"] = folders
        full = [int(b) for b in touched if len(folders[b]) > max_layers]
        if full:
            whole = self._write(manifest, self._read(manifest, full), version)
            folders |= {str(b): [whole] for b in full}
        if mark is not None:
            manifest["marks"] = manifest["marks"] | {mark[0]: mark[1]}
        self._publish(version, manifest)
        return version

    def _write(self, manifest: dict, rows: DataFrame, version: int) -> str:
        folder = f"{version:010d}-{uuid.uuid4().hex}"
        names = StructType.fromJson(manifest["schema"]).names
        dealt = rows.select(*names, _bucket(manifest)).repartition(_BUCKET).sortWithinPartitions(_BUCKET, manifest["key"])
        dealt.write.partitionBy(_BUCKET).parquet(f"{self.location}/data/{folder}")
        return folder

    def replace(self, table: DataFrame, scan_run_id: str, now: datetime, max_layers: int = 1) -> int:
        """Make ``table``, the outcome of a whole scan, the next version.

        Only rows that differ are written: those the scan merely found again are told by the
        version's stamp. No row of the store may be missing in ``table``.
        """
        manifest = self._manifest()[1]
        key = manifest["key"]
        compared = [n for n in StructType.fromJson(manifest["schema"]).names if n not in _STAMPED]
        prints = lambda df: df.select(key, F.xxhash64(*compared).alias("print"), "status", *_STAMPED)
        old, new = prints(self.read()).alias("old"), prints(table).alias("new")
        stamped = (F.col("new.scan_run_id") == scan_run_id) & (F.col("new.last_seen_timestamp") == F.lit(now))
        kept = F.when(F.col("new.status") == "present", stamped).otherwise(
            F.col("new.scan_run_id").eqNullSafe(F.col("old.scan_run_id"))
            & F.col("new.last_seen_timestamp").eqNullSafe(F.col("old.last_seen_timestamp"))
        )
        same = new.join(old, key).filter((F.col("new.print") == F.col("old.print")) & F.coalesce(kept, F.lit(False)))
        return self.upsert(table.join(same.select(key), key, "left_anti"), max_layers, seen=(scan_run_id, now))

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the ``keep`` latest versions and the folders that only those used.

        Folders of a version that is still being written are left alone.
        """
        versions = sorted(self.versions())
        kept = versions[-keep:]
        used: dict[str, set[str]] = {}
        for version in kept:
            for bucket, folders in self._manifest(version)[1]["folders"].items():
                for folder in folders:
                    used.setdefault(folder, set()).add(f"{_BUCKET}={bucket}")
        for version in versions[:-keep]:
            self._files.remove(f"versions/{version:010d}.json")
        for folder in self._files.names("data"):
            if int(folder.split("-")[0]) > kept[-1]:
                continue
            if folder not in used:
                self._files.remove(f"data/{folder}")
                continue
            for part in self._files.names(f"data/{folder}"):
                if part.startswith(_BUCKET) and part not in used[folder]:
                    self._files.remove(f"data/{folder}/{part}")


def _bucket(manifest: dict) -> Column:
    return F.pmod(F.xxhash64(manifest["key"]), F.lit(manifest["buckets"])).cast("int").alias(_BUCKET)
