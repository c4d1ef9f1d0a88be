"""Reading file content and the text files of an export."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mediacat import fixed
from mediacat.functions import content
from mediacat.sources.json_records import json_records
from mediacat.sources.mounts import Mount

_CHUNK = 1 << 20


def file_content(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content) of regular files through Spark's binary reader.

    It leaves out hidden and empty files and cannot hold a file over 2 GB in one cell;
    ``file_digests`` has neither limit.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return files.select(_relative(F.col("path"), root).alias("path"), "content")


def spread_tasks(df: DataFrame, tasks: int | None) -> int:
    """Number of tasks for work whose rows are small and whose files are not."""
    return tasks or 8 * df.sparkSession.sparkContext.defaultParallelism


def _relative(path: Column, root: str) -> Column:
    """Path below ``root`` of the path a Spark reader reports."""
    return _below(F.regexp_replace(path, r"^file:/*", "/"), root)


def _below(path: Column, root: str) -> Column:
    """A path without ``root``; one that lies elsewhere stays as it is."""
    base = root if "://" in root else "/" + root.removeprefix("file:").strip("/") if root.startswith(("/", "file:")) else root
    base = base.rstrip("/") + "/"
    inside = F.substring(path, F.lit(len(base) + 1), F.length(path))
    return F.when(F.startswith(path, F.lit(base)), inside).otherwise(F.regexp_replace(path, r"^(?:\./+)+", ""))


def file_digests(
    files: DataFrame, root: str, checksum: bool = True, tasks: int | None = None
) -> DataFrame:
    """(path, size, crc32, content_fingerprint, mime_type) of listed files of any size.

    Each task reads its files in pieces: all bytes for the checksum, the first and last
    64 KiB for the fingerprint, the first few for the type. Without ``checksum`` only
    those ends are read and crc32 is NULL. A file that cannot be read gives NULLs.

    The paths are spread over ``tasks`` tasks first (eight per core unless given), since
    a listing has one partition per album and one album may hold most of the files.
    ``root`` is a folder all executors mount or a URI that ``mounts`` can open.
    """
    mount = Mount(root).checked()
    head, tail = fixed.FINGERPRINT_HEAD_BYTES, fixed.FINGERPRINT_TAIL_BYTES
    magic, chunk = fixed.MAGIC_HEAD_BYTES, _CHUNK

    def digest(path: str) -> tuple:
        try:
            with mount.open(path) as handle:
                size = handle.size()
                start = handle.read(head + tail)
                crc = zlib.crc32(start)
                while checksum and (piece := handle.read(chunk)):
                    crc = zlib.crc32(piece, crc)
                hashed = hashlib.sha256(start if size <= head + tail else start[:head])
                if size > head + tail:
                    handle.seek(size - tail)
                    hashed.update(handle.read(tail))
            crc_text = f"{crc:08x}" if checksum else None
            return size, crc_text, hashed.hexdigest(), start[:magic]
        except OSError:
            return None, None, None, None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *digest(path)) for path in batch["path"]]
            yield pd.DataFrame(
                rows, columns=["path", "size", "crc32", "content_fingerprint", "head"]
            )

    spread = files.select("path").repartition(spread_tasks(files, tasks), "path")
    raw = spread.mapInPandas(
        read, "path string, size bigint, crc32 string, content_fingerprint string, head binary"
    )
    return raw.select(
        "path", "size", "crc32", "content_fingerprint",
        F.when(F.col("head").isNotNull(), content.sniff_mime(F.col("head"))).alias("mime_type"),
    )


def json_files(files: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """(path, raw) of the listed JSON files: all bytes of each, NULL where that fails.

    ``files`` is the inventory of ``root``. Spark's readers would leave out names and
    folders that begin with an underscore or a dot, and empty files.
    """
    mount = Mount(root).checked()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    with mount.open(path) as handle:
                        raw = handle.read()
                except OSError:
                    raw = None
                yield pd.DataFrame({"path": [path], "raw": pd.Series([raw], dtype="object")})

    listed = files.filter(F.rlike("path", F.lit(r"(?i)\.json$"))).select("path")
    return listed.repartition(spread_tasks(files, tasks), "path").mapInPandas(read, "path string, raw binary")


def sidecar_json(files: DataFrame, root: str) -> DataFrame:
    """Bytes of the sidecars of an inventory."""
    name = F.substring_index("path", "/", -1)
    wanted = F.contains("path", F.lit("/")) & (name != fixed.ALBUM_METADATA_NAME)
    return json_files(files.filter(wanted), root)


def album_json(files: DataFrame, root: str) -> DataFrame:
    """Bytes of the album metadata files of an inventory."""
    name = F.substring_index("path", "/", -1)
    wanted = F.contains("path", F.lit("/")) & (name == fixed.ALBUM_METADATA_NAME)
    return json_files(files.filter(wanted), root)


def _dump(spark: SparkSession, location: str, fields: str) -> DataFrame:
    """The objects of dumps as columns; what is no JSON is left out."""
    found = json_records(spark, location).select(F.from_json("record", fields).alias("r"))
    return found.select("r.*")


def exif_dump(spark: SparkSession, location: str, root: str = "") -> DataFrame:
    """(path, tags) from the JSON lists a tag reader prints, one object per file.

    A list of any size is read by many tasks. Paths below ``root`` (``inventory.scan_root``
    of the export) become relative to it, as the inventory has them.
    """
    fields = ", ".join(f"{name} string" for name in ["SourceFile", *fixed.TAG_NAMES])
    rows = _dump(spark, location, fields)
    entries = F.array(*[F.struct(F.lit(t).alias("key"), F.col(t).alias("value")) for t in fixed.TAG_NAMES])
    return rows.filter("SourceFile IS NOT NULL").select(
        _below(F.col("SourceFile"), root).alias("path"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("tags"),
    )


def probe_dump(spark: SparkSession, location: str, root: str = "") -> DataFrame:
    """(path, format, streams) from the JSON a media prober prints, alone or in a list.

    Paths become relative as in ``exif_dump``.
    """
    rows = _dump(
        spark, location,
        "format struct<filename:string,duration:string>, "
        "streams array<struct<codec_type:string,width:int,height:int,"
        "r_frame_rate:string,avg_frame_rate:string>>",
    )
    return rows.filter("format.filename IS NOT NULL").select(
        _below(F.col("format.filename"), root).alias("path"),
        F.struct(F.col("format.duration").alias("duration")).alias("format"),
        "streams",
    )


def scan_log(spark: SparkSession, location: str) -> DataFrame:
    """(value, line_no) of log lines; line_no sorts by file name and by place in the file.

    Files are read in blocks: the block's start orders the blocks of a file, and within a
    block lines come one after the other.
    """
    return spark.read.text(location).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("line_no"),
    )
