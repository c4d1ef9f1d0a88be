import hashlib
import uuid
import zlib

from pyspark.sql import functions as F

from mediacat.functions import content, ids
from mediacat.operators import media


def test_digests(spark):
    blobs = [b"", b"abc", bytes(range(256)) * 512, bytes(range(256)) * 512 + b"x", b"\0" * 200_000]
    df = spark.createDataFrame([(str(i), bytearray(b)) for i, b in enumerate(blobs)], "path string, content binary")
    rows = {r.path: r for r in media.hash_content(df).collect()}
    for i, blob in enumerate(blobs):
        part = blob if len(blob) <= 131072 else blob[:65536] + blob[-65536:]
        row = rows[str(i)]
        assert row.size == len(blob)
        assert row.crc32 == f"{zlib.crc32(blob):08x}"
        assert row.content_fingerprint == hashlib.sha256(part).hexdigest()


def test_mime(spark):
    cases = [
        (bytes.fromhex("FFD8FFE000104A464946"), "image/jpeg"),
        (bytes.fromhex("89504E470D0A1A0A"), "image/png"),
        (b"\0\0\0\x18ftypmp41\0\0\0\0mp41isom", "video/mp4"),
        (b"\x1a\x45\xdf\xa3", "application/octet-stream"),
        (b"GIF87a", "image/gif"),
        (b"RIFF\0\0\0\0WEBPVP8 ", "image/webp"),
        (b"\0\0\0\x18ftypheic", "image/heic"),
        (b"\0\0\0\x14ftypqt  ", "video/quicktime"),
        (b"RIFF\0\0\0\0AVI LIST", "video/x-msvideo"),
        (b"WAVE\0\0\0\0AVI LIST", "application/octet-stream"),
        (b"\x1aE\xdf\xa3" + b"\0" * 700 + b"webm", "video/webm"),
        (b"\x1aE\xdf\xa3\x01" + b"B\x82\x88matroska", "video/x-matroska"),
        (b"text about webm and matroska" + b" " * 20, "application/octet-stream"),
        (b"This is not a recognized file type", "application/octet-stream"),
        (b"", "application/octet-stream"),
    ]
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, c binary")
    rows = df.select("i", content.sniff_mime(F.col("c")).alias("m")).orderBy("i").collect()
    assert [r.m for r in rows] == [m for _, m in cases]


def test_uuid5(column_of):
    texts = ["Photos from 2023", "", "ü|1|2", "x" * 500]
    assert column_of(texts, ids.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, t)) for t in texts]


def test_media_id(spark):
    df = spark.createDataFrame([("a/b.jpg", None, 5, "2020-01-01T00:00:00+00:00")],
                               "p string, t string, s bigint, c string")
    got = df.select(ids.media_id(F.col("p"), F.col("t"), F.col("s"), F.col("c"))).first()[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_DNS, "a/b.jpg||5|2020-01-01T00:00:00+00:00"))
