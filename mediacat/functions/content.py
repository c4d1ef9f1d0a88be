"""Checksums, fingerprints and type detection of content held in a binary column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediacat import fixed


def crc32_hex(content: Column) -> Column:
    """CRC-32 as eight lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")


def fingerprint(content: Column) -> Column:
    """SHA-256 of the content, or of its first and last 64 KiB when it is longer than both."""
    head, tail = fixed.FINGERPRINT_HEAD_BYTES, fixed.FINGERPRINT_TAIL_BYTES
    ends = F.concat(F.substring(content, 1, head), F.substring(content, -tail, tail))
    return F.sha2(F.when(F.octet_length(content) <= head + tail, content).otherwise(ends), 256)


def sidecar_fingerprint(content: Column) -> Column:
    """SHA-256 of the whole sidecar."""
    return F.sha2(content, 256)


def strict_text(content: Column) -> Column:
    """Bytes as UTF-8 text without a byte order mark; NULL where they are not UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^\ufeff", "")


def sniff_mime(content: Column) -> Column:
    """MIME type told from the first bytes; the document type of a container may stand
    anywhere in its header."""
    head = F.hex(F.substring(content, 1, fixed.MAGIC_HEAD_BYTES))
    found = None
    for mime, offset, magic in fixed.MAGIC_BYTES:
        if offset == fixed.ANYWHERE:
            hit = F.rlike(head, F.lit(f"^(?:[0-9A-F]{{2}})*?{magic}"))
        else:
            hit = F.substring(head, 2 * offset + 1, len(magic)) == magic
        if mime in fixed.MAGIC_CONTAINERS:
            hit = F.startswith(head, F.lit(fixed.MAGIC_CONTAINERS[mime])) & hit
        found = F.when(hit, mime) if found is None else found.when(hit, mime)
    return found.otherwise(fixed.UNKNOWN_MIME)


def is_image(mime: Column) -> Column:
    return F.startswith(mime, F.lit("image/"))


def is_video(mime: Column) -> Column:
    return F.startswith(mime, F.lit("video/"))


def is_unknown_mime(mime: Column) -> Column:
    return mime == fixed.UNKNOWN_MIME
