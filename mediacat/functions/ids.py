"""Deterministic identifiers: name-based UUIDs built from SHA-1 in SQL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediacat import fixed


def uuid5(name: Column) -> Column:
    """Version-5 UUID of a text in the DNS namespace."""
    digest = F.sha1(
        F.concat(F.unhex(F.lit(fixed.UUID_DNS_NAMESPACE)), F.encode(name, "UTF-8"))
    )
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def album_id(folder_name: Column) -> Column:
    """Album identity: the folder name alone."""
    return uuid5(folder_name)


def media_id(path: Column, taken: Column, size: Column, creation: Column) -> Column:
    """Media identity: path, taken time, size and creation time; missing times are empty."""
    return uuid5(
        F.concat_ws(
            "|",
            path,
            F.coalesce(taken, F.lit("")),
            size.cast("string"),
            F.coalesce(creation, F.lit("")),
        )
    )


def pair_id(image_path: Column, video_path: Column) -> Column:
    return uuid5(F.concat_ws("|", image_path, video_path))


def person_id(name: Column) -> Column:
    return uuid5(F.concat(F.lit("person|"), name))
