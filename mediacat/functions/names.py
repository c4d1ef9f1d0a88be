"""File-name expressions: suffixes, numbers, edit marks, sidecar names, archive members.

Nearly everything is plain string and regex functions, which keeps these columns
inside whole-stage code generation.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from mediacat import fixed

_NUMBER = r"\(\p{Nd}+\)"


def _prefixes(words: list[str], shortest: int = 1) -> list[str]:
    return sorted({w[:n] for w in words for n in range(shortest, len(w) + 1)})


_MEDIA_SUFFIX_PREFIXES = _prefixes(fixed.MEDIA_EXTENSIONS, 2)
_SIDECAR_EXT_PREFIXES = _prefixes(fixed.SIDECAR_EXTENSIONS, 2)


# --- splitting -------------------------------------------------------------------

def suffix(name: Column) -> Column:
    """``.ext`` of a file name: the part from its last dot, unless that dot is first or last."""
    last = F.substring_index(name, ".", -1)
    has_suffix = (F.length(name) - F.length(last) > 1) & (last != "")
    return F.when(has_suffix, F.concat(F.lit("."), last)).otherwise(F.lit(""))


def stem(name: Column) -> Column:
    """File name without its suffix."""
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def lower_suffix(name: Column) -> Column:
    return F.lower(suffix(name))


def parent(path: Column) -> Column:
    """Folder part of a relative path, empty at the top level."""
    base = F.substring_index(path, "/", -1)
    return F.substring(path, F.lit(1), F.greatest(F.length(path) - F.length(base) - 1, F.lit(0)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


# --- classification ----------------------------------------------------------------

def should_scan(name: Column) -> Column:
    """False for system files, the export's own pages and temporary files."""
    return ~(
        F.lower(name).isin(fixed.SYSTEM_FILES + fixed.EXPORT_FILES)
        | lower_suffix(name).isin(fixed.TEMPORARY_SUFFIXES)
    )


def is_hidden(name: Column) -> Column:
    return F.startswith(name, F.lit("."))


def kind(album: Column, name: Column) -> Column:
    """media, sidecar, album_metadata or other; files outside any album are other."""
    return (
        F.when(album == "", "other")
        .when(
            lower_suffix(name) == ".json",
            F.when(name == fixed.ALBUM_METADATA_NAME, "album_metadata").otherwise("sidecar"),
        )
        .when(should_scan(name), "media")
        .otherwise("other")
    )


# --- path normal form ---------------------------------------------------------------

def _nfc(path: Column) -> Column:
    # Defined here so that it travels to the executors by value.
    def compose(text: pd.Series) -> pd.Series:
        return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")

    return F.pandas_udf(compose, StringType())(path)


def normalize_path(path: Column) -> Column:
    """Composed Unicode with forward slashes.

    Spark has no function for composition, so a vectorised helper does it; only names
    outside ASCII are sent to it.
    """
    other = F.when(F.regexp_like(path, F.lit(r"[^\x00-\x7F]")), path)
    return F.translate(F.coalesce(_nfc(other), path), "\\", "/")


# --- extensions ---------------------------------------------------------------------

def has_real_ext(low_suffix: Column) -> Column:
    """Lower-cased suffix is a known media extension or the beginning of one."""
    return low_suffix.isin(_MEDIA_SUFFIX_PREFIXES)


def _spelled(ext: Column, special: dict[str, str]) -> Column:
    bare = F.regexp_replace(ext, r"^\.+", "")
    pairs = [F.lit(text) for pair in special.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), bare), F.concat(F.lit("."), bare))


def full_ext(ext: Column) -> Column:
    """Extension with leading dot; the one-character forms are spelled out."""
    special = {short: f".{long}" for short, long in fixed.ONE_CHAR_EXTENSIONS.items()}
    return _spelled(ext, special | {"": ""})


def ext_key(ext: Column) -> Column:
    """Join key under which two extensions match: spelled out, ``.jpeg`` as ``.jpg``."""
    special = {short: f".{long}" for short, long in fixed.ONE_CHAR_EXTENSIONS.items()}
    return _spelled(ext, special | {"": "", "jpeg": ".jpg"})


# --- numbers and edit marks -----------------------------------------------------------

def numeric_suffix(name: Column) -> Column:
    """Rightmost ``(digits)`` of a name, else NULL."""
    return F.nullif(F.regexp_extract(name, rf"(?s)^.*({_NUMBER})", 1), F.lit(""))


def drop_numeric(name: Column) -> Column:
    """Name without its first ``(digits)``."""
    return F.regexp_replace(name, rf"(?s)^(.*?){_NUMBER}", "$1")


def strip_edited(name: Column, marks: list[str] | None = None) -> Column:
    """Name without its last edit mark, NULL when it has none or nothing is left."""
    mark = "|".join(marks or [fixed.EDITED_MARK])
    pattern = rf"(?isu)^(.*)(?:{mark})"
    return F.when(
        F.regexp_like(name, F.lit(pattern)), F.nullif(F.regexp_replace(name, pattern, "$1"), F.lit(""))
    )


def suffix_in_name(name: Column, number: Column) -> Column:
    """``(n)`` ends the name or stands before a dot; no number always fits."""
    return (
        number.isNull()
        | (number == "")
        | F.endswith(name, number)
        | F.contains(name, F.concat(number, F.lit(".")))
    )


# --- sidecar names --------------------------------------------------------------------

def sidecar_number(name: Column) -> Column:
    """``(n)`` just before ``.json``, else empty."""
    digits = F.regexp_extract(
        F.regexp_replace(name, fixed.SIDECAR_JSON_TAIL, ""), fixed.SIDECAR_NUMBER_TAIL, 1
    )
    is_json = F.regexp_like(name, F.lit(fixed.SIDECAR_JSON_TAIL))
    return F.when(is_json & (digits != ""), F.concat(F.lit("("), digits, F.lit(")"))).otherwise("")


def sidecar_core(name: Column) -> Column:
    """Sidecar name without ``.json``, number and supplement tail."""
    bare = F.when(
        F.regexp_like(name, F.lit(fixed.SIDECAR_JSON_TAIL)),
        F.regexp_replace(
            F.regexp_replace(name, fixed.SIDECAR_JSON_TAIL, ""), fixed.SIDECAR_NUMBER_TAIL, ""
        ),
    ).otherwise(name)
    return F.regexp_replace(bare, fixed.SIDECAR_SUPPLEMENT_TAIL, "")


def _known_part(extra_exts: list[str] | None) -> str:
    known = _prefixes(fixed.SIDECAR_EXTENSIONS + list(extra_exts or []), 2)
    return "(?:" + "|".join(sorted(known, key=len, reverse=True)) + ")"


def sidecar_reach(core: Column, extra_exts: list[str] | None = None) -> Column:
    """``core`` up to its rightmost part that begins a known extension; empty when none."""
    part = _known_part(extra_exts)
    return F.when(
        F.contains(core, F.lit(".")),
        F.regexp_extract(core, rf"(?is)^((?:.*\.)?{part})(?:\..*)?\z", 1),
    ).otherwise("")


def extension_run(reach: Column, extra_exts: list[str] | None = None) -> Column:
    """The run of such parts that ends ``reach``, with the dot before it."""
    part = _known_part(extra_exts)
    return F.regexp_extract(reach, rf"(?is)^.*?((?:(?:^|\.){part})+)\z", 1)


def sidecar_key(filename: Column, extension: Column) -> Column:
    """``filename.extension``; the dot stays when there is no extension."""
    return F.concat(filename, F.lit("."), extension)


# --- albums and archives -----------------------------------------------------------------

def album_year(folder: Column) -> Column:
    """Year of a folder named like ``Photos from 2019``, else NULL."""
    digits = F.nullif(F.regexp_extract(folder, fixed.YEAR_ALBUM_PATTERN, 1), F.lit(""))
    year = digits.cast("int")
    return F.when(year.between(fixed.YEAR_MIN, fixed.YEAR_MAX), year)


def sanitize_member(member: Column) -> Column:
    """Archive member name made safe for every file system."""
    replaced = F.regexp_replace(member, fixed.INVALID_MEMBER_CHARS, "_")
    trimmed = F.regexp_replace(replaced, r"[. ]+(?=/|\z)", "")
    reserved = "|".join(fixed.RESERVED_DEVICE_NAMES)
    return F.regexp_replace(trimmed, rf"(?i)(^|/)({reserved})(?=[./]|\z)", "$1_$2")


def is_safe_member(member: Column) -> Column:
    """True when no step of the path leaves the target folder."""
    walk = F.aggregate(
        F.split(member, "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(True).alias("inside")),
        lambda at, step: F.struct(
            (
                at["depth"]
                + F.when(step == "..", -1).when((step == "") | (step == "."), 0).otherwise(1)
            ).alias("depth"),
            (at["inside"] & ((step != "..") | (at["depth"] > 0))).alias("inside"),
        ),
    )
    return ~F.startswith(member, F.lit("/")) & walk["inside"]


def archive_format(name: Column) -> Column:
    """Archive kind by name ending, NULL for other files."""
    low = F.lower(name)
    known = None
    for ending, label in fixed.ARCHIVE_FORMATS.items():
        hit = F.endswith(low, F.lit(ending))
        known = F.when(hit, label) if known is None else known.when(hit, label)
    return known
