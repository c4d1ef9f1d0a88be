"""Linking media files to their JSON sidecars by name, as joins.

Phases 1 to 3 look up an exact key, so a media file carries up to three probes and
one join answers all of them; the lowest phase that hits wins. Phase 4 compares
prefixes among what is left and hands out each sidecar once, in path order
(``contention``). Nothing runs before the result is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mediacat import fixed
from mediacat.functions import names
from mediacat.operators import contention

_KEY = ["album", "key", "number"]


def _text(column: Column) -> Column:
    """The same text, marked as never NULL.

    A join on a nullable key makes Spark repeat the key's whole expression in a filter
    below the join; a key that cannot be NULL is computed once.
    """
    return F.coalesce(column, F.lit(""))


# --- exact phases ------------------------------------------------------------------

def _with_probes(
    media: DataFrame, phases: tuple[int, ...], edit_marks: list[str] | None
) -> DataFrame:
    """(path, album, name, phase, key, number): what each media file looks up per phase.

    Phase 1 is the name itself with its suffix in lower case and no number. Phase 2 is
    the name without its number, looked up with that number. Phase 3 is the name without
    its edit mark and then without its number.
    """
    marks = edit_marks or [fixed.EDITED_MARK]
    name, stem, low, plain = F.col("name"), F.col("stem"), F.col("low"), F.col("plain")
    real, number = F.col("real"), F.col("number")
    dot = F.lit(".")

    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(F.lower(stem), F.lit(mark))
    feats = (
        media.select("path", "album", "name", names.lower_suffix(name).alias("low"))
        .withColumn("real", names.has_real_ext(low))
        .withColumn("stem", names.stem(name))
        .withColumn("number", names.numeric_suffix(name))
        .withColumn(
            "plain", F.when(marked, names.strip_edited(F.when(real, stem).otherwise(name), marks))
        )
    )
    keys = {
        1: (F.when(real, F.concat(stem, low)).otherwise(F.concat(name, dot)), F.lit("")),
        2: (F.when(number.isNotNull(), F.concat(names.drop_numeric(name), dot)), number),
        3: (
            F.concat(names.drop_numeric(plain), F.when(real, low).otherwise(dot)),
            F.coalesce(names.numeric_suffix(plain), F.lit("")),
        ),
    }
    probes = F.array(
        *[
            F.struct(F.lit(p).alias("phase"), keys[p][0].alias("key"), keys[p][1].alias("number"))
            for p in phases
        ]
    )
    return feats.select("path", "album", "name", F.inline(probes)).filter(F.col("key").isNotNull())


def sidecar_index(sidecars: DataFrame) -> DataFrame:
    """One row per (album, key, number) that exactly one sidecar has."""
    keyed = sidecars.select(
        "album",
        _text(names.sidecar_key(F.col("filename"), F.col("extension"))).alias("key"),
        _text(F.col("numeric_suffix")).alias("number"),
        "path",
    )
    return (
        keyed.groupBy(*_KEY)
        .agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("sidecar_path"))
        .filter(F.col("n") == 1)
        .drop("n")
    )


def match_exact(
    media: DataFrame, sidecars: DataFrame, edit_marks: list[str] | None = None
) -> DataFrame:
    """Every media file (path, album, name) with the sidecar of the first phase that hits.

    sidecar_path and phase are NULL where phases 1 to 3 find nothing. ``edit_marks``
    replaces the edit marks of phase 3.
    """
    hit = F.when(F.col("sidecar_path").isNotNull(), F.struct("phase", "sidecar_path"))
    return (
        _with_probes(media, (1, 2, 3), edit_marks)
        .join(sidecar_index(sidecars), _KEY, "left")
        .groupBy("path", "album", "name")
        .agg(F.min(hit).alias("best"))
        .select(
            "path", "album", "name", F.col("best.sidecar_path"), F.col("best.phase").alias("phase")
        )
    )


def _match_one(
    media: DataFrame, sidecars: DataFrame, phase: int, edit_marks: list[str] | None = None
) -> DataFrame:
    """(path, sidecar_path, phase) of one exact phase alone."""
    probes = _with_probes(media, (phase,), edit_marks)
    return probes.join(sidecar_index(sidecars), _KEY).select("path", "sidecar_path", "phase")


def match_phase1(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    return _match_one(media, sidecars, 1)


def match_phase2(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    return _match_one(media, sidecars, 2)


def match_phase3(
    media: DataFrame, sidecars: DataFrame, edit_marks: list[str] | None = None
) -> DataFrame:
    return _match_one(media, sidecars, 3, edit_marks)


# --- prefix phase -----------------------------------------------------------------------

def _prefix_media(media: DataFrame) -> DataFrame:
    name, plain = F.col("name"), F.col("plain")
    return media.select(
        "path",
        "album",
        names.lower_suffix(name).alias("low"),
        F.coalesce(names.strip_edited(name), name).alias("plain"),
    ).select(
        "path",
        "album",
        _text(names.numeric_suffix(plain)).alias("number"),
        _text(names.ext_key(F.col("low"))).alias("ext"),
        _text(names.drop_numeric(plain)).alias("base"),
    )


def _prefix_sidecars(sidecars: DataFrame) -> DataFrame:
    return sidecars.select(
        "path",
        "album",
        _text(F.col("numeric_suffix")).alias("number"),
        _text(names.ext_key(F.col("extension"))).alias("ext"),
        _text(F.col("filename")).alias("base"),
    )


def _by_prefix(media: DataFrame, sidecars: DataFrame, *every: DataFrame) -> DataFrame:
    """(path, album, sidecar_path) of all ``media``, as phase 4 decides.

    ``every`` holds all media and sidecars of the catalog, of which these are left.
    """
    names = _prefix_media(every[0]).unionByName(_prefix_sidecars(every[1])) if every else None
    return contention.assign_in_order(_prefix_media(media), _prefix_sidecars(sidecars), names)


def match_phase4(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(path, sidecar_path, phase) among media and sidecars that no exact phase linked.

    The sidecar's name begins the media name or equals it, or else the media name begins a
    longer sidecar name. Number and extension must agree.
    """
    return _by_prefix(media, sidecars).filter("sidecar_path IS NOT NULL").select(
        "path", "sidecar_path", F.lit(4).alias("phase")
    )


# --- the whole link ------------------------------------------------------------------------

def link_sidecars(
    media: DataFrame, sidecars: DataFrame, edit_marks: list[str] | None = None
) -> DataFrame:
    """Every media file with its sidecar and phase, both NULL when nothing fits.

    ``media`` has path, album and name; ``sidecars`` is the output of
    ``parse_sidecar_names``.
    """
    exact = match_exact(media, sidecars, edit_marks)
    matched, rest = exact.filter("phase IS NOT NULL"), exact.filter("phase IS NULL")
    free = sidecars.join(
        matched.select(F.col("sidecar_path").alias("path")), "path", "left_anti"
    )
    phase = F.when(F.col("sidecar_path").isNotNull(), 4).alias("phase")
    columns = ["path", "album", "sidecar_path"]
    return matched.select(*columns, "phase").unionByName(_by_prefix(rest, free, media, sidecars).select(*columns, phase))


def orphan_media(links: DataFrame) -> DataFrame:
    """Media that no phase linked."""
    return links.filter(F.col("sidecar_path").isNull()).select("path", "album")


def orphan_sidecars(sidecars: DataFrame, links: DataFrame) -> DataFrame:
    """Sidecars that no media uses, in every album."""
    used = links.select(F.col("sidecar_path").alias("path")).filter(F.col("path").isNotNull())
    return sidecars.join(used, "path", "left_anti").select("path", "album")


def unprocessed(files: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, path) of discovered files that linking did not use.

    Media are always used; sidecars are when linked; album metadata always; other never.
    """
    used = (
        links.select(F.explode(F.array("path", "sidecar_path")).alias("path"))
        .filter(F.col("path").isNotNull())
    )
    kind = names.kind(F.col("album"), F.col("name"))
    return (
        files.select("path", kind.alias("kind"))
        .filter(F.col("kind") != "album_metadata")
        .join(used, "path", "left_anti")
        .select("kind", "path")
    )


# --- the earlier matcher, kept as an option ---------------------------------------------------

def match_alternative(
    media: DataFrame, sidecars: DataFrame, marks: list[str] | None = None
) -> DataFrame:
    """(path, sidecar_path) by localized edit marks, then by equal number alone.

    A media whose stem ends in an edit mark is looked up without it (and without its
    first number). A key that exists settles the media: a single sidecar must have no
    number or one found in the media stem, several need exactly one without number.
    Media without such a key take the first sidecar in path order with their number.
    """
    marks = marks or fixed.EDITED_MARKS_LOCALIZED
    name, stem, plain = F.col("name"), F.col("stem"), F.col("plain")
    ending = rf"(?isu)^(.*)(?:{'|'.join(marks)})\z"

    def first_number(text: Column) -> Column:
        return F.regexp_extract(text, r"\(\p{Nd}+\)", 0)

    base = F.when(first_number(plain) == "", plain).otherwise(
        F.replace(plain, first_number(plain), F.lit(""))
    )
    wanted = (
        media.select("path", "album", "name", names.stem(name).alias("stem"))
        .withColumn("plain", F.regexp_extract(stem, ending, 1))
        .withColumn("base", base)
        .select(
            "path",
            "album",
            "stem",
            _text(first_number(stem)).alias("number"),
            # No file name has a slash, so a name that is nothing but a mark finds no key.
            _text(
                F.when(F.col("base") == "", "/").otherwise(F.concat("base", names.lower_suffix(name)))
            ).alias("key"),
        )
    )
    marked = F.regexp_like(stem, F.lit(ending))

    # The key of this matcher has no trailing dot when there is no extension.
    key = F.when(F.col("extension") == "", F.col("filename")).otherwise(
        names.sidecar_key(F.col("filename"), F.col("extension"))
    )
    bare = F.col("numeric_suffix") == ""
    by_key = sidecars.groupBy("album", key.alias("key")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(bare).alias("n_bare"),
        F.min(F.when(bare, F.col("path"))).alias("bare_path"),
        F.min("path").alias("any_path"),
        F.min("numeric_suffix").alias("any_number"),
    )
    single = F.when(
        names.suffix_in_name(F.col("stem"), F.col("any_number")), F.col("any_path")
    )
    several = F.when(F.col("n_bare") == 1, F.col("bare_path"))
    # Rows without a mark or a number take no part in the join on it: they would all go to
    # one task.
    keyed = wanted.filter(marked).join(by_key, ["album", "key"], "left")
    settled = keyed.filter(F.col("n").isNotNull()).select(
        "path", F.when(F.col("n") == 1, single).otherwise(several).alias("sidecar_path")
    )
    columns = ["path", "album", "number"]
    open_media = (
        keyed.filter(F.col("n").isNull())
        .select(*columns)
        .unionByName(wanted.filter(~marked).select(*columns))
        .filter(F.col("number") != "")
    )
    by_number = (
        sidecars.filter(~bare)
        .groupBy("album", F.col("numeric_suffix").alias("number"))
        .agg(F.min("path").alias("sidecar_path"))
    )
    numbered = open_media.join(by_number, ["album", "number"]).select("path", "sidecar_path")
    return settled.filter(F.col("sidecar_path").isNotNull()).unionByName(numbered)
