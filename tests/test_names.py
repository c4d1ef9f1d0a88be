import random
import unicodedata
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from mediacat.functions import names
from mediacat.operators import files as file_ops

NAMES = [
    "photo.jpg", "..json", "a.", ".hidden", "21.12.11 - 1", "a.b.c", "noext", ".", "..", "a..", "x.JPG",
    "IMG(1).jpg", "(3)(4).png", "a\nb.c", "ü.é", "photo-edited(2).jpg",
]


def test_split_follows_pathlib(column_of):
    usable = [n for n in NAMES if n not in (".", "..")]
    assert column_of(usable, names.suffix) == [PurePosixPath(n).suffix for n in usable]
    assert column_of(usable, names.stem) == [PurePosixPath(n).stem for n in usable]


def test_parent_and_base(column_of):
    paths = ["a/b/c.jpg", "c.jpg", "a/c"]
    assert column_of(paths, names.parent) == ["a/b", "", "a"]
    assert column_of(paths, names.base_name) == ["c.jpg", "c.jpg", "c"]


@pytest.mark.parametrize(
    "album, name, expected",
    [
        ("", "photo.jpg", "other"),
        ("A", "photo.jpg", "media"),
        ("A", "metadata.json", "album_metadata"),
        ("A", "Metadata.json", "sidecar"),
        ("A", "print-subscriptions.json", "sidecar"),
        ("A", "Thumbs.DB", "other"),
        ("A", "x.TMP", "other"),
        ("A", "icon\r", "other"),
        ("A", ".facebook_1.jpg", "media"),
        ("A", "archive_browser.html", "other"),
    ],
)
def test_kind(spark, album, name, expected):
    df = spark.createDataFrame([(album, name)], "album string, name string")
    assert df.select(names.kind(F.col("album"), F.col("name"))).first()[0] == expected


def test_hidden(column_of):
    assert column_of([".a", "a."], names.is_hidden) == [True, False]


def test_normalize_path(column_of):
    paths = ["Caf" + unicodedata.normalize("NFD", "é") + "\\a.jpg", "plain\\b", None]
    assert column_of(paths, names.normalize_path) == ["Café/a.jpg", "plain/b", None]


def test_extensions(column_of):
    exts = [".j", ".jp", ".jpg", ".nef", ".tif", "", ".p", ".mkv", ".heif"]
    assert column_of(exts, names.has_real_ext) == [True, True, True, False, False, False, True, True, False]
    assert column_of([".j", "p", "jpeg", "", "..x", "svg.png"], names.full_ext) == [
        ".jpg", ".png", ".jpeg", "", ".x", ".svg.png"]
    assert column_of([".j", "jpeg", ".jpg", ""], names.ext_key) == [".jpg", ".jpg", ".jpg", ""]


def test_numbers_and_edit_marks(column_of):
    assert column_of(["a(1)b(22).jpg", "a", "()", "x(3"], names.numeric_suffix) == ["(22)", None, None, None]
    assert column_of(["a(1)b(22).jpg", "a"], names.drop_numeric) == ["ab(22).jpg", "a"]
    assert column_of(["a-Edited-EDITED.jpg", "a.jpg", "-edited"], names.strip_edited) == [
        "a-Edited.jpg", None, None]
    fits = lambda n: names.suffix_in_name(n, F.lit("(2)"))
    assert column_of(["a(2)", "a(2).b", "a(2)b", "a(22)"], fits) == [True, True, False, False]


SIDECARS = [
    ("photo.jpg.supplemental-metadata.json", "photo", "jpg", ""),
    ("photo.jpg.supplemental-metadata(2).json", "photo", "jpg", "(2)"),
    ("photo.jp.supplemental-metadata.json", "photo", "jp", ""),
    ("IMG.JPG.suppl.json", "IMG", "jpg", ""),
    ("01.02.12 - 2.supplemental-metadata.json", "01.02.12 - 2", "", ""),
    ("a.svg.png.json", "a", "svg.png", ""),
    ("j.j.json", "j", "j", ""),
    ("clip.mkv.supplemental-metadata.json", "clip.mkv", "", ""),
    ("photo.json", "photo", "", ""),
    ("photo(1).json", "photo", "", "(1)"),
    ("jpg.json", "jpg", "", ""),
    (".jpg.json", "", "jpg", ""),
    ("x.jpg.tail.json", "x", "jpg", ""),
    ("not-json.jpg", "not-json", "jpg", ""),
    ("a.SUPP-meta.JSON ", "a", "", ""),
]


def test_sidecar_names(spark):
    df = spark.createDataFrame([("p/" + n, "p", n) for n, *_ in SIDECARS], "path string, album string, name string")
    got = {r.path[2:]: (r.filename, r.extension, r.numeric_suffix) for r in file_ops.parse_sidecar_names(df).collect()}
    assert got == {n: tuple(rest) for n, *rest in SIDECARS}


def _parts_by_loop(core, known):
    """Plain reading of the rule: walk left from the last part that begins an extension."""
    def begins(part):
        return len(part) > 1 and any(k.startswith(part.lower()) for k in known)

    parts = core.split(".")
    hits = [i for i, p in enumerate(parts) if begins(p)]
    if "." not in core:
        return core, ""
    if not hits:
        if all(len(p) == 1 for p in parts):
            return ".".join(parts[:-1]), parts[-1].lower()
        return core, ""
    last = first = hits[-1]
    while first > 0 and begins(parts[first - 1]):
        first -= 1
    return ".".join(parts[:first]), ".".join(parts[first:last + 1]).lower()


def test_sidecar_names_at_random(spark):
    from mediacat import fixed

    rng = random.Random(7)
    pieces = ["jpg", "JP", "a", "b", "", "svg", "png", "tail", "x1", "m4", "photo", "nef", "3g", "mk"]
    cores = {".".join(rng.choices(pieces, k=rng.randint(1, 5))) for _ in range(400)}
    cores = sorted(c for c in cores if not c.endswith((".s", ".supp")))
    df = spark.createDataFrame([("p", "p", c + ".json") for c in cores], "path string, album string, name string")
    rows = file_ops.parse_sidecar_names(df.withColumn("path", F.col("name"))).collect()
    got = {r.path[:-5]: (r.filename, r.extension) for r in rows}
    assert got == {c: _parts_by_loop(c, fixed.SIDECAR_EXTENSIONS) for c in cores}


def test_extra_extensions(spark):
    df = spark.createDataFrame([("p", "p", "clip.mkv.json")], "path string, album string, name string")
    row = file_ops.parse_sidecar_names(df, ["mkv"]).first()
    assert (row.filename, row.extension) == ("clip", "mkv")


def test_album_year(column_of):
    folders = ["Photos from 2023", "photos FROM 1900 x", "Photos from 1899", "Photos from 2201", "My Photos from 2020"]
    assert column_of(folders, names.album_year) == [2023, 1900, None, None, None]


def test_members(column_of):
    raw = ["a<b>.txt", "CON", "x/con.txt/y", "a. /b..", "CONSOLE", "com1.tar.gz", "ok/é", "CON /x", "a/ ."]
    assert column_of(raw, names.sanitize_member) == [
        "a_b_.txt", "_CON", "x/_con.txt/y", "a/b", "CONSOLE", "_com1.tar.gz", "ok/é", "_CON/x", "a/"]
    paths = ["a/b", "a/../b", "../b", "a/../../b", "/etc/x", "./a", "a/./../.."]
    assert column_of(paths, names.is_safe_member) == [True, True, False, False, False, True, False]
    archives = ["A.ZIP", "b.tar.gz", "c.tgz", "d.tar", "e.tar.bz2", "f.tbz2", "g.7z"]
    assert column_of(archives, names.archive_format) == ["zip", "tar.gz", "tgz", "tar", "tar.bz2", "tbz2", None]
