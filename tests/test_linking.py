import random

import pytest

from mediacat.operators import contention, files as file_ops, linking

FULL = ".supplemental-metadata"


def _files(spark, album_names):
    rows = [(f"{album}/{name}", album, name) for album, name in album_names]
    return spark.createDataFrame(rows, "path string, album string, name string")


def _link(spark, media, sidecars, **options):
    parsed = file_ops.parse_sidecar_names(_files(spark, sidecars))
    rows = linking.link_sidecars(_files(spark, media), parsed, **options).collect()
    assert len(rows) == len(set(r.path for r in rows)) == len(media)
    return {r.path: (r.sidecar_path, r.phase) for r in rows}


CASES = [
    ("photo1.jpg", f"photo1.jpg{FULL}.json", 1),
    ("01.02.12 - 2", f"01.02.12 - 2{FULL}.json", 1),
    ("01.04(1).12 - 1", f"01.04.12 - 1{FULL}(1).json", 2),
    ("photo(1).jpg", f"photo.jpg{FULL}(1).json", 4),
    ("photo-edited(2).jpg", f"photo.jpg{FULL}(2).json", 3),
    ("Screenshot_abb9c8060a0a1.jpg", f"Screenshot_abb9c8060a0a.jpg{FULL}.json", 4),
    ("x.nef", f"x.nef{FULL}.json", 4),
    ("clip.mkv", f"clip.mkv{FULL}.json", None),
    ("clip(1).mkv", f"clip.mkv{FULL}(1).json", 2),
    ("a.JPG", f"a.jpeg{FULL}.json", 4),
    ("pic", f"picture{FULL}.json", 4),
    ("orphan.jpg", "other.png.json", None),
]


def test_single_pairs(spark):
    # One album per pair, so the pairs cannot disturb each other.
    media = [(f"A{i}", m) for i, (m, _, _) in enumerate(CASES)]
    sidecars = [(f"A{i}", s) for i, (_, s, _) in enumerate(CASES)]
    got = _link(spark, media, sidecars)
    for i, (m, s, phase) in enumerate(CASES):
        expected = (f"A{i}/{s}", phase) if phase else (None, None)
        assert got[f"A{i}/{m}"] == expected, m


def test_edited_shares_the_sidecar(spark):
    got = _link(spark, [("A", "photo.jpg"), ("A", "photo-edited.jpg")], [("A", f"photo.jpg{FULL}.json")])
    assert got["A/photo.jpg"][1] == 1 and got["A/photo-edited.jpg"][1] == 3
    assert got["A/photo.jpg"][0] == got["A/photo-edited.jpg"][0]


def test_matched_sidecars_are_gone_in_phase_4(spark):
    got = _link(spark, [("A", "IMG.jpg"), ("A", "IMG~2.jpg")], [("A", f"IMG.jpg{FULL}.json")])
    assert got["A/IMG.jpg"][1] == 1 and got["A/IMG~2.jpg"] == (None, None)


def test_several_candidates_give_no_link(spark):
    numbered = [("A", f"IMG_1234.jpg{FULL}(1).json"), ("A", f"IMG_1234.jpg{FULL}(2).json")]
    assert _link(spark, [("A", "IMG_1234.jpg")], numbered)["A/IMG_1234.jpg"] == (None, None)
    twins = [("A", f"a.jpg{FULL}.json"), ("A", "a.JPG.s.json")]
    assert _link(spark, [("A", "a.jpg")], twins)["A/a.jpg"] == (None, None)


def test_albums_are_separate(spark):
    got = _link(spark, [("A", "a.jpg"), ("B", "a.jpg")], [("B", f"a.jpg{FULL}.json")])
    assert got["A/a.jpg"] == (None, None) and got["B/a.jpg"][1] == 1


def test_orphans_and_unprocessed(spark):
    media, sidecars = [("A", "a.jpg"), ("A", "b.jpg")], [("A", f"a.jpg{FULL}.json"), ("B", "z.json")]
    files = _files(spark, media + sidecars + [("A", "metadata.json"), ("A", "x.tmp")])
    parsed = file_ops.parse_sidecar_names(file_ops.sidecar_files(files))
    links = linking.link_sidecars(file_ops.media_files(files), parsed)
    assert [r.path for r in linking.orphan_media(links).collect()] == ["A/b.jpg"]
    assert [r.path for r in linking.orphan_sidecars(parsed, links).collect()] == ["B/z.json"]
    left = {(r.kind, r.path) for r in linking.unprocessed(files, links).collect()}
    assert left == {("sidecar", "B/z.json"), ("other", "A/x.tmp")}


def _one_by_one(edges):
    """Media in path order, each taking its only free candidate."""
    free = {s for _, s, _ in edges}
    taken = {}
    for media in sorted({m for m, _, _ in edges}):
        for kind in (1, 2):
            options = [s for m, s, k in edges if m == media and k == kind and s in free]
            if options:
                if len(options) == 1:
                    taken[media] = options[0]
                    free.discard(options[0])
                break
    return taken


def _assigned(spark, media, sidecars):
    """contention.assign_in_order over (album, number, ext, base, path) tuples."""
    schema = "album string, number string, ext string, base string, path string"
    frames = [spark.createDataFrame(rows, schema).repartition(3) for rows in (media, sidecars)]
    rows = contention.assign_in_order(*frames).collect()
    assert sorted((r.album, r.path) for r in rows) == sorted((m[0], m[4]) for m in media)
    return {r.path: r.sidecar_path for r in rows if r.sidecar_path}


def _edges(media, sidecars):
    for *group, name, path in media:
        for *other, base, sidecar in sidecars:
            if group == other and name.startswith(base):
                yield path, sidecar, 1
            elif group == other and base.startswith(name):
                yield path, sidecar, 2


@pytest.mark.parametrize("seed", range(8))
def test_assignment_in_order(spark, seed):
    rng = random.Random(seed)

    def some(count, letter):
        return [
            (rng.choice("AB"), rng.choice(["", "(1)"]), rng.choice(["", ".jpg"]),
             "".join(rng.choice("ab\U0001f600") for _ in range(rng.randint(0, 5))), f"{letter}{rng.random()}")
            for _ in range(count)
        ]

    media, sidecars = some(150, "m"), some(110, "s")
    assert _assigned(spark, media, sidecars) == _one_by_one(list(_edges(media, sidecars)))


@pytest.mark.parametrize("length", [8, 64, 256])
def test_assignment_spreads_along_a_chain(spark, length):
    # The first media takes the shortest name, which leaves the second one candidate, and so on.
    media = [("A", "", "", "a" * i, f"m{i:03d}") for i in range(1, length)]
    sidecars = [("A", "", "", "a" * i, f"s{i:03d}") for i in range(1, length)]
    group = f"chain of {length}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = _assigned(spark, media, sidecars)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == {f"m{i:03d}": f"s{i:03d}" for i in range(1, length)}
    assert jobs <= 12
    backwards = [(*m[:4], f"m{length - len(m[3]):03d}") for m in media]
    assert _assigned(spark, backwards, sidecars) == _one_by_one(list(_edges(backwards, sidecars)))


def test_linking_runs_no_job_before_it_is_asked_for(spark):
    spark.sparkContext.setJobGroup("built", "built")
    try:
        media, parsed = _files(spark, [("A", "a.nef")]), file_ops.parse_sidecar_names(_files(spark, [("A", "a.nef.json")]))
        linking.link_sidecars(media, parsed)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("built")
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_large_album_is_split_but_no_tree_is(spark):
    bases = [f"IMG_{i:04d}{tail}" for i in range(200) for tail in ("", "~2", "~2x")]
    rows = [("A", "", "", base, base) for base in bases]
    names = spark.createDataFrame(rows, "album string, number string, ext string, base string, path string")
    got = contention._with_beginnings(names, names).collect()
    assert len({r.beginning for r in got}) == 200 and all(r.beginning == r.base[:8] for r in got)


def test_crowded_sidecar(spark):
    # Thousands of media fit one sidecar; the first in path order gets it.
    media = [("A", f"IMG_{i:05d}.nef") for i in range(3000)]
    got = _link(spark, media, [("A", "IMG_.nef.json")])
    assert got["A/IMG_00000.nef"] == ("A/IMG_.nef.json", 4)
    assert sum(phase is not None for _, phase in got.values()) == 1


def test_random_names_by_brute_force(spark):
    rng = random.Random(3)
    stems = ["a", "ab", "abc", "b", "a(1)", "ab(1)", "a-edited", "ab-edited(1)"]
    tails = [".jpg", ".nef", "", ".jp", ".mkv"]
    media = sorted({("A", rng.choice(stems) + rng.choice(tails)) for _ in range(40)})
    sidecars = sorted({("A", rng.choice(["a", "ab", "abc", "abcd", "b"]) + rng.choice(tails)
                        + rng.choice(["", FULL, ".s"]) + rng.choice(["", "(1)"]) + ".json") for _ in range(25)})
    parsed = file_ops.parse_sidecar_names(_files(spark, sidecars))
    exact = {}
    for phase in (linking.match_phase1, linking.match_phase2, linking.match_phase3):
        for r in phase(_files(spark, media), parsed).collect():
            exact.setdefault(r.path, r.sidecar_path)
    rest = [m for m in media if f"{m[0]}/{m[1]}" not in exact]
    free = [r for r in parsed.collect() if r.path not in exact.values()]
    feats = linking._prefix_media(_files(spark, rest)).collect()
    ext = {r.path: r.ext for r in linking._prefix_sidecars(parsed).collect()}
    edges = []
    for m in feats:
        for s in free:
            if (m.number, m.ext) == (s.numeric_suffix, ext[s.path]):
                if m.base.startswith(s.filename):
                    edges.append((m.path, s.path, 1))
                elif s.filename.startswith(m.base):
                    edges.append((m.path, s.path, 2))
    expected = exact | _one_by_one(edges)
    got = {p: s for p, (s, _) in _link(spark, media, sidecars).items() if s}
    assert got == expected


def test_result_does_not_depend_on_partitioning(spark):
    media = _files(spark, [("A", f"a{i}.nef") for i in range(20)])
    parsed = file_ops.parse_sidecar_names(_files(spark, [("A", f"a{i}.nef.json") for i in range(0, 20, 3)]))
    once = sorted(map(tuple, linking.link_sidecars(media, parsed).collect()), key=str)
    again = linking.link_sidecars(media.repartition(7), parsed.repartition(3, "filename"))
    assert sorted(map(tuple, again.collect()), key=str) == once


def test_alternative_matcher(spark):
    media = [("A", "a-bearbeitet.jpg"), ("A", "b(1)-edited.jpg"), ("A", "c(3).jpg"), ("A", "d.jpg")]
    sidecars = [("A", "a.jpg.json"), ("A", "b.jpg(1).json"), ("A", "x.png(3).json")]
    parsed = file_ops.parse_sidecar_names(_files(spark, sidecars))
    got = {r.path: r.sidecar_path for r in linking.match_alternative(_files(spark, media), parsed).collect()}
    assert got == {
        "A/a-bearbeitet.jpg": "A/a.jpg.json",
        "A/c(3).jpg": "A/x.png(3).json",
    }


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_only_equi_joins(spark):
    media = _files(spark, [("A", "a.jpg")])
    parsed = file_ops.parse_sidecar_names(_files(spark, [("A", "a.jpg.json")]))
    frames = [linking.match_exact(media, parsed), linking.match_phase4(media, parsed), linking.link_sidecars(media, parsed)]
    frames += [f(media, parsed) for f in (linking.match_phase1, linking.match_phase2, linking.match_phase3)]
    for df in frames:
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_localized_marks_in_phase_3(spark):
    media, sidecars = [("A", "a-bearbeitet.jpg")], [("A", "a.jpg.json")]
    # Without the mark the name still links, but only because "a" begins it.
    assert _link(spark, media, sidecars)["A/a-bearbeitet.jpg"][1] == 4
    marked = _link(spark, media, sidecars, edit_marks=["-edited", "-bearbeitet"])
    assert marked["A/a-bearbeitet.jpg"] == ("A/a.jpg.json", 3)
