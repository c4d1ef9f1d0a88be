"""Targets by hand, flows against a linear program's bounds, draws against their targets."""

import itertools
import random
from fractions import Fraction

import pytest

from mediacat.llm import album_mixing
from mediacat.llm.quota_flow import QuotaFlow

SCHEMA = "media_item_id bigint, google_description string, album_ids array<string>, size string"


def test_targets():
    sizes = {"b": 100, "a": 1000, None: 100, "c": 10}
    got = album_mixing.album_targets(sizes, Fraction(3, 2) * 1210, (3, 1, 2), 2)
    assert list(got) == ["a", "b", "c", None]  # weights 3, 1, 2, 3
    assert got["c"] == 20 and got[None] == 200 and got["b"] == 200 and got["a"] == 1815 - 420
    assert album_mixing.album_targets({"a": 0, "b": 0}, Fraction(0), (3, 1), 2) == {"a": 0, "b": 0}
    assert album_mixing.album_targets({"a": 5, "b": 5}, Fraction(100), (3, 1), 2) == {"a": 10, "b": 10}


def cheapest(patterns, words, quotas):
    """Largest flow and its least number of second-copy words, by trying every split of small flows."""
    albums = sorted(quotas)

    def most(capacity):  # Hall's condition: the tightest set of albums
        best = sum(capacity)
        for r in range(len(albums) + 1):
            for some in itertools.combinations(albums, r):
                outside = sum(c for c, p in zip(capacity, patterns) if set(p) - set(some))
                best = min(best, sum(quotas[a] for a in some) + outside)
        return best

    once, twice = most(words), most([2 * w for w in words])
    return twice, twice - once


@pytest.mark.parametrize("seed", range(40))
def test_flow_is_largest_and_cheapest(seed):
    rng = random.Random(seed)
    albums = "abcd"
    patterns = list({tuple(sorted(rng.sample(albums, rng.randint(1, 3)))) for _ in range(6)})
    words = [rng.randint(1, 9) for _ in patterns]
    quotas = {a: rng.randint(0, 20) for a in albums}
    flow = QuotaFlow(patterns, quotas)
    used = [flow.add_copy(words) for _ in range(2)]
    total, repeated = cheapest(patterns, words, quotas)
    assert sum(map(sum, used)) == total and sum(used[1]) == repeated
    for a in albums:
        assert sum(s.get(a, 0) for s in flow.sent) == quotas[a] - flow.quota[a]
    for pattern, sent, first, second in zip(patterns, flow.sent, *used):
        assert sum(sent.values()) == first + second and all(v >= 0 for v in sent.values())


def rows_of(rng, n, albums):
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 3, 10, 40, 200])
        out.append((i, " ".join(["w"] * size) or None, rng.choice(albums), "x"))
    return out


def test_draws_meet_targets(spark):
    rng = random.Random(4)
    rows = rows_of(rng, 3000, [["a"]] * 6 + [["b"]] * 2 + [["c"], [None]])
    frame = spark.createDataFrame(rows, SCHEMA)
    mix = album_mixing.mix_albums(frame)
    got = mix.items.collect()
    targets = {r.album_id: r for r in mix.albums.collect()}
    assert len(got) == 3000
    taken = dict.fromkeys(targets, 0)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.copies * r.size
        assert r.drawn_for == r.album_ids * r.copies
        taken[r.album_ids[0]] += r.taken
    for album, r in targets.items():
        assert r.size == sum(x.size for x in got if x.album_ids == [album])
        assert abs(taken[album] - r.target) <= 1, (album, taken[album], r.target)
    again = album_mixing.mix_albums(frame.repartition(7).orderBy("size")).items.collect()
    assert sorted((r.media_item_id, r.taken) for r in again) == sorted((r.media_item_id, r.taken) for r in got)
    other = album_mixing.mix_albums(frame, seed="other").items.collect()
    assert sorted((r.media_item_id, r.taken) for r in other) != sorted((r.media_item_id, r.taken) for r in got)


def test_overlapping_albums(spark):
    rng = random.Random(5)
    rows = rows_of(rng, 2000, [["a", "b"], ["b", "a", "a"], ["b", "c"], ["c"], [], None])
    mix = album_mixing.mix_albums(spark.createDataFrame(rows, SCHEMA), weights=(1, 1, 4))
    items, albums = mix.items.collect(), {r.album_id: r for r in mix.albums.collect()}
    sent = dict.fromkeys(albums, 0)
    for r in items:
        assert r.copies == len(r.drawn_for) <= 2 and set(r.drawn_for) <= set(r.album_ids)
        for album in r.drawn_for:
            sent[album] += r.size
    assert set(albums) == {"a", "b", "c"}
    for album, r in albums.items():
        assert abs(sent[album] - r.target) <= 2 * 200
    assert all(r.copies == 0 for r in items if not r.album_ids)


def test_edges(spark):
    assert album_mixing.mix_albums(spark.createDataFrame([], SCHEMA)).items.collect() == []
    rows = [(1, None, ["a"], ""), (1, "", ["a"], ""), (None, "one two", ["b"], ""), (None, "one two", ["b"], ""), (3, "x " * 200_000, ["c"], "")]
    got = album_mixing.mix_albums(spark.createDataFrame(rows, SCHEMA)).items.collect()
    assert sorted(r.size for r in got) == [0, 0, 2, 2, 200_000]
    assert all(r.taken <= 2 * r.size for r in got)
    with pytest.raises(ValueError):
        album_mixing.mix_albums(spark.createDataFrame(rows, SCHEMA), most_patterns=2)
