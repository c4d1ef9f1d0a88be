"""Near vectors against all pairs of an album: none too many, nearly all found."""

import numpy as np
import pytest

from mediacat.llm import near_vectors as near


def test_recall_and_precision(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 64))
    rows = []
    for i in range(1500):
        v = base[i % 150] + rng.standard_normal(64) * rng.choice([0.0, 0.15, 0.27, 0.33, 0.6])
        rows.append((i, int(i % 150 % 4), v.tolist()))
    rows += [(2000 + i, 1, (base[7] + rng.standard_normal(64) * 0.1).tolist()) for i in range(700)]
    rows += [(3000 + i, 2, rows[5][2]) for i in range(50)]
    odd = [(4000, 1, None), (4001, 1, [0.0] * 64), (4002, 1, [float("nan")] * 64), (4003, 1, [None] * 64), (4004, None, rows[0][2]),
           (4005, 1, [float("inf")] + [1.0] * 63), (4006, 1, []), (4007, 3, [1.0, 2.0]), (4008, 3, [2.0, 4.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows + odd], "media_item_id bigint, album_id int, embedding array<double>, v string")
    got = {r.media_item_id: r for r in near.near_vectors(frame).collect()}
    assert len(got) == len(rows) + len(odd)
    ids = np.array([r[0] for r in rows])
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    album = np.array([r[1] for r in rows])
    links = (x @ x.T >= 0.93) & (album[:, None] == album[None, :])
    np.fill_diagonal(links, False)
    want = links.sum(axis=1)
    have = np.array([got[i].n_links for i in ids])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(4000, 4007))
    assert got[4008].component_id == 4007 and got[4007].n_links == 1
    assert all(got[3000 + i].n_links >= 49 for i in range(50))
    assert all(r.kept == (r.media_item_id == r.component_id) for r in got.values())


def test_no_rows(spark):
    frame = spark.createDataFrame([], "media_item_id bigint, album_id int, embedding array<float>")
    assert near.near_vectors(frame).collect() == []


@pytest.mark.parametrize("codewords", [8, 28, 50])
def test_recall_at_every_size(codewords):
    rng = np.random.default_rng(5)
    codes = near.cap_filters(64, codewords, 0.93)
    found = 0
    for _ in range(200):
        a, b = near._pair(rng, 64, 0.93)
        assert abs(a @ b - 0.93) < 1e-9
        found += any(np.intersect1d(c.of(a), c.of(b)).size for c in codes)
    assert found >= 0.95 * 200


def test_filters_of_any_dimension_and_similarity():
    for dimension, similarity in [(1, 0.93), (2, 0.93), (5, 0.9), (64, 1.0), (64, 0.3), (16, 0.0), (3, -1.0)]:
        rng = np.random.default_rng(6)
        codes = near.cap_filters(dimension, 8, similarity)
        pairs = [near._pair(rng, dimension, similarity) for _ in range(60)]
        found = np.mean([any(np.intersect1d(c.of(a), c.of(b)).size for c in codes) for a, b in pairs])
        assert found >= 0.9, (dimension, similarity, len(codes), found)
