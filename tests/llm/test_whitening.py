"""Whitened components against a full eigendecomposition of the same rows."""

import math

import numpy as np
import pytest

from mediacat.llm import spectral, whitening

SCHEMA = "media_item_id bigint, embedding array<double>, n string"


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_components_of_a_matrix(d):
    rng = np.random.default_rng(d)
    for values in [rng.random(d), np.linspace(1, 2, d) ** 8, np.ones(d), np.r_[np.ones(d // 2), np.zeros(d - d // 2)], 10.0 ** -np.arange(d)]:
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        a = (q * values) @ q.T
        k = min(4, d)
        got, vectors = spectral.leading_components(a, 4)
        want = np.sort(values)[::-1][:k]
        assert np.allclose(got, want, rtol=0, atol=1e-13 * want[0])
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-13)
        assert np.linalg.norm(a @ vectors - vectors * got) <= 1e-12 * want[0]


def test_polar_factor():
    a = np.diag([3.0, -2.0, 1e-9, -1e-12])
    assert np.allclose(spectral.polar(a), np.diag([1, -1, 1, -1]), atol=1e-12)
    assert np.allclose(spectral.leading_components(np.zeros((3, 3)), 4)[0], 0)


def brute(vectors, components=4):
    x = np.array([[math.floor(256 * c) for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    mean = np.array([s / n for s in sums], dtype=float)
    centred = fit.astype(float) - mean
    v = centred.T @ centred / n
    values, q = np.linalg.eigh(v)
    values, q = values[::-1], q[:, ::-1]
    white = (x.astype(float) - mean) @ q[:, :components] / np.sqrt(values[:components])
    return n, [int(sum((n * a - s) ** 2 for a, s in zip(r, sums))) for r in x], white, values[:components] / values.sum()


def test_rows_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 12)) * np.linspace(0.2, 2, 12)
    vectors = [base[i % 300].tolist() for i in range(500)]
    odd = [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("-inf")] * 12)]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(*o, "x") for o in odd] + [(None, vectors[0], "x")]
    got = whitening.whiten_embeddings(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == 4 * 501
    n, deviations, white, explained = brute(vectors)
    signs = {}
    for r in got:
        i, k = r.media_item_id or 0, r.component - 1
        assert r.n == n and int(r.deviation) == deviations[i]
        assert abs(r.explained - explained[k]) < 1e-12 and r.identity_error < 1e-10
        assert abs(abs(r.whitened) - abs(white[i, k])) < 1e-9
        if abs(r.whitened) > 1e-6:
            signs.setdefault(k, set()).add(r.whitened * white[i, k] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_short_empty_huge_and_equal_vectors(spark):
    rows = [(1, [1.0, 2.0], ""), (2, [1.0], ""), (3, [1.0, 0.0], ""), (4, [], ""), (5, [-0.0, 1e300], "")]
    got = whitening.whiten_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 10 and {r.n for r in got} == {4}
    by_id = {(r.media_item_id, r.component): r for r in got}
    assert by_id[2, 1].whitened == by_id[3, 1].whitened and by_id[2, 1].deviation == by_id[3, 1].deviation
    x = [(256, 512), (256, 0), (256, 0), (0, 0), (0, 2**31)]
    sums = (512, 512 + 2**31)
    assert [int(by_id[i + 1, 1].deviation) for i in range(5)] == [sum((4 * a - s) ** 2 for a, s in zip(v, sums)) for v in x]

    same = spark.createDataFrame([(1, [1.0, 2.0, 3.0], ""), (2, [1.0, 2.0, 3.0], "")], SCHEMA)
    got = whitening.whiten_embeddings(same).collect()
    assert len(got) == 6 and all(r.whitened == 0 and r.explained == 0 and r.n == 1 and r.deviation == 0 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, "")]])
def test_no_usable_rows(spark, rows):
    assert whitening.whiten_embeddings(spark.createDataFrame(rows, SCHEMA)).collect() == []
