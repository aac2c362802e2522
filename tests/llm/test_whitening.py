"""Whitening against numpy's eigenvectors and exact whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from slotwise.llm import queries, whitening


def _plain(rows: list) -> tuple[list, np.ndarray, np.ndarray, list[int], int]:
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    return good, values[::-1], axes[:, ::-1], [int(s) for s in fit.sum(axis=0)], len(fit)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_components_of_random_matrices(d):
    rng = np.random.default_rng(d)
    for _ in range(5):
        a = rng.standard_normal((3 * d, d)) * rng.uniform(0.01, 9, d)
        v = a.T @ a
        values, axes = whitening.leading_components(v, 4)
        k = min(4, d)
        want = np.linalg.eigvalsh(v)[::-1][:k]
        assert np.allclose(values, want, rtol=1e-12)
        assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12
        assert np.abs(v @ axes - axes * values).max() < 1e-11 * want[0]


def test_clusters_and_flat_matrices():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    for spectrum in (np.ones(30), np.r_[np.full(5, 7.0), np.linspace(1, 2, 25)], np.r_[7, 7 - 1e-13, 7 - 2e-13, np.zeros(27)], np.r_[1e-200, np.zeros(29)], np.zeros(30)):
        v = (q * spectrum) @ q.T
        v = (v + v.T) / 2
        values, axes = whitening.leading_components(v, 4)
        assert np.allclose(values, np.sort(spectrum)[::-1][:4], atol=1e-12 * max(spectrum.max(), 1e-300))
        assert np.abs(axes.T @ axes - np.eye(4)).max() < 1e-10
        assert np.abs(v @ axes - axes * values).max() <= 1e-11 * max(spectrum.max(), 1e-300)
    diagonal = np.diag([3.0, 1.0, 2.0])
    values, axes = whitening.leading_components(diagonal, 2)
    assert np.allclose(values, [3, 2]) and np.allclose(np.abs(axes), [[1, 0], [0, 0], [0, 1]], atol=1e-12)


def test_rows_against_plain(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(6) * [3, 2, 1, 1, 0.5, 0.1]]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(50)] + [(None, rows[9][1]), (7, rows[7][1]), (2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, []), (2005, [-0.0] * 6)]
    frame = spark.createDataFrame([(i, v, "w", 1) for i, v in rows], "vec_id long, embedding array<double>, whitened string, x int").repartition(6)
    other = spark.createDataFrame([(3000, [1.0, 2.0], "w", 1)], frame.schema)
    model = whitening.fit_whitening(frame.union(other))
    good, values, axes, sums, n = _plain(rows)
    assert (model.n, list(model.sums)) == (n, sums)
    assert np.allclose(model.explained, values[:4] / values.sum(), rtol=1e-12)
    assert model.identity_error < 1e-9
    got = whitening.whiten(frame.union(other), model).collect()
    assert len(got) == len(good)
    by_id: dict = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    signs = np.sign((model.components * axes[:, :4]).sum(axis=0))
    for i, x in good:
        r = by_id[i].pop()
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        want = (np.array(x) - np.array(sums) / n) @ axes[:, :4] / np.sqrt(values[:4]) * signs
        assert np.allclose(r.whitened, want, atol=1e-9)
        assert r.x == 1
    w = np.array([r.whitened for r in {tuple(map(float, r.embedding)): r for r in got}.values()])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9


def test_flat_huge_and_empty(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    model = whitening.fit_whitening(same)
    assert (model.n, model.sums, model.components.shape[1]) == (1, (256, 512), 0)
    assert [(r.deviation, r.whitened) for r in whitening.whiten(same, model).collect()] == [(0, [])] * 2
    assert whitening.fit_whitening(same.filter("false")) is None
    assert whitening.whiten(same, None).collect() == []
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(huge)
    got = {r.vec_id: r.deviation for r in whitening.whiten(huge, model).collect()}
    assert model.sums == (-1, 256 * 6) and got[1] is None
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.fit_whitening(line).components.shape[1] == 1


def test_query_against_plain(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    good, values, axes, sums, n = _plain(rows)
    got = queries.op13_whitening(spark, folder).collect()
    assert len(got) == 4 * len(good)
    x = dict(good)
    for r in got:
        own = np.array(x[r.vec_id])
        want = (own - np.array(sums) / n) @ axes[:, r.component - 1] / np.sqrt(values[r.component - 1])
        assert abs(abs(r.whitened) - abs(want)) < 1e-9 and r.n == n and r.identity_error < 1e-4
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
