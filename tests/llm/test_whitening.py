"""Whitening against a plain covariance in numpy and whole numbers in Python."""

from fractions import Fraction

import numpy as np
import pytest

from evidara.llm import whitening


def rows_of(spark, vectors, extra=()):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)] + list(extra), "vec_id long, embedding array<float>, vector string, n int")


@pytest.mark.parametrize("width,count", [(5, 40), (40, 300), (17, 100)])
def test_against_numpy(spark, monkeypatch, width, count):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "HELD_TILES", 1)
    r = np.random.default_rng(width)
    data = (r.normal(size=(count, width)) @ r.normal(size=(width, width))).astype(np.float32)
    got = whitening.whiten(rows_of(spark, data.tolist())).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(64 * data.astype(float)).astype(np.int64) + 1_000_000
    v = np.cov(x.T, bias=True)
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1][:32], vectors[:, ::-1][:, :32]
    white = (x - x.mean(0)) @ vectors / np.sqrt(e)
    mine = got["whitened"].to_numpy().reshape(count, -1)
    assert mine.shape == white.shape
    for a, b in zip(mine.T, white.T, strict=True):  # either sign, the same for all rows
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-5
    assert np.allclose(got["explained"].to_numpy().reshape(count, -1)[0], e / np.trace(v), rtol=1e-9)
    s = [int(c) for c in x.sum(0)]
    assert got["deviation"].tolist()[:: len(e)] == [sum((count * int(c) - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    assert set(got["n"]) == {count}
    assert got["identity_error"].nunique() == 1
    assert abs(got["identity_error"].iloc[0] - np.abs(np.cov(mine.T, bias=True) - np.eye(len(e))).max()) < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1, 0.9], [0.5, -0.2], [-0.7, 0.3], [-0.7, 0.3]]
    odd = [(90, None, "x", 1), (91, [nan, 1.0], "x", 1), (92, [1.0, None], "x", 1), (93, [inf, 0.0], "x", 1), (94, [], "x", 1), (95, [1.0, 2.0, 3.0], "x", 1), (None, [0.2, 0.2], None, None)]
    got = whitening.whiten(rows_of(spark, good, odd)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted((i is None, i or 0, c) for i in [0, 1, 2, 3, None] for c in (1, 2))
    assert {r.n for r in got} == {5}
    assert len({(r.component, round(r.whitened, 9)) for r in got if r.vec_id in (2, 3)}) == 2


def test_dependent_dimensions_and_equal_vectors(spark):
    line = [[float(i), 2.0 * i, 7.0] for i in range(20)]
    got = whitening.whiten(rows_of(spark, line)).collect()
    assert {r.component for r in got} == {1} and max(r.identity_error for r in got) < 1e-9
    assert whitening.whiten(rows_of(spark, [[1.0, 2.0]] * 5)).collect() == []
    assert whitening.whiten(rows_of(spark, [])).collect() == []


def test_large_entries(spark):
    got = whitening.whiten(rows_of(spark, [[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]])).collect()
    assert got and any(r.deviation is None for r in got)


def test_exact_deviation():
    y, rest, n = np.array([[3, -(1 << 39)], [0, 1]]), [1, 4], 5
    exact = [sum((n * Fraction(int(c)) - t) ** 2 for c, t in zip(row, rest, strict=True)) for row in y]
    assert whitening.exact_deviation(y, rest, n) == [int(d) if d < 1 << 63 else None for d in exact]
