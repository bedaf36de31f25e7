import math

import numpy as np
import pytest

from dirlens.llm import whitening
from dirlens.llm.whitening import components, polar, whiten

SCHEMA = "vec_id long, embedding array<float>, component string, n int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, e, "x", 0) for i, e in rows], SCHEMA).repartition(3)


def plain(rows, most=32):
    """Everything again with exact sums and LAPACK's eigenvectors."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e]) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    n, size = len(kept), len(kept[0][1])
    total = [sum(x[j] for _, x in kept) for j in range(size)]
    exact = [[sum((n * x[i] - total[i]) * (n * x[j] - total[j]) for _, x in kept) for j in range(size)] for i in range(size)]
    v = np.array([[float(c) for c in r] for r in exact]) / float(n) ** 3
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    deviations = {i: sum((n * x[j] - total[j]) ** 2 for j in range(size)) for i, x in kept}
    white = {i: np.array([(n * x[j] - total[j]) / n for j in range(size)]) @ u / np.sqrt(np.maximum(e, 1e-300)) for i, x in kept}
    return n, v, e, deviations, white


def test_as_plain_pass(spark):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((300, 12)) * np.linspace(3, 0.2, 12)) @ np.linalg.qr(rng.standard_normal((12, 12)))[0]
    rows = [(int(i), [float(c) for c in r]) for i, r in enumerate(x)]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] * 12), (904, [])]
    got = whiten(_frame(spark, rows + bad), most=5).collect()
    n, v, e, deviations, white = plain(rows)
    assert n == 300 and len(got) == 300 * 5
    for r in got:
        assert r.n == n and r.deviation == deviations[r.vec_id]
        assert abs(r.explained - e[r.component - 1] / np.trace(v)) <= 1e-10 * r.explained
        assert r.identity_error < 1e-9
    for c in range(1, 6):
        mine = np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == c])
        other = np.array([white[i][c - 1] for i in range(300)])
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-8


def test_polar_and_components():
    rng = np.random.default_rng(5)
    for n, spectrum in [(1, [2.0]), (2, [1, 1 + 1e-9]), (40, np.geomspace(1e8, 1e-3, 40)), (64, rng.uniform(1, 5, 64)), (9, [4, 4, 4, 2, 2, 1, 0, 0, 0]), (8, [3.0] * 8), (6, [5, 0, 0, 0, 0, 0])]:
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        v = q * np.array(spectrum, float) @ q.T
        v = (v + v.T) / 2
        values, vectors = components(v)
        scale = max(spectrum)
        assert np.abs(np.sort(values)[::-1] - np.sort(np.array(spectrum, float))[::-1]).max() < 1e-13 * n * scale
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
        assert np.abs(vectors.T @ v @ vectors - np.diag(values)).max() < 1e-12 * n * scale
    a = rng.standard_normal((20, 20))
    a = a + a.T
    u = polar(a)
    assert np.abs(u @ u.T - np.eye(20)).max() < 1e-13 and np.linalg.eigvalsh(u @ a).min() > 0


def test_constant_dimensions_few_rows_other_lengths_and_empty(spark):
    assert whiten(_frame(spark, [])).collect() == []
    assert whiten(_frame(spark, [(1, None), (2, [])])).collect() == []
    one = whiten(_frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None), (2, 0, None, 0.0, None)]
    rows = [(None, [1.0, 0.0, 3.0]), (2, [2.0, 0.0, 3.0]), (2, [2.0, 0.0, 3.0]), (4, [5.0, 1.0]), (5, [1e30, 0.0, 0.0])]
    got = whiten(_frame(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (0, 3), (2, 1), (2, 1), (2, 2), (2, 2), (2, 3), (2, 3)]
    assert all((r.whitened is not None) == (r.component == 1) for r in got) and all(r.n == 3 for r in got)
    assert {abs(round(r.whitened, 9)) for r in got if r.component == 1} == {round(math.sqrt(2), 9), round(math.sqrt(0.5), 9)}


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float((i % 2) * 2.0**30), 0.0]) for i in range(8)]
    got = whiten(_frame(spark, rows)).collect()
    assert {r.deviation for r in got} == {None}
    assert {abs(round(r.whitened, 9)) for r in got if r.component == 1} == {1.0}


@pytest.mark.parametrize("rows", [1, 7])
def test_small_slices_give_the_same(spark, monkeypatch, rows):
    rng = np.random.default_rng(7)
    data = [(i, [float(c) for c in r]) for i, r in enumerate(rng.standard_normal((40, 4)))]
    want = {(r.vec_id, r.component): r.deviation for r in whiten(_frame(spark, data)).collect()}
    monkeypatch.setattr(whitening, "ROWS", rows)
    assert {(r.vec_id, r.component): r.deviation for r in whiten(_frame(spark, data)).collect()} == want
