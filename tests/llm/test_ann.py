import numpy as np
import pytest

from dirlens.llm import ann as A


def brute(ids, x, k, every):
    ids, at = np.unique(ids, return_index=True)
    x = x[at].astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = np.round(u @ u[i], 12)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


@pytest.mark.parametrize(("block", "spread"), [(4096, 2), (64, 2), (4096, 0)])
def test_recall_and_exact_scores(spark, monkeypatch, block, spread):
    """Clustered vectors, and ones without any structure."""
    monkeypatch.setattr(A, "BLOCK", block)
    monkeypatch.setattr(A, "QUERIES", 2 * block)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(1500, 16)) + spread * rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)]).astype(np.float32)
    x[700:900] = x[700]  # many copies of one vector
    ids = np.arange(1500)
    rows = [(int(i), v.tolist(), 0.5) for i, v in zip(ids, x, strict=True)]
    bad = [(2000, None, 0.0), (2050, [0.0] * 16, 0.0), (2100, [float("nan")] + [1.0] * 15, 0.0), (2150, [None] + [1.0] * 15, 0.0), (2200, [1.0] * 3, 0.0), (None, x[0].tolist(), 0.0), (2250, [float("inf")] * 16, 0.0), rows[50], rows[3]]
    got = A.nearest(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score double").repartition(3)).collect()
    want, by = brute(ids, x, 5, 50), {}
    for r in got:
        by.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(by) == set(want) and all(sorted(v) == [1, 2, 3, 4, 5] for v in by.values())
    hits = sum(len({i for i, _ in by[q].values()} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    u = x.astype(np.float64)
    for q, v in by.items():
        assert [s for _, s in (v[r] for r in range(1, 6))] == sorted((s for _, s in v.values()), reverse=True)
        for i, s in v.values():
            assert s == pytest.approx(u[q] @ u[i] / np.linalg.norm(u[q]) / np.linalg.norm(u[i]), abs=1e-12)
    assert [i for i, _ in (by[750][r] for r in range(1, 6))] == [700, 701, 702, 703, 704]


def test_clusters_need_few_probes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32)) / 4 + 2 * rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)]
    router = A.train_router(x[:2000], 16)
    assert len(router.bias) == 16 and router.probes <= 4


def test_of_rows_that_share_an_id_one_counts(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(300)]
    twice = [(i, rng.normal(size=8).tolist()) for i in (0, 7, 50)]
    schema = "vec_id long, embedding array<double>"
    told = [sorted(A.nearest(spark.createDataFrame(r, schema).repartition(n)).collect()) for r, n in ((rows + twice, 2), (twice + rows, 5))]
    assert told[0] == told[1] and len(told[0]) == 30


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert A.nearest(spark.createDataFrame([], schema)).count() == 0
    assert A.nearest(spark.createDataFrame([(0, [1.0, 2.0])], schema)).count() == 0
    got = A.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0])], schema)).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 2), (2, 1)]


def test_partitions_are_balanced():
    x = A._unit(np.random.default_rng(2).normal(size=(600, 8)))
    x[:300] = x[0] + 1e-3 * x[:300]  # half of all rows in one place
    home = A.balanced_partitions(A._unit(x), A.neighbour_graph(A._unit(x), 10), 6)
    assert np.bincount(home, minlength=6).max() <= np.ceil(1.1 * 100)


def test_multiples_of_a_vector_tie_to_the_smallest_ids():
    from dirlens.llm.ann import _best

    rng = np.random.default_rng(7)
    v = rng.normal(size=16)
    ids = rng.permutation(40)
    c = np.concatenate([v * 2.0 ** rng.permutation(40)[:, None], rng.normal(size=(20, 16))])
    got = _best(np.array([1000]), v[None, :], np.concatenate([ids, np.arange(100, 120)]), c, 5)
    assert got["vec_id"].tolist() == [0, 1, 2, 3, 4]
