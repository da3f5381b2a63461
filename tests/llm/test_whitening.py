import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import registry, whitening as w

FOLDER = "/root/testdata/sf0.01"


def plain(x, k):
    """Whitening by one dense eigendecomposition of exactly centred rows."""
    n, S = len(x), x.sum(0)
    c = (x * n - S).astype(float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return c @ vectors / np.sqrt(values), values / (c**2).sum() * n, ((x * n - S) ** 2).sum(1), values


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    data = [(i, None if v is None else [None if e is None else int(e) for e in v], "x", 1) for i, v in zip(ids, x)]
    return spark.createDataFrame(data, "id bigint, features array<bigint>, component string, n int").repartition(3)


def check(out, x, k):
    z, share, deviation, values = plain(x, k)
    got = {(r.id, r.component): r for r in out}
    assert len(got) == len(out) == len(x) * k
    for j in range(k):
        own = np.array([got[i, j + 1].whitened for i in range(len(x))])
        assert min(np.abs(own - z[:, j]).max(), np.abs(own + z[:, j]).max()) < 1e-8
        assert abs(got[0, j + 1].explained / share[j] - 1) < 1e-9
    assert all(int(got[i, 1].deviation) == int(deviation[i]) and got[i, 1].n == len(x) for i in range(len(x)))
    assert out[0].identity_error < 1e-9


@pytest.mark.parametrize("d,k", [(40, 5), (40, 12), (6, 32), (1, 1)])
def test_equal_to_a_dense_decomposition(spark, d, k):
    rng = np.random.default_rng(d + k)
    x = np.floor(rng.standard_normal((300, d)) * np.linspace(50, 5, d)).astype(np.int64) + 10**6
    check(w.whiten(frame(spark, x), components=k).collect(), x, min(d, k))


def test_steep_and_flat_spectra():
    rng = np.random.default_rng(1)
    for values in (10.0 ** -np.arange(30), np.linspace(1, 0.97, 60), np.r_[1e6, 1e3, np.linspace(1, 0.5, 50)], np.r_[np.ones(5), np.zeros(35)]):
        Q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
        V = (Q * values) @ Q.T
        found, vectors, residual, certified = w.leading_eigenpairs(lambda X: V @ X, len(values), 6, 8, 1e-12)
        assert certified and np.allclose(found, values[:6], atol=1e-11 * values[0])
        assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-12


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-(10**15), 10**15, (50, 4))
    out = w.whiten(frame(spark, x), components=2).collect()
    big = x.astype(object)
    exact = ((big * 50 - big.sum(0)) ** 2).sum(1)
    assert {(r.id, int(r.deviation)) for r in out} == set(enumerate(exact.tolist()))


def test_many_tasks_are_summed_in_groups(spark, monkeypatch):
    monkeypatch.setattr(w, "GROUPS", 2)
    x = np.random.default_rng(4).integers(0, 100, (200, 5))
    check(w.whiten(frame(spark, x).repartition(7), components=3).collect(), x, 3)


def test_awkward_rows(spark):
    x = [[1, 2, 3], [4, 4, 9], None, [1, None, 3], [1, 2], [], [4, 4, 9], [0, 7, 1]]
    out = w.whiten(frame(spark, x, [1, 2, 3, 4, 5, 6, 2, None]), components=2).collect()
    assert sorted((r.id or 0, r.component) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert {r.n for r in out} == {4}
    assert w.whiten(frame(spark, [])).collect() == [] and w.whiten(frame(spark, [None, []])).collect() == []
    for same in ([[5, 6]], [[5, 6]] * 3):
        rows = w.whiten(frame(spark, same)).collect()
        assert len(rows) == 2 * len(same) and all((r.deviation, r.whitened, r.explained, r.identity_error) == (0, None, None, None) for r in rows)
    flat = w.whiten(frame(spark, [[1, 9], [2, 9], [4, 9]]), components=2).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and all(round(r.explained, 9) in (0, 1) for r in flat)


def test_quantised_vectors(spark):
    data = [(0, [0.5, -0.01]), (1, [math.nan, 1.0]), (2, [math.inf, 1.0]), (3, [None, 1.0]), (4, None), (5, [1e38, 0.0]), (6, [])]
    df = spark.createDataFrame(data, "id int, v array<float>").withColumn("x", w.quantised(F.col("v")))
    assert {r.id: r.x for r in df.collect()} == {0: [1_000_032, 999_999], **{i: None for i in (1, 2, 3, 4, 5)}, 6: []}


def test_query(spark):
    import duckdb

    rows = duckdb.sql(f"select vec_id, embedding from '{FOLDER}/embeddings.parquet' order by vec_id").fetchall()
    x = np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 1_000_000
    out = registry.op13_whitening(spark, FOLDER)
    assert dict(out.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double",
    }
    check(out.withColumnRenamed("vec_id", "id").collect(), x, 32)
