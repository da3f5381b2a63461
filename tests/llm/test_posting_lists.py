import numpy as np
import pytest

from foldwise.llm import posting_lists as lists


def rows_of(n=3000, size=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (30, size))
    return np.round(centres[rng.integers(0, 30, n)] + rng.normal(0, 0.4, (n, size)), 3)


def exact(data, ids, query_ids, k):
    out = {}
    for q in query_ids:
        own = data[ids.index(q)]
        found = {}
        for i, v in zip(ids, data):
            if i != q:
                d = float(np.sqrt(((v - own) ** 2).sum()))
                found[i] = min(d, found.get(i, d))
        out[q] = sorted((d, i) for i, d in found.items())[:k]
    return out


def frame(spark, pairs):
    return spark.createDataFrame([(i, v, "x") for i, v in pairs], "id bigint, features array<float>, list string").repartition(4)


def test_balanced_cells_and_graph_search():
    data = rows_of()
    centroids = lists.balanced_centroids(data, 40)
    assert len(centroids) == 40
    graph = lists.CentroidGraph.over(centroids)
    met = graph.search(data[:300], 1.2, 4)
    true = np.sqrt(((data[:300, None] - centroids[None]) ** 2).sum(axis=2))
    seen = np.isfinite(met)
    assert np.allclose(met[seen], true[seen]) and (met.min(axis=1) <= true.min(axis=1) * 1.0001).mean() > 0.98
    lone = lists.CentroidGraph.over(centroids[:1])
    assert np.isfinite(lone.search(data[:3], 1.1, 4)).all()


@pytest.mark.parametrize("group_rows", [4096, 50])
def test_recall_order_and_scores(spark, group_rows):
    data = rows_of().astype(np.float32).astype(float)
    data[100:400] = data[0]  # a vector that many rows share
    ids = list(range(len(data)))
    vectors = frame(spark, list(zip(ids, data.tolist())))
    out = lists.nearest_rows(vectors, vectors.filter("id % 100 = 0"), k=10, list_rows=100, group_rows=group_rows).collect()
    truth = exact(data, ids, range(0, 3000, 100), 10)
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.distance, r.entry_id))
        assert r.distance == pytest.approx(float(np.sqrt(((data[r.query_id] - data[r.entry_id]) ** 2).sum())), rel=1e-12)
    assert found.keys() == truth.keys() and all(len(v) == 10 and v == sorted(v) for v in found.values())
    recall = np.mean([len({i for _, i in found[q]} & {i for _, i in truth[q]}) / 10 for q in truth])
    assert recall >= 0.95
    assert [i for _, i in found[0]] == list(range(100, 110))


def test_rows_that_take_no_part(spark):
    good = [(n, v) for n, v in enumerate(rows_of(60, 4, 3).tolist())]
    bad = [(100, None), (200, []), (300, [0.0] * 4), (400, [1.0, None, 1.0, 1.0]), (500, [float("nan"), 1.0, 1.0, 1.0]), (600, [float("inf")] * 4), (None, [1.0] * 4), (700, [1.0] * 3)]
    repeated = [good[5], (7, [9.0, 9.0, 9.0, 9.0])]
    vectors = frame(spark, good + bad + repeated)
    out = lists.nearest_rows(vectors, vectors.filter("id % 20 = 0"), k=100, list_rows=10, ratio=99.0).collect()
    assert {r.query_id for r in out} == {0, 20, 40} and {r.entry_id for r in out} == set(range(60))
    data = np.array([v for _, v in good + repeated], np.float32).astype(float)
    truth = exact(data, [i for i, _ in good + repeated], [0, 20, 40], 100)
    assert {(r.query_id, r["rank"], r.entry_id) for r in out} == {(q, n + 1, i) for q, v in truth.items() for n, (_, i) in enumerate(v)}
    empty = frame(spark, [])
    assert lists.nearest_rows(empty, empty).count() == 0
    alone = frame(spark, [(0, [1.0, 2.0])])
    assert lists.nearest_rows(alone, alone).count() == 0


def test_queries_with_few_rows_in_reach_still_get_k(spark):
    """Tight groups of four rows far from each other: a ratio meets the own group only, so the search widens."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 50, (60, 6))
    data = np.round(np.repeat(centres, 4, axis=0) + rng.normal(0, 0.01, (240, 6)), 4)
    vectors = frame(spark, list(enumerate(data.tolist())))
    kept = np.array([r.features for r in vectors.orderBy("id").collect()])
    out = lists.nearest_rows(vectors, vectors.filter("id % 10 = 0"), k=10, list_rows=4, ratio=1.05).collect()
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append(r.entry_id)
    assert set(found) == set(range(0, 240, 10)) and all(len(v) == 10 for v in found.values())
    truth = exact(kept, list(range(240)), found, 10)
    assert np.mean([len(set(found[q]) & {i for _, i in truth[q]}) / 10 for q in found]) >= 0.9
    few = lists.nearest_rows(vectors.filter("id < 6"), vectors.filter("id = 0"), k=10, list_rows=2).collect()
    assert [r.rank for r in few] == [1, 2, 3, 4, 5]
