"""Optimal partitions against trying every partition, and the edge cases of the binning built on them."""

from itertools import combinations

import numpy as np
import pytest

from foldwise.operators import optimal_bins as O


def brute(n, events, max_bins, least):
    positives, negatives, best = events.sum(), (n - events).sum(), None
    for size in range(max_bins):
        for cuts in combinations(range(1, len(n)), size):
            parts = np.split(np.arange(len(n)), cuts)
            rows, hits = np.array([n[p].sum() for p in parts]), np.array([events[p].sum() for p in parts])
            steps = np.diff(hits / rows)
            if (rows < least).any() or not ((steps >= 0).all() or (steps <= 0).all()):
                continue
            value = O.woe_of(rows, hits, positives, negatives)[1].sum()
            if best is None or value > best + 1e-12:
                best = value
    return best


@pytest.mark.parametrize("seed", range(12))
def test_partition_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 60, 11).astype(float)
    events = np.floor(rng.random(11) * (n + 1))
    least, bins = (0.0, 5) if seed % 2 else (0.1 * n.sum(), 4)
    cuts = O.optimal_partition(n, events, events.sum(), (n - events).sum(), bins, least)
    parts = np.split(np.arange(11), cuts)
    rows, hits = np.array([n[p].sum() for p in parts]), np.array([events[p].sum() for p in parts])
    assert len(parts) <= bins and (rows >= least).all()
    assert (np.diff(hits / rows) >= 0).all() or (np.diff(hits / rows) <= 0).all()
    assert O.woe_of(rows, hits, events.sum(), (n - events).sum())[1].sum() == pytest.approx(brute(n, events, bins, least), abs=1e-12)


def test_categories_by_rate_are_best_of_all_groupings():
    rng = np.random.default_rng(9)
    n = rng.integers(5, 50, 6).astype(float)
    events = 1 + np.floor(rng.random(6) * (n - 1))
    order = np.lexsort([np.arange(6), events / n])
    cuts = O.optimal_partition(n[order], events[order], events.sum(), (n - events).sum(), 3, 0, (1,))
    value = lambda groups: sum(O.woe_of(np.array([n[g].sum()]), np.array([events[g].sum()]), events.sum(), (n - events).sum())[1][0] for g in groups)
    own = value([order[p] for p in np.split(np.arange(6), cuts)])
    every = max(value([np.flatnonzero(np.array(code) == k) for k in set(code)]) for code in np.ndindex(*[3] * 6))
    assert own == pytest.approx(every)


def test_awkward_columns(spark):
    rows = [(k, None if k % 3 else float(k % 7), None, "a" if k % 2 else "b", 1.0, k % 5 == 0) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, gone double, c string, flat double, y boolean").withColumn("y", spark_int("y"))
    numbers, categories = ["x", "gone", "flat"], ["c"]
    cuts, table = O.optimal_bins(df, numbers, categories, "y", prebins=6, max_bins=3)
    found = {(r.column, r.bin): r for r in O.bin_table(table).collect()}
    assert found["gone", -1].n == 200 and found["flat", 0].n == 200 and found["flat", 0].iv == 0
    assert {b for c, b in found if c == "x"} <= {-1, 0, 1, 2} and found["x", -1].n == 133
    assert O.optimal_woe(df, cuts, table, [*numbers, *categories]).filter("gone_woe <> 0 or x_woe is null or c_woe is null").count() == 0
    unseen = spark.createDataFrame([(1, 2.0, 3.0, "zzz", None, None)], df.schema)
    assert O.optimal_woe(unseen, cuts, table, ["c", "gone", "flat"]).first().c_woe == 0
    for part in (df.filter("y = 1"), df.limit(0), df.filter("y is null")):
        one, own = O.optimal_bins(part, numbers, categories, "y")
        assert own.filter("woe is not null or iv is not null or bin > 0").count() == 0
        assert O.optimal_woe(df, one, own, numbers).count() == 200
    ranked = {r.column: r.iv for r in O.optimal_iv_ranking(O.optimal_bins_2d(df, [("x", "c"), ("c", "flat")], numbers, "y")[1]).collect()}
    assert ranked.keys() == {"x*c", "c*flat"} and all(v >= 0 for v in ranked.values())


def spark_int(name):
    from pyspark.sql import functions as F

    return F.col(name).cast("int")


def test_many_values_fall_into_the_rest(spark):
    df = spark.createDataFrame([(f"v{k}" if k % 2 else "often", int(k % 4 == 0)) for k in range(400)], "c string, y int")
    cuts, table = O.optimal_bins(df, [], ["c"], "y", prebins=5)
    assert cuts.values == {"c": ["often"]} and {r.code for r in table.collect()} == {0, 1}
