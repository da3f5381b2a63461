"""Sliced scans, exact quantiles, hot groups and stored tables against plain numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.kernels import scan
from foldwise.kernels.lookup import attach_row, lookup
from foldwise.kernels.quantiles import exact_quantiles, quantile_name
from foldwise.kernels.store import materialize


@pytest.fixture
def sliced(monkeypatch):
    monkeypatch.setattr(scan, "SMALL_TABLE", 0)


def sample(n=4000, seed=3):
    rng = np.random.default_rng(seed)
    value = np.where(rng.random(n) < 0.34, 7.0, np.round(rng.normal(0, 50, n), 1))
    return pd.DataFrame({"id": np.arange(n), "g": rng.integers(0, 3, n), "v": value, "w": rng.integers(0, 9, n)})


def test_sliced_number_scan(spark, sliced):
    pdf = sample().groupby(["g", "v"], as_index=False)["w"].sum()
    out = scan.value_scan(spark.createDataFrame(pdf), ["g"], "v", {"before": F.col("w")}).toPandas()
    pdf = pdf.sort_values(["g", "v"])
    pdf["before"] = pdf.groupby("g")["w"].cumsum() - pdf["w"]
    merged = out.merge(pdf, on=["g", "v"], suffixes=("", "_x"))
    assert len(merged) == len(pdf) == len(out)
    assert (merged.before == merged.before_x).all()


def test_sliced_text_scan(spark, sliced):
    words = sorted({f"Customer#{i * i % 9973:05d}" for i in range(3000)} | {"", "é", "zz"}, key=str.encode)
    df = spark.createDataFrame(pd.DataFrame({"k": words}))
    out = scan.value_scan(df, [], "k", {"code": F.lit(1)}).toPandas().set_index("k")["code"]
    assert [out[w] for w in words] == list(range(len(words)))


def test_small_and_sliced_paths_agree(spark, monkeypatch):
    pdf = sample().drop_duplicates("v")
    plain = scan.value_scan(spark.createDataFrame(pdf), [], "v", {"b": F.col("w")}).toPandas().sort_values("v")
    monkeypatch.setattr(scan, "SMALL_TABLE", 0)
    cut = scan.value_scan(spark.createDataFrame(pdf), [], "v", {"b": F.col("w")}).toPandas().sort_values("v")
    assert plain.b.tolist() == cut.b.tolist()


def test_slices_do_not_exceed_their_share(spark, sliced):
    df = spark.range(20000).select((F.col("id") * 1.5).alias("v"))
    splits = scan.split_points(df, F.col("v"), 8)
    sizes = [r["count"] for r in scan.add_slices(df, F.col("v"), splits).groupBy(scan.SLICE).count().collect()]
    assert max(sizes) < 20000 / 8 * 1.6


def test_exact_quantiles(spark, sliced):
    pdf = sample()
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    row = exact_quantiles(spark.createDataFrame(pdf), ["v", "w"], qs).first()
    for c in ("v", "w"):
        for q in qs:
            assert row[quantile_name(c, q)] == pytest.approx(np.quantile(pdf[c], q), abs=1e-9)
    grouped = exact_quantiles(spark.createDataFrame(pdf), ["v"], [0.3], ["g"]).toPandas()
    for _, r in grouped.iterrows():
        assert r[quantile_name("v", 0.3)] == pytest.approx(np.quantile(pdf[pdf.g == r.g].v, 0.3), abs=1e-9)


def test_hot_groups_are_cut(spark):
    pdf = sample()
    pdf["k"] = np.where(pdf.id % 3 == 0, -1, pdf.id % 400)
    df, cut = scan.slice_hot_groups(spark.createDataFrame(pdf), ["k"], F.col("id"), 200)
    slices = df.groupBy("k").agg(F.countDistinct(scan.SLICE).alias("n")).toPandas().set_index("k")["n"]
    assert cut and slices[-1] > 3 and (slices.drop(-1) == 1).all()
    _, uncut = scan.slice_hot_groups(spark.createDataFrame(pdf), ["k"], F.col("id"), 10_000)
    assert not uncut


def test_lookup_null_keys_and_defaults(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    table = spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, v double")
    out = {r.id: r.v for r in lookup(df, table, ["k"], {"v": -1.0}).collect()}
    assert out == {1: 1.0, 2: 2.0, 3: -1.0}


def test_one_row_statistics_are_no_join(spark):
    df = spark.range(10)
    plan = attach_row(df, df.agg(F.max("id").alias("top")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_stored_table_is_broadcast_by_size_only(spark):
    small = materialize(spark.range(100).select("id", (F.col("id") * 2).alias("v")))
    big = spark.range(100000)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(lookup(big, small, ["id"]))
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        assert "SortMergeJoin" in plan(lookup(big, small, ["id"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
