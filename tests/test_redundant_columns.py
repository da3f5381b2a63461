"""Twin columns by signatures against the correlations of all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.operators import metrics, preparation as P


def by_all_pairs(pdf):
    names = list(pdf.columns)
    constant = [c for c in names if pdf[c].nunique() <= 1]
    r = pdf.drop(columns=constant).corr().abs()
    left = list(r.columns)
    return constant + [b for j, b in enumerate(left) if any(abs(r.loc[a, b] - 1) < 1e-11 for a in left[:j])]


@pytest.mark.parametrize("gaps", [False, True])
def test_equal_to_all_pairs(spark, gaps):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({f"c{i}": rng.random(300) * 10.0 ** (i % 5) for i in range(12)})
    pdf["scaled"], pdf["mirror"], pdf["again"] = pdf.c3 * 7 + 1, 4 - pdf.c5 / 3, pdf.c3
    pdf["nearly"] = pdf.c7 + rng.random(300) * 1e-4 * pdf.c7.std()
    pdf["fixed"], pdf["far"] = 2.0, 1e6 + pdf.c1
    if gaps:
        pdf["holes"] = pdf.c2.where(rng.random(300) < 0.8)
        pdf["other_holes"] = (1 - pdf.c2).where(rng.random(300) < 0.8)
        pdf["empty"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf)).repartition(4)
    found = P.redundant_columns(df, list(pdf.columns))
    assert sorted(found) == sorted(by_all_pairs(pdf))
    assert {"scaled", "mirror", "again", "far", "fixed"} <= set(found) and "nearly" not in found
    assert ("holes" in found and "other_holes" in found and "empty" in found) == gaps


def test_small_tables(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 3.0, 9.0)], "a double, b double, c double")
    assert P.redundant_columns(df, ["a", "b", "c"]) == ["b", "c"]
    assert P.redundant_columns(df.limit(0), ["a", "b"]) == ["a", "b"]
    assert P.redundant_columns(df.limit(1), ["a", "b"]) == ["a", "b"]
    assert P.drop_redundant(df, ["a"]).columns == ["a", "b", "c"]


def test_a_thousand_columns_without_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.random((60, 800))
    wide = np.hstack([base, base[:, :150] * -2 + 1, np.tile(base[:, :1], 50)])
    columns = [f"c{i}" for i in range(1000)]
    rows = spark.createDataFrame([(r.tolist(),) for r in wide], "v array<double>").repartition(3)
    df = rows.select(*[F.col("v")[i].alias(c) for i, c in enumerate(columns)])
    asked = []
    exact = metrics.corr_pairs
    monkeypatch.setattr(P, "corr_pairs", lambda d, pairs: asked.append(len(pairs)) or exact(d, pairs))
    assert P.redundant_columns(df, columns) == columns[800:]
    assert sum(asked) <= 400
