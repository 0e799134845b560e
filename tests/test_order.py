"""Exact quantiles of many, of equal and of very uneven values, with bins forced to be refined."""

import numpy as np
import pytest

from tessella.operators.order import quantiles


@pytest.mark.parametrize("limit", [50_000, 40])
def test_quantiles(spark, limit):
    rnd = np.random.default_rng(1)
    groups = {
        "wide": np.exp(rnd.uniform(-300, 300, 3000)) * rnd.choice([-1, 1], 3000),
        "ties": rnd.choice([1.0, 2.0, 2.5], 2000, p=[0.5, 0.499, 0.001]),
        "same": np.full(500, 7.0),
        "one": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
        "some": rnd.normal(0, 1, 777),
    }
    rows = [(k, float(v), 1) for k, vs in groups.items() for v in vs] + [("none", None, 1), ("nan", float("nan"), 1), (None, 4.0, 1), ("some", None, 2), ("some", float("nan"), 2)]
    df = spark.createDataFrame(rows, "g string, v double, p int").repartition(7)
    fractions = [0.0, 0.01, 0.25, 0.5, 0.9137, 0.99, 1.0]
    got = {r.g: r.p for r in quantiles(df.where("g is not null"), ["g"], "v", fractions, limit).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile(vs, fractions), rtol=1e-12, atol=0), k
    assert quantiles(df.where("g = 'nan'"), ["g"], "v", fractions, limit).count() == 0


def test_one_huge_group(spark):
    """All values are in one group, which no task holds."""
    df = spark.range(400_000).selectExpr("0L as g", "cast((id * 7919) % 400009 as double) as v")
    v = (np.arange(400_000) * 7919) % 400_009
    got = quantiles(df, ["g"], "v", [0.02, 0.5, 0.98], limit=5000).first().p
    assert np.allclose(got, np.quantile(v, [0.02, 0.5, 0.98]))
