"""Order statistics and shuffles against sorted lists."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import order


@pytest.mark.parametrize("bound, parts", [(1 << 16, 1 << 10), (3, 4), (1, 2)])
def test_quantiles_equal_numpy(spark, bound, parts):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"a": rng.normal(size=500), "b": rng.integers(0, 4, 500).astype(float), "c": rng.standard_cauchy(500) ** 3, "d": np.full(500, 7.0), "e": [1e308, -1e308, 3.0, 4.0] * 125})
    df = spark.createDataFrame(data).repartition(5)
    shares = [0.0, 0.1, 0.5, 0.777, 1.0]
    got = order.quantiles(df, list(data), shares, bound, parts)
    for c in data:
        np.testing.assert_allclose(got[c], np.quantile(data[c], shares), rtol=1e-12)


def test_quantiles_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (3.0, None, 2.0), (None, None, float("nan"))], "a double, `n.n` double, z double")
    assert order.quantiles(df, ["a", "n.n", "z"], [0.5, 0.25]) == {"a": [2.0, 1.5], "n.n": [None, None], "z": [2.0, 2.0]}
    assert order.quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
    assert order.quantiles(spark.range(5), ["id"], [0.5], bound=1, parts=2) == {"id": [2.0]}


def test_places_span_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [("big", i) for i in range(300)] + [("small", 5), (None, 1), (None, 2), ("tie", 4), ("tie", 4)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(6)
    got = sorted((r["g"] or "", r["n"], r["x"]) for r in order.placed(df, "g", [F.col("x")], "n").collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [("big", i + 1, i) for i in range(300)] + [("small", 1, 5), ("", 1, 1), ("", 2, 2), ("tie", 1, 4), ("tie", 2, 4)]
    assert got == sorted(want)


def test_a_shuffle_keeps_groups_and_windows_hold_none(spark):
    df = spark.createDataFrame([(f"s{i % 3}", i // 50, i, float(i)) for i in range(200)], "symbol string, fold int, ts long, x double")
    out = order.shuffled(df, "x", keys=("symbol", "ts"))
    got = out.toPandas()
    for fold, g in got.groupby("fold"):
        assert sorted(g["x"]) == [float(i) for i in range(50 * fold, 50 * fold + 50)] and (g["x"] != g["ts"]).sum() > 40
    assert got.sort_values("ts")["x"].tolist() == order.shuffled(df.repartition(9), "x").toPandas().sort_values("ts")["x"].tolist()
    for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines():
        if "row_number" in line and "Window" in line:
            assert "__part" in line
