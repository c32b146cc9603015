"""Tests from sums over lags against regressions on whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.functions import kernels as k
from tidewright.operators import moments


def series():
    rng = np.random.default_rng(2)
    walk = 100 + rng.normal(size=500).cumsum()
    calm = np.zeros(260)
    for i in range(1, 260):
        calm[i] = 0.6 * calm[i - 1] + rng.normal()
    return {"walk": walk, "calm": 50 + calm, "short": 10 + rng.normal(size=30), "tiny": np.arange(5.0)}


@pytest.fixture(scope="module")
def frame(spark):
    parts = [pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=len(x), freq="h"), "close_adj": x}) for s, x in series().items()]
    df = spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1))
    holes = df.limit(3).select("symbol", F.expr("ts + INTERVAL 7 MINUTES").alias("ts"), F.lit(None).cast("double").alias("close_adj"))
    return df.unionByName(holes)  # missing values are left out


def test_unit_roots_of_all_orders(frame):
    orders = [0.0, 0.05, 0.4, 1.0]
    got = {(r["symbol"], r["d"]): r for r in moments.unit_roots(frame, orders=orders).collect()}
    for s, x in series().items():
        for d in orders:
            y = k.difference(x, k.difference_weights(d, min(100, len(x) // 2))) if d else x
            if len(y) < 8:
                assert (s, d) not in got
                continue
            stat, p = k.adf(y)
            assert got[s, d]["n"] == len(y) and got[s, d]["stat"] == pytest.approx(stat, rel=1e-7) and got[s, d]["p"] == pytest.approx(p, abs=1e-7)


def test_optimal_orders(frame):
    got = {r["symbol"]: r for r in moments.optimal_orders(frame).collect()}
    for s, x in series().items():
        if len(x) >= 8:
            d, p, _ = k.optimal_difference(x)
            assert got[s]["optimal_d"] == pytest.approx(d) and got[s]["adf_p"] == pytest.approx(p, abs=1e-7)


def test_arch_and_fluctuation(frame):
    df = frame.withColumn("log_return", F.col("close_adj") / 100)
    arch = {r["symbol"]: r for r in moments.arch_lm(df).collect()}
    hurst = {r["symbol"]: r for r in moments.fluctuation(df).collect()}
    for s, x in series().items():
        if len(x) > 20:
            assert arch[s]["p"] == pytest.approx(k.arch_lm(x / 100), abs=1e-7)
        assert hurst[s]["hurst"] == pytest.approx(k.hurst_dfa(x / 100), rel=1e-9)


def test_granger_equals_regressions(spark):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=200), rng.normal(size=200)
    y = 0.5 * np.roll(x, 2) + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "ts": pd.date_range("2024-01-01", periods=200, freq="h"), "x": x, "z": z, "y": y}))
    got = {}
    for r in moments.granger(df, ["x", "z"], "y", lags=3).collect():
        got.setdefault(r["feature"], {})[r["lag"]] = r["p"]
    for name, v in (("x", x), ("z", z)):
        best, lag = k.granger(v, y, 3)
        assert min(got[name].values()) == pytest.approx(best, abs=1e-9) and min(got[name], key=got[name].get) == lag
    assert min(got["x"].values()) < 1e-6 and len(got["z"]) == 3


def test_no_python_group_holds_a_series(frame):
    for df in (moments.unit_roots(frame), moments.arch_lm(frame.withColumn("log_return", F.col("close_adj")))):
        assert "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_stationarity_and_variance_ratios(frame):
    got = {r["symbol"]: r for r in moments.stationarity(frame).collect()}
    ratios = {(r["symbol"], r["steps"]): r for r in moments.variance_ratios(frame).collect()}
    for s, x in series().items():
        stat, p = k.kpss(x)
        assert got[s]["stat"] == pytest.approx(stat, rel=1e-9) and got[s]["p"] == pytest.approx(p, abs=1e-9)
        for steps in (3, 20):
            if len(x) - 1 >= steps + 2:
                want = k.variance_ratio(x, steps)
                assert (ratios[s, steps]["ratio"], ratios[s, steps]["z"]) == pytest.approx(want[:2], rel=1e-9)
            else:
                assert (s, steps) not in ratios
