"""Recursions over ranges against plain recursions of whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.functions import kernels as k
from tidewright.operators import labels, recursive, regimes

SIZES = {"a": 400, "b": 1, "c": 3, "d": 900, "e": 50}


@pytest.fixture(scope="module")
def series():
    rng, parts = np.random.default_rng(1), []
    for s, n in SIZES.items():
        x = 100 + rng.normal(size=n).cumsum()
        x[rng.random(n) < 0.2] = np.nan
        if s == "e":
            x[:30] = np.nan
        parts.append(pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "x": x, "row": np.arange(n)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def many_ranges(spark):
    """Ranges that cut symbols, and batches that cut ranges."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    for c, v in zip(old, ("5", "37", "false")):
        spark.conf.set(c, v)
    yield spark
    for c, v in old.items():
        spark.conf.set(c, v)


@pytest.fixture(scope="module")
def frame(many_ranges, series):
    df = many_ranges.createDataFrame(series.sample(frac=1, random_state=2))
    return df.withColumn("x", F.nanvl("x", F.lit(None).cast("double")))


def back(df):
    return df.toPandas().sort_values(["symbol", "ts"])


def test_means_of_ranges(frame, series):
    got = back(recursive.ema(frame, {"m12": ("x", 12), "m1": ("x", 1), "m26": ("x", 26)}))
    for name, span in (("m12", 12), ("m1", 1), ("m26", 26)):
        want = series.groupby("symbol").x.transform(lambda v: v.ewm(span=span, adjust=False).mean())
        np.testing.assert_allclose(got[name].to_numpy(float), want, rtol=1e-12)
    assert got["row"].tolist() == series["row"].tolist()


@pytest.mark.parametrize("lag", [0, 1])
def test_deviations_of_ranges(frame, series, lag):
    got = back(recursive.ewm_std(frame, "x", 20, "s", lag=lag, floor=0.01 if lag else None))
    want = series.groupby("symbol").x.transform(lambda v: pd.Series(recursive.ewm_std_values(v, 20), index=v.index).shift(lag))
    np.testing.assert_allclose(got["s"].to_numpy(float), want.fillna(0.01).clip(lower=0.01) if lag else want, rtol=1e-10)


@pytest.mark.parametrize("n", [1, 5, 700])
def test_following_rows_come_from_later_ranges(frame, n):
    for r in recursive.with_following(frame, ["ts", "row"], n, "next").collect():
        assert [q["row"] for q in r["next"]] == list(range(r["row"] + 1, min(r["row"] + n + 1, SIZES[r["symbol"]])))


def test_no_group_or_window_holds_a_symbol(frame):
    bars = frame.where("x IS NOT NULL").select("symbol", "ts", F.col("x").alias("close_adj"), (F.col("x") / 1000).alias("log_return"))
    plan = labels.triple_barrier(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "Window" in plan
    for line in plan.splitlines():
        if "Window" in line:
            assert "__part" in line or "sum(rows" in line, line  # of a range, or over one row a range


# --- regimes


def plain_filter(x, mean, var, stay):
    a = np.array([[stay[0], 1 - stay[0]], [1 - stay[1], stay[1]]])
    p, out = np.array([1 - stay[1], 1 - stay[0]]) / (2 - stay[0] - stay[1]), []
    for v in x:
        p = p @ a * np.exp(-0.5 * (v - np.array(mean)) ** 2 / np.array(var)) / np.sqrt(var)
        p = p / p.sum()
        out.append(p[1])
    return np.array(out)


def plain_moments(x, chain):
    """Of expectation maximisation, by forward and backward loops."""
    f = np.exp(-0.5 * (x[:, None] - chain.mean) ** 2 / chain.var) / np.sqrt(chain.var)
    n, p, ahead = len(x), chain.lasting(), []
    for t in range(n):
        p = p @ chain.moves * f[t]
        p = p / p.sum()
        ahead.append(p)
    back = [np.ones(2)]
    for t in range(n - 1, 0, -1):
        b = chain.moves @ (f[t] * back[-1])
        back.append(b / b.sum())
    back = back[::-1]
    state, moves = np.zeros((n, 2)), np.zeros((2, 2))
    for t in range(n):
        state[t] = ahead[t] * back[t] / (ahead[t] * back[t]).sum()
        before = ahead[t - 1] if t else chain.lasting()
        m = before[:, None] * chain.moves * (f[t] * back[t])[None]
        moves += m / m.sum()
    return np.concatenate([state.sum(0), state.T @ x, state.T @ x**2, moves.ravel()])


def switching(n, seed):
    rng, state, out = np.random.default_rng(seed), 0, []
    for _ in range(n):
        state = state if rng.random() < (0.97, 0.93)[state] else 1 - state
        out.append(rng.normal((0.0005, -0.001)[state], (0.005, 0.02)[state]))
    return np.array(out)


def test_a_chain_step_equals_loops():
    x, chain = switching(300, 4), k.Chain([0.001, -0.002], [2e-5, 5e-4], [0.9, 0.8])
    for cut in ((300,), (1, 299), (100, 1, 199)):
        parts = np.split(x, np.cumsum(cut)[:-1])
        before, after = k.chain_messages(chain, [chain.map_of(p) for p in parts])
        total = sum(chain.moments(p, b, a) for p, b, a in zip(parts, before, after))
        np.testing.assert_allclose(total, plain_moments(x, chain), rtol=1e-9)
        np.testing.assert_allclose(np.concatenate([chain.filtered(p, b)[:, 1] for p, b in zip(parts, before)]), plain_filter(x, chain.mean, chain.var, chain.stay), atol=1e-10)


def test_fit_finds_the_chain():
    chain = k.fit_chain(switching(20_000, 5))
    assert abs(np.sqrt(chain.var) - [0.005, 0.02]).max() < 0.001 and abs(chain.stay - [0.97, 0.93]).max() < 0.02
    assert k.fit_chain(np.zeros(100)) is None and k.fit_chain(np.arange(5.0)) is None


@pytest.fixture(scope="module")
def returns(many_ranges):
    rows = [pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=len(x), freq="h"), "log_return": x}) for s, x in (("a", switching(500, 6)), ("b", switching(300, 7)), ("flat", np.zeros(60)), ("few", switching(5, 8)))]
    return many_ranges.createDataFrame(pd.concat(rows).sample(frac=1, random_state=3))


def test_regimes_equal_a_scalar_filter(returns):
    chains = {r["symbol"]: r for r in regimes.fit(returns).collect()}
    assert set(chains) == {"a", "b"}
    got = back(regimes.regimes(returns))
    for s, seed, n in (("a", 6, 500), ("b", 7, 300)):
        c = chains[s]
        np.testing.assert_allclose(got[got.symbol == s][regimes.HIGH], plain_filter(switching(n, seed), c["mean"], c["var"], c["stay"]), atol=1e-8)
    flat, few = got[got.symbol == "flat"], got[got.symbol == "few"]
    assert (flat[regimes.HIGH] == 0).all() and (few[regimes.LOW] == 1).all() and len(flat) == 60 and len(few) == 5


def test_long_symbols_are_fitted_in_ranges_alike(returns):
    alone = {r["symbol"]: r for r in regimes.fit(returns, steps=4).collect()}
    ranged = {r["symbol"]: r for r in regimes.fit(returns, steps=4, in_task=0).collect()}
    assert set(alone) == set(ranged)
    for s, r in alone.items():
        for field in ("mean", "var", "stay"):
            np.testing.assert_allclose(ranged[s][field], r[field], rtol=1e-9, atol=1e-15)


def test_symbols_without_a_chain_go_by_deviation(returns):
    x = switching(300, 7)
    got = back(regimes.by_deviation(returns.where("symbol = 'b'")))
    d = pd.Series(x).rolling(20).std()
    assert (got[regimes.HIGH].to_numpy() == (d > d.median()).to_numpy().astype(float)).all()


def test_conditioned_information_equals_loops(spark):
    rng = np.random.default_rng(9)
    y, p = rng.integers(0, 2, 400), rng.random(400)
    x = np.where(p > 0.5, y + rng.normal(size=400), rng.normal(size=400))
    z = rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "target_label": y, regimes.HIGH: p, "x": x, "z": z}))
    got = {r["feature"]: r for r in regimes.conditioned_information(df, ["x", "z"]).collect()}
    for name, v in (("x", x), ("z", z)):
        for column, mask in (("mi_high_vol", p > 0.5), ("mi_low_vol", p <= 0.5), ("mi_all", p >= 0)):
            assert abs(got[name][column] - k.mutual_information(v[mask], y[mask])) < 1e-9
        assert got[name]["accepted"] == (got[name]["mi_high_vol"] > 0.01 or got[name]["mi_low_vol"] > 0.01)
    assert got["x"]["mi_high_vol"] > 0.05
