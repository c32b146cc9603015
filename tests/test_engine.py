"""Invariants of the engine, kernels against pandas, and some queries against their SQL."""

import datetime as dt
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright import plans
from tidewright.functions import kernels
from tidewright.functions import kernels as k
from tidewright.operators import cv, features, labels, metrics, model, pipeline, selection, trading
from tidewright.operators.recursive import ewm_std_values

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def walk(n=80, seed=3):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2022-01-01", periods=n), "open": close * 1.001, "high": close * 1.02, "low": close * 0.98, "close": close, "volume": rng.integers(1000, 5000, n).astype(float), "mkt_return": rng.normal(0, 0.01, n)})
    for c in ("open", "high", "low", "close"):
        pdf[f"{c}_adj"] = pdf[c]
    pdf["log_return"] = np.log(pdf["close"] / pdf["close"].shift())
    return pdf.astype(object).where(pdf.notna(), None)


SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, mkt_return double, open_adj double, high_adj double, low_adj double, close_adj double, log_return double"


@pytest.mark.parametrize("name", ["feat_volatility", "feat_directional", "triple_barrier", "trade_lockout", "purge_embargo", "roc_auc", "portfolio_weighted_sum"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = plans.queries()[name](spark, DATA).toPandas(), con.execute(plans.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    keys = [c for c in cols if not pd.api.types.is_float_dtype(got[c])] or cols
    got, want = (x[cols].sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in cols:
        if pd.api.types.is_float_dtype(got[c]):
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=2e-6, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_features_do_not_see_their_own_bar(spark):
    pdf = walk()
    shocked = pdf.copy()
    shocked.loc[50, "close_adj"] = shocked.loc[50, "close_adj"] * 2
    shocked.loc[50, "volume"] = shocked.loc[50, "volume"] * 10
    at = pdf.loc[50, "ts"]
    rows = []
    for p in (pdf, shocked):
        records = [{**r, "ts": r["ts"].to_pydatetime()} for r in p.to_dict("records")]
        df, names = features.route(spark.createDataFrame(records, SCHEMA))
        out = df.select("ts", *names).where(F.col("ts").isin(at.to_pydatetime(), pdf.loc[0, "ts"].to_pydatetime())).orderBy("ts").collect()
        assert all(out[0][n] is None for n in names)
        rows.append(out[1])
    for n in names:
        a, b = rows[0][n], rows[1][n]
        assert a is b is None or float(a) == pytest.approx(float(b), rel=1e-6), n


def test_triple_barrier_by_hand(spark):
    prices = [100, 100, 100, 103, 100, 97, 100, 100, 100, 100]
    rows = [("A", f"2024-01-{i + 1:02d}", float(p)) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "symbol string, d string, close_adj double").withColumn("ts", F.to_timestamp("d")).withColumn("log_return", F.lit(0.0))
    got = labels.triple_barrier(df, horizon=3, floor=0.02).orderBy("ts").collect()
    assert [r["target_label"] for r in got] == [1, 1, 1, 0, 0, 1, 0, None, None, None]
    assert got[0]["barrier_touch_time"] == got[3]["ts"] and got[6]["barrier_touch_time"] == got[9]["ts"]


def test_lockout(spark):
    rows = [("A", 1, 3, 1), ("A", 2, 4, 1), ("A", 3, 5, 1), ("A", 4, None, 0), ("A", 5, None, 1), ("A", 6, 7, 1)]
    df = spark.createDataFrame(rows, "symbol string, i int, u int, pred_signal int").selectExpr("symbol", "pred_signal", "timestamp_seconds(i) ts", "timestamp_seconds(u) barrier_touch_time")
    assert [r["executed_signal"] for r in trading.locked_out(df).orderBy("ts").collect()] == [1, 0, 1, 0, 1, 0]


def test_purged_gap(spark):
    df = spark.range(300).selectExpr("'A' symbol", "timestamp_seconds(id * 86400) ts", "timestamp_seconds((id + 4) * 86400) barrier_touch_time")
    gaps = cv.leakage_gap(cv.purged(df, max_train=120)).collect()
    assert len(gaps) == 5 and all(g["gap_seconds"] > 5 * 86400 for g in gaps)


def test_kernels():
    rng = np.random.default_rng(42)
    x = pd.Series(rng.normal(size=200))
    x[5] = np.nan
    want = x.ewm(span=20, min_periods=2).std().to_numpy()
    got = ewm_std_values(x.to_numpy(), 20)
    ok = ~np.isnan(x.to_numpy())
    assert np.allclose(got[ok], want[ok], equal_nan=True)
    assert k.difference_weights(0.4)[:3] == pytest.approx([1, -0.4, 0.4 * -0.6 / 2])
    price = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.015, 600)))
    assert k.adf(price)[1] > 0.05 and k.adf(rng.normal(size=500))[1] < 0.01
    d, p, corr = k.optimal_difference(price)
    assert 0 < d <= 1 and p < 0.05
    assert k.f_sf(3.0, 2, 30) == pytest.approx(0.06494, abs=1e-4) and k.chi2_sf(11.07, 5) == pytest.approx(0.05, abs=1e-4)
    f = rng.normal(size=(200, 2)) * [1, 2]
    y = (rng.random(200) < 1 / (1 + np.exp(-(0.8 * f[:, 0] - 0.5 * f[:, 1])))).astype(float)
    a, b = k.bounded_platt(f @ k.logistic(f, y)[:2], y)
    assert 0.1 <= a <= 2.5 and -1.5 <= b <= 1.5
    assert k.vif_kept(np.array([[1, 0.99, 0], [0.99, 1, 0], [0, 0, 1.0]])) == [1, 2]
    assert k.average_linkage(np.array([[0, 0.1, 0.9], [0.1, 0, 0.9], [0.9, 0.9, 0]]), 0.5) == [0, 0, 1]


def test_stream_of_bars(spark, tmp_path):
    from tidewright.sources.bars import event_bars
    from tidewright.streaming.bars import read_ticks, stream_bars

    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(str(tmp_path / "e"))
    q = stream_bars(read_ticks(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bars").count() == event_bars(spark, DATA).count()


def test_bds_sees_the_whole_series():
    """Blocks give what the whole matrix gives; a dependence that ended long ago is found; AR(1) alone is none."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=301)
    near = np.abs(x[:, None] - x[None]) < 1.5 * x.std(ddof=1)
    mean = lambda a: a[np.triu_indices(len(a), 1)].mean()
    n, c, rows = 301, mean(near), near.sum(axis=1) - 1
    cube = (rows * (rows - 1)).sum() / (n * (n - 1) * (n - 2))
    var = 4 * (cube**2 + 2 * cube * c**2 + c**4 - 4 * cube * c**2)
    assert k.bds(x, block=64)[0] == pytest.approx(300**0.5 * (mean(near[:-1, :-1] & near[1:, 1:]) - mean(near[1:, 1:]) ** 2) / var**0.5)
    wild = rng.normal(size=3000) * np.repeat(rng.choice([0.2, 3.0], 30), 100)
    late = np.concatenate([wild, rng.normal(size=2000)])
    from tidewright.operators.diagnostics import _one

    bars = pd.DataFrame({"symbol": "A", "ts": range(5001), "close_adj": 100 * np.exp(np.cumsum(np.append(0, late)) / 1000), "log_return": np.append(np.nan, late / 1000)})
    assert _one(bars)["bds_p"][0] < 0.001
    ar = np.zeros(1500)
    for i in range(1, 1500):
        ar[i] = 0.6 * ar[i - 1] + rng.normal()
    assert k.bds(ar)[1] < 0.001 < k.bds(k.ar1_residuals(ar))[1]


def test_metrics_and_votes_take_all(spark, monkeypatch):
    from tidewright.operators import selection
    from tidewright.plans import core_queries

    got = plans.queries()["risk_metrics_by_fold"](spark, DATA).toPandas()
    whole = plans.queries()["risk_metrics"](spark, DATA).toPandas().set_index("symbol")
    total = got[got["label"] == "Full OOS"].set_index("symbol")
    assert len(whole) > 1 and sorted(total.index) == sorted(whole.index)
    assert (total["total_trades"] == whole["total_trades"].reindex(total.index)).all() and np.allclose(total["max_drawdown"], whole["max_drawdown"].reindex(total.index))
    assert got.groupby("symbol")["label"].nunique().min() > 1
    voted = []
    monkeypatch.setattr(selection, "votes", lambda df, names: voted.extend(names))
    core_queries.consensus_vote(spark, DATA)
    assert voted == core_queries.CANDIDATES


def test_auc_in_ranges(spark):
    from tidewright.operators import metrics

    rng = np.random.default_rng(9)
    p = np.round(rng.random(4000), 5)
    y = (rng.random(4000) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y}))
    ranks = pd.Series(p).rank().to_numpy()
    want = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (4000 - y.sum()))
    out = metrics.roc_auc(df)
    assert out.first()["auc"] == pytest.approx(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(range" in plan and "windowspecdefinition(p" not in plan
    assert metrics.roc_auc(df.limit(0)).first()["auc"] is None


def daily_bars(spark, n=200, seed=3):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    rows = []
    for i, c in enumerate(close):
        o, h, l = c * (1 + rng.uniform(-0.01, 0.01)), c * (1 + rng.uniform(0.01, 0.03)), c * (1 - rng.uniform(0.01, 0.03))  # noqa: E741
        rows.append(("A", dt.datetime(2022, 1, 1) + dt.timedelta(days=i), float(o), float(h), float(l), float(c), float(rng.integers(1000, 5000)), int(rng.random() < 0.5)))
    return rows


BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, target_label int"


def test_routed_features_do_not_see_their_own_bar(spark):
    """A shock at bar 50 leaves the routed features of bar 50 as they were; the first bar has none."""
    plain = daily_bars(spark, 80)
    shocked = [(*r[:2], *(x * 2 for x in r[2:6]), r[6] * 10, r[7]) if i >= 50 else r for i, r in enumerate(plain)]
    (a, names), (b, _) = (pipeline.stateless(spark.createDataFrame(x, BARS)) for x in (plain, shocked))
    x, y = (d.orderBy("ts").toPandas() for d in (a, b))
    assert len(names) >= 50 and x.loc[0, names].isna().all()
    assert np.allclose(x.loc[:50, names].to_numpy(float), y.loc[:50, names].to_numpy(float), equal_nan=True)
    assert not np.allclose(x.loc[51, names].to_numpy(float), y.loc[51, names].to_numpy(float), equal_nan=True)


def test_pipeline_model_is_read_as_written(spark, tmp_path):
    rows = daily_bars(spark, 260)
    rng = np.random.default_rng(1)
    rows = [(*r[:7], int(rows[i - 1][5] > rows[i - 1][2]) if i and rng.random() < 0.9 else r[7]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, BARS)
    columns = ["geo_body_ratio", "ret_3", "zscore_5", "rsi_14", "vol_parkinson", "cmf_20"]
    pipeline.fit(df, columns=columns).write(str(tmp_path))
    model_ = pipeline.FeatureModel.read(spark, str(tmp_path))
    found = model_.selected.first()
    assert 1 <= len(found["features"]) <= 4 and all(f.rsplit("_", 1)[0].removesuffix("_zscaled") in {*columns, "frac_diff_d"} for f in found["features"])
    out = model_.transform(df).where(f"feature = '{found['features'][0]}'").orderBy("ts").toPandas()
    assert len(out) == 260 and out["value"].notna().sum() > 150
    base, lag_ = found["features"][0].rsplit("_zscaled_lag", 1) if "_zscaled_lag" in found["features"][0] else (None, 0)
    if base and base != "frac_diff_d":
        x = pipeline.stateless(df)[0].orderBy("ts").toPandas()[base].shift(int(lag_))
        assert np.allclose(out["value"], (x - x.rolling(20).mean()) / (x.rolling(20).std() + 1e-8), equal_nan=True, atol=1e-6)


def test_conditional_difference_by_fitted_order(spark):
    rng = np.random.default_rng(42)
    price = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.015, 600)))
    d, p, memory = kernels.optimal_difference(price)
    assert kernels.adf(price)[1] > 0.05 and 0 < d <= 1 and p < 0.05 and memory > 0.3
    df = spark.createDataFrame([("A", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(price)], "symbol string, ts timestamp, close_adj double")
    orders = spark.createDataFrame([("A", float(d))], "symbol string, optimal_d double")
    got = features.fractional_of(df, orders).orderBy("ts").toPandas()["frac_diff_d"].to_numpy(float)
    w = kernels.difference_weights(d)
    want = [sum(w[k] * price[i - k] for k in range(min(len(w), i + 1))) if i >= 9 else np.nan for i in range(600)]
    assert np.allclose(got, want, equal_nan=True)
    assert features.fractional_of(df, orders.withColumn("optimal_d", F.lit(1.0))).where("frac_diff_d is not null").count() == 0


def test_platt_stays_in_bounds_and_keeps_order():
    rng = np.random.default_rng(42)
    x = np.column_stack([rng.normal(0, 1, 200), rng.normal(0, 2, 200)])
    y = (rng.random(200) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.5 * x[:, 1])))).astype(float)
    net = model.Calibrated().fit(x, y)
    assert 0.1 <= net.a <= 2.5 and -1.5 <= net.b <= 1.5
    p = net.probability(x)
    assert ((p >= 0) & (p <= 1)).all() and np.corrcoef(p, 1 / (1 + np.exp(-net.score(x))))[0, 1] > 0.99
    plain = model.Calibrated(method="none").fit(x, y)
    assert (plain.a, plain.b) == (1.0, 0.0)
    with pytest.raises(ValueError):
        model.Calibrated().fit(x[:60], y[:60])


def test_balanced_logistic_is_at_its_optimum(spark):
    """The gradient of the penalised, balanced loss is nil at what pyspark.ml fits, and the kernel gives the same."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1, -1, 0.5] + 1)))).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, t int")
    fitted = model.balanced_logistic(df, ["a", "b", "c"], "t")
    beta = np.append(np.array(fitted.coefficients), fitted.intercept)
    w = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (1 - y).sum()))
    m = np.column_stack([x, np.ones(400)])
    slope = m.T @ (w * (1 / (1 + np.exp(-m @ beta)) - y)) + np.append(beta[:3] / 0.03, 0)
    assert np.abs(slope).max() < 1e-3 and np.allclose(beta, kernels.logistic(x, y, 0.03), atol=1e-4)


def test_information_matches_plain_loops():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=150), (rng.random(150) < 0.5).astype(float)
    x[::7] = x[0]  # ties
    digamma = lambda v: sum(1 / i for i in range(1, int(v))) - 0.5772156649015329
    s, total = x / x.std(), 0.0
    for i in range(150):
        same = np.sort(np.abs(s[y == y[i]] - s[i]))
        radius = np.nextafter(same[3], 0)
        total += digamma(150) + digamma(3) - digamma((y == y[i]).sum()) - digamma(max(1, (np.abs(s - s[i]) <= radius).sum()))
    assert kernels.mutual_information(x, y) == pytest.approx(max(0, total / 150), abs=1e-6)
    free = rng.normal(size=150)
    assert kernels.mutual_information(free, (free > 0).astype(float)) > 0.5
    a = rng.normal(size=300)
    assert kernels.mutual_information_of_series(a, a + 0.1 * rng.normal(size=300)) > 1 and kernels.mutual_information_of_series(a, rng.normal(size=300)) < 0.2


def test_causality_and_dependence():
    rng = np.random.default_rng(11)
    x, e = rng.normal(size=400), rng.normal(size=400)
    y = np.concatenate([[0, 0], 0.8 * x[:-2]]) + 0.5 * e
    p, at = kernels.granger(x, y)
    assert p < 1e-6 and at == 2 and kernels.granger(e, x)[0] > 0.01
    # the F test by hand for one lag
    t, own = y[1:], np.column_stack([np.ones(399), y[:-1]])
    both = np.column_stack([own, x[:-1]])
    rest = lambda m: ((t - m @ np.linalg.lstsq(m, t, rcond=None)[0]) ** 2).sum()
    f = (rest(own) - rest(both)) / (rest(both) / 396)
    assert kernels.granger(x, y, 1)[0] == pytest.approx(kernels.t_two_sided(np.sqrt(f), 396), abs=1e-9)
    logistic = [0.3]
    for _ in range(600):
        logistic.append(3.9 * logistic[-1] * (1 - logistic[-1]))
    assert kernels.bds(np.array(logistic))[1] < 1e-6 and kernels.bds(rng.normal(size=600))[1] > 0.001
    z = np.zeros(2000)
    shock, s = rng.normal(size=2000), 1.0
    for i in range(2000):
        z[i] = shock[i] * s
        s = np.sqrt(0.2 + 0.8 * z[i] ** 2)
    assert kernels.arch_lm(z) < 1e-6 and kernels.arch_lm(shock) > 0.001
    assert abs(kernels.hurst_dfa(shock) - 0.5) < 0.1 and kernels.hurst_dfa(np.cumsum(shock)) > 1.2
    assert kernels.kpss(shock)[1] > 0.05 and kernels.kpss(np.cumsum(shock))[1] < 0.05


def test_gaussians_part_two_clouds():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal([-3, 1], 0.5, (200, 2)), rng.normal([3, 2], 0.5, (100, 2))])
    weight, mean, cov = kernels.two_gaussians(x)
    assert np.allclose(weight, [2 / 3, 1 / 3], atol=0.02) and np.allclose(mean, [[-3, 1], [3, 2]], atol=0.2)
    p = kernels.responsibilities(x, weight, mean, cov)
    assert (p[:200, 0] > 0.9).all() and (p[200:, 1] > 0.9).all()


def test_selection_of_a_block():
    rng = np.random.default_rng(9)
    n = 400
    x = rng.normal(size=(n, 8))
    x[:, 1] = x[:, 0] + 0.01 * rng.normal(size=n)  # correlates with an earlier column
    x[:, 2] = 0  # no variance
    y = (np.concatenate([[0], x[:-1, 0]]) + 0.3 * rng.normal(size=n) > 0).astype(float)
    found = selection.selected_in_block(x, y)
    assert found[0] == 1 and 1 not in found and 2 not in found
    close = np.column_stack([x[:, 0], x[:, 0] + 0.5 * rng.normal(size=n), x[:, 3], x[:, 4]])
    label = (close[:, 0] > 0).astype(float)
    assert set(selection.best_of_clusters(close, label, [0, 1, 2, 3])) == {0, 2, 3}
    assert kernels.average_linkage(np.array([[0, 1, 5, 6.0], [1, 0, 4, 5], [5, 4, 0, 1], [6, 5, 1, 0]]), 2) == [0, 0, 1, 1]
    assert kernels.average_linkage(np.array([[0, 1, 5, 6.0], [1, 0, 4, 5], [5, 4, 0, 1], [6, 5, 1, 0]]), 5) == [0, 0, 0, 0]


def test_candidates_by_votes(spark):
    voted = spark.createDataFrame([("A", f"f{i}", v, 1, 8) for i, v in enumerate([8, 5, 5, 4, 1])] + [("B", f"f{i}", v, 2, 8) for i, v in enumerate([4, 6, 2, 1])], "symbol string, feature string, votes long, lag int, blocks long")
    got = sorted((r["symbol"], r["place"], r["feature"]) for r in selection.candidates(voted).collect())
    assert got == [("A", 1, "f0"), ("A", 2, "f1"), ("A", 3, "f2"), ("B", 1, "f1"), ("B", 2, "f0"), ("B", 3, "f2")]


def test_permuted_column_is_a_shuffle(spark):
    df = spark.createDataFrame([("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 3, float(i)) for i in range(90)], "symbol string, ts timestamp, fold int, x double")
    got = metrics.permuted(df, "x").toPandas().sort_values("ts")
    plain = df.toPandas().sort_values("ts")
    for fold in range(3):
        a, b = got[got["fold"] == fold]["x"].tolist(), plain[plain["fold"] == fold]["x"].tolist()
        assert sorted(a) == sorted(b) and a != b
    assert got["x"].tolist() == metrics.permuted(df.repartition(7), "x").toPandas().sort_values("ts")["x"].tolist()


def test_every_oracle_on_the_smallest_tables(spark):
    """All queries with SQL against it, on the whole tables of the least scale."""
    src = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(src):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{src}/{f}'")
    known, wrong = plans.queries(), []
    plain = lambda rows: sorted((tuple(None if isinstance(v, float) and v != v else float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])
    for name, sql in plans.oracle_sql().items():
        df = known[name](spark, src)
        columns = sorted(df.columns)
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        if plain([tuple(r[c] for c in columns) for r in df.collect()]) != plain(want):
            wrong.append(name)
    assert not wrong
