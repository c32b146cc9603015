"""Hierarchies and votes of features, sums over pairs, and models as tables, against loops."""

import math

import numpy as np
import pandas as pd
import pytest

from tidewright.functions import kernels as k
from tidewright.functions.tables import written
from tidewright.operators import model, pipeline, regimes, selection
from tidewright.plans import core_queries

SF = "/root/testdata/sf0.001"


def plain_ward(d, most):
    """By the increase of the sum of squares that each joining means, on squared distances alone."""
    groups = [[i] for i in range(len(d))]
    inner = lambda g: sum(d[i, j] ** 2 for i in g for j in g) / (2 * len(g))
    cost = lambda a, b: 2 * (inner(a + b) - inner(a) - inner(b))
    while len(groups) > most:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(5))
def test_ward_matches_sums_of_squares(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(14, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for most in (1, 3, 6, 14):
        of = k.ward_clusters(d, most)
        assert {frozenset(np.flatnonzero(np.array(of) == c).tolist()) for c in set(of)} == plain_ward(d, most)
        for c, best in zip(dict.fromkeys(of), k.medoids(d, of)):
            mine = [i for i in range(14) if of[i] == c]
            assert best == min(mine, key=lambda i: sum(d[i, j] for j in mine))


def test_ward_joins_all_at_one_height():
    """Two pairs at one distance: three clusters can't be had."""
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 1], [9, 9, 1, 0.0]])
    assert k.ward_clusters(d, 3) == [0, 0, 1, 1] and k.ward_clusters(d, 4) == [0, 1, 2, 3]


def test_hierarchy_of_a_table(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 3))
    x = np.column_stack([base, base + 0.1 * rng.normal(size=(200, 3))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcdef")))
    found = selection.hierarchy(df, list("abcdef"), 3)
    assert [found[c][0] for c in "abcdef"] == [0, 1, 2, 0, 1, 2] and sum(best for _, best in found.values()) == 3
    assert selection.hierarchy(df, list("abc"), 3) == {"a": (0, True), "b": (1, True), "c": (2, True)}


def test_causal_falls_back_on_rank_correlation():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300).astype(float)
    x = np.column_stack([rng.normal(size=300) + 3 * y, rng.normal(size=300) + 2 * y, *(rng.normal(size=300) for _ in range(5))])
    found = selection.causal(x, y, lags=2, p=0.0, least_mi=9)
    rho = np.abs([np.corrcoef(pd.Series(c).rank(), pd.Series(y).rank())[0, 1] for c in x.T])
    assert found == {int(c): 1 for c in np.argsort(-rho)[:5]}
    late = np.column_stack([np.roll(y, -2) + 0.1 * rng.normal(size=300), x[:, 2:5]])
    assert selection.causal(late, y, p=1e-6, least_mi=9, least=1) == {0: 2}


def test_wide_consensus_by_votes_words_and_bounds(spark, monkeypatch):
    names = [f"f{i:02d}" for i in range(20)] + ["cmf_1", regimes.HIGH]
    votes = {"A": {n: 8 for n in names}, "B": {"f01": 8, "cmf_1": 8, "f02": 3, "f03": 2, "f00": 2, "f04": 1, "f05": 1, "f06": 1}}
    rows = [(s, f, v, 1, 8) for s, of in votes.items() for f, v in of.items()]
    monkeypatch.setattr(selection, "votes", lambda *a: spark.createDataFrame(rows, "symbol string, feature string, votes long, lag int, blocks long"))
    got = {s: [] for s in votes}
    for r in sorted(selection.wide_consensus(None, names).collect(), key=lambda r: r["place"]):
        got[r["symbol"]].append(r["feature"])
    assert got["A"] == ["cmf_1", *[f"f{i:02d}" for i in range(15)]]
    assert got["B"] == ["cmf_1", "f01", "f02", "f00", "f03", "f04"]


@pytest.mark.parametrize("n", [5, 64, 65, 700, 3000])
@pytest.mark.parametrize("kind", ["normal", "rounded", "heavy", "zeros"])
def test_sums_over_pairs_equal_loops(n, kind):
    rng = np.random.default_rng(n)
    x = {"normal": lambda: rng.normal(size=n), "rounded": lambda: np.round(rng.normal(size=n), 1), "heavy": lambda: rng.standard_cauchy(size=n), "zeros": lambda: np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n))}[kind]()
    y, far = np.roll(x, 1), 1.5 * x.std(ddof=1)
    near = (np.abs(x[:, None] - x[None]) < far) & (np.abs(y[:, None] - y[None]) < far)
    assert k.near_pairs(x, y, far) == k.near_pairs(x, y, far, block=7) == near.sum()
    both = np.maximum(np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None]))
    assert (k.kth_neighbour(x, y, 3) == np.partition(both, 3, axis=1)[:, 3]).all()


def test_bds_equals_loops():
    x = np.random.default_rng(1).normal(size=400)
    n, m, far = 400, 399, 1.5 * x.std(ddof=1)
    near = np.abs(x[:, None] - x[None]) < far
    others = near.sum(axis=1) - 1
    c, kk = others.sum() / (n * (n - 1)), (others * (others - 1)).sum() / (n * (n - 1) * (n - 2))
    c1 = (near[1:, 1:].sum() - m) / (m * (m - 1))
    c2 = ((near[1:, 1:] & near[:-1, :-1]).sum() - m) / (m * (m - 1))
    var = 4 * (kk**2 + 2 * kk * c**2 + c**4 - 4 * kk * c**2)
    assert math.isclose(k.bds(x)[0], math.sqrt(m) * (c2 - c1**2) / math.sqrt(var), rel_tol=1e-9)


@pytest.fixture(scope="module")
def folds(spark):
    return written(core_queries.fold_rows(spark, "/root/testdata/sf0.01"))


COLUMNS = ["cmf_20", "vol_parkinson", "ret_3", "geo_body_ratio"]


def test_fold_models_equal_plain_fits(spark, folds, tmp_path):
    fitted = model.FoldLogistic(features=COLUMNS).fit(folds.where("role = 'train'"))
    fitted.save(f"file://{tmp_path}/m")
    again = model.FoldLogisticModel.load(f"file://{tmp_path}/m")
    scored = again.transform(folds)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert not any(w in plan for w in ("FlatMap", "MapIn", "Python"))  # neither a fit nor Python
    got = scored.select("symbol", "fold", "ts", "role", "prob_up").toPandas()
    assert got["prob_up"].tolist() == pytest.approx(fitted.transform(folds).select("prob_up").toPandas()["prob_up"].tolist())
    for (symbol, fold), g in folds.toPandas().groupby(["symbol", "fold"]):
        g = g.sort_values(["ts", "role"])
        train = ((g["role"] == "train") & g["target_label"].notna()).to_numpy()
        net = model.Calibrated().fit(g[COLUMNS].to_numpy(float)[train], g["target_label"].to_numpy(float)[train])
        own = got[(got["symbol"] == symbol) & (got["fold"] == fold)].sort_values(["ts", "role"])
        np.testing.assert_allclose(own["prob_up"], net.probability(g[COLUMNS].to_numpy(float)), atol=1e-8)


def test_folds_that_cannot_be_fitted_score_a_half(spark):
    rows = pd.DataFrame({"symbol": "s", "fold": [1] * 10 + [2] * 90, "ts": pd.date_range("2024-01-01", periods=100, freq="h"), "target_label": [0, 1] * 5 + [1] * 90, "x": np.arange(100.0)})
    df = spark.createDataFrame(rows)
    fitted = model.FoldLogistic(features=["x"]).fit(df)
    assert fitted.table.count() == 0
    assert {(r["prob_up"], r["slope"], r["offset"]) for r in fitted.transform(df).collect()} == {(0.5, 1.0, 0.0)}


def test_feature_pipeline_is_computed_once(spark, tmp_path):
    """The fitted model holds tables; applying it fits nothing, and the features of its bars come from one chain of windows."""
    bars = written(core_queries.labelled(spark, "/root/testdata/sf0.01").where("symbol in ('click', 'view')").select("symbol", "ts", *core_queries.OHLCV, "target_label"))
    fitted = pipeline.FeaturePipeline(columns=["ret_3", "zscore_20", "cmf_20"], hidden=True).fit(bars)
    fitted.save(f"file://{tmp_path}/p")
    again = pipeline.FeaturePipelineModel.load(f"file://{tmp_path}/p")
    assert again.found.chains.count() == 2
    for table in again.found.tables().values():
        assert "Parquet" in table._jdf.queryExecution().sparkPlan().toString()
    out = again.transform(bars)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroups") <= 1  # the chain's messages
    a, b = (x.toPandas().sort_values(["symbol", "ts", "place"]).reset_index(drop=True) for x in (fitted.transform(bars), out))
    pd.testing.assert_frame_equal(a, b)


def test_a_selected_regime_is_passed_on(spark):
    """Where the high regime's chance is selected, it comes as it is beside its lagged forms."""
    bars = written(core_queries.labelled(spark, "/root/testdata/sf0.01").where("symbol = 'click'").select("symbol", "ts", *core_queries.OHLCV, "target_label"))
    ahead = pipeline.stateless(bars)[0]
    chains = regimes.fit(ahead)
    payload = spark.createDataFrame([("click", 1.0)], "symbol string, optimal_d double")
    chosen = spark.createDataFrame([("click", [regimes.HIGH, f"{regimes.HIGH}_momentum"], {regimes.HIGH: 1})], "symbol string, features array<string>, lags map<string,int>")
    out = pipeline.FeatureModel(payload, chosen, chains).transform(bars).toPandas()
    want = regimes.regimes(ahead.select("symbol", "ts", "log_return"), chains=chains).toPandas().set_index("ts")[regimes.HIGH].sort_index()
    raw = out[out["feature"] == regimes.HIGH].set_index("ts")["value"].sort_index().dropna()
    np.testing.assert_allclose(raw, want, atol=1e-12)
    moved = out[out["feature"] == f"{regimes.HIGH}_momentum"].set_index("ts")["value"].sort_index().dropna()
    np.testing.assert_allclose(moved, ((want - want.shift(1)) / (want.shift(1).abs() + 1e-8)).dropna(), atol=1e-9)


def test_diversify_of_a_table_equals_lists(spark):
    """Place by place what the plain rule over lists picks; a group of banned features keeps them."""
    rng = np.random.default_rng(11)
    names = [*selection.BLACKLIST[:3], "cmf_slope_5_momentum", "rvol_5_momentum", "vol_parkinson_momentum", "ret_3_momentum", "skewness_20_momentum", "rsi_14_momentum", "zscore_5_momentum", "hl_log_range_momentum"]
    groups = {f"g{i}": list(rng.permutation(names)[: rng.integers(1, len(names))]) for i in range(30)} | {"banned": list(selection.BLACKLIST[:3])}
    df = spark.createDataFrame([(g, i, f) for g, fs in groups.items() for i, f in enumerate(map(str, fs))], "symbol string, place int, feature string")
    for most in (2, 4):
        got = {g: [] for g in groups}
        for r in sorted(selection.diversify(df, "symbol", most).collect(), key=lambda r: r["place"]):
            got[r["symbol"]].append(r["feature"])
        assert got == {g: selection.diversified(selection.allowed(list(map(str, fs))), most) for g, fs in groups.items()}
