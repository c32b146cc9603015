"""Queries of the feature strategies over daily order bars."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewright.operators import features as f
from tidewright.operators.audit import adjusted, repaired, returns, with_benchmark
from tidewright.operators.topology import book
from tidewright.plans.oracle import INDEX, ORD, avg, features as sql, lag, roll, sd, total, win
from tidewright.plans.registry import query
from tidewright.sources.bars import order_bars, order_index

E = "1e-8"
CLV = f"(((c - l) - (h - c)) / (h - l + {E}))"
UP, LOW = "(h - greatest(o, c))", "(least(o, c) - l)"


def adjusted_orders(spark, sf_dir):
    return returns(adjusted(repaired(order_bars(spark, sf_dir))))


def with_market(spark, sf_dir):
    m = order_index(spark, sf_dir).select("symbol", "ts", "close")
    m = m.select("ts", F.log(F.try_divide("close", f.lag("close"))).alias("return"))
    return with_benchmark(adjusted_orders(spark, sf_dir), m)


def strategy(name, levels, columns, *helpers, start=adjusted_orders, extra="", scale=None):
    """Registers feat_<name>: its features, and SQL from formulas of columns over helper levels."""

    @query(f"feat_{name}", ["symbol", "ts"], list(columns), sql(columns, *helpers, extra=extra), scale)
    def run(spark, sf_dir):
        df = f.compute(start(spark, sf_dir), levels if isinstance(levels, list) else [levels])[0]
        return df.withColumn("log_energy_ratio", F.log1p("wavelet_energy_ratio")) if name == "wavelet" else df


strategy("baseline", f.baseline, {
    "geo_body_ratio": f"(c - o) / (h - l + {E})", "geo_upper_shadow": f"{UP} / (h - l + {E})", "geo_lower_shadow": f"{LOW} / (h - l + {E})", "overnight_gap": f"o / {lag('c')} - 1",
    **{f"rvol_{n}": f"v / ({avg('v', n, 1)} + {E})" for n in (5, 15)}, **{f"vol_shock_{n}": f"(lv - {avg('lv', n, 1)}) / ({sd('lv', n, 1)} + {E})" for n in (5, 15)},
    "sin_dow": "sin(2 * pi() * ((dayofweek(t) + 6) % 7) / 5)", "cos_dow": "cos(2 * pi() * ((dayofweek(t) + 6) % 7) / 5)", "sin_month": "sin(2 * pi() * month(t) / 12)", "cos_month": "cos(2 * pi() * month(t) / 12)",
}, {"lv": f"ln(v + {E})"})


def _ema(span):
    a = 2 / (span + 1)
    return f"list_reduce(list(c) OVER ({ORD} ROWS UNBOUNDED PRECEDING), lambda a, b: a * {1 - a} + b * {a})"


strategy("trend", [f.trend, f.trend_more], {
    **{f"ret_{k}": f"ln(c / {lag('c', k)})" for k in (1, 3)}, **{f"vol_adj_mom_{k}": f"ln(c / {lag('c', k)}) / (({sd('r', 20, 1)} + {E}) * sqrt({k}))" for k in (1, 3)},
    "macd_dist": "macd", "macd_slope_5": f"macd - {lag('macd', 5)}", **{f"tsmom_sign_{k}": f"sign(ln(c / {lag('c', k)}))" for k in (1, 3, 5, 10, 20)},
    **{f"breakout_ratio_{k}": f"(c - {roll('max', 'c', k, 1)}) / ({roll('max', 'c', k, 1)} - {roll('min', 'c', k, 1)} + {E})" for k in (3, 5, 10, 20)},
}, {"macd": f"{_ema(12)} / {_ema(26)} - 1"})
strategy("oscillator", f.oscillator, {
    **{f"zscore_{k}": f"(c - {avg('c', k, 1)}) / ({sd('c', k, 1)} + {E})" for k in (3, 5, 10, 20)},
    **{f"bollinger_pctB_{k}": f"(c - ({avg('c', k, 1)} - 2 * {sd('c', k, 1)})) / (4 * {sd('c', k, 1)} + {E})" for k in (3, 5, 10, 20)},
    "rsi_14": f"100 - 100 / (1 + {avg('g', 14, 1)} / ({avg('ls', 14, 1)} + {E}))",
}, {"g": f"greatest(coalesce(c - {lag('c')}, 0), 0)", "ls": f"greatest(-coalesce(c - {lag('c')}, 0), 0)"})
K = 0.34 / (1.34 + 21 / 19)
RS = "(ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o))"
strategy("volatility", f.volatility, {
    "vol_parkinson": "sqrt(power(ln(h / l), 2) / (4 * ln(2)))", "vol_garman_klass": "sqrt(greatest(0, 0.5 * power(ln(h / l), 2) - (2 * ln(2) - 1) * power(ln(c / o), 2)))", "vol_rogers_satchell": "sqrt(greatest(0, rs))",
    "vol_yang_zhang": f"sqrt(CASE WHEN {roll('var_samp', 'onr', 20)} IS NOT NULL THEN greatest(0, {roll('var_samp', 'onr', 20)} + {K} * {roll('var_samp', 'dy', 20)} + {1 - K} * {avg('rs', 20)}) END)",
    "vol_downside_dev_20": sd("dn", 20), "vol_upside_dev_20": sd("up", 20), "vol_semi_variance_ratio_raw": f"{sd('dn', 20)} / ({sd('up', 20)} + {E})", "skewness_20": roll("skewness", "r", 20), "kurtosis_20": roll("kurtosis", "r", 20),
}, {"rs": RS, "onr": f"ln(o / {lag('c')})", "dy": "ln(c / o)", "dn": "CASE WHEN r < 0 THEN r ELSE 0 END", "up": "CASE WHEN r > 0 THEN r ELSE 0 END"})
strategy("kinematic", [f.kinematic, f.kinematic_more], {
    "kinematic_velocity": "r0", "kinematic_squeeze_ratio": f"4 * {sd('c', 20, 1)} / (3 * {avg('tr', 20, 1)} + {E})", "kinematic_clv_vol": f"{CLV} * v / ({avg('v', 20, 1)} + {E})",
    "kinematic_acceleration": "acc", "kinematic_jerk": f"acc - {lag('acc')}", "kinematic_clv_vol_roll20": avg("cv", 20),
}, {"tr": f"greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')}))", "acc": f"r - {lag('r')}", "cv": f"{CLV} * v"})
strategy("wavelet", f.wavelet, {
    "wavelet_detail_d1": "d1", "wavelet_detail_d2": "d2", "wavelet_approx_a3": avg("c", 8), "log_energy_ratio": f"ln(1 + d1 * d1 / (d2 * d2 + {E}))",
}, {"d1": f"(c - {lag('c')}) / sqrt(2)", "d2": f"((c + {lag('c')}) - ({lag('c', 2)} + {lag('c', 3)})) / 2"})
strategy("intraday", f.intraday, {"shadow_asymmetry_ratio": f"({UP} - {LOW}) / (h - l + {E})", "buying_tail_power": f"{LOW} / (h - l + {E}) * v", "selling_tail_power": f"{UP} / (h - l + {E}) * v", "body_efficiency_ratio": f"abs(c - o) / (h - l + {E})"})
strategy("flow_divergence", f.flow_divergence, {
    "cmf_20": "cmf", "cmf_slope_5": f"cmf - {lag('cmf', 5)}", "obv_zscore_20": f"{total('sv', 20)} / ({sd('sv', 20)} + {E})", "obv_slope_5": f"({total('sv', 20)} - {total('sv', 20, 5)}) / ({avg('v', 20)} + {E})",
    "vpt_zscore_20": f"{total('rv', 20)} / ({sd('rv', 20)} + {E})", "cmf_price_divergence": f"cmf - (c / {lag('c', 20)} - 1)",
}, {"cv": f"{CLV} * v", "sv": "sign(r0) * v", "rv": "r0 * v"}, {"cmf": f"{total('cv', 20)} / ({total('v', 20)} + {E})"})
strategy("directional", f.directional, {
    "net_pressure_ratio": CLV, "net_pressure_volume": "npv", "net_pressure_vol_roll": avg("npv", 14), "wick_absorption_direction": f"({LOW} - {UP}) / (h - l + {E})",
    "wick_absorption_thrust": f"({LOW} - {UP}) / (h - l + {E}) * v / ({avg('v', 14)} + {E})", "body_direction_momentum": "bm", "body_direction_accel": f"bm - {lag('bm', 2)}",
}, {"npv": f"{CLV} * ln(v + 1)", "body": f"(c - o) / (h - l + {E})"}, {"bm": avg("body", 5)})
strategy("signed_volatility", f.signed_volatility, {"vol_directional_bias": "vb", "signed_expansion_thrust": "sign(c - o) * ln(h / l)", "vol_directional_accel": f"vb - {lag('vb', 3)}"},
    {"u": "CASE WHEN r > 0 THEN r * r ELSE 0 END", "d": "CASE WHEN r < 0 THEN r * r ELSE 0 END"}, {"vb": f"({avg('u', 20)} - {avg('d', 20)}) / ({avg('u', 20)} + {avg('d', 20)} + {E})"})
D = 3 - 2 * math.sqrt(2)


def rank_sql(x, n):
    values = f"list({x}) {win(n)}"
    return f"CASE WHEN count({x}) {win(n)} = {n} THEN (len(list_filter({values}, lambda e: e < {x})) + (len(list_filter({values}, lambda e: e = {x})) + 1) / 2) / {n} END"


strategy("liquidity", f.liquidity, {
    "liq_spread_cs": "CASE WHEN alpha IS NOT NULL THEN greatest(0, 2 * (exp(alpha) - 1) / (1 + exp(alpha))) END", "liq_amihud_raw": "am", "liq_amihud_pct_rank": rank_sql("am", 20),
    "liq_turnover_ratio_20": f"cv / ({avg('cv', 20, 1)} + {E})", "liq_log_turnover": f"ln(cv + {E})",
}, {"gm": f"power(ln(high / low), 2) + power(ln({lag('high')} / {lag('low')}), 2)", "bt": f"CASE WHEN {lag('high')} IS NOT NULL THEN power(ln(greatest(high, {lag('high')}) / least(low, {lag('low')})), 2) END", "cv": "close * v", "am": f"abs(r) / (nullif(close * v, 0) + {E})"},
   {"alpha": f"(sqrt(2 * bt) - sqrt(bt)) / {D} - sqrt(gm / {D})"})
MARKET = f"{INDEX},\nbm AS (SELECT b.*, coalesce(mk.mkt_return, 0) AS mkt_return FROM b LEFT JOIN mk ON b.t = mk.t)"


def pair(fn, n):
    return f"(CASE WHEN count(*) {win(n)} = {n} THEN {fn}(a, m) {win(n)} END)"


strategy("market_context", f.market_context, {
    "mkt_relative_return": "a - m", "mkt_rs_cum_20": "cum", "mkt_rs_momentum": f"cum - {lag('cum', 5)}", "mkt_rolling_beta_60": "beta", "mkt_beta_shock": f"beta - {lag('beta', 5)}",
    "mkt_vol_ratio_20": f"{sd('a', 20)} / ({sd('m', 20)} + {E})", "mkt_correlation_20": f"coalesce({pair('corr', 20)}, 0)", "mkt_divergence_signed": "sign(a) * sign(m) * (a - m)",
}, {"a": "r0", "m": f"coalesce({lag('mkt_return')}, 0)"}, {"cum": f"{total('a', 20)} - {total('m', 20)}", "beta": f"CASE WHEN {pair('covar_samp', 60)} IS NOT NULL THEN greatest(-1, least(3.5, {pair('covar_samp', 60)} / ({roll('var_samp', 'm', 60)} + {E}))) END"},
   start=with_market, extra=MARKET)
strategy("jump", f.jump, {"jump_diffusion_component": "jd", "continuous_vol_ratio": f"bv / (rv + {E})", "jump_signed_shock": "jd * sign(r0)"},
    {"r2": "r0 * r0", "bp": f"abs(r0) * abs({lag('r0')})"}, {"rv": total("r2", 20), "bv": f"pi() / 2 * {total('bp', 20)}"}, {"jd": f"CASE WHEN rv IS NOT NULL AND bv IS NOT NULL THEN greatest(rv - bv, 0) / (rv + {E}) END"})
PAT = "CASE WHEN p2 IS NOT NULL THEN CASE WHEN p2 <= p1 AND p1 <= r0 THEN 0 WHEN p2 <= r0 AND r0 < p1 THEN 1 WHEN p1 < p2 AND p2 <= r0 THEN 2 WHEN p1 <= r0 AND r0 < p2 THEN 3 WHEN r0 < p2 AND p2 <= p1 THEN 4 ELSE 5 END END"
ENT = " + ".join(f"CASE WHEN count(*) FILTER (pat = {k}) {win(18)} > 0 THEN -(count(*) FILTER (pat = {k}) {win(18)} / 18) * log2(count(*) FILTER (pat = {k}) {win(18)} / 18 + {E}) ELSE 0 END" for k in range(6))
strategy("complexity", f.complexity, {"chaos_permutation_entropy_20": f"CASE WHEN count(pat) {win(18)} = 18 THEN ({ENT}) / log2(6) END", "lz_complexity_proxy_20": avg("fl", 20)},
    {"p1": lag("r0"), "p2": lag("r0", 2), "sg": "CASE WHEN r0 > 0 THEN 1 ELSE 0 END"}, {"pat": PAT, "fl": f"abs(sg - {lag('sg')})"})
FW = f.difference_weights(0.4)


@query("feat_fractional", ["symbol", "ts"], ["frac_diff"], sql({"frac_diff": f"CASE WHEN count(*) {win(10)} = 10 THEN " + " + ".join(f"coalesce({w} * {lag('c', k) if k else 'c'}, 0)" for k, w in enumerate(FW)) + " END"}))
def feat_fractional(spark, sf_dir):
    return f.compute(adjusted_orders(spark, sf_dir), [f.fractional])[0].withColumnRenamed("frac_diff_d0.40", "frac_diff")


QUOTES = {f"{s}_price_{i}": (f"{p} {'-' if s == 'bid' else '+'} {i}.0") for i in range(1, 4) for s, p in (("bid", "low"), ("ask", "high"))}


def with_ladder(spark, sf_dir):
    """Bars with three levels of quotes made from their prices and volume."""
    df = adjusted_orders(spark, sf_dir).withColumns({n: F.expr(x) for n, x in QUOTES.items()})
    return df.withColumns({f"{s}_size_{i}": F.expr(f"volume / {i + (s == 'ask')}.0 + (high - close) / 1000") for i in range(1, 4) for s in ("bid", "ask")})


SIZES = {f"{s}_size_{i}": f"v / {i + (s == 'ask')}.0 + (high - close) / 1000" for i in range(1, 4) for s in ("bid", "ask")}
DECAY = {i: math.exp(-0.5 * (i - 1)) for i in range(1, 4)}
SIDE = {"sb": " + ".join(f"bid_size_{i} * {DECAY[i]}" for i in DECAY), "sa": " + ".join(f"ask_size_{i} * {DECAY[i]}" for i in DECAY), "pb": " + ".join(f"bid_price_{i} * bid_size_{i} * {DECAY[i]}" for i in DECAY), "pa": " + ".join(f"ask_price_{i} * ask_size_{i} * {DECAY[i]}" for i in DECAY)}
MICRO = f"(pb / (sb + {E}) * sa + pa / (sa + {E}) * sb) / (sb + sa + {E})"


@query("topology_l2_depth", ["symbol", "ts"], ["mid_price", "l2_spread", "order_imbalance_depth", "micro_price_depth", "micro_mid_deviation"],
       sql({"mid_price": "(bid_price_1 + ask_price_1) / 2", "l2_spread": "ask_price_1 - bid_price_1", "order_imbalance_depth": f"(sb - sa) / (sb + sa + {E})", "micro_price_depth": MICRO, "micro_mid_deviation": f"{MICRO} - (bid_price_1 + ask_price_1) / 2"}, QUOTES | SIZES, SIDE))
def topology_l2_depth(spark, sf_dir):
    return book(with_ladder(spark, sf_dir))


def with_best(spark, sf_dir):
    df = adjusted_orders(spark, sf_dir).withColumns({"best_bid": F.col("low"), "best_ask": F.col("high") + 1.0, "bid_size": F.col("volume"), "ask_size": F.col("volume") / 2 + (F.col("high") - F.col("close")) / 1000})
    return book(df)


BEST = {"best_bid": "low", "best_ask": "high + 1.0", "bid_size": "v", "ask_size": "v / 2 + (high - close) / 1000"}
BOOK = {"mid": "(best_bid + best_ask) / 2", "spr": "best_ask - best_bid", "imb": f"(bid_size - ask_size) / (bid_size + ask_size + {E})", "mic": f"(best_bid * ask_size + best_ask * bid_size) / (bid_size + ask_size + {E})"}


@query("topology_l1", ["symbol", "ts"], ["mid_price", "l2_spread", "order_imbalance_depth", "micro_price", "micro_mid_deviation"], sql({"mid_price": "mid", "l2_spread": "spr", "order_imbalance_depth": "imb", "micro_price": "mic", "micro_mid_deviation": "mic - mid"}, BEST, BOOK))
def topology_l1(spark, sf_dir):
    return with_best(spark, sf_dir)


def _gone(x):
    return f"coalesce(greatest({x}, 0), 0)"


strategy("order_book", f.order_book, {
    "l2_micro_dev_raw": "dev", "l2_micro_dev_diff": f"dev - {lag('dev')}", "l2_spread_zscore": f"(spr - {avg('spr', 20)}) / ({sd('spr', 20)} + {E})", "l2_order_imbalance_raw": "raw", "l2_order_imbalance_z": f"(raw - {avg('raw', 20)}) / ({sd('raw', 20)} + {E})",
    "l2_depth_total": "bid_size + ask_size", "l2_depth_ratio": f"bid_size / (ask_size + {E})", "l2_bid_replenishment": _gone("db"), "l2_ask_replenishment": _gone("da"), "l2_bid_withdrawal": _gone("-db"), "l2_ask_withdrawal": _gone("-da"),
}, BEST, BOOK, {"dev": "mic - mid", "raw": "bid_size - ask_size", "db": f"bid_size - {lag('bid_size')}", "da": f"ask_size - {lag('ask_size')}"}, start=with_best)
strategy("toxicity", f.toxicity, {"flow_imbalance_proxy": "fi", "flow_imbalance_zscore": f"(fi - {avg('fi', 20)}) / ({sd('fi', 20)} + {E})", "flow_vpin_10": f"{total('ab', 10)} / ({total('v', 10)} + {E})"}, {"fi": f"{CLV} * v"}, {"ab": "abs(fi)"})
strategy("nonlinear", f.nonlinear, {"nonlin_ret_squared_signed": "r0 * r0 * sign(r0)", "nonlin_ret_cubed": "r0 * r0 * r0", "nonlin_range_x_ret": "ln(h / l) * r0", "nonlin_ret_x_volshock": f"r0 * v / ({avg('v', 20, 1)} + {E})"})
strategy("regime", f.regime, {"regime_p_high_vol": "p", "regime_weighted_return": "r0 * p", "regime_transition_shock": f"abs(p - {lag('p')})"},
    {"vo": sd("r0", 20)}, {"md": f"CASE WHEN count(vo) {win(60, 1)} = 60 THEN quantile_cont(vo, 0.5) {win(60, 1)} END"}, {"p": "CASE WHEN vo > md THEN 1.0 ELSE 0.0 END"})
HB = " + ".join(f"CASE WHEN n{k} > 0 THEN -(n{k} / 20) * ln(n{k} / 20) ELSE 0 END" for k in range(10))
strategy("efficiency", f.efficiency, {"chaos_hurst_proxy": f"ln({sd('r0', 20)} / ({sd('r0', 5)} + {E})) / ln(4)", "chaos_shannon_entropy_20": f"CASE WHEN count(r0) {win(20)} = 20 THEN {HB} END", "chaos_kaufman_er_10": f"abs(c - {lag('c', 10)}) / ({total('mv', 10)} + {E})"},
    {"mv": f"abs(c - {lag('c')})", "vals": f"list(r0) {win(20)}"}, {"bins": "list_transform(vals, lambda e: CAST(least(floor((e - list_min(vals)) / nullif(list_max(vals) - list_min(vals), 0) * 10), 9) AS INT))"},
    {f"n{k}": f"len(list_filter(bins, lambda e: e = {k}))" for k in range(10)})
strategy("vol_term", f.vol_term, {"vts_5_20": "vt", "vol_accel": f"vt - {lag('vt')}"}, {"vt": f"{sd('r0', 5)} / ({sd('r0', 20)} + {E})"})
strategy("vwap", f.vwap, {"vwap_distance_20": f"(c - vw) / (vw + {E})"}, {"tp": "(h + l + c) / 3 * v"}, {"vw": f"{total('tp', 20)} / ({total('v', 20)} + {E})"})
strategy("roll_measure", f.roll_measure, {"liq_roll_measure_20": f"CASE WHEN count(lb) {win(19)} = 19 THEN corr(r, lb) {win(19)} END"}, {"lb": lag("r")})


@query("feat_stress", ["symbol", "ts"], ["asym_ratio_20", "drawdown_20", "drawdown_velocity"],
       sql({"asym_ratio_20": f"{sd('ps', 20)} / ({sd('ng', 20)} + {E})", "drawdown_20": "dd", "drawdown_velocity": f"dd - {lag('dd')}"},
           {"r0": "r0 / 10"}, {"ps": "greatest(r0, 0)", "ng": "least(r0, 0)", "s": f"product(1 + r0) OVER ({ORD} ROWS UNBOUNDED PRECEDING)"}, {"dd": f"(s - {roll('max', 's', 20)}) / ({roll('max', 's', 20)} + {E})"}).replace("SELECT *, r0 / 10 AS r0", "SELECT * REPLACE (r0 / 10 AS r0)"))
def feat_stress(spark, sf_dir):
    """A tenth of each return: the orders' prices jump too far for a product of 1 + r."""
    df = adjusted_orders(spark, sf_dir).withColumn("log_return", F.col("log_return") / 10)
    return f.compute(df, [f.stress])[0]


@query("regime_vol_rank", ["symbol", "ts"], ["regime_vol_rank_60", "regime_is_high_vol"], sql({"regime_vol_rank_60": "rk", "regime_is_high_vol": "CASE WHEN rk >= 0.7 THEN 1.0 ELSE 0.0 END"}, {"vo": sd("r0", 20)}, {"rk": rank_sql("vo", 60)}))
def regime_vol_rank(spark, sf_dir):
    return f.regime_rank(adjusted_orders(spark, sf_dir))


@query("lag_transform", ["symbol", "ts"], ["vp_zscaled_lag1", "vp_momentum", "clv_zscaled_lag2", "clv_momentum"],
       sql({"vp_zscaled_lag1": f"({lag('vp')} - {avg('vp', 20, 1)}) / ({sd('vp', 20, 1)} + {E})", "vp_momentum": f"(vp - {lag('vp')}) / (abs({lag('vp')}) + {E})", "clv_zscaled_lag2": f"({lag('k', 2)} - {avg('k', 20, 2)}) / ({sd('k', 20, 2)} + {E})", "clv_momentum": f"(k - {lag('k', 2)}) / (abs({lag('k', 2)}) + {E})"},
           {"vp": "sqrt(power(ln(h / l), 2) / (4 * ln(2))) + 0.001", "k": f"2 + {CLV}"}).strip())
def lag_transform(spark, sf_dir):
    """Columns held away from zero, whose momentum would be noise over a tiny base."""
    df = adjusted_orders(spark, sf_dir).withColumns({"vp": F.sqrt(f.prices().log_range ** 2 / (4 * math.log(2))) + 0.001, "clv": 2 + f.prices().clv})
    return f.lagged(df, {"vp": 1, "clv": 5})


ROUTED = ["geo_body_ratio", "ret_3", "zscore_20", "vol_parkinson", "kinematic_clv_vol", "wavelet_approx_a3", "body_efficiency_ratio", "cmf_20", "net_pressure_ratio", "mkt_relative_return"]


@query("shift_lock", ["symbol", "ts"], ROUTED,
       "SELECT symbol, ts, " + ", ".join(f"lag({n}) OVER (PARTITION BY symbol ORDER BY ts) AS {n}" for n in ROUTED) + " FROM (" + sql({
           "geo_body_ratio": f"(c - o) / (h - l + {E})", "ret_3": f"ln(c / {lag('c', 3)})", "zscore_20": f"(c - {avg('c', 20, 1)}) / ({sd('c', 20, 1)} + {E})", "vol_parkinson": "sqrt(power(ln(h / l), 2) / (4 * ln(2)))",
           "kinematic_clv_vol": f"{CLV} * v / ({avg('v', 20, 1)} + {E})", "wavelet_approx_a3": avg("c", 8), "body_efficiency_ratio": f"abs(c - o) / (h - l + {E})", "cmf_20": f"{total('cv', 20)} / ({total('v', 20)} + {E})", "net_pressure_ratio": CLV, "mkt_relative_return": "r0 - m",
       }, {"cv": f"{CLV} * v", "m": f"coalesce({lag('mkt_return')}, 0)"}, extra=MARKET) + ")")
def shift_lock(spark, sf_dir):
    return f.route(with_market(spark, sf_dir))[0]
