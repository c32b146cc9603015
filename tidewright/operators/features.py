"""Rolling features of bars. A strategy is a list of levels {name: column}; names that start with _ are dropped at the end.

Inputs: open_adj, high_adj, low_adj, close_adj, volume, log_return, raw high, low and close; some use optional columns.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Callable, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.kernels import difference_weights
from tidewright.functions.series import EPS, both_max, both_min, correlation, delta, floored, frame, kurt, lag, ordered, pct_rank, ratio, rolled, skew, staged, zero
from tidewright.operators import recursive

LAGS = (1, 3, 5, 10, 20)
Levels = list[dict[str, Column] | Callable[[DataFrame], DataFrame]]


class Prices(NamedTuple):
    """Columns that most strategies start from."""

    o: Column
    h: Column
    l: Column  # noqa: E741
    c: Column
    v: Column
    r: Column
    r0: Column
    span: Column
    upper: Column
    lower: Column
    clv: Column
    log_range: Column


def prices() -> Prices:
    o, h, l, c, v, r = (F.col(x) for x in ("open_adj", "high_adj", "low_adj", "close_adj", "volume", "log_return"))  # noqa: E741
    span = h - l + EPS
    return Prices(o, h, l, c, v, r, zero("log_return"), span, h - both_max(o, c), both_min(o, c) - l, ((c - l) - (h - c)) / span, F.log(ratio(h, l)))


def per(a: Column, b: Column) -> Column:
    return a / (b + EPS)


def mean(x, n: int, lag: int = 0) -> Column:
    return rolled(F.avg, x, n, lag)


def std(x, n: int, lag: int = 0) -> Column:
    return rolled(F.stddev_samp, x, n, lag)


def total(x, n: int, lag: int = 0) -> Column:
    return rolled(F.sum, x, n, lag)


def z(x: str, n: int) -> Column:
    return (F.col(x) - mean(x, n)) / (std(x, n) + EPS)


def baseline(lags: tuple = (1, 3), width: int = 5) -> Levels:
    p = prices()
    o, c, v, span, upper, lower = p.o, p.c, p.v, p.span, p.upper, p.lower
    out = {"geo_body_ratio": (c - o) / span, "geo_upper_shadow": upper / span, "geo_lower_shadow": lower / span, "overnight_gap": ratio(o, lag("close_adj")) - 1, "_lv": F.log(v + EPS)}
    day, month = F.weekday("ts"), F.month("ts")
    out |= {f"{f.__name__}_dow": f(2 * math.pi * day / 5) for f in (F.sin, F.cos)} | {f"{f.__name__}_month": f(2 * math.pi * month / 12) for f in (F.sin, F.cos)}
    rolls = {}
    for k in lags:
        n = k * width
        rolls[f"rvol_{n}"] = v / (mean("volume", n, 1) + EPS)
        rolls[f"vol_shock_{n}"] = (F.col("_lv") - mean("_lv", n, 1)) / (std("_lv", n, 1) + EPS)
    return [out, rolls]


def trend(lags: tuple = (1, 3)) -> Levels:
    c = prices().c
    means = lambda df: recursive.ema(df, {"_ema_12": ("close_adj", 12), "_ema_26": ("close_adj", 26)})
    first = {f"ret_{k}": F.log(ratio(c, lag("close_adj", k))) for k in lags} | {"_vol": std("log_return", 20, 1), "macd_dist": ratio(F.col("_ema_12"), F.col("_ema_26")) - 1, "_ema_12": F.col("_ema_12"), "_ema_26": F.col("_ema_26")}
    return [means, first, {f"vol_adj_mom_{k}": F.col(f"ret_{k}") / ((F.col("_vol") + EPS) * math.sqrt(k)) for k in lags}]


def trend_more(lags: tuple = LAGS) -> Levels:
    """Signs, breakouts and the slope of macd_dist; needs trend()."""
    c = prices().c
    out = {f"tsmom_sign_{k}": F.signum(F.log(ratio(c, lag("close_adj", k)))) for k in lags}
    for k in lags:
        top, low = rolled(F.max, "close_adj", k, 1), rolled(F.min, "close_adj", k, 1)
        out[f"breakout_ratio_{k}"] = (c - top) / (top - low + EPS)
    return [out | {"macd_slope_5": delta("macd_dist", 5)}]


def oscillator(lags: tuple = (3, 5, 10, 20)) -> Levels:
    c = prices().c
    out = {}
    for k in lags:
        m, s = mean("close_adj", k, 1), std("close_adj", k, 1)
        out |= {f"zscore_{k}": (c - m) / (s + EPS), f"bollinger_pctB_{k}": (c - (m - 2 * s)) / (4 * s + EPS)}
    d = delta("close_adj")
    gain = {"_up": F.when(d > 0, d).otherwise(0.0), "_down": F.when(d < 0, -d).otherwise(0.0)}
    return [out | gain, {"rsi_14": 100 - 100 / (1 + mean("_up", 14, 1) / (mean("_down", 14, 1) + EPS))}]


def volatility() -> Levels:
    p = prices()
    o, h, l, c, r, log_range = p.o, p.h, p.l, p.c, p.r, p.log_range  # noqa: E741
    hc, ho, lc, lo_, co, oc = (F.log(ratio(a, b)) for a, b in ((h, c), (h, o), (l, c), (l, o), (c, o), (o, lag("close_adj"))))
    first = {
        "vol_parkinson": F.sqrt(log_range * log_range / (4 * math.log(2))),
        "vol_garman_klass": F.sqrt(floored(0.5 * log_range * log_range - (2 * math.log(2) - 1) * co * co)),
        "_rs": hc * ho + lc * lo_, "_on": oc, "_day": co,
        "_dn": F.when(r < 0, r).otherwise(0.0), "_up": F.when(r > 0, r).otherwise(0.0),
        "skewness_20": skew("log_return", 20), "kurtosis_20": kurt("log_return", 20),
    }
    k = 0.34 / (1.34 + 21 / 19)
    var = lambda x: rolled(F.var_samp, x, 20)
    second = {
        "vol_rogers_satchell": F.sqrt(floored(F.col("_rs"))),
        "vol_yang_zhang": F.sqrt(floored(var("_on") + k * var("_day") + (1 - k) * mean("_rs", 20))),
        "vol_downside_dev_20": std("_dn", 20), "vol_upside_dev_20": std("_up", 20),
    }
    return [first, second, {"vol_semi_variance_ratio_raw": per(F.col("vol_downside_dev_20"), F.col("vol_upside_dev_20"))}]


def kinematic() -> Levels:
    p = prices()
    h, l, v, r0, clv = p.h, p.l, p.v, p.r0, p.clv  # noqa: E741
    before = lag("close_adj")
    first = {"kinematic_velocity": r0, "_tr": F.greatest(h - l, F.abs(h - before), F.abs(l - before)), "kinematic_clv_vol": clv * v / (mean("volume", 20, 1) + EPS)}
    return [first, {"kinematic_squeeze_ratio": 4 * std("close_adj", 20, 1) / (3 * mean("_tr", 20, 1) + EPS)}]


def kinematic_more() -> Levels:
    p = prices()
    v, clv = p.v, p.clv
    first = {"kinematic_acceleration": delta("log_return"), "_cv": clv * v}
    return [first, {"kinematic_jerk": delta("kinematic_acceleration"), "kinematic_clv_vol_roll20": mean("_cv", 20)}]


def wavelet() -> Levels:
    c = prices().c
    l1, l2, l3 = (lag("close_adj", k) for k in (1, 2, 3))
    first = {"wavelet_detail_d1": (c - l1) / math.sqrt(2), "wavelet_detail_d2": ((c + l1) - (l2 + l3)) / 2, "wavelet_approx_a3": mean("close_adj", 8)}
    return [first, {"wavelet_energy_ratio": per(F.col("wavelet_detail_d1") ** 2, F.col("wavelet_detail_d2") ** 2)}]


def intraday() -> Levels:
    p = prices()
    o, c, v, span, upper, lower = p.o, p.c, p.v, p.span, p.upper, p.lower
    return [{"shadow_asymmetry_ratio": (upper - lower) / span, "buying_tail_power": lower / span * v, "selling_tail_power": upper / span * v, "body_efficiency_ratio": F.abs(c - o) / span}]


def flow_divergence() -> Levels:
    p = prices()
    c, v, r0, clv = p.c, p.v, p.r0, p.clv
    first = {"_cv": clv * v, "_sv": F.signum(r0) * v, "_rv": r0 * v}
    second = {
        "cmf_20": total("_cv", 20) / (total("volume", 20) + EPS),
        "obv_zscore_20": total("_sv", 20) / (std("_sv", 20) + EPS),
        "obv_slope_5": (total("_sv", 20) - total("_sv", 20, 5)) / (mean("volume", 20) + EPS),
        "vpt_zscore_20": total("_rv", 20) / (std("_rv", 20) + EPS),
    }
    return [first, second, {"cmf_slope_5": delta("cmf_20", 5), "cmf_price_divergence": F.col("cmf_20") - (ratio(c, lag("close_adj", 20)) - 1)}]


def directional() -> Levels:
    p = prices()
    o, c, v, span, upper, lower, clv = p.o, p.c, p.v, p.span, p.upper, p.lower, p.clv
    first = {"net_pressure_ratio": clv, "net_pressure_volume": clv * F.log(v + 1), "wick_absorption_direction": (lower - upper) / span, "_body": (c - o) / span}
    second = {"net_pressure_vol_roll": mean("net_pressure_volume", 14), "wick_absorption_thrust": F.col("wick_absorption_direction") * v / (mean("volume", 14) + EPS), "body_direction_momentum": mean("_body", 5)}
    return [first, second, {"body_direction_accel": delta("body_direction_momentum", 2)}]


def signed_volatility() -> Levels:
    p = prices()
    o, c, r, log_range = p.o, p.c, p.r, p.log_range
    first = {"_u": F.when(r > 0, r * r).otherwise(0.0), "_d": F.when(r < 0, r * r).otherwise(0.0), "signed_expansion_thrust": F.signum(c - o) * log_range}
    u, d = mean("_u", 20), mean("_d", 20)
    return [first, {"vol_directional_bias": (u - d) / (u + d + EPS)}, {"vol_directional_accel": delta("vol_directional_bias", 3)}]


def liquidity() -> Levels:
    """From raw prices. The spread keeps the roles of its two range terms as the engine that it must match has them."""
    p = prices()
    v, r = p.v, p.r
    hi, lo, cl = F.col("high"), F.col("low"), F.col("close")
    bh, bl = lag("high"), lag("low")
    sq = lambda x: x * x
    d = 3 - 2 * math.sqrt(2)
    first = {"_gamma": sq(F.log(ratio(hi, lo))) + sq(F.log(ratio(bh, bl))), "_beta": sq(F.log(ratio(both_max(hi, bh), both_min(lo, bl)))), "_cv": cl * v}
    amihud = F.abs(r) / (F.nullif("_cv", F.lit(0.0)) + EPS)
    second = {"_alpha": (F.sqrt(2 * F.col("_beta")) - F.sqrt("_beta")) / d - F.sqrt(F.col("_gamma") / d), "liq_amihud_raw": amihud, "liq_turnover_ratio_20": F.col("_cv") / (mean("_cv", 20, 1) + EPS), "liq_log_turnover": F.log(F.col("_cv") + EPS)}
    e = F.exp("_alpha")
    third = {"liq_spread_cs": floored(2 * (e - 1) / (1 + e)), "liq_amihud_pct_rank": pct_rank("liq_amihud_raw", 20), "liq_amihud_z": z("liq_amihud_raw", 20)}
    return [first, second, third]


def market_context() -> Levels:
    """Empty plan where mkt_return is absent: see compute()."""
    r0 = prices().r0
    first = {"_a": r0, "_m": zero(lag("mkt_return"))}
    a, m = F.col("_a"), F.col("_m")
    full = lambda agg, n: F.when(F.count("*").over(frame(n)) == n, agg.over(frame(n)))
    second = {
        "mkt_relative_return": a - m, "mkt_rs_cum_20": total("_a", 20) - total("_m", 20),
        "mkt_rolling_beta_60": F.greatest(F.lit(-1.0), F.least(F.lit(3.5), full(F.covar_samp("_a", "_m"), 60) / (full(F.var_samp("_m"), 60) + EPS))),
        "mkt_vol_ratio_20": std("_a", 20) / (std("_m", 20) + EPS), "mkt_correlation_20": zero(F.when(F.count("*").over(frame(20)) == 20, correlation("_a", "_m", frame(20)))),
        "mkt_divergence_signed": F.signum(a) * F.signum(m) * (a - m),
    }
    second["mkt_rolling_beta_60"] = F.when(F.count("*").over(frame(60)) == 60, second["mkt_rolling_beta_60"])
    return [first, second, {"mkt_rs_momentum": delta("mkt_rs_cum_20", 5), "mkt_beta_shock": delta("mkt_rolling_beta_60", 5)}]


def jump() -> Levels:
    r0 = prices().r0
    first = {"_r0": r0, "_r2": r0 * r0}
    second = {"_bp": F.abs("_r0") * F.abs(lag("_r0"))}
    third = {"_rv": total("_r2", 20), "_bv": math.pi / 2 * total("_bp", 20)}
    rv, bv = F.col("_rv"), F.col("_bv")
    fourth = {"jump_diffusion_component": floored(rv - bv) / (rv + EPS), "continuous_vol_ratio": bv / (rv + EPS)}
    return [first, second, third, fourth, {"jump_signed_shock": F.col("jump_diffusion_component") * F.signum("_r0")}]


def pattern(x: str) -> Column:
    """Number of the order of three consecutive values, ties as a stable sort leaves them."""
    a, b, d = lag(x, 2), lag(x, 1), F.col(x)
    first = F.when((a <= b) & (a <= d), 0).when((b < a) & (b <= d), 1).otherwise(2)
    rest = F.when(first == 0, (b > d).cast("int")).when(first == 1, (a > d).cast("int")).otherwise((a > b).cast("int"))
    return F.when(a.isNotNull(), first * 2 + rest)


def complexity(n: int = 20) -> Levels:
    r0 = prices().r0
    windows = n - 2
    shares = [F.count_if(F.col("_pat") == k).over(frame(windows)) / windows for k in range(6)]
    entropy = reduce(lambda s, p: s - F.when(p > 0, p * F.log2(p + EPS)).otherwise(0.0), shares, F.lit(0.0)) / math.log2(6)
    flips = {"_r0": r0, "_sign": (r0 > 0).cast("int")}
    return [flips, {"_pat": pattern("_r0"), "_flip": F.abs(delta("_sign")).cast("double")}, {"chaos_permutation_entropy_20": F.when(F.count("_pat").over(frame(windows)) == windows, entropy), "lz_complexity_proxy_20": mean("_flip", n)}]


def fractional_of(df: DataFrame, orders: DataFrame, x: str = "close_adj", out: str = "frac_diff_d", least_rows: int = 10) -> DataFrame:
    """df with each symbol's fractional difference by its own order in orders(symbol, optimal_d); null unless 0 < order < 1."""
    step = lambda w, k: F.concat(w, F.array(-F.element_at(w, -1) * (F.col("_d") - k + 1) / k))
    weights = F.aggregate(F.sequence(F.lit(1), F.lit(99)), F.array(F.lit(1.0)), lambda w, k: F.when(F.abs(F.element_at(step(w, k), -1)) >= 1e-4, F.when(F.size(w) == k, step(w, k)).otherwise(w)).otherwise(w))
    known = orders.where("optimal_d > 0 and optimal_d < 1").select("symbol", F.col("optimal_d").alias("_d")).withColumn("_w", weights)
    values = F.collect_list(F.struct(F.col(x).alias("x"))).over(frame(100))
    joined = df.withColumn("_recent", F.transform(F.reverse(values), lambda v: F.coalesce(v["x"], F.lit(0.0)))).withColumn("_n", F.count(x).over(frame(100))).join(known, "symbol", "left")
    n = F.least(F.size("_recent"), F.size("_w"))
    products = F.zip_with(F.slice("_recent", F.lit(1), n), F.slice("_w", F.lit(1), n), lambda a, b: a * b)
    value = F.aggregate(products, F.lit(0.0), lambda s, t: s + t)
    return joined.withColumn(out, F.when(F.col("_w").isNotNull() & (F.col("_n") >= least_rows), value)).drop("_recent", "_n", "_d", "_w")


def fractional(d: float = 0.4, x: str = "close_adj", least_rows: int = 10) -> Levels:
    """The current value takes part; missing ones count 0; null before `least_rows` values."""
    w = difference_weights(d)
    recent = F.collect_list(x).over(frame(len(w)))
    weights = F.array(*[F.lit(k) for k in w])
    n = F.size(recent)
    value = F.aggregate(F.zip_with(F.reverse(recent), F.slice(weights, F.lit(1), n), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return [{f"frac_diff_d{d:.2f}": F.when(n >= least_rows, value)}]


def sizes(columns: list[str]) -> tuple[str, str] | None:
    """The bid and ask sizes of the first level of a ladder, else of the best quotes."""
    return next(((b, a) for b, a in (("bid_size_1", "ask_size_1"), ("bid_size", "ask_size")) if {b, a} <= set(columns)), None)


def order_book(columns: list[str] = ("bid_size", "ask_size")) -> Levels:
    """Needs micro_mid_deviation and l2_spread. Features of sizes come where df has some; in a symbol whose sizes are all 0 or
    missing they are null."""
    out = {"l2_micro_dev_raw": F.col("micro_mid_deviation"), "l2_micro_dev_diff": delta("micro_mid_deviation"), "l2_spread_zscore": z("l2_spread", 20)}
    found = sizes(list(columns))
    if not found:
        return [out]
    whole = Window.partitionBy("symbol")
    some = (F.coalesce(F.sum(found[0]).over(whole), F.lit(0.0)) != 0) | (F.coalesce(F.sum(found[1]).over(whole), F.lit(0.0)) != 0)
    first = {"_some": some}
    b, a = F.when(F.col("_some"), F.col(found[0])), F.when(F.col("_some"), F.col(found[1]))
    gone = lambda x: F.when(F.col("_some"), zero(floored(x)))
    out |= {
        "l2_order_imbalance_raw": b - a, "l2_depth_total": b + a, "l2_depth_ratio": b / (a + EPS),
        "l2_bid_replenishment": gone(delta(found[0])), "l2_ask_replenishment": gone(delta(found[1])), "l2_bid_withdrawal": gone(-delta(found[0])), "l2_ask_withdrawal": gone(-delta(found[1])),
    }
    return [first, out, {"l2_order_imbalance_z": z("l2_order_imbalance_raw", 20)}]


def toxicity(columns: list[str] = ()) -> Levels:
    """From the sizes that df has, else from where a bar closes in its range."""
    p = prices()
    v, clv = p.v, p.clv
    found = sizes(list(columns))
    first = {"flow_imbalance_proxy": F.col(found[0]) - F.col(found[1]) if found else clv * v}
    return [first, {"_abs": F.abs("flow_imbalance_proxy"), "flow_imbalance_zscore": z("flow_imbalance_proxy", 20)}, {"flow_vpin_10": total("_abs", 10) / (total("volume", 10) + EPS)}]


def nonlinear() -> Levels:
    p = prices()
    v, r0, log_range = p.v, p.r0, p.log_range
    return [{"nonlin_ret_squared_signed": r0 * r0 * F.signum(r0), "nonlin_ret_cubed": r0 * r0 * r0, "nonlin_range_x_ret": log_range * r0, "nonlin_ret_x_volshock": r0 * v / (mean("volume", 20, 1) + EPS)}]


def regime() -> Levels:
    r0 = prices().r0
    first = {"_r0": r0}
    second = {"_vol": std("_r0", 20)}
    median = F.when(F.count("_vol").over(frame(60, 1)) == 60, F.percentile("_vol", F.lit(0.5)).over(frame(60, 1)))
    third = {"regime_p_high_vol": F.coalesce((F.col("_vol") > median).cast("double"), F.lit(0.0))}
    return [first, second, third, {"regime_weighted_return": F.col("_r0") * F.col("regime_p_high_vol"), "regime_transition_shock": F.abs(delta("regime_p_high_vol"))}]


def efficiency() -> Levels:
    """Hurst proxy, entropy of a histogram of ten bins over the frame's range, Kaufman's ratio."""
    r0 = prices().r0
    first = {"_r0": r0, "_move": F.abs(delta("close_adj"))}
    values = F.collect_list("_r0").over(frame(20))
    low, high = F.array_min(values), F.array_max(values)
    bins = F.transform(values, lambda x: F.least(F.floor(F.try_divide(x - low, high - low) * 10), F.lit(9)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.size(F.filter(bins, lambda b: b == k)) / 20)
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0))
    second = {
        "chaos_hurst_proxy": F.log(ratio(std("_r0", 20), std("_r0", 5) + EPS)) / math.log(4),
        "chaos_shannon_entropy_20": F.when(F.count("_r0").over(frame(20)) == 20, F.when(high > low, entropy).otherwise(0.0)),
        "chaos_kaufman_er_10": F.abs(delta("close_adj", 10)) / (total("_move", 10) + EPS),
    }
    return [first, second]


def stress() -> Levels:
    r0 = prices().r0
    grown = F.product(1 + F.col("_r0")).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    first = {"_r0": r0, "_pos": F.greatest(r0, F.lit(0.0)), "_neg": F.least(r0, F.lit(0.0))}
    second = {"_s": grown, "asym_ratio_20": std("_pos", 20) / (std("_neg", 20) + EPS)}
    top = rolled(F.max, "_s", 20)
    return [first, second, {"drawdown_20": (F.col("_s") - top) / (top + EPS)}, {"drawdown_velocity": delta("drawdown_20")}]


def vol_term() -> Levels:
    r0 = prices().r0
    return [{"_r0": r0}, {"vts_5_20": std("_r0", 5) / (std("_r0", 20) + EPS)}, {"vol_accel": delta("vts_5_20")}]


def vwap() -> Levels:
    p = prices()
    h, l, c, v = p.h, p.l, p.c, p.v  # noqa: E741
    first = {"_tpv": (h + l + c) / 3 * v}
    price = total("_tpv", 20) / (total("volume", 20) + EPS)
    return [first, {"vwap_distance_20": (c - price) / (price + EPS)}]


def roll_measure() -> Levels:
    """Correlation of a return with the one before, over 20 returns."""
    return [{"_b": lag("log_return")}, {"liq_roll_measure_20": F.when(F.count("_b").over(frame(19)) == 19, correlation("log_return", "_b", frame(19)))}]


#: The strategies that the router runs, in its order.
ROUTED: dict[str, Callable[[], Levels]] = {
    "baseline": baseline, "trend": trend, "oscillator": oscillator, "volatility": volatility, "kinematic": kinematic, "wavelet": wavelet,
    "intraday": intraday, "flow_divergence": flow_divergence, "directional": directional, "signed_volatility": signed_volatility, "liquidity": liquidity, "market_context": market_context,
}
EXTRA: dict[str, Callable[[], Levels]] = {
    "jump": jump, "complexity": complexity, "fractional": fractional, "order_book": order_book, "toxicity": toxicity, "nonlinear": nonlinear, "regime": regime,
    "efficiency": efficiency, "stress": stress, "vol_term": vol_term, "vwap": vwap, "kinematic_more": kinematic_more, "roll_measure": roll_measure,
}


def compute(df: DataFrame, strategies: list[Callable[[], Levels]]) -> tuple[DataFrame, list[str]]:
    """df with the strategies' features, and their names. Helper columns are dropped between strategies, whose windows all
    use df's one exchange and sort. market_context is skipped where there is no mkt_return."""
    names: list[str] = []
    for s in strategies:
        if s is market_context and "mkt_return" not in df.columns:
            continue
        levels = s(df.columns) if s in (order_book, toxicity) else s()
        df = staged(df, *levels)
        made = [n for level in levels if not callable(level) for n in level]
        helpers = [n for n in made if n.startswith("_")]
        names += [n for n in made if not n.startswith("_") and n not in names]
        df = df.drop(*helpers)
    return df, names


def route(df: DataFrame, shift: bool = True) -> tuple[DataFrame, list[str]]:
    """df with all routed features, one bar late so that none sees its own bar."""
    out, names = compute(df, list(ROUTED.values()))
    return (out.withColumns({n: lag(n) for n in names}), names) if shift else (out, names)


def regime_rank(df: DataFrame, high: float = 0.70) -> DataFrame:
    """regime_vol_rank_60 and regime_is_high_vol."""
    r0 = prices().r0
    rank = F.coalesce((F.col("regime_vol_rank_60") >= high).cast("double"), F.lit(0.0))
    return staged(df, {"_r0": r0}, {"_vol": std("_r0", 20)}, {"regime_vol_rank_60": pct_rank("_vol", 60)}, {"regime_is_high_vol": rank}).drop("_r0", "_vol")


def accelerated(df: DataFrame, lags: dict[str, int]) -> DataFrame:
    """{col}_acceleration: the change of a column's momentum over its lag from one bar to the next; lags aren't clamped."""
    steps = {f"_m_{x}": (F.col(x) - lag(x, k)) / (F.abs(lag(x, k)) + EPS) for x, k in lags.items()}
    return staged(df, steps, {f"{x}_acceleration": delta(f"_m_{x}") for x in lags}).drop(*steps)


def lagged(df: DataFrame, lags: dict[str, int], most: int = 2) -> DataFrame:
    """{col}_zscaled_lag{L} and {col}_momentum for each column and its lag, clamped to 1 .. most."""
    out = {}
    for x, k in lags.items():
        k = min(max(int(k), 1), most)
        out[f"{x}_zscaled_lag{k}"] = (lag(x, k) - mean(x, 20, k)) / (std(x, 20, k) + EPS)
        out[f"{x}_momentum"] = (F.col(x) - lag(x, k)) / (F.abs(lag(x, k)) + EPS)
    return df.withColumns(out)
