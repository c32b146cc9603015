"""Diagnostics of each symbol's series: aggregations where SQL can express them, else one Arrow group a symbol."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import kernels as k
from tidewright.functions.tables import spread
from tidewright.functions.series import EPS, correlation, lag, ratio, rolled


def distribution(df: DataFrame, x: str = "log_return") -> DataFrame:
    """Moments and the Jarque-Bera test of x by symbol."""
    g = df.groupBy("symbol").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    jb = n / 6 * (g1 * g1 + g2 * g2 / 4)
    skew = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3
    ok = n >= 30
    return g.select("symbol", "n", "mean", "std", F.when(ok, skew).otherwise(0.0).alias("skewness"), F.when(ok, kurt).otherwise(3.0).alias("kurtosis"), F.when(ok, jb).otherwise(0.0).alias("jb_stat"), F.when(ok, F.exp(-jb / 2)).otherwise(1.0).alias("jb_p"), F.coalesce(ok & (kurt > 3), F.lit(False)).cast("int").alias("fat_tailed"))


def autocorrelation(df: DataFrame, x: str = "log_return", lags: int = 10) -> DataFrame:
    """ACF by symbol and lag, with the 95 % bound."""
    named = df.where(F.col(x).isNotNull()).select("symbol", "ts", x)
    means = named.groupBy("symbol").agg(F.avg(x).alias("m"))
    e = named.join(means, "symbol").withColumn("e", F.col(x) - F.col("m"))
    e = e.withColumns({f"l{i}": lag("e", i) for i in range(1, lags + 1)})
    g = e.groupBy("symbol").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("e") * F.col(f"l{i}")) / F.sum(F.col("e") * F.col("e")) for i in range(1, lags + 1)]).alias("acf"))
    out = g.select("symbol", "n", F.posexplode("acf").alias("pos", "acf"))
    return out.select("symbol", (F.col("pos") + 1).cast("int").alias("lag"), "acf", (F.abs("acf") > 1.96 / F.sqrt("n")).cast("int").alias("significant"))


def jumps(df: DataFrame, window: int = 20) -> DataFrame:
    """Mean share of jumps in realised variance by symbol, over its returns, and whether over 5 % of these have one over 0.25;
    nothing for under two windows of returns. The first window of products of neighbours is one short, and so missing."""
    r = df.where(F.col("log_return").isNotNull()).select("symbol", "ts", F.col("log_return").alias("r"))
    r = r.withColumns({"_sq": F.col("r") * F.col("r"), "_two": F.abs("r") * F.abs(lag("r"))})
    rv, bv = rolled(F.sum, "_sq", window), float(np.pi / 2) * rolled(F.sum, "_two", window)
    j = r.withColumn("j", F.when(bv.isNotNull(), F.greatest(rv - bv, F.lit(0.0)) / (rv + EPS)))
    g = j.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("j").alias("mean_ratio"), F.count_if(F.col("j") > 0.25).alias("jump_bars"))
    enough = F.col("n") >= 2 * window
    return g.select("symbol", F.when(enough, F.col("mean_ratio")).otherwise(0.0).alias("mean_ratio"), F.when(enough, F.col("jump_bars")).otherwise(0).alias("jump_bars"), (enough & (F.col("jump_bars") > 0.05 * F.col("n"))).cast("int").alias("has_jumps"))


def pattern_entropy(df: DataFrame, x: str = "log_return") -> DataFrame:
    """Permutation entropy of order three by symbol; 1 for under 30 values."""
    from tidewright.operators.features import pattern

    named = df.where(F.col(x).isNotNull()).select("symbol", "ts", x)
    p = named.withColumn("p", pattern(x)).where(F.col("p").isNotNull()).groupBy("symbol", "p").agg(F.count("*").alias("c"))
    g = p.groupBy("symbol").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return g.select("symbol", F.when(F.col("n") >= 28, (F.log2("n") - F.col("s") / F.col("n")) / float(np.log2(6))).otherwise(1.0).alias("entropy"))


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's coefficient of two columns by symbol, ties at their mean rank, and its t statistic."""
    from pyspark.sql import Window

    ok = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rank = lambda x: F.rank().over(Window.partitionBy("symbol").orderBy(x)) + (F.count("*").over(Window.partitionBy("symbol", x)) - 1) / 2
    g = ok.withColumns({"_ra": rank(a), "_rb": rank(b)}).groupBy("symbol").agg(F.count("*").alias("n"), correlation("_ra", "_rb").alias("rho"))
    return g.withColumn("t_stat", F.col("rho") * F.sqrt(ratio((F.col("n") - 2).cast("double"), 1 - F.col("rho") ** 2)))


def fitted_regime(train: DataFrame, df: DataFrame) -> DataFrame:
    """gmm_prob_bull and gmm_prob_bear of df's (return, Parkinson volatility): one mixture for each symbol, fitted on its training
    rows and applied to all of df's. A symbol is one group."""

    def pair(d: DataFrame) -> DataFrame:
        spread = F.log(ratio(F.col("high_adj"), F.col("low_adj")))
        return d.select(F.col("symbol").alias("symbol"), F.col("ts").alias("ts"), F.coalesce("log_return", F.lit(0.0)).alias("a"), F.coalesce(F.sqrt(spread * spread / float(4 * np.log(2))), F.lit(0.0)).alias("b"))

    def fit(past: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        x = past.sort_values("ts")[["a", "b"]].to_numpy(float)
        p = np.zeros((len(now), 2))
        if len(x) > 10 and x[:, 0].var() > 1e-8:
            p = k.responsibilities(now[["a", "b"]].to_numpy(float), *k.two_gaussians(x))
        return now[["symbol", "ts"]].assign(gmm_prob_bull=p[:, 1], gmm_prob_bear=p[:, 0])

    return pair(train).groupBy("symbol").cogroup(pair(df).groupBy("symbol")).applyInPandas(fit, "symbol string, ts timestamp, gmm_prob_bull double, gmm_prob_bear double")


def leverage(df: DataFrame) -> DataFrame:
    """Correlation of a return with the next squared one by symbol."""
    w = df.withColumn("_l", lag("log_return"))
    return w.groupBy("symbol").agg(correlation("_l", F.col("log_return") * F.col("log_return")).alias("leverage")).withColumn("is_asymmetric", (F.col("leverage") < -0.1).cast("int"))


#: The hypotheses of a payload.
FLAGS = ("has_long_trend", "has_short_reversion", "has_vol_clustering", "has_asymmetric_vol", "is_volume_significant", "is_nonlinear", "has_vol_jumps", "is_high_complexity", "has_l2_orderbook", "micro_deviation_sig")
STATISTICS = ("hurst", "vr_3", "vr_3_p", "vr_20", "vr_20_p", "adf_p", "kpss_p", "memory_corr", "arch_p", "leverage", "volume_corr", "volume_p", "bds_stat", "bds_p", "mi_lag1", "jump_ratio", "entropy", "micro_corr", "micro_p", "spread_adf_p")
PAYLOAD = f"symbol string, dynamic_lags array<int>, optimal_d double, dominant_cycle int, price_stationary boolean, {', '.join(f'{x} double' for x in STATISTICS)}, flags struct<{', '.join(f'{x}: boolean' for x in FLAGS)}>"


def _one(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("ts", kind="stable")
    price = pdf["close_adj"].dropna().to_numpy(float)
    r = pdf["log_return"].dropna().to_numpy(float)
    x = dict.fromkeys(STATISTICS, 0.0) | dict.fromkeys([c for c in STATISTICS if c.endswith("_p")], 1.0) | {"vr_3": 1.0, "vr_20": 1.0, "hurst": 0.5}
    lags = [1, 3, 5]
    if len(r) >= 50:
        a = k.acf(r, min(30, len(r) // 3))
        sig = [i for i in range(1, len(a)) if abs(a[i]) > 1.96 / np.sqrt(len(r))] or [1, 3, 5]
        lags = sorted({*sig[:5], 1, 5, 20})
        (x["vr_3"], _, x["vr_3_p"]), (x["vr_20"], _, x["vr_20_p"]) = k.variance_ratio(price, 3), k.variance_ratio(price, 20)
        x["hurst"] = k.hurst_dfa(r)
        left = k.ar1_residuals(r)
        if left.std() > 0:
            x["bds_stat"], x["bds_p"] = k.bds((left - left.mean()) / (left.std() + EPS))
        x["mi_lag1"] = k.mutual_information_of_series(r[:-1], r[1:])
    d, stationary = 1.0, False
    if len(price) >= 50:
        d, _, x["memory_corr"] = k.optimal_difference(price)
        x["adf_p"], x["kpss_p"] = k.adf(price)[1], k.kpss(price)[1]
        stationary = x["adf_p"] < 0.05 < x["kpss_p"]
    if len(r) >= 30:
        x["arch_p"], x["leverage"] = k.arch_lm(r), k.pearson(r[:-1], r[1:] ** 2)
    both = pdf[["volume", "log_return"]].dropna() if "volume" in pdf else pdf[:0]
    if len(both) >= 30:
        x["volume_corr"], x["volume_p"] = k.rank_test(both["volume"].to_numpy(float), both["log_return"].abs().to_numpy(float))
    if len(r) >= 40:
        x["jump_ratio"], many = k.jump_share(r)
    x["entropy"] = k.permutation_entropy(r)
    book = "micro_mid_deviation" in pdf and "l2_spread" in pdf
    if book:
        before = pdf["micro_mid_deviation"].fillna(0.0).shift(1).fillna(0.0).to_numpy(float)
        x["micro_corr"], x["micro_p"] = k.rank_test(before, pdf["log_return"].fillna(0.0).to_numpy(float))
        x["spread_adf_p"] = k.adf(pdf["l2_spread"].fillna(0.0).to_numpy(float))[1] if len(pdf) >= 20 else 1.0
    flags = dict(zip(FLAGS, (
        x["vr_20"] > 1 and x["vr_20_p"] < 0.05, x["vr_3"] < 1 and x["vr_3_p"] < 0.05, x["arch_p"] < 0.05, x["leverage"] < -0.1, x["volume_p"] < 0.05 and x["volume_corr"] > 0.1, x["bds_p"] < 0.05,
        len(r) >= 40 and many > 0.05 * len(r), len(r) >= 30 and x["entropy"] > 0.85, book, book and x["micro_p"] < 0.05 and abs(x["micro_corr"]) > 0.05,
    )))
    return pd.DataFrame([{"symbol": pdf["symbol"].iloc[0], "dynamic_lags": lags, "optimal_d": d, "dominant_cycle": k.dominant_cycle(price), "price_stationary": bool(stationary), **x, "flags": {f: bool(v) for f, v in flags.items()}}])


def scan(df: DataFrame) -> DataFrame:
    """The routing payload of each symbol: lags, order of difference, cycle, statistics and the ten flags. The order book takes
    part where df has micro_mid_deviation and l2_spread. Each symbol's series is one group."""
    book = [c for c in ("micro_mid_deviation", "l2_spread") if c in df.columns]
    return spread(df.select("symbol", "ts", "close_adj", "volume", "log_return", *book), "symbol").groupBy("symbol").applyInPandas(_one, PAYLOAD)


def regime_probabilities(df: DataFrame, train: int = 120, step: int = 20) -> DataFrame:
    """gmm_prob_bull and gmm_prob_bear: a mixture of (return, deviation) fitted on the `train` bars before each block of
    `step` bars. Blocks are groups of their own, each with the bars before it."""
    f = df.withColumn("_r0", F.coalesce("log_return", F.lit(0.0))).withColumn("_vol", rolled(F.stddev_samp, "_r0", 20))
    from pyspark.sql import Window

    f = f.select("symbol", "ts", "_r0", F.coalesce("_vol", F.lit(0.0)).alias("_vol")).withColumn("row", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)
    own = F.floor((F.col("row") - train) / step)
    reach = -(-train // step)
    dealt = f.withColumn("block", F.explode(F.sequence(own, own + reach))).where(F.col("block") >= 0)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        begin = train + int(pdf["block"].iloc[0]) * step
        past, now = pdf[(pdf["row"] < begin) & (pdf["row"] >= begin - train)], pdf[(pdf["row"] >= begin) & (pdf["row"] < begin + step)]
        x = past[["_r0", "_vol"]].to_numpy(float)
        p = np.zeros((len(now), 2))
        if len(now) and len(x) > 10 and x[:, 0].var() > 1e-8:
            p = k.responsibilities(now[["_r0", "_vol"]].to_numpy(float), *k.two_gaussians(x))
        return pd.DataFrame({"symbol": now["symbol"], "ts": now["ts"], "gmm_prob_bull": p[:, 1], "gmm_prob_bear": p[:, 0]})

    return dealt.groupBy("symbol", "block").applyInPandas(fit, "symbol string, ts timestamp, gmm_prob_bull double, gmm_prob_bear double")
