"""From probabilities to trades: thresholds, bets, lock-out of overlapping trades, equity, risk."""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.series import frame, ordered
from tidewright.functions.tables import written


def rolling_signals(df: DataFrame, window: int = 60, percentile: float = 0.65, least: int = 30, include_current: bool = True, prob: str = "prob_up") -> DataFrame:
    """dynamic_threshold (percentile of the last `window` probabilities), pred_signal, z and bet_size."""
    w = frame(window, 0 if include_current else 1)
    p = F.col(prob)
    enough = F.count(prob).over(w) >= least
    out = df.withColumn("dynamic_threshold", F.when(enough, F.percentile(prob, F.lit(percentile)).over(w)))
    out = out.withColumn("z", F.when(enough, (p - F.avg(prob).over(w)) / (F.stddev_pop(prob).over(w) + 1e-8)))
    out = out.withColumn("pred_signal", F.coalesce((p >= F.col("dynamic_threshold")).cast("int"), F.lit(0)))
    bet = F.least(F.lit(1.0), F.greatest(F.lit(0.2), 0.2 + (F.col("z") - 0.5) * 0.8 / 1.5))
    return out.withColumn("bet_size", F.when(F.col("pred_signal") == 1, F.coalesce(bet, F.lit(0.2))).otherwise(0.0))


def static_signals(df: DataFrame, threshold: float = 0.5, prob: str = "prob_up") -> DataFrame:
    p = F.col(prob)
    return df.withColumn("pred_signal", F.coalesce((p >= threshold).cast("int"), F.lit(0))).withColumn("bet_size", F.when(F.col("pred_signal") == 1, F.least(F.lit(1.0), F.greatest(F.lit(0.2), (p - 0.5) / 0.5))).otherwise(0.0))


def probability_buffer(train: DataFrame, test: DataFrame, window: int = 60) -> DataFrame:
    """The last `window` training rows of each symbol and all test rows."""
    recent = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    tail = train.withColumn("__n", F.row_number().over(recent)).where(F.col("__n") <= window).drop("__n")
    return tail.withColumn("is_test", F.lit(0)).unionByName(test.withColumn("is_test", F.lit(1)))


def locked_out(df: DataFrame, by: tuple = ("symbol",)) -> DataFrame:
    """executed_signal: a signal is taken if the last taken one's barrier_touch_time has come; without one it never comes.

    One pass over each group's ordered signals (not bars), as they stream in sorted; its state is the unlocking time.
    """
    far = 2**62
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    signals = df.where("pred_signal = 1").select(*by, "ts", micros("ts").alias("at"), F.coalesce(micros("barrier_touch_time"), F.lit(far)).alias("until"))
    dealt = signals.repartition(*by).sortWithinPartitions(*by, "at", "until")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, free = None, -far
        for batch in batches:
            keep = []
            for key, at, until in zip(zip(*(batch[c].to_pylist() for c in by)), batch["at"].to_pylist(), batch["until"].to_pylist()):
                if key != now:
                    now, free = key, -far
                keep.append(at >= free)
                if at >= free:
                    free = until
            yield pa.RecordBatch.from_arrays([*(batch[c].filter(pa.array(keep)) for c in (*by, "ts"))], names=[*by, "ts"])

    kinds = dict(df.dtypes)
    chosen = dealt.mapInArrow(taken, ", ".join(f"`{c}` {kinds[c]}" for c in (*by, "ts"))).distinct().withColumn("executed_signal", F.lit(1))
    return df.join(chosen, [*by, "ts"], "left").fillna(0, ["executed_signal"])


def executed(df: DataFrame, cost: float = 0.002, ret: str = "barrier_return") -> DataFrame:
    on = F.col("executed_signal") == 1
    out = df.withColumns({"executed_return": F.when(on, F.col(ret)).otherwise(0.0), "executed_bet": F.when(on, F.col("bet_size")).otherwise(0.0)})
    out = out.withColumn("trade_cost", 2 * cost * F.col("executed_bet"))
    return out.withColumn("net_trade_pnl", F.col("executed_return") * F.col("executed_bet") - F.col("trade_cost"))


def equity(df: DataFrame, by: tuple = ("symbol",)) -> DataFrame:
    """equity_curve, peak_equity (of the curve itself, which starts after the first trade) and drawdown."""
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("equity_curve", F.product(1 + F.col("net_trade_pnl")).over(w))
    out = out.withColumn("peak_equity", F.max("equity_curve").over(w))
    return out.withColumn("drawdown", (F.col("equity_curve") - F.col("peak_equity")) / F.col("peak_equity"))


def risk_metrics(df: DataFrame, by: tuple = ("symbol",), risk_free: float = 0.045, days: int = 252) -> DataFrame:
    """One row a group of equity()'s rows. A ratio without a loss below it, a growth rate after a total loss, and a Calmar ratio
    without a drawdown are null; so are the ratios of groups without trades, whose other metrics are 0."""
    on = F.col("executed_signal") == 1
    pnl = F.when(on, F.col("net_trade_pnl"))
    gain, loss = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    g = df.groupBy(*by).agg(
        F.count(pnl).alias("n"), F.count("*").alias("rows"), F.count(gain).alias("wins"), F.sum(gain).alias("won"), F.sum(loss).alias("lost"), F.avg(gain).alias("avg_win"), F.avg(loss).alias("avg_loss"),
        F.max_by("equity_curve", "ts").alias("final"), F.avg("net_trade_pnl").alias("mean"), F.stddev_samp("net_trade_pnl").alias("sd"), F.stddev_samp(F.when(F.col("net_trade_pnl") < 0, F.col("net_trade_pnl"))).alias("down"), F.count_if(F.col("net_trade_pnl") < 0).alias("falls"),
        F.min("drawdown").alias("max_dd"), F.avg(F.when(on, F.col("bet_size"))).alias("bet"),
    )
    year = F.col("rows") / days
    cum, sd = F.col("final") - 1, F.col("sd") * days**0.5
    cagr = F.when(cum > -1, F.pow(1 + cum, 1 / year) - 1)
    excess = F.col("mean") * days - risk_free
    down = F.when(F.col("falls") > 1, F.col("down") * days**0.5).otherwise(1e-8)
    traded = lambda x: F.when(F.col("n") > 0, x).otherwise(0.0)
    known = lambda x: F.when(F.col("n") > 0, x)
    return g.select(
        *by, F.col("n").alias("total_trades"), traded(F.try_divide("wins", "n")).alias("win_rate"),
        known(F.try_divide(F.coalesce("won", F.lit(0.0)), F.abs("lost"))).alias("profit_factor"), known(F.try_divide(F.coalesce("avg_win", F.lit(0.0)), F.abs("avg_loss"))).alias("win_loss_ratio"),
        traded(cum).alias("cum_return"), traded(cagr).alias("cagr"), traded(sd).alias("ann_vol"), traded(F.when(sd > 0, excess / sd).otherwise(0.0)).alias("sharpe"),
        traded(F.when(down > 0, excess / down).otherwise(0.0)).alias("sortino"), traded(F.col("max_dd")).alias("max_drawdown"), known(F.when(F.col("max_dd") < 0, cagr / F.abs("max_dd"))).alias("calmar"), traded(F.col("bet")).alias("avg_bet"),
    )


def metrics_with_total(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Metrics of each symbol's folds, their equity begun anew, and of all its rows. Trades are computed once and written."""
    df = written(df)
    by_fold = risk_metrics(equity(df, ("symbol", fold)), ("symbol", fold)).withColumn("label", F.concat(F.lit("Fold "), F.col(fold).cast("string"))).drop(fold)
    return by_fold.unionByName(risk_metrics(equity(df)).withColumn("label", F.lit("Full OOS")))


def plot_data(df: DataFrame) -> DataFrame:
    """What an equity plot needs: ts, equity, drawdown, and where a fold begins."""
    first = F.col("fold") != F.lag("fold").over(ordered())
    return df.select("symbol", "ts", "equity_curve", "drawdown", F.coalesce(first, F.lit(True)).alias("fold_start"))


def entry_rates(df: DataFrame) -> DataFrame:
    s: Column = F.col("pred_signal")
    t = "dynamic_threshold"
    return df.groupBy("fold").agg(F.avg(s.cast("double")).alias("entry_rate"), F.min(t).alias("min_threshold"), F.avg(t).alias("mean_threshold"), F.max(t).alias("max_threshold"))
