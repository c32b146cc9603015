"""Order-book columns from ladders of quotes, or from the best quotes."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.series import EPS


def book(df: DataFrame, levels: int = 10) -> DataFrame:
    """mid_price, l2_spread, order_imbalance_depth, micro_price_depth and micro_mid_deviation from two or more levels; else
    micro_price, spread and imbalance from the best quotes; else df."""
    known = [i for i in range(1, levels + 1) if {f"bid_price_{i}", f"ask_price_{i}"} <= set(df.columns)]
    if len(known) >= 2:
        size = lambda side, i: F.col(f"{side}_size_{i}") * math.exp(-0.5 * (i - 1))
        paid = lambda side: reduce(add, [F.col(f"{side}_price_{i}") * size(side, i) for i in known])
        df = df.withColumns({"mid_price": (F.col("bid_price_1") + F.col("ask_price_1")) / 2, "l2_spread": F.col("ask_price_1") - F.col("bid_price_1")})
        df = df.withColumns({"_b": reduce(add, [size("bid", i) for i in known]), "_a": reduce(add, [size("ask", i) for i in known])})
        b, a = F.col("_b"), F.col("_a")
        micro = (paid("bid") / (b + EPS) * a + paid("ask") / (a + EPS) * b) / (b + a + EPS)
        df = df.withColumns({"order_imbalance_depth": (b - a) / (b + a + EPS), "micro_price_depth": micro}).drop("_b", "_a")
        return df.withColumn("micro_mid_deviation", F.col("micro_price_depth") - F.col("mid_price"))
    if {"best_bid", "best_ask", "bid_size", "ask_size"} <= set(df.columns):
        b, a, bs, as_ = (F.col(x) for x in ("best_bid", "best_ask", "bid_size", "ask_size"))
        df = df.withColumns({"mid_price": (b + a) / 2, "l2_spread": a - b, "order_imbalance_depth": (bs - as_) / (bs + as_ + EPS), "micro_price": (b * as_ + a * bs) / (bs + as_ + EPS)})
        return df.withColumn("micro_mid_deviation", F.col("micro_price") - F.col("mid_price"))
    return df
