"""Triple-barrier labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.recursive import ewm_std, with_following


def triple_barrier(df: DataFrame, horizon: int = 5, up: float = 1.0, down: float = 1.0, span: int = 20, floor: float = 1e-4) -> DataFrame:
    """Adds local_volatility, target_label, target_barrier_return, barrier_touch_time to bars with close_adj and log_return.

    Barriers lie at up and down times the volatility known one bar before. The first close within `horizon` bars at or
    past one decides: 1 above, 0 below; without any the label is 0 at the horizon. A symbol's last `horizon` bars have
    none. The frame ahead lies within a range of (symbol, ts), so no task holds a symbol.
    """
    vol = ewm_std(df, "log_return", span, "local_volatility", floor=floor, ranged=True)
    out = with_following(vol, ["ts", "close_adj"], horizon, "__ahead")
    p, s = F.col("close_adj"), F.col("local_volatility")
    hit = F.filter("__ahead", lambda b: (b["close_adj"] >= p * (1 + up * s)) | (b["close_adj"] <= p * (1 - down * s)))
    out = out.withColumn("__hit", hit).withColumn("__at", F.when(F.size("__ahead") == horizon, F.coalesce(F.try_element_at("__hit", F.lit(1)), F.try_element_at("__ahead", F.lit(horizon)))))
    label = F.when(F.col("__at").isNull(), None).when((F.size("__hit") > 0) & (F.col("__at.close_adj") >= p * (1 + up * s)), 1).otherwise(0)
    return out.withColumns({"target_label": label.cast("int"), "target_barrier_return": F.col("__at.close_adj") / p - 1, "barrier_touch_time": F.col("__at.ts")}).drop("__ahead", "__hit", "__at")
