"""Weighted portfolios of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUES = ["open", "high", "low", "close", "volume", "log_return"]


def back_filled(weights: DataFrame, first: int = 2018, base: int | None = None, legacy: bool = False) -> DataFrame:
    """weights(symbol, year, weight) with the base year's rows repeated for each year from `first` to the one before it.

    The base is the first year there is, so that no year has two sets; legacy takes the last year, and the years between
    then hold both sets, of which unique_weights() drops the tickers in both.
    """
    pick = F.max if legacy else F.min
    years = weights.agg(pick("year").alias("base")) if base is None else weights.sparkSession.createDataFrame([(base,)], "base int")
    rows = weights.join(F.broadcast(years), F.col("year") == F.col("base"))  # one row
    early = rows.where(F.col("base") > first).withColumn("year", F.explode(F.sequence(F.lit(first), F.col("base") - 1)))
    return weights.unionByName(early.select(weights.columns))


def unique_weights(weights: DataFrame) -> DataFrame:
    """Weights of (symbol, year) that occur once."""
    once = weights.groupBy("symbol", "year").agg(F.count("*").alias("n")).where("n = 1").select("symbol", "year")
    return weights.join(once, ["symbol", "year"], "left_semi")


def weighted(bars: DataFrame, weights: DataFrame, values: list[str] = VALUES, coverage: float = 1.0) -> DataFrame:
    """One synthetic bar a ts: the weighted sum over the year's symbols, null unless `coverage` of them have a bar then."""
    w = unique_weights(weights).select("symbol", "year", "weight")
    held = w.groupBy("year").agg(F.count_distinct("symbol").alias("held"))
    joined = bars.withColumn("year", F.year("ts")).join(w, ["symbol", "year"])
    sums = joined.groupBy("year", "ts").agg(F.count_distinct("symbol").alias("n"), *[F.when(F.count(x) == F.count("*"), F.sum(F.col("weight") * F.col(x))).alias(x) for x in values])
    enough = F.col("n") >= coverage * F.col("held")
    return sums.join(held, "year").select("ts", "n", "held", *[F.when(enough, F.col(x)).alias(x) for x in values])
