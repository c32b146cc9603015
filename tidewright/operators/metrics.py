"""Metrics of probabilities and predictions: one aggregation each, or one over ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.tables import cut
from tidewright.operators import order


def _bins(df: DataFrame, b: Column) -> DataFrame:
    return df.withColumn("bin", b).groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("mean_y"))


def brier_decomposition(df: DataFrame, bins: int = 5) -> DataFrame:
    """Reliability, resolution, uncertainty and Brier score of (p, y), in `bins` uniform bins."""
    b = _bins(df, F.greatest(F.lit(0), F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))))
    whole = df.agg(F.count("*").alias("rows"), F.avg(F.col("y").cast("double")).alias("base"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    j = b.crossJoin(F.broadcast(whole))  # one row
    return j.groupBy("brier", "base").agg((F.sum(F.col("n") * (F.col("mean_p") - F.col("mean_y")) ** 2) / F.max("rows")).alias("reliability"), (F.sum(F.col("n") * (F.col("mean_y") - F.col("base")) ** 2) / F.max("rows")).alias("resolution")).select("brier", "reliability", "resolution", (F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def calibration_curve(df: DataFrame, bins: int = 5, quantile: bool = False, drop_top: bool = False) -> DataFrame:
    """n, mean p and mean y by bin, uniform or between quantiles; drop_top leaves out rows at the largest quantile."""
    if not quantile:
        return _bins(df, F.greatest(F.lit(0), F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))).orderBy("bin")
    edges = order.quantiles(df, ["p"], [i / bins for i in range(bins + 1)])["p"]
    place = sum(((F.col("p") >= F.lit(e)).cast("int") for e in edges), F.lit(0)) - 1
    j = df.where(F.col("p") < F.lit(edges[-1])) if drop_top else df
    return _bins(j, F.least(place, F.lit(bins - 1))).orderBy("bin")


def classification_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of (y, pred) by class, and their macro and weighted means."""
    hit = F.col("y") == F.col("pred")
    classes = df.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), hit.cast("int").alias("h")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("c")).select("c.*")
    g = classes.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("said"), F.sum("h").alias("hits"))
    g = g.withColumns({"precision": F.coalesce(F.try_divide("hits", "said"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))})
    g = g.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    names = ["precision", "recall", "f1"]
    macro = g.agg(F.lit("macro").alias("label"), *[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    heavy = g.agg(F.lit("weighted").alias("label"), *[(F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names], F.sum("support").alias("support"))
    return g.select(F.col("label").cast("string").alias("label"), *names, "support").unionByName(macro).unionByName(heavy)


def roc_auc(df: DataFrame) -> DataFrame:
    """Exact area under the curve of (p, y): rank sums from counts by distinct p, ties at half. Running sums are taken within
    ranges of p and added to the negatives of the ranges before, so no task holds all scores."""
    g = df.groupBy("p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    g = cut(g.repartitionByRange("p").withColumn("range", F.spark_partition_id()))  # kept, so that ranges are the same twice
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = g.groupBy("range").agg(F.sum("neg").alias("sum")).select("range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("before") + F.coalesce(F.sum("neg").over(within), F.lit(0))
    won = g.join(ranges, "range").withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    return won.agg((F.sum("won") / (F.sum("pos") * F.sum("neg"))).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def scores(df: DataFrame, threshold: float = 0.5, eps: float = 1e-15) -> DataFrame:
    q = F.least(F.greatest("p", F.lit(eps)), F.lit(1 - eps))
    y = F.col("y").cast("double")
    return df.agg(F.avg((F.col("p") - y) ** 2).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"), F.avg(((F.col("p") >= threshold).cast("int") == F.col("y")).cast("double")).alias("accuracy"))


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("y").pivot("pred", [0, 1]).count().fillna(0).withColumnsRenamed({"0": "pred_0", "1": "pred_1"})


def crosstab_share(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Row-normalised percentages of `col`'s values by `row`."""
    n = F.count("*")
    return df.groupBy(row).agg(*[(100.0 * F.count_if(F.col(col) == v) / n).alias(f"{col}_{v}") for v in values])


def bet_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("fold").agg((100.0 * F.count_if(F.col("bet_size") > 0) / F.count("*")).alias("active_pct"), F.avg("bet_size").alias("mean_bet"), F.max("bet_size").alias("max_bet"))


def by_group(df: DataFrame, by: str, threshold: float = 0.5) -> DataFrame:
    """auc and acc of (p, y) by group: rank sums from counts by distinct p, whose windows lie within a group."""
    g = df.groupBy(by, "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = F.when(F.col("p") >= threshold, F.col("pos")).otherwise(F.col("neg"))
    g = g.withColumns({"won": F.col("pos") * (below + F.col("neg") / 2), "hit": hit})
    return g.groupBy(by).agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"), (F.sum("hit") / F.sum(F.col("pos") + F.col("neg"))).alias("acc"))


def stability(selected: DataFrame) -> DataFrame:
    """In how many folds each of (fold, features array) was selected."""
    return selected.select("fold", F.explode("features").alias("feature")).groupBy("feature").agg(F.count_distinct("fold").alias("folds"))


def generalisation_gap(train: DataFrame, test: DataFrame) -> DataFrame:
    """(fold, auc, acc) of training and test side by side."""
    t = test.withColumnsRenamed({"auc": "test_auc", "acc": "test_acc"})
    return train.withColumnsRenamed({"auc": "train_auc", "acc": "train_acc"}).join(t, "fold").withColumns({"auc_gap": F.col("train_auc") - F.col("test_auc"), "acc_gap": F.col("train_acc") - F.col("test_acc")})


def permuted(df: DataFrame, column: str, by: str = "fold", seed: int = 42) -> DataFrame:
    """df with `column` shuffled within each group: values dealt by one random order to rows in another; see order.shuffled()."""
    return order.shuffled(df, column, by, ("symbol", "ts"), seed)
