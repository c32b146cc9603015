"""Forward-chaining folds with purging and embargo, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame) -> DataFrame:
    """row_id from 0 in order of ts, and the number of rows, by symbol."""
    w = Window.partitionBy("symbol")
    return df.withColumn("row_id", F.row_number().over(w.orderBy("ts")) - 1).withColumn("n_rows", F.count("*").over(w))


def folds(df: DataFrame, splits: int = 5, max_train: int | None = 750) -> DataFrame:
    """Rows by (fold, role): test folds of n // (splits + 1) rows at the end, and before each the last max_train rows."""
    size = F.floor(F.col("n_rows") / (splits + 1))
    rows = numbered(df).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    start = F.col("n_rows") - (splits - F.col("fold") + 1) * size
    rows = rows.withColumn("test_from", start).withColumn("test_to", start + size)
    role = F.when(F.col("row_id").between(F.col("test_from"), F.col("test_to") - 1), "test").when((F.col("row_id") < F.col("test_from")) & (F.col("row_id") >= (F.col("test_from") - max_train if max_train else F.lit(0))), "train")
    return rows.withColumn("role", role).where(F.col("role").isNotNull())


def purged(df: DataFrame, splits: int = 5, embargo_days: int = 5, max_train: int | None = 750) -> DataFrame:
    """folds() without training rows whose label isn't known `embargo_days` before the test begins."""
    f = folds(df, splits, max_train)
    begun = F.min(F.when(F.col("role") == "test", F.col("ts"))).over(Window.partitionBy("symbol", "fold"))
    early = F.col("barrier_touch_time") < F.col("test_start") - F.make_interval(days=F.lit(embargo_days))
    return f.withColumn("test_start", begun).where((F.col("role") == "test") | F.coalesce(early, F.lit(False)))


def positional_purge(df: DataFrame, splits: int = 5, gap: int = 5, max_train: int | None = None) -> DataFrame:
    """folds() without the last `gap` training rows."""
    return folds(df, splits, max_train).where((F.col("role") == "test") | (F.col("row_id") < F.col("test_from") - gap))


def leakage_gap(assigned: DataFrame) -> DataFrame:
    """By fold: test start less the last training touch, in seconds, which must exceed the embargo."""
    start, last = F.min(F.when(F.col("role") == "test", F.col("ts"))), F.max(F.when(F.col("role") == "train", F.col("barrier_touch_time")))
    return assigned.groupBy("symbol", "fold").agg(start.alias("test_start"), last.alias("last_touch"), F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "test").alias("test_rows")).withColumn("gap_seconds", (F.unix_timestamp("test_start") - F.unix_timestamp("last_touch")).cast("double"))


def buffered_test(df: DataFrame, splits: int = 5, buffer: int = 150) -> DataFrame:
    """Each fold's test rows and the `buffer` rows before them; in_test marks the former."""
    f = numbered(df).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    size = F.floor(F.col("n_rows") / (splits + 1))
    start = F.col("n_rows") - (splits - F.col("fold") + 1) * size
    rows = f.withColumn("test_from", start).where(F.col("row_id").between(start - buffer, start + size - 1))
    return rows.withColumn("in_test", (F.col("row_id") >= F.col("test_from")).cast("int"))
