"""Cleaning of bars: duplicates, geometry, adjustment, returns, alignment of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.series import lag, ordered, ratio, zero

#: Columns that a model may not see: what looks ahead, and the corporate actions.
FORWARD_LOOKING = ["target_label", "target_barrier_return", "barrier_touch_time", "local_volatility", "split_factor", "dividend"]
PRICES = ["open", "high", "low", "close"]


def last_of_duplicates(df: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Of bars with one symbol and ts the last that came."""
    w = Window.partitionBy("symbol", "ts").orderBy(F.desc(seq))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def repaired(df: DataFrame) -> DataFrame:
    """High and low that enclose open and close; bars without a positive low or a volume go."""
    high = F.greatest("high", "open", "close")
    low = F.least("low", "open", "close")
    return df.withColumns({"high": high, "low": low}).where("low > 0 and volume >= 0")


def adjusted(df: DataFrame) -> DataFrame:
    """split_factor and dividend where missing, and prices on a total-return index that starts at 1000."""
    for name, default in (("split_factor", 1.0), ("dividend", 0.0)):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default))
    earned = ratio(F.col("close") + F.col("dividend"), lag("close") * F.col("split_factor")) - 1
    upto = ordered().rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__r", earned).withColumn("close_adj", 1000 * F.product(1 + zero("__r")).over(upto)).drop("__r")
    # one factor for all four, so that prices that are equal stay equal
    out = out.withColumn("__scale", ratio(F.col("close_adj"), F.col("close")))
    return out.withColumns({f"{c}_adj": F.col(c) * F.col("__scale") for c in PRICES}).drop("__scale")


def unadjusted(df: DataFrame) -> DataFrame:
    """The same columns without corporate actions."""
    return df if "close_adj" in df.columns else df.withColumns({f"{c}_adj": F.col(c) for c in PRICES})


def returns(df: DataFrame) -> DataFrame:
    before = lag("close_adj")
    pairs = {"log_return": (F.col("close_adj"), before), "overnight_return": (F.col("open_adj"), before), "intraday_return": (F.col("close_adj"), F.col("open_adj")), "high_low_range": (F.col("high_adj"), F.col("low_adj"))}
    return df.withColumns({n: F.log(ratio(a, b)) for n, (a, b) in pairs.items()}).dropna(subset=["close_adj", "open_adj"])


def flat_columns(df: DataFrame, kept: tuple = ("split_factor", "dividend", "target_label"), least: float = 1e-8) -> list[str]:
    """Numeric columns without spread or with one value; an action of one aggregation."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in kept]
    if not numeric:
        return []
    row = df.agg(*[F.stddev_pop(c).alias(f"s_{c}") for c in numeric], *[F.count_distinct(c).alias(f"n_{c}") for c in numeric]).first()
    return [c for c in numeric if row[f"n_{c}"] <= 1 or (row[f"s_{c}"] or 0.0) < least]


def audit_report(raw: DataFrame, clean: DataFrame, dropped: list[str] = ()) -> DataFrame:
    """Rows by symbol before and after, and the flat columns that were dropped."""
    after = clean.groupBy("symbol").agg(F.count("*").alias("clean_rows"))
    counts = raw.groupBy("symbol").agg(F.count("*").alias("initial_rows")).join(after, "symbol", "left").fillna(0, ["clean_rows"])
    return counts.withColumn("dropped_columns", F.array(*map(F.lit, dropped)).cast("array<string>"))


def complete(df: DataFrame) -> DataFrame:
    """Labelled rows without any missing value: first those whose label or touch time is missing go, then all others."""
    return df.dropna(subset=["target_label", "barrier_touch_time"]).dropna()


def without_future(df: DataFrame) -> DataFrame:
    return df.drop(*FORWARD_LOOKING)


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns; missing ones are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """The next value, else the last, else 0."""
    w = ordered()
    ahead, behind = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.first(c, True).over(ahead), F.last(c, True).over(behind), F.lit(0.0)))
    return df


def dense_columns(df: DataFrame, most_null: float = 0.25) -> list[str]:
    """Columns of which less than this share is null; an action."""
    row = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in df.columns]).first()
    return [c for c in df.columns if row[f"n_{c}"] < most_null * max(1, row["rows"])]


def common_rows(df: DataFrame, other: DataFrame, keys: tuple = ("symbol", "ts")) -> DataFrame:
    """Rows of df whose keys other has too."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns})


def with_benchmark(df: DataFrame, market: DataFrame) -> DataFrame:
    """Bars left-joined to mkt_ columns by ts; days without a market bar get 0."""
    m = market.select("ts", *[F.col(c).alias(f"mkt_{c}") for c in market.columns if c not in ("ts", "symbol")])
    names = [c for c in m.columns if c != "ts"]
    return df.join(m, "ts", "left").fillna(0.0, names)
