"""Sources and sinks of bar tables: bars from ticks and orders, CSV histories, portfolio weights, Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "time timestamp, open double, high double, low double, close double, volume double"
WEIGHT_SCHEMA = "industry_name string, Weight_Final_Constrained double, Ticker string, year int"


def bars(ticks: DataFrame, symbol: Column, ts: Column, price: Column, order: Column, volume: Column) -> DataFrame:
    """Open, high, low, close and volume of ticks by symbol and ts; the first and last by `order`."""
    t = ticks.select(symbol.alias("symbol"), ts.cast("timestamp").alias("ts"), price.cast("double").alias("price"), order.alias("order"), volume.cast("double").alias("size"))
    return t.groupBy("symbol", "ts").agg(
        F.min_by("price", "order").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "order").alias("close"), F.sum("size").alias("volume")
    )


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Hourly bars of event values, one symbol an event type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bars(e, F.col("event_type"), F.date_trunc(unit, "ts"), F.col("value"), F.struct("ts", "event_id"), F.lit(1))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices, one symbol a priority; volume in thousands."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return bars(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_totalprice") / 1000)


def order_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of all orders as one series."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return bars(o, F.lit("INDEX"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_totalprice") / 1000)


def provider_symbol(symbol: Column) -> Column:
    """The name under which a history provider lists a symbol."""
    return F.when(symbol == "VNINDEX", F.lit("VNINDEX.QA")).otherwise(F.concat(symbol, F.lit(".VN")))


def read_bar_csv(spark: SparkSession, path: str) -> DataFrame:
    """One CSV file (or folder of parts) a symbol, named by it, or a folder of folders symbol=..., in capitalised or plain column
    names."""
    raw = spark.read.csv(path, header=True)
    raw = raw.withColumnsRenamed({c: {"date": "time"}.get(c.lower(), c.lower()) for c in raw.columns})
    name = F.col("symbol").cast("string") if "symbol" in raw.columns else F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv(/[^/]*)?$", 1)
    return raw.select(name.alias("symbol"), F.to_timestamp("time").alias("ts"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in ("open", "high", "low", "close", "volume")])


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEIGHT_SCHEMA).csv(path, header=True)


def tickers(weights: DataFrame) -> DataFrame:
    return weights.select("Ticker").distinct().orderBy("Ticker")


def write_bars(df: DataFrame, path: str, format: str = "parquet") -> None:
    """One folder a symbol, so that readers prune."""
    df.write.mode("overwrite").partitionBy("symbol").format(format).save(path)


def write_bar_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV a symbol, in capitalised column names, all in one job."""
    names = {"ts": "Date", **{c: c.capitalize() for c in ("open", "high", "low", "close", "volume")}}
    df.withColumnsRenamed(names).write.partitionBy("symbol").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def write_labelled(df: DataFrame, path: str) -> None:
    """The labelled bars, and those without any missing value, as Parquet below path."""
    from tidewright.operators.audit import complete

    df.write.mode("overwrite").parquet(f"{path}/labelled")
    complete(df).write.mode("overwrite").parquet(f"{path}/ready")


#: Columns of out-of-sample predictions and of executed trades, with which their tables are read.
PREDICTION_SCHEMA = "symbol string, ts timestamp, fold int, prob_up double, dynamic_threshold double, pred_signal int, bet_size double, true_target int, barrier_return double, barrier_touch_time timestamp"
EXECUTION_SCHEMA = PREDICTION_SCHEMA + ", executed_signal int, executed_return double, executed_bet double, trade_cost double, net_trade_pnl double, equity_curve double, peak_equity double, drawdown double"


def write_predictions(df: DataFrame, path: str, schema: str = PREDICTION_SCHEMA) -> None:
    """Exactly the columns of the schema, as Parquet."""
    df.select(*[F.expr(f"cast({f.split()[0]} as {f.split()[1]})").alias(f.split()[0]) for f in schema.split(", ")]).write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str, schema: str = PREDICTION_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def long_enough(df: DataFrame, rows: int = 50) -> DataFrame:
    """Bars of symbols that have more than so many."""
    kept = df.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") > rows).select("symbol")
    return df.join(kept, "symbol", "left_semi")


def profile(df: DataFrame) -> DataFrame:
    """Rows, first and last ts, and missing values by column, in one pass."""
    return df.agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns if c not in ("symbol", "ts")])
