"""Queries of sources and sinks, of operators on other inputs, and of diagnostics in closed form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.tables import shared, written
from tidewright.operators import audit, cv, diagnostics, features, metrics, model, pipeline, portfolio, selection, trading
from tidewright.operators.topology import book
from tidewright.plans import core_queries as q
from tidewright.plans.feature_queries import BOOK, CLV, DECAY, E, MICRO, QUOTES, SIDE, SIZES, adjusted_orders, with_best, with_ladder
from tidewright.plans.oracle import EVENTS, ORD, ORDERS, TS, avg, features as sql, label_sql, lag, sd, total
from tidewright.plans.registry import ORACLES, query
from tidewright.sources import bars

BASE = q.BASE


def new_path(spark, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


# sources and sinks


@query("csv_round_trip", ["symbol", "ts"], q.OHLCV, f"WITH {EVENTS} SELECT *, {TS} FROM ev")
def csv_round_trip(spark, sf_dir):
    """Bars written as one CSV folder a symbol, in capitalised names, and read again."""
    path = new_path(spark, "csv")
    bars.write_bar_csv(bars.event_bars(spark, sf_dir), path)
    return bars.read_bar_csv(spark, path)


@query("bars_sink", ["symbol", "ts"], q.OHLCV, f"WITH {EVENTS} SELECT *, {TS} FROM ev WHERE symbol IN ('click', 'view')")
def bars_sink(spark, sf_dir):
    """A sink of a folder a symbol, of which two are read."""
    path = new_path(spark, "bars")
    bars.write_bars(bars.event_bars(spark, sf_dir), path)
    return spark.read.parquet(path).where("symbol in ('click', 'view')")


SHARES = "ct AS (SELECT r_name AS industry_name, n_name AS ticker, 2024 + n_regionkey % 2 AS year, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name, n_regionkey), sh AS (SELECT industry_name, ticker, year, k / sum(k) OVER (PARTITION BY industry_name) AS weight FROM ct)"


def weights(spark, sf_dir) -> DataFrame:
    """Each nation's share of its region's customers, as a table of weights that was written and read."""
    path = new_path(spark, "weights")
    n = q.table(spark, sf_dir, "customer").join(q.table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).join(q.table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    g = n.groupBy(F.col("r_name").alias("industry_name"), F.col("n_name").alias("Ticker"), (2024 + F.col("n_regionkey") % 2).cast("int").alias("year")).agg(F.count("*").alias("c"))
    all_ = g.groupBy("industry_name").agg(F.sum("c").alias("all"))
    g.join(all_, "industry_name").select("industry_name", (F.col("c") / F.col("all")).alias("Weight_Final_Constrained"), "Ticker", "year").write.option("header", True).csv(path)
    return bars.read_weights(spark, path)


@query("weights_csv", ["ticker"], [], f"WITH {SHARES} SELECT DISTINCT ticker FROM sh WHERE industry_name = 'ASIA'")
def weights_csv(spark, sf_dir):
    return bars.tickers(weights(spark, sf_dir).where("industry_name = 'ASIA'")).withColumnRenamed("Ticker", "ticker")


@query("weights_table", ["industry_name", "ticker", "year"], ["weight"], f"WITH {SHARES} SELECT * FROM sh")
def weights_table(spark, sf_dir):
    return weights(spark, sf_dir).withColumnsRenamed({"Ticker": "ticker", "Weight_Final_Constrained": "weight"})


COMPLETE = "y IS NOT NULL AND touch IS NOT NULL AND ret IS NOT NULL AND r IS NOT NULL"


@query("labelled_sink", ["symbol", "ts", "target_label"], ["target_barrier_return"], f"{label_sql()} SELECT symbol, {TS}, y AS target_label, ret AS target_barrier_return FROM lb WHERE {COMPLETE}")
def labelled_sink(spark, sf_dir):
    """The complete labelled rows, from the table that the sink wrote."""
    path = new_path(spark, "labelled")
    bars.write_labelled(q.labelled(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/ready")


@query("predictions_sink", ["symbol", "ts", "fold", "pred_signal"], ["prob_up", "bet_size"], f"{q.SIG} SELECT symbol, {TS}, fold, sig AS pred_signal, p AS prob_up, bet AS bet_size FROM sn")
def predictions_sink(spark, sf_dir):
    path = new_path(spark, "predictions")
    bars.write_predictions(q.signals(spark, sf_dir), path)
    return bars.read_predictions(spark, path)


@query("execution_sink", ["symbol", "ts", "executed_signal"], ["executed_bet", "trade_cost", "equity_curve"], f"{q.EQ} SELECT symbol, {TS}, taken AS executed_signal, CASE WHEN taken = 1 THEN bet ELSE 0 END AS executed_bet, CASE WHEN taken = 1 THEN 2 * 0.002 * bet ELSE 0 END AS trade_cost, e AS equity_curve FROM pk")
def execution_sink(spark, sf_dir):
    path = new_path(spark, "execution")
    bars.write_predictions(trading.equity(q.traded(spark, sf_dir)), path, bars.EXECUTION_SCHEMA)
    return bars.read_predictions(spark, path, bars.EXECUTION_SCHEMA)


@query("plot_data", ["symbol", "ts", "fold_start"], ["equity_curve", "drawdown"], f"{q.EQ} SELECT symbol, {TS}, CAST(coalesce(fold <> lag(fold) OVER ({ORD}), true) AS BIGINT) AS fold_start, e AS equity_curve, (e - top) / top AS drawdown FROM pk")
def plot_data(spark, sf_dir):
    return trading.plot_data(trading.equity(q.traded(spark, sf_dir)))


@query("profile_nulls", ["n_rows", "null_open", "null_close", "null_volume"], [], f"WITH {EVENTS}, h AS (SELECT t, open, CASE WHEN volume > 1 THEN close END AS close, CASE WHEN volume < 3 THEN volume END AS volume FROM ev) SELECT count(*) AS n_rows, count(*) - count(open) AS null_open, count(*) - count(close) AS null_close, count(*) - count(volume) AS null_volume FROM h")
def profile_nulls(spark, sf_dir):
    df = bars.event_bars(spark, sf_dir)
    return bars.profile(df.withColumns({"close": F.when(F.col("volume") > 1, F.col("close")), "volume": F.when(F.col("volume") < 3, F.col("volume"))}))


# cleaning


@query("split_dividend_index", ["symbol", "ts"], ["close_adj", "open_adj"], f"""WITH {ORDERS}, ac AS (SELECT *, CASE WHEN month(t) = 6 AND day(t) <= 3 THEN 2.0 ELSE 1.0 END AS sf, CASE WHEN day(t) = 15 THEN close / 50 ELSE 0.0 END AS dv FROM ob WHERE low > 0),
g AS (SELECT *, (close + dv) / (lag(close) OVER ({ORD}) * sf) - 1 AS ret FROM ac), x AS (SELECT *, 1000 * exp(sum(ln(1 + coalesce(ret, 0))) OVER ({ORD} ROWS UNBOUNDED PRECEDING)) AS ca FROM g)
SELECT symbol, {TS}, ca AS close_adj, open * ca / close AS open_adj FROM x""", scale={"close_adj": 1e-3, "open_adj": 1e-3})
def split_dividend_index(spark, sf_dir):
    """Bars with splits on some days and dividends on others."""
    df = bars.order_bars(spark, sf_dir).where("low > 0")
    split = F.when((F.month("ts") == 6) & (F.dayofmonth("ts") <= 3), 2.0).otherwise(1.0)
    return audit.adjusted(df.withColumns({"split_factor": split, "dividend": F.when(F.dayofmonth("ts") == 15, F.col("close") / 50).otherwise(0.0)}))


@query("unadjusted_bars", ["symbol", "ts"], q.ADJ, f"WITH {EVENTS} SELECT symbol, {TS}, open AS open_adj, high AS high_adj, low AS low_adj, close AS close_adj FROM ev")
def unadjusted_bars(spark, sf_dir):
    return audit.unadjusted(bars.event_bars(spark, sf_dir))


@query("coerced_numbers", ["o_orderkey"], ["x"], "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS x FROM orders")
def coerced_numbers(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string"))
    return audit.numeric(q.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("x")), ["x"])


@query("index_intersection", ["symbol", "ts"], ["close"], f"{label_sql()} SELECT symbol, {TS}, close FROM lb WHERE y IS NOT NULL AND volume_ > 1".replace("volume_", "v"))
def index_intersection(spark, sf_dir):
    df = q.labelled(spark, sf_dir)
    return audit.common_rows(df.where("volume > 1"), df.where("target_label is not null"))


@query("quarantine", ["column_name", "n"], [], f"{label_sql()} SELECT unnest(['symbol', 'ts', 'close', 'volume']) AS column_name, unnest([count(symbol), count(t), count(close), count(v)]) AS n FROM lb")
def quarantine(spark, sf_dir):
    """Values by column of labelled bars without the columns that look ahead."""
    df = q.labelled(spark, sf_dir).select("symbol", "ts", "target_label", "close", "target_barrier_return", "volume", "barrier_touch_time", "split_factor", "local_volatility", "dividend")
    kept = audit.without_future(df)
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).isNotNull().alias("known")) for c in kept.columns]))
    return kept.select(named.alias("c")).groupBy("c.column_name").agg(F.count_if("c.known").alias("n"))


@query("audit_report_flat", ["symbol", "initial_rows", "clean_rows", "dropped"], [], f"WITH {EVENTS}, d AS (SELECT string_agg(column_name, ',' ORDER BY column_name) AS dropped FROM ({{flat}}) WHERE s < 1e-8 OR n <= 1) SELECT symbol, count(*) AS initial_rows, count(*) FILTER (volume > 1) AS clean_rows, any_value(dropped) AS dropped FROM ev, d GROUP BY 1".replace("{flat}", "FLAT_SQL"))
def audit_report_flat(spark, sf_dir):
    """Rows before and after cleaning, and the columns that the table itself shows to be flat."""
    raw = bars.event_bars(spark, sf_dir)
    report = audit.audit_report(raw, raw.where("volume > 1"), sorted(audit.flat_columns(with_flat(spark, sf_dir))))
    return report.select("symbol", "initial_rows", "clean_rows", F.array_join("dropped_columns", ",").alias("dropped"))


def _flat(columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, stddev_pop({x}) AS s, count(DISTINCT {x}) AS n, avg(CASE WHEN {x} IS NULL THEN 1.0 ELSE 0.0 END) AS gone FROM ev" for c, x in columns.items())


FLAT = {"open": "open", "volume": "volume", "capped": "least(volume, 1)", "tiny": "volume * 1e-12", "rare": "CASE WHEN volume > 3 THEN close END", "constant": "2.5"}


ORACLES["audit_report_flat"] = ORACLES["audit_report_flat"].replace("FLAT_SQL", _flat(FLAT))


def with_flat(spark, sf_dir) -> DataFrame:
    return bars.event_bars(spark, sf_dir).select("open", "volume", F.least("volume", F.lit(1.0)).alias("capped"), (F.col("volume") * 1e-12).alias("tiny"), F.when(F.col("volume") > 3, F.col("close")).alias("rare"), F.lit(2.5).alias("constant"))


@query("audit_flat_columns", ["column_name"], [], f"WITH {EVENTS} SELECT column_name FROM ({_flat(FLAT)}) WHERE s < 1e-8 OR n <= 1")
def audit_flat_columns(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in audit.flat_columns(with_flat(spark, sf_dir))], "column_name string")


@query("dense_columns", ["column_name"], [], f"WITH {EVENTS} SELECT column_name FROM ({_flat(FLAT)}) WHERE gone < 0.25")
def dense_columns(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in audit.dense_columns(with_flat(spark, sf_dir))], "column_name string")


# portfolios whose symbols mostly trade at once

EV_WEIGHTS = "ct AS (SELECT event_type AS symbol, CAST(year(ts) AS INT) AS year, count(*) AS k FROM events GROUP BY 1, 2), w AS (SELECT symbol, year, k / sum(k) OVER (PARTITION BY year) AS weight FROM ct)"


@query("portfolio_full", ["ts", "n"], ["close", "volume"], f"WITH {EVENTS}, {EV_WEIGHTS}, g AS (SELECT t, count(*) AS n, sum(weight * close) AS close, sum(weight * volume) AS volume FROM ev JOIN w ON ev.symbol = w.symbol AND year(t) = w.year GROUP BY 1) SELECT {TS}, n, close, volume FROM g WHERE n = (SELECT count(*) FROM w)")
def portfolio_full(spark, sf_dir):
    e = q.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.year("ts").alias("year")).agg(F.count("*").alias("c"))
    w = e.join(e.groupBy("year").agg(F.sum("c").alias("all")), "year").select("symbol", "year", (F.col("c") / F.col("all")).alias("weight"))
    return portfolio.weighted(bars.event_bars(spark, sf_dir), w, ["close", "volume"]).where("close is not null")


# features on other inputs


@query("feat_amihud", ["symbol", "ts"], ["liq_amihud_raw", "liq_amihud_z"], sql({"liq_amihud_raw": "am", "liq_amihud_z": f"(am * 1e6 - {avg('am', 20)} * 1e6) / ({sd('am', 20)} * 1e6 + 1e-2)"}, {"am": f"abs(r) / (nullif(close * v, 0) + {E})"}), scale={"liq_amihud_raw": 1e9})
def feat_amihud(spark, sf_dir):
    """In millionths, which rounding tells apart."""
    return features.compute(adjusted_orders(spark, sf_dir), [features.liquidity])[0]


ALL = (1, 3, 5, 10, 20)


@query("feat_baseline_all", ["symbol", "ts"], [f"rvol_{k}" for k in ALL] + [f"vol_shock_{k}" for k in ALL[1:]], sql({**{f"rvol_{n}": f"v / ({avg('v', n, 1)} + {E})" for n in ALL}, **{f"vol_shock_{n}": f"(lv - {avg('lv', n, 1)}) / ({sd('lv', n, 1)} + {E})" for n in ALL[1:]}}, {"lv": f"ln(v + {E})"}))
def feat_baseline_all(spark, sf_dir):
    return features.compute(adjusted_orders(spark, sf_dir), [lambda: features.baseline(ALL, width=1)])[0]


@query("feat_acceleration", ["symbol", "ts"], ["k_acceleration", "vp_acceleration"], sql({"k_acceleration": f"mk - {lag('mk')}", "vp_acceleration": f"mv - {lag('mv')}"}, {"k": f"2 + {CLV}", "vp": "ln(h / l) + 1"}, {"mk": f"(k - {lag('k', 5)}) / (abs({lag('k', 5)}) + {E})", "mv": f"(vp - {lag('vp', 1)}) / (abs({lag('vp', 1)}) + {E})"}))
def feat_acceleration(spark, sf_dir):
    df = adjusted_orders(spark, sf_dir).withColumns({"k": 2 + features.prices().clv, "vp": features.prices().log_range + 1})
    return features.accelerated(df, {"k": 5, "vp": 1})


LADDER = {"l2_order_imbalance_raw": "raw", "l2_order_imbalance_z": f"(raw - {avg('raw', 20)}) / ({sd('raw', 20)} + {E})", "l2_depth_total": "bid_size_1 + ask_size_1", "l2_depth_ratio": f"bid_size_1 / (ask_size_1 + {E})", "l2_bid_withdrawal": "coalesce(greatest(-db, 0), 0)"}


@query("feat_order_book_ladder", ["symbol", "ts"], list(LADDER), sql(LADDER, QUOTES | SIZES, {"raw": "bid_size_1 - ask_size_1", "db": f"bid_size_1 - {lag('bid_size_1')}"}))
def feat_order_book_ladder(spark, sf_dir):
    """Sizes of a ladder's first level."""
    return features.compute(book(with_ladder(spark, sf_dir)), [features.order_book])[0]


@query("feat_order_book_empty", ["symbol", "ts"], ["l2_depth_total", "l2_bid_withdrawal"], sql({"l2_depth_total": "CASE WHEN symbol >= '3' THEN bid_size + ask_size END", "l2_bid_withdrawal": f"CASE WHEN symbol >= '3' THEN coalesce(greatest({lag('bid_size')} - bid_size, 0), 0) END"}, {"best_bid": "low", "best_ask": "high + 1.0", "bid_size": "v", "ask_size": "v / 2 + (high - close) / 1000"}))
def feat_order_book_empty(spark, sf_dir):
    """Symbols without any size have no features of sizes."""
    df = with_best(spark, sf_dir)
    return features.compute(df.withColumns({c: F.when(F.col("symbol") >= "3", F.col(c)).otherwise(0.0) for c in ("bid_size", "ask_size")}), [features.order_book])[0]


QT = {"best_bid": "low", "best_ask": "high + 1.0", "bid_size": "v", "ask_size": "v / 2 + (high - close) / 1000"}


@query("feat_toxicity_quotes", ["symbol", "ts"], ["flow_imbalance_proxy", "flow_imbalance_zscore", "flow_vpin_10"], sql({"flow_imbalance_proxy": "fi", "flow_imbalance_zscore": f"(fi - {avg('fi', 20)}) / ({sd('fi', 20)} + {E})", "flow_vpin_10": f"{total('ab', 10)} / ({total('v', 10)} + {E})"}, QT, {"fi": "bid_size - ask_size"}, {"ab": "abs(fi)"}))
def feat_toxicity_quotes(spark, sf_dir):
    return features.compute(with_best(spark, sf_dir), [features.toxicity])[0]


@query("fractional_by_symbol", ["symbol", "ts"], ["frac_diff_d"], sql({"frac_diff_d": "CASE WHEN symbol < '3' AND " + f"count(*) OVER ({ORD} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) >= 10 THEN " + " + ".join(f"coalesce({w} * {lag('c', k) if k else 'c'}, 0)" for k, w in enumerate(features.difference_weights(0.4))) + " END"}))
def fractional_by_symbol(spark, sf_dir):
    """An order of 0.4 for some symbols, none for the others."""
    df = adjusted_orders(spark, sf_dir)
    return features.fractional_of(df, df.select("symbol").distinct().withColumn("optimal_d", F.when(F.col("symbol") < "3", 0.4).otherwise(1.0)))


# selection

#: Names of lagged features, some of one cluster, some of none, some banned.
NAMES = (
    "volume_momentum", "cmf_slope_5_zscaled_lag1", "obv_slope_5_momentum", "ret_3_zscaled_lag2", "vol_parkinson_momentum", "ret_3_momentum", "skewness_20_momentum", "zscore_5_momentum",
    "rsi_14_momentum", "sin_month_momentum", "geo_upper_shadow_zscaled_lag1", "kinematic_squeeze_ratio_zscaled_lag1", "hl_log_range_momentum", "macd_dist_momentum", "rvol_5_momentum",
)
_names = ", ".join(f"'{n}'" for n in NAMES)
_banned = ", ".join(f"'{n}'" for n in ("volume_momentum", "sin_month_momentum"))


@query("diversify", ["case_name", "place", "feature"], [], f"""WITH v AS (SELECT event_type || '-' || (user_id // 15) % 3 AS case_name, [{_names}][1 + user_id % 15] AS f, count(*) AS k FROM events WHERE user_id % 5 < 4 GROUP BY ALL), c AS (SELECT case_name, f, row_number() OVER (PARTITION BY case_name ORDER BY k DESC, f) AS i FROM v),
ok AS (SELECT *, f NOT IN ({_banned}) AS fine, max(CAST(f NOT IN ({_banned}) AS INT)) OVER (PARTITION BY case_name) AS a FROM c), k AS (SELECT case_name, i, f, CASE WHEN regexp_matches(f, '^(cmf_slope_5|obv_slope_5|rvol_5)') THEN 1 WHEN regexp_matches(f, '^(vol_parkinson|hl_log_range|kinematic_squeeze_ratio)') THEN 2 WHEN regexp_matches(f, '^(ret_3|body_direction_momentum)') THEN 3 WHEN regexp_matches(f, '^(skewness_20|wavelet_energy_ratio|liq_amihud_pct_rank|geo_upper_shadow)') THEN 4 END AS g FROM ok WHERE fine OR a = 0),
n AS (SELECT *, CASE WHEN g IS NOT NULL AND row_number() OVER (PARTITION BY case_name, g ORDER BY i) = 1 THEN 0 ELSE 1 END AS later FROM k), p AS (SELECT *, row_number() OVER (PARTITION BY case_name ORDER BY later, i) AS place FROM n) SELECT case_name, place, f AS feature FROM p WHERE place <= 4""")
def diversify(spark, sf_dir):
    """Features by how often users that stand for them have events, for groups of users and types."""
    e = q.table(spark, sf_dir, "events").where("user_id % 5 < 4")
    case = F.concat_ws("-", "event_type", (F.floor(F.col("user_id") / 15) % 3).cast("string"))
    v = e.groupBy(case.alias("case_name"), F.element_at(F.array(*map(F.lit, NAMES)), (1 + F.col("user_id") % 15).cast("int")).alias("feature")).agg(F.count("*").alias("k"))
    placed = v.withColumn("place", F.row_number().over(Window.partitionBy("case_name").orderBy(F.desc("k"), "feature")))
    return selection.diversify(placed, "case_name")


@query("moving_blocks", ["symbol", "block", "n_block"], [], f"{BASE}, n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1), k AS (SELECT symbol, n, greatest(CAST(floor(n * 0.75) AS BIGINT), 40) AS len FROM n), s AS (SELECT symbol, n, len, greatest(n - len, 0) AS last, greatest(1, greatest(n - len, 0) // 7) AS step FROM k), e AS (SELECT DISTINCT symbol, n, len, least(i * step, last) AS start, min(i) OVER (PARTITION BY symbol, least(i * step, last)) AS block FROM s, generate_series(0, 7) AS g(i)) SELECT symbol, CAST(block AS BIGINT) AS block, least(len, n - start) AS n_block FROM e")
def moving_blocks(spark, sf_dir):
    return selection.blocks(q.adjusted_events(spark, sf_dir)).groupBy("symbol", "block").agg(F.count("*").alias("n_block"))


@query("feature_pipeline", ["symbol", "place", "feature", "n"], [])
def feature_pipeline(spark, sf_dir):
    """A model of each symbol's labelled bars, written, read and applied: the values that each of its features has."""
    df = written(q.labelled(spark, sf_dir).select("symbol", "ts", *q.OHLCV, "target_label"))
    path = new_path(spark, "model")
    pipeline.FeaturePipeline(columns=q.CANDIDATES).fit(df).save(path)
    found = pipeline.FeaturePipelineModel.load(path).transform(df)
    return found.groupBy("symbol", "place", "feature").agg(F.count("value").alias("n"))


@query("stability_counts", ["feature", "folds"], [], "WITH e AS (SELECT user_id % 5 AS fold, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, avg(n) OVER (PARTITION BY fold) AS a FROM e) SELECT event_type AS feature, count(DISTINCT fold) AS folds FROM m WHERE n > a GROUP BY 1")
def stability_counts(spark, sf_dir):
    """Event types stand for features: those over their fold's mean count are selected."""
    e = q.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("fold"), F.col("event_type").alias("feature")).agg(F.count("*").alias("n"))
    over = e.join(e.groupBy("fold").agg(F.avg("n").alias("a")), "fold").where("n > a")
    return metrics.stability(over.groupBy("fold").agg(F.collect_list("feature").alias("features")))


@query("generalisation_gap", ["fold"], ["auc_gap", "acc_gap"], f"WITH sc AS (SELECT l.doc_id % 5 AS fold, l.quality AS y, (d.n_chars % 1000) / 1000.0 AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id), k AS (SELECT f.i AS fold, fold = f.i AS test, y, p, CAST(p >= 0.5 AS INT) = y AS hit FROM sc, generate_series(0, 4) AS f(i)), r AS (SELECT *, rank() OVER (PARTITION BY fold, test ORDER BY p) + (count(*) OVER (PARTITION BY fold, test, p) - 1) / 2 AS g FROM k), a AS (SELECT fold, test, avg(CAST(hit AS INT)) AS acc, (sum(g) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY 1, 2) SELECT x.fold, x.auc - z.auc AS auc_gap, x.acc - z.acc AS acc_gap FROM a x JOIN a z ON x.fold = z.fold AND NOT x.test AND z.test")
def generalisation_gap(spark, sf_dir):
    d = q.table(spark, sf_dir, "documents").select("doc_id", (F.pmod("n_chars", F.lit(1000)) / 1000.0).alias("p"))
    sc = q.table(spark, sf_dir, "labels").join(d, "doc_id").select((F.col("doc_id") % 5).alias("own"), F.col("quality").alias("y"), "p")
    k = sc.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    of = lambda rows: metrics.by_group(rows, "fold")
    return metrics.generalisation_gap(of(k.where("own <> fold")), of(k.where("own = fold")))


@query("interaction_gain", ["symbol", "fold"], ["base_auc", "pairs_auc", "delta_auc"])
def interaction_gain(spark, sf_dir):
    return model.interaction_gain(q.fold_rows(spark, sf_dir), ["cmf_20", "vol_parkinson", "ret_3", "geo_body_ratio"])


# diagnostics in closed form


@query("bns_jump", ["symbol", "jump_bars", "has_jumps"], ["mean_ratio"], f"{BASE}, x AS (SELECT symbol, t, r, {lag('r')} AS p FROM b WHERE r IS NOT NULL), w AS (SELECT symbol, t, row_number() OVER ({ORD}) AS i, count(*) OVER (PARTITION BY symbol) AS n, sum(r * r) OVER ({ORD} ROWS 19 PRECEDING) AS rv, pi() / 2 * sum(abs(r) * abs(p)) OVER ({ORD} ROWS 19 PRECEDING) AS bv FROM x), j AS (SELECT symbol, n, CASE WHEN i > 20 THEN greatest(rv - bv, 0) / (rv + 1e-8) END AS j FROM w) SELECT symbol, CASE WHEN max(n) >= 40 THEN avg(j) ELSE 0 END AS mean_ratio, CASE WHEN max(n) >= 40 THEN count(*) FILTER (j > 0.25) ELSE 0 END AS jump_bars, CAST(max(n) >= 40 AND count(*) FILTER (j > 0.25) > 0.05 * max(n) AS BIGINT) AS has_jumps FROM j GROUP BY 1")
def bns_jump(spark, sf_dir):
    return diagnostics.jumps(q.adjusted_events(spark, sf_dir))


@query("normality", ["symbol", "fat_tailed"], ["jb_p"], f"{BASE}, m AS (SELECT symbol, count(r) AS n, avg(r) AS mean, kurtosis(r) + 3 AS ku FROM b GROUP BY 1), d AS (SELECT b.symbol, avg(power(r - mean, 2)) AS m2, avg(power(r - mean, 3)) AS m3, avg(power(r - mean, 4)) AS m4 FROM b JOIN m ON b.symbol = m.symbol WHERE r IS NOT NULL GROUP BY 1) SELECT m.symbol, exp(-n / 12 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4)) AS jb_p, CAST(ku > 3 AS BIGINT) AS fat_tailed FROM m JOIN d ON m.symbol = d.symbol")
def normality(spark, sf_dir):
    return diagnostics.distribution(q.adjusted_events(spark, sf_dir))


def _vr(k: int) -> str:
    return f"""v{k} AS (SELECT symbol, sum(power(q{k} - {k} * mean, 2)) / ({k} * (max(n) - {k} + 1) * (1 - {k} / max(n))) AS sk FROM (SELECT e.*, p - lag(p, {k}) OVER ({ORD}) AS q{k} FROM e) GROUP BY 1)"""


@query("payload_memory", ["symbol", "lags"], ["vr_3", "vr_20"], f"""{BASE}, e0 AS (SELECT symbol, t, ln(c) AS p, r, avg(r) OVER (PARTITION BY symbol) AS mean, count(r) OVER (PARTITION BY symbol) AS n FROM b), e AS (SELECT * FROM e0), one AS (SELECT symbol, var_samp(r) AS s1 FROM e GROUP BY 1), {_vr(3)}, {_vr(20)},
ce AS (SELECT symbol, r - mean AS d, row_number() OVER ({ORD}) AS i, n FROM e WHERE r IS NOT NULL), ss AS (SELECT symbol, sum(d * d) AS s, max(n) AS n FROM ce GROUP BY 1),
g AS (SELECT x.symbol, k.lag, sum(x.d * y.d) AS c FROM generate_series(1, 30) AS k(lag), ce x JOIN ce y ON x.symbol = y.symbol AND y.i = x.i - k.lag GROUP BY 1, 2), si AS (SELECT g.symbol, g.lag, row_number() OVER (PARTITION BY g.symbol ORDER BY g.lag) AS k FROM g JOIN ss ON g.symbol = ss.symbol WHERE abs(c / s) > 1.96 / sqrt(n)),
al AS (SELECT symbol, lag FROM si WHERE k <= 5 UNION SELECT symbol, unnest([1, 5, 20]) FROM ss UNION SELECT symbol, 3 FROM ss WHERE symbol NOT IN (SELECT symbol FROM si)), la AS (SELECT symbol, string_agg(CAST(lag AS VARCHAR), ',' ORDER BY lag) AS lags FROM al GROUP BY 1)
SELECT one.symbol, la.lags, v3.sk / s1 AS vr_3, v20.sk / s1 AS vr_20 FROM one JOIN v3 ON one.symbol = v3.symbol JOIN v20 ON one.symbol = v20.symbol JOIN la ON one.symbol = la.symbol""")
def payload_memory(spark, sf_dir):
    return diagnostics.scan(q.adjusted_events(spark, sf_dir)).select("symbol", F.array_join(F.col("dynamic_lags").cast("array<string>"), ",").alias("lags"), "vr_3", "vr_20")


@query("payload_volume", ["symbol", "has_asymmetric_vol", "high_complexity"], ["volume_corr", "leverage"], f"{BASE}, k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY v) + (count(*) OVER (PARTITION BY symbol, v) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol ORDER BY abs(r)) + (count(*) OVER (PARTITION BY symbol, abs(r)) - 1) / 2 AS z FROM b WHERE r IS NOT NULL), vc AS (SELECT symbol, corr(a, z) AS volume_corr FROM k GROUP BY 1), le AS (SELECT symbol, corr(l, r * r) AS leverage FROM (SELECT symbol, r, {lag('r')} AS l FROM b) GROUP BY 1), p AS (SELECT symbol, r AS z, {lag('r')} AS y, {lag('r', 2)} AS x FROM b WHERE r IS NOT NULL), c AS (SELECT symbol, CAST(x > y AS INT) * 4 + CAST(y > z AS INT) * 2 + CAST(x > z AS INT) AS k, count(*) AS n FROM p WHERE x IS NOT NULL GROUP BY 1, 2), s AS (SELECT symbol, n / sum(n) OVER (PARTITION BY symbol) AS w FROM c), en AS (SELECT symbol, -sum(w * log2(w)) / log2(6) AS entropy FROM s GROUP BY 1) SELECT vc.symbol, CAST(leverage < -0.1 AS BIGINT) AS has_asymmetric_vol, CAST(entropy > 0.85 AS BIGINT) AS high_complexity, volume_corr, leverage FROM vc JOIN le ON vc.symbol = le.symbol JOIN en ON vc.symbol = en.symbol")
def payload_volume(spark, sf_dir):
    return diagnostics.scan(q.adjusted_events(spark, sf_dir)).select("symbol", F.col("flags.has_asymmetric_vol").alias("has_asymmetric_vol"), F.col("flags.is_high_complexity").alias("high_complexity"), "volume_corr", "leverage")


@query("payload_flags", ["symbol", *diagnostics.FLAGS], [])
def payload_flags(spark, sf_dir):
    return diagnostics.scan(book(with_ladder(spark, sf_dir))).select("symbol", "flags.*")


@query("fitted_regime", ["symbol", "ts"], ["gmm_prob_bull", "gmm_prob_bear"])
def fitted_regime(spark, sf_dir):
    """Fitted on the first half of each symbol's bars."""
    df = cv.numbered(q.adjusted_events(spark, sf_dir))
    return diagnostics.fitted_regime(df.where(F.col("row_id") < F.col("n_rows") / 2), df)




@query("risk_metrics_of_folds", ["symbol", "label", "total_trades"], ["win_rate", "cum_return", "max_drawdown", "avg_bet"], f"{q.FOLD_EQ} SELECT symbol, 'Fold ' || fold AS label, {q.RATIOS} FROM pk GROUP BY symbol, fold")
def risk_metrics_of_folds(spark, sf_dir):
    return trading.metrics_with_total(q.traded(spark, sf_dir)).where("label <> 'Full OOS'")
