"""Queries of bars, audit, labels, portfolios, folds, trading, metrics, diagnostics, selection and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from tidewright.operators import audit, cv, diagnostics, features, labels, metrics, model, portfolio, recursive, selection, trading
from tidewright.plans.feature_queries import adjusted_orders, with_market
from tidewright.plans.oracle import EVENTS, INDEX, ORD, ORDERS, TS, adjusted as adjusted_sql, label_sql, lag
from tidewright.plans.registry import query
from tidewright.sources import bars

OHLCV = ["open", "high", "low", "close", "volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adjusted_events(spark, sf_dir):
    return audit.returns(audit.adjusted(audit.repaired(bars.event_bars(spark, sf_dir))))


def labelled(spark, sf_dir, floor: float = 0.0001):
    return labels.triple_barrier(adjusted_events(spark, sf_dir), floor=floor)


@query("bars_event_hourly", ["symbol", "ts"], OHLCV, f"WITH {EVENTS} SELECT *, {TS} FROM ev")
def bars_event_hourly(spark, sf_dir):
    return bars.event_bars(spark, sf_dir)


@query("bars_order_daily", ["symbol", "ts"], OHLCV, f"WITH {ORDERS} SELECT *, {TS} FROM ob")
def bars_order_daily(spark, sf_dir):
    return bars.order_bars(spark, sf_dir)


@query("profile_bars", ["n_rows", "first_ts", "last_ts", "null_close"], [], f"WITH {EVENTS} SELECT count(*) AS n_rows, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) - count(close) AS null_close FROM ev")
def profile_bars(spark, sf_dir):
    return bars.profile(bars.event_bars(spark, sf_dir))


@query("symbols_with_history", ["symbol"], [], "SELECT event_type AS symbol FROM (SELECT DISTINCT event_type, date_trunc('hour', ts) AS t FROM events) GROUP BY 1 HAVING count(*) > 50")
def symbols_with_history(spark, sf_dir):
    return bars.long_enough(bars.event_bars(spark, sf_dir)).select("symbol").distinct()


@query("provider_symbols", ["name"], [], "SELECT DISTINCT CASE WHEN n_name = 'VNINDEX' THEN 'VNINDEX.QA' ELSE n_name || '.VN' END AS name FROM nation")
def provider_symbols(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(bars.provider_symbol(F.col("n_name")).alias("name")).distinct()


@query("audit_dedup_last", ["symbol", "ts"], ["value"], "SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, last(value ORDER BY event_id) AS value FROM events GROUP BY 1, 2")
def audit_dedup_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts"), "value", F.col("event_id").alias("ingest_seq"))
    return audit.last_of_duplicates(e)


@query("audit_envelope_repair", ["symbol", "ts"], OHLCV, f"WITH {EVENTS}, br AS (SELECT symbol, t, open, (open + close) / 2 AS high, low - 50 AS low, close, volume FROM ev) SELECT symbol, {TS}, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close, volume FROM br WHERE least(low, open, close) > 0 AND volume >= 0")
def audit_envelope_repair(spark, sf_dir):
    broken = bars.event_bars(spark, sf_dir).withColumns({"high": (F.col("open") + F.col("close")) / 2, "low": F.col("low") - 50})
    return audit.repaired(broken)


@query("audit_report", ["symbol", "initial_rows", "clean_rows"], [], f"WITH {EVENTS} SELECT symbol, count(*) AS initial_rows, count(*) FILTER (low - 50 > 0) AS clean_rows FROM ev GROUP BY 1")
def audit_report(spark, sf_dir):
    raw = bars.event_bars(spark, sf_dir).withColumn("low", F.col("low") - 50)
    return audit.audit_report(raw, audit.repaired(raw))


ADJ = ["open_adj", "high_adj", "low_adj", "close_adj"]


@query("total_return_index", ["symbol", "ts"], ADJ, f"WITH {EVENTS}, {adjusted_sql('ev')} SELECT symbol, {TS}, o AS open_adj, h AS high_adj, l AS low_adj, c AS close_adj FROM b")
def total_return_index(spark, sf_dir):
    return adjusted_events(spark, sf_dir)


@query("base_returns", ["symbol", "ts"], ["log_return", "overnight_return", "intraday_return", "high_low_range"], f"WITH {EVENTS}, {adjusted_sql('ev')} SELECT symbol, {TS}, r AS log_return, ln(o / {lag('c')}) AS overnight_return, ln(c / o) AS intraday_return, ln(h / l) AS high_low_range FROM b")
def base_returns(spark, sf_dir):
    return adjusted_events(spark, sf_dir)


@query("fill_gaps", ["symbol", "ts"], ["x"], f"WITH {EVENTS}, g AS (SELECT symbol, t, CASE WHEN volume > 1 THEN close END AS x FROM ev) SELECT symbol, {TS}, coalesce(first_value(x IGNORE NULLS) OVER ({ORD} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(x IGNORE NULLS) OVER ({ORD} ROWS UNBOUNDED PRECEDING), 0) AS x FROM g")
def fill_gaps(spark, sf_dir):
    return audit.filled(bars.event_bars(spark, sf_dir).withColumn("x", F.when(F.col("volume") > 1, F.col("close"))), ["x"])


@query("align_schema", ["symbol"], ["close", "missing"], f"WITH {EVENTS} SELECT symbol, close, CAST(NULL AS DOUBLE) AS missing FROM ev")
def align_schema(spark, sf_dir):
    return audit.aligned(bars.event_bars(spark, sf_dir), ["symbol", "close", "missing"])


@query("benchmark_join", ["symbol", "ts"], ["close_adj", "mkt_return"], f"WITH {ORDERS}, {adjusted_sql('ob')}, {INDEX} SELECT b.symbol, strftime(b.t, '%Y-%m-%d %H:%M:%S') AS ts, b.c AS close_adj, coalesce(mk.mkt_return, 0) AS mkt_return FROM b LEFT JOIN mk ON b.t = mk.t")
def benchmark_join(spark, sf_dir):
    return with_market(spark, sf_dir)


VOL = "local_volatility"


@query("ewm_vol", ["symbol", "ts"], [VOL], f"{label_sql()} SELECT symbol, {TS}, sigma AS {VOL} FROM sg")
def ewm_vol(spark, sf_dir):
    return labelled(spark, sf_dir)


LABELS = f"{label_sql()} SELECT symbol, {TS}, y AS target_label, ret AS target_barrier_return, strftime(touch, '%Y-%m-%d %H:%M:%S') AS barrier_touch_time, sigma AS {VOL} FROM lb"


@query("triple_barrier", ["symbol", "ts", "target_label", "barrier_touch_time"], ["target_barrier_return", VOL], LABELS)
def triple_barrier(spark, sf_dir):
    return labelled(spark, sf_dir)


@query("label_summary", ["symbol", "n_labels"], ["share_up", "mean_return"], f"SELECT symbol, count(target_label) AS n_labels, avg(target_label) AS share_up, avg(target_barrier_return) AS mean_return FROM ({LABELS}) GROUP BY 1")
def label_summary(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("symbol").agg(F.count("target_label").alias("n_labels"), F.avg("target_label").alias("share_up"), F.avg("target_barrier_return").alias("mean_return"))


@query("ewm_vol_long", ["symbol", "ts"], ["vol"], f"{label_sql(memory=100000)} SELECT symbol, {TS}, sigma AS vol FROM sg")
def ewm_vol_long(spark, sf_dir):
    return recursive.ewm_std(adjusted_events(spark, sf_dir), "log_return", 20, "vol", floor=0.0001)


@query("ema_long", ["symbol", "ts"], ["ema_12"], f"WITH {EVENTS} SELECT symbol, {TS}, list_reduce(list(close) OVER ({ORD} ROWS UNBOUNDED PRECEDING), lambda a, b: a * {1 - 2 / 13} + b * {2 / 13}) AS ema_12 FROM ev")
def ema_long(spark, sf_dir):
    return recursive.ema(bars.event_bars(spark, sf_dir), {"ema_12": ("close", 12)})


@query("ema_fold", ["symbol", "ts"], ["ema_12"], f"WITH {EVENTS} SELECT symbol, {TS}, list_reduce(list(close) OVER ({ORD} ROWS UNBOUNDED PRECEDING), lambda a, b: a * {1 - 2 / 13} + b * {2 / 13}) AS ema_12 FROM ev")
def ema_fold(spark, sf_dir):
    return recursive.ema(bars.event_bars(spark, sf_dir).repartition("symbol"), {"ema_12": ("close", 12), "ema_26": ("close", 26)})


# portfolios: a weight for each priority and year from its orders' share

WEIGHTS = "sh AS (SELECT o_orderpriority AS symbol, CAST(year(o_orderdate) AS INT) AS year, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), w AS (SELECT symbol, year, n / sum(n) OVER (PARTITION BY year) AS weight FROM sh)"


def weights(spark, sf_dir):
    sh = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.year("o_orderdate").alias("year")).agg(F.count("*").cast("double").alias("n"))
    return sh.select("symbol", "year", (F.col("n") / F.sum("n").over(Window.partitionBy("year"))).alias("weight"))


@query("weight_year_backfill", ["symbol", "year"], ["weight"], f"WITH {WEIGHTS}, f AS (SELECT min(year) AS y FROM w) SELECT * FROM w UNION ALL SELECT w.symbol, CAST(g.i AS INT) AS year, w.weight FROM w, f, generate_series(1988, f.y - 1) AS g(i) WHERE w.year = f.y")
def weight_year_backfill(spark, sf_dir):
    return portfolio.back_filled(weights(spark, sf_dir), first=1988)


@query("weight_uniqueness", ["symbol", "year"], ["weight"], f"WITH {WEIGHTS}, l AS (SELECT max(year) AS y FROM w), u AS (SELECT * FROM w UNION ALL SELECT w.symbol, CAST(l.y - 1 AS INT), w.weight FROM w, l WHERE w.year = l.y AND w.symbol < '3') SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol, year) AS k FROM u) WHERE k = 1")
def weight_uniqueness(spark, sf_dir):
    w = weights(spark, sf_dir)
    last = w.agg(F.max("year").alias("y"))
    more = w.join(F.broadcast(last), F.col("year") == F.col("y")).where("symbol < '3'").select("symbol", (F.col("year") - 1).alias("year"), "weight")
    return portfolio.unique_weights(w.unionByName(more))


PV = ["open", "high", "low", "close", "volume", "log_return"]


@query("portfolio_weighted_sum", ["ts", "n"], PV, f"WITH {ORDERS}, {adjusted_sql('ob')}, {WEIGHTS}, hd AS (SELECT year, count(DISTINCT symbol) AS held FROM w GROUP BY 1), g AS (SELECT b.t, year(b.t) AS year, count(DISTINCT b.symbol) AS n, " + ", ".join(f"CASE WHEN count({x}) = count(*) THEN sum(weight * {x}) END AS {a}" for a, x in zip(PV, ["open", "high", "low", "close", "v", "r"])) + f" FROM b JOIN w ON b.symbol = w.symbol AND year(b.t) = w.year GROUP BY 1, 2) SELECT {TS}, n, " + ", ".join(f"CASE WHEN n >= held THEN {a} END AS {a}" for a in PV) + " FROM g JOIN hd ON g.year = hd.year")
def portfolio_weighted_sum(spark, sf_dir):
    return portfolio.weighted(adjusted_orders(spark, sf_dir), weights(spark, sf_dir))


# folds

ROWS = f"{label_sql()}, nr AS (SELECT symbol, t, touch, y, ret, c, i - 1 AS row_id, n AS n_rows FROM lb), f AS (SELECT nr.*, k.fold, n_rows - (5 - k.fold + 1) * (n_rows // 6) AS a, n_rows - (5 - k.fold) * (n_rows // 6) AS z FROM nr, generate_series(1, 5) AS k(fold)), fo AS (SELECT *, CASE WHEN row_id >= a AND row_id < z THEN 'test' WHEN row_id < a AND row_id >= a - 300 THEN 'train' END AS role FROM f), fd AS (SELECT * FROM fo WHERE role IS NOT NULL)"
PURGED = f"{ROWS}, ts0 AS (SELECT *, min(t) FILTER (role = 'test') OVER (PARTITION BY symbol, fold) AS test_start FROM fd), pg AS (SELECT * FROM ts0 WHERE role = 'test' OR touch < test_start - INTERVAL 1 DAY)"


@query("cv_folds", ["symbol", "fold", "role", "ts"], [], f"{ROWS} SELECT symbol, fold, role, {TS} FROM fd")
def cv_folds(spark, sf_dir):
    return cv.folds(adjusted_events(spark, sf_dir), max_train=300)


def purged(spark, sf_dir):
    return cv.purged(labelled(spark, sf_dir), embargo_days=1, max_train=300)


@query("purge_embargo", ["symbol", "fold", "role", "ts"], [], f"{PURGED} SELECT symbol, fold, role, {TS} FROM pg")
def purge_embargo(spark, sf_dir):
    return purged(spark, sf_dir)


@query("positional_purge", ["symbol", "fold", "role", "ts"], [], f"{ROWS} SELECT symbol, fold, role, {TS} FROM fd WHERE role = 'test' OR row_id < a - 5")
def positional_purge(spark, sf_dir):
    return cv.positional_purge(adjusted_events(spark, sf_dir), gap=5, max_train=300)


@query("leakage_gap", ["symbol", "fold", "train_rows", "test_rows"], ["gap_seconds"], f"{PURGED} SELECT symbol, fold, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'test') AS test_rows, epoch(min(t) FILTER (role = 'test')) - epoch(max(touch) FILTER (role = 'train')) AS gap_seconds FROM pg GROUP BY 1, 2")
def leakage_gap(spark, sf_dir):
    return cv.leakage_gap(purged(spark, sf_dir))


@query("test_buffer", ["symbol", "fold", "ts", "in_test"], [], f"{ROWS} SELECT symbol, fold, {TS}, CAST(row_id >= a AS BIGINT) AS in_test FROM f WHERE row_id BETWEEN a - 150 AND z - 1")
def test_buffer(spark, sf_dir):
    return cv.buffered_test(adjusted_events(spark, sf_dir))


# trading, from probabilities that a hash of the bar's price stands for

PROB = "CAST(floor(close * 7919) AS BIGINT) % 1000 / 1000.0"


def predicted(spark, sf_dir):
    df = labelled(spark, sf_dir).withColumnsRenamed({"target_barrier_return": "barrier_return", "target_label": "true_target"})
    prob = F.pmod(F.floor(F.col("close") * 7919).cast("long"), F.lit(1000)) / 1000.0
    fold = F.ntile(5).over(Window.partitionBy("symbol").orderBy("ts"))
    df = df.withColumn("barrier_return", F.col("barrier_return") / 100)  # the events' values jump too far for equity
    return df.withColumn("prob_up", prob).withColumn("fold", fold).where("true_target IS NOT NULL")


def signals(spark, sf_dir):
    return trading.rolling_signals(predicted(spark, sf_dir))


W60 = f"OVER ({ORD} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
SIG = f"""{label_sql()}, pr AS (SELECT *, {PROB} AS p, ntile(5) OVER ({ORD}) AS fold FROM lb), pv AS (SELECT * FROM pr WHERE y IS NOT NULL),
th AS (SELECT *, CASE WHEN count(p) {W60} >= 30 THEN quantile_cont(p, 0.65) {W60} END AS th, CASE WHEN count(p) {W60} >= 30 THEN (p - avg(p) {W60}) / (stddev_pop(p) {W60} + 1e-8) END AS z FROM pv),
sn AS (SELECT *, CASE WHEN p >= th THEN 1 ELSE 0 END AS sig, CASE WHEN p >= th THEN least(1.0, greatest(0.2, 0.2 + (z - 0.5) * 0.8 / 1.5)) ELSE 0.0 END AS bet FROM th)"""


@query("rolling_percentile_threshold", ["symbol", "ts", "pred_signal"], ["dynamic_threshold"], f"{SIG} SELECT symbol, {TS}, sig AS pred_signal, th AS dynamic_threshold FROM sn")
def rolling_percentile_threshold(spark, sf_dir):
    return signals(spark, sf_dir)


@query("bet_size", ["symbol", "ts"], ["bet_size"], f"{SIG} SELECT symbol, {TS}, bet AS bet_size FROM sn")
def bet_size(spark, sf_dir):
    return signals(spark, sf_dir)


@query("static_bets", ["symbol", "ts", "pred_signal"], ["bet_size"], f"{SIG} SELECT symbol, {TS}, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred_signal, CASE WHEN p >= 0.5 THEN least(1.0, greatest(0.2, (p - 0.5) / 0.5)) ELSE 0.0 END AS bet_size FROM sn")
def static_bets(spark, sf_dir):
    return trading.static_signals(predicted(spark, sf_dir))


@query("probability_buffer", ["symbol", "ts", "is_test"], [], f"{SIG}, tr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS k FROM sn WHERE fold < 5) SELECT symbol, {TS}, CAST(0 AS BIGINT) AS is_test FROM tr WHERE k <= 60 UNION ALL SELECT symbol, {TS}, 1 FROM sn WHERE fold = 5")
def probability_buffer(spark, sf_dir):
    df = predicted(spark, sf_dir)
    return trading.probability_buffer(df.where("fold < 5"), df.where("fold = 5"))


LOCK = f"""{SIG.replace('WITH ', 'WITH RECURSIVE ', 1)}, sq2 AS (SELECT symbol, t, touch, row_number() OVER ({ORD}) AS k FROM sn WHERE sig = 1),
lk AS (SELECT symbol, k, t, touch AS free, 1 AS taken FROM sq2 WHERE k = 1 UNION ALL SELECT s.symbol, s.k, s.t, CASE WHEN s.t >= lk.free THEN s.touch ELSE lk.free END, CASE WHEN s.t >= lk.free THEN 1 ELSE 0 END FROM lk JOIN sq2 s ON s.symbol = lk.symbol AND s.k = lk.k + 1),
ex AS (SELECT sn.*, coalesce(lk.taken, 0) AS taken FROM sn LEFT JOIN lk ON sn.symbol = lk.symbol AND sn.t = lk.t),
pn AS (SELECT *, CASE WHEN taken = 1 THEN ret / 100 * bet - 2 * 0.002 * bet ELSE 0.0 END AS pnl FROM ex)"""


def traded(spark, sf_dir):
    return trading.executed(trading.locked_out(signals(spark, sf_dir)))


@query("trade_lockout", ["symbol", "ts", "executed_signal"], ["net_trade_pnl"], f"{LOCK} SELECT symbol, {TS}, taken AS executed_signal, pnl AS net_trade_pnl FROM pn")
def trade_lockout(spark, sf_dir):
    return traded(spark, sf_dir)


EQ = f"{LOCK}, eq AS (SELECT *, product(1 + pnl) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS e FROM pn), pk AS (SELECT *, max(e) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS top FROM eq)"


@query("equity_drawdown", ["symbol", "ts"], ["equity_curve", "peak_equity", "drawdown"], f"{EQ} SELECT symbol, {TS}, e AS equity_curve, top AS peak_equity, (e - top) / top AS drawdown FROM pk")
def equity_drawdown(spark, sf_dir):
    return trading.equity(traded(spark, sf_dir))


@query("risk_metrics", ["symbol", "total_trades"], ["win_rate", "profit_factor", "win_loss_ratio", "cum_return", "ann_vol", "max_drawdown", "avg_bet", "sharpe", "sortino", "cagr", "calmar"], f"{EQ} SELECT symbol, count(*) FILTER (taken = 1) AS total_trades, count(*) FILTER (taken = 1 AND pnl > 0) / count(*) FILTER (taken = 1) AS win_rate, coalesce(sum(pnl) FILTER (pnl > 0), 0) / abs(sum(pnl) FILTER (pnl < 0)) AS profit_factor, coalesce(avg(pnl) FILTER (pnl > 0), 0) / abs(avg(pnl) FILTER (pnl < 0)) AS win_loss_ratio, arg_max(e, t) - 1 AS cum_return, stddev_samp(pnl) * sqrt(252) AS ann_vol, min((e - top) / top) AS max_drawdown, avg(bet) FILTER (taken = 1) AS avg_bet, (avg(pnl) * 252 - 0.045) / (stddev_samp(pnl) * sqrt(252)) AS sharpe, (avg(pnl) * 252 - 0.045) / (stddev_samp(pnl) FILTER (pnl < 0) * sqrt(252)) AS sortino, power(arg_max(e, t), 252 / count(*)) - 1 AS cagr, (power(arg_max(e, t), 252 / count(*)) - 1) / abs(min((e - top) / top)) AS calmar FROM pk GROUP BY 1")
def risk_metrics(spark, sf_dir):
    return trading.risk_metrics(trading.equity(traded(spark, sf_dir)))


FOLD_EQ = f"{LOCK}, eq AS (SELECT *, product(1 + pnl) OVER (PARTITION BY symbol, fold ORDER BY t ROWS UNBOUNDED PRECEDING) AS e FROM pn), pk AS (SELECT *, max(e) OVER (PARTITION BY symbol, fold ORDER BY t ROWS UNBOUNDED PRECEDING) AS top FROM eq)"
RATIOS = "count(*) FILTER (taken = 1) AS total_trades, CASE WHEN count(*) FILTER (taken = 1) > 0 THEN count(*) FILTER (taken = 1 AND pnl > 0) / count(*) FILTER (taken = 1) ELSE 0 END AS win_rate, CASE WHEN count(*) FILTER (taken = 1) > 0 THEN arg_max(e, t) - 1 ELSE 0 END AS cum_return, CASE WHEN count(*) FILTER (taken = 1) > 0 THEN min((e - top) / top) ELSE 0 END AS max_drawdown, coalesce(avg(bet) FILTER (taken = 1), 0) AS avg_bet"
WHOLE = "ea AS (SELECT *, product(1 + pnl) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS e FROM pn), pa AS (SELECT *, max(e) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS top FROM ea)"


@query("risk_metrics_by_fold", ["symbol", "label", "total_trades"], ["win_rate", "cum_return", "max_drawdown", "avg_bet"], f"{FOLD_EQ}, {WHOLE} SELECT symbol, 'Fold ' || fold AS label, {RATIOS} FROM pk GROUP BY symbol, fold UNION ALL SELECT symbol, 'Full OOS' AS label, {RATIOS} FROM pa GROUP BY symbol")
def risk_metrics_by_fold(spark, sf_dir):
    return trading.metrics_with_total(traded(spark, sf_dir))


@query("entry_rates", ["fold"], ["entry_rate", "min_threshold", "mean_threshold", "max_threshold"], f"{SIG} SELECT fold, avg(sig) AS entry_rate, min(th) AS min_threshold, avg(th) AS mean_threshold, max(th) AS max_threshold FROM sn GROUP BY 1")
def entry_rates(spark, sf_dir):
    return trading.entry_rates(signals(spark, sf_dir))


@query("bet_summary", ["fold"], ["active_pct", "mean_bet", "max_bet"], f"{SIG} SELECT fold, 100.0 * count(*) FILTER (bet > 0) / count(*) AS active_pct, avg(bet) AS mean_bet, max(bet) AS max_bet FROM sn GROUP BY 1")
def bet_summary(spark, sf_dir):
    return metrics.bet_summary(signals(spark, sf_dir))


@query("crosstab_signal", ["fold"], ["pred_signal_0", "pred_signal_1"], f"{SIG} SELECT fold, 100.0 * count(*) FILTER (sig = 0) / count(*) AS pred_signal_0, 100.0 * count(*) FILTER (sig = 1) / count(*) AS pred_signal_1 FROM sn GROUP BY 1")
def crosstab_signal(spark, sf_dir):
    return metrics.crosstab_share(signals(spark, sf_dir), "fold", "pred_signal", [0, 1])


# metrics of a score of documents against their labels

SCORED = "sc AS (SELECT l.quality AS y, (d.n_chars % 1000) / 1000.0 AS p, CAST((d.n_chars % 1000) / 1000.0 >= 0.5 AS INT) AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.pmod("n_chars", F.lit(1000)) / 1000.0).alias("p"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("quality").alias("y"), "p", (F.col("p") >= 0.5).cast("int").alias("pred"))


BIN = "greatest(0, least(CAST(floor(p * 5) AS INT), 4))"


@query("brier_uniform", [], ["brier", "reliability", "resolution", "uncertainty"], f"WITH {SCORED}, a AS (SELECT avg(y) AS base, avg(power(p - y, 2)) AS brier, count(*) AS n FROM sc), g AS (SELECT {BIN} AS k, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM sc GROUP BY 1) SELECT max(brier) AS brier, sum(g.n * power(mp - my, 2)) / max(a.n) AS reliability, sum(g.n * power(my - base, 2)) / max(a.n) AS resolution, max(base * (1 - base)) AS uncertainty FROM g, a")
def brier_uniform(spark, sf_dir):
    return metrics.brier_decomposition(scored(spark, sf_dir))


@query("calibration_curve", ["bin", "n"], ["mean_p", "mean_y"], f"WITH {SCORED} SELECT {BIN} AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM sc GROUP BY 1")
def calibration_curve(spark, sf_dir):
    return metrics.calibration_curve(scored(spark, sf_dir))


@query("calibration_quantile", ["bin", "n"], ["mean_p", "mean_y"], f"WITH {SCORED}, e AS (SELECT quantile_cont(p, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM sc) SELECT least(len(list_filter(q, lambda x: x <= p)) - 1, 4) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM sc, e GROUP BY 1")
def calibration_quantile(spark, sf_dir):
    return metrics.calibration_curve(scored(spark, sf_dir), quantile=True)


@query("brier_quantile", ["bin", "n"], ["mean_p", "mean_y"], f"WITH {SCORED}, e AS (SELECT quantile_cont(p, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q, max(p) AS top FROM sc) SELECT least(len(list_filter(q, lambda x: x <= p)) - 1, 4) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM sc, e WHERE p < top GROUP BY 1")
def brier_quantile(spark, sf_dir):
    return metrics.calibration_curve(scored(spark, sf_dir), quantile=True, drop_top=True)


@query("confusion_matrix", ["y", "pred_0", "pred_1"], [], f"WITH {SCORED} SELECT y, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM sc GROUP BY 1")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir))


@query("roc_auc", ["positives", "negatives"], ["auc"], f"WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS k FROM sc) SELECT (sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives FROM r")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored(spark, sf_dir))


@query("score_metrics", [], ["brier", "log_loss", "accuracy"], f"WITH {SCORED}, q AS (SELECT y, p, pred, least(greatest(p, 1e-15), 1 - 1e-15) AS c FROM sc) SELECT avg(power(p - y, 2)) AS brier, avg(-(y * ln(c) + (1 - y) * ln(1 - c))) AS log_loss, avg(CASE WHEN pred = y THEN 1.0 ELSE 0 END) AS accuracy FROM q")
def score_metrics(spark, sf_dir):
    return metrics.scores(scored(spark, sf_dir))


@query("classification_report", ["label", "support"], ["precision", "recall", "f1"], f"WITH {SCORED}, k AS (SELECT unnest([0, 1]) AS c), g AS (SELECT c, count(*) FILTER (y = c) AS support, count(*) FILTER (pred = c) AS said, count(*) FILTER (y = c AND pred = c) AS hit FROM sc, k GROUP BY 1), m AS (SELECT c, support, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM g), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m) SELECT CAST(c AS VARCHAR) AS label, support, precision, recall, f1 FROM f UNION ALL SELECT 'macro', CAST(sum(support) AS BIGINT), avg(precision), avg(recall), avg(f1) FROM f UNION ALL SELECT 'weighted', CAST(sum(support) AS BIGINT), sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM f")
def classification_report(spark, sf_dir):
    return metrics.classification_report(scored(spark, sf_dir))


# diagnostics

BASE = f"WITH {EVENTS}, {adjusted_sql('ev')}"


@query("jarque_bera", ["symbol", "n"], ["mean", "std", "skewness", "kurtosis", "jb_stat"], f"{BASE}, m AS (SELECT symbol, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS std, skewness(r) AS skewness, kurtosis(r) + 3 AS kurtosis FROM b GROUP BY 1), d AS (SELECT b.symbol, avg(power(r - mean, 2)) AS m2, avg(power(r - mean, 3)) AS m3, avg(power(r - mean, 4)) AS m4 FROM b JOIN m ON b.symbol = m.symbol WHERE r IS NOT NULL GROUP BY 1) SELECT m.*, n / 6 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4) AS jb_stat FROM m JOIN d ON m.symbol = d.symbol")
def jarque_bera(spark, sf_dir):
    return diagnostics.distribution(adjusted_events(spark, sf_dir))


@query("acf", ["symbol", "lag", "significant"], ["acf"], f"{BASE}, e AS (SELECT symbol, t, r - avg(r) OVER (PARTITION BY symbol) AS e, row_number() OVER ({ORD}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b WHERE r IS NOT NULL), v AS (SELECT symbol, sum(e * e) AS s, max(n) AS n FROM e GROUP BY 1), g AS (SELECT x.symbol, k.lag, sum(x.e * y.e) AS c FROM generate_series(1, 10) AS k(lag), e x JOIN e y ON x.symbol = y.symbol AND y.i = x.i - k.lag GROUP BY 1, 2) SELECT g.symbol, g.lag, CAST(abs(c / s) > 1.96 / sqrt(n) AS BIGINT) AS significant, c / s AS acf FROM g JOIN v ON g.symbol = v.symbol")
def acf(spark, sf_dir):
    return diagnostics.autocorrelation(adjusted_events(spark, sf_dir))


@query("permutation_entropy", ["symbol"], ["entropy"], f"{BASE}, p AS (SELECT symbol, r AS z, {lag('r')} AS y, {lag('r', 2)} AS x FROM b WHERE r IS NOT NULL), c AS (SELECT symbol, CAST(x > y AS INT) * 4 + CAST(y > z AS INT) * 2 + CAST(x > z AS INT) AS k, count(*) AS n FROM p WHERE x IS NOT NULL GROUP BY 1, 2), s AS (SELECT symbol, n / sum(n) OVER (PARTITION BY symbol) AS q FROM c) SELECT symbol, -sum(q * log2(q)) / log2(6) AS entropy FROM s GROUP BY 1")
def permutation_entropy(spark, sf_dir):
    return diagnostics.pattern_entropy(adjusted_events(spark, sf_dir))


@query("spearman_volume", ["symbol", "n"], ["rho", "t_stat"], f"{BASE}, k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY v) + (count(*) OVER (PARTITION BY symbol, v) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol ORDER BY abs(r)) + (count(*) OVER (PARTITION BY symbol, abs(r)) - 1) / 2 AS z FROM b WHERE r IS NOT NULL), g AS (SELECT symbol, count(*) AS n, corr(a, z) AS rho FROM k GROUP BY 1) SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t_stat FROM g")
def spearman_volume(spark, sf_dir):
    return diagnostics.rank_correlation(adjusted_events(spark, sf_dir).withColumn("a", F.abs("log_return")), "volume", "a")


@query("leverage", ["symbol", "is_asymmetric"], ["leverage"], f"{BASE}, k AS (SELECT symbol, r, {lag('r')} AS l FROM b) SELECT symbol, corr(l, r * r) AS leverage, CAST(corr(l, r * r) < -0.1 AS BIGINT) AS is_asymmetric FROM k GROUP BY 1")
def leverage(spark, sf_dir):
    return diagnostics.leverage(adjusted_events(spark, sf_dir))


@query("dgp_payload", ["symbol", "dominant_cycle"], ["optimal_d", "hurst", "vr_3", "vr_20", "adf_p", "kpss_p", "arch_p", "bds_p", "entropy"])
def dgp_payload(spark, sf_dir):
    return diagnostics.scan(adjusted_events(spark, sf_dir))


@query("regime_mixture", ["symbol", "ts"], ["gmm_prob_bull", "gmm_prob_bear"])
def regime_mixture(spark, sf_dir):
    return diagnostics.regime_probabilities(adjusted_events(spark, sf_dir))


# selection and models

CANDIDATES = ["geo_body_ratio", "ret_3", "zscore_5", "zscore_20", "rsi_14", "vol_parkinson", "kinematic_squeeze_ratio", "cmf_20", "net_pressure_ratio", "body_direction_momentum", "vol_directional_bias", "liq_amihud_pct_rank"]


def routed(spark, sf_dir):
    df, _ = features.route(labelled(spark, sf_dir))
    return df.select("symbol", "ts", "target_label", "target_barrier_return", "barrier_touch_time", *CANDIDATES)


@query("corr_prune_vif", ["feature"], [])
def corr_prune_vif(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in selection.screened(routed(spark, sf_dir), CANDIDATES)], "feature string")


@query("feature_clusters", ["feature", "cluster"], [])
def feature_clusters(spark, sf_dir):
    return spark.createDataFrame(list(selection.clusters(routed(spark, sf_dir), CANDIDATES).items()), "feature string, cluster int")


@query("consensus_vote", ["symbol", "feature", "votes", "lag", "blocks"], [])
def consensus_vote(spark, sf_dir):
    return selection.votes(routed(spark, sf_dir), CANDIDATES)


@query("consensus_features", ["symbol", "place", "feature", "votes", "lag"], [])
def consensus_features(spark, sf_dir):
    return selection.consensus(routed(spark, sf_dir), CANDIDATES)


def fold_rows(spark, sf_dir):
    return cv.purged(routed(spark, sf_dir), embargo_days=1, max_train=300)


@query("logit_platt_oos", ["symbol", "fold", "ts", "role", "y"], ["prob_up", "slope", "offset"])
def logit_platt_oos(spark, sf_dir):
    return model.out_of_sample(fold_rows(spark, sf_dir), ["cmf_20", "vol_parkinson", "ret_3", "geo_body_ratio"]).where("role = 'test'")


@query("permutation_importance", ["feature", "n"], ["mean_loss", "std_loss"])
def permutation_importance(spark, sf_dir):
    return model.importance(fold_rows(spark, sf_dir), ["cmf_20", "vol_parkinson", "ret_3", "geo_body_ratio"])


@query("logit_balanced", ["term"], ["value"])
def logit_balanced(spark, sf_dir):
    cols = ["cmf_20", "vol_parkinson", "ret_3"]
    rows, names = model.interactions(model.imputed(routed(spark, sf_dir).where("target_label is not null"), cols), cols)
    fitted = model.balanced_logistic(model.scaled(rows, names), names, "target_label")
    return spark.createDataFrame([*zip(names, map(float, fitted.coefficients)), ("intercept", float(fitted.intercept))], "term string, value double")


@query("imputed_scaled", ["symbol", "ts"], ["x"], f"{BASE}, q AS (SELECT quantile_cont(r, 0.5) AS m FROM b), f AS (SELECT symbol, t, coalesce(r, m) AS x FROM b, q), s AS (SELECT avg(x) AS a, stddev_pop(x) AS d FROM f) SELECT symbol, {TS}, (x - a) / d AS x FROM f, s")
def imputed_scaled(spark, sf_dir):
    df = adjusted_events(spark, sf_dir).withColumn("x", F.col("log_return"))
    return model.scaled(model.imputed(df, ["x"]), ["x"])


_SHUFFLE = lambda seed: f"row_number() OVER (PARTITION BY fold ORDER BY md5('{seed}|' || symbol || '|' || strftime(t, '%Y-%m-%d %H:%M:%S.%f')))"


@query("permuted_column", ["symbol", "ts", "fold"], ["prob_up"], f"{SIG}, a AS (SELECT fold, p, {_SHUFFLE(42)} AS n FROM sn), z AS (SELECT symbol, t, fold, {_SHUFFLE(43)} AS n FROM sn) SELECT symbol, {TS}, z.fold, p AS prob_up FROM z JOIN a ON z.fold = a.fold AND z.n = a.n")
def permuted_column(spark, sf_dir):
    """Each row's value after the shuffle within folds."""
    return metrics.permuted(predicted(spark, sf_dir).select("symbol", "ts", "fold", "prob_up"), "prob_up")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_summary(spark, sf_dir)
