"""Queries of hidden regimes, hierarchies of features, models as tables, and tests from sums over lags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.tables import written
from tidewright.operators import diagnostics, model, moments, regimes, selection
from tidewright.plans import core_queries as q
from tidewright.plans.more_queries import new_path
from tidewright.plans.oracle import ORD, TS, lag, swept
from tidewright.plans.registry import ORACLES, query


@query("markov_regimes", ["symbol", "ts"], [regimes.LOW, regimes.HIGH])
def markov_regimes(spark, sf_dir):
    """Chances of two regimes of each symbol's returns, by a chain fitted to them."""
    return regimes.regimes(q.adjusted_events(spark, sf_dir))


_LOW, _HIGH = "exp(-0.5 * power(x - m, 2) / (0.25 * vv)) / sqrt(0.25)", "exp(-0.5 * power(x - m, 2) / (1.75 * vv)) / sqrt(1.75)"
_AHEAD = "(p * 0.9 + (1 - p) * (1 - 0.95))"
_STEP = f"{_AHEAD} * {_HIGH} / ({_AHEAD} * {_HIGH} + (1 - {_AHEAD}) * {_LOW})"


@query("markov_filter", ["symbol", "ts"], [regimes.LOW, regimes.HIGH], f"""{q.BASE}, mv AS (SELECT symbol, avg(r) AS m, var_pop(r) AS vv FROM b GROUP BY 1), k AS (SELECT b.symbol, t, m, vv, list(r) OVER ({ORD.replace('symbol', 'b.symbol')} ROWS UNBOUNDED PRECEDING) AS xs FROM b JOIN mv ON b.symbol = mv.symbol WHERE r IS NOT NULL),
f AS (SELECT symbol, t, list_reduce(list_prepend((1 - 0.95) / (2 - 0.95 - 0.9), xs), lambda p, x: {_STEP}) AS h FROM k) SELECT symbol, {TS}, 1 - h AS {regimes.LOW}, h AS {regimes.HIGH} FROM f""")
def markov_filter(spark, sf_dir):
    """Chances by chains set from each symbol's mean and variance."""
    df = q.adjusted_events(spark, sf_dir)
    m, v = F.avg("log_return"), F.var_pop("log_return")
    chains = df.groupBy("symbol").agg(F.array(m, m).alias("mean"), F.array(0.25 * v, 1.75 * v).alias("var"), F.array(F.lit(0.95), F.lit(0.9)).alias("stay"))
    return regimes.filtered(df, chains)


@query("regime_information", ["symbol", "feature", "accepted"], ["mi_high_vol", "mi_low_vol", "mi_all"])
def regime_information(spark, sf_dir):
    """Information of features with the label within the hidden regimes."""
    rows = written(q.routed(spark, sf_dir))
    chance = regimes.regimes(q.adjusted_events(spark, sf_dir)).select("symbol", "ts", regimes.HIGH)
    return regimes.conditioned_information(rows.join(chance, ["symbol", "ts"]), q.CANDIDATES)


@query("feature_medoids", ["feature", "cluster", "medoid"], [])
def feature_medoids(spark, sf_dir):
    found = selection.hierarchy(written(q.routed(spark, sf_dir)), q.CANDIDATES, 5)
    return spark.createDataFrame([(c, i, best) for c, (i, best) in found.items()], "feature string, cluster int, medoid boolean")


@query("wide_consensus", ["symbol", "place", "feature", "votes", "lag"], [])
def wide_consensus(spark, sf_dir):
    return selection.wide_consensus(written(q.routed(spark, sf_dir)), q.CANDIDATES)


COLUMNS = ["cmf_20", "vol_parkinson", "ret_3", "geo_body_ratio"]


def fold_model(spark, sf_dir):
    """Folds' rows, and the models of their training rows, written and read."""
    rows = written(q.fold_rows(spark, sf_dir))
    path = new_path(spark, "fold-model")
    model.FoldLogistic(features=COLUMNS).fit(rows.where("role = 'train'")).save(path)
    return rows, model.FoldLogisticModel.load(path)


@query("fold_models", ["symbol", "fold", "rows"], ["slope", "offset"])
def fold_models(spark, sf_dir):
    """A row of parameters a symbol and fold."""
    return fold_model(spark, sf_dir)[1].table


@query("fold_model_scores", ["symbol", "fold", "ts", "role"], ["prob_up"])
def fold_model_scores(spark, sf_dir):
    """Chances of test rows by models that were fitted, written and read before."""
    rows, found = fold_model(spark, sf_dir)
    return found.transform(rows.where("role = 'test'"))


# tests from sums over lags

_R = f"{q.BASE}, r0 AS (SELECT symbol, t, r FROM b WHERE r IS NOT NULL)"
_SQ = ", ".join(f"lag(r * r, {i}) OVER ({ORD}) AS l{i}" for i in range(1, 6))


@query("arch_test", ["symbol", "n"], ["stat"], f"{_R}, a AS (SELECT symbol, t, r * r * 1e6 AS s, {_SQ} FROM r0), c AS (SELECT * FROM a WHERE l5 IS NOT NULL), {swept('g', 'c', 'symbol', 'symbol', 's', [f'l{i}' for i in range(1, 6)])}, z AS (SELECT symbol, sum(s * s) AS z FROM g0 GROUP BY 1) SELECT g5.symbol, count(*) AS n, count(*) * (1 - sum(s * s) / any_value(z)) AS stat FROM g5 JOIN z ON g5.symbol = z.symbol GROUP BY 1")
def arch_test(spark, sf_dir):
    return moments.arch_lm(q.adjusted_events(spark, sf_dir))


def _granger() -> str:
    lags = ", ".join(f"lag({c}, {i}) OVER (PARTITION BY symbol, feature ORDER BY t) AS {c}{i}" for i in (1, 2) for c in "yx")
    parts = [f"{q.BASE}, k0 AS (SELECT symbol, t, r AS y, unnest(['volume', 'range']) AS feature, unnest([v, ln(h / l)]) AS x FROM b), k1 AS (SELECT *, {lags} FROM k0 WHERE y IS NOT NULL AND x IS NOT NULL)"]
    out = []
    for n in (1, 2):
        own, other = [f"y{i}" for i in range(1, n + 1)], [f"x{i}" for i in range(1, n + 1)]
        parts.append(f"k1_{n} AS (SELECT * FROM k1 WHERE y{n} IS NOT NULL)")
        parts.append(swept(f"w{n}_", f"k1_{n}", "symbol, feature", "symbol, feature", "y", own + other))
        parts += [f"s{n}{k} AS (SELECT symbol, feature, count(*) AS n, sum(y * y) AS s FROM w{n}_{k} GROUP BY ALL)" for k in (n, 2 * n)]
        out.append(f"SELECT a.symbol, a.feature, {n} AS lag, a.n, ((a.s - b.s) / {n}) / (b.s / (a.n - {2 * n + 1})) AS f_stat FROM s{n}{n} a JOIN s{n}{2 * n} b ON a.symbol = b.symbol AND a.feature = b.feature")
    return ",\n".join(parts) + " " + " UNION ALL ".join(out)


@query("granger_test", ["symbol", "feature", "lag", "n"], ["f_stat"], _granger())
def granger_test(spark, sf_dir):
    """Whether volume and range foretell returns."""
    df = q.adjusted_events(spark, sf_dir).withColumn("range", F.log(F.col("high_adj") / F.col("low_adj")))
    return moments.granger(df, ["volume", "range"], "log_return")


def _unit_root(most: int = 24) -> str:
    """For series whose test takes at most `most` lags."""
    lags = [f"l{i}" for i in range(1, most + 1)]
    m = "least(CAST(ceil(12 * power(n / 100.0, 0.25)) AS BIGINT), n // 2 - 3)"
    parts = [
        f"{q.BASE}, u0 AS (SELECT symbol, t, c, c - {lag('c')} AS d, {lag('c')} AS level, row_number() OVER ({ORD}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b), u1 AS (SELECT *, {m} AS m, {', '.join(f'lag(d, {i}) OVER ({ORD}) AS {x}' for i, x in enumerate(lags, 1))} FROM u0)",
        f"ua AS (SELECT symbol, m, d, level, {', '.join(f'CASE WHEN {i} <= m THEN {x} ELSE 0 END AS {x}' for i, x in enumerate(lags, 1))} FROM u1 WHERE i >= m + 2)",
        swept("va", "ua", "symbol", "symbol, m", "d", ["level", *lags]),
        "aic AS (" + " UNION ALL ".join(f"SELECT symbol, {k} AS lags, count(*) * ln(sum(d * d) / count(*)) + 2 * {k + 2} AS a FROM va{k + 1} WHERE {k} <= m GROUP BY 1" for k in range(most + 1)) + ")",
        "best AS (SELECT symbol, arg_min(lags, (a, lags)) AS lags FROM aic GROUP BY 1)",
        f"ub AS (SELECT u1.symbol, best.lags, d, level, {', '.join(f'CASE WHEN {i} <= best.lags THEN {x} ELSE 0 END AS {x}' for i, x in enumerate(lags, 1))} FROM u1 JOIN best ON u1.symbol = best.symbol WHERE i >= best.lags + 2)",
        swept("vb", "ub", "symbol", "symbol, lags", "d", [*lags, "level"]),
        f"last AS (SELECT a.symbol, a.lags, count(*) AS k, sum(a.d * a.level) / sum(a.level * a.level) AS beta, sum(a.level * a.level) AS xx FROM vb{most} a GROUP BY ALL)",
        f"ssr AS (SELECT symbol, sum(d * d) AS s FROM vb{most + 1} GROUP BY 1)",
    ]
    return ",\n".join(parts) + " SELECT last.symbol, lags, beta / sqrt(s / (k - lags - 2) / xx) AS stat FROM last JOIN ssr ON last.symbol = ssr.symbol"


@query("unit_root", ["symbol", "lags"], ["stat"], _unit_root())
def unit_root(spark, sf_dir):
    """The augmented Dickey-Fuller test of prices."""
    return moments.unit_roots(q.adjusted_events(spark, sf_dir))


@query("fractional_orders", ["symbol"], ["optimal_d", "adf_p"])
def fractional_orders(spark, sf_dir):
    return moments.optimal_orders(q.adjusted_events(spark, sf_dir))


@query("fluctuation", ["symbol"], ["hurst"], f"""{_R}, n0 AS (SELECT symbol, count(*) AS n, avg(r) AS m FROM r0 GROUP BY 1), sc AS (SELECT DISTINCT symbol, n, m, CAST(floor(power(10, 1 + k * (log10(n // 4) - 1) / 14)) AS BIGINT) AS s FROM n0, range(15) q(k)),
wk AS (SELECT r0.symbol, n, sum(r - m) OVER (PARTITION BY r0.symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS w, row_number() OVER (PARTITION BY r0.symbol ORDER BY t) - 1 AS i FROM r0 JOIN n0 ON r0.symbol = n0.symbol),
pt AS (SELECT wk.symbol, s, i // s AS part, sqrt(greatest(0, var_pop(w) * (1 - power(corr(i, w), 2)))) AS f FROM wk JOIN sc ON wk.symbol = sc.symbol WHERE i // s < wk.n // s GROUP BY 1, 2, 3),
fl AS (SELECT symbol, s, avg(f) AS f FROM pt GROUP BY 1, 2) SELECT symbol, regr_slope(ln(f), ln(s)) AS hurst FROM fl GROUP BY 1""")
def fluctuation(spark, sf_dir):
    """The exponent of detrended fluctuation of returns."""
    return moments.fluctuation(q.adjusted_events(spark, sf_dir))


@query("dominant_cycle", ["symbol", "dominant_cycle"], [], f"""{q.BASE}, p AS (SELECT symbol, c, row_number() OVER ({ORD}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b), e AS (SELECT symbol, i, n, c - avg(c) OVER w - covar_pop(c, i) OVER w / var_pop(i) OVER w * (i - avg(i) OVER w) AS e FROM p WINDOW w AS (PARTITION BY symbol)),
f AS (SELECT symbol, n, k, power(sum(e * cos(2 * pi() * k * i / n)), 2) + power(sum(e * sin(2 * pi() * k * i / n)), 2) AS a FROM e, range(1, 2000) q(k) WHERE k <= n // 2 GROUP BY ALL)
SELECT symbol, CAST(floor(least(greatest(any_value(n) / arg_max(k, a), 3), 30)) AS BIGINT) AS dominant_cycle FROM f GROUP BY 1""")
def dominant_cycle(spark, sf_dir):
    """The period of the strongest frequency of prices (for symbols of under 4,000 bars in the SQL)."""
    return diagnostics.scan(q.adjusted_events(spark, sf_dir)).select("symbol", "dominant_cycle")


# redundancy of columns

_COLS = {"open_gap": "o / c", "range": "ln(h / l)", "twice": "2 * ln(h / l) + 1", "volume": "v", "body": "ln(c / o)", "top": "ln(h / c)", "flat": "v * 0 + 3"}
_REAL = ["range", "volume", "body", "top"]


def bar_columns(spark, sf_dir):
    """Columns of bars of which one repeats another, one is all but a third's, and one is constant."""
    c = lambda n: F.col(f"{n}_adj")
    spread = F.log(c("high") / c("low"))
    return q.adjusted_events(spark, sf_dir).select((c("open") / c("close")).alias("open_gap"), spread.alias("range"), (2 * spread + 1).alias("twice"), "volume", F.log(c("close") / c("open")).alias("body"), F.log(c("high") / c("close")).alias("top"), (F.col("volume") * 0 + 3).alias("flat"))


_CX = f"{q.BASE}, cx AS (SELECT {', '.join(f'{x} AS {n}' for n, x in _COLS.items())} FROM b)"
_pairs = [(a, b) for i, b in enumerate(list(_COLS)[:-1]) for a in list(_COLS)[:i]]


@query("varied_columns", ["feature"], [], f"{_CX} SELECT feature FROM (SELECT unnest({list(_COLS)}) AS feature, unnest([{', '.join(f'var_pop({n})' for n in _COLS)}]) AS v FROM cx) WHERE v > 1e-8")
def varied_columns(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in selection.varied(bar_columns(spark, sf_dir), list(_COLS))], "feature string")


@query("uncorrelated_columns", ["feature"], [], f"{_CX}, p AS ({' UNION ALL '.join(f'SELECT {b!r} AS b, abs(corr({a}, {b})) AS r FROM cx' for a, b in _pairs)}) SELECT unnest({list(_COLS)[:-1]}) AS feature EXCEPT SELECT b FROM p WHERE r > 0.8")
def uncorrelated_columns(spark, sf_dir):
    """Columns that correlate with no earlier one."""
    df, names = bar_columns(spark, sf_dir), list(_COLS)[:-1]
    kept = selection.k.correlated_kept(selection.matrix(df, names))
    return spark.createDataFrame([(names[i],) for i in kept], "feature string")


def _inflation() -> str:
    parts, out = [f"{_CX}, cg AS (SELECT 1 AS g, * FROM cx)"], []
    for c in _REAL:
        parts.append(swept(f"i_{c}", "cg", "g", "g", c, [x for x in _REAL if x != c]))
        out.append(f"SELECT '{c}' AS feature, (SELECT sum({c} * {c}) FROM i_{c}0) / (SELECT sum({c} * {c}) FROM i_{c}{len(_REAL) - 1}) AS vif")
    return ",\n".join(parts) + " " + " UNION ALL ".join(out)


@query("inflation", ["feature"], ["vif"], _inflation())
def inflation(spark, sf_dir):
    """Variance inflation of columns by each other."""
    return spark.createDataFrame(list(selection.inflation(bar_columns(spark, sf_dir), _REAL).items()), "feature string, vif double")


@query("stationarity", ["symbol", "lags"], ["stat", "p"], f"""{q.BASE}, e AS (SELECT symbol, c - avg(c) OVER (PARTITION BY symbol) AS e, row_number() OVER ({ORD}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b),
k AS (SELECT x.symbol, l.h, any_value(x.n) AS n, sum(x.e * y.e) AS c FROM range(0, 200) l(h), e x JOIN e y ON x.symbol = y.symbol AND y.i = x.i - l.h GROUP BY 1, 2),
g AS (SELECT symbol, n, sum(CASE WHEN h = 0 THEN c ELSE 2 * c END) / n AS s0, sum(2 * h * c) / n AS s1 FROM k WHERE h <= floor(power(n, 2.0 / 9)) GROUP BY symbol, n),
m AS (SELECT symbol, n, least(CAST(floor(1.1447 * power(power(s1 / s0, 2), 1.0 / 3) * power(n, 1.0 / 3)) AS BIGINT), n - 1) AS lags FROM g),
s AS (SELECT m.symbol, m.n, lags, sum(CASE WHEN h = 0 THEN c ELSE 2 * (1 - h / (lags + 1)) * c END) / m.n AS s FROM m JOIN k ON m.symbol = k.symbol AND h <= lags GROUP BY m.symbol, m.n, lags),
w AS (SELECT symbol, sum(w * w) AS w FROM (SELECT symbol, sum(e) OVER (PARTITION BY symbol ORDER BY i) AS w FROM e) GROUP BY 1), t AS (SELECT s.symbol, lags, w.w / (n * n) / s AS stat FROM s JOIN w ON s.symbol = w.symbol)
SELECT symbol, lags, stat, CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 - (stat - 0.347) / 0.116 * 0.05 WHEN stat <= 0.574 THEN 0.05 - (stat - 0.463) / 0.111 * 0.025 WHEN stat <= 0.739 THEN 0.025 - (stat - 0.574) / 0.165 * 0.015 ELSE 0.01 END AS p FROM t""")
def stationarity(spark, sf_dir):
    return moments.stationarity(q.adjusted_events(spark, sf_dir))


def _ratios() -> str:
    parts = [f"{q.BASE}, p AS (SELECT symbol, t, ln(c) AS p, ln(c) - {lag('ln(c)')} AS r FROM b), f AS (SELECT symbol, count(r) AS n, avg(r) AS m FROM p GROUP BY 1), e AS (SELECT p.*, n, m, power(r - m, 2) AS q, row_number() OVER (PARTITION BY p.symbol ORDER BY t) AS i FROM p JOIN f ON p.symbol = f.symbol), s AS (SELECT symbol, any_value(n) AS n, sum(q) AS s FROM e GROUP BY 1)"]
    out = []
    for n in (3, 20):
        parts.append(f"v{n} AS (SELECT symbol, sum(power(d, 2)) AS f FROM (SELECT symbol, p - lag(p, {n}) OVER (PARTITION BY symbol ORDER BY i) - {n} * m AS d FROM e) GROUP BY 1)")
        parts.append(f"t{n} AS (SELECT x.symbol, sum(power(2 * ({n} - j.j) / {n}, 2) * x.q * y.q) AS t FROM range(1, {n}) j(j), e x JOIN e y ON x.symbol = y.symbol AND y.i = x.i - j.j GROUP BY 1)")
        ratio = f"(f / ({n} * (n - {n} + 1) * (1 - {n} / n)) / (s / (n - 1)))"
        out.append(f"SELECT s.symbol, {n} AS steps, {ratio} AS ratio, ({ratio} - 1) * s / sqrt(t) AS z FROM s JOIN v{n} ON s.symbol = v{n}.symbol JOIN t{n} ON s.symbol = t{n}.symbol")
    return ", ".join(parts) + " " + " UNION ALL ".join(out)


@query("variance_ratio", ["symbol", "steps"], ["ratio", "z"], _ratios())
def variance_ratio(spark, sf_dir):
    return moments.variance_ratios(q.adjusted_events(spark, sf_dir))


# flags and statistics of the payload

#: 5 % points of the normal distribution, two-sided, and of chi-square with five degrees of freedom.
_Z5, _CHI5 = 1.959963984540054, 11.070497693516351


@query("payload_tests", ["symbol", "has_long_trend", "has_short_reversion", "has_vol_clustering"], [], f"""SELECT v.symbol, CAST(bool_or(steps = 20 AND ratio > 1 AND abs(z) > {_Z5}) AS BIGINT) AS has_long_trend, CAST(bool_or(steps = 3 AND ratio < 1 AND abs(z) > {_Z5}) AS BIGINT) AS has_short_reversion, CAST(any_value(stat) > {_CHI5} AS BIGINT) AS has_vol_clustering
FROM ({_ratios()}) v JOIN ({ORACLES['arch_test']}) a ON v.symbol = a.symbol GROUP BY v.symbol""")
def payload_tests(spark, sf_dir):
    """Flags that are tests of one statistic, by its critical value."""
    return diagnostics.scan(q.adjusted_events(spark, sf_dir)).select("symbol", "flags.*")


_AR = f"""{_R}, a0 AS (SELECT symbol, t, r, {lag('r')} AS p FROM r0), a1 AS (SELECT symbol, t, r - avg(r) OVER w - covar_pop(r, p) OVER w / var_pop(p) OVER w * (p - avg(p) OVER w) AS e FROM a0 WHERE p IS NOT NULL WINDOW w AS (PARTITION BY symbol)),
x AS MATERIALIZED (SELECT symbol, e / (stddev_pop(e) OVER (PARTITION BY symbol) + 1e-8) AS x, row_number() OVER ({ORD}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM a1),
y AS MATERIALIZED (SELECT *, lead(x) OVER (PARTITION BY symbol ORDER BY i) AS y, 1.5 * stddev_samp(x) OVER (PARTITION BY symbol) AS far FROM x),
nr AS MATERIALIZED (SELECT a.symbol, a.i, any_value(a.n) AS n, count(*) FILTER (abs(a.x - b.x) < a.far) AS k, count(*) FILTER (abs(a.x - b.x) < a.far AND abs(a.y - b.y) < a.far) AS j FROM y a JOIN y b ON a.symbol = b.symbol AND a.i <> b.i GROUP BY 1, 2),
bc AS (SELECT symbol, max(n) AS n, sum(k) / (max(n) * (max(n) - 1)) AS c, sum(k * (k - 1)) / (max(n) * (max(n) - 1) * (max(n) - 2)) AS kk, (sum(k) - 2 * max(CASE WHEN i = 1 THEN k END)) / ((max(n) - 1) * (max(n) - 2)) AS c1, sum(j) / ((max(n) - 1) * (max(n) - 2)) AS cm FROM nr GROUP BY 1),
bds AS (SELECT symbol, sqrt(n - 1) * (cm - c1 * c1) / sqrt(4 * (kk * kk + 2 * kk * c * c + power(c, 4) - 4 * kk * c * c)) AS bds_stat FROM bc)"""
_MI = """m0 AS MATERIALIZED (SELECT symbol, p / stddev_pop(p) OVER w AS a, r / stddev_pop(r) OVER w AS b, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i, count(*) OVER w AS n FROM a0 WHERE p IS NOT NULL WINDOW w AS (PARTITION BY symbol)),
m1 AS (SELECT u.symbol, u.i, greatest(abs(u.a - v.a), abs(u.b - v.b)) AS d FROM m0 u JOIN m0 v ON u.symbol = v.symbol AND u.i <> v.i QUALIFY row_number() OVER (PARTITION BY u.symbol, u.i ORDER BY d) = 3),
m2 AS (SELECT u.symbol, u.i, any_value(u.n) AS n, count(*) FILTER (abs(u.a - v.a) <= (1 - 1e-10) * d) AS ka, count(*) FILTER (abs(u.b - v.b) <= (1 - 1e-10) * d) AS kb FROM m0 u JOIN m1 ON u.symbol = m1.symbol AND u.i = m1.i JOIN m0 v ON u.symbol = v.symbol GROUP BY 1, 2),
hm AS (SELECT k + 1 AS k, sum(CASE WHEN k > 0 THEN 1 / k ELSE 0 END) OVER (ORDER BY k) AS h FROM range(0, 20000) z(k)),
mi AS (SELECT symbol, greatest(0, any_value(hn.h) + 1.5 - avg(x.h) - avg(z.h)) AS mi_lag1 FROM m2 JOIN hm hn ON hn.k = n JOIN hm x ON x.k = ka JOIN hm z ON z.k = kb GROUP BY 1)"""


@query("dependence_tests", ["symbol"], ["bds_stat", "mi_lag1"], f"{_AR}, {_MI} SELECT bds.symbol, bds_stat, mi_lag1 FROM bds JOIN mi ON bds.symbol = mi.symbol")
def dependence_tests(spark, sf_dir):
    """The independence test of what an autoregression leaves, and the information of a return about the next (in the SQL by joins of
    all pairs)."""
    return diagnostics.scan(q.adjusted_events(spark, sf_dir)).select("symbol", "bds_stat", "mi_lag1")


_CLASSES = f"""{q.BASE}, g0 AS (SELECT symbol, t, CAST(c > o AS INT) AS y, unnest(['all', CASE WHEN v > 1 THEN 'high' ELSE 'low' END]) AS state, r, ln(h / l) AS rg FROM b WHERE r IS NOT NULL),
g1 AS (SELECT symbol, state, y, unnest(['ret', 'range']) AS feature, unnest([r, rg]) AS v FROM g0), g2 AS MATERIALIZED (SELECT symbol, state, feature, y, v / stddev_pop(v) OVER (PARTITION BY symbol, state, feature) AS v, row_number() OVER (PARTITION BY symbol, state, feature) AS i, count(*) OVER (PARTITION BY symbol, state, feature, y) AS own FROM g1),
g3 AS MATERIALIZED (SELECT a.symbol, a.state, a.feature, a.i, a.own, a.v, abs(a.v - b.v) AS d FROM g2 a JOIN g2 b ON a.symbol = b.symbol AND a.state = b.state AND a.feature = b.feature AND a.y = b.y AND a.i <> b.i WHERE a.own > 3 QUALIFY row_number() OVER (PARTITION BY a.symbol, a.state, a.feature, a.i ORDER BY abs(a.v - b.v)) = 3),
g4 AS (SELECT a.symbol, a.state, a.feature, a.i, any_value(a.own) AS own, count(*) AS m FROM g3 a JOIN g3 b ON a.symbol = b.symbol AND a.state = b.state AND a.feature = b.feature AND abs(a.v - b.v) <= (1 - 1e-10) * a.d GROUP BY 1, 2, 3, 4),
hm AS (SELECT k + 1 AS k, sum(CASE WHEN k > 0 THEN 1 / k ELSE 0 END) OVER (ORDER BY k) AS h FROM range(0, 20000) z(k)), g5 AS (SELECT symbol, state, feature, count(*) AS n, avg(x.h) AS ho, avg(z.h) AS hm FROM g4 JOIN hm x ON x.k = own JOIN hm z ON z.k = m GROUP BY 1, 2, 3),
g6 AS (SELECT symbol, feature, state, greatest(0, hm_n.h + 1.5 - ho - g5.hm) AS mi FROM g5 JOIN hm hm_n ON hm_n.k = n), g7 AS (SELECT symbol, feature, coalesce(max(mi) FILTER (state = 'high'), 0) AS mi_high_vol, coalesce(max(mi) FILTER (state = 'low'), 0) AS mi_low_vol, coalesce(max(mi) FILTER (state = 'all'), 0) AS mi_all FROM g6 GROUP BY 1, 2)"""


@query("state_information", ["symbol", "feature", "accepted"], ["mi_high_vol", "mi_low_vol", "mi_all"], f"{_CLASSES} SELECT *, CAST(mi_high_vol > 0.01 OR mi_low_vol > 0.01 AS BIGINT) AS accepted FROM g7")
def state_information(spark, sf_dir):
    """Information of return and range with the direction of a bar, in bars of one event, of more, and in all."""
    df = q.adjusted_events(spark, sf_dir).where("log_return IS NOT NULL")
    df = df.select("symbol", "ts", (F.col("close_adj") > F.col("open_adj")).cast("int").alias("target_label"), (F.col("volume") > 1).cast("double").alias(regimes.HIGH), F.col("log_return").alias("ret"), F.log(F.col("high_adj") / F.col("low_adj")).alias("range"))
    return regimes.conditioned_information(df, ["ret", "range"])
