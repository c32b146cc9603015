"""Tests that are regressions on lags, from sums: no task holds a series, and symbols, orders and features are rows that run at once.

A regression needs its columns' second moments only. For a few lags these are aggregates of lag columns. For the unit-root test, whose
lags grow with the series, sums over shifted samples differ by a few terms at both ends, so one sum a lag and the ends give all
samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import kernels as k
from tidewright.functions.tables import written


def covariances(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, n, cov: over rows with all columns known their count, and population covariances as rows of the upper triangle."""
    known = df.dropna(subset=columns)
    pairs = [F.covar_pop(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*pairs).alias("cov"))


def _square(flat, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = flat
    return out + np.triu(out, 1).T


def _left(s: np.ndarray, columns: list[int]) -> float:
    """Variance of column 0 that the others leave."""
    c = s[columns, 0]
    return float(max(s[0, 0] - c @ np.linalg.pinv(s[np.ix_(columns, columns)], hermitian=True, rcond=1e-12) @ c, 0.0))


def arch_lm(df: DataFrame, x: str = "log_return", lags: int = 5) -> DataFrame:
    """symbol, n, stat, p of the Lagrange-multiplier test of squared values on their lags."""
    w = Window.partitionBy("symbol").orderBy("ts")
    s = df.where(F.col(x).isNotNull()).select("symbol", "ts", (F.col(x) * F.col(x)).alias("s"))
    s = s.withColumns({f"l{i}": F.lag("s", i).over(w) for i in range(1, lags + 1)})
    kind = df.schema["symbol"].dataType.simpleString()

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                m = _square(r["cov"], lags + 1)
                stat = r["n"] * (1 - _left(m, list(range(1, lags + 1))) / max(m[0, 0], 1e-300))
                rows.append((r["symbol"], r["n"], stat, k.chi2_sf(stat, lags)))
            yield pd.DataFrame(rows, columns=["symbol", "n", "stat", "p"])

    return covariances(s, ["symbol"], ["s", *[f"l{i}" for i in range(1, lags + 1)]]).mapInPandas(solve, f"symbol {kind}, n long, stat double, p double")


def granger(df: DataFrame, columns: list[str], y: str, lags: int = 2) -> DataFrame:
    """symbol, feature, lag, n, f_stat, p: whether each feature's last 1 .. `lags` values help its symbol's y beyond y's own. Rows
    without feature or y are left out before lags are taken; samples too short for a lag give none."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    rows = df.select("symbol", "ts", F.col(y).cast("double").alias("y"), named.alias("c")).select("symbol", "ts", "y", "c.*").dropna(subset=["x", "y"])
    w = Window.partitionBy("symbol", "feature").orderBy("ts")
    rows = rows.withColumns({f"{c}{i}": F.lag(c, i).over(w) for i in range(1, lags + 1) for c in ("y", "x")})
    kind = df.schema["symbol"].dataType.simpleString()
    found = None
    for lag in range(1, lags + 1):
        own, other = [f"y{i}" for i in range(1, lag + 1)], [f"x{i}" for i in range(1, lag + 1)]

        def solve(batches, lag=lag):
            for pdf in batches:
                out = []
                for r in pdf.to_dict("records"):
                    m, left = _square(r["cov"], 2 * lag + 1), r["n"] - 2 * lag - 1
                    if left > 0:
                        s0, s1 = (r["n"] * _left(m, list(range(1, 1 + lag * q))) for q in (1, 2))
                        f = (s0 - s1) / lag / max(s1 / left, 1e-300)
                        out.append((r["symbol"], r["feature"], lag, r["n"], f, k.f_sf(f, lag, left)))
                yield pd.DataFrame(out, columns=["symbol", "feature", "lag", "n", "f_stat", "p"])

        one = covariances(rows, ["symbol", "feature"], ["y", *own, *other]).mapInPandas(solve, f"symbol {kind}, feature string, lag int, n long, f_stat double, p double")
        found = one if found is None else found.unionByName(one)
    return found


def _differences(df: DataFrame, x: str, orders: list[float], size: int) -> DataFrame:
    """symbol, d, ts, z: x, and for orders above 0 its fractional differences, from the values before each."""
    known = df.where(F.col(x).isNotNull()).select("symbol", "ts", F.col(x).cast("double").alias("x"))
    sizes = known.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    before = F.reverse(F.collect_list("x").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-size, -1)))
    rows = known.withColumn("b", before).join(sizes, "symbol")
    ways = F.array(*[F.struct(F.lit(float(d)).alias("d"), F.array(*[F.lit(float(v)) for v in k.difference_weights(d, size)] if d else [F.lit(1.0)]).alias("w")) for d in orders])
    rows = rows.withColumn("way", F.explode(ways)).select("symbol", "ts", "x", "b", F.col("way.d").alias("d"), F.slice("way.w", F.lit(1), F.least(F.size("way.w"), F.floor(F.col("n") / 2).cast("int"))).alias("w"))
    weighed = F.aggregate(F.zip_with(F.slice("b", F.lit(1), F.size("w")), "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    z = F.when(F.col("d") == 0, F.col("x")).when(F.size("b") >= F.size("w"), weighed)
    return rows.select("symbol", "d", "ts", z.alias("z")).where(F.col("z").isNotNull())


def most_lags(n: int) -> int:
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 3))


def unit_roots(df: DataFrame, x: str = "close_adj", orders: list[float] = (0.0,), size: int = 100) -> DataFrame:
    """symbol, d, n, lags, stat, p of the augmented Dickey-Fuller test with a constant of each symbol's x at each order of difference, lags
    by Akaike's criterion. Series under eight values give none."""
    w = Window.partitionBy("symbol", "d")
    z = _differences(df, x, list(orders), size).withColumn("z", F.col("z") - F.avg("z").over(w))
    z = written(z.withColumn("i", F.row_number().over(w.orderBy("ts")) - 1).withColumn("n", F.count(F.lit(1)).over(w)).where("n >= 8"))
    longest = z.agg(F.max("n")).first()[0]
    top = most_lags(longest) if longest else 0
    d = F.lead("z").over(w.orderBy("ts")) - F.col("z")
    rows = z.withColumn("e", d).withColumn("past", F.collect_list("e").over(w.orderBy("ts").rowsBetween(-top, 0)))
    at = lambda h: F.try_element_at("past", F.col("has") - h)
    rows = rows.where("e IS NOT NULL").withColumn("has", F.size("past"))
    shifted = lambda c, h: F.coalesce(F.sum(F.when(F.col("has") > h, F.col(c) * at(h))), F.lit(0.0))
    edge = F.when((F.col("i") <= top + 1) | (F.col("i") >= F.col("n") - top - 3), F.struct("i", "z"))
    sums = rows.groupBy("symbol", "d").agg(F.max("n").alias("n"), F.array(*[shifted("e", h) for h in range(top + 1)]).alias("ee"), F.array(*[shifted("z", h) for h in range(top + 1)]).alias("ze"), F.sum("z").alias("sz"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    ends = z.groupBy("symbol", "d").agg(F.array_sort(F.collect_list(edge)).alias("ends"))
    kind = df.schema["symbol"].dataType.simpleString()

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                lags, stat = _unit_root(r["n"], np.asarray(r["ee"]), np.asarray(r["ze"]), r["sz"], r["zz"], {e["i"]: e["z"] for e in r["ends"]})
                rows.append((r["symbol"], r["d"], r["n"], lags, stat, k.adf_p(stat)))
            yield pd.DataFrame(rows, columns=["symbol", "d", "n", "lags", "stat", "p"])

    return sums.join(ends, ["symbol", "d"]).mapInPandas(solve, f"symbol {kind}, d double, n long, lags int, stat double, p double")


def _unit_root(n: int, ee: np.ndarray, ze: np.ndarray, sz: float, zz: float, z: dict[int, float]) -> tuple[int, float]:
    """Lags and statistic from sums over a series z of n values and its n - 1 steps e: ee[h] of e_j e_(j-h), ze[h] of z_j e_(j-h), and
    of z and its squares over all j with a step; z has the values at both ends."""
    last = n - 1
    e = {j: z[j + 1] - z[j] for j in z if j + 1 in z}

    def gram(skip: int, lags: int) -> np.ndarray:
        """Of 1, e_j, z_j, e_(j-1) ... over the steps from `skip`."""
        names = range(lags + 1)
        g = np.empty((lags + 3, lags + 3))
        place = lambda a: 1 if a == 0 else a + 2
        for a in names:
            g[0, place(a)] = z[last - a] - z[skip - a]
            g[2, place(a)] = ze[a] - sum(z[j] * e[j - a] for j in range(a, skip))
            for b in range(a, lags + 1):
                h = b - a
                v = ee[h] - sum(e[i] * e[i - h] for i in range(h, skip - a)) - sum(e[i] * e[i - h] for i in range(last - a, last))
                g[place(a), place(b)] = v
        g[0, 0], g[0, 2], g[2, 2] = last - skip, sz - sum(z[j] for j in range(skip)), zz - sum(z[j] ** 2 for j in range(skip))
        i, j = np.tril_indices(len(g), -1)
        g[1, 2] = g[2, 1]
        upper = np.triu(g)
        upper[0, 1:], upper[2, 3:] = g[0, 1:], g[2, 3:]
        out = upper + np.triu(upper, 1).T
        return out

    def fit(g: np.ndarray, lags: int) -> tuple[float, float]:
        on = [0, 2, *range(3, lags + 3)]
        inner = g[np.ix_(on, on)]
        scale = np.sqrt(np.maximum(np.diag(inner), 1e-300))
        inverse = np.linalg.pinv(inner / np.outer(scale, scale), hermitian=True, rcond=1e-13) / np.outer(scale, scale)
        beta = inverse @ g[on, 1]
        ssr = max(float(g[1, 1] - beta @ g[on, 1]), 1e-300)
        count = g[0, 0]
        se = math.sqrt(max(ssr / max(1, count - len(on)) * inverse[1, 1], 1e-300))
        return count * math.log(ssr / count) + 2 * len(on), float(beta[1] / se)

    top = most_lags(n)
    whole = gram(top, top)
    best = min(range(top + 1), key=lambda lags: fit(whole, lags)[0])
    return best, fit(gram(best, best), best)[1]


def optimal_orders(df: DataFrame, x: str = "close_adj", step: float = 0.05, size: int = 100) -> DataFrame:
    """symbol, optimal_d, adf_p: the least order of difference, in steps, that is stationary at 5 %, all orders at once; 1 where none is
    or there are under 50 values."""
    grid = [i * step for i in range(int(round(1 / step)) + 1)]
    tested = written(unit_roots(df.where(F.col(x).isNotNull()), x, grid, size))
    hit = F.min(F.when(F.col("p") < 0.05, F.struct("d", "p")))
    out = tested.groupBy("symbol").agg(hit.alias("hit"), F.max_by("p", "d").alias("last"), F.max("n").alias("n"))
    return out.select("symbol", F.when(F.col("n") >= 50, F.coalesce("hit.d", F.lit(1.0))).otherwise(1.0).alias("optimal_d"), F.when(F.col("n") >= 50, F.coalesce("hit.p", "last")).otherwise(1.0).alias("adf_p"))


def fluctuation(df: DataFrame, x: str = "log_return") -> DataFrame:
    """symbol, n, hurst: the exponent of detrended fluctuation of x; 0.5 for under 40 values. Scales are rows, segments are groups, and a
    segment's line is its covariance with time."""
    w = Window.partitionBy("symbol").orderBy("ts")
    known = df.where(F.col(x).isNotNull()).select("symbol", "ts", F.col(x).cast("double").alias("x"))
    sizes = known.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"))
    kind = df.schema["symbol"].dataType.simpleString()

    def scales(batches):
        for pdf in batches:
            yield pdf.assign(scales=[k.fluctuation_scales(n).tolist() if n >= 40 else [] for n in pdf["n"]])

    named = written(sizes.mapInPandas(scales, f"symbol {kind}, n long, m double, scales array<int>"))
    walk = known.join(named, "symbol").withColumn("walk", F.sum(F.col("x") - F.col("m")).over(w)).withColumn("i", F.row_number().over(w) - 1)
    parts = walk.select("symbol", "n", "i", "walk", F.explode("scales").alias("scale")).withColumn("part", F.floor(F.col("i") / F.col("scale"))).where(F.col("part") < F.floor(F.col("n") / F.col("scale")))
    left = parts.groupBy("symbol", "scale", "part").agg(F.var_pop("walk").alias("v"), F.covar_pop("i", "walk").alias("c"), F.var_pop("i").alias("t"))
    at = left.groupBy("symbol", "scale").agg(F.avg(F.sqrt(F.greatest(F.col("v") - F.col("c") * F.col("c") / F.col("t"), F.lit(0.0)))).alias("f")).where("f > 0")
    lines = at.groupBy("symbol").agg(F.count(F.lit(1)).alias("points"), F.regr_slope(F.log("f"), F.log("scale")).alias("slope"))
    return named.join(lines, "symbol", "left").select("symbol", "n", F.when(F.col("points") > 1, F.col("slope")).otherwise(0.5).alias("hurst"))


def stationarity(df: DataFrame, x: str = "close_adj") -> DataFrame:
    """symbol, n, lags, stat, p (0.01 to 0.1) of the test of level stationarity; lags by the data, from sums of products of values a few
    places apart, then as many such sums as they say. Symbols without variance have none."""
    w = Window.partitionBy("symbol").orderBy("ts")
    whole = Window.partitionBy("symbol")
    e = df.where(F.col(x).isNotNull()).select("symbol", "ts", (F.col(x).cast("double") - F.avg(F.col(x).cast("double")).over(whole)).alias("e"))
    e = written(e.withColumns({"walk": F.sum("e").over(w), "n": F.count(F.lit(1)).over(whole)}))
    longest = e.agg(F.max("n")).first()[0] or 0

    def products(most: int) -> DataFrame:
        past = F.collect_list("e").over(w.rowsBetween(-most, 0))
        rows = e.withColumn("past", past).withColumn("has", F.size("past"))
        return rows.groupBy("symbol").agg(F.max("n").alias("n"), (F.sum(F.col("walk") * F.col("walk"))).alias("walks"), F.array(*[F.coalesce(F.sum(F.when(F.col("has") > h, F.col("e") * F.try_element_at("past", F.col("has") - h))), F.lit(0.0)) for h in range(most + 1)]).alias("c"))

    n = F.col("n").cast("double")
    cover = F.floor(F.pow(n, F.lit(2 / 9))).cast("int")
    few = products(int(longest ** (2 / 9)) if longest else 0)
    lag = F.sequence(F.lit(1), F.greatest(cover, F.lit(1)))
    total = lambda f: F.aggregate(lag, F.lit(0.0), lambda s, k: s + F.when(k <= cover, f(k)).otherwise(0.0))
    c = lambda k: F.coalesce(F.try_element_at("c", k + 1), F.lit(0.0))
    s0, s1 = F.element_at("c", 1) / n + total(lambda k: 2 * c(k) / n), total(lambda k: 2 * k * c(k) / n)
    gamma = F.coalesce(1.1447 * F.pow(F.pow(F.try_divide(s1, s0), F.lit(2.0)), F.lit(1 / 3)), F.lit(0.0))
    chosen = written(few.select("symbol", F.least(F.floor(gamma * F.pow(n, F.lit(1 / 3))), F.col("n") - 1).cast("int").alias("lags")))
    many = products(chosen.agg(F.max("lags")).first()[0] or 0).join(chosen, "symbol")
    weighed = F.aggregate(F.sequence(F.lit(1), F.greatest("lags", F.lit(1))), F.lit(0.0), lambda s, k: s + F.when(k <= F.col("lags"), (1 - k / (F.col("lags") + 1)) * c(k)).otherwise(0.0))
    out = many.withColumn("stat", F.try_divide(F.col("walks") / (n * n), F.element_at("c", 1) / n + 2 / n * weighed)).where("stat IS NOT NULL")
    p = F.lit(k.KPSS[0][1])
    for (lo, hi_p), (hi, lo_p) in zip(k.KPSS, k.KPSS[1:]):
        p = F.when(F.col("stat") > lo, hi_p + (F.least("stat", F.lit(hi)) - lo) / (hi - lo) * (lo_p - hi_p)).otherwise(p)
    return out.select("symbol", "n", "lags", "stat", p.alias("p"))


def variance_ratios(df: DataFrame, x: str = "close_adj", steps: tuple[int, ...] = (3, 20)) -> DataFrame:
    """symbol, steps, n, ratio, z: variance of changes of the logarithm over `steps` bars to that over one, and its statistic that allows
    for changing variance. Symbols of under steps + 2 changes have none."""
    w = Window.partitionBy("symbol").orderBy("ts")
    p = df.where(F.col(x).isNotNull()).select("symbol", "ts", F.log(F.col(x)).alias("p"))
    p = p.withColumn("r", F.col("p") - F.lag("p").over(w))
    facts = p.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("m"))
    e = p.join(facts, "symbol").withColumn("q", F.pow(F.col("r") - F.col("m"), F.lit(2.0)))
    found = None
    for k_ in steps:
        far = F.col("p") - F.lag("p", k_).over(w) - k_ * F.col("m")
        rows = e.withColumn("far", far).withColumns({f"q{j}": F.col("q") * F.lag("q", j).over(w) for j in range(1, k_)})
        g = rows.groupBy("symbol").agg(F.max("n").cast("double").alias("n"), F.sum("q").alias("s"), F.sum(F.col("far") * F.col("far")).alias("f"), *[F.sum(f"q{j}").alias(f"q{j}") for j in range(1, k_)]).where(F.col("n") >= k_ + 2)
        n = F.col("n")
        ratio = F.try_divide(F.col("f") / (k_ * (n - k_ + 1) * (1 - k_ / n)), F.col("s") / (n - 1))
        theta = sum(((2 * (k_ - j) / k_) ** 2 * F.col(f"q{j}") for j in range(1, k_)), F.lit(0.0))
        one = g.select("symbol", F.lit(k_).alias("steps"), n.cast("long").alias("n"), ratio.alias("ratio"), F.try_divide((ratio - 1) * F.col("s"), F.sqrt(theta)).alias("z"))
        found = one if found is None else found.unionByName(one)
    return found
