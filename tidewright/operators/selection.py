"""Selection of features: correlation, variance inflation, clusters, votes over blocks of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import kernels as k
from tidewright.functions.tables import spread
from tidewright.operators.audit import filled
from tidewright.operators.regimes import HIGH

#: Lagged features that are never used.
BLACKLIST = (
    "geo_lower_shadow_momentum", "geo_lower_shadow_zscaled_lag2", "regime_vol_rank_60_momentum", "regime_vol_rank_60_zscaled_lag1", "volume_zscaled_lag1", "volume_momentum", "cmf_slope_5_zscaled_lag2",
    "kinematic_squeeze_ratio_momentum", "sin_month_zscaled_lag1", "sin_month_momentum", "liq_amihud_pct_rank_zscaled_lag2", "obv_slope_5_zscaled_lag1", "wavelet_energy_ratio_momentum", "geo_upper_shadow_zscaled_lag2",
)
#: Clusters of features, by the beginnings of their names.
CLUSTERS = {
    "flow": ("cmf_slope_5", "obv_slope_5", "rvol_5"),
    "volatility": ("vol_parkinson", "hl_log_range", "kinematic_squeeze_ratio"),
    "momentum": ("ret_3", "body_direction_momentum"),
    "microstructure": ("skewness_20", "wavelet_energy_ratio", "liq_amihud_pct_rank", "geo_upper_shadow"),
}


def matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> np.ndarray:
    """Correlations of complete rows, computed on executors; one small matrix comes back."""
    rows = VectorAssembler(inputCols=columns, outputCol="v", handleInvalid="skip").transform(df.select(*columns))
    return np.nan_to_num(Correlation.corr(rows, "v", method).first()[0].toArray())


def varied(df: DataFrame, columns: list[str], least: float = 1e-8) -> list[str]:
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if (row[c] or 0.0) > least]


def screened(df: DataFrame, columns: list[str], most_corr: float = 0.8, most_vif: float = 4.0) -> list[str]:
    """Columns with variance that correlate with no earlier one and don't inflate variance."""
    columns = varied(df, columns)
    corr = matrix(df, columns)
    kept = k.correlated_kept(corr, most_corr)
    left = k.vif_kept(corr[np.ix_(kept, kept)], most_vif)
    return [columns[kept[i]] for i in left]


def clusters(df: DataFrame, columns: list[str], similar: float = 0.6) -> dict[str, int]:
    """Clusters by average linkage of sqrt(1 - |rank correlation|)."""
    rho = np.abs(matrix(df, columns, "spearman"))
    found = k.average_linkage(np.sqrt(np.maximum(1 - rho, 0)), float(np.sqrt(1 - similar)))
    return dict(zip(columns, found))


def rank_distance(rho: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.clip(0.5 * (1 - np.nan_to_num(rho)), 0, None))
    np.fill_diagonal(d, 0.0)
    return (d + d.T) / 2


def hierarchy(df: DataFrame, columns: list[str], most: int = 15) -> dict[str, tuple[int, bool]]:
    """Of each column its cluster in Ward's hierarchy of sqrt((1 - rank correlation) / 2), cut at `most` clusters, and whether it is the
    cluster's medoid. Clusters are numbered by their first column; with no more columns than clusters each is its own. Correlations
    of complete rows are taken on executors; a matrix of columns comes back."""
    if len(columns) <= most:
        return {c: (i, True) for i, c in enumerate(columns)}
    distance = rank_distance(matrix(df, columns, "spearman"))
    found = k.ward_clusters(distance, most)
    best = set(k.medoids(distance, found))
    return {c: (found[i], i in best) for i, c in enumerate(columns)}


def blocks(df: DataFrame, count: int = 8, share: float = 0.75, least: int = 40) -> DataFrame:
    """Rows by overlapping block, each a contiguous share of its symbol's rows: starts lie a whole step apart, and those that
    would begin alike are one block."""
    from tidewright.operators.cv import numbered

    n = numbered(df)
    length = F.greatest(F.floor(F.col("n_rows") * share), F.lit(least))
    last = F.greatest(F.col("n_rows") - length, F.lit(0))
    step = F.greatest(F.lit(1), F.floor(last / max(1, count - 1)))
    start = lambda i: F.least(i * step, last)
    rows = n.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    own = (F.col("block") == 0) | (start(F.col("block")) > start(F.col("block") - 1))
    return rows.where(own & (F.col("row_id") >= start(F.col("block"))) & (F.col("row_id") < start(F.col("block")) + length))


def selected_in_block(x: np.ndarray, y: np.ndarray, p: float = 0.10, least_mi: float = 0.01, least: int = 3, lags: int = 2) -> dict[int, int]:
    """Columns of x that a block votes for, with the lag at which each foretells y (0: none does): of those left by correlation
    and variance inflation the best of each cluster, if Granger's test or mutual information finds a lag; where that leaves under
    `least`, all of them."""
    some = np.flatnonzero(x.var(axis=0) > 1e-8)
    corr = np.nan_to_num(np.corrcoef(x[:, some], rowvar=False)).reshape(len(some), len(some))
    kept = k.correlated_kept(corr)
    kept = [int(some[kept[i]]) for i in k.vif_kept(corr[np.ix_(kept, kept)])] if len(kept) > 1 else [int(some[i]) for i in kept]
    kept = best_of_clusters(x, y, kept, least)
    found = {}
    for c in kept:
        chance, lag = k.granger(x[:, c], y, lags)
        if chance >= p:
            mi = [k.mutual_information(np.concatenate([np.zeros(i), x[:-i, c]]), y) for i in range(1, lags + 1)]
            lag = int(np.argmax(mi)) + 1 if max(mi) > least_mi else 0
        if lag:
            found[c] = lag
    return found if len(found) >= least else {c: found.get(c, 0) for c in kept}


def best_of_clusters(x: np.ndarray, y: np.ndarray, columns: list[int], least: int = 3, similar: float = 0.6) -> list[int]:
    """Of each cluster by rank correlation the column of most mutual information with y; all where there are few."""
    if len(columns) <= least:
        return columns
    rho = np.abs(np.nan_to_num(k.spearman(x[:, columns])))
    np.fill_diagonal(rho, 1.0)
    of = np.array(k.average_linkage(np.sqrt(np.clip(1 - rho, 0, 1)), float(np.sqrt(1 - similar))))
    mi = np.array([k.mutual_information(x[:, c], y) for c in columns])
    return [columns[g[mi[g].argmax()]] for g in (np.flatnonzero(of == c) for c in np.unique(of))]


#: Words in features' names that decide between features of as many votes.
DIRECTIONAL = ("mkt_relative", "mkt_rs", "mkt_rolling_beta", "mkt_divergence", "cmf", "obv", "vpt", "net_pressure", "vol_directional", "signed_expansion", "liq_amihud", "kurtosis_20")


def causal(x: np.ndarray, y: np.ndarray, lags: int = 5, p: float = 0.05, least_mi: float = 0.01, least: int = 3, fallback: int = 5) -> dict[int, int]:
    """Columns of x that foretell y, with the lag at which: by Granger's test, else by the mutual information of a lagged column. Where
    under `least` do, the `fallback` of largest rank correlation with y in size (ties: the earlier) are added at lag 1."""
    found = {}
    for c in range(x.shape[1]):
        chance, lag = k.granger(x[:, c], y, lags)
        if chance >= p:
            mi = [k.mutual_information(np.concatenate([np.zeros(i), x[:-i, c]]), y) for i in range(1, lags + 1)]
            lag = int(np.argmax(mi)) + 1 if max(mi) > least_mi else 0
        if lag:
            found[c] = lag
    if len(found) < least and x.shape[1]:
        rank_y = k.ranks(y[:, None].astype(float))[:, 0]
        size = np.array([abs(k.pearson(c, rank_y)) for c in k.ranks(x).T])
        for c in np.argsort(-size, kind="stable")[:fallback]:
            found.setdefault(int(c), 1)
    return found


def wide_in_block(x: np.ndarray, y: np.ndarray, most: int = 14, least: int = 6, forced: int | None = None) -> dict[int, int]:
    """Columns of x that a block votes for, with their lags (0: none): those left by correlation (0.85) and variance inflation (5), of
    them the medoids of at most `most` clusters and the forced column, of them the causal ones; all of the last but one where those
    are under `least`."""
    some = np.flatnonzero(x.var(axis=0) > 1e-8)
    corr = np.nan_to_num(np.corrcoef(x[:, some], rowvar=False)).reshape(len(some), len(some))
    kept = k.correlated_kept(corr, 0.85)
    kept = [int(some[kept[i]]) for i in k.vif_kept(corr[np.ix_(kept, kept)], 5.0)] if len(kept) > 1 else [int(some[i]) for i in kept]
    if len(kept) > most:
        distance = rank_distance(k.spearman(x[:, kept]))
        kept = [kept[i] for i in k.medoids(distance, k.ward_clusters(distance, most))]
    if forced is not None and forced not in kept:
        kept.append(forced)
    found = {kept[c]: lag for c, lag in causal(x[:, kept], y).items()}
    return found if len(found) >= least else {c: found.get(c, 0) for c in kept}


def wide_consensus(df: DataFrame, columns: list[str], label: str = "target_label", count: int = 8, threshold: float = 0.6, least: int = 6, most: int = 16) -> DataFrame:
    """symbol, place, feature, votes, lag: of each symbol the features with at least a share `threshold` of its blocks' votes, by votes and
    then those with a DIRECTIONAL word first; where they are under `least`, the first so many by votes alone; at most `most`.
    Remaining ties go by name (the reference keeps the order in which votes came). A regime's chance among the columns always
    stands for election. Lags are medians, 1 to 5."""
    forced = columns.index(HIGH) if HIGH in columns else None
    voted = votes(df, columns, label, count, lambda x, y: wide_in_block(x, y, forced=forced), 5)
    by = Window.partitionBy("symbol")
    word = F.greatest(*[F.col("feature").contains(w).cast("int") for w in DIRECTIONAL])
    v = voted.withColumns({"word": word, "enough": (F.col("votes") >= F.ceil(F.col("blocks") * threshold)).cast("int")})
    v = v.withColumn("few", F.sum("enough").over(by) < least)
    order = [F.when(F.col("few"), 0).otherwise(-F.col("enough")), F.desc("votes"), F.when(F.col("few"), 0).otherwise(-F.col("word")), F.col("feature")]
    v = v.withColumn("place", F.row_number().over(by.orderBy(*order)))
    kept = F.when(F.col("few"), F.col("place") <= least).otherwise((F.col("enough") == 1) & (F.col("place") <= most))
    return v.where(kept).select("symbol", "place", "feature", "votes", "lag")


def votes(df: DataFrame, columns: list[str], label: str = "target_label", count: int = 8, select=None, latest: int = 2) -> DataFrame:
    """symbol, feature, votes, lag, blocks: in how many of a symbol's blocks a feature is selected by select(x, y), and the median of the
    lags found, 1 to `latest` (1: none). Blocks are groups of their own and run in parallel; those of one class don't vote, but
    count."""
    select = select or selected_in_block
    rows = blocks(filled(df.where(F.col(label).isNotNull()).select("symbol", "ts", F.col(label).cast("double").alias(label), *columns), columns), count)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        x, y = pdf[columns].to_numpy(float), pdf[label].to_numpy()
        found = select(x, y) if len(np.unique(y)) > 1 else {}
        names = [columns[i] for i in found]
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "feature": pd.Series([*names, None], dtype=object), "lag": [*found.values(), 0]})

    found = spread(rows, "symbol", "block").groupBy("symbol", "block").applyInPandas(one, "symbol string, feature string, lag int")
    of_all = found.where("feature is null").groupBy("symbol").agg(F.count("*").alias("blocks"))
    median = F.least(F.greatest(F.coalesce(F.floor(F.percentile(F.when(F.col("lag") > 0, F.col("lag")), F.lit(0.5))), F.lit(1)), F.lit(1)), F.lit(latest)).cast("int")
    voted = found.where("feature is not null").groupBy("symbol", "feature").agg(F.count("*").alias("votes"), median.alias("lag"))
    return voted.join(of_all, "symbol")


def candidates(voted: DataFrame, threshold: float = 0.6, fallback: int = 3) -> DataFrame:
    """Of votes() the features with at least a share `threshold` of the blocks, rounded up; where those are under `fallback`, the
    first so many by votes, then by name."""
    enough = (F.col("votes") >= F.ceil(F.col("blocks") * threshold)).cast("int")
    by = Window.partitionBy("symbol")
    placed = voted.withColumn("place", F.row_number().over(by.orderBy(F.desc("votes"), "feature"))).withColumn("enough", enough)
    placed = placed.withColumn("many", F.sum("enough").over(by))
    return placed.where(F.when(F.col("many") >= fallback, F.col("enough") == 1).otherwise(F.col("place") <= fallback)).drop("enough", "many")


def consensus(df: DataFrame, columns: list[str], label: str = "target_label", count: int = 8, threshold: float = 0.6, most: int = 5) -> DataFrame:
    """symbol, place, feature, votes, lag: the candidates of each symbol clustered once more over all its rows, the best of each
    cluster kept, at most `most` by votes."""
    voted = candidates(votes(df, columns, label, count), threshold)
    rows = filled(df.where(F.col(label).isNotNull()).select("symbol", "ts", F.col(label).cast("double").alias(label), *columns), columns)

    def final(pdf: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
        named = named.sort_values("place")
        at = {f: i for i, f in enumerate(named["feature"])}
        kept = best_of_clusters(pdf.sort_values("ts", kind="stable")[list(at)].to_numpy(float), pdf.sort_values("ts", kind="stable")[label].to_numpy(), list(at.values())) if len(pdf) else []
        out = named.iloc[sorted(kept)].head(most)
        return out.assign(place=range(1, len(out) + 1))[["symbol", "place", "feature", "votes", "lag"]]

    return spread(rows, "symbol").groupBy("symbol").cogroup(voted.groupBy("symbol")).applyInPandas(final, "symbol string, place int, feature string, votes long, lag int")


def inflation(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation of each column by the others, over complete rows: the diagonal of the inverse of their correlations."""
    return dict(zip(columns, np.diag(np.linalg.pinv(matrix(df, columns), hermitian=True)).tolist()))


def diversify(df: DataFrame, by: str = "symbol", most: int = 4) -> DataFrame:
    """by, place, feature: of each group's candidates (by, place, feature), in their order, those that aren't blacklisted (all, where
    none is left), the first of each cluster, then others up to `most`."""
    group = Window.partitionBy(by)
    fine = ~F.col("feature").isin(*BLACKLIST)
    rows = df.select(by, "place", "feature", fine.alias("__fine")).withColumn("__any", F.max("__fine").over(group)).where(F.col("__fine") | ~F.col("__any"))
    cluster = F.coalesce(*[F.when(F.col("feature").rlike(f"^({'|'.join(heads)})"), name) for name, heads in CLUSTERS.items()])
    rows = rows.withColumn("__c", cluster).withColumn("__n", F.row_number().over(Window.partitionBy(by, "__c").orderBy("place")))
    later = F.when(F.col("__c").isNotNull() & (F.col("__n") == 1), 0).otherwise(1)
    return rows.withColumn("__at", F.row_number().over(group.orderBy(later, "place"))).where(F.col("__at") <= most).select(by, F.col("__at").cast("long").alias("place"), "feature")


def diversified(features: list[str], most: int = 4) -> list[str]:
    """In the order of the candidates, the first feature of each cluster, then others in order up to `most`."""
    picked, told = [], set()
    for f in features:
        cluster = next((c for c, heads in CLUSTERS.items() if c not in told and f.startswith(heads)), None)
        if cluster and len(picked) < most:
            picked.append(f)
            told.add(cluster)
    return (picked + [f for f in features if f not in picked])[:most]


def allowed(features: list[str]) -> list[str]:
    """Features that aren't blacklisted; all where none is left."""
    return [f for f in features if f not in BLACKLIST] or features
