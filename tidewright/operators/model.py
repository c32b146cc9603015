"""Per-fold models: imputation, interactions, scaling, ridge logistic regression, bounded calibration."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import kernels as k
from tidewright.functions.tables import spread, written
from tidewright.operators.order import quantiles


def interactions(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """df with the product of each two columns, and all names."""
    pairs = {f"{a}__x__{b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)}
    return df.withColumns(pairs), [*columns, *pairs]


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values at the column's exact median; a column without values stays missing."""
    medians = quantiles(df, columns, [0.5])
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(medians[c][0]).cast("double")) for c in columns})


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation (1 if that is 0)."""
    s = df.agg(*[F.avg(c).alias(f"__a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(s))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"__a_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in columns}).drop(*[f"__{x}_{c}" for x in "as" for c in columns])


def balanced_logistic(df: DataFrame, columns: list[str], label: str, c: float = 0.03):
    """A fitted pyspark.ml model on any number of rows, with classes weighed alike."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(n.values())
    weighted = df.withColumn("__w", F.when(F.col(label) == 1, total / (2 * n.get(1, 1))).otherwise(total / (2 * n.get(0, 1))))
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(weighted)
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol="__w", regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(rows)


class Calibrated:
    """Imputer, interactions, scaler, logistic model on the first 70 % of rows, calibration on the rest; method "none" fits all
    rows and doesn't calibrate, and so do rows of which either part has one class. Calibration needs over LEAST rows to fit."""

    LEAST = 50

    def __init__(self, c: float = 0.03, split: float = 0.7, pairs: bool = True, method: str = "bounded") -> None:
        self.c, self.split, self.pairs, self.method, self.a, self.b = c, split, pairs, method, 1.0, 0.0

    def _wide(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), self.median, x)
        return np.column_stack([x, *(x[:, i] * x[:, j] for i, j in combinations(range(x.shape[1]), 2))]) if self.pairs else x

    def fit(self, x: np.ndarray, y: np.ndarray) -> Calibrated:
        self.median = np.nan_to_num(np.nanmedian(x, axis=0)) if len(x) else np.zeros(x.shape[1])
        wide = self._wide(x)
        self.mean, sd = wide.mean(axis=0), wide.std(axis=0)
        self.sd = np.where(sd > 0, sd, 1.0)
        wide = (wide - self.mean) / self.sd
        cut = int(len(y) * self.split)
        if self.method == "none" or len(np.unique(y[:cut])) < 2 or len(np.unique(y[cut:])) < 2:
            self.beta = k.logistic(wide, y, self.c)
        elif cut <= self.LEAST:
            raise ValueError(f"calibration needs over {self.LEAST} rows to fit, not {cut}")
        else:
            self.beta = k.logistic(wide[:cut], y[:cut], self.c)
            self.a, self.b = k.bounded_platt(wide[cut:] @ self.beta[:-1] + self.beta[-1], y[cut:])
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((self._wide(x) - self.mean) / self.sd) @ self.beta[:-1] + self.beta[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.score(x) + self.b, -35, 35)))


FITTED = "columns array<string>, pairs boolean, median array<double>, mean array<double>, sd array<double>, beta array<double>, slope double, offset double, rows long"


class _FoldParams(Params):
    """What a model of each group of rows takes."""

    groups = Param(Params._dummy(), "groups", "columns whose every combination has a model of its own", TypeConverters.toListString)
    features = Param(Params._dummy(), "features", "columns to score by", TypeConverters.toListString)
    label = Param(Params._dummy(), "label", "column of 0 and 1; rows without it aren't fitted", TypeConverters.toString)
    order = Param(Params._dummy(), "order", "column that orders a group's rows", TypeConverters.toString)
    penalty = Param(Params._dummy(), "penalty", "inverse strength of the ridge", TypeConverters.toFloat)
    pairs = Param(Params._dummy(), "pairs", "whether products of two features are features too", TypeConverters.toBoolean)
    method = Param(Params._dummy(), "method", "bounded or none: how scores are calibrated", TypeConverters.toString)


class FoldLogistic(Estimator, _FoldParams, DefaultParamsReadable, DefaultParamsWritable):
    """Imputer, products, scaler, balanced ridge logistic model and calibration of every group, each a row of parameters. A group
    is fitted in one task, all in parallel; those with one class, or too few rows to calibrate, have no model."""

    @keyword_only
    def __init__(self, *, features=None, groups=("symbol", "fold"), label="target_label", order="ts", penalty=0.03, pairs=True, method="bounded"):
        super().__init__()
        self._setDefault(groups=["symbol", "fold"], label="target_label", order="ts", penalty=0.03, pairs=True, method="bounded")
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FoldLogisticModel:
        groups, columns, label, order = (self.getOrDefault(p) for p in (self.groups, self.features, self.label, self.order))
        c, pairs, method = (self.getOrDefault(p) for p in (self.penalty, self.pairs, self.method))
        named = dataset.where(F.col(label).isNotNull()).select(*groups, order, F.col(label).cast("double").alias(label), *[F.col(x).cast("double").alias(x) for x in columns])

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order)
            y, net = pdf[label].to_numpy(float), Calibrated(c, pairs=pairs, method=method)
            if not enough(len(y), net) or len(np.unique(y)) < 2:
                return pd.DataFrame(columns=[*groups, *FIELDS])
            net.fit(pdf[columns].to_numpy(float), y)
            facts = {"columns": list(columns), "pairs": pairs, "median": net.median.tolist(), "mean": net.mean.tolist(), "sd": net.sd.tolist(), "beta": net.beta.tolist(), "slope": net.a, "offset": net.b, "rows": len(y)}
            return pdf[groups].head(1).assign(**{k: [v] for k, v in facts.items()})[[*groups, *FIELDS]]

        kinds = ", ".join(f"`{g}` {dataset.schema[g].dataType.simpleString()}" for g in groups)
        return self._copyValues(FoldLogisticModel(written(spread(named, *groups).groupBy(*groups).applyInPandas(one, f"{kinds}, {FITTED}"))))


FIELDS = [f.split()[0] for f in FITTED.split(", ")]


class FoldLogisticModel(Model, _FoldParams, MLWritable, MLReadable):
    """A table of a row a group. Bars are scored by a join with it and an expression of columns, without Python."""

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self.table = table

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """dataset with score and prob_up, slope and offset; rows of groups without a model have null, 0.5, 1 and 0."""
        groups, columns = self.getOrDefault(self.groups), self.getOrDefault(self.features)
        joined = dataset.join(self.table.withColumn("__fitted", F.lit(True)), groups, "left")
        x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.element_at("median", i)) for i, c in enumerate(columns, 1)]
        if self.getOrDefault(self.pairs):
            x += [a * b for a, b in combinations(x, 2)]
        score = sum(((v - F.element_at("mean", i)) / F.element_at("sd", i) * F.element_at("beta", i) for i, v in enumerate(x, 1)), F.element_at("beta", -1))
        joined = joined.withColumn("score", score).withColumns({"slope": F.coalesce("slope", F.lit(1.0)), "offset": F.coalesce("offset", F.lit(0.0))})
        clipped = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.col("slope") * F.col("score") + F.col("offset")))
        chance = F.when(F.col("__fitted"), 1 / (1 + F.exp(-clipped))).otherwise(0.5)
        return joined.select(*dataset.columns, "score", chance.alias("prob_up"), "slope", "offset")

    def write(self) -> MLWriter:
        return TableWriter(self, {"parameters": self.table})

    @classmethod
    def read(cls) -> MLReader:
        return TableReader(cls, ["parameters"])


class TableWriter(MLWriter):
    """Parameters as Spark's own writers keep them, and each table as Parquet beside them."""

    def __init__(self, instance, tables: dict[str, DataFrame]):
        super().__init__()
        self.instance, self.tables = instance, tables

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"tables": list(self.tables)})
        for name, table in self.tables.items():
            table.write.parquet(f"{path}/{name}")


class TableReader(MLReader):
    def __init__(self, kind, tables: list[str]):
        super().__init__()
        self.kind, self.tables = kind, tables

    def load(self, path: str):
        """A table that the model was written without is none."""
        facts = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        known = set(facts["tables"])
        out = self.kind(*[self.sparkSession.read.parquet(f"{path}/{name}") if name in known else None for name in self.tables])
        out._resetUid(facts["uid"])
        DefaultParamsReader.getAndSetParams(out, facts)
        return out


def out_of_sample(df: DataFrame, columns: list[str], label: str = "target_label", c: float = 0.03, pairs: bool = True, method: str = "bounded") -> DataFrame:
    """Probabilities of purged() folds' rows: each (symbol, fold), of at most max_train and its test rows, has a model of its own. Training
    rows come with theirs too, which thresholds of the first test rows need. Folds with too few training rows to calibrate have no
    model: 0.5."""
    named = df.select("symbol", F.col("fold").cast("int").alias("fold"), "ts", "role", F.col(label).cast("int").alias("y"), F.col("target_barrier_return").alias("barrier_return"), "barrier_touch_time", *columns)
    fitted = FoldLogistic(features=list(columns), label="y", penalty=c, pairs=pairs, method=method).fit(named.where("role = 'train'"))
    return fitted.transform(named).select("symbol", "fold", "ts", "role", "prob_up", "y", "barrier_return", "barrier_touch_time", "slope", "offset")


def enough(rows: int, net: Calibrated) -> bool:
    return rows >= 20 if net.method == "none" else int(rows * net.split) > net.LEAST


def auc(p: np.ndarray, y: np.ndarray) -> float:
    order = pd.Series(p).rank().to_numpy()
    pos = (y == 1).sum()
    return float((order[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


def interaction_gain(df: DataFrame, columns: list[str], label: str = "target_label", c: float = 0.05) -> DataFrame:
    """symbol, fold, base_auc, pairs_auc, delta_auc on test rows: a calibrated model, and an uncalibrated one of all products of
    two columns at the weaker penalty. Folds with one class, or too few training rows, are left out."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").dropna(subset=[label])
        x, y, train = pdf[columns].to_numpy(float), pdf[label].to_numpy(float), (pdf["role"] == "train").to_numpy()
        base = Calibrated()
        if not enough(int(train.sum()), base) or len(np.unique(y[train])) < 2 or len(np.unique(y[~train])) < 2:
            return pd.DataFrame({"symbol": pd.Series([], dtype=object), "fold": pd.Series([], dtype="int32"), "base_auc": pd.Series([], dtype=float), "pairs_auc": pd.Series([], dtype=float)})
        pairs = Calibrated(c, method="none").fit(x[train], y[train])
        base.fit(x[train], y[train])
        return pd.DataFrame([{"symbol": pdf["symbol"].iloc[0], "fold": int(pdf["fold"].iloc[0]), "base_auc": auc(base.probability(x[~train]), y[~train]), "pairs_auc": auc(pairs.probability(x[~train]), y[~train])}])

    named = spread(df.select("symbol", F.col("fold").cast("int").alias("fold"), "ts", "role", label, *columns), "symbol", "fold")
    found = named.groupBy("symbol", "fold").applyInPandas(one, "symbol string, fold int, base_auc double, pairs_auc double")
    return found.withColumn("delta_auc", F.col("pairs_auc") - F.col("base_auc"))


def importance(df: DataFrame, columns: list[str], label: str = "target_label") -> DataFrame:
    """feature, mean, std, n of the loss of test AUC over folds when the feature's test values are shuffled."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").dropna(subset=[label])
        x, y, train = pdf[columns].to_numpy(float), pdf[label].to_numpy(float), (pdf["role"] == "train").to_numpy()
        if not enough(int(train.sum()), Calibrated()) or len(np.unique(y[train])) < 2 or len(np.unique(y[~train])) < 2:
            return pd.DataFrame({"feature": pd.Series([], dtype=object), "loss": pd.Series([], dtype=float)})
        net, rng = Calibrated().fit(x[train], y[train]), np.random.default_rng(42)
        base, out = auc(net.probability(x[~train]), y[~train]), []
        for i in range(len(columns)):
            moved = x[~train].copy()
            moved[:, i] = rng.permutation(moved[:, i])
            out.append(base - auc(net.probability(moved), y[~train]))
        return pd.DataFrame({"feature": columns, "loss": out})

    losses = spread(df.select("symbol", "fold", "ts", "role", label, *columns), "symbol", "fold").groupBy("symbol", "fold").applyInPandas(one, "feature string, loss double")
    return losses.groupBy("feature").agg(F.avg("loss").alias("mean_loss"), F.stddev_samp("loss").alias("std_loss"), F.count("*").alias("n")).orderBy(F.desc("mean_loss"))
