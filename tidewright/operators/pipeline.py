"""The fitted feature pipeline: audit, routed features one bar late, payload, conditional difference, selection, lagged features."""

from __future__ import annotations

from typing import NamedTuple

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, MLReadable, MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.tables import written
from tidewright.operators import audit, diagnostics, features, regimes, selection
from tidewright.operators.model import TableReader, TableWriter
from tidewright.operators.topology import book

FRACTION, LABEL = "frac_diff_d", "__label"


def stateless(bars: DataFrame, topology: bool = True) -> tuple[DataFrame, list[str]]:
    """Audited bars with order-book columns and all routed features, one bar late; and the features' names. Columns that look
    ahead go first."""
    clean = audit.returns(audit.adjusted(audit.repaired(audit.without_future(bars))))
    return features.route(book(clean) if topology else clean)


class FeatureModel(NamedTuple):
    """What fit() found, as tables of a row a symbol: payload (see diagnostics.scan), selected(symbol, features, lags), and the chains of
    hidden regimes (see regimes.fit), where these were asked for."""

    payload: DataFrame
    selected: DataFrame
    chains: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in self._asdict().items() if v is not None}

    def write(self, path: str) -> None:
        """The tables as Parquet below path; those of an earlier model there go."""
        for name, table in self._asdict().items():
            (self.payload.limit(0) if table is None else table).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark, path: str) -> FeatureModel:
        chains = spark.read.parquet(f"{path}/chains")
        return FeatureModel(spark.read.parquet(f"{path}/payload"), spark.read.parquet(f"{path}/selected"), chains if "stay" in chains.columns else None)

    def transform(self, bars: DataFrame) -> DataFrame:
        """symbol, ts, place, feature, value: each symbol's selected features in their order, of every bar; null where a bar has
        none. A schema of names comes from the model's table, which has a row a symbol."""
        df = stateful(stateless(bars)[0], self.payload, self.chains)
        used = {r["base"]: None for r in self.selected.select(F.explode(F.map_keys("lags")).alias("base")).distinct().collect()}
        used = [c for c in used if c in df.columns]
        values = F.array().cast("array<struct<name:string,value:double>>")
        for k in (1, 2):
            df = features.lagged(df, {c: k for c in used})
            named = [f"{c}_{kind}" for c in used for kind in (f"zscaled_lag{k}", "momentum")]
            shown = [F.struct(F.lit(n if n.endswith(f"lag{k}") else f"{n}@{k}").alias("name"), F.col(n).cast("double").alias("value")) for n in named]
            raw = [F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in used if c == regimes.HIGH and k == 1]
            df = df.withColumn("__values", F.concat(F.col("__values") if k > 1 else values, F.array(*raw, *shown) if shown else values)).drop(*named)
        rows = df.select("symbol", "ts", "__values").join(self.selected, "symbol").select("symbol", "ts", "__values", "lags", F.posexplode("features").alias("place", "feature"))
        base = F.regexp_replace("feature", "_momentum$", "")
        key = F.when(F.col("feature").endswith("_momentum"), F.concat("feature", F.lit("@"), F.try_element_at("lags", base).cast("string"))).otherwise(F.col("feature"))
        return rows.withColumn("__key", key).select("symbol", "ts", (F.col("place") + 1).alias("place"), "feature", F.expr("try_element_at(filter(__values, v -> v.name = __key), 1).value").alias("value"))


def stateful(df: DataFrame, payload: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """df with each symbol's fractional difference, where its payload's order lies between 0 and 1, the volatility regime, and with
    chains the chance of the hidden high-volatility regime. These see their own bar."""
    out = features.regime_rank(features.fractional_of(df, payload.select("symbol", "optimal_d"), out=FRACTION))
    if chains is None:
        return out
    # With return and time alone, the chance reaches the bars by a join; bars without a return have none.
    return out.join(regimes.regimes(df.select("symbol", "ts", "log_return"), chains=chains).select("symbol", "ts", regimes.HIGH), ["symbol", "ts"], "left")


def fit(bars: DataFrame, label: str = "target_label", columns: list[str] | None = None, most: int = 4, hidden: bool = False) -> FeatureModel:
    """A model of labelled bars, each symbol's by itself and in parallel. columns: the candidates; without them all numeric columns of
    the last stage. A fractional difference is a candidate in symbols that have one, and with `hidden` so is the chance of the
    high-volatility regime, which is passed on as it is besides its lagged forms. The bars' features are computed once and written,
    and so are the rows to select from."""
    known = bars.where(F.col(label).isNotNull()).withColumnRenamed(label, LABEL)
    ahead = written(stateless(known)[0])
    payload = written(diagnostics.scan(ahead))
    chains = regimes.fit(ahead) if hidden else None
    df = stateful(ahead, payload, chains)
    always = (FRACTION, regimes.HIGH)
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in ("symbol", "ts", LABEL, *audit.FORWARD_LOOKING)]
    columns = [c for c in numeric if columns is None or c in columns or c in always]
    rows = written(df.select("symbol", "ts", LABEL, *columns).dropna(subset=[c for c in columns if c not in always]))
    chosen = selection.consensus(rows, columns, LABEL)
    names_of = chosen.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("place", "feature", "lag"))).alias("s"))
    lags = F.map_from_arrays(F.transform("s", lambda x: x["feature"]), F.transform("s", lambda x: x["lag"]))
    forms = lambda x: F.array(F.concat(x["feature"], F.lit("_zscaled_lag"), x["lag"].cast("string")), F.concat(x["feature"], F.lit("_momentum")))
    every = F.flatten(F.transform("s", lambda x: F.when(x["feature"] == regimes.HIGH, F.concat(F.array(x["feature"]), forms(x))).otherwise(forms(x))))
    named = written(names_of.select("symbol", lags.alias("lags"), every.alias("every")))

    candidates = named.select("symbol", F.posexplode("every").alias("place", "feature"))
    picked = selection.diversify(candidates, "symbol", most).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("place", "feature"))).getField("feature").alias("features"))
    return FeatureModel(payload, written(picked.join(named, "symbol").select("symbol", "features", "lags")), chains)


class _FeatureParams(Params):
    label = Param(Params._dummy(), "label", "column of 0 and 1; bars without it aren't fitted", TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "candidates; all numeric features if empty", TypeConverters.toListString)
    most = Param(Params._dummy(), "most", "features to select for a symbol", TypeConverters.toInt)
    hidden = Param(Params._dummy(), "hidden", "whether the hidden regime's chance is a candidate", TypeConverters.toBoolean)


class FeaturePipeline(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """fit() as a pyspark.ml estimator."""

    @keyword_only
    def __init__(self, *, label="target_label", columns=(), most=4, hidden=False):
        super().__init__()
        self._setDefault(label="target_label", columns=[], most=4, hidden=False)
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()})

    def _fit(self, dataset: DataFrame) -> FeaturePipelineModel:
        columns = self.getOrDefault(self.columns) or None
        found = fit(dataset, self.getOrDefault(self.label), columns, self.getOrDefault(self.most), self.getOrDefault(self.hidden))
        return self._copyValues(FeaturePipelineModel(*found))


class FeaturePipelineModel(Model, _FeatureParams, MLWritable, MLReadable):
    """The fitted tables as a pyspark.ml model, written and read as these are."""

    def __init__(self, payload: DataFrame | None = None, selected: DataFrame | None = None, chains: DataFrame | None = None):
        super().__init__()
        self.found = FeatureModel(payload, selected, chains)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.found.transform(dataset)

    def write(self) -> TableWriter:
        return TableWriter(self, self.found.tables())

    @classmethod
    def read(cls) -> TableReader:
        return TableReader(cls, ["payload", "selected", "chains"])
