"""Hidden volatility regimes of each symbol: a two-state Markov chain fitted by expectation maximisation, and what it says of each bar.

A step of the chain is linear in the chances before it, so a range of bars is a 2 x 2 matrix: symbols of any length are filtered and
fitted in ranges, whose matrices are composed in order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import kernels as k
from tidewright.functions.series import rolled
from tidewright.functions.tables import spread, written

#: The column of the high-volatility regime's chance, which selection and lagged features know by name.
HIGH, LOW = "regime_p_high_vol", "regime_p_low_vol"
CHAIN = "mean array<double>, var array<double>, stay array<double>"
#: Values of a symbol that one task fits alone; longer symbols are fitted in ranges, a pass over all of them a step.
IN_TASK = 1 << 20


def ranges(df: DataFrame, x: str) -> DataFrame:
    """symbol, part, n, ts, x: known values of each symbol in order, as arrays of one row a range of (symbol, ts). Written."""
    known = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select("symbol", "ts", F.col(x).cast("double").alias("x"))
    rows = known.repartitionByRange("symbol", "ts").withColumn("part", F.spark_partition_id())
    packed = rows.groupBy("symbol", "part").agg(F.array_sort(F.collect_list(F.struct("ts", "x"))).alias("rows"))
    return written(packed.select("symbol", "part", F.size("rows").cast("long").alias("n"), F.col("rows.ts").alias("ts"), F.col("rows.x").alias("x")))


def _chain(row) -> k.Chain:
    return k.Chain(row["mean"], row["var"], row["stay"])


def _facts(chain: k.Chain) -> dict:
    return {"mean": chain.mean.tolist(), "var": chain.var.tolist(), "stay": chain.stay.tolist()}


def _messages(blocks: DataFrame, chains: DataFrame, kind: str) -> DataFrame:
    """symbol, part, before, after: a symbol's messages, from its ranges' matrices, which are the only rows that meet."""

    def matrices(batches):
        for pdf in batches:
            maps = [_chain(r).map_of(np.asarray(r["x"])).ravel().tolist() for r in pdf.to_dict("records")]
            yield pdf[["symbol", "part", "mean", "var", "stay"]].assign(map=maps)

    def messages(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        before, after = k.chain_messages(_chain(pdf.iloc[0]), [np.reshape(m, (2, 2)) for m in pdf["map"]])
        return pdf[["symbol", "part"]].assign(before=[v.tolist() for v in before], after=[v.tolist() for v in after])

    maps = blocks.join(chains, "symbol").select("symbol", "part", "x", "mean", "var", "stay").mapInPandas(matrices, f"symbol {kind}, part int, {CHAIN}, map array<double>")
    return maps.groupBy("symbol").applyInPandas(messages, f"symbol {kind}, part int, before array<double>, after array<double>")


def fit(df: DataFrame, x: str = "log_return", steps: int = 500, close: float = 1e-7, in_task: int = IN_TASK) -> DataFrame:
    """symbol, mean, var, stay of each symbol's chain, the state of smaller variance first. Symbols under 10 values, or without
    variance, have none."""
    return _fit(ranges(df, x), steps, close, in_task)


def _fit(blocks: DataFrame, steps: int, close: float, in_task: int) -> DataFrame:
    kind = blocks.schema["symbol"].dataType.simpleString()
    sizes = blocks.groupBy("symbol").agg(F.sum("n").alias("all"))
    sized = blocks.join(sizes, "symbol")

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        chain = k.fit_chain(np.concatenate([np.asarray(v, float) for v in pdf.sort_values("part")["x"]]), steps, close)
        return pd.DataFrame([{"symbol": pdf["symbol"].iloc[0], **_facts(chain)}] if chain else [], columns=["symbol", "mean", "var", "stay"])

    short = spread(sized.where(F.col("all") <= in_task).select("symbol", "part", "x"), "symbol")
    found = written(short.groupBy("symbol").applyInPandas(alone, f"symbol {kind}, {CHAIN}"))
    long = written(sized.where(F.col("all") > in_task).select("symbol", "part", "x"))
    if long.isEmpty():
        return found
    flat = long.select("symbol", F.explode("x").alias("x")).groupBy("symbol").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).where("n >= 10 AND v > 1e-16")
    chains = written(flat.select("symbol", F.array("m", "m").alias("mean"), F.array(0.25 * F.col("v"), 1.75 * F.col("v")).alias("var"), F.array(F.lit(0.95), F.lit(0.9)).alias("stay"), "v"))

    def moments(batches):
        for pdf in batches:
            sums = [_chain(r).moments(np.asarray(r["x"]), np.asarray(r["before"]), np.asarray(r["after"])).tolist() for r in pdf.to_dict("records")]
            yield pdf[["symbol"]].assign(s=sums)

    def better(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                new = k.Chain.of_moments(np.asarray(r["s"]), 1e-4 * r["v"])
                rows.append({"symbol": r["symbol"], **_facts(new), "v": r["v"], "moved": _chain(r).change(new)})
            yield pd.DataFrame(rows, columns=["symbol", "mean", "var", "stay", "v", "moved"])

    for _ in range(steps):
        told = long.join(_messages(long, chains, kind), ["symbol", "part"]).join(chains, "symbol").select("symbol", "x", "before", "after", "mean", "var", "stay")
        sums = told.mapInPandas(moments, f"symbol {kind}, s array<double>").groupBy("symbol").agg(F.array(*[F.sum(F.element_at("s", i)) for i in range(1, 11)]).alias("s"))
        new = written(sums.join(chains, "symbol").select("symbol", "s", "mean", "var", "stay", "v").mapInPandas(better, f"symbol {kind}, {CHAIN}, v double, moved double"))
        chains, moved = new.drop("moved"), new.agg(F.max("moved")).first()[0]
        if moved is None or moved < close:
            break
    return found.unionByName(chains.drop("v"))


def filtered(df: DataFrame, chains: DataFrame, x: str = "log_return") -> DataFrame:
    """symbol, ts, regime_p_low_vol, regime_p_high_vol of each bar with a value, given it and those before, by its symbol's chain.
    Symbols without a chain don't come."""
    return _filtered(ranges(df, x), chains)


def _filtered(blocks: DataFrame, chains: DataFrame) -> DataFrame:
    kind = blocks.schema["symbol"].dataType.simpleString()
    told = blocks.join(_messages(blocks, chains, kind).drop("after"), ["symbol", "part"]).join(chains, "symbol")

    def chances(batches):
        for pdf in batches:
            high = [_chain(r).filtered(np.asarray(r["x"]), np.asarray(r["before"]))[:, 1].tolist() for r in pdf.to_dict("records")]
            yield pdf[["symbol", "ts"]].assign(high=high)

    ts = blocks.schema["ts"].dataType.simpleString()
    found = told.select("symbol", "ts", "x", "before", "mean", "var", "stay").mapInPandas(chances, f"symbol {kind}, ts {ts}, high array<double>")
    rows = found.select("symbol", F.explode(F.arrays_zip("ts", "high")).alias("r"))
    return rows.select("symbol", "r.ts", (1 - F.col("r.high")).alias(LOW), F.col("r.high").alias(HIGH))


def by_deviation(df: DataFrame, x: str = "log_return", window: int = 20) -> DataFrame:
    """The regimes of symbols that have no chain: high where the deviation of the last values is over its median."""
    known = df.where(F.col(x).isNotNull()).select("symbol", "ts", F.col(x).alias("x")).withColumn("d", rolled(F.stddev_samp, "x", window))
    middle = known.groupBy("symbol").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    high = F.coalesce((F.col("d") > F.col("m")).cast("double"), F.lit(0.0))
    return known.join(middle, "symbol").select("symbol", "ts", (1 - high).alias(LOW), high.alias(HIGH))


def regimes(df: DataFrame, x: str = "log_return", chains: DataFrame | None = None, in_task: int = IN_TASK) -> DataFrame:
    """symbol, ts, regime_p_low_vol, regime_p_high_vol of every bar with a value. chains: fitted before, on other bars; else they are
    fitted on these."""
    blocks = ranges(df, x)
    chains = _fit(blocks, 500, 1e-7, in_task) if chains is None else chains
    rest = df.join(chains.select("symbol"), "symbol", "left_anti")
    return _filtered(blocks, chains).unionByName(by_deviation(rest, x))


def conditioned_information(df: DataFrame, columns: list[str], label: str = "target_label", chance: str = HIGH, least: float = 0.01) -> DataFrame:
    """symbol, feature, mi_high_vol, mi_low_vol, mi_all, accepted: mutual information of each feature with the label in bars whose
    chance of the high regime is over a half, in the others, and in all. A feature is accepted if either regime's is over `least`.
    Each (symbol, state, feature) is a group of two columns; rows without chance or value don't count, nor states of four rows or
    fewer in either class, whose information is 0."""
    named = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    state = F.when(F.col(chance) > 0.5, "high").otherwise("low")
    rows = df.where(F.col(chance).isNotNull() & F.col(label).isNotNull()).select("symbol", F.col(label).cast("int").alias("y"), F.explode(F.array(F.lit("all"), state)).alias("state"), F.explode(named).alias("c"))
    rows = rows.select("symbol", "state", "c.feature", "y", "c.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    kind = df.schema["symbol"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        mi = k.mutual_information(pdf["v"].to_numpy(), pdf["y"].to_numpy())
        return pdf[["symbol", "state", "feature"]].head(1).assign(mi=mi)

    found = spread(rows, "symbol", "state", "feature").groupBy("symbol", "state", "feature").applyInPandas(one, f"symbol {kind}, state string, feature string, mi double")
    g = found.groupBy("symbol", "feature").agg(*[F.coalesce(F.max(F.when(F.col("state") == s, F.col("mi"))), F.lit(0.0)).alias(n) for s, n in (("high", "mi_high_vol"), ("low", "mi_low_vol"), ("all", "mi_all"))])
    return g.withColumn("accepted", (F.col("mi_high_vol") > least) | (F.col("mi_low_vol") > least))
