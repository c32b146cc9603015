"""Registry of queries: a DataFrame function, and independent DuckDB SQL where there is any. Both are rounded alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
#: Ratios of prices often end in an exact half of the last digit; this moves them off it on both sides.
NUDGE = 1.3e-9


def query(name: str, keys: list[str], numbers: list[str] = (), sql: str | None = None, scale: dict[str, float] | None = None) -> Callable:
    """Registers fn(spark, sf_dir) under a name. Of its columns, `keys` are kept (times as text) and `numbers` are rounded;
    sql is wrapped to do the same. scale: factors of numbers too small or too large for rounding to tell apart."""
    scale = scale or {}

    def add(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            kinds = dict(df.dtypes)
            key = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if kinds[c].startswith("timestamp") else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint", "smallint", "boolean") else F.col(c)
            return df.select(*[key(c) for c in keys], *[(F.round(F.col(c).cast("double") * F.lit(float(scale.get(c, 1.0))) + NUDGE, DIGITS) + 0.0).alias(c) for c in numbers])

        QUERIES[name] = run
        if sql:
            columns = [c for c in keys] + [f"round(CAST({c} AS DOUBLE) * {float(scale.get(c, 1.0))!r} + {NUDGE}, {DIGITS}) + 0.0 AS {c}" for c in numbers]
            ORACLES[name] = f"SELECT {', '.join(columns)} FROM ({sql}) AS q"
        return fn

    return add
