"""Recursive series, such as exponential means and deviations, of symbols of any length: a blocked scan.

Rows are dealt into ranges of (symbol, ts) and pass once through their range in order, carrying the recursion from batch to batch as if
it began in the range. What a range does to the recursion that comes into it is a map of few numbers; the maps of a symbol's
ranges are composed in order, and each row is corrected by what came into its range, which is an expression of columns. So no task,
group or window holds a symbol, and the only exchange is the range sort."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.tables import written

PART, PLACE = "__part", "__k"


def ewm_std_values(x, span: int) -> np.ndarray:
    """Bias-corrected exponential deviation of the values so far, from the second on; a missing value ages the weights."""
    return pd.Series(x, dtype=float).ewm(span=span, min_periods=2).std().to_numpy()


class Mean:
    """The mean y that began in this range, the share r of what came in that is still in it, the first value, and the rows up to
    it."""

    fields = ("y", "r", "f", "g")

    def __init__(self, span: int):
        self.a, self.span = 2 / (span + 1), span
        self.y, self.r, self.f, self.g, self.n, self.last = np.nan, 1.0, np.nan, np.nan, 0, None

    def step(self, x: np.ndarray) -> list[np.ndarray]:
        at = np.flatnonzero(~np.isnan(x))
        y, r = np.full(len(x), self.y), np.full(len(x), self.r)
        f, g = np.full(len(x), self.f), np.full(len(x), self.g)
        if len(at):
            first, place = at[0], self.n + at
            begins = self.last is None
            aged = (1 - self.a) ** np.diff(place, prepend=place[0] if begins else self.last).astype(float)
            share = aged / (aged + self.a)
            if begins:
                share[0], self.f, self.g = 1.0, x[first], place[0] + 1.0
                off = 0.0
            else:
                off = share[0] * (self.y - x[first])
            kept = np.cumprod(share)
            ages = np.searchsorted(at, np.arange(first, len(x)), "right") - 1
            y[first:] = pd.Series(x[first:]).ewm(span=self.span, adjust=False).mean().to_numpy() + (kept / (share[0] or 1.0))[ages] * off
            r[first:] = (self.r * kept)[ages]
            f[first:], g[first:] = self.f, self.g
            self.y, self.r, self.last = y[-1], r[-1], int(place[-1])
        self.n += len(x)
        return [y, r, f, g]


class Deviation:
    """Mean, variance, weight, squared weight and count of the values before a row that are in this range."""

    fields = ("m", "v", "w", "q", "c")

    def __init__(self, span: int):
        self.span, self.rest = span, 1 - 2 / (span + 1)
        self.state = (0.0, 0.0, 0.0, 0.0, 0.0)

    def step(self, x: np.ndarray) -> list[np.ndarray]:
        s, known = pd.Series(x), pd.Series((~np.isnan(x)).astype(float))
        own = s.ewm(span=self.span)
        now = (own.mean().fillna(0.0).to_numpy(), own.var(bias=True).fillna(0.0).to_numpy(), known.ewm(span=self.span).sum().to_numpy(), known.ewm(alpha=1 - self.rest**2).sum().to_numpy() if self.rest else known.to_numpy(), known.cumsum().to_numpy())
        after = merged(self.state, now, self.rest ** np.arange(1.0, len(x) + 1))
        out = [np.concatenate([[before], values[:-1]]) for before, values in zip(self.state, after)]
        self.state = tuple(float(v[-1]) for v in after)
        return out


def merged(before: tuple, now: tuple, aged):
    """Moments of two weighted sets as one; the weights of the earlier have aged. Columns or arrays alike."""
    (m0, v0, w0, q0, c0), (m, v, w, q, c) = before, now
    w0 = w0 * aged
    total = w0 + w
    safe = np.where(total > 0, total, 1.0)
    share = w0 / safe
    return m + share * (m0 - m), share * v0 + (1 - share) * v + share * (1 - share) * (m0 - m) ** 2, total, q0 * aged * aged + q, c0 + c


def streamed(df: DataFrame, makers: dict[str, tuple[str, Callable]]) -> DataFrame:
    """df in ranges of (symbol, ts), written, with the range and the place in its symbol's rows there, and for each {name: (column,
    maker of a kernel)} the kernel's fields as `__name_field`. Batches are the only rows in memory."""
    columns = list(dict.fromkeys(x for x, _ in makers.values()))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    added = [f"__{name}_{field}" for name, (_, make) in makers.items() for field in make().fields]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, kernels, k = TaskContext.get().partitionId(), None, {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols = batch.column("symbol").to_numpy(zero_copy_only=False)
            values = {x: batch.column(x).cast(pa.float64()).to_numpy(zero_copy_only=False) for x in columns}
            edges = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1), len(symbols)]
            found, places = [], []
            for a, b in zip(edges, edges[1:]):
                if held is None or symbols[a] != held:
                    held, kernels, k = symbols[a], {name: make() for name, (_, make) in makers.items()}, 0
                found.append([v for name, (x, _) in makers.items() for v in kernels[name].step(values[x][a:b])])
                places.append(np.arange(k, k + b - a))
                k += b - a
            more = [np.full(len(symbols), part, np.int64), np.concatenate(places), *(np.concatenate(v) for v in zip(*found))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v) for v in more)], names=[*batch.schema.names, PART, PLACE, *added])

    ranges = df.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts")
    return written(ranges.mapInArrow(stream, ", ".join([*kinds, f"`{PART}` long", f"`{PLACE}` long", *(f"`{c}` double" for c in added)])))


def carried(rows: DataFrame, facts: list[Column], compose: Callable[[pd.DataFrame], pd.DataFrame], fields: str) -> DataFrame:
    """rows with what came into their range: compose() turns the facts of a symbol's ranges, in order, one row each, into `fields`."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(PART).reset_index(drop=True)
        return pd.concat([pdf[["symbol", PART]], compose(pdf)], axis=1)

    kind = rows.schema["symbol"].dataType.simpleString()
    ends = rows.groupBy("symbol", PART).agg(*facts)
    states = written(ends.groupBy("symbol").applyInPandas(one, f"symbol {kind}, `{PART}` long, {fields}"))
    return rows.join(states, ["symbol", PART])


def _last(column: str) -> Column:
    return F.max_by(column, PLACE)


def ema(df: DataFrame, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """df with exponential means {name: (column, span)}. A missing value ages the mean, which a row without one keeps."""
    rows = streamed(df, {name: (x, lambda span=span: Mean(span)) for name, (x, span) in columns.items()})
    facts, fields = [F.count(F.lit(1)).alias("rows")], []
    for name, (x, _) in columns.items():
        facts += [_last(f"__{name}_{f}").alias(f"{name}_{f}") for f in Mean.fields]
        facts.append(F.max(F.when(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")), F.col(PLACE))).alias(f"{name}_at"))
        fields += [f"`__{name}_in` double", f"`__{name}_age` double"]

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {}
        for name, (_, span) in columns.items():
            y, age, before = np.nan, 0.0, []
            for y1, r, f, g, at, n in zip(*(pdf[f"{name}_{c}"] for c in (*Mean.fields, "at")), pdf["rows"]):
                before.append((y, age))
                if np.isnan(at):
                    age += n
                    continue
                y, age = y1 if np.isnan(y) else y1 + r * _off(y, age + g, f, span), n - 1 - at
            out[f"__{name}_in"], out[f"__{name}_age"] = zip(*before)
        return pd.DataFrame(out)

    rows = carried(rows, facts, compose, ", ".join(fields))
    done = {}
    for name, (_, span) in columns.items():
        y, r, f, g, y0, age = (F.col(f"__{name}_{c}") for c in (*Mean.fields, "in", "age"))
        off = _off(y0, age + g, f, span, F.pow)
        done[name] = F.when(F.isnan(y), y0).when(y0.isNull(), y).otherwise(y + r * off)  # pandas' missing y0 is null
    return rows.select(*df.columns, *[c.alias(n) for n, c in done.items()])


def _off(y, age, f, span: int, power=pow):
    """How much the mean at a range's first value differs from that value, when y came in and `age` rows have passed."""
    a = 2 / (span + 1)
    left = power(1 - a, age) if power is pow else power(F.lit(1 - a), age)
    return left / (left + a) * (y - f)


def ewm_std(df: DataFrame, x: str, span: int, out: str, lag: int = 1, floor: float | None = None, ranged: bool = False) -> DataFrame:
    """df with `out`: the bias-corrected exponential deviation of x one row late (lag 1) or of its own row too (lag 0), missing and
    small values raised to floor. Weights age also where x is missing. ranged: the rows keep the range that they are in, for
    with_following()."""
    rest = 1 - 2 / (span + 1)
    rows = streamed(df.drop(out), {"d": (x, lambda: Deviation(span))})
    names = [f"__d_{f}" for f in Deviation.fields]
    facts = [F.count(F.lit(1)).alias("rows"), F.max_by(F.struct(*names, F.col(x).cast("double").alias("x")), PLACE).alias("s")]

    def own(v) -> tuple:
        known = v is not None and not np.isnan(v)
        return (float(v), 0.0, 1.0, 1.0, 1.0) if known else (0.0,) * 5

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        state, before = (0.0,) * 5, []
        for n, s in zip(pdf["rows"], pdf["s"]):
            before.append(state)
            end = merged(tuple(s[c] for c in names), own(s["x"]), rest)
            state = tuple(float(v) for v in merged(state, end, rest ** float(n)))
        return pd.DataFrame(before, columns=[f"__in_{f}" for f in Deviation.fields])

    rows = carried(rows, facts, compose, ", ".join(f"`__in_{f}` double" for f in Deviation.fields))
    aged = F.pow(F.lit(rest), F.col(PLACE).cast("double"))
    state = _merged_columns([F.col(f"__in_{f}") for f in Deviation.fields], [F.col(n) for n in names], aged)
    if not lag:
        value = F.col(x).cast("double")
        known = value.isNotNull() & ~F.isnan(value)
        one = F.when(known, 1.0).otherwise(0.0)
        state = _merged_columns(state, [F.when(known, value).otherwise(0.0), F.lit(0.0), one, one, one], F.lit(rest))
    m, v, w, q, c = state
    spread = w * w - q
    found = F.when((c >= 2) & (spread > 0), F.sqrt(v * w * w / spread))
    if floor is not None:
        found = F.greatest(F.coalesce(found, F.lit(floor)), F.lit(floor))
    return rows.select(*[c for c in df.columns if c != out], found.alias(out), *([PART] if ranged else []))


def _merged_columns(before: list[Column], now: list[Column], aged: Column) -> list[Column]:
    (m0, v0, w0, q0, c0), (m, v, w, q, c) = before, now
    total = w0 * aged + w
    share = F.coalesce(F.try_divide(w0 * aged, total), F.lit(0.0))
    return [m + share * (m0 - m), share * v0 + (1 - share) * v + share * (1 - share) * (m0 - m) * (m0 - m), total, q0 * aged * aged + q, c0 + c]


def with_following(df: DataFrame, columns: list[str], n: int, out: str) -> DataFrame:
    """df with the structs of `columns` of each row's next n rows of its symbol, in order: windows lie within ranges of (symbol, ts),
    to which the first rows of the ranges after are lent. Rows that don't have their range yet are dealt into ranges and written."""
    rows = df if PART in df.columns else written(df.repartitionByRange("symbol", "ts").withColumn(PART, F.spark_partition_id()))
    own = Window.partitionBy("symbol", PART)
    counts = rows.groupBy("symbol", PART).agg(F.count(F.lit(1)).alias("rows"))
    by = Window.partitionBy("symbol").orderBy(PART)  # a row a range
    ends = counts.select("symbol", F.col(PART).alias("__to"), F.sum("rows").over(by).alias("end"))
    starts = counts.select("symbol", PART, (F.sum("rows").over(by) - F.col("rows")).alias("start"))
    heads = rows.select("symbol", PART, "ts", *[c for c in columns if c not in ("symbol", "ts")]).withColumn(PLACE, F.row_number().over(own.orderBy("ts"))).where(F.col(PLACE) <= n)
    lent = heads.join(starts, ["symbol", PART]).join(ends, "symbol").where((F.col("__to") < F.col(PART)) & (F.col("start") + F.col(PLACE) <= F.col("end") + n))
    lent = lent.select("symbol", F.col("__to").alias(PART), "ts", *[c for c in columns if c not in ("symbol", "ts")], F.lit(True).alias("__lent"))
    both = rows.withColumn("__lent", F.lit(False)).unionByName(lent, allowMissingColumns=True)
    ahead = F.collect_list(F.struct(*columns)).over(own.orderBy("ts").rowsBetween(1, n))
    return both.withColumn(out, ahead).where(~F.col("__lent")).drop("__lent", PART)
