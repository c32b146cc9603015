"""Exact order statistics, places and shuffles of tables of any size: no task holds a column or a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.tables import written

#: Values that one task sorts at last, and parts that a range of values is counted in.
BOUND, PARTS = 1 << 16, 1 << 10


def quantiles(df: DataFrame, columns: list[str], shares: list[float], bound: int = BOUND, parts: int = PARTS) -> dict[str, list[float | None]]:
    """The columns' exact quantiles, between neighbours in proportion, as percentile() has them; null and NaN don't count, and a column
    without values has None. Each pass counts the values in parts of the ranges that hold a wanted place, and goes on with the part
    that holds it, between the least and the greatest value there, until it has one value or at most `bound`. What comes to the
    driver is the counts of the parts."""
    if not columns or not shares:
        return {c: [] for c in columns}
    value = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns}
    first = df.agg(*[f(value[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max), ("n", F.count))]).first()
    places = {(c, r) for i, c in enumerate(columns) if first[f"n{i}"] for s in shares for r in _around(s, first[f"n{i}"])}
    index = {c: i for i, c in enumerate(columns)}
    # Of each wanted place: the range's ends, its values, and how many lie below it.
    open_ = {p: (first[f"a{index[p[0]]}"], first[f"b{index[p[0]]}"], first[f"n{index[p[0]]}"], 0) for p in places}
    found: dict[tuple, float] = {}
    while True:
        found |= {p: a for p, (a, b, _, _) in open_.items() if a == b}
        wide = {p: r for p, r in open_.items() if p not in found and r[2] > bound}
        if not wide:
            break
        ranges = list(dict.fromkeys((p[0], r[0], r[1]) for p, r in wide.items()))
        marks = [F.when(value[c].between(a, b), F.struct(F.lit(i).alias("range"), _part(value[c], a, b, parts).alias("part"), value[c].alias("v"))) for i, (c, a, b) in enumerate(ranges)]
        rows = df.select(F.explode(F.array(*marks)).alias("m")).where("m IS NOT NULL").groupBy("m.range", "m.part").agg(F.count(F.lit(1)).alias("n"), F.min("m.v").alias("a"), F.max("m.v").alias("b")).collect()
        counts: dict[int, list] = {i: [] for i in range(len(ranges))}
        for r in sorted(rows, key=lambda r: r["a"]):
            counts[r["range"]].append(r)
        for p, (a, b, _, below) in wide.items():
            for r in counts[ranges.index((p[0], a, b))]:
                if p[1] < below + r["n"]:
                    open_[p] = (r["a"], r["b"], r["n"], below)
                    break
                below += r["n"]
    rest = {p: r for p, r in open_.items() if p not in found}
    if rest:
        ranges = list(dict.fromkeys((p[0], r[0], r[1]) for p, r in rest.items()))
        held = df.agg(*[F.sort_array(F.collect_list(F.when(value[c].between(a, b), value[c]))).alias(f"v{i}") for i, (c, a, b) in enumerate(ranges)])
        wanted = {p: F.col(f"v{ranges.index((p[0], r[0], r[1]))}")[p[1] - r[3]] for p, r in rest.items()}
        row = held.select(*[c.alias(f"p{i}") for i, c in enumerate(wanted.values())]).first()
        found |= {p: row[f"p{i}"] for i, p in enumerate(wanted)}
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        n, out[c] = first[f"n{i}"], []
        for s in shares:
            if n:
                lo, hi = _around(s, n)
                at = s * (n - 1) - lo
                out[c].append(found[c, lo] if lo == hi else (1 - at) * found[c, lo] + at * found[c, hi])
            else:
                out[c].append(None)
    return out


def _around(share: float, n: int) -> tuple[int, int]:
    at = share * (n - 1)
    return math.floor(at), math.ceil(at)


def _part(value: Column, a: float, b: float, parts: int) -> Column:
    """Ranges as wide as doubles are cut in halves, so that no width is infinite."""
    share = (value / 2 - a / 2) / (b / 2 - a / 2)
    return F.least(F.floor(share * parts), F.lit(parts - 1))


def placed(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """df with each row's place (from 1) in its group by `order`: rows are dealt into ranges of it, written, and numbered there after the
    counts of the ranges before. A group may span any number of ranges."""
    named = {f"__o{i}": c for i, c in enumerate(order)}
    rows = df.withColumns(named)
    rows = written(rows.repartitionByRange(F.col(group), *map(F.col, named)).withColumn("__part", F.spark_partition_id()))
    counts = rows.groupBy("__part", group).agg(F.count(F.lit(1)).alias("__rows"))
    before = counts.select("__part", F.col(group).alias("__g"), (F.sum("__rows").over(Window.partitionBy(group).orderBy("__part")) - F.col("__rows")).alias("__before"))  # a row a range
    inside = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__part", group).orderBy(*map(F.col, named))))
    before = before.withColumnRenamed("__part", "__p")
    joined = inside.join(before, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return joined.select(*df.columns, (F.col("__before") + F.col("__r")).alias(out))


def shuffled(df: DataFrame, column: str, by: str = "fold", keys: tuple[str, ...] = ("symbol", "ts"), seed: int = 42) -> DataFrame:
    """df with `column` shuffled within each group: the value of the n-th row in one random order goes to the n-th in another. Orders are
    digests of the seed and the keys, so reruns and other dealings give the same; rows without a group are one."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if df.schema[c].dataType.typeName().startswith("timestamp") else F.col(c).cast("string")
    order = lambda i: [F.md5(F.concat_ws("|", F.lit(str(seed + i)), *[text(c) for c in keys])), *map(F.col, keys)]
    values = placed(df.select(by, *keys, F.col(column).alias("__v")), by, order(0), "__n").select(F.col(by).alias("__by"), "__v", F.col("__n").alias("__m"))
    rows = placed(df.drop(column), by, order(1), "__n")
    return rows.join(values, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__n") == F.col("__m"))).select(*[F.col("__v").alias(c) if c == column else F.col(c) for c in df.columns])
