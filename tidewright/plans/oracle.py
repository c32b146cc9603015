"""Pieces of DuckDB SQL for the oracles, written apart from the DataFrame code."""

from __future__ import annotations

EVENTS = """ev AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS t, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
 last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""
ORDERS = """ob AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS TIMESTAMP) AS t, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
 arg_max(o_totalprice, o_orderkey) AS close, sum(o_totalprice / 1000) AS volume FROM orders GROUP BY 1, 2)"""
INDEX = """ix AS (SELECT CAST(o_orderdate AS TIMESTAMP) AS t, arg_max(o_totalprice, o_orderkey) AS close, sum(o_totalprice / 1000) AS volume FROM orders GROUP BY 1),
mk AS (SELECT t, ln(close / lag(close) OVER (ORDER BY t)) AS mkt_return FROM ix)"""
ORD = "PARTITION BY symbol ORDER BY t"
TS = "strftime(t, '%Y-%m-%d %H:%M:%S') AS ts"


def lag(x: str, k: int = 1) -> str:
    return f"(lag({x}, {k}) OVER ({ORD}))"


def win(n: int, back: int = 0) -> str:
    return f"OVER ({ORD} ROWS BETWEEN {n - 1 + back} PRECEDING AND {f'{back} PRECEDING' if back else 'CURRENT ROW'})"


def roll(fn: str, x: str, n: int, back: int = 0) -> str:
    return f"(CASE WHEN count({x}) {win(n, back)} = {n} THEN {fn}({x}) {win(n, back)} END)"


def avg(x: str, n: int, back: int = 0) -> str:
    return roll("avg", x, n, back)


def sd(x: str, n: int, back: int = 0) -> str:
    return roll("stddev_samp", x, n, back)


def total(x: str, n: int, back: int = 0) -> str:
    return roll("sum", x, n, back)


def adjusted(source: str) -> str:
    """CTE b: t, symbol, raw open, high, low, close, v, and o, h, l, c, r on the total-return index."""
    return f"""rr AS (SELECT *, close / lag(close) OVER ({ORD}) - 1 AS ret FROM {source} WHERE low > 0 AND volume >= 0),
aj AS (SELECT *, 1000 * product(1 + coalesce(ret, 0)) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS c FROM rr),
ad AS (SELECT symbol, t, open, high, low, close, volume AS v, open * (c / close) AS o, high * (c / close) AS h, low * (c / close) AS l, close * (c / close) AS c FROM aj),
b AS (SELECT *, ln(c / lag(c) OVER ({ORD})) AS r, coalesce(ln(c / lag(c) OVER ({ORD})), 0) AS r0 FROM ad)"""


def features(columns: dict[str, str], *levels: dict[str, str], source: str = "ob", extra: str = "") -> str:
    """A query of columns over levels of helper columns that follow b."""
    table = ORDERS if source == "ob" else EVENTS
    steps, last = [f"WITH {table}", adjusted(source)] if not extra else [f"WITH {table}", adjusted(source), extra], "bm" if extra else "b"
    for i, level in enumerate(levels):
        steps.append(f"l{i} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in level.items())} FROM {last})")
        last = f"l{i}"
    return ",\n".join(steps) + f"\nSELECT symbol, {TS}, {', '.join(f'{x} AS {n}' for n, x in columns.items())} FROM {last}"


def label_sql(source: str = "ev", span: int = 20, horizon: int = 5, floor: float = 0.0001, memory: int = 240) -> str:
    """CTEs up to lb: b with sigma, y, ret, touch."""
    table = EVENTS if source == "ev" else ORDERS
    a = 1 - 2 / (span + 1)
    return f"""WITH {table}, {adjusted(source)},
num AS (SELECT *, row_number() OVER ({ORD}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b),
wt AS (SELECT x.symbol, x.i, sum(power({a}, x.i - y.i)) AS w, sum(power({a}, 2 * (x.i - y.i))) AS w2, sum(power({a}, x.i - y.i) * y.r) AS wx, count(*) AS k
  FROM num x JOIN num y ON x.symbol = y.symbol AND y.i BETWEEN x.i - {memory - 1} AND x.i AND y.r IS NOT NULL GROUP BY 1, 2),
sq AS (SELECT x.symbol, x.i, sum(power({a}, x.i - y.i) * power(y.r - wt.wx / wt.w, 2)) AS s
  FROM num x JOIN wt ON x.symbol = wt.symbol AND x.i = wt.i JOIN num y ON x.symbol = y.symbol AND y.i BETWEEN x.i - {memory - 1} AND x.i AND y.r IS NOT NULL GROUP BY 1, 2),
vo AS (SELECT wt.symbol, wt.i + 1 AS i, CASE WHEN wt.k >= 2 THEN sqrt(sq.s * wt.w / (wt.w * wt.w - wt.w2)) END AS vol FROM wt JOIN sq ON wt.symbol = sq.symbol AND wt.i = sq.i),
sg AS (SELECT num.*, greatest(coalesce(vo.vol, {floor}), {floor}) AS sigma FROM num LEFT JOIN vo ON num.symbol = vo.symbol AND num.i = vo.i),
fw AS (SELECT s.symbol, s.i, min(f.i) FILTER (WHERE f.c >= s.c * (1 + s.sigma) OR f.c <= s.c * (1 - s.sigma)) AS hit, max(f.i) AS last, count(*) AS k
  FROM sg s JOIN sg f ON s.symbol = f.symbol AND f.i BETWEEN s.i + 1 AND s.i + {horizon} GROUP BY 1, 2),
lb AS (SELECT s.*, CASE WHEN fw.k = {horizon} THEN CASE WHEN fw.hit IS NOT NULL AND e.c >= s.c * (1 + s.sigma) THEN 1 ELSE 0 END END AS y,
  CASE WHEN fw.k = {horizon} THEN e.c / s.c - 1 END AS ret, CASE WHEN fw.k = {horizon} THEN e.t END AS touch
  FROM sg s LEFT JOIN fw ON s.symbol = fw.symbol AND s.i = fw.i LEFT JOIN sg e ON e.symbol = s.symbol AND e.i = coalesce(fw.hit, fw.last))"""


def swept(name: str, source: str, group: str, kept: str, y: str, columns: list[str]) -> str:
    """CTEs {name}0 .. {name}{len(columns)}: `y` and the columns of a table less their group's means, then less their projections on the
    first column, the second, and so on (Gram-Schmidt); a column of zeros takes nothing. The y of {name}k is what a regression on the
    first k columns and a constant leaves."""
    over = f"OVER (PARTITION BY {group})"
    steps = [f"{name}0 AS MATERIALIZED (SELECT {kept}, " + ", ".join(f"{c} - avg({c}) {over} AS {c}" for c in [y, *columns]) + f" FROM {source})"]
    for i, c in enumerate(columns):
        rest = [y, *columns[i + 1 :]]
        steps.append(f"{name}{i + 1} AS MATERIALIZED (SELECT {kept}, {', '.join(columns[: i + 1])}, " + ", ".join(f"{r} - coalesce(sum({r} * {c}) {over} / nullif(sum({c} * {c}) {over}, 0), 0) * {c} AS {r}" for r in rest) + f" FROM {name}{i})")
    return ",\n".join(steps)
