"""Merkle manifest of a dataset: trees of 16 branches over each source's rows, and over the sources, with every row's proof.

Rows are numbered within their source by a range sort of digests (texts aren't exchanged), cut into aligned blocks of 16^3 rows, and
each block's root is found in its own task; blocks' roots are the leaves of the next level, so a driver loop of a few rounds builds
the tree of any source. Paths then come down: each block meets the one path that all its rows share above it, and inside the block
treehash stacks carry the path from leaf to leaf in memory that is logarithmic in the block (`walk`)."""

from __future__ import annotations

import string
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
#: Levels of the tree inside a block: 16^3 = 4,096 rows a group.
BLOCK_LEVELS = 3
BLOCK = FANOUT**BLOCK_LEVELS
PATH = "array<struct<left:string,right:string>>"
PATH_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(texts: list[str]) -> str:
    return sha256("".join(texts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels over n leaves: none over one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


class Treehash:
    """Nodes `level` levels over the leaves fed so far, on one stack of unfinished runs; close() ends a last run that isn't full."""

    def __init__(self, level: int):
        self.nodes: list[str] = []
        self.open: list[list[str]] = [[] for _ in range(level)]

    def feed(self, node: str, at: int = 0) -> None:
        while at < len(self.open):
            self.open[at].append(node)
            if len(self.open[at]) < FANOUT:
                return
            node, self.open[at], at = digest(self.open[at]), [], at + 1
        self.nodes.append(node)

    def close(self) -> list[str]:
        for at in range(len(self.open)):
            if self.open[at]:
                last, self.open[at] = digest(self.open[at]), []
                self.feed(last, at + 1)
        return self.nodes


def root_of(leaves: list[str], levels: int) -> str:
    tree = Treehash(levels)
    for leaf in leaves:
        tree.feed(leaf)
    return tree.close()[0]


def walk(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf in turn: at every level the digests before and after its own in its run. A level holds the run that
    the present leaf is in, and a treehash that builds the next run while the leaves of this one pass, one leaf a step."""
    runs, ahead = [], []
    for level in range(levels):
        first = Treehash(level)
        for leaf in leaves[: FANOUT ** (level + 1)]:
            first.feed(leaf)
        runs.append(first.close())
        ahead.append(Treehash(level))
    for p in range(len(leaves)):
        path = []
        for level, run in enumerate(runs):
            own = p // FANOUT**level % FANOUT
            path.append(("".join(run[:own]), "".join(run[own + 1 :])))
        yield path
        for level in range(levels):
            span = FANOUT ** (level + 1)
            if p + span < len(leaves):
                ahead[level].feed(leaves[p + span])
            if (p + 1) % span == 0:
                runs[level], ahead[level] = ahead[level].close(), Treehash(level)


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def leaf_of(columns: list) -> F.Column:
    """The digest of a row's fields, each `-` if null, else its bytes' count, `:`, and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with `pos` (from 0) in its group by `order`, nulls first, and the group's rows `n`: rows are dealt into ranges of the order
    and numbered inside their range, after the counts of ranges before it. No task holds a group that spans ranges."""
    keys = [F.col(c).asc_nulls_first() for c in group + order]
    placed = written(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("part", *group).agg(F.count(F.lit(1)).alias("rows"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    starts = counts.select("part", *group, (F.sum("rows").over(over.orderBy("part")) - F.col("rows")).alias("start"), F.sum("rows").over(over).alias("n"))
    starts = starts.select(*[F.col(c).alias(f"s_{c}") for c in ["part", *group]], "start", "n")
    inside = placed.withColumn("r", F.row_number().over(Window.partitionBy("part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order])))
    on = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in ["part", *group]]
    return inside.join(starts, on).select(*df.columns, (F.col("start") + F.col("r") - 1).alias("pos"), "n")


def _roots(nodes: DataFrame) -> DataFrame:
    """nodes (g, pos, digest, n) to the roots of their blocks, as the nodes of the next level."""

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n = rows["n"][0].as_py()
        root = root_of(rows["digest"].to_pylist(), min(BLOCK_LEVELS, height(n)))
        return pa.table({"g": [key[0].as_py()], "pos": [key[1].as_py()], "digest": [root], "n": [-(-n // BLOCK)]}, schema=pa.schema([("g", pa.int64()), ("pos", pa.int64()), ("digest", pa.string()), ("n", pa.int64())]))

    return nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("block")).applyInArrow(one, "g long, pos long, digest string, n long")


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """All levels from these nodes up to one node a group; `most` is the largest group."""
    levels = [nodes]
    while most > 1:
        levels.append(written(_roots(levels[-1])))
        most = -(-most // BLOCK)
    return levels


def _down(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths (g, pos, path) of the nodes of levels[0], from those (g, path) over the groups' roots."""
    above = top.select("g", F.lit(0).cast("long").alias("pos"), "path")
    for nodes in reversed(levels[:-1]):

        def one(key: tuple, rows: pa.Table, parent: pa.Table) -> pa.Table:
            rows = rows.sort_by("pos")
            shared = [(x["left"], x["right"]) for x in parent["path"][0].as_py()]
            n = rows["n"][0].as_py()
            paths = [[{"left": a, "right": b} for a, b in path + shared] for path in walk(rows["digest"].to_pylist(), min(BLOCK_LEVELS, height(n)))]
            return pa.table({"g": rows["g"], "pos": rows["pos"], "path": pa.array(paths, PATH_ARROW)})

        blocks = nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("block"))
        above = blocks.cogroup(above.groupBy("g", F.col("pos").alias("block"))).applyInArrow(one, f"g long, pos long, path {PATH}")
    return above


def _most(df: DataFrame) -> int:
    return df.agg(F.max("n")).first()[0] or 0


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered=None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source, position of every row of docs.

    fields: the columns that a leaf covers, of which the first orders the rows of a source, the second is the source and the last is the
    text; others are ignored, whatever their names. tampered: Column, true in rows whose text is lower-cased (A-Z) before
    they are verified; by default those whose doc_id's decimal crc32 is divisible by 5. Rows of a null source are a source of their
    own, the first; null doc_ids come first in their source and are never tampered with; rows that tie are ordered by leaf, and
    rows that are equal have equal leaves and each its place. A null field is `-`, an empty text `0:`. An empty table gives none."""
    key, source, text = fields[0], fields[1], fields[-1]
    if tampered is None:
        tampered = F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
    lower = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(F.col(source).alias("source"), F.col(key).alias("key"), leaf_of([F.col(c) for c in fields]).alias("leaf"), F.when(tampered, leaf_of([*[F.col(c) for c in fields[:-1]], lower])).alias("changed"))
    rows = numbered(written(rows.withColumn("tie", F.monotonically_increasing_id())), ["source"], ["key", "leaf", "tie"])
    rows = written(rows.drop("tie"))
    sizes = rows.where("pos = 0").select("source", F.col("n").alias("size"))
    groups = written(numbered(sizes, [], ["source"]))
    named = groups.select(F.col("source").alias("s"), F.col("pos").alias("g"), "size")
    # A source's rows are many, sources few beside them: blocks, not rows, are given their source's number.
    blocks = rows.groupBy("source", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.count(F.lit(1)).alias("rows"))
    blocks = blocks.join(named, F.col("source").eqNullSafe(F.col("s"))).select(F.col("s"), F.col("block").alias("b"), "g")
    placed = written(rows.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.col("pos") / BLOCK) == F.col("b"))).select("g", "pos", F.col("leaf").alias("digest"), "n", "key", "changed"))

    levels = _levels(placed.select("g", "pos", "digest", "n"), _most(groups.select(F.col("size").alias("n"))))
    subroots = levels[-1].select("g", F.col("digest").alias("subroot"))
    tops = groups.select(F.col("pos").alias("h"), "n").join(subroots, F.col("h") == F.col("g")).select(F.lit(0).cast("long").alias("g"), F.col("h").alias("pos"), F.col("subroot").alias("digest"), "n")
    upper = _levels(written(tops), _most(groups))
    root = upper[-1].select(F.col("digest").alias("root"))
    over_sources = _down(upper, root.select(F.lit(0).cast("long").alias("g"), F.array().cast(PATH).alias("path")))
    over_sources = written(over_sources.select(F.col("pos").alias("g"), "path"))
    if len(levels) == 1:  # no source has two rows
        shared = over_sources.select("g", F.lit(0).cast("long").alias("pos"), "path")
    else:
        shared = _down(levels[1:], over_sources)
    facts = subroots.join(groups.select("source", F.col("pos").alias("g")), "g").crossJoin(root)
    shared = shared.join(facts, "g").select("g", "pos", "path", "source", "subroot", "root")
    kind = docs.schema[source].dataType.simpleString()
    key_kind = docs.schema[key].dataType.simpleString()

    def prove(_: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        path_above = [(x["left"], x["right"]) for x in above["path"][0].as_py()]
        subroot, top, n = above["subroot"][0].as_py(), above["root"][0].as_py(), rows["n"][0].as_py()
        leaves, changed = rows["digest"].to_pylist(), rows["changed"].to_pylist()
        proofs, ends = [], []
        for leaf, other, path in zip(leaves, changed, walk(leaves, min(BLOCK_LEVELS, height(n)))):
            path = path + path_above
            proofs.append(digest([x for pair in path for x in pair]))
            ends.append(folded(other or leaf, path))
        size = len(leaves)
        out = {"doc_id": rows["key"], "leaf": leaves, "subroot": [subroot] * size, "root": [top] * size, "proof_sha256": proofs, "folded_root": ends, "verified": [x == top for x in ends], "source": pa.array([above["source"][0].as_py()] * size, above.schema.field("source").type), "position": rows["pos"]}
        return pa.table(out)

    found = placed.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("block")).cogroup(shared.groupBy("g", F.col("pos").alias("block")))
    return found.applyInArrow(prove, f"doc_id {key_kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source {kind}, position long")


def oracle_sql(leaf_levels: int = 6, source_levels: int = 3) -> str:
    """DuckDB SQL of op12, for up to 16^leaf_levels rows a source: the levels and proofs by plain grouping."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*[field(c) for c in FIELDS[:-1]], field(text)]) + ")"
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    crc = "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)))"
    parts = [
        f"rowed AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN ({crc}) % 5 = 0 THEN {leaf(f'translate(text, {upper!r}, {lower!r})')} END AS changed FROM documents)",
        "n0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM rowed)",
        "t0 AS (SELECT source AS g, pos, leaf AS digest, n FROM n0)",
        "p0 AS (SELECT doc_id, source AS g, pos AS leaf_pos, leaf, '' AS proof, coalesce(changed, leaf) AS cur FROM n0)",
    ]

    def climb(tree: str, path: str, levels: int, key: str) -> None:
        for k in range(levels):
            parts.append(f"{tree}r{k} AS (SELECT g, pos // 16 AS run, any_value(n) AS n, list(digest ORDER BY pos) AS digests FROM {tree}{k} GROUP BY ALL)")
            parts.append(f"{tree}{k + 1} AS MATERIALIZED (SELECT g, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(digests, '')) ELSE digests[1] END AS digest, (n + 15) // 16 AS n FROM {tree}r{k})")
            at = f"({key} // {16**k}) % 16"
            left, right = f"array_to_string(r.digests[1:{at}], '')", f"array_to_string(r.digests[{at} + 2:], '')"
            parts.append(f"{path}{k + 1} AS (SELECT p.* EXCLUDE (proof, cur), CASE WHEN r.n > 1 THEN p.proof || {left} || {right} ELSE p.proof END AS proof, CASE WHEN r.n > 1 THEN sha256({left} || p.cur || {right}) ELSE p.cur END AS cur FROM {path}{k} p JOIN {tree}r{k} r ON r.g IS NOT DISTINCT FROM p.g AND r.run = {key} // {16 ** (k + 1)})")

    climb("t", "p", leaf_levels, "p.leaf_pos")
    parts.append(f"s AS MATERIALIZED (SELECT g AS source, digest AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t{leaf_levels})")
    parts.append("u0 AS (SELECT 0 AS g, pos, subroot AS digest, n FROM s)")
    parts.append(f"q0 AS (SELECT p.* EXCLUDE (g), 0 AS g, s.source, s.subroot, s.pos AS source_pos FROM p{leaf_levels} p JOIN s ON s.source IS NOT DISTINCT FROM p.g)")
    climb("u", "q", source_levels, "p.source_pos")
    return f"WITH {', '.join(parts)} SELECT q.doc_id, q.leaf, q.subroot, u.digest AS root, sha256(q.proof) AS proof_sha256, q.cur AS folded_root, q.cur = u.digest AS verified, q.source, q.leaf_pos AS position FROM q{source_levels} q CROSS JOIN u{source_levels} u"
