"""Nearest neighbours from a permutation index: vectors as their nearest pivots in order, in inverted files by pivot."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import cut, written

#: Pivots, how many of its nearest a vector is known by, and the files of how many of its nearest a query visits.
PIVOTS, NEAREST, LISTS = 512, 96, 32
#: Vectors of an index block, and the share of them whose scores are computed after ranking by footrule distance: FEWEST at least, or
#: half of a smaller block.
BLOCK, RERANK, FEWEST = 8192, 0.0625, 512
#: Queries that one task brings to a block.
QUERIES = 4096


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, which have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class InvertedFiles:
    """One block of vectors. For each pivot, the vectors that have it among their `nearest`, and its place there.

    The footrule distance of two orders of `nearest` pivots, where a missing one counts as at place `nearest`, is a
    constant less 2 * sum over shared pivots of (nearest - the later place). A query adds these along the files of its first
    `lists` pivots, where a shared pivot counts most.
    """

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, reach: float, nearest: int, lists: int = LISTS) -> None:
        self.vectors, self.pivots, self.nearest = vectors.astype(np.float64), pivots, min(nearest, len(pivots))
        self.lists = min(lists, self.nearest)
        rest = np.sqrt(np.maximum(reach**2 - (self.vectors**2).sum(axis=1), 0))
        order = self.order(np.column_stack([self.vectors, rest]))
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows = (by // self.nearest).astype(np.int32)
        self.places = (by % self.nearest).astype(np.int32)
        self.begin = np.searchsorted(flat[by], np.arange(len(pivots) + 1))

    def order(self, lifted: np.ndarray) -> np.ndarray:
        near = lifted @ self.pivots.T
        first = np.argpartition(-near, self.nearest - 1, axis=1)[:, : self.nearest]
        return np.take_along_axis(first, np.argsort(-np.take_along_axis(near, first, axis=1), axis=1, kind="stable"), axis=1)

    def search(self, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the `most` rows nearest by footrule distance, and their inner products."""
        q = queries.astype(np.float64)
        for vector, pivots in zip(q, self.order(np.column_stack([q, np.zeros(len(q))]))):
            if most < len(self.vectors):
                files = [slice(self.begin[p], self.begin[p + 1]) for p in pivots[: self.lists]]
                place = np.repeat(np.arange(self.lists, dtype=np.int32), [f.stop - f.start for f in files])
                later = np.maximum(np.concatenate([self.places[f] for f in files]), place)
                gain = np.bincount(np.concatenate([self.rows[f] for f in files]), self.nearest - later, len(self.vectors))
                rows = np.argpartition(-gain, most)[:most]
            else:
                rows = np.arange(len(self.vectors))
            yield rows, self.vectors[rows] @ vector


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, nearest_pivots: int = NEAREST, block: int = BLOCK, rerank: float = RERANK, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of rows(vec_id, embedding), by largest inner product, in
    double precision, ties to the smaller vec_id, without the query's own vec_id.

    Equal vectors are indexed once and carry their k + 1 smallest ids, all that a result can name; so a vector that many
    rows share is neither a hot key nor a crowd in the result. The index is cut into blocks of about `block` vectors by
    hash. Each holds inverted files over `pivots` pivots; every distinct query vector visits every block, in it the files of its
    `lists` nearest pivots, ranks the vectors found there by footrule distance, scores the nearest share `rerank` of the block,
    FEWEST at least or half of a block that has few, exactly, and leaves its k + 1 best. rerank=1 scores all: the exact way. Queries come to a block in parts of
    about QUERIES, a task for each. Pivots are a sample of fixed size, the vectors of least hash. Inner product is turned to
    nearness by one more coordinate.

    Vectors null, empty, zero or with null or non-finite components take no part, nor do null ids or vectors whose length
    isn't the table's most frequent (of several the longest). A row repeated with one id and vector counts once. Fewer
    than k candidates give fewer rows; no rows or queries give none. Other columns are not read.
    """
    # As they are stored: single precision where both tables have it, else double, in which all scores are computed.
    single = all(dict(t.dtypes)["embedding"] == "array<float>" for t in (rows, queries))
    vector = F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding")
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    lengths = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    spark = rows.sparkSession
    if lengths is None:
        return spark.createDataFrame([], empty)
    fits = F.size("embedding") == lengths["n"]
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    ids = good.where(fits).distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    classes = written(ids.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("id", F.col("ids")[0]))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, reach = classes.agg(F.count("*"), F.max(norm)).first()
    sample = classes.orderBy(F.xxhash64("embedding"), "id").limit(pivots).select("embedding").collect()
    base = np.array([r[0] for r in sample], np.float64)
    base = np.column_stack([base, np.sqrt(np.maximum(reach**2 - (base**2).sum(axis=1), 0))])
    base /= np.linalg.norm(base, axis=1, keepdims=True)

    blocks = -(-n // block)
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), vector)
    asked = asked.where(usable(F.col("embedding")) & F.col("query_id").isNotNull() & fits).distinct()
    vectors = asked.groupBy("embedding").agg(F.min("query_id").alias("q"))
    vectors = cut(vectors)
    parts = -(-vectors.count() // QUERIES) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    stored = classes.select(of(blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("kind"), "id", "embedding", "ids")
    asking = vectors.withColumn("id", F.col("q")).select(every(blocks).alias("block"), of(parts).alias("part"), F.lit(1).alias("kind"), "id", "embedding", F.array().cast("array<long>").alias("ids"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, files, ids = None, None, None
        for batch in batches:
            block_of, kind_of = batch["block"].to_numpy().astype(np.int64) * parts + batch["part"].to_numpy(), batch["kind"].to_numpy()
            edges = np.flatnonzero(np.diff(block_of * 2 + kind_of)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(batch)]):
                part = batch.slice(lo, hi - lo)
                if block_of[lo] != now:
                    now, files, held = block_of[lo], None, []
                if kind_of[lo] == 0:
                    held.append(part)
                    continue
                if not held and files is None:
                    continue
                if files is None:
                    files = InvertedFiles(np.concatenate([_matrix(p["embedding"]) for p in held]), base, reach, nearest_pivots, lists)
                    ids = [x for p in held for x in p["ids"].to_pylist()]
                    held = []
                most = max(2 * (k + 1), min(FEWEST, -(-len(ids) // 2)), int(np.ceil(rerank * len(ids))))
                out: list[list] = [[], [], []]
                for q, (at, score) in zip(part["id"].to_pylist(), files.search(_matrix(part["embedding"]), most)):
                    if len(at) > k + 1:  # all that tie with the last stay
                        least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                        at, score = at[score >= least], score[score >= least]
                    best = sorted(((-s, v) for a, s in zip(at.tolist(), score.tolist()) for v in ids[a]))[: k + 1]
                    out[0] += [q] * len(best)
                    out[1] += [v for _, v in best]
                    out[2] += [-s for s, _ in best]
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["q", "vec_id", "score"])

    placed = stored.unionByName(asking).repartition(max(1, blocks * parts), "block", "part").sortWithinPartitions("block", "part", "kind")
    found = placed.mapInArrow(searched, "q long, vec_id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = cut(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"))
    names = asked.join(vectors, "embedding").select("query_id", "q")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = names.join(top, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
