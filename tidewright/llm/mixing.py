"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import WORD, cut, fresh

#: Weights of the sources, dealt by code point again and again.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and most passes over a source.
SHARE, PASSES = 1.5, 2
#: Ranges into which a source's shuffle order, and all virtual finish times, are cut for running sums.
RANGES = 4096
#: Bytes of the sources' table, names and cuts, up to which it is sent to all tasks; and the parts a source is dealt into beyond.
MAX_BROADCAST, SALTS = 8_000_000, 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def shuffle_key(doc_id: Column, seed: int = 7) -> Column:
    """A document's place in its source's shuffle, the same at each run."""
    return F.xxhash64(F.lit(seed), doc_id)


def _range_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - 12).cast("int")


def _unsigned(key: Column) -> Column:
    """Orders as the unsigned key does, as _range_of is of its top bits."""
    return key.bitwiseXOR(F.lit(-(2**63)))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """source, source_size, target for one row per source of sizes(source, source_size).

    Sources by code point, null last, weigh as weights, repeating. They divide share * all sizes by weight; none gets over
    passes * its size, and what is over is shared again. With sources in order of their cap per weight, those before some
    place are at their caps; the others divide the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    level = F.col("cap") / F.col("weight")
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before, onward, every = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(passes))
        .withColumn("level", level)
        .withColumn("total", F.sum("source_size").over(every) * float(share))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("water", F.col("rest") / F.sum("weight").over(onward))
    )
    # the first source whose cap stands above the water is the first that isn't full; its water holds for all after it
    held = F.min(F.when(F.col("water") < F.col("level"), F.struct("level", "source", "water"))).over(every)
    full = F.coalesce(F.col("level") < held["level"], F.lit(True)) | (F.col("level") <= held["water"])
    return filled.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("weight") * held["water"]).alias("target"))


def fair_queue(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per source: source, source_size, target, and cuts, an array with each pass's last place that the mix admits.

    Each source is a flow whose documents queue in shuffled order, pass after pass. A document's virtual finish time is
    the words of its source up to and with it, divided by the source's target. The mix is the documents in order of
    finish time, until share * all sizes are taken. Running sums are taken within ranges of the shuffle order or of
    finish times and added to the sums of the ranges before, so no task holds a whole source. In a source, order by
    finish time is order by (key, doc_id): the mix admits a prefix of each pass, which its last place describes.
    """
    # two columns a document leave the scan of texts; a running sum needs one shuffle of these
    sized = docs.select("source", "doc_id", words(F.col("text")).alias("size")).withColumn("key", shuffle_key(F.col("doc_id")))
    sized = cut(sized.withColumn("range", _range_of(F.col("key"))).repartition("source", "range"))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    in_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut(ranges.withColumn("before", F.coalesce(F.sum("sum").over(in_source), F.lit(0).cast("long"))))
    aims = cut(targets(ranges.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, passes))
    offsets = ranges.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "range", "before", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("place", F.struct(_unsigned(F.col("key")).alias("k"), F.col("doc_id").alias("d")))
    run = placed.withColumn("sum", F.sum("size").over(within))
    o = offsets.select(F.col("source").alias("s"), F.col("range").alias("r"), "before", "source_size", "target")
    run = run.join(o, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    finish = lambda p: (F.col("before") + F.col("sum") + F.lit(p) * F.col("source_size")) / F.col("target")
    copies = run.where(F.col("target") > 0).select("source", "place", "size", F.posexplode(F.array(*[finish(p) for p in range(passes)])).alias("turn", "finish"))
    # a finish time is at most passes * size / target, and few pass 1 by much: what lies beyond shares the last range
    timed = cut(copies.withColumn("range", F.least(F.floor(F.col("finish") * RANGES), F.lit(2 * RANGES)).cast("int")))
    steps = timed.groupBy("range").agg(F.sum("size").alias("sum"))
    steps = steps.withColumn("upto", F.sum("sum").over(Window.orderBy("range")))
    budget = aims.agg((F.sum("source_size") * float(share)).alias("budget"))
    steps = steps.crossJoin(F.broadcast(budget))  # one row
    edge = steps.where(F.col("upto") > F.col("budget")).agg(F.min(F.struct("range", (F.col("budget") - F.col("upto") + F.col("sum")).alias("left"))).alias("edge"))
    at = timed.crossJoin(F.broadcast(edge))  # one row
    whole = at.where(F.col("edge").isNull() | (F.col("range") < F.col("edge.range")))
    # what finishes in the last range, be it every document of sources of one document, in ranges of its own full order
    order = F.struct("finish", F.col("source").isNull().alias("none"), "source", "turn", "place")
    part = at.where(F.col("range") == F.col("edge.range")).withColumn("order", order).repartitionByRange("order")
    part = cut(part.withColumn("piece", F.spark_partition_id()))
    pieces = part.groupBy("piece").agg(F.sum("size").alias("sum"))
    pieces = pieces.select(F.col("piece").alias("at"), (F.sum("sum").over(Window.orderBy("piece")) - F.col("sum")).alias("before"))
    in_piece = Window.partitionBy("piece").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("so_far", F.sum("size").over(in_piece)).join(F.broadcast(pieces), F.col("piece") == F.col("at"))  # a row for each partition
    part = part.where(F.col("before") + F.col("so_far") - F.col("size") / 2 <= F.col("edge.left"))
    last = whole.select("source", "turn", "place").unionByName(part.select("source", "turn", "place"))
    last = last.groupBy("source").agg(*[F.max(F.when(F.col("turn") == p, F.col("place"))).alias(f"cut{p}") for p in range(passes)])
    last = last.withColumnRenamed("source", "s")
    return cut(aims.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", F.array(*[F.col(f"cut{p}") for p in range(passes)]).alias("cuts")))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """docs with size, source_size, target, copies (times that the mix holds the row) and taken (words: copies * size).

    Text null or empty: size 0, which the mix takes whenever its place is admitted. Repeated rows share their place and
    so their fate. A null source is a source of its own, the last. An empty table gives an empty mix. Columns of docs
    named as results are replaced.
    """
    results = ["size", "source_size", "target", "copies", "taken"]
    carried = [c for c in docs.columns if c not in results]
    spark, kept = docs.sparkSession, docs.select(*carried)
    name, flow, place, salt = (fresh(x, docs) for x in ("__source", "__flow", "__place", "__salt"))
    flows = fair_queue(docs, weights, share, passes).select(F.col("source").alias(name), F.struct("source_size", "target", "cuts").alias(flow))
    at = F.struct(_unsigned(shuffle_key(F.col("doc_id"))).alias("k"), F.col("doc_id").alias("d"))
    sized = kept.withColumns({"size": words(F.col("text")), place: at})
    same = F.col("source").eqNullSafe(F.col(name))
    bytes_of = flows.agg(F.sum(64 * (1 + passes) + F.coalesce(F.octet_length(name), F.lit(0)))).first()[0] or 0
    if bytes_of <= MAX_BROADCAST:
        both = sized.join(F.broadcast(flows), same, "left")
    else:  # each source in SALTS parts, so that none is one task's
        dealt = flows.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        of = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        both = sized.join(dealt, same & (of == F.col(salt)), "left")
    copies = F.aggregate(F.col(flow)["cuts"], F.lit(0), lambda n, c: n + F.when(F.col(place) <= c, 1).otherwise(0))
    both = both.withColumn("copies", copies)
    return both.select(*carried, "size", F.col(flow)["source_size"].alias("source_size"), F.col(flow)["target"].alias("target"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
