"""Near-duplicate groups: MinHash signatures joined within a Hamming distance by multiple indexes, links confirmed on full shingle sets."""

from __future__ import annotations

import math
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, fresh, written

#: Words of a shingle.
SHINGLE = 5
#: Symbols of a signature, 16 bits each.
SYMBOLS = 64


def distance(percent: int, symbols: int = SYMBOLS) -> int:
    """The largest number of symbols in which linked documents may differ: a pair at similarity percent / 100 differs in more
    with probability under 1e-7."""
    p, over = 1 - percent / 100, 0.0
    for d in range(symbols, 0, -1):
        over += math.comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
        if over >= 1e-7:
            return d
    return 0


def chunks_of(most: int) -> int:
    """Chunks such that `most` differences leave one with at most one: 14 for 27, 16 for 31."""
    return most // 2 + 1


#: Of the similarity that operator 10 asks for.
DISTANCE = distance(85)
CHUNKS = chunks_of(DISTANCE)
#: Rows of a block of a bucket whose pairs are compared in one task.
BLOCK = 256

#: Places of the bitmap that keeps most texts without a partner out of the exchange, as a power of two, at most (4 MB).
BITMAP = 25

_WORDS_KEPT = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SALTS = _mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(raw: bytes, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text; of the whole sequence if it has fewer words."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash symbols (rows, SYMBOLS) of non-empty sets that stand one after another; 16 bits of each minimum."""
    out = np.empty((len(starts), SYMBOLS), np.uint16)
    for k, salt in enumerate(_SALTS):
        h = (shingles ^ salt) * salt
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        least = np.minimum.reduceat(h, starts)
        out[:, k] = (_mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: its tag, number of shingles, two hashes of the whole set, signature."""
    hashes = _Hashes()
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            if len(hashes) > _WORDS_KEPT:
                hashes.clear()
            sets = [shingle_set((x or "").encode(), hashes) for x in part["text"].to_pylist()]
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            sums = [(0, 0)] * len(sets)
            sigs: list[bytes | None] = [None] * len(sets)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                one, two = np.add.reduceat(_mix(flat), starts).view(np.int64), np.add.reduceat(_mix(flat ^ np.uint64(0xD6E8FEB86659FD93)), starts).view(np.int64)
                for i, a, b, s in zip(some, one.tolist(), two.tolist(), signatures(flat, starts)):
                    sums[i], sigs[i] = (a, b), s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["tag"], pa.array(sizes, pa.int64()), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "tag", "n_shingles", "set1", "set2", "sig"],
            )


def _chunks(chunks: int = CHUNKS) -> list[np.ndarray]:
    return np.array_split(np.arange(SYMBOLS), chunks)


def _keys(chunks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every chunk of every signature with each of its symbols left out in turn: two chunks with at most one difference
    share one of these keys."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                sig = np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
                out, at_place = [], np.repeat(np.arange(SYMBOLS, dtype=np.int32), len(sig))
                for c, places in enumerate(_chunks(chunks)):
                    for p in places:
                        h = np.full(len(sig), (c << 8) + int(p) + 1, np.uint64)
                        for q in places:
                            if q != p:
                                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, q])
                        out.append(h.view(np.int64))
                node = np.tile(part["node"].to_numpy(), len(out))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(at_place), pa.array(node)], names=["key", "place", "node"])

    return keys


def _bound(percent: int, n_a, own_a, n_b, own_b):
    """Whether sets of so many shingles, so many of which no other candidate has, can be similar enough."""
    most = np.minimum(n_a - own_a, n_b - own_b)
    return 100 * most >= percent * (n_a + n_b - most)


def _near(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sig_a", "sig_b"))
            keep = pa.array((a != b).sum(axis=1) <= most)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return near


def parities(shingles: np.ndarray) -> bytes:
    """A bit for each of 4 to 8 places a shingle, set where an odd number of the set's shingles fall. Two sets' bits differ in no
    more places than the sets have shingles apart, and in nearly as many while these are few."""
    bits = 1 << max(3, (4 * len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For pairs of parities() the places in which they differ. The longer is folded to the shorter's length, as places are
    low bits of hashes."""
    out, sizes = np.zeros(len(a), np.int64), np.array([list(map(len, a)), list(map(len, b))])
    for x, y in np.unique(sizes, axis=1).T.tolist():
        (at,) = np.nonzero((sizes[0] == x) & (sizes[1] == y))
        both = [np.frombuffer(b"".join([of[i] for i in at]), np.uint8).reshape(len(at), -1, min(x, y)) for of in (a, b)]
        out[at] = np.bitwise_count(np.bitwise_xor.reduce(both[0], axis=1) ^ np.bitwise_xor.reduce(both[1], axis=1)).sum(axis=1, dtype=np.int64)
    return out


def _possible(percent: int, n_a, n_b, odd_a: list[bytes], odd_b: list[bytes]) -> np.ndarray:
    """Whether sets of so many shingles and these parities can be similar enough: with d of both sets' n shingles in one only,
    the similarity is (n - d) / (n + d). No pair that is similar enough is left out."""
    keep = np.zeros(len(odd_a), bool)
    for lo in range(0, len(keep), 4096):
        part = slice(lo, lo + 4096)
        least = np.maximum(apart(odd_a[part], odd_b[part]), np.abs(n_a[part] - n_b[part]))
        keep[part] = (100 + percent) * least <= (100 - percent) * (n_a[part] + n_b[part])
    return keep


def _bitmap(met: DataFrame) -> np.ndarray:
    """Bits of met(doc_id) by the ids' low bits: 16 places an id, but no more than BITMAP allows."""
    places = 1 << min(BITMAP, max(15, (16 * met.count()).bit_length()))
    at = (F.pmod("doc_id", F.lit(places)) + 1).alias("at")
    parts = met.select(at).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((places >> 15, 1 << 12), np.uint8)
    for row in parts.toLocalIterator():
        out[row["part"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _perhaps(bits):
    """Rows of which the bitmap has the id."""

    def perhaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            at = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False) & (8 * len(known) - 1)
            yield batch.filter(pa.array((known[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return perhaps


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            if len(hashes) > _WORDS_KEPT:
                hashes.clear()
            sets = [shingle_set((x or "").encode(), hashes) for x in part["text"].to_pylist()]
            columns = [pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(map(parities, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], names=["node", "shingles", "n", "odd"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set."""
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            sets = [np.frombuffer(x, np.int64) for x in part["shingles"].to_pylist()]
            node = np.repeat(part["node"].to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(node)], names=["shingle", "node"])


def _likely(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(_possible(percent, *(batch[c].to_numpy() for c in ("n_a", "n_b")), *(batch[c].to_pylist() for c in ("odd_a", "odd_b"))))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return likely


def _confirmed(percent: int):
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])

    return confirmed


def _with_parities(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their parities allow: full sets, many times longer, travel for these only."""
    odd = near
    for c in ("b", "a"):
        odd = odd.join(sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")), c)
    return written(odd.select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(_likely(percent), "a long, b long").distinct())


def _links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    full = near
    for c in ("b", "a"):
        full = full.join(sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")), c)
    return cut(full.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a long, b long").distinct())


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it reaches) for every node of links(a, b), by alternating large and small stars.

    Each round groups by node, with partial minima, and hangs every neighbour on the least one. A hub's neighbours are
    never gathered in one row. It ends when a round changes no edge; paths shorten by a constant factor each round.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)

    def large(e: DataFrame) -> DataFrame:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        hung = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        edges = cut(small(large(edges)))
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _first_place(differ: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """For pairs whose symbols differ as marked: the symbol left out in the first key that they share."""
    starts = np.array([c[0] for c in _chunks(chunks)])
    chunk = (np.add.reduceat(differ, starts, axis=1, dtype=np.int64) <= 1).argmax(axis=1)
    inside = differ & (np.repeat(np.arange(chunks), [len(c) for c in _chunks(chunks)]) == chunk[:, None])
    return np.where(inside.any(axis=1), inside.argmax(axis=1), starts[chunk])


def _bucket_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs that can be linked within each bucket of members(key, node, component, sig, odd, n, own), but for those of one
    component.

    Members of a bucket's largest component need no comparison among themselves: only the others, the strays, meet all. Both
    are dealt into blocks of about BLOCK, and every block of strays meets every block in one task that compares counts,
    signatures and parities and returns the near pairs only: neither a bucket's rows nor its pairs are gathered. A bucket of one block
    stays whole. Of the buckets that a pair shares only that of _first_place() returns it.
    """
    furthest = distance(percent)
    chunks = chunks_of(furthest)
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("rows"))
    sizes = sizes.groupBy("key").agg(F.sum("rows").alias("rows"), F.max(F.struct("rows", "component")).alias("large"))
    whole = F.col("rows") <= BLOCK
    blocks = lambda rows: F.ceil(rows / BLOCK).cast("int")
    dealt = members.join(sizes, "key").withColumn("stray", whole | (F.col("component") != F.col("large.component")))
    dealt = dealt.withColumn("strays", F.when(whole, 1).otherwise(blocks(F.col("rows") - F.col("large.rows")))).withColumn("others", F.when(whole, 0).otherwise(blocks(F.col("large.rows"))))
    turn = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("stray"), turn(F.col("strays"))).otherwise(F.col("strays") + turn(F.greatest("others", F.lit(1)))))
    other = F.sequence(F.lit(0), F.col("strays") + F.when(F.col("stray"), F.col("others")).otherwise(0) - 1)
    meets = dealt.withColumn("with", F.explode(other)).select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "place", "node", "component", "sig", "odd", "n", "own")

    def near(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        odd = table["odd"].to_pylist()
        node, comp, block, n, own = (table[c].to_numpy() for c in ("node", "component", "block", "n", "own"))
        i, j = key[1].as_py(), key[2].as_py()
        place = table["place"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [], []
        for x in left:
            fits = (comp[right] != comp[x]) & _bound(percent, n[x], own[x], n[right], own[right])
            y = right[fits if i != j else fits & (right > x)]
            if len(y):
                differ = sig[y] != sig[x]
                y = y[(differ.sum(axis=1) <= furthest) & (_first_place(differ, chunks) == place)]
                y = y[_possible(percent, n[x].repeat(len(y)), n[y], [odd[x]] * len(y), [odd[i] for i in y])]
                a.append(np.minimum(node[x], node[y]))
                b.append(np.maximum(node[x], node[y]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return meets.groupBy("key", "i", "j").applyInArrow(near, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    A document's set is its distinct 5-word shingles, A-Z lower-cased; with fewer words the whole sequence. Documents with
    100 * intersection >= percent * union are linked; component_id is the least doc_id reachable.

    1. Documents with equal sets form one node, named by the least doc_id. 2. Nodes whose signatures differ in at most
    distance(percent) symbols share a key of a chunk with one symbol left out, and meet in its bucket. 3. For the nodes in buckets,
    shingles that no other of them has are counted: these bound what a node can share, and a node with too many is linked
    with none. 4. In each bucket the node with the smallest such share, which in a group of copies is the nearest to what
    they were copied from, is compared with the others; pairs that parities
    of their shingles allow are confirmed on full sets and joined to components. 5. Where
    nodes of one bucket still lie in different components, those outside its largest are compared with all others too, in
    blocks, and the pairs that counts, signatures and parities of their shingles allow are confirmed. So no link within the distance is lost, and a large group of copies costs
    about one comparison a member and bucket.

    Empty and null texts: no shingles, linked with nothing. A null doc_id is its own component (null). Rows repeated under
    one doc_id are one document if their texts have one set. Other columns are not read.
    """
    return _grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("tag")), percent).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each near-duplicate group of the rows of docs(doc_id, text ...), linked as in near_duplicates().

    It is the row of least doc_id, null ones last; of several such, as of rows repeated under one doc_id, the one whose values
    decide. Rows of one doc_id whose texts aren't linked are in groups of their own. Texts without shingles are linked with
    nothing; of those one row stays under each doc_id, and one under null.
    """
    names = [fresh(x, docs) for x in ("__hash", "__id", "__none")]
    hash_name, id_name, none_name = names
    columns = [F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.col("doc_id").isNull()]
    rows = docs.withColumns(dict(zip(names, columns)))
    # texts, not doc_ids, name the nodes
    grouped = _grouped(rows.select(F.col(hash_name).alias("doc_id"), "text", F.when(~F.col(none_name), F.col(id_name)).alias("tag")), percent)
    some = F.col("n_shingles") > 0
    keys = [F.col("doc_id").alias(hash_name), F.coalesce("tag", F.lit(0).cast("long")).alias(id_name), F.col("tag").isNull().alias(none_name)]
    found = grouped.select(*keys, some.alias("some"), F.when(some, F.col("component_id")).otherwise(F.coalesce("tag", F.lit(0))).alias("group"), (~some & F.col("tag").isNull()).alias("lost"))
    found = written(found.groupBy(*names, "some", "group", "lost").agg(F.count("*").alias("rows")))
    best = found.groupBy("some", "group", "lost").agg(F.min(F.struct(none_name, id_name, hash_name)).alias("best"))
    judged = written(found.join(best, ["some", "group", "lost"]).select(*names, "rows", (F.struct(none_name, id_name, hash_name) == F.col("best")).alias("first")))
    single = rows.join(judged.where("not first or rows > 1").select(*names), names, "left_anti").select(*docs.columns)
    again = rows.join(judged.where("first and rows > 1").select(*names), names, "left_semi")
    return single.unionByName(again.groupBy(*names).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))


def _grouped(known: DataFrame, percent: int) -> DataFrame:
    """near_duplicates() of known(doc_id, text, tag), with each row's tag and the hashes of its set."""
    furthest = distance(percent)
    profile = written(known.mapInArrow(_profiles, "doc_id long, tag long, n_shingles long, set1 long, set2 long, sig binary"))
    named = profile.where("n_shingles > 0 and doc_id is not null")
    nodes = written(named.groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")))
    keys = nodes.select("node", "sig").mapInArrow(_keys(chunks_of(furthest)), "key long, place int, node long").repartition("key")
    # place is asked for too, so that both readers of the keys have the same columns and share one exchange
    shared = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("place").alias("place")).where("lo < hi and place >= 0").select("key")
    bucket = written(keys.join(shared, "key"))
    met = written(bucket.select(F.col("node").alias("doc_id")).distinct())
    perhaps = known.select("doc_id", "text").mapInArrow(_perhaps(known.sparkSession.sparkContext.broadcast(_bitmap(met))), "doc_id long, text string")
    texts = perhaps.join(met, "doc_id", "left_semi").distinct()  # a node's copies are one set
    sets = written(texts.mapInArrow(_sets, "node long, shingles binary, n long, odd binary"))
    lone = sets.mapInArrow(_shingles, "shingle long, node long").groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    lone = lone.where(F.col("node") == F.col("last")).groupBy("node").agg(F.count("*").alias("own"))
    counts = nodes.select("node", F.col("n_shingles").alias("n"), "sig").join(met.withColumnRenamed("doc_id", "node"), "node").join(lone, "node", "left")
    able = written(counts.withColumn("own", F.coalesce("own", F.lit(0).cast("long"))).where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")))

    placed = written(bucket.join(able.select("node", "n", "own", "sig"), "node"))
    center = placed.groupBy("key").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("part"), "node", "n", "own", "sig")).alias("c"))
    star = placed.join(center, "key").where("node <> c.node")
    most = F.least(F.col("n") - F.col("own"), F.col("c.n") - F.col("c.own"))
    star = star.where(100 * most >= percent * (F.col("n") + F.col("c.n") - most))
    # signatures come along: a pair's are compared where its bucket meets, and only near pairs go on
    star = star.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"), F.col("sig").alias("sig_a"), F.col("c.sig").alias("sig_b"))
    star = written(star.mapInArrow(_near(furthest), "a long, b long").distinct())
    links = _links(_with_parities(star, sets, percent), sets, percent)
    first = written(components(links))
    grouped = placed.select("key", "place", "node").join(first, "node", "left").select("key", "place", "node", F.coalesce("component", "node").alias("component"))
    open_keys = grouped.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = written(grouped.join(open_keys, "key").join(able, "node"))
    rest = rest.join(sets.select("node", "odd").dropDuplicates(["node"]), "node")
    more = _bucket_pairs(rest, percent).join(star, ["a", "b"], "left_anti")
    links = links.unionByName(_links(cut(more), sets, percent))
    final = components(links)
    owner = nodes.join(final, "node", "left").select("set1", "set2", "n_shingles", F.coalesce("component", "node").alias("component"))
    out = profile.join(owner, ["set1", "set2", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "tag", "set1", "set2", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
