"""Phrases of up to four words that hold together, by hierarchical pair naming.

Texts become blocks of local codes, kept as one table that is bucketed by block, so that it is never exchanged. At level 1 a block asks
once for each of its words, at level k once for each pair of adjacent frequent (k-1)-grams that overlap in k-2 words. Requests
travel packed, a row a block and bucket of keys; buckets are as many as keep each in a bound, and a key's commonest case is one request
a block. Pairs of one left phrase and a unit of right ones share a bucket and are told by steps. A bucket sums its keys' counts and
names the frequent ones, the most frequent by the smallest numbers, and the names go back to the blocks, packed as well, by their
places among what was asked. A phrase's two names of the level below are its parents: cuts and the phrases inside it are found along them. No dictionary is
broadcast, and tokens aren't exchanged, but a block's distinct pairs."""

from __future__ import annotations

import string
import uuid
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import shared_dir, written

#: Tokens of a block, at least, and of all blocks behind one bucket of requests, at most.
BLOCK, BUCKET = 1 << 22, 1 << 21
#: Bits of the right names that share a bucket with one left name, at most. Each block may ask for all of these, so with many blocks
#: they are fewer, and a unit stays in a quarter of a bucket's tokens.
UNIT_BITS = 14
#: Tokens of a long text that are coded at a time, and characters of it that are split at a time.
SEGMENT, SLICE = 1 << 16, 1 << 18
BREAKS = ".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans((string.ascii_uppercase + BREAKS).encode(), (string.ascii_lowercase + "." * len(BREAKS)).encode())
_WHITE = b" \t."


def _slices(text: str, size: int) -> Iterator[bytes]:
    """The text's bytes, lower-cased and with `.` for every break, in slices that end at white space or a break."""
    rest = []
    for i in range(0, len(text), size):
        part = text[i : i + size].encode().translate(_TABLE)
        cut = max(part.rfind(bytes([c])) for c in _WHITE) + 1
        if cut:
            yield b"".join([*rest, part[:cut]])
            rest = []
        rest.append(part[cut:])
    yield b"".join(rest)


def _segments(text: str, ahead: int, segment: int, size: int) -> Iterator[tuple[list[bytes], int]]:
    """Tokens of a text, `.` between pieces, in segments with the number of those that are its own: the last `ahead` are the next
    segment's first ones, so that every phrase that begins in a segment is whole."""
    held: list[bytes] = []
    for part in _slices(text, size):
        held += part.replace(b".", b" . ").split()
        while len(held) >= segment + ahead:
            yield held[: segment + ahead], segment
            held = held[segment:]
    if held:
        yield held, len(held)


class _Block:
    """Codes of a block's tokens (-1 at breaks), which of them are counted, and the words behind the codes."""

    def __init__(self):
        self.codes, self.own, self.words, self.size, self.next = [], [], {}, 0, count()

    def add(self, lang: str, tokens: list[bytes], own: int) -> None:
        known = self.words.setdefault(lang, {b".": -1})
        fresh = [w for w in dict.fromkeys(tokens) if w not in known]
        known.update(zip(fresh, self.next))
        self.codes.append(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))
        self.codes.append(np.array([-1], np.int32))
        mine = np.ones(len(tokens) + 1, np.uint8)
        mine[own:] = 0
        self.own.append(mine)
        self.size += len(tokens)


def _fields(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


#: A block's codes (with which of them are its own), or its packed requests of a bucket.
BLOCKS = _fields(block=pa.int64(), bucket=pa.int64(), n=pa.int64(), codes=pa.binary(), own=pa.binary(), lang=pa.string(), start=pa.int64(), left=pa.binary(), right=pa.binary(), cnt=pa.binary())
#: A block's packed names of a level, told by their numbers within a bucket and places of a request, or a named phrase.
NAMES = _fields(block=pa.int64(), level=pa.int64(), bucket=pa.int64(), n=pa.int64(), codes=pa.binary(), ids=pa.binary(), id=pa.int64(), lang=pa.string(), word=pa.binary(), left=pa.int64(), right=pa.int64(), f=pa.int64())


def _rows(schema: pa.Schema, many: int, **columns) -> pa.Table:
    return pa.table([columns[f.name] if f.name in columns else pa.nulls(many, f.type) for f in schema], schema=schema)


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int64(): 'long', pa.string(): 'string', pa.binary(): 'binary'})[f.type]}" for f in schema)


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 as compressed planes of their bytes, after the number of planes."""
    values = np.ascontiguousarray(values, "<u8")
    planes = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    bytes_of = values.view(np.uint8).reshape(-1, 8)[:, :planes]
    return bytes([planes]) + pa.compress(bytes_of.T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = packed[0]
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :planes] = np.frombuffer(pa.decompress(packed[1:], decompressed_size=planes * n, codec="zstd", asbytes=True), np.uint8).reshape(planes, n).T
    return wide.view("<u8").ravel().astype(np.int64)


def _steps(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of ascending pairs: the right side of the first with each left, then how much it rises."""
    out = np.diff(right, prepend=0)
    first = np.diff(left, prepend=-1) != 0
    out[first] = right[first]
    return out


def _rights(left: np.ndarray, steps: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.diff(left, prepend=-1))
    sums = np.cumsum(steps)
    return sums - np.repeat(sums[first] - steps[first], np.diff(first, append=len(left)))


def _unit(blocks: int, bucket: int) -> int:
    """Bits of a unit of right names."""
    return min(UNIT_BITS, max(1, bucket // (4 * max(1, blocks))).bit_length() - 1)


def _bits(own: np.ndarray) -> bytes:
    return pa.compress(np.packbits(own).tobytes(), codec="zstd", asbytes=True)


def _blocks(batches: Iterator[pa.RecordBatch], ahead: int, sizes: tuple[int, ...], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition's texts, one row each with its codes, then its words: a row a language and bucket."""
    serial, block = count(TaskContext.get().partitionId() << 24), _Block()

    def done() -> Iterator[pa.Table]:
        number = next(serial)
        codes, own = np.concatenate(block.codes), np.concatenate(block.own)
        yield _rows(BLOCKS, 1, block=[number], n=[len(codes)], codes=[_packed(codes.astype(np.int64) + 1)], own=[_bits(own)])
        seen = np.bincount(codes[codes >= 0], own[codes >= 0], minlength=1).astype(np.int64)
        for lang, known in block.words.items():
            known.pop(b".")
            words = sorted(known)
            place = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            order = np.argsort(place, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(words) else ():
                text = b" ".join([words[i] for i in mine])
                yield _rows(BLOCKS, 1, block=[number], bucket=[place[mine[0]]], n=[len(mine)], lang=[lang], start=[len(text)], codes=[_packed(at[mine])], left=[pa.compress(text, codec="zstd", asbytes=True)], cnt=[_packed(seen[at[mine]])])

    def batches_of(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        yield from pa.concat_tables(list(tables)).combine_chunks().to_batches()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang = lang.as_py()
            for tokens, own in _segments(text.as_py(), ahead, *sizes[2:]):
                block.add(lang, tokens, own)
                if block.size >= sizes[0]:
                    yield from batches_of(done())
                    block = _Block()
    if block.size:
        yield from batches_of(done())


def _bucketed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder that is bucketed by block, so that joins by block read it where it is."""
    spark = df.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/tables/{name}").bucketBy(many, "block").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return out


def _named(least: int, level: int, buckets: int):
    """Names of a bucket's keys that are counted `least` times by all its blocks together, and what goes back to each block."""

    def of(key: tuple, asked: pa.Table) -> pa.Table:
        sizes, cnt = asked["n"].to_numpy(), asked["cnt"].to_pylist()
        counts = np.concatenate([_unpacked(c, n) for c, n in zip(cnt, sizes)])
        if level == 1:
            words = pa.array([w for t, n in zip(asked["left"].to_pylist(), asked["start"].to_pylist()) for w in pa.decompress(t, decompressed_size=n, codec="zstd", asbytes=True).split(b" ")], pa.binary())
            word = words.dictionary_encode()
            langs = asked["lang"].combine_chunks().dictionary_encode()
            keys = word.indices.to_numpy().astype(np.int64) * len(langs.dictionary) + np.repeat(langs.indices.to_numpy(), sizes)
            _, one, place = np.unique(keys, return_index=True, return_inverse=True)
            total = np.bincount(place, counts).astype(np.int64)
        else:
            lefts = [np.cumsum(_unpacked(c, n)) for c, n in zip(asked["left"].to_pylist(), sizes)]
            left = np.concatenate(lefts)
            right = np.concatenate([_rights(x, _unpacked(c, n)) for x, c, n in zip(lefts, asked["right"].to_pylist(), sizes)])
            order = np.lexsort((right, left))
            begins = np.ones(len(order), bool)
            begins[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(begins) - 1
            one, total = order[begins], np.add.reduceat(counts[order], np.flatnonzero(begins))
        enough = total >= least
        number = np.full(len(total), -1)
        number[np.flatnonzero(enough)[np.argsort(-total[enough], kind="stable")]] = np.arange(np.count_nonzero(enough)) * buckets + key[0].as_py()
        ids, kept = number[place], one[enough]
        facts = {"id": number[enough], "f": total[enough]}
        if level == 1:
            facts |= {"lang": asked["lang"].combine_chunks().take(pa.array(np.repeat(np.arange(len(sizes)), sizes)[kept])), "word": words.take(pa.array(kept))}
        else:
            facts |= {"left": left[kept], "right": right[kept]}
        out, at = [_rows(NAMES, len(kept), **{k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in facts.items()})], 0
        told = []
        starts = [0] * len(sizes) if level == 1 else asked["start"].to_pylist()
        for block, lang, start, n in zip(asked["block"].to_pylist(), asked["lang"].to_pylist(), starts, sizes):
            mine = np.flatnonzero(ids[at : at + n] >= 0)
            if len(mine):
                told.append((block, lang, len(mine), _packed(np.diff(start + mine, prepend=0)), _packed(ids[at : at + n][mine] // buckets)))
            at += n
        if told:
            block, lang, n, deltas, names = zip(*told)
            out.append(_rows(NAMES, len(told), block=block, level=[level] * len(told), bucket=[key[0].as_py()] * len(told), n=n, codes=deltas, ids=names, lang=pa.array(lang, pa.string())))
        return pa.concat_tables(out)

    return of


def _requests(length: int, buckets: int, unit: int):
    """A block's requests for its pairs of named phrases of length - 1 words, told the names of shorter ones: its codes become those of
    words, then of pairs of them, and so on."""

    def of(key: tuple, payload: pa.Table, told: pa.Table) -> pa.Table:
        if not payload.num_rows:
            return BLOCKS.empty_table()
        rows = {(r["bucket"], r["lang"]): r for r in payload.to_pylist()}
        whole = rows.pop((None, None))
        n = whole["n"]
        codes = _unpacked(whole["codes"], n) - 1
        own = np.unpackbits(np.frombuffer(pa.decompress(whole["own"], decompressed_size=-(-n // 8), codec="zstd", asbytes=True), np.uint8), count=n)
        parts = told.to_pylist()
        for k in range(1, length):
            mine = [p for p in parts if p["level"] == k]
            if not mine:
                return BLOCKS.empty_table()
            places = [np.cumsum(_unpacked(p["codes"], p["n"])) for p in mine]
            if k == 1:  # places among the words that the block asked the bucket for
                asked = [rows[p["bucket"], p["lang"]] for p in mine]
                places = [_unpacked(r["codes"], r["n"])[x] for r, x in zip(asked, places)]
            at = np.concatenate(places)
            ids = np.concatenate([_unpacked(p["ids"], p["n"]) * buckets + p["bucket"] for p in mine])
            by = np.argsort(ids, kind="stable")
            at, ids = at[by], ids[by]
            # Named codes get short ones, in the order of their names, so that pairs fit in 64 bits; words of two languages may
            # not share a name, but two codes of one block never do.
            short = np.full(max(int(codes.max()), int(at.max())) + 2, -1, np.int64)
            short[at] = np.arange(len(at))
            here = short[codes]  # -1 looks at the last place, which is never named
            both = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0))
            if not len(both):
                return BLOCKS.empty_table()
            pairs, place = np.unique(here[both] * len(at) + here[both + 1], return_inverse=True)
            # Codes follow buckets, and pairs within these, so that a bucket's codes are a run. Buckets are a rule of names alone.
            left, right = ids[pairs // len(at)], ids[pairs % len(at)]
            bucket = _mixed(left, right >> unit) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            new = np.empty(len(order), np.int64)
            new[order] = np.arange(len(order))
            place = new[place]
            codes = np.full(n, -1, np.int64)
            codes[both] = place
        left, right, bucket = left[order], right[order], bucket[order].astype(np.int64)
        seen = np.bincount(place, own[both], minlength=len(order)).astype(np.int64)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*starts[1:], len(bucket)]
        number = key[0].as_py()
        runs = [slice(a, b) for a, b in zip(starts, ends)]
        lefts = [_packed(np.diff(left[r], prepend=0)) for r in runs]
        return _rows(BLOCKS, len(runs), block=[number] * len(runs), bucket=bucket[starts], n=np.subtract(ends, starts), start=starts, left=lefts, right=[_packed(_steps(left[r], right[r])) for r in runs], cnt=[_packed(seen[r]) for r in runs])

    return of


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Well spread numbers of pairs."""
    x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def phrase_table(docs: DataFrame, longest: int = 4, least: int = 30, sizes: tuple[int, int, int, int] = (BLOCK, BUCKET, SEGMENT, SLICE)) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (lang, n), and for each length the frequent phrases: (id, lang, phrase, f) of single words, and
    (id, left, right, f) above, where left and right name the phrase without its last and its first word."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # A token has two bytes at least, with its separator, so a bucket's share of all tokens is bounded.
    weight = texts.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    buckets = max(1, -(-weight // (2 * sizes[1])))
    blocks = _bucketed(texts.mapInArrow(lambda batches: _blocks(batches, longest - 1, sizes, buckets), _sql(BLOCKS)))
    payload, asked, told, names = blocks.select("block", "bucket", "n", "codes", "own", "lang"), blocks.where("bucket IS NOT NULL"), None, []
    unit = _unit(blocks.where("bucket IS NULL").count(), sizes[1])
    spread = lambda rows: rows.select("bucket", "block", "n", "start", "lang", "left", "right", "cnt").groupBy("bucket")
    for length in range(1, longest + 1):
        if told is not None:
            asked = payload.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_requests(length, buckets, unit), _sql(BLOCKS))
        found = written(spread(asked).applyInArrow(_named(least, length, buckets), _sql(NAMES)))
        named = found.where("id IS NOT NULL")
        names.append(named.select("id", "lang", F.col("word").cast("string").alias("phrase"), "f") if length == 1 else named.select("id", "left", "right", "f"))
        back = found.where("block IS NOT NULL").select("block", "level", "bucket", "n", "codes", "ids", "lang")
        told = back if told is None else told.unionByName(back)
    return _totals(blocks), names


def _totals(blocks: DataFrame) -> DataFrame:
    """Words of each language, from the counts of the blocks' packed words."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(_unpacked(c, n).sum()) for c, n in zip(batch.column("cnt").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(sums, pa.int64())], names=["lang", "words"])

    counted = blocks.where("bucket IS NOT NULL").select("lang", "n", "cnt").mapInArrow(total, "lang string, words long")
    return counted.groupBy("lang").agg(F.sum("words").alias("n"))


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, subsumed_percent: int = 80, top: int = 2000, sizes: tuple[int, int, int, int] = (BLOCK, BUCKET, SEGMENT, SLICE)) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `longest` words.

    Texts are lower-cased (A-Z), split at `[.,;:!?\\n-\\r]` into pieces and these at spaces and tabs into words. Only lang and text are
    read, whatever other columns are called. A null lang is `und`, together with rows that say so; a null or empty text has no words; a
    repeated row counts again; languages without a phrase that occurs `least` times, and empty tables, give no row. Ties of score
    go by a, then by phrase. Very long texts are coded in segments that overlap by
    longest - 1 words, which count once. sizes: tokens of a block, of a bucket and of a segment, characters split at a
    time; results don't depend on them."""
    if longest < 2:
        raise ValueError("phrases have two words at least")
    totals, names = phrase_table(docs, longest, least, sizes)
    # Each length's phrases with their text, last word, and the counts of every beginning and end, shortest first.
    full = [names[0].select("id", "lang", "phrase", F.col("phrase").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))]
    for found in names[1:]:
        below = full[-1]
        a = below.select(F.col("id").alias("left"), "lang", "phrase", "heads")
        b = below.select(F.col("id").alias("right"), "last", "tails")
        joined = found.join(a, "left").join(b, "right")
        full.append(written(joined.select("id", "left", "right", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"))))
    scored = None
    for at, rows in enumerate(full[1:], 2):
        cuts = [F.struct(F.expr(f"CAST(f AS DECIMAL(19,0)) * 2000000 DIV (CAST(heads[{k - 1}] AS DECIMAL(19,0)) + CAST(tails[{at - k - 1}] AS DECIMAL(19,0)))").alias("score"), F.lit(k).alias("k"), F.expr(f"heads[{k - 1}]").alias("l"), F.expr(f"tails[{at - k - 1}]").alias("r")) for k in range(1, at)]
        rows = rows.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
        if at < longest:
            # A phrase inside a longer one is inside its parents too, and they are no rarer: the next length decides.
            longer = full[at].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("g")).groupBy("id").agg(F.max("g").alias("g"))
            rows = rows.join(longer, "id", "left").where(f"g IS NULL OR CAST(g AS DECIMAL(19,0)) * 100 < CAST(f AS DECIMAL(19,0)) * {int(subsumed_percent)}")
        rows = rows.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        scored = rows if scored is None else scored.unionByName(rows)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first `top` of each of 64 parts of a language, then of these, so that one language isn't one task.
    parts = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """DuckDB SQL of op13 by plain counting of all phrases."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    grams = " UNION ALL ".join(f"SELECT lang, ws[i : i + {k - 1}] AS p FROM pieces, range(1, len(ws) - {k - 2}) t(i)" for k in range(1, 5))
    cuts = "min(struct_pack(score := 2000000::HUGEINT * c.a // (l.a + r.a), k := k.k, l := l.a, r := r.a))"
    return rf"""
WITH pieces AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(translate(text, '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda w: w <> '') AS ws FROM documents),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (SELECT lang, p, count(*)::HUGEINT AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= 30),
cand AS MATERIALIZED (SELECT * FROM f WHERE len(p) > 1),
cut AS (SELECT c.lang, c.p, c.a, {cuts} AS m FROM cand c, range(1, 4) k(k), f l, f r
  WHERE k.k < len(c.p) AND l.lang = c.lang AND r.lang = c.lang AND l.p = c.p[:k.k] AND r.p = c.p[k.k + 1:] GROUP BY ALL),
inner_of AS (SELECT DISTINCT c.lang, c.p[i : i + k.k - 1] AS p, c.a FROM cand c, range(2, 4) k(k), range(1, 4) t(i) WHERE k.k < len(c.p) AND i + k.k - 1 <= len(c.p)),
kept AS (SELECT * FROM cut c WHERE NOT EXISTS (SELECT 1 FROM inner_of o WHERE o.lang = c.lang AND o.p = c.p AND 100 * o.a >= 80 * c.a)),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, m.l AS l, m.r AS r, m.score AS score, row_number() OVER (PARTITION BY lang ORDER BY m.score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
