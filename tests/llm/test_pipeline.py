"""The pipeline's stages each act on what the one before kept."""

import collections
import random
import zlib
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tests.llm.test_operators import brute_components, fair_queue_by_hand
from tidewright.llm import mixing, near_dedup
from tidewright.llm.packing import load_tokenizer
from tidewright.llm.quality_rules import quality_rules


def test_stages(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], src).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(d.columns == docs.columns for d in seen[:-1])
    assert {r[0] for r in seen[1].select("doc_id").collect()} == {r[0] for r in quality_rules(docs).where("kept").select("doc_id").collect()}
    assert seen[2].count() <= seen[1].count() and seen[3].count() == seen[2].count()
    mixed = seen[4].groupBy("doc_id").count().collect()
    assert max(r["count"] for r in mixed) <= 2
    tok, tokens = load_tokenizer(), 0
    for r in seen[4].collect():
        tokens += len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert seen[5].agg({"length": "sum"}).first()[0] == tokens


def test_dedup_links_from_four_fifths(spark):
    words = [f"w{i}" for i in range(120)]
    near = ["x" if i in (30, 80) else w for i, w in enumerate(words)]  # shares 106 of 126 shingles: 0.84
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "another text")], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()} == {1, 3}


def test_dedup_keeps_one_row_of_each_group(spark):
    """The stage's rows against brute-force components of its own input, with repeated rows and null ids."""
    words = [f"w{i}" for i in range(120)]
    text = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    lone = " ".join(f"u{i}" for i in range(30))
    rows = [(1, text()), (1, text()), (1, text().upper()), (2, text(30)), (2, lone), (2, lone), (None, text(80)), (None, text()), (5, ""), (5, ""), (6, None), (None, "null twins here"), (None, "null twins here"), (None, "NULL twins here"), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "doc_id long, text string, n int")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()]
    shingles = lambda t: frozenset(tuple(w[k : k + 5]) for w in [(t or "").lower().split()] if w for k in range(max(1, len(w) - 4)))
    groups = []  # of places, linked from 0.8
    for i, (_, t) in enumerate(rows):
        s = shingles(t)
        near = [g for g in groups if s and any(100 * len(s & shingles(rows[j][1])) >= 80 * len(s | shingles(rows[j][1])) for j in g)]
        groups = [g for g in groups if g not in near] + [sorted([i, *sum(near, [])])]
    full = [g for g in groups if shingles(rows[g[0]][1])]
    assert len(full) == 3
    for g in full:
        least = min((rows[j][0] is None, rows[j][0] or 0) for j in g)
        kept = [x for x in got if any(rows[j][0] == x[0] and rows[j][1] == x[1] for j in g)]
        assert len(kept) == 1 and (kept[0][0] is None, kept[0][0] or 0) == least
    assert sorted(x[0] or 0 for x in got if not shingles(x[1])) == [0, 5, 6] and len(got) == 6


def brute_repetition(words, least=8):
    """Words in 3-word windows that occur twice, words covered by repeats of `least` or more, the longest such repeat."""
    n, best = len(words), [0] * len(words)
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    triple = {t for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for t in (i, i + 1, i + 2)}
    covered = {t for i in range(n) if best[i] >= least for t in range(i, i + best[i])}
    return len(triple), len(covered), max([b for b in best if b >= least], default=0)


def test_run_against_brute_force(spark, tmp_path):
    """run() on a table with odd rows and clashing columns, each step by hand from what the one before keeps."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(90)]
    rows = []
    for i in range(40):
        words = [word() for _ in range(rng.randrange(55, 120))] if i % 4 else [w if rng.random() > 0.01 else word() for w in base]
        if i % 5 == 0:
            words[3] = f"user{i}@mail.example.com"
        rows.append((i, " ".join(words)))
    rows += [(100, "too short"), (101, None), (102, ""), (103, "same again " * 60), (7, rows[7][1]), (None, rows[9][1]), (None, " ".join(word() for _ in range(60))), (104, "<|endoftext|> " + rows[11][1])]
    docs = spark.createDataFrame([(*r, "sba"[i % 3], i, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, cuts int, __place int")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = []
    for i, (doc, text) in enumerate(rows):
        words = (text or "").split()
        triple, covered, longest = brute_repetition(words)
        if len(words) >= 50 and 100 * triple <= 50 * len(words) and covered <= 0.4 * len(words) and longest <= 100:
            kept.append((doc, text, "sba"[i % 3]))
    shingles = lambda t: frozenset(tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4)))
    groups = []
    for row in kept:
        near = [g for g in groups if any(100 * len(shingles(row[1]) & shingles(x[1])) >= 80 * len(shingles(row[1]) | shingles(x[1])) for x in g)]
        groups = [g for g in groups if g not in near] + [sum(near, []) + [row]]
    first = [min(g, key=lambda r: (r[0] is None, r[0] or 0, *r[1:])) for g in groups]
    keys = {r[0]: r[1] % 2**64 for r in docs.select("doc_id", mixing.shuffle_key(F.col("doc_id"))).collect()}
    copies = fair_queue_by_hand([(d, s, len(t.split()), keys[d]) for d, t, s in first])
    tok = load_tokenizer()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == {d for d, n in copies.items() if n} and max(copies.values()) == 2
    for doc, text, _ in first:
        if not copies[doc]:
            continue
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        mine = pieces[doc]
        if "@" in text:  # a surrogate of other tokens
            assert sum(r["length"] for r in mine) == copies[doc] * mine[0]["doc_tokens"]
            continue
        assert sum(r["length"] for r in mine) == copies[doc] * len(ids)
        for r in mine:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = [0, *(a + b for a, b in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] & (ends[-1] - 1) == 0


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_dedup_confirms_few_pairs_of_a_large_group(spark, monkeypatch):
    """Exact copies, and edited copies of which most are linked with nothing, are confirmed in few rows: a pair isn't repeated for
    the copies of its texts, nor confirmed where it is far apart."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)] * 60
    for i in range(60):  # 3 to 12 words changed: similar to the base by 0.86 to 0.55, to each other by less
        at = rng.sample(range(200), 3 + i % 10)
        texts.append(" ".join(f"x{rng.randrange(4)}" if k in at else w for k, w in enumerate(base)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    confirmed, links = [], near_dedup._links

    def counted(near, sets, percent):
        confirmed.append(near.join(sets, near.b == sets.node).count())
        return links(near, sets, percent)

    monkeypatch.setattr(near_dedup, "_links", counted)
    got = {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()}
    assert got == {i for i, (_, least) in brute_components(list(enumerate(texts)), 80).items() if i == least}
    assert sum(confirmed) <= 2 * len(texts)


def test_parities_bound_what_sets_have_apart():
    rng = np.random.default_rng(2)
    sets = []
    for n in (1, 2, 5, 60, 300, 513, 2000):
        whole = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [np.unique(whole[: max(1, n - k)]) for k in (0, 1, n // 9, n // 5, n // 2)]
    pairs = [(a, b) for a in sets for b in sets]
    apart = [len(np.setxor1d(a, b)) for a, b in pairs]
    odd = [[near_dedup.parities(x) for x in of] for of in zip(*pairs)]
    assert (near_dedup.apart(*odd) <= apart).all()
    alike = [100 * (len(a) + len(b) - d) >= 80 * (len(a) + len(b) + d) for (a, b), d in zip(pairs, apart)]
    possible = near_dedup._possible(80, *(np.array([len(x) for x in of]) for of in zip(*pairs)), *odd)
    assert possible[alike].all() and possible.sum() < 1.2 * sum(alike)


def test_bitmap_keeps_every_id(spark):
    ids = [0, 1, -1, 7, 1 << 40, -(1 << 62), (1 << 63) - 1, *range(100, 900, 8)]
    bits = near_dedup._bitmap(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    others = [i + 3 for i in range(100, 900, 8)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([*ids, *others, None], pa.int64()), "text": ["x"] * (len(ids) + len(others) + 1)})
    got = pa.Table.from_batches(near_dedup._perhaps(SimpleNamespace(value=bits))(iter([batch])))["doc_id"].to_pylist()
    assert set(ids) <= set(got) and not set(others) & set(got)
