"""Quality rules: counts per document, and repetition found with a suffix array over its words."""

from __future__ import annotations

from collections import defaultdict
from itertools import count
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.common import WHITE

SYMBOLS = b"#*$%&|<>"
#: Shortest repeat that counts, in words; a power of two.
MIN_REPEAT = 8
#: A document goes if repeats cover more of its words than this.
MAX_COVERED = 0.4
#: A document goes if its longest repeat has more words than this.
MAX_LONGEST = 100
#: Words of one suffix array; a longer document has one of its own.
BLOCK_WORDS = 200_000

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"


class _Ids(defaultdict):
    """Numbers words in the order in which they come."""

    def __init__(self) -> None:
        super().__init__(count().__next__)


def _ranks(key: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, ranks of all suffixes by their first k words, in one array that changes) for k = 1, 2, 4 ... until all differ. A rank is the first place of
    its group in the suffix array, so suffixes that already stand alone are never sorted again. end: one past the last
    word of each suffix's document; key differs between documents."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = key[order[1:]] != key[order[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    sizes = np.diff(np.append(np.flatnonzero(new), n))
    active = order[np.repeat(sizes > 1, sizes)]
    k = 1
    while True:
        yield k, rank
        if not len(active):
            return
        after = active + k
        inside = after < end[active]
        second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        old = rank[active]
        both = old * (n + 1) + second
        o = np.argsort(both, kind="stable")
        active, both, old = active[o], both[o], old[o]
        new = np.empty(len(o), bool)
        new[:1] = True
        new[1:] = both[1:] != both[:-1]
        group = np.empty(len(o), bool)
        group[:1] = True
        group[1:] = old[1:] != old[:-1]
        place = np.arange(len(o))
        first = np.maximum.accumulate(np.where(group, place, 0))
        begun = np.maximum.accumulate(np.where(new, place, 0))
        rank[active] = old + begun - first
        sizes = np.diff(np.append(np.flatnonzero(new), len(o)))
        active = active[np.repeat(sizes > 1, sizes)]
        k *= 2


def _spans(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Marks the n words that lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def repetition(ids: np.ndarray, sizes: np.ndarray, min_repeat: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of so many words each, whose word numbers stand in ids: words in 3-word windows that occur twice, words
    covered by maximal repeats of min_repeat words or more, and the longest repeat's words (0 if none is so long).

    Neighbours in the suffix array share their longest common prefix; the larger of a suffix's two is the longest repeat
    that starts there, and the union of these spans is that of all maximal repeats. Repeats may overlap themselves.
    """
    docs, n = len(sizes), len(ids)
    zero = np.zeros(docs, np.int64)
    if not n:
        return zero, zero.copy(), zero.copy()
    doc = np.repeat(np.arange(docs), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    key = doc * (int(ids.max()) + 1) + ids
    levels, triple = {}, np.zeros(n, bool)
    for k, rank in _ranks(key, end):
        levels[k] = rank.astype(np.int32 if n < 2**31 else np.int64)
        if k == 2:
            at = np.flatnonzero(np.arange(n) + 2 < end)
            three = rank[at].astype(np.int64) * n + levels[1][at + 2]
            _, back, times = np.unique(three, return_inverse=True, return_counts=True)
            twice = at[times[back] > 1]
            triple[twice] = triple[twice + 1] = triple[twice + 2] = True
    per_doc = lambda marks: np.bincount(doc[marks], minlength=docs).astype(np.int64)
    longest = zero.copy()
    if min_repeat not in levels:
        return per_doc(triple), zero.copy(), longest
    last = levels[max(levels)]
    suffixes = np.empty(n, np.int64)
    suffixes[last] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    same = (levels[min_repeat][a] == levels[min_repeat][b]) & (a + min_repeat <= end[a]) & (b + min_repeat <= end[b])
    a, b = a[same], b[same]
    shared = np.zeros(len(a), np.int64)
    for k in sorted(levels, reverse=True):
        x, y = a + shared, b + shared
        fits = (x + k <= end[a]) & (y + k <= end[b])
        fits[fits] = levels[k][x[fits]] == levels[k][y[fits]]
        shared[fits] += k
    length = np.zeros(n, np.int64)
    np.maximum.at(length, a, shared)
    np.maximum.at(length, b, shared)
    at = np.flatnonzero(length)
    np.maximum.at(longest, doc[at], length[at])
    return per_doc(triple), per_doc(_spans(at, length[at], n)), longest


def measure(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> list[np.ndarray]:
    """The columns of SCHEMA for some whole texts, in blocks of about BLOCK_WORDS words."""
    rows, held, sizes, ids = [], [], [], _Ids()
    found: list[list[np.ndarray]] = [[], [], []]

    def flush() -> None:
        if sizes:
            for into, x in zip(found, repetition(np.concatenate(held), np.array(sizes), min_repeat)):
                into.append(x)
        held.clear()
        sizes.clear()
        ids.clear()
        ids.default_factory = count().__next__

    for text in texts:
        text = text or ""
        raw = text.encode()
        words = raw.split()
        white = len(raw) - len(raw.translate(None, WHITE))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        rows.append((len(words), len(text) - white, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines))))
        held.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
        if sum(sizes[-1:]) > BLOCK_WORDS or len(ids) > BLOCK_WORDS or sum(sizes) > BLOCK_WORDS:
            flush()
    flush()
    first = np.array(rows, np.int64).reshape(-1, 4)
    return [*first.T, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)]


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """docs with its columns and those of SCHEMA, base_failed and kept.

    base_failed: under 50 words, or more than half of the words in 3-word windows that occur twice. kept: not base_failed,
    repeats of min_repeat words or more cover at most max_covered of the words, and the longest has at most max_longest
    words. Null and empty texts have no words and fail. Each row is judged by itself, repeated rows alike; columns of docs
    with the names of results are replaced.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    carried = [c for c in docs.columns if c not in {*names, "base_failed", "kept"}]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = measure(batch["text"].to_pylist(), min_repeat)
            n_words, n_repeat, covered, longest = cols[0], cols[4], cols[5], cols[6]
            failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
            kept = ~failed & (covered <= max_covered * n_words) & (longest <= max_longest)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carried), *(pa.array(x, pa.int64()) for x in cols), pa.array(failed), pa.array(kept)], names=[*carried, *names, "base_failed", "kept"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), SCHEMA, "base_failed boolean, kept boolean"])
    return docs.select(*carried).mapInArrow(judged, schema)
