"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk, bytes from one chunk to the next, dimensions of a byte, filters.
WIDTH, STEP, DIMENSIONS, FILTERS = 16, 4, 8, 24
#: Labelled documents that are learned from, by label, at most; and bytes of the longest such document.
SAMPLE = {0: 1200, 1: 1800}
SAMPLE_BYTES = 32_768
EPOCHS, BATCH, RATE, SEED = 14, 64, 0.004, 11


class ByteConvolution:
    """p(good) = sigmoid(v . max over chunks of relu(W . bytes of the chunk) + b).

    Chunks of WIDTH bytes start every STEP bytes, so they overlap, and zeros after the end let them cover the whole text.
    The bytes' vectors (embed) and the filters are learned together; to score, their product is laid out as one table of
    FILTERS numbers for each place in a chunk and byte.
    """

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, DIMENSIONS)).astype(np.float32)
        self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * DIMENSIONS), (WIDTH * DIMENSIONS, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.base]

    @staticmethod
    def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes, each padded to whole chunks, and where each text's first chunk lies among all."""
        parts, starts, at = [], [], 0
        for t in texts:
            chunks = max(1, -(-(len(t) - WIDTH) // STEP) + 1)
            size = chunks * STEP + WIDTH - STEP
            size += -size % STEP
            parts.append(t.ljust(size, b"\0"))
            starts.append(at // STEP)
            at += size
        return np.frombuffer(b"".join(parts), np.uint8), np.array(starts)

    def _chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All chunks (n, WIDTH), and the first of each text. A chunk that would reach into the next text isn't among them."""
        raw, starts = self.laid_out(texts)
        every = np.lib.stride_tricks.sliding_window_view(raw, WIDTH)[::STEP]
        ends = np.append(starts[1:], len(raw) // STEP)
        inside = np.concatenate([np.arange(s, e - (WIDTH // STEP - 1)) for s, e in zip(starts, ends)])
        sizes = ends - starts - (WIDTH // STEP - 1)
        return every[inside], np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def fit(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam on the weighted log loss. Only the chunk that gives a filter its maximum takes part in its gradient."""
        rng = np.random.default_rng(seed)
        first, second = ([np.zeros_like(p) for p in self.parameters] for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                at = order[lo : lo + BATCH]
                chunks, starts = self._chunks([texts[i] for i in at])
                conv = self._convolved(chunks)
                best = np.maximum.reduceat(conv, starts, axis=0)
                ends = np.append(starts[1:], len(conv))
                where = np.stack([s + conv[s:e].argmax(axis=0) for s, e in zip(starts, ends)])  # (texts, FILTERS)
                pooled = np.maximum(best + self.bias, 0)
                p = 1 / (1 + np.exp(-(pooled @ self.out + self.base)))
                slope = ((p - labels[at]) * weights[at] / weights[at].sum()).astype(np.float32)
                d_pool = slope[:, None] * self.out * (pooled > 0)
                picked = chunks[where]  # (texts, FILTERS, WIDTH)
                vectors = self.embed[picked].reshape(len(at), FILTERS, -1)
                d_filters = np.einsum("tf,tfx->xf", d_pool, vectors)
                d_vectors = (d_pool[:, :, None] * self.filters.T[None]).reshape(-1, DIMENSIONS)
                d_embed = np.zeros_like(self.embed)
                np.add.at(d_embed, picked.reshape(-1), d_vectors)
                grads = [d_embed, d_filters, d_pool.sum(axis=0), pooled.T @ slope + 1e-4 * self.out, slope.sum(keepdims=True)]
                step += 1
                for x, g, m, v in zip(self.parameters, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    x -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def tables(self) -> np.ndarray:
        """(WIDTH, 256, FILTERS): what a byte at a place adds to each filter."""
        return np.einsum("bd,wdf->wbf", self.embed, self.filters.reshape(WIDTH, DIMENSIONS, FILTERS)).astype(np.float32)

    def _convolved(self, chunks: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
        tables = self.tables() if tables is None else tables
        out = tables[0][chunks[:, 0]]
        for w in range(1, WIDTH):
            out += tables[w][chunks[:, w]]
        return out

    def scores(self, texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
        """Probabilities of whole texts, some of which together have about `block` bytes."""
        tables, out, lo = self.tables(), [], 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size + len(texts[hi]) <= block:
                size += len(texts[hi])
                hi += 1
            chunks, starts = self._chunks(texts[lo:hi])
            pooled = np.maximum(np.maximum.reduceat(self._convolved(chunks, tables), starts, axis=0) + self.bias, 0)
            out.append(1 / (1 + np.exp(-(pooled @ self.out + self.base).astype(np.float64))))
            lo = hi
        return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id, fold: int = 0):
    """True where crc32 of doc_id as text leaves `fold` modulo 5; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: dict = SAMPLE, epochs: int = EPOCHS) -> ByteConvolution:
    """A network fitted on a bounded sample: of each label's documents outside the held-out fold the sample[label] of least
    hash among those up to SAMPLE_BYTES long, whole; of rows repeated under one doc_id the least text. Weights give each label its share of all labelled documents. Null labels don't
    count; of several labels of a document the highest does. Without two labels the network says the share of label 1."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(~held_out(F.col("doc_id")))
    shares = dict(known.groupBy("quality").count().collect())
    net = ByteConvolution()
    if len(shares) < 2:
        net.out[:] = 0
        net.base[:] = 4.0 if shares.get(1) else -4.0 if shares else 0.0
        return net
    short = F.octet_length("text") <= SAMPLE_BYTES
    able = known.join(docs.where(short).select("doc_id").distinct(), "doc_id", "left_semi")
    picked = None
    for label, most in sample.items():
        part = able.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.where(short).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).toPandas()  # at most the sample's size
    rows = rows.sort_values(["doc_id", "text"], kind="stable")
    y = rows["quality"].to_numpy(np.float32)
    total = sum(shares.values())
    weights = np.where(y == 1, shares[1] / total / max(1, (y == 1).sum()), shares[0] / total / max(1, (y == 0).sum())).astype(np.float32)
    net.base[:] = np.log(shares[1] / shares[0])
    net.fit([t.encode() for t in rows["text"]], y, weights, epochs)
    return net


def score(docs: DataFrame, net: ByteConvolution, threshold: float = 0.3) -> DataFrame:
    """docs with held_out, score and predicted, from whole texts alone.

    Null and empty texts are one chunk of zeros. Each row is scored by itself; columns named as results are replaced.
    """
    results = ["held_out", "score", "predicted"]
    carried = [c for c in docs.columns if c not in results]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    named = docs.select(*carried, held_out(F.col("doc_id")).alias("held_out"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = net.scores([(t or "").encode() for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "held_out boolean, score double, predicted int"])
    return named.mapInArrow(scored, schema)
