"""Sum-of-squares packing of documents into windows of tokens."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 2048
END = 1
#: The tokenizer whose ids these are, and its vocabulary in the form that encodes fastest.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Pieces of text of which a task keeps the ids.
CACHE = 400_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def load_tokenizer(name: str = TOKENIZER):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_path(name))


def _path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def special_ids(name: str = TOKENIZER) -> dict[str, bytes]:
    """The tokenizer's added tokens, which it finds in any text, with their ids as bytes."""
    with open(_path(name)) as found:
        return {x["content"]: int(x["id"]).to_bytes(4, "little") for x in json.load(found)["added_tokens"]}


class _Known(dict):
    """Ids of pieces by piece, encoded when first asked for."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(_path(name), "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = np.array(self.encoding.encode_ordinary(piece), "<u4").tobytes()
        return found


#: White space next to a space.
_JOINED = re.compile(r"\s | \s")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes: those of TOKENIZER, from the same vocabulary's ranks.

    The tokenizer never joins what stands before a single space with what follows, unless white space lies next to it; so
    texts are cut there, and each distinct piece (a space and a word) is encoded once a task. Elsewhere texts stay whole. The
    tokenizer's added tokens have their own ids wherever they stand; what lies between them is encoded for itself.
    """

    def __init__(self, name: str = RANKS, tokenizer: str = TOKENIZER) -> None:
        self.known = _Known(name)
        self.special = special_ids(tokenizer)
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        return [self._encoded(x) for x in texts]

    def _encoded(self, text: str) -> bytes:
        if self.added is None or not self.added.search(text):
            return b"".join(map(self.known.__getitem__, self._cut(text)))
        return b"".join(self.special.get(x) or b"".join(map(self.known.__getitem__, self._cut(x))) for x in self.added.split(text) if x)

    @staticmethod
    def _cut(text: str) -> list[str]:
        first, *rest = text.split(" ")
        pieces = [first, *[" " + x for x in rest]]
        if _JOINED.search(text):
            return Encoder._mend(pieces)
        return pieces if first else pieces[1:]

    @staticmethod
    def _mend(pieces: list[str]) -> list[str]:
        """Joins pieces again where white space lies next to the space between them."""
        out: list[str] = []
        for p in pieces:
            if out and (p == " " or p[1:2].isspace() or out[-1][-1:].isspace() or out[-1] == ""):
                out[-1] += p
            else:
                out.append(p)
        return [p for p in out if p]


class SumOfSquares:
    """Places rests of documents into open windows: of all fill levels h with an open window (0: a new one), the one for
    which sum(count[level] ** 2) is least after the move from h to h + size. Ties go to the fuller window. A full window
    is closed, and its level counts nothing. open[h] lists the open windows at level h, the last opened first out."""

    def __init__(self, capacity: int = WINDOW) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list] = {}

    def level(self, size: int) -> int:
        top = self.capacity - size
        count = self.count
        # change of the sum: level h loses one (1 - 2c), level h + size gains one (1 + 2c); level 0 and full windows are free
        gain = 1 + 2 * count[size : size + top + 1]
        gain[top] = 0
        loss = 1 - 2 * count[: top + 1]
        loss[0] = 0
        change = gain + loss
        usable = count[: top + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return int(top - np.argmin(change[::-1]))

    def place(self, item: object, size: int) -> list | None:
        """Puts the item in; returns the window's items if that fills it."""
        h = self.level(size)
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
        else:
            window = []
        window.append(item)
        if h + size == self.capacity:
            return window
        self.open.setdefault(h + size, []).append(window)
        self.count[h + size] += 1
        return None

    def rest(self) -> list[list]:
        """The windows still open, fullest first."""
        return [w for h in sorted(self.open, reverse=True) for w in self.open[h]]


def pack(sizes: Iterator[tuple[object, int]], capacity: int = WINDOW) -> Iterator[list[tuple[object, int, int]]]:
    """Windows of (document, start, length) for (document, size) as they come.

    A document's full windows leave at once; its rest is placed by sum of squares. At the end the few windows still open
    are emptied in order into full ones, cutting documents where a window ends, and what is left goes to windows whose
    lengths are powers of two: no window needs padding.
    """
    bins = SumOfSquares(capacity)
    for doc, size in sizes:
        whole = size - size % capacity
        for start in range(0, whole, capacity):
            yield [(doc, start, capacity)]
        if size > whole and (full := bins.place((doc, whole, size - whole), size - whole)):
            yield full
    left = [x for w in bins.rest() for x in w]
    room = sum(x[2] for x in left)
    lengths = [capacity] * (room // capacity) + [1 << i for i in range(capacity.bit_length() - 1, -1, -1) if room % capacity >> i & 1]
    left.reverse()
    for length in lengths:
        window, need = [], length
        while need:
            doc, start, size = left.pop()
            part = min(size, need)
            window.append((doc, start, part))
            if size > part:
                left.append((doc, start + part, size - part))
            need -= part
        yield window


def pack_documents(docs: DataFrame, tokenizer: str = RANKS, capacity: int = WINDOW) -> DataFrame:
    """SCHEMA: the pieces of all documents in sequences of at most `capacity` tokens.

    A document's ids are those of its text (null: empty) and END, so even an empty one has a piece. Each task packs the
    rows it reads, in their order, with no shuffle: open windows hold pieces' places and ids of rests only. sequence_id is
    the task's number and a counter, so a task that runs again gives the same rows. Repeated rows are packed each; a null
    doc_id stays null. Lengths are `capacity` or powers of two: no padding.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        first = TaskContext.get().partitionId() << 32
        ids: dict[int, bytes] = {}
        names: dict[int, tuple] = {}

        def sizes() -> Iterator[tuple[int, int]]:
            n = 0
            for batch in batches:
                for at in range(0, len(batch), 500):
                    part = batch.slice(at, 500)
                    for doc, raw in zip(part["doc_id"].to_pylist(), encoder.encode([x or "" for x in part["text"].to_pylist()])):
                        ids[n] = raw + END.to_bytes(4, "little")
                        size = len(ids[n]) // 4
                        names[n] = (doc, size, size)
                        yield n, size
                        n += 1

        rows: list[tuple] = []
        for number, window in enumerate(pack(sizes(), capacity)):
            offset = 0
            for n, start, length in window:
                doc, size, left = names[n]
                raw = memoryview(ids[n])[4 * start : 4 * (start + length)]
                rows.append((doc, start, length, zlib.crc32(raw), size, first + number, offset))
                offset += length
                if left == length:
                    del ids[n], names[n]
                else:
                    names[n] = (doc, size, left - length)
            if len(rows) > 20_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(packed, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in SCHEMA.split(", ")])
