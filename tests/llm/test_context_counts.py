"""Codes of many texts and counts of many bits against the plain ways."""

import collections
import types

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import context_mixing as m

TEXTS = [None, "", " \n ", "  Lost ÉTÉ\tWords  ", "a b a\x0b\x0c\rb ", "x" * 50, "zz\x1cq \x85 \xa0b", "end\n"]


@pytest.mark.parametrize("tokens", [[b"a", m.END, b"words"], [b"a", b"b"], []])
def test_codes_of_many_texts(tokens):
    ids, at, spelled, rare, of = m.encoded_texts(pa.array(TEXTS), pa.array(tokens, pa.binary()))
    places = dict(zip(tokens, range(1, len(tokens) + 1)))
    for i, text in enumerate(TEXTS):
        symbols, raw = m.encoded(m.tokens_of(text), places)
        assert ids[at[i] : at[i + 1]].tolist() == symbols.tolist() and spelled[i].as_py() == raw
        assert collections.Counter(rare.filter(pa.array(of == i)).to_pylist()) == collections.Counter(raw.split())


@pytest.mark.parametrize("size", [1, 1 << 25])
def test_counted_words(monkeypatch, size):
    monkeypatch.setattr(m, "SLICE", size)
    held = [False, True, False, True] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS), pa.array(held)], names=["text", "held_out"])
    got, want = collections.Counter(), collections.Counter()
    for x in m._counted(iter([batch, batch.slice(3, 2)])):
        for token, n in zip(*(c.to_pylist() for c in x.columns)):
            got[token] += n
    for text, out in [*zip(TEXTS, held), *zip(TEXTS[3:5], held[3:5])]:
        for token in m.tokens_of(text):
            want[token] += not out
    assert dict(got) == dict(want)


@pytest.mark.parametrize("pairs", [50, 1 << 22])
def test_repeated_pairs_are_counted_once(monkeypatch, pairs):
    """A thousand equal texts draw as few bits as one, and count as a loop over all bits does."""
    monkeypatch.setattr(m, "PAIRS", pairs)
    monkeypatch.setattr(m, "DEEP", 2)
    words = b"red apple blue stone and the of".split()
    code = m.Code([*words, m.END], np.arange(1, 9), 3)
    coded = [m.encoded([*words, b"qq", m.END], code.places())] * 1000
    want = np.zeros((m.SPELLING, 1 << 12, 2), np.uint32)
    for rows in m.rows_of(code, coded):
        for part in rows.parts():
            for c in range(len(rows.hashes)):
                np.add.at(want[c], (part.slots(c, 12), part.bits), np.uint32(1))
    drawn = []
    at = lambda out, index, n: drawn.append(len(index)) or np.add.at(out, index, n)
    monkeypatch.setattr(m, "np", types.SimpleNamespace(**vars(np) | {"add": types.SimpleNamespace(at=at, reduceat=np.add.reduceat)}))
    assert (m.Tables.counts(m.rows_of(code, coded), 12) == want).all()
    assert pairs == 50 or sum(drawn) < 1000
