"""Packed requests for pairs of phrases."""

import numpy as np
import pyarrow as pa

from tidewright.llm import collocations as c


def test_steps_give_back_the_pairs():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 4000):
        left, right = np.unique(rng.integers(0, 60, (n, 2)), axis=0).T
        assert (c._rights(left, c._steps(left, right)) == right).all()


def test_units_stay_in_a_bucket():
    assert c._unit(1, c.BUCKET) == c.UNIT_BITS and c._unit(10**9, c.BUCKET) == 0
    assert all(blocks << c._unit(blocks, c.BUCKET) <= c.BUCKET // 4 for blocks in (32, 211, 2000, 500_000))


def test_a_pair_takes_few_bytes():
    """A block's requests for pairs of 20,000 named words take under two bytes and a half a pair, and name each pair once."""
    rng, buckets, many = np.random.default_rng(5), 50, 20_000
    codes = np.minimum(rng.zipf(1.2, 400_000), many).astype(np.int64) - 1
    names = rng.permutation(many)  # codes and ranks of the same words have nothing to do with each other
    ranks = np.argsort(np.argsort(-np.bincount(codes, minlength=many), kind="stable"))
    place = names.argsort()
    words = c._rows(c.BLOCKS, 1, block=[7], n=[len(codes)], codes=[c._packed(names[codes] + 1)], own=[c._bits(np.ones(len(codes), np.uint8))])
    rows, told = [words], []
    for b in range(buckets):
        mine = place[ranks[place] % buckets == b]
        rows.append(c._rows(c.BLOCKS, 1, block=[7], bucket=[b], n=[len(mine)], lang=["en"], codes=[c._packed(names[mine])]))
        told.append(c._rows(c.NAMES, 1, block=[7], level=[1], bucket=[b], n=[len(mine)], lang=["en"], codes=[c._packed(np.diff(np.arange(len(mine)), prepend=0))], ids=[c._packed(ranks[mine] // buckets)]))
    asked = c._requests(2, buckets, 12)((pa.scalar(7),), pa.concat_tables(rows), pa.concat_tables(told)).to_pylist()
    got = {}
    for r in asked:
        left = np.cumsum(c._unpacked(r["left"], r["n"]))
        for pair, n in zip(zip(left.tolist(), c._rights(left, c._unpacked(r["right"], r["n"])).tolist()), c._unpacked(r["cnt"], r["n"]).tolist()):
            assert pair not in got
            got[pair] = n
    pairs, n = np.unique(ranks[codes[:-1]] * many + ranks[codes[1:]], return_counts=True)
    assert got == dict(zip(zip((pairs // many).tolist(), (pairs % many).tolist()), n.tolist()))
    assert sum(len(r["left"]) + len(r["right"]) for r in asked) < 2.5 * len(got)
