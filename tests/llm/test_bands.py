"""Recall of the bands that production uses, and what they send on."""

import inspect
import random
import tracemalloc

import numpy as np
import pytest

from lociq.llm import near_duplicates as nd


@pytest.mark.parametrize("of", [nd.class_links, nd.near_duplicate_pairs, nd.near_duplicate_groups])
def test_pairs_at_the_limit_meet(of):
    """8,000 pairs that share 40 of 80 windows: at most 2 in 1,000 meet in no band."""
    bands = inspect.signature(of).parameters["bands"].default
    g, pairs = np.random.default_rng(5), 8_000
    h = g.integers(0, 2**63, (pairs, 80), dtype=np.uint64)
    sides = [np.concatenate([h[:, :40], h[:, a : a + 20]], axis=1).ravel() for a in (40, 60)]
    a, b = (nd.band_keys(nd.min_hashes(x, np.full(pairs, 60), 2 * bands), bands) for x in sides)
    missed = int((~(a == b).any(axis=1)).sum())
    assert missed <= 16, missed


def sketches(h, per):
    """Rows of fingerprint, second bits and an id, of texts of ``per`` window hashes each."""
    least = nd.min_hashes(h, np.full(len(h) // per, per), nd.BITS)
    return np.concatenate([nd.fingerprints(least), nd.second_bits(least), np.arange(1, len(least) + 1, dtype=np.uint64)[:, None]], axis=1)


def test_both_bits_keep_pairs_at_the_limit():
    """Of 8,000 pairs at 0.5 at most two are turned down by both bits, hardly one of unlike texts stays."""
    g = np.random.default_rng(8)
    h = g.integers(0, 2**63, (8_000, 80), dtype=np.uint64)
    x, y = (sketches(np.concatenate([h[:, :40], h[:, a : a + 20]], axis=1).ravel(), 60) for a in (40, 60))
    each = np.arange(len(x))
    y[:, -1] += np.uint64(10_000)
    assert sum(b.num_rows for b in nd._alike(x, y, iter([(each, each)]), 72)) >= 7_998
    near = [len(i) for i, _ in nd._near_steps(nd._fp(x[:3_000]), None, 51)]
    kept = sum(b.num_rows for b in nd._alike(x, x, nd._near_steps(nd._fp(x[:3_000]), None, 51), 72))
    assert sum(near) > 20_000 and kept < 20


def test_pairs_of_a_large_cell_leave_in_pieces():
    """4,000 texts that are all alike make 8 million pairs; few are held at a time."""
    x = sketches(np.tile(np.random.default_rng(9).integers(0, 2**63, 50, dtype=np.uint64), 4_000), 50)
    tracemalloc.start()
    n = [b.num_rows for b in nd._cell(x, None, 51, 72)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n) == 4_000 * 3_999 // 2 and peak < 200e6, peak


def test_packed_rows_are_bounded():
    """However many keys come up often, a task holds a bounded number of their rows."""
    out, most = nd._Packer(often=2, block=8_192, most=10_000), 0
    for s in range(20):
        list(out.rows(np.repeat(np.arange(2_000, dtype=np.uint64), 2), np.full((4_000, nd.ROW), s, np.uint64)))
        most = max(most, sum(len(x) for held in out.held.values() for x in held))
    assert most <= 10_000


@pytest.mark.parametrize("often", [64, 2])
def test_keys_of_one_text_go_no_further(spark, often):
    """Of 300 texts two are alike, and 30 a copy in another task: only what meets is shuffled with sketches."""
    r = random.Random(10)
    texts = ["".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(200)) for _ in range(299)]
    texts += [texts[0][:190], *texts[:30]]
    df = nd._texts(spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "id string, seq string").repartition(4), "id", "seq", 5)
    hot, _ = nd.hot_slots(df, 5)
    met = nd._met(nd._keyed_rows(df, 5, nd._banded(32), hot, often, 3), 3)
    rows = nd._with_sketches(met, 3, 1 << 30, 8_192).collect()
    assert 0 < len(rows) < 300 and len({(x.part, x.f4) for x in rows}) == len(rows)
    assert len({x.f4 for x in rows if sum(y.part == x.part for y in rows) > 1}) >= 2


def test_a_shared_motif_makes_few_candidates():
    """4,000 texts of one bucket that share a motif and no more: pairs within the radius are many, candidates few."""
    h = np.random.default_rng(11).integers(0, 2**63, (4_000, 120), dtype=np.uint64)
    h[:, :16] = h[0, :16]
    x = sketches(h.ravel(), 120)
    within = sum(len(i) for i, _ in nd._near_steps(nd._fp(x), None, 51))
    left = sum(b.num_rows for b in nd._cell(x, None, 51, 72))
    assert within > 200_000 and left < within // 50, (within, left)
