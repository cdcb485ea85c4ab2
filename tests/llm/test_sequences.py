"""Near-duplicates and shared spans against brute force."""

import inspect
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lociq.llm import near_duplicates as nd
from lociq.llm import shared_spans as ss
from lociq.llm.windows import inside, letters, rolling, sliding_min

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
DIRTY = "id string, seq string, digest int, text string, sid string, f string, a int"


def edited(r, s, edits):
    s = list(s)
    for _ in range(edits):
        at, kind = r.randrange(len(s)), r.random()
        if kind < 0.5:
            s[at] = r.choice(LETTERS)
        elif kind < 0.75:
            s.insert(at, r.choice(LETTERS))
        else:
            del s[at]
    return "".join(s)


def corpus(seed, families=12, alone=20):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice(LETTERS) for _ in range(n))
    out, stretch = [], word(60)
    for f in range(families):
        base = word(r.randint(60, 400))
        out += [edited(r, base, r.randint(0, 14)) for _ in range(r.randint(1, 5))]
        if f % 3 == 0:
            out += [base, base[len(base) // 2 :] + base[: len(base) // 2], word(30) + stretch[f : f + 45] + word(20)]
    out += [word(r.randint(1, 90)) for _ in range(alone)] + ["", "AAAA", "A" * 300, "A" * 200 + word(50), "ÄÖ" * 60, "ÄÖ" * 60 + "x"]
    rows = [(f"p{i}", s) for i, s in enumerate(out)]
    rows += [("copy", out[0]), ("copy", out[0]), ("p0", out[0]), ("none", None), (None, out[0]), ("zz", out[1])]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "t", "s", "f", 2) for x in rows], DIRTY).repartition(3)


def windows(s, n):
    return {s[i : i + n] for i in range(len(s) - n + 1)}


def brute_pairs(rows, least=0.5, width=5):
    s = {i: windows(t, width) for i, t in rows if i is not None and t and len(t) >= width}
    ids = sorted(s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(s[a] & s[b]) >= least * len(s[a] | s[b])}


@pytest.mark.parametrize("seed", range(2))
def test_pairs_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = {tuple(x) for x in nd.near_duplicate_pairs(frame(spark, rows), "id", "seq").collect()}
    assert got == brute_pairs(rows)


@pytest.mark.parametrize("least", [0.5, 0.3])
def test_exact_mode_loses_nothing(spark, least):
    rows = corpus(11)
    got = {tuple(x) for x in nd.near_duplicate_pairs(frame(spark, rows), "id", "seq", least=least, exact=True).collect()}
    assert got == brute_pairs(rows, least)


def test_groups_follow_links(spark):
    rows = corpus(7)
    want = brute_pairs(rows)
    root = {i: i for i, t in rows if i is not None and t and len(t) >= 5}
    for _ in root:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.group_id for r in nd.near_duplicate_groups(frame(spark, rows), "id", "seq").collect()}
    assert got == root


def test_empty_tables(spark):
    df = frame(spark, corpus(1)).limit(0)
    assert nd.near_duplicate_pairs(df, "id", "seq").count() == 0
    assert nd.near_duplicate_groups(df, "id", "seq").count() == 0
    assert ss.shared_runs(df, "id", "seq").count() == 0
    assert ss.shared_share(df, "id", "seq").count() == 0


def test_buckets_cut_into_blocks_lose_nothing(spark):
    r = random.Random(3)
    base = "".join(r.choice(LETTERS) for _ in range(200))
    rows = [(f"p{i}", edited(r, base, 6)) for i in range(150)]
    whole = {tuple(x)[:2] for x in nd.class_links(frame(spark, rows), "id", "seq").collect()}
    # Cut in the bucket's own task; packed by the tasks before the shuffle; both.
    for block, often in ((16, 1 << 30), (8_192, 2), (4, 5)):
        cut = {tuple(x)[:2] for x in nd.class_links(frame(spark, rows), "id", "seq", block=block, often=often).collect()}
        assert whole == cut and len(whole) > 3000


def test_blocks_meet_in_a_grid(spark):
    g = np.random.default_rng(2)
    fp = g.integers(0, 2**63, (200, nd.WORDS), dtype=np.uint64)
    fp[100:150] = fp[:50]
    rows = [(7, fp[i : i + 5].tobytes()) for i in range(0, 200, 5)] + [(8, fp[:3].tobytes())]
    got = nd._compare_blocks(spark.createDataFrame([(k, bytearray(x)) for k, x in rows], "key long, fps binary"), 0, group=3).collect()
    assert sorted(r.a0 & (1 << 64) - 1 for r in got) == sorted(fp[:50, 0].tolist())


def test_hot_windows_follow_the_texts(spark):
    """A motif in a tenth of the texts is hot however rows lie, also where one text repeats another window."""
    r = random.Random(4)
    word = lambda n: "".join(r.choice(LETTERS) for _ in range(n))
    motif = word(40)
    texts = [word(100) + (motif if i % 10 == 0 else word(40)) + word(100) for i in range(400)] + ["ACDEF" * 2000]
    tables = []
    for parts in (1, 7):
        df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
        tables.append(nd.hot_slots(df, 5))
    assert (tables[0][0] == tables[1][0]).all() and tables[0][1] == tables[1][1] == 401
    h, _ = nd.window_hashes(*letters(pa.array([motif, "ACDEFACDEF"])), 5)
    hot = tables[0][0][nd._slot(h)]
    assert hot[:36].all() and not hot[36:].any()


def test_pairs_that_share_a_hot_motif_meet():
    """Of 3,000 pairs at 0.5 whose shared part is a fifth hot, few lack a common key."""
    bands = inspect.signature(nd.class_links).parameters["bands"].default
    g, pairs = np.random.default_rng(6), 3_000
    h = g.integers(0, 2**63, (pairs, 120), dtype=np.uint64)
    h[:, :12] = h[0, :12]
    keys = []
    for a in (60, 90):
        x = np.concatenate([h[:, :60], h[:, a : a + 30]], axis=1)
        n = np.full(pairs, 90)
        row, key = nd._banded(bands)(x.ravel(), n, nd.min_hashes(x.ravel(), n, nd.BITS), np.isin(x.ravel(), h[0, :12]))
        keys.append(set(zip(row.tolist(), key.tolist(), strict=True)))
    met = {r for r, _ in keys[0] & keys[1]}
    assert pairs - len(met) <= 6, pairs - len(met)
    alone = np.unique([k for _, k in keys[0]], return_counts=True)[1]
    assert alone.max() < pairs // 20  # the motif makes no bucket of all


def distance(a, b):
    return sum(int(x ^ y).bit_count() for x, y in zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("radius", [0, 40, 51, 90, 127])
def test_bit_sliced_distances(radius):
    g = np.random.default_rng(radius)
    fp = g.integers(0, 2**63, (150, nd.WORDS), dtype=np.uint64)
    for i in range(60):  # near ones: a few bits flipped
        fp[90 + i] = fp[i]
        for b in g.integers(0, nd.BITS, g.integers(0, 90)):
            fp[90 + i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if distance(fp[i], fp[j]) <= radius}
    i, j = nd.near_pairs(fp, None, radius)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    a, b = nd.near_pairs(fp[:70], fp[70:], radius)
    assert {(x, y + 70) for x, y in zip(a.tolist(), b.tolist(), strict=True)} == {(x, y) for x, y in want if x < 70 <= y}
    p, q = np.triu_indices(150, 1)
    ok = nd.near_listed(fp, p, q, radius)
    assert set(zip(p[ok].tolist(), q[ok].tolist(), strict=True)) == want
    key = np.repeat(np.arange(4), [70, 3, 1, 76])
    i, j = nd._bucket_pairs(key, fp, radius)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for x, y in want if key[x] == key[y]}


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x", "y"), ("y", "z"), ("x", "x"), ("z", "x")]
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(41)} | {"x": "x", "y": "x", "z": "x"}


def brute_runs(rows, least=40):
    of = defaultdict(set)
    texts = {(i, t) for i, t in rows if i is not None and t}
    for i, t in texts:
        for w in windows(t, least):
            of[w].add(i)
    out = set()
    for i, t in texts:
        shared = set()
        for k in range(len(t) - least + 1):
            if len(of[t[k : k + least]]) > 1:
                shared |= set(range(k + 1, k + least + 1))
        for p in shared:
            if p - 1 not in shared:
                e = p
                while e + 1 in shared:
                    e += 1
                out.add((i, p, e))
    return out


@pytest.mark.parametrize("hot", [60_000, 3])
@pytest.mark.parametrize("seed", range(2))
def test_shared_runs_against_brute_force(spark, seed, hot):
    rows = corpus(seed + 20)
    got = [tuple(x) for x in ss.shared_runs(frame(spark, rows), "id", "seq", hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_runs(rows)


def test_hot_anchor_reaches_its_task_in_few_rows(spark):
    """A stretch in all of 400 texts: what gathers under its anchors is two rows and a number a task."""
    r = random.Random(8)
    word = lambda n: "".join(r.choice(LETTERS) for _ in range(n))
    motif = word(60)
    df = spark.createDataFrame([(f"p{i}", word(80) + motif + word(80)) for i in range(400)], "id string, seq string").repartition(4)
    rows = ss._anchor_rows(ss._texts(df, "id", "seq", 40), 40)
    assert rows.groupBy("part").count().agg({"count": "max"}).collect()[0][0] <= 12
    kept = ss._several(rows, 300).collect()
    assert sum(x.slot is not None for x in kept) >= 1 and sum(x.slot is None for x in kept) >= 400
    whole = {tuple(x) for x in ss.shared_runs(df, "id", "seq").collect()}
    assert whole == {tuple(x) for x in ss.shared_runs(df, "id", "seq", hot=300).collect()}
    assert {x[0] for x in whole} == {f"p{i}" for i in range(400)}


def test_share_of_records(spark):
    got = {r.id: (r.letters, r.shared) for r in ss.shared_share(spark.createDataFrame([("a", "Q" * 50), ("b", "Q" * 45), ("c", "W"), ("d", ""), ("e", None)], "id string, seq string"), "id", "seq").collect()}
    assert got == {"a": (50, 50), "b": (45, 45), "c": (1, 0), "d": (0, 0)}


def test_windows():
    data, off = letters(pa.array(["abcabc", "", "xabc"]))
    h = rolling(data, 3, 5, 1)
    assert h[0] == h[3] == h[7] and h[0] != h[1]
    at, n = inside(off, 3)
    assert at.tolist() == [0, 1, 2, 3, 6, 7] and n.tolist() == [4, 0, 2]
    wide, _ = letters(pa.array(["ä", "abcabc"]))
    assert rolling(wide, 3, 5, 1)[1] == h[0]
    x = np.arange(50)[::-1] % 7
    for w in (1, 2, 5, 29):
        assert sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(50 - w + 1)]


def test_long_texts_are_taken_whole(spark):
    r = random.Random(9)
    long = "".join(r.choice(LETTERS) for _ in range(60_000))
    rows = [("a", long), ("b", long[30_000:] + long[:30_000]), ("c", long[59_900:] + "".join(r.choice(LETTERS) for _ in range(500)))]
    assert {tuple(x) for x in nd.near_duplicate_pairs(frame(spark, rows), "id", "seq").collect()} == {("a", "b")}
    got = {tuple(x) for x in ss.shared_runs(frame(spark, rows), "id", "seq").collect()}
    assert got == {("a", 1, 60_000), ("b", 1, 60_000), ("c", 1, 100)} | {x for x in brute_runs(rows) if x[0] == "c"}
