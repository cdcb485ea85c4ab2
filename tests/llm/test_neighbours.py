"""Neighbours of items with many terms."""

import random
from collections import Counter, defaultdict

import numpy as np

from lociq.llm import packing
from lociq.llm.packing import Index


def test_a_seed_asks_with_all_of_its_terms():
    rare, common = [f"rare{i}" for i in range(24)], [f"common{i}" for i in range(10)]
    texts = [" ".join(rare + common), *rare, " ".join(common), " ".join(common), "other words"]
    index, used = Index(texts), np.zeros(len(texts), np.uint8)
    best = list(index.neighbours(0, used))
    assert set(best) == set(range(1, 27)) and set(best[:2]) == {25, 26}
    used[[3, 25]] = 1
    assert list(index.without(used).neighbours(0, used)) == list(index.neighbours(0, used)) == [i for i in best if i not in (3, 25)]


def test_best_come_first_however_many_are_asked_for():
    """Taken in parts, with many ties, neighbours come in the order of a whole sort."""
    r = random.Random(3)
    texts = [" ".join(r.choices([f"w{i}" for i in range(12)], k=r.randint(1, 6))) for _ in range(1500)]
    index, used = Index(texts), np.zeros(1500, np.uint8)
    used[r.sample(range(1500), 200)] = 1
    for seed in range(5):
        asked = [slice(index.start[t], index.start[t + 1]) for t in index.terms[seed]]
        score = sum(np.bincount(index.item[s], index.weight[s], index.n) for s in asked)
        want = sorted((i for i in range(1500) if score[i] and not used[i] and i != seed), key=lambda i: (-score[i], i))
        got = list(index.neighbours(seed, used))
        assert sorted(got) == sorted(want) and np.allclose(score[got], score[want])


def test_shards_hold_texts_about_the_same(spark):
    """Six vocabularies over shards of a sixth: nearly all of a text's likes share its shard."""
    r = random.Random(5)
    rows = [(i, f"t{i % 6}", " ".join(f"v{i % 6}x{r.randint(0, 40)}" for _ in range(20)), 10) for i in range(600)] + [(None, "t0", None, 0)] * 3 + [(700 + i, "copy", "v1x1 v1x2 v1x3", 10) for i in range(200)]
    df = spark.createDataFrame([(a, c, d, b) for a, b, c, d in rows], "id long, text string, tokens int, part string").repartition(4)
    specs = spark.createDataFrame([(1, 100)], "spec_id int, capacity int")
    out = packing.pack(df, specs, "id", "text", "tokens", shard_items=100).collect()
    assert Counter(x.id for x in out) == Counter(x[0] for x in rows)
    of = defaultdict(Counter)
    for x in out:
        if x.id is not None and x.id < 600:
            of[x.id % 6][x.container.split("-")[0]] += 1
    assert sum(max(c.values()) for c in of.values()) > 360  # 17 % by chance
    assert packing.violations(packing.pack(df.where("id < 600"), specs, "id", "text", "tokens", shard_items=100), df, specs, "id", "tokens").first()[2:] == (600, 0, 0, 0)
