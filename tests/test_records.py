"""References, intervals and value frequencies on small fixtures, dirty ones included."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociq.functions.keys import clean_sequence, trim_key
from lociq.operators import frequency, intervals, references

T = lambda day: dt.datetime(2024, 1, day)


def refs(spark, parents, children):
    p = spark.createDataFrame(parents, "pk string, since timestamp_ntz, `key` int, at string")
    c = spark.createDataFrame(children, "rec string, ck string, at timestamp_ntz, `key` int, since string")
    return [references.Parent("P", p, F.col("pk"), F.col("since"))], [references.Child("C", "P", c, F.col("ck"), F.col("rec"), F.col("at"))]


def test_orphans_and_their_counts(spark):
    parents = [("a", T(5), 1, "x"), ("a", T(9), 1, "x"), ("b", None, 1, "x"), ("d", T(1), 1, "x")]
    children = [
        ("1", "a", T(5), 0, "y"), ("2", "a", T(4), 0, "y"), ("3", "b", T(9), 0, "y"), ("4", "c", T(9), 0, "y"), ("5", None, T(9), 0, "y"),
        ("6", "d", None, 0, "y"), ("4", "c", T(9), 0, "y"), ("7", "d", T(2), 0, "y"), ("8", "", T(2), 0, "y"), ("9", "d", T(31), 0, "y"),
    ]
    p, c = refs(spark, parents, children)
    got = Counter(r.record_key for r in references.orphans(p, c).collect())
    assert got == {"2": 1, "3": 1, "4": 2, "5": 1, "6": 1, "8": 1}
    n = {r.period: (r.references, r.orphan_keys) for r in references.orphan_counts(p, c).collect()}
    assert n == {"2024-01": (6, 5), None: (1, 1)}


def test_orphans_of_empty_tables(spark):
    p, c = refs(spark, [], [])
    assert references.orphans(p, c).count() == 0
    p, c = refs(spark, [], [("1", "a", T(1), 0, "y")])
    assert references.orphans(p, c).count() == 1


def test_hot_orphan_key_keeps_all_rows(spark):
    p, c = refs(spark, [("x", T(1), 0, "")], [(str(i), "hot" if i % 3 == 0 else f"k{i}", T(2), 0, "") for i in range(3000)])
    assert references.orphans(p, c).count() == 3000


def brute_gaps(rows):
    by = defaultdict(list)
    for g, c, s, e in rows:
        if s is not None and e is not None:
            by[g, c].append((min(s, e), max(s, e)))
    out, stretches = set(), set()
    for k, v in by.items():
        covered = set()
        for s, e in v:
            covered |= set(range(s, e + 1))
        run = sorted(covered)
        begin = run[0]
        for a, b in zip(run, run[1:]):
            if b > a + 1:
                out.add((*k, a + 1, b - 1))
                stretches.add((*k, begin, a))
                begin = b
        stretches.add((*k, begin, run[-1]))
    return out, stretches


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "genome string, contig string, start int, `end` int, _part int, fresh string")


@pytest.mark.parametrize("seed", range(3))
def test_gaps_and_stretches(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["g", "h", None, "i"]), r.choice(["c", "d"]), r.choice([None, *range(-40, 200)]), r.randint(-40, 200)) for _ in range(60)]
    rows += rows[:10] + [("one", "c", 5, 5), ("hot", "c", 1, 10_000), ("hot", "c", 3, 4)]
    df = frame(spark, rows).repartition(7)
    gaps, stretches = brute_gaps(rows)
    assert {tuple(x) for x in intervals.gaps(df, ["genome", "contig"]).collect()} == gaps
    assert {tuple(x)[:4] for x in intervals.islands(df, ["genome", "contig"]).collect()} == stretches


def test_one_entity_over_many_partitions(spark):
    rows = [("g", "c", 10 * i, 10 * i + 4) for i in range(5000)] + [("g", "c", 20_000, 30_000)]
    df = frame(spark, rows).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        gaps = {tuple(x)[2:] for x in intervals.gaps(df, ["genome", "contig"]).collect()}
        islands = intervals.islands(df, ["genome", "contig"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert gaps == {(10 * i + 5, 10 * i + 9) for i in range(4999) if not 20_000 <= 10 * i + 5 <= 30_000}
    assert len(islands) == len(gaps) + 1
    assert sum(x.n_starts for x in islands) == 5000


def test_gaps_of_an_empty_table(spark):
    assert intervals.gaps(frame(spark, []), ["genome", "contig"]).count() == 0
    assert intervals.islands(frame(spark, [("g", "c", None, 1)]), ["genome", "contig"]).count() == 0


KEYED = "k string, v int, n int, bin string"


def test_key_stats_with_nulls_and_ties(spark):
    rows = [("a", 1), ("a", 2), ("a", 2), ("a", 1), ("a", None), (None, 3), ("b", None), ("c", 7)]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], KEYED)
    got = {r["key"]: tuple(r)[1:] for r in frequency.key_stats(df, F.col("k"), F.col("v")).collect()}
    assert got == {"a": (5, 4, 2, 1, 2), None: (1, 1, 1, 3, 1), "b": (1, 0, 0, None, 0), "c": (1, 1, 1, 7, 1)}
    assert frequency.key_stats(df.limit(0), F.col("k"), F.col("v")).count() == 0


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_percentile_is_exact(spark, p):
    r = random.Random(5)
    rows = [(r.choice("aaab"), r.randint(-900, 900)) for _ in range(500)] + [(None, 4), ("z", None)]
    df = spark.createDataFrame([(*x, 0, "") for x in rows], KEYED)
    want = {}
    for k in {x[0] for x in rows if x[1] is not None}:
        v = sorted(b for a, b in rows if a == k and b is not None)
        want[k] = v[max(1, -(-int(p * 100) * len(v) // 100)) - 1]
    assert {x["key"]: x["percentile"] for x in frequency.key_percentile(df, F.col("k"), F.col("v"), p, 16).collect()} == want


def test_heavy_keys_at_the_limit(spark):
    rows = [("a", 0)] * 4 + [(f"x{i}", i) for i in range(96)] + [("", 1), (None, 1)] * 5
    df = spark.createDataFrame([(*r, 0, "") for r in rows], KEYED)
    found = frequency.heavy_keys([("f", df, F.col("k"), F.col("v")), ("g", df.limit(0), F.col("k"), F.col("v"))], "0.04").collect()
    assert [(r.field_name, r.key_value, r.rows, r.total) for r in found] == [("f", "a", 4, 100)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ* \t\n\r\x0b  X", max_size=8)), max_size=20))
def test_cleaned_sequence(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r.i: r.c for r in df.select("i", clean_sequence("s").alias("c")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else "".join(t.split()).upper().removesuffix("*")
        assert got[i] == want


def test_trimmed_key(spark):
    df = spark.createDataFrame([(" \ta b\t ",), ("\n",), (None,)], "k string")
    assert [r[0] for r in df.select(trim_key("k")).collect()] == ["a b", "\n", None]


def test_stretches_of_one_entity_over_many_partitions(spark):
    """Carried labels: long stretches that nest and touch, in more partitions than stretches, and
    entity columns of names that are used inside."""
    import random

    r = random.Random(2)
    rows, at = [], 0
    for _ in range(40):
        at += r.randint(2, 50)
        begin = at
        for _ in range(r.randint(1, 60)):
            rows.append((begin + r.randint(0, 900), begin + r.randint(0, 900)))
        at = begin + 901
    covered = set()
    for a, b in rows:
        covered |= set(range(min(a, b), max(a, b) + 1))
    want, p = [], None
    for x in sorted(covered):
        if p is None or x > p[1] + 1:
            p = [x, x]
            want.append(p)
        p[1] = x
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for names in (["c"], ["_start", "s"], ["__s", "__part"]):
            df = spark.createDataFrame([(*["k"] * len(names), a, b) for a, b in rows], ", ".join(f"`{n}` string" for n in names) + ", x int, y int")
            got = intervals.islands(df, names, "x", "y")
            assert got.columns == [*names, "stretch_start", "stretch_end", "n_starts"]
            assert sorted([g.stretch_start, g.stretch_end] for g in got.collect()) == want
            assert sum(g.n_starts for g in got.collect()) == len({min(a, b) for a, b in rows})
            gaps = sorted((g.gap_start, g.gap_end) for g in intervals.gaps(df, names, "x", "y").collect())
            assert gaps == [(a[1] + 1, b[0] - 1) for a, b in zip(want, want[1:])]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_numbers_run_on_over_partitions(spark):
    from lociq.operators.ordered import numbered

    rows = [("hot", i) for i in range(500)] + [(f"g{i}", 0) for i in range(20)] + [(None, 3), (None, 1)]
    df = spark.createDataFrame([(b, a, "x") for a, b in rows], "o int, g string, place string").repartition(5)
    got = numbered(df, ("g",), ("o",)).collect()
    assert {(x.g, x.o): x.place for x in got} == {("hot", i): i + 1 for i in range(500)} | {(f"g{i}", 0): 1 for i in range(20)} | {(None, 1): 1, (None, 3): 2}
    assert [x.n for x in sorted(numbered(df, (), ("g", "o"), "n").collect(), key=lambda x: (x.g is not None, x.g, x.o))] == list(range(1, 523))
    assert numbered(df.limit(0), ("g",), ("o",)).count() == 0


def test_percentile_of_wide_values(spark):
    """Values over nearly all of 64 bits: more than one level, exact at each."""
    import random

    from lociq.operators import frequency

    r = random.Random(3)
    rows = [(k, r.choice([r.randint(-(1 << 61), 1 << 61), r.randint(0, 50), 7])) for k in ("a", "b", None) for _ in range(101)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    for p in (0.0, 0.5, 0.9, 1.0):
        want = {}
        for k in ("a", "b", None):
            v = sorted(x for q, x in rows if q == k)
            want[k] = v[max(1, -(-int(p * 1000) * len(v) // 1000)) - 1]
        assert {x.key: x.percentile for x in frequency.key_percentile(df, F.col("k"), F.col("v"), p).collect()} == want
