"""Blocks, overlaps and patterns on small fixtures."""

import math
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociq.functions import render
from lociq.operators import blocks, overlap, patterns

GENE = "genomeID string, contig string, proteinID string, start int, `end` int"


def block_of(spark, rows, **kw):
    df = spark.createDataFrame(rows, GENE)
    return {r.proteinID: r.block for r in blocks.gap_blocks(df, **kw).collect()}


def test_gap_at_the_limit_and_beyond(spark):
    rows = [("g", "c", "a", 1, 100), ("g", "c", "b", 3600, 3700), ("g", "c", "x", 7201, 7300), ("g", "c", "y", 7301, 7400)]
    assert block_of(spark, rows) == {"a": "g_1", "b": "g_1", "x": "g_2", "y": "g_2"}


def test_nested_gene_then_far_gene_splits(spark):
    rows = [("g", "c", "a", 1, 9000), ("g", "c", "b", 100, 200), ("g", "c", "x", 8000, 8100)]
    assert block_of(spark, rows) == {"a": "g_1", "b": "g_1"}


def test_numbers_run_over_contigs_and_skip_singletons(spark):
    rows = [("g", "a", "1", 1, 2), ("g", "b", "2", 1, 2), ("g", "b", "3", 3, 4), ("g", "c", "4", 1, 2), ("g", "c", "5", 1, 2), ("h", "a", "6", 1, 2)]
    assert block_of(spark, rows) == {"2": "g_1", "3": "g_1", "4": "g_2", "5": "g_2"}
    assert block_of(spark, rows, drop_trailing=True) == {"2": "g_1", "3": "g_1"}
    assert block_of(spark, []) == {}


def test_neighbourhood_sample_is_one_block(spark):
    starts = [203348, 206250, 206600, 207000, 207590, 208500, 209500, 210250]
    ends = [203686, 206590, 206990, 207503, 208490, 209490, 210183, 210900]
    rows = [("g", "NZ_FMWD01000005.1", str(i), s, e) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]
    assert set(block_of(spark, rows).values()) == {"g_1"}


def test_order_and_partitions_do_not_matter(spark):
    r = random.Random(1)
    rows = [("g", r.choice("ab"), str(i), s := r.randint(1, 90000), s + r.randint(0, 900)) for i in range(80)]
    a = block_of(spark, rows)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, GENE).repartition(5)
    assert {x.proteinID: x.block for x in blocks.gap_blocks(df).collect()} == a


def model_fold(hits):
    kept = []
    for s, e, d, c in hits:
        over = [k for k in kept if k[0] <= e and s <= k[1]]
        if any(not math.floor(k[3]) < c for k in over):
            continue
        kept = [k for k in kept if k not in over] + [(s, e, d, c)]
    return sorted((s, e, d, math.floor(c)) for s, e, d, c in kept)


def fold(spark, groups):
    rows = [(g, i, s, e, d, float(c)) for g, hits in enumerate(groups) for i, (s, e, d, c) in enumerate(hits)]
    df = spark.createDataFrame(rows, "proteinID int, ID int, domStart int, domEnd int, domain string, score double")
    return {r.proteinID: [tuple(x) for x in r.domains] for r in overlap.overlap_fold(df, "proteinID", "ID").collect()}


def test_fold_is_not_best_first(spark):
    got = fold(spark, [[(1, 10, "a", 10), (5, 15, "b", 20), (12, 25, "c", 30)], [(1, 10, "a", 100.7), (2, 9, "b", 100.3)], [(1, 5, "a", 7), (5, 9, "b", 7)]])
    assert got == {0: [(12, 25, "c", 30)], 1: [(2, 9, "b", 100)], 2: [(1, 5, "a", 7)]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 20), st.sampled_from("abc"), st.sampled_from([5, 5.4, 9.9, 20])), min_size=1, max_size=9), min_size=1, max_size=6))
def test_fold_follows_the_model(spark, groups):
    groups = [[(s, s + n, d, c) for s, n, d, c in g] for g in groups]
    assert fold(spark, groups) == {i: model_fold(g) for i, g in enumerate(groups)}


def test_overlap_pairs_meet_once(spark):
    r = random.Random(2)
    rows = [(r.choice("pq"), i, s := r.randint(1, 400), s + r.randint(0, 150), "d", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "proteinID string, ID int, domStart int, domEnd int, bin string, j int")
    want = sorted((p, i, j) for p, i, s, e, *_ in rows for q, j, t, f, *_ in rows if p == q and i < j and s <= f and t <= e)
    assert sorted(tuple(x) for x in overlap.overlap_pairs(df, "proteinID", "ID").collect()) == want


def test_cutoffs_are_strict(spark):
    hits = spark.createDataFrame([("m", 5.0), ("m", 5.1), ("m", 0.5), ("m", 0.6), ("x", 10.0), ("x", 10.5), ("m", None)], "domain string, score double")
    cuts = spark.createDataFrame([("m", 5.0)], "hmm string, cutoff double")
    assert sorted(tuple(r) for r in overlap.above_cutoff(hits, cuts).collect()) == [("m", 5.1), ("x", 10.5)]
    assert sorted(tuple(r) for r in overlap.below_cutoff(hits, cuts).collect()) == [("m", 0.6)]


def name(spark, tokens, dictionary, **kw):
    b = spark.createDataFrame([("b", tokens)], "block string, tokens array<string>")
    p = spark.createDataFrame(dictionary, "pattern_id int, keyword string, genes array<string>")
    return {r.pattern_id: (r.completeness, r.collinear) for r in patterns.pattern_matches(b, p, "block", **kw).collect()}


def test_completeness_and_order(spark):
    tokens = "oxDsrC oxDsrA oxDsrB DsrE DsrF DsrH oxDsrC oxDsrM".split()
    got = name(spark, tokens, [(1, "oxDsr", "oxDsrA oxDsrB oxDsrC DsrE DsrF DsrH".split()), (2, "oxDsrMK", "oxDsrM K1 K2 K3 K4".split()), (3, "half", ["DsrE", "no"]), (4, "back", ["DsrH", "DsrF", "DsrE"]), (5, "one", ["DsrH"])])
    assert got == {1: (1.0, False), 4: (1.0, True), 5: (1.0, True)}
    assert name(spark, tokens, [(3, "half", ["DsrE", "no"])], least=0.4, check_order=False) == {3: (0.5, None)}


def test_last_pattern_of_a_name_counts(spark):
    m = spark.createDataFrame([("b", 1, "k", 1.0, True), ("b", 7, "k", 0.6, False)], "block string, pattern_id int, keyword string, completeness double, collinear boolean")
    assert [tuple(r) for r in patterns.named(m, "block").collect()] == [("b", "k", 0.6, False)]


def test_rescue_is_strict_and_on_the_contig(spark):
    missing = spark.createDataFrame([("b", "t")], "block string, token string")
    extent = spark.createDataFrame([("b", "g", "c", 1000, 2000)], "block string, genomeID string, contig string, block_start int, block_end int")
    weak = [("g", "c", "edge", "t", 5500, 5600), ("g", "c", "in", "t", 5499, 5600), ("g", "d", "other", "t", 1500, 1600), ("g", "c", "kind", "u", 1500, 1600)]
    w = spark.createDataFrame(weak, "genomeID string, contig string, proteinID string, token string, start int, `end` int")
    assert [r.proteinID for r in patterns.rescue(missing, extent, w, "block").collect()] == ["in"]


def test_renderings(spark):
    df = spark.createDataFrame([("grp0_SoxA",), ("SoxX-SoxA",), ("grp0_SoxX-grp0_SoxA",), ("A",)], "a string")
    assert [r[0] for r in df.select(render.token("a")).collect()] == ["SoxA", "SoxX-SoxA", "SoxA", "A"]
    g = spark.createDataFrame([("a b", "c"), ("a", None)], "x string, y string")
    assert [r[0] for r in g.select(render.lineage(["x", "y"])).collect()] == ["a-b_c", "0"]
    d = spark.sql("SELECT array(named_struct('start', 5, 'end', 9, 'domain', 'B', 'score', 2), named_struct('start', 1, 'end', 4, 'domain', 'A', 'score', 7)) AS d")
    assert tuple(d.select(render.architecture("d"), render.coordinates("d"), render.scores("d")).first()) == ("A-B", "1:4-5:9", "7-2")
    assert spark.range(1).select(render.genome_of(F.lit("/x/RS_GCF_1.1.faa.gz"))).first()[0] == "RS_GCF_1"
