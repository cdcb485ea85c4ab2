"""Queries over blocks, patterns, intervals and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions import render
from lociq.operators import blocks, overlap, patterns, store
from lociq.plans.sqlviews import BLOCK, DOMAIN, FOLD, GENOME, KEYWORD, MATCH, PATTERN, PLACED, PROTEIN, TOKEN, sql
from lociq.schemas import RANKS
from lociq.sources import catalog, sinks

D = 3500


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.gap_blocks(catalog.placed(spark, d), D)


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_fold(catalog.domains(spark, d), "proteinID", "ID")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d).select("proteinID", render.token(render.architecture("domains")).alias("token"))


def _block_tokens(spark: SparkSession, d: str) -> DataFrame:
    return patterns.token_rows(_blocks(spark, d), _tokens(spark, d), "block")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return patterns.pattern_matches(_block_tokens(spark, d), catalog.patterns(spark, d), "block")


def win1_gap_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("genomeID", "contig", "proteinID", "block")


def win1_without_trailing(spark: SparkSession, d: str) -> DataFrame:
    return blocks.gap_blocks(catalog.placed(spark, d), D, drop_trailing=True).select("proteinID", "block")


def win2_block_numbering(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("genomeID", F.substring_index("block", "_", -1).cast("int").alias("n")).groupBy("genomeID").agg(F.countDistinct("n").alias("n_blocks"), F.max("n").alias("last_n"))


def agg9_block_extent(spark: SparkSession, d: str) -> DataFrame:
    return blocks.extents(_blocks(spark, d))


def pat1_pattern_completeness(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("block", "pattern_id", "keyword", F.round("completeness", 6).alias("completeness"))


def pat2_collinearity(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("block", "pattern_id", "collinear")


def pat3_last_pattern_wins(spark: SparkSession, d: str) -> DataFrame:
    return patterns.named(_matches(spark, d), "block").select("block", "keyword", F.round("completeness", 6).alias("completeness"), "collinear")


def pat4_missing_members(spark: SparkSession, d: str) -> DataFrame:
    tokens = _block_tokens(spark, d)
    p = catalog.patterns(spark, d)
    names = patterns.named(patterns.pattern_matches(tokens, p, "block"), "block")
    return patterns.missing_members(names, tokens, p, "block")


def _rescued(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """(block, proteinID, token) of weak hits that blocks of the proteins with ``hits`` lack."""
    m = blocks.gap_blocks(catalog.placed(spark, d).join(hits.select("proteinID").distinct(), "proteinID", "left_semi"), D)
    tokens = patterns.token_rows(m, overlap.overlap_fold(hits, "proteinID", "ID").select("proteinID", render.token(render.architecture("domains")).alias("token")), "block")
    p = catalog.patterns(spark, d)
    missing = patterns.missing_members(patterns.named(patterns.pattern_matches(tokens, p, "block"), "block"), tokens, p, "block")
    extent = m.groupBy("block").agg(F.min("genomeID").alias("genomeID"), F.min("contig").alias("contig"), F.min("start").alias("block_start"), F.max("end").alias("block_end"))
    weak = overlap.below_cutoff(catalog.domains(spark, d, "ID", "proteinID", "domain", "score"), catalog.thresholds(spark, d)).select("proteinID", F.col("domain").alias("token")).distinct()
    return patterns.rescue(missing, extent, weak.join(catalog.placed(spark, d), "proteinID"), "block", D)


def pat5_rescue_band_join(spark: SparkSession, d: str) -> DataFrame:
    m = _blocks(spark, d)
    tokens = patterns.token_rows(m, _tokens(spark, d), "block")
    p = catalog.patterns(spark, d)
    missing = patterns.missing_members(patterns.named(patterns.pattern_matches(tokens, p, "block"), "block"), tokens, p, "block")
    extent = m.groupBy("block").agg(F.min("genomeID").alias("genomeID"), F.min("contig").alias("contig"), F.min("start").alias("block_start"), F.max("end").alias("block_end"))
    weak = overlap.below_cutoff(catalog.domains(spark, d, "ID", "proteinID", "domain", "score"), catalog.thresholds(spark, d)).select("proteinID", F.col("domain").alias("token")).distinct()
    return patterns.rescue(missing, extent, weak.join(catalog.placed(spark, d), "proteinID"), "block", D)


def pat6_without_order(spark: SparkSession, d: str) -> DataFrame:
    m = patterns.pattern_matches(_block_tokens(spark, d), catalog.patterns(spark, d), "block", check_order=False)
    return m.select("block", "keyword", F.when(F.col("collinear").isNull(), ".").otherwise("1").alias("csb")).distinct()


def int1_overlap_fold(spark: SparkSession, d: str) -> DataFrame:
    kept = _folded(spark, d).select("proteinID", F.explode("domains").alias("x"))
    return kept.select("proteinID", F.col("x.domain").alias("domain"), F.col("x.start").alias("dom_start"), F.col("x.end").alias("dom_end"), F.col("x.score").alias("score"))


def int2_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = catalog.domains(spark, d).where("domStart IS NOT NULL AND domEnd IS NOT NULL")
    return overlap.overlap_pairs(m, "proteinID", "ID")


def flt1_threshold_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return overlap.above_cutoff(catalog.domains(spark, d, "ID", "domain", "score"), catalog.thresholds(spark, d)).select("ID", "domain", "score")


def flt2_subcutoff_band(spark: SparkSession, d: str) -> DataFrame:
    return overlap.below_cutoff(catalog.domains(spark, d, "ID", "domain", "score"), catalog.thresholds(spark, d)).select("ID", "domain", "score")


def src9_cutoff_modes(spark: SparkSession, d: str) -> DataFrame:
    m = catalog.domains(spark, d, "ID", "domain", "score")
    out = None
    for mode in ("optimized", "trusted", "noise"):
        n = overlap.above_cutoff(m, catalog.thresholds(spark, d, mode)).groupBy("domain").agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "domain", "n")
        out = n if out is None else out.unionByName(n)
    return out


def agg10_best_hsp(spark: SparkSession, d: str) -> DataFrame:
    m = catalog.domains(spark, d).where("score IS NOT NULL")
    return overlap.best_report(m, ["proteinID", "domain"], "score", "ID").select("proteinID", "domain", "ID", "score")


def agg11_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return overlap.last_write(catalog.domains(spark, d), ["proteinID"], "ID").select("proteinID", "ID", "domain")


def agg12_domain_counts(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d).select("proteinID", F.size("domains").alias("n_domains"))


def agg14_architecture_groups(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d).groupBy(render.architecture("domains").alias("arch")).agg(F.count(F.lit(1)).alias("n_proteins"))


def agg18_rebuild_members(spark: SparkSession, d: str) -> DataFrame:
    return catalog.proteins(spark, d, "proteinID", "genomeID").join(_folded(spark, d), "proteinID").select("genomeID", "proteinID", render.architecture("domains").alias("arch"), render.scores("domains").alias("scores"))


def agg19_rebuild_blocks(spark: SparkSession, d: str) -> DataFrame:
    p = catalog.placed(spark, d, "clusterID").where("clusterID IS NOT NULL").join(_tokens(spark, d), "proteinID")
    t = p.groupBy("clusterID").agg(F.array_sort(F.collect_list(F.struct("start", "end", "proteinID", "token"))).alias("g"))
    return t.select("clusterID", F.array_join(F.transform("g", lambda x: x["token"]), " ").alias("types"), F.size("g").alias("genes"))


def prj2_architecture(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d).select("proteinID", render.architecture("domains").alias("arch"), render.coordinates("domains").alias("coords"), render.scores("domains").alias("scores"))


def prj5_token(spark: SparkSession, d: str) -> DataFrame:
    m = catalog.domains(spark, d, "ID", "domain").select("domain").distinct()
    arch = m.select(F.explode(F.array(F.concat(F.lit("grp0_"), "domain"), F.concat_ws("-", "domain", "domain"), F.col("domain"))).alias("arch"))
    return arch.select("arch", render.token("arch").alias("token")).distinct()


def prj6_block_domains(spark: SparkSession, d: str) -> DataFrame:
    p = catalog.proteins(spark, d, "proteinID", "clusterID").where("clusterID IS NOT NULL").join(catalog.domains(spark, d, "ID", "proteinID", "domain"), "proteinID")
    return p.groupBy("clusterID").agg(F.array_join(F.sort_array(F.collect_set("domain")), ",").alias("domain_set"), F.count("domain").alias("n_domains"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    p = catalog.placed(spark, d, "clusterID", "strand", "locustag").join(_folded(spark, d), "proteinID", "left")
    return p.withColumn("arch", render.architecture("domains")).withColumn("scores", render.scores("domains")).withColumn("coords", render.coordinates("domains"))


def _stored_names(spark: SparkSession, d: str) -> DataFrame:
    return catalog.keywords(spark, d).select("clusterID", "keyword", "completeness", F.col("collinearity").alias("collinear")).distinct()


def win3_relative_index(spark: SparkSession, d: str) -> DataFrame:
    members = catalog.placed(spark, d, "clusterID").where("clusterID IS NOT NULL").select("clusterID", "proteinID", "start", "end")
    anchors = catalog.domains(spark, d, "ID", "proteinID", "score").where("score > 300").select("proteinID")
    return blocks.relative_index(members, anchors)


def win6_relative_coords(spark: SparkSession, d: str) -> DataFrame:
    return blocks.relative_coordinates(catalog.placed(spark, d, "clusterID").where("clusterID IS NOT NULL"))


def jn12_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    p = catalog.proteins(spark, d, "proteinID", "clusterID").where("clusterID IS NOT NULL")
    anchors = p.join(catalog.domains(spark, d, "ID", "proteinID", "score").where("score > 300").select("proteinID").distinct(), "proteinID", "left_semi").select(F.col("proteinID").alias("anchor"), "clusterID")
    return anchors.join(p, "clusterID").select("anchor", "proteinID")


def agg15_keyword_strings(spark: SparkSession, d: str) -> DataFrame:
    return sinks.keyword_strings(_stored_names(spark, d))


def snk1_hit_table(spark: SparkSession, d: str) -> DataFrame:
    t = sinks.hit_table(_hits(spark, d), _stored_names(spark, d), catalog.genomes(spark, d, "genomeID", *RANKS))
    return t.select("genomeID", "proteinID", "arch", "scores", "coords", "contig", "start", F.col("end").alias("stop"), "strand", "locustag", "clusterID", "keywords", "completeness", "csb", "lineage")


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """Records with a high score in a cluster, under the names that a tree gives them."""
    strong = catalog.domains(spark, d, "ID", "proteinID", "score").where("score > 300").select("proteinID").distinct()
    a = catalog.proteins(spark, d, "proteinID", "genomeID", "clusterID").join(strong, "proteinID", "left_semi")
    return sinks.tree_names(a, catalog.genomes(spark, d, "genomeID", *RANKS), ("proteinID",), "proteinID").where("clusterID IS NOT NULL")


def snk8_cluster_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A line a record: its name in the tree, and the genes of its cluster in one colour."""
    m = _hits(spark, d).where("clusterID IS NOT NULL AND arch IS NOT NULL").withColumn("color", F.lit("#000088"))
    return sinks.domain_rows(m, _anchors(spark, d).select("clusterID", "node"))


def snk8_coloured_dataset(spark: SparkSession, d: str) -> DataFrame:
    """The same with a colour an architecture, by first appearance in order of genome, contig and start."""
    m = _hits(spark, d).where("clusterID IS NOT NULL AND arch IS NOT NULL")
    c = sinks.colors(m, "arch", ("genomeID", "contig", "start", "proteinID"))
    return sinks.domain_rows(m.join(c.withColumnRenamed("label", "arch"), "arch"), _anchors(spark, d).select("clusterID", "node"))


def snk7_type_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A symbol a record in the colour of its architecture."""
    m = _hits(spark, d).where("arch IS NOT NULL")
    c = sinks.colors(m, "arch", ("genomeID", "contig", "start", "proteinID"))
    named = sinks.tree_names(m, catalog.genomes(spark, d, "genomeID", *RANKS), ("contig", "start", "proteinID"), "proteinID")
    return sinks.symbol_rows(named.join(c.withColumnRenamed("label", "arch"), "arch"), "node", "color")


def snk12_context_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Neighbourhood table: place, protein, domains, contig, ends, strand and lineage of each gene
    around an anchor, sorted by six ranks, the clade left out."""
    hits = _hits(spark, d).select("proteinID", "genomeID", "arch", "scores", "coords", "contig", "start", "end", "strand")
    rows = win3_relative_index(spark, d).join(hits, "proteinID").join(catalog.genomes(spark, d, "genomeID", *RANKS), "genomeID", "left")
    ranks = [r for r in RANKS if r not in ("Clade", "Species")]
    return rows.orderBy(*ranks, "anchor", "relative").select("anchor", "relative", "proteinID", "arch", "scores", "coords", "contig", "start", F.col("end").alias("stop"), "strand", *RANKS)


def pat5_rescued_domains(spark: SparkSession, d: str) -> DataFrame:
    """Rescue to its end: the domains of all proteins after weak hits that a named block lacks are
    added behind those above their cutoff, and overlaps are resolved again."""
    hits = catalog.domains(spark, d).where("score IS NOT NULL")
    strong = overlap.above_cutoff(hits, catalog.thresholds(spark, d))
    found = _rescued(spark, d, strong)
    weak = overlap.below_cutoff(hits, catalog.thresholds(spark, d)).join(found.select("proteinID", F.col("token").alias("domain")).distinct(), ["proteinID", "domain"], "left_semi")
    kept = store.extend_domains(strong, weak).select("proteinID", F.explode("domains").alias("x"))
    return kept.select("proteinID", F.col("x.domain").alias("domain"), F.col("x.start").alias("dom_start"), F.col("x.end").alias("dom_end"), F.col("x.score").alias("score"))


QUERIES = {f.__name__: f for f in (
    win1_gap_blocks, win1_without_trailing, win2_block_numbering, agg9_block_extent, pat1_pattern_completeness, pat2_collinearity, pat3_last_pattern_wins, pat4_missing_members, pat5_rescue_band_join,
    pat6_without_order, int1_overlap_fold, int2_overlap_pairs, flt1_threshold_cutoff, flt2_subcutoff_band, src9_cutoff_modes, agg10_best_hsp, agg11_last_write_wins, agg12_domain_counts,
    agg14_architecture_groups, agg18_rebuild_members, agg19_rebuild_blocks, prj2_architecture, prj5_token, prj6_block_domains, win3_relative_index, win6_relative_coords, jn12_neighbourhood,
    agg15_keyword_strings, snk1_hit_table, snk7_type_dataset, snk8_cluster_dataset, snk8_coloured_dataset, snk12_context_sorted, pat5_rescued_domains,
)}

_NAMING = (PROTEIN, PLACED, DOMAIN, BLOCK, FOLD, TOKEN, PATTERN, MATCH)
_MISSING = """missing AS (
  SELECT DISTINCT n.block, unnest(list_filter(p.genes, lambda g: NOT list_contains(b.tokens, g))) AS token FROM named n JOIN pattern p USING (keyword) JOIN blocktok b ON b.block = n.block WHERE n.completeness < 1)"""
_PLACE = """member AS (SELECT * FROM placed WHERE clusterID IS NOT NULL),
spot AS (SELECT clusterID, proteinID, row_number() OVER (PARTITION BY clusterID ORDER BY s, e, proteinID) AS place FROM member),
near AS (SELECT a.proteinID AS anchor, b.proteinID, b.place - a.place AS relative FROM spot a JOIN spot b USING (clusterID) WHERE a.proteinID IN (SELECT proteinID FROM domain_ WHERE score > 300))"""
_LINEAGE = "replace(concat_ws('_', " + ", ".join(RANKS) + "), ' ', '-')"
_NAMES = """stored AS (SELECT DISTINCT clusterID, keyword, completeness, CASE collinearity WHEN true THEN '1' WHEN false THEN '0' ELSE '.' END AS csb FROM keyword_),
strings AS (SELECT clusterID, string_agg(keyword, ',' ORDER BY keyword, completeness NULLS FIRST, csb) AS keywords, string_agg(coalesce(CAST(completeness AS VARCHAR), ''), ',' ORDER BY keyword, completeness NULLS FIRST, csb) AS completeness,
  string_agg(csb, ',' ORDER BY keyword, completeness NULLS FIRST, csb) AS csb FROM stored GROUP BY clusterID)"""
_TREE = f"""tree AS (
  SELECT proteinID, clusterID, coalesce(node, proteinID) || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS node
  FROM (SELECT proteinID, clusterID, node, row_number() OVER (PARTITION BY p.genomeID ORDER BY proteinID) AS n
    FROM protein p LEFT JOIN (SELECT genomeID, replace(concat_ws('_', genomeID, {', '.join(RANKS)}), ' ', '-') AS node FROM genome) g ON g.genomeID = p.genomeID
    WHERE proteinID IN (SELECT proteinID FROM domain_ WHERE score > 300)))"""
_STRONG = "strong AS (SELECT d.* FROM domain_ d LEFT JOIN thresholds t ON t.hmm = d.domain WHERE d.score > coalesce(t.optimized, 10))"
_STRONG_PLACED = PLACED.replace("placed AS (SELECT * FROM protein WHERE", "placed AS (SELECT * FROM protein WHERE proteinID IN (SELECT proteinID FROM strong) AND")
_RESCUED = sql(
    PROTEIN, DOMAIN, _STRONG, _STRONG_PLACED, BLOCK, FOLD.replace("FROM domain_ WHERE", "FROM strong WHERE"), TOKEN, PATTERN, MATCH, _MISSING,
    """found AS (SELECT DISTINCT p.proteinID, m.token
  FROM missing m JOIN (SELECT block, min(genomeID) AS genomeID, min(contig) AS contig, min(s) AS s, max(e) AS e FROM block GROUP BY block) x USING (block)
  JOIN protein p ON p.genomeID = x.genomeID AND p.contig = x.contig AND p.s IS NOT NULL AND p.e IS NOT NULL AND ((p.s > x.s - 3500 AND p.s < x.e + 3500) OR (p.e > x.s - 3500 AND p.e < x.e + 3500))
  JOIN domain_ d ON d.proteinID = p.proteinID AND d.domain = m.token JOIN thresholds t ON t.hmm = d.domain AND d.score > 0.1 * t.optimized AND d.score < t.optimized),
added AS (SELECT 0 AS src, * FROM strong UNION ALL SELECT 1, d.* FROM domain_ d JOIN found f ON f.proteinID = d.proteinID AND f.token = d.domain JOIN thresholds t ON t.hmm = d.domain AND d.score > 0.1 * t.optimized AND d.score < t.optimized)""",
    FOLD.replace("FROM domain_ WHERE", "FROM added WHERE").replace("ORDER BY ID)", "ORDER BY src, ID)").replace("ordered AS", "ordered2 AS").replace("FROM ordered)", "FROM ordered2)").replace("folded AS", "folded2 AS").replace("FROM folded)", "FROM folded2)").replace("fold AS", "fold2 AS").replace("FROM fold GROUP", "FROM fold2 GROUP").replace("arch AS (", "arch2 AS ("),
    body="SELECT proteinID, k.d AS domain, k.s AS dom_start, k.e AS dom_end, CAST(floor(k.c) AS INTEGER) AS score FROM fold2",
)

ORACLE = {
    "win1_gap_blocks": sql(PROTEIN, PLACED, BLOCK, body="SELECT genomeID, contig, proteinID, block FROM block"),
    "win1_without_trailing": sql(PROTEIN, PLACED, BLOCK.replace("FROM sized WHERE members > 1)", "FROM sized x WHERE members > 1 AND (contig, island) <> (SELECT (max((y.contig, y.island))) FROM sized y WHERE y.genomeID = x.genomeID))"), body="SELECT proteinID, block FROM block"),
    "win2_block_numbering": sql(PROTEIN, PLACED, BLOCK, body="SELECT genomeID, count(DISTINCT block) AS n_blocks, CAST(max(CAST(split_part(block, '_', -1) AS INTEGER)) AS INTEGER) AS last_n FROM block GROUP BY genomeID"),
    "agg9_block_extent": sql(PROTEIN, PLACED, BLOCK, body="SELECT block, min(s) AS block_start, max(e) AS block_end, count(*) AS genes FROM block GROUP BY block"),
    "pat1_pattern_completeness": sql(*_NAMING, body="SELECT block, pattern_id, keyword, round(completeness, 6) AS completeness FROM match_"),
    "pat2_collinearity": sql(*_NAMING, body="SELECT block, pattern_id, collinear FROM match_"),
    "pat3_last_pattern_wins": sql(*_NAMING, body="SELECT block, keyword, round(completeness, 6) AS completeness, collinear FROM named"),
    "pat4_missing_members": sql(*_NAMING, _MISSING, body="SELECT block, token FROM missing"),
    "pat5_rescue_band_join": sql(*_NAMING, _MISSING, body="""SELECT DISTINCT m.block, p.proteinID, m.token
FROM missing m JOIN (SELECT block, min(genomeID) AS genomeID, min(contig) AS contig, min(s) AS s, max(e) AS e FROM block GROUP BY block) x USING (block)
JOIN placed p ON p.genomeID = x.genomeID AND p.contig = x.contig AND ((p.s > x.s - 3500 AND p.s < x.e + 3500) OR (p.e > x.s - 3500 AND p.e < x.e + 3500))
JOIN domain_ d ON d.proteinID = p.proteinID AND d.domain = m.token JOIN thresholds t ON t.hmm = d.domain AND d.score > 0.1 * t.optimized AND d.score < t.optimized"""),
    "pat6_without_order": sql(*_NAMING, body="SELECT DISTINCT block, keyword, '.' AS csb FROM match_"),
    "int1_overlap_fold": sql(DOMAIN, FOLD, body="SELECT proteinID, k.d AS domain, k.s AS dom_start, k.e AS dom_end, CAST(floor(k.c) AS INTEGER) AS score FROM fold"),
    "int2_overlap_pairs": sql(DOMAIN, body="SELECT x.proteinID, x.ID AS a, y.ID AS b FROM domain_ x JOIN domain_ y ON x.proteinID = y.proteinID AND x.ID < y.ID AND x.domStart <= y.domEnd AND y.domStart <= x.domEnd"),
    "flt1_threshold_cutoff": sql(DOMAIN, body="SELECT ID, domain, score FROM domain_ LEFT JOIN thresholds ON hmm = domain WHERE score > coalesce(optimized, 10)"),
    "flt2_subcutoff_band": sql(DOMAIN, body="SELECT ID, domain, score FROM domain_ JOIN thresholds ON hmm = domain WHERE score > optimized * 0.1 AND score < optimized"),
    "src9_cutoff_modes": sql(DOMAIN, body=" UNION ALL ".join(f"SELECT '{m}' AS mode, domain, count(*) AS n FROM domain_ LEFT JOIN thresholds ON hmm = domain WHERE score > coalesce({m}, 10) GROUP BY domain" for m in ("optimized", "trusted", "noise"))),
    "agg10_best_hsp": sql(DOMAIN, body="SELECT proteinID, domain, ID, score FROM (SELECT *, row_number() OVER (PARTITION BY proteinID, domain ORDER BY score DESC, ID) AS r FROM domain_ WHERE score IS NOT NULL) WHERE r = 1"),
    "agg11_last_write_wins": sql(DOMAIN, body="SELECT proteinID, ID, domain FROM (SELECT *, row_number() OVER (PARTITION BY proteinID ORDER BY ID DESC) AS r FROM domain_) WHERE r = 1"),
    "agg12_domain_counts": sql(DOMAIN, FOLD, body="SELECT proteinID, CAST(n_domains AS INTEGER) AS n_domains FROM arch"),
    "agg14_architecture_groups": sql(DOMAIN, FOLD, body="SELECT arch, count(*) AS n_proteins FROM arch GROUP BY arch"),
    "agg18_rebuild_members": sql(PROTEIN, DOMAIN, FOLD, body="SELECT genomeID, proteinID, arch, scores FROM protein JOIN arch USING (proteinID)"),
    "agg19_rebuild_blocks": sql(PROTEIN, PLACED, DOMAIN, BLOCK, FOLD, TOKEN, body="SELECT clusterID, string_agg(token, ' ' ORDER BY s, e, proteinID) AS types, CAST(count(*) AS INTEGER) AS genes FROM placed JOIN token USING (proteinID) WHERE clusterID IS NOT NULL GROUP BY clusterID"),
    "prj2_architecture": sql(DOMAIN, FOLD, body="SELECT proteinID, arch, coords, scores FROM arch"),
    "prj5_token": sql(DOMAIN, body="""SELECT DISTINCT arch, CASE WHEN regexp_matches(arch, '\\w+_(\\w+$)') THEN regexp_extract(arch, '\\w+_(\\w+$)', 1) ELSE arch END AS token
FROM (SELECT unnest(['grp0_' || domain, domain || '-' || domain, domain]) AS arch FROM domain_)"""),
    "prj6_block_domains": sql(PROTEIN, DOMAIN, body="SELECT clusterID, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domain_set, count(domain) AS n_domains FROM protein JOIN domain_ USING (proteinID) WHERE clusterID IS NOT NULL GROUP BY clusterID"),
    "win3_relative_index": sql(PROTEIN, PLACED, DOMAIN, _PLACE, body="SELECT anchor, proteinID, CAST(relative AS INTEGER) AS relative FROM near"),
    "win6_relative_coords": sql(PROTEIN, PLACED, body="""SELECT clusterID, proteinID, s - min(s) OVER w AS rel_start, e - min(s) OVER w AS rel_end, last_value(e) OVER (PARTITION BY clusterID ORDER BY s, e, proteinID ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - min(s) OVER w AS width
FROM placed WHERE clusterID IS NOT NULL WINDOW w AS (PARTITION BY clusterID)"""),
    "jn12_neighbourhood": sql(PROTEIN, DOMAIN, body="SELECT a.proteinID AS anchor, b.proteinID FROM protein a JOIN protein b USING (clusterID) WHERE a.proteinID IN (SELECT proteinID FROM domain_ WHERE score > 300)"),
    "agg15_keyword_strings": sql(KEYWORD, _NAMES, body="SELECT clusterID, keywords, completeness, csb FROM strings"),
    "snk1_hit_table": sql(PROTEIN, PLACED, DOMAIN, FOLD, GENOME, KEYWORD, _NAMES, body=f"""SELECT p.genomeID, p.proteinID, arch, scores, coords, contig, s AS start, e AS stop, strand, locustag, p.clusterID, keywords, strings.completeness, csb, CASE WHEN g.genomeID IS NOT NULL THEN {_LINEAGE} END AS lineage
FROM placed p LEFT JOIN arch USING (proteinID) LEFT JOIN strings ON strings.clusterID = p.clusterID LEFT JOIN genome g ON g.genomeID = p.genomeID"""),
    "snk8_cluster_dataset": sql(PROTEIN, PLACED, DOMAIN, FOLD, GENOME, _TREE, body="""SELECT node || chr(9) || line AS line
FROM (SELECT clusterID, any_value(width) || chr(9) || string_agg('RE|' || (s - f) || '|' || (e - f) || '|#000088|' || arch, chr(9) ORDER BY s, e, proteinID) AS line
  FROM (SELECT *, min(s) OVER (PARTITION BY clusterID) AS f, last_value(e) OVER (PARTITION BY clusterID ORDER BY s, e, proteinID ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - min(s) OVER (PARTITION BY clusterID) AS width
    FROM placed JOIN arch USING (proteinID) WHERE clusterID IS NOT NULL) GROUP BY clusterID) JOIN tree USING (clusterID)"""),
    "snk12_context_sorted": sql(PROTEIN, PLACED, DOMAIN, FOLD, GENOME, _PLACE, body=f"SELECT anchor, n.proteinID, CAST(relative AS INTEGER) AS relative, arch, scores, coords, contig, s AS start, e AS stop, strand, {', '.join(RANKS)} FROM near n JOIN placed p ON p.proteinID = n.proteinID LEFT JOIN arch a ON a.proteinID = n.proteinID LEFT JOIN genome g ON g.genomeID = p.genomeID"),
    "pat5_rescued_domains": _RESCUED,
}
