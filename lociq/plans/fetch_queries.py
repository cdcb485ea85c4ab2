"""Queries over fetches, joins, matrices, sequence sets and store changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions import render
from lociq.functions.keys import trim_key
from lociq.operators import blocks, filters, matrix, sequences, store
from lociq.plans.sqlviews import BLOCK, CLUSTER, DOMAIN, FOLD, GENOME, KEYWORD, PLACED, PROTEIN, sql
from lociq.schemas import RANKS
from lociq.sources import catalog, readers
from lociq.sources.tables import table

PARTS, WORDS = ("Drai", "Wexa"), ("mtSt", "sQuo")
FEATURES = ("BruaN", "PhooI", "SteoI", "mtSteor")
MARKERS = ("BruaN", "PhooI", "ZmoJ")


def _genes_with_domains(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Proteins with their domains, and those columns of the protein that a query asks for."""
    return catalog.proteins(spark, d, "proteinID", *columns).join(catalog.domains(spark, d, "proteinID", "domain"), "proteinID", "left")


def flt3_or_ilike_domain(spark: SparkSession, d: str) -> DataFrame:
    return _genes_with_domains(spark, d).where(filters.any_like("domain", PARTS)).select("proteinID", "ID", "domain")


def flt4_or_ilike_keyword(spark: SparkSession, d: str) -> DataFrame:
    k = catalog.keywords(spark, d, "ID", "clusterID", "keyword").where(filters.any_like("keyword", WORDS))
    return catalog.proteins(spark, d, "proteinID", "clusterID").join(k.select("clusterID", "keyword").distinct(), "clusterID").select("proteinID", "clusterID", "keyword")


def flt5_domain_and_keyword(spark: SparkSession, d: str) -> DataFrame:
    k = catalog.keywords(spark, d, "ID", "clusterID", "keyword").where(filters.any_like("keyword", WORDS)).select("clusterID").distinct()
    return _genes_with_domains(spark, d, "clusterID").where(filters.any_like("domain", PARTS)).join(k, "clusterID", "left_semi").select("proteinID", "ID")


def flt6_keyword_all(spark: SparkSession, d: str) -> DataFrame:
    return filters.has_all(catalog.keywords(spark, d, "ID", "clusterID", "keyword"), "clusterID", "keyword", ("mt", "ox"))


def flt7_rank_filter(spark: SparkSession, d: str) -> DataFrame:
    return catalog.genomes(spark, d, "genomeID", "Superkingdom", "Phylum").where(filters.rank_like("Superkingdom", "bacteria")).select("genomeID", "Phylum")


def flt8_genome_limiter(spark: SparkSession, d: str) -> DataFrame:
    g = catalog.genomes(spark, d, "genomeID", "Superkingdom").where(filters.rank_like("Superkingdom", "archaea"))
    return filters.limited(catalog.proteins(spark, d, "proteinID", "genomeID"), g).select("proteinID", "genomeID")


def flt9_completeness_floor(spark: SparkSession, d: str) -> DataFrame:
    return catalog.keywords(spark, d).where(F.col("completeness") > 0.7).select("ID", "clusterID", "keyword")


def flt10_missing_lineage(spark: SparkSession, d: str) -> DataFrame:
    six = [r for r in RANKS if r not in ("Clade", "Species")]
    return catalog.genomes(spark, d, "genomeID", *six).where(filters.lineage_missing(six)).select("genomeID")


def flt11_length_range(spark: SparkSession, d: str) -> DataFrame:
    return catalog.proteins(spark, d, "proteinID", "sequence").where(filters.length_between("sequence", 100, 300)).select("proteinID", F.length("sequence").alias("n"))


def flt12_multi_domain(spark: SparkSession, d: str) -> DataFrame:
    return catalog.proteins(spark, d, "proteinID", "dom_count").where("dom_count > 1").select("proteinID", "dom_count")


def flt13_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = catalog.keywords(spark, d).where("completeness = 1").select("clusterID").distinct()
    return catalog.proteins(spark, d, "proteinID", "clusterID").join(wanted, "clusterID", "left_semi").select("proteinID", "clusterID")


def flt14_regex_keyword_list(spark: SparkSession, d: str) -> DataFrame:
    k = catalog.keywords(spark, d, "ID", "clusterID", "keyword").groupBy("clusterID").agg(F.collect_set("keyword").alias("words"))
    return k.where(filters.any_word("words", "mt(Oxa|Ny)")).select("clusterID")


def flt15_domain_regex_genomes(spark: SparkSession, d: str) -> DataFrame:
    return _genes_with_domains(spark, d, "genomeID").where(F.col("domain").rlike("^Brua[xN]")).select("genomeID").distinct()


def flt16_incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    done = catalog.proteins(spark, d, "proteinID", "genomeID")
    return catalog.genomes(spark, d, "genomeID").join(done, "genomeID", "left_anti")


def prj1_lineage(spark: SparkSession, d: str) -> DataFrame:
    return catalog.genomes(spark, d, "genomeID", *RANKS).select("genomeID", render.lineage(RANKS).alias("lineage"))


def prj8_genome_of_id(spark: SparkSession, d: str) -> DataFrame:
    return catalog.proteins(spark, d, "proteinID", "genomeID").select("proteinID", F.substring_index("proteinID", "-", 1).alias("genome"), render.genome_of(F.concat(F.lit("/in/"), "genomeID", F.lit(".1.faa.gz"))).alias("from_file"))


def jn1_left_join(spark: SparkSession, d: str) -> DataFrame:
    return _genes_with_domains(spark, d).select("proteinID", "ID", "domain")


def jn2_keywords_join(spark: SparkSession, d: str) -> DataFrame:
    k = catalog.keywords(spark, d, "ID", "clusterID", "keyword").select("clusterID", "keyword").distinct()
    return catalog.proteins(spark, d, "proteinID", "clusterID").join(k, "clusterID", "left").select("proteinID", "keyword")


def jn4_keywords_of_genomes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.keywords(spark, d, "ID", "clusterID", "keyword").join(catalog.clusters(spark, d), "clusterID", "left").select("ID", "keyword", "genomeID")


def jn5_four_way(spark: SparkSession, d: str) -> DataFrame:
    k = catalog.keywords(spark, d, "ID", "clusterID", "keyword").select("clusterID", "keyword").distinct()
    out = _genes_with_domains(spark, d, "genomeID", "clusterID").join(catalog.genomes(spark, d, "genomeID", "Phylum"), "genomeID", "left").join(k, "clusterID", "left")
    return out.groupBy("Phylum", "keyword").agg(F.countDistinct("proteinID").alias("n_proteins"), F.count("ID").alias("n_domains"))


def _limiter(spark: SparkSession, d: str, mode: str) -> DataFrame:
    m = _genes_with_domains(spark, d, "genomeID").where(filters.any_like("domain", PARTS))
    return filters.limited(catalog.genomes(spark, d, "genomeID"), m, mode).select("genomeID")


def jn6_limiter_semi(spark: SparkSession, d: str) -> DataFrame:
    return _limiter(spark, d, "semi")


def jn6_limiter_anti(spark: SparkSession, d: str) -> DataFrame:
    return _limiter(spark, d, "anti")


def jn13_fusion_completion(spark: SparkSession, d: str) -> DataFrame:
    hit = _genes_with_domains(spark, d, "dom_count").where(filters.any_like("domain", PARTS) & (F.col("dom_count") > 1)).select("proteinID").distinct()
    return catalog.domains(spark, d, "ID", "proteinID", "domain").join(hit, "proteinID", "left_semi").select("proteinID", "ID", "domain")


def jn15_taxonomy_lookup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.proteins(spark, d, "proteinID", "genomeID").join(catalog.genomes(spark, d, "genomeID", "Genus"), "genomeID", "left").select("proteinID", "Genus")


def _marker_records(spark: SparkSession, d: str) -> DataFrame:
    rows = _genes_with_domains(spark, d, "genomeID", "sequence").where(F.col("domain").isin(list(MARKERS)) & F.col("sequence").isNotNull())
    return rows.select(F.col("domain").alias("file"), F.col("genomeID").alias("genome"), F.col("proteinID").alias("id"), F.col("ID").alias("ord"), F.col("sequence").alias("seq"))


def jn16_concat_inner(spark: SparkSession, d: str) -> DataFrame:
    return sequences.concatenated(_marker_records(spark, d), MARKERS)


def jn16_concat_gapfill(spark: SparkSession, d: str) -> DataFrame:
    return sequences.concatenated(_marker_records(spark, d), MARKERS, gaps=True)


def jn17_fusion_intersect(spark: SparkSession, d: str) -> DataFrame:
    per = _genes_with_domains(spark, d, "dom_count").where(F.col("domain").isin("BruaN", "PhooI")).groupBy("proteinID").agg(F.countDistinct("domain").alias("k"), F.max("dom_count").alias("dom_count"))
    return per.where("k = 2 AND dom_count >= 2").select("proteinID")


def _protkey(spark: SparkSession, d: str, how: str) -> DataFrame:
    k = catalog.keywords(spark, d, "ID", "clusterID", "keyword").where(filters.any_like("keyword", WORDS)).select("clusterID")
    return _genes_with_domains(spark, d, "clusterID").where(filters.any_like("domain", PARTS)).join(k, "clusterID", how).select("proteinID").distinct()


def jn18_protkey_with(spark: SparkSession, d: str) -> DataFrame:
    return _protkey(spark, d, "left_semi")


def jn18_protkey_without(spark: SparkSession, d: str) -> DataFrame:
    return _protkey(spark, d, "left_anti")


def agg1_rank_counts(spark: SparkSession, d: str) -> DataFrame:
    return matrix.rank_counts(catalog.genomes(spark, d, "genomeID", *RANKS[:7]), RANKS[:7]).orderBy("level", "taxon")


def agg2_domain_counts(spark: SparkSession, d: str) -> DataFrame:
    return _genes_with_domains(spark, d).groupBy("domain").agg(F.count("proteinID").alias("n")).orderBy("domain")


def agg3_keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.keywords(spark, d, "ID", "clusterID", "keyword").groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy("keyword")


def agg4_distinct_lineage(spark: SparkSession, d: str) -> DataFrame:
    return catalog.genomes(spark, d, "genomeID", *RANKS).select(*RANKS).distinct()


def agg5_distinct_projection(spark: SparkSession, d: str) -> DataFrame:
    return catalog.proteins(spark, d, "proteinID", "genomeID", "contig", "strand").select("genomeID", "contig", "strand").distinct()


def agg7_collect_members(spark: SparkSession, d: str) -> DataFrame:
    """The members of each genome as one text, in order."""
    p = catalog.proteins(spark, d, "proteinID", "genomeID").where("genomeID IS NOT NULL")
    return p.groupBy("genomeID").agg(F.array_join(F.sort_array(F.collect_list("proteinID")), ",").alias("members"))


def agg13_repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "proteins").groupBy("proteinID").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _found(spark: SparkSession, d: str) -> DataFrame:
    m = _genes_with_domains(spark, d, "genomeID").where(F.col("domain").isin(list(FEATURES))).select("genomeID", F.col("domain").alias("feature"))
    k = catalog.keywords(spark, d, "ID", "clusterID", "keyword").where(F.col("keyword").isin(list(FEATURES))).join(catalog.proteins(spark, d, "proteinID", "clusterID", "genomeID").select("clusterID", "genomeID").distinct(), "clusterID")
    return m.unionByName(k.select("genomeID", F.col("keyword").alias("feature")))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix.presence(catalog.genomes(spark, d, "genomeID"), _found(spark, d), FEATURES)


def agg8_presence_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)


def cmb1_combination_and(spark: SparkSession, d: str) -> DataFrame:
    m = matrix.combined(_matrix(spark, d), FEATURES)
    return m.select(*[F.col(f"`{c}`").alias(c.replace("+", "_and_")) for c in m.columns])


def cmb3_listed_combinations(spark: SparkSession, d: str) -> DataFrame:
    m = matrix.combined_as(_matrix(spark, d), [("BruaN", "PhooI"), ("SteoI", "mtSteor", "PhooI")])
    return m.select("genomeID", F.col("`BruaN+PhooI`").alias("two"), F.col("`SteoI+mtSteor+PhooI`").alias("three"))


def cmb2_keyword_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Blocks for each non-empty subset of three keyword patterns: all of them must match."""
    return filters.keyword_subsets(catalog.keywords(spark, d, "ID", "clusterID", "keyword"), "clusterID", ("mt", "ox", "ass"))


def _rank_stats(spark: SparkSession, d: str) -> DataFrame:
    selected = _matrix(spark, d).join(catalog.genomes(spark, d, "genomeID", "Completeness").where("Completeness > 90").select("genomeID"), "genomeID", "left_semi")
    return matrix.rank_statistics(catalog.genomes(spark, d, "genomeID", *RANKS), selected, FEATURES, RANKS)


def agg6_rank_absolute(spark: SparkSession, d: str) -> DataFrame:
    return _rank_stats(spark, d).select("level", "taxon", "feature", "n_present", "n_selected")


def agg6_rank_relative(spark: SparkSession, d: str) -> DataFrame:
    return _rank_stats(spark, d).select("level", "taxon", "feature", F.round("ratio", 6).alias("ratio"))


def win4_singletons(spark: SparkSession, d: str) -> DataFrame:
    return sequences.split_members(_marker_records(spark, d), ["file", "genome"]).where("members = 1").select("file", "genome", "id")


def win4_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return sequences.split_members(_marker_records(spark, d), ["file", "genome"]).where("members > 1").select("file", "genome", "id", "members")


def win7_first_appearance(spark: SparkSession, d: str) -> DataFrame:
    return matrix.first_appearance(catalog.genomes(spark, d, "genomeID", *RANKS), RANKS, "Phylum")


def rnk4_occurrence_suffix(spark: SparkSession, d: str) -> DataFrame:
    r = _genes_with_domains(spark, d, "genomeID").where("domain = 'BruaN'")
    return sequences.occurrence_names(r.select("genomeID", "proteinID", "ID"), "genomeID", ("ID",), "genomeID").select("ID", "label", "occurrence")


def rnk5_top5_per_group(spark: SparkSession, d: str) -> DataFrame:
    return sequences.top_per_group(catalog.genomes(spark, d, "genomeID", "Phylum").select("Phylum", "genomeID"), "Phylum", ("genomeID",), 5).select("Phylum", "genomeID", "place")


def srt3_lineage_order(spark: SparkSession, d: str) -> DataFrame:
    return catalog.genomes(spark, d, "genomeID", *RANKS).select("genomeID", *RANKS).orderBy(*RANKS, "genomeID")


def srt4_hierarchical_topk(spark: SparkSession, d: str) -> DataFrame:
    six = [r for r in RANKS if r not in ("Clade", "Species")]
    return catalog.genomes(spark, d, "genomeID", *six).orderBy(*six, "genomeID").select("genomeID", *six)


def set1_union(spark: SparkSession, d: str) -> DataFrame:
    return catalog.genomes(spark, d, "genomeID").select("genomeID").unionByName(catalog.proteins(spark, d, "proteinID", "genomeID").select("genomeID")).distinct()


def set2_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = (_genes_with_domains(spark, d, "genomeID").where(F.col("domain") == x).select("genomeID") for x in ("BruaN", "PhooI"))
    return a.intersect(b)


def set3_difference(spark: SparkSession, d: str) -> DataFrame:
    return catalog.genomes(spark, d, "genomeID").select("genomeID").subtract(_genes_with_domains(spark, d, "genomeID").where("domain = 'PhooI'").select("genomeID"))


def set4_merge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "proteins").select(F.col("proteinID").alias("id"), trim_key("genomeID").alias("file"), "loaded_at")
    return sequences.merge_first(p, ("loaded_at", "file"), "id").select("id", "file", "loaded_at")


def src11_gtdb_split(spark: SparkSession, d: str) -> DataFrame:
    six = [r for r in RANKS if r != "Clade"]
    text = F.concat_ws(";", *[F.concat(F.lit(f"{r[0].lower()}__"), r) for r in six])
    return catalog.genomes(spark, d, "genomeID", *six).select("genomeID", text.alias("t")).select("genomeID", *readers.gtdb_lineage("t"))


def src16_recursive_lineage(spark: SparkSession, d: str) -> DataFrame:
    ranks = ("Superkingdom", "Phylum", "Class", "Ordnung", "Family", "Genus")
    g = catalog.genomes(spark, d, "genomeID", "Completeness", *ranks)
    full = lambda k: F.concat_ws("|", *ranks[: k + 1])
    links = None
    for k, r in enumerate(ranks):
        part = g.select(full(k).alias("taxid"), (full(k - 1) if k else full(k)).alias("parent"), F.lit(r.lower()).alias("rank"), F.col(r).alias("name")).distinct()
        links = part if links is None else links.unionByName(part)
    wanted = g.where("Completeness > 99").select(full(len(ranks) - 1).alias("taxid")).distinct()
    return readers.lineages(links.drop("name"), links.select("taxid", "name"), wanted)


def dml3_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    old = catalog.genomes(spark, d, "genomeID")
    return store.insert_absent(old, catalog.clusters(spark, d).where("genomeID IS NOT NULL").select("genomeID"), "genomeID")


def dml5_update_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    g = catalog.genomes(spark, d, "genomeID", "Strain")
    new = table(spark, d, "genomes").where("deleted_at IS NOT NULL").select(trim_key("genomeID").alias("genomeID"), F.col("NCBITaxon"), F.concat(F.lit("re "), "Strain").alias("Strain"))
    return store.update(g, new, "genomeID", ["Strain"]).select("genomeID", "Strain")


def dml6_extend_domains(spark: SparkSession, d: str) -> DataFrame:
    m = catalog.domains(spark, d)
    strong = F.coalesce(F.col("score") > 200, F.lit(False))
    r = store.extend_domains(m.where(strong), m.where(~strong))
    return r.select("proteinID", render.architecture("domains").alias("arch"))


def dml7_replace_keywords(spark: SparkSession, d: str) -> DataFrame:
    k = catalog.keywords(spark, d)
    changed = k.where("completeness = 1").select("clusterID").distinct()
    new = changed.select(F.lit(0).cast("bigint").alias("ID"), "clusterID", F.lit("renewed").alias("keyword"), F.lit(1.0).alias("completeness"), F.lit(None).cast("boolean").alias("collinearity"))
    return store.replace_for(k, new.select("ID", "clusterID", "keyword", "completeness", "collinearity").select(*[new[c] for c in k.columns]), changed, "clusterID").select("ID", "clusterID", "keyword")


def dml7_rewrite_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Blocks found anew for the genomes of one kingdom: their clusters, keywords and the
    proteins' clusterID give way, all else stays. A row a protein or keyword."""
    of = catalog.genomes(spark, d, "genomeID", "Superkingdom").where(filters.rank_like("Superkingdom", "archaea")).select("genomeID")
    p = catalog.proteins(spark, d, "proteinID", "genomeID", "clusterID")
    members = blocks.gap_blocks(filters.limited(catalog.placed(spark, d), of)).select("proteinID", "genomeID", F.col("block").alias("clusterID"))
    names = members.groupBy("clusterID").agg(F.lit("renewed").alias("keyword"), F.lit(1.0).alias("completeness"), F.lit(None).cast("boolean").alias("collinearity"))
    t = store.rewrite_clusters({"proteins": p, "clusters": catalog.clusters(spark, d), "keywords": catalog.keywords(spark, d)}, of, members, names)
    rows = lambda name, key: t[name].select(F.lit(name).alias("table_name"), F.col(key).alias("key"), "clusterID")
    return rows("proteins", "proteinID").unionByName(rows("keywords", "keyword")).unionByName(rows("clusters", "genomeID"))


def dml11_delete_protein(spark: SparkSession, d: str) -> DataFrame:
    """One protein, the first by id, deleted with its domains."""
    p = catalog.proteins(spark, d, "proteinID")
    t = store.delete_proteins({"proteins": p, "domains": catalog.domains(spark, d, "ID", "proteinID")}, p.agg(F.min("proteinID").alias("proteinID")))
    return t["domains"].select("ID", "proteinID").unionByName(t["proteins"].select(F.lit(None).cast("bigint").alias("ID"), "proteinID"))


def dml8_rename_domain(spark: SparkSession, d: str) -> DataFrame:
    only = catalog.proteins(spark, d, "proteinID", "clusterID").where("clusterID IS NOT NULL").select("proteinID")
    return store.rename_where(catalog.domains(spark, d, "ID", "proteinID", "domain"), "domain", "BruaN", "BruaN_new", only, "proteinID").select("ID", "domain")


def dml9_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = catalog.genomes(spark, d, "genomeID", "Completeness").where("Completeness < 85").select("genomeID")
    t = {"genomes": catalog.genomes(spark, d, "genomeID"), "proteins": catalog.proteins(spark, d, "proteinID", "genomeID"), "clusters": catalog.clusters(spark, d), "domains": catalog.domains(spark, d, "ID", "proteinID"), "keywords": catalog.keywords(spark, d, "ID", "clusterID")}
    out = None
    for name, rows in store.delete_genomes(t, gone).items():
        n = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def dml10_delete_proteins(spark: SparkSession, d: str) -> DataFrame:
    p = catalog.proteins(spark, d, "proteinID", "dom_count")
    t = store.delete_proteins({"proteins": p, "domains": catalog.domains(spark, d, "ID", "proteinID")}, p.where("dom_count > 2").select("proteinID"))
    return t["domains"].select("ID", "proteinID")


def lint_unlisted_genes(spark: SparkSession, d: str) -> DataFrame:
    genes = catalog.patterns(spark, d).select(F.explode("genes").alias("gene")).distinct()
    return genes.join(catalog.thresholds(spark, d).select(F.col("hmm").alias("gene")), "gene", "left_anti")


QUERIES = {f.__name__: f for f in (
    flt3_or_ilike_domain, flt4_or_ilike_keyword, flt5_domain_and_keyword, flt6_keyword_all, flt7_rank_filter, flt8_genome_limiter, flt9_completeness_floor, flt10_missing_lineage, flt11_length_range, flt12_multi_domain,
    flt13_point_lookup, flt14_regex_keyword_list, flt15_domain_regex_genomes, flt16_incremental_skip, prj1_lineage, prj8_genome_of_id, jn1_left_join, jn2_keywords_join, jn4_keywords_of_genomes, jn5_four_way,
    jn6_limiter_semi, jn6_limiter_anti, jn13_fusion_completion, jn15_taxonomy_lookup, jn16_concat_inner, jn16_concat_gapfill, jn17_fusion_intersect, jn18_protkey_with, jn18_protkey_without, agg1_rank_counts,
    agg2_domain_counts, agg3_keyword_counts, agg4_distinct_lineage, agg5_distinct_projection, agg7_collect_members, agg13_repeated_ids, agg8_presence_matrix, cmb1_combination_and, cmb2_keyword_subsets, cmb3_listed_combinations,
    agg6_rank_absolute, agg6_rank_relative, win4_singletons, win4_duplicates, win7_first_appearance, rnk4_occurrence_suffix, rnk5_top5_per_group, srt3_lineage_order, srt4_hierarchical_topk, set1_union, set2_intersect,
    set3_difference, set4_merge_dedupe, src11_gtdb_split, src16_recursive_lineage, dml3_insert_absent, dml5_update_taxonomy, dml6_extend_domains, dml7_replace_keywords, dml7_rewrite_clusters, dml8_rename_domain, dml9_delete_cascade,
    dml10_delete_proteins, dml11_delete_protein, lint_unlisted_genes,
)}

_WITH = """hit AS (SELECT p.proteinID, p.genomeID, p.clusterID, p.dom_count, p.sequence, d.ID, d.domain FROM protein p LEFT JOIN domain_ d USING (proteinID))"""
_PART = "(" + " OR ".join(f"domain ILIKE '%{p}%'" for p in PARTS) + ")"
_KEY = "(" + " OR ".join(f"keyword ILIKE '%{p}%'" for p in WORDS) + ")"
_RANKED = ", ".join(RANKS)
_SIXR = [r for r in RANKS if r not in ("Clade", "Species")]
_MARK = f"""marker AS (SELECT domain AS file, genomeID AS genome, proteinID AS id, ID AS ord, sequence AS seq FROM hit WHERE domain IN {MARKERS} AND sequence IS NOT NULL)"""
_CELL = f"""found AS (SELECT genomeID, domain AS feature FROM hit WHERE domain IN {FEATURES}
  UNION ALL SELECT p.genomeID, k.keyword FROM keyword_ k JOIN protein p USING (clusterID) WHERE k.keyword IN {FEATURES}),
matrix AS (SELECT g.genomeID, {", ".join(f"coalesce(max(CASE WHEN feature = '{f}' THEN 1 ELSE 0 END), 0) AS {f}" for f in FEATURES)} FROM genome g LEFT JOIN found USING (genomeID) GROUP BY g.genomeID)"""
_LEVELS = " UNION ALL ".join(f"SELECT genomeID, '{r}' AS level, {r} AS taxon FROM genome" for r in RANKS)
_STATS = f"""level AS ({_LEVELS}), sel AS (SELECT m.* FROM matrix m JOIN genome g USING (genomeID) WHERE g.Completeness > 90),
long AS (""" + " UNION ALL ".join(f"SELECT genomeID, '{f}' AS feature, {f} AS present FROM sel" for f in FEATURES) + f"""),
stat AS (SELECT l.level, l.taxon, f.feature, coalesce(sum(x.present), 0) AS n_present, count(x.present) AS n_selected FROM level l CROSS JOIN (SELECT unnest({list(FEATURES)}) AS feature) f
  LEFT JOIN long x ON x.genomeID = l.genomeID AND x.feature = f.feature GROUP BY ALL)"""
_CMB = ", ".join(f"least({', '.join(c)}) AS {'_and_'.join(c)}" for k in (2, 3) for c in __import__("itertools").combinations(FEATURES, k))
_H = (PROTEIN, DOMAIN, _WITH)
_SUB = " UNION ALL ".join("SELECT clusterID, '" + "+".join(n for i, n in enumerate(("mt", "ox", "ass")) if b >> i & 1) + "' AS subset FROM w WHERE " + " AND ".join(n + "_" for i, n in enumerate(("mt", "ox", "ass")) if b >> i & 1) for b in range(1, 8))
_WORDS = "w AS (SELECT clusterID, " + ", ".join(f"bool_or(regexp_matches(keyword, '^{x}')) AS {x}_" for x in ("mt", "ox", "ass")) + " FROM keyword_ GROUP BY clusterID)"
_NODE = [", '|', ".join(["Superkingdom", "Phylum", "Class", "Ordnung", "Family", "Genus"][: k + 1]) for k in range(6)]

ORACLE = {
    "flt3_or_ilike_domain": sql(*_H, body=f"SELECT proteinID, ID, domain FROM hit WHERE {_PART}"),
    "flt4_or_ilike_keyword": sql(PROTEIN, KEYWORD, body=f"SELECT p.proteinID, p.clusterID, k.keyword FROM protein p JOIN (SELECT DISTINCT clusterID, keyword FROM keyword_ WHERE {_KEY}) k USING (clusterID)"),
    "flt5_domain_and_keyword": sql(*_H, KEYWORD, body=f"SELECT proteinID, ID FROM hit WHERE {_PART} AND clusterID IN (SELECT clusterID FROM keyword_ WHERE {_KEY})"),
    "flt6_keyword_all": sql(KEYWORD, body="SELECT clusterID FROM keyword_ GROUP BY clusterID HAVING bool_or(keyword ILIKE '%mt%') AND bool_or(keyword ILIKE '%ox%')"),
    "flt7_rank_filter": sql(GENOME, body="SELECT genomeID, Phylum FROM genome WHERE Superkingdom ILIKE 'bacteria'"),
    "flt8_genome_limiter": sql(PROTEIN, GENOME, body="SELECT proteinID, genomeID FROM protein WHERE genomeID IN (SELECT genomeID FROM genome WHERE Superkingdom ILIKE 'archaea')"),
    "flt9_completeness_floor": sql(KEYWORD, body="SELECT ID, clusterID, keyword FROM keyword_ WHERE completeness > 0.7"),
    "flt10_missing_lineage": sql(GENOME, body="SELECT genomeID FROM genome WHERE " + " OR ".join(f"{r} = 'NULL'" for r in _SIXR)),
    "flt11_length_range": sql(PROTEIN, body="SELECT proteinID, CAST(length(sequence) AS INTEGER) AS n FROM protein WHERE length(sequence) > 100 AND length(sequence) < 300"),
    "flt12_multi_domain": sql(PROTEIN, body="SELECT proteinID, dom_count FROM protein WHERE dom_count > 1"),
    "flt13_point_lookup": sql(PROTEIN, KEYWORD, body="SELECT proteinID, clusterID FROM protein WHERE clusterID IN (SELECT clusterID FROM keyword_ WHERE completeness = 1)"),
    "flt14_regex_keyword_list": sql(KEYWORD, body="SELECT clusterID FROM keyword_ GROUP BY clusterID HAVING bool_or(regexp_matches(keyword, '^mt(Oxa|Ny)'))"),
    "flt15_domain_regex_genomes": sql(*_H, body="SELECT DISTINCT genomeID FROM hit WHERE regexp_matches(domain, '^Brua[xN]')"),
    "flt16_incremental_skip": sql(PROTEIN, GENOME, body="SELECT genomeID FROM genome WHERE genomeID NOT IN (SELECT genomeID FROM protein WHERE genomeID IS NOT NULL)"),
    "prj1_lineage": sql(GENOME, body=f"SELECT genomeID, replace(concat_ws('_', {_RANKED}), ' ', '-') AS lineage FROM genome"),
    "prj8_genome_of_id": sql(PROTEIN, body="SELECT proteinID, split_part(proteinID, '-', 1) AS genome, split_part(genomeID, '.', 1) AS from_file FROM protein"),
    "jn1_left_join": sql(*_H, body="SELECT proteinID, ID, domain FROM hit"),
    "jn2_keywords_join": sql(PROTEIN, KEYWORD, body="SELECT proteinID, keyword FROM protein LEFT JOIN (SELECT DISTINCT clusterID, keyword FROM keyword_) USING (clusterID)"),
    "jn4_keywords_of_genomes": sql(KEYWORD, CLUSTER, body="SELECT ID, keyword, c.genomeID FROM keyword_ LEFT JOIN cluster_ c USING (clusterID)"),
    "jn5_four_way": sql(*_H, GENOME, KEYWORD, body="""SELECT Phylum, k.keyword, count(DISTINCT proteinID) AS n_proteins, count(ID) AS n_domains FROM hit LEFT JOIN genome USING (genomeID)
LEFT JOIN (SELECT DISTINCT clusterID, keyword FROM keyword_) k ON k.clusterID = hit.clusterID GROUP BY Phylum, k.keyword"""),
    "jn6_limiter_semi": sql(*_H, GENOME, body=f"SELECT genomeID FROM genome WHERE genomeID IN (SELECT genomeID FROM hit WHERE {_PART})"),
    "jn6_limiter_anti": sql(*_H, GENOME, body=f"SELECT genomeID FROM genome g WHERE NOT EXISTS (SELECT 1 FROM hit WHERE {_PART} AND hit.genomeID = g.genomeID)"),
    "jn13_fusion_completion": sql(*_H, body=f"SELECT proteinID, ID, domain FROM domain_ WHERE proteinID IN (SELECT proteinID FROM hit WHERE {_PART} AND dom_count > 1)"),
    "jn15_taxonomy_lookup": sql(PROTEIN, GENOME, body="SELECT proteinID, Genus FROM protein LEFT JOIN genome USING (genomeID)"),
    "jn16_concat_inner": sql(*_H, _MARK, body=f"""SELECT genome, string_agg(seq, '' ORDER BY list_position({list(MARKERS)}, file), ord) AS sequence FROM marker GROUP BY genome HAVING count(DISTINCT file) = 3"""),
    "jn16_concat_gapfill": sql(*_H, _MARK, body=f"""SELECT genome, string_agg(coalesce(seq, repeat('-', width)), '' ORDER BY list_position({list(MARKERS)}, file), ord) AS sequence
FROM (SELECT DISTINCT genome FROM marker) CROSS JOIN (SELECT file, max(length(seq)) AS width FROM marker GROUP BY file) LEFT JOIN marker USING (genome, file) GROUP BY genome"""),
    "jn17_fusion_intersect": sql(*_H, body="SELECT proteinID FROM hit WHERE domain IN ('BruaN', 'PhooI') AND dom_count >= 2 GROUP BY proteinID HAVING count(DISTINCT domain) = 2"),
    "jn18_protkey_with": sql(*_H, KEYWORD, body=f"SELECT DISTINCT proteinID FROM hit WHERE {_PART} AND clusterID IN (SELECT clusterID FROM keyword_ WHERE {_KEY})"),
    "jn18_protkey_without": sql(*_H, KEYWORD, body=f"SELECT DISTINCT proteinID FROM hit WHERE {_PART} AND (clusterID IS NULL OR clusterID NOT IN (SELECT clusterID FROM keyword_ WHERE {_KEY}))"),
    "agg1_rank_counts": sql(GENOME, body="SELECT level, taxon, count(*) AS n_genomes FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS level, {r} AS taxon FROM genome" for r in RANKS[:7]) + ") GROUP BY ALL"),
    "agg2_domain_counts": sql(*_H, body="SELECT domain, count(proteinID) AS n FROM hit GROUP BY domain"),
    "agg3_keyword_counts": sql(KEYWORD, body="SELECT keyword, count(*) AS n FROM keyword_ GROUP BY keyword"),
    "agg4_distinct_lineage": sql(GENOME, body=f"SELECT DISTINCT {_RANKED} FROM genome"),
    "agg5_distinct_projection": sql(PROTEIN, body="SELECT DISTINCT genomeID, contig, strand FROM protein"),
    "agg7_collect_members": sql(PROTEIN, body="SELECT genomeID, string_agg(proteinID, ',' ORDER BY proteinID) AS members FROM protein WHERE genomeID IS NOT NULL GROUP BY genomeID"),
    "agg13_repeated_ids": "SELECT proteinID, count(*) AS n FROM proteins GROUP BY proteinID HAVING count(*) > 1",
    "agg8_presence_matrix": sql(*_H, GENOME, KEYWORD, _CELL, body="SELECT * FROM matrix"),
    "cmb1_combination_and": sql(*_H, GENOME, KEYWORD, _CELL, body=f"SELECT *, {_CMB} FROM matrix"),
    "cmb3_listed_combinations": sql(*_H, GENOME, KEYWORD, _CELL, body="SELECT genomeID, least(BruaN, PhooI) AS two, least(SteoI, mtSteor, PhooI) AS three FROM matrix"),
    "cmb2_keyword_subsets": sql(KEYWORD, _WORDS, body=_SUB),
    "agg6_rank_absolute": sql(*_H, GENOME, KEYWORD, _CELL, _STATS, body="SELECT level, taxon, feature, CAST(n_present AS BIGINT) AS n_present, n_selected FROM stat"),
    "agg6_rank_relative": sql(*_H, GENOME, KEYWORD, _CELL, _STATS, body="SELECT level, taxon, feature, CASE WHEN n_selected > 0 THEN round(n_present / n_selected, 6) END AS ratio FROM stat"),
    "win4_singletons": sql(*_H, _MARK, body="SELECT file, genome, id FROM (SELECT *, count(*) OVER (PARTITION BY file, genome) AS members FROM marker) WHERE members = 1"),
    "win4_duplicates": sql(*_H, _MARK, body="SELECT * EXCLUDE (seq, ord) FROM (SELECT *, count(*) OVER (PARTITION BY file, genome) AS members FROM marker) WHERE members > 1"),
    "win7_first_appearance": sql(GENOME, body=f"SELECT Phylum AS taxon, CAST(row_number() OVER (ORDER BY f, Phylum) AS INTEGER) AS place FROM (SELECT Phylum, min(({_RANKED})) AS f FROM genome GROUP BY Phylum)"),
    "rnk4_occurrence_suffix": sql(*_H, body="SELECT ID, CASE n WHEN 1 THEN genomeID ELSE genomeID || '_' || n END AS label, CAST(n AS INTEGER) AS occurrence FROM (SELECT *, row_number() OVER (PARTITION BY genomeID ORDER BY ID) AS n FROM hit WHERE domain = 'BruaN')"),
    "rnk5_top5_per_group": sql(GENOME, body="SELECT Phylum, genomeID, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY Phylum ORDER BY genomeID) AS place FROM genome) WHERE place <= 5"),
    "srt3_lineage_order": sql(GENOME, body=f"SELECT genomeID, {_RANKED} FROM genome ORDER BY {_RANKED}, genomeID"),
    "srt4_hierarchical_topk": sql(GENOME, body=f"SELECT genomeID, {', '.join(_SIXR)} FROM genome ORDER BY {', '.join(_SIXR)}, genomeID"),
    "set1_union": sql(PROTEIN, GENOME, body="SELECT genomeID FROM genome UNION SELECT genomeID FROM protein"),
    "set2_intersect": sql(*_H, body="SELECT genomeID FROM hit WHERE domain = 'BruaN' INTERSECT SELECT genomeID FROM hit WHERE domain = 'PhooI'"),
    "set3_difference": sql(*_H, GENOME, body="SELECT genomeID FROM genome EXCEPT SELECT genomeID FROM hit WHERE domain = 'PhooI'"),
    "set4_merge_dedupe": "SELECT id, file, loaded_at FROM (SELECT proteinID AS id, trim(genomeID, ' ' || chr(9)) AS file, loaded_at, row_number() OVER (PARTITION BY proteinID ORDER BY loaded_at, trim(genomeID, ' ' || chr(9))) AS r FROM proteins) WHERE r = 1",
    "src11_gtdb_split": sql(GENOME, body="SELECT genomeID, Superkingdom, '' AS Clade, Phylum, Class, Ordnung, Family, Genus, Species FROM genome"),
    "src16_recursive_lineage": sql(GENOME, "w AS (SELECT * FROM genome WHERE Completeness > 99)", body=" UNION ".join(f"SELECT concat({_NODE[5]}) AS taxid, '{r.lower()}' AS rank, {r} AS name FROM w" for r in ("Superkingdom", "Phylum", "Class", "Ordnung", "Family", "Genus"))),
    "dml3_insert_absent": sql(GENOME, CLUSTER, body="SELECT genomeID FROM genome UNION SELECT genomeID FROM cluster_ WHERE genomeID IS NOT NULL"),
    "dml5_update_taxonomy": sql(GENOME, body="SELECT g.genomeID, coalesce(n.s, g.Strain) AS Strain FROM genome g LEFT JOIN (SELECT trim(genomeID, ' ' || chr(9)) AS id, max('re ' || Strain) AS s FROM genomes WHERE deleted_at IS NOT NULL GROUP BY 1) n ON n.id = g.genomeID"),
    "dml6_extend_domains": sql(DOMAIN, FOLD.replace("ORDER BY ID)", "ORDER BY CASE WHEN score > 200 THEN 0 ELSE 1 END, ID)"), body="SELECT proteinID, arch FROM arch"),
    "dml7_replace_keywords": sql(KEYWORD, body="SELECT ID, clusterID, keyword FROM keyword_ WHERE clusterID NOT IN (SELECT clusterID FROM keyword_ WHERE completeness = 1) UNION ALL SELECT DISTINCT 0, clusterID, 'renewed' FROM keyword_ WHERE completeness = 1"),
    "dml7_rewrite_clusters": sql(PROTEIN, PLACED, GENOME, CLUSTER, KEYWORD, "gone AS (SELECT genomeID FROM genome WHERE Superkingdom ILIKE 'archaea')", BLOCK.replace("FROM placed WINDOW", "FROM placed WHERE genomeID IN (FROM gone) WINDOW"), body="""SELECT 'proteins' AS table_name, p.proteinID AS key, CASE WHEN p.genomeID IN (FROM gone) THEN b.block ELSE p.clusterID END AS clusterID FROM protein p LEFT JOIN block b USING (proteinID)
UNION ALL SELECT 'clusters', genomeID, clusterID FROM cluster_ c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.genomeID = c.genomeID) UNION ALL SELECT DISTINCT 'clusters', genomeID, block FROM block
UNION ALL SELECT 'keywords', keyword, clusterID FROM keyword_ WHERE clusterID NOT IN (SELECT clusterID FROM cluster_ WHERE genomeID IN (FROM gone)) UNION ALL SELECT DISTINCT 'keywords', 'renewed', block FROM block"""),
    "dml8_rename_domain": sql(PROTEIN, DOMAIN, body="SELECT ID, CASE WHEN domain = 'BruaN' AND proteinID IN (SELECT proteinID FROM protein WHERE clusterID IS NOT NULL) THEN 'BruaN_new' ELSE domain END AS domain FROM domain_"),
    "dml9_delete_cascade": sql(PROTEIN, DOMAIN, GENOME, CLUSTER, KEYWORD, "gone AS (SELECT genomeID FROM genome WHERE Completeness < 85)", body="""SELECT 'genomes' AS table_name, count(*) AS n FROM genome WHERE genomeID NOT IN (FROM gone)
UNION ALL SELECT 'proteins', count(*) FROM protein WHERE genomeID NOT IN (FROM gone) UNION ALL SELECT 'clusters', count(*) FROM cluster_ c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.genomeID = c.genomeID)
UNION ALL SELECT 'domains', count(*) FROM domain_ WHERE proteinID NOT IN (SELECT proteinID FROM protein WHERE genomeID IN (FROM gone))
UNION ALL SELECT 'keywords', count(*) FROM keyword_ WHERE clusterID NOT IN (SELECT clusterID FROM cluster_ WHERE genomeID IN (FROM gone))"""),
    "dml10_delete_proteins": sql(PROTEIN, DOMAIN, body="SELECT ID, proteinID FROM domain_ WHERE proteinID NOT IN (SELECT proteinID FROM protein WHERE dom_count > 2)"),
    "dml11_delete_protein": sql(PROTEIN, DOMAIN, body="SELECT ID, proteinID FROM domain_ WHERE proteinID <> (SELECT min(proteinID) FROM protein) UNION ALL SELECT NULL, proteinID FROM protein WHERE proteinID <> (SELECT min(proteinID) FROM protein)"),
    "lint_unlisted_genes": sql("pattern AS (SELECT DISTINCT unnest([gene_1, gene_2, gene_3, gene_4, gene_5, gene_6, gene_7, gene_8, gene_9]) AS gene FROM patterns)", body="SELECT gene FROM pattern WHERE gene IS NOT NULL AND gene NOT IN (SELECT hmm FROM thresholds WHERE hmm IS NOT NULL)"),
}
