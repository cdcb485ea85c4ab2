"""Queries behind the writers, and joins and orders that other queries hold as a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions import render
from lociq.operators import filters, matrix, overlap, patterns, sequences
from lociq.plans import fetch_queries, gene_queries
from lociq.plans.sqlviews import BLOCK, CLUSTER, DOMAIN, FOLD, GENOME, KEYWORD, PATTERN, PLACED, PROTEIN, TOKEN, sql
from lociq.schemas import RANKS
from lociq.sources import catalog, sinks


def _records(p: DataFrame, folded: DataFrame, names: DataFrame, *keep: str, how: str = "inner") -> DataFrame:
    """The FASTA record of each protein: its id, architecture, scores and places, its cluster with
    keywords, completeness and order, and the sequence. Without a cluster the header ends early."""
    p = p.where("sequence IS NOT NULL").join(folded, "proteinID", how).join(sinks.keyword_strings(names), "clusterID", "left")
    p = p.withColumn("arch", render.architecture("domains")).withColumn("scores", render.scores("domains")).withColumn("coords", render.coordinates("domains"))
    return p.select(*keep, "arch", sinks.record_header().alias("header"), F.replace("sequence", F.lit("*"), F.lit("")).alias("seq"))


def _fasta(records: DataFrame) -> Column:
    return F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("record")


def _sequenced(spark: SparkSession, d: str) -> DataFrame:
    return catalog.proteins(spark, d, "proteinID", "genomeID", "clusterID", "sequence")


def snk2_architecture_fasta(spark: SparkSession, d: str) -> DataFrame:
    """The FASTA record of each protein with its architecture, which names its file."""
    r = _records(_sequenced(spark, d), gene_queries._folded(spark, d), gene_queries._stored_names(spark, d))
    return r.select("arch", _fasta(r))


def prj7_header_tokens(spark: SparkSession, d: str) -> DataFrame:
    """What the headers of these records say: id, type and keywords, read back from the text."""
    r = _records(_sequenced(spark, d), gene_queries._folded(spark, d), gene_queries._stored_names(spark, d))
    return render.header_tokens(r, "header").select("id", "type", F.array_join("keywords", ",").alias("keywords"))


def snk3_fusion_parts(spark: SparkSession, d: str) -> DataFrame:
    p = catalog.proteins(spark, d, "proteinID", "sequence").where("sequence IS NOT NULL").join(gene_queries._folded(spark, d), "proteinID")
    return sinks.fusion_parts(p)


def snk4_keyword_fasta(spark: SparkSession, d: str) -> DataFrame:
    """FASTA records of the blocks of each keyword subset, a file a subset."""
    p = _sequenced(spark, d).join(fetch_queries.cmb2_keyword_subsets(spark, d), "clusterID")
    r = _records(p, gene_queries._folded(spark, d), gene_queries._stored_names(spark, d), "subset", "proteinID", how="left")
    return r.select("subset", "proteinID", _fasta(r))


def snk5_binary_dataset(spark: SparkSession, d: str) -> DataFrame:
    return sinks.binary_rows(fetch_queries._matrix(spark, d), catalog.genomes(spark, d, "genomeID", *RANKS), fetch_queries.FEATURES)


def snk6_taxon_symbols(spark: SparkSession, d: str) -> DataFrame:
    g = catalog.genomes(spark, d, "genomeID", *RANKS).select(render.lineage(["genomeID", *RANKS]).alias("node"), F.lit("#ff0000").alias("shade"))
    return sinks.symbol_rows(g, "node", "shade")


def _rank_counts_wide(spark: SparkSession, d: str, value: str) -> DataFrame:
    """A row a taxon of every rank, a column a feature."""
    s = matrix.rank_statistics(catalog.genomes(spark, d, "genomeID", *RANKS), fetch_queries._matrix(spark, d), fetch_queries.FEATURES, RANKS)
    return s.groupBy("level", "taxon").pivot("feature", list(fetch_queries.FEATURES)).agg(F.max(value))


def snk9_rank_counts_wide(spark: SparkSession, d: str) -> DataFrame:
    return _rank_counts_wide(spark, d, "n_present")


def snk9_rank_ratios_wide(spark: SparkSession, d: str) -> DataFrame:
    r = _rank_counts_wide(spark, d, "ratio")
    return r.select("level", "taxon", *[F.round(f, 6).alias(f) for f in fetch_queries.FEATURES])


def snk10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Counts per rank, domain and keyword in one table."""
    g = fetch_queries.agg1_rank_counts(spark, d).select("level", "taxon", F.col("n_genomes").alias("n"))
    m = fetch_queries.agg2_domain_counts(spark, d).select(F.lit("domain").alias("level"), F.col("domain").alias("taxon"), "n")
    k = fetch_queries.agg3_keyword_counts(spark, d).select(F.lit("keyword").alias("level"), F.col("keyword").alias("taxon"), "n")
    return g.unionByName(m).unionByName(k)


def snk10_genome_dump(spark: SparkSession, d: str) -> DataFrame:
    """All genomes by lineage, every column as text."""
    g = catalog.genomes(spark, d, "genomeID", *RANKS, "Strain", "TypeStrain", "NCBITaxon", "NCBIBioproject", "NCBIBiosample", "NCBIAssembly")
    return sinks.genome_dump(g)


def snk15_taxon_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers rewritten to lineages, numbered from the second record of a genome on; a record
    without a lineage keeps its own id. The type stands behind it."""
    r = fetch_queries._genes_with_domains(spark, d, "genomeID").where("domain = 'PhooI'").select("ID", "genomeID", "proteinID", "domain")
    named = sinks.tree_names(r, catalog.genomes(spark, d, "genomeID", *RANKS), ("ID",), "proteinID")
    return named.select("ID", F.concat_ws(" ", "node", "domain").alias("label"))


def lim1_debug_dump(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 rows of all tables joined, by protein and domain: a look into a store."""
    k = catalog.keywords(spark, d, "ID", "clusterID", "keyword").select("clusterID", "keyword").distinct()
    rows = fetch_queries._genes_with_domains(spark, d, "genomeID", "clusterID").join(catalog.genomes(spark, d, "genomeID", "Phylum"), "genomeID", "left").join(k, "clusterID", "left")
    return rows.orderBy("proteinID", "ID", "keyword").limit(100).select("proteinID", "genomeID", "clusterID", "ID", "domain", "Phylum", "keyword")


def jn3_members_of_a_genome(spark: SparkSession, d: str) -> DataFrame:
    """Proteins and domains of the genome that has the most proteins."""
    p = catalog.proteins(spark, d, "proteinID", "genomeID")
    top = p.groupBy("genomeID").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "genomeID").limit(1)
    return filters.limited(p, top).join(catalog.domains(spark, d, "ID", "proteinID", "domain"), "proteinID").select("proteinID", "ID", "domain")


def jn7_hits_with_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    t = catalog.thresholds(spark, d).select(F.col("hmm").alias("domain"), "cutoff")
    return catalog.domains(spark, d, "ID", "domain").join(t, "domain", "left").select("ID", F.coalesce("cutoff", F.lit(overlap.DEFAULT_CUTOFF)).alias("cutoff"))


def jn8_unplaced_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Places of proteins; what has none keeps an empty contig and zeros."""
    ids = catalog.domains(spark, d, "ID", "proteinID").select("proteinID").distinct()
    p = catalog.proteins(spark, d, "proteinID", "contig", "start", "end")
    return ids.join(p, "proteinID", "left").select("proteinID", F.coalesce("contig", F.lit("")).alias("contig"), F.coalesce("start", F.lit(0)).alias("first"), F.coalesce("end", F.lit(0)).alias("last"))


def jn9_sequences_of_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = catalog.domains(spark, d, "ID", "proteinID", "score").where("score > 200").select("proteinID").distinct()
    return hits.join(catalog.proteins(spark, d, "proteinID", "sequence"), "proteinID", "left").select("proteinID", F.md5("sequence").alias("digest"))


def jn10_blocks_and_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Every block with every pattern it shares a gene with, and how many."""
    c = patterns.candidates(gene_queries._block_tokens(spark, d), catalog.patterns(spark, d), "block")
    return c.select("block", "pattern_id", F.size(F.array_intersect("genes", "tokens")).alias("shared"))


def jn14_keywords_of_blocks(spark: SparkSession, d: str) -> DataFrame:
    k = catalog.keywords(spark, d, "ID", "clusterID", "keyword", "completeness").where("completeness > 0.5").select("clusterID", "keyword").distinct()
    return catalog.clusters(spark, d).join(k, "clusterID", "left").select("clusterID", "keyword")


def jn19_taxon_of_genome(spark: SparkSession, d: str) -> DataFrame:
    return matrix.by_rank(catalog.genomes(spark, d, "genomeID", *RANKS), RANKS)


def agg16_floor_mean(spark: SparkSession, d: str) -> DataFrame:
    """All of a genome's features there: the whole part of their mean, in long form."""
    m = fetch_queries._matrix(spark, d)
    long = m.select("genomeID", F.explode(F.array(*[F.col(f) for f in fetch_queries.FEATURES[:3]])).alias("present"))
    return long.groupBy("genomeID").agg(F.floor(F.avg("present")).cast("int").alias("complete"))


def srt1_hit_order(spark: SparkSession, d: str) -> DataFrame:
    return catalog.placed(spark, d).orderBy("genomeID", "contig", "start", "proteinID").select("genomeID", "contig", "start", "proteinID")


def set5_domains_in_common(spark: SparkSession, d: str) -> DataFrame:
    """Proteins whose domains overlap a wanted set."""
    m = catalog.domains(spark, d, "ID", "proteinID", "domain").groupBy("proteinID").agg(F.collect_set("domain").alias("s"))
    wanted = F.array(*[F.lit(x) for x in fetch_queries.MARKERS])
    return m.where(F.arrays_overlap("s", wanted)).select("proteinID", F.size(F.array_intersect("s", wanted)).alias("common"))


def lim3_exists(spark: SparkSession, d: str) -> DataFrame:
    return catalog.clusters(spark, d).join(catalog.proteins(spark, d, "proteinID", "clusterID").where("clusterID IS NOT NULL").select("clusterID"), "clusterID", "left_semi").select("clusterID")


def src24_genome_ids(spark: SparkSession, d: str) -> DataFrame:
    return catalog.genomes(spark, d, "genomeID").select("genomeID").distinct()


QUERIES = {f.__name__: f for f in (
    snk2_architecture_fasta, prj7_header_tokens, snk3_fusion_parts, snk4_keyword_fasta, snk5_binary_dataset, snk6_taxon_symbols, snk9_rank_counts_wide, snk9_rank_ratios_wide, snk10_statistics, snk10_genome_dump, lim1_debug_dump, snk15_taxon_headers, jn3_members_of_a_genome, jn7_hits_with_cutoffs,
    jn8_unplaced_defaults, jn9_sequences_of_hits, jn10_blocks_and_patterns, jn14_keywords_of_blocks, jn19_taxon_of_genome, agg16_floor_mean, srt1_hit_order, set5_domains_in_common, lim3_exists, src24_genome_ids,
)}

_F = fetch_queries
_NODE = "replace(concat_ws('_', genomeID, " + ", ".join(RANKS) + "), ' ', '-')"
_HEADER = """concat_ws(' ', genomeID || '-' || proteinID, arch, scores, coords, CASE WHEN p.clusterID IS NOT NULL THEN concat_ws(' ', p.clusterID, coalesce(keywords, ''), coalesce(completeness, ''), coalesce(csb, '')) END)"""
_RECORD = f"""record AS (SELECT p.proteinID, p.genomeID, p.clusterID, arch, keywords, {_HEADER} AS header, '>' || {_HEADER} || chr(10) || replace(sequence, '*', '') AS record
  FROM protein p LEFT JOIN arch USING (proteinID) LEFT JOIN strings ON strings.clusterID = p.clusterID WHERE sequence IS NOT NULL)"""
_REC = (PROTEIN, DOMAIN, FOLD, KEYWORD, gene_queries._NAMES, _RECORD)

ORACLE = {
    "snk2_architecture_fasta": sql(*_REC, body="SELECT arch, record FROM record WHERE arch IS NOT NULL"),
    "prj7_header_tokens": sql(*_REC, body="SELECT genomeID || '-' || proteinID AS id, regexp_extract(arch, '[^_]*$') AS type, coalesce(keywords, '') AS keywords FROM record WHERE arch IS NOT NULL"),
    "snk3_fusion_parts": sql(PROTEIN, DOMAIN, FOLD, body="SELECT proteinID, k.d AS domain, substr(replace(sequence, '*', ''), k.s + 1, k.e - k.s) AS part FROM fold JOIN protein USING (proteinID) JOIN arch USING (proteinID) WHERE sequence IS NOT NULL AND n_domains > 1"),
    "snk4_keyword_fasta": sql(*_REC, _F._WORDS, f"subsets AS ({_F._SUB})", body="SELECT subset, proteinID, record FROM record JOIN subsets USING (clusterID)"),
    "snk5_binary_dataset": sql(PROTEIN, DOMAIN, _F._WITH, GENOME, KEYWORD, _F._CELL, body=f"SELECT genomeID, concat_ws(chr(9), {_NODE}, {', '.join(f'CAST({f} AS VARCHAR)' for f in _F.FEATURES)}) AS line FROM matrix JOIN genome USING (genomeID)"),
    "snk6_taxon_symbols": sql(GENOME, body=f"SELECT concat_ws(chr(9), {_NODE}, '2', '10', '#ff0000', '1', '1') AS line FROM genome"),
    "snk9_rank_counts_wide": sql(PROTEIN, DOMAIN, _F._WITH, GENOME, KEYWORD, _F._CELL, f"level AS ({_F._LEVELS})", body=f"SELECT level, taxon, {', '.join(f'CAST(sum({f}) AS BIGINT) AS {f}' for f in _F.FEATURES)} FROM level JOIN matrix USING (genomeID) GROUP BY level, taxon"),
    "snk9_rank_ratios_wide": sql(PROTEIN, DOMAIN, _F._WITH, GENOME, KEYWORD, _F._CELL, f"level AS ({_F._LEVELS})", body=f"SELECT level, taxon, {', '.join(f'round(sum({f}) / count(*), 6) AS {f}' for f in _F.FEATURES)} FROM level JOIN matrix USING (genomeID) GROUP BY level, taxon"),
    "snk10_genome_dump": sql(GENOME, body="SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'None') AS {c}" for c in ("genomeID", *RANKS, "Strain", "TypeStrain", "NCBITaxon", "NCBIBioproject", "NCBIBiosample", "NCBIAssembly")) + " FROM genome"),
    "lim1_debug_dump": sql(PROTEIN, DOMAIN, _F._WITH, GENOME, KEYWORD, body="""SELECT proteinID, hit.genomeID, hit.clusterID, ID, domain, Phylum, keyword FROM hit LEFT JOIN genome USING (genomeID)
LEFT JOIN (SELECT DISTINCT clusterID, keyword FROM keyword_) k ON k.clusterID = hit.clusterID ORDER BY proteinID, ID NULLS FIRST, keyword NULLS FIRST LIMIT 100"""),
    "snk10_statistics": sql(PROTEIN, DOMAIN, _F._WITH, GENOME, KEYWORD, body="SELECT level, taxon, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS level, {r} AS taxon FROM genome" for r in RANKS[:7]) + """) GROUP BY ALL
UNION ALL SELECT 'domain', domain, count(proteinID) FROM hit GROUP BY domain UNION ALL SELECT 'keyword', keyword, count(*) FROM keyword_ GROUP BY keyword"""),
    "snk15_taxon_headers": sql(PROTEIN, DOMAIN, _F._WITH, GENOME, body=f"""SELECT ID, coalesce(node, proteinID) || CASE n WHEN 1 THEN '' ELSE '_' || n END || ' PhooI' AS label
FROM (SELECT ID, proteinID, node, row_number() OVER (PARTITION BY hit.genomeID ORDER BY ID) AS n FROM hit LEFT JOIN (SELECT genomeID, {_NODE} AS node FROM genome) g ON g.genomeID = hit.genomeID WHERE domain = 'PhooI')"""),
    "jn3_members_of_a_genome": sql(PROTEIN, DOMAIN, body="SELECT proteinID, ID, domain FROM protein JOIN domain_ USING (proteinID) WHERE genomeID = (SELECT genomeID FROM protein GROUP BY genomeID ORDER BY count(*) DESC, genomeID LIMIT 1)"),
    "jn7_hits_with_cutoffs": sql(DOMAIN, body="SELECT ID, coalesce(optimized, 10.0) AS cutoff FROM domain_ LEFT JOIN thresholds ON hmm = domain"),
    "jn8_unplaced_defaults": sql(PROTEIN, DOMAIN, body="SELECT proteinID, coalesce(contig, '') AS contig, coalesce(s, 0) AS first, coalesce(e, 0) AS last FROM (SELECT DISTINCT proteinID FROM domain_) LEFT JOIN protein USING (proteinID)"),
    "jn9_sequences_of_hits": sql(PROTEIN, DOMAIN, body="SELECT proteinID, md5(sequence) AS digest FROM (SELECT DISTINCT proteinID FROM domain_ WHERE score > 200) LEFT JOIN protein USING (proteinID)"),
    "jn10_blocks_and_patterns": sql(PROTEIN, PLACED, DOMAIN, BLOCK, FOLD, TOKEN, PATTERN, body="SELECT block, pattern_id, CAST(len(list_filter(list_distinct(genes), lambda g: list_contains(tokens, g))) AS INTEGER) AS shared FROM blocktok JOIN pattern ON len(list_filter(genes, lambda g: list_contains(tokens, g))) > 0"),
    "jn14_keywords_of_blocks": sql(CLUSTER, KEYWORD, body="SELECT clusterID, keyword FROM cluster_ LEFT JOIN (SELECT DISTINCT clusterID, keyword FROM keyword_ WHERE completeness > 0.5) USING (clusterID)"),
    "jn19_taxon_of_genome": sql(GENOME, body=_F._LEVELS),
    "agg16_floor_mean": sql(PROTEIN, DOMAIN, _F._WITH, GENOME, KEYWORD, _F._CELL, body=f"SELECT genomeID, least({', '.join(_F.FEATURES[:3])}) AS complete FROM matrix"),
    "srt1_hit_order": sql(PROTEIN, PLACED, body="SELECT genomeID, contig, s AS start, proteinID FROM placed ORDER BY 1, 2, 3, 4"),
    "set5_domains_in_common": sql(DOMAIN, body=f"SELECT proteinID, CAST(count(DISTINCT domain) AS INTEGER) AS common FROM domain_ WHERE domain IN {_F.MARKERS} GROUP BY proteinID"),
    "lim3_exists": sql(PROTEIN, CLUSTER, body="SELECT clusterID FROM cluster_ WHERE clusterID IN (SELECT clusterID FROM protein)"),
    "src24_genome_ids": sql(GENOME, body="SELECT genomeID FROM genome"),
}
