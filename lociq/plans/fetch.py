"""Fetches and datasets with parameters, as the command line and callers ask for them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions import render
from lociq.operators import filters, matrix, overlap
from lociq.plans import gene_queries
from lociq.plans.sqlviews import DOMAIN, FOLD, GENOME, KEYWORD, PROTEIN, sql
from lociq.schemas import RANKS
from lociq.sources import catalog, sinks


@dataclass(frozen=True)
class Limits:
    """Which genomes count: those of a taxon, and those that have (``semi``) or lack (``anti``) a
    domain or a keyword of one of these parts. Nothing given lets all genomes through."""

    ranks: Sequence[tuple[str, str]] = field(default_factory=tuple)
    domains: Sequence[str] = field(default_factory=tuple)
    keywords: Sequence[str] = field(default_factory=tuple)
    mode: str = "semi"

    def __bool__(self) -> bool:
        return bool(self.ranks or self.domains or self.keywords)


def genomes_within(spark: SparkSession, d: str, limits: Limits) -> DataFrame:
    """(genomeID) of the genomes within the limits. Several taxa are alternatives."""
    g = catalog.genomes(spark, d, "genomeID", *dict.fromkeys(r for r, _ in limits.ranks))
    if limits.ranks:
        any_of = F.lit(False)
        for rank, taxon in limits.ranks:
            any_of = any_of | filters.rank_like(rank, taxon)
        g = g.where(any_of)
    g = g.select("genomeID")
    if limits.domains:
        has = catalog.proteins(spark, d, "proteinID", "genomeID").join(catalog.domains(spark, d, "ID", "proteinID", "domain").where(filters.any_like("domain", limits.domains)), "proteinID", "left_semi")
        g = filters.limited(g, has, limits.mode)
    if limits.keywords:
        named = catalog.keywords(spark, d, "ID", "clusterID", "keyword").where(filters.any_like("keyword", limits.keywords))
        has = catalog.proteins(spark, d, "proteinID", "genomeID", "clusterID").join(named, "clusterID", "left_semi")
        g = filters.limited(g, has, limits.mode)
    return g


def fetch(spark: SparkSession, d: str, domains: Sequence[str] = (), keywords: Sequence[str] = (), all_keywords: bool = False, limits: Limits | None = None, least: float = 0.5) -> DataFrame:
    """Proteins with all of their domains, cluster names and lineage: the hit table and the
    sequence of those that have a domain of one of the parts ``domains`` and lie in a cluster
    with a keyword of one of the parts ``keywords`` (of every part, with ``all_keywords``).

    No part given asks for nothing: without any, all proteins come. Names with a completeness
    of ``least`` or less are left out of the strings.
    """
    limits = limits or Limits()
    p = catalog.proteins(spark, d)
    if limits:
        p = filters.limited(p, genomes_within(spark, d, limits))
    if domains:
        p = p.join(catalog.domains(spark, d, "ID", "proteinID", "domain").where(filters.any_like("domain", domains)), "proteinID", "left_semi")
    if keywords:
        k = catalog.keywords(spark, d, "ID", "clusterID", "keyword")
        within = filters.has_all(k, "clusterID", "keyword", keywords) if all_keywords else k.where(filters.any_like("keyword", keywords))
        p = p.join(within, "clusterID", "left_semi")
    # All domains of a fetched protein come along, also those no part names.
    rows = catalog.domains(spark, d).join(p.select("proteinID"), "proteinID", "left_semi") if domains or keywords or limits else catalog.domains(spark, d)
    folded = overlap.overlap_fold(rows, "proteinID", "ID")
    p = p.join(folded, "proteinID", "left").withColumn("arch", render.architecture("domains")).withColumn("scores", render.scores("domains")).withColumn("coords", render.coordinates("domains"))
    names = catalog.keywords(spark, d).where(F.col("completeness") > least).select("clusterID", "keyword", "completeness", F.col("collinearity").alias("collinear")).distinct()
    t = sinks.hit_table(p, names, catalog.genomes(spark, d, "genomeID", *RANKS))
    return t.select("genomeID", "proteinID", "arch", "scores", "coords", "contig", "start", "end", "strand", "locustag", "clusterID", "keywords", "completeness", "csb", "lineage", "sequence")


def dataset(spark: SparkSession, d: str, domains: Sequence[str] = (), keywords: Sequence[str] = (), fusions: Sequence[Sequence[str]] = (), in_blocks: Sequence[tuple[str, Sequence[str], bool]] = (), limits: Limits | None = None, least: float = 0.5, most: int = 1, combos: Sequence[Sequence[str]] = ()) -> DataFrame:
    """A row a genome and a 0/1 column a feature: domains and keywords by their names (without
    regard to case, ``_`` and ``%`` as wildcards), fusions ``A+B`` of proteins that have every
    part, and domains of proteins in a block with (or, if false, without) one of some keywords.
    Then the combinations of up to ``most`` features, or those listed.

    Every feature kind is one pass over its table, however many features there are.
    """
    g = genomes_within(spark, d, limits or Limits())
    p = catalog.proteins(spark, d, "proteinID", "genomeID", "clusterID", "dom_count")
    hits = p.join(catalog.domains(spark, d, "ID", "proteinID", "domain"), "proteinID")
    named = catalog.keywords(spark, d, "ID", "clusterID", "keyword", "completeness").where(F.col("completeness") > least)
    label = lambda column, parts: F.explode(F.array_compact(F.array(*[F.when(F.col(column).ilike(x), F.lit(x)) for x in parts]))).alias("feature")
    found, features = [], []
    if domains:
        found.append(hits.select("genomeID", label("domain", domains)))
        features += domains
    if keywords:
        found.append(p.join(named, "clusterID").select("genomeID", label("keyword", keywords)))
        features += keywords
    for parts in fusions:
        name = "+".join(parts)
        per = hits.where(F.col("dom_count") >= len(parts)).groupBy("proteinID", "genomeID").agg(*[F.bool_or(F.col("domain").ilike(x)).alias(f"p{i}") for i, x in enumerate(parts)])
        whole = F.lit(True)
        for i in range(len(parts)):
            whole = whole & F.col(f"p{i}")
        found.append(per.where(whole).select("genomeID", F.lit(name).alias("feature")))
        features.append(name)
    for domain, words, within in in_blocks:
        name = f"{domain}{'@' if within else '!'}{','.join(words)}"
        rows = hits.where(F.col("domain").ilike(domain)).join(named.where(filters.any_like("keyword", words)), "clusterID", "left_semi" if within else "left_anti")
        found.append(rows.select("genomeID", F.lit(name).alias("feature")))
        features.append(name)
    if not features:
        raise ValueError("a dataset needs a feature")
    cells = found[0]
    for f in found[1:]:
        cells = cells.unionByName(f)
    m = matrix.presence(g, cells, features)
    return matrix.combined_as(m, combos) if combos else matrix.combined(m, features, most) if most > 1 else m


def fetch_hit_table(spark: SparkSession, d: str) -> DataFrame:
    """A fetch with all kinds of predicates."""
    t = fetch(spark, d, domains=("Drai", "Wexa", "Brua"), keywords=("mt", "ox"), limits=Limits(ranks=(("Superkingdom", "bacteria"),), domains=("Phoo",)))
    return t.select("genomeID", "proteinID", "arch", "clusterID", "keywords", "completeness", "csb", "lineage")


def dataset_features(spark: SparkSession, d: str) -> DataFrame:
    """A dataset of all kinds of features."""
    m = dataset(spark, d, domains=("BruaN", "PhooI"), keywords=("mtSteor",), fusions=(("BruaN", "PhooI"),), in_blocks=(("SteoI", ("mt", "ox"), True), ("SteoI", ("mt", "ox"), False)), limits=Limits(ranks=(("Superkingdom", "bacteria"), ("Superkingdom", "archaea"))))
    names = ("bruan", "phooi", "mtsteor", "fusion", "inside", "outside")
    return m.select("genomeID", *[F.col(f"`{c}`").alias(n) for c, n in zip(m.columns[1:], names, strict=True)])


QUERIES = {f.__name__: f for f in (fetch_hit_table, dataset_features)}

_BASE = (PROTEIN, DOMAIN, FOLD, GENOME, KEYWORD)
_HAS = "CAST(EXISTS (SELECT 1 FROM hit h WHERE h.genomeID = g.genomeID AND {}) AS INTEGER)".format
_WITHIN = "clusterID IN (SELECT clusterID FROM keyword_ WHERE completeness > 0.5 AND (keyword ILIKE '%mt%' OR keyword ILIKE '%ox%'))"

ORACLE = {
    "fetch_hit_table": sql(*_BASE, gene_queries._NAMES.replace("FROM keyword_)", "FROM keyword_ WHERE completeness > 0.5)"), """sel AS (SELECT * FROM protein WHERE genomeID IN (SELECT genomeID FROM genome WHERE Superkingdom ILIKE 'bacteria')
  AND genomeID IN (SELECT p.genomeID FROM protein p JOIN domain_ d USING (proteinID) WHERE domain ILIKE '%Phoo%')
  AND proteinID IN (SELECT proteinID FROM domain_ WHERE domain ILIKE '%Drai%' OR domain ILIKE '%Wexa%' OR domain ILIKE '%Brua%') AND clusterID IN (SELECT clusterID FROM keyword_ WHERE keyword ILIKE '%mt%' OR keyword ILIKE '%ox%'))""",
        body=f"SELECT p.genomeID, p.proteinID, arch, p.clusterID, keywords, strings.completeness, csb, {gene_queries._LINEAGE} AS lineage FROM sel p LEFT JOIN arch USING (proteinID) LEFT JOIN strings ON strings.clusterID = p.clusterID JOIN genome g ON g.genomeID = p.genomeID"),
    "dataset_features": sql(*_BASE, "hit AS (SELECT proteinID, genomeID, clusterID, dom_count, domain FROM protein JOIN domain_ USING (proteinID))", body=f"""SELECT genomeID, {_HAS("domain ILIKE 'BruaN'")} AS bruan, {_HAS("domain ILIKE 'PhooI'")} AS phooi,
  CAST(EXISTS (SELECT 1 FROM protein p JOIN keyword_ k USING (clusterID) WHERE p.genomeID = g.genomeID AND k.completeness > 0.5 AND keyword ILIKE 'mtSteor') AS INTEGER) AS mtsteor,
  {_HAS("proteinID IN (SELECT proteinID FROM hit WHERE dom_count >= 2 AND (domain ILIKE 'BruaN' OR domain ILIKE 'PhooI') GROUP BY proteinID HAVING count(DISTINCT lower(domain)) = 2)")} AS fusion,
  {_HAS(f"domain ILIKE 'SteoI' AND {_WITHIN}")} AS inside, {_HAS(f"domain ILIKE 'SteoI' AND NOT coalesce({_WITHIN}, false)")} AS outside
FROM genome g WHERE Superkingdom ILIKE 'bacteria' OR Superkingdom ILIKE 'archaea'"""),
}
