"""Queries p1, p4 and p5: dangling references, intervals, heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions.keys import first_dot, present, trim_key
from lociq.operators import frequency, intervals, references
from lociq.sources.tables import table


def _reference_tables(spark: SparkSession, d: str):
    genomes, clusters, keywords, proteins = (table(spark, d, t) for t in ("genomes", "clusters", "keywords", "proteins"))
    live = lambda t: t.where("deleted_at IS NULL")
    parents = [
        references.Parent("clusters", live(clusters), trim_key("clusterID"), F.col("loaded_at")),
        references.Parent("genomes", live(genomes), trim_key("genomeID"), F.col("loaded_at")),
    ]
    named = lambda t: t.where(present(trim_key("clusterID")))
    children = [
        references.Child("proteins", "clusters", named(proteins), trim_key("clusterID"), F.col("proteinID"), F.col("loaded_at")),
        references.Child("keywords", "clusters", named(keywords), trim_key("clusterID"), F.col("ID"), F.col("loaded_at")),
        references.Child("clusters", "genomes", live(clusters), first_dot(trim_key("genomeID")), trim_key("clusterID"), F.col("loaded_at")),
    ]
    return parents, children


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    o = references.orphans(*_reference_tables(spark, d))
    return o.select("src_table", "record_key", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def p1_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    c = references.orphan_counts(*_reference_tables(spark, d))
    return c.select("src_table", "parent_table", "period", F.col("references").alias("n_references"), "orphan_keys")


def _genes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "proteins").select(trim_key("genomeID").alias("genomeID"), trim_key("contig").alias("contig"), "start", "end")
    return p.where(F.coalesce(F.col("contig") != "", F.lit(False)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    g = intervals.gaps(_genes(spark, d), ["genomeID", "contig"])
    return g.select("genomeID", "contig", F.col("gap_start").cast("int").alias("gap_start"), F.col("gap_end").cast("int").alias("gap_end"))


def p4_stretches(spark: SparkSession, d: str) -> DataFrame:
    return intervals.islands(_genes(spark, d), ["genomeID", "contig"]).select("genomeID", "contig", "stretch_start", "stretch_end", "n_starts")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    p, m = table(spark, d, "proteins"), table(spark, d, "domains")
    heavy = frequency.heavy_keys([
        ("proteins.genomeID", p, trim_key("genomeID"), trim_key("contig")),
        ("domains.domain", m, trim_key("domain"), F.col("score")),
    ], "0.04")
    return heavy.select("field_name", "key_value")


def p5_genome_stats(spark: SparkSession, d: str) -> DataFrame:
    s = frequency.key_stats(table(spark, d, "proteins"), trim_key("genomeID"), F.nullif(trim_key("contig"), F.lit("")))
    return s.select(F.col("key").alias("genomeID"), F.col("rows").alias("n_rows"), F.col("values").alias("n_values"), "distinct_values", F.col("mode").alias("mode_contig"), "mode_rows")


def p5_domain_stats(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "domains").where(F.coalesce(trim_key("domain") != "", F.lit(False)))
    s = frequency.key_stats(m, trim_key("domain"), F.col("score"))
    q = frequency.key_percentile(m, trim_key("domain"), F.col("score"), 0.5)
    return s.join(q, "key", "left").select(F.col("key").alias("domain"), F.col("rows").alias("n_rows"), F.col("values").alias("n_values"), "distinct_values", F.col("mode").alias("mode_score"), "mode_rows", F.col("percentile").alias("median_score"))


QUERIES = {
    "p1_found": p1_found, "p1_orphan_counts": p1_orphan_counts, "p4_found": p4_found, "p4_stretches": p4_stretches,
    "p5_found": p5_found, "p5_genome_stats": p5_genome_stats, "p5_domain_stats": p5_domain_stats,
}

_TRIM = "trim({0}, ' ' || chr(9))"
_REFS = """
WITH child AS (
  SELECT 'proteins' AS src_table, 'clusters' AS parent_table, trim(clusterID, ' ' || chr(9)) AS key, proteinID AS record_key, loaded_at FROM proteins
  WHERE trim(clusterID, ' ' || chr(9)) NOT IN ('', 'NULL')
  UNION ALL SELECT 'keywords', 'clusters', trim(clusterID, ' ' || chr(9)), CAST(ID AS VARCHAR), loaded_at FROM keywords
  WHERE trim(clusterID, ' ' || chr(9)) NOT IN ('', 'NULL')
  UNION ALL SELECT 'clusters', 'genomes', split_part(trim(genomeID, ' ' || chr(9)), '.', 1), trim(clusterID, ' ' || chr(9)), loaded_at FROM clusters WHERE deleted_at IS NULL),
parent AS (
  SELECT 'clusters' AS parent_table, trim(clusterID, ' ' || chr(9)) AS key, loaded_at FROM clusters WHERE deleted_at IS NULL
  UNION ALL SELECT 'genomes', trim(genomeID, ' ' || chr(9)), loaded_at FROM genomes WHERE deleted_at IS NULL),
orphan AS (
  SELECT c.*, strftime(c.loaded_at, '%Y-%m') AS period FROM child c
  WHERE NOT EXISTS (SELECT 1 FROM parent p WHERE p.parent_table = c.parent_table AND p.key = c.key AND p.loaded_at <= c.loaded_at))
"""
_GENES = """
WITH gene AS (
  SELECT trim(genomeID, ' ' || chr(9)) AS genomeID, trim(contig, ' ' || chr(9)) AS contig, CAST(least("start", "end") AS BIGINT) AS s, CAST(greatest("start", "end") AS BIGINT) AS e
  FROM proteins WHERE "start" IS NOT NULL AND "end" IS NOT NULL AND trim(contig, ' ' || chr(9)) <> ''),
seen AS (SELECT *, max(e) OVER (PARTITION BY genomeID, contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM gene)
"""

ORACLE = {
    "p1_found": _REFS + "SELECT DISTINCT src_table, record_key, period FROM orphan",
    "p1_orphan_counts": _REFS + "SELECT src_table, parent_table, period, count(*) AS n_references, count(DISTINCT key) AS orphan_keys FROM orphan GROUP BY ALL",
    "p4_found": _GENES + "SELECT genomeID, contig, CAST(far + 1 AS INTEGER) AS gap_start, CAST(s - 1 AS INTEGER) AS gap_end FROM seen WHERE s > far + 1",
    "p4_stretches": _GENES + """, island AS (
  SELECT *, sum(CASE WHEN s <= far + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY genomeID, contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM seen)
SELECT genomeID, contig, min(s) AS stretch_start, max(e) AS stretch_end, count(DISTINCT s) AS n_starts FROM island GROUP BY genomeID, contig, g""",
    "p5_found": """
WITH k AS (
  SELECT 'proteins.genomeID' AS field_name, trim(genomeID, ' ' || chr(9)) AS key_value FROM proteins
  UNION ALL SELECT 'domains.domain', trim(domain, ' ' || chr(9)) FROM domains),
c AS (SELECT field_name, key_value, count(*) AS n FROM k WHERE key_value <> '' GROUP BY ALL)
SELECT field_name, key_value FROM (SELECT *, sum(n) OVER (PARTITION BY field_name) AS total FROM c) WHERE 100 * n >= 4 * total""",
    "p5_genome_stats": """
WITH r AS (SELECT trim(genomeID, ' ' || chr(9)) AS genomeID, nullif(trim(contig, ' ' || chr(9)), '') AS v FROM proteins),
c AS (SELECT genomeID AS g, v AS mode_contig, count(*) AS mode_rows FROM r WHERE v IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY mode_rows DESC, mode_contig) AS r FROM c),
s AS (SELECT r.genomeID, count(*) AS n_rows, count(v) AS n_values, count(DISTINCT v) AS distinct_values FROM r GROUP BY 1)
SELECT s.*, m.mode_contig, coalesce(m.mode_rows, 0) AS mode_rows FROM s LEFT JOIN m ON m.g = s.genomeID AND m.r = 1""",
    "p5_domain_stats": """
WITH r AS (SELECT trim(domain, ' ' || chr(9)) AS domain, score AS v FROM domains WHERE trim(domain, ' ' || chr(9)) <> ''),
c AS (SELECT domain AS d, v AS mode_score, count(*) AS mode_rows FROM r WHERE v IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY mode_rows DESC, mode_score) AS r FROM c),
s AS (SELECT domain, count(*) AS n_rows, count(v) AS n_values, count(DISTINCT v) AS distinct_values, CAST(quantile_disc(v, 0.5) AS BIGINT) AS median_score FROM r GROUP BY 1)
SELECT s.*, mode_score, coalesce(m.mode_rows, 0) AS mode_rows FROM s LEFT JOIN m ON m.d = s.domain AND m.r = 1""",
}
