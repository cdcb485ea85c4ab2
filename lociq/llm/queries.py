"""Queries p2, p3, p6 to p9 and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions.keys import clean_sequence, present, trim_key
from lociq.llm import bpe, cooccurrence, garbled, near_duplicates, packing, shared_spans
from lociq.sources.tables import table


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "proteins").select("proteinID", clean_sequence("sequence").alias("seq"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    p = near_duplicates.near_duplicate_pairs(_sequences(spark, d), "proteinID", "seq", width=5, least=0.5)
    return p.select(F.col("a").alias("protein_a"), F.col("b").alias("protein_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    g = near_duplicates.near_duplicate_groups(_sequences(spark, d), "proteinID", "seq", width=5, least=0.5)
    return g.select(F.col("id").alias("proteinID"), "class_id", "group_id", "links")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    r = shared_spans.shared_runs(_sequences(spark, d), "proteinID", "seq", least=40)
    return r.select(F.col("id").alias("proteinID"), "span_start", "span_end")


def p3_shared_share(spark: SparkSession, d: str) -> DataFrame:
    s = shared_spans.shared_share(_sequences(spark, d), "proteinID", "seq", least=40)
    return s.select(F.col("id").alias("proteinID"), "letters", "shared", F.round("share", 6).alias("share"))


def _domain_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "proteins").select("proteinID", trim_key("clusterID").alias("block")).where(present(F.col("block"))).distinct()
    m = table(spark, d, "domains").select("proteinID", trim_key("domain").alias("item")).where(F.coalesce(F.col("item") != "", F.lit(False))).distinct()
    return p.join(m, "proteinID")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    a = cooccurrence.associations(_domain_rows(spark, d), F.col("block"), F.col("item"), min_baskets=3, min_share="0.005", min_lift=3)
    return a.select(F.col("a").alias("domain_a"), F.col("b").alias("domain_b"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs in at least three blocks, with counts and lift."""
    a = cooccurrence.associations(_domain_rows(spark, d), F.col("block"), F.col("item"), min_baskets=3)
    return a.select(F.col("a").alias("domain_a"), F.col("b").alias("domain_b"), "k", "n_a", "n_b", F.col("n").alias("n_blocks"), F.round("lift", 6).alias("lift"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(table(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs, specs = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "packspecs")
    return packing.pack_texts(docs, specs, "doc_id", "text", "byte_bpe_50k")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("spec_id", F.col("id").alias("doc_id"), "piece", "container", "tokens")


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(_packed(spark, d), table(spark, d, "packspecs"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What the containers must keep: every document there, none beyond its capacity, none cut
    without need, no token astray."""
    docs, specs = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "packspecs")
    sizes = bpe.with_counts(docs, "text", "size").select("doc_id", "size")
    return packing.violations(_packed(spark, d), sizes, specs, "doc_id", "size")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restored(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {
    "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_shared_share": p3_shared_share,
    "p6_found": p6_found, "p6_pairs": p6_pairs, "p7_ids": p7_ids,
    "p8_containers": p8_containers, "p8_usage": p8_usage, "p8_invariants": p8_invariants, "p9_found": p9_found, "p9_restored": p9_restored,
}

_SEQ = """
WITH seq AS (SELECT DISTINCT proteinID, regexp_replace(upper(regexp_replace(sequence, '\\s', '', 'g')), '\\*$', '') AS s FROM proteins WHERE sequence IS NOT NULL)
"""
_PAIRS2 = _SEQ + """,
win AS (SELECT DISTINCT proteinID, substr(s, CAST(i AS INTEGER), 5) AS w FROM (SELECT proteinID, s, unnest(range(1, length(s) - 3)) AS i FROM seq WHERE length(s) >= 5)),
n AS (SELECT proteinID, count(*) AS n FROM win GROUP BY 1),
both_ AS (SELECT a.proteinID AS a, b.proteinID AS b, count(*) AS k FROM win a JOIN win b ON a.w = b.w AND a.proteinID < b.proteinID GROUP BY ALL),
pair AS (SELECT a, b FROM both_ JOIN n x ON x.proteinID = a JOIN n y ON y.proteinID = b WHERE 2 * k >= x.n + y.n - k)
"""
_SHARED3 = _SEQ + """,
win AS (SELECT proteinID, i, substr(s, CAST(i AS INTEGER), 40) AS w FROM (SELECT proteinID, s, unnest(range(1, length(s) - 38)) AS i FROM seq WHERE length(s) >= 40)),
hit AS (SELECT proteinID, i FROM win WHERE w IN (SELECT w FROM win GROUP BY w HAVING count(DISTINCT proteinID) > 1)),
mark AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY proteinID ORDER BY i) + 40 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY proteinID ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM mark),
span AS (SELECT proteinID, CAST(min(i) AS INTEGER) AS span_start, CAST(max(i) + 39 AS INTEGER) AS span_end FROM run GROUP BY proteinID, g)
"""
_BLOCKS6 = """
WITH item AS (
  SELECT DISTINCT trim(p.clusterID, ' ' || chr(9)) AS block, trim(d.domain, ' ' || chr(9)) AS item FROM proteins p JOIN domains d USING (proteinID)
  WHERE trim(p.clusterID, ' ' || chr(9)) NOT IN ('', 'NULL') AND trim(d.domain, ' ' || chr(9)) <> ''),
total AS (SELECT count(DISTINCT block) AS n FROM item),
one AS (SELECT item, count(*) AS m FROM item GROUP BY 1),
pair AS (
  SELECT k.a AS domain_a, k.b AS domain_b, k.k, x.m AS n_a, y.m AS n_b, n AS n_blocks
  FROM (SELECT a.item AS a, b.item AS b, count(*) AS k FROM item a JOIN item b ON a.block = b.block AND a.item < b.item GROUP BY ALL) k
  JOIN one x ON x.item = k.a JOIN one y ON y.item = k.b CROSS JOIN total)
"""

ORACLE = {
    "p2_found": _PAIRS2 + "SELECT a AS protein_a, b AS protein_b FROM pair",
    "p2_groups": _PAIRS2.replace("WITH", "WITH RECURSIVE", 1) + """,
cls AS (SELECT s, min(proteinID) AS class_id FROM seq WHERE length(s) >= 5 GROUP BY s),
own AS (SELECT proteinID, class_id FROM seq JOIN cls USING (s)),
link AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM pair JOIN own x ON x.proteinID = a JOIN own y ON y.proteinID = b WHERE x.class_id <> y.class_id),
side AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM side UNION SELECT r.a, s.b FROM reach r JOIN side s ON s.a = r.b),
root AS (SELECT a, least(a, min(b)) AS group_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS links FROM side GROUP BY a)
SELECT proteinID, class_id, coalesce(group_id, class_id) AS group_id, coalesce(links, 0) AS links FROM own LEFT JOIN root ON root.a = class_id LEFT JOIN degree ON degree.a = class_id""",
    "p3_found": _SHARED3 + "SELECT proteinID, span_start, span_end FROM span",
    "p3_shared_share": _SHARED3 + """
SELECT proteinID, max(length(s)) AS letters, CAST(coalesce(any_value(shared), 0) AS BIGINT) AS shared, round(CASE WHEN max(length(s)) > 0 THEN coalesce(any_value(shared), 0) / max(length(s)) ELSE 0.0 END, 6) AS share
FROM seq LEFT JOIN (SELECT proteinID, sum(span_end - span_start + 1) AS shared FROM span GROUP BY 1) USING (proteinID) GROUP BY proteinID""",
    "p8_invariants": "SELECT spec_id, capacity, (SELECT count(*) FROM documents) AS items, 0 AS over_capacity, 0 AS cut_needlessly, 0 AS tokens_astray FROM packspecs",
    "p6_found": _BLOCKS6 + "SELECT domain_a, domain_b FROM pair WHERE k >= 3 AND 200 * k >= n_blocks AND k * n_blocks >= 3 * n_a * n_b",
    "p6_pairs": _BLOCKS6 + "SELECT domain_a, domain_b, k, n_a, n_b, n_blocks, round(k * n_blocks / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift FROM pair WHERE k >= 3",
}
