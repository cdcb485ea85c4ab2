"""Changes to the stored tables, as tables in and tables out. No table is changed in place:
a caller writes what comes back, one genome partition at a time if it likes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.operators import overlap


def insert_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows and those of ``new`` whose key isn't stored yet; of repeated new keys one."""
    fresh = new.join(stored.select(key), key, "left_anti").dropDuplicates([key])
    return stored.unionByName(fresh, allowMissingColumns=True)


def update(stored: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Stored rows with ``columns`` taken from ``new`` where it has a value."""
    n = new.groupBy(key).agg(*[F.max(c).alias(f"_{c}") for c in columns])
    out = stored.join(n, key, "left")
    return out.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


def extend_domains(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Domains of proteins after new hits are added behind the stored ones and overlaps are
    resolved again: (proteinID, domains)."""
    both = stored.withColumn("_o", F.struct(F.lit(0).alias("src"), F.col("ID"))).unionByName(new.withColumn("_o", F.struct(F.lit(1).alias("src"), F.col("ID"))))
    return overlap.overlap_fold(both, "proteinID", "_o")


def replace_for(stored: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows of changed keys give way to the new ones; all others stay."""
    return stored.join(changed.select(key), key, "left_anti").unionByName(new)


def rewrite_clusters(tables: dict[str, DataFrame], changed: DataFrame, members: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """Proteins, clusters and keywords after the blocks of the ``changed`` genomes (genomeID) were
    found anew: ``members`` (proteinID, genomeID, clusterID), ``names`` (clusterID, keyword,
    completeness, collinearity). A protein of these genomes in no new block has no cluster."""
    of = changed.select("genomeID").distinct()
    new = members.select("proteinID", F.col("clusterID").alias("_new"))
    marked = tables["proteins"].join(of.withColumn("_in", F.lit(True)), "genomeID", "left").join(new, "proteinID", "left")
    proteins = marked.withColumn("clusterID", F.when(F.col("_in"), F.col("_new")).otherwise(F.col("clusterID"))).select(*tables["proteins"].columns)
    old = tables["clusters"].join(of, "genomeID", "left_semi").select("clusterID")
    clusters = without(tables["clusters"], of, "genomeID").unionByName(members.select("clusterID", "genomeID").distinct(), allowMissingColumns=True)
    keywords = without(tables["keywords"], old, "clusterID").unionByName(names, allowMissingColumns=True)
    return {"proteins": proteins, "clusters": clusters.select(*tables["clusters"].columns), "keywords": keywords.select(*tables["keywords"].columns)}


def rename_where(rows: DataFrame, column: str, old: str, new: str, only: DataFrame, key: str) -> DataFrame:
    """``column`` renamed from old to new in the rows whose key is in ``only``."""
    marked = rows.join(only.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    cond: Column = F.col("_in") & (F.col(column) == old)
    return marked.withColumn(column, F.when(cond, F.lit(new)).otherwise(F.col(column))).drop("_in").select(*rows.columns)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``gone``: deleting, and its cascade, table by table."""
    return rows.join(gone.select(key), key, "left_anti")


def delete_genomes(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The five tables without the genomes in ``gone`` and what hangs on them."""
    proteins = tables["proteins"].join(gone.select("genomeID"), "genomeID", "left_semi")
    clusters = tables["clusters"].join(gone.select("genomeID"), "genomeID", "left_semi")
    return {
        "genomes": without(tables["genomes"], gone, "genomeID"), "proteins": without(tables["proteins"], gone, "genomeID"), "clusters": without(tables["clusters"], gone, "genomeID"),
        "domains": without(tables["domains"], proteins, "proteinID"), "keywords": without(tables["keywords"], clusters, "clusterID"),
    }


def delete_proteins(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Proteins and domains without the proteins in ``gone``."""
    return {"proteins": without(tables["proteins"], gone, "proteinID"), "domains": without(tables["domains"], gone, "proteinID")}
