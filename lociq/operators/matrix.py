"""Presence matrices, feature combinations, counts and ratios by rank."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.operators.ordered import numbered


def presence(genomes: DataFrame, found: DataFrame, features: Sequence[str]) -> DataFrame:
    """genomeID and one 0/1 column a feature; every genome has a row, features in given order.
    ``found`` is (genomeID, feature), repeats allowed."""
    cells = found.groupBy("genomeID").agg(*[F.max(F.when(F.col("feature") == f, 1).otherwise(0)).alias(f) for f in features])
    return genomes.select("genomeID").join(cells, "genomeID", "left").select("genomeID", *[F.coalesce(F.col(f"`{f}`"), F.lit(0)).alias(f) for f in features])


def combined(matrix: DataFrame, features: Sequence[str], most: int = 3, least: int = 2) -> DataFrame:
    """The matrix with a column ``a+b`` for each combination of features: 1 if all are there. A
    feature of that name stays as it is."""
    named = {"+".join(c): c for k in range(least, most + 1) for c in combinations(features, k)}
    wide = [F.least(*[F.col(f"`{f}`") for f in c]).alias(n) for n, c in named.items() if n not in matrix.columns]
    return matrix.select("*", *wide)


def combined_as(matrix: DataFrame, combos: Sequence[Sequence[str]]) -> DataFrame:
    """The same for combinations that are given, one list each."""
    return matrix.select("*", *[F.least(*[F.col(f"`{f}`") for f in c]).alias("+".join(c)) if len(c) > 1 else F.col(f"`{c[0]}`").alias(c[0] + "+") for c in combos])


def by_rank(genomes: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """(genomeID, level, taxon), a row a genome and rank."""
    return genomes.select("genomeID", F.explode(F.array(*[F.struct(F.lit(r).alias("level"), F.col(r).alias("taxon")) for r in ranks])).alias("x")).select("genomeID", "x.*")


def rank_counts(genomes: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """Genomes per level and taxon."""
    return by_rank(genomes, ranks).groupBy("level", "taxon").agg(F.count(F.lit(1)).alias("n_genomes"))


def rank_statistics(genomes: DataFrame, matrix: DataFrame, features: Sequence[str], ranks: Sequence[str]) -> DataFrame:
    """Per level, taxon and feature: sum, selected genomes, ratio (null without any). Every
    taxon of ``genomes`` comes out, also one of which the matrix has no genome."""
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("present")) for f in features])).alias("v")
    # The matrix is summed up per taxon before features are spread out.
    m = matrix.withColumn("in_", F.lit(1))
    wide = by_rank(genomes, ranks).join(m, "genomeID", "left").groupBy("level", "taxon").agg(F.coalesce(F.sum("in_"), F.lit(0)).alias("n_selected"), *[F.coalesce(F.sum(F.col(f"`{f}`")), F.lit(0)).alias(f) for f in features])
    long = wide.select("level", "taxon", "n_selected", values).select("level", "taxon", "n_selected", "v.*")
    return long.select("level", "taxon", "feature", F.col("present").alias("n_present"), "n_selected", F.try_divide("present", "n_selected").alias("ratio"))


def first_appearance(genomes: DataFrame, ranks: Sequence[str], level: str) -> DataFrame:
    """(taxon, place): taxa of a level by where they first come up when genomes are sorted by
    lineage. The first lineage of a taxon is found by an aggregate; only taxa are ranked."""
    first = genomes.groupBy(F.col(level).alias("taxon")).agg(F.min(F.struct(*ranks)).alias("first"))
    return numbered(first, (), ("first", "taxon")).select("taxon", "place")
