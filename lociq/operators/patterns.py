"""Naming of blocks by fuzzy, order-aware matching against a pattern dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_rows(members: DataFrame, tokens: DataFrame, block: str) -> DataFrame:
    """(block, tokens ARRAY): the tokens of a block's genes in order of start."""
    rows = members.join(tokens, "proteinID").where("token IS NOT NULL")
    item = F.struct("start", "end", "proteinID", "token")
    return rows.groupBy(block).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["token"]).alias("tokens"))


def completeness(genes: Column | str, tokens: Column | str) -> Column:
    """Share of a pattern's distinct genes that the block has."""
    return F.size(F.array_intersect(genes, tokens)) / F.size(F.array_distinct(genes))


def collinear(genes: Column | str, tokens: Column | str) -> Column:
    """Whether the pattern's genes that are present come in its order or in reverse, by their
    first places in the block; one gene or none is in order."""
    places = F.transform(F.filter(genes, lambda g: F.array_contains(tokens, g)), lambda g: F.array_position(tokens, g))
    up = F.array_sort(places)
    return (places == up) | (places == F.reverse(up))


def candidates(blocks: DataFrame, patterns: DataFrame, block: str) -> DataFrame:
    """(block, tokens, pattern_id, keyword, genes): blocks with patterns they share a gene with.

    Blocks and patterns meet on genes (an equi-join with the dictionary), so a block is never
    held against patterns it has nothing of.
    """
    p = patterns.select("pattern_id", F.explode(F.array_distinct("genes")).alias("token"))
    met = blocks.select(block, F.explode(F.array_distinct("tokens")).alias("token")).join(F.broadcast(p), "token").select(block, "pattern_id").distinct()
    return met.join(blocks, block).join(F.broadcast(patterns), "pattern_id")


def pattern_matches(blocks: DataFrame, patterns: DataFrame, block: str, least: float = 0.5, check_order: bool = True) -> DataFrame:
    """(block, pattern_id, keyword, completeness, collinear) above the floor, strictly."""
    c = candidates(blocks, patterns, block)
    order = collinear("genes", "tokens") if check_order else F.lit(None).cast("boolean")
    return c.select(block, "pattern_id", "keyword", completeness("genes", "tokens").alias("completeness"), order.alias("collinear")).where(F.col("completeness") > least)


def named(matches: DataFrame, block: str) -> DataFrame:
    """(block, keyword, completeness, collinear): of patterns with one name the last in the
    dictionary counts, complete or not."""
    best = F.max_by(F.struct("completeness", "collinear"), "pattern_id").alias("m")
    return matches.groupBy(block, "keyword").agg(best).select(block, "keyword", "m.completeness", "m.collinear")


def missing_members(names: DataFrame, blocks: DataFrame, patterns: DataFrame, block: str) -> DataFrame:
    """(block, token): genes that an incompletely matched keyword lacks, over all of the
    patterns with that keyword."""
    short = names.where("completeness < 1").select(block, "keyword").join(F.broadcast(patterns.select("keyword", "genes")), "keyword").join(blocks, block)
    return short.select(block, F.explode(F.array_except("genes", "tokens")).alias("token")).distinct()


def rescue(missing: DataFrame, extent: DataFrame, weak: DataFrame, block: str, distance: int = 3500) -> DataFrame:
    """(block, proteinID, token): weak hits whose token a block lacks and whose start or end
    lies strictly inside the block's extent widened by ``distance``, on the same contig.

    ``missing`` (block, token), ``extent`` (block, genomeID, contig, block_start, block_end),
    ``weak`` (genomeID, contig, proteinID, token, start, end). The join is on genome, contig
    and token; the band is what is left of it.
    """
    want = missing.join(extent, block)
    lo, hi = F.col("block_start") - distance, F.col("block_end") + distance
    inside = lambda c: (F.col(c) > lo) & (F.col(c) < hi)
    return want.join(weak, ["genomeID", "contig", "token"]).where(inside("start") | inside("end")).select(block, "proteinID", "token").distinct()
