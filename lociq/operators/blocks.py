"""Gap-bounded blocks of neighbouring genes, and positions within them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("start", "end", "proteinID")


def gap_blocks(genes: DataFrame, distance: int = 3500, drop_trailing: bool = False) -> DataFrame:
    """Genes that lie in a block of at least two: genomeID, contig, proteinID, start, end and
    block (clusterID ``genome_n``, n from 1 over the blocks of the genome by contig, start).

    A gene joins its predecessor's block if it starts at most ``distance`` after the
    predecessor's end (the predecessor's alone, not the furthest so far). ``drop_trailing``
    leaves out what lies in the last run of each genome.

    Windows run over a contig, never a whole genome; block numbers come from the block counts
    of the contigs, one small row each.
    """
    # One sort serves all: a gene is in a block if it joins its predecessor or its successor
    # joins it, and a block begins where only the latter holds.
    w = Window.partitionBy("genomeID", "contig").orderBy(*ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = genes.withColumn("joins", F.coalesce(F.col("start") - F.lag("end").over(w) <= distance, F.lit(False)))
    run = run.withColumn("joined", F.coalesce(F.lead("joins").over(w), F.lit(False)))
    run = run.withColumn("nth", F.sum((~F.col("joins") & F.col("joined")).cast("int")).over(upto))
    kept = run.where(F.col("joins") | F.col("joined"))
    if drop_trailing:
        # The last run of a genome is the one that holds its last gene.
        last = run.groupBy("genomeID").agg(F.max(F.struct("contig", *ORDER, "joins", "nth")).alias("l"))
        last = last.where("l.joins").select("genomeID", F.col("l.contig").alias("contig"), F.col("l.nth").alias("nth"))
        kept = kept.join(last, ["genomeID", "contig", "nth"], "left_anti")
    per = kept.groupBy("genomeID", "contig").agg(F.max("nth").alias("blocks"))
    before = F.coalesce(F.sum("blocks").over(Window.partitionBy("genomeID").orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("genomeID", "contig", before.alias("offset"))
    out = kept.join(per, ["genomeID", "contig"])
    return out.select("genomeID", "contig", "proteinID", "start", "end", F.concat_ws("_", "genomeID", (F.col("offset") + F.col("nth")).cast("string")).alias("block"))


def extents(members: DataFrame, block: str = "block") -> DataFrame:
    """Least start, greatest end and number of genes of each block."""
    return members.groupBy(block).agg(F.min("start").alias("block_start"), F.max("end").alias("block_end"), F.count(F.lit(1)).alias("genes"))


def relative_index(members: DataFrame, anchors: DataFrame, block: str = "clusterID") -> DataFrame:
    """The neighbourhood of each anchor (proteinID): all genes of its block with their place
    relative to it (..., -1, 0, 1, ...) by start."""
    place = members.withColumn("place", F.row_number().over(Window.partitionBy(block).orderBy(*ORDER)))
    a = place.join(anchors.select("proteinID").distinct(), "proteinID", "left_semi").select(block, F.col("proteinID").alias("anchor"), F.col("place").alias("anchor_place"))
    return a.join(place, block).select("anchor", "proteinID", (F.col("place") - F.col("anchor_place")).alias("relative"))


def relative_coordinates(members: DataFrame, block: str = "clusterID") -> DataFrame:
    """Start and end of each gene counted from the block's first start, and the block's width
    (the last gene's end, in order of start, less the first start)."""
    w = Window.partitionBy(block)
    last = F.last("end").over(w.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.min("start").over(w)
    return members.select(block, "proteinID", (F.col("start") - first).alias("rel_start"), (F.col("end") - first).alias("rel_end"), (last - first).alias("width"))
