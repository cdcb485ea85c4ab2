"""From report files to stored tables, for all genomes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions import render
from lociq.operators import blocks, filters, overlap, patterns, sequences, store
from lociq.session import cut
from lociq.sources import readers


def build(spark: SparkSession, reports: str, features: str, proteins: str, thresholds: str, dictionary: str, cutoff: str = "optimized", distance: int = 3500, least: float = 0.5, complete: bool = True, most_evalue: float | None = None, taxonomy: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five stored tables out of search reports, gene coordinates and sequences in three
    folders, a file a genome in each; ``tables.write`` lays them out.

    Hits above the cutoff are resolved per protein, proteins are placed by their features,
    blocks are found and named; with ``complete``, hits below the cutoff that a named block
    lacks join it with the score of their best part, and blocks are found and named again.
    ``most_evalue`` leaves out weaker hits of reports that weren't made with such a limit.
    ``taxonomy`` (genomeID, ranks ...) fills the genomes' rows. Reports and features are parsed
    once; what later steps share is kept in the shared folder.
    """
    hits = readers.hmmer_report(spark, reports).withColumn("genomeID", render.genome_of("file"))
    hits = hits if most_evalue is None else readers.significant(hits, most_evalue)
    best = overlap.best_report(hits, ["genomeID", "report_ord", "query", "hit_ord", "hit_id", "hit_score"], "hsp_score", "hsp_ord")
    cuts = readers.threshold_table(spark, thresholds).select("hmm", F.col(cutoff).alias("cutoff"))
    raw = cut(best.select(
        F.concat_ws("-", "genomeID", "hit_id").alias("proteinID"), "genomeID", F.col("query").alias("domain"), F.col("hit_score").alias("score"), F.col("hsp_score").alias("part_score"),
        F.col("hsp_start").alias("domStart"), F.col("hsp_end").alias("domEnd"), F.struct("report_ord", "hit_ord").alias("ID"),
    ))
    place = readers.gff(spark, features).select(F.concat_ws("-", render.genome_of("file"), "id").alias("proteinID"), "contig", "start", "end", "strand", "locustag").dropDuplicates(["proteinID"])
    place = cut(place.join(raw.select("proteinID").distinct(), "proteinID", "left_semi"))
    words = readers.pattern_table(spark, dictionary)
    strong = overlap.above_cutoff(raw, cuts)
    named = _name(overlap.overlap_fold(strong, "proteinID", "ID"), place, words, distance, least)
    if complete:
        below = overlap.below_cutoff(raw, cuts)
        weak = below.select("proteinID", "genomeID", F.col("domain").alias("token")).distinct().join(place, "proteinID")
        extent = named["members"].groupBy("block").agg(F.min("genomeID").alias("genomeID"), F.min("contig").alias("contig"), F.min("start").alias("block_start"), F.max("end").alias("block_end"))
        missing = patterns.missing_members(named["names"], named["tokens"], words, "block")
        found = patterns.rescue(missing, extent, weak, "block", distance).select("proteinID", F.col("token").alias("domain")).distinct()
        added = below.join(found, ["proteinID", "domain"], "left_semi").withColumn("score", F.col("part_score"))
        named = _name(store.extend_domains(strong, added.select(*strong.columns)), place, words, distance, least)
    kept, members = named["folded"], named["members"]
    seq = readers.fasta(spark, proteins).select(F.concat_ws("-", render.genome_of("file"), "id").alias("proteinID"), F.col("seq").alias("sequence"), "ord")
    seq = sequences.merge_first(seq.join(kept.select("proteinID"), "proteinID", "left_semi"), ["ord"], "proteinID").drop("ord")
    p = kept.select("proteinID", F.substring_index("proteinID", "-", 1).alias("genomeID"), F.size("domains").alias("dom_count")).join(place, "proteinID", "left").join(seq, "proteinID", "left")
    p = p.join(members.select("proteinID", F.col("block").alias("clusterID")), "proteinID", "left")
    d = kept.select("proteinID", F.explode("domains").alias("x")).select("proteinID", F.col("x.domain").alias("domain"), F.col("x.score").alias("score"), F.col("x.start").alias("domStart"), F.col("x.end").alias("domEnd"))
    # Every genome with a file of sequences has a row, hits or not.
    genomes = readers.files(spark, proteins).select(F.col("stem").alias("genomeID")).distinct()
    genomes = genomes if taxonomy is None else genomes.join(taxonomy, "genomeID", "left")
    return {
        "genomes": genomes, "proteins": p, "domains": d, "clusters": members.select(F.col("block").alias("clusterID"), "genomeID").distinct(),
        "keywords": named["names"].withColumnRenamed("block", "clusterID").withColumnRenamed("collinear", "collinearity"),
    }


def _name(folded: DataFrame, place: DataFrame, words: DataFrame, distance: int, least: float) -> dict[str, DataFrame]:
    folded = cut(folded)
    genes = folded.select("proteinID", F.substring_index("proteinID", "-", 1).alias("genomeID")).join(place, "proteinID").where("contig <> '' AND start IS NOT NULL AND end IS NOT NULL")
    members = cut(blocks.gap_blocks(genes.select("genomeID", "contig", "proteinID", "start", "end"), distance))
    return {"folded": folded, "members": members, **_keywords(members, folded, words, least)}


def _keywords(members: DataFrame, folded: DataFrame, words: DataFrame, least: float) -> dict[str, DataFrame]:
    tokens = cut(patterns.token_rows(members, folded.select("proteinID", render.token(render.architecture("domains")).alias("token")), "block"))
    return {"tokens": tokens, "names": cut(patterns.named(patterns.pattern_matches(tokens, words, "block", least), "block"))}


def renamed(tables: dict[str, DataFrame], words: DataFrame, distance: int | None = 3500, least: float = 0.5) -> dict[str, DataFrame]:
    """Stored tables after blocks were found and named again from what is stored; with no
    ``distance`` the stored blocks stay and only their names are given again."""
    p = tables["proteins"].where("contig <> '' AND start IS NOT NULL AND end IS NOT NULL")
    folded = cut(overlap.overlap_fold(tables["domains"], "proteinID", "ID"))
    if distance is None:
        members = cut(p.where("clusterID IS NOT NULL").select("genomeID", "contig", "proteinID", "start", "end", F.col("clusterID").alias("block")))
    else:
        members = cut(blocks.gap_blocks(p.select("genomeID", "contig", "proteinID", "start", "end"), distance))
    names = _keywords(members, folded, words, least)["names"].withColumnRenamed("block", "clusterID").withColumnRenamed("collinear", "collinearity")
    names = names.withColumn("ID", F.xxhash64("clusterID", "keyword"))
    all_ = tables["genomes"].select("genomeID").unionByName(tables["proteins"].select("genomeID"))
    return {**tables, **store.rewrite_clusters(tables, all_, members.select("proteinID", "genomeID", F.col("block").alias("clusterID")), names)}


def sequence_set(spark: SparkSession, action: str, files: list[str], limits: tuple[int, int] = (0, 1 << 31)) -> tuple[list[str], DataFrame]:
    """(header columns, records) of an action on sequence files, in the order given: ``merge``
    (first record of an id), ``filter`` (length strictly between the limits), ``singletons`` and
    ``duplicates`` (one or several records of a genome in a file), ``concat`` and ``concat-gaps``
    (all records of a genome over all files joined)."""
    known = None
    for i, f in enumerate(files):
        r = readers.fasta(spark, f).withColumn("file", F.lit(str(i))).withColumn("genome", F.substring_index("id", "-", 1))
        known = r if known is None else known.unionByName(r)
    if action == "merge":
        return ["description"], sequences.merge_first(known, [F.col("file").cast("int"), "ord"])
    if action == "filter":
        return ["description"], known.where(filters.length_between("seq", *limits))
    if action in ("singletons", "duplicates"):
        n = sequences.split_members(known, ["file", "genome"])
        return ["description"], n.where("members = 1" if action == "singletons" else "members > 1")
    joined = sequences.concatenated(known, [str(i) for i in range(len(files))], gaps=action == "concat-gaps")
    return ["genome"], joined.withColumnRenamed("sequence", "seq")
