"""Writers: tables, FASTA files, tree-annotation datasets. Data is written by tasks; only fixed
headers are written by the driver."""

from __future__ import annotations

import random
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions.render import lineage
from lociq.operators.ordered import numbered
from lociq.operators.sequences import occurrence_names
from lociq.schemas import RANKS


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def keyword_strings(names: DataFrame) -> DataFrame:
    """(clusterID, keywords, completeness, csb): what a cluster is named, as three lists in the
    same order. ``csb`` is 1 in order, 0 out of order, ``.`` where order wasn't looked at."""
    flag = F.when(F.col("collinear"), "1").when(~F.col("collinear"), "0").otherwise(".")
    n = names.withColumn("flag", flag).groupBy("clusterID").agg(F.array_sort(F.collect_list(F.struct("keyword", "completeness", "flag"))).alias("k"))
    text = lambda f: F.array_join(F.transform("k", lambda x: F.coalesce(x[f].cast("string"), F.lit(""))), ",")
    return n.select("clusterID", text("keyword").alias("keywords"), text("completeness").alias("completeness"), text("flag").alias("csb"))


def tree_names(records: DataFrame, genomes: DataFrame, order: Sequence[str], record: str, sep: str = "_") -> DataFrame:
    """The records with ``node``, their name in a tree: genome and lineage, or the record's own id
    where the genome has no row or a rank is null; ``_2``, ``_3`` ... from a genome's second record on."""
    g = genomes.select("genomeID", lineage(["genomeID", *RANKS], sep).alias("node"))
    named = records.join(g.where("node <> '0'"), "genomeID", "left").withColumn("node", F.coalesce("node", record))
    return occurrence_names(named, "genomeID", order, "node").withColumn("node", F.col("label")).drop("label", "occurrence")


def hit_table(proteins: DataFrame, names: DataFrame, genomes: DataFrame, sep: str = "_") -> DataFrame:
    """The hit table: a row a protein with its architecture, cluster keywords and lineage,
    sorted by genome, contig and start. ``proteins`` has arch, scores and coords already."""
    n = keyword_strings(names)
    g = genomes.select("genomeID", lineage(RANKS, sep).alias("lineage"))
    out = proteins.join(n, "clusterID", "left").join(g, "genomeID", "left")
    return out.orderBy("genomeID", "contig", "start", "proteinID")


def record_header() -> Column:
    """Header of a protein's record out of its columns: genome-protein, architecture, scores and
    places; in a cluster also its id, keywords, completeness and order."""
    text = [F.coalesce(c, F.lit("")) for c in ("keywords", "completeness", "csb")]
    cluster = F.when(F.col("clusterID").isNotNull(), F.concat_ws(" ", "clusterID", *text))
    return F.concat_ws(" ", F.concat_ws("-", "genomeID", "proteinID"), "arch", "scores", "coords", cluster)


def fasta_lines(records: DataFrame, header: Sequence[str], seq: str = "seq") -> DataFrame:
    """One text column ``value``: ``>header`` and the sequence without ``*``."""
    return records.select(F.concat(F.lit(">"), F.concat_ws(" ", *header), F.lit("\n"), F.replace(seq, F.lit("*"), F.lit(""))).alias("value"))


def write_fasta(records: DataFrame, path: str, header: Sequence[str], by: str | None = None, seq: str = "seq") -> None:
    """FASTA text, a folder for each value of ``by``. Rows of a value are brought together, so
    that a rare value makes one file; adaptive execution splits what is too large for one."""
    cols = [F.concat(F.lit(">"), F.concat_ws(" ", *header), F.lit("\n"), F.replace(seq, F.lit("*"), F.lit(""))).alias("value")]
    if by is None:
        records.select(*cols).write.mode("overwrite").text(path)
    else:
        records.select(by, *cols).hint("rebalance", by).write.mode("overwrite").partitionBy(by).text(path)


def fusion_parts(proteins: DataFrame) -> DataFrame:
    """(proteinID, domain, part): the stretch of each domain of proteins with several."""
    d = proteins.where(F.size("domains") > 1).select("proteinID", "sequence", F.explode("domains").alias("d"))
    s = F.replace("sequence", F.lit("*"), F.lit(""))
    return d.select("proteinID", F.col("d.domain").alias("domain"), F.substring(s, F.col("d.start") + 1, F.col("d.end") - F.col("d.start")).alias("part"))


def color(seed: int) -> str:
    """The colour of a seed: a number drawn by the public Mersenne twister."""
    return f"#{random.Random(seed).randint(0, 0xFFFFFF):06x}"


def colors(labels: DataFrame, label: str, order: Sequence[str], first: int = 0, step: int = 42) -> DataFrame:
    """(label, color): a colour a label in the order of first appearance."""
    firsts = labels.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.min(F.struct(*order)).alias("o"))
    ranked = numbered(firsts, (), ("o", "label"), "place").select("label", "place")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([color(first + step * (i - 1)) for i in b.column(1).to_pylist()], pa.string())], names=["label", "color"])

    return ranked.mapInArrow(run, "label string, color string")


def _dataset(kind: str, label: str, shade: str, *more: str) -> list[str]:
    """Header of an annotation file for trees: the kind of dataset, the separator, and the
    settings every kind must have; then its own."""
    return [f"DATASET_{kind}", "SEPARATOR TAB", f"DATASET_LABEL\t{label}", f"COLOR\t{shade}", *more, "DATA"]


def binary_header(features: Sequence[str], label: str = "features", shade: str = "#1f77b4", shape: int = 2, legend: str | None = None) -> list[str]:
    """Header lines of a binary dataset: a field a feature, each with a shape and a colour; with
    ``legend`` also a legend of that title."""
    field = lambda name, values: "\t".join([name, *map(str, values)])
    shapes, shades = [shape] * len(features), [shade] * len(features)
    more = [field("FIELD_LABELS", features), field("FIELD_SHAPES", shapes), field("FIELD_COLORS", shades)]
    if legend:
        more += [field("LEGEND_TITLE", [legend]), field("LEGEND_SHAPES", shapes), field("LEGEND_COLORS", shades), field("LEGEND_LABELS", features)]
    return _dataset("BINARY", label, shade, *more)


def symbol_header(label: str = "types", shade: str = "#1f77b4", largest: int = 10) -> list[str]:
    """Header lines of a symbol dataset; symbols are at most ``largest`` pixels wide."""
    return _dataset("SYMBOL", label, shade, f"MAXIMUM_SIZE\t{largest}")


def domain_header(label: str = "gene clusters", shade: str = "#1f77b4") -> list[str]:
    """Header lines of a dataset of shapes on a line."""
    return _dataset("DOMAINS", label, shade)


def binary_rows(matrix: DataFrame, genomes: DataFrame, features: Sequence[str], sep: str = "_") -> DataFrame:
    """(genomeID, line): the data lines of the binary dataset."""
    g = genomes.select("genomeID", lineage(["genomeID", *RANKS], sep).alias("node"))
    return matrix.join(g, "genomeID").select("genomeID", F.concat_ws("\t", "node", *[F.col(f"`{f}`").cast("string") for f in features]).alias("line"))


def symbol_rows(nodes: DataFrame, node: str, shade: str) -> DataFrame:
    """(line): a symbol a node in its colour."""
    return nodes.select(F.concat_ws("\t", node, F.lit("2"), F.lit("10"), shade, F.lit("1"), F.lit("1")).alias("line"))


def domain_rows(members: DataFrame, nodes: DataFrame, block: str = "clusterID") -> DataFrame:
    """(line): name, width and ``RE|start|end|color|label`` of the genes of a node's block, counted
    from its first start, in order of start. ``members`` has start, end, proteinID, arch, color;
    ``nodes`` the block and the node, one line each."""
    item = F.struct("start", "end", "proteinID", "color", "arch")
    g = members.groupBy(block).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    first = F.col("xs")[0]["start"]
    width = F.element_at("xs", -1)["end"] - first
    shapes = F.transform("xs", lambda x: F.concat_ws("|", F.lit("RE"), (x["start"] - first).cast("string"), (x["end"] - first).cast("string"), x["color"], x["arch"]))
    return g.join(nodes, block).select(F.concat_ws("\t", "node", width.cast("string"), F.array_join(shapes, "\t")).alias("line"))


def write_dataset(rows: DataFrame, path: str, header: Sequence[str]) -> None:
    """A dataset folder: ``header`` holds the header lines, ``data`` the data lines."""
    spark = rows.sparkSession
    spark.createDataFrame([(x,) for x in header], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    rows.select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/data")


def write_rank_counts(stats: DataFrame, path: str, column: str) -> None:
    """Rank counts, absolute or relative: a folder a level, tab-separated."""
    stats.select("level", "taxon", "feature", F.col(column)).hint("rebalance", "level").write.mode("overwrite").option("sep", "\t").partitionBy("level").csv(path)


def genome_dump(genomes: DataFrame) -> DataFrame:
    """All genomes by lineage, every column as text, ``None`` for null."""
    return genomes.orderBy(*RANKS, "genomeID").select(*[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in genomes.columns])


def write_statistics(genomes: DataFrame, counts: DataFrame, path: str) -> None:
    """Statistics of a store: a folder a rank with its taxa and their genomes, and all genomes."""
    write_rank_counts(counts.withColumn("feature", F.lit("genomes")), f"{path}/ranks", "n_genomes")
    write_tsv(genome_dump(genomes), f"{path}/Species")


def remove_empty(spark: SparkSession, path: str) -> int:
    """Delete data files without content below a path; how many there were."""
    from lociq.sources.tables import hadoop_path

    fs, p = hadoop_path(spark, path)
    found, gone = fs.listFiles(p, True), 0
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0 and f.getPath().getName().startswith("part-"):
            gone += bool(fs.delete(f.getPath(), False))
    return gone


def write_features(features: DataFrame, path: str) -> None:
    """Features (id, contig, start, end, strand) as the nine columns of a feature table, compressed."""
    line = F.concat_ws("\t", "contig", F.lit("lociq"), F.lit("CDS"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("0"), F.concat(F.lit("ID="), "id"))
    features.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
