"""Readers of the text inputs. All are DataFrame plans over text files: compressed files are
read as they are, nothing is parsed on the driver, and columns that aren't asked for cost nothing.

Every line keeps its file and its place (``ord``), since the first or the last line of an id
counts in some inputs. The place is the line's rank by Spark's own partition and offset order,
so it says which line comes first and not how many lie between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociq.functions.render import genome_of
from lociq.schemas import RANKS


def _rest(items: Column | str) -> Column:
    """All items but the first."""
    return F.slice(items, 2, F.size(items))


def _numbered() -> Column:
    """1, 2, 3 ... in file order, for dictionaries: files of a few hundred lines, written by hand."""
    return F.row_number().over(Window.orderBy("ord"))


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, stem, size) of the files below a folder, without reading them."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", F.col("length").alias("size"))
    name = F.substring_index("path", "/", -1)
    return f.select("path", name.alias("name"), genome_of(name).alias("stem"), "size")


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of ``left`` without a file of the same stem in ``right``."""
    return left.join(right.select("stem"), "stem", "left_anti")


def queue(proteins: DataFrame, features: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(stem, faa, gff): paired input files; genomes in ``done`` (genomeID) are left out."""
    q = proteins.select("stem", F.col("path").alias("faa")).join(features.select("stem", F.col("path").alias("gff")), "stem")
    return q if done is None else q.join(done.select(F.col("genomeID").alias("stem")), "stem", "left_anti")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ord, value): the lines of text files, ``\\r`` at the end removed."""
    t = spark.read.option("recursiveFileLookup", True).text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", r"\r$", "").alias("value"))


def _records(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    t = spark.read.option("recursiveFileLookup", True).option("lineSep", sep).text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), "value")


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ord, id, description, seq): records of FASTA files; the id runs to the first
    blank. Records are split at ``>`` at a line's start, so a file is split between tasks."""
    r = _records(spark, path, "\n>")
    text = F.regexp_replace(F.regexp_replace("value", r"\r", ""), r"^>", "")
    head, body = F.substring_index(text, "\n", 1), F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + F.lit(1), F.length(text))).otherwise("")
    out = r.where(F.length(F.trim(text)) > 0).select("file", "ord", F.trim(head).alias("description"), F.regexp_replace(body, r"\s", "").alias("seq"))
    return out.select("file", "ord", F.regexp_extract("description", r"^(\S*)", 1).alias("id"), "description", "seq")


def attribute(attributes: Column | str, tag: str) -> Column:
    """Value of a tag in the ninth column of a feature table (``tag=value;tag=value``): the text
    behind the first ``=`` of the first part with that tag, null without one."""
    parts = F.transform(F.split(attributes, ";"), lambda x: F.trim(x))
    found = F.get(F.filter(parts, lambda x: F.substring_index(x, "=", 1) == tag), F.lit(0))
    return F.when(F.instr(found, "=") > 0, F.substring(found, len(tag) + 2, F.length(found)))


def gff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, id, contig, start, end, strand, locustag): one row an id and file, its last line.
    Ids that name a coding sequence (``cds-...``) go by what they name."""
    c = F.split("value", "\t")
    at = lambda i: F.try_element_at(c, F.lit(i))
    v = lines(spark, path).where(~F.col("value").startswith("#"))
    rows = v.select(
        "file", "ord", F.regexp_replace(attribute(at(9), "ID"), "^cds-", "").alias("id"), at(1).alias("contig"), at(4).try_cast("int").alias("start"), at(5).try_cast("int").alias("end"),
        at(7).alias("strand"), F.coalesce(attribute(at(9), "locus_tag"), F.lit("")).alias("locustag"),
    ).where("id <> ''")
    last = F.max_by(F.struct("contig", "start", "end", "strand", "locustag"), "ord").alias("x")
    return rows.groupBy("file", "id").agg(last).select("file", "id", "x.*")


def prodigal_features(records: DataFrame) -> DataFrame:
    """Features out of headers ``id # start # end # strand # attributes``: (id, contig, start,
    end, strand); the contig is the id without its last number. Other headers are left out."""
    p = F.transform(F.split("description", "#"), lambda x: F.trim(x))
    r = records.where(F.size(p) == 5).select(p.alias("p"))
    return r.select(F.col("p")[0].alias("id"), F.regexp_replace(F.col("p")[0], r"_\d+\s*$", "").alias("contig"), F.col("p")[1].try_cast("int").alias("start"), F.col("p")[2].try_cast("int").alias("end"), F.when(F.col("p")[3] == "1", "+").otherwise("-").alias("strand"))


def hmmer_report(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Hits of profile-search text reports, in the columns of ``schemas.HITS`` and the file.

    Reports are split at ``Query:`` and hits at ``>>``, so one record is one query's section;
    the table of complete sequences gives score, bias and E-value, the table of domains the
    parts (score, and from/to of the alignment on the sequence, start counted from 0).
    """
    r = _records(spark, path, "\nQuery:")
    q = r.where(F.col("value").contains(">>")).select("file", F.col("ord").alias("report_ord"), F.regexp_extract("value", r"^\s*(\S+)", 1).alias("query"), "value")
    number = r"([-+0-9.eE]+)"
    top = q.select("file", "report_ord", "query", F.posexplode(F.split(F.substring_index("value", "\n>>", 1), "\n")).alias("hit_ord", "row"))
    score = rf"^\s*{number}\s+{number}\s+{number}\s+{number}\s+{number}\s+{number}\s+{number}\s+\d+\s+(\S+)"
    hits = top.where(F.col("row").rlike(score)).select(
        "file", "report_ord", "query", "hit_ord", F.regexp_extract("row", score, 8).alias("hit_id"), F.regexp_extract("row", score, 1).try_cast("double").alias("evalue"),
        F.regexp_extract("row", score, 2).try_cast("double").alias("hit_score"), F.regexp_extract("row", score, 3).try_cast("double").alias("bias"),
    )
    part = q.select("file", "report_ord", F.explode(_rest(F.split("value", "\n>>"))).alias("section"))
    row = part.select("file", "report_ord", F.regexp_extract("section", r"^\s*(\S+)", 1).alias("hit_id"), F.explode(F.split("section", "\n")).alias("row"))
    domain = rf"^\s*(\d+)\s+[!?]\s+{number}\s+{number}\s+{number}\s+{number}\s+(\d+)\s+(\d+)\s+\S+\s+(\d+)\s+(\d+)"
    hsps = row.where(F.col("row").rlike(domain)).select(
        "file", "report_ord", "hit_id", F.regexp_extract("row", domain, 1).cast("bigint").alias("hsp_ord"), F.regexp_extract("row", domain, 2).try_cast("double").alias("hsp_score"),
        (F.regexp_extract("row", domain, 8).cast("int") - 1).alias("hsp_start"), F.regexp_extract("row", domain, 9).cast("int").alias("hsp_end"),
    )
    return hits.join(hsps, ["file", "report_ord", "hit_id"]).select("file", "report_ord", "query", "hit_ord", "hit_id", "hit_score", "bias", "evalue", "hsp_ord", "hsp_score", "hsp_start", "hsp_end")


def significant(hits: DataFrame, most: float = 1e-4) -> DataFrame:
    """Hits up to an E-value."""
    return hits.where(F.col("evalue") <= most)


def models(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, name, length, alphabet, sequences) of profile model files: their headers only."""
    v = lines(spark, path).where(F.col("value").rlike(r"^(NAME|LENG|ALPH|NSEQ)\s"))
    field = lambda k: F.max(F.when(F.col("value").startswith(k), F.regexp_extract("value", r"^\S+\s+(\S+)", 1)))
    return v.groupBy("file").agg(field("NAME").alias("name"), field("LENG").cast("int").alias("length"), field("ALPH").alias("alphabet"), field("NSEQ").cast("int").alias("sequences"))


def threshold_table(spark: SparkSession, path: str) -> DataFrame:
    """(hmm, optimized, trusted, noise) of a tab-separated table; lines whose numbers can't be
    read are left out."""
    c = F.split("value", "\t")
    t = spark.read.text(path).select(F.trim(c[0]).alias("hmm"), *[F.try_element_at(c, F.lit(i + 2)).try_cast("double").alias(n) for i, n in enumerate(("optimized", "trusted", "noise"))])
    return t.where("optimized IS NOT NULL")


def pattern_table(spark: SparkSession, path: str) -> DataFrame:
    """(pattern_id, keyword, genes): a pattern a line; blanks are removed, empty lines skipped.
    Ids follow the order of the file."""
    v = lines(spark, path).select("ord", F.filter(F.split(F.replace("value", F.lit(" "), F.lit("")), "\t"), lambda x: x != "").alias("p")).where(F.size("p") > 1)
    return v.select(_numbered().alias("pattern_id"), F.col("p")[0].alias("keyword"), _rest("p").alias("genes"))


def combination_table(spark: SparkSession, path: str) -> DataFrame:
    """(combo_id, features): a tab-separated combination a line."""
    v = lines(spark, path).select("ord", F.filter(F.transform(F.split("value", "\t"), lambda x: F.trim(x)), lambda x: x != "").alias("features"))
    return v.where(F.size("features") > 0).select(_numbered().alias("combo_id"), "features")


def gtdb_lineage(taxonomy: Column | str) -> list[Column]:
    """The eight ranks of a taxonomy text like ``d__X;p__Y;...``: prefixes of three letters
    fall off; the clade, which such texts lack, is empty."""
    part = F.transform(F.split(taxonomy, ";"), lambda x: F.substring(x, F.lit(4), F.length(x)))
    at = lambda i: F.coalesce(F.try_element_at(part, F.lit(i)), F.lit(""))
    return [at(1).alias("Superkingdom"), F.lit("").alias("Clade"), *[at(i + 2).alias(r) for i, r in enumerate(RANKS[2:])]]


def gtdb_metadata(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Taxonomy rows of a metadata table with a header; only the columns named here are read.
    ``wanted`` (genomeID) limits them."""
    t = spark.read.option("header", True).option("sep", "\t").csv(path)
    out = t.select(
        genome_of("accession").alias("genomeID"), *gtdb_lineage("gtdb_taxonomy"), F.col("ncbi_strain_identifiers").alias("Strain"),
        F.when(F.col("gtdb_type_designation") == "type strain of species", 1).otherwise(0).alias("TypeStrain"), F.col("checkm_completeness").try_cast("double").alias("Completeness"),
        F.col("checkm_contamination").try_cast("double").alias("Contamination"), F.col("ncbi_taxid").try_cast("int").alias("NCBITaxon"), F.col("ncbi_bioproject").alias("NCBIBioproject"),
        F.col("ncbi_biosample").alias("NCBIBiosample"), F.col("ncbi_genbank_assembly_accession").alias("NCBIAssembly"),
    )
    return out if wanted is None else out.join(wanted.select("genomeID"), "genomeID", "left_semi")


def custom_metadata(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """The same of a table with the columns genomeID, the ranks in small letters, strain, taxid,
    biosample, bioproject, genbank, refseq, completeness, contamination, typestrain; a type
    strain is one whose last column isn't empty."""
    t = spark.read.option("header", True).option("sep", "\t").csv(path)
    names = ("superkingdom", "clade", "phylum", "class", "order", "family", "genus", "species")
    out = t.select(
        genome_of("genomeID").alias("genomeID"), *[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(r) for n, r in zip(names, RANKS, strict=True)], F.col("strain").alias("Strain"),
        F.when(F.length(F.trim("typestrain")) > 0, 1).otherwise(0).alias("TypeStrain"), F.col("completeness").try_cast("double").alias("Completeness"), F.col("contamination").try_cast("double").alias("Contamination"),
        F.col("taxid").try_cast("int").alias("NCBITaxon"), F.col("bioproject").alias("NCBIBioproject"), F.col("biosample").alias("NCBIBiosample"), F.col("genbank").alias("NCBIAssembly"),
    )
    return out if wanted is None else out.join(wanted.select("genomeID"), "genomeID", "left_semi")


def assembly_reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(genomeID, taxid, biosample, bioproject, genbank, refseq) scraped from report texts."""
    v = lines(spark, path).where(F.col("value").startswith("#"))
    field = lambda p: F.max(F.nullif(F.regexp_extract("value", p, 1), F.lit("")))
    return v.groupBy(genome_of("file").alias("genomeID")).agg(
        field(r"(?i)taxid:\s*(\d+)").cast("int").alias("taxid"), field(r"(?i)biosample:\s*(\S+)").alias("biosample"), field(r"(?i)bioproject:\s*(\S+)").alias("bioproject"),
        field(r"(?i)genbank assembly accession:\s*(\S+)").alias("genbank"), field(r"(?i)refseq assembly accession:\s*(\S+)").alias("refseq"),
    )


def assembly_summary(spark: SparkSession, path: str) -> DataFrame:
    """(genomeID, accession, taxid) of a summary table with a header."""
    t = spark.read.option("header", True).option("sep", "\t").csv(path)
    return t.select(genome_of("Assembly Accession").alias("genomeID"), F.col("Assembly Accession").alias("accession"), F.col("Taxonomy id").try_cast("int").alias("taxid"))


def lineages(nodes: DataFrame, names: DataFrame, wanted: DataFrame, top: str = "superkingdom", depth: int = 64) -> DataFrame:
    """(taxid, rank, name): ancestors of the wanted taxa up to rank ``top``, themselves included.
    A walk of more than ``depth`` steps goes in a circle: an error is raised.

    ``nodes`` (taxid, parent, rank), ``names`` (taxid, name), ``wanted`` (taxid). All walks go
    up one level a pass; a pass joins only what hasn't arrived.
    """
    from lociq.session import cut

    n = nodes.select(F.col("taxid").alias("at"), "parent", "rank")
    front = wanted.select("taxid").distinct().select("taxid", F.col("taxid").alias("at"))
    seen = None
    for _ in range(depth):
        step = cut(front.join(n, "at").select("taxid", "at", "parent", "rank"))
        here = step.select("taxid", "at", "rank")
        seen = here if seen is None else seen.unionByName(here)
        front = step.where((F.col("rank") != top) & (F.col("parent") != F.col("at"))).select("taxid", F.col("parent").alias("at"))
        if front.isEmpty():
            break
    else:
        raise ValueError(f"a lineage of more than {depth} steps")
    return seen.join(names.select(F.col("taxid").alias("at"), "name"), "at").select("taxid", "rank", "name")


def by_rank(lineage: DataFrame, ranks: tuple[str, ...] = ("superkingdom", "clade", "phylum", "class", "order", "family", "genus", "species")) -> DataFrame:
    """The lineages as one row a taxon with a column a rank."""
    return lineage.groupBy("taxid").pivot("rank", list(ranks)).agg(F.max("name"))


def processed(spark: SparkSession, path: str) -> DataFrame:
    """(genomeID) of a progress log: its first column."""
    return spark.read.option("sep", "\t").csv(path).select(F.trim("_c0").alias("genomeID")).where("genomeID <> ''").distinct()
