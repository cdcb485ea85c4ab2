"""The stored tables as the operators want them: keys trimmed, rows unique, ends in order.

Tables that came from elsewhere may repeat rows under one key. Repeats agree once keys, texts and
ends are normalised, so rows are normalised, cut to the columns asked for and made distinct.
Grouping by whole rows combines before the shuffle, needs no sort, and lets every predicate of
a query through to the scan. A folder that ``store.write`` has made holds normalised, unique
rows already: it is read as it is, and predicates reach the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions.keys import clean_sequence, first_dot, present, trim_key
from lociq.schemas import RANKS
from lociq.sources.tables import is_store, table

_OWN = ("Strain", "TypeStrain", "Completeness", "Contamination", "NCBITaxon", "NCBIBioproject", "NCBIBiosample", "NCBIAssembly")


def _read(spark: SparkSession, d: str, name: str, key: str, columns: dict[str, Column], wanted: Sequence[str], where: Column | None = None) -> DataFrame:
    names = [key, *[c for c in wanted if c != key]] if wanted else list(columns)
    t = table(spark, d, name)
    if is_store(spark, d):
        return t.select(*names)
    t = t if where is None else t.where(where)
    return t.select(*[columns[c].alias(c) for c in names]).distinct()


def proteins(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """One row per proteinID, with the columns asked for (all if none are); no cluster is null."""
    cluster = F.when(present(trim_key("clusterID")), trim_key("clusterID"))
    columns = {
        "proteinID": F.col("proteinID"), "genomeID": trim_key("genomeID"), "clusterID": cluster, "locustag": F.nullif("locustag", F.lit("")), "contig": F.nullif(trim_key("contig"), F.lit("")),
        "start": F.least("start", "end"), "end": F.greatest("start", "end"), "strand": F.nullif("strand", F.lit("")), "dom_count": F.col("dom_count"),
        "sequence": F.nullif(clean_sequence("sequence"), F.lit("")),
    }
    return _read(spark, d, "proteins", "proteinID", columns, wanted)


def placed(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """Proteins with a contig and both ends: proteinID, genomeID, contig, start, end and what
    else is asked for."""
    rows = proteins(spark, d, *dict.fromkeys(("proteinID", "genomeID", "contig", "start", "end", *wanted)))
    return rows.where("contig IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")


def domains(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """One row per ID, with a domain name; ends in order; the score may be null."""
    columns = {
        "ID": F.col("ID"), "proteinID": F.col("proteinID"), "domain": trim_key("domain"), "score": F.col("score"), "domStart": F.least("domStart", "domEnd"), "domEnd": F.greatest("domStart", "domEnd"),
    }
    return _read(spark, d, "domains", "ID", columns, wanted, F.coalesce(trim_key("domain") != "", F.lit(False)))


def genomes(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """One row per genome that isn't withdrawn; a missing rank is the text NULL."""
    columns = {"genomeID": trim_key("genomeID"), **{r: F.coalesce(r, F.lit("NULL")) for r in RANKS}, **{c: F.col(c) for c in _OWN}}
    return _read(spark, d, "genomes", "genomeID", columns, wanted, F.col("deleted_at").isNull())


def clusters(spark: SparkSession, d: str) -> DataFrame:
    columns = {"clusterID": trim_key("clusterID"), "genomeID": first_dot(trim_key("genomeID"))}
    return _read(spark, d, "clusters", "clusterID", columns, (), F.col("deleted_at").isNull())


def keywords(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """One row per ID with a cluster and a keyword."""
    columns = {"ID": F.col("ID"), "clusterID": trim_key("clusterID"), "keyword": F.col("keyword"), "completeness": F.col("completeness"), "collinearity": F.col("collinearity")}
    return _read(spark, d, "keywords", "ID", columns, wanted, present(trim_key("clusterID")) & F.col("keyword").isNotNull())


def patterns(spark: SparkSession, d: str) -> DataFrame:
    """(pattern_id, keyword, genes): the ordered genes of each pattern."""
    genes = F.filter(F.array(*[f"gene_{i}" for i in range(1, 10)]), lambda g: g.isNotNull())
    return table(spark, d, "patterns").select("pattern_id", "keyword", genes.alias("genes"))


def thresholds(spark: SparkSession, d: str, column: str = "optimized") -> DataFrame:
    """(hmm, cutoff) by the chosen column."""
    return table(spark, d, "thresholds").select("hmm", F.col(column).alias("cutoff"))
