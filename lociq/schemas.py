"""Schemas of the stored tables and of the text inputs. Nothing is inferred."""

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

_TYPES = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp_ntz": TimestampNTZType()}


def schema(text: str) -> StructType:
    """A schema out of ``name type, ...``, without a running session. ``name type=text`` names
    the text that stands for a missing value."""
    fields = []
    for name, kind in (x.split() for x in text.split(",")):
        kind, _, missing = kind.partition("=")
        fields.append(StructField(name, _TYPES[kind], True, {"missing": missing} if missing else None))
    return StructType(fields)


#: Lineage ranks, highest first. Fixed values.
RANKS = ("Superkingdom", "Clade", "Phylum", "Class", "Ordnung", "Family", "Genus", "Species")

GENOMES = schema(
    "genomeID string, " + ", ".join(f"{r} string=NULL" for r in RANKS) + ", Strain string, TypeStrain int, Completeness double, "
    "Contamination double, dRep int, NCBITaxon int, NCBIProject int, NCBIBioproject string, NCBIBiosample string, NCBIAssembly string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
)
CLUSTERS = schema("clusterID string, genomeID string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
KEYWORDS = schema("ID bigint, clusterID string, keyword string, completeness double, collinearity boolean, loaded_at timestamp_ntz")
PROTEINS = schema(
    "proteinID string, genomeID string, clusterID string, locustag string, contig string, start int, end int, strand string, dom_count int, sequence string, loaded_at timestamp_ntz"
)
DOMAINS = schema("ID bigint, proteinID string, domain string, score int, domStart int, domEnd int")
THRESHOLDS = schema("hmm string, optimized double, trusted double, noise double")
HITS = schema(
    "report_ord bigint, query string, hit_ord bigint, hit_id string, hit_score double, bias double, evalue double, hsp_ord bigint, hsp_score double, hsp_start int, hsp_end int"
)
TABLES = {"genomes": GENOMES, "clusters": CLUSTERS, "keywords": KEYWORDS, "proteins": PROTEINS, "domains": DOMAINS}
