"""Incremental ingest: rows come as files and are appended; the first write of a key counts.

The stream's checkpoint takes the place of a progress log: files are read once, and a batch
that is repeated after a failure writes the same folder again. A batch looks at nothing that is
stored, so its cost doesn't grow with the store, and no row is turned away for the batch it came
in; what was written twice is told apart by the number of its batch when the store is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lociq.operators import overlap
from lociq.schemas import DOMAINS, PROTEINS

#: What makes a row of a streamed table the same as another.
KEYS = {"proteins": ("proteinID",), "domains": ("proteinID", "domain", "domStart", "domEnd")}
SCHEMAS = {"proteins": PROTEINS, "domains": DOMAINS}


def store_batch(batch: DataFrame, target: str, batch_id: int, key: Sequence[str] = ("proteinID",), skip: DataFrame | None = None) -> None:
    """Append a batch, one whole row a key. The batch number is part of the path, so a batch
    that is written twice replaces itself. Genomes in ``skip`` (genomeID) are left out."""
    if skip is not None and "genomeID" in batch.columns:
        batch = batch.join(skip.select("genomeID"), "genomeID", "left_anti")
    batch.dropDuplicates(list(key)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, table: str = "proteins", files_per_batch: int = 1000, skip: DataFrame | None = None, schema: StructType | None = None) -> StreamingQuery:
    """Start the stream that reads rows of a table from parquet files in ``source`` and stores
    them in ``target``; it takes what is there and stops. However files fall into batches, the
    same keys are stored. ``skip`` (genomeID) are genomes that were processed elsewhere."""
    rows = spark.readStream.schema(schema or SCHEMAS[table]).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(lambda df, i: store_batch(df, target, i, KEYS[table], skip)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, target: str, table: str = "proteins", latest: bool = False) -> DataFrame:
    """What the stream has stored: of rows of one key the whole row of the first batch, or of
    the ``latest``, where a new search is to replace what was there."""
    rows, key = spark.read.parquet(target), list(KEYS[table])
    pick = F.max_by if latest else F.min_by
    rest = [c for c in rows.columns if c not in key and c != "batch"]
    return rows.groupBy(*key).agg(pick(F.struct(*rest), F.col("batch")).alias("x")).select(*key, "x.*")


def arrivals(rows: DataFrame, time: str = "loaded_at", every: str = "30 days", late: str = "60 days") -> DataFrame:
    """Rows per window of arrival, with a watermark for late ones; for streams and tables."""
    t = rows.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", every)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), "n")


def resolve_batch(hits: DataFrame) -> DataFrame:
    """Domains of a batch of hits after overlaps are resolved: (proteinID, domains)."""
    return overlap.overlap_fold(hits.select(*[f.name for f in DOMAINS.fields]), "proteinID", "ID")
