"""Result folders and the log of a run."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.sources.tables import hadoop_path


def result_folder(spark: SparkSession, base: str, name: str = "run", at: datetime | None = None) -> str:
    """A new folder ``base/name_time`` for the results of a run; a number follows if it is taken."""
    stem = f"{base.rstrip('/')}/{name}_{(at or datetime.now(UTC)):%Y-%m-%d_%H-%M-%S}"
    path, n = stem, 1
    while True:
        fs, p = hadoop_path(spark, path)
        if not fs.exists(p):
            fs.mkdirs(p)
            return path
        n += 1
        path = f"{stem}_{n}"


def append_log(tables: dict[str, DataFrame], path: str) -> None:
    """Append a line a genome to the run log (genomeID, time, proteins, clusters): the log that
    ``readers.processed`` reads to skip genomes the next time."""
    p = tables["proteins"].groupBy("genomeID").agg(F.count(F.lit(1)).alias("proteins"))
    c = tables["clusters"].groupBy("genomeID").agg(F.count(F.lit(1)).alias("clusters"))
    g = tables["genomes"].select("genomeID").distinct().join(p, "genomeID", "left").join(c, "genomeID", "left")
    g = g.select("genomeID", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("at"), F.coalesce("proteins", F.lit(0)).alias("proteins"), F.coalesce("clusters", F.lit(0)).alias("clusters"))
    g.write.mode("append").option("sep", "\t").csv(path)


def banner(title: str, lines: Sequence[str] = ()) -> str:
    """A console header: the title between rules, and lines below it."""
    rule = "=" * max(len(title), 40)
    return "\n".join([rule, title, rule, *lines])
