"""Readers and writers of the engine's parquet tables.

A store is a folder of tables that ``write`` has laid out: rows unique and normalised, in the
schemas of ``schemas.TABLES``, range-sorted by the columns that queries look them up by, so that
the statistics of files and row groups let a scan pass by what it doesn't need.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.schemas import TABLES

#: Columns each table is sorted by. They take the place of secondary indexes.
SORTED_BY = {
    "genomes": ("genomeID",), "clusters": ("genomeID", "clusterID"), "keywords": ("keyword", "clusterID"), "proteins": ("genomeID", "clusterID", "proteinID"), "domains": ("domain", "proteinID"),
}
_MARK = "_store"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of parquet tables; columns are pruned by the plan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path, as the cluster sees it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def is_store(spark: SparkSession, folder: str) -> bool:
    """Whether the folder's tables were laid out by ``write``."""
    fs, p = hadoop_path(spark, f"{folder}/{_MARK}")
    return fs.exists(p)


def conform(rows: DataFrame, name: str, now: datetime) -> DataFrame:
    """The rows in the columns and types of a stored table. A column that isn't there is null;
    a missing rank is the text NULL, a missing load time is ``now``."""
    out = []
    for f in TABLES[name].fields:
        c = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        if f.name == "loaded_at":
            c = F.coalesce(c, F.expr(f"timestamp_ntz'{now:%Y-%m-%d %H:%M:%S.%f}'"))
        elif f.metadata.get("missing"):
            c = F.coalesce(c, F.lit(f.metadata["missing"]))
        out.append(c.alias(f.name))
    return rows.select(*out)


def write(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> None:
    """Lay the tables out as a store. Rows of a key come once; tables without an ID get one from
    their key's digest, the same in every run. The mark goes last: a folder without it is read
    as tables that may repeat rows."""
    fs, mark = hadoop_path(spark, f"{folder}/{_MARK}")
    fs.delete(mark, False)
    now = datetime.now(UTC)  # one time for all tables: no row is loaded before what it refers to
    for name, rows in tables.items():
        keys = {"genomes": ["genomeID"], "clusters": ["clusterID"], "keywords": ["clusterID", "keyword"], "proteins": ["proteinID"], "domains": ["proteinID", "domain", "domStart", "domEnd"]}.get(name)
        if keys is None:
            rows.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
            continue
        if "ID" in TABLES[name].names and "ID" not in rows.columns:
            rows = rows.withColumn("ID", F.xxhash64(*keys))
        by = SORTED_BY[name]
        conform(rows.dropDuplicates(keys), name, now).repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    fs.create(mark, True).close()
