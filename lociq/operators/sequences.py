"""Sets of sequence records: merging, splitting, concatenating, numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.operators.ordered import numbered


def merge_first(records: DataFrame, order: Sequence[Column | str], key: str = "id") -> DataFrame:
    """One record per id: the first by file and place."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def split_members(records: DataFrame, group: Sequence[str]) -> DataFrame:
    """Records with the number of members of their group: 1 for a singleton."""
    n = records.groupBy(*group).agg(F.count(F.lit(1)).alias("members"))
    return records.join(n, list(group))


def concatenated(records: DataFrame, files: Sequence[str], gaps: bool = False, order: str = "ord") -> DataFrame:
    """(genome, sequence): all records (file, genome, seq) of a genome joined, in the order of
    files and, within a file, by the column ``order`` and then the sequence. Without gaps only
    genomes found in all files; with gaps a missing file is filled with ``-`` of that file's
    greatest length. Whole records are joined; null sequences count as empty."""
    at = F.expr("map(" + ", ".join(f"'{f}', {i}" for i, f in enumerate(files)) + ")")
    rows = records.where(F.col("file").isin(list(files))).select("genome", at[F.col("file")].alias("o"), F.col(order).alias("ord"), F.coalesce("seq", F.lit("")).alias("seq"))
    listed = F.array_sort(F.collect_list(F.struct("o", "ord", "seq"))).alias("parts")
    text = lambda parts: F.array_join(F.transform(parts, lambda x: x["seq"]), "")
    whole = rows.groupBy("genome").agg(listed)
    if not gaps:
        return whole.where(F.size(F.array_distinct(F.transform("parts", lambda x: x["o"]))) == len(files)).select("genome", text("parts").alias("sequence"))
    # One row: the width of each file.
    width = rows.agg(*[F.coalesce(F.max(F.when(F.col("o") == i, F.length("seq"))), F.lit(0)).alias(f"w{i}") for i in range(len(files))])
    piece = lambda i: F.when(F.exists("parts", lambda x: x["o"] == i), text(F.filter("parts", lambda x: x["o"] == i))).otherwise(F.repeat(F.lit("-"), F.col(f"w{i}")))
    return whole.join(F.broadcast(width)).select("genome", F.concat(*[piece(i) for i in range(len(files))]).alias("sequence"))


def occurrence_names(records: DataFrame, genome: str, order: Sequence[str], name: str) -> DataFrame:
    """Records with a name per genome: as it is for the first, ``_2``, ``_3`` ... after it. A
    genome of many records is numbered by as many tasks as it takes."""
    n = numbered(records, (genome,), order, "occurrence")
    return n.withColumn("label", F.when(F.col("occurrence") == 1, F.col(name)).otherwise(F.concat_ws("_", name, F.col("occurrence").cast("string"))))


def top_per_group(rows: DataFrame, group: str, order: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` rows a group, by order. A limit on the ranking is pushed below the
    shuffle, so a hot group sends only its best rows of each task."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
