"""References to records that do not exist.

Parent and child keys are put into one long table, tagged, and grouped by parent table and
key. A group whose earliest child is not covered by a parent is an orphan group. Grouping
keeps two timestamps a key, so it combines on the map side and no hot key gathers anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parent:
    """A table that is referred to: ``key`` names a record from time ``since`` on."""

    name: str
    rows: DataFrame
    key: Column
    since: Column


@dataclass(frozen=True)
class Child:
    """A table that refers to ``parent``: ``at`` is the time of the reference."""

    name: str
    parent: str
    rows: DataFrame
    key: Column
    record: Column
    at: Column


def references(children: Sequence[Child]) -> DataFrame:
    """All references in long form: parent_table, key, src_table, record_key, at."""
    parts = [
        c.rows.select(
            F.lit(c.parent).alias("parent_table"), c.key.alias("key"), F.lit(c.name).alias("src_table"),
            c.record.cast("string").alias("record_key"), c.at.alias("at"),
        )
        for c in children
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphan_keys(parents: Sequence[Parent], children: Sequence[Child]) -> DataFrame:
    """Groups (parent_table, key) with a reference that no parent covers in time.

    Columns: parent_table, key, since (null: never there), first_ref, undated.
    """
    tagged = references(children).select("parent_table", "key", F.lit(None).cast("timestamp_ntz").alias("since"), "at", F.lit(True).alias("is_child"))
    for p in parents:
        tagged = tagged.unionByName(
            p.rows.select(
                F.lit(p.name).alias("parent_table"), p.key.alias("key"), p.since.alias("since"),
                F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(False).alias("is_child"),
            )
        )
    grouped = tagged.groupBy("parent_table", "key").agg(
        F.min("since").alias("since"), F.min("at").alias("first_ref"),
        F.bool_or("is_child").alias("referred"), F.bool_or(F.col("is_child") & F.col("at").isNull()).alias("undated"),
    )
    lacking = F.col("key").isNull() | F.col("since").isNull() | F.col("undated") | (F.col("first_ref") < F.col("since"))
    return grouped.where(F.col("referred") & lacking).select("parent_table", "key", "since", "first_ref", "undated")


def orphans(parents: Sequence[Parent], children: Sequence[Child]) -> DataFrame:
    """Every reference whose parent is absent, withdrawn, or loaded only afterwards.

    Null handling: a null key refers to nothing and is an orphan (callers leave such rows out
    where a null means "no reference"); a reference without a time is an orphan, since no
    parent is known to be there by then; a parent without a time covers nothing. Repeated
    references stay repeated. Empty tables give an empty result; other columns are ignored.

    The join is on the orphan keys only; a hot orphan key is split by adaptive skew joins.
    """
    keys = orphan_keys(parents, children).select(F.col("parent_table").alias("_p"), F.col("key").alias("_k"), "since")
    r = references(children)
    on = (F.col("parent_table") == F.col("_p")) & F.col("key").eqNullSafe(F.col("_k"))
    uncovered = F.col("_k").isNull() | F.col("since").isNull() | F.col("at").isNull() | (F.col("at") < F.col("since"))
    return r.join(keys, on).where(uncovered).select("parent_table", "key", "src_table", "record_key", "at")


def orphan_counts(parents: Sequence[Parent], children: Sequence[Child], period: str = "yyyy-MM") -> DataFrame:
    """Orphan references per referring table and period: references, distinct keys.

    A reference without a time has the null period.
    """
    per = orphans(parents, children).withColumn("period", F.date_format("at", period))
    by_key = per.groupBy("src_table", "parent_table", "period", "key").agg(F.count(F.lit(1)).alias("n"))
    return by_key.groupBy("src_table", "parent_table", "period").agg(F.sum("n").alias("references"), F.count(F.lit(1)).alias("orphan_keys"))
