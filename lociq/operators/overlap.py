"""Scored intervals: cutoffs, best reports, and the overlap-resolving fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_CUTOFF = 10.0


def above_cutoff(hits: DataFrame, cutoffs: DataFrame, default: float = DEFAULT_CUTOFF) -> DataFrame:
    """Hits whose score is above their model's cutoff, or the default of an unlisted model.
    ``cutoffs`` (hmm, cutoff) has one row a model of the library."""
    t = cutoffs.select(F.col("hmm").alias("domain"), "cutoff")
    return hits.join(t, "domain", "left").where(F.col("score") > F.coalesce("cutoff", F.lit(default))).drop("cutoff")


def below_cutoff(hits: DataFrame, cutoffs: DataFrame, share: float = 0.1) -> DataFrame:
    """Hits of listed models strictly between ``share`` of the cutoff and the cutoff."""
    t = cutoffs.select(F.col("hmm").alias("domain"), "cutoff")
    return hits.join(t, "domain").where((F.col("score") > F.col("cutoff") * share) & (F.col("score") < F.col("cutoff"))).drop("cutoff")


def best_report(hits: DataFrame, by: Sequence[str], score: str, order: str) -> DataFrame:
    """Per group the row of the highest score, the first in order on a tie."""
    rest = [c for c in hits.columns if c not in by]
    top = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(order))).alias("top")
    return hits.groupBy(*by).agg(top).select(*by, *[F.col(f"top.{c}").alias(c) for c in rest])


def last_write(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Per group the row that was written last."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("top")).select(*by, *[F.col(f"top.{c}").alias(c) for c in rest])


def overlaps(a: Column, b: Column) -> Column:
    """Closed intervals (start, end) with at least one position in common."""
    return (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def overlap_fold(hits: DataFrame, by: str, order: str) -> DataFrame:
    """Resolve overlaps per group in input order: (by, domains ARRAY<start, end, domain, score>).

    A new interval is turned down if one kept interval that it overlaps has a (whole) score
    that isn't below the new one; else it takes the place of all that it overlaps. This is no
    best-first selection: the order counts. Rows with a null start, end or score are left out.
    """
    item = F.struct(F.col(order).alias("o"), F.col("domStart").alias("start"), F.col("domEnd").alias("end"), F.col("domain"), F.col("score").cast("double").alias("score"))
    rows = hits.where("domStart IS NOT NULL AND domEnd IS NOT NULL AND score IS NOT NULL")
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,domain:string,score:double>>)")

    def step(kept: Column, x: Column) -> Column:
        turned_down = F.exists(kept, lambda y: overlaps(y, x) & ~(F.floor(y["score"]) < x["score"]))
        mine = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["domain"].alias("domain"), x["score"].alias("score"))
        return F.when(turned_down, kept).otherwise(F.concat(F.filter(kept, lambda y: ~overlaps(y, x)), F.array(mine)))

    folded = F.aggregate("items", empty, step)
    whole = F.transform(folded, lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end"), y["domain"].alias("domain"), F.floor(y["score"]).cast("int").alias("score")))
    return listed.select(by, F.array_sort(whole).alias("domains"))


def overlap_pairs(hits: DataFrame, by: str, row_id: str) -> DataFrame:
    """Pairs of overlapping intervals of a group, the smaller id first. A pair meets at the
    later of its two starts, so each interval looks only at those that begin inside it; both
    sides meet on (group, bin of position), never on the group alone."""
    width = 64
    a = hits.select(by, F.col(row_id).alias("i"), F.col("domStart").alias("s"), F.col("domEnd").alias("e"))
    spread = a.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    b = a.select(by, F.col("i").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.floor(F.col("s") / width).alias("bin"))
    # j begins inside i; of equal starts the smaller id looks at the larger.
    inside = (F.col("s2") >= F.col("s")) & (F.col("s2") <= F.col("e")) & ((F.col("s2") > F.col("s")) | (F.col("j") > F.col("i")))
    return spread.join(b, [by, "bin"]).where(inside).select(by, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
