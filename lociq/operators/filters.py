"""Predicates of fetch queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_like(column: str, parts: Sequence[str]) -> Column:
    """OR of substring matches without regard to case; ``_`` and ``%`` of a part are wildcards.
    No part matches nothing."""
    return reduce(or_, [F.col(column).ilike(f"%{p}%") for p in parts], F.lit(False))


def rank_like(rank: str, taxon: str) -> Column:
    """A rank that equals the taxon without regard to case; wildcards of the taxon count."""
    return F.col(rank).ilike(taxon)


def lineage_missing(ranks: Sequence[str]) -> Column:
    """Whether one of the ranks is the text NULL."""
    return reduce(or_, [F.col(r) == "NULL" for r in ranks], F.lit(False))


def length_between(column: str, low: int, high: int) -> Column:
    """Length strictly between both limits."""
    return (F.length(column) > low) & (F.length(column) < high)


def any_word(words: Column | str, pattern: str) -> Column:
    """Whether a word of the array is the pattern, or begins with what it matches as a regex."""
    return F.exists(words, lambda k: (k == pattern) | k.rlike(f"^(?:{pattern})"))


def has_all(rows: DataFrame, group: str, value: str, parts: Sequence[str]) -> DataFrame:
    """(group): groups of which every part is found (as a substring) in some row: relational
    division by one aggregate, however many parts."""
    hits = [F.max(F.col(value).ilike(f"%{p}%").cast("int")).alias(f"m{i}") for i, p in enumerate(parts)]
    per = rows.where(any_like(value, parts)).groupBy(group).agg(*hits)
    return per.where(reduce(lambda a, b: a & b, [F.col(f"m{i}") == 1 for i in range(len(parts))], F.lit(True))).select(group)


def limited(genomes: DataFrame, members: DataFrame, mode: str = "semi") -> DataFrame:
    """Genomes that have (``semi``) or lack (``anti``) a row in ``members``."""
    return genomes.join(members.select("genomeID"), "genomeID", "left_semi" if mode == "semi" else "left_anti")


def keyword_subsets(keywords: DataFrame, group: str, names: Sequence[str]) -> DataFrame:
    """(group, subset): groups for each non-empty subset ``a+b`` of the keyword patterns ``names``
    of which every one matches a keyword of the group. The groups' matches are found once; the
    subsets, 2 to the number of names less one, come out of those."""
    hits = F.array_compact(F.array(*[F.when(F.bool_or((F.col("keyword") == n) | F.col("keyword").rlike(f"^(?:{n})")), F.lit(n)) for n in names]))
    per = keywords.groupBy(group).agg(hits.alias("hits")).where(F.size("hits") > 0)
    grown = F.aggregate("hits", F.array(F.lit("")), lambda acc, n: F.concat(acc, F.transform(acc, lambda x: F.when(x == "", n).otherwise(F.concat_ws("+", x, n)))))
    return per.select(group, F.explode(F.filter(grown, lambda x: x != "")).alias("subset"))
