"""Text renderings: lineage, architecture, coordinates, tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What of an architecture a pattern gene is compared with. Fixed value.
SUFFIX = r"\w+_(\w+$)"


def lineage(columns: Sequence[str], sep: str = "_") -> Column:
    """Ranks joined by ``sep``, blanks as ``-``; ``0`` if any rank is null."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return F.when(missing, F.lit("0")).otherwise(F.replace(F.concat_ws(sep, *columns), F.lit(" "), F.lit("-")))


def in_order(items: Column | str, value: str, sep: str = "-") -> Column:
    """Field ``value`` of an array of structs, in the array's order, joined."""
    return F.array_join(F.transform(items, lambda x: x[value].cast("string")), sep)


def architecture(domains: Column | str) -> Column:
    """Domain names by start, joined by ``-``. Structs are (start, end, domain, score)."""
    return in_order(F.array_sort(domains), "domain")


def coordinates(domains: Column | str) -> Column:
    return F.array_join(F.transform(F.array_sort(domains), lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), "-")


def scores(domains: Column | str) -> Column:
    return in_order(F.array_sort(domains), "score")


def token(arch: Column | str) -> Column:
    """What a pattern gene is compared with: the part after the last ``_`` if it runs to the
    end of the architecture, else the whole. A fusion ``A-B`` is no gene of a pattern."""
    c = F.col(arch) if isinstance(arch, str) else arch
    return F.when(c.rlike(SUFFIX), F.regexp_extract(c, SUFFIX, 1)).otherwise(c)


def genome_of(name: Column | str) -> Column:
    """Genome of a file path or protein id: the base name cut at the first dot."""
    c = F.col(name) if isinstance(name, str) else name
    return F.substring_index(F.substring_index(c, "/", -1), ".", 1)


def header_tokens(records: DataFrame, header: str) -> DataFrame:
    """The records with what a sequence header says: ``id``, its first word; ``type``, the part of
    the second behind the last ``_``; ``keywords``, the list in the last word but two of headers
    of more than seven words, empty in others."""
    words = F.split(header, " ")
    at = lambda i: F.try_element_at(words, F.lit(i))
    keys = F.when(F.size(words) > 7, F.filter(F.split(at(-3), ","), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    return records.select("*", at(1).alias("id"), F.substring_index(at(2), "_", -1).alias("type"), keys.alias("keywords"))
