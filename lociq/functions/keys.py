"""Key and sequence normalisation shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that stands for "no value" in key columns, besides null. Fixed value.
NO_KEY = "NULL"


def trim_key(c: Column | str) -> Column:
    """The key without spaces and tabs at both ends; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(" \t"))


def present(c: Column) -> Column:
    """True where a trimmed key is neither null, empty nor the text NULL."""
    return F.coalesce((c != "") & (c != NO_KEY), F.lit(False))


def clean_sequence(c: Column | str) -> Column:
    """The sequence in upper case without white space and without one closing ``*``."""
    c = F.col(c) if isinstance(c, str) else c
    # Texts of plain letters, nearly all of them, pass by the costly pattern of Unicode white space.
    bare = F.when(c.rlike(r"[^!-~]"), F.regexp_replace(c, r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+", "")).otherwise(c)
    up = F.upper(bare)
    return F.when(up.endswith("*"), F.substring(up, F.lit(1), F.length(up) - 1)).otherwise(up)


def first_dot(c: Column) -> Column:
    """The text before the first dot: the genome a file or an assembly version names."""
    return F.substring_index(c, ".", 1)
