"""Per-key results when a few keys hold most records.

Value-frequency compression: rows are grouped by key *and* value first, which combines on the
map side and spreads a hot key over as many tasks as it has values; what a key then brings is
one weighted row a value. Counts, distinct counts, modes and percentiles follow exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, n): how many rows hold the value under the key; nulls are values too."""
    return df.select(key.alias("key"), value.alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def key_stats(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """Per key: rows, values (non-null), distinct_values, mode, mode_rows.

    Of several most frequent values the least is the mode. A null key is a key; a null value
    counts in rows only. Repeated rows count as they stand. An empty table gives no rows.
    """
    w = weighted(df, key, value)
    some = F.col("value").isNotNull()
    # These aggregates all combine before the shuffle: of a key with countless values a task
    # sends one row.
    best = w.where(some).groupBy("key").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("values"), F.max("n").alias("mode_rows"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
    )
    total = w.groupBy("key").agg(F.sum("n").alias("rows"))
    b = best.withColumnRenamed("key", "_k")
    return total.join(b, F.col("key").eqNullSafe(F.col("_k")), "left").select(
        "key", "rows", F.coalesce("values", F.lit(0)).alias("values"), F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), "mode", F.coalesce("mode_rows", F.lit(0)).alias("mode_rows"),
    )


def key_percentile(df: DataFrame, key: Column, value: Column, p: float, fan: int = 1 << 12) -> DataFrame:
    """Per key the exact lower percentile: the least value with at least ``p`` of the key's
    non-null values at or below it. ``value`` must be a whole number.

    Bins are summed up and the one that holds the rank is picked, then its own bins, down to
    single values. A level cuts a bin into at most ``fan``, so a window never sees more rows of
    a key than that, however wide its values; their range decides how many levels there are.
    Keys without a non-null value give no row.
    """
    w = weighted(df, key, value.cast("long")).where("value IS NOT NULL")
    low, high = w.agg(F.min("value"), F.max("value")).first()
    if low is None:
        return w.select("key", F.col("value").alias("percentile"))
    width = 1
    while width * fan <= high - low:
        width *= fan
    per = Window.partitionBy("key")
    inside, need = w.select("key", "value", "n"), None
    while True:
        # The lowest value of a bin stands for it.
        bins = inside.withColumn("value", F.expr(f"value - pmod(value, {width}L)")).groupBy("key", "value").agg(F.sum("n").alias("n"))
        cum = bins.select("key", "value", "n", F.sum("n").over(per.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(per).alias("total"))
        if need is None:
            cum = cum.withColumn("need", F.greatest(F.ceil(F.col("total") * F.lit(p)), F.lit(1)))
        else:
            cum = cum.join(need, F.col("key").eqNullSafe(F.col("_k"))).drop("_k", "_b")
        found = cum.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        if width == 1:
            return found.select("key", F.col("value").alias("percentile"))
        need = found.select(F.col("key").alias("_k"), F.col("value").alias("_b"), (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"))
        at = F.col("key").eqNullSafe(F.col("_k")) & (F.col("value") >= F.col("_b")) & (F.col("value") < F.col("_b") + width)
        inside = w.join(need.select("_k", "_b"), at).select("key", "value", "n")
        width //= fan


def heavy_keys(fields: Sequence[tuple[str, DataFrame, Column, Column]], share: str) -> DataFrame:
    """Keys holding at least ``share`` (decimal text, compared exactly) of the rows of their field whose key is neither null nor
    empty: field_name, key_value, rows, total. Each field is (name, rows, key, value).

    Repeated rows count as they stand; ties all come out; empty tables give nothing.
    """
    out = None
    for name, rows, key, value in fields:
        w = weighted(rows.where(F.coalesce(key != "", F.lit(False))), key, value.cast("string"))
        w = w.select(F.lit(name).alias("field_name"), F.col("key").alias("key_value"), "value", "n")
        out = w if out is None else out.unionByName(w)
    per_key = out.groupBy("field_name", "key_value").agg(F.sum("n").alias("rows"))
    # One row a field: the number of fields is that of the list above.
    total = per_key.groupBy("field_name").agg(F.sum("rows").alias("total"))
    return per_key.join(F.broadcast(total), "field_name").where(F.col("rows") >= F.lit(share).cast("decimal(10,8)") * F.col("total"))
