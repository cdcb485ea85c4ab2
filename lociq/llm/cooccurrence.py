"""Items that appear together: pair counts over baskets and their lift over chance.

Large-basket blocking: a basket's items are spread over chunks of bounded size by a hash, so a
huge basket becomes many chunks; each task multiplies two chunks. Ordinary baskets are one
chunk. Counts of both are combined, first on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.session import cut


def _pairs_within(items: str) -> Column:
    return F.expr(f"flatten(transform({items}, (x, i) -> transform(slice({items}, i + 2, size({items})), y -> struct(x AS a, y AS b))))")


def _pairs_across(left: str, right: str) -> Column:
    return F.expr(f"flatten(transform({left}, x -> transform({right}, y -> struct(least(x, y) AS a, greatest(x, y) AS b))))")


def pair_counts(items: DataFrame, chunk: int = 256) -> DataFrame:
    """(a, b, k): in how many baskets the items a < b lie together.

    ``items`` must hold distinct, non-null (basket, item) rows. ``chunk`` bounds the expected
    number of items in a chunk; no basket is cut or sampled.
    """
    sizes = items.groupBy("basket").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.where(F.col("size") > chunk).select(F.col("basket").alias("_b"), F.ceil(F.col("size") / chunk).cast("int").alias("chunks"))
    spread = items.join(large, F.col("basket") == F.col("_b"), "left").select(
        "basket", "item", F.coalesce("chunks", F.lit(1)).alias("chunks"), F.coalesce(F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int"), F.lit(0)).alias("c"),
    )
    chunked = spread.groupBy("basket", "chunks", "c").agg(F.sort_array(F.collect_list("item")).alias("own"))
    within = chunked.where(F.size("own") > 1).select(F.explode(_pairs_within("own")).alias("p"))
    # Each chunk of a large basket meets the chunks after it; the product of two chunks is one
    # row until its task expands it.
    ahead = chunked.where(F.col("c") < F.col("chunks") - 1).select("basket", "own", F.explode(F.sequence(F.col("c") + 1, F.col("chunks") - 1)).alias("c"))
    other = chunked.where("chunks > 1").select("basket", "c", F.col("own").alias("far"))
    across = ahead.join(other, ["basket", "c"]).select(F.explode(_pairs_across("own", "far")).alias("p"))
    return within.unionByName(across).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("k"))


def associations(rows: DataFrame, basket: Column, item: Column, min_baskets: int = 1, min_share: str = "0", min_lift: int = 0, chunk: int = 256) -> DataFrame:
    """Pairs of items with their counts and association: a, b, k, n_a, n_b, n, lift, pmi.

    ``n`` is the number of baskets with at least one item. Kept are pairs with
    k >= min_baskets, k >= min_share * n and k * n >= min_lift * n_a * n_b, compared exactly.
    Rows with a null basket or item are left out; repeated rows count once; an item with itself
    is no pair; a basket of one item counts in n only. Empty tables give no pairs.

    An item in fewer baskets than a pair needs can't be in a kept pair, so it is left out
    before pairs are built; the counts n_a, n_b and n are taken over everything.
    """
    # Read three times below; the rows before it are joined and made distinct once.
    distinct = cut(rows.select(basket.alias("basket"), item.alias("item")).where("basket IS NOT NULL AND item IS NOT NULL").distinct())
    per_item = distinct.groupBy("item").agg(F.count(F.lit(1)).alias("m"))
    n = distinct.select("basket").distinct().agg(F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.lit(min_baskets).cast("decimal(20,0)"), F.lit(min_share).cast("decimal(10,8)") * F.col("n"))
    counted = per_item.join(F.broadcast(n))  # one row: the number of baskets
    frequent = counted.where(F.col("m") >= need)
    pairs = pair_counts(distinct.join(frequent.select("item"), "item", "left_semi"), chunk)
    a = frequent.select(F.col("item").alias("a"), F.col("m").alias("n_a"), "n")
    b = frequent.select(F.col("item").alias("b"), F.col("m").alias("n_b"))
    kept = pairs.join(a, "a").join(b, "b").where(F.col("k") >= need)
    big = lambda c: F.col(c).cast("decimal(18,0)")
    kept = kept.where(big("k") * big("n") >= F.lit(min_lift) * big("n_a") * big("n_b"))
    lift = F.col("k") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return kept.select("a", "b", "k", "n_a", "n_b", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))
