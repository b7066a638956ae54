"""Items that appear together: basket collapsing.

Identical deduplicated item arrays are grouped into weights, pairs are enumerated once per distinct basket, and weights are
summed. Items that cannot reach the wanted support are taken out of the baskets first; no pair that counts is lost by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.session import broadcast_if_small, cut


def baskets(df: DataFrame, key: str, items: str) -> DataFrame:
    """(key, basket): distinct non-empty items in code-point order. Rows without items have an empty basket."""
    kept = F.filter(F.coalesce(F.col(items), F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    return df.select(key, F.array_sort(F.array_distinct(kept)).alias("basket"))


def item_support(sets: DataFrame) -> DataFrame:
    """(item, n): number of baskets holding each item."""
    return sets.select(F.explode("basket").alias("item")).groupBy("item").count().withColumnRenamed("count", "n")


def collapse(sets: DataFrame, key: str, items: DataFrame | None = None) -> DataFrame:
    """(basket, weight): distinct baskets with the number of rows that have them, of the given items only, two items at least."""
    if items is not None:
        rows = sets.select(key, F.explode("basket").alias("item")).join(broadcast_if_small(items.select("item")), "item", "left_semi")
        sets = rows.groupBy(key).agg(F.array_sort(F.collect_list("item")).alias("basket"))
    return sets.filter(F.size("basket") > 1).groupBy("basket").agg(F.count("*").alias("weight"))


def pair_counts(weighted: DataFrame) -> DataFrame:
    """(item_a, item_b, n_ab) with item_a < item_b: weights summed over the distinct baskets.

    A basket's pairs are generated one first item at a time, so that a long basket needs no array of all its pairs.
    """
    firsts = weighted.select("basket", "weight", F.posexplode("basket").alias("i", "item_a"))
    rest = firsts.select("item_a", "weight", F.explode(F.slice("basket", F.col("i") + 2, F.greatest(F.size("basket") - F.col("i") - 1, F.lit(0)))).alias("item_b"))
    return rest.groupBy("item_a", "item_b").agg(F.sum("weight").alias("n_ab"))


def at_least(times: int) -> Column:
    """Whether n_ab * n >= times * n_a * n_b, exact for counts beyond 10^10, whose products no bigint holds."""
    whole = {c: F.col(c).cast("decimal(19,0)") for c in ("n_ab", "n", "n_a", "n_b")}
    return whole["n_ab"] * whole["n"] >= F.lit(times).cast("decimal(10,0)") * (whole["n_a"] * whole["n_b"]).cast("decimal(28,0)")


def measures() -> tuple[Column, Column]:
    """Lift, and conviction of a for b, null where a never occurs without b; in doubles, as products may pass a bigint."""
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return lift, F.when(F.col("n_a") > F.col("n_ab"), (1 - F.col("n_b") / F.col("n")) / (1 - F.col("n_ab") / F.col("n_a")))


def scored_pairs(df: DataFrame, key: str, items: str, min_count: int = 1, min_share: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, conviction_ab) of all pairs with n_ab >= min_count and n_ab >= min_share * n.

    n is the number of rows of df, which has one row per key, with or without items. lift is n_ab * n / (n_a * n_b);
    conviction_ab is the expected share of a without b over the observed one, null where a never occurs without b. Null and
    empty items don't count, repeated items of a row count once; an empty table gives no rows.
    """
    sets = cut(baskets(df, key, items), "baskets")
    n = sets.count()
    need = max(min_count, 1, -int(-min_share * n // 1))
    support = item_support(sets)
    frequent = cut(support.filter(F.col("n") >= need), "support")  # at most (all entries / need) rows
    pairs = pair_counts(collapse(sets, key, frequent)).filter(F.col("n_ab") >= need)
    small = broadcast_if_small(frequent)
    a, b = small.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), small.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    out = pairs.join(a, "item_a").join(b, "item_b").withColumn("n", F.lit(n).cast("long"))
    lift, conviction = measures()
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), conviction.alias("conviction_ab"))
