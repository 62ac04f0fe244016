"""One row per product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.functions.quantile import average_pct_rank, dense_codes
from cartwheel.functions.scalar import beside, fill_numeric, long, ratio, rounded, std, zero
from cartwheel.operators.pair_features import cart_std, mean
from cartwheel.session import written

GROUPS = ("popularity", "reorder_patterns", "department_aisle")


def product_sums(sums: DataFrame) -> DataFrame:
    """All product counts and rates, from the (user, product) sums in one step."""
    rate = F.try_divide(F.col("n_again").cast("double"), F.col("n_flags").cast("double"))
    out = sums.groupBy("product_id").agg(
        long(F.sum("n_orders")).alias("total_orders"),
        long(F.count(F.lit(1))).alias("total_users"),
        mean(F.sum("cart_sum"), F.sum("n_carts"), 4).alias("avg_cart_position"),
        cart_std(4, combine=True).alias("std_cart_position"),
        mean(F.sum("n_again"), F.sum("n_flags"), 4).alias("reorder_rate"),
        long(F.sum("n_again")).alias("total_reorders"),
        long(F.sum("n_flags")).alias("total_purchases"),
        long(F.sum(F.col("n_flags") - F.col("n_again"))).alias("first_purchase_count"),
        std(rate, 6).alias("reorder_consistency"),
    )
    return out.withColumns(
        {
            "orders_per_user": ratio("total_orders", "total_users", 4),
            "reorder_to_first_ratio": ratio("total_reorders", "first_purchase_count", 6),
        }
    )


POPULARITY = ("total_orders", "total_users", "avg_cart_position", "std_cart_position", "orders_per_user")
REORDERS = ("reorder_rate", "total_reorders", "total_purchases", "first_purchase_count")


def popularity_counts(sums: DataFrame) -> DataFrame:
    return product_sums(sums).select("product_id", *POPULARITY)


def with_popularity_ranks(counts: DataFrame) -> DataFrame:
    """Percentile ranks of orders and users (average ties). ``counts`` is read
    three times: pass a written table."""
    ranked = average_pct_rank(counts, "total_orders", "popularity_rank")
    return average_pct_rank(ranked, "total_users", "user_reach_rank")


def popularity(sums: DataFrame) -> DataFrame:
    return with_popularity_ranks(written(popularity_counts(sums), "item-popularity"))


def reorder_basics(sums: DataFrame) -> DataFrame:
    return product_sums(sums).select("product_id", *REORDERS)


def reorder_stages(facts: DataFrame, early: int = 5) -> DataFrame:
    """Reorder rate in early and late orders: mean over order numbers of their means."""
    by_number = facts.groupBy("product_id", "order_number").agg(F.avg("reordered").alias("_rate"))
    is_early = F.col("order_number") <= early
    return by_number.groupBy("product_id").agg(
        zero(rounded(F.avg(F.when(is_early, F.col("_rate"))), 6)).alias("early_reorder_rate"),
        zero(rounded(F.avg(F.when(~is_early, F.col("_rate"))), 6)).alias("late_reorder_rate"),
    )


def reorder_consistency(sums: DataFrame) -> DataFrame:
    """Deviation over users of their own reorder rate."""
    return product_sums(sums).select("product_id", "reorder_consistency")


def reorder_patterns(facts: DataFrame, sums: DataFrame) -> DataFrame:
    basics = product_sums(sums).select("product_id", *REORDERS, "reorder_consistency", "reorder_to_first_ratio")
    return basics.join(reorder_stages(facts), "product_id", "left")


def category_codes(catalogue: DataFrame) -> DataFrame:
    """Category names with dense integer codes of their ids (null id: -1)."""
    out = dense_codes(catalogue, "aisle_id", "aisle_encoded")
    out = dense_codes(out, "department_id", "department_encoded")
    return out.select(
        "product_id", "aisle_id", "department_id", "aisle", "department", "aisle_encoded", "department_encoded"
    )


def build(facts: DataFrame, sums: DataFrame, catalogue: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """Every product; those never bought get zeros."""
    counts = written(product_sums(sums), "product-sums")
    reorders = [*REORDERS, "reorder_consistency", "reorder_to_first_ratio"]
    builders = {
        "popularity": lambda: with_popularity_ranks(counts.select("product_id", *POPULARITY)),
        "reorder_patterns": lambda: counts.select("product_id", *reorders).join(
            reorder_stages(facts), "product_id", "left"
        ),
        "department_aisle": lambda: category_codes(catalogue),
    }
    out = catalogue.select("product_id", "product_name")
    for group in [g for g in GROUPS if g in groups]:
        out = out.join(builders[group](), "product_id", "left")
    return fill_numeric(out)


def base_stats(sums: DataFrame) -> DataFrame:
    """``item_`` popularity, cart, reorder and reach columns in one step."""
    out = sums.groupBy("product_id").agg(
        long(F.sum("n_lines")).alias("item_total_orders"),
        long(F.sum("n_orders")).alias("item_unique_orders"),
        mean(F.sum("cart_sum"), F.sum("n_carts"), 3).alias("item_avg_cart_position"),
        cart_std(3, combine=True).alias("item_std_cart_position"),
        long(F.min("cart_min")).alias("item_min_cart_position"),
        long(F.max("cart_max")).alias("item_max_cart_position"),
        ratio(F.sum("n_again"), F.sum("n_flags"), 3).alias("item_reorder_rate"),
        long(F.sum("n_again")).alias("item_total_reorders"),
        long(F.count(F.lit(1))).alias("item_unique_users"),
    )
    return out.withColumn("item_reorder_probability", ratio("item_total_reorders", "item_total_orders", 3))


def with_reach(items: DataFrame, orders: DataFrame, n_users: int | None = None) -> DataFrame:
    """Share of all users who bought the product."""
    if n_users:
        return items.withColumn("item_user_penetration", ratio("item_unique_users", F.lit(n_users), 6))
    users = orders.agg(F.count_distinct("user_id").alias("_users"))
    reach = ratio("item_unique_users", "_users", 6)
    return items.transform(beside, users).withColumn("item_user_penetration", reach).drop("_users")


def category_stats(items: DataFrame, catalogue: DataFrame, key: str, prefix: str) -> DataFrame:
    """Lines and reorder rate per category, summed up from the product sums."""
    sold = items.join(catalogue.select("product_id", key), "product_id")
    return sold.where(F.col(key).isNotNull()).groupBy(key).agg(
        long(F.sum("item_total_orders")).alias(f"{prefix}_total_orders"),
        ratio(F.sum("item_total_reorders"), F.sum("item_total_orders"), 3).alias(f"{prefix}_avg_reorder_rate"),
    )


def build_prefixed(sums: DataFrame, orders: DataFrame, catalogue: DataFrame, n_users: int | None = None) -> DataFrame:
    """All ``item_``, ``dept_`` and ``aisle_`` columns for every product.

    The product sums feed every part below and are written once. The rank in a
    category goes over distinct volumes of that category.
    """
    stats = written(base_stats(sums), "item-stats")
    sold = stats.join(catalogue.select("product_id", "department_id", "aisle_id"), "product_id")
    out = catalogue.join(with_reach(stats, orders, n_users), "product_id", "left")
    for key, prefix in (("department_id", "dept"), ("aisle_id", "aisle")):
        out = out.join(category_stats(stats, catalogue, key, prefix), key, "left")
        volumes = sold.select(key, "item_total_orders").distinct()
        by_volume = Window.partitionBy(key).orderBy(F.desc("item_total_orders"))
        ranks = volumes.withColumn(f"item_{prefix}_popularity_rank", long(F.row_number().over(by_volume)))
        out = out.join(ranks, [key, "item_total_orders"], "left")
        versus = F.col("item_reorder_rate") - F.col(f"{prefix}_avg_reorder_rate")
        out = out.withColumn(f"item_vs_{prefix}_reorder_rate", rounded(versus, 3))
    return fill_numeric(out)
