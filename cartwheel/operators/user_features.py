"""One row per user.

Aggregates that a hot user could swamp are taken in two steps (first per order,
product or category), so partial aggregation shrinks them before the shuffle
on the user. ``sums`` is ``pair_features.pair_sums`` of the lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.quantile import quantile_of, ranked_counts
from cartwheel.functions.scalar import beside, fill_numeric, long, ratio, rounded, std, std_of_sums, zero
from cartwheel.operators.facts import with_products
from cartwheel.operators.pair_features import cart_std, mean

GROUPS = ("order_patterns", "basket_patterns", "product_patterns", "department_aisle")


def order_patterns(orders: DataFrame) -> DataFrame:
    gap = "days_since_prior_order"
    return orders.groupBy("user_id").agg(
        long(F.count("order_number")).alias("total_orders"),
        F.max("order_number").alias("max_order_number"),
        rounded(F.avg("order_number"), 4).alias("avg_order_number"),
        zero(rounded(F.avg(gap), 4)).alias("avg_days_since_prior"),
        std(gap, 4).alias("std_days_since_prior"),
        zero(F.min(gap)).alias("min_days_since_prior"),
        zero(F.max(gap)).alias("max_days_since_prior"),
        F.mode("order_dow", True).alias("preferred_dow"),
        F.mode("order_hour_of_day", True).alias("preferred_hour"),
    )


def basket_sizes(facts: DataFrame) -> DataFrame:
    return facts.groupBy("user_id", "order_id").agg(F.count(F.lit(1)).alias("basket_size"))


def _spread(facts: DataFrame, digits: int, prefix: str = "") -> DataFrame:
    """Mean, deviation, range and median of a user's basket sizes, from how often each size occurs.

    d distinct sizes have at least d * d / 2 lines, so a user has few.
    """
    ranked = ranked_counts(basket_sizes(facts), ["user_id"], "basket_size", bounded=True)
    size, n = F.col("basket_size"), F.col("_ties")
    total, squares = F.sum(size * n), F.sum(size * size * n)
    return ranked.groupBy("user_id").agg(
        rounded(total.cast("double") / F.sum(n), digits).alias(f"{prefix}avg_basket_size"),
        zero(rounded(std_of_sums(F.sum(n), total, squares), digits)).alias(f"{prefix}std_basket_size"),
        long(F.min(size)).alias(f"{prefix}min_basket_size"),
        long(F.max(size)).alias(f"{prefix}max_basket_size"),
        rounded(quantile_of("basket_size", 0.5), digits).alias(f"{prefix}median_basket_size"),
    )


def basket_patterns(facts: DataFrame) -> DataFrame:
    return _spread(facts, 4)


def product_patterns(sums: DataFrame) -> DataFrame:
    return sums.groupBy("user_id").agg(
        long(F.count(F.lit(1))).alias("unique_products"),
        mean(F.sum("n_again"), F.sum("n_flags"), 4).alias("reorder_rate"),
        long(F.sum("n_again")).alias("total_reorders"),
        mean(F.sum("cart_sum"), F.sum("n_carts"), 4).alias("avg_cart_position"),
        cart_std(4, combine=True).alias("std_cart_position"),
    )


def department_aisle(sums: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Distinct and most frequent department and aisle; first by name on ties."""
    named = with_products(sums.select("user_id", "product_id", "n_lines"), catalogue, ("department", "aisle"))
    out = None
    for category in ("department", "aisle"):
        counted = (
            named.where(F.col(category).isNotNull())
            .groupBy("user_id", category)
            .agg(F.sum("n_lines").alias("_n"))
        )
        one = counted.groupBy("user_id").agg(
            long(F.count(F.lit(1))).alias(f"unique_{category}s"),
            F.min_by(category, F.struct(-F.col("_n"), F.col(category))).alias(f"top_{category}"),
        )
        out = one if out is None else out.join(one, "user_id")
    return out


def build(
    orders: DataFrame, facts: DataFrame, sums: DataFrame, catalogue: DataFrame, groups: Sequence[str] = GROUPS
) -> DataFrame:
    """Chosen feature groups side by side. Order features exist for every user,
    basket features only for users with lines.

    The full outer join is laid out as left joins to all users: these keep the
    partitioning by user that every group already has after its aggregation.
    """
    builders = {
        "order_patterns": lambda: order_patterns(orders),
        "basket_patterns": lambda: basket_patterns(facts),
        "product_patterns": lambda: product_patterns(sums),
        "department_aisle": lambda: department_aisle(sums, catalogue),
    }
    wanted = [g for g in GROUPS if g in groups]
    seen = []
    if "order_patterns" in wanted:
        seen.append(orders.select("user_id"))
    if set(wanted) - {"order_patterns"}:
        seen.append(sums.select("user_id"))
    out = reduce(DataFrame.unionAll, seen).distinct()
    for group in wanted:
        out = out.join(builders[group](), "user_id", "left")
    return out


def temporal(orders: DataFrame) -> DataFrame:
    gap = "days_since_prior_order"
    return orders.groupBy("user_id").agg(
        long(F.max("order_number")).alias("user_total_orders"),
        rounded(F.avg("order_dow"), 2).alias("user_avg_dow"),
        std("order_dow", 2).alias("user_std_dow"),
        F.count_distinct("order_dow").alias("user_unique_dow"),
        rounded(F.avg("order_hour_of_day"), 2).alias("user_avg_hour"),
        std("order_hour_of_day", 2).alias("user_std_hour"),
        F.count_distinct("order_hour_of_day").alias("user_unique_hours"),
        zero(rounded(F.avg(gap), 2)).alias("user_avg_days_between_orders"),
        std(gap, 2).alias("user_std_days_between_orders"),
        zero(F.min(gap)).alias("user_min_days_between_orders"),
        zero(F.max(gap)).alias("user_max_days_between_orders"),
    )


def basket(facts: DataFrame) -> DataFrame:
    return _spread(facts, 2, "user_")


def totals(sums: DataFrame) -> DataFrame:
    """Volume and reorder behaviour."""
    return sums.groupBy("user_id").agg(
        long(F.sum("n_lines")).alias("user_total_products"),
        long(F.count(F.lit(1))).alias("user_unique_products"),
        mean(F.sum("n_again"), F.sum("n_flags"), 3).alias("user_reorder_rate"),
        long(F.sum("n_again")).alias("user_total_reorders"),
        long(F.sum("n_flags")).alias("user_total_order_items"),
    )


def diversity(sums: DataFrame, catalogue: DataFrame, n_departments: int | None = None, n_aisles: int | None = None) -> DataFrame:
    """Distinct departments and aisles, and their share of all there are."""
    seen = with_products(sums.select("user_id", "product_id"), catalogue, ("department_id", "aisle_id"), "inner")
    seen = seen.select("user_id", "department_id", "aisle_id").distinct()
    counts = seen.groupBy("user_id").agg(
        long(F.count_distinct("department_id")).alias("user_unique_departments"),
        long(F.count_distinct("aisle_id")).alias("user_unique_aisles"),
    )
    sizes = catalogue.agg(
        (F.lit(n_departments) if n_departments else F.count_distinct("department_id")).alias("_departments"),
        (F.lit(n_aisles) if n_aisles else F.count_distinct("aisle_id")).alias("_aisles"),
    )
    return counts.transform(beside, sizes).select(
        "user_id",
        "user_unique_departments",
        "user_unique_aisles",
        ratio("user_unique_departments", "_departments", 3).alias("user_dept_exploration"),
        ratio("user_unique_aisles", "_aisles", 3).alias("user_aisle_exploration"),
    )


def with_ratios(users: DataFrame) -> DataFrame:
    return users.withColumns(
        {
            "user_avg_products_per_order": ratio("user_total_products", "user_total_orders", 2),
            "user_product_discovery_rate": ratio("user_unique_products", "user_total_products", 3),
            "user_reorder_ratio": ratio("user_total_reorders", "user_total_order_items", 3),
        }
    )


def build_prefixed(
    orders: DataFrame,
    facts: DataFrame,
    sums: DataFrame,
    catalogue: DataFrame,
    n_departments: int | None = None,
    n_aisles: int | None = None,
) -> DataFrame:
    """All ``user_`` columns; users without lines get zeros."""
    out = temporal(orders)
    for part in (basket(facts), totals(sums), diversity(sums, catalogue, n_departments, n_aisles)):
        out = out.join(part, "user_id", "left")
    return fill_numeric(with_ratios(out))


def add_segments(users: DataFrame, segments: DataFrame) -> DataFrame:
    """Segmentation columns beside the user features."""
    columns = ("recency", "frequency", "monetary", "R_score", "F_score", "M_score", "RFM_score", "Segment")
    return users.join(segments.select("user_id", *columns), "user_id", "left")


def standard_names(customers: DataFrame) -> DataFrame:
    """Dashboard names, taken from the segmentation columns where absent."""
    fallbacks = {
        "total_orders": "frequency",
        "total_spent": "monetary",
        "days_since_last_order": "recency",
    }
    new = {
        name: F.col(source)
        for name, source in fallbacks.items()
        if name not in customers.columns and source in customers.columns
    }
    return customers.withColumns(new) if new else customers
