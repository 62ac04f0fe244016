"""One row per (user, product) that occurs in the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.scalar import col, fill_numeric, long, ratio, rounded, std_of_sums, zero

PAIR = ["user_id", "product_id"]


def pairs(facts: DataFrame) -> DataFrame:
    return facts.select(*PAIR).distinct()


def pair_sums(facts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Counts and sums per (user, product): the one large aggregation that the
    user, item and pair features share. Write it once, then build all of them.

    Every column adds up (or takes a minimum or maximum), so each feature table
    needs only a partial aggregation of this one. Orders belong to one user:
    distinct orders of a product are the sum over its users. With ``tasks`` the lines
    themselves are dealt: most pairs have one or two, which partial sums, three times
    as wide, would not make fewer. They are dealt by ranges, so that the pairs of a
    user lie side by side and a hot user's in several tasks.
    """
    if tasks:
        facts = facts.repartitionByRange(tasks, *PAIR)
    cart = long("add_to_cart_order")
    return facts.groupBy(*PAIR).agg(
        # Facts have one row per order and product: rows are orders, too.
        long(F.count(F.lit(1))).alias("n_orders"),
        long(F.count(F.lit(1))).alias("n_lines"),
        long(F.count("reordered")).alias("n_flags"),
        long(F.sum("reordered")).alias("n_again"),
        long(F.count("add_to_cart_order")).alias("n_carts"),
        F.sum(cart).alias("cart_sum"),
        F.sum(cart * cart).alias("cart_squares"),
        F.min("add_to_cart_order").alias("cart_min"),
        F.max("add_to_cart_order").alias("cart_max"),
        F.min("order_number").alias("first_order_number"),
        F.max("order_number").alias("last_order_number"),
        F.max_by("add_to_cart_order", "order_number").alias("last_cart"),
        F.sum(long("order_number")).alias("number_sum"),
        F.sum("days_since_prior_order").alias("gap_sum"),
        long(F.count("days_since_prior_order")).alias("n_gaps"),
    )


def mean(total: Column | str, n: Column | str, digits: int) -> Column:
    """Rounded mean of a summed measure; null without values."""
    return rounded(F.try_divide(col(total).cast("double"), col(n).cast("double")), digits)


def cart_std(digits: int, combine: bool = False) -> Column:
    """Deviation of cart positions of one pair, or over the pairs of a group."""
    sums = [F.col(c) for c in ("n_carts", "cart_sum", "cart_squares")]
    sums = [F.sum(c) for c in sums] if combine else sums
    return zero(rounded(std_of_sums(*sums), digits))


def interactions(sums: DataFrame) -> DataFrame:
    return sums.select(
        *PAIR,
        F.col("n_orders").alias("user_item_orders"),
        F.col("n_again").alias("user_item_reorders"),
        mean("cart_sum", "n_carts", 4).alias("avg_cart_position"),
        cart_std(4).alias("std_cart_position"),
        F.col("cart_min").alias("min_cart_position"),
        F.col("cart_max").alias("max_cart_position"),
        "first_order_number",
        "last_order_number",
        mean("number_sum", "n_lines", 4).alias("avg_order_number"),
        zero(mean("gap_sum", "n_gaps", 4)).alias("avg_days_between_orders"),
    )


def derived(interaction: DataFrame, digits: int = 6) -> DataFrame:
    span = F.col("last_order_number") - F.col("first_order_number") + 1
    return (
        interaction.withColumn("order_span", span)
        .withColumn("user_item_reorder_rate", ratio("user_item_reorders", "user_item_orders", digits))
        .withColumn("purchase_frequency", ratio("user_item_orders", "order_span", digits))
    )


def with_recency(interaction: DataFrame, orders: DataFrame, digits: int = 6) -> DataFrame:
    """Distance to the user's newest order, and the share of the user's orders."""
    users = orders.groupBy("user_id").agg(
        F.max("order_number").alias("user_max_order"),
        long(F.count(F.lit(1))).alias("user_total_orders"),
    )
    since = F.col("user_max_order") - F.col("last_order_number")
    return (
        interaction.join(users, "user_id")
        .withColumn("orders_since_last_purchase", since)
        .withColumn("user_item_order_ratio", ratio("user_item_orders", "user_total_orders", digits))
    )


def interaction_features(orders: DataFrame, sums: DataFrame) -> DataFrame:
    return with_recency(derived(interactions(sums)), orders)


def prefixed_interactions(sums: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The twelve ``ui_`` columns; recency is counted in orders that have lines.

    ``wanted`` are the rows of ``sums`` to describe, all of them by default.
    """
    newest = sums.groupBy("user_id").agg(F.max("last_order_number").alias("_newest"))
    span = F.col("last_order_number") - F.col("first_order_number") + 1
    return (sums if wanted is None else wanted).join(newest, "user_id").select(
        *PAIR,
        F.col("n_lines").alias("ui_times_bought"),
        F.col("n_again").alias("ui_times_reordered"),
        mean("n_again", "n_flags", 3).alias("ui_reorder_rate"),
        mean("cart_sum", "n_carts", 3).alias("ui_avg_cart_position"),
        cart_std(3).alias("ui_std_cart_position"),
        F.col("cart_min").alias("ui_min_cart_position"),
        F.col("first_order_number").alias("ui_first_order_number"),
        F.col("last_order_number").alias("ui_last_order_number"),
        mean("number_sum", "n_lines", 3).alias("ui_avg_order_number"),
        span.alias("ui_order_span"),
        ratio("n_lines", span, 3).alias("ui_purchase_frequency"),
        (F.col("_newest") - F.col("last_order_number")).alias("ui_orders_since_last_purchase"),
    )


def _prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def combine(interaction: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Interactions with the user's and the product's features, names prefixed
    ``ui_``, ``user_`` and ``item_`` so that no column hides another."""
    return (
        _prefixed(interaction, PAIR, "ui_")
        .join(_prefixed(users, ["user_id"], "user_"), "user_id", "left")
        .join(_prefixed(items, ["product_id"], "item_"), "product_id", "left")
    )


def with_crosses(combined: DataFrame) -> DataFrame:
    """Six user x item crosses, each from the two prefixed columns it is meant for."""
    pace = 1.0 / (F.col("user_avg_days_since_prior") + 1)
    return combined.withColumns(
        {
            "basket_size_item_popularity": rounded(F.col("user_avg_basket_size") * F.col("item_total_orders"), 4),
            "user_item_reorder_alignment": rounded(F.col("user_reorder_rate") * F.col("item_reorder_rate"), 4),
            "user_order_frequency": rounded(pace, 4),
            "user_item_frequency_match": rounded(pace * F.col("ui_purchase_frequency"), 4),
            "diversity_ubiquity": ratio("user_unique_products", F.col("item_total_users") + 1, 4),
            "dept_exploration_vs_item_dept": rounded(
                F.col("user_unique_departments") * F.col("item_department_encoded"), 4
            ),
        }
    )


def build(orders: DataFrame, sums: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    return fill_numeric(with_crosses(combine(interaction_features(orders, sums), users, items)))
