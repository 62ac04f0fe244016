"""Descriptive aggregates over orders, lines and products."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product as pairs_of

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.quantile import quantile_of, ranked_counts
from cartwheel.functions.scalar import beside, long, ratio, rounded
from cartwheel.operators.facts import with_products


def _count(name: str):
    return long(F.count(F.lit(1))).alias(name)


def overview(orders: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """Users, orders, lines, products: one aggregate per table, joined as single rows."""
    return (
        orders.agg(long(F.count_distinct("user_id")).alias("n_users"), _count("n_orders"))
        .transform(beside, lines.agg(_count("n_lines")))
        .transform(beside, products.agg(_count("n_products")))
    )


def counts_by(df: DataFrame, key: str, name: str = "n_orders") -> DataFrame:
    return df.groupBy(key).agg(_count(name))


def peak(df: DataFrame, key: str, name: str = "n_orders") -> DataFrame:
    """Most frequent value; the smallest key on ties."""
    return counts_by(df, key, name).orderBy(F.desc(name), F.asc(key)).limit(1)


def order_sizes(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_id").agg(_count("order_size"))


def order_size_stats(orders: DataFrame, lines: DataFrame) -> DataFrame:
    ranked = ranked_counts(order_sizes(lines), [], "order_size", bounded=True)
    sizes = ranked.agg(
        rounded(F.sum(F.col("order_size") * F.col("_ties")).cast("double") / F.sum("_ties"), 4).alias("avg_order_size"),
        quantile_of("order_size", 0.5).alias("median_order_size"),
        F.max("order_size").alias("max_order_size"),
    )
    per_user = orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), F.max("order_number").alias("_top"))
    users = per_user.agg(
        rounded(F.avg("_n"), 4).alias("avg_orders_per_user"),
        long(F.max("_top")).alias("max_order_number"),
    )
    return sizes.transform(beside, users)


def reorder_summary(lines: DataFrame) -> DataFrame:
    return lines.agg(
        rounded(F.avg("reordered"), 4).alias("reorder_rate"),
        long(F.count_if(F.col("reordered") == 1)).alias("n_reordered"),
        long(F.count_if(F.col("reordered") == 0)).alias("n_first_time"),
    )


def lines_by_category(lines: DataFrame, catalogue: DataFrame, category: str) -> DataFrame:
    """Lines per category: summed per product first, then the small result is joined."""
    per_product = lines.groupBy("product_id").agg(F.count("order_id").alias("_n"))
    named = with_products(per_product, catalogue, (category,), "inner").where(F.col(category).isNotNull())
    return named.groupBy(category).agg(long(F.sum("_n")).alias("n_lines"))


def top_categories(lines: DataFrame, catalogue: DataFrame, category: str, k: int) -> DataFrame:
    return lines_by_category(lines, catalogue, category).orderBy(F.desc("n_lines"), category).limit(k)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed."""
    span = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    width = F.col("_high") - F.col("_low")
    offset = (F.col(column) - F.col("_low")).cast("double") * bins
    place = F.least(F.floor(F.coalesce(F.try_divide(offset, width.cast("double")), F.lit(0.0))), F.lit(bins - 1))
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return (
        counted.transform(beside, span)
        .groupBy(place.cast("int").alias("bin"))
        .agg(long(F.sum("_n")).alias("n_values"))
    )


def department_kpis(items: DataFrame, k: int = 10) -> DataFrame:
    """Needs columns department, item_total_orders, item_reorder_rate."""
    return (
        items.where(F.col("department").isNotNull())
        .groupBy("department")
        .agg(
            long(F.sum("item_total_orders")).alias("total_orders"),
            rounded(F.avg("item_reorder_rate"), 4).alias("avg_reorder_rate"),
            long(F.count("product_id")).alias("product_count"),
        )
        .orderBy(F.desc("total_orders"), "department")
        .limit(k)
    )


def top_reorder_products(items: DataFrame, k: int = 10) -> DataFrame:
    return (
        items.select("product_id", "product_name", "department", "item_reorder_rate")
        .orderBy(F.desc("item_reorder_rate"), "product_id")
        .limit(k)
    )


def headline_kpis(customers: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Customers, orders, mean basket, mean reorder rate and total volume in one row."""
    return (
        customers.agg(
            _count("n_customers"),
            rounded(F.avg("user_avg_basket_size"), 4).alias("avg_basket_size"),
            long(F.sum("total_spent")).alias("total_spent"),
        )
        .transform(beside, orders.agg(_count("n_orders")))
        .transform(beside, items.agg(rounded(F.avg("item_reorder_rate"), 4).alias("avg_reorder_rate")))
    )


def filter_options(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("department").where(F.col("department").isNotNull()).distinct()


def in_departments(df: DataFrame, departments: Sequence[str] | None) -> DataFrame:
    return df if not departments else df.where(F.col("department").isin(list(departments)))


def user_id_range(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.min("user_id").alias("min_user_id"),
        F.max("user_id").alias("max_user_id"),
        long(F.count_distinct("user_id")).alias("n_known_users"),
    )


def correlation_matrix(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of score columns, from one pass."""
    wanted = [(a, b) for a, b in pairs_of(columns, columns) if a < b]
    row = scores.agg(*[F.corr(a, b).alias(f"_{a}__{b}") for a, b in wanted])
    cells = []
    for a, b in pairs_of(columns, columns):
        low, high = min(a, b), max(a, b)
        value = F.lit(1.0) if a == b else rounded(F.col(f"_{low}__{high}"), 4)
        cells.append(F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), value.alias("correlation")))
    return row.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def share_of(df: DataFrame, flag: str, digits: int = 4) -> DataFrame:
    return df.agg(ratio(F.count_if(F.col(flag) == 1), F.count(F.lit(1)), digits).alias("share"))


def cohort_retention(orders: DataFrame, placed_at: str) -> DataFrame:
    """Users by the month of their first order, and how many of them order again, month by month.

    A dense triangle: months without an order of the cohort are 0, months after
    the last one of the data are absent. Months are few, so only the first two
    steps see the size of the data.
    """
    month = F.trunc(F.col(placed_at), "month")
    active = orders.where(F.col("user_id").isNotNull() & F.col(placed_at).isNotNull()).select("user_id", month.alias("_month")).distinct()
    started = active.groupBy("user_id").agg(F.min("_month").alias("cohort"))
    distance = F.months_between("_month", "cohort").cast("int").alias("period")
    seen = active.join(started, "user_id").select("cohort", distance).groupBy("cohort", "period").agg(_count("n_active"))
    sizes = started.groupBy("cohort").agg(_count("n_users"))
    last = active.agg(F.max("_month").alias("_last"))
    months = F.sequence(F.lit(0), F.months_between("_last", "cohort").cast("int"))
    dense = sizes.transform(beside, last).select("cohort", "n_users", F.explode(months).alias("period"))
    filled = dense.join(seen, ["cohort", "period"], "left").withColumn("n_active", F.coalesce("n_active", F.lit(0)).cast("long"))
    return filled.select("cohort", "period", "n_users", "n_active", ratio("n_active", "n_users", 6).alias("retention"))
