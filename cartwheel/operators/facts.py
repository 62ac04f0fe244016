"""Joins of the star schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_lines(*parts: DataFrame) -> DataFrame:
    """Prior and train lines one below the other, repeats kept."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def order_facts(orders: DataFrame, order_products: DataFrame) -> DataFrame:
    """Lines with their order. Orders without lines drop out.

    Both sides are facts: left to a shuffled join, which AQE splits on a hot order.
    """
    return orders.join(order_products, "order_id")


def enrich_products(products: DataFrame, aisles: DataFrame, departments: DataFrame, how: str = "left") -> DataFrame:
    return (
        products.join(aisles, "aisle_id", how)
        .join(departments, "department_id", how)
        .select("product_id", "product_name", "aisle_id", "department_id", "aisle", "department")
    )


def with_products(lines: DataFrame, products: DataFrame, columns: Sequence[str] | None = None, how: str = "left") -> DataFrame:
    """Product columns beside every line; unknown products keep nulls.

    Joined by the big side's product key, the dimension side is small enough for
    Spark to broadcast; past the size limit AQE splits hot products instead.
    """
    dims = products if columns is None else products.select("product_id", *columns)
    return lines.join(dims, "product_id", how)


def enrich_lines(lines: DataFrame, products: DataFrame, aisles: DataFrame, departments: DataFrame) -> DataFrame:
    return with_products(lines, enrich_products(products, aisles, departments))


def prepare_order_data(orders: DataFrame, prior: DataFrame, train: DataFrame, products: DataFrame) -> DataFrame:
    """(prior + train) lines with their order, department and aisle id."""
    placed = order_facts(orders, combine_lines(prior, train))
    return with_products(placed, products, ("department_id", "aisle_id"))


def rename_clashes(df: DataFrame, other: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """``other`` with a suffix on every non-key column that ``df`` has too."""
    taken = set(df.columns) - set(keys)
    return other.select(*[F.col(c).alias(c + suffix) if c in taken else F.col(c) for c in other.columns])


def train_positives(orders: DataFrame, train_lines: DataFrame) -> DataFrame:
    """(user, product) bought in the train order."""
    placed = orders.where(F.col("eval_set") == "train").select("order_id", "user_id")
    return placed.join(train_lines.select("order_id", "product_id"), "order_id").select("user_id", "product_id")
