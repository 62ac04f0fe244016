"""The basket star schema derived from wholesale order tables.

``orders`` and ``lineitem`` become orders and order lines with order numbers,
cart positions and reorder flags; ``part`` becomes products, aisles and
departments. ``n_products`` folds part keys onto a smaller catalogue.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwheel.functions.ordered import cell_count, running
from cartwheel.operators.pair_features import pair_sums
from cartwheel.session import staged

TASK_LINES = 250_000
LINE_COLUMNS = ("order_id", "product_id", "add_to_cart_order", "reordered")
ORDER_COLUMNS = (
    "order_id",
    "user_id",
    "eval_set",
    "order_number",
    "order_dow",
    "order_hour_of_day",
    "days_since_prior_order",
)


def orders_from(raw: DataFrame) -> DataFrame:
    base = raw.select(
        F.col("o_orderkey").cast("long").alias("order_id"),
        F.col("o_custkey").cast("long").alias("user_id"),
        F.col("o_orderdate").alias("_at"),
    )
    numbered = running(
        base,
        ["user_id"],
        ["_at", "order_id"],
        number="_number",
        totals={"_orders": F.lit(1)},
        prev={"_prev": "_at"},
    )
    last = F.col("_number") == F.col("_orders")
    eval_set = (
        F.when(~last, "prior").when(F.col("user_id") % 10 == 0, "test").otherwise("train")
    )
    return numbered.select(
        "order_id",
        "user_id",
        eval_set.alias("eval_set"),
        F.col("_number").cast("int").alias("order_number"),
        (F.dayofweek("_at") - 1).cast("int").alias("order_dow"),
        (F.col("order_id") % 24).cast("int").alias("order_hour_of_day"),
        F.datediff("_at", "_prev").cast("double").alias("days_since_prior_order"),
    )


def task_count(lines: DataFrame) -> int:
    """Tasks for a pass over all lines: few enough rows in each to be sorted in memory."""
    return max(cell_count(lines), math.ceil(lines.count() / TASK_LINES))


def facts_from(raw_lines: DataFrame, orders: DataFrame, n_products: int | None) -> DataFrame:
    """Order lines joined to their orders, one row per (order, product)."""
    part = F.col("l_partkey").cast("long")
    product = (part % n_products if n_products else part) + 1
    raw = raw_lines.select(
        F.col("l_orderkey").cast("long").alias("order_id"),
        product.alias("product_id"),
        F.col("l_linenumber").alias("ln"),
    )
    tasks = task_count(raw_lines)
    dealt = raw.repartition(tasks, "order_id")
    lines = dealt.groupBy("order_id", "product_id").agg(F.min("ln").alias("ln"))
    # An order has as many lines as someone put into a basket. Dealt by order once, the
    # lines need no further exchange to be told apart, numbered and joined.
    carts = running(lines, ["order_id"], ["ln", "product_id"], number="add_to_cart_order", bounded=True).drop("ln")
    placed = carts.join(orders, "order_id")
    return _with_reorders(placed, tasks).select(
        *ORDER_COLUMNS[:2],
        *ORDER_COLUMNS[3:],
        "product_id",
        F.col("add_to_cart_order").cast("int").alias("add_to_cart_order"),
        F.col("_again").cast("int").alias("reordered"),
        "eval_set",
    )


def _with_reorders(placed: DataFrame, tasks: int) -> DataFrame:
    """Adds whether the user had the product in an earlier order.

    Dealt by ranges of user and product, a hot user's lines lie in several tasks: a
    group has at most one line for each order of its user. The lines of any other user
    lie side by side, so that later sums per user or order are taken before an
    exchange. Lines without a user or product are in no group.
    """
    pair = ["user_id", "product_id"]
    known = placed.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    first = F.min("order_number").over(Window.partitionBy(*pair))
    return known.repartitionByRange(tasks, *pair).withColumn("_again", F.col("order_number") > first)


def catalogue_from(part: DataFrame, n_products: int | None) -> DataFrame:
    """Products with their aisle (brand) and department (type) names and ids."""
    sold = part.where(F.col("p_partkey") < n_products) if n_products else part
    base = sold.select(
        (F.col("p_partkey") + 1).cast("long").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("aisle"),
        F.col("p_type").alias("department"),
    )
    for name in ("aisle", "department"):
        names = base.where(F.col(name).isNotNull()).select(name).distinct()
        ids = running(names, [], [name], number=f"{name}_id", bounded=True)
        # A product without a brand or type stays, without that id.
        base = base.join(ids, name, "left").withColumn(f"{name}_id", F.col(f"{name}_id").cast("int"))
    return base


@dataclass(frozen=True)
class Star:
    """Lazy tables of the star schema; big ones are written once per application."""

    spark: SparkSession
    folder: str
    n_products: int | None = None
    version: str = ""

    @property
    def source(self) -> tuple:
        """Names what staged tables are made of; a new version after the source files have changed."""
        return self.folder, self.version, self.n_products

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        raw = self.raw("orders")
        return staged(self.spark, ("orders", *self.source), lambda: orders_from(raw))

    @cached_property
    def facts(self) -> DataFrame:
        raw = self.raw("lineitem")
        return staged(
            self.spark,
            ("facts", *self.source),
            lambda: facts_from(raw, self.orders, self.n_products),
            partition_by=("eval_set",),
        )

    def pairs(self, *eval_sets: str) -> DataFrame:
        """The (user, product) sums of some evaluation sets."""
        sets = eval_sets or ("prior", "train")
        return staged(
            self.spark,
            ("pairs", *self.source, sets),
            lambda: pair_sums(self.lines(*sets), task_count(self.lines(*sets))),
        )

    @cached_property
    def catalogue(self) -> DataFrame:
        raw = self.raw("part")
        return staged(
            self.spark,
            ("catalogue", *self.source),
            lambda: catalogue_from(raw, self.n_products),
        )

    @property
    def products(self) -> DataFrame:
        return self.catalogue.select("product_id", "product_name", "aisle_id", "department_id")

    @property
    def aisles(self) -> DataFrame:
        return self.catalogue.select("aisle_id", "aisle").distinct()

    @property
    def departments(self) -> DataFrame:
        return self.catalogue.select("department_id", "department").distinct()

    def lines(self, *eval_sets: str) -> DataFrame:
        """Facts of some evaluation sets: a partition filter, not a row filter."""
        return self.facts.where(F.col("eval_set").isin(*(eval_sets or ("prior", "train"))))

    def order_products(self, *eval_sets: str) -> DataFrame:
        return self.lines(*eval_sets).select(*LINE_COLUMNS)
