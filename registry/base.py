"""Registration of queries and the shared SQL of the adapter."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartwheel.sources.retail import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def r(x: str, digits: int) -> str:
    return f"round(({x})::DOUBLE + 1e-9, {digits})"


def ratio(a: str, b: str, digits: int | None = None) -> str:
    q = f"({a})::DOUBLE / nullif(({b})::DOUBLE, 0)"
    return f"coalesce({q if digits is None else r(q, digits)}, 0)"


def std(x: str, digits: int) -> str:
    return f"coalesce({r(f'stddev_samp({x})', digits)}, 0)"


# Named common table expressions; each may use those above it.
FRAGMENTS: dict[str, str] = {
    "placed": """
      SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS placed_at,
             row_number() OVER w AS order_number,
             count(*) OVER (PARTITION BY o_custkey) AS n_orders,
             lag(o_orderdate) OVER w AS prev_at
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "ord": """
      SELECT order_id, user_id,
             CASE WHEN order_number < n_orders THEN 'prior' WHEN user_id % 10 = 0 THEN 'test' ELSE 'train' END AS eval_set,
             order_number::INTEGER AS order_number,
             dayofweek(placed_at)::INTEGER AS order_dow,
             (order_id % 24)::INTEGER AS order_hour_of_day,
             date_diff('day', prev_at, placed_at)::DOUBLE AS days_since_prior_order
      FROM placed""",
    "baskets": """
      SELECT l_orderkey AS order_id, l_partkey + 1 AS product_id, min(l_linenumber) AS ln
      FROM lineitem GROUP BY ALL""",
    "carts": """
      SELECT order_id, product_id,
             row_number() OVER (PARTITION BY order_id ORDER BY ln, product_id)::INTEGER AS add_to_cart_order
      FROM baskets""",
    "facts": """
      SELECT ord.*, product_id, add_to_cart_order,
             (row_number() OVER (PARTITION BY user_id, product_id ORDER BY order_number) > 1)::INTEGER AS reordered
      FROM carts JOIN ord USING (order_id)""",
    "lines": "SELECT * FROM facts WHERE eval_set IN ('prior', 'train')",
    "prior_lines": "SELECT * FROM facts WHERE eval_set = 'prior'",
    "train_lines": "SELECT * FROM facts WHERE eval_set = 'train'",
    "prod": """
      SELECT p_partkey + 1 AS product_id, p_name AS product_name,
             dense_rank() OVER (ORDER BY p_brand)::INTEGER AS aisle_id,
             dense_rank() OVER (ORDER BY p_type)::INTEGER AS department_id,
             p_brand AS aisle, p_type AS department
      FROM part""",
}


def fragment(name: str, text: str) -> str:
    FRAGMENTS[name] = text
    return name


def copies(names: tuple[str, ...], suffix: str, instead: dict[str, str]) -> None:
    """Register ``names`` and all they are made of once more, with other sources in place of some."""
    used: list[str] = []

    def place(text: str) -> bool:
        """Whether the text depends on a source that is replaced."""
        found = False
        for name in list(FRAGMENTS):
            if re.search(rf"\b{name}\b", text):
                if name in instead:
                    found = True
                elif name in used or place(FRAGMENTS[name]):
                    found = True
                    if name not in used:
                        used.append(name)
        return found

    place(" ".join(names))
    for name in used:
        text = FRAGMENTS[name]
        for other in used:
            text = re.sub(rf"\b{other}\b", f"{other}{suffix}", text)
        for source, new in instead.items():
            text = re.sub(rf"\b{source}\b", new, text)
        fragment(f"{name}{suffix}", text)


def with_fragments(body: str) -> str:
    """The body behind the expressions it needs, each after those it uses."""
    placed: dict[str, str] = {}

    def place(text: str) -> None:
        for name in FRAGMENTS:
            if name not in placed and re.search(rf"\b{name}\b", text):
                placed[name] = ""
                definition = FRAGMENTS[name]
                place(definition)
                del placed[name]
                placed[name] = definition

    place(body)
    parts = ",\n".join(f"{name} AS ({text})" for name, text in placed.items())
    return f"WITH {parts}\n{body}" if parts else body


def oracle() -> dict[str, str]:
    return {key: with_fragments(sql) for key, sql in SQL.items()}


def query(key: str, sql: str | None = None):
    """Register ``fn(star)`` under ``key`` with its equivalent SQL."""

    def register(fn: Callable[[Star], DataFrame]):
        QUERIES[key] = lambda spark, folder: fn(Star(spark, folder, None))
        if sql is not None:
            SQL[key] = sql
        return fn

    return register
