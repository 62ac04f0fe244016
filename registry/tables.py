"""Sources, sinks, validation, projections and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.scalar import (
    beside,
    binarise,
    clamp,
    confidence,
    day_name,
    long,
    mapped,
    ratio as ratio_of,
    rounded,
)
from cartwheel.functions.rules import DISPLAY_NAMES, DISPLAY_DEFAULT
from cartwheel.operators import candidates, facts, item_features, pair_features, quality, rfm, user_features
from cartwheel.plans.ingest import ingest
from cartwheel.schemas import RAW_FILES, REQUIRED, SCHEMAS
from cartwheel.session import new_path, written
from cartwheel.sources import files
from registry.base import fragment, query, r, ratio

ORDER_SQL = "order_id, user_id, eval_set, order_number, order_dow, order_hour_of_day, days_since_prior_order"
LINE_SQL = "order_id, product_id, add_to_cart_order, reordered"
PRODUCT_SQL = "product_id, product_name, aisle_id, department_id"


def six_tables(s) -> dict[str, DataFrame]:
    return {
        "orders": s.orders,
        "order_products_prior": s.order_products("prior"),
        "order_products_train": s.order_products("train"),
        "products": s.products,
        "aisles": s.aisles,
        "departments": s.departments,
    }


SIX_SQL = {
    "orders": f"SELECT {ORDER_SQL} FROM ord",
    "order_products_prior": f"SELECT {LINE_SQL} FROM prior_lines",
    "order_products_train": f"SELECT {LINE_SQL} FROM train_lines",
    "products": f"SELECT {PRODUCT_SQL} FROM prod",
    "aisles": "SELECT DISTINCT aisle_id, aisle FROM prod",
    "departments": "SELECT DISTINCT department_id, department FROM prod",
}
SIZES_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows, {len(SCHEMAS[n])}::BIGINT AS n_columns FROM ({q})"
    for n, q in SIX_SQL.items()
)


def raw_folder(s) -> str:
    folder = new_path(s.spark, "raw")
    for name, table in six_tables(s).items():
        files.save_csv(table, f"{folder}/{RAW_FILES[name]}")
    return folder


# Sources and sinks


@query("s1_load_csv", SIX_SQL["orders"])
def _(s):
    path = new_path(s.spark, "orders-csv")
    files.save_csv(s.orders, path)
    return files.load_csv(s.spark, path, SCHEMAS["orders"])


@query("s2_save_csv", SIX_SQL["products"])
def _(s):
    path = new_path(s.spark, "products-csv")
    files.save_csv(s.products, path)
    return files.load_csv(s.spark, path, SCHEMAS["products"])


@query(
    "s3_load_parquet",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders",
)
def _(s):
    raw = files.load_parquet(s.spark, f"{s.folder}/orders.parquet")
    return raw.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
    )


@query("s4_save_parquet", f"SELECT {LINE_SQL}, eval_set FROM lines")
def _(s):
    path = new_path(s.spark, "lines")
    files.save_parquet(s.lines().select("order_id", "product_id", "add_to_cart_order", "reordered", "eval_set"), path, ("eval_set",))
    return files.load_parquet(s.spark, path)


@query("s5_json_round_trip", "SELECT department_id, department, count(*) AS n_products FROM prod GROUP BY ALL")
def _(s):
    path = new_path(s.spark, "departments")
    table = s.catalogue.groupBy("department_id", "department").agg(long(F.count(F.lit(1))).alias("n_products"))
    files.save_json(table, path)
    return files.load_json(s.spark, path, table.schema)


def _all_values(tables: dict[str, DataFrame]) -> DataFrame:
    """Every value of the six tables side by side: orders with their lines, products, aisles and departments."""
    lines = tables["order_products_prior"].unionByName(tables["order_products_train"])
    products = tables["products"].join(tables["aisles"], "aisle_id").join(tables["departments"], "department_id")
    return tables["orders"].join(lines, "order_id", "left").join(products, "product_id", "full_outer")


VALUES_SQL = f"""SELECT order_id, user_id, eval_set, order_number, order_dow, order_hour_of_day, {{gap}} AS days_since_prior_order,
  product_id, add_to_cart_order, l.reordered, product_name, aisle_id, department_id, aisle, department
  FROM ord LEFT JOIN (SELECT {LINE_SQL} FROM lines) l USING (order_id) FULL OUTER JOIN prod USING (product_id)"""


@query("s6_load_raw", VALUES_SQL.format(gap="days_since_prior_order"))
def _(s):
    return _all_values(files.load_raw(s.spark, raw_folder(s)))


@query(
    "s7_ingest",
    VALUES_SQL.format(gap="CASE WHEN order_id IS NOT NULL THEN coalesce(days_since_prior_order, 0) END"),
)
def _(s):
    """The processed tables as saved: first gaps filled, types narrowed (cast back here to compare)."""
    done = ingest(s.spark, raw_folder(s), new_path(s.spark, "processed"))
    declared = {f.name: f.dataType for schema in SCHEMAS.values() for f in schema.fields}
    narrow = {c for table in done.values() for c, kind in table.dtypes if kind in ("tinyint", "smallint", "float")}
    assert {"order_dow", "order_hour_of_day", "reordered", "days_since_prior_order"} <= narrow
    values = _all_values(done)
    return values.select(*[F.col(c).cast(declared[c]).alias(c) for c in values.columns])


@query("s8_fallback_scan", f"SELECT {PRODUCT_SQL}, aisle, department FROM prod")
def _(s):
    """No processed table yet: rebuilt from the raw ones."""
    return files.enriched_products(s.spark, new_path(s.spark, "nothing"), six_tables(s))


@query("s8_processed_scan", f"SELECT {PRODUCT_SQL}, aisle, department FROM prod")
def _(s):
    folder = new_path(s.spark, "processed")
    files.save_parquet(facts.enrich_products(s.products, s.aisles, s.departments), f"{folder}/products_enriched.parquet")
    return files.enriched_products(s.spark, folder, six_tables(s))


# Validation, profiling, cleaning


@query(
    "v1_required_columns",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows, '' AS missing_columns, '' AS all_null_columns, 1 AS passed FROM ({q})"
        for n, q in SIX_SQL.items()
    ),
)
def _(s):
    checked = [quality.validate_frame(t, REQUIRED[n], n) for n, t in six_tables(s).items()]
    return reduce(DataFrame.unionAll, checked)


@query(
    "v2_category_keys",
    """SELECT 'products.aisle_id' AS check_name, count(DISTINCT aisle_id) AS invalid_keys FROM prod
       WHERE aisle_id NOT IN (SELECT aisle_id FROM prod)
       UNION ALL SELECT 'products.department_id', count(DISTINCT department_id) FROM prod
       WHERE department_id NOT IN (SELECT department_id FROM prod)
       UNION ALL SELECT 'lines.product', count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
       UNION ALL SELECT 'orders.user', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def _(s):
    """Also on the raw tables, where a key may really be missing."""
    report = quality.foreign_key_report(s.products, s.aisles, s.departments)
    lines = quality.orphan_count(s.raw("lineitem"), s.raw("part"), "l_partkey", "lines.product", "p_partkey")
    return report.unionAll(lines).unionAll(
        quality.orphan_count(s.raw("orders"), s.raw("customer"), "o_custkey", "orders.user", "c_custkey")
    )


@query(
    "v3_line_orders",
    """SELECT 'lines.order_id' AS check_name, count(DISTINCT l_orderkey) AS invalid_keys FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
       UNION ALL SELECT 'orders.without_lines', count(*) FROM ord
       WHERE order_id NOT IN (SELECT order_id FROM facts)""",
)
def _(s):
    raw = quality.orphan_count(s.raw("lineitem"), s.raw("orders"), "l_orderkey", "lines.order_id", "o_orderkey")
    return raw.unionAll(
        quality.orphan_count(s.orders, s.facts, "order_id", "orders.without_lines")
    )


@query(
    "v4_validate_frame",
    """SELECT 'first_orders' AS table_name, count(*) AS n_rows, 'basket_size' AS missing_columns,
       'days_since_prior_order' AS all_null_columns, 0 AS passed FROM ord WHERE order_number = 1""",
)
def _(s):
    """First orders: their gap is all null, and a required column is absent."""
    first = s.orders.where(F.col("order_number") == 1)
    return quality.validate_frame(first, [*REQUIRED["orders"], "basket_size"], "first_orders")


@query("v5_fill_first_gap", "SELECT order_id, coalesce(days_since_prior_order, 0) AS days_since_prior_order FROM ord")
def _(s):
    return quality.fill_first_gap(s.orders).select("order_id", "days_since_prior_order")


def _narrow(c: str) -> str:
    kind = {"eval_set": "'string'", "days_since_prior_order": "'float'"}.get(
        c,
        f"CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' "
        f"WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' "
        f"WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END",
    )
    return f"SELECT '{c}' AS column_name, {kind} AS dtype, count(DISTINCT {c}) AS unique_count FROM ord"


@query("v6_narrow_types", " UNION ALL ".join(_narrow(c) for c in ORDER_SQL.split(", ")))
def _(s):
    """The types chosen for the order columns, and that no value got lost."""
    return quality.integrity_report(quality.narrow_types(s.orders)).select("column_name", "dtype", "unique_count")


_PROFILED = ["order_id", "user_id", "order_number", "order_dow", "order_hour_of_day", "days_since_prior_order"]
_TYPES = {"order_id": "bigint", "user_id": "bigint", "eval_set": "string", "days_since_prior_order": "double"}


def _profile(c: str) -> str:
    numbers = c in _PROFILED
    stats = [f"{r(f'{fn}({c})', 4)} AS {name}" if numbers else f"NULL::DOUBLE AS {name}"
             for fn, name in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))]
    return f"""SELECT '{c}' AS column_name, '{_TYPES.get(c, 'int')}' AS dtype, {int(c == 'order_id')} AS is_required,
      count(*) AS n_rows, count(*) - count({c}) AS null_count,
      {r(f'100.0 * (count(*) - count({c})) / count(*)', 4)} AS null_percentage,
      count(DISTINCT {c}) AS unique_count, {', '.join(stats)} FROM ord"""


@query("v7_integrity_report", " UNION ALL ".join(_profile(c) for c in ORDER_SQL.split(", ")))
def _(s):
    report = quality.integrity_report(s.orders, ["order_id"])
    digits = ("null_percentage", "mean", "std", "min", "max")
    return report.withColumns({c: rounded(c, 4) for c in digits})


@query("v8_table_sizes", SIZES_SQL)
def _(s):
    return quality.table_sizes(six_tables(s))


@query(
    "v9_missing_values",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM ord" for c in ORDER_SQL.split(", ")),
)
def _(s):
    return quality.missing_values(s.orders)


@query("v10_numeric_coercion", "SELECT user_id, RFM_score::DOUBLE AS RFM_score, 0.0::DOUBLE AS Segment FROM rfm_segments")
def _(s):
    scored = rfm.segment_users(s.lines()).select("user_id", "RFM_score", "Segment")
    return quality.to_numbers(scored, ["RFM_score", "Segment"])


@query(
    "v11_fill_missing",
    """SELECT user_id, product_id, coalesce(ui_times_bought, 0) AS ui_times_bought, coalesce(n, 0) AS item_total_orders
       FROM (SELECT DISTINCT user_id, product_id FROM train_lines)
       LEFT JOIN (SELECT user_id, product_id, count(*) AS ui_times_bought FROM prior_lines GROUP BY ALL) USING (user_id, product_id)
       LEFT JOIN (SELECT product_id, count(*) AS n FROM prior_lines GROUP BY ALL) USING (product_id)""",
)
def _(s):
    """Train pairs with their prior history; most pairs have none."""
    bought = pair_features.prefixed_interactions(s.pairs("prior")).select("user_id", "product_id", "ui_times_bought")
    items = item_features.base_stats(s.pairs("prior")).select("product_id", "item_total_orders")
    wide = pair_features.pairs(s.lines("train")).join(bought, ["user_id", "product_id"], "left")
    return quality.fill_by_group(wide.join(items, "product_id", "left"))


# Projections


@query("p1_column_subset", "SELECT product_id, department_id, aisle_id FROM prod")
def _(s):
    return s.products.select("product_id", "department_id", "aisle_id")


@query(
    "p2_filters",
    f"""SELECT {LINE_SQL}, order_number FROM lines WHERE reordered = 0 AND order_number <= 5
        AND order_id IN (SELECT order_id FROM ord WHERE order_dow = 0)""",
)
def _(s):
    sundays = s.orders.where(F.col("order_dow") == 0).select("order_id")
    early = s.lines().where((F.col("reordered") == 0) & (F.col("order_number") <= 5))
    return early.join(sundays, "order_id", "left_semi").select(
        "order_id", "product_id", "add_to_cart_order", "reordered", "order_number"
    )


@query(
    "p3_safe_ratios",
    f"""SELECT user_id, {ratio('sum(reordered)', 'count(*)', 3)} AS reorder_ratio,
        {ratio('count(*)', 'sum(reordered)', 4)} AS lines_per_reorder FROM lines GROUP BY user_id""",
)
def _(s):
    return s.lines().groupBy("user_id").agg(
        ratio_of(F.sum("reordered"), F.count(F.lit(1)), 3).alias("reorder_ratio"),
        ratio_of(F.count(F.lit(1)), F.sum("reordered"), 4).alias("lines_per_reorder"),
    )


fragment(
    "user_newest", "SELECT user_id, max(order_number) AS user_max, count(*) AS user_orders FROM ord GROUP BY user_id"
)


@query(
    "p4_span_and_distance",
    """SELECT user_id, product_id, max(order_number) - min(order_number) + 1 AS order_span,
       any_value(user_max) - max(order_number) AS orders_since_last_purchase
       FROM lines JOIN user_newest USING (user_id) GROUP BY user_id, product_id""",
)
def _(s):
    return pair_features.interaction_features(s.orders, s.pairs()).select(
        "user_id", "product_id", "order_span", "orders_since_last_purchase"
    )


@query("p6_joined_score", "SELECT user_id, RFM_score FROM rfm_segments")
def _(s):
    return rfm.score_line_metrics(rfm.line_metrics(s.lines())).select("user_id", "RFM_score")


@query("p7_rule_table", "SELECT R_score, F_score, M_score, Segment, count(*) AS n_users FROM rfm_segments GROUP BY ALL")
def _(s):
    return rfm.segment_users(s.lines()).groupBy(*rfm.SCORES, "Segment").agg(long(F.count(F.lit(1))).alias("n_users"))


@query("p8_value_mapping", "SELECT user_id, segment_display FROM customers")
def _(s):
    segments = rfm.segment_users_by_orders(s.orders, s.lines())
    return segments.select("user_id", mapped("Segment", DISPLAY_NAMES, DISPLAY_DEFAULT).alias("segment_display"))


fragment(
    "item_share",
    f"""SELECT product_id, {r('n::DOUBLE / max(n) OVER ()', 6)} AS share
        FROM (SELECT product_id, count(*) AS n FROM lines GROUP BY product_id)""",
)


def item_share(s) -> DataFrame:
    counts = item_features.base_stats(s.pairs()).select("product_id", "item_total_orders")
    most = counts.agg(F.max("item_total_orders").alias("_most"))
    return counts.transform(beside, most).select(
        "product_id", ratio_of("item_total_orders", "_most", 6).alias("share")
    )


@query(
    "p9_confidence",
    "SELECT product_id, CASE WHEN share > 0.6 THEN 'High' WHEN share > 0.3 THEN 'Medium' ELSE 'Low' END AS confidence FROM item_share",
)
def _(s):
    return item_share(s).select("product_id", confidence("share").alias("confidence"))


@query("p10_clamp", "SELECT product_id, greatest(0.2, least(0.8, share)) AS score FROM item_share")
def _(s):
    return item_share(s).select("product_id", clamp("share", 0.2, 0.8).alias("score"))


@query(
    "p11_titles",
    """SELECT product_id, upper(department[1]) || lower(department[2:]) AS department, coalesce(aisle, 'Unknown') AS aisle
       FROM prod""",
)
def _(s):
    return s.catalogue.select(
        "product_id", F.initcap("department").alias("department"), F.coalesce("aisle", F.lit("Unknown")).alias("aisle")
    )


@query(
    "p12_day_names",
    """SELECT ['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][order_dow + 1] AS day,
       count(*) AS n_orders FROM ord GROUP BY ALL""",
)
def _(s):
    return s.orders.groupBy(day_name("order_dow").alias("day")).agg(long(F.count(F.lit(1))).alias("n_orders"))


@query(
    "p13_standard_names",
    """SELECT user_id, frequency AS total_orders, monetary AS total_spent, recency AS days_since_last_order FROM order_segments""",
)
def _(s):
    named = user_features.standard_names(rfm.segment_users_by_orders(s.orders, s.lines()))
    return named.select("user_id", "total_orders", "total_spent", "days_since_last_order")


@query(
    "p14_suffix_merge",
    """SELECT a.user_id, a.frequency, a.monetary, b.frequency AS frequency_feat, b.monetary AS monetary_feat, b.unique_orders
       FROM rfm_orders a LEFT JOIN rfm_lines b USING (user_id)""",
)
def _(s):
    left = rfm.order_metrics(s.orders, s.lines()).select("user_id", "frequency", "monetary")
    right = rfm.line_metrics(s.lines()).select("user_id", "frequency", "monetary", "unique_orders")
    return left.join(facts.rename_clashes(left, right, ["user_id"], "_feat"), "user_id", "left")


@query("p15_binarise", "SELECT product_id, (share > 0.5)::INTEGER AS guess FROM item_share")
def _(s):
    return item_share(s).select("product_id", binarise("share").alias("guess"))


# Joins


@query("j1_order_facts", f"SELECT {ORDER_SQL}, product_id, add_to_cart_order, reordered FROM lines")
def _(s):
    return facts.order_facts(s.orders, s.order_products())


@query("j2_lines_products", f"SELECT {LINE_SQL}, product_name, aisle_id, department_id FROM lines LEFT JOIN prod USING (product_id)")
def _(s):
    return facts.with_products(s.order_products(), s.products)


@query("j3_enriched_products", f"SELECT {PRODUCT_SQL}, aisle, department FROM prod")
def _(s):
    return facts.enrich_products(s.products, s.aisles, s.departments)


@query("j4_enriched_lines", f"SELECT {LINE_SQL}, product_name, aisle_id, department_id, aisle, department FROM lines LEFT JOIN prod USING (product_id)")
def _(s):
    return facts.enrich_lines(s.order_products(), s.products, s.aisles, s.departments)


@query("j5_outer_feature_groups", "SELECT * FROM user_all")
def _(s):
    """All feature groups of all users: order features exist for every user, basket features only for those with lines."""
    return user_features.build(s.orders, s.lines(), s.pairs(), s.catalogue)


@query(
    "j6_items_with_zeros",
    f"SELECT * REPLACE ({r('popularity_rank', 9)} AS popularity_rank, {r('user_reach_rank', 9)} AS user_reach_rank) FROM item_all",
)
def _(s):
    """All feature groups of all products, those never bought with zeros."""
    items = item_features.build(s.lines(), s.pairs(), s.catalogue)
    return items.withColumns({c: rounded(c, 9) for c in ("popularity_rank", "user_reach_rank")})


@query("j7_left_joins", "SELECT * FROM user_wide")
def _(s):
    """Temporal, basket, total and diversity features joined to every user, over the whole history."""
    return user_features.build_prefixed(s.orders, s.lines(), s.pairs(), s.catalogue)


@query(
    "j8_category_stats",
    f"""SELECT product_id, dept_total_orders, dept_avg_reorder_rate FROM prod LEFT JOIN
        (SELECT department_id, count(*) AS dept_total_orders, {ratio('sum(reordered)', 'count(*)', 3)} AS dept_avg_reorder_rate
         FROM lines JOIN prod USING (product_id) GROUP BY department_id) USING (department_id)""",
)
def _(s):
    stats = item_features.category_stats(item_features.base_stats(s.pairs()), s.catalogue, "department_id", "dept")
    return s.products.join(stats, "department_id", "left").select("product_id", "dept_total_orders", "dept_avg_reorder_rate")


@query("j10_train_positives", "SELECT user_id, product_id FROM train_lines")
def _(s):
    return facts.train_positives(s.orders, s.order_products("train"))


@query(
    "j12_popular_not_bought",
    """SELECT u.user_id, p.product_id FROM (SELECT DISTINCT user_id FROM ord) u,
         (SELECT product_id, count(*) AS n FROM lines GROUP BY product_id) p
       ANTI JOIN (SELECT DISTINCT user_id, product_id FROM lines) b ON b.user_id = u.user_id AND b.product_id = p.product_id
       QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY p.n DESC, p.product_id) <= 100""",
)
def _(s):
    """The 100 most popular products that each user does not have."""
    ranked = candidates.popular_items(s.lines())
    users = s.orders.select("user_id").distinct()
    owned = written(pair_features.pairs(s.lines()), "pairs")
    return candidates.missing_from_top(users, owned, ranked, "user_id", 100).select(
        "user_id", "product_id"
    )


@query(
    "j13_last_three_orders",
    f"""SELECT user_id, {LINE_SQL} FROM facts WHERE order_id IN (SELECT order_id FROM ord
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY order_number DESC) <= 3)""",
)
def _(s):
    from cartwheel.functions.ordered import top_per_group

    recent = top_per_group(
        s.orders.select("user_id", "order_id", "order_number"), ["user_id"], [F.desc("order_number")], 3
    ).select("order_id")
    return s.facts.join(recent, "order_id", "left_semi").select(
        "user_id", "order_id", "product_id", "add_to_cart_order", "reordered"
    )
