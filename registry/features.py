"""User, item and user x item features."""

from __future__ import annotations

from cartwheel.functions.scalar import rounded
from cartwheel.operators import item_features, pair_features, user_features
from cartwheel.session import staged
from registry.base import fragment, query, r, ratio, std

GAP = "days_since_prior_order"

fragment(
    "u1",
    f"""
      SELECT user_id, count(*) AS total_orders, max(order_number) AS max_order_number,
             {r('avg(order_number)', 4)} AS avg_order_number, coalesce({r(f'avg({GAP})', 4)}, 0) AS avg_days_since_prior,
             {std(GAP, 4)} AS std_days_since_prior, coalesce(min({GAP}), 0) AS min_days_since_prior,
             coalesce(max({GAP}), 0) AS max_days_since_prior, any_value(d.order_dow) AS preferred_dow,
             any_value(h.order_hour_of_day) AS preferred_hour
      FROM ord
      JOIN (SELECT user_id, order_dow FROM ord GROUP BY user_id, order_dow
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, order_dow) = 1) d USING (user_id)
      JOIN (SELECT user_id, order_hour_of_day FROM ord GROUP BY user_id, order_hour_of_day
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, order_hour_of_day) = 1) h USING (user_id)
      GROUP BY user_id""",
)
fragment("sizes", "SELECT user_id, order_id, count(*) AS n FROM lines GROUP BY ALL")


def _spread(prefix: str, digits: int) -> str:
    return f"""{r('avg(n)', digits)} AS {prefix}avg_basket_size, {std('n', digits)} AS {prefix}std_basket_size,
      min(n) AS {prefix}min_basket_size, max(n) AS {prefix}max_basket_size,
      {r('median(n)', digits)} AS {prefix}median_basket_size"""


fragment("u2", f"SELECT user_id, {_spread('', 4)} FROM sizes GROUP BY user_id")
fragment(
    "u3",
    f"""
      SELECT user_id, count(DISTINCT product_id) AS unique_products, {r('avg(reordered)', 4)} AS reorder_rate,
             sum(reordered)::BIGINT AS total_reorders, {r('avg(add_to_cart_order)', 4)} AS avg_cart_position,
             {std('add_to_cart_order', 4)} AS std_cart_position
      FROM lines GROUP BY user_id""",
)


def _top(c: str) -> str:
    return f"""(SELECT user_id, count(*) AS unique_{c}s, first({c} ORDER BY n DESC, {c}) AS top_{c}
       FROM (SELECT user_id, {c}, count(*) AS n FROM lines JOIN prod USING (product_id) GROUP BY ALL) GROUP BY user_id)"""


fragment("u4", f"SELECT * FROM {_top('department')} JOIN {_top('aisle')} USING (user_id)")
fragment(
    "user_all",
    "SELECT * FROM u1 FULL OUTER JOIN u2 USING (user_id) FULL OUTER JOIN u3 USING (user_id) FULL OUTER JOIN u4 USING (user_id)",
)


@query("u1_order_patterns", "SELECT * FROM u1")
def _(s):
    return user_features.order_patterns(s.orders)


@query("u2_basket_patterns", "SELECT * FROM u2")
def _(s):
    return user_features.basket_patterns(s.lines())


@query("u3_product_patterns", "SELECT * FROM u3")
def _(s):
    return user_features.product_patterns(s.pairs())


@query("u4_department_aisle", "SELECT * FROM u4")
def _(s):
    return user_features.department_aisle(s.pairs(), s.catalogue)


@query("u_all_groups", "SELECT * FROM user_all")
def _(s):
    return user_features.build(s.orders, s.lines(), s.pairs(), s.catalogue)


fragment(
    "u5",
    f"""
      SELECT user_id, max(order_number)::BIGINT AS user_total_orders,
             {r('avg(order_dow)', 2)} AS user_avg_dow, {std('order_dow', 2)} AS user_std_dow,
             count(DISTINCT order_dow) AS user_unique_dow,
             {r('avg(order_hour_of_day)', 2)} AS user_avg_hour, {std('order_hour_of_day', 2)} AS user_std_hour,
             count(DISTINCT order_hour_of_day) AS user_unique_hours,
             coalesce({r(f'avg({GAP})', 2)}, 0) AS user_avg_days_between_orders, {std(GAP, 2)} AS user_std_days_between_orders,
             coalesce(min({GAP}), 0) AS user_min_days_between_orders, coalesce(max({GAP}), 0) AS user_max_days_between_orders
      FROM ord GROUP BY user_id""",
)
fragment("u6", f"SELECT user_id, {_spread('user_', 2)} FROM sizes GROUP BY user_id")
fragment(
    "u7",
    f"""
      SELECT user_id, count(product_id) AS user_total_products, count(DISTINCT product_id) AS user_unique_products,
             {r('avg(reordered)', 3)} AS user_reorder_rate, sum(reordered)::BIGINT AS user_total_reorders,
             count(reordered) AS user_total_order_items
      FROM lines GROUP BY user_id""",
)
fragment(
    "u9",
    f"""
      SELECT user_id, count(DISTINCT department_id) AS user_unique_departments, count(DISTINCT aisle_id) AS user_unique_aisles,
             {ratio('count(DISTINCT department_id)', '(SELECT count(DISTINCT department_id) FROM prod)', 3)} AS user_dept_exploration,
             {ratio('count(DISTINCT aisle_id)', '(SELECT count(DISTINCT aisle_id) FROM prod)', 3)} AS user_aisle_exploration
      FROM lines JOIN prod USING (product_id) GROUP BY user_id""",
)

@query("u5_temporal", "SELECT * FROM u5")
def _(s):
    return user_features.temporal(s.orders)


@query("u6_basket", "SELECT * FROM u6")
def _(s):
    return user_features.basket(s.lines())


@query(
    "u7_totals_and_ratios",
    f"""SELECT user_id, user_total_products, user_unique_products, user_reorder_rate, user_total_reorders, user_total_order_items,
        {ratio('user_total_products', 'user_total_orders', 2)} AS user_avg_products_per_order,
        {ratio('user_unique_products', 'user_total_products', 3)} AS user_product_discovery_rate,
        {ratio('user_total_reorders', 'user_total_order_items', 3)} AS user_reorder_ratio
        FROM u5 JOIN u7 USING (user_id)""",
)
def _(s):
    orders = user_features.temporal(s.orders).select("user_id", "user_total_orders")
    wide = user_features.totals(s.pairs()).join(orders, "user_id")
    return user_features.with_ratios(wide).drop("user_total_orders")


@query("u8_reorder", "SELECT user_id, user_reorder_rate, user_total_reorders, user_total_order_items FROM u7")
def _(s):
    return user_features.totals(s.pairs()).select(
        "user_id", "user_reorder_rate", "user_total_reorders", "user_total_order_items"
    )


@query("u9_diversity", "SELECT * FROM u9")
def _(s):
    return user_features.diversity(s.pairs(), s.catalogue)


USER_WIDE = """user_id user_total_orders user_avg_dow user_std_dow user_unique_dow user_avg_hour user_std_hour user_unique_hours
  user_avg_days_between_orders user_std_days_between_orders user_min_days_between_orders user_max_days_between_orders""".split()
USER_FILLED = """user_avg_basket_size user_std_basket_size user_min_basket_size user_max_basket_size user_median_basket_size
  user_total_products user_unique_products user_reorder_rate user_total_reorders user_total_order_items
  user_unique_departments user_unique_aisles user_dept_exploration user_aisle_exploration""".split()
fragment(
    "user_wide",
    f"""
      SELECT {', '.join('u5.' + c for c in USER_WIDE)}, {', '.join(f'coalesce({c}, 0) AS {c}' for c in USER_FILLED)},
             {ratio('user_total_products', 'user_total_orders', 2)} AS user_avg_products_per_order,
             {ratio('user_unique_products', 'user_total_products', 3)} AS user_product_discovery_rate,
             {ratio('user_total_reorders', 'user_total_order_items', 3)} AS user_reorder_ratio
      FROM u5 LEFT JOIN u6 USING (user_id) LEFT JOIN u7 USING (user_id) LEFT JOIN u9 USING (user_id)""",
)


@query("u_prefixed_features", "SELECT * FROM user_wide")
def _(s):
    return user_features.build_prefixed(s.orders, s.lines(), s.pairs(), s.catalogue)


# Items

fragment(
    "i1",
    f"""
      SELECT product_id, count(DISTINCT order_id) AS total_orders, count(DISTINCT user_id) AS total_users,
             {r('avg(add_to_cart_order)', 4)} AS avg_cart_position, {std('add_to_cart_order', 4)} AS std_cart_position,
             {ratio('count(DISTINCT order_id)', 'count(DISTINCT user_id)', 4)} AS orders_per_user
      FROM lines GROUP BY product_id""",
)


def _pct(c: str) -> str:
    return f"""(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"""


fragment("i2", f"SELECT *, ({_pct('total_orders')})::DOUBLE AS popularity_rank, ({_pct('total_users')})::DOUBLE AS user_reach_rank FROM i1")
fragment(
    "i3",
    f"""
      SELECT product_id, {r('avg(reordered)', 4)} AS reorder_rate, sum(reordered)::BIGINT AS total_reorders,
             count(*) AS total_purchases, count(*) FILTER (reordered = 0) AS first_purchase_count
      FROM lines GROUP BY product_id""",
)
fragment(
    "i4",
    f"""
      SELECT product_id, coalesce({r('avg(m) FILTER (order_number <= 5)', 6)}, 0) AS early_reorder_rate,
             coalesce({r('avg(m) FILTER (order_number > 5)', 6)}, 0) AS late_reorder_rate
      FROM (SELECT product_id, order_number, avg(reordered) AS m FROM lines GROUP BY ALL) GROUP BY product_id""",
)
fragment(
    "i5",
    f"""
      SELECT product_id, {std('m', 6)} AS reorder_consistency
      FROM (SELECT product_id, user_id, avg(reordered) AS m FROM lines GROUP BY ALL) GROUP BY product_id""",
)
fragment(
    "i_reorder",
    f"""
      SELECT *, {ratio('total_reorders', 'first_purchase_count', 6)} AS reorder_to_first_ratio
      FROM i3 JOIN i4 USING (product_id) JOIN i5 USING (product_id)""",
)
fragment(
    "i7",
    """
      SELECT product_id, aisle_id, department_id, aisle, department,
             (dense_rank() OVER (ORDER BY aisle_id) - 1)::INTEGER AS aisle_encoded,
             (dense_rank() OVER (ORDER BY department_id) - 1)::INTEGER AS department_encoded
      FROM prod""",
)
ITEM_FILLED = """total_orders total_users avg_cart_position std_cart_position orders_per_user popularity_rank user_reach_rank
  reorder_rate total_reorders total_purchases first_purchase_count early_reorder_rate late_reorder_rate reorder_consistency
  reorder_to_first_ratio""".split()
fragment(
    "item_all",
    f"""
      SELECT i7.*, product_name, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ITEM_FILLED)}
      FROM i7 JOIN (SELECT product_id, product_name FROM prod) USING (product_id)
      LEFT JOIN i2 USING (product_id) LEFT JOIN i_reorder USING (product_id)""",
)


def _ranks(df):
    return df.withColumns({c: rounded(c, 9) for c in ("popularity_rank", "user_reach_rank")})


@query("i1_popularity", "SELECT * FROM i1")
def _(s):
    return item_features.popularity_counts(s.pairs())


@query(
    "i2_popularity_rank",
    f"SELECT product_id, {r('popularity_rank', 9)} AS popularity_rank, {r('user_reach_rank', 9)} AS user_reach_rank FROM i2",
)
def _(s):
    return _ranks(item_features.popularity(s.pairs())).select("product_id", "popularity_rank", "user_reach_rank")


@query("i3_reorder_basics", "SELECT product_id, reorder_rate, total_reorders, total_purchases FROM i3")
def _(s):
    return item_features.reorder_basics(s.pairs()).drop("first_purchase_count")


@query("i4_reorder_stages", "SELECT * FROM i4")
def _(s):
    return item_features.reorder_stages(s.lines())


@query("i5_reorder_consistency", "SELECT * FROM i5")
def _(s):
    return item_features.reorder_consistency(s.pairs())


@query("i6_first_purchases", "SELECT product_id, first_purchase_count, reorder_to_first_ratio FROM i_reorder")
def _(s):
    return item_features.reorder_patterns(s.lines(), s.pairs()).select(
        "product_id", "first_purchase_count", "reorder_to_first_ratio"
    )


@query("i7_category_codes", "SELECT * FROM i7")
def _(s):
    return item_features.category_codes(s.catalogue)


@query(
    "i_all_groups",
    f"SELECT * REPLACE ({r('popularity_rank', 9)} AS popularity_rank, {r('user_reach_rank', 9)} AS user_reach_rank) FROM item_all",
)
def _(s):
    return _ranks(item_features.build(s.lines(), s.pairs(), s.catalogue))


fragment(
    "i8",
    f"""
      SELECT product_id, count(*) AS item_total_orders, count(DISTINCT order_id) AS item_unique_orders,
             {r('avg(add_to_cart_order)', 3)} AS item_avg_cart_position, {std('add_to_cart_order', 3)} AS item_std_cart_position,
             min(add_to_cart_order)::BIGINT AS item_min_cart_position, max(add_to_cart_order)::BIGINT AS item_max_cart_position,
             {r('avg(reordered)', 3)} AS item_reorder_rate, sum(reordered)::BIGINT AS item_total_reorders,
             count(DISTINCT user_id) AS item_unique_users,
             {ratio('sum(reordered)', 'count(*)', 3)} AS item_reorder_probability,
             {ratio('count(DISTINCT user_id)', '(SELECT count(DISTINCT user_id) FROM ord)', 6)} AS item_user_penetration
      FROM lines GROUP BY product_id""",
)
fragment(
    "dept_stats",
    f"""
      SELECT department_id, count(*) AS dept_total_orders, {ratio('sum(reordered)', 'count(*)', 3)} AS dept_avg_reorder_rate
      FROM lines JOIN prod USING (product_id) GROUP BY department_id""",
)
fragment(
    "aisle_stats",
    f"""
      SELECT aisle_id, count(*) AS aisle_total_orders, {ratio('sum(reordered)', 'count(*)', 3)} AS aisle_avg_reorder_rate
      FROM lines JOIN prod USING (product_id) GROUP BY aisle_id""",
)
ITEM_BASE = """item_total_orders item_unique_orders item_avg_cart_position item_std_cart_position item_min_cart_position
  item_max_cart_position item_reorder_rate item_total_reorders item_unique_users item_reorder_probability
  item_user_penetration dept_total_orders dept_avg_reorder_rate aisle_total_orders aisle_avg_reorder_rate""".split()


def _dense(key: str) -> str:
    return f"""CASE WHEN item_total_orders IS NULL THEN 0 ELSE dense_rank() OVER
      (PARTITION BY {key}, item_total_orders IS NULL ORDER BY item_total_orders DESC) END"""


fragment(
    "item_wide",
    f"""
      SELECT prod.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ITEM_BASE)},
             {_dense('department_id')} AS item_dept_popularity_rank, {_dense('aisle_id')} AS item_aisle_popularity_rank,
             coalesce({r('item_reorder_rate - dept_avg_reorder_rate', 3)}, 0) AS item_vs_dept_reorder_rate,
             coalesce({r('item_reorder_rate - aisle_avg_reorder_rate', 3)}, 0) AS item_vs_aisle_reorder_rate
      FROM prod LEFT JOIN i8 USING (product_id) LEFT JOIN dept_stats USING (department_id) LEFT JOIN aisle_stats USING (aisle_id)""",
)


def _item_wide(s):
    return item_features.build_prefixed(s.pairs(), s.orders, s.catalogue)


@query("i8_item_stats", f"SELECT * EXCLUDE (item_user_penetration) FROM i8")
def _(s):
    return item_features.base_stats(s.pairs())


@query("i9_reach", "SELECT product_id, item_unique_users, item_user_penetration FROM i8")
def _(s):
    return item_features.with_reach(item_features.base_stats(s.pairs()), s.orders).select(
        "product_id", "item_unique_users", "item_user_penetration"
    )


@query(
    "i10_category_stats",
    "SELECT product_id, dept_total_orders, dept_avg_reorder_rate, aisle_total_orders, aisle_avg_reorder_rate FROM item_wide",
)
def _(s):
    return _item_wide(s).select(
        "product_id", "dept_total_orders", "dept_avg_reorder_rate", "aisle_total_orders", "aisle_avg_reorder_rate"
    )


@query("i11_rank_in_category", "SELECT product_id, item_dept_popularity_rank, item_aisle_popularity_rank FROM item_wide")
def _(s):
    return _item_wide(s).select("product_id", "item_dept_popularity_rank", "item_aisle_popularity_rank")


@query("i12_versus_category", "SELECT product_id, item_vs_dept_reorder_rate, item_vs_aisle_reorder_rate FROM item_wide")
def _(s):
    return _item_wide(s).select("product_id", "item_vs_dept_reorder_rate", "item_vs_aisle_reorder_rate")


@query("i_prefixed_features", "SELECT * FROM item_wide")
def _(s):
    return _item_wide(s)


# User x item

fragment(
    "x2",
    f"""
      SELECT user_id, product_id, count(DISTINCT order_id) AS user_item_orders, sum(reordered)::BIGINT AS user_item_reorders,
             {r('avg(add_to_cart_order)', 4)} AS avg_cart_position, {std('add_to_cart_order', 4)} AS std_cart_position,
             min(add_to_cart_order) AS min_cart_position, max(add_to_cart_order) AS max_cart_position,
             min(order_number) AS first_order_number, max(order_number) AS last_order_number,
             {r('avg(order_number)', 4)} AS avg_order_number, coalesce({r(f'avg({GAP})', 4)}, 0) AS avg_days_between_orders
      FROM lines GROUP BY ALL""",
)
fragment(
    "x3",
    f"""
      SELECT *, last_order_number - first_order_number + 1 AS order_span,
             {ratio('user_item_reorders', 'user_item_orders', 6)} AS user_item_reorder_rate,
             {ratio('user_item_orders', 'last_order_number - first_order_number + 1', 6)} AS purchase_frequency
      FROM x2""",
)
fragment("user_orders", "SELECT user_id, max(order_number) AS user_max_order, count(*) AS user_total_orders FROM ord GROUP BY user_id")
fragment(
    "x4",
    f"""
      SELECT x3.*, user_max_order, user_total_orders, user_max_order - last_order_number AS orders_since_last_purchase,
             {ratio('user_item_orders', 'user_total_orders', 6)} AS user_item_order_ratio
      FROM x3 JOIN user_orders USING (user_id)""",
)
fragment(
    "x5",
    f"""
      SELECT user_id, product_id, count(*) AS ui_times_bought, sum(reordered)::BIGINT AS ui_times_reordered,
             {r('avg(reordered)', 3)} AS ui_reorder_rate, {r('avg(add_to_cart_order)', 3)} AS ui_avg_cart_position,
             {std('add_to_cart_order', 3)} AS ui_std_cart_position, min(add_to_cart_order) AS ui_min_cart_position,
             min(order_number) AS ui_first_order_number, max(order_number) AS ui_last_order_number,
             {r('avg(order_number)', 3)} AS ui_avg_order_number, max(order_number) - min(order_number) + 1 AS ui_order_span,
             {ratio('count(*)', 'max(order_number) - min(order_number) + 1', 3)} AS ui_purchase_frequency,
             any_value(newest) - max(order_number) AS ui_orders_since_last_purchase
      FROM lines JOIN (SELECT user_id, max(order_number) AS newest FROM lines GROUP BY user_id) USING (user_id)
      GROUP BY user_id, product_id""",
)


@query("x1_user_item_pairs", "SELECT DISTINCT user_id, product_id FROM lines")
def _(s):
    return pair_features.pairs(s.lines())


@query("x2_interactions", "SELECT * FROM x2")
def _(s):
    return pair_features.interactions(s.pairs())


X3 = ["order_span", "user_item_reorder_rate", "purchase_frequency"]
X4 = ["user_max_order", "orders_since_last_purchase", "user_total_orders", "user_item_order_ratio"]


@query("x3_derived", f"SELECT user_id, product_id, {', '.join(X3)} FROM x3")
def _(s):
    return pair_features.derived(pair_features.interactions(s.pairs())).select("user_id", "product_id", *X3)


@query("x4_recency_and_share", f"SELECT user_id, product_id, {', '.join(X4)} FROM x4")
def _(s):
    return pair_features.interaction_features(s.orders, s.pairs()).select("user_id", "product_id", *X4)


@query("x5_prefixed_interactions", "SELECT * FROM x5")
def _(s):
    return pair_features.prefixed_interactions(s.pairs())


CROSS_SQL = {
    "basket_size_item_popularity": r("u.avg_basket_size * i.total_orders", 4),
    "user_item_reorder_alignment": r("u.reorder_rate * i.reorder_rate", 4),
    "user_order_frequency": r("1.0 / (u.avg_days_since_prior + 1)", 4),
    "user_item_frequency_match": r("1.0 / (u.avg_days_since_prior + 1) * x.purchase_frequency", 4),
    "diversity_ubiquity": ratio("u.unique_products", "i.total_users + 1", 4),
    "dept_exploration_vs_item_dept": r("u.unique_departments * i.department_encoded", 4),
}
CROSS_KEYS = {
    "basket_size_item_popularity": "ca",
    "user_item_reorder_alignment": "cb",
    "user_order_frequency": "cc",
    "user_item_frequency_match": "cd",
    "diversity_ubiquity": "ce",
    "dept_exploration_vs_item_dept": "cf",
}
CROSS_FROM = "FROM x4 x LEFT JOIN user_all u USING (user_id) LEFT JOIN item_all i USING (product_id)"


def wide_tables(s):
    """The user and item tables, saved once: Spark then joins tables of known size."""
    users = staged(
        s.spark, ("user_features", *s.source),
        lambda: user_features.build(s.orders, s.lines(), s.pairs(), s.catalogue),
    )
    items = staged(
        s.spark, ("item_features", *s.source),
        lambda: item_features.build(s.lines(), s.pairs(), s.catalogue),
    )
    return users, items


def _pairs_wide(s):
    return pair_features.build(s.orders, s.pairs(), *wide_tables(s))


for _name, _key in CROSS_KEYS.items():

    @query(f"{_key}_{_name}", f"SELECT user_id, product_id, {CROSS_SQL[_name]} AS {_name} {CROSS_FROM}")
    def _(s, name=_name):
        return _pairs_wide(s).select("user_id", "product_id", name)


X6_UI = [c for c in """user_item_orders user_item_reorders avg_cart_position std_cart_position min_cart_position max_cart_position
  first_order_number last_order_number avg_order_number avg_days_between_orders order_span user_item_reorder_rate purchase_frequency
  user_max_order user_total_orders orders_since_last_purchase user_item_order_ratio""".split()]
X6_USER = """total_orders max_order_number avg_order_number avg_days_since_prior std_days_since_prior min_days_since_prior
  max_days_since_prior preferred_dow preferred_hour avg_basket_size std_basket_size min_basket_size max_basket_size
  median_basket_size unique_products reorder_rate total_reorders avg_cart_position std_cart_position unique_departments
  top_department unique_aisles top_aisle""".split()
X6_ITEM = """product_name total_orders total_users avg_cart_position std_cart_position orders_per_user reorder_rate total_reorders
  total_purchases first_purchase_count early_reorder_rate late_reorder_rate reorder_consistency reorder_to_first_ratio aisle_id
  department_id aisle department aisle_encoded department_encoded""".split()


@query(
    "x6_user_item_features",
    f"""SELECT user_id, product_id, {', '.join(f'x.{c} AS ui_{c}' for c in X6_UI)},
        {', '.join(f'u.{c} AS user_{c}' for c in X6_USER)}, {', '.join(f'i.{c} AS item_{c}' for c in X6_ITEM)},
        {r('i.popularity_rank', 9)} AS item_popularity_rank, {r('i.user_reach_rank', 9)} AS item_user_reach_rank,
        {', '.join(f'{v} AS {k}' for k, v in CROSS_SQL.items())} {CROSS_FROM}""",
)
def _(s):
    return _pairs_wide(s).withColumns({c: rounded(c, 9) for c in ("item_popularity_rank", "item_user_reach_rank")})
