"""Segmentation and descriptive aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwheel.functions.scalar import rounded
from cartwheel.operators import eda, facts, item_features, rfm, user_features
from cartwheel.plans.ingest import save_segments
from cartwheel.session import new_path
from registry.base import fragment, query, r, ratio

Q = "[0, 0.2, 0.4, 0.6, 0.8, 1.0]"


def _bins(x: str, edges: str) -> str:
    inner = f"list_filter({edges}, lambda e: e > {edges}[1] AND e < {edges}[len({edges})])"
    return f"(1 + len(list_filter({inner}, lambda e: round({x}::DOUBLE, 9) > e)))"


def _edges(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(quantile_cont({x}, {Q}), lambda e: round(e, 9))))"


def _case(r_: str, rows: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in rows) + f" ELSE '{default}' END"


fragment(
    "rfm_lines",
    """
      SELECT user_id, max(order_number) AS max_order_number,
             count(DISTINCT order_number) AS unique_order_numbers,
             min(order_number) AS min_order_number, count(product_id) AS total_products,
             count(DISTINCT order_id) AS unique_orders, avg(reordered) AS reorder_rate,
             avg(days_since_prior_order) AS avg_days_between_orders,
             ((SELECT max(order_number) FROM lines) - max(order_number) + 1)::BIGINT AS recency,
             count(DISTINCT order_id) AS frequency, count(product_id) AS monetary
      FROM lines GROUP BY user_id""",
)
fragment(
    "line_edges",
    f"SELECT {_edges('recency')} AS er, {_edges('frequency')} AS ef, {_edges('monetary')} AS em FROM rfm_lines",
)
fragment(
    "rfm_scored",
    f"""
      SELECT m.*, (greatest(len(er) - 1, 1) + 1 - {_bins('recency', 'er')})::INTEGER AS R_score,
             {_bins('frequency', 'ef')}::INTEGER AS F_score, {_bins('monetary', 'em')}::INTEGER AS M_score
      FROM rfm_lines m, line_edges""",
)
STANDARD = _case(
    "",
    [
        ("Champions", "R_score >= 4 AND F_score >= 4 AND M_score >= 4"),
        ("Loyal_Customers", "R_score >= 4 AND F_score >= 4 AND M_score >= 2"),
        ("Potential_Loyalists", "R_score >= 4 AND F_score >= 2 AND M_score >= 2"),
        ("New_Customers", "R_score >= 4 AND F_score <= 2"),
        ("Promising", "R_score >= 2 AND F_score <= 2 AND M_score >= 4"),
        ("Need_Attention", "R_score >= 2 AND F_score >= 2 AND M_score >= 4"),
        ("About_to_Sleep", "R_score <= 2 AND F_score >= 2 AND M_score >= 2"),
    ],
    "Hibernating",
)
fragment(
    "rfm_segments",
    f"""
      SELECT *, R_score::VARCHAR || F_score::VARCHAR || M_score::VARCHAR AS RFM_score, {STANDARD} AS Segment
      FROM rfm_scored""",
)
fragment(
    "rfm_orders",
    f"""
      SELECT u.user_id, coalesce(u.gap, 365.0) AS recency, u.frequency, v.monetary
      FROM (SELECT user_id, max(order_number)::BIGINT AS frequency, {r('avg(days_since_prior_order)', 2)} AS gap
            FROM ord GROUP BY user_id) u
      LEFT JOIN (SELECT user_id, count(product_id) AS monetary FROM lines GROUP BY user_id) v USING (user_id)""",
)
fragment(
    "order_edges", f"SELECT {_edges('frequency')} AS ef, {_edges('monetary')} AS em FROM rfm_orders"
)
fragment(
    "first_ranks",
    """
      SELECT *, row_number() OVER (ORDER BY recency, user_id) AS rn, count(*) OVER () AS n_all FROM rfm_orders""",
)
fragment(
    "order_scored",
    f"""
      SELECT user_id, recency, frequency, monetary,
             (6 - greatest(1, ((rn - 1) * 5 + (n_all - 2)) // (n_all - 1)))::INTEGER AS R_score,
             {_bins('frequency', 'ef')}::INTEGER AS F_score,
             CASE WHEN monetary IS NOT NULL THEN {_bins('monetary', 'em')}::INTEGER END AS M_score
      FROM first_ranks, order_edges""",
)
DETAILED = _case(
    "",
    [
        ("Champions", "R_score >= 4 AND F_score >= 4 AND M_score >= 4"),
        ("Loyal Customers", "R_score >= 3 AND F_score >= 4 AND M_score >= 3"),
        ("Potential Loyalists", "R_score >= 4 AND F_score >= 2 AND M_score >= 2"),
        ("New Customers", "R_score >= 4 AND F_score = 1"),
        ("Promising", "R_score >= 3 AND F_score >= 2 AND M_score >= 2"),
        ("Need Attention", "R_score >= 3 AND F_score >= 2 AND M_score <= 2"),
        ("About to Sleep", "R_score >= 2 AND F_score >= 2"),
        ("At Risk", "R_score <= 2 AND F_score >= 3"),
        ("Hibernating", "R_score <= 2 AND F_score <= 2 AND M_score >= 3"),
    ],
    "Lost",
)
fragment(
    "order_segments",
    f"""
      SELECT *, R_score::VARCHAR || F_score::VARCHAR || M_score::VARCHAR AS RFM_score, {DETAILED} AS Segment
      FROM order_scored""",
)
DISPLAY = _case(
    "",
    [
        ("🏆 Champions", "f >= 4 AND m >= 4"),
        ("💎 Loyal Customers", "f >= 3 AND m >= 3"),
        ("🌟 New Customers", "r >= 4"),
        ("💪 Potential Loyalists", "f >= 4"),
        ("⚠️ At Risk", "r <= 2"),
    ],
    "😴 Hibernating",
)
RENAMED = """CASE Segment WHEN 'Champions' THEN '🏆 Champions' WHEN 'Loyal Customers' THEN '💎 Loyal Customers'
  WHEN 'New Customers' THEN '🌟 New Customers' WHEN 'Potential Loyalists' THEN '💪 Potential Loyalists'
  WHEN 'At Risk' THEN '⚠️ At Risk' WHEN 'About to Sleep' THEN '😴 Hibernating'
  WHEN 'Need Attention' THEN '⚠️ At Risk' WHEN 'Cannot Lose Them' THEN '🆘 Can''t Lose'
  ELSE '😴 Hibernating' END"""
fragment("customers", f"SELECT *, monetary AS total_spent, {RENAMED} AS segment_display FROM order_segments")


def customers(s):
    named = user_features.standard_names(rfm.segment_users_by_orders(s.orders, s.lines()))
    return rfm.with_display_segment(named)


@query("w1_prepare_order_data", "SELECT facts.*, aisle_id, department_id FROM lines facts LEFT JOIN prod USING (product_id)")
def _(s):
    return facts.prepare_order_data(s.orders, s.order_products("prior"), s.order_products("train"), s.products)


@query(
    "w2_line_metrics",
    f"""SELECT * REPLACE ({r('reorder_rate', 6)} AS reorder_rate,
        {r('avg_days_between_orders', 6)} AS avg_days_between_orders) FROM rfm_lines""",
)
def _(s):
    return rfm.line_metrics(s.lines()).withColumns(
        {c: rounded(c, 6) for c in ("reorder_rate", "avg_days_between_orders")}
    )


@query("w3_order_metrics", "SELECT * FROM rfm_orders")
def _(s):
    return rfm.order_metrics(s.orders, s.lines())


SCORED_COLUMNS = ["user_id", "recency", "frequency", "monetary", "R_score", "F_score", "M_score"]


@query("w4_quantile_scores", f"SELECT {', '.join(SCORED_COLUMNS)} FROM rfm_scored")
def _(s):
    return rfm.score_line_metrics(rfm.line_metrics(s.lines())).select(*SCORED_COLUMNS)


@query("w5_rank_first_scores", f"SELECT {', '.join(SCORED_COLUMNS)} FROM order_scored")
def _(s):
    return rfm.score_order_metrics(rfm.order_metrics(s.orders, s.lines())).select(*SCORED_COLUMNS)


SEGMENT_COLUMNS = ["user_id", "Segment", "RFM_score", "R_score", "F_score", "M_score"]


@query("w6_standard_segments", f"SELECT {', '.join(SEGMENT_COLUMNS)} FROM rfm_segments")
def _(s):
    return rfm.segment_lookup(rfm.segment_users(s.lines()))


@query("w7_detailed_segments", f"SELECT {', '.join(SEGMENT_COLUMNS)} FROM order_segments")
def _(s):
    return rfm.segment_lookup(rfm.segment_users_by_orders(s.orders, s.lines()))


@query(
    "w8_display_segments",
    f"""SELECT user_id, {DISPLAY} AS segment_display FROM
        (SELECT user_id, coalesce(R_score, 3) r, coalesce(F_score, 3) f, coalesce(M_score, 3) m FROM order_scored)""",
)
def _(s):
    scored = rfm.score_order_metrics(rfm.order_metrics(s.orders, s.lines()))
    return rfm.with_display_segment(scored).select("user_id", "segment_display")


def _share(source: str) -> str:
    share = r("count(*) * 100.0 / (SELECT count(*) FROM " + source + ")", 1)
    return f"SELECT Segment AS segment, count(*) AS n_users, {share} AS share_pct FROM {source} GROUP BY Segment"


@query("w9_segment_counts", _share("rfm_segments"))
def segment_counts(s):
    return rfm.segment_counts(rfm.segment_users(s.lines()))


@query("w9_detailed_segment_counts", _share("order_segments"))
def _(s):
    return rfm.segment_counts(rfm.segment_users_by_orders(s.orders, s.lines()))


@query(
    "w10_score_counts",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {m} AS score, count(*) AS n_users FROM rfm_scored GROUP BY {m}"
        for m in rfm.SCORES
    ),
)
def _(s):
    return rfm.score_counts(rfm.score_line_metrics(rfm.line_metrics(s.lines())))


@query(
    "w11_frequency_volume_grid",
    "SELECT F_score, "
    + ", ".join(f"count(*) FILTER (M_score = {m}) AS m_{m}" for m in range(1, 6))
    + " FROM rfm_scored GROUP BY F_score",
)
def _(s):
    return rfm.frequency_volume_grid(rfm.score_line_metrics(rfm.line_metrics(s.lines())))


@query("w12_saved_segments", f"SELECT {', '.join(SEGMENT_COLUMNS)} FROM rfm_segments")
def _(s):
    folder = new_path(s.spark, "segments")
    save_segments(rfm.segment_users(s.lines()), folder)
    return s.spark.read.parquet(f"{folder}/user_segments.parquet")


@query(
    "w13_user_features_with_segments",
    """SELECT user_id, max_no AS user_total_orders, recency, frequency, monetary, R_score, F_score, M_score, RFM_score, Segment
       FROM (SELECT user_id, max(order_number)::BIGINT AS max_no FROM ord GROUP BY user_id) LEFT JOIN order_segments USING (user_id)""",
)
def _(s):
    users = user_features.temporal(s.orders).select("user_id", "user_total_orders")
    return user_features.add_segments(users, rfm.segment_users_by_orders(s.orders, s.lines()))


@query(
    "a1_overview",
    """SELECT (SELECT count(DISTINCT user_id) FROM ord) AS n_users, (SELECT count(*) FROM ord) AS n_orders,
       (SELECT count(*) FROM lines) AS n_lines, (SELECT count(*) FROM prod) AS n_products""",
)
def _(s):
    return eda.overview(s.orders, s.lines(), s.products)


@query("a2_eval_set_counts", "SELECT eval_set, count(*) AS n_orders FROM ord GROUP BY eval_set")
def _(s):
    return eda.counts_by(s.orders, "eval_set")


@query(
    "a3_order_size_stats",
    f"""SELECT {r('avg(n)', 4)} AS avg_order_size, median(n)::DOUBLE AS median_order_size, max(n) AS max_order_size,
        (SELECT {r('avg(c)', 4)} FROM (SELECT count(*) c FROM ord GROUP BY user_id)) AS avg_orders_per_user,
        (SELECT max(order_number)::BIGINT FROM ord) AS max_order_number
        FROM (SELECT count(*) n FROM lines GROUP BY order_id)""",
)
def _(s):
    return eda.order_size_stats(s.orders, s.lines())


@query("a4_orders_by_hour", "SELECT order_hour_of_day, count(*) AS n_orders FROM ord GROUP BY ALL")
def _(s):
    return eda.counts_by(s.orders, "order_hour_of_day")


@query("a4_orders_by_day", "SELECT order_dow, count(*) AS n_orders FROM ord GROUP BY ALL")
def _(s):
    return eda.counts_by(s.orders, "order_dow")


@query(
    "a4_peak_hour",
    "SELECT order_hour_of_day, count(*) AS n_orders FROM ord GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 1",
)
def _(s):
    return eda.peak(s.orders, "order_hour_of_day")


@query("a4_peak_day", "SELECT order_dow, count(*) AS n_orders FROM ord GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 1")
def _(s):
    return eda.peak(s.orders, "order_dow")


@query(
    "a5_reorder_summary",
    f"""SELECT {r('avg(reordered)', 4)} AS reorder_rate, count(*) FILTER (reordered = 1) AS n_reordered,
        count(*) FILTER (reordered = 0) AS n_first_time FROM lines""",
)
def _(s):
    return eda.reorder_summary(s.lines())


for _category, _k in (("department", 5), ("aisle", 10)):

    @query(f"a6_lines_by_{_category}", f"SELECT {_category}, count(*) AS n_lines FROM lines JOIN prod USING (product_id) GROUP BY ALL")
    def _(s, category=_category):
        return eda.lines_by_category(s.lines(), s.catalogue, category)

    @query(
        f"a6_top_{_category}s",
        f"SELECT {_category}, count(*) AS n_lines FROM lines JOIN prod USING (product_id) GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT {_k}",
    )
    def _(s, category=_category, k=_k):
        return eda.top_categories(s.lines(), s.catalogue, category, k)


@query(
    "a7_order_size_histogram",
    """SELECT coalesce(least(floor((n - low)::DOUBLE * 50 / nullif(high - low, 0)), 49), 0)::INTEGER AS bin, count(*) AS n_values
       FROM (SELECT n, min(n) OVER () AS low, max(n) OVER () AS high FROM (SELECT count(*) n FROM lines GROUP BY order_id))
       GROUP BY ALL""",
)
def _(s):
    return eda.histogram(eda.order_sizes(s.lines()), "order_size", 50)


@query(
    "a7_score_histograms",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS model, coalesce(least(floor(({m} - low)::DOUBLE * 20 / nullif(high - low, 0)), 19), 0)::INTEGER AS bin,
          count(*) AS n_values FROM (SELECT {m}, min({m}) OVER () AS low, max({m}) OVER () AS high FROM scored) GROUP BY ALL"""
        for m in ("popular", "recent", "habit")
    ),
)
def _(s):
    """How the scores of every model are spread."""
    from registry.candidates import scored

    rows = scored(s)
    parts = [eda.histogram(rows, m, 20).select(F.lit(m).alias("model"), "bin", "n_values") for m in ("popular", "recent", "habit")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


fragment(
    "item_kpi",
    f"""
      SELECT product_id, product_name, department, coalesce(n, 0) AS item_total_orders, coalesce(rate, 0) AS item_reorder_rate
      FROM prod LEFT JOIN (SELECT product_id, count(*) AS n, {ratio('sum(reordered)', 'count(*)', 3)} AS rate
                           FROM lines GROUP BY product_id) USING (product_id)""",
)


def item_kpis(s):
    stats = item_features.base_stats(s.pairs()).select("product_id", "item_total_orders", "item_reorder_rate")
    return s.catalogue.join(stats, "product_id", "left").fillna(0, ["item_total_orders", "item_reorder_rate"])


@query(
    "a8_department_kpis",
    f"""SELECT department, sum(item_total_orders)::BIGINT AS total_orders, {r('avg(item_reorder_rate)', 4)} AS avg_reorder_rate,
        count(*) AS product_count FROM item_kpi GROUP BY department ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(s):
    return eda.department_kpis(item_kpis(s))


@query(
    "a9_top_reorder_products",
    """SELECT product_id, product_name, department, item_reorder_rate FROM item_kpi
       ORDER BY item_reorder_rate DESC, product_id LIMIT 10""",
)
def _(s):
    return eda.top_reorder_products(item_kpis(s))


@query(
    "a10_headline_kpis",
    f"""SELECT (SELECT count(*) FROM customers) AS n_customers, (SELECT count(*) FROM ord) AS n_orders,
        (SELECT {r('avg(b)', 4)} FROM (SELECT coalesce(b, 0) AS b FROM customers LEFT JOIN
           (SELECT user_id, {r('avg(n)', 2)} AS b FROM (SELECT user_id, count(*) n FROM lines GROUP BY user_id, order_id)
            GROUP BY user_id) USING (user_id))) AS avg_basket_size,
        (SELECT {r('avg(item_reorder_rate)', 4)} FROM item_kpi) AS avg_reorder_rate,
        (SELECT sum(total_spent)::BIGINT FROM customers) AS total_spent""",
)
def _(s):
    baskets = user_features.basket(s.lines()).select("user_id", "user_avg_basket_size")
    people = customers(s).join(baskets, "user_id", "left").fillna(0, ["user_avg_basket_size"])
    return eda.headline_kpis(people, s.orders, item_kpis(s))


@query(
    "a11_champion_share",
    f"""SELECT count(*) AS n_customers, count(*) FILTER (t) AS n_champions,
        {r('100.0 * count(*) FILTER (t) / count(*)', 1)} AS champion_pct,
        {r('avg(total_spent) FILTER (t)', 4)} AS avg_spent_champions, {r('avg(total_spent)', 4)} AS avg_spent_overall
        FROM (SELECT *, segment_display = '🏆 Champions' AS t FROM customers)""",
)
def _(s):
    return rfm.champion_share(customers(s))


@query("a12_filter_options", "SELECT DISTINCT department FROM prod")
def _(s):
    return eda.filter_options(s.catalogue)


@query(
    "a12_user_id_range",
    "SELECT min(user_id) AS min_user_id, max(user_id) AS max_user_id, count(DISTINCT user_id) AS n_known_users FROM ord",
)
def _(s):
    return eda.user_id_range(s.orders)


@query(
    "a12_department_filter",
    "SELECT product_id, product_name, aisle, department FROM prod WHERE department IN ('ECONOMY', 'PROMO')",
)
def _(s):
    return eda.in_departments(s.catalogue, ["ECONOMY", "PROMO"]).select(
        "product_id", "product_name", "aisle", "department"
    )
