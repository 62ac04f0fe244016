"""Recency / frequency / basket volume segmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions import rules
from cartwheel.functions.quantile import add_scores, rank_first_score
from cartwheel.functions.scalar import beside, long, mapped, ratio, rounded
from cartwheel.session import written

SCORES = ("R_score", "F_score", "M_score")
SINGLE_ORDER_RECENCY = 365.0


def line_metrics(facts: DataFrame) -> DataFrame:
    """Per user over order lines; recency counts back from the highest order number.

    Lines are first summed per (user, order): the distinct counts of the second
    step then see one row per order and need no row expansion.
    """
    per_order = facts.groupBy("user_id", "order_id", "order_number").agg(
        F.count("product_id").alias("_lines"),
        F.sum("reordered").alias("_again"),
        F.count("reordered").alias("_flags"),
        F.sum("days_since_prior_order").alias("_gap"),
        F.count("days_since_prior_order").alias("_gaps"),
    )
    users = per_order.groupBy("user_id").agg(
        F.max("order_number").alias("max_order_number"),
        long(F.count_distinct("order_number")).alias("unique_order_numbers"),
        F.min("order_number").alias("min_order_number"),
        long(F.sum("_lines")).alias("total_products"),
        long(F.count(F.lit(1))).alias("unique_orders"),
        F.try_divide(F.sum("_again").cast("double"), F.sum("_flags").cast("double")).alias("reorder_rate"),
        F.try_divide(F.sum("_gap"), F.sum("_gaps").cast("double")).alias("avg_days_between_orders"),
    )
    newest = facts.agg(F.max("order_number").alias("_newest"))
    return (
        users.transform(beside, newest)
        .withColumn("recency", long(F.col("_newest") - F.col("max_order_number") + 1))
        .withColumn("frequency", F.col("unique_orders"))
        .withColumn("monetary", F.col("total_products"))
        .drop("_newest")
    )


def order_metrics(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Per user over orders; users without any line keep a null volume."""
    users = orders.groupBy("user_id").agg(
        long(F.max("order_number")).alias("frequency"),
        rounded(F.avg("days_since_prior_order"), 2).alias("_gap"),
    )
    volume = lines.groupBy("user_id").agg(long(F.count("product_id")).alias("monetary"))
    return users.join(volume, "user_id", "left").select(
        "user_id",
        F.coalesce("_gap", F.lit(SINGLE_ORDER_RECENCY)).alias("recency"),
        "frequency",
        "monetary",
    )


def _joined_score() -> Column:
    return F.concat(*[F.col(s).cast("string") for s in SCORES])


def score_line_metrics(metrics: DataFrame, quantiles: int = 5, on_ties: str = "compress") -> DataFrame:
    """Scores from quantile edges. The per-user table is written first: edges and scores both read it."""
    metrics = written(metrics, "line-metrics")
    scored = add_scores(
        metrics,
        quantiles,
        {"R_score": ("recency", True), "F_score": ("frequency", False), "M_score": ("monetary", False)},
        on_ties,
    )
    return scored.withColumn("RFM_score", _joined_score())


def score_order_metrics(metrics: DataFrame, quantiles: int = 5) -> DataFrame:
    """R from the first-come rank (equal-count bins), F and M from quantile edges.

    The per-user table is written first: the rank over all users takes several passes.
    """
    metrics = written(metrics, "order-metrics")
    ranked = rank_first_score(metrics, "recency", "user_id", quantiles, "R_score", reverse=True)
    scored = add_scores(ranked, quantiles, {"F_score": ("frequency", False), "M_score": ("monetary", False)})
    return scored.withColumn("RFM_score", _joined_score())


def standard_segment() -> Column:
    return rules.label(rules.STANDARD_RULES, rules.STANDARD_DEFAULT, *[F.col(s) for s in SCORES])


def detailed_segment() -> Column:
    return rules.label(rules.DETAILED_RULES, rules.DETAILED_DEFAULT, *[F.col(s) for s in SCORES])


def display_segment(columns: Sequence[str]) -> Column:
    """Dashboard label from the scores; a score that is missing counts as 3."""
    score = [F.coalesce(F.col(s), F.lit(3)) if s in columns else F.lit(3) for s in SCORES]
    return rules.label(rules.DISPLAY_RULES, rules.DISPLAY_DEFAULT, *score)


def display_name(segment: Column | str) -> Column:
    return mapped(segment, rules.DISPLAY_NAMES, rules.DISPLAY_DEFAULT)


def with_display_segment(customers: DataFrame) -> DataFrame:
    """A stored segment is renamed; otherwise the label is worked out."""
    label = display_name("Segment") if "Segment" in customers.columns else display_segment(customers.columns)
    return customers.withColumn("segment_display", label)


def segment_users(facts: DataFrame, quantiles: int = 5) -> DataFrame:
    return score_line_metrics(line_metrics(facts), quantiles).withColumn("Segment", standard_segment())


def segment_users_by_orders(orders: DataFrame, lines: DataFrame, quantiles: int = 5) -> DataFrame:
    scored = score_order_metrics(order_metrics(orders, lines), quantiles)
    return scored.withColumn("Segment", detailed_segment())


def segment_counts(segments: DataFrame, column: str = "Segment") -> DataFrame:
    counts = segments.groupBy(column).agg(long(F.count(F.lit(1))).alias("n_users"))
    total = segments.agg(F.count(F.lit(1)).alias("_all"))
    return counts.transform(beside, total).select(
        F.col(column).alias("segment"),
        "n_users",
        rounded(F.col("n_users") * 100.0 / F.col("_all"), 1).alias("share_pct"),
    )


def score_counts(scored: DataFrame) -> DataFrame:
    """(metric, score, users): three scores unpivoted, then one small aggregate."""
    long_form = scored.unpivot(["user_id"], list(SCORES), "metric", "score")
    return long_form.groupBy("metric", "score").agg(long(F.count(F.lit(1))).alias("n_users"))


def frequency_volume_grid(scored: DataFrame, quantiles: int = 5) -> DataFrame:
    """Users per F score (rows) and M score (columns), 0 where empty."""
    levels = list(range(1, quantiles + 1))
    grid = scored.groupBy("F_score").pivot("M_score", levels).count().fillna(0)
    return grid.select("F_score", *[F.col(str(m)).cast("long").alias(f"m_{m}") for m in levels])


def segment_lookup(segments: DataFrame) -> DataFrame:
    return segments.select("user_id", "Segment", "RFM_score", *SCORES)


def champion_share(customers: DataFrame, champion: str = rules.DISPLAY_NAMES["Champions"]) -> DataFrame:
    """Share of champions, and their mean volume against all customers."""
    top = F.col("segment_display") == champion
    return customers.agg(
        long(F.count(F.lit(1))).alias("n_customers"),
        long(F.count_if(top)).alias("n_champions"),
        rounded(100.0 * ratio(F.count_if(top), F.count(F.lit(1))), 1).alias("champion_pct"),
        rounded(F.avg(F.when(top, F.col("total_spent"))), 4).alias("avg_spent_champions"),
        rounded(F.avg("total_spent"), 4).alias("avg_spent_overall"),
    )
