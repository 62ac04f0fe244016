"""Blending scores and serving top-k lists for all users in one job.

Scores are long tables (user_id, product_id, model, score).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.ordered import top_per_group
from cartwheel.functions.scalar import beside, clamp, confidence, mapped, rounded

PAIR = ["user_id", "product_id"]

# Marketing attributes per display segment.
INSIGHTS = {
    "🏆 Champions": ("VIP Customer", "Frequent high-value purchases", "Premium & organic products", "Weekends & holidays", "Special care, early access"),
    "💎 Loyal Customers": ("Loyal Customer", "Regular, stable purchases", "Familiar brands", "Weekends & mid-week", "Loyalty programs, rewards"),
    "🌟 New Customers": ("New Customer", "Exploring products", "Good deals, popular items", "Mainly weekends", "Onboarding, welcome offers"),
    "💪 Potential Loyalists": ("Potential Loyalist", "High frequency, low spending", "Fair prices, variety packs", "Weekdays, avoid rush hours", "Upselling, bundle deals"),
    "⚠️ At Risk": ("At-Risk Customer", "Decreasing purchase frequency", "Sale items, promotions", "Irregular, needs stimulation", "Win-back campaigns, discounts"),
    "😴 Hibernating": ("Hibernating Customer", "Long time no purchase", "Flash sales, seasonal items", "Major promotions only", "Reactivation campaigns"),
}
INSIGHT_DEFAULT = ("Regular Customer", "Basic shopping patterns", "Diverse products", "Weekends", "General care")
INSIGHT_FIELDS = ("customer_type", "behavior", "preference", "timing", "strategy")

# Campaign attributes per display segment.
STRATEGIES = {
    "🏆 Champions": ("VIP newsletter with exclusive products", "Early access deals, premium bundles", "Weekends (peak shopping time)", "Personal shopping assistant"),
    "💎 Loyal Customers": ("Loyalty rewards with top recommendations", "Member exclusive discounts", "Consistent weekly patterns", "Email + mobile app notifications"),
    "🌟 New Customers": ("Welcome series with product tutorials", "First-time buyer incentives", "Weekend discovery shopping", "Onboarding flow + social media"),
    "💪 Potential Loyalists": ("Value-focused bundles and cross-sell", "Bulk purchase discounts", "Weekday convenience shopping", "Smart recommendations + push notifications"),
    "⚠️ At Risk": ("Win-back campaign with special offers", "Flash sales, surprise discounts", "Immediate intervention needed", "Multi-channel retargeting"),
    "😴 Hibernating": ("Re-engagement campaign with seasonal deals", "Come-back incentives, free delivery", "Holiday seasons, special events", "Email blast + social ads"),
}
STRATEGY_DEFAULT = STRATEGIES["💎 Loyal Customers"]
STRATEGY_FIELDS = ("email", "promo", "send_time", "channel")


def to_long(wide: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Score columns ``{column: model}`` to the long form."""
    renamed = wide.select(*PAIR, *[F.col(c).cast("double").alias(m) for c, m in columns.items()])
    return renamed.unpivot(PAIR, list(columns.values()), "model", "score")


def simple_average(scores: DataFrame) -> DataFrame:
    return scores.groupBy(*PAIR).agg(rounded(F.avg("score"), 6).alias("score"))


def _literal(weights: Mapping[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])


def weighted_average(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights are a small table (model, weight), e.g. the AUC of every model."""
    weighted = scores.join(F.broadcast(weights), "model")
    total = F.try_divide(F.sum(F.col("weight") * F.col("score")), F.sum("weight"))
    return weighted.groupBy(*PAIR).agg(rounded(total, 6).alias("score"))


def top_k(scores: DataFrame, k: int, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    return top_per_group(scores, list(keys), [F.desc("score"), "product_id"], k)


def ensemble(scores: DataFrame, weights: Mapping[str, float] | None = None, k: int = 10) -> DataFrame:
    """Weighted sum over each model's best 2k, with the models that voted, best k."""
    used = scores
    weight: Column = F.lit(1.0)
    if weights is not None:
        used = scores.where(F.col("model").isin(list(weights)))
        weight = F.try_element_at(_literal(weights), F.col("model"))
    best = top_k(used, 2 * k, ["user_id", "model"])
    blended = best.groupBy(*PAIR).agg(
        rounded(F.sum(F.col("score") * weight), 6).alias("score"),
        F.sort_array(F.collect_list("model")).alias("contributing_models"),
    )
    return top_k(blended, k).withColumn("model", F.lit("ensemble"))


def exclude_seen(scores: DataFrame, seen: DataFrame) -> DataFrame:
    return scores.join(seen.select(*PAIR), PAIR, "left_anti")


def drop_padding(scores: DataFrame, column: str = "idx") -> DataFrame:
    return scores.where(F.col(column) > 0)


def fallback(users: DataFrame, popular: DataFrame, k: int) -> DataFrame:
    """The k most popular products for every given user, score 1, 0.9, 0.8, ..."""
    top = popular.where(F.col("popularity_rank") <= k).select(
        "product_id",
        F.col("popularity_rank").cast("int").alias("rank"),
        rounded(F.lit(1.0) - (F.col("popularity_rank") - 1) * 0.1, 6).alias("score"),
        F.lit("fallback").alias("model"),
    )
    lists = top.agg(F.sort_array(F.collect_list(F.struct("rank", "product_id", "score", "model"))).alias("_top"))
    return users.select("user_id").transform(beside, lists).select("user_id", F.inline("_top"))


def recommend(
    users: DataFrame, scores: DataFrame, popular: DataFrame, model: str = "ensemble", k: int = 10, max_k: int | None = None
) -> DataFrame:
    """Top-k lists of all requested users; users the model does not know, and
    every user of an unknown model, get the popular list."""
    if k < 1 or (max_k is not None and k > max_k):
        raise ValueError(f"k must be between 1 and {max_k or 'any number'}")
    wanted = scores.join(users, "user_id", "left_semi")
    columns = ["user_id", "rank", "product_id", "score", "model"]
    if model == "ensemble":
        served = ensemble(wanted, k=k).select(*columns)
    else:
        scores = scores.where(F.col("model") == model)
        served = top_k(wanted.where(F.col("model") == model), k).select(*columns)
    # Whoever has a score gets a list: the lists need not be computed twice.
    missed = users.join(scores.select("user_id").distinct(), "user_id", "left_anti")
    return served.unionByName(fallback(missed, popular, k).select(*columns))


def popular_products(items: DataFrame, n: int = 100, column: str = "total_orders") -> DataFrame:
    return items.orderBy(F.desc(column), "product_id").limit(n).select("product_id", column)


def diversified(
    scores: DataFrame, catalogue: DataFrame, k: int = 10, per_department: int = 2, n_departments: int = 6,
    departments: Sequence[str] | None = None,
) -> DataFrame:
    """Best products of a user from several departments.

    Up to ``per_department`` products of the user's ``n_departments`` best
    departments (by their best score), then the best ``k`` of these.
    """
    named = scores.join(catalogue.select("product_id", "department"), "product_id")
    if departments:
        named = named.where(F.col("department").isin(list(departments)))
    per = top_per_group(
        named, ["user_id", "department"], [F.desc("score"), "product_id"], per_department, "_in_department"
    )
    heads = top_per_group(
        per.where(F.col("_in_department") == 1), ["user_id"], [F.desc("score"), "department"], n_departments, "_place"
    )
    kept = per.join(heads.select("user_id", "department"), ["user_id", "department"], "left_semi")
    return top_per_group(kept, ["user_id"], [F.desc("score"), "product_id"], k).select(
        "user_id", "rank", "product_id", "department", "score"
    )


def present(recommendations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Names, clamped score and confidence beside every recommendation."""
    named = recommendations.join(
        catalogue.select("product_id", "product_name", "department", "aisle"), "product_id", "left"
    )
    score = clamp("score", 0.1, 0.95)
    return named.select(
        "user_id",
        "rank",
        "product_id",
        "product_name",
        F.initcap("department").alias("department"),
        F.coalesce("aisle", F.lit("Unknown")).alias("aisle"),
        score.alias("score"),
        confidence(score).alias("confidence"),
    )


def customer_profiles(request: DataFrame, customers: DataFrame) -> DataFrame:
    """Requested users with their profile columns and whether they are known."""
    found = customers.withColumn("_known", F.lit(1))
    return request.join(found, "user_id", "left").withColumn("is_known", F.coalesce("_known", F.lit(0))).drop("_known")


def _attributes(segment: Column | str, table: Mapping[str, tuple], default: tuple, fields: Sequence[str]) -> dict[str, Column]:
    return {
        field: mapped(segment, {name: row[i] for name, row in table.items()}, default[i])
        for i, field in enumerate(fields)
    }


def with_marketing(customers: DataFrame, segment: str = "segment_display") -> DataFrame:
    """Insight and campaign attributes of the customer's segment."""
    return customers.withColumns(
        {
            **_attributes(segment, INSIGHTS, INSIGHT_DEFAULT, INSIGHT_FIELDS),
            **_attributes(segment, STRATEGIES, STRATEGY_DEFAULT, STRATEGY_FIELDS),
        }
    )


def favourite_department(presented: DataFrame) -> DataFrame:
    """Department of each user's first recommendation."""
    return presented.groupBy("user_id").agg(F.min_by("department", "rank").alias("favourite_department"))
