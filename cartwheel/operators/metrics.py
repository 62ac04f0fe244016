"""Classification, ranking, recommendation and catalogue metrics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.functions.ordered import running, top_per_group
from cartwheel.functions.scalar import beside, binarise, long, ratio, rounded, zero
from cartwheel.session import written

PAIR = ["user_id", "product_id"]
K_VALUES = (5, 10, 20)


def score_histogram(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score, written once: the curve metrics
    take several passes over it."""
    hist = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        long(F.count_if(F.col(label) == 1)).alias("pos"), long(F.count_if(F.col(label) == 0)).alias("neg")
    )
    return written(hist, "scores")


def roc_auc_of(hist: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    curve = running(hist, [], ["score"], sums={"_neg": "neg"})
    below = F.col("_neg") - F.col("neg")
    # Decimal sum: a double would depend on the order of the additions.
    pairs = F.sum((F.col("pos") * (2 * below + F.col("neg"))).cast("decimal(38,0)"))
    area = F.try_divide(
        pairs.cast("double"), F.lit(2.0) * F.sum("pos").cast("double") * F.sum("neg").cast("double")
    )
    return curve.agg(rounded(area, 6).alias("auc"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return roc_auc_of(score_histogram(scored, label, score))


def pr_auc_of(hist: DataFrame) -> DataFrame:
    """Trapezoids under the precision-recall curve, starting at (0, 1)."""
    falling = hist.withColumn("_falling", -F.col("score"))
    curve = running(falling, [], ["_falling"], sums={"_tp": "pos", "_fp": "neg"})
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("_tp", "_fp", "pos", "neg"))
    before_tp, before = tp - pos, (tp - pos) + (fp - neg)
    precision = tp / (tp + fp)
    earlier = F.when(before > 0, F.try_divide(before_tp, before)).otherwise(F.lit(1.0))
    area = F.sum(pos * (precision + earlier) / 2)
    return curve.agg(rounded(F.try_divide(area, F.sum("pos").cast("double")), 6).alias("pr_auc"))


def pr_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return pr_auc_of(score_histogram(scored, label, score))


def _f1(precision: Column, recall: Column, digits: int = 6) -> Column:
    return ratio(2 * precision * recall, precision + recall, digits)


def _threshold_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [
        ratio(tp + tn, tp + fp + fn + tn, 6).alias("accuracy"),
        rounded(precision, 6).alias("precision"),
        rounded(recall, 6).alias("recall"),
        _f1(precision, recall).alias("f1"),
    ]


def threshold_metrics(scored: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 of ``score > threshold``; empty sets give 0."""
    guess = binarise(score, threshold)
    cell = lambda g, y: long(F.count_if((guess == g) & (F.col(label) == y)))
    counts = scored.agg(
        cell(1, 1).alias("_tp"), cell(1, 0).alias("_fp"), cell(0, 1).alias("_fn"), cell(0, 0).alias("_tn")
    )
    return counts.select(*_threshold_columns(*[F.col(c) for c in ("_tp", "_fp", "_fn", "_tn")]))


def classification_metrics(scored: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    return roc_auc(scored, label, score).transform(beside, threshold_metrics(scored, label, score, threshold))


def ranking_metrics(
    scored: DataFrame, k_values: Sequence[int] = K_VALUES, label: str = "label", score: str = "score",
    keys: Sequence[str] = PAIR,
) -> DataFrame:
    """Precision, recall and F1 of the K best rows of the whole set, one row per K."""
    most = max(k_values)
    best = scored.select(*keys, F.col(label).alias("_y"), F.col(score).alias("_s")).orderBy(F.desc("_s"), *keys).limit(most)
    placed = running(best.withColumn("_order", -F.col("_s")), [], ["_order", *keys], number="_rank", bounded=True)
    all_positives = scored.agg(long(F.coalesce(F.sum(label), F.lit(0))).alias("_all"))
    ks = F.explode(F.array(*[F.lit(k) for k in k_values])).alias("k")
    per_k = (
        placed.select("_y", "_rank", ks).where(F.col("_rank") <= F.col("k"))
        .groupBy("k").agg(long(F.sum("_y")).alias("_hits"), long(F.count(F.lit(1))).alias("_rows"))
        .transform(beside, all_positives)
    )
    precision, recall = ratio("_hits", "_rows"), ratio("_hits", "_all")
    return per_k.select(
        "k", rounded(precision, 6).alias("precision"), rounded(recall, 6).alias("recall"), _f1(precision, recall).alias("f1")
    )


def _averaged(users: DataFrame, k_values: Sequence[int]) -> DataFrame:
    """Mean over users of precision and recall at every K; F1 of the two means."""
    means = users.agg(
        long(F.count(F.lit(1))).alias("n_users"),
        *[F.coalesce(F.avg(ratio(f"_hits_{k}", f"_recs_{k}")), F.lit(0.0)).alias(f"_p_{k}") for k in k_values],
        *[F.coalesce(F.avg(ratio(f"_hits_{k}", "_relevant")), F.lit(0.0)).alias(f"_r_{k}") for k in k_values],
    )
    cells = [F.struct(F.lit(k).alias("k"), F.col(f"_p_{k}").alias("p"), F.col(f"_r_{k}").alias("r")) for k in k_values]
    return means.select("n_users", F.inline(F.array(*cells))).select(
        "k",
        "n_users",
        rounded("p", 6).alias("avg_precision"),
        rounded("r", 6).alias("avg_recall"),
        _f1(F.col("p"), F.col("r")).alias("avg_f1"),
    )


def recommendation_metrics(recommendations: DataFrame, truth: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """Lists (user, rank, product) against true (user, product) pairs, as sets.

    Users without truth are skipped; a repeated product counts once. One join
    serves all K: a product counts from its first rank on.
    """
    true_pairs = truth.select(*PAIR).distinct()
    relevant = true_pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("_relevant"))
    first = recommendations.groupBy(*PAIR).agg(F.min("rank").alias("rank"))
    hits = first.join(true_pairs.withColumn("_hit", F.lit(1)), PAIR, "left")
    counted = hits.groupBy("user_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"_recs_{k}") for k in k_values],
        *[F.count_if((F.col("rank") <= k) & F.col("_hit").isNotNull()).alias(f"_hits_{k}") for k in k_values],
    )
    return _averaged(counted.join(relevant, "user_id"), k_values)


def discounted_metrics(recommendations: DataFrame, truth: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """MAP, NDCG and MRR at every K: hits weigh by their place in the list.

    Over the users with a list and with truth, as ``recommendation_metrics``. A
    repeated product counts at its first rank; a list that is shorter than K just
    ends, one without a hit counts 0. The ideal list begins with the user's
    min(K, truth) true products.
    """
    most = max(k_values)
    true_pairs = truth.select(*PAIR).distinct()
    relevant = true_pairs.groupBy("user_id").agg(long(F.count(F.lit(1))).alias("_relevant"))
    first = recommendations.where(F.col("rank") <= most).groupBy(*PAIR).agg(F.min("rank").alias("rank"))
    hits = first.join(true_pairs.withColumn("_hit", F.lit(1)), PAIR, "left").withColumn("_hit", zero("_hit"))
    # At most ``most`` rows of a user are left.
    so_far = Window.partitionBy("user_id").orderBy("rank", "product_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hits.withColumn("_nth", F.sum("_hit").over(so_far))

    def within(k: int, value: Column) -> Column:
        return zero(F.sum(F.when((F.col("rank") <= k) & (F.col("_hit") == 1), value)))

    def best(k: int) -> Column:
        return zero(F.max(F.when((F.col("rank") <= k) & (F.col("_hit") == 1), 1.0 / F.col("rank"))))

    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    users = placed.groupBy("user_id").agg(
        *[within(k, F.col("_nth") / F.col("rank")).alias(f"_map_{k}") for k in k_values],
        *[within(k, gain).alias(f"_dcg_{k}") for k in k_values],
        *[best(k).alias(f"_mrr_{k}") for k in k_values],
    ).join(relevant, "user_id")
    ideal = list(accumulate(1 / math.log2(i + 1) for i in range(1, most + 1)))
    cells = []
    for k in k_values:
        full = F.least(F.lit(k), F.col("_relevant")).cast("int")
        ndcg = F.col(f"_dcg_{k}") / F.get(F.array(*map(F.lit, ideal)), full - 1)
        cells.append(
            F.struct(F.lit(k).alias("k"), (F.col(f"_map_{k}") / full).alias("m"), ndcg.alias("n"), F.col(f"_mrr_{k}").alias("r"))
        )
    return users.select(F.inline(F.array(*cells))).groupBy("k").agg(
        long(F.count(F.lit(1))).alias("n_users"),
        rounded(F.avg("m"), 6).alias("map"),
        rounded(F.avg("n"), 6).alias("ndcg"),
        rounded(F.avg("r"), 6).alias("mrr"),
    )


def novelty(recommendations: DataFrame, facts: DataFrame) -> DataFrame:
    """Mean self-information, -log2 of the share of users who bought a product, over all recommended places.

    A product nobody bought counts as bought by one user.
    """
    buyers = facts.select(*PAIR).distinct().groupBy("product_id").agg(F.count(F.lit(1)).alias("_buyers"))
    users = facts.agg(F.count_distinct("user_id").alias("_users"))
    listed = recommendations.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"))
    known = listed.join(buyers, "product_id", "left").transform(beside, users)
    share = F.greatest(F.coalesce("_buyers", F.lit(1)), F.lit(1)) / F.col("_users")
    return known.agg(
        zero(rounded(F.sum(F.col("_n") * -F.log2(share)) / F.sum("_n"), 6)).alias("avg_novelty"),
        long(F.coalesce(F.sum(F.when(F.col("_buyers").isNull(), F.col("_n"))), F.lit(0))).alias("n_never_bought"),
    )


def per_user_ranking(
    scored: DataFrame, k_values: Sequence[int] = K_VALUES, label: str = "label", score: str = "score"
) -> DataFrame:
    """Each user's rows ranked by score: precision, recall and F1 at K over users."""
    relevant = scored.groupBy("user_id").agg(long(F.sum(label)).alias("_relevant"))
    best = top_per_group(scored, ["user_id"], [F.desc(score), "product_id"], max(k_values), "_rank")
    counted = best.groupBy("user_id").agg(
        *[F.count_if(F.col("_rank") <= k).alias(f"_recs_{k}") for k in k_values],
        *[F.count_if((F.col("_rank") <= k) & (F.col(label) == 1)).alias(f"_hits_{k}") for k in k_values],
    )
    return _averaged(counted.join(relevant, "user_id"), k_values)


def hit_rates(recommendations: DataFrame, targets: DataFrame, k_values: Sequence[int] = K_VALUES, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Share of sequences whose target is among the first K products of their list.

    Every target row is a sequence of its own, also where a user has the same
    target twice; only a product that a list repeats counts once, at its best rank.
    """
    keys = list(keys)
    aim = targets.select(*keys, F.col("target").alias("product_id"))
    best = recommendations.groupBy(*keys, "product_id").agg(F.min("rank").alias("rank"))
    found = aim.join(best, [*keys, "product_id"], "left")
    row = found.agg(
        long(F.count(F.lit(1))).alias("n_targets"),
        *[ratio(F.count_if(F.col("rank") <= k), F.count(F.lit(1)), 6).alias(f"hit_rate_{k}") for k in k_values],
    )
    return row


def coverage_metrics(recommendations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Share of the catalogue recommended, mean share of distinct products per list."""
    unique = recommendations.agg(long(F.count_distinct("product_id")).alias("total_unique_recommendations"))
    size = catalogue.agg(F.count(F.lit(1)).alias("_items"))
    lists = recommendations.groupBy("user_id").agg(
        F.count_distinct("product_id").alias("_distinct"), F.count("product_id").alias("_length")
    )
    diversity = lists.where(F.col("_length") > 1).agg(
        zero(rounded(F.avg(F.col("_distinct") / F.col("_length")), 6)).alias("avg_list_diversity")
    )
    return unique.transform(beside, size).transform(beside, diversity).select(
        ratio("total_unique_recommendations", "_items", 6).alias("catalog_coverage"),
        "avg_list_diversity",
        "total_unique_recommendations",
    )


def business_metrics(recommendations: DataFrame, popularity: DataFrame, revenue: DataFrame | None = None) -> DataFrame:
    """Mean popularity, and mean and total revenue, of recommended products.

    Recommendations are counted per product first; unknown products count 0.
    """
    per_item = recommendations.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = per_item.join(popularity.select("product_id", F.col("popularity").alias("_pop")), "product_id", "left")
    lists = F.sum("_n").cast("double")
    out = [zero(rounded(F.sum(F.col("_n") * zero("_pop")) / lists, 4)).alias("avg_item_popularity")]
    if revenue is not None:
        joined = joined.join(revenue.select("product_id", F.col("revenue").alias("_rev")), "product_id", "left")
        total = F.sum(F.col("_n") * zero("_rev"))
        out += [
            zero(rounded(total / lists, 4)).alias("avg_item_revenue"),
            zero(rounded(total, 2)).alias("total_potential_revenue"),
        ]
    return joined.agg(*out)


def model_report(
    scored: DataFrame, model: str, k_values: Sequence[int] = K_VALUES,
    label: str = "label", score: str = "score",
    additional: Mapping[str, float] | None = None,
) -> DataFrame:
    """One flat row: sample, classification and ranking metrics of one model, and ``additional`` ones from elsewhere."""
    stats = scored.agg(
        long(F.count(F.lit(1))).alias("total_samples"),
        long(F.coalesce(F.sum(label), F.lit(0))).alias("positive_samples"),
        long(F.count_if(F.col(label) == 0)).alias("negative_samples"),
        ratio(F.sum(label), F.count(F.lit(1)), 6).alias("positive_rate"),
    )
    ranks = ranking_metrics(scored, k_values, label, score)
    at_k = ranks.agg(
        *[F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{m}_at_{k}") for k in k_values for m in ("precision", "recall", "f1")]
    )
    gain = rounded((F.col("auc") - 0.5) / 0.5 * 100, 1).alias("improvement_over_random")
    whole = stats.transform(beside, classification_metrics(scored, label, score)).transform(beside, at_k)
    extra = [F.lit(float(v)).alias(name) for name, v in (additional or {}).items()]
    return whole.select(F.lit(model).alias("model_name"), "*", gain, *extra)


def nested_report(report: DataFrame) -> DataFrame:
    """The flat report as nested structs, the shape of the JSON sink."""
    groups = {
        "data_stats": ["total_samples", "positive_samples", "positive_rate", "negative_samples"],
        "classification": ["auc", "accuracy", "precision", "recall", "f1"],
        "ranking": [c for c in report.columns if c.partition("_at_")[0] in ("precision", "recall", "f1") and "_at_" in c],
    }
    known = {"model_name", "improvement_over_random", *sum(groups.values(), [])}
    if others := [c for c in report.columns if c not in known]:
        groups["additional"] = others
    return report.select(
        "model_name", *[F.struct(*cols).alias(name) for name, cols in groups.items()], "improvement_over_random"
    )


def leaderboard(reports: Sequence[DataFrame]) -> DataFrame:
    """Model metrics one below the other, the best by AUC marked, gain over the weakest.

    The table has one row per model.
    """
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)
    best = table.agg(
        F.max_by("model_name", F.struct("auc", F.col("model_name"))).alias("_best"), F.min("auc").alias("_low")
    )
    return table.transform(beside, best).select(
        *table.columns,
        (F.col("model_name") == F.col("_best")).cast("int").alias("is_best"),
        rounded(100.0 * ratio(F.col("auc") - F.col("_low"), "_low"), 2).alias("gain_over_lowest_pct"),
    )


def best_per_metric(table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Best model of every metric (long form)."""
    tall = table.unpivot(["model_name"], [F.col(m) for m in metrics], "metric", "value")
    return tall.groupBy("metric").agg(
        F.min_by("model_name", F.struct(-F.col("value"), F.col("model_name"))).alias("best_model"),
        F.max("value").alias("best_value"),
    )
