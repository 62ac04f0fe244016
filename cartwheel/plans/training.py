"""Star schema -> labelled training matrix -> fitted models and their reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.config import HISTORY_SETS, Params
from cartwheel.operators import candidates, item_features, pair_features, rfm, user_features
from cartwheel.operators.quality import to_numbers
from cartwheel.session import written
from cartwheel.sources.files import save_json, save_parquet
from cartwheel.sources.retail import Star, task_count


@dataclass(frozen=True)
class Parts:
    """The intermediate tables of a training run."""

    users: DataFrame
    history: DataFrame
    popular: DataFrame
    labelled: DataFrame
    #: The labelled candidates with the columns of ``history`` and ``popularity_score``.
    candidates: DataFrame


HOT_ITEMS = 1000


def labelled_candidates(star: Star, params: Params = Params()) -> Parts:
    lines = star.lines(*HISTORY_SETS[params.history])
    users = candidates.target_users(star.orders)
    history = candidates.purchase_history(star.pairs(*HISTORY_SETS[params.history]))
    popular = written(candidates.popular_items(lines), "popular")
    pairs = candidates.candidate_rows(users, history, popular, params.reorder_candidates, params.popular_candidates)
    positives = star.lines("train").select("user_id", "product_id")
    # A user has a bounded number of candidates, and of positives: those of the last order.
    rows = written(candidates.label_pairs(pairs, positives, task_count(lines)), "labelled")
    return Parts(users, history, popular, rows.select("user_id", "product_id", "label"), rows)


def features(star: Star, params: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """User, item and pair features over the history the model may see.

    With ``history="prior"`` the train orders, which carry the labels, stay out. The
    pair features are those of the reorder candidates: the others were never bought.
    """
    sets = HISTORY_SETS[params.history]
    lines = star.lines(*sets)
    orders = star.orders.where(F.col("eval_set").isin(*sets))
    segments = rfm.segment_users_by_orders(orders, lines, params.quantiles)
    pairs = star.pairs(*sets)
    users = user_features.build_prefixed(orders, lines, pairs, star.catalogue)
    users = to_numbers(user_features.add_segments(users, segments), ["RFM_score"])
    items = item_features.build_prefixed(pairs, orders, star.catalogue).drop("product_name")
    known = candidates.first_of_history(pairs, params.reorder_candidates)
    return users, items, pair_features.prefixed_interactions(pairs, known)


def matrix(star: Star, params: Params = Params()) -> DataFrame:
    """Features beside every labelled candidate, categories encoded, split into
    train and test rows; written once, as several learners pass over it, and split
    as it is read.

    User and item tables are saved before, so that their joins go by known sizes.
    """
    parts = labelled_candidates(star, params)
    users, items, pairs = features(star, params)
    users, items = written(users, "user-features"), written(items, "item-features")
    users = candidates.with_class_code(users, "Segment")
    for column in ("department", "aisle"):
        items = candidates.with_class_code(items, column)
    hot = parts.popular.where(F.col("popularity_rank") <= HOT_ITEMS).select("product_id")
    tasks = task_count(star.lines(*HISTORY_SETS[params.history]))
    wide = candidates.training_matrix(parts.labelled, users, items, pairs, hot, tasks)
    wide = wide.fillna(candidates.MISSING_CLASS, ["Segment", "department", "aisle"])
    return candidates.stratified_split(written(wide, "matrix"), params.test_share, params.seed)


def save_splits(split: DataFrame, labelled: DataFrame, popular: DataFrame, folder: str) -> DataFrame:
    """Train and test tables, candidates, popular items and a metadata row."""
    save_parquet(split, f"{folder}/splits", ("split",))
    save_parquet(labelled, f"{folder}/user_candidate_set.parquet")
    save_parquet(popular, f"{folder}/popular_items.parquet")
    n_features = len(candidates.feature_columns(split))
    meta = split.agg(
        F.count_if(F.col("split") == "train").alias("train_size"),
        F.count_if(F.col("split") == "test").alias("test_size"),
        F.lit(n_features).cast("long").alias("feature_count"),
        F.avg(F.when(F.col("split") == "train", F.col("label"))).alias("positive_rate_train"),
        F.avg(F.when(F.col("split") == "test", F.col("label"))).alias("positive_rate_test"),
    )
    save_json(meta, f"{folder}/split_metadata")
    return meta
