"""Small hand-made cases of the operators."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartwheel.functions import rules, scalar
from cartwheel.functions.scalar import ratio, rounded
from cartwheel.sources.retail import catalogue_from
from cartwheel.operators import candidates, eda, metrics, models, pair_features, quality, recommend, rfm, sequences, user_features
from cartwheel.sources.files import save_model
from registry import QUERIES
from tests.conftest import TINY, rows


def facts(spark, *lines):
    """(user, order_number, cart, product)"""
    data = [(u, u * 100 + n, n, c, p, 0, None) for u, n, c, p in lines]
    return spark.createDataFrame(
        data,
        "user_id long, order_id long, order_number int, add_to_cart_order int, product_id long, reordered int, days_since_prior_order double",
    )


def test_rounding_lifts_ties(spark):
    df = spark.createDataFrame([(0.125,), (2.5,), (1.005,), (None,)], "x double")
    assert [r[0] for r in df.select(rounded("x", 2)).collect()] == [0.13, 2.5, 1.01, None]
    assert df.select(rounded(F.lit(2.5), 0, half_even=True)).first()[0] == 2.0


def test_ratio_of_zero_is_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (None, 2), (1, 3)], "a int, b int")
    assert [r[0] for r in df.select(ratio("a", "b", 3)).collect()] == [0.0, 0.0, 0.0, 0.333]


def test_first_rule_wins(spark):
    scores = spark.createDataFrame(
        [(5, 5, 5), (4, 4, 2), (5, 1, 1), (2, 5, 5), (1, 5, 5), (1, 1, 1)], "R_score int, F_score int, M_score int"
    )
    standard = [r[0] for r in scores.select(rfm.standard_segment()).collect()]
    assert standard == ["Champions", "Loyal_Customers", "New_Customers", "Need_Attention", "About_to_Sleep", "Hibernating"]
    detailed = [r[0] for r in scores.select(rfm.detailed_segment()).collect()]
    assert detailed == ["Champions", "Potential Loyalists", "New Customers", "About to Sleep", "At Risk", "Lost"]


def test_missing_scores_count_as_three(spark):
    df = spark.createDataFrame([(1,), (5,)], "R_score int")
    assert [r[0] for r in df.select(rfm.display_segment(df.columns)).collect()] == ["💎 Loyal Customers"] * 2


def test_display_name_of_an_unmapped_segment(spark):
    df = spark.createDataFrame([("Lost",), ("Champions",)], "Segment string")
    assert [r[0] for r in df.select(rfm.display_name("Segment")).collect()] == [
        rules.DISPLAY_DEFAULT,
        "🏆 Champions",
    ]


def test_top_department_prefers_the_first_name(spark):
    lines = facts(spark, (1, 1, 1, 1), (1, 1, 2, 2), (1, 2, 1, 1), (1, 2, 2, 2), (1, 2, 3, 3))
    catalogue = spark.createDataFrame([(1, "b", "y"), (2, "a", "x"), (3, None, None)], "product_id long, department string, aisle string")
    got = user_features.department_aisle(pair_features.pair_sums(lines), catalogue)
    assert rows(got) == [(1, 2, "a", 2, "x")]


def test_pair_sums_agree_with_pandas(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"user_id": rng.integers(0, 4, 300), "product_id": rng.integers(0, 6, 300), "add_to_cart_order": rng.integers(1, 30, 300)})
    df = spark.createDataFrame(
        frame.assign(order_id=range(300), order_number=1, reordered=0, days_since_prior_order=1.0)
    )
    got = user_features.product_patterns(pair_features.pair_sums(df)).orderBy("user_id").collect()
    want = frame.groupby("user_id")["add_to_cart_order"].agg(["mean", "std"]).round(4)
    assert [r.avg_cart_position for r in got] == pytest.approx(want["mean"].tolist(), abs=1.01e-4)
    assert [r.std_cart_position for r in got] == pytest.approx(want["std"].tolist(), abs=1.01e-4)


def test_windows_of_three(spark):
    lines = facts(spark, *[(1, 1, i, i * 10) for i in range(1, 6)], (2, 1, 1, 10))
    vocab = spark.createDataFrame([(10 * i, 10 * i) for i in range(1, 6)], "product_id long, idx int")
    got = {r.pos: (r.seq, r.target) for r in sequences.next_item_windows(lines, vocab, length=3).collect()}
    assert got[1] == ([0, 0, 10], 20)
    assert got[4] == ([20, 30, 40], 50)
    assert len(got) == 4


@pytest.mark.parametrize("block", [4, 7, 64])
def test_windows_in_blocks_are_whole(spark, small_cells, block):
    rng = np.random.default_rng(5)
    lines = facts(spark, *[(u, n, c, int(rng.integers(1, 20))) for u in (1, 2) for n in range(1, 30) for c in range(1, u * 4)])
    vocab = sequences.vocabulary(lines, 15)
    plain = sequences.next_item_windows(lines, vocab, length=5, block=10**6)
    cut = sequences.next_item_windows(lines, vocab, length=5, block=block)
    assert rows(plain, "user_id", "pos", "seq", "target") == rows(cut, "user_id", "pos", "seq", "target")


def test_decode_drops_padding(spark):
    vocab = spark.createDataFrame([(7, 1), (9, 2)], "product_id long, idx int")
    seqs = spark.createDataFrame([(1, [0, 2, 1])], "user_id long, seq array<int>")
    assert rows(sequences.decode(seqs, vocab), "place", "product_id") == [(1, 9), (2, 7)]


@pytest.mark.parametrize("seed", range(3))
def test_missing_from_top_matches_brute_force(spark, small_cells, seed):
    rng = np.random.default_rng(seed)
    ranked = [(int(p), r) for r, p in enumerate(rng.permutation(30), 1)]
    owned = {(u, int(p)) for u in range(6) for p in rng.choice(30, rng.integers(0, 31) if u else 30, replace=False)}
    users = spark.createDataFrame([(u,) for u in range(8)], "user_id long")
    got = candidates.missing_from_top(
        users,
        spark.createDataFrame(sorted(owned), "user_id long, product_id long"),
        spark.createDataFrame(ranked, "product_id long, popularity_rank long"),
        "user_id",
        7,
    )
    want = []
    for u in range(8):
        want += [(u, p) for p, _ in ranked if (u, p) not in owned][:7]
    assert rows(got, "user_id", "product_id") == sorted(want, key=repr)


def test_stratified_split_is_exact(spark, small_cells):
    df = spark.range(500).select(
        (F.col("id") % 50).alias("user_id"), F.col("id").alias("product_id"), (F.col("id") % 10 == 0).cast("int").alias("label")
    )
    split = candidates.stratified_split(df, 0.2, 42).groupBy("label", "split").count()
    assert rows(split) == [(0, "test", 90), (0, "train", 360), (1, "test", 10), (1, "train", 40)]


def scored(spark, data):
    return spark.createDataFrame([(1, i, y, s) for i, (y, s) in enumerate(data)], "user_id long, product_id long, label int, score double")


def test_constant_scores_have_auc_half(spark):
    assert metrics.roc_auc(scored(spark, [(1, 0.3), (0, 0.3), (0, 0.3)])).first().auc == 0.5


@pytest.mark.parametrize("cut", [False, True])
def test_auc_counts_pairs(spark, cut, request):
    if cut:
        request.getfixturevalue("small_cells")
    rng = np.random.default_rng(2)
    data = [(int(rng.random() < 0.3), float(rng.integers(0, 200) / 200)) for _ in range(400)]
    pos = np.array([s for y, s in data if y])
    neg = np.array([s for y, s in data if not y])
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.roc_auc(scored(spark, data)).first().auc == pytest.approx(want, abs=1e-6)


def test_pr_auc_of_a_perfect_order(spark):
    assert metrics.pr_auc(scored(spark, [(1, 0.9), (1, 0.8), (0, 0.1)])).first().pr_auc == 1.0


def test_no_positive_guess_gives_zero(spark):
    got = metrics.threshold_metrics(scored(spark, [(1, 0.5), (0, 0.2)])).first()
    assert (got.accuracy, got.precision, got.recall, got.f1) == (0.5, 0.0, 0.0, 0.0)


def test_recommendations_are_sets(spark):
    recs = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 6), (2, 1, 5)], "user_id long, rank int, product_id long")
    truth = spark.createDataFrame([(1, 5), (1, 5), (1, 9)], "user_id long, product_id long")
    got = {r.k: r for r in metrics.recommendation_metrics(recs, truth, (2, 3)).collect()}
    assert got[2].n_users == 1  # user 2 has no truth
    assert (got[2].avg_precision, got[2].avg_recall) == (1.0, 0.5)
    assert (got[3].avg_precision, got[3].avg_recall) == (0.5, 0.5)


def long_scores(spark):
    return spark.createDataFrame(
        [(1, 10, "a", 0.9), (1, 11, "a", 0.8), (1, 12, "a", 0.1), (1, 11, "b", 0.5), (1, 13, "b", 0.4)],
        "user_id long, product_id long, model string, score double",
    )


def test_ensemble_sums_over_the_union(spark):
    got = recommend.ensemble(long_scores(spark), {"a": 1.0, "b": 2.0}, k=1)
    assert rows(got, "product_id", "score", "contributing_models") == [(11, 1.8, ["a", "b"])]


def test_ensemble_takes_two_k_per_model(spark):
    """With k=1 each model sends its best two: product 12 never arrives."""
    best = recommend.ensemble(long_scores(spark), k=1)
    assert best.first().product_id == 11
    assert recommend.ensemble(long_scores(spark), k=2).where("product_id = 12").isEmpty()


def test_fallback_scores_go_below_zero(spark):
    popular = spark.createDataFrame([(p, p) for p in range(1, 13)], "product_id long, popularity_rank long")
    users = spark.createDataFrame([(1,)], "user_id long")
    got = recommend.fallback(users, popular, 12).orderBy("rank").collect()
    assert [r.score for r in got][:2] == [1.0, 0.9] and got[11].score == -0.1


def test_top_k_is_limited(spark):
    with pytest.raises(ValueError):
        recommend.recommend(spark.range(1).toDF("user_id"), long_scores(spark), None, k=51, max_k=50)
    with pytest.raises(ValueError):
        recommend.recommend(spark.range(1).toDF("user_id"), long_scores(spark), None, k=0)


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 300, 70000, 1 << 40, "12", "1x", 0.5), (2, 1, 1, 1, "3", "2", None)], "a long, b long, c long, d long, e string, f string, g double")
    assert [f.dataType.simpleString() for f in quality.narrow_types(df).schema.fields] == [
        "tinyint", "smallint", "int", "bigint", "int", "string", "float",
    ]


def test_validate_empty_and_missing(spark):
    got = quality.validate_frame(spark.createDataFrame([], "a int"), ["a", "b"], "t").first()
    assert (got.passed, got.missing_columns, got.all_null_columns) == (0, "b", "")


def test_orphans_are_distinct_keys(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k long")
    parent = spark.createDataFrame([(1,)], "k long")
    assert quality.orphan_count(child, parent, "k", "c").first().invalid_keys == 2


def test_missing_tables_are_reported(spark):
    assert not quality.is_valid({"orders": spark.createDataFrame([], "order_id long")})


def test_feature_groups_cover_all_users(spark):
    """User 1 has orders and lines, 2 only orders, 3 only lines."""
    lines = facts(spark, (1, 1, 1, 10), (3, 1, 1, 10))
    orders = spark.createDataFrame(
        [(1, 11, 1, 0, 0, None), (2, 21, 1, 0, 0, None)],
        "user_id long, order_id long, order_number int, order_dow int, order_hour_of_day int, days_since_prior_order double",
    )
    sums = pair_features.pair_sums(lines)
    got = user_features.build(orders, lines, sums, None, ["order_patterns", "product_patterns"])
    assert rows(got, "user_id", "total_orders", "unique_products") == [(1, 1, 1), (2, 1, None), (3, None, 1)]


def test_a_repeated_target_is_a_sequence_of_its_own(spark):
    recs = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 10)], "user_id long, rank int, product_id long")
    targets = spark.createDataFrame([(1, 10), (1, 10), (1, 99)], "user_id long, target long")
    got = metrics.hit_rates(recs, targets, (1, 5)).first()
    assert (got.n_targets, got.hit_rate_1, got.hit_rate_5) == (3, 0.666667, 0.666667)


def test_hours_above_62_are_told_apart(spark):
    orders = spark.createDataFrame([(1, i, 3, h, 1.0) for i, h in enumerate((0, 64, 128))], "user_id long, order_number int, order_dow int, order_hour_of_day int, days_since_prior_order double")
    assert user_features.temporal(orders).first().user_unique_hours == 3


def test_users_without_known_items_get_popular_ones(spark):
    lines = facts(spark, (1, 1, 1, 10), (1, 2, 1, 20), (2, 1, 1, 10), (3, 1, 1, 77))
    vocab = spark.createDataFrame([(10, 1), (20, 2)], "product_id long, idx int")
    users = spark.createDataFrame([(1,), (3,), (4,)], "user_id long")
    got = sequences.next_item_scores(lines, vocab, users, k=2)
    assert rows(got.select("user_id").distinct()) == [(1,), (3,), (4,)]
    assert rows(got.where("user_id > 1"), "user_id", "product_id", "rank") == [(3, 10, 1), (3, 20, 2), (4, 10, 1), (4, 20, 2)]


def test_unknown_products_are_coded_as_zero(spark):
    lines = facts(spark, *[(1, 1, i, i * 10) for i in range(1, 5)])
    vocab = spark.createDataFrame([(10, 1), (30, 2)], "product_id long, idx int")
    got = {r.pos: (r.seq, r.target) for r in sequences.next_item_windows(lines, vocab, length=3).collect()}
    assert got == {1: ([0, 0, 1], 0), 2: ([0, 1, 0], 2), 3: ([1, 0, 2], 0)}


def test_orphans_are_counted_in_raw_tables(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "a long")
    parent = spark.createDataFrame([(1,)], "b long")
    assert tuple(quality.orphan_count(child, parent, "a", "check", "b").first()) == ("check", 1)


def test_products_without_brand_stay(spark):
    part = spark.createDataFrame([(1, "x", "b2", "t"), (2, "y", None, "t"), (3, "z", "b1", None)], "p_partkey long, p_name string, p_brand string, p_type string")
    got = catalogue_from(part, None)
    assert rows(got, "product_id", "aisle_id", "department_id") == [(2, 2, 1), (3, None, 1), (4, 1, None)]


def test_what_was_written_is_marked_for_deletion(spark):
    from cartwheel import session

    session.written(spark.range(3))
    folder = session.application_folder(spark)
    assert folder in session._MARKED and folder.startswith(spark.conf.get("spark.checkpoint.dir"))


def learnable(spark, n=600):
    """Labels follow two of three inputs, with noise."""
    rng = np.random.default_rng(3)
    x = rng.random((n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.2 * rng.standard_normal(n) > 0.8).astype(int)
    data = [(i, i % 7, int(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(data, "user_id long, product_id long, label int, a double, b double, c double")
    return df.where("user_id % 4 > 0"), df.where("user_id % 4 = 0")


def test_models_rank_unseen_rows(spark):
    train, held = learnable(spark)
    boosted = models.boosted_trees(train, ["a", "b", "c"], iterations=12, depth=3)
    forest = models.random_forest(train, ["a", "b", "c"], trees=10, depth=4)
    stack = models.stack_logistic(train, ["a", "b"])
    for model in (boosted, forest, stack):
        assert metrics.roc_auc(models.predict(model, held)).first().auc > 0.85
    kept, losses = models.kept_rounds(boosted, held, patience=3)
    assert len(losses) == 12 and 1 <= kept <= 12 and losses[kept - 1] == min(losses[: kept + 3])
    assert models.bounded_sample(train, 100).count() == 100
    assert models.feature_importance(forest).first().feature == "a"


def test_boosting_stops_where_validation_gets_worse(spark):
    """Noise is learned by heart: the validation loss soon rises, and the model is cut there."""
    rng = np.random.default_rng(8)
    data = [(i, 0, int(rng.random() < 0.5), *map(float, rng.random(2))) for i in range(500)]
    df = spark.createDataFrame(data, "user_id long, product_id long, label int, a double, b double")
    aside = models.validation_share(df, 0.3)
    assert 100 < df.where(aside).count() < 200
    found = models.stopped_trees(df.where(~aside), df.where(aside), ["a", "b"], iterations=30, depth=5, patience=5)
    assert found.kept < 30 and found.model.stages[-1].getNumTrees == found.kept
    again = found.model.stages[-1].evaluateEachIteration(found.model.stages[0].transform(df.where(aside)))
    assert again == pytest.approx(found.losses[: found.kept])
    assert found.losses[found.kept - 1] == min(found.losses[: found.kept + 5])


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_node_tables_give_the_scores_of_the_model(spark, tmp_path, kind):
    train, held = learnable(spark)
    inputs = ["a", "b", "c"]
    make = models.boosted_trees if kind == "boosted" else models.random_forest
    model = make(train, inputs, 8, 4)
    path = save_model(model, str(tmp_path), kind)
    nodes = models.node_table(spark, path)
    assert nodes.select("tree").distinct().count() == 8
    assert nodes.where("(value IS NULL) = (feature IS NULL)").count() == 0
    walked = {(r.user_id, r.product_id): r.score for r in models.score_by_nodes(held, nodes, inputs, kind == "boosted", 4).collect()}
    scored = models.predict(model, held).collect()
    assert len(walked) == len(scored) > 100
    assert all(abs(walked[r.user_id, r.product_id] - r.score) < 1e-6 for r in scored)


def test_logistic_stack_is_its_weights(spark):
    train, held = learnable(spark)
    model = models.stack_logistic(train, ["a", "b"])
    fit = model.stages[-1]
    weights = dict(zip(["a", "b"], fit.coefficients.toArray().tolist()))
    margins = {r.user_id: r.margin for r in models.score_linear(held, weights, "margin", fit.intercept).collect()}
    for r in models.predict(model, held).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-margins[r.user_id])), abs=1e-6)


def test_registered_scores_are_those_of_the_node_table(spark):
    """The served model on the registered test rows: walked node by node in SQL over its table."""
    scores, walked = (rows(QUERIES[k](spark, TINY)) for k in ("l3_predictions", "l3_node_predictions"))
    assert len(scores) == len(walked) > 0
    assert all(a[:3] == b[:3] and abs(a[3] - b[3]) < 2e-6 for a, b in zip(scores, walked))
    stopping = QUERIES["l1_early_stopping"](spark, TINY).collect()
    kept = [r for r in stopping if r.is_kept]
    trees = QUERIES["l1_model_nodes"](spark, TINY).select("tree").distinct().count()
    assert len(kept) == 1 and trees == kept[0].round and kept[0].validation_loss == min(r.validation_loss for r in stopping[: trees + 20])
    board = QUERIES["l8_leaderboard"](spark, TINY).collect()
    assert [r.is_best for r in board].count(1) == 1 and max(board, key=lambda r: r.auc).auc == next(r.auc for r in board if r.is_best)


def test_discounted_metrics_match_brute_force(spark):
    """Repeated products, lists without hits, shorter and longer than K and than the truth; users without truth or list."""
    rng = np.random.default_rng(4)
    lists = {u: rng.integers(0, 12, rng.integers(1, 9)).tolist() for u in range(30)}
    lists[3] = [5] * 6
    truth = {u: sorted(set(rng.integers(0, 12, rng.integers(1, 8)).tolist())) for u in range(5, 35)}
    truth[3], truth[6] = [5], [99]
    recs = [(u, i + 1, p) for u, ps in lists.items() for i, p in enumerate(ps)]
    pairs = [(u, p) for u, ps in truth.items() for p in [*ps, ps[0]]]
    got = metrics.discounted_metrics(
        spark.createDataFrame(recs, "user_id long, rank int, product_id long"), spark.createDataFrame(pairs, "user_id long, product_id long"), (1, 3, 7)
    )
    for row in got.collect():
        aps, ndcgs, rrs = [], [], []
        for u in lists.keys() & truth.keys():
            first = {}
            for rank, p in enumerate(lists[u], 1):
                first.setdefault(p, rank)
            hits = sorted(rank for p, rank in first.items() if p in truth[u] and rank <= row.k)
            full = min(row.k, len(truth[u]))
            aps.append(sum((n + 1) / rank for n, rank in enumerate(hits)) / full)
            ndcgs.append(sum(1 / math.log2(rank + 1) for rank in hits) / sum(1 / math.log2(i + 1) for i in range(1, full + 1)))
            rrs.append(1 / hits[0] if hits else 0)
        assert (row.n_users, row.map, row.ndcg, row.mrr) == (len(aps), *(pytest.approx(np.mean(x), abs=1e-6) for x in (aps, ndcgs, rrs)))
    none = metrics.discounted_metrics(spark.createDataFrame(recs, "user_id long, rank int, product_id long"), spark.createDataFrame([], "user_id long, product_id long"))
    assert none.count() == 0


def test_novelty_of_products_nobody_bought(spark):
    bought = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 1), (4, 2)], "user_id long, product_id long")
    recs = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 9)], "user_id long, rank int, product_id long")
    row = metrics.novelty(recs, bought).first()
    assert (row.avg_novelty, row.n_never_bought) == (pytest.approx((-math.log2(3 / 4) + 2 + 2) / 3, abs=1e-6), 1)


def test_retention_is_a_dense_triangle(spark):
    placed = [(1, "2024-01-30"), (1, "2024-04-01"), (2, "2024-01-02"), (2, "2024-01-03"), (3, "2024-03-15"), (None, "2024-02-01"), (4, None)]
    orders = spark.createDataFrame(placed, "user_id long, day string").withColumn("day", F.col("day").cast("date"))
    got = [(str(r.cohort), r.period, r.n_users, r.n_active, r.retention) for r in eda.cohort_retention(orders, "day").collect()]
    assert sorted(got) == [
        ("2024-01-01", 0, 2, 2, 1.0), ("2024-01-01", 1, 2, 0, 0.0), ("2024-01-01", 2, 2, 0, 0.0), ("2024-01-01", 3, 2, 1, 0.5),
        ("2024-03-01", 0, 1, 1, 1.0), ("2024-03-01", 1, 1, 0, 0.0),
    ]


def test_every_window_is_a_target(spark):
    hits, meta = (QUERIES[k](spark, TINY).first() for k in ("m7_hit_rates", "q7_sequence_metadata"))
    assert hits.n_targets == meta.total_targets


def test_report_with_additional_metrics(spark):
    train, _ = learnable(spark, 60)
    report = metrics.model_report(train.withColumn("score", F.col("a")), "m", additional={"train_minutes": 3.5, "map_at_10": 0.25})
    nested = metrics.nested_report(report).first()
    assert (nested.additional.train_minutes, nested.additional.map_at_10) == (3.5, 0.25)


def test_checksums_wrap_beyond_a_long(spark):
    """Sums of this size failed with an overflow."""
    values = [0, 7, -7, 2**63 - 1, -(2**63), 2**63, 2**64 + 5, -(2**64) - 5, 10**30]
    df = spark.createDataFrame([(str(v),) for v in values], "x string").select(scalar.wrapped(F.col("x").cast("decimal(38,0)")).alias("x"))
    assert [r.x for r in df.collect()] == [(v + 2**63) % 2**64 - 2**63 for v in values]


def test_lines_are_dealt_once_by_order_and_once_by_pair(spark):
    """Tasks follow the lines; the lines are exchanged twice, not once for each step."""
    from cartwheel.sources import retail

    orders = spark.createDataFrame(
        [(1, 5, "prior", 1), (2, 5, "train", 2), (3, None, "prior", 1), (4, 6, "prior", 1)], "order_id long, user_id long, eval_set string, order_number int"
    ).selectExpr("*", "0 AS order_dow", "0 AS order_hour_of_day", "0D AS days_since_prior_order")
    raw = spark.createDataFrame(
        [(1, 0, 1), (1, 0, 2), (1, 1, 3), (2, 0, 1), (2, 2, 1), (3, 0, 1), (4, 1, 1), (9, 1, 1)], "l_orderkey long, l_partkey long, l_linenumber int"
    )
    facts = retail.facts_from(raw, orders, None)
    assert rows(facts, "order_id", "product_id", "add_to_cart_order", "reordered") == [
        (1, 1, 1, 0), (1, 2, 2, 0), (2, 1, 1, 1), (2, 3, 2, 0), (4, 2, 1, 0)
    ]
    assert facts._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2


def test_the_split_neither_sorts_nor_moves_whole_rows(spark):
    df = spark.range(2000).selectExpr("id AS user_id", "id % 7 AS product_id", "int(id % 10 = 0) AS label", "id AS wide")
    split = candidates.stratified_split(df, 0.2, 42)
    assert rows(split.groupBy("label", "split").count()) == [(0, "test", 360), (0, "train", 1440), (1, "test", 40), (1, "train", 160)]
    text = split._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and "hashpartitioning(label" not in text.split("Union")[0]
    drawn = split.orderBy("label", F.md5(F.concat_ws("#", F.lit("42"), "user_id", "product_id")), "user_id").collect()
    for label, n in ((0, 360), (1, 40)):
        assert [r.split for r in drawn if r.label == label][: n + 1] == ["test"] * n + ["train"]


def test_a_cut_model_is_a_shorter_fit(spark, monkeypatch):
    train, held = learnable(spark)
    fits = []
    fit = models.boosted_trees
    monkeypatch.setattr(models, "boosted_trees", lambda *a, **k: fits.append(1) or fit(*a, **k))
    found = models.stopped_trees(train, held, ["a", "b", "c"], iterations=9, depth=4, patience=1)
    assert len(fits) == 1
    cut = models.first_rounds(fit(train, ["a", "b", "c"], 9, 4), 4)
    short = fit(train, ["a", "b", "c"], 4, 4)
    assert cut.stages[-1].getNumTrees == 4 and found.model.stages[-1].getNumTrees == found.kept
    assert rows(models.predict(cut, held), "user_id", "score") == rows(models.predict(short, held), "user_id", "score")
    assert list(cut.stages[-1].featureImportances.toArray()) == list(short.stages[-1].featureImportances.toArray())


def test_the_sample_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    df = spark.range(5000).selectExpr("id AS user_id", "id % 7 AS product_id", "id % 2 AS label")
    got = models.bounded_sample(df, 1000)
    assert got.rdd.getNumPartitions() == 10
    order = [F.xxhash64("user_id", "product_id"), "user_id", "product_id"]
    assert rows(got) == rows(df.orderBy(*order).limit(1000))
    assert rows(models.bounded_sample(df, 1000)) == rows(got)


def test_all_rows_are_fitted_on(spark, monkeypatch):
    """Learners saw at most half a million rows."""
    from registry import models as registered

    monkeypatch.setattr(models, "TASK_ROWS", 100)
    monkeypatch.setattr(models, "TASKS", 16)
    sample = models.bounded_sample
    monkeypatch.setattr(models, "bounded_sample", lambda rows, limit=1000: sample(rows, limit))
    monkeypatch.setattr(registered, "fitted", lambda s, name, fit: fit())
    df = spark.range(5000).selectExpr("id AS user_id", "id % 7 AS product_id", "id % 2 AS label", "if(id % 10 < 8, 'train', 'test') AS split")
    train, test = registered.parts(None, df.unionByName(df.limit(1)))
    assert rows(train) == rows(df.unionByName(df.limit(1)).where("split = 'train'").drop("split"))
    assert train.count() == 4001 and test.count() == 1000 and train.rdd.getNumPartitions() == 16
    assert [tuple(r) for r in train.collect()] == [tuple(r) for r in train.collect()]


def test_reports_of_the_leaderboard_are_made_one_by_one(spark):
    """The six reports ran at once as parts of one plan."""
    text = QUERIES["l8_leaderboard"](spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "UDF" not in text and text.count("Relation") >= 6


def test_what_is_owned_beyond_the_needed_places_is_left_out(spark, monkeypatch):
    """The walk saw the whole history of every owner, and of those that are none."""
    seen = []
    walk = candidates.running
    monkeypatch.setattr(candidates, "running", lambda df, *a, **k: seen.append(df.count()) or walk(df, *a, **k))
    ranked = spark.range(1, 1001).selectExpr("id * 7 AS product_id", "id AS popularity_rank", "1000 - id AS popularity_score")
    owned = spark.createDataFrame([(u, 7 * r) for u in (1, 2) for r in (2, 9, *range(500, 540))] + [(3, 7 * 12)], "user_id long, product_id long")
    got = candidates.missing_from_top(spark.createDataFrame([(1,), (3,), (None,)], "user_id long"), owned, ranked, "user_id", 10)
    want = {1: [r for r in range(1, 13) if r not in (2, 9)], 3: list(range(1, 11)), None: list(range(1, 11))}
    assert rows(got, "user_id", "product_id", "popularity_score") == sorted(((u, 7 * r, 1000 - r) for u, rs in want.items() for r in rs), key=repr)
    assert seen == [5]  # two places of user 1 and the end of the ranking for each owner


def test_candidates_bring_what_is_known_of_them(spark):
    history = spark.createDataFrame([(1, 5, 3, 9), (1, 6, 1, 2), (1, 7, 1, 1), (2, 5, 1, 1)], "user_id long, product_id long, times_bought long, last_order int")
    ranked = spark.createDataFrame([(5, 4, 1), (8, 2, 2), (9, 1, 3)], "product_id long, popularity_score long, popularity_rank long")
    users = spark.createDataFrame([(1,)], "user_id long")
    got = candidates.candidate_rows(users, history, ranked, 2, 1)
    assert rows(got, "user_id", "product_id", "times_bought", "last_order", "popularity_score") == [
        (1, 5, 3, 9, None), (1, 6, 1, 2, None), (1, 8, None, None, 2)
    ]
    assert rows(candidates.candidates(users, history, ranked, 2, 1)) == [(1, 5), (1, 6), (1, 8)]


def test_lines_and_pairs_of_a_user_lie_side_by_side(spark):
    from cartwheel.sources import retail

    lines = facts(spark, *[(u, n, c, c * u) for u in range(40) for n in range(1, 5) for c in range(1, 6)])
    orders = lines.selectExpr("order_id", "user_id", "'prior' AS eval_set", "order_number", "0 AS order_dow", "0 AS order_hour_of_day", "0D AS days_since_prior_order").distinct()
    raw = lines.selectExpr("order_id AS l_orderkey", "product_id - 1 AS l_partkey", "add_to_cart_order AS l_linenumber")
    for table in (retail.facts_from(raw, orders, None), pair_features.pair_sums(lines, 8)):
        places = table.withColumn("_task", F.spark_partition_id()).groupBy("user_id").agg(F.count_distinct("_task").alias("n"))
        assert places.agg(F.sum("n") - F.count("n")).first()[0] < 8 and table.rdd.getNumPartitions() >= 4


def test_line_metrics_are_worked_out_once(spark):
    """Edges and scores each summed the lines again."""
    lines = facts(spark, *[(u, n, c, c) for u in range(1, 9) for n in range(1, u + 1) for c in (1, 2)])
    scored_users = rfm.score_line_metrics(rfm.line_metrics(lines))
    plan = scored_users._jdf.queryExecution().optimizedPlan().toString()
    assert "add_to_cart_order" not in plan and "LogicalRDD" not in plan and plan.count("Relation") >= 1
    assert scored_users.count() == 8


def matrix_parts(spark):
    labelled = spark.createDataFrame([(u, p, (u + p) % 2) for u in range(6) for p in (1, 2, 10 + u)] + [(None, 1, 0), (9, None, 1)], "user_id long, product_id long, label int")
    pairs = spark.createDataFrame([(u, 10 + u, u * 2) for u in range(6)], "user_id long, product_id long, ui_n int")
    users = spark.createDataFrame([(u, u * 1.5) for u in range(5)], "user_id long, user_x double")
    items = spark.createDataFrame([(p, p * 3, f"d{p}") for p in (1, 2, 10, 11, 12, 13)], "product_id long, item_n int, department string")
    return labelled, users, items, pairs


def test_the_matrix_is_exchanged_once_by_user(spark):
    """Its rows went by pair, by user and, whole, by product."""
    labelled, users, items, pairs = matrix_parts(spark)
    plain = candidates.training_matrix(labelled, users, items, pairs)
    hot = spark.createDataFrame([(1,), (2,), (77,)], "product_id long")
    dealt = candidates.training_matrix(labelled, users, items, pairs, hot, 3)
    assert dealt.columns == plain.columns == ["product_id", "user_id", "label", "ui_n", "user_x", "item_n", "department"]
    assert rows(dealt) == rows(plain) and plain.count() == 20
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        text = candidates.training_matrix(labelled, users, items, pairs, hot, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    dealt_by = re.findall(r"hashpartitioning\((.*?), \d+\)", text)
    assert sorted(re.sub(r"#\d+L?", "", k) for k in dealt_by) == ["_user", "product_id", "product_id", "user_id", "user_id"]


def test_labels_meet_the_pairs_of_a_user(spark):
    pairs = spark.createDataFrame([(u, p) for u in range(5) for p in range(4)] + [(None, 1), (1, None)], "user_id long, product_id long")
    bought = spark.createDataFrame([(1, 2), (1, 2), (3, 0), (3, 9), (None, 1), (7, 7), (1, None)], "user_id long, product_id long")
    got = candidates.label_pairs(pairs, bought, 3)
    assert rows(got) == rows(candidates.label_pairs(pairs, bought)) and rows(got.where("label = 1")) == [(1, 2, 1), (3, 0, 1)]


def test_the_matrix_is_written_once(spark, monkeypatch):
    from cartwheel import session
    from cartwheel.sources.retail import Star
    from registry.candidates import matrix

    labels = []
    name = session.new_path
    monkeypatch.setattr(session, "new_path", lambda s, label: labels.append(label) or name(s, label))
    star = Star(spark, TINY, version="written once")
    assert matrix(star).count() == matrix(star).count() > 0
    assert labels.count("matrix") == 1
