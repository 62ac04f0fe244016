"""Candidates, labels, samples, splits, and the scored pairs later sections use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.scalar import beside, long, ratio as ratio_of, rounded, zero
from cartwheel.operators import candidates, facts, item_features, pair_features, user_features
from cartwheel.plans import training
from cartwheel.session import new_path, staged
from cartwheel.sources.files import load_json, load_parquet
from registry.base import fragment, query, r, ratio

fragment("targets", "SELECT DISTINCT user_id FROM ord WHERE eval_set = 'train'")
fragment(
    "history",
    "SELECT user_id, product_id, count(*) AS times_bought, max(order_number) AS last_order FROM prior_lines GROUP BY user_id, product_id",
)
fragment(
    "popular",
    """
      SELECT product_id, count(*) AS popularity_score, row_number() OVER (ORDER BY count(*) DESC, product_id) AS popularity_rank
      FROM prior_lines GROUP BY product_id""",
)
fragment(
    "reorder_cands",
    """
      SELECT user_id, product_id FROM history SEMI JOIN targets USING (user_id)
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY product_id) <= 15""",
)
fragment(
    "popular_cands",
    """
      SELECT t.user_id, p.product_id FROM targets t, popular p
      ANTI JOIN history h ON h.user_id = t.user_id AND h.product_id = p.product_id
      QUALIFY row_number() OVER (PARTITION BY t.user_id ORDER BY p.popularity_rank) <= 20""",
)
fragment("cands", "SELECT * FROM reorder_cands UNION SELECT * FROM popular_cands")
fragment(
    "labelled",
    """
      SELECT c.user_id, c.product_id, (t.user_id IS NOT NULL)::INTEGER AS label
      FROM cands c LEFT JOIN (SELECT DISTINCT user_id, product_id FROM train_lines) t USING (user_id, product_id)""",
)
fragment(
    "scored",
    f"""
      SELECT l.*,
             coalesce({r('popularity_score::DOUBLE / (SELECT max(popularity_score) FROM popular)', 6)}, 0) AS popular,
             coalesce({r('1.0 / (1 + newest - last_order)', 6)}, 0) AS recent,
             coalesce({r('times_bought::DOUBLE / n_orders', 6)}, 0) AS habit
      FROM labelled l LEFT JOIN popular USING (product_id) LEFT JOIN history USING (user_id, product_id)
      LEFT JOIN (SELECT user_id, max(order_number) AS newest, count(*) AS n_orders FROM ord WHERE eval_set = 'prior'
                 GROUP BY user_id) USING (user_id)""",
)


def _parts(s) -> training.Parts:
    return training.labelled_candidates(s)


def scored(s) -> DataFrame:
    """Labelled candidates with three plain scores, written once per application.

    popular: share of the best-seller's lines; recent: 1 / (1 + orders since the
    last purchase); habit: share of the user's orders with the product.
    """

    def build() -> DataFrame:
        parts = _parts(s)
        users = s.orders.where(F.col("eval_set") == "prior").groupBy("user_id").agg(
            F.max("order_number").alias("_newest"), F.count(F.lit(1)).alias("_orders")
        )
        most = parts.popular.agg(F.max("popularity_score").alias("_most"))
        # Candidates outside the history have their popularity, and no user or history score.
        bought = F.col("times_bought").isNotNull()
        known = (
            parts.candidates.where(bought).drop("popularity_score")
            .join(parts.popular.select("product_id", "popularity_score"), "product_id", "left")
            .join(users, "user_id", "left")
        )
        wide = known.unionByName(parts.candidates.where(~bought), allowMissingColumns=True).transform(beside, most)
        return wide.select(
            "user_id",
            "product_id",
            "label",
            ratio_of("popularity_score", "_most", 6).alias("popular"),
            zero(rounded(1.0 / (1 + F.col("_newest") - F.col("last_order")), 6)).alias("recent"),
            ratio_of("times_bought", "_orders", 6).alias("habit"),
        )

    return staged(s.spark, ("scored", *s.source), build)


_MATRIX: dict[tuple, DataFrame] = {}


def matrix(s) -> DataFrame:
    """Made once per application. It is a written table already, only the split is told as it is read."""
    key = (s.spark.sparkContext.applicationId, *s.source)
    if key not in _MATRIX:
        _MATRIX[key] = training.matrix(s)
    return _MATRIX[key]


@query("c1_target_users", "SELECT user_id FROM targets")
def _(s):
    return candidates.target_users(s.orders)


@query("c2_reorder_candidates", "SELECT * FROM reorder_cands")
def _(s):
    known = candidates.purchase_history(s.pairs("prior")).join(candidates.target_users(s.orders), "user_id", "left_semi")
    return candidates.reorder_candidates(known, 15)


@query(
    "c2_frequent_candidates",
    """SELECT user_id, product_id FROM history SEMI JOIN targets USING (user_id)
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY times_bought DESC, product_id) <= 15""",
)
def _(s):
    known = candidates.purchase_history(s.pairs("prior")).join(candidates.target_users(s.orders), "user_id", "left_semi")
    return candidates.reorder_candidates(known, 15, by_frequency=True)


@query("c3_popular_candidates", "SELECT * FROM popular_cands")
def _(s):
    lines = s.lines("prior")
    history = candidates.purchase_history(s.pairs("prior"))
    return candidates.popular_candidates(candidates.target_users(s.orders), history, candidates.popular_items(lines), 20)


@query("c4_candidates", "SELECT * FROM cands")
def _(s):
    lines = s.lines("prior")
    history = candidates.purchase_history(s.pairs("prior"))
    return candidates.candidates(candidates.target_users(s.orders), history, candidates.popular_items(lines))


@query("j11_labels", "SELECT * FROM labelled")
def _(s):
    return _parts(s).labelled


@query(
    "c5_class_stats",
    f"""SELECT count(*) AS n_samples, sum(label)::BIGINT AS n_positive, count(*) FILTER (label = 0) AS n_negative,
        {ratio('sum(label)', 'count(*)', 6)} AS positive_rate FROM labelled""",
)
def _(s):
    return candidates.class_stats(scored(s))


@query("c6_user_sample", "SELECT user_id FROM targets ORDER BY md5('42#' || user_id::VARCHAR), user_id LIMIT 500")
def _(s):
    return candidates.sample_users(candidates.target_users(s.orders), 500, 42)


@query(
    "c7_stratified_split",
    """SELECT user_id, product_id, label, CASE WHEN row_number() OVER (PARTITION BY label
         ORDER BY md5('42#' || user_id::VARCHAR || '#' || product_id::VARCHAR), user_id, product_id)
         <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS split FROM labelled""",
)
def _(s):
    return candidates.stratified_split(scored(s).select("user_id", "product_id", "label"), 0.2, 42)


@query(
    "c8_label_encoding",
    """SELECT user_id, Segment, (dense_rank() OVER (ORDER BY Segment) - 1)::INTEGER AS Segment_encoded FROM
       (SELECT user_id, coalesce(Segment, '0') AS Segment FROM (SELECT c_custkey AS user_id FROM customer)
        LEFT JOIN (SELECT user_id, Segment FROM rfm_segments) USING (user_id))""",
)
def _(s):
    """Segments of all customers; those without orders have none."""
    from cartwheel.operators import rfm

    known = rfm.segment_users(s.lines()).select("user_id", "Segment")
    customers = s.raw("customer").select(F.col("c_custkey").alias("user_id"))
    return candidates.encode_labels(customers.join(known, "user_id", "left"), "Segment")


@query(
    "c8_encoder_classes",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS class_name, (dense_rank() OVER (ORDER BY {c}) - 1)::INTEGER AS code FROM (SELECT DISTINCT {c} FROM prod)"
        for c in ("department", "aisle")
    ),
)
def _(s):
    return candidates.encoder_classes(s.catalogue, ["department", "aisle"])


@query(
    "c10_popular_items",
    """SELECT product_id, count(*) AS popularity_score, row_number() OVER (ORDER BY count(*) DESC, product_id) AS popularity_rank
       FROM train_lines GROUP BY product_id""",
)
def _(s):
    return candidates.popular_items(s.lines("train"))


@query(
    "c11_recent_purchases",
    """SELECT user_id, product_id, n_bought, rank::INTEGER AS rank FROM
       (SELECT user_id, product_id, count(*) AS n_bought,
               row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, product_id) AS rank
        FROM train_lines GROUP BY user_id, product_id) WHERE rank <= 50""",
)
def _(s):
    return candidates.recent_purchases(s.orders, s.order_products("train"))


@query(
    "c12_class_weights",
    f"""SELECT sum(label)::BIGINT AS n_positive, count(*) FILTER (label = 0) AS n_negative,
        {ratio('count(*) FILTER (label = 0)', 'sum(label)', 6)} AS positive_weight FROM labelled""",
)
def _(s):
    return candidates.class_weights(scored(s))


@query(
    "c12_row_weights",
    f"""SELECT user_id, product_id, label, {r('count(*) OVER ()::DOUBLE / (2.0 * count(*) OVER (PARTITION BY label))', 6)} AS weight
        FROM labelled""",
)
def _(s):
    weighted = candidates.with_balanced_weight(scored(s).select("user_id", "product_id", "label"))
    return weighted.withColumn("weight", rounded("weight", 6))


@query(
    "c13_trivial_baselines",
    f"""SELECT user_id, product_id, label,
        {r("('0x' || md5('42#' || user_id::VARCHAR || '#' || product_id::VARCHAR)[1:8])::UBIGINT::DOUBLE / 4294967296.0", 6)} AS score_random,
        (SELECT {r('avg(reordered)', 6)} FROM train_lines) AS score_majority FROM labelled""",
)
def _(s):
    base = candidates.constant_baselines(scored(s).select("user_id", "product_id", "label"), s.lines("train"))
    return base.withColumns({c: rounded(c, 6) for c in ("score_random", "score_majority")})


SPLIT_SQL = """SELECT user_id, product_id, label, CASE WHEN row_number() OVER (PARTITION BY label
         ORDER BY md5('42#' || user_id::VARCHAR || '#' || product_id::VARCHAR), user_id, product_id)
         <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS split FROM labelled"""


@query(
    "s10_saved_splits",
    f"""SELECT split, s.user_id, product_id, label, popularity_score, popularity_rank, train_size, test_size FROM ({SPLIT_SQL}) s
        LEFT JOIN popular USING (product_id),
        (SELECT count(*) FILTER (split = 'train') AS train_size, count(*) FILTER (split = 'test') AS test_size FROM ({SPLIT_SQL}))""",
)
def _(s):
    """Splits, candidates, popular products and metadata, all read back."""
    folder = new_path(s.spark, "artifacts")
    parts = _parts(s)
    split = candidates.stratified_split(parts.labelled, 0.2, 42)
    meta = training.save_splits(split, parts.labelled, parts.popular, folder)
    rows = load_parquet(s.spark, f"{folder}/splits").withColumn("split", F.col("split").cast("string"))
    kept = load_parquet(s.spark, f"{folder}/user_candidate_set.parquet")
    popular = load_parquet(s.spark, f"{folder}/popular_items.parquet")
    sizes = load_json(s.spark, f"{folder}/split_metadata", meta.schema).select("train_size", "test_size")
    whole = rows.join(kept, ["user_id", "product_id", "label"]).join(popular, "product_id", "left").transform(beside, sizes)
    return whole.select("split", "user_id", "product_id", "label", "popularity_score", "popularity_rank", "train_size", "test_size")
