"""Blending and serving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.scalar import rounded
from cartwheel.operators import candidates, item_features, recommend, rfm, user_features
from cartwheel.session import new_path
from cartwheel.sources.files import export_recommendations, load_csv
from registry.base import fragment, query, r
from registry.candidates import scored
from registry.segments import customers

MODELS = {"popular": "popular", "recent": "recent", "habit": "habit"}
WEIGHTS = {"popular": 0.5, "recent": 0.3, "habit": 0.2}

fragment(
    "long_scores",
    " UNION ALL ".join(f"SELECT user_id, product_id, '{m}' AS model, {m} AS score FROM scored" for m in MODELS),
)
fragment("avg_scores", f"SELECT user_id, product_id, label, {r('(popular + recent + habit) / 3', 6)} AS score FROM scored")
fragment(
    "top_avg",
    """
      SELECT user_id, product_id, label, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id)::INTEGER AS rank
      FROM avg_scores""",
)


def _ensemble(weights: dict[str, float], k: int) -> str:
    weight = "CASE model " + " ".join(f"WHEN '{m}' THEN {w}" for m, w in weights.items()) + " END"
    return f"""
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id)::INTEGER AS rank FROM
        (SELECT user_id, product_id, {r(f'sum(score * ({weight})::DOUBLE)', 6)} AS score,
                string_agg(model, ',' ORDER BY model) AS contributing_models, 'ensemble' AS model
         FROM (SELECT * FROM long_scores QUALIFY row_number() OVER
                 (PARTITION BY user_id, model ORDER BY score DESC, product_id) <= {2 * k})
         GROUP BY user_id, product_id)) WHERE rank <= {k}"""


fragment("blend", _ensemble({m: 1.0 for m in MODELS}, 10))


def long_scores(s) -> DataFrame:
    return recommend.to_long(scored(s), MODELS)


def avg_scores(s) -> DataFrame:
    score = rounded((F.col("popular") + F.col("recent") + F.col("habit")) / 3, 6)
    return scored(s).select("user_id", "product_id", "label", score.alias("score"))


def all_users(s) -> DataFrame:
    return s.orders.select("user_id").distinct()


@query(
    "a13_score_correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS model_a, '{b}' AS model_b, {r(f'corr({a}, {b})', 4) if a != b else 'max(1.0::DOUBLE)'} AS correlation FROM scored"
        for a in MODELS
        for b in MODELS
    ),
)
def _(s):
    from cartwheel.operators.eda import correlation_matrix

    return correlation_matrix(scored(s), list(MODELS))


@query("e1_simple_average", f"SELECT user_id, product_id, {r('avg(score)', 6)} AS score FROM long_scores GROUP BY user_id, product_id")
def _(s):
    return recommend.simple_average(long_scores(s))


def _auc(m: str) -> str:
    return f"""(SELECT {r("sum(p * (below + n / 2.0)) / (sum(p)::DOUBLE * sum(n)::DOUBLE)", 6)} FROM
      (SELECT p, n, sum(n) OVER (ORDER BY x) - n AS below FROM
        (SELECT {m} AS x, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY {m})))"""


def model_weights(s) -> DataFrame:
    """AUC of every model as its weight."""
    from functools import reduce

    from cartwheel.operators.metrics import roc_auc

    rows = [
        roc_auc(scored(s), score=m).select(F.lit(m).alias("model"), F.col("auc").alias("weight")) for m in MODELS
    ]
    return reduce(DataFrame.unionAll, rows)


fragment("model_weights", " UNION ALL ".join(f"SELECT '{m}' AS model, {_auc(m)} AS weight" for m in MODELS))


@query(
    "e2_weighted_average",
    f"""SELECT user_id, product_id, {r('sum(weight * score) / sum(weight)', 6)} AS score
        FROM long_scores JOIN model_weights USING (model) GROUP BY user_id, product_id""",
)
def _(s):
    return recommend.weighted_average(long_scores(s), model_weights(s))


@query("e3_ensemble", f"SELECT * FROM ({_ensemble(WEIGHTS, 10)})")
def _(s):
    blended = recommend.ensemble(long_scores(s), WEIGHTS, 10)
    return blended.withColumn("contributing_models", F.concat_ws(",", "contributing_models"))


@query("e4_top_k", "SELECT user_id, product_id, score, rank FROM top_avg WHERE rank <= 10")
def _(s):
    return recommend.top_k(avg_scores(s), 10).drop("label")


@query(
    "e5_exclude_seen",
    "SELECT user_id, product_id, score FROM avg_scores ANTI JOIN history USING (user_id, product_id)",
)
def _(s):
    seen = candidates.purchase_history(s.pairs("prior"))
    return recommend.exclude_seen(avg_scores(s).drop("label"), seen)


@query("e5_drop_padding", "SELECT user_id, product_id, idx FROM walk WHERE idx > 0")
def _(s):
    from cartwheel.operators.sequences import encode
    from registry.sequences import vocab_of

    coded = encode(s.lines("prior").select("user_id", "product_id"), vocab_of(s))
    return recommend.drop_padding(coded).select("user_id", "product_id", "idx")


fragment(
    "fallback_lists",
    f"""
      SELECT user_id, popularity_rank::INTEGER AS rank, product_id, {r('1.0 - (popularity_rank - 1) * 0.1', 6)} AS score, 'fallback' AS model
      FROM (SELECT DISTINCT user_id FROM ord), popular WHERE popularity_rank <= 10""",
)


@query(
    "e6_fallback",
    "SELECT * FROM fallback_lists WHERE user_id NOT IN (SELECT user_id FROM blend)",
)
def _(s):
    served = scored(s).select("user_id").distinct()
    missed = all_users(s).join(served, "user_id", "left_anti")
    return recommend.fallback(missed, candidates.popular_items(s.lines("prior")), 10)


@query(
    "e7_batch_recommendations",
    """SELECT user_id, rank, product_id, score, model FROM blend
       UNION ALL SELECT user_id, rank, product_id, score, model FROM fallback_lists WHERE user_id NOT IN (SELECT user_id FROM blend)""",
)
def _(s):
    popular = candidates.popular_items(s.lines("prior"))
    return recommend.recommend(all_users(s), long_scores(s), popular, "ensemble", 10)


@query("e7_unknown_model", "SELECT * FROM fallback_lists")
def _(s):
    popular = candidates.popular_items(s.lines("prior"))
    return recommend.recommend(all_users(s), long_scores(s), popular, "no such model", 10)


@query(
    "e8_popular_products",
    "SELECT product_id, count(DISTINCT order_id) AS total_orders FROM lines GROUP BY product_id ORDER BY 2 DESC, 1 LIMIT 100",
)
def _(s):
    return recommend.popular_products(item_features.popularity_counts(s.pairs()))


def _diverse(where: str) -> str:
    return f"""
      WITH named AS (SELECT a.user_id, a.product_id, a.score, p.department,
             row_number() OVER (PARTITION BY a.user_id, p.department ORDER BY a.score DESC, a.product_id) AS place
           FROM avg_scores a JOIN prod p USING (product_id) {where}),
      heads AS (SELECT user_id, department FROM named WHERE place = 1
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, department) <= 4)
      SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id)::INTEGER AS rank,
             product_id, department, score FROM named SEMI JOIN heads USING (user_id, department) WHERE place <= 2)
      WHERE rank <= 6"""


@query("e9_diversified", f"SELECT * FROM ({_diverse('')})")
def _(s):
    return recommend.diversified(avg_scores(s).drop("label"), s.catalogue, 6, 2, 4)


@query("e9_department_whitelist", f"SELECT * FROM ({_diverse('''WHERE p.department IN ('ECONOMY', 'PROMO', 'SMALL')''')})")
def _(s):
    return recommend.diversified(
        avg_scores(s).drop("label"), s.catalogue, 6, 2, 4, ["ECONOMY", "PROMO", "SMALL"]
    )


fragment(
    "presented",
    """
      SELECT user_id, rank, product_id, product_name, upper(department[1]) || lower(department[2:]) AS department,
             coalesce(aisle, 'Unknown') AS aisle, greatest(0.1, least(0.95, score)) AS score,
             CASE WHEN score > 0.6 THEN 'High' WHEN score > 0.3 THEN 'Medium' ELSE 'Low' END AS confidence
      FROM top_avg LEFT JOIN prod USING (product_id) WHERE rank <= 10""",
)


def presented(s) -> DataFrame:
    return recommend.present(recommend.top_k(avg_scores(s), 10), s.catalogue)


@query("e10_presented", "SELECT * FROM presented")
def _(s):
    return presented(s)


@query(
    "e11_customer_profiles",
    """SELECT c.user_id, frequency, monetary, Segment, (s.user_id IS NOT NULL)::INTEGER AS is_known
       FROM (SELECT c_custkey AS user_id FROM customer) c
       LEFT JOIN (SELECT * FROM order_segments WHERE user_id IN (SELECT user_id FROM targets)) s USING (user_id)""",
)
def _(s):
    """All customers looked up among those with a train order."""
    profiles = rfm.segment_users_by_orders(s.orders, s.lines()).join(
        candidates.target_users(s.orders), "user_id", "left_semi"
    )
    request = s.raw("customer").select(F.col("c_custkey").alias("user_id"))
    return recommend.customer_profiles(request, profiles.select("user_id", "frequency", "monetary", "Segment"))


def _attribute(table: dict, default: tuple, fields: tuple) -> str:
    cases = []
    for i, field in enumerate(fields):
        whens = " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in table.items())
        cases.append(f"CASE segment_display {whens} ELSE '{default[i]}' END AS {field}")
    return ", ".join(cases)


MARKETING = f"""{_attribute(recommend.INSIGHTS, recommend.INSIGHT_DEFAULT, recommend.INSIGHT_FIELDS)},
  {_attribute(recommend.STRATEGIES, recommend.STRATEGY_DEFAULT, recommend.STRATEGY_FIELDS)}"""


@query(
    "e12_marketing",
    f"""SELECT user_id, segment_display, {MARKETING}, favourite_department FROM customers LEFT JOIN
        (SELECT user_id, department AS favourite_department FROM presented WHERE rank = 1) USING (user_id)""",
)
def _(s):
    people = recommend.with_marketing(customers(s).select("user_id", "segment_display"))
    return people.join(recommend.favourite_department(presented(s)), "user_id", "left")


@query("s11_exported_recommendations", "SELECT user_id, rank, product_id, product_name, department, aisle, score, confidence FROM presented")
def _(s):
    path = new_path(s.spark, "recommendations-csv")
    table = presented(s)
    export_recommendations(table, path)
    return load_csv(s.spark, path, table.schema)
