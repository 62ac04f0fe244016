"""Evaluation metrics over the plain scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from cartwheel.functions.ordered import top_per_group
from cartwheel.operators import eda, metrics, recommend, sequences
from cartwheel.session import new_path
from cartwheel.sources.files import load_json, save_json
from registry.base import fragment, query, r, ratio
from registry.candidates import scored
from registry.recommend import MODELS, _auc, avg_scores
from registry.sequences import VOCABULARY

KS = (5, 10, 20)
F1 = "coalesce(2 * p * c / nullif(p + c, 0), 0)"

fragment(
    "recs20", "SELECT user_id, product_id, rank FROM top_avg WHERE rank <= 20"
)
fragment("truth", "SELECT DISTINCT user_id, product_id FROM train_lines")


def recs20(s) -> DataFrame:
    return recommend.top_k(avg_scores(s), 20).select("user_id", "product_id", "rank")


def truth(s) -> DataFrame:
    return s.lines("train").select("user_id", "product_id")


@query("m1_roc_auc", " UNION ALL ".join(f"SELECT '{m}' AS model, {_auc(m)} AS auc" for m in MODELS))
def _(s):
    parts = [metrics.roc_auc(scored(s), score=m).select(F.lit(m).alias("model"), "auc") for m in MODELS]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


PR_SQL = f"""
  SELECT {r('sum(p * (tp::DOUBLE / (tp + fp) + coalesce((tp - p)::DOUBLE / nullif(tp - p + fp - n, 0), 1)) / 2) / sum(p)', 6)} AS pr_auc
  FROM (SELECT p, n, sum(p) OVER (ORDER BY x DESC) AS tp, sum(n) OVER (ORDER BY x DESC) AS fp FROM
    (SELECT score AS x, sum(label) AS p, sum(1 - label) AS n FROM avg_scores GROUP BY score))"""


@query("m2_pr_auc", PR_SQL)
def _(s):
    return metrics.pr_auc(avg_scores(s))


fragment(
    "confusion",
    """
      SELECT count(*) FILTER (score > 0.3 AND label = 1) AS tp, count(*) FILTER (score > 0.3 AND label = 0) AS fp,
             count(*) FILTER (score <= 0.3 AND label = 1) AS fn, count(*) FILTER (score <= 0.3 AND label = 0) AS tn FROM avg_scores""",
)
THRESHOLD_SQL = f"""{ratio('tp + tn', 'tp + fp + fn + tn', 6)} AS accuracy, {ratio('tp', 'tp + fp', 6)} AS precision,
  {ratio('tp', 'tp + fn', 6)} AS recall,
  {r(f"coalesce(2 * {ratio('tp', 'tp + fp')} * {ratio('tp', 'tp + fn')} / nullif({ratio('tp', 'tp + fp')} + {ratio('tp', 'tp + fn')}, 0), 0)", 6)} AS f1"""
AVG_AUC = _auc("score").replace("FROM scored", "FROM avg_scores")


@query("m3_classification_metrics", f"SELECT {AVG_AUC} AS auc, {THRESHOLD_SQL} FROM confusion")
def _(s):
    return metrics.classification_metrics(avg_scores(s), threshold=0.3)


fragment(
    "at_k",
    f"""
      SELECT k, {ratio('sum(label)', 'count(*)')} AS p, {ratio('sum(label)', '(SELECT sum(label) FROM avg_scores)')} AS c
      FROM (SELECT label, row_number() OVER (ORDER BY score DESC, user_id, product_id) AS n FROM avg_scores), (SELECT unnest([5, 10, 20]) AS k)
      WHERE n <= k GROUP BY k""",
)


@query("m4_ranking_metrics", f"SELECT k, {r('p', 6)} AS precision, {r('c', 6)} AS recall, {r(F1, 6)} AS f1 FROM at_k")
def _(s):
    return metrics.ranking_metrics(avg_scores(s))


def _per_user(source: str, relevant: str, hit: str) -> str:
    return f"""SELECT k::INTEGER AS k, count(*) AS n_users, {r('avg(hits::DOUBLE / recs)', 6)} AS avg_precision,
      {r('avg(coalesce(hits::DOUBLE / nullif(relevant, 0), 0))', 6)} AS avg_recall,
      {r('coalesce(2 * avg(hits::DOUBLE / recs) * avg(coalesce(hits::DOUBLE / nullif(relevant, 0), 0)) / nullif(avg(hits::DOUBLE / recs) + avg(coalesce(hits::DOUBLE / nullif(relevant, 0), 0)), 0), 0)', 6)} AS avg_f1
      FROM (SELECT k, user_id, count(*) AS recs, count(*) FILTER ({hit}) AS hits
            FROM {source}, (SELECT unnest([5, 10, 20]) AS k) WHERE rank <= k GROUP BY k, user_id)
      JOIN ({relevant}) USING (user_id) GROUP BY k"""


@query(
    "m5_recommendation_metrics",
    _per_user(
        "(SELECT r.*, t.user_id IS NOT NULL AS hit FROM recs20 r LEFT JOIN truth t USING (user_id, product_id))",
        "SELECT user_id, count(*) AS relevant FROM truth GROUP BY user_id",
        "hit",
    ),
)
def _(s):
    return metrics.recommendation_metrics(recs20(s), truth(s))


@query(
    "m6_per_user_ranking",
    _per_user("top_avg", "SELECT user_id, sum(label) AS relevant FROM avg_scores GROUP BY user_id", "label = 1"),
)
def _(s):
    return metrics.per_user_ranking(avg_scores(s))


fragment(
    "item_lists",
    """
      SELECT prev, idx, rank FROM
        (SELECT p.idx AS prev, v.idx, row_number() OVER (PARTITION BY p.idx
           ORDER BY coalesce(s.probability, 0.4 * k.n / k.n_all) DESC, v.product_id) AS rank
         FROM (SELECT idx, product_id FROM vocab UNION ALL SELECT 0, NULL) p CROSS JOIN vocab v
         JOIN (SELECT product_id, count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS n_all
               FROM walk WHERE idx > 0 GROUP BY product_id) k ON k.product_id = v.product_id
         LEFT JOIN steps s ON s.prev_product_id = p.product_id AND s.product_id = v.product_id)
      WHERE rank <= 20""",
)


@query(
    "m7_hit_rates",
    f"""SELECT count(*) AS n_targets, {', '.join(f"{ratio(f'count(*) FILTER (rank <= {k})', 'count(*)', 6)} AS hit_rate_{k}" for k in KS)}
        FROM (SELECT string_split(seq, ',')[20]::INTEGER AS prev, target FROM windows) w
        LEFT JOIN item_lists l ON l.prev = w.prev AND l.idx = w.target""",
)
def _(s):
    """Is the target of a window among the next items of its last one? A window is a row, no list is copied for it."""
    vocab = sequences.vocabulary(s.lines("prior"), VOCABULARY)
    windows = sequences.next_item_windows(s.lines("prior"), vocab)
    targets = windows.select(F.element_at("seq", -1).alias("prev"), "target")
    return metrics.hit_rates(sequences.window_lists(s.lines("prior"), vocab, max(KS)), targets, KS, keys=["prev"])


@query(
    "k1_discounted_metrics",
    f"""SELECT k::INTEGER AS k, count(*) AS n_users, {r('avg(precisions / least(k, relevant))', 6)} AS map,
          {r('avg(gains / list_sum(list_transform(range(1, least(k, relevant) + 1), lambda i: 1 / log2(i + 1))))', 6)} AS ndcg,
          {r('avg(coalesce(1.0::DOUBLE / best, 0))', 6)} AS mrr
        FROM (SELECT k, user_id, coalesce(sum(nth::DOUBLE / rank) FILTER (hit), 0) AS precisions,
                coalesce(sum(1 / log2(rank + 1.0)) FILTER (hit), 0) AS gains, min(rank) FILTER (hit) AS best
              FROM (SELECT user_id, rank, t.user_id IS NOT NULL AS hit,
                      count(t.user_id) OVER (PARTITION BY r.user_id ORDER BY rank) AS nth
                    FROM recs20 r LEFT JOIN truth t USING (user_id, product_id)), (SELECT unnest([5, 10, 20]) AS k)
              WHERE rank <= k GROUP BY k, user_id)
        JOIN (SELECT user_id, count(*) AS relevant FROM truth GROUP BY user_id) USING (user_id) GROUP BY k""",
)
def _(s):
    return metrics.discounted_metrics(recs20(s), truth(s), KS)


@query(
    "k4_novelty",
    f"""SELECT {r('avg(-log2(greatest(coalesce(buyers, 1), 1)::DOUBLE / (SELECT count(DISTINCT user_id) FROM prior_lines)))', 6)} AS avg_novelty,
          count(*) FILTER (buyers IS NULL) AS n_never_bought
        FROM recs20 LEFT JOIN (SELECT product_id, count(DISTINCT user_id) AS buyers FROM prior_lines GROUP BY product_id) USING (product_id)""",
)
def _(s):
    return metrics.novelty(recs20(s), s.lines("prior"))


@query(
    "k5_cohort_retention",
    f"""SELECT * FROM (WITH active AS (SELECT DISTINCT o_custkey AS user_id, date_trunc('month', o_orderdate)::DATE AS m FROM orders),
          started AS (SELECT user_id, min(m) AS cohort FROM active GROUP BY user_id),
          sizes AS (SELECT cohort, count(*) AS n_users FROM started GROUP BY cohort),
          dense AS (SELECT cohort, n_users, unnest(range(0, date_diff('month', cohort, (SELECT max(m) FROM active)) + 1)) AS period FROM sizes),
          seen AS (SELECT cohort, date_diff('month', cohort, m) AS period, count(*) AS n FROM active JOIN started USING (user_id) GROUP BY ALL)
        SELECT strftime(cohort, '%Y-%m') AS cohort, period::INTEGER AS period, n_users, coalesce(n, 0) AS n_active, {ratio('coalesce(n, 0)', 'n_users', 6)} AS retention
        FROM dense LEFT JOIN seen USING (cohort, period))""",
)
def _(s):
    orders = s.raw("orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate")
    return eda.cohort_retention(orders, "o_orderdate").withColumn("cohort", F.date_format("cohort", "yyyy-MM"))


@query(
    "m8_coverage_metrics",
    f"""SELECT {ratio('count(DISTINCT product_id)', '(SELECT count(*) FROM prod)', 6)} AS catalog_coverage,
        (SELECT {r('avg(d::DOUBLE / n)', 6)} FROM (SELECT count(DISTINCT product_id) d, count(*) n FROM recs20 GROUP BY user_id) WHERE n > 1) AS avg_list_diversity,
        count(DISTINCT product_id) AS total_unique_recommendations FROM recs20""",
)
def _(s):
    return metrics.coverage_metrics(recs20(s), s.catalogue)


@query(
    "m9_business_metrics",
    f"""SELECT {r('avg(coalesce(popularity_score, 0))', 4)} AS avg_item_popularity, {r('avg(coalesce(p_retailprice, 0))', 4)} AS avg_item_revenue,
        {r('sum(coalesce(p_retailprice, 0))', 2)} AS total_potential_revenue
        FROM recs20 LEFT JOIN popular USING (product_id) LEFT JOIN (SELECT p_partkey + 1 AS product_id, p_retailprice FROM part) USING (product_id)""",
)
def _(s):
    popularity = s.lines("prior").groupBy("product_id").agg(F.count(F.lit(1)).cast("double").alias("popularity"))
    revenue = s.raw("part").select((F.col("p_partkey") + 1).alias("product_id"), F.col("p_retailprice").alias("revenue"))
    return metrics.business_metrics(recs20(s), popularity, revenue)


AT_K_SQL = ", ".join(
    f"max({x}) FILTER (k = {k}) AS {n}_at_{k}"
    for k in KS
    for n, x in (("precision", r("p", 6)), ("recall", r("c", 6)), ("f1", r(F1, 6)))
)
REPORT_SQL = f"""
  SELECT 'average' AS model_name, n AS total_samples, pos AS positive_samples, n - pos AS negative_samples, {ratio('pos', 'n', 6)} AS positive_rate,
         auc, accuracy, precision, recall, f1, tops.*, {r('(auc - 0.5) / 0.5 * 100', 1)} AS improvement_over_random
  FROM (SELECT count(*) AS n, sum(label)::BIGINT AS pos FROM avg_scores),
       (SELECT {AVG_AUC} AS auc, {THRESHOLD_SQL.replace('0.3', '0.5')} FROM half), (SELECT {AT_K_SQL} FROM at_k) tops"""
fragment(
    "half",
    """
      SELECT count(*) FILTER (score > 0.5 AND label = 1) AS tp, count(*) FILTER (score > 0.5 AND label = 0) AS fp,
             count(*) FILTER (score <= 0.5 AND label = 1) AS fn, count(*) FILTER (score <= 0.5 AND label = 0) AS tn FROM avg_scores""",
)


@query("m10_model_report", REPORT_SQL)
def _(s):
    return metrics.model_report(avg_scores(s), "average")


@query(
    "m10_saved_report",
    f"""SELECT model_name, total_samples, positive_samples, positive_rate, negative_samples, auc, accuracy, precision, recall, f1
        FROM ({REPORT_SQL})""",
)
def _(s):
    """The nested form, read back from its JSON file."""
    path = new_path(s.spark, "report")
    report = metrics.nested_report(metrics.model_report(avg_scores(s), "average"))
    save_json(report, path)
    return load_json(s.spark, path, report.schema).select("model_name", "data_stats.*", "classification.*")


fragment("aucs", " UNION ALL ".join(f"SELECT '{m}' AS model_name, {_auc(m)} AS auc" for m in MODELS))


@query(
    "m11_leaderboard",
    f"""SELECT model_name, auc, (row_number() OVER (ORDER BY auc DESC, model_name DESC) = 1)::INTEGER AS is_best,
        {r('100.0 * (auc - min(auc) OVER ()) / min(auc) OVER ()', 2)} AS gain_over_lowest_pct FROM aucs""",
)
def _(s):
    return metrics.leaderboard(
        [metrics.roc_auc(scored(s), score=m).select(F.lit(m).alias("model_name"), "auc") for m in MODELS]
    )


fragment(
    "model_hits",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS model_name, {_auc(m)} AS auc, (SELECT {r('avg(label)', 6)} FROM
            (SELECT label, row_number() OVER (PARTITION BY user_id ORDER BY {m} DESC, product_id) AS k FROM scored) WHERE k <= 10) AS hits_10"""
        for m in MODELS
    ),
)


@query(
    "m11_best_per_metric",
    """SELECT 'auc' AS metric, first(model_name ORDER BY auc DESC, model_name) AS best_model, max(auc) AS best_value FROM model_hits
       UNION ALL SELECT 'hits_10', first(model_name ORDER BY hits_10 DESC, model_name), max(hits_10) FROM model_hits""",
)
def _(s):
    from functools import reduce

    from cartwheel.functions.scalar import beside, rounded

    rows = []
    for m in MODELS:
        best = top_per_group(scored(s), ["user_id"], [F.desc(m), "product_id"], 10, "_k")
        hits = best.agg(rounded(F.avg("label"), 6).alias("hits_10"))
        rows.append(metrics.roc_auc(scored(s), score=m).transform(beside, hits).withColumn("model_name", F.lit(m)))
    return metrics.best_per_metric(reduce(DataFrame.unionAll, rows), ["auc", "hits_10"])


