"""Purchase candidates, labels, samples and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.ordered import among_first, running, top_per_group
from cartwheel.functions.quantile import dense_codes
from cartwheel.functions.scalar import beside, fill_numeric, long, ratio, seeded
from cartwheel.session import written

PAIR = ["user_id", "product_id"]


def target_users(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("eval_set") == "train").select("user_id").distinct()


def purchase_history(sums: DataFrame) -> DataFrame:
    """Distinct products per user with how often and when last bought, from the
    pair sums of the lines."""
    return sums.select(
        *PAIR, F.col("n_lines").alias("times_bought"), F.col("last_order_number").alias("last_order")
    )


def first_of_history(history: DataFrame, n: int, by_frequency: bool = False) -> DataFrame:
    """The rows of each user's first ``n`` products, by product id or by frequency."""
    order: list[Column | str] = ["product_id"]
    if by_frequency:
        order = [F.desc("times_bought"), "product_id"]
    return top_per_group(history, ["user_id"], order, n, "_place").drop("_place")


def reorder_candidates(history: DataFrame, n: int, by_frequency: bool = False) -> DataFrame:
    """First ``n`` products of each user's history, by product id or by frequency."""
    return first_of_history(history, n, by_frequency).select(*PAIR)


def popular_items(lines: DataFrame) -> DataFrame:
    """Products by number of lines, ranked 1.. (product id breaks ties).

    The catalogue may grow with the data, so the counts are written once and
    ranked in cells instead of in one global window.
    """
    counts = written(
        lines.groupBy("product_id").agg(long(F.count(F.lit(1))).alias("popularity_score"))
        .withColumn("_order", -F.col("popularity_score")),
        "popularity",
    )
    ranked = running(counts, [], ["_order", "product_id"], number="popularity_rank")
    return ranked.select("product_id", "popularity_score", long("popularity_rank").alias("popularity_rank"))


def missing_from_top(
    owners: DataFrame,
    owned: DataFrame,
    ranked: DataFrame,
    key: str,
    n: int,
) -> DataFrame:
    """First ``n`` ranked products that an owner does not have yet.

    Sorted by rank, an owner's products leave gaps; walking the gaps gives the
    answer without holding a history in an array and without pairing owners
    with the catalogue. Before the gap that ends at the j-th product there are
    (previous rank - (j-1)) missing products; a gap yields what is left of ``n``.

    With h products an owner lacks at least ``n`` of the first n + h: what is owned
    beyond that place is left out before anything is exchanged. ``owned`` is read
    twice (pass a written table) and may have rows of others than the owners.
    """
    sizes = written(owned.groupBy(key).agg(F.count(F.lit(1)).alias("_owned")), "owned")
    most = sizes.agg(F.coalesce(F.max("_owned"), F.lit(0)).alias("_most"))
    # Written, its size is known: short enough, Spark broadcasts it.
    near = written(ranked.transform(beside, most).where(F.col("popularity_rank") <= F.col("_most") + n).drop("_most"), "near")
    spots = owned.select(key, "product_id").join(near.select("product_id", "popularity_rank"), "product_id")
    spots = spots.join(sizes.withColumnRenamed(key, "_of"), F.col(key).eqNullSafe(F.col("_of")))
    spots = spots.where(F.col("popularity_rank") <= F.col("_owned") + n)
    wanted = owners.select(F.col(key).alias("_owner"))
    spots = spots.join(wanted, F.col(key).eqNullSafe(F.col("_owner")), "left_semi").select(key, "popularity_rank")
    # One row past the end of the ranking closes the last gap.
    end = ranked.agg((F.coalesce(F.max("popularity_rank"), F.lit(0)) + 1).alias("popularity_rank"))
    spots = spots.unionByName(owners.select(key).transform(beside, end))
    walked = running(spots, [key], ["popularity_rank"], number="_j", prev={"_prev": "popularity_rank"})
    start = F.coalesce("_prev", F.lit(0))
    found = start - (F.col("_j") - 1)
    gap_end = F.least(F.col("popularity_rank") - 1, start + (F.lit(n) - found))
    gaps = walked.where((found < n) & (gap_end > start))
    places = gaps.select(key, F.explode(F.sequence(start + 1, gap_end)).alias("popularity_rank"))
    return places.join(near, "popularity_rank").select(key, *ranked.columns)


def popular_candidates(users: DataFrame, history: DataFrame, ranked: DataFrame, n: int) -> DataFrame:
    """Top ``n`` products the user never bought."""
    return missing_from_top(users, history.select(*PAIR), ranked, "user_id", n).select(*PAIR)


def candidate_rows(users: DataFrame, history: DataFrame, ranked: DataFrame, n_reorder: int = 15, n_popular: int = 20) -> DataFrame:
    """Reorder and popular candidates of the target users with what is known of them.

    The former bring the columns of the history, the latter ``popularity_score``.
    One part is inside the history and the other outside, each without repeats:
    the union needs no duplicate removal.
    """
    known = first_of_history(history, n_reorder).join(users, "user_id", "left_semi")
    fresh = missing_from_top(users, history, ranked, "user_id", n_popular).drop("popularity_rank")
    return known.unionByName(fresh, allowMissingColumns=True)


def candidates(users: DataFrame, history: DataFrame, ranked: DataFrame, n_reorder: int = 15, n_popular: int = 20) -> DataFrame:
    """Reorder and popular candidates of the target users."""
    return candidate_rows(users, history, ranked, n_reorder, n_popular).select(*PAIR)


def beside_user(rows: DataFrame, other: DataFrame, tasks: int) -> DataFrame:
    """Left join by user and product of tables with a bounded number of rows for each user.

    Both are dealt by user alone, so that the rows of a user lie side by side after it
    and need no further exchange to meet the user's columns.
    """
    renamed = {"user_id": "_user", "product_id": "_product"}
    met = other.withColumnsRenamed(renamed).repartition(tasks, "_user")
    same = F.col("product_id").between(F.col("_product"), F.col("_product"))
    return rows.repartition(tasks, "user_id").join(met, (F.col("user_id") == F.col("_user")) & same, "left").drop("_user", "_product")


def label_pairs(pairs: DataFrame, positives: DataFrame, tasks: int | None = None) -> DataFrame:
    """Adds whether a pair is among the positives; ``tasks`` says that a user has a bounded number of both."""
    bought = positives.select(*PAIR).distinct().withColumn("_hit", F.lit(1))
    met = beside_user(pairs, bought, tasks) if tasks else pairs.join(bought, PAIR, "left")
    return met.withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def class_stats(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        long(F.count(F.lit(1))).alias("n_samples"),
        long(F.coalesce(F.sum("label"), F.lit(0))).alias("n_positive"),
        long(F.count_if(F.col("label") == 0)).alias("n_negative"),
        ratio(F.sum("label"), F.count(F.lit(1)), 6).alias("positive_rate"),
    )


def class_weights(labelled: DataFrame) -> DataFrame:
    """Negatives per positive, the weight of the positive class."""
    stats = class_stats(labelled)
    return stats.select("n_positive", "n_negative", ratio("n_negative", "n_positive", 6).alias("positive_weight"))


def with_balanced_weight(labelled: DataFrame) -> DataFrame:
    """Weight n / (2 * class size) on every row."""
    stats = labelled.agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_pos"))
    size = F.when(F.col("label") == 1, F.col("_pos")).otherwise(F.col("_n") - F.col("_pos"))
    weighted = labelled.transform(beside, stats)
    return weighted.withColumn("weight", F.col("_n") / (2.0 * size)).drop("_n", "_pos")


def sample_users(users: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` users without replacement, the same ones on every run."""
    return users.withColumn("_draw", seeded(seed, "user_id")).orderBy("_draw", "user_id").limit(n).drop("_draw")


def stratified_split(
    labelled: DataFrame, test_share: float, seed: int, keys: Sequence[str] = PAIR
) -> DataFrame:
    """Adds ``split``: exactly round(share * n) rows of every label go to test.

    Only the draws next to the last test row of a label are put in order (see
    ``among_first``); the rows stay where they are. Pass a written table.
    """
    drawn = labelled.withColumn("_draw", seeded(seed, *keys))
    bucket = F.conv(F.substring("_draw", 1, 3), 16, 10).cast("int")
    quota = F.floor(F.col("_size") * test_share + 0.5)
    told = among_first(drawn, ["label"], ["_draw", *keys], bucket, quota, "_test")
    return told.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_draw", "_test")


def with_items(rows: DataFrame, items: DataFrame, hot: DataFrame) -> DataFrame:
    """Item columns beside every row; those of ``hot`` products, a bounded table of ids, are broadcast.

    Most rows have one of a few products: these are neither exchanged nor put into one task.
    """
    near = rows.join(F.broadcast(items.join(F.broadcast(hot), "product_id", "left_semi")), "product_id")
    met = F.broadcast(items.join(F.broadcast(hot), "product_id", "left_semi").select("product_id"))
    far = rows.join(met, "product_id", "left_anti").join(items, "product_id", "left")
    return near.unionByName(far)


def training_matrix(
    labelled: DataFrame, users: DataFrame, items: DataFrame, pair_features: DataFrame,
    hot: DataFrame | None = None, tasks: int | None = None,
) -> DataFrame:
    """Labelled pairs with user, product and pair features; missing numbers are 0.

    The items are joined first, while the rows are narrow. With ``tasks`` the rows are
    then dealt by user, once for both other joins: see ``beside_user``.
    """
    others = [c for part in (pair_features, users, items) for c in part.columns if c not in PAIR]
    rows = labelled.join(items, "product_id", "left") if hot is None else with_items(labelled, items, hot)
    if tasks:
        met, users = beside_user(rows, pair_features, tasks), users.repartition(tasks, "user_id")
    else:
        met = rows.join(pair_features, PAIR, "left")
    joined = met.join(users, "user_id", "left")
    return fill_numeric(joined.select(*reversed(PAIR), *[c for c in labelled.columns if c not in PAIR], *others))


def encode_labels(df: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_encoded``: position among the sorted values, missing as '0'."""
    filled = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("0")))
    return dense_codes(filled, column, f"{column}_encoded")


def with_class_code(dimension: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_encoded`` to a user or item table: 1.. by the sorted classes, 0 for missing.

    The codes are joined to the dimension before it meets the matrix; rows of the
    matrix without a user or item get 0 with their other numbers.
    """
    name = F.coalesce(F.col(column).cast("string"), F.lit(MISSING_CLASS))
    filled = dimension.withColumn(column, name)
    classes = filled.where(F.col(column) != MISSING_CLASS).select(column).distinct()
    codes = running(classes, [], [column], number="_code", bounded=True).withColumnRenamed(column, "_class")
    coded = filled.join(codes, F.col(column) == F.col("_class"), "left").drop("_class")
    return coded.withColumn(f"{column}_encoded", F.coalesce("_code", F.lit(0)).cast("int")).drop("_code")


def encoder_classes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, class, code) of every encoded category."""
    out = None
    for column in columns:
        values = df.select(F.coalesce(F.col(column).cast("string"), F.lit("0")).alias("class_name")).distinct()
        part = dense_codes(values, "class_name", "code").select(F.lit(column).alias("column_name"), "class_name", "code")
        out = part if out is None else out.unionByName(part)
    return out


MISSING_CLASS = "0"
NOT_FEATURES = ("user_id", "product_id", "label", "split", "weight", "product_name", "Segment", "department", "aisle")


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs: everything but ids, label, text and raw categories."""
    return [c for c in df.columns if c not in NOT_FEATURES]


def recent_purchases(orders: DataFrame, lines: DataFrame, n_orders: int = 3, n_products: int = 50) -> DataFrame:
    """Products of each user's last train orders by count."""
    recent = top_per_group(
        orders.where(F.col("eval_set") == "train").select("user_id", "order_id", "order_number"),
        ["user_id"], [F.desc("order_number")], n_orders, "_age",
    )
    counts = (
        lines.select("order_id", "product_id")
        .join(recent.select("user_id", "order_id"), "order_id")
        .groupBy(*PAIR)
        .agg(long(F.count(F.lit(1))).alias("n_bought"))
    )
    return top_per_group(counts, ["user_id"], [F.desc("n_bought"), "product_id"], n_products)


def constant_baselines(labelled: DataFrame, lines: DataFrame, seed: int = 42) -> DataFrame:
    """Score columns of the two trivial models: uniform noise and the mean reorder rate."""
    draw = F.conv(F.substring(seeded(seed, *PAIR), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rate = lines.agg(F.avg("reordered").alias("score_majority"))
    return labelled.withColumn("score_random", draw).transform(beside, rate)
