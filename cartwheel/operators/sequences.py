"""Next-item sequences per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.functions.ordered import running, top_per_group
from cartwheel.functions.scalar import beside, long
from cartwheel.operators.candidates import missing_from_top, popular_items
from cartwheel.session import written

ORDER = ["order_number", "add_to_cart_order"]
BLOCK = 4096


def ordered_history(facts: DataFrame) -> DataFrame:
    """Items with their position 1.. in the user's purchase history."""
    items = facts.select("user_id", *ORDER, "product_id")
    return running(items, ["user_id"], ORDER, number="pos")


def vocabulary(lines: DataFrame, size: int | None = 10_000) -> DataFrame:
    """Top products by line count with index 1..; 0 stays free for unknown and padding."""
    if size is None:
        return popular_items(lines).select("product_id", F.col("popularity_rank").cast("int").alias("idx"))
    counts = lines.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.desc("_n"), "product_id").limit(size)
    by_count = Window.partitionBy(F.lit(0)).orderBy(F.desc("_n"), "product_id")
    return top.select("product_id", F.row_number().over(by_count).cast("int").alias("idx"))


def encode(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds ``idx``; unknown products get 0."""
    return df.join(vocab, "product_id", "left").withColumn("idx", F.coalesce("idx", F.lit(0)))


def left_pad(items: Column, length: int) -> Column:
    return F.concat(F.array_repeat(F.lit(0), F.lit(length) - F.size(items)), items)


def next_item_windows(
    facts: DataFrame, vocab: DataFrame, length: int = 20, block: int = BLOCK
) -> DataFrame:
    """For every item after the first: the ``length`` items before it, and itself.

    Histories are numbered and cut into blocks of ``block`` positions, so that no
    history is too long for one task; a block also gets the ``length`` items
    before it, so every list is whole.
    """
    coded = encode(ordered_history(facts), vocab)
    own = F.floor((F.col("pos") - 1) / block)
    following = F.floor((F.col("pos") - 1 + length) / block)
    spread = coded.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, following)))
    within = Window.partitionBy("user_id", "_block").orderBy("pos")
    rows = spread.select(
        "user_id",
        "pos",
        "_own",
        "_block",
        F.collect_list("idx").over(within.rowsBetween(-length, -1)).alias("_before"),
        F.col("idx").alias("target"),
    ).where(F.col("_own") == F.col("_block"))
    return rows.where(F.col("pos") > 1).select(
        "user_id",
        (F.col("pos") - 1).cast("int").alias("pos"),
        left_pad(F.col("_before"), length).alias("seq"),
        "target",
    )


def last_items(facts: DataFrame, vocab: DataFrame, users: DataFrame, length: int = 20) -> DataFrame:
    """Last ``length`` items of the requested users; all zeros for unknown ones."""
    wanted = facts.select("user_id", *ORDER, "product_id").join(users, "user_id", "left_semi")
    newest = top_per_group(wanted, ["user_id"], [F.desc(c) for c in ORDER], length, "_age")
    lists = encode(newest, vocab).groupBy("user_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("_age")).alias("at"), "idx"))), lambda s: s["idx"]
        ).alias("_items")
    )
    empty = F.array().cast("array<int>")
    return users.join(lists, "user_id", "left").select(
        "user_id", left_pad(F.coalesce("_items", empty), length).alias("seq")
    )


def decode(sequences: DataFrame, vocab: DataFrame) -> DataFrame:
    """(user, place, product) of encoded lists; padding and unknown items drop out."""
    places = sequences.select("user_id", F.posexplode("seq").alias("place", "idx"))
    return places.where(F.col("idx") > 0).join(vocab, "idx").select("user_id", "place", "product_id")


def pair_sequences(pairs: DataFrame, sums: DataFrame, vocab: DataFrame, length: int = 20) -> DataFrame:
    """Per (user, target): the user's last known products other than the target.

    ``sums`` are the pair sums of the history, which lists each product once, at
    its last purchase. Without the target,
    ``length`` of the newest ``length + 1`` products remain: a list per user of
    fixed size holds all that any target needs.
    """
    latest = sums.select("user_id", "product_id", F.struct("last_order_number", "last_cart").alias("_at"))
    known = latest.join(vocab, "product_id")
    newest = top_per_group(known, ["user_id"], [F.desc("_at")], length + 1, "_age")
    lists = newest.groupBy("user_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("_age")).alias("at"), "idx"))), lambda s: s["idx"]
        ).alias("_items")
    )
    coded = encode(pairs.select("user_id", "product_id"), vocab).join(lists, "user_id", "left")
    others = F.array_remove(F.coalesce("_items", F.array().cast("array<int>")), F.col("idx"))
    tail = F.slice(others, F.greatest(F.size(others) - (length - 1), F.lit(1)), F.lit(length))
    return coded.select(
        "user_id", "product_id", F.col("idx").alias("target"), left_pad(tail, length).alias("seq")
    )


def metadata(sequences: DataFrame, vocab: DataFrame, length: int = 20) -> DataFrame:
    size = vocab.agg(long(F.count(F.lit(1)) + 1).alias("vocab_size"))
    counts = sequences.agg(
        long(F.count("seq")).alias("total_sequences"), long(F.count("target")).alias("total_targets")
    )
    return size.transform(beside, counts).withColumn("max_sequence_length", F.lit(length))


def transitions(facts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Item -> next item counts and probabilities over known items."""
    items = facts.select("user_id", *ORDER, "product_id")
    stepped = running(items, ["user_id"], ORDER, prev={"_from": "product_id"})
    moves = stepped.where(F.col("_from").isNotNull())
    counts = moves.groupBy("_from", "product_id").agg(long(F.count(F.lit(1))).alias("n_moves"))
    known = counts.join(vocab.select("product_id"), "product_id", "left_semi").join(
        vocab.select(F.col("product_id").alias("_from")), "_from", "left_semi"
    )
    totals = known.groupBy("_from").agg(F.sum("n_moves").alias("_all"))
    return known.join(totals, "_from").select(
        F.col("_from").alias("prev_product_id"),
        "product_id",
        "n_moves",
        (F.col("n_moves") / F.col("_all")).alias("probability"),
    )


def successors(facts: DataFrame, vocab: DataFrame, k: int = 10, back_off: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best next products of every known product, and those of a user without any: ranked lists.

    Score: transition probability, or ``back_off`` times the product's share of
    lines where the step was never seen. The k best successors and the k most
    popular non-successors of every item are enough for the k best overall.
    """
    step = written(transitions(facts, vocab), "transitions")
    known = facts.join(vocab.select("product_id"), "product_id", "left_semi")
    ranked = written(popular_items(known), "ranked")
    all_lines = ranked.agg(F.sum("popularity_score").alias("_all"))
    share = (
        ranked.transform(beside, all_lines)
        .select("product_id", (F.lit(back_off) * F.col("popularity_score") / F.col("_all")).alias("score"))
    )
    best = top_per_group(step, ["prev_product_id"], [F.desc("probability"), "product_id"], k)
    seen = best.select("prev_product_id", "product_id", F.col("probability").alias("score"))
    origins = vocab.select(F.col("product_id").alias("prev_product_id"))
    unseen = missing_from_top(
        origins, step.select("prev_product_id", "product_id"), ranked, "prev_product_id", k
    ).join(share, "product_id").select("prev_product_id", "product_id", "score")
    per_item = top_per_group(
        seen.unionByName(unseen), ["prev_product_id"], [F.desc("score"), "product_id"], k
    )
    first = ranked.join(share, "product_id").where(F.col("popularity_rank") <= k)
    return per_item, first.select("product_id", "score", F.col("popularity_rank").cast("int").alias("rank"))


def next_item_scores(
    facts: DataFrame, vocab: DataFrame, users: DataFrame, k: int = 10, back_off: float = 0.4
) -> DataFrame:
    """Top ``k`` next products per user from the last item bought; who has bought nothing known gets the most popular."""
    per_item, popular = successors(facts, vocab, k, back_off)
    known = facts.join(vocab.select("product_id"), "product_id", "left_semi")
    last = top_per_group(
        known.select("user_id", *ORDER, "product_id").join(users, "user_id", "left_semi"),
        ["user_id"], [F.desc(c) for c in ORDER], 1, "_age",
    ).select("user_id", F.col("product_id").alias("prev_product_id"))
    known_users = last.join(per_item, "prev_product_id").select("user_id", "product_id", "score", "rank")
    # k rows, packed into one.
    packed = popular.agg(F.sort_array(F.collect_list(F.struct("rank", "product_id", "score"))).alias("_first"))
    others = users.join(last, "user_id", "left_anti").transform(beside, packed)
    return known_users.unionByName(others.select("user_id", F.inline("_first")))


def window_lists(facts: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """(prev, product_id, rank) in vocabulary indices: the list for every last item of a window, 0 being unknown."""
    per_item, popular = successors(facts, vocab, k)
    origin = vocab.select(F.col("product_id").alias("prev_product_id"), F.col("idx").alias("prev"))
    listed = per_item.join(origin, "prev_product_id").select("prev", "product_id", "rank")
    whole = listed.unionByName(popular.select(F.lit(0).alias("prev"), "product_id", "rank"))
    return whole.join(vocab, "product_id").select("prev", F.col("idx").alias("product_id"), "rank")
