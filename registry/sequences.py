"""Next-item sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwheel.config import Params
from cartwheel.functions.scalar import rounded
from cartwheel.operators import candidates, sequences
from registry.base import fragment, query, r
from registry.candidates import scored

VOCABULARY = Params().vocabulary


def text(items: str = "seq") -> Column:
    return F.concat_ws(",", F.col(items).cast("array<string>")).alias(items)


def _pad(items: str) -> str:
    return f"""array_to_string(list_concat(list_transform(range(20 - len({items})), lambda x: 0), {items}), ',')"""


fragment(
    "vocab",
    f"""
      SELECT product_id, row_number() OVER (ORDER BY count(*) DESC, product_id)::INTEGER AS idx
      FROM prior_lines GROUP BY product_id QUALIFY idx <= {VOCABULARY}""",
)
fragment(
    "walk",
    """
      SELECT user_id, product_id, order_number, add_to_cart_order, coalesce(idx, 0) AS idx,
             row_number() OVER (PARTITION BY user_id ORDER BY order_number, add_to_cart_order) AS pos
      FROM prior_lines LEFT JOIN vocab USING (product_id)""",
)
fragment(
    "windows",
    f"""
      SELECT user_id, (pos - 1)::INTEGER AS pos, target, {_pad('before')} AS seq FROM
        (SELECT user_id, pos, idx AS target, list(idx) OVER (PARTITION BY user_id ORDER BY pos
           ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS before FROM walk) WHERE pos > 1""",
)
fragment(
    "last_lists",
    f"""
      SELECT user_id, {_pad('coalesce(items, []::INTEGER[])')} AS seq, coalesce(items, []::INTEGER[]) AS items
      FROM (SELECT DISTINCT user_id FROM ord) LEFT JOIN
        (SELECT user_id, list(idx ORDER BY pos) AS items FROM
          (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) <= 20) GROUP BY user_id)
        USING (user_id)""",
)


def vocab_of(s):
    return sequences.vocabulary(s.lines("prior"), VOCABULARY)


@query("q1_ordered_history", "SELECT user_id, order_number, add_to_cart_order, product_id, pos FROM walk")
def _(s):
    history = sequences.ordered_history(s.lines("prior"))
    return history.withColumn("pos", F.col("pos").cast("long"))


@query("q2_vocabulary", "SELECT * FROM vocab")
def _(s):
    return vocab_of(s)


@query("j14_unknown_products", "SELECT user_id, order_number, add_to_cart_order, product_id, idx FROM walk")
def _(s):
    items = s.lines("prior").select("user_id", "order_number", "add_to_cart_order", "product_id")
    return sequences.encode(items, vocab_of(s))


@query("q3_next_item_windows", "SELECT * FROM windows")
def _(s):
    return sequences.next_item_windows(s.lines("prior"), vocab_of(s)).withColumn("seq", text())


@query("q4_inference_sequences", "SELECT user_id, seq FROM last_lists")
def _(s):
    users = s.orders.select("user_id").distinct()
    return sequences.last_items(s.lines("prior"), vocab_of(s), users).withColumn("seq", text())


@query(
    "q5_decoded_sequences",
    """SELECT user_id, (20 - len(items) + i - 1)::INTEGER AS place, product_id FROM
       (SELECT user_id, items, unnest(items) AS idx, generate_subscripts(items, 1) AS i FROM last_lists)
       JOIN vocab USING (idx)""",
)
def _(s):
    users = s.orders.select("user_id").distinct()
    vocab = vocab_of(s)
    return sequences.decode(sequences.last_items(s.lines("prior"), vocab, users), vocab)


@query(
    "q6_pair_sequences",
    f"""SELECT user_id, product_id, target, {_pad('tail')} AS seq FROM
        (SELECT c.user_id, c.product_id, coalesce(v.idx, 0) AS target,
                list_filter(coalesce(h.items, []::INTEGER[]), lambda x: x != coalesce(v.idx, 0)) AS others,
                others[greatest(len(others) - 19, 1):] AS tail
         FROM cands c LEFT JOIN vocab v USING (product_id) LEFT JOIN
           (SELECT user_id, list(idx ORDER BY order_number, add_to_cart_order) AS items FROM
             (SELECT user_id, idx, order_number, add_to_cart_order FROM walk WHERE idx > 0
              QUALIFY row_number() OVER (PARTITION BY user_id, idx ORDER BY pos DESC) = 1) GROUP BY user_id) h USING (user_id))""",
)
def _(s):
    pairs = scored(s).select("user_id", "product_id")
    return sequences.pair_sequences(pairs, s.pairs("prior"), vocab_of(s)).withColumn("seq", text())


@query(
    "q7_sequence_metadata",
    """SELECT (SELECT count(*) + 1 FROM vocab) AS vocab_size, 20 AS max_sequence_length,
       count(*) AS total_sequences, count(target) AS total_targets FROM windows""",
)
def _(s):
    vocab = vocab_of(s)
    return sequences.metadata(sequences.next_item_windows(s.lines("prior"), vocab), vocab)


fragment(
    "steps",
    """
      SELECT prev_product_id, product_id, count(*) AS n_moves,
             count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY prev_product_id) AS probability
      FROM (SELECT product_id, idx, lag(product_id) OVER w AS prev_product_id, lag(idx) OVER w AS prev_idx
            FROM walk WINDOW w AS (PARTITION BY user_id ORDER BY pos))
      WHERE prev_idx > 0 AND idx > 0 GROUP BY prev_product_id, product_id""",
)


@query(
    "q8_transitions",
    f"SELECT prev_product_id, product_id, n_moves, {r('probability', 9)} AS probability FROM steps",
)
def _(s):
    steps = sequences.transitions(s.lines("prior"), vocab_of(s))
    return steps.withColumn("probability", rounded("probability", 9))


@query(
    "q8_next_item_scores",
    f"""SELECT user_id, product_id, {r('score', 9)} AS score, rank::INTEGER AS rank FROM
        (SELECT a.user_id, v.product_id, coalesce(s.probability, 0.4 * k.n / k.n_all) AS score,
                row_number() OVER (PARTITION BY a.user_id
                  ORDER BY coalesce(s.probability, 0.4 * k.n / k.n_all) DESC, v.product_id) AS rank
         FROM (SELECT DISTINCT user_id FROM ord) a
         LEFT JOIN (SELECT user_id, product_id AS prev_product_id FROM walk WHERE idx > 0
               QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) = 1) l ON l.user_id = a.user_id
         CROSS JOIN vocab v
         JOIN (SELECT product_id, count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS n_all
               FROM walk WHERE idx > 0 GROUP BY product_id) k ON k.product_id = v.product_id
         LEFT JOIN steps s ON s.prev_product_id = l.prev_product_id AND s.product_id = v.product_id)
        WHERE rank <= 10""",
)
def _(s):
    users = s.orders.select("user_id").distinct()
    scores = sequences.next_item_scores(s.lines("prior"), vocab_of(s), users)
    return scores.withColumn("score", rounded("score", 9))
