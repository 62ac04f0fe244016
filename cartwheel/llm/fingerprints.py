"""Threshold-scaled document fingerprints.

A text's words (lower case, ASCII white space between them) give shingles of five;
fewer words give one shingle of all. The sketch of a text is the set of its shingle
hashes below a fixed fraction of the hash range. So that short texts have one
too, the ``floor`` smallest hashes always belong to it. Both rules look at one
hash and the set alone: the sketch of a union is the union of the sketches under
the same rules (``merged``), and two sketches can be compared whatever the lengths
of their texts.

``containment`` estimates which part of the first text's shingles the second has.
It uses the hashes up to the bound below which both sketches are whole. Two empty
sketches give 1, an empty and another one 0, no hash of the first up to the
bound gives 0. Null text counts as empty; an empty text has the empty sketch.

The neighbour of a document is the one with the next smaller id, after the last the
first; of repeated ids rows follow each other by their texts' hash, null ids
come last. Nothing but column functions and one shuffle of the texts is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
FRACTION_BITS = 4
FLOOR = 16
BUCKETS_PER_PARTITION = 8
_TOP = (1 << 63) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column, words: int = WORDS, fraction_bits: int = FRACTION_BITS, floor: int = FLOOR) -> Column:
    """Sorted distinct hashes, 63 bits each."""
    none = F.array().cast("array<bigint>")
    limit = F.lit(1 << (63 - fraction_bits))

    def shingles(h: Column) -> Column:
        count = F.size(h)
        many = F.transform(
            F.sequence(F.lit(0), count - words),
            lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + k) for k in range(words)]), 1),
        )
        one = F.array(F.shiftrightunsigned(F.xxhash64(h), 1))
        return F.when(count >= words, many).when(count > 0, one).otherwise(none)

    def kept(s: Column) -> Column:
        def choose(low: Column) -> Column:
            lowest = F.slice(F.array_sort(F.array_distinct(s)), 1, floor)
            return F.when(F.size(low) >= floor, F.array_sort(low)).otherwise(lowest)

        return _let(F.array_distinct(F.filter(s, lambda x: x < limit)), choose)

    split = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")
    hashed = F.transform(split, lambda w: F.xxhash64(w))
    return _let(_let(hashed, shingles), kept)


def _bound(s: Column, fraction_bits: int, floor: int) -> Column:
    """Up to here the sketch has every hash of its text."""
    limit = F.lit((1 << (63 - fraction_bits)) - 1)
    return F.when(F.size(s) < floor, F.lit(_TOP)).otherwise(F.greatest(limit, F.array_max(s)))


def containment(a: Column, b: Column, fraction_bits: int = FRACTION_BITS, floor: int = FLOOR) -> Column:
    bound = F.least(_bound(a, fraction_bits, floor), _bound(b, fraction_bits, floor))
    shared = _let(
        bound,
        lambda top: _let(
            F.filter(a, lambda x: x <= top),
            lambda own: F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, b)) / F.size(own)),
        ),
    )
    empty = F.when(F.size(b) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.size(a) == 0, empty).otherwise(shared)


def merged(a: Column, b: Column, fraction_bits: int = FRACTION_BITS, floor: int = FLOOR) -> Column:
    """The sketch of both texts' shingles together."""
    limit = F.lit(1 << (63 - fraction_bits))

    def choose(all_hashes: Column) -> Column:
        low = F.filter(all_hashes, lambda x: x < limit)
        return F.when(F.size(low) >= floor, low).otherwise(F.slice(all_hashes, 1, floor))

    return _let(F.array_sort(F.array_union(a, b)), choose)


def as_string(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.hex(x)), ",")


def heads(ids: DataFrame, buckets: int) -> list[int]:
    """The largest id of each of at most ``buckets`` ranges of ids, ascending; reads the ids alone."""
    shares = [i / buckets for i in range(1, buckets + 1)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 10 * buckets).alias("cuts")).first()
    cuts = sorted(set(found.cuts or []))
    if not cuts:
        return []
    # The cuts are estimates: take the largest id that is really in each range.
    top = ids.where("doc_id IS NOT NULL").groupBy(_range(F.col("doc_id"), cuts).alias("b")).agg(F.max("doc_id").alias("top"))
    return sorted(row.top for row in top.collect())


def _range(value: Column, cuts: list[int]) -> Column:
    """Number of cuts below the value, by bisection in column functions."""
    table = F.lit(cuts)
    step = 1 << max(len(cuts).bit_length() - 1, 0)

    def halved(size: int) -> Callable[[Column], Column]:
        return lambda s: F.when(F.get(table, s["at"] + (size - 1)) < s["v"], s["at"] + size).otherwise(s["at"])

    at = F.lit(0)
    while step:
        # Bound once per step, else every step would repeat the ones before.
        at = _let(F.struct(at.alias("at"), value.alias("v")), halved(step))
        step >>= 1
    return at


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """doc_id and ``columns``, and as ``next_`` columns those of the row with the next smaller id.

    Rows are dealt by ranges of ids. The largest of each range also goes, as a
    ghost, behind the last row of the range above it.
    """
    spark = docs.sparkSession
    buckets = buckets or BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    tops = heads(docs.select("doc_id"), buckets)
    if tops:
        bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_range(F.col("doc_id"), tops))
        is_top = F.coalesce(F.get(F.lit(tops), F.col("_b")) == F.col("doc_id"), F.lit(False))
        above = F.pmod(F.col("_b") + 1, F.lit(len(tops)))
    else:
        bucket, is_top, above = F.lit(0), F.lit(True), F.lit(0)
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("ghost"))
    ghost = F.struct(above.alias("b"), F.lit(True).alias("ghost"))
    dealt = (
        docs.withColumn("_b", bucket)
        .withColumn("_at", F.explode(F.when(is_top, F.array(own, ghost)).otherwise(F.array(own))))
        .select("doc_id", *columns, F.col("_at.b").alias("_b"), F.col("_at.ghost").alias("_ghost"))
    )
    order = Window.partitionBy("_b").orderBy("_ghost", F.desc_nulls_last("doc_id"), F.xxhash64(*columns))
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return dealt.select("doc_id", *columns, *following, "_ghost").where(~F.col("_ghost")).drop("_ghost")


def fingerprints(docs: DataFrame, words: int = WORDS, fraction_bits: int = FRACTION_BITS, floor: int = FLOOR) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike it is to that and to the next one."""
    rules = (fraction_bits, floor)
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("sketch", sketch(F.col("text"), words, *rules))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)
    )
    paired = (
        with_next(slim, ["text", "sketch"])
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", edited)
        .withColumn("edited_sketch", sketch(F.col("edited"), words, *rules))
    )
    return paired.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch"), *rules).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch"), *rules).alias("near_next"),
    )
