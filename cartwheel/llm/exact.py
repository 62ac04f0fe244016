"""Exact deduplication against immutable snapshots.

Documents come in loads. What is new in a load becomes a snapshot that never
changes: a table of its digests, the exact buckets, and one static binary fuse
filter for each range of digests. The digests of the next load, each once however
many copies it has, are screened by the filters of all snapshots. Negatives are
new for certain; their duplicates are grouped among themselves. Positives are
joined with the exact buckets, and the bytes of every such row are compared with
those of the snapshot's document: only equal bytes make a duplicate.

Of equal texts the row with the largest id stays. Rows that repeat id and text
are one document and share its verdict; null texts count as empty, a null id is
smaller than any other. An empty table gives no rows.

Hot texts: copies are added up before they are shuffled, a filter sees a digest
once, and for the byte comparison the copies of a text are spread by its size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.session import written

LOADS = 2
KEYS_PER_FILTER = 1 << 17
COPIES_PER_SALT = 64
_FILTERS = "bucket int, seed long, segment long, span long, cells binary"
_U = np.uint64


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, seeded."""
    h = keys + _U(int(seed) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _places(h: np.ndarray, segment: int, span: int) -> np.ndarray:
    """The three cells of each hash, in neighbouring segments."""
    first = ((h >> _U(32)) * _U(int(span))) >> _U(32)
    segment = int(segment)
    mask = _U(segment - 1)
    second = (first + _U(segment)) ^ ((h >> _U(18)) & mask)
    third = (first + _U(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> _U(32))) & _U(0xFF)).astype(np.uint8)


def fuse_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, segment length, span of first cells and cells of a filter of distinct 64-bit keys.

    Keys are peeled in rounds: whoever is alone in a cell goes. Cells are set in
    the reverse order; within a round no key touches the cell of another.
    """
    n = max(len(keys), 1)
    segment = 1 << int(np.log(n) / np.log(3.33) + 2.25) if n > 1 else 4
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)) if n > 1 else 1.0
    segments = max(int(np.ceil(n * factor / segment)) - 2, 1)
    span = segments * segment
    size = span + 2 * segment
    for seed in range(1, 1000):
        h = _mixed(keys, seed)
        places = _places(h, segment, span)
        count = np.bincount(places.ravel(), minlength=size)
        total = np.bincount(places.ravel(), np.tile(np.arange(len(keys), dtype=float), 3), minlength=size)
        rounds, left = [], len(keys)
        while left:
            alone = np.flatnonzero(count == 1)
            out, first = np.unique(total[alone].astype(np.int64), return_index=True)
            if not len(out):
                break
            rounds.append((out, alone[first]))
            gone = places[:, out].ravel()
            count -= np.bincount(gone, minlength=size)
            total -= np.bincount(gone, np.tile(out.astype(float), 3), minlength=size)
            left -= len(out)
        if left:
            continue
        cells, prints = np.zeros(size, np.uint8), _prints(h)
        for out, cell in reversed(rounds):
            others = cells[places[0, out]] ^ cells[places[1, out]] ^ cells[places[2, out]]
            cells[cell] = prints[out] ^ others ^ cells[cell]
        return seed, segment, span, cells.tobytes()
    raise ValueError("keys are not distinct")


def may_hold(keys: np.ndarray, seed: int, segment: int, span: int, cells: bytes) -> np.ndarray:
    """False only for keys that are not in the filter."""
    table = np.frombuffer(cells, np.uint8)
    h = _mixed(keys, seed)
    a, b, c = _places(h, segment, span)
    return (table[a] ^ table[b] ^ table[c]) == _prints(h)


@dataclass(frozen=True)
class Snapshot:
    load: int
    exact: DataFrame  # digest, keep_id, group_size
    filters: DataFrame
    buckets: int


def _key(digest: Column) -> Column:
    """64 bits of the digest."""
    return F.xxhash64(digest)


def marked(docs: DataFrame, loads: int = LOADS) -> DataFrame:
    """doc_id, digest, load and text of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.pmod(F.xxhash64(doc_id), F.lit(loads)).cast("int").alias("load"),
        text.alias("text"),
    )


def snapshot(groups: DataFrame, load: int) -> Snapshot:
    """Exact buckets and filters of the new digests of a load."""
    exact = written(groups.select("digest", "keep_id", "group_size"), f"snapshot-{load}")
    spark = exact.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * parts, -(-exact.count() // KEYS_PER_FILTER))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(rows["key"].to_numpy().astype(np.int64).view(np.uint64))
        return pd.DataFrame([(rows["bucket"].iloc[0], *fuse_filter(keys))], columns=_FILTERS.split()[0::2])

    filters = _bucketed(exact, buckets).groupBy("bucket").applyInPandas(build, _FILTERS)
    return Snapshot(load, exact, written(filters, f"filters-{load}"), buckets)


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    key = _key(F.col("digest"))
    return groups.select(key.alias("key"), F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"))


def screened(groups: DataFrame, against: Snapshot) -> DataFrame:
    """The groups whose digest the filters of a snapshot do not exclude."""

    def screen(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if filters.empty or rows.empty:
            return rows[["key"]].iloc[:0]
        own = filters.iloc[0]
        keys = rows["key"].to_numpy().astype(np.int64)
        return pd.DataFrame({"key": keys[may_hold(keys.view(np.uint64), own.seed, own.segment, own.span, own.cells)]})

    keys = _bucketed(groups, against.buckets).groupBy("bucket")
    maybe = keys.cogroup(against.filters.groupBy("bucket")).applyInPandas(screen, "key long")
    return groups.join(maybe.distinct(), _key(F.col("digest")) == F.col("key"), "left_semi")


def verified(rows: DataFrame, positives: DataFrame, against: Snapshot) -> DataFrame:
    """Digests of positives whose rows all have the bytes of the snapshot's document.

    ``rows`` has all documents with their texts; ``positives`` are groups of one load.
    """
    salts = F.ceil(F.col("group_size") / COPIES_PER_SALT).cast("int")
    found = positives.select("digest", salts.alias("salts"), F.col("load").alias("in_load")).join(
        against.exact.select("digest", "keep_id"), "digest"
    )
    found = written(found, "positives")
    new = (
        rows.join(found.select("digest", "salts", F.col("in_load").alias("load")), ["digest", "load"])
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), "salts"))
        .select("digest", "salt", "text")
    )
    old = (
        rows.where(F.col("load") == against.load)
        .join(found.select("digest", F.col("keep_id").alias("doc_id"), "salts"), ["digest", "doc_id"])
        .select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("old_text"))
    )
    other = new.join(old, ["digest", "salt"]).where(F.col("text") != F.col("old_text")).select("digest").distinct()
    return found.join(other, "digest", "left_anti").select("digest").distinct()


def verdicts(docs: DataFrame, loads: int = LOADS) -> DataFrame:
    """doc_id, digest, keep_id, group_size and kept of every row."""
    rows = marked(docs, loads)
    marks = written(rows.drop("text"), "digests")
    snapshots: list[Snapshot] = []
    parts: list[DataFrame] = []
    for load in range(loads):
        groups = (
            marks.where(F.col("load") == load)
            .groupBy("digest", "load")
            .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        )
        if snapshots:
            groups = written(groups, "load-groups")
        for old in snapshots:
            known = written(verified(rows, screened(groups, old), old), "known")
            parts.append(groups.join(known, "digest", "left_semi").withColumn("origin", F.lit(old.load)))
            groups = groups.join(known, "digest", "left_anti")
        if load + 1 < loads:
            snapshots.append(snapshot(groups, load))
            groups = snapshots[-1].exact.withColumn("load", F.lit(load))
        parts.append(groups.withColumn("origin", F.lit(load)))
    assigned = parts[0]
    for part in parts[1:]:
        assigned = assigned.unionByName(part)
    totals = assigned.groupBy("digest", "origin").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    of_load = assigned.select("digest", "load", "origin").join(totals, ["digest", "origin"])
    return (
        marks.join(of_load, ["digest", "load"])
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "digest", "keep_id", "group_size", "kept")
    )


def report(docs: DataFrame, loads: int = LOADS) -> DataFrame:
    return verdicts(docs, loads).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, loads: int = LOADS) -> DataFrame:
    """The documents that stay, with all their columns; of repeated rows one."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), digest.alias("own"), F.struct("*").alias("row"))
    gone = verdicts(docs, loads).where(~F.col("kept")).select("doc_id", "digest").distinct()
    left = own.join(gone, own["id"].eqNullSafe(gone["doc_id"]) & (own["own"] == gone["digest"]), "left_anti")
    return left.dropDuplicates(["id", "own"]).select("row.*")
