"""Sharding by fixed virtual slots.

Every record hashes to one of ``n_slots`` virtual slots by its id, for ever. Bytes
and rows are added up per slot, and a stored, versioned map says which shard has
which slot. Rebalancing edits the map: as few slots as needed move from the
heaviest to the lightest shard, all others stay where they are. A call with the
path of a stored map starts from its last version and adds one only if something
moves; one more shard starts empty and fills by the same moves.

A slot with far more than its share (an id on very many rows) has a second level:
it is cut into a power of two of pieces by the hash of id, text and size, and equal
rows go to the pieces in turn. Doubling the pieces of a slot sends no row to another
shard: both halves start where the piece was. The map has ``n_slots`` rows and at most
``4 * PIECES * shards`` more (past versions keep their pieces), whatever the size of the data; it is the
only thing the driver holds and the only thing that is broadcast.

A null id is hashed like any value, a null text has no bytes. Equal rows are
counted and numbered from their count. An empty table leaves the map as it is.
Other columns, whatever their names, are not read. Texts are read once.
"""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwheel.session import new_path, written

N_SLOTS = 4096
#: A slot is cut when it has more than one part in so many of what a shard should have.
PIECES = 64
#: Equal rows are numbered in blocks of so many.
BLOCK = 1 << 16
MAP_SCHEMA = "version int, slot int, piece int, shard int, rows long, bytes long"
IDENTITY = ("doc_id", "text_crc32", "size")


class SlotMap(NamedTuple):
    """A version of the map: pieces of every slot, shard of every (slot, piece) in order."""

    version: int
    pieces: list[int]
    owner: list[int]

    def places(self) -> list[tuple[int, int]]:
        return [(slot, piece) for slot, n in enumerate(self.pieces) for piece in range(n)]


def measured(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(n_slots)).cast("int").alias("vslot"),
    )


def first_map(n_slots: int = N_SLOTS, shards: int = 8) -> list[int]:
    return [slot % shards for slot in range(n_slots)]


def rebalanced(current: list[int], weights: list[int], shards: int) -> list[int]:
    """The map after moving slots from the heaviest to the lightest shard.

    Each step takes the slot whose weight is nearest to half the difference, and
    only if the difference shrinks. New shards start empty and fill the same way;
    what a shard beyond ``shards`` has goes first, the heaviest to the lightest.
    """
    owner = list(current)
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(owner):
        if shard < shards:
            held[shard].add(slot)
    load = [sum(weights[s] for s in own) for own in held]
    homeless = [s for s, shard in enumerate(owner) if shard >= shards]
    for slot in sorted(homeless, key=lambda s: (-weights[s], s)):
        light = load.index(min(load))
        held[light].add(slot)
        load[light] += weights[slot]
        owner[slot] = light
    while True:
        heavy, light = load.index(max(load)), load.index(min(load))
        gap = load[heavy] - load[light]
        fits = [s for s in held[heavy] if 0 < weights[s] < gap]
        if not fits:
            return owner
        slot = min(fits, key=lambda s: (abs(2 * weights[s] - gap), s))
        held[heavy].remove(slot)
        held[light].add(slot)
        load[heavy] -= weights[slot]
        load[light] += weights[slot]
        owner[slot] = light


def cut(current: SlotMap, totals: list[tuple[int, int]], shards: int) -> SlotMap:
    """The map with pieces doubled until each has a small share of the rows and bytes; no row changes its shard."""
    bounds = [max(1, -(-sum(amounts) // (shards * PIECES))) for amounts in zip(*totals, strict=True)]
    pieces = []
    for n, amounts in zip(current.pieces, totals, strict=True):
        while any(amount > n * bound for amount, bound in zip(amounts, bounds, strict=True)):
            n *= 2
        pieces.append(n)
    at = dict(zip(current.places(), current.owner, strict=True))
    finer = current._replace(pieces=pieces)
    return finer._replace(owner=[at[slot, piece % current.pieces[slot]] for slot, piece in finer.places()])


def load_map(spark: SparkSession, path: str) -> SlotMap | None:
    """The last version of a stored map, None where nothing is stored."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = stored.agg(F.max("version")).first()[0]
    if version is None:
        return None
    rows = stored.where(F.col("version") == version).orderBy("slot", "piece").collect()
    pieces = [0] * (rows[-1].slot + 1)
    for row in rows:
        pieces[row.slot] += 1
    found = SlotMap(version, pieces, [row.shard for row in rows])
    if found.places() != [(row.slot, row.piece) for row in rows]:
        raise ValueError(f"version {version} of the map in {path} was written twice or in part")
    return found


def save_map(spark: SparkSession, path: str, slot_map: SlotMap, totals: list[tuple[int, int]]) -> None:
    """Add a version to a stored map. One file has all of it, so it is there or not; one job edits a map at a time."""
    rows = [
        (slot_map.version, slot, piece, shard, *amounts)
        for (slot, piece), shard, amounts in zip(slot_map.places(), slot_map.owner, totals, strict=True)
    ]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _totals(units: DataFrame, keys: list[str], places: list[tuple[int, ...]]) -> list[tuple[int, int]]:
    """(rows, bytes) of every place, as many pairs as the map has rows."""
    sums = units.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("b")).collect()
    found = {tuple(row[key] for key in keys): (row.n, row.b) for row in sums}
    return [found.get(place, (0, 0)) for place in places]


def dealt(units: DataFrame, pieces: list[int]) -> DataFrame:
    """Units (``IDENTITY``, vslot, n rows) with their rows dealt to the pieces of the slot in turn."""
    table = units.sparkSession.createDataFrame(list(enumerate(pieces)), "vslot int, pieces int")
    each = units.join(F.broadcast(written(table, "slot-pieces")), "vslot")
    turns = each.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", "pieces") - 1)))
    own = F.pmod(F.xxhash64(*IDENTITY), F.col("pieces"))
    return turns.select(
        "vslot",
        F.pmod(own + F.col("turn"), F.col("pieces")).cast("int").alias("piece"),
        *IDENTITY,
        F.expr("(n - 1 - turn) div pieces + 1").alias("n"),
    )


def placed(parts: DataFrame, slot_map: SlotMap, rows: list[int]) -> DataFrame:
    """Shard of every row and its gapless place there.

    Rows are numbered inside their piece, which begins where the pieces of the
    same shard before it end.
    """
    at = {shard: 0 for shard in slot_map.owner}
    starts = []
    for (slot, piece), shard, n in zip(slot_map.places(), slot_map.owner, rows, strict=True):
        starts.append((slot, piece, shard, at[shard], slot_map.version))
        at[shard] += n
    table = parts.sparkSession.createDataFrame(starts, "vslot int, piece int, shard int, base long, map_version int")
    ahead = Window.partitionBy("vslot", "piece").orderBy(*IDENTITY).rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    blocks = counted.join(F.broadcast(written(table, "slot-starts")), ["vslot", "piece"]).withColumn(
        "block", F.explode(F.expr(f"sequence(0L, (n - 1) div {BLOCK})"))
    )
    one = F.explode(F.expr(f"sequence(block * {BLOCK}, least(n, (block + 1) * {BLOCK}) - 1)"))
    return blocks.withColumn("one", one).withColumn("slot", F.col("base") + F.col("ahead") + F.col("one"))


def shard(docs: DataFrame, shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual slot, its piece and map version.

    ``map_path`` names a stored map that the call starts from and edits; it is begun
    there if there is none, and in a folder of this application without a path.
    """
    spark = docs.sparkSession
    path = map_path or new_path(spark, "slot-map")
    units = written(measured(docs, n_slots).groupBy("vslot", *IDENTITY).agg(F.count("*").alias("n")), "slot-units")
    totals = _totals(units, ["vslot"], [(slot,) for slot in range(n_slots)])
    current = load_map(spark, path)
    if current is None:
        current = SlotMap(0, [1] * n_slots, first_map(n_slots, shards))
        save_map(spark, path, current, totals)
    if len(current.pieces) != n_slots:
        raise ValueError(f"the map in {path} has {len(current.pieces)} slots, not {n_slots}")
    finer = cut(current, totals, shards)
    parts = dealt(units, finer.pieces)
    totals = _totals(parts, ["vslot", "piece"], finer.places())
    edited = finer._replace(owner=rebalanced(finer.owner, [b for _, b in totals], shards))
    if edited != current:
        edited = edited._replace(version=current.version + 1)
        save_map(spark, path, edited, totals)
    return placed(parts, edited, [n for n, _ in totals]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
        F.col("piece").alias("slot_piece"),
        "map_version",
    )
