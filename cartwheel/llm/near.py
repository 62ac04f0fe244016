"""Near duplicates by a multi-index Hamming join of MinHash signatures.

A text's set holds the hashes of its distinct word shingles. Equal sets are one
class. A class has a signature of 64 MinHash values of 16 bits. Two sets of
the wanted likeness differ in more than ``radius`` positions with a probability of at
most ``loss``; all pairs up to ``radius`` are guaranteed to be found:

1. The positions are split into ``radius // 2 + 1`` chunks, so that two such signatures
   differ in at most one position of some chunk. Each chunk gives a key for each of
   its positions, made of the other ones: the allowed error is left out in turn.
2. In each key every class is compared with the smallest one only, by the distance of
   the signatures. These stars join classes to families.
3. Keys that still hold several families are compared across families: the members
   outside of the largest family with all members. Now every pair up to ``radius`` lies
   in one family, and no pair inside of a family has been written.
4. Families are verified on full sets, in blocks of a bounded number of texts: small
   families together, large ones as pairs of blocks of like set sizes. A block gives
   a spanning forest of its links, not the links.

Words are lower-cased (A-Z) runs without ASCII white space. A text of fewer words
than a shingle has one shingle, the whole; one without words has an empty set
and is linked with nothing, as are null texts. A null id comes after all others:
it is never the id of a component that has another, but its row is linked like
any. Repeated rows are copies. An empty table gives no rows. Columns other than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.graph import components
from cartwheel.llm.rows import slim, texts
from cartwheel.session import written

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
WORD_MEMO = 1 << 18
BLOCK_TEXTS = 256
BLOCK_SHINGLES = 1 << 19
_SLICE = 2048
K, BITS = 64, 16


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; linked when ``den`` x intersection >= ``num`` x union."""

    words: int = 5
    num: int = 80
    den: int = 100
    loss: float = 1e-6

    @property
    def radius(self) -> int:
        p = 1 - self.num / self.den
        tail, r = 1.0, -1
        while tail > self.loss:
            r += 1
            tail -= comb(K, r) * p**r * (1 - p) ** (K - r)
        return r

    @property
    def chunks(self) -> list[np.ndarray]:
        return np.array_split(np.arange(K), self.radius // 2 + 1)


# ---- sets and signatures, inside tasks


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingle_set(text: str, words: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, _U)
    h = np.fromiter(map(memo.__getitem__, parts), _U, len(parts))
    width = min(words, len(parts))
    steps = _finished(np.arange(1, width + 1, dtype=_U) * _STEP) | _U(1)
    total = np.full(len(parts) - width + 1, _U(len(parts) if width < words else 0))
    for i, step in enumerate(steps):
        total += h[i : len(h) - width + 1 + i] * step
    return np.unique(_finished(total))


def class_of(own: np.ndarray) -> int | None:
    return None if not len(own) else xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    grid = _finished(np.arange(1, 2 * K + 1, dtype=_U) * _STEP)
    return grid[:K] | _U(1), grid[K:]


def signature(own: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The values as bit planes: one long for each of the 16 bits, with a bit per position."""
    lowest = np.full(len(factors), _U(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(own), 4096):
        np.minimum(lowest, (own[at : at + 4096, None] * factors + shifts).min(axis=0), out=lowest)
    bits = np.unpackbits((_finished(lowest) & _U(0xFFFF)).astype("<u2").view(np.uint8), bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.reshape(K, BITS).T, axis=1, bitorder="little")).view("<i8").ravel()


def values_of(planes: np.ndarray) -> np.ndarray:
    """The 16-bit values of signatures, one row each."""
    bits = np.unpackbits(planes.astype("<i8").view(np.uint8), bitorder="little").reshape(-1, BITS, K)
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u2").reshape(-1, K)


_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("sig", pa.list_(pa.int64())), ("digest", pa.int64())]
)
#: Seed of the hash function of Spark's own column function.
_SEED = 42


def signed(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, size of the set, class, signature and a 64-bit hash of the text."""
    words = rule.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _seeds()
        memo = _Hashes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in texts(batch):
                own = shingle_set(text, words, memo)
                sig = signature(own, factors, shifts) if len(own) else None
                digest = xxhash.xxh64_intdigest(text.encode(), _SEED)
                digest -= (digest >> 63) << 64
                for column, value in zip(rows, (doc_id, len(own), class_of(own), sig, digest), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _SIGNED.types, strict=True)], schema=_SIGNED)

    return slim(docs).mapInArrow(run, "doc_id long, n long, cls long, sig array<long>, digest long")


def keyed(classes: DataFrame, rule: Rule) -> DataFrame:
    """(key, cls): for each chunk and position of it, a hash of the chunk's other values."""
    chunks = rule.chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("cls", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            cls = batch.column(0).to_numpy(zero_copy_only=False)
            planes = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, BITS)
            for at in range(0, len(cls), 2048):
                part, keys = values_of(planes[at : at + 2048]).astype(_U), []
                for number, chunk in enumerate(chunks):
                    for wild in chunk:
                        key = np.full(len(part), _U((number << 32) + int(wild) + 1))
                        for position in chunk[chunk != wild]:
                            key = _finished(key * _STEP + part[:, position] + _U(int(position)))
                        keys.append(key)
                flat = np.stack(keys, axis=1).ravel().view(np.int64)
                own = np.repeat(cls[at : at + 2048], len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(own)], schema=schema)

    return classes.select("cls", "sig").mapInArrow(run, "key long, cls long")


# ---- candidates


def distance(a: Column, b: Column) -> Column:
    """Number of positions that differ in some bit plane."""
    differs = F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))
    for plane in range(1, BITS):
        differs = differs.bitwiseOR(F.get(a, F.lit(plane)).bitwiseXOR(F.get(b, F.lit(plane))))
    return F.bit_count(differs)


def _alike(rule: Rule) -> Column:
    """Of a pair with columns n_a, n_b, sig_a, sig_b: sizes and signatures allow a link."""
    sizes = F.least("n_a", "n_b") * rule.den >= F.greatest("n_a", "n_b") * rule.num
    return sizes & (distance(F.col("sig_a"), F.col("sig_b")) <= rule.radius)


def _step(n: Column, rule: Rule) -> Column:
    """Sets that can be linked have sizes in the same or in neighbouring steps."""
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(rule.den / rule.num)))).cast("int")


def families(classes: DataFrame, rule: Rule) -> DataFrame:
    """(node, root): every pair of classes within the radius has the same root."""
    keys = keyed(classes, rule)
    ranges = keys.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("top")).where("hub <> top")
    shared = written(keys.join(ranges.drop("top"), "key"), "shared-keys")
    sides = [classes.select(F.col("cls").alias(f"cls_{s}"), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}")) for s in "ab"]
    stars = (
        shared.where("cls <> hub")
        .select(F.col("hub").alias("cls_a"), F.col("cls").alias("cls_b"))
        .distinct()
        .join(sides[0], "cls_a")
        .join(sides[1], "cls_b")
        .where(_alike(rule))
        .select(F.col("cls_a").alias("u"), F.col("cls_b").alias("v"))
    )
    stars = written(stars, "stars")
    rooted = components(stars)
    named = shared.drop("hub").join(rooted.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.select("key", "cls", F.coalesce("root", "cls").alias("root"))
    per_root = named.groupBy("key", "root").agg(F.count("*").alias("size"))
    mixed = (
        per_root.groupBy("key")
        .agg(F.max_by("root", "size").alias("most"), F.count("*").alias("roots"))
        .where("roots > 1")
        .drop("roots")
    )
    mixed = written(named.join(mixed, "key"), "mixed-keys")
    few = mixed.where("root <> most").select("key", F.col("cls").alias("cls_a"), F.col("root").alias("root_a"))
    all_of = mixed.select("key", F.col("cls").alias("cls_b"), F.col("root").alias("root_b"), F.col("most").alias("most_b"))
    step_a, step_b = _step(F.col("n_a"), rule), _step(F.col("n_b"), rule)
    few = few.join(sides[0], "cls_a").withColumn("step", F.explode(F.array(step_a - 1, step_a, step_a + 1)))
    all_of = all_of.join(sides[1], "cls_b").withColumn("step", step_b)
    # A pair outside of the largest family comes once, by its order.
    once = F.expr("root_a <> root_b AND (root_b = most_b OR cls_a < cls_b)")
    across = few.join(all_of, ["key", "step"]).where(once & _alike(rule)).select(F.col("cls_a").alias("u"), F.col("cls_b").alias("v"))
    return components(stars.unionByName(across.distinct()))


# ---- verification


def _spanning(sets: list[np.ndarray], nodes: list[int], sides: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different sides, or of side 0 among themselves."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(count), sizes)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(column, minlength=len(values)) > 1
    kept = common[column]
    column = (np.cumsum(common) - 1)[column[kept]]
    owner = owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((count, count), np.float32)
    width = int(common.sum())
    cuts = np.searchsorted(column, np.arange(0, width + _SLICE, _SLICE))
    for at, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = np.zeros((count, min(_SLICE, width - at * _SLICE)), np.float32)
        part[owner[low:high], column[low:high] - at * _SLICE] = 1
        shared += part @ part.T
    both = shared.astype(np.int64)
    linked = rule.den * both >= rule.num * (sizes[:, None] + sizes[None, :] - both)
    if sides.any():
        linked &= sides[:, None] != sides[None, :]
    parent = list(range(count))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        low, high = root(int(a)), root(int(b))
        if low != high:
            parent[high] = low
            out.append((nodes[a], nodes[b]))
    return out


def _unit_of(members: DataFrame, rule: Rule, block_texts: int, block_shingles: int) -> DataFrame:
    """(cls, root, n, rep, unit, side): in which units of work a class is compared.

    Sets of likeness ``num / den`` have sizes in the same or in neighbouring steps of a
    scale by that ratio; a large family is cut into blocks inside of each step.
    """
    members = members.withColumn("step", _step(F.col("n"), rule))
    whole = members.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    small = (F.col("texts") <= block_texts) & (F.col("shingles") <= block_shingles)
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = whole.where(small).agg(F.sum("shingles").alias("s")).first().s or 0
    bundles = max(4 * parts, -(-total // block_shingles))
    own = members.join(whole, "root")
    bundled = own.where(small).select(
        "cls",
        "root",
        "rep",
        F.xxhash64(F.lit("bundle"), F.pmod(F.xxhash64("root"), F.lit(bundles))).alias("unit"),
        F.lit(0).alias("side"),
    )
    blocks = F.ceil(F.greatest(F.count("*") / block_texts, F.sum("n") / block_shingles)).cast("int")
    large = own.where(~small)
    per_step = large.groupBy("root", "step").agg(blocks.alias("blocks"))
    near = per_step.select(F.col("root"), F.col("step").alias("own_step"), F.lit(0).alias("zero"))
    around = (
        near.join(per_step, "root")
        .where(F.abs(F.col("step") - F.col("own_step")) <= 1)
        .groupBy("root", F.col("own_step").alias("step"))
        .agg(F.map_from_entries(F.collect_list(F.struct("step", "blocks"))).alias("blocks"))
    )
    placed = large.join(around, ["root", "step"]).withColumn(
        "block", F.pmod(F.xxhash64("cls"), F.get(F.array(F.col("blocks")[F.col("step")]), F.lit(0))).cast("int")
    )

    def with_step(other: Column, own_first: bool) -> Column:
        """Units with every block of another step."""
        count = F.coalesce(F.try_element_at("blocks", other), F.lit(0))
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        mine, theirs = (F.col("step"), F.col("block")), other

        def unit(j: Column) -> Column:
            ends = (*mine, theirs, j) if own_first else (theirs, j, *mine)
            return F.struct(F.xxhash64("root", *ends).alias("unit"), F.lit(1 if own_first else 2).alias("side"))

        return F.transform(numbers, unit)

    same = F.transform(
        F.sequence(F.lit(0), F.col("blocks")[F.col("step")] - 1),
        lambda j: F.struct(
            F.xxhash64("root", "step", F.least(j, F.col("block")), "step", F.greatest(j, F.col("block"))).alias("unit"),
            F.when(j == F.col("block"), 0).when(F.col("block") < j, 1).otherwise(2).alias("side"),
        ),
    )
    units = F.concat(same, with_step(F.col("step") + 1, True), with_step(F.col("step") - 1, False))
    dealt = placed.select("cls", "root", "rep", F.explode(units).alias("at")).select("cls", "root", "rep", "at.unit", "at.side")
    return bundled.unionByName(dealt)


def links(
    docs: DataFrame,
    members: DataFrame,
    rule: Rule,
    block_texts: int = BLOCK_TEXTS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(u, v): edges that connect the classes of each family as its true links do."""
    units = _unit_of(members, rule, block_texts, block_shingles)
    wanted = units.select("cls", "root", "unit", "side", F.col("rep.doc_id").alias("rep_id"), F.col("rep.digest").alias("rep_digest"))
    own = slim(docs).withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    # By the text as well: null and repeated ids stand for many texts.
    same = own["doc_id"].eqNullSafe(wanted["rep_id"]) & (own["digest"] == wanted["rep_digest"])
    work = own.join(wanted, same).select("text", "cls", "root", "unit", "side")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        memo = _Hashes()
        out: list[tuple[int, int]] = []
        for _, family in rows.groupby("root"):
            sets, nodes, sides = [], [], []
            for cls, text, side in zip(family["cls"], family["text"], family["side"], strict=True):
                own = shingle_set(text or "", rule.words, memo)
                # Equal rows bring their text more than once.
                if class_of(own) == cls and cls not in nodes:
                    sets.append(own)
                    nodes.append(int(cls))
                    sides.append(int(side))
            if len(sets) > 1:
                out += _spanning(sets, nodes, np.array(sides), rule)
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return work.groupBy("unit").applyInPandas(verify, "u long, v long")


def classes(marks: DataFrame) -> DataFrame:
    """cls, n, rep and sig of every class; its representative is the row with the smallest id and text hash, null ids last."""
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("rep")
    return marks.where("cls IS NOT NULL").groupBy("cls").agg(F.min("n").alias("n"), rep, F.any_value("sig").alias("sig"))


def _placed(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, digest, n, cls and the first row (``top``) of the component of every row."""
    marks = written(signed(docs, rule), "signatures")
    per_class = written(classes(marks), "classes")
    # A smaller set has no partner but its equals.
    able = per_class.where(F.col("n") * rule.den >= (F.col("n") + 1) * rule.num)
    rooted = families(able, rule)
    members = per_class.select("cls", "n", "rep").join(rooted.withColumnRenamed("node", "cls"), "cls")
    found = components(written(links(docs, members, rule), "links"))
    tops = per_class.select("cls", "rep").join(found.withColumnRenamed("node", "cls"), "cls", "left")
    tops = tops.select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    first = tops.groupBy("root").agg(F.min("rep").alias("top"))
    of_class = tops.join(first, "root").select("cls", "top")
    return marks.select("doc_id", "digest", "n", "cls").join(of_class, "cls", "left")


def grouped(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id"))
    return _placed(docs, rule).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def deduplicated(docs: DataFrame, rule: Rule) -> DataFrame:
    """The documents that stay, one of each component, with all their columns.

    Rows are told apart by id and text: of several rows under one id, or under
    none, only the first of the component stays. Equal rows stay or go together.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("digest") == F.col("top.digest"))
    gone = _placed(docs, rule).where(F.col("cls").isNotNull() & ~stays).select("doc_id", "digest").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("own"), F.struct("*").alias("row"))
    left = own.join(gone, own["id"].eqNullSafe(gone["doc_id"]) & (own["own"] == gone["digest"]), "left_anti")
    return left.select("row.*")
