"""Exact and near copies, slots: against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwheel.llm import exact, graph, near, slots
from tests.llm.conftest import SCHEMA, prose


# ---- op5


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 60_000])
def test_a_filter_never_misses_and_seldom_errs(n):
    draw = np.random.default_rng(n)
    keys = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
    own = exact.fuse_filter(keys)
    assert exact.may_hold(keys, *own).all()
    others = np.setdiff1d(draw.integers(0, 2**63, 50_000, dtype=np.uint64), keys)
    assert exact.may_hold(others, *own).mean() < 0.01
    if n >= 60_000:
        assert len(own[3]) < 1.3 * n


def _exact_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for i in ids:
            out.append((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("loads", [1, 2, 3])
def test_exact_copies_in_any_number_of_loads(spark, awkward, awkward_rows, loads):
    got = sorted((tuple(r) for r in exact.report(awkward, loads).collect()), key=repr)
    assert got == _exact_by_hand(awkward_rows)


def test_exact_hot_text_and_empty_table(spark, empty, monkeypatch):
    monkeypatch.setattr(exact, "COPIES_PER_SALT", 4)
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 50}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in exact.report(docs).collect()), key=repr) == _exact_by_hand(rows)
    assert exact.report(empty).count() == 0 and exact.deduplicated(empty).count() == 0


def test_only_equal_bytes_are_duplicates(spark, monkeypatch):
    """With digests that collide, the comparison of bytes keeps texts of different loads apart."""
    rows = [(i, t) for i, t in enumerate(["aa", "ab", "aa", "b", "ab", "aa", "ab"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = exact.marked
    monkeypatch.setattr(exact, "marked", lambda d, n: real(d, n).withColumn("digest", F.unhex(F.sha2(F.substring("text", 1, 1), 256))))
    got = {r.doc_id: r.group_size for r in exact.verdicts(docs, 2).collect()}
    load = {r.doc_id: r.load for r in real(docs, 2).collect()}
    per_load = Counter((load[i], t[0]) for i, t in rows)
    assert all(got[i] == per_load[load[i], "a"] for i, t in rows if t[0] == "a")


def test_exact_stage_keeps_one_of_each_text_and_all_columns(awkward, awkward_rows):
    got = exact.deduplicated(awkward)
    assert got.columns == awkward.columns
    texts = [r.text or "" for r in got.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in awkward_rows})


# ---- op6


def _near_by_hand(rows, words, num, den):
    sets = []
    for _, text, *_ in rows:
        parts = (text or "").encode().lower().split()
        if len(parts) >= words:
            sets.append({tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)})
        else:
            sets.append({tuple(parts)} if parts else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for a, (doc_id, *_) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        component = min(ids) if ids else None
        out.append((doc_id, len(sets[a]), component, doc_id == component))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_near_copies_of_awkward_rows(awkward, empty, awkward_rows):
    assert _got(near.grouped(awkward, near.Rule(3, 85, 100))) == _near_by_hand(awkward_rows, 3, 85, 100)
    assert near.grouped(empty, near.Rule()).count() == 0


def _family(spark, size=70):
    """A text, copies with a few words changed at all places, strangers with a shared passage."""
    words, rows = prose(1, 120).split(), []
    draw = np.random.default_rng(4)
    for i in range(size):
        own = list(words)
        for at in draw.integers(0, len(own), draw.integers(0, 9)):
            own[at] = f"x{draw.integers(0, 3)}"
        rows.append((i, " ".join(own[: 120 - int(draw.integers(0, 6))])))
    passage = prose(2, 40)
    rows += [(1000 + i, passage + " " + prose(50 + i, 30)) for i in range(30)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_near_copies_lose_no_link_in_hot_families(spark):
    rows, docs = _family(spark)
    for rule in (near.Rule(3, 85, 100), near.Rule(5, 80, 100)):
        want = _near_by_hand(rows, rule.words, rule.num, rule.den)
        assert 3 < len({r[2] for r in want if r[0] < 1000}) < 70
        assert _got(near.grouped(docs, rule)) == want


def test_blocks_of_a_large_family_find_the_links_of_the_whole(spark):
    rows, docs = _family(spark)
    rule = near.Rule(3, 85, 100)
    marks = near.classes(near.signed(docs, rule))
    members = marks.withColumn("root", F.lit(7).cast("long"))
    want = graph.components(near.links(docs, members, rule))
    want = {r.node: r.root for r in want.collect()}
    for texts, shingles in ((9, 1 << 19), (256, 700), (1, 1 << 19)):
        got = graph.components(near.links(docs, members, rule, texts, shingles))
        assert {r.node: r.root for r in got.collect()} == want


def test_all_pairs_within_the_radius_share_a_family(spark):
    draw, rows = np.random.default_rng(0), []
    rule = near.Rule(3, 85, 100)
    for _ in range(12):
        base = draw.integers(0, 1 << 16, near.K).astype("<u2")
        for _ in range(6):
            other = base.copy()
            at = draw.choice(near.K, draw.integers(0, rule.radius), replace=False)
            other[at] = draw.integers(0, 1 << 16, len(at))
            rows.append((len(rows), other))
    planes = []
    for i, values in rows:
        bits = np.unpackbits(values.view(np.uint8), bitorder="little").reshape(near.K, near.BITS).T
        planes.append((i, 100, np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<i8").ravel().tolist()))
    assert (near.values_of(np.array([p[2] for p in planes])) == np.array([v for _, v in rows])).all()
    got = {r.node: r.root for r in near.families(spark.createDataFrame(planes, "cls long, n long, sig array<long>"), rule).collect()}
    for a, va in rows:
        for b, vb in rows:
            if a < b and (va != vb).sum() <= rule.radius:
                assert got[a] == got[b]


def test_signature_distance_follows_likeness():
    memo, (factors, shifts) = near._Hashes(), near._seeds()
    text, gaps = prose(1, 4000).split(), []
    for seed in range(20):
        other = text[: 4000 - 160] + prose(100 + seed, 160).split()
        a, b = (near.shingle_set(" ".join(t), 3, memo) for t in (text, other))
        both = len(np.intersect1d(a, b))
        sig = near.values_of(np.array([near.signature(s, factors, shifts) for s in (a, b)]))
        gaps.append((sig[0] != sig[1]).mean() - (1 - both / (len(a) + len(b) - both)))
    assert abs(np.mean(gaps)) < 0.03


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(61)} | {x: 100 for x in range(100, 160)} | {300: 300, 301: 300}
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_stage_keeps_one_of_each_component(spark, awkward):
    rows, docs = _family(spark, 30)
    rule = near.Rule(3, 85, 100)
    want = {r[0] for r in _near_by_hand(rows, 3, 85, 100) if r[3]}
    assert {r.doc_id for r in near.deduplicated(docs, rule).collect()} == want
    assert near.deduplicated(awkward, rule).columns == awkward.columns


# ---- op9


def _check_shards(rows, got, shards=8):
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    texts = sorted((i or -99, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r.doc_id or -99, r.size, r.text_crc32) for r in got) == texts
    return [sum(r.size for r in by.get(s, [])) for s in range(shards)]


def test_shards_of_equal_bytes(spark):
    rows = [(i, "x" * (i * i % 97)) for i in range(4000)]
    loads = _check_shards(rows, slots.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert max(loads) - min(loads) <= 4


def test_shards_of_awkward_rows(awkward, empty, awkward_rows):
    _check_shards(awkward_rows, slots.shard(awkward).collect())
    assert slots.shard(empty).count() == 0


def test_rebalancing_moves_few_slots_and_fills_a_new_shard():
    draw = np.random.default_rng(1)
    weights = draw.integers(1, 1000, 512).tolist()
    first = slots.first_map(512, 8)
    second = slots.rebalanced(first, weights, 8)
    third = slots.rebalanced(second, weights, 9)

    def loads(owner, n):
        return [sum(w for w, s in zip(weights, owner, strict=True) if s == shard) for shard in range(n)]

    assert max(loads(second, 8)) - min(loads(second, 8)) < 50 and max(loads(third, 9)) - min(loads(third, 9)) < 100
    moved = [(a, b) for a, b in zip(second, third, strict=True) if a != b]
    assert sum(b == 8 for _, b in moved) > 0.8 * len(moved)
    assert slots.rebalanced(second, weights, 8) == second
    assert slots.rebalanced([0] * 4, [5, 0, 0, 0], 2) == [0] * 4


def now_version(spark, path):
    return slots.load_map(spark, path).version


def test_a_stored_map_is_edited(spark, tmp_path):
    """A second call starts from the stored version; more rows and one more shard move few slots and rows."""
    path = str(tmp_path / "map")
    rows = [(i, "x" * (i * i % 97)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert slots.load_map(spark, path) is None
    first = slots.shard(docs, map_path=path).collect()
    stored = slots.load_map(spark, path)
    again = slots.shard(docs, map_path=path).collect()
    assert sorted(first) == sorted(again) and slots.load_map(spark, path) == stored

    # One shard more: rows go to the new shard, nearly all others stay.
    grown = slots.shard(docs, 9, map_path=path).collect()
    loads = _check_shards(rows, grown, 9)
    assert max(loads) - min(loads) <= 8
    before, after = ({r.doc_id: r.shard for r in got} for got in (first, grown))
    moved = [after[i] for i in before if before[i] != after[i]]
    assert sum(s == 8 for s in moved) > 0.9 * len(moved) and len(moved) < 1.2 * len(rows) / 9
    assert slots.load_map(spark, path).version == stored.version + 1
    assert {r.map_version for r in grown} == {stored.version + 1}

    # More rows: the versions before stay in the folder, few old rows move.
    more = rows + [(i, "y" * (i % 89)) for i in range(3000, 3600)]
    later = slots.shard(spark.createDataFrame(more, "doc_id long, text string"), 9, map_path=path).collect()
    loads = _check_shards(more, later, 9)
    assert max(loads) - min(loads) <= 8
    now = {r.doc_id: r.shard for r in later}
    assert sum(now[i] != after[i] for i in after) < 0.1 * len(after)
    assert {r.version for r in spark.read.parquet(path).select("version").distinct().collect()} == set(range(now_version(spark, path) + 1))

    # Fewer shards: only what the last ones had moves, but for the evening out.
    fewer = slots.shard(spark.createDataFrame(more, "doc_id long, text string"), 7, map_path=path).collect()
    loads = _check_shards(more, fewer, 7)
    assert max(loads) - min(loads) <= 8
    assert sum(r.shard != now[r.doc_id] for r in fewer if now[r.doc_id] < 7) < 0.1 * len(more)

    # No rows leave the map as it is; another number of slots is refused.
    version = now_version(spark, path)
    assert slots.shard(docs.where("false"), 7, map_path=path).count() == 0
    assert now_version(spark, path) == version
    with pytest.raises(ValueError):
        slots.shard(docs, 7, n_slots=64, map_path=path)


def test_a_map_written_twice_is_refused(spark, tmp_path):
    path = str(tmp_path / "map")
    one = slots.SlotMap(0, [1, 2], [0, 1, 0])
    for _ in range(2):
        slots.save_map(spark, path, one, [(0, 0)] * 3)
    with pytest.raises(ValueError):
        slots.load_map(spark, path)


@pytest.mark.parametrize("kind", ["equal", "null id", "empty"])
def test_an_id_on_most_rows_does_not_fill_a_shard(spark, kind):
    """Equal rows, other texts under one null id, and rows without bytes: bytes stay even."""
    hot = {
        "equal": [(7, "same text of some length")] * 6000,
        "null id": [(None, f"text {i} " + "z" * (i % 40)) for i in range(6000)],
        "empty": [(None, None)] * 6000,
    }[kind]
    rows = hot + [(i, "x" * (i % 61)) for i in range(100, 3100)]
    got = slots.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    loads = _check_shards(rows, got)
    assert max(loads) - min(loads) <= 0.01 * sum(loads) / 8
    per_piece = Counter((r.virtual_slot, r.slot_piece) for r in got)
    assert max(per_piece.values()) <= 2 * len(rows) / (8 * slots.PIECES) + 10


def test_blocks_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(slots, "BLOCK", 3)
    rows = [(7, "same")] * 2000 + [(8, "other")] * 10
    _check_shards(rows, slots.shard(spark.createDataFrame(rows, "doc_id long, text string"), n_slots=2).collect())


def test_cutting_a_slot_moves_no_row():
    one = slots.SlotMap(3, [1, 2, 1], [5, 1, 2, 0])
    finer = slots.cut(one, [(10, 10), (1000, 90_000), (0, 0)], 8)
    assert finer.version == 3 and finer.pieces[0] == 8 and finer.pieces[1] == 512 and finer.pieces[2] == 1
    assert [finer.owner[8 + piece] for piece in range(4)] == [1, 2, 1, 2] and set(finer.owner[:8]) == {5}


def test_rows_with_null_and_repeated_ids_are_linked(spark):
    """A null id bridges two texts; near copies under one id, and under none, are told apart by their text."""
    words = prose(3, 60).split()
    a, b, c = (" ".join(words[i:] + [f"end{i}"] * i) for i in (0, 3, 6))
    other = prose(4, 60)
    rows = [(5, a), (None, b), (9, c), (7, other), (7, other + " more"), (None, prose(6, 50)), (None, prose(6, 50) + " tail"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rule = near.Rule(3, 85, 100)
    got = sorted((tuple(r) for r in near.grouped(docs, rule).select("doc_id", "component_id", "kept").collect()), key=repr)
    want = [(5, 5, True), (None, 5, False), (9, 5, False), (7, 7, True), (7, 7, True), (None, None, True), (None, None, True), (None, None, True)]
    assert got == sorted(want, key=repr)
    left = sorted((tuple(r) for r in near.deduplicated(docs, rule).collect()), key=repr)
    assert len(left) == 4 and left.count((5, a)) == 1 and left.count((None, None)) == 1
    assert sum(i == 7 for i, _ in left) == 1 and sum(i is None and t is not None for i, t in left) == 1
