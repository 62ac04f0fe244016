"""Runs of words, files of ids and aligned tokenizers against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cartwheel.llm import align, planes, runs
from cartwheel.llm.queries import QUERIES
from tests.conftest import TINY

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def text_rows(docs):
    return [(row.doc_id, row.text) for row in docs.select("doc_id", "text").collect()]


# --- runs ---------------------------------------------------------------------


def plain_runs(words, least=12):
    """All (start, length, period) by comparing every word with that q further, for every q."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((start, end - start, q) for (start, end), q in found.items())


def listed(found):
    return sorted(zip(found.start.tolist(), (found.end - found.start).tolist(), found.period.tolist(), strict=True))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def strange_words(draw):
    n = draw.choice([0, 1, 11, 12, 13, 40, 90, 250, 400])
    kind = draw.randrange(6)
    if kind == 0:
        return [draw.choice("ab") for _ in range(n)]
    if kind == 1:
        return fibonacci(n)
    if kind == 2:  # regions of one small period that meet out of phase
        unit, out = [draw.choice("ab") for _ in range(draw.randint(1, 4))], []
        while len(out) < n:
            out += (unit * 60)[: draw.randint(1, 60)]
        return out
    if kind == 3:  # one long period with a few breaks
        unit = [draw.choice("abcdefgh") for _ in range(draw.randint(1, max(1, n // 2)))]
        out = (unit * n)[:n]
        for _ in range(draw.randint(0, 3)):
            if out:
                out[draw.randrange(n)] = "z"
        return out
    if kind == 4:  # squares of periodic words
        unit = ([draw.choice("ab") for _ in range(draw.randint(1, 3))] * 120)[: draw.randint(1, 120)]
        return unit + unit + [draw.choice("abc")]
    return [draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)] + [draw.choice("ab")] * draw.randint(0, 30)


@pytest.mark.parametrize(("base", "least"), [(2, 4), (4, 12), (8, 12), (16, 12), (16, 2)])
def test_all_runs_are_found(base, least):
    draw = random.Random(base * 100 + least)
    for _ in range(60):
        texts = [[w.encode() for w in strange_words(draw)] for _ in range(draw.randint(1, 10))]
        for words, found in zip(texts, runs.found_in(texts, base, least), strict=True):
            assert listed(found) == plain_runs(words, least)


def test_regions_in_phase_are_needed(monkeypatch):
    """A square of a periodic word has no selected place; its regions propose it."""
    unit = ["ab"[i % 2] for i in range(101)]
    words = [w.encode() for w in unit + unit]
    assert (0, 202, 101) in listed(runs.found_in([words])[0])
    monkeypatch.setattr(runs.Block, "in_phase", lambda self, known, t: runs._NOWHERE)
    assert (0, 202, 101) not in listed(runs.found_in([words])[0])


def expected_runs(doc_id, text, planted):
    words = WORD.findall((text or "").encode())
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words) if n <= 3000 else listed(runs.found_in([words])[0])
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id,
        len(found),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_run_query_matches_brute_force(spark):
    got = [tuple(row) for row in QUERIES["op11_synchronising_runs"](spark, TINY).collect()]
    want = [expected_runs(*row, True) for row in text_rows(spark.read.parquet(f"{TINY}/documents.parquet"))]
    assert sorted(got) == sorted(want)
    assert any(row[1] for row in want)


def test_runs_of_awkward_rows(spark, awkward, awkward_rows, empty):
    got = sorted((tuple(row) for row in runs.report(awkward, block=50).collect()), key=repr)
    assert got == sorted((expected_runs(row[0], row[1], False) for row in awkward_rows), key=repr)
    assert runs.report(empty).count() == 0 and runs.all_runs(empty).count() == 0


def test_a_very_long_text_and_its_collapsed_form(spark):
    chorus = [f"w{i}" for i in range(700)]
    words = [f"x{i}" for i in range(40_000)] + chorus * 4 + [f"y{i}" for i in range(300)] + ["la"] * 50_000
    docs = spark.createDataFrame([(1, "\n ".join(words)), (2, "a\x0bb\x1cc a b c")], "doc_id long, text string")
    assert [tuple(r) for r in runs.all_runs(docs).orderBy("start").collect()] == [(1, 40_000, 2800, 700), (1, 43_100, 50_000, 1)]
    texts = {r.doc_id: r.text for r in runs.collapsed(docs).collect()}
    assert texts[1].split() == words[:40_000] + chorus + words[42_800:43_100] + ["la"]
    assert texts[2] == "a b\x1cc a b c"


# --- files of ids ---------------------------------------------------------------


def reference_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected_ids(rows):
    """(doc_id, start, n_tokens, crc) and ids in ascending order of the ids; nulls first."""
    tokenizer, out, lists, at = reference_tokenizer(), [], [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        lists.append(ids)
        at += len(ids)
    return out, lists


def test_plane_query_matches_the_library(spark):
    got = QUERIES["op12_id_planes"](spark, TINY).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    want, _ = expected_ids(text_rows(spark.read.parquet(f"{TINY}/documents.parquet")))
    assert sorted(tuple(row) for row in got) == sorted(want)


@pytest.mark.parametrize("layout", [planes.Layout(), planes.Layout(block=100, bits=1), planes.Layout(block=7, level=1)])
def test_files_round_trip(spark, awkward, awkward_rows, layout, tmp_path):
    folder = str(tmp_path / "ids")
    planes.write_ids(awkward, folder, layout)
    files = planes.read_ids(spark, folder).orderBy("file", "place").collect()
    ids = [row.doc_id for row in files]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    _, lists = expected_ids([row[:2] for row in awkward_rows])
    assert sorted(row.ids for row in files) == sorted(lists)
    index = planes.read_index(spark, folder).collect()
    assert sum(row.n_ids for row in index) == sum(map(len, lists))
    sizes = Counter(row.file for row in index if row.n_ids < layout.block)
    assert max(sizes.values()) == 1 and max(row.n_ids for row in index) <= layout.block


def test_starts_count_all_files_before(awkward, awkward_rows):
    rows = planes.report(awkward, planes.Layout(block=1000)).orderBy("file", "place").collect()
    assert len(rows) == len(awkward_rows) and len({r.file for r in rows}) > 1
    at = 0
    for row in rows:
        assert row.start == at
        at += row.n_tokens


def test_planes_of_any_ids():
    draw = np.random.default_rng(3)
    for ids in (draw.integers(0, 1 << 32, 5000), draw.integers(0, 300, 37), np.zeros(9), np.array([], np.int64)):
        ids = ids.astype(np.uint32)
        for bits in (1, 8):
            made = planes.to_planes(ids, bits)
            assert len(made) == 32 // bits and (planes.from_planes(made, len(ids), bits) == ids).all()


def test_added_token_and_single_documents():
    writer = planes.Writer(planes.Layout(block=8))
    docs = [(3, np.arange(5)), (None, np.arange(0)), (4, np.arange(100, 137)), (-7, np.arange(2))]
    content = writer.head() + b"\n"
    for doc_id, ids in docs:
        content += b"".join(s + b"\n" for s in writer.add(doc_id, ids.astype(np.uint32)))
    content += b"".join(s + b"\n" for s in writer.close())
    reader = planes.Reader(content)
    assert reader.doc_ids == [3, None, 4, -7] and reader.n_ids == 44
    for number, (_, ids) in enumerate(docs):
        assert (reader.document(number) == ids).all()
    broken = bytearray(content)
    broken[int(reader.offsets[1]) + 14] ^= 255
    with pytest.raises(Exception):  # noqa: B017 - by the compressor or the checksum
        planes.Reader(bytes(broken)).chunk(1)


def test_added_token_is_one_id(spark, tmp_path):
    folder, text = str(tmp_path / "ids"), "Stories end with <|endoftext|> here \n<|endoftext|>"
    planes.write_ids(spark.createDataFrame([(1, text)], "doc_id long, text string"), folder)
    assert planes.read_ids(spark, folder).first().ids == [*reference_tokenizer().encode(text, add_special_tokens=False).ids, 2]


def test_no_documents(spark, empty, tmp_path):
    assert planes.report(empty, folder=str(tmp_path / "none")).count() == 0
    assert planes.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_one_hot_id_is_dealt_to_many_files(spark):
    docs = spark.range(4000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "if(id % 2 = 0, 'same', concat('own ', id)) AS text")
    rows = planes.report(docs).collect()
    assert len(rows) == 4000
    per_file = Counter(row.file for row in rows)
    assert max(per_file.values()) < 2 * 4000 / len(per_file)


# --- aligned tokenizers -----------------------------------------------------------


@pytest.fixture(scope="module")
def brute_sides():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}

    def bytes_b(i):
        piece = model.id_to_piece(i)
        code = re.fullmatch("<0x(..)>", piece)
        return bytes([int(code[1], 16)]) if code else piece.replace("▁", " ").encode()

    def sides(text):
        """(ids and bytes of A, those of B), or nothing."""
        if not text:
            return None
        a, b = own.encode(f" {text}", add_special_tokens=False).ids, model.encode(text)
        spelled = [bytes(byte_of[c] for c in own.id_to_token(i)) for i in a], [bytes_b(i) for i in b]
        return (a, b, *spelled) if all(b"".join(s) == f" {text}".encode() for s in spelled) else None

    return sides


def brute_groups(found):
    if found is None:
        return []
    a, b, bytes_a, bytes_b = found
    ends_a, ends_b = (np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b))
    out, low_a, low_b = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        high_a, high_b = ends_a.index(end, low_a) + 1, ends_b.index(end, low_b) + 1
        out.append((a[low_a:high_a], b[low_b:high_b]))
        low_a, low_b = high_a, high_b
    return out


def expected_links(rows, sides):
    found = [(doc_id, brute_groups(sides(text))) for doc_id, text in rows]
    times = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in found]
    counts, most = Counter(pair for own in times for pair in own), defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, groups), own in zip(found, times, strict=True):
        spelled = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append(
            (
                doc_id,
                sum(len(a) for a, _ in groups),
                sum(len(b) for _, b in groups),
                len(groups),
                sum(own.values()),
                sum(n for pair, n in own.items() if counts[pair] == most[pair[0]]),
                sum(n * counts[pair] for pair, n in own.items()),
                hashlib.sha256(spelled.encode()).hexdigest() if groups else "",
            )
        )
    return out, counts


def test_link_query_matches_brute_force(spark, brute_sides):
    got = [tuple(row) for row in QUERIES["op13_tokenizer_links"](spark, TINY).collect()]
    want, _ = expected_links(text_rows(spark.read.parquet(f"{TINY}/documents.parquet")), brute_sides)
    assert sorted(got) == sorted(want)


STRANGE = [
    (20, "already ▁ marked"),
    (21, "<|endoftext|> and <s> and <0x41> and </s>"),
    (22, "a\tb\r\nc  d   e\n\n\n f g　h"),
    (23, "ﬁne ﬀ ½ é ​﻿ 🤷🏽‍♀️"),
    (24, " leading and trailing "),
    (25, " "),
]


@pytest.mark.parametrize(("block", "buckets", "fan"), [(300, 5, 2), (1 << 20, 64, 8)])
def test_links_of_awkward_rows(spark, awkward, awkward_rows, brute_sides, block, buckets, fan):
    """Blocks of one text and of all, trees of several levels and of none."""
    more = spark.createDataFrame(STRANGE, "doc_id long, text string")
    docs = awkward.select("doc_id", "text").unionByName(more)
    got = [tuple(row) for row in align.report(docs, block=block, buckets=buckets, fan=fan).collect()]
    want, _ = expected_links([*(row[:2] for row in awkward_rows), *STRANGE], brute_sides)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [row for row in want if row[0] == 20] == [(20, 0, 0, 0, 0, 0, 0, "")]


def test_wide_groups_give_the_same_links(spark, awkward, awkward_rows, brute_sides, monkeypatch):
    sides = [brute_sides(row[1]) for row in awkward_rows]
    own = align.both(public_tokenizers.path(align.RANKS_A), public_tokenizers.path(align.MODEL_B))
    monkeypatch.setattr(align, "WIDE", 0)
    monkeypatch.setattr(align, "LINKS", 7)
    for found in sides:
        if found and len(found[0]) < 500:
            a, b = np.array(found[0]), np.array(found[1])
            one = align.Aligned(own.side_a(a, np.array([len(a)])), own.side_b(b, np.array([len(b)])))
            got = Counter()
            for _, pairs, times in one.links():
                for pair, n in zip(pairs.tolist(), times.tolist(), strict=True):
                    got[pair >> 32, pair & 0xFFFFFFFF] += n
            assert got == Counter((x, y) for g, h in brute_groups(found) for x in g for y in h)
            pairs, documents = one.counted()
            assert len(set(pairs.tolist())) == len(pairs) == len(got) and (documents == 1).all()


def test_pair_counts_and_groups(spark, brute_sides):
    rows = [(1, "the cat"), (2, "the cats"), (3, "the the"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, counts = expected_links(rows, brute_sides)
    got = align.pair_counts(docs).collect()
    assert {(r.a_id, r.b_id): r.documents for r in got} == dict(counts)
    most = {x: max(n for (y, _), n in counts.items() if y == x) for x, _ in counts}
    assert all(r.is_best == (r.documents == most[r.a_id]) for r in got)
    listed_groups = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in align.groups(docs).collect()}
    assert listed_groups == {doc_id: brute_groups(brute_sides(text)) for doc_id, text in rows}


def test_no_links(empty):
    assert align.report(empty).count() == 0 and align.pair_counts(empty).count() == 0


def test_perfect_hash_is_minimal_and_kept():
    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(draw.integers(0, 1 << 62, n).astype(np.uint64))
        again = align.PerfectHash.load(align.PerfectHash.of(keys).dump())
        assert sorted(again.index(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError, match="distinct"):
        align.PerfectHash.of(np.array([4, 4], np.uint64))
