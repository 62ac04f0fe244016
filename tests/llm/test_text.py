"""Fingerprints, tokens, packing: against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartwheel.llm import bpe, fingerprints, packing
from tests.conftest import SMALL
from tests.llm.conftest import prose


# ---- op1


def test_neighbours_and_edits(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    spread = docs.withColumn("doc_id", F.col("doc_id") * F.col("doc_id") - 1000)
    got = {r.doc_id: r for r in fingerprints.fingerprints(spread).collect()}
    rows = sorted(((r.doc_id, r.text) for r in spread.collect()), reverse=True)
    likeness = []
    for at, (doc_id, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        likeness.append((row.near_edited, row.near_next))
    assert 0.4 < np.mean([a for a, _ in likeness]) < 0.6 and np.mean([b for _, b in likeness]) < 0.05


def _sets(text, words=5):
    parts = text.lower().split()
    return {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)}


def test_containment_of_unequal_lengths_is_estimated_and_merges(spark):
    long, other = prose(3, 20_000), prose(4, 4_000)
    part = " ".join(long.split()[2_000:4_000]) + " " + " ".join(other.split()[:2_000])
    rows = spark.createDataFrame([(part, long, long + " " + other)], "a string, b string, c string")
    s = {c: fingerprints.sketch(F.col(c)) for c in "abc"}
    row = rows.select(
        fingerprints.containment(s["a"], s["b"]).alias("a_in_b"),
        fingerprints.containment(s["a"], s["a"]).alias("same"),
        F.size(s["b"]).alias("n_b"),
        (F.size(F.array_except(s["b"], fingerprints.merged(s["a"], s["b"])))).alias("lost"),
        F.array_max(s["b"]).alias("top"),
    ).first()
    true = len(_sets(part) & _sets(long)) / len(_sets(part))
    assert abs(row.a_in_b - true) < 0.1 and row.same == 1.0 and row.lost == 0
    assert abs(row.n_b / len(_sets(long)) - 1 / 16) < 0.01 and row.top < 1 << 59


def test_short_sketches_are_whole(spark):
    rows = spark.createDataFrame([("a b c d e f g", "a b c d e f x"), ("one", "one"), ("", ""), ("one", "")], "a string, b string")
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    got = rows.select(F.size(a), F.size(b), fingerprints.containment(a, b)).collect()
    assert [tuple(r) for r in got] == [(3, 3, 2 / 3), (1, 1, 1.0), (0, 0, 1.0), (1, 0, 0.0)]


def test_fingerprints_of_awkward_rows(awkward, empty, awkward_rows):
    got = fingerprints.fingerprints(awkward).collect()
    assert len(got) == len(awkward_rows) and fingerprints.fingerprints(empty).count() == 0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.fingerprint)
    assert by[1] == by[2] and by[3] == by[4] == by[5] == {""} and by[6] != by[1]


def test_many_ranges_give_the_same_neighbours(spark):
    rows = spark.createDataFrame([(i * i, str(i)) for i in range(300)], "doc_id long, text string")
    for buckets in (1, 2, 7, 64, 1000):
        got = {r.text: r.next_text for r in fingerprints.with_next(rows, ["text"], buckets).collect()}
        assert got == {str(i): str((i - 1) % 300) for i in range(300)}


# ---- op2


@pytest.fixture(scope="module")
def own():
    return bpe.codec(public_tokenizers.path(bpe.MULTI))


@pytest.fixture(scope="module")
def whole():
    import base64

    with open(public_tokenizers.path(bpe.MULTI), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_any_leaf_size_gives_the_tokens_of_the_whole_text(own, whole):
    draw = random.Random(3)
    bits = [" ", "  ", "\n", "'", "'ll", "'s", "a", "é", "12", "!", "the ", "x y ", "\t", "日本", "　", "\x1c", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 120)))
        leaf = draw.choice((1, 2, 5, 16))
        ids = own.encode(text, leaf)
        assert ids == whole.encode_ordinary(text)
        assert own.decode(ids, leaf) == text.encode()


@pytest.mark.parametrize("text", [" " * 100_000, "a" * 100_000, "\n " * 50_000, "don't " * 20_000])
def test_long_runs(own, whole, text):
    assert own.encode(text) == whole.encode_ordinary(text)


def test_round_trip_of_awkward_rows(awkward, empty, awkward_rows, whole):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(awkward, leaf=512).collect())
    want = []
    for doc_id, text, *_ in awkward_rows:
        ids = whole.encode_ordinary(text or "")
        digests = (hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        want.append((doc_id or 0, len(ids), *digests))
    assert got == sorted(want)
    assert bpe.round_trip(empty).count() == 0
    back = bpe.decoded(bpe.encoded(awkward))
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, *_ in awkward_rows)


# ---- op4


def _check_packing(pieces, documents, tokenizer, window=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == documents.keys()
    for doc_id, text in documents.items():
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for row in by_sequence.values():
        at = 0
        for p in sorted(row, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_holds_every_id_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pieces = packing.pack(docs, block_tokens=50_000).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    padding = _check_packing(pieces, {r.doc_id: r.text for r in docs.collect()}, tokenizer)
    assert padding < 1024 * docs.rdd.getNumPartitions()
    assert len({p.tier for p in pieces}) > 2
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p.step_group] += p.length
    assert max(tokens.values()) <= packing.STEP_TOKENS


def test_short_documents_fill_the_gaps_of_long_ones():
    packer = packing.Packer((4, 8, 16), step_tokens=32)
    for number, length in enumerate([13, 3, 20, 2, 2, 5, 1]):
        packer.add(number, length)
    done = packer.pack(last=True)
    assert all(size == sum(p[0] for p in row) for size, row in done[:-1])
    assert (16, [(13, 0, 0), (3, 1, 0)]) in done
    assert sorted(d for _, row in done for _, d, _ in row if d == 2) == [2, 2]


def test_packing_awkward_rows(spark, awkward, empty):
    one = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).coalesce(1).cache()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    _check_packing(packing.pack(one).collect(), {r.doc_id: r.text for r in one.collect()}, tokenizer)
    assert packing.pack(empty).count() == 0
    assert packing.pack(awkward).groupBy().sum("length").first()[0] == packing.pack(awkward).where("start = 0").groupBy().sum("doc_tokens").first()[0]


def test_added_tokens_are_single_ids(spark):
    end = "<|endoftext|>"
    bits = ["Stories end with ", end, " here", end + end, "<|endof", "text|>", "\n", "  ", prose(7, 3000), "é", "'ll"]
    draw = random.Random(5)
    texts = [end, f"Stories end with {end} here", prose(1, 4000) + end + prose(2, 4000)]
    texts += ["".join(draw.choice(bits) for _ in range(draw.randint(1, 8))) for _ in range(40)]
    docs = dict(enumerate(texts))
    pieces = packing.pack(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(tokenizer.encode(texts[0], add_special_tokens=False).ids) == 1
    _check_packing(pieces, docs, tokenizer)
