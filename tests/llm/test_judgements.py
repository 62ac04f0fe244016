"""Pages, personal data, quality, licences, and the pipeline."""

import hashlib
import html
import html.entities
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow.dataset as ds
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cartwheel.llm import licences, pii, quality, warc
from tests.conftest import TINY
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_groups import _near_by_hand


# ---- op3

PAGES = [
    (1, "http://a.example/x", '<html lang="en"><title> A &amp; B </title><p>one<br>two &lt;3 &#233;&#128512;<script>var x="</p>";</script>'),
    (2, None, "<p>same</p>"),
    (2, None, "<p>same</p>"),
    (3, "http://a.example/y\r\nX: 1", None),
    (None, "u", ""),
    (4, "u", "<!-- never closed <p>hidden</p>"),
    (5, "u", "a<style>b</style>c<SCRIPT>d</SCRIPT >e &amp;lt; &#0; &#55296; &#1114112;"),
    (6, "u", '<a href="/1">x</a><a class="k" href="/2">y</a><a>z</a>' + "<div>" * 20_000 + "<script>" * 20_000),
]


def _derived(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    extra = pages.select("*", F.lit("own").alias("payload"), F.lit("own").alias("record_id"), F.lit(1).alias("part"))
    return warc.derived(warc.responses(extra))


def test_pages_give_two_linked_records_each(spark):
    rows = _derived(spark).collect()
    assert Counter(r.record_type for r in rows) == {"metadata": len(PAGES), "conversion": len(PAGES)}
    assert len({r.refers_to for r in rows}) == len(PAGES) - 1
    for r in rows:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id)
        assert r.content_length == len(r.block.encode()) and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
    text = {r.page_id: r.block for r in rows if r.record_type == "conversion"}
    assert text == {1: "A & B\none\ntwo <3 é😀", 2: "same", 3: "", None: "", 4: "", 5: "a c e &lt; � � �", 6: "xyz"}
    meta = {r.page_id: r.block for r in rows if r.record_type == "metadata"}
    assert meta[1] == "title: A & B\r\nlanguage: en\r\n"
    assert meta[6] == "title: \r\nlanguage: \r\noutlink: /1 L a/@href\r\noutlink: /2 L a/@href\r\n"


def test_references_are_those_of_html(spark):
    texts = ["&copy; &middot; &eacute;", "&#x27;&#X1F600;&#233;", "&copy 2020 &notit; &notin; &unknown; &;&", "&#38;lt; &amp;copy;"]
    texts += ["&#128; &#x80; &#1; x&#xFDD0;y &#00000000000233; &#99999999999999; &#xFFFFFFFFFFFF;", "&#x; &#; &Aacute&aacute;"]
    texts += ["".join(f"&{name} " for name in html.entities.html5 if not name.startswith(("nbsp", "NewLine", "Tab")))]
    pages = spark.read.parquet(f"{TINY}/pages.parquet").collect()
    own = [(i, "u", f"x{text}x") for i, text in enumerate(texts)]
    own += [(1000 + r.page_id, r.url, r.html) for r in pages]
    found = warc.derived(warc.responses(spark.createDataFrame(own, "page_id long, url string, html string")))
    got = {r.page_id: r.block for r in found.where("record_type = 'conversion'").collect()}
    for page_id, _, text in own:
        for tags, sign in ((warc.HIDDEN, " "), (warc.BLOCK_TAG, "\n"), (warc.TAG, "")):
            text = re.sub(tags.replace(r"\z", r"\Z"), sign, text)
        text = html.unescape(text.replace("&nbsp;", " "))
        want = re.sub(" ?\n[ \n]*", "\n", re.sub("[ \t\f\r]+", " ", text)).strip(" \n")
        assert got[page_id] == want


def test_titles_and_headers_are_kept(spark):
    text = "<html><TITLE\nid=x>\n Caf&eacute;&nbsp;&amp; &#x27;Co&#39; &copy 2020 &amp;lt; </TITLE>"
    pages = spark.createDataFrame([(1, "u", text, "2020-02-02T00:00:00Z")], "page_id long, url string, html string, fetched string")
    records = warc.responses(pages, F.col("fetched"))
    other = records.withColumn("http_head", F.lit("HTTP/1.0 203 Other\r\nserver: x\r\ncontent-type:  text/html\r\n\r\n"))
    for made, kind in ((records, "text/html; charset=utf-8"), (other, "text/html")):
        rows = warc.derived(made).collect()
        assert {r.source_content_type for r in rows} == {kind} and {r.record_date for r in rows} == {"2020-02-02T00:00:00Z"}
        assert {r.source_http_head for r in rows} == {made.first().http_head}
        block = next(r.block for r in rows if r.record_type == "metadata")
        want = re.sub(r"\s+", " ", html.unescape(re.search(r"(?is)<title[^>]*>([^<]*)", text)[1])).strip()
        assert block == f"title: {want}\r\nlanguage: \r\n"


def test_tags_end_where_their_values_do(spark):
    texts = {
        "<p title='x>y'>T": "T",
        """<a href = "/?a>b" class=k>A</a> <i data-x=it's>B</i> don't""": "A B don't",
        '<img alt="never closed>C': "C",
        "a < b > c <d": "a < b > c",
        "<div =\"=>\">D</div>": "D",
        "x" * 3_000_000 + "<p q='>'>" * 20_000 + "<" * 100_000 + "y='" * 50_000: "x" * 3_000_000 + "\n" + "<" * 99_999,
    }
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").withColumn("url", F.lit("u"))
    got = warc.derived(warc.responses(pages)).where("record_type = 'conversion'").orderBy("page_id").collect()
    assert [r.block for r in got] == list(texts.values())


def test_attributes_in_all_spellings(spark):
    text = """<html class=k lang='de'><a href='/1'>x</a><a class="k" href=/2?a=1&amp;b=2>y</a><A HREF = "/3&copy;">z</A><a data-href="/no">"""
    pages = spark.createDataFrame([(1, "u", text)], "page_id long, url string, html string")
    block = warc.derived(warc.responses(pages)).where("record_type = 'metadata'").first().block
    links = "".join(f"outlink: {link} L a/@href\r\n" for link in ("/1", "/2?a=1&b=2", "/3©"))
    assert block == f"title: \r\nlanguage: de\r\n{links}"


def test_records_can_be_read_back(spark):
    rows = {r.record_id: r for r in _derived(spark).collect()}
    for r in warc.serialised(_derived(spark)).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        want = rows[fields["WARC-Record-ID"]]
        assert first == "WARC/1.1" and fields["WARC-Refers-To"] == want.refers_to and fields["WARC-Type"] == want.record_type
        assert rest == want.block.encode() + b"\r\n\r\n" and int(fields["Content-Length"]) == len(rest) - 4
        assert fields["WARC-Source-Payload-Digest"] == want.source_payload_digest
        assert ("WARC-Target-URI" in fields) == (want.target_uri is not None) and "X" not in fields


def test_no_pages(spark):
    assert warc.derived(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


# ---- op7

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base_by_hand(text):
    out = []
    for kind, pattern in enumerate(BASE.values()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isascii() and c.isdigit()]
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2:
                doubled = [d if i % 2 == 0 else 2 * d // 10 + 2 * d % 10 for i, d in enumerate(digits[::-1])]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    draw = random.Random(2)
    bits = ["a", "b.", "@", "@", ".", "1", "23", "192.", ".168", "0.", "1.1", " ", "-", "+", "+1 (", "4111111111111111"]
    bits += ["5500 0000 0000 0004", "é", "\n", "%", "x@y.z", "٣"]
    for _ in range(8000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 25)))
        assert pii.base_spans(text) == _base_by_hand(text), text


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a@", "+1", "1 ", "a."])
def test_long_texts_take_linear_time(unit):
    start = time.perf_counter()
    pii.base_spans(unit * 200_000)
    assert time.perf_counter() - start < 15


def _people(spark):
    """One person's surname is near her address in many texts; other words are near it by chance."""
    rows = []
    for i in range(60):
        text = prose(i, 40)
        if i < 8:
            text += f" Write to Zanthe Quill or quill{i % 2}@mail.example {prose(900 + i, 6)} and ask Quill again."
        elif i < 20:
            text += " Zanthe is a common name here."
        rows.append((i, text, "en", "a", len(text)))
    rows.append((100, "no such person", "en", "a", 14))
    return rows, spark.createDataFrame(rows, SCHEMA)


def _terms_by_hand(rows, doubt=1.0, generalise=0.5, remove=0.8):
    """Flagged terms per row number, from counts over all pairs of rows and entities."""
    words = [set(re.split(pii.NO_WORD, (text or "").lower())) - {""} for _, text, *_ in rows]
    near = [defaultdict(set) for _ in rows]
    for at, (_, text, *_) in enumerate(rows):
        for start, kind, end in pii.base_spans(text or ""):
            around = pii.surroundings(text, start, end).lower()
            near[at][pii.entity(kind, text[start:end])] |= set(re.split(pii.NO_WORD, around)) - {""}
    out, n = [{} for _ in rows], len(rows)
    for e in {e for own in near for e in own}:
        having = [at for at, own in enumerate(near) if e in own]
        whole = np.log2(n / len(having))
        for t in {t for at in having for t in near[at][e]}:
            beside = [at for at in having if t in near[at][e]]
            c_t, d = sum(t in w for w in words), len({rows[at][1] for at in beside})
            share = np.log2(n * len(beside) / (len(having) * c_t)) / whole * d / (d + doubt) if whole > 0 else 0
            if share >= generalise:
                for at in having:
                    if t in words[at]:
                        out[at][t] = max(share, out[at].get(t, 0))
    return [{t: 5 if share >= remove else 4 for t, share in terms.items()} for terms in out]


def _spans_by_hand(rows):
    out = []
    for (_, text, *_), kinds in zip(rows, _terms_by_hand(rows), strict=True):
        spans = pii.base_spans(text or "")
        taken = [(a, b) for a, _, b in spans]
        for m in re.finditer(pii.NO_WORD.replace("[", "[^", 1), text or ""):
            kind = kinds.get(m.group().lower())
            if kind and not any(a < m.end() and m.start() < b for a, b in taken):
                spans.append((m.start(), kind, m.end()))
        out.append(pii.spelled(sorted(spans)))
    return out


def test_terms_that_reveal_an_entity_are_found(spark):
    rows, docs = _people(spark)
    want = _spans_by_hand(rows)
    assert all("generalised" in line or "removed" in line for line in want[:8])
    got = {r.doc_id: r.spans for r in pii.spans(docs)[0].collect()}
    assert [got[i] for i, *_ in rows] == want
    clean = {r.doc_id: r.text for r in pii.cleaned(docs).collect()}
    assert "uill" not in clean[0] and "[EMAIL]" in clean[0] and clean[30] == rows[30][1] and clean[100] == rows[-1][1]


def _directory(spark):
    """Pages with null and repeated ids, copies, one address on many pages, and a page with many addresses."""
    rows = [(None if i % 3 else 7, f"{prose(i, 30)} Quill quill@mail.example office{i % 5} {prose(50 + i, 9)}", "en", "a", 1) for i in range(12)]
    rows += rows[:3] + [(20 + i, f"{prose(80 + i, 20)} Zed{i} zed{i}@mail.example", "en", "a", 1) for i in range(25)]
    rows += [(60, " ".join(f"Zed{i} zed{i}@mail.example" for i in range(25)) + " office1", "en", "a", 1)]
    rows += [(61, " ".join(f"Zed{i}" for i in range(25)) + " Quill nobody here", "en", "a", 1), (None, None, None, None, None)]
    rows += [(100 + i, prose(200 + i, 30), "en", "a", 1) for i in range(40)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_terms_of_rows_with_null_and_repeated_ids(spark):
    rows, docs = _directory(spark)
    want = Counter((i, line) for (i, *_), line in zip(rows, _spans_by_hand(rows), strict=True))
    assert sum("generalised" in line or "removed" in line for i, line in want.elements() if i is None) >= 8
    assert Counter((r.doc_id, r.spans) for r in pii.spans(docs)[0].collect()) == want


@pytest.mark.parametrize("few", [0, 1, 1000])
def test_texts_with_few_and_many_entities_meet_the_same_terms(spark, few):
    _, docs = _directory(spark)
    found = pii.detected(docs)
    rich, terms = found.where("text IS NOT NULL"), pii.disclosing(docs, found)

    def rows(df):
        return {(bytes(r.of), t.term, round(t.share, 9)) for r in df.collect() for t in r.terms}

    assert rows(pii.flagged(rich, terms, few)) == rows(pii.flagged(rich, terms)) != set()


def test_pages_with_one_address_cost_what_they_hold(spark):
    """Each page has terms of its own beside a common address: pairs grow with the pages, not with their square."""
    made = {}
    for pages in (50, 200):
        rows = [(i, " ".join(f"w{i}x{j}" for j in range(8)) + f" help@mail.example {prose(i, 5)}", "en", "a", 1) for i in range(pages)]
        rows += [(1000 + i, prose(300 + i, 5), "en", "a", 1) for i in range(3 * pages)]
        docs = spark.createDataFrame(rows, SCHEMA)
        found = pii.detected(docs)
        got = pii.flagged(found.where("text IS NOT NULL"), pii.disclosing(docs, found, 0.0, 0.0))
        made[pages] = got.agg(F.sum(F.size("terms"))).first()[0]
        assert got.agg(F.max(F.size("terms"))).first()[0] <= 8 + 5 + 3
    assert made[200] <= 5 * made[50]


def test_copies_are_no_evidence(spark):
    """Fifty copies of a text say no more than one: Quill stands elsewhere too, and a second text would tell."""
    text = "Ask Quill at quill@mail.example today"
    rows = [(i, text, "en", "a", 1) for i in range(50)] + [(i, "Ask Quill at noon today", "en", "a", 1) for i in range(50, 52)]
    rows += [(i, "x", "en", "a", 1) for i in range(60, 199)]
    assert pii.spans(spark.createDataFrame(rows, SCHEMA))[0].where("spans LIKE '%generalised%' OR spans LIKE '%removed%'").count() == 0
    rows[0] = (0, text + "!", "en", "a", 1)
    assert pii.spans(spark.createDataFrame(rows, SCHEMA))[0].where("spans LIKE '%generalised%'").count() == 50


def test_a_single_text_discloses_what_stands_nowhere_else(spark):
    rows = [(0, "Mind Quill quill@mail.example today", "en", "a", 1)] + [(i, "never mind today", "en", "a", 1) for i in range(1, 40)]
    got = {r.doc_id: r.spans for r in pii.spans(spark.createDataFrame(rows, SCHEMA))[0].collect()}
    assert got[0] == "generalised:5:10,email:11:29" and not any(got[i] for i in range(1, 40))


def test_one_passage_on_different_pages_is_evidence(spark):
    """The same words stand around the address on pages that are otherwise different, and twice with one id."""
    passage = "one two three four five six seven Quill quill@mail.example nine ten eleven twelve more words stand here"
    rows = [(i // 2, f"{prose(i, 12)} {passage} {prose(100 + i, 12)}", "en", "a", 1) for i in range(20)]
    rows += [(100 + i, prose(200 + i, 30), "en", "a", 1) for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.spans(spark.createDataFrame(rows, SCHEMA))[0].collect()}
    assert all("removed" in got[i] for i in range(10)) and not any(got[100 + i] for i in range(60))


def test_two_texts_can_disclose(spark):
    rows = [(i, f"{prose(i, 12)} Quill quill@mail.example {prose(100 + i, 12)}", "en", "a", 1) for i in range(2)]
    rows += [(10 + i, prose(200 + i, 30), "en", "a", 1) for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.spans(spark.createDataFrame(rows, SCHEMA))[0].collect()}
    for i in range(2):
        at = rows[i][1].index("Quill")
        assert f"generalised:{at}:{at + 5}" in got[i]


def test_personal_data_of_awkward_rows(awkward, empty, awkward_rows, spark):
    more = awkward.limit(3).withColumn("text", F.concat(F.lit("+1 (377) 555-0271 a@b.c 4111111111111111 x 1.2.3.4 "), F.col("text")))
    docs = awkward.unionByName(more)
    got = pii.spans(docs)[0].agg(F.count("*"), *[F.sum(f"n_{k}") for k in BASE]).first()
    assert tuple(got) == (len(awkward_rows) + 3, 3, 3, 3, 3)
    out = pii.cleaned(docs)
    assert out.columns == docs.columns and out.count() == len(awkward_rows) + 3
    # The x stands nowhere without the addresses, so it discloses all of them.
    assert out.where("text LIKE '[PHONE] [EMAIL] [CARD] [TERM] [IP] %' AND n_chars = length(text)").count() == 3
    assert pii.spans(empty)[0].count() == 0 and pii.cleaned(empty).count() == 0


# ---- op8


def test_quality_on_labels_that_were_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.judged(docs, train).join(held.select("doc_id", "quality"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")))
    kept = dict(tuple(r) for r in got.collect())
    assert kept[1] > 0.99 and kept[0] < 0.05


@pytest.mark.parametrize("ridge", [1e-6, 0.1, 1.0])
@pytest.mark.parametrize("gap", [0.0, 3.0, 1000.0])
def test_the_fit_settles_whether_labels_overlap_or_not(ridge, gap):
    draw = np.random.default_rng(1)
    y = (np.arange(400) % 8 > 0).astype(float)
    x = draw.standard_normal((400, 15)) * 10.0 ** -np.arange(15) + gap * y[:, None] * 10.0 ** -np.arange(15)
    model = quality.fitted(x, y, ridge)
    p = model.probability(x)
    assert np.isfinite(model.weights).all() and p[y == 1].mean() > p[y == 0].mean()
    assert gap == 0 or ((p > 0.5) == y).mean() > 0.98


def _whole(rows):
    return rows


def _a_third_is_one_text(rows):
    """As in a crawl with one page under thousands of addresses."""
    good = next(text for quality_, text in rows if quality_ and text)
    return rows + [(1, good)] * (len(rows) // 2)


def _short(rows):
    return [(quality_, " ".join(text.split(" ")[:400])) for quality_, text in rows]


@pytest.mark.parametrize("made", [_whole, _a_third_is_one_text, _short])
def test_good_documents_are_kept_on_tables_of_all_kinds(made):
    """The fit alone, on half of the labelled rows, judged on the half it has not seen."""
    folder = "/root/testdata/sf0.1"
    docs = ds.dataset(f"{folder}/documents.parquet").to_table(columns=["doc_id", "text"])
    labels = dict(zip(*(ds.dataset(f"{folder}/labels.parquet").to_table().column(c).to_pylist() for c in ("doc_id", "quality")), strict=True))
    known = made([(labels[i], t or "") for i, t in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "text")), strict=True) if i in labels])
    x, y = np.array([quality.features(t) for _, t in known]), np.array([float(q) for q, _ in known])
    p = quality.fitted(x[::2], y[::2]).probability(x[1::2])
    assert (p[y[1::2] == 1] >= quality.REJECT).mean() > 0.995 and (p[y[1::2] == 0] < quality.REJECT).mean() > 0.97


def test_sites_are_shrunk_toward_what_stands_above(spark):
    rows = [("big", "x", 0.9)] * 400 + [("big", "y", 0.1)] * 100 + [("bad", "x", 0.1)] * 300 + [("tiny", "x", 0.1)]
    scored = spark.createDataFrame(rows, "host string, path string, p double")
    paths, share, strength = quality.sites(scored)
    host = {r.host: r.host_share for r in paths.collect()}
    assert share == pytest.approx(sum(p for *_, p in rows) / len(rows)) and strength >= 1
    assert abs(host["bad"] - 0.1) < 0.05 and abs(host["tiny"] - share) < abs(host["tiny"] - 0.1)


def test_verdicts_are_those_of_the_formula(spark):
    """Sums, strengths, shares and posteriors of every row again in plain Python, with columns named by the caller."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnsRenamed({"source": "site", "lang": "folder"})
    docs = docs.withColumn("folder", F.when(F.col("doc_id") % 7 > 0, F.concat("folder", F.col("doc_id") % 3)))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.judged(docs, labels, host="site", path="folder").collect()
    model = quality.trained(quality.measured(docs, "site", "folder"), labels)
    rows = [(r.doc_id, r.site, r.folder, quality.features(r.text or "")) for r in docs.collect()]
    p = {i: float(v) for (i, *_), v in zip(rows, model.probability(np.array([x for *_, x in rows])), strict=True)}

    def strength(groups):
        """(values, mean above) per group: the prior rows of a Beta with the variance beyond the sampling noise."""
        n = sum(len(v) for v, _ in groups)
        mean = sum(len(v) * m for v, m in groups) / n
        seen = sum(len(v) * (sum(v) / len(v) - m) ** 2 for v, m in groups) / n
        noise = sum(x * (1 - x) for v, _ in groups for x in v) / n / max(n / len(groups), 1)
        return max(mean * (1 - mean) / max(seen - noise, 1e-6) - 1, 1)

    hosts, paths = defaultdict(list), defaultdict(list)
    for i, host, path, _ in rows:
        hosts[host].append(p[i])
        paths[host, path].append(p[i])
    share = sum(p.values()) / len(rows)
    weight = strength([(v, share) for v in hosts.values()])
    above = {h: (sum(v) + weight * share) / (len(v) + weight) for h, v in hosts.items()}
    weight = strength([(v, above[h]) for (h, _), v in paths.items()])

    def logit(x):
        return np.log(min(max(x, quality._EPS), 1 - quality._EPS) / (1 - min(max(x, quality._EPS), 1 - quality._EPS)))

    assert len(got) == len(rows) and len(paths) > len(hosts) > 1 and any(path is None for _, path in paths)
    for r in got:
        own = paths[r.host, r.path]
        site = (sum(own) - p[r.doc_id] + weight * above[r.host]) / (len(own) - 1 + weight)
        posterior = 1 / (1 + np.exp(-(logit(p[r.doc_id]) + logit(site) - logit(share))))
        assert r.p == pytest.approx(p[r.doc_id], abs=1e-9) and r.site_share == pytest.approx(site, abs=1e-6)
        assert r.posterior == pytest.approx(posterior, abs=1e-6) and r.kept == (r.posterior >= quality.REJECT)


def test_rows_with_one_id_are_rejected_one_by_one(spark):
    """Good and bad texts under one id, under none, and the same text on two paths."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.where("doc_id % 3 = 0")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).when(F.col("doc_id") % 3 == 1, F.lit(1)))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source"))).withColumn("row_digest", F.lit("own"))
    verdicts = quality.judged(docs, labels).groupBy("doc_id").agg(F.sum(F.col("kept").cast("int")), F.count("*")).collect()
    kept = {tuple(r) for r in quality.accepted(docs, labels).groupBy("doc_id").count().collect()}
    assert kept == {(i, n) for i, n, _ in verdicts if n}
    assert all(0 < n < rows for i, n, rows in verdicts if i in (None, 1))


def test_quality_of_awkward_rows(awkward, empty, awkward_rows, spark):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (4, 0, 0), (10, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(awkward, labels)
    assert got.count() == len(awkward_rows) and got.where("posterior BETWEEN 0 AND 1 AND kept IS NOT NULL").count() == len(awkward_rows)
    none = quality.judged(awkward, labels.where("quality = 1"))
    assert none.where("kept").count() == len(awkward_rows)
    assert quality.judged(empty, labels).count() == 0
    assert quality.accepted(awkward, labels).columns == awkward.columns


# ---- op10

MIT = "\n".join(f"  {line}" for line in (" ".join(licences.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is"))).split(", "))


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Some text without a stop\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Released under the MIT Licence.", "MIT"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("LICENSED UNDER THE APACHE LICENSE,\n  VERSION 2.0. And more.", "Apache-2.0"),
        (" ".join(licences.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is")), "MIT"),
        (" ".join(licences.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")), "BSD-3-Clause"),
        (" ".join(licences.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")), "BSD-2-Clause"),
        (licences.SENTENCES["gnu-free"] + "\n" + licences.SENTENCES["gpl-3-later"], "GPL-3.0-or-later"),
        ("Released under the MIT License. Licensed under the Apache License 2.0.", "Apache-2.0,MIT"),
        ("He was licensed under the old act.", ""),
        ("The MIT License is a licence.", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_licences(spark, text, found):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = licences.scan(docs).first()
    assert sorted(row.licences.split(",")) == sorted(found.split(",")) and row.n_unmatched == 0


COMMENTED = """# Copyright (c) 2020 X
#
# Permission is hereby granted, free of charge, to any person
# obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
# without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
# sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
# subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in all copies or substantial portions
# of the Software."""


@pytest.mark.parametrize(
    ("text", "found"),
    [
        *[(f"SPDX-License-Identifier: {name}", name) for name in licences.NAMED],
        ("// SPDX-License-Identifier: MIT\nint main() {}", "MIT"),
        ("/* Copyright X SPDX-License-Identifier: Apache-2.0 */ int x", "Apache-2.0"),
        ("# SPDX-License-Identifier: MIT OR Apache-2.0", ""),
        (COMMENTED, "MIT"),
        (COMMENTED.replace("#\n", "").replace("# ", ""), "MIT"),
        ("no full stop here\nReleased under\nthe MIT License\nand more", "MIT"),
    ],
)
def test_tags_and_wrapped_headers(spark, text, found):
    row = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.licences, row.n_unmatched) == (found, 0)


def test_unknown_notices_are_counted(spark):
    text = licences.SENTENCES["bsd-source"] + " " + licences.SENTENCES["mit-notice"]
    row = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.licences, row.n_unmatched) == ("", 2)


def test_every_known_sentence_has_a_marker():
    texts = [*licences.SENTENCES.values(), *[f"{o} {t}" for o in licences.OPENINGS for ts in licences.NAMED.values() for t in ts]]
    parts = [p for t in texts for p in re.split(r"(?<=[.!?:;])\s+", t)]
    assert [p for p in parts if not re.search(licences.MARKERS, p)] == []


NOTICES = [
    (
        "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not\n"
        " * distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
        "MPL-2.0",
    ),
    (
        "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, "
        "provided that the above\n# copyright notice and this permission notice appear in all copies.\n#\n"
        '# THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\n'
        "# REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\n# AND FITNESS.",
        "ISC",
    ),
    (
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, "
        "compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, "
        "commercial or non-commercial, and by any\nmeans.",
        "Unlicense",
    ),
    (
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
        "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
        "LGPL-2.1-or-later",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "AGPL-3.0-or-later",
    ),
    (
        "This software is provided 'as-is', without any express or implied\nwarranty.\n\nPermission is granted to anyone to use this "
        "software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the "
        "following restrictions:",
        "Zlib",
    ),
    ("// Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("// SPDX-License-Identifier: GPL-2.0-only\nint main;", "GPL-2.0-only"),
    ("# SPDX-License-Identifier: ISC", "ISC"),
    ("SPDX-License-Identifier: GPL-2.0+", "GPL-2.0+"),
    ("Permission to use the software is a matter of licence.", ""),
]


def test_standard_notices(spark):
    """Headers as they stand in files, wrapped and behind comment signs, with answers by hand."""
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.n_unmatched) for r in licences.scan(docs).collect()}
    assert got == {i: (found, 0) for i, (_, found) in enumerate(NOTICES)}


def test_all_identifiers(spark):
    names = [*licences.NAMED, *licences.IDENTIFIERS]
    assert len(names) == len(set(names))
    docs = spark.createDataFrame([(i, f"SPDX-License-Identifier: {name}") for i, name in enumerate(names)], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licences.scan(docs).collect()} == dict(enumerate(names))


def test_every_known_sentence_has_a_rule():
    used = {key for _, ids in licences.RULES for key in ids}
    assert set(licences.SENTENCES) <= used


def test_licences_of_awkward_rows(awkward, empty, awkward_rows):
    assert licences.scan(awkward).where("licences = ''").count() == len(awkward_rows)
    assert licences.scan(empty).count() == 0


# ---- pipeline


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), {}
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, TINY)
        kept[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = kept["quality"]
    verdict = quality.judged(spark.read.parquet(f"{TINY}/documents.parquet"), spark.read.parquet(f"{TINY}/labels.parquet"))
    assert {r.doc_id for r in after} == {r.doc_id for r in verdict.where("kept").collect()} and 0 < len(after) < len(before)
    before, after = kept["exact_dedup"]
    assert {r.doc_id for r in after} == {max(r.doc_id for r in before if r.text == t) for t in {r.text for r in before}}
    before, after = kept["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before]
    assert {r.doc_id for r in after} == {r[0] for r in _near_by_hand(rows, 5, 80, 100) if r[3]}
    before, after = kept["pii"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    new = {r.doc_id: r.text for r in after}
    for r in before:
        assert not pii.base_spans(new[r.doc_id])
        if not _base_by_hand(r.text):
            assert new[r.doc_id] == r.text
    before, after = kept["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r.length for r in after) == tokens


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
