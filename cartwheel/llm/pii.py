"""Personal data, and the terms of the corpus that give it away.

Patterns find the protected entities: mail and IP addresses, card and phone
numbers. Then the corpus says which words near an entity reveal it. With ``N``
documents, the information of entity ``e`` is ``IC = log2(N / c(e))``; a term ``t`` of its
surroundings discloses ``PMI = log2(N c(e, t) / (c(e) c(t)))`` of it. In documents that
hold the entity, a term is generalised when it discloses at least the share
``generalise`` of the information, and removed from the share ``remove`` on. All
counts are of documents, copies included: ``c(t)`` of those with the term, ``c(e, t)``
of those with the term next to the entity. Every pair is judged; its share is shrunk
by ``d / (d + doubt)``, where ``d`` is the number of different texts behind ``c(e, t)``:
copies of one text add no evidence, one passage on different pages does. With the
default ``doubt`` a single text flags the terms that occur nowhere without the entity;
all other terms need more. Documents without entities are left alone.

A flagged term is looked for in the whole text of each document with the entity. For
that, the words of a text meet the flagged pairs by (entity, term); a text with more
than ``FEW`` entities asks by its words first and by its entities then, so that no
text is multiplied with itself and none with the terms of other documents.

The texts are read twice: once for entities, once to count words where they
are stored. Only texts with an entity are written and joined.

Null text counts as empty and has no spans. Terms belong to the text of a row, so null
and repeated ids change nothing and equal texts get equal spans; an empty table gives
no rows. Other columns, whatever their names, are kept aside as one struct. All
patterns run in linear time on long texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cartwheel.llm.rows import slim, texts
from cartwheel.session import written

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
N_BASE = 4
NEAR_WORDS = 8
NEAR_CHARS = 200
DOUBT = 1.0
#: Texts with more entities than this meet the flagged pairs by their words alone at first.
FEW = 16
GENERALISE = 0.5
REMOVE = 0.8
#: Everything but ASCII white space, signs and controls belongs to a word.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits: the one before took it to its end.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

Span = tuple[int, int, int]  # start, number of the kind, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the @ signs: a run before each is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done:
            # In steps, since a run is mostly short and a text may be long.
            low = max(done, start - 64)
            run = len(_LOCAL.search(text[low:start]).group())
            start -= run
            if run < 64:
                break
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for turn, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + turn % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by start and kind."""
    spans: list[Span] = []
    if "@" in text:
        spans += [(start, 0, end) for start, end in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m.group().split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def entity(kind: int, text: str) -> str:
    """One spelling for all ways to write the same entity."""
    return f"{KINDS[kind]} {_digits(text) if kind >= 2 else text.lower()}"


def surroundings(text: str, start: int, end: int, words: int = NEAR_WORDS, chars: int = NEAR_CHARS) -> str:
    """The words next to a span; a word longer than ``chars`` is no term."""
    before = text[max(0, start - chars) : start].split()[-words:]
    after = text[end : end + chars].split()[:words]
    return " ".join([*before, *after])


_FOUND = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, text string, "
    "text_digest binary, near array<struct<entity: string, words: string>>"
)
_FOUND_TYPE = pa.schema(
    [
        ("doc_id", pa.int64()),
        *[(f"n_{kind}", pa.int64()) for kind in KINDS[:N_BASE]],
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
        ("text", pa.string()),
        ("text_digest", pa.binary()),
        ("near", pa.list_(pa.struct([("entity", pa.string()), ("words", pa.string())]))),
    ]
)


def detected(docs: DataFrame) -> DataFrame:
    """Base spans of every row; its text, the whole row and what stands near only where there are some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, where = [], []
            for at, (doc_id, text) in enumerate(texts(batch)):
                spans = base_spans(text)
                line = spelled(spans)
                row = {"doc_id": doc_id, "spans": line, "base_sha256": hashlib.sha256(line.encode()).hexdigest()}
                for number, kind in enumerate(KINDS[:N_BASE]):
                    row[f"n_{kind}"] = sum(span[1] == number for span in spans)
                if spans:
                    row["text"] = text
                    row["text_digest"] = hashlib.blake2b(text.encode(), digest_size=16).digest()
                    near: dict[str, list[str]] = {}
                    for start, kind, end in spans:
                        near.setdefault(entity(kind, text[start:end]), []).append(surroundings(text, start, end))
                    # One entry for each entity of the row, so that counts of entries are counts of documents.
                    row["near"] = [{"entity": e, "words": " ".join(words)} for e, words in near.items()]
                where.append(at if spans else None)
                out.append(row)
            found = pa.RecordBatch.from_pylist(out, _FOUND_TYPE)
            whole = batch.column(2).take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, whole], [*_FOUND_TYPE.names, "whole"])

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), whole)
    return rows.mapInArrow(run, _schema(rows.schema["whole"].dataType))


def _schema(whole: StructType) -> StructType:
    fixed = StructType.fromDDL(_FOUND)
    return StructType([*fixed.fields, StructField("whole", whole)])


def _terms(text):
    return F.array_remove(F.array_distinct(F.split(F.lower(text), NO_WORD)), "")


def disclosing(
    docs: DataFrame,
    found: DataFrame,
    doubt: float = DOUBT,
    generalise: float = GENERALISE,
) -> DataFrame:
    """(entity, term, share): terms that disclose at least ``generalise`` of an entity's information."""
    near = found.select("text_digest", F.explode("near").alias("at"))
    # Equal texts have equal words near an entity.
    by_text = written(
        near.groupBy("at.entity", "text_digest").agg(F.count("*").alias("copies"), F.min("at.words").alias("words")),
        "entity-texts",
    )
    of_entity = by_text.groupBy("entity").agg(F.sum("copies").alias("c_e"))
    pairs = (
        by_text.select("entity", "copies", F.explode(_terms(F.col("words"))).alias("term"))
        .groupBy("entity", "term")
        .agg(F.sum("copies").alias("c_et"), F.count("*").alias("d_et"))
    )
    pairs = written(pairs.join(of_entity, "entity"), "entity-terms")
    # Words are added up where they are read; only then the counts meet the few terms asked for.
    counts = (
        slim(docs)
        .select(F.explode(_terms(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("c_t"))
    )
    all_docs = F.lit(found.count())
    information = F.log2(all_docs / F.col("c_e"))
    told = F.log2(all_docs * F.col("c_et") / (F.col("c_e") * F.col("c_t")))
    share = F.when(information > 0, told / information * F.col("d_et") / (F.col("d_et") + doubt))
    return (
        pairs.join(counts, "term").select("entity", "term", share.alias("share")).where(F.col("share") >= generalise)
    )


def flagged(rich: DataFrame, terms: DataFrame, few: int = FEW) -> DataFrame:
    """text_digest and its terms (with the greatest share): those its entities flag and that it holds."""
    held = rich.select(
        "text_digest", F.array_distinct("near.entity").alias("entities"), _terms(F.col("text")).alias("words")
    )
    by_pair = (
        held.where(F.size("entities") <= few)
        .select("text_digest", "words", F.explode("entities").alias("entity"))
        .select("text_digest", "entity", F.explode("words").alias("term"))
        .join(terms, ["entity", "term"])
    )
    many = held.where(F.size("entities") > few)
    by_word = (
        many.select("text_digest", F.explode("words").alias("term"))
        .distinct()
        .join(terms, "term")
        .join(many.select("text_digest", F.explode("entities").alias("entity")).distinct(), ["text_digest", "entity"])
    )
    columns = ["text_digest", "term", "share"]
    return (
        by_pair.select(columns)
        .unionByName(by_word.select(columns))
        .groupBy("text_digest", "term")
        .agg(F.max("share").alias("share"))
        .groupBy(F.col("text_digest").alias("of"))
        .agg(F.collect_list(F.struct("term", "share")).alias("terms"))
    )


def _with_terms(rich: DataFrame, remove: float) -> DataFrame:
    """Adds the spans of each row's terms, wherever they stand in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            columns = (batch.column(name).to_pylist() for name in ("spans", "text", "terms"))
            for line, text, terms in zip(*columns, strict=True):
                kinds = {term["term"]: 5 if term["share"] >= remove else 4 for term in terms or ()}
                lines.append(_with_words(line, text, kinds) if kinds else line)
            at = batch.schema.get_field_index("spans")
            kept = [name for name in batch.schema.names if name != "terms"]
            yield batch.set_column(at, "spans", pa.array(lines, pa.string())).select(kept)

    return rich.mapInArrow(run, rich.drop("terms").schema)


def _with_words(line: str, text: str, kinds: dict[str, int]) -> str:
    spans = [(start, KINDS.index(kind), end) for start, end, kind in parsed(line)]
    taken = [(start, end) for start, _, end in spans]
    for m in _WORD.finditer(text):
        kind = kinds.get(m.group().lower())
        if kind and not any(start < m.end() and m.start() < end for start, end in taken):
            spans.append((m.start(), kind, m.end()))
    return spelled(sorted(spans))


def parsed(line: str) -> list[tuple[int, int, str]]:
    parts = [part.split(":") for part in line.split(",") if part]
    return sorted((int(start), int(end), kind) for kind, start, end in parts)


def spans(
    docs: DataFrame, doubt: float = DOUBT, generalise: float = GENERALISE, remove: float = REMOVE
) -> tuple[DataFrame, DataFrame]:
    """All rows (digest columns and spans), and those with entities with their texts."""
    found = written(detected(docs), "pii-found")
    rich = found.where(F.col("text").isNotNull())
    # Written, so that the joins with it are planned by its size.
    terms = written(disclosing(docs, found, doubt, generalise), "pii-terms")
    of_text = flagged(rich, terms)
    rich = rich.join(of_text, F.col("text_digest") == F.col("of"), "left").drop("of")
    rich = _with_terms(rich, remove)
    columns = ["doc_id", *[f"n_{kind}" for kind in KINDS[:N_BASE]], "base_sha256", "spans"]
    plain = found.where(F.col("text").isNull())
    return plain.select(columns).unionByName(rich.select(columns)), rich


def cleaned_text(text: str, line: str) -> str:
    """The text with placeholders for entities and general terms; removed terms leave nothing."""
    out, done = [], 0
    for start, end, kind in parsed(line):
        if end <= done:
            continue
        out.append(text[done : max(start, done)])
        if kind == "generalised":
            out.append("[NUMBER]" if text[start:end].isdigit() else "[TERM]")
        elif kind != "removed":
            out.append(f"[{kind.upper()}]")
        done = end
    return "".join([*out, text[done:]])


def cleaned(
    docs: DataFrame, doubt: float = DOUBT, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """The documents with entities and disclosing terms replaced, all columns kept, ``n_chars`` made right.

    Rows without entities go through as they are; only the others are written.
    """
    names, schema = docs.columns, docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            values = [text.as_py() for text in batch.column(at)]
            yield batch.filter(pa.array([not base_spans(text or "") for text in values], pa.bool_()))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield batch.set_column(0, "text", pa.array([cleaned_text(text, line) for text, line in pairs], pa.string()))

    rich = spans(docs, doubt, generalise, remove)[1].select("text", "spans", "whole")
    rich = rich.mapInArrow(apply, rich.schema)
    columns = [F.col(f"whole.`{name}`").alias(name) for name in names]
    replaced = {"text": F.col("text").cast(schema["text"].dataType).alias("text")}
    if "n_chars" in names:
        replaced["n_chars"] = F.length("text").cast(schema["n_chars"].dataType).alias("n_chars")
    rich = rich.select(*[replaced.get(name, column) for name, column in zip(names, columns, strict=True)])
    return docs.mapInArrow(clean, schema).unionByName(rich)
