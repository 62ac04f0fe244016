"""WARC derivatives of web pages.

Every page is a response record. From each response two records are derived: a
metadata record (title, language, links) and a conversion record with the plain
text. Both refer to the response by its id, and keep its target, date, content
type and payload digest next to the digest of their own block.

Ids are name-based: the same page gives the same ids, whoever builds them. Pages
whose rows are equal have equal records. A null url is left out of the header, a
null page counts as an empty one; an empty page has an empty text. A ">" inside a
quoted value does not end its tag; tags that are never closed end with the page,
so the text of a very long page takes linear time. Other columns of the
pages are not read, whatever their names. An empty table gives no records.
"""

from __future__ import annotations

from functools import lru_cache
from html import unescape
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
HTTP_TYPE = "application/http;msgtype=response"
SOURCE_TYPE = "text/html; charset=utf-8"
#: Tags that end a line of text.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z))"
#: Up to the end of a tag: values in quotes may hold ">"; the marks "+" give nothing back.
REST = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+){0,50}+>"""
ANY = rf"(?:{REST}|[^>]*(?:>|\z))"
BLOCK_TAG = rf"(?i)</?(?:{BLOCKS})\b{ANY}"
#: A "<" before anything else is text.
TAG = f"<[a-zA-Z/!?]{ANY}"
#: White space that is not a single space.
WIDE = "[ \t\f\r]{2,}|[\t\f\r]"
#: References as html.unescape knows them: codes, and names with or without the semicolon.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{0,31};?)"
NO_BREAK = {"nbsp;": " ", "nbsp": " "}
TITLE = rf"(?is)<title\b{ANY}([^<]*)"
HREF = r"""(?i)<a\b[^>]*?[\s"'/]href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
LANG = r"""(?i)<html\b[^>]*?[\s"'/]lang\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
CONTENT_TYPE = r"(?i)\r\nContent-Type:[ \t]*([^\r\n]*)"
CRLF = "\r\n"


def _without_marks(text: Column) -> Column:
    """Without the two characters that mark references."""
    return F.replace(F.replace(text, F.lit("\x01"), F.lit("")), F.lit("\x02"), F.lit(""))


def plain_text(html: Column) -> Column:
    """Visible text: one line for each block, single spaces, entities resolved once."""
    bare = F.regexp_replace(_without_marks(html), HIDDEN, " ")
    bare = F.regexp_replace(F.regexp_replace(bare, BLOCK_TAG, "\n"), TAG, "")
    bare = F.regexp_replace(_resolved(bare, NO_BREAK), WIDE, " ")
    return F.btrim(F.regexp_replace(bare, " ?\n[ \n]*", "\n"), F.lit(" \n"))


@lru_cache
def _odd_codes() -> dict[str, str]:
    """Codes that stand for another character or for none, by their decimal digits."""
    codes = [*range(32), *range(127, 160), *range(0xFDD0, 0xFDF0)]
    codes += [plane << 16 | low for plane in range(17) for low in (0xFFFE, 0xFFFF)]
    found = {code: unescape(f"&#{code};") for code in codes}
    return {str(code): char for code, char in found.items() if char != chr(code)}


def _table(pairs: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\x04".join(f"{k}\x03{v}" for k, v in pairs.items())), F.lit("\x04"), F.lit("\x03"))


def _resolved(text: Column, own: dict[str, str]) -> Column:
    """All references in one pass, as html.unescape does; ``own`` goes before its table. \\x01 and \\x02 are dropped.

    A map is searched key by key, so there is one for each initial, and one of
    the names that may go without a semicolon.
    """
    names = html5 | own
    initials = sorted({name[0] for name in names})
    by_initial = F.create_map(
        *[c for i in initials for c in (F.lit(i), _table({n: s for n, s in names.items() if n[0] == i}))]
    )
    open_names = _table({name: sign for name, sign in names.items() if not name.endswith(";")})
    odd = _table(_odd_codes())
    longest = max(len(name) for name in names if not name.endswith(";"))

    def numbered(name: Column) -> Column:
        hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
        digits = F.ltrim(F.rtrim(F.substring(name, F.when(hexadecimal, F.lit(3)).otherwise(F.lit(2)), F.length(name)), F.lit(";")), F.lit("0"))
        # Eight digits are beyond all characters, so longer ones need not be read.
        digits = F.concat(F.lit("0"), F.substring(digits, 1, 8))
        code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        wrong = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(wrong, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(odd, code.cast("string")), char)

    def named(name: Column) -> Column:
        starts = [
            F.concat(F.try_element_at(open_names, F.substring(name, 1, n)), F.substring(name, F.lit(n + 1), F.length(name)))
            for n in range(longest, 1, -1)
        ]
        whole = F.try_element_at(F.try_element_at(by_initial, F.substring(name, 1, 1)), name)
        return F.coalesce(whole, *starts, F.concat(F.lit("&"), name))

    def resolved(part: Column, i: Column) -> Column:
        end = F.locate("\x02", part)
        name = F.substring(part, F.lit(1), end - 1)
        char = F.when(F.startswith(name, F.lit("#")), numbered(name)).otherwise(named(name))
        return F.when(i == 0, part).otherwise(F.concat(char, F.substring(part, end + 1, F.length(part))))

    def whole(t: Column) -> Column:
        return F.when(F.instr(t, "\x01") == 0, t).otherwise(F.array_join(F.transform(F.split(t, "\x01"), resolved), ""))

    marked = F.regexp_replace(_without_marks(text), REFERENCE, "\x01$1\x02")
    # Bound, so that the text is made once and not for each use.
    return F.get(F.transform(F.array(marked), whole), F.lit(0))


def _value(quoted: Column) -> Column:
    """Value of an attribute without its quotes and line ends, references resolved."""
    bare = F.when(quoted.rlike("^[\"']"), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(quoted)
    return F.translate(_resolved(bare, {}), "\r\n", "")


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    pieces = [F.substring(h, 1, 8), F.substring(h, 9, 4)]
    pieces += [F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def responses(pages: DataFrame, date: str | Column = DATE) -> DataFrame:
    """One response record per page, with its payload; ``date`` is one date or a column of ``pages``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    length = F.octet_length("payload").cast("string")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: {SOURCE_TYPE}{CRLF}Content-Length: "), length, F.lit(CRLF * 2))
    return (
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            F.col("url").cast("string").alias("target_uri"),
            html.alias("payload"),
            (date if isinstance(date, Column) else F.lit(date)).alias("record_date"),
        )
        .withColumn("payload_digest", _digest(F.col("payload")))
        .withColumn("record_id", _record_id("response", F.col("page_id"), F.col("target_uri"), F.col("payload_digest")))
        .withColumn("http_head", head)
    )


def _metadata(html: Column) -> Column:
    """Block of the metadata record, in the form of header fields."""
    title = F.trim(F.regexp_replace(_resolved(F.regexp_extract(html, TITLE, 1), NO_BREAK), "[ \t\n\f\r]+", " "))
    language = _value(F.regexp_extract(html, LANG, 1))
    links = F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), _value)
    lines = F.transform(links, lambda link: F.concat(F.lit("outlink: "), link, F.lit(" L a/@href")))
    fields = F.concat(F.array(F.concat(F.lit("title: "), title), F.concat(F.lit("language: "), language)), lines)
    return F.concat(F.array_join(fields, CRLF), F.lit(CRLF))


def derived(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response."""
    kinds = {"metadata": "application/warc-fields", "conversion": "text/plain; charset=utf-8"}
    parts = [
        F.struct(F.lit(kind).alias("record_type"), F.lit(content).alias("content_type"), F.col(f"{kind}_block").alias("block"))
        for kind, content in kinds.items()
    ]
    kept = ["page_id", "record_id", "target_uri", "record_date", "payload_digest", "http_head"]
    blocks = [_metadata(F.col("payload")).alias("metadata_block"), plain_text(F.col("payload")).alias("conversion_block")]
    every = records.select(*kept, *blocks).select(*kept, F.explode(F.array(*parts)).alias("part"))
    record_id = _record_id("derived", F.col("part.record_type"), F.col("record_id"))
    return every.select(
        "page_id",
        F.col("part.record_type").alias("record_type"),
        record_id.alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "record_date",
        F.col("part.content_type").alias("content_type"),
        F.octet_length("part.block").cast("long").alias("content_length"),
        _digest(F.col("part.block")).alias("block_digest"),
        F.col("payload_digest").alias("source_payload_digest"),
        F.regexp_extract("http_head", CONTENT_TYPE, 1).alias("source_content_type"),
        F.col("http_head").alias("source_http_head"),
        F.col("part.block").alias("block"),
    )


def serialised(records: DataFrame) -> DataFrame:
    """page_id, record_type and the bytes of each derived record as it stands in a file."""

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")

    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Refers-To", F.col("refers_to")),
        field("WARC-Target-URI", F.regexp_replace("target_uri", "[\r\n]", "")),
        field("WARC-Date", F.col("record_date")),
        field("WARC-Block-Digest", F.col("block_digest")),
        field("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
        field("WARC-Source-Content-Type", F.col("source_content_type")),
        field("Content-Type", F.col("content_type")),
        field("Content-Length", F.col("content_length").cast("string")),
        F.lit(CRLF),
        F.col("block"),
        F.lit(CRLF * 2),
    )
    return records.select("page_id", "record_type", F.encode(record, "UTF-8").alias("record"))


def _backtracking_free(pattern: str) -> str:
    """The pattern for an engine that never gives anything back, as an SQL string."""
    for mark in "*?}":
        pattern = pattern.replace(f"{mark}+", mark)
    return _sql_text(pattern)


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_map(pairs: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{_sql_text(k)}: {_sql_text(v)}' for k, v in pairs.items())}}}"


def _resolved_sql(text: str, names: str) -> str:
    """References of ``text`` by the map column ``names``."""
    name, rest = "substr(p, 1, instr(p, chr(2)) - 1)", "substr(p, instr(p, chr(2)) + 1)"
    is_hex = f"lower(substr({name}, 2, 1)) = 'x'"
    digits = f"substr(ltrim(rtrim(substr({name}, CASE WHEN {is_hex} THEN 3 ELSE 2 END), ';'), '0'), 1, 8)"
    code = f"CASE WHEN {is_hex} THEN TRY_CAST('0x0' || {digits} AS BIGINT) ELSE TRY_CAST('0' || {digits} AS BIGINT) END"
    right = "CASE WHEN c > 1114111 OR c BETWEEN 55296 AND 57343 THEN 65533 ELSE c END"
    char = f"list_transform([{code}], lambda c: coalesce(odd[c::VARCHAR], chr(({right})::INT)))[1]"
    longest = max(len(n) for n in html5 if not n.endswith(";"))
    starts = ", ".join(f"{names}[substr({name}, 1, {n})] || substr({name}, {n + 1})" for n in range(longest, 1, -1))
    sign = f"CASE WHEN {name} LIKE '#%' THEN {char} ELSE coalesce({names}[{name}], {starts}, '&' || {name}) END"
    piece = f"lambda p, i: CASE WHEN i = 1 THEN p ELSE {sign} || {rest} END"
    bare = f"replace(replace({text}, chr(1), ''), chr(2), '')"
    marked = f"regexp_replace({bare}, '{REFERENCE}', chr(1) || '\\1' || chr(2), 'g')"
    return f"array_to_string(list_transform(string_split({marked}, chr(1)), {piece}), '')"


def derived_sql(date: str = DATE) -> str:
    """The same records in SQL."""

    def uuid(*parts: str) -> str:
        h = f"md5(concat_ws(chr(10), {', '.join(parts)}))"
        cuts = f"substr({h}, 1, 8), substr({h}, 9, 4), '3' || substr({h}, 14, 3), 'a' || substr({h}, 18, 3), substr({h}, 21, 12)"
        return f"'<urn:uuid:' || concat_ws('-', {cuts}) || '>'"

    def value(quoted: str) -> str:
        bare = f"""CASE WHEN {quoted}[1] IN ('"', '''') THEN substr({quoted}, 2, length({quoted}) - 2) ELSE {quoted} END"""
        return f"translate({_resolved_sql(bare, 'names')}, chr(13) || chr(10), '')"

    bare = f"regexp_replace(replace(replace(payload, chr(1), ''), chr(2), ''), '{HIDDEN}', ' ', 'g')"
    bare = f"regexp_replace({bare}, {_backtracking_free(BLOCK_TAG)}, chr(10), 'g')"
    bare = f"regexp_replace({bare}, {_backtracking_free(TAG)}, '', 'g')"
    text = f"regexp_replace({_resolved_sql(bare, 'breaking')}, '[ \\t\\f\\r]+', ' ', 'g')"
    text = f"trim(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
    crlf = "chr(13) || chr(10)"
    title = _resolved_sql(f"regexp_extract(payload, {_backtracking_free(TITLE)}, 1)", "breaking")
    title = f"trim(regexp_replace({title}, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ')"
    links = f"regexp_extract_all(payload, {_sql_text(HREF)}, 1)"
    outlinks = f"list_transform({links}, lambda x: 'outlink: ' || {value('x')} || ' L a/@href' || {crlf})"
    language = value(f"regexp_extract(payload, {_sql_text(LANG)}, 1)")
    metadata = f"'title: ' || {title} || {crlf} || 'language: ' || {language} || {crlf} || array_to_string({outlinks}, '')"
    head = f"'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: {SOURCE_TYPE}' || {crlf} || 'Content-Length: ' || strlen(payload) || {crlf} || {crlf}"
    return f"""
    WITH tables AS (SELECT {_sql_map(html5)} AS names, {_sql_map(html5 | NO_BREAK)} AS breaking, {_sql_map(_odd_codes())} AS odd),
    pages_in AS (
      SELECT page_id, url AS target_uri, coalesce(html, '') AS payload,
             'sha256:' || sha256(coalesce(html, '')) AS source_payload_digest FROM pages),
    responses AS (
      SELECT *, {uuid("'response'", "coalesce(page_id::VARCHAR, '')", "coalesce(target_uri, '')", "source_payload_digest")} AS refers_to
      FROM pages_in, tables),
    both_kinds AS (
      SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, {metadata} AS block FROM responses
      UNION ALL
      SELECT *, 'conversion', 'text/plain; charset=utf-8', {text} FROM responses)
    SELECT page_id, record_type, {uuid("'derived'", "record_type", "refers_to")} AS record_id, refers_to, target_uri,
           '{date}' AS record_date, content_type, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest,
           source_payload_digest, '{SOURCE_TYPE}' AS source_content_type, {head} AS source_http_head, block
    FROM both_kinds"""
