"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response record gives two derived records that refer to it: ``conversion``,
the plain text of its page, and ``metadata``, the response's own identifier, headers
and digests with facts about the page; the two name each other. Identifiers are
version-4-shaped UUIDs made of SHA-256 digests of what they name, so a rerun, or a
task that is run again, gives the same records.

``read`` gives the records of WARC files, ``captured`` their responses with the
headers, date, identifier and digests that they have, ``responses`` makes the like of
a table of pages; ``derive`` works on either and is column expressions only. Text
records are written as whole WARC files by Spark's text writer, whose line separator
is the blank lines that end every record.

Defined results: a null or empty page has the empty text; an element, comment or tag
that is not closed ends with the page; a null url is the empty target; a null page_id
still has an identifier, made from its content; repeated pages give repeated records
with equal identifiers; pages of any length are read whole; columns besides page_id,
url and html are not read, whatever their names; a malformed record or a damaged
gzip member ends its file with an ``error`` row after the records before it; a
response whose HTTP head does not end is all payload; an empty table gives an empty
result.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Stands for the time of capture where the source has none; a rerun must not change the records.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"

# Element whose content is not text, and elements that end a line of text.
_DROP = "script|style|noscript|template"
_BREAK = "p|div|br|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|article|section|header|footer|nav|blockquote|pre|title|head|body|html"

#: All named character references that end in a semicolon, and what numbers from 128 to 159 stand for.
_NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
_WINDOWS = [_html.unescape(f"&#{n};") for n in range(128, 160)]


def _steps() -> list[tuple[str, str]]:
    """Regular-expression replacements, in order, that both Java and RE2 read alike."""
    whole = "|".join(["!--.*?(?:-->|\\z)", *(f"{e}(?:[ \\t\\r\\n/][^>]*)?>.*?(?:</{e}[ \\t\\r\\n]*>|\\z)" for e in _DROP.split("|"))])
    return [
        (f"(?is)<(?:{whole})", " "),
        (f"(?is)</?(?:{_BREAK})(?:[ \\t\\r\\n/][^>]*)?(?:>|\\z)", "\n"),
        ("(?s)<[/!?a-zA-Z][^>]*(?:>|\\z)", ""),
    ]


_SPACES = [("[ \\t\\r\\f\\x0B]+", " "), (" ?\n[ \n]*", "\n"), ("^[ \n]+|[ \n]+$", "")]


def _unescaped(text: Column) -> Column:
    """Character references decoded once: named ones, decimal and hexadecimal numbers."""
    named = F.map_from_arrays(F.array(*[F.lit(k) for k in _NAMED]), F.array(*[F.lit(v) for v in _NAMED.values()]))

    def character(n: Column) -> Column:
        bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        of = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(bad, "\ufffd").when(n.between(128, 159), F.element_at(F.array(*[F.lit(x) for x in _WINDOWS]), (n - 127).cast("int"))).otherwise(of)

    def decoded(part: Column) -> Column:
        """A piece that stood behind an ampersand."""
        name = F.regexp_extract(part, "^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("long")
        shown = F.when(name == "", F.lit(None))
        for usual in ("amp", "nbsp", "lt", "gt", "quot"):  # a map is searched entry by entry
            shown = shown.when(name == usual, _NAMED[usual])
        shown = shown.when(name.startswith("#"), character(number)).otherwise(F.try_element_at(named, name))
        return F.coalesce(F.concat(shown, F.substring(part, F.length(name) + 2, F.length(part))), F.concat(F.lit("&"), part))

    return F.array_join(F.transform(F.split(text, "&"), lambda x, i: F.when(i == 0, x).otherwise(decoded(x))), "")


def plain_text(html: Column) -> Column:
    text = F.coalesce(html, F.lit(""))
    for pattern, by in _steps():
        text = F.regexp_replace(text, pattern, by)
    text = F.translate(_unescaped(text), "\u00a0", " ")
    for pattern, by in _SPACES:
        text = F.regexp_replace(text, pattern, by)
    return text


def _uuid(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    cut = lambda i, n: F.substring(h, i, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-4"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages as response records: record_id, target_uri, date, http_headers, payload and their digests."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html), F.lit(CRLF + CRLF))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), html.alias("payload"))
    payload, block = _digest(F.col("payload")), _digest(F.concat("http_headers", "payload"))
    ident = _uuid(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.col("date"), F.sha2("payload", 256))
    return rows.select("*", ident.alias("record_id"), payload.alias("payload_digest"), block.alias("block_digest"))


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response: its conversion and its metadata record.

    Columns: page_id, record_type, record_id, refers_to, concurrent_to (the other of
    the two), target_uri, date, content_type, content_length (bytes), block_digest,
    payload_digest (of the response, kept), source_headers (kept) and block, the
    record's content.
    """
    text = plain_text(F.col("payload"))
    base = records.select("page_id", "target_uri", "date", "http_headers", "record_id", "payload_digest", F.col("block_digest").alias("source_block"), F.octet_length("payload").alias("size"), text.alias("text"))
    described = F.concat(
        F.lit("source-record-id: "), "record_id", F.lit(CRLF),
        F.lit("source-payload-digest: "), "payload_digest", F.lit(CRLF),
        F.lit("source-block-digest: "), "source_block", F.lit(CRLF),
        F.lit("source-payload-length: "), F.col("size").cast("string"), F.lit(CRLF),
        F.lit("text-length: "), F.octet_length("text").cast("string"), F.lit(CRLF),
        F.lit("text-digest: "), _digest(F.col("text")), F.lit(CRLF),
        "http_headers",
    )
    made = F.array(
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), described.alias("block")),
    )
    named = F.transform(made, lambda r: r.withField("record_id", _uuid(r["record_type"], F.col("record_id"), F.sha2(r["block"], 256))))
    linked = F.transform(named, lambda r, i: r.withField("concurrent_to", F.get(named, 1 - i)["record_id"]))
    out = base.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.col("http_headers").alias("source_headers"), F.inline(linked))
    return out.select(
        "page_id", "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), _digest(F.col("block")).alias("block_digest"), "payload_digest", "source_headers", "block",
    )


def as_warc(records: DataFrame) -> DataFrame:
    """One column ``value``: each derived record as WARC text without the blank lines after it.

    Both records name the response, its target, date and payload digest; its headers
    stand in the metadata record, which the conversion record names.
    """
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), field("WARC-Type", F.col("record_type")), field("WARC-Record-ID", F.col("record_id")), field("WARC-Refers-To", F.col("refers_to")),
        field("WARC-Concurrent-To", F.col("concurrent_to")), field("WARC-Target-URI", F.col("target_uri")), field("WARC-Date", F.col("date")),
        field("WARC-Refers-To-Target-URI", F.col("target_uri")), field("WARC-Refers-To-Date", F.col("date")), field("WARC-Refers-To-Payload-Digest", F.col("payload_digest")),
        field("WARC-Block-Digest", F.col("block_digest")), field("WARC-Payload-Digest", F.col("block_digest")),
        field("Content-Type", F.col("content_type")), field("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF),
    )
    return records.select(F.concat(head, "block").alias("value"))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write derived records as WARC files, one per partition."""
    as_warc(records).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


_READ = "path string, position long, record_type string, headers map<string,string>, block binary, error string"


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a plain or gzipped file piece by piece, member after member."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[i : i + step]) for i in range(0, len(data), step))
        return
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):
            piece = view[at : at + step]
            at += len(piece)
            out = member.decompress(piece, step)
            while out or member.unconsumed_tail:
                yield out
                out = member.decompress(member.unconsumed_tail, step)
            at -= len(member.unused_data)
        if not member.eof:
            raise zlib.error("the last member is cut off")


def _parse(data: bytes) -> Iterator[tuple[int, str | None, dict[str, str], bytes | None, str | None]]:
    """(position in the inflated file, type, headers, block, error); no more of the file is held than one record and a piece."""
    held, at, pieces, ended = bytearray(), 0, _inflated(data), False

    def more() -> bool:
        nonlocal ended
        piece = None if ended else next(pieces, None)
        ended = piece is None
        held.extend(piece or b"")
        return not ended

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if not held:
            return
        lines = bytes(held[:end]).decode("utf-8", "replace").split(CRLF) if end >= 0 else [""]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = headers.get("content-length", "")
        whole = end + 4 + int(size) if lines[0].startswith("WARC/") and size.isdigit() else -1
        while whole > len(held) and more():
            pass
        if whole < 0 or whole > len(held):
            yield at, None, {}, None, "not a whole WARC record"
            return
        yield at, headers.get("warc-type"), headers, bytes(held[end + 4 : whole]), None
        while len(held) < whole + 4 and more():
            pass
        done = whole + 4 if held[whole : whole + 4] == b"\r\n\r\n" else whole
        del held[:done]
        at += done


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: path, position, record_type, headers (lower-case names), block, error.

    A file is one row of Spark's binary reader, so it may be up to 2 GB as it is stored;
    its records are inflated and handed on as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("position", pa.int64()), ("record_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("error", pa.string())])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, weight = [], 0
                try:
                    for position, kind, headers, block, error in _parse(content.as_py()):
                        rows.append((name, position, kind, list(headers.items()), block, error))
                        weight += len(block or b"")
                        if len(rows) == 256 or weight > 4 << 20:
                            yield made(rows)
                            rows, weight = [], 0
                except zlib.error as e:
                    rows.append((name, None, None, [], None, f"gzip: {e}"))
                if rows:
                    yield made(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _READ)


def _body(head: str, body: bytes) -> str:
    """The text of an HTTP body: without chunks, inflated, decoded by the charset of its headers or of the page."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\n")[1:])}
    if fields.get("transfer-encoding", "").lower() == "chunked" and re.match(rb"[0-9A-Fa-f]+[^\r\n]*\r\n", body):
        parts, at = [], 0
        while m := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n").match(body, at):
            size = int(m[1], 16)
            parts.append(body[m.end() : m.end() + size])
            at = m.end() + size + 2
            if not size:
                break
        body = b"".join(parts)
    if fields.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate") and (body[:2] == b"\x1f\x8b" or body[:1] == b"\x78"):
        out = zlib.decompressobj(47)
        try:
            body = out.decompress(body)
        except zlib.error:
            pass  # as it was sent
    found = re.search(r"charset=[\"']?([\w.:-]+)", fields.get("content-type", ""), re.I) or re.search(r"charset=[\"']?([\w.:-]+)", body[:1024].decode("latin-1"), re.I)
    for charset in (found[1] if found else "utf-8", "utf-8"):
        try:
            return body.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("latin-1")


_CAPTURED = "page_id long, target_uri string, date string, http_headers string, payload string, record_id string, payload_digest string, block_digest string"


def captured(records: DataFrame) -> DataFrame:
    """The responses among the rows of ``read``, in the form that ``derive`` takes.

    Identifier, target, date and digests are the record's own; a digest that it lacks
    is computed, of the block as it is stored and of the payload behind the HTTP head.
    page_id is null. Records of other types and error rows give none.
    """
    field = lambda name: F.try_element_at("headers", F.lit(name))
    rows = records.where("record_type = 'response' and error is null").select(
        field("warc-target-uri").alias("uri"), field("warc-date").alias("date"), field("warc-record-id").alias("id"),
        field("warc-payload-digest").alias("payload_digest"), field("warc-block-digest").alias("block_digest"), "block",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        digest = lambda x: "sha256:" + hashlib.sha256(x).hexdigest()
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            rows = []
            for uri, date, ident, payload_digest, block_digest, block in zip(*columns, batch.column(5), strict=True):
                block = block.as_py()
                end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
                head, body = (block[: end + 4].decode("latin-1"), block[end + 4 :]) if end >= 0 else ("", block)
                rows.append((None, uri or "", date or DATE, head, _body(head, body), ident or f"<urn:sha256:{hashlib.sha256(block).hexdigest()}>", payload_digest or digest(body), block_digest or digest(block)))
            if rows:
                types = [pa.int64(), *[pa.string()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in _CAPTURED.split(", ")])

    return rows.mapInArrow(run, _CAPTURED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")))


def sql() -> str:
    """The same derivation in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def lit(s: str) -> str:
        parts = [quote(p) for p in s.replace("\r", "\x00").replace("\n", "\x01").replace("\x1f", "\x02").replace("\x00", "\x03chr(13)\x03").replace("\x01", "\x03chr(10)\x03").replace("\x02", "\x03chr(31)\x03").split("\x03")]
        return "(" + " || ".join(p[1:-1] if p.startswith("'chr(") else p for p in parts) + ")"

    text = "coalesce(html, '')"
    for pattern, by in _steps():
        text = f"regexp_replace({text}, {quote(pattern.replace(chr(10), chr(92) + 'n'))}, {lit(by)}, 'g')"
    # References: every piece behind an ampersand is looked at on its own.
    names, shown = ("[" + ", ".join(lit(x) for x in xs) + "]" for xs in (_NAMED, _NAMED.values()))
    name = "regexp_extract(x, '^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);', 1)"
    number = "case when regexp_matches(x, '^#[xX]') then cast('0x' || substr(n, 3) as bigint) else cast(substr(n, 2) as bigint) end"
    character = f"case when c = 0 or c > 1114111 or c between 55296 and 57343 then chr(65533) when c between 128 and 159 then [{', '.join(lit(x) for x in _WINDOWS)}][c - 127] else chr(cast(c as integer)) end"
    spaced = "translate(t, chr(160), ' ')"
    for pattern, by in _SPACES:
        spaced = f"regexp_replace({spaced}, {quote(pattern.replace(chr(10), chr(92) + 'n'))}, {lit(by)}, 'g')"

    def uuid(*parts: str) -> str:
        h = f"sha256({(' || ' + lit(chr(31)) + ' || ').join(parts)})"
        return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"

    crlf = lit(CRLF)
    return f"""
    with h as (select row_number() over () as row, page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload, {text} as marked from pages),
    p as (select row, unnest(generate_series(1, len(l))) as i, unnest(l) as x from (select row, string_split(marked, '&') as l from h)),
    n as (select row, i, x, case when i > 1 then {name} else '' end as n from p),
    c as (select *, case when starts_with(n, '#') then {number} end as c from n),
    m as (select unnest({names}) as n, unnest({shown}) as shown),
    u as (select row, i, case when i = 1 then x when c is not null then {character} || substr(x, length(c.n) + 2) when shown is not null then shown || substr(x, length(c.n) + 2) else '&' || x end as x from c left join m on c.n = m.n),
    j as (select row, string_agg(x, '' order by i) as t from u group by row),
    r as (
        select page_id, target_uri, {lit(DATE)} as date, payload,
            {lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: ")} || octet_length(encode(payload)) || {lit(CRLF + CRLF)} as http_headers,
            {spaced} as text
        from h join j using (row)
    ), s as (
        select *, {uuid("'response'", "coalesce(cast(page_id as varchar), '')", "target_uri", "date", "sha256(payload)")} as refers_to,
            'sha256:' || sha256(payload) as payload_digest, 'sha256:' || sha256(http_headers || payload) as source_block
        from r
    ), d as (
        select page_id, refers_to, target_uri, date, payload_digest, http_headers as source_headers, 'conversion' as record_type, 'text/plain; charset=utf-8' as content_type, text as block from s
        union all
        select page_id, refers_to, target_uri, date, payload_digest, http_headers, 'metadata', 'application/warc-fields',
            'source-record-id: ' || refers_to || {crlf} || 'source-payload-digest: ' || payload_digest || {crlf} || 'source-block-digest: ' || source_block || {crlf}
            || 'source-payload-length: ' || octet_length(encode(payload)) || {crlf} || 'text-length: ' || octet_length(encode(text)) || {crlf}
            || 'text-digest: sha256:' || sha256(text) || {crlf} || http_headers
        from s
    )
    , w as (select *, {uuid("record_type", "refers_to", "sha256(block)")} as record_id from d)
    select x.page_id, x.record_type, x.record_id, x.refers_to, (select min(y.record_id) from w y where y.refers_to = x.refers_to and y.record_type <> x.record_type) as concurrent_to, x.target_uri, x.date, x.content_type,
        cast(octet_length(encode(x.block)) as bigint) as content_length, 'sha256:' || sha256(x.block) as block_digest, x.payload_digest, x.source_headers, x.block
    from w x
    """
