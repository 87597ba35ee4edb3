"""Registered queries of the whole conversion.

Parsers have no SQL form; but the files of ``parse_*`` are made from the texts of the
table, so SQL can say what blocks must come out of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detect import with_detection
from ..options import ConvertOptions
from ..sources.baseline import LONGEST, with_baseline
from ..sources.read import column
from ..sources.samples import container, files
from . import chunk, convert
from .queries_text import _clean_sql, _heading_sql, read, strip, word_count
from .sinks import document_json


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column(read(spark, sf_dir, "pages"), "page_id", "html", F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages to retrieval chunks with heading path and provenance."""
    return convert.chunks(pages(spark, sf_dir))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.convert(pages(spark, sf_dir)).select("doc_id", "title", "format", "markdown", "warnings")


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(read(spark, sf_dir, "documents"))


def format_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = convert.documents(_formats(spark, sf_dir))
    return docs.select("doc_id", "filename", "format", "title", F.size("blocks").cast("long").alias("blocks"), F.col("error.code").alias("error"), F.array_join("warnings", "; ").alias("warnings"))


def format_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.convert(_formats(spark, sf_dir), ConvertOptions(frontmatter=False)).select("doc_id", "format", "markdown")


def format_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.chunks(_formats(spark, sf_dir)).select("doc_id", "id", "index", "text", "token_estimate")


def chunks_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.to_jsonl(page_chunks(spark, sf_dir))


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as text files, measured."""
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.concat("role", F.lit(".txt")).alias("name"))
    return convert.compare(column(turns, "id", "text", F.col("name")))


# -- every document as a file of one format, and the blocks that must come out ------------------------------------


def _parsed(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = convert.documents(files(read(spark, sf_dir, "documents"), kind=kind))
        rows = docs.select("doc_id", "title", F.posexplode("blocks").alias("pos", "b"))
        b = F.col("b")
        grid = F.concat(F.when(F.size(b["header"]) > 0, F.array(b["header"])).otherwise(F.array().cast("array<array<string>>")), b["rows"])
        text = (
            F.when(b["type"] == "list", F.array_join(F.transform(b["items"], lambda i: F.concat(i["depth"].cast("string"), F.lit(":"), i["text"])), "\x1f"))
            .when(b["type"] == "table", F.array_join(F.transform(grid, lambda r: F.array_join(r, "\x1f")), "\x1e"))
            .when(b["type"] == "key_values", F.array_join(F.transform(b["kv"], lambda p: F.concat(p["k"], F.lit("="), p["v"])), "\x1f"))
            .otherwise(F.coalesce(b["text"], F.lit("")))
        )
        level = F.when(b["type"] == "heading", b["level"])
        return rows.select("doc_id", "title", F.col("pos").cast("long").alias("pos"), b["type"].alias("type"), level.alias("level"), F.sha2(text, 256).alias("digest"))

    return run


def _baseline(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = with_baseline(with_detection(files(read(spark, sf_dir, "documents"), kind=kind)))
        return found.select("doc_id", F.sha2("baseline", 256).alias("digest"))

    return run


def _plain_text(x: str) -> str:
    """SQL of what a plain extraction keeps of a text."""
    return f"select doc_id, sha256({strip(f'substr({x}, 1, {LONGEST})')}) as digest from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: {strip('x')} <> '') as l from documents)"


def _expected(title: str, *parts: str) -> str:
    """parts: SQL lists of structs (t, l, x) over ``l``, the lines of a text that are not blank."""
    return f"""with d as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: {strip('x')} <> '') as l from documents),
    b as (select doc_id, list_concat({', '.join(parts)}) as b from d), e as (select doc_id, unnest(generate_series(0, len(b) - 1)) as pos, unnest(b) as b from b)
    select doc_id, {title} as title, pos, b.t as type, cast(b.l as integer) as level, sha256(b.x) as digest from e"""


def _one(kind: str, text: str, level: int | str = "null") -> str:
    return f"[{{'t': '{kind}', 'l': {level}, 'x': {text}}}]"


def _each(kind: str, text: str = "", level: int | str = "null") -> str:
    return f"list_transform(l, lambda x: {{'t': '{kind}', 'l': {level}, 'x': {text or strip('x')}}})"


_CLEANED = _clean_sql("nfc_normalize(x)")
#: Lines as paragraphs of their own, some of which look like headings.
_PROSE = f"list_transform(l, lambda x: case when {_heading_sql(_CLEANED)} then {{'t': 'heading', 'l': 2, 'x': {_CLEANED}}} else {{'t': 'paragraph', 'l': null, 'x': {_CLEANED}}} end)"
_PLAIN = "array_to_string(list_concat(['SAMPLE TITLE'], l, ['- one' || chr(10) || '- two']), chr(10) || chr(10))"
_POINTS = _one("list", "'0:one' || chr(31) || '0:two'")
_GRID = lambda *rows: " || chr(30) || ".join("'" + "' || chr(31) || '".join(r) + "'" for r in rows)

_DEEP = len(container({"deep.txt": "DEEP TITLE\n\ntext."}))
_NOTES = f"'# Notes' || chr(10) || chr(10) || {_PLAIN}"
_SIZE = f"(octet_length(encode({_NOTES})) + 8 + {_DEEP})"
_TABLE_ROW = lambda first, rest: f"array_to_string(list_concat([{first}], list_transform(l, lambda x, i: {rest})), chr(30))"
_SIMPLE = "regexp_replace(x, '[\\x{8000}-\\x{10FFFF}]', '?', 'g')"



def _records(number: str, level: int) -> str:
    """SQL of the blocks of a list of records: a table of several, pairs under a heading of one."""
    some = _one("table", _TABLE_ROW(f"'{number}' || chr(31) || 'text'", f"(i - 1) || chr(31) || {strip('x')}"))
    only = f"list_concat({_one('heading', chr(39) + '[1]' + chr(39), level)}, {_one('key_values', f"'{number}=0' || chr(31) || 'text=' || l[1]")})"
    return f"case when len(l) > 1 then {some} when len(l) = 1 then {only} else [] end"


_PARSED = {
    "json": _expected(
        "'File ' || doc_id", _one("key_values", "'product=sample'"), _one("heading", "'formats'", 3), _one("list", "'0:a' || chr(31) || '0:b'"), _one("heading", "'lines'", 3), _records("n", 4), _one("heading", "'deep'", 3), _one("heading", "'x'", 4), _one("key_values", "'y='")
    ),
    "jsonl": _expected("'File ' || doc_id", _records("id", 3)),
    "csv": _expected("'File ' || doc_id", _one("table", _TABLE_ROW("'Month' || chr(31) || 'Sum' || chr(31) || 'Note'", f"'M' || (i - 1) || chr(31) || (i - 1) * 10 || chr(31) || {strip('x')}"))),
    "xml": _expected("'root'", _one("heading", "'root'", 1), _one("key_values", f"array_to_string(list_concat(['@id=1'], list_transform(l, lambda x, i: '@n=' || (i - 1) || chr(31) || 'line=' || {_CLEANED})), chr(31))"), _one("heading", "'group'", 2), _one("key_values", "'a=1' || chr(31) || 'b=2'")),
    "rtf": _expected("'File ' || doc_id", _one("paragraph", "'**Sample**'"), _PROSE.replace(_CLEANED, _clean_sql(f"nfc_normalize({_SIMPLE})"))),
    "zip": _expected(
        "'File ' || doc_id", _one("key_values", f"'Files=3' || chr(31) || 'Unpacked=' || case when {_SIZE} < 1024 then {_SIZE} || ' B' when {_SIZE} < 1048576 then printf('%.1f KB', {_SIZE} / 1024.0::double) else printf('%.1f MB', {_SIZE} / 1048576.0::double) end"),
        _one("rule", "''"), _one("heading", "'notes.md'", 2), _one("raw", strip(f"regexp_replace({_NOTES}, '^# ', '### ')")), _one("rule", "''"), _one("heading", "'data.csv'", 2), _one("table", _GRID(("a", "b"), ("1", "2"))),
        _one("rule", "''"), _one("heading", "'inner.zip'", 2), _one("key_values", "'Files=1' || chr(31) || 'Unpacked=17 B'"), _one("rule", "''"), _one("heading", "'deep.txt'", 4), _one("heading", "'DEEP TITLE'", 5), _one("paragraph", "'text.'"),
    ),
    "txt": _expected("'SAMPLE TITLE'", _PROSE, _POINTS),
    "md": _expected("'Sample'", _one("raw", f"{strip(f"'# Sample' || chr(10) || chr(10) || {_PLAIN}")}")),
    "py": _expected("'file_' || doc_id || '.py'", _one("code", f"rtrim(array_to_string(list_concat(['def f():' || chr(10) || '    return 1'], list_transform(l, lambda x: '# ' || x)), chr(10)), ' ' || chr(9))")),
    "html": _expected("'Sample'", _one("heading", "'Sample'", 1), _each("paragraph", strip("regexp_replace(x, '[ \t\n\r\f\v]+', ' ', 'g')")), _one("list", "'0:one' || chr(31) || '1:nested'"), _one("table", _GRID(("a", "b"), ("1", "2")))),
    "eml": _expected("'Sample'", _one("key_values", "'From=a@example.com' || chr(31) || 'To=b@example.com' || chr(31) || 'Subject=Sample'"), _one("heading", "'SAMPLE TITLE'", 2), _PROSE, _POINTS),
    "ipynb": _expected("'Sample'", _one("raw", "'intro'"), _one("code", "'print(1)'"), _one("code", "'1'"), _one("raw", strip(_PLAIN))),
    "docx": _expected("'Sample'", _one("heading", "'Part one'", 1), _each("paragraph"), _one("list", "'0:a point' || chr(31) || '1:a second'"), _one("table", _GRID(("Name", "Size"), ("first", "1"), ("second", "2")))),
    "pptx": _expected(
        "'First slide'", _one("page_break", "''"), _one("heading", "'First slide'", 2), _one("paragraph", f"case when len(l) > 0 then {strip('l[1]')} else 'x' end"), _one("list", "'0:below' || chr(31) || '1:nested'"), _one("page_break", "''"), _one("heading", "'Slide 2'", 2),
        f"[case when len(l) > 1 then {{'t': 'list', 'l': null, 'x': array_to_string(list_transform(l, lambda x: '0:' || {strip('x')}), chr(31))}} else {{'t': 'paragraph', 'l': null, 'x': coalesce({strip('l[1]')}, 'y')}} end]",
    ),
    "xlsx": _expected("'File ' || doc_id", _one("heading", "'Sheet: Data'", 2), _one("table", _GRID(("Month", "Sum", "Growth"), ("Jan", "$1,234.50", "25%"), ("Feb", "-$890.00", "2024-01-01"))), f"case when len(l) > 0 then {_each('paragraph')} else {_one('paragraph', chr(39) + 'note' + chr(39))} end"),
    "epub": _expected("'A Book'", _one("page_break", "''"), _one("heading", "'Chapter one'", 1), _each("paragraph", strip("regexp_replace(x, '[ \t\n\r\f\v]+', ' ', 'g')")), _one("page_break", "''"), _one("heading", "'Two'", 1), _one("paragraph", "'no heading here'")),
    "png": _expected("'file_' || doc_id || '.png'", _one("key_values", "'Format=PNG' || chr(31) || 'Size=29 B' || chr(31) || 'Dimensions=3x2'")),
}

_LINES = lambda *parts: "array_to_string(list_concat(" + ", ".join(parts) + "), chr(10))"

_BASELINES = {
    "docx": _plain_text(_LINES("['Sample', 'Part one']", "l", "['a point', 'a second']")),
    "pptx": _plain_text(_LINES("['below', 'nested', case when len(l) > 0 then l[1] else 'x' end, 'First slide']", "case when len(l) > 0 then l else ['y'] end")),
    "xlsx": _plain_text(_LINES("['Month Sum Growth', 'Jan 1234.5 0.25', 'Feb -890 45292']", "case when len(l) > 0 then l else ['note'] end", "['hidden']")),
    "txt": _plain_text(_clean_sql(f"nfc_normalize({_PLAIN})")),
}

def _front(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = convert.with_frontmatter(convert.documents(files(read(spark, sf_dir, "documents"), kind="txt")), "2024-01-01T00:00:00Z")
    return docs.select("doc_id", "frontmatter")


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_json(convert.documents(files(read(spark, sf_dir, "documents"), kind="md"))).select("doc_id", F.sha2("json", 256).alias("digest"))


_LINED = f"(select doc_id, list_filter(string_split(text, chr(10)), lambda x: {strip('x')} <> '') as l from documents)"
_FRONT = f"""select doc_id, array_to_string(['---', 'title: SAMPLE TITLE', 'source:', '  filename: file_' || doc_id || '.txt', '  format: text', '  media_type: text/plain', '  bytes: ' || octet_length(encode({_PLAIN})),
        '  sha256: ' || sha256({_PLAIN}), 'converted_at: ''2024-01-01T00:00:00Z''', 'converted_by: sheafwork', 'word_count: ' || (2 + {word_count("array_to_string(l, ' ')")}), '---'], chr(10)) as frontmatter from {_LINED}"""
_FILE_MD = f"('---' || chr(10) || 'title: Sample' || chr(10) || '---' || chr(10) || '# Sample' || chr(10) || chr(10) || {_PLAIN} || chr(10))"
_JSON = f"""select doc_id, sha256('{{"title":"Sample","source":{{"filename":"file_' || doc_id || '.md","format":"markdown","media_type":"text/markdown","bytes":' || octet_length(encode({_FILE_MD})) || ',"sha256":"' || sha256({_FILE_MD})
        || '"}},"metadata":{{"title": "Sample"}},"blocks":[{{"type":"raw","content":' || to_json({strip(f"'# Sample' || chr(10) || chr(10) || {_PLAIN}")}) || '}}],"assets":[],"warnings":[]}}') as digest from {_LINED}"""

QUERIES = {
    "frontmatter": (_front, _FRONT),
    "document_json": (_json, _JSON),
    "page_chunks": (page_chunks, None),
    "page_markdown": (page_markdown, None),
    "format_blocks": (format_blocks, None),
    "format_markdown": (format_markdown, None),
    "format_chunks": (format_chunks, None),
    "chunks_jsonl": (chunks_jsonl, None),
    "conversation_measures": (_rounds, None),
} | {f"parse_{kind}": (_parsed(kind), sql) for kind, sql in _PARSED.items()} | {f"baseline_{kind}": (_baseline(kind), sql) for kind, sql in _BASELINES.items()}
