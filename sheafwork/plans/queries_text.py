"""Registered queries of the scalar functions and of detection, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import text as T

BLANK = "[ \\t\\n\\r\\f\\v]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def word_count(x: str) -> str:
    return f"cast(len(list_filter(regexp_split_to_array({x}, '{BLANK}+'), lambda w: w <> '')) as bigint)"


def over(table_: str, key_: str, **made):
    """A query that adds expressions to a table's key. made: name -> function of no argument giving a Column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, table_).select(key_, *[f().alias(name) for name, f in made.items()])

    return run


_MESS_SQL = "' ' || replace(text, chr(10), chr(13) || chr(10) || chr(10) || chr(10) || chr(10)) || '  “ﬁne”  – a — b…' || chr(7) || chr(160) || 'x'"


def _mess():
    return F.concat(F.lit(" "), F.replace("text", F.lit("\n"), F.lit("\r\n\n\n\n")), F.lit("  “ﬁne”  – a — b…\x07 x"))


def _clean_sql(x: str) -> str:
    for old, new in T.LIGATURES + T.SMART:
        x = f"replace({x}, '{old}', '{new.replace(chr(39), chr(39) * 2)}')"
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"
    x = f"regexp_replace({x}, '[ \\t]{{2,}}', ' ', 'g')"
    return strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


_PREFIXES = ("# ", "- ", "> ", "1. ", "```", "| ", "", "  ## ", "~~~", "--- ")


def _marked():
    lines = F.split("text", "\n")
    pre = F.array(*[F.lit(p) for p in _PREFIXES])
    return F.array_join(F.concat(F.transform(lines, lambda x, i: F.concat(F.element_at(pre, (i % len(_PREFIXES) + 1).cast("int")), x)), F.array(F.lit("- - -"), F.lit(" ***"), F.lit("=="), F.lit("-x"))), "\n")


_PRE_SQL = "[" + ", ".join(f"'{p}'" for p in _PREFIXES) + "]"
_MARKED_SQL = f"array_to_string(list_concat(list_transform(string_split(text, chr(10)), lambda x, i: {_PRE_SQL}[(i - 1) % {len(_PREFIXES)} + 1] || x), ['- - -', ' ***', '==', '-x']), chr(10))"


def _escape_sql(x: str) -> str:
    both = f"{T._BREAK_LINE}|{T._BLOCK_START}".replace("'", "''")
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: case when regexp_matches(l, '{both}') then regexp_replace(l, '^([ \\t]{{0,3}})', '\\1\\\\') else l end), chr(10))"


def _slug_sql(x: str, most: int = 60) -> str:
    a = strip("regexp_replace(" + x + ", '[^A-Za-z0-9_ \\t\\n\\r\\f\\v-]', '', 'g')")
    b = f"substr(regexp_replace(lower({a}), '[- \\t\\n\\r\\f\\v]+', '-', 'g'), 1, {most})"
    c = f"regexp_replace({b}, '^-+|-+$', '', 'g')"
    return f"case when {c} = '' then 'untitled' else {c} end"


def _heading_sql(x: str, words: int = 14) -> str:
    s = strip(x)
    n = lambda p: f"len(regexp_extract_all({s}, '{p}'))"
    numbered = f"regexp_matches({s}, '^([0-9]+(\\.[0-9]+)*|[IVXLC]+\\.|[A-Z]\\.){BLANK}+[^ \\t\\n\\r\\f\\v]')"
    return f"({s} <> '' and length({s}) <= 120 and {word_count(s)} <= {words} and not regexp_matches({s}, '[.,;:]$') and ({numbered} or ({n('\\p{L}')} > 0 and {n('\\p{Lu}')} * 10 > {n('\\p{L}')} * 7)))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


_LINES_SQL = "(select doc_id, unnest(generate_series(0, len(l) - 1)) as line_no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents))"


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    x = F.when(F.col("line_no") % 3 == 0, F.translate(line, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(F.col("line_no") % 3 == 1, F.concat(F.lit("1.2 "), line)).otherwise(line)
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.looks_like_heading(x).alias("heading"))


_HEADINGS_SQL = f"""select doc_id, line_no, {_heading_sql('x')} as heading from (
    select doc_id, line_no, case line_no % 3 when 0 then translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') when 1 then '1.2 ' || line else line end as x from {_LINES_SQL})"""

_NAMES = ("report.PDF", "a/b/data.tsv", ".env", "Dockerfile", "src/main.py", "notes", "x.tar.gz", "photo.JPEG", "page.xhtml", "book.epub", "CMakeLists.txt", "log.txt", "feed.rss", "n.ipynb", "query.sql", "w.unknown")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in _NAMES])
    heads = F.array(*[F.lit(h) for h in _HEADS])
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    name = F.element_at(names, (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    head = F.element_at(heads, (F.floor(F.col("doc_id") / len(_NAMES)) % len(_HEADS) + 1).cast("int"))
    return docs.select("doc_id", name.alias("filename"), F.concat(F.unhex(head), F.encode("text", "UTF-8")).alias("content"))


_HEADS = ("", "255044462D", "7B5C727466", "89504E470D0A1A0A", "FFD8FF", "474946383761", "424D000000000000000000", "424D61626364656667", "52494646000000005745425000", "49492A00", "D0CF11E0A1B11AE1", "504B0304", "20207B", "3C68746D6C3E", "3C3F786D6C", "00")


def _detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", D.detect(F.col("content"), F.col("filename")).alias("d")).select("doc_id", "d.*")


def _detect_sql() -> str:
    code = " ".join(f"when ext = '{e}' then '{lang}'" for e, lang in D.CODE)
    bare = " ".join(f"when base = '{n}' then '{lang}'" for n, lang in D.BARE_NAMES)
    fmt = " ".join(f"when ext in ({', '.join(repr(e) for e in es)}) then '{f}'" for f, _, es in D.FORMATS)
    media = " ".join(f"when format = '{f}' then '{m}'" for f, m, _ in D.FORMATS if f not in ("image", "text"))
    image = " ".join(f"when extension = '{e}' then '{m}'" for e, m in D.IMAGE_MEDIA)
    heads = "[" + ", ".join(f"'{h}'" for h in _HEADS) + "]"
    names = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
    return f"""
    with f as (
        select doc_id, {names}[doc_id % {len(_NAMES)} + 1] as filename, {heads}[(doc_id // {len(_NAMES)}) % {len(_HEADS)} + 1] as hex, text from documents
    ), e as (
        select *, lower(regexp_replace(filename, '^.*/', '')) as base, lower(regexp_extract(regexp_replace(filename, '^.*/', ''), '[^.](\\.[^./]+)$', 1)) as ext,
            hex || upper(hex(substr(text, 1, 40))) as h, hex as head
        from f
    ), m as (
        select doc_id, ext, base, h, head, text,
            case when starts_with(h, '255044462D') then 'pdf' when starts_with(h, '7B5C727466') then 'rtf' when starts_with(h, '89504E470D0A1A0A') then 'image.png'
                when starts_with(h, 'FFD8FF') then 'image.jpg' when starts_with(h, '474946383761') or starts_with(h, '474946383961') then 'image.gif'
                when starts_with(h, '424D') and substr(h, 13, 8) = '00000000' then 'image.bmp' when starts_with(h, '52494646') and substr(h, 17, 8) = '57454250' then 'image.webp'
                when starts_with(h, '49492A00') or starts_with(h, '4D4D002A') then 'image.tiff' when starts_with(h, 'D0CF11E0A1B11AE1') then 'ole2'
                when starts_with(h, '504B0304') or starts_with(h, '504B0506') then 'zip' end as magic,
            case {code} {bare} end as code, case {fmt} end as fmt
        from e
    ), n as (
        select doc_id, code, magic, ext,
            case when magic is not null then split_part(magic, '.', 1) when code is not null then 'code' when fmt is not null then fmt
                when head = '00' or head = '424D000000000000000000' or contains(head, '00000000') then 'binary'
                when regexp_matches(x, '^[{{\\[]') then 'json' when regexp_matches(x, '(?i)^(<!doctype html|<html)') then 'html' when starts_with(x, '<?xml') then 'xml' else 'text' end as format,
            case when magic is not null then 'magic' when code is not null or fmt is not null then 'extension' when head = '00' then 'extension'
                when regexp_matches(x, '^[{{\\[]') or regexp_matches(x, '(?i)^(<!doctype html|<html)') or starts_with(x, '<?xml') then 'content' else 'fallback' end as via
        from (select *, regexp_replace(case head when '20207B' then '{{' when '3C68746D6C3E' then '<html>' when '3C3F786D6C' then '<?xml' else '' end || text, '^[ \\t\\n\\r\\f\\v]+', '') as x from m)
    ), o as (
        select doc_id, format, via, code,
            case when via = 'magic' then case when format = 'image' then '.' || split_part(magic, '.', 2) when format = 'ole2' then case when ext = '' then '.doc' else ext end else '.' || format end
                when via = 'content' and ext = '' then '.' || format else ext end as extension
        from n
    )
    select doc_id, format, case {media} when format = 'image' then case {image} end when format = 'binary' then 'application/octet-stream' when format = 'ole2' then 'application/x-ole-storage' else 'text/plain' end as media_type,
        extension, case when format = 'code' then code else '' end as lang,
        cast(case when format = 'zip' and via = 'magic' then 0.9 when via = 'magic' then 1.0 when format = 'code' then 0.9 when format = 'binary' then 0.3 when via = 'extension' then 0.85
            when format = 'json' then 0.5 when format = 'html' then 0.8 when format = 'xml' then 0.7 else 0.3 end as double) as confidence, via
    from o"""


def _resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.resolve(_detect(spark, sf_dir).select("doc_id", "format"), D.parsers(spark)).groupBy("format", "label", "priority").agg(F.count("*").alias("n"))


def _parsers_sql() -> str:
    return "(values " + ", ".join(f"('{f}', {p}, '{label}')" for f, p, label in D.PARSERS) + ") as p(format, priority, label)"


def _resolve_sql() -> str:
    return f"""select d.format, coalesce(label, 'Plain text') as label, coalesce(priority, 900) as priority, count(*) as n
    from ({_detect_sql()}) d left join (select format, min_by(label, priority) as label, min(priority) as priority from {_parsers_sql()} group by format) r on d.format = r.format group by all"""


def _demoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 3, F.lit("```")).otherwise(F.concat(F.lit("## "), x))), "\n")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.demote_headings(text, 2), 256).alias("digest"))


_DEMOTED_SQL = """
    with l as (select doc_id, i, case when i % 5 = 3 then '```' else '## ' || x end as x from (
        select doc_id, unnest(generate_series(0, len(l) - 1)) as i, unnest(l) as x from (select doc_id, string_split(text, chr(10)) as l from documents))),
    f as (select *, sum(case when x = '```' then 1 else 0 end) over (partition by doc_id order by i) % 2 as fenced from l)
    select doc_id, sha256(string_agg(case when fenced = 0 and x <> '```' then '##' || x else x end, chr(10) order by i)) as digest from f group by doc_id"""

_MEMBERS = ("docs/", "/etc/passwd", "a/../b", "__MACOSX/", "x/.git/", "ok/", "", "node_modules/")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    pre = F.array(*[F.lit(m) for m in _MEMBERS])
    tail = F.when(F.col("page_id") % 3 == 0, F.lit(".DS_Store")).when(F.col("page_id") % 3 == 1, F.concat(F.col("page_id").cast("string"), F.lit(".md"))).otherwise(F.lit("d/"))
    name = F.concat(F.element_at(pre, (F.col("page_id") % len(_MEMBERS) + 1).cast("int")), tail)
    return read(spark, sf_dir, "pages").select("page_id", name.alias("name"), T.wanted_member(name).alias("wanted"))


_MEMBERS_SQL = f"""select page_id, name, not (ends_with(name, '/') or starts_with(name, '/') or regexp_matches(name, '(^|/)\\.\\.(/|$)') or regexp_replace(name, '^.*/', '') in ('.DS_Store', 'Thumbs.db', '.gitignore')
        or regexp_matches(name, '(^|/)(__MACOSX|\\.git|node_modules|\\.venv)/')) as wanted
    from (select page_id, [{', '.join(repr(m) for m in _MEMBERS)}][page_id % {len(_MEMBERS)} + 1] || case page_id % 3 when 0 then '.DS_Store' when 1 then page_id || '.md' else 'd/' end as name from pages)"""


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sinks import unique_stems

    names = read(spark, sf_dir, "pages").select("page_id", F.concat(T.basename(F.col("url")), F.lit(".html")).alias("filename"), F.concat(F.lit("f"), (F.col("page_id") % 7).cast("string"), F.when(F.col("page_id") % 2 == 0, ".md").otherwise(".txt")).alias("name"))
    return unique_stems(names.select("page_id", "name"), "page_id", "name")


_STEMS_SQL = """
    with n as (select page_id, 'f' || (page_id % 7) || case when page_id % 2 = 0 then '.md' else '.txt' end as name from pages),
    s as (select *, regexp_replace(name, '\\.[^.]*$', '') as base, regexp_extract(name, '\\.([^.]*)$', 1) as ext from n),
    r as (select *, row_number() over (partition by base order by page_id) as k, row_number() over (partition by base, ext order by page_id) as ke from s),
    first as (select base, min_by(ext, page_id) as first_ext from s group by base)
    select page_id, name, case when k = 1 then base when ke = 1 and ext <> first_ext then base || '-' || ext else base || '-' || ext || '-' || ke end as stem from r join first using (base)"""

_long = lambda f: (lambda: f().cast("long"))
_digest = lambda f: (lambda: F.sha2(f(), 256))
_FILE = "'Dir ' || doc_id || '/../my-report_' || regexp_replace(text, '[^ -~]', '', 'g') || '.tar.gz'"


def _file():
    return F.concat(F.lit("Dir "), F.col("doc_id").cast("string"), F.lit("/../my-report_"), F.regexp_replace("text", "[^ -~]", ""), F.lit(".tar.gz"))


_STEM = strip(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_FILE}, '^.*/', ''), '\\.[^.]*$', ''), '[_-]+', ' ', 'g'), '{BLANK}+', ' ', 'g')")
_SAFE = f"substr(regexp_replace(regexp_replace(regexp_replace(replace({_FILE}, '\\', '/'), '^.*/', ''), '[^A-Za-z0-9._-]', '_', 'g'), '^\\.+', ''), 1, 120)"
_CUT = "substr(t, 501, 1000)"


def _window():
    return F.replace("text", F.lit(". "), F.lit(".\n\n"))


QUERIES = {
    "clean_ascii": (over("documents", "doc_id", digest=_digest(lambda: T.clean_folded(_mess())), n=_long(lambda: F.length(T.clean_folded(_mess())))), f"select doc_id, sha256({_clean_sql(_MESS_SQL)}) as digest, cast(length({_clean_sql(_MESS_SQL)}) as bigint) as n from documents"),
    "clean_unicode": (over("documents", "doc_id", digest=_digest(lambda: T.clean(_mess()))), None),
    "slugify_unicode": (over("documents", "doc_id", slug=lambda: T.slugify(F.col("text"))), None),
    "decode_bytes": (over("documents", "doc_id", same=lambda: T.decode(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))) == F.col("text"), latin=lambda: F.length(T.decode(F.unhex(F.lit("E92E")))).cast("long")), "select doc_id, true as same, cast(2 as bigint) as latin from documents"),
    "escape_md": (over("documents", "doc_id", digest=_digest(lambda: T.escape_md(F.concat("text", F.lit("*a* _b_ [c] <d> `e`"))))), "select doc_id, sha256(regexp_replace(text || '*a* _b_ [c] <d> `e`', '([\\\\`*_{}\\[\\]<>|])', '\\\\\\1', 'g')) as digest from documents"),
    "escape_cell": (over("documents", "doc_id", digest=_digest(lambda: T.escape_cell(F.concat(F.lit(" "), F.col("text"), F.lit("|x\\y\t"))))), f"select doc_id, sha256({strip('''replace(replace(replace(' ' || text || '|x' || chr(92) || 'y' || chr(9), chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), chr(10), '<br>')''')}) as digest from documents"),
    "escape_block_start": (over("documents", "doc_id", digest=_digest(lambda: T.escape_block_start(_marked()))), f"select doc_id, sha256({_escape_sql(_MARKED_SQL)}) as digest from documents"),
    "slugify": (over("documents", "doc_id", slug=lambda: T.slugify_ascii(F.col("text"))), f"select doc_id, {_slug_sql('text')} as slug from documents"),
    "title_from_filename": (over("documents", "doc_id", title=lambda: T.title_from_filename(_file())), f"select doc_id, case when s = '' then 'Untitled' else upper(substr(s, 1, 1)) || substr(s, 2) end as title from (select doc_id, {_STEM} as s from documents)"),
    "safe_name": (over("documents", "doc_id", name=lambda: T.safe_name(_file())), f"select doc_id, case when s = '' then 'file' else s end as name from (select doc_id, {_SAFE} as s from documents)"),
    "human_bytes": (
        over("documents", "doc_id", size=lambda: T.human_bytes(F.col("n_chars") * (F.col("doc_id") % 5) * (F.col("doc_id") % 5) * 997)),
        """select doc_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', n / 1024.0::double) when n < 1073741824 then printf('%.1f MB', n / 1048576.0::double) else printf('%.1f GB', n / 1073741824.0::double) end as size
        from (select doc_id, n_chars * (doc_id % 5) * (doc_id % 5) * 997 as n from documents)""",
    ),
    "heading_like": (_headings, _HEADINGS_SQL),
    "is_numeric": (
        lambda spark, d: read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.is_numeric(F.element_at(F.array(F.lit("(12.5)"), F.concat(F.lit(" $"), F.col("l_orderkey").cast("string")), F.lit("-1,234 %"), F.lit("1e5"), F.lit("$-3"), F.col("l_returnflag"), F.lit("5.")), (F.col("l_orderkey") % 7 + 1).cast("int"))).alias("numeric")),
        f"select l_orderkey, l_linenumber, regexp_matches({strip('x')}, '^-?[0-9,]*\\.?[0-9]+[ \\t\\n\\r\\f\\v]*%?$|^[($]-?[0-9,]*\\.?[0-9]+[)]?$') as numeric from (select l_orderkey, l_linenumber, ['(12.5)', ' $' || l_orderkey, '-1,234 %', '1e5', '$-3', l_returnflag, '5.'][l_orderkey % 7 + 1] as x from lineitem)",
    ),
    "word_count": (over("documents", "doc_id", words=lambda: T.word_count(F.col("text"))), f"select doc_id, {word_count('text')} as words from documents"),
    "token_estimate": (over("documents", "doc_id", tokens=lambda: T.estimate_tokens(F.col("text"))), "select doc_id, cast(greatest(1, length(text) // 4) as bigint) as tokens from documents"),
    "sha256_provenance": (over("documents", "doc_id", sha256=lambda: T.sha256(F.col("text")), size_bytes=_long(lambda: F.octet_length("text"))), "select doc_id, sha256(text) as sha256, cast(octet_length(encode(text)) as bigint) as size_bytes from documents"),
    "pdf_date": (
        over("orders", "o_orderkey", iso=lambda: T.pdf_date(F.when(F.col("o_orderkey") % 3 == 0, F.lit("yesterday")).otherwise(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderkey") % 3 == 1, "1405").otherwise("")) ))),
        "select o_orderkey, case o_orderkey % 3 when 0 then null when 1 then strftime(o_orderdate, '%Y-%m-%d') || 'T14:05:00' else strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00' end as iso from orders",
    ),
    "furniture_key": (over("documents", "doc_id", key=lambda: T.generalise(F.concat(F.lit(" Page  "), F.col("doc_id").cast("string"), F.lit("\tof 12 "), F.substring("lang", 1, 2)))), "select doc_id, 'page # of # ' || lang as key from documents"),
    "page_number_line": (over("documents", "doc_id", number=lambda: T.is_page_number(F.element_at(F.array(F.lit(" Page 3 "), F.lit("12/40"), F.lit("page 3 of 9"), F.lit("chapter 3"), F.lit("12345")), (F.col("doc_id") % 5 + 1).cast("int")))), "select doc_id, doc_id % 5 < 3 as number from documents"),
    "archive_wanted": (_members, _MEMBERS_SQL),
    "longest_backtick_run": (over("documents", "doc_id", run=_long(lambda: T.longest_backtick_run(F.concat(F.lit("a`b"), F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")), F.lit(" ``")))) ), "select doc_id, cast(greatest(2, doc_id % 6) as bigint) as run from documents"),
    "inline_safe": (over("documents", "doc_id", digest=_digest(lambda: T.inline_safe(F.col("text")))), f"select doc_id, sha256({strip(f'''regexp_replace(text, '{BLANK}+', ' ', 'g')''')}) as digest from documents"),
    "overlap_tail": (over("documents", "doc_id", tail=lambda: T.tail(F.col("text"), 120)), "select doc_id, case when length(text) <= 120 then text when contains(right(text, 120), ' ') then substr(right(text, 120), instr(right(text, 120), ' ') + 1) else right(text, 120) end as tail from documents"),
    "paginate": (
        over("documents", "doc_id", digest=_digest(lambda: T.cut(_window(), 500, 1000))),
        f"""select doc_id, sha256(case when length(t) > 1500 and back > 0 and length({_CUT}) - back - 1 > length({_CUT}) // 2 then substr({_CUT}, 1, length({_CUT}) - back - 1) else {_CUT} end) as digest
        from (select doc_id, t, instr(reverse({_CUT}), chr(10) || chr(10)) as back from (select doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) as t from documents))""",
    ),
    "demote_headings": (_demoted, _DEMOTED_SQL),
    "detect_format": (_detect, _detect_sql()),
    "code_language": (lambda spark, d: _named(spark, d).select("doc_id", D.extension(F.col("filename")).alias("extension"), D.code_language(F.col("filename")).alias("lang")), None),
    "registry_resolve": (_resolve, _resolve_sql()),
    "formats_list": (lambda spark, d: D.supported_formats(D.parsers(spark)), f"select format, min_by(label, priority) as label from {_parsers_sql()} group by format"),
    "output_stems": (_stems, _STEMS_SQL),
}
