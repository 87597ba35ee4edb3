"""Registered queries of layout inference, chunking, measures and streaming, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout as L
from ..operators import measure as M
from ..operators import text_blocks as B
from ..options import ConvertOptions
from . import chunk as C
from .queries_tables import _blocks_sql, _found
from .queries_text import BLANK, _heading_sql, read, strip, word_count

# -- a relation of page lines: four lines of a document make a page, most pages get a running header and a page number --


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    cast = lambda c: c.cast("long")
    body = base.select(
        "doc_id", cast(F.floor(F.col("i") / 4) + 1).alias("page"), cast(F.col("i") % 4 + 1).alias("line_no"),
        F.when(F.col("i") % 7 == 0, 18.0).when(F.col("i") % 7 == 3, 14.0).otherwise(11.0).alias("size"), (F.col("i") % 5 == 0).alias("bold"),
        F.when(F.col("i") % 6 == 4, F.concat(F.lit("- "), "x")).when(F.col("i") % 6 == 5, F.concat(F.lit("2) "), "x")).otherwise(F.col("x")).alias("text"),
    )
    pages = body.select("doc_id", "page").distinct()
    top = pages.where("doc_id % 3 <> 0 and page % 5 <> 4").select("doc_id", "page", F.lit(0).cast("long").alias("line_no"), F.lit(8.0).alias("size"), F.lit(False).alias("bold"), F.concat(F.lit("Annual  Report "), F.col("page").cast("string")).alias("text"))
    foot = pages.select("doc_id", "page", F.lit(9).cast("long").alias("line_no"), F.lit(8.0).alias("size"), F.lit(False).alias("bold"), F.concat(F.lit("Page "), F.col("page").cast("string")).alias("text"))
    return body.unionByName(top).unionByName(foot)


_LINES = """(
    with b as (select doc_id, unnest(generate_series(0, len(l) - 1)) as i, unnest(l) as x from (select doc_id, string_split(text, chr(10)) as l from documents)),
    body as (select doc_id, i // 4 + 1 as page, i % 4 + 1 as line_no, cast(case i % 7 when 0 then 18.0 when 3 then 14.0 else 11.0 end as double) as size, i % 5 = 0 as bold,
        case i % 6 when 4 then '- ' || x when 5 then '2) ' || x else x end as text from b),
    pages as (select distinct doc_id, page from body)
    select * from body union all select doc_id, page, 0, 8.0, false, 'Annual  Report ' || page from pages where doc_id % 3 <> 0 and page % 5 <> 4 union all select doc_id, page, 9, 8.0, false, 'Page ' || page from pages)"""


def _norm_sql(x: str) -> str:
    return f"lower({strip(f'''regexp_replace({x}, '{BLANK}+', ' ', 'g')''')})"


def _key_sql(x: str) -> str:
    return f"regexp_replace({_norm_sql(x)}, '[0-9]+', '#', 'g')"


_BODY = f"""(with s as (select doc_id, size, cast(sum(greatest(1, length(text))) as bigint) as w, min(page * 100 + line_no) as f from {_LINES} group by doc_id, size),
    r as (select *, row_number() over (partition by doc_id order by w desc, f) as k from s) select doc_id, size as body from r where k = 1)"""
_LEVELS = f"""(with b as (select distinct l.doc_id, l.size from {_LINES} l join {_BODY} b on l.doc_id = b.doc_id where b.body > 0 and l.size > b.body * 1.12),
    r as (select *, row_number() over (partition by doc_id order by size desc) as level from b) select * from r where level <= 4)"""
_FURNITURE = f"""(with e as (select *, row_number() over (partition by doc_id, page order by line_no) as top, row_number() over (partition by doc_id, page order by line_no desc) as bottom from {_LINES}),
    k as (select doc_id, page, {_key_sql('text')} as key from e where top <= 2 or bottom <= 2),
    t as (select doc_id, max(page) as total from {_LINES} group by doc_id),
    s as (select doc_id, key, count(distinct page) as pages from k where key <> '' and length(key) < 120 group by all)
    select s.doc_id, key, pages from s join t on s.doc_id = t.doc_id where total >= 2 and pages >= case when total < 4 then total else greatest(3, floor(total * 0.6)) end)"""
_PAGE_NUMBER = "(?i)^(page[ \\t]+)?[0-9]{1,4}([ \\t]*(of|/)[ \\t]*[0-9]{1,4})?$"
_KEPT = f"""(select l.* from (select *, {_key_sql('text')} as key from {_LINES}) l left join {_FURNITURE} f on l.doc_id = f.doc_id and l.key = f.key where f.key is null and {strip('text')} <> '' and not regexp_matches({strip('text')}, '{_PAGE_NUMBER}'))"""


def _rows(spark, d) -> DataFrame:
    """(doc_id, lines): the lines of a document in its row."""
    return L.by_document(_lines(spark, d).withColumn("y", F.col("line_no") * 10.0))


def _keys(lines: str = "lines"):
    return F.transform(L.running_furniture(F.col(lines)), lambda r: r["key"])


def _kept(spark, d):
    rows = _rows(spark, d).withColumn("kept", L.without_furniture(F.col("lines"), _keys()))
    return rows.select("doc_id", F.inline("kept")).select("doc_id", F.col("page").cast("long").alias("page"), F.col("line_no").cast("long").alias("line_no"), "size", "text")


def _levelled(spark, d):
    rows = _rows(spark, d).withColumn("kept", L.without_furniture(F.col("lines"), _keys())).withColumn("body", L.body_size(F.col("lines")))
    rows = rows.withColumn("sizes", L.heading_sizes(F.col("lines"), F.col("body")))
    return rows.select("doc_id", L.levelled(F.col("kept"), F.col("body"), F.col("sizes")).alias("lines"))


def _levels(spark, d):
    rows = _levelled(spark, d).select("doc_id", F.inline("lines")).where("level is not null")
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("page", "line_no", "level")])


_LEVELLED = f"""(select k.*, b.body, cast(case when s.level is not null and k.size > b.body * 1.12 then s.level when k.bold and k.size >= b.body and {_heading_sql('k.text', 10)} then 3 end as bigint) as level
    from {_KEPT} k join {_BODY} b on k.doc_id = b.doc_id left join {_LEVELS} s on k.doc_id = s.doc_id and k.size = s.size)"""


def _reflowed(spark, d):
    runs = _levelled(spark, d).select("doc_id", F.inline(L.reflow(F.col("lines"))))
    seq = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line_no"))
    text = F.when(F.col("kind").isin("list", "ordered_list"), F.array_join("texts", "\n")).otherwise(F.array_join("texts", " "))
    return runs.select("doc_id", F.col("page").cast("long").alias("page"), seq.cast("long").alias("seq"), "kind", F.col("level").cast("long").alias("level"), text.alias("text"))


_BULLET, _NUMBERED, _END = "^[ \\t]*[-*•·‣▪◦●○][ \\t]+", "^[ \\t]*[0-9]{1,2}[.)][ \\t]+", "[.!?:;\"”]$"
_REFLOWED = f"""
    with k as (select *, case when regexp_matches(text, '{_BULLET}') then 'list' when regexp_matches(text, '{_NUMBERED}') and not {_heading_sql('text')} then 'ordered_list' when level is not null then 'heading' else 'paragraph' end as kind from {_LEVELLED}),
    s as (select *, lag(kind) over w as bk, lag(text) over w as bt from k window w as (partition by doc_id, page order by line_no)),
    g as (select *, cast(sum(case when bk is null or bk <> kind or kind = 'heading' or (kind = 'paragraph' and regexp_matches(bt, '{_END}')) then 1 else 0 end) over (partition by doc_id, page order by line_no rows unbounded preceding) as bigint) as seq from s),
    t as (select *, case kind when 'list' then {strip(f"regexp_replace(text, '{_BULLET}', '')")} when 'ordered_list' then {strip(f"regexp_replace(text, '{_NUMBERED}', '')")} else text end as t from g)
    select doc_id, page, seq, kind, case when kind = 'heading' then max(level) end as level, case when kind in ('list', 'ordered_list') then string_agg(t, chr(10) order by line_no) else string_agg(t, ' ' order by line_no) end as text from t group by doc_id, page, seq, kind"""


def _outlined(spark, d):
    lines = _lines(spark, d)
    outline = lines.where("line_no = 1").select("doc_id", "page", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), F.concat(F.lit(" "), F.col("text"), F.lit("\t")).alias("title"), F.col("page").alias("p"))
    outline = outline.select("doc_id", "page", "seq", (F.col("p") % 8 + F.col("seq")).cast("int").alias("level"), "title")
    return L.outline_levels(lines, outline).where("outline_level is not null").select("doc_id", "page", "line_no", F.col("outline_level").cast("long").alias("outline_level"))


_OUTLINED = f"""select l.doc_id, l.page, l.line_no, cast(greatest(1, least(6, l.page % 8 + 2)) as bigint) as outline_level from {_LINES} l
    join (select doc_id, page, {_norm_sql("text")} as norm from {_LINES} where line_no = 1) o on l.doc_id = o.doc_id and l.page = o.page and {_norm_sql('l.text')} = o.norm where o.norm <> ''"""


def _boxed(spark, d):
    lines = _lines(spark, d).where("line_no between 1 and 4")
    x = lines.select("doc_id", "page", "line_no", (F.col("line_no") * 10.0).alias("x0"), (F.col("line_no") * 10.0 + F.length("text")).alias("x1"), (F.col("line_no") * 20.0).alias("y0"), (F.col("line_no") * 20.0 + 12).alias("y1"))
    boxes = lines.where("line_no = 2").select("doc_id", "page", F.lit(0.0).alias("x0"), F.lit(70.0).alias("x1"), F.lit(40.0).alias("y0"), (F.lit(60.0) + F.col("page") % 3 * 10).alias("y1"))
    return L.outside_boxes(x, boxes).select("doc_id", "page", "line_no")


_BOXED = f"""select l.doc_id, l.page, l.line_no from {_LINES} l where line_no between 1 and 4 and not exists (select 1 from {_LINES} b where b.line_no = 2 and b.doc_id = l.doc_id and b.page = l.page
    and l.line_no * 10.0 + length(l.text) / 2.0 between -2 and 72 and l.line_no * 20.0 + 6 between 38 and 62 + b.page % 3 * 10)"""


def _interleaved(spark, d):
    lines = _lines(spark, d)
    tables = lines.where("line_no in (2, 4)").select("doc_id", "page", (F.col("line_no") * 10.0 - 5 * (F.col("page") % 2)).alias("y"), F.col("line_no").alias("table_no"))
    return L.interleave_tables(lines.withColumn("y", F.col("line_no") * 10.0), tables)


_INTERLEAVED = f"""select doc_id, page, row_number() over (partition by doc_id, page order by y, rank, ref) as seq, kind, ref from (
    select doc_id, page, line_no * 10.0 as y, 1 as rank, 'line' as kind, line_no as ref from {_LINES} union all select doc_id, page, line_no * 10.0 - 5 * (page % 2), 0, 'table', line_no from {_LINES} where line_no in (2, 4))"""


def _scanned(spark, d):
    shown = lambda x: x["line_no"].isin(0, 9) | (x["page"] % 2 == F.col("doc_id") % 2)
    rows = _rows(spark, d).withColumn("kept", L.without_furniture(F.filter("lines", shown), _keys()))
    pages = rows.select("doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["page"]))).alias("page"))
    return L.scanned(rows.select("doc_id", F.inline("kept")), pages)


_SCANNED = f"""with k as (select distinct doc_id, page from {_KEPT} where line_no in (0, 9) or page % 2 = doc_id % 2), p as (select distinct doc_id, page from {_LINES}),
    s as (select p.doc_id, count(*) filter (k.page is null) as empty_pages, count(*) as pages from p left join k on p.doc_id = k.doc_id and p.page = k.page group by p.doc_id)
    select doc_id, empty_pages, empty_pages > 0 and empty_pages >= greatest(1, pages // 2) as looks_scanned from s"""

# -- chunking ------------------------------------------------------------------------------------------------------


def _sections(spark, d):
    """Lines as blocks: every fifth is a heading of a level from 1 to 4, every seventh a page break."""
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    i = F.col("pos")
    return rows.select("doc_id", i.cast("long").alias("pos"), "text", F.when(i % 5 == 0, (i * 7 + F.col("doc_id")) % 4 + 1).cast("int").alias("level"), F.when(i % 7 == 3, i).cast("int").alias("page"))


_SECTIONS = """(select doc_id, i as pos, x as text, case when i % 5 = 0 then cast((i * 7 + doc_id) % 4 + 1 as integer) end as level, case when i % 7 = 3 then cast(i as integer) end as page
    from (select doc_id, unnest(generate_series(0, len(l) - 1)) as i, unnest(l) as x from (select doc_id, string_split(text, chr(10)) as l from documents)))"""


def _paths(spark, d):
    return C.heading_path(_sections(spark, d)).select("doc_id", "pos", F.array_join("path", " > ").alias("path"))


def _paths_sql() -> str:
    last = lambda k, what: f"last_value(case when level = {k} then {what} end ignore nulls) over w"
    cols = ", ".join(f"{last(k, 'text')} as h{k}, {last(k, 'pos')} as p{k}, last_value(case when level < {k} then pos end ignore nulls) over w as o{k}" for k in (1, 2, 3, 4))
    parts = ", ".join(f"case when p{k} is not null and (o{k} is null or p{k} > o{k}) then h{k} end" for k in (1, 2, 3, 4))
    return f"select doc_id, pos, array_to_string(list_filter([{parts}], lambda x: x is not null and x <> ''), ' > ') as path from (select doc_id, pos, {cols} from {_SECTIONS} window w as (partition by doc_id order by pos rows unbounded preceding))"


def _packed(spark, d):
    units = _sections(spark, d).select("doc_id", "pos", "text", F.lit("prose").alias("kind"), F.col("level").isNotNull().alias("is_heading"))
    return C.packed(units, 500).select("doc_id", "pos", "grp")


_PACKED = f"""
    with recursive u as (select doc_id, pos, cast(length(text) as bigint) as n, level is not null as h, length(text) > 750 as alone from {_SECTIONS}),
    r as (
        select doc_id, pos, case when alone then 0 else n + 2 end as size, cast(0 as bigint) as grp, alone as shut from u where pos = 0
        union all
        select u.doc_id, u.pos, case when u.alone then 0 when moved then u.n + 2 else r_size + u.n + 2 end, r_grp + case when moved then 1 else 0 end, u.alone
        from (select u.*, r.size as r_size, r.grp as r_grp, not (r.size = 0 and not r.shut) and ((u.h and not u.alone and r.size > 175) or (r.size > 0 and r.size + u.n > 500) or r.shut or u.alone) as moved from r join u on u.doc_id = r.doc_id and u.pos = r.pos + 1) u)
    select doc_id, pos, grp from r"""


def _split_pieces(spark, d):
    table = F.concat(F.lit("| a |\n| --- |\n| "), F.replace("text", F.lit("\n"), F.lit(" |\n| ")), F.lit(" |"))
    units = read(spark, d, "documents").select("doc_id", F.lit(0).alias("pos"), table.alias("text"), F.lit("table").alias("kind"), F.lit(False).alias("is_heading"))
    return C.packed(units, 600).select("doc_id", "piece", F.sha2("text", 256).alias("digest"))


_SPLIT = """
    with recursive l as (select doc_id, unnest(generate_series(0, len(l) - 1)) as i, unnest(l) as x from (select doc_id, list_transform(string_split(text, chr(10)), lambda x: '| ' || x || ' |') as l from documents)),
    r as (
        select doc_id, i, x, cast(0 as bigint) as piece, cast(length(x) + 1 as bigint) as size from l where i = 0
        union all
        select l.doc_id, l.i, l.x, r.piece + case when r.size + 14 + length(l.x) > 600 then 1 else 0 end, case when r.size + 14 + length(l.x) > 600 then 0 else r.size end + length(l.x) + 1 from r join l on l.doc_id = r.doc_id and l.i = r.i + 1),
    t as (select doc_id, sum(length(x) + 1) + 13 > 900 as long from l group by doc_id)
    select doc_id, case when long then piece else 0 end as piece, sha256('| a |' || chr(10) || '| --- |' || chr(10) || string_agg(x, chr(10) order by i)) as digest from r join t using (doc_id) group by all"""


def _overlap(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = _sections(spark, d).withColumn("prose", F.col("pos") % 3 != 0)
    prefix = F.when(F.col("prose") & F.coalesce(F.lag("prose").over(w), F.lit(False)), T.tail(F.lag("text").over(w), 60)).otherwise("")
    return rows.select("doc_id", "pos", F.coalesce(prefix, F.lit("")).alias("prefix"))


_OVERLAP = f"""select doc_id, pos, case when pos % 3 <> 0 and b % 3 <> 0 then case when length(t) <= 60 then t when contains(right(t, 60), ' ') then substr(right(t, 60), instr(right(t, 60), ' ') + 1) else right(t, 60) end else '' end as prefix
    from (select *, lag(text) over w as t, lag(pos) over w as b from {_SECTIONS} window w as (partition by doc_id order by pos))"""


def _documents(spark, d):
    docs = _found(spark, d, F.col("source").alias("title"), F.concat("source", F.lit("-"), "lang", F.lit(".txt")).alias("filename"), F.sha2("text", 256).alias("sha256"))
    return docs.select("doc_id", "title", F.lit(False).alias("passthrough"), B.as_blocks(F.col("found")).alias("blocks"), "filename", "sha256", F.lit("text").alias("format"))


def _chunks(spark, d):
    out = C.chunks(_documents(spark, d), ConvertOptions(chunk_size=600, chunk_overlap=80))
    return out.select("doc_id", "id", F.col("index").cast("long").alias("index"), F.sha2("text", 256).alias("digest"), F.array_join("heading_path", " > ").alias("heading_path"), F.col("char_count").cast("long").alias("char_count"), "token_estimate")


def _token_totals(spark, d):
    return C.chunks(_documents(spark, d)).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_estimate").alias("total_tokens"))


# -- measures ------------------------------------------------------------------------------------------------------


def _measured(spark, d):
    return M.headline(M.measure(_documents(spark, d)))


_MEASURED = f"""with b as ({_blocks_sql()}), m as (select doc_id, count(*) filter (kind = 'heading') as headings, count(*) filter (kind in ('list', 'ordered_list')) as lists,
        cast(sum(case when kind in ('list', 'ordered_list') then len(string_split(items, chr(31))) else 0 end) as bigint) as list_items,
        cast(sum(case when kind in ('list', 'ordered_list') then {word_count('items')} else {word_count('text')} end) as bigint) as words from (select * replace (replace(items, chr(31), ' ' || chr(31)) as items) from b) group by doc_id)
    select doc_id, headings, 0::bigint as tables, 0::bigint as table_cells, lists, list_items, 0::bigint as code_blocks, 0::bigint as pages, 0::bigint as images, 0::bigint as running_headers_removed, words,
        case when headings = 0 and list_items = 0 then 'Structure preserved, provenance attached.' else 'Recovered ' || array_to_string(list_filter([case when headings > 0 then headings || ' headings' end, case when list_items > 0 then list_items || ' list items' end], lambda x: x is not null), ', ') || '.' end as headline
    from m"""


def _histogram(spark, d):
    return M.histogram(_documents(spark, d))


def _summary(spark, d):
    rows = read(spark, d, "documents").select(F.col("lang").alias("format"), (F.col("doc_id") % 13 == 0).alias("failed"), T.word_count(F.col("text")).alias("words"), (F.col("doc_id") % 4).alias("chunks"), (F.col("doc_id") % 3).alias("warnings"))
    return M.batch_summary(rows)


_SUMMARY = f"""select lang as format, count(*) filter (doc_id % 13 <> 0) as converted, count(*) filter (doc_id % 13 = 0) as failed, cast(sum({word_count('text')}) as bigint) as words, cast(sum(doc_id % 4) as bigint) as chunks, cast(sum(doc_id % 3) as bigint) as warnings
    from documents group by rollup (lang)"""


def _compared(spark, d):
    """The plain text of a page against what the block walk recovers, per page."""
    from ..operators import html_facts as H

    pages = read(spark, d, "pages")
    baseline = H.strip_tags(F.col("html"))
    kept = H.strip_tags(H.drop_chrome(F.col("html")))
    return pages.select("page_id", T.word_count(baseline).alias("baseline_words"), T.word_count(kept).alias("kept_words"), F.size(H.elements(F.col("html"), "h1")).cast("long").alias("headings"), F.size(H.links(H.drop_chrome(F.col("html")))).cast("long").alias("links"))


def _compared_sql() -> str:
    from .queries_tables import _chrome_sql, _strip_tags_sql

    return f"""select page_id, {word_count(_strip_tags_sql('html'))} as baseline_words, {word_count(_strip_tags_sql('c'))} as kept_words, cast(len(regexp_extract_all(html, '(?is)<h1(?: [^>]*)?>(.*?)</h1>', 1)) as bigint) as headings,
        cast(len(list_filter(regexp_extract_all(c, '(?is)<a [^>]*?href="([^"]*)"[^>]*>.*?</a>', 1), lambda h: not starts_with(lower(h), 'javascript:'))) as bigint) as links from (select *, {_chrome_sql()} as c from pages)"""


def _dirty_md():
    """A Markdown text around all lines of the document, with a fault here and there."""
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(T.escape_line(x), "[ \\t]+$", "")), "\n")
    fence = F.when(F.col("doc_id") % 2 == 0, F.lit("```\ncode  \n```\n")).otherwise(F.lit("```\nopen\n"))
    table = F.when(F.col("doc_id") % 3 == 0, F.lit("| a | b |\n| --- |\n")).otherwise(F.lit("| a | b |\n| --- | --- |\n| x \\| y | z |\n"))
    head = F.when(F.col("doc_id") % 5 == 0, F.lit("####### seven\n")).otherwise(F.lit("## two\n"))
    blank = F.when(F.col("doc_id") % 7 == 0, F.lit("text  \n")).otherwise(F.lit("text\n"))
    return F.concat(F.lit("---\ntitle: x \n---\n"), head, table, blank, F.when(F.col("doc_id") % 11 == 0, F.lit("\x07\n")).otherwise(F.lit("")), body, F.lit("\n"), fence)


def _validated(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(M.problems(_dirty_md()), ",").alias("problems"))


_VALIDATED = """select doc_id, array_to_string(list_filter([case when doc_id % 2 = 1 then 'open_fence' end, case when doc_id % 3 = 0 then 'ragged_table' end, case when doc_id % 5 = 0 then 'bad_heading' end,
    case when doc_id % 7 = 0 then 'trailing_blank' end, case when doc_id % 11 = 0 then 'control_character' end], lambda x: x is not null), ',') as problems from documents"""


def _kinds(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(M.line_kinds(_dirty_md())).alias("k")).groupBy("doc_id", F.col("k.kind").alias("kind")).agg(F.count("*").alias("n"))


_KINDS = """with l as (select doc_id, unnest(['fm', 'h', 'tbl', 'text', 'fence']) as kind, unnest([3, case when doc_id % 5 = 0 then 0 else 1 end, case when doc_id % 3 = 0 then 2 else 3 end,
        1 + case when doc_id % 5 = 0 then 1 else 0 end + case when doc_id % 11 = 0 then 1 else 0 end + case when doc_id % 2 = 0 then 1 else 0 end, case when doc_id % 2 = 0 then 3 else 3 end]) as n, len(string_split(text, chr(10))) as lines from documents)
    select doc_id, kind, cast(case kind when 'text' then n + lines else n end as bigint) as n from l where n > 0"""


def _excerpts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(M.excerpt(F.concat("text", F.lit("\n## near\n"), _dirty_md())), 256).alias("digest"))


def _guards(spark, d):
    from ..sources.archive import guards

    m = read(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("archive_id"), (F.col("l_quantity") * 1e5).cast("long").alias("file_size"), (F.col("l_quantity") * (F.col("l_orderkey") % 50)).cast("long").alias("compress_size"))
    return guards(m).select("archive_id", "members", "file_size", "compress_size", "breach")


_GUARDS = """with m as (select l_orderkey % 50 as archive_id, cast(l_quantity * 1e5 as bigint) as f, cast(l_quantity * (l_orderkey % 50) as bigint) as c from lineitem),
    s as (select archive_id, count(*) as members, cast(sum(f) as bigint) as file_size, greatest(1, cast(sum(c) as bigint)) as compress_size from m group by archive_id)
    select archive_id, members, file_size, compress_size, case when file_size > 419430400 then 'bytes' when file_size > 200 * compress_size then 'ratio' when members > 500 then 'members' end as breach from s"""


def _sessions(spark, d):
    from ..streaming.windows import sessions

    return sessions(read(spark, d, "events"), "30 minutes").select("user_id", F.col("start").alias("session_start"), F.col("end").alias("session_end"), "n")


_SESSIONS = """with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as s from events),
    g as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from o)
    select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from g group by user_id, k"""

QUERIES = {
    "body_size_mode": (lambda s, d: _rows(s, d).select("doc_id", L.body_size(F.col("lines")).alias("body")), f"select * from {_BODY}"),
    "heading_size_rank": (lambda s, d: _rows(s, d).select("doc_id", F.posexplode(L.heading_sizes(F.col("lines"), L.body_size(F.col("lines")))).alias("k", "size")).select("doc_id", "size", (F.col("k") + 1).cast("long").alias("level")), f"select * from {_LEVELS}"),
    "running_furniture": (lambda s, d: _rows(s, d).select("doc_id", F.inline(L.running_furniture(F.col("lines")))), f"select * from {_FURNITURE}"),
    "drop_furniture": (lambda s, d: _kept(s, d).select("doc_id", "page", "line_no"), f"select doc_id, page, line_no from {_KEPT}"),
    "heading_level": (_levels, f"select doc_id, page, line_no, level from {_LEVELLED} where level is not null"),
    "outline_join": (_outlined, _OUTLINED),
    "box_anti_join": (_boxed, _BOXED),
    "table_interleave": (_interleaved, _INTERLEAVED),
    "paragraph_reflow": (_reflowed, _REFLOWED),
    "scanned_pages": (_scanned, _SCANNED),
    "page_carry": (lambda s, d: C.carry_page(_sections(s, d)).select("doc_id", "pos", F.col("page").cast("long").alias("page")), f"select doc_id, pos, cast(last_value(page ignore nulls) over (partition by doc_id order by pos rows unbounded preceding) as bigint) as page from {_SECTIONS}"),
    "heading_path": (_paths, _paths_sql()),
    "chunk_pack": (_packed, _PACKED),
    "chunk_split_oversized": (_split_pieces, _SPLIT),
    "chunk_overlap": (_overlap, _OVERLAP),
    "chunk_materialize": (_chunks, None),
    "token_totals": (_token_totals, None),
    "measure_headline": (_measured, _MEASURED),
    "block_histogram": (_histogram, f"select doc_id, case kind when 'ordered_list' then 'list' else kind end as type, count(*) as n from ({_blocks_sql()}) group by all"),
    "batch_summary": (_summary, _SUMMARY),
    "baseline_compare": (_compared, _compared_sql()),
    "md_validate": (_validated, _VALIDATED),
    "md_line_kinds": (_kinds, _KINDS),
    "md_excerpt": (_excerpts, None),
    "archive_guards": (_guards, _GUARDS),
    "events_session_window": (_sessions, _SESSIONS),
}
