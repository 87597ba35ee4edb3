"""Line dedup: exact copies and near copies of lines within an edit distance.

Segment-partition join. A line of length l is split into threshold + 1 segments; a
line of length l to l + threshold within the threshold has one of them unchanged, at one of few
places. Segments make a length-aware index, substrings at those places probe it.
Candidates are verified by a banded bit-parallel edit distance.

Keys that many different lines share are not expanded into pairs. With the threshold 1
their lines get narrower keys: all but one window of the line; and, where a window is
still crowded, all but one character, of which every match is a link, so that a
star of links stands for the group. All steps are DataFrame functions.

Lines count as equal by a 64-bit hash. A line stays if it is the first of its class,
by doc_id, then by the hash of the text, then by line number; all others go.

Defined results: null text stays null; empty texts, and lines of fewer than
``MIN_LENGTH`` characters or without a word, are left as they are; rows that repeat
doc_id and text are one document and are treated alike; null doc_id comes first; lines
of any length are compared whole; an empty table gives an empty result; other columns,
whatever their names, are passed through untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Workspace, components, table

THRESHOLD = 1
MIN_LENGTH = 16
#: Different lines of one key that are expanded into pairs.
CROWD = 32
#: Windows of a line, at most, and their least width.
WINDOWS, WIDTH = 32, 16
#: Rows of one long each that may be broadcast: 16 MB.
SMALL = 1_000_000


def segments(length: Column, threshold: int) -> list[tuple[Column, Column]]:
    """(first place from 1, length) of each segment; lengths differ by one at most, the longer ones last."""
    parts = threshold + 1
    short, more = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    out, at = [], F.lit(1)
    for i in range(parts):
        size = short + F.when(more >= parts - i, 1).otherwise(0)
        out.append((at, size))
        at = at + size
    return out


def keys(line: Column, threshold: int) -> Column:
    """Array of (key, own): keys of the line's segments, and of the substrings that probe those of lines as long or shorter."""
    n = F.length(line)
    out = []
    for shift in range(threshold + 1):
        for i, (at, size) in enumerate(segments(n - shift, threshold)):
            low, high = max(-i, shift - (threshold - i)), min(i, shift + (threshold - i))
            for d in range(low, high + 1):
                key = F.xxhash64((n - shift).cast("int"), F.lit(i), F.substring(line, at + d, size))
                out.append(F.struct(key.alias("key"), F.lit(shift == 0 and d == 0).alias("own")))
    return F.array(*out)


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two strings is at most the threshold.

    Bit-parallel over the band of diagonals -threshold to threshold: after j
    characters of b, bit d of mask e tells whether the first j + d characters of a
    are within e edits of them. The threshold + 1 masks are packed into one long.
    """
    t, band = threshold, 2 * threshold + 1
    full = (1 << band) - 1
    n, m = F.length(a), F.length(b)

    def long(x: int) -> Column:
        return F.lit(x).cast("long")

    def step(chars: Column, state: Column, j: Column) -> Column:
        y = F.get(chars["y"], j)
        hit = reduce(lambda p, q: p.bitwiseOR(q), [F.when(F.get(chars["x"], j + d) == y, long(1 << (d + t))).otherwise(long(0)) for d in range(-t, t + 1)])

        def move(s: Column) -> Column:
            old, new, out = [], [], long(0)
            for e in range(t + 1):
                mask = F.shiftright(s["s"], e * band).bitwiseAND(full)
                got = mask.bitwiseAND(s["m"])
                if e:
                    got = got.bitwiseOR(old[-1]).bitwiseOR(F.shiftright(old[-1], 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(full)
                old.append(mask)
                new.append(got)
                out = out.bitwiseOR(F.shiftleft(got, e * band))
            return out

        return F.aggregate(F.array(F.struct(state.alias("s"), hit.alias("m"))), long(0), lambda _, s: move(s))

    start = sum(sum(1 << (d + t) for d in range(e + 1)) << (e * band) for e in range(t + 1))
    # The characters are bound once: an expression inside a lambda is evaluated anew at every step.
    chars = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")))
    last = F.get(F.transform(chars, lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c["y"]) - 1), long(start), lambda s, j: step(c, s, j))), F.lit(0))
    bit = F.shiftright(last, t * band).bitwiseAND(F.call_function("shiftleft", long(1), (n - m + t).cast("int")))
    return F.when(F.abs(n - m) > t, F.lit(False)).when(m == 0, n <= t).otherwise(bit != 0)


def exploded(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, at, line, h) of every line that takes part."""
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.where((F.length("line") >= MIN_LENGTH) & F.col("line").rlike(WORD)).withColumn("h", F.xxhash64("line"))


def _side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _width(length: Column) -> Column:
    return F.greatest(F.lit(WIDTH), F.ceil(length / WINDOWS)).cast("int")


def _windows(line: Column, shift: int) -> Column:
    """Array of (key, own, at, size): the line without one window, aligned to lines shorter by ``shift``."""
    n = (F.length(line) - shift).cast("int")
    w = _width(n)
    count = F.ceil(n / w).cast("int")

    def one(k: Column) -> Column:
        behind = F.greatest(F.lit(0), n - w * (k + 1))
        tail = F.when(behind > 0, F.substring(line, F.length(line) - behind + 1, behind)).otherwise("")
        key = F.xxhash64(n, k, F.substring(line, F.lit(1), w * k), tail)
        return F.struct(key.alias("key"), F.lit(shift == 0).alias("own"), (w * k).alias("at"), (F.length(line) - w * k - behind).cast("int").alias("size"))

    return F.transform(F.sequence(F.lit(0), count - 1), one)


def _pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of different lines of a key, one of which owns it. members: (key, h, own), few of each key."""
    l, r = members.where("own").alias("l"), members.alias("r")
    met = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.h") != F.col("r.h")))
    return met.select(F.least("l.h", "r.h").alias("a"), F.greatest("l.h", "r.h").alias("b"))


def _crowded(members: DataFrame) -> DataFrame:
    return members.groupBy("key").agg(F.count_distinct("h").alias("m")).where(F.col("m") > CROWD).select("key")


def links(space: Workspace, lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between hashes of different lines within the threshold; of crowded groups as stars."""
    listed = lines.select("h", "line", F.inline(keys(F.col("line"), threshold)))
    live = listed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("own").alias("own")).where("lo <> hi and own").select("key")
    live = space.store(live)
    if live.count() <= SMALL:  # a broadcast moves no lines, so the texts come along
        members = space.store(listed.join(F.broadcast(live), "key").select("key", "h", "own", "line"))
        found = members.select("h", "line")
    else:  # a shuffle takes the hashes alone, and each text once
        members = space.store(listed.select("key", "h", "own").join(live, "key"))
        found = lines.select("h", "line").join(members.select("h").distinct(), "h", "left_semi")
    texts = space.store(found.groupBy("h").agg(F.first("line").alias("line")))
    few = members.groupBy("key", "h").agg(F.max("own").alias("own"))
    few = space.store(few)
    crowded = space.store(_crowded(few))
    many = crowded.count()
    if threshold != 1:  # the narrower keys are those of a single edit
        many = 0
    calm = few.join(_side(crowded, many), "key", "left_anti") if many else few
    pairs, stars = _pairs(calm), None
    if many:
        again = few.join(_side(crowded, many), "key", "left_semi").select("h").distinct().join(texts, "h")
        cut = again.select("h", "line", F.inline(F.concat(_windows(F.col("line"), 0), _windows(F.col("line"), 1))))
        cut = space.store(cut)
        thick = space.store(_crowded(cut))
        n_thick = thick.count()
        narrow = cut.select("key", "h", "own")
        pairs = pairs.union(_pairs(narrow.join(_side(thick, n_thick), "key", "left_anti") if n_thick else narrow))
        if n_thick:
            last = cut.join(_side(thick, n_thick), "key", "left_semi")
            stars = _stars(last)
    pairs = pairs.distinct()
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("lb")), "b")
    found = both.where(within(F.col("la"), F.col("lb"), threshold)).select("a", "b")
    out = space.store(found if stars is None else found.union(stars))
    space.drop(members)
    return out


def _stars(crowd: DataFrame) -> DataFrame:
    """Links of lines that differ in one window, all characters of which are left out in turn.

    Lines that are equal but for one character in the same place, or of which one
    has one character more, get equal keys, and lines with equal keys are within one
    edit of each other. A line's own key at a place is the line without that
    character; one without it altogether is keyed by itself.
    """
    spot = F.explode(F.sequence(F.col("at") + 1, F.col("at") + F.greatest(F.lit(1), F.col("size"))))
    each = crowd.select("h", "line", "own", spot.alias("p")).where(F.col("p") <= F.length("line")).distinct()
    rest = F.concat(F.substring("line", F.lit(1), F.col("p") - 1), F.substring("line", F.col("p") + 1, F.length("line")))
    same_place = each.select(F.xxhash64(F.col("p"), F.length("line"), rest).alias("key"), "h")
    shorter = each.select(F.xxhash64(F.lit("one more"), rest).alias("key"), "h", F.lit(False).alias("itself"))
    itself = crowd.select(F.xxhash64(F.lit("one more"), "line").alias("key"), "h", F.lit(True).alias("itself")).distinct()
    swapped = same_place.join(same_place.groupBy("key").agg(F.min("h").alias("head")), "key").where("h <> head").select("h", "head")
    # All that a shorter line can be got from by one removal are linked to that line.
    added = shorter.select("key", "h").join(itself.select("key", F.col("h").alias("head")), "key").where("h <> head").select("h", "head")
    return swapped.union(added).select(F.least("h", "head").alias("a"), F.greatest("h", "head").alias("b")).distinct()


def removals(space: Workspace, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, gone, near): the numbers of the lines to remove, and how many of them equal no earlier line."""
    lines = exploded(docs)
    comps = components(space, links(space, lines, threshold)).select(F.col("node").alias("h"), F.col("component").alias("class"))
    comps = space.store(comps)
    place = F.struct("doc_id", "text_hash", "at")
    spots = lines.select("doc_id", "text_hash", "at", "h").join(_side(comps, comps.count()), "h", "left").withColumn("class", F.coalesce("class", "h"))
    first = spots.groupBy("class", "h").agg(F.min(place).alias("own_first"), F.max(place).alias("own_last"))
    top = first.groupBy("class").agg(F.min("own_first").alias("top"), F.count("*").alias("kinds"), F.max("own_last").alias("end")).where("top <> end")
    top = space.store(top)
    gone = spots.join(top.select("class", "top", "kinds"), "class").where(place != F.col("top"))
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("gone"), F.count(F.when((F.col("kinds") > 1) & (F.col("h") != F.col("class")), 1)).alias("near"))


def cleaned(space: Workspace, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs, its text without the removed lines, and lines_before, lines_gone."""
    gone = space.settle(removals(space, docs, threshold))
    d = docs.alias("d")
    # By a shuffle at every size: what is removed grows with the input.
    g = gone.select(F.col("doc_id").alias("g_doc"), F.col("text_hash").alias("g_hash"), F.col("gone").alias("g_gone")).hint("merge").alias("g")
    joined = d.join(g, (F.xxhash64("d.text") == F.col("g_hash")) & F.col("d.doc_id").eqNullSafe(F.col("g_doc")), "left")
    parts = F.split("d.text", "\n")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("g_gone", i)), "\n")
    text = F.when(F.col("g_gone").isNull(), F.col("d.text")).otherwise(kept)
    others = [F.col(f"d.`{c}`") for c in docs.columns if c != "text"]
    return joined.select(*others, text.alias("text"), F.coalesce(F.size(parts), F.lit(0)).alias("lines_before"), F.coalesce(F.size("g_gone"), F.lit(0)).alias("lines_gone"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = cleaned(Workspace(spark, "line_dedup"), docs)
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("lines_before")).cast("long").alias("n_lines"), F.col("lines_gone").cast("long").alias("n_removed"), "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows; those of which nothing is left go."""
    out = cleaned(Workspace(spark, "line_dedup"), docs)
    out = out.where((F.col("lines_gone") == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lines_gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def sql() -> str:
    """Every pair of lines of about one length that agree in either half, in DuckDB's SQL."""
    return rf"""
    with recursive l as (
        select doc_id, unnest(generate_series(0, len(l) - 1)) as pos, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)
    ), t as (select * from l where length(line) >= {MIN_LENGTH} and regexp_matches(line, '[^\x20\x09-\x0D]')),
    d as materialized (select distinct line, length(line) as n from t),
    k as (
        select line, n, s, substr(line, 1, (n - s) // 2) as head, right(line, (n - s) - (n - s) // 2) as tail from d, (select unnest([0, 1]) as s)
    ), p as (
        select a.line as a, b.line as b from k a join k b on a.s = 0 and a.n = b.n - b.s and a.head = b.head and a.line <> b.line
        union select a.line, b.line from k a join k b on a.s = 0 and a.n = b.n - b.s and a.tail = b.tail and a.line <> b.line
    ), e as materialized (select a, b from p where levenshtein(a, b) <= {THRESHOLD} union select b, a from p where levenshtein(a, b) <= {THRESHOLD}),
    reach as (select a as line, a as c from e union select e.b, r.c from reach r join e on r.line = e.a),
    c as (select line, min(c) as class from reach group by line),
    f as (select doc_id, pos, row_number() over (partition by coalesce(class, t.line) order by doc_id, pos) as k from t left join c on t.line = c.line)
    select x.doc_id, count(l.pos) as n_lines, count(f.k) filter (f.k > 1) as n_removed, case when x.text is null then null else coalesce(string_agg(l.line, chr(10) order by l.pos) filter (f.k is null or f.k = 1), '') end as text
    from documents x left join l on x.doc_id = l.doc_id left join f on l.doc_id = f.doc_id and l.pos = f.pos group by x.doc_id, x.text"""
