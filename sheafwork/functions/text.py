"""Text hygiene as column expressions; every function maps a string column to a column."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded

# Characters that cleaning writes out, in order.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))
SMART = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("…", "..."), ("\u00a0", " "))

BLANK = "[ \\t\\n\\r\\f\\x0B]"


def strip(c: Column) -> Column:
    """Without white space at either end (trim() knows spaces only)."""
    return F.btrim(c, F.lit(" \t\n\r\f\x0b"))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), na_action="ignore")


def nfkc(c: Column) -> Column:
    bounded()
    return _nfkc(c)


def fold_ascii(c: Column) -> Column:
    bounded()
    return _fold_ascii(c)


def decode(content: Column) -> Column:
    """Bytes to text: UTF-8 with or without a byte order mark, else Latin-1."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\ufeff", "")


def clean_folded(c: Column, join_hyphens: bool = False) -> Column:
    """Cleaning of text that is already in NFKC, in the JVM alone."""
    single = [(old, new) for old, new in LIGATURES + SMART if len(new) == 1]
    c = F.translate(c, "".join(old for old, _ in single), "".join(new for _, new in single))
    longer = [(old, new) for old, new in LIGATURES + SMART if len(new) > 1]
    written = c
    for old, new in longer:
        written = F.replace(written, F.lit(old), F.lit(new))
    c = F.when(c.rlike("[" + "".join(old for old, _ in longer) + "]"), written).otherwise(c)  # few texts need these passes
    c = F.regexp_replace(c, "\\r\\n?", "\n")
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    if join_hyphens:
        c = F.regexp_replace(c, "(?U)(\\w)-\\n(\\w)", "$1$2")
    c = F.regexp_replace(c, "[ \\t]{2,}", " ")
    return strip(F.regexp_replace(c, "\\n{3,}", "\n\n"))


def clean(c: Column, join_hyphens: bool = False) -> Column:
    return clean_folded(nfkc(c), join_hyphens)


def escape_md(c: Column) -> Column:
    return F.regexp_replace(c, "([\\\\`*_{}\\[\\]<>|])", "\\\\$1")


def escape_cell(c: Column) -> Column:
    for old, new in (("\\", "\\\\"), ("|", "\\|"), ("\n", "<br>")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return strip(c)


_BREAK_LINE = "^[ \\t]{0,3}(" + "|".join(f"{m}[ \\t]*({m}[ \\t]*)+" for m in ("-", "\\*", "_", "=")) + ")$"
_BLOCK_START = "^[ \\t]{0,3}(#{1,6}([ \\t]|$)|```|~~~|\\||>|[-+*][ \\t]|[0-9]{1,9}[.)][ \\t])"


def escape_line(line: Column) -> Column:
    risky = line.rlike(_BREAK_LINE) | line.rlike(_BLOCK_START)
    return F.when(risky, F.regexp_replace(line, "^([ \\t]{0,3})", "$1\\\\")).otherwise(line)


def escape_block_start(c: Column) -> Column:
    """Keeps lines of text from becoming Markdown structure."""
    return F.array_join(F.transform(F.split(c, "\n"), escape_line), "\n")


def slugify_ascii(c: Column, most: int = 60) -> Column:
    c = F.lower(strip(F.regexp_replace(c, f"[^A-Za-z0-9_ \\t\\n\\r\\f\\x0B-]", "")))
    c = F.regexp_replace(c, f"[- \\t\\n\\r\\f\\x0B]+", "-")
    c = F.regexp_replace(F.substring(c, 1, most), "^-+|-+$", "")
    return F.when(c == "", "untitled").otherwise(c)


def slugify(c: Column, most: int = 60) -> Column:
    return slugify_ascii(fold_ascii(c), most)


def basename(c: Column) -> Column:
    return F.regexp_replace(c, "^.*/", "")


def title_from_filename(c: Column) -> Column:
    stem = F.regexp_replace(basename(c), "\\.[^.]*$", "")
    stem = strip(F.regexp_replace(F.regexp_replace(stem, "[_-]+", " "), f"{BLANK}+", " "))
    return F.when(stem == "", "Untitled").otherwise(F.concat(F.upper(F.substring(stem, 1, 1)), F.substring(stem, F.lit(2), F.length(stem))))


def words(c: Column) -> Column:
    """White-space separated words; none in an empty text."""
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0)).cast("long")


def looks_like_heading(c: Column, most_words: int = 14) -> Column:
    """Short, no closing punctuation, and numbered or mostly in capitals."""

    def of(s: Column) -> Column:
        letters, capitals = F.regexp_count(s, F.lit("\\p{L}")), F.regexp_count(s, F.lit("\\p{Lu}"))
        short = (s != "") & (F.length(s) <= 120) & (word_count(s) <= most_words) & ~s.rlike("[.,;:]$")
        numbered = s.rlike(f"^([0-9]+(\\.[0-9]+)*|[IVXLC]+\\.|[A-Z]\\.){BLANK}+[^ \\t\\n\\r\\f\\x0B]")
        return short & (numbered | ((letters > 0) & (capitals * 10 > letters * 7)))

    return let(strip(c), of)


def safe_name(c: Column, fallback: str = "file") -> Column:
    c = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^.*/", "")
    c = F.substring(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]", "_"), "^\\.+", ""), 1, 120)
    return F.when(c == "", fallback).otherwise(c)


def human_bytes(n: Column) -> Column:
    """In whole numbers, as the size in tenths of a unit may lie halfway between two; such halves go to the even digit, as printf has it."""
    n = n.cast("long")

    def shown(bits: int, name: str) -> Column:
        rest = n % (1 << bits) * 10
        tenths = F.shiftright(n, bits) * 10 + F.shiftright(rest, bits)
        twice = rest % (1 << bits) * 2
        tenths = tenths + F.when((twice > 1 << bits) | ((twice == 1 << bits) & (tenths % 2 == 1)), 1).otherwise(0)
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(name))

    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, shown(10, " KB"))
        .when(n < 1024**3, shown(20, " MB"))
        .otherwise(shown(30, " GB"))
    )


NUMERIC = "^-?[0-9,]*\\.?[0-9]+[ \\t\\n\\r\\f\\x0B]*%?$|^[($]-?[0-9,]*\\.?[0-9]+[)]?$"


def is_numeric(c: Column) -> Column:
    return strip(c).rlike(NUMERIC)


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def pdf_date(c: Column) -> Column:
    """D:YYYYMMDDhhmmss to an ISO date and time; missing parts of the time are 00."""
    p = "^D:([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})?([0-9]{2})?([0-9]{2})?"
    part = lambda i: F.lpad(F.regexp_extract(c, p, i), 2, "0")
    day = F.concat_ws("-", *[F.regexp_extract(c, p, i) for i in (1, 2, 3)])
    return F.when(c.rlike(p), F.concat(day, F.lit("T"), F.concat_ws(":", part(4), part(5), part(6))))


def normal_line(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, f"{BLANK}+", " ")))


def generalise(c: Column) -> Column:
    """The key under which running headers and footers are counted: numbers are one sign."""
    return F.regexp_replace(normal_line(c), "[0-9]+", "#")


def is_page_number(c: Column) -> Column:
    return strip(c).rlike("(?i)^(page[ \\t]+)?[0-9]{1,4}([ \\t]*(of|/)[ \\t]*[0-9]{1,4})?$")


# Archive members that are never converted.
IGNORED_PREFIXES = ("__MACOSX/", ".git/", "node_modules/", ".venv/")
IGNORED_NAMES = (".DS_Store", "Thumbs.db", ".gitignore")
# Folders that a directory scan passes over.
SKIPPED_FOLDERS = (".git", "node_modules", ".venv", "venv", "__pycache__", ".next", "dist", "build")


def wanted_member(c: Column) -> Column:
    bad = c.endswith("/") | c.startswith("/") | c.rlike("(^|/)\\.\\.(/|$)") | basename(c).isin(*IGNORED_NAMES)
    for p in IGNORED_PREFIXES:
        bad = bad | c.startswith(p) | c.contains(f"/{p}")
    return ~bad


def longest_backtick_run(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))


def inline_safe(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{BLANK}+", " "))


def tail(c: Column, n: int) -> Column:
    """The last n characters, from the first word that begins in them."""
    end = F.right(c, F.lit(n))
    return F.when(F.length(c) <= n, c).when(F.instr(end, " ") > 0, F.substring(end, F.instr(end, " ") + 1, F.length(end))).otherwise(end)


def cut(c: Column, offset: int, most: int) -> Column:
    """A window of the text, ended at the last blank line of its second half if there is one and more follows."""
    piece = F.substring(c, offset + 1, most)
    back = F.locate("\n\n", F.reverse(piece))  # from the end
    at = F.length(piece) - back - 1
    more = F.length(c) > offset + most
    return F.when(more & (back > 0) & (at > F.floor(F.length(piece) / 2)), F.substring(piece, F.lit(1), at)).otherwise(piece)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fence_positions(lines: Column, marks: str = "```|~~~") -> Column:
    """Positions of the lines that open or close a code fence."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(f"^[ \\t]*({marks})"), i)), lambda i: i.isNotNull())


def demote_headings(c: Column, by: int) -> Column:
    """ATX headings outside code fences, ``by`` levels deeper, six at most."""

    def line(x: Column, i: Column, fences: Column) -> Column:
        level = F.length(F.regexp_extract(x, "^(#{1,6})[ \\t]", 1))
        deeper = F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), level + by)), F.substring(x, level + 1, F.length(x)))
        return F.when((level > 0) & (F.size(F.filter(fences, lambda f: f < i)) % 2 == 0), deeper).otherwise(x)

    return F.array_join(let(F.split(c, "\n"), lambda xs: let(fence_positions(xs), lambda fences: F.transform(xs, lambda x, i: line(x, i, fences)))), "\n")
