"""Table shaping on ``array<array<string>>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape_cell, is_numeric, strip

ROWS = "array<array<string>>"
_EMPTY = "cast(array() as array<array<string>>)"


def _any(row: Column) -> Column:
    return F.exists(row, lambda c: c != "")


def width(rows: Column, header: Column | None = None) -> Column:
    sizes = F.transform(rows, lambda r: F.size(r))
    most = F.coalesce(F.array_max(sizes), F.lit(0))
    return F.greatest(most, F.coalesce(F.size(header), F.lit(0))) if header is not None else most


def pad(row: Column, n: Column) -> Column:
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(F.lit(0), n - F.size(row)).cast("int")))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, though an expression uses it often."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def normalized(rows: Column, n: Column) -> Column:
    """All rows padded to n cells; n, which may have to be found in all rows, is computed once."""
    return _let(n, lambda k: F.transform(rows, lambda r: pad(r, k)))


def trim(rows: Column) -> Column:
    """Cells stripped, nulls empty, without empty rows at either end and without empty columns, all rows of one width."""

    def ends(cells: Column) -> Column:
        full = F.transform(cells, _any)
        first = F.array_position(full, F.lit(True))
        last = F.size(cells) - F.array_position(F.reverse(full), F.lit(True)) + 1
        return F.when(first > 0, F.slice(cells, first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.expr(_EMPTY))

    def used(kept: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(width(kept) - 1, F.lit(0)))
        filled = F.filter(places, lambda i: F.exists(kept, lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
        return F.struct(kept.alias("kept"), filled.alias("used"))

    cells = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    return _let(_let(_let(cells, ends), used), lambda x: F.transform(x["kept"], lambda r: F.transform(x["used"], lambda i: F.coalesce(F.get(r, i), F.lit("")))))


def has_header(rows: Column, hint: Column | None = None) -> Column:
    """Whether the first row is a header: by the source's hint, else if it is full and holds no number."""
    first, body = F.get(rows, F.lit(0)), F.slice(rows, 2, 1 << 30)
    possible = (F.size(rows) >= 2) & F.exists(first, lambda c: strip(c) != "") & F.exists(body, lambda r: F.exists(r, lambda c: strip(c) != ""))
    looks = F.forall(first, lambda c: (strip(c) != "") & ~is_numeric(c))
    decided = looks if hint is None else F.coalesce(hint, looks)
    return F.coalesce(possible & decided, F.lit(False))


def alignments(rows: Column, n: Column) -> Column:
    """``---:`` for each column whose filled cells, at least one, are all numbers, else ``---``."""

    def one(i: Column) -> Column:
        cells = F.filter(F.transform(rows, lambda r: F.coalesce(F.get(r, i), F.lit(""))), lambda c: strip(c) != "")
        return F.when((F.size(cells) > 0) & F.forall(cells, is_numeric), "---:").otherwise("---")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)).otherwise(F.array().cast("array<string>"))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def pipe_table(header: Column, rows: Column, caption: Column | None = None) -> Column:
    """A pipe table; without a header its header row is blank."""

    def drawn(x: Column) -> Column:
        n, body = x["n"], x["body"]
        top = F.when(F.coalesce(F.size(header), F.lit(0)) > 0, pad(header, n)).otherwise(F.array_repeat(F.lit(""), n))
        made = [F.array(_line(F.transform(top, escape_cell)), _line(alignments(body, n))), F.transform(body, lambda r: _line(F.transform(r, escape_cell)))]
        return F.when(n > 0, F.array_join(F.concat(*made), "\n")).otherwise("")

    shaped = _let(width(rows, header), lambda n: F.struct(n.alias("n"), normalized(rows, n).alias("body")))
    text = _let(shaped, drawn)
    if caption is None:
        return text
    return F.when((caption != "") & (text != ""), F.concat(F.lit("**"), caption, F.lit("**\n\n"), text)).otherwise(text)


def _html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_table(header: Column, rows: Column) -> Column:
    n = width(rows, header)
    cells = lambda r, tag: F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), _html(c), F.lit(f"</{tag}>"))), "")
    top = F.when(F.coalesce(F.size(header), F.lit(0)) > 0, F.array(F.concat(F.lit("<thead><tr>"), cells(pad(header, n), "th"), F.lit("</tr></thead>")))).otherwise(F.array().cast("array<string>"))
    body = F.transform(normalized(rows, n), lambda r: F.concat(F.lit("<tr>"), cells(r, "td"), F.lit("</tr>")))
    return F.array_join(F.concat(F.array(F.lit("<table>")), top, F.array(F.lit("<tbody>")), body, F.array(F.lit("</tbody></table>"))), "\n")


def csv_table(header: Column, rows: Column) -> Column:
    """A fenced block of comma-separated values; quotes are doubled and lines end in CRLF inside."""
    n = width(rows, header)
    cell = lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = lambda r: F.array_join(F.transform(r, cell), ",")
    top = F.when(F.coalesce(F.size(header), F.lit(0)) > 0, F.array(line(pad(header, n)))).otherwise(F.array().cast("array<string>"))
    lines = F.array_join(F.concat(top, F.transform(normalized(rows, n), line)), "\r\n")
    return F.concat(F.lit("```csv\n"), strip(lines), F.lit("\n```"))


def number_display(value: Column, number_format: Column) -> Column:
    """A spreadsheet number as its cell shows it: percent, currency, whole, or the shortest decimal."""
    decimals = F.length(F.regexp_extract(number_format, "\\.(0+)", 1))
    symbol = F.regexp_extract(number_format, "([$€£¥₹])", 1)

    def fixed(v: Column, d: Column) -> Column:
        """At most three decimals; halves go to the even digit."""
        shown = [F.format_string(f"%,.{k}f", F.bround(v, k)) for k in range(4)]
        return F.when(d == 0, shown[0]).when(d == 1, shown[1]).when(d == 2, shown[2]).otherwise(shown[3])

    size = F.abs(value)
    sign = F.when(value < 0, "-").otherwise("")
    plain = F.when(value == F.floor(value), value.cast("decimal(30,0)").cast("string")).otherwise(F.regexp_replace(value.cast("decimal(38,10)").cast("string"), "0+$", ""))
    return (
        F.when(number_format.contains("%"), F.concat(sign, F.replace(fixed(size * 100, decimals), F.lit(","), F.lit("")), F.lit("%")))
        .when(symbol != "", F.concat(sign, symbol, fixed(size, decimals)))
        .otherwise(plain)
    )
