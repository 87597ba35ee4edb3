"""JSON and delimited text as columns: what of a value is a table, its columns, its scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERLAP = 0.7


def scalar(v: Column) -> Column:
    """A JSON scalar, given as its JSON text, as a cell shows it."""
    return F.when(v.isNull() | (v == "null"), "").when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v)


def object_pairs(json: Column) -> Column:
    """Array of (k, v) of a flat object in source order, v as text."""
    return F.transform(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: F.struct(e["key"].alias("k"), F.coalesce(e["value"], F.lit("")).alias("v")))


def parse_lines(text: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, line_no, value, bad): JSON Lines, each line by itself; blank lines go."""
    rows = text.select(key, F.posexplode(F.split(column, "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    parsed = F.try_parse_json(F.col("line"))
    return rows.select(key, "line_no", F.col("line").alias("value"), parsed.isNull().alias("bad"))


def key_overlap(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, overlap, is_table): how alike the key sets of a document's records are. records: key, row, keys (array).

    Shares are added in the order of ``row``, so the mean is the same double whatever
    the partitions; one sort by key and row, and nothing of a document but its sum is kept.
    """
    w = Window.partitionBy(key).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = records.select(key, "row", "keys", F.first("keys").over(w).alias("first"))
    share = F.size(F.array_intersect("first", "keys")) / F.greatest(F.lit(1), F.size(F.array_union("first", "keys")))
    rows = rows.select(key, "row", F.size("first").alias("width"), share.alias("share")).withColumns({"n": F.count("*").over(w), "total": F.sum("share").over(w)})
    last = rows.groupBy(key).agg(F.max(F.struct("n", "total", "width")).alias("last")).select(key, "last.*")
    return last.select(key, "n", (F.col("total") / F.col("n")).alias("overlap"), "width").select(key, "n", "overlap", ((F.col("n") >= 2) & (F.col("width") > 0) & (F.col("overlap") > OVERLAP)).alias("is_table"))


def columns(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, col, name): the union of the records' keys, in the order in which they are first seen."""
    each = records.select(key, "row", F.posexplode("keys").alias("pos", "name"))
    first = each.groupBy(key, "name").agg(F.min(F.struct("row", "pos")).alias("at"))
    return first.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).alias("col"), "name")


def delimiter(sample: Column) -> Column:
    """The most frequent of comma, semicolon, tab and bar, the first of them at a tie; a comma if there is none."""
    marks = (",", ";", "\t", "|")
    counts = F.array(*[F.struct((F.length(sample) - F.length(F.replace(sample, F.lit(m), F.lit("")))).alias("n"), F.lit(-i).alias("rank"), F.lit(m).alias("mark")) for i, m in enumerate(marks)])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["mark"]).otherwise(",")


def csv_records(line: Column, mark: str = ",") -> Column:
    """Cells of one line without quoted line feeds; doubled quotes inside quotes are one."""
    cell = f'(?:^|{"[|]" if mark == "|" else mark})("(?:[^"]|"")*"|[^{mark}"]*)'
    raw = F.regexp_extract_all(line, F.lit(cell), F.lit(1))
    return F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
