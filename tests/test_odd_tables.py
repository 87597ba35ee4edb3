"""Registered queries against their SQL on tables with what the made tables lack."""

import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sheafwork.functions import tables as TB
from sheafwork.plans.registry import QUERIES

BLANK = ["", " \n\t\n", "\n\n", "a line\nHEADING", "TITLE", "- one\n- two", None]


def documents(texts, n_chars=None):
    n = len(texts)
    return pa.table({
        "doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": ["web"] * n,
        "n_chars": pa.array(n_chars or [len(t or "") for t in texts], pa.int64()),
    })


def agrees(spark, folder, name, **tables):
    run, sql = QUERIES[name]
    duck = duckdb.connect()
    duck.execute("set threads=1")  # the order of a sum of doubles
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        duck.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    df = run(spark, str(folder))
    got = sorted(map(tuple, df.collect()), key=repr)
    want = sorted(duck.execute(f"select {', '.join(df.columns)} from ({sql})").fetchall(), key=repr)
    assert got and got == want


@pytest.mark.parametrize("name", ["lift_title", "md_document", "measure_headline", "block_histogram"])
def test_documents_without_a_block(spark, tmp_path, name):
    agrees(spark, tmp_path, name, documents=documents(BLANK))


def test_delimited_files_of_long_lines_and_of_other_marks(spark, tmp_path):
    texts = ["y" * 140_000, "a\n" + "word " * 30_000, '  \n|"a; \n";":word\',\' \t| |word"', "x | y; z\n" * 30, '"|"|" \t a', "plain\nlines"]
    agrees(spark, tmp_path, "parse_csv", documents=documents(texts))


def test_sizes_halfway_between_two_tenths(spark, tmp_path):
    # the query multiplies by 997 and by the squares of 1 to 4; 64 makes quarters of a KB
    agrees(spark, tmp_path, "human_bytes", documents=documents([""] * 2000, [64 * (k + 1) for k in range(1000)] + [65_536 * (k + 1) for k in range(500)] + [2**26 * (k + 1) for k in range(500)]))


def test_mean_overlap_halfway_between_two_roundings(spark, tmp_path):
    """Whichever way the rows are spread over files, a mean is that of its rows in order."""
    n = 64 * 1000
    rows = pa.table({"event_id": pa.array(range(n), pa.int64()), "user_id": pa.array([i * 7 % 1009 for i in range(n)], pa.int64())})
    agrees(spark, tmp_path, "json_table_like", events=rows)
    run = QUERIES["json_table_like"][0]
    spread = tmp_path / "spread" / "events.parquet"
    spread.mkdir(parents=True)
    for k in range(4):
        pq.write_table(rows.take(pa.array(range(k, n, 4))), spread / f"{k}.parquet")
    assert sorted(run(spark, str(spread.parent)).collect()) == sorted(run(spark, str(tmp_path)).collect())


def test_long_tables_in_time_that_grows_as_they_do(spark):
    """Each row once asked for the width of all rows: 60,000 rows took minutes."""
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.array(i.cast("string"), F.lit("x"))).alias("rows"))
    header = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    begun = time.monotonic()
    made = rows.select(F.size(TB.normalized(F.col("rows"), TB.width(F.col("rows")))), F.length(TB.html_table(header, F.col("rows"))), F.length(TB.csv_table(header, F.col("rows")))).first()
    assert made[0] == 60_000 and time.monotonic() - begun < 30
