"""The whole way over DataFrames: documents, Markdown, chunks, sinks, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

import sheafwork
from sheafwork.operators.measure import problems
from sheafwork.options import ConvertOptions
from sheafwork.plans import chunk, render
from sheafwork.schema import BLOCK_STRUCT
from sheafwork.sources import samples
from sheafwork.sources.model import block, table

FILES = "doc_id long, filename string, content binary, size_bytes long"


@pytest.fixture(scope="module")
def files(spark):
    text = "Hello world line.\nSecond line é.\nThird: x | y"
    rows = [(i, f"my_file-{i}.{k}", bytearray(samples.build(k, text)), len(samples.build(k, text))) for i, k in enumerate(samples.KINDS)]
    return spark.createDataFrame([*rows, (99, "empty.txt", bytearray(b""), 0), (100, "lie.txt", bytearray(samples.build("docx", text)), 1)], FILES)


def test_convert(spark, files):
    out = {r["doc_id"]: r for r in sheafwork.convert(files, converted_at="2024-01-01T00:00:00Z").collect()}
    assert len(out) == len(samples.KINDS) + 2
    assert out[99]["error"]["code"] == "parse_error" and out[99]["markdown"] is None
    assert out[100]["format"] == "docx"
    for r in out.values():
        if r["error"] is None:
            assert r["markdown"].startswith("---\n") and r["markdown"].endswith("\n") and not r["markdown"].endswith("\n\n")
            assert r["title"]


def test_markdown_is_sound_and_repeatable(spark, files):
    docs = sheafwork.convert(files, ConvertOptions(frontmatter=False)).where("error is null").select("doc_id", "markdown")
    assert docs.where(F.size(problems(F.col("markdown"))) > 0).count() == 0
    assert sorted(docs.collect()) == sorted(docs.collect())


def test_verbs(spark, files):
    assert sheafwork.formats(spark).count() == 20
    assert {r["detection"]["format"] for r in sheafwork.detect(files).collect()} >= {"docx", "zip", "epub", "image", "code"}
    text = "\n\n".join(f"Paragraph {i} of the text." for i in range(200))
    whole = spark.createDataFrame([(1, text)], "doc_id long, markdown string")
    at, got = 0, ""
    while at is not None:
        r = sheafwork.window(whole, at, 1000).first()
        got, at = got + r["text"], r["next_offset"]
    assert got == text


def test_one(spark):
    r = sheafwork.one(spark, b"# T\n\ntext", "a.md")
    assert "# T" in r["markdown"]
    with pytest.raises(sheafwork.SourceError):
        sheafwork.one(spark, b"", "a.md")


def doc_of(spark, blocks, title="T"):
    rows = [(1, title, False, blocks, "report.txt", "abc", "text")]
    return spark.createDataFrame(rows, f"doc_id long, title string, passthrough boolean, blocks array<{BLOCK_STRUCT}>, filename string, sha256 string, format string")


def test_chunks_keep_structure(spark):
    rows = [[f"name {i}", str(i)] for i in range(200)]
    blocks = [block("heading", "One", level=1), block("paragraph", "word " * 60), block("heading", "Two", level=2), table(rows, header=["k", "v"]), block("code", "\n".join(f"line {i}" for i in range(300)), lang="py"), block("page_break", page=4), block("paragraph", "last.")]
    out = sorted(chunk.chunks(doc_of(spark, blocks), ConvertOptions(chunk_size=500, chunk_overlap=50)).collect(), key=lambda r: r["index"])
    assert [r["index"] for r in out] == list(range(len(out))) and out[0]["id"] == "reporttxt-0000"
    tables = [r for r in out if r["text"].startswith("| k")]
    assert len(tables) > 3 and all(r["heading_path"] == ["T", "One", "Two"] for r in tables)
    code = [r for r in out if r["text"].startswith("```py")]
    assert len(code) > 3 and all(r["text"].endswith("```") for r in code)
    assert out[-1]["pages"] == [4] and all(r["char_count"] <= 800 for r in out)


def test_render_formats(spark):
    t = table([["a,b", '"q"'], ["1", "<x>"]], header=["h", "i"])
    for fmt, want in (("csv", '"a,b"'), ("html", "&lt;x&gt;"), ("pipe", "| h | i |")):
        md = render.markdown(doc_of(spark, [t]), ConvertOptions(table_format=fmt)).first()["markdown"]
        assert want in md
    md = render.markdown(doc_of(spark, [block("list", items=[(0, "a", None), (1, "b", True), (0, "c", None)], ordered=True)], None)).first()["markdown"]
    assert md == "1. a\n  - [x] b\n2. c\n"
    long = block("paragraph", "word " * 40)
    assert max(map(len, render.markdown(doc_of(spark, [long]), ConvertOptions(wrap_width=40)).first()["markdown"].split("\n"))) <= 40
    repeated = render.markdown(doc_of(spark, [block("heading", "t", level=1), block("rule")])).first()["markdown"]
    assert repeated == "# t\n\n---\n"


def test_sinks_and_reading(spark, files, tmp_path):
    (tmp_path / "in" / "node_modules").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# A\n\ntext")
    (tmp_path / "in" / "node_modules" / "b.md").write_text("no")
    read = sheafwork.files(spark, str(tmp_path / "in"))
    assert [r["filename"] for r in read.collect()] == ["a.md"]
    docs = sheafwork.convert(read)
    sheafwork.write_tables(docs, sheafwork.chunks(read), str(tmp_path / "out"))
    sheafwork.write_jsonl(sheafwork.chunks(read), str(tmp_path / "jsonl"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "jsonl")).collect()]
    assert lines[0]["source"]["filename"] == "a.md" and lines[0]["index"] == 0
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == len(lines)


def test_documents_as_json(spark, files):
    docs = sheafwork.documents(files).where("error is null")
    want = {r["doc_id"]: r for r in docs.collect()}
    got = {r["doc_id"]: json.loads(r["json"]) for r in sheafwork.document_json(docs).collect()}
    assert set(got) == set(want)
    for k, d in got.items():
        row = want[k]
        assert d["title"] == row["title"] and d["warnings"] == row["warnings"] and len(d["assets"]) == len(row["assets"]) and d["metadata"] == json.loads(row["metadata"])
        assert [b["type"] for b in d["blocks"]] == [b["type"] for b in row["blocks"]]
        for b, r in zip(d["blocks"], row["blocks"], strict=True):
            if b["type"] == "table":
                assert b["content"]["rows"] == r["rows"] and b["content"].get("header") == (r["header"] or None)
            elif b["type"] == "list":
                assert [i["text"] for i in b["content"]] == [i["text"] for i in r["items"]] and b["metadata"]["ordered"] == r["ordered"]
            elif b["type"] == "key_values":
                assert b["content"] == {p["k"]: p["v"] for p in r["kv"]}
            elif b["type"] not in ("rule", "page_break"):
                assert b["content"] == (r["text"] or "") and b.get("level") == r["level"]


def test_baselines(spark, files):
    got = {r["filename"]: r for r in sheafwork.compare(files).collect()}
    assert "Hello world line." in got["my_file-0.txt"]["baseline"]
    by = {name.rpartition(".")[2]: r for name, r in got.items() if name != "lie.txt"}
    for kind in ("docx", "pptx", "xlsx", "html", "pdf", "md", "csv"):
        assert "Second line é." in by[kind]["baseline"], kind
    assert "first" not in by["docx"]["baseline"] and by["docx"]["tables"] == 1  # the table is not in its paragraphs
    assert "menu" in by["html"]["baseline"] and "menu" not in by["html"]["markdown"]
    assert by["pdf"]["headline"].startswith("Recovered 1 table")


def test_receipts_and_large_files(spark, files):
    import sheafwork.sources.read as reading

    docs = sheafwork.convert(files)
    rows = {r["doc_id"]: r for r in sheafwork.receipts(docs, sheafwork.chunks(files)).collect()}
    assert rows[99]["error"]["code"] == "parse_error" and rows[0]["chunks"] > 0 and rows[0]["characters"] > 0
    big = spark.createDataFrame([(1, "a.txt", None, 3 << 30)], FILES)
    assert sheafwork.convert(big).first()["error"]["code"] == "file_too_large"
    assert reading.LARGEST < 1 << 31


def test_large_files_are_rows(spark, tmp_path, monkeypatch):
    import sheafwork.sources.read as reading

    monkeypatch.setattr(reading, "LARGEST", 10)
    (tmp_path / "a.txt").write_text("small")
    (tmp_path / "b.txt").write_text("a text of more than ten bytes")
    got = {r["filename"]: (r["content"], r["size_bytes"]) for r in sheafwork.files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (b"small", 5), "b.txt": (None, 29)}


def test_stream_ingest_once(spark, tmp_path):
    from sheafwork.streaming.ingest import ingest

    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "a.txt").write_text("TITLE\n\nsome text.")
    (tmp_path / "land" / "copy.txt").write_text("TITLE\n\nsome text.")
    args = (spark, str(tmp_path / "land"), str(tmp_path / "out"), str(tmp_path / "check"))
    ingest(*args).awaitTermination(120)
    (tmp_path / "land" / "b.txt").write_text("OTHER\n\nmore text.")
    os.utime(tmp_path / "land" / "b.txt", (1e9, 1e9))  # an old file is new here
    ingest(*args).awaitTermination(120)
    rows = [r for p in (tmp_path / "out").glob("batch=*/documents") for r in spark.read.parquet(str(p)).collect()]
    assert sorted(r["title"] for r in rows) == ["OTHER", "TITLE"]


def test_stream_windows(spark, tmp_path):
    from sheafwork.streaming.windows import sessions, tumbling

    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")], "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    assert sorted(r["n"] for r in sessions(events, "30 minutes").collect()) == [1, 1, 2]
    assert tumbling(events, "1 hour").count() == 2
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = tumbling(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").count() == 2


def test_command_line(spark, tmp_path, capsys):
    from sheafwork.cli import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\ntext")
    (tmp_path / "in" / "b.doc").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")
    path = str(tmp_path / "in")
    assert main(["version"]) == 0 and main(["formats"]) == 0
    assert main(["convert", path], spark) == 2  # several files need a folder
    assert main(["convert", f"{path}/a.md"], spark) == 0
    assert "# A" in capsys.readouterr().out
    assert main(["convert", path, "--out", str(tmp_path / "out"), "--chunk", "--ir", "--bundles"], spark) == 0
    assert "Legacy Office" in capsys.readouterr().err
    assert (tmp_path / "out" / "bundles" / "a" / "a.md").read_text().endswith("# A\n\ntext\n")
    ir = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out" / "documents_json")).collect()]
    assert [(d["source"]["filename"], d["blocks"][0]["type"]) for d in ir] == [("a.md", "raw")]
    assert main(["inspect", path], spark) == 0
    assert main(["convert", f"{path}/b.doc"], spark) == 1
