"""Writing results: tables, JSON Lines, Markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunk import to_jsonl


def unique_stems(names: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``stem``, different for each row: the name without its extension, then with it, then with a number."""
    base, ext = F.regexp_replace(name, "\\.[^.]*$", ""), F.regexp_extract(name, "\\.([^.]*)$", 1)
    rows = names.withColumn("base", base).withColumn("ext", ext)
    first = rows.groupBy("base").agg(F.min_by("ext", key).alias("first_ext"))
    rows = rows.join(first, "base")
    k = F.row_number().over(Window.partitionBy("base").orderBy(key))
    ke = F.row_number().over(Window.partitionBy("base", "ext").orderBy(key))
    stem = F.when(k == 1, F.col("base")).when((ke == 1) & (F.col("ext") != F.col("first_ext")), F.concat_ws("-", "base", "ext")).otherwise(F.concat_ws("-", "base", "ext", ke.cast("string")))
    return rows.withColumn("stem", stem).drop("base", "ext", "first_ext")


def write_documents(documents: DataFrame, path: str) -> None:
    """documents and, each row apart, their assets as Parquet under one folder. Documents are computed once, the assets are cut from what was written."""
    spark = documents.sparkSession
    documents.write.mode("overwrite").parquet(f"{path}/whole")
    whole = spark.read.schema(documents.schema).parquet(f"{path}/whole")
    whole.drop("assets").write.mode("overwrite").parquet(f"{path}/documents")
    whole.select("doc_id", F.explode("assets").alias("a")).select("doc_id", "a.*").write.mode("overwrite").parquet(f"{path}/assets")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/whole")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_chunks(chunk_rows: DataFrame, path: str) -> None:
    chunk_rows.write.mode("overwrite").parquet(f"{path}/chunks")


def write_tables(documents: DataFrame, chunk_rows: DataFrame, path: str) -> None:
    """documents, assets and chunks as Parquet under one folder."""
    write_documents(documents, path)
    write_chunks(chunk_rows, path)


def write_jsonl(chunk_rows: DataFrame, path: str) -> None:
    to_jsonl(chunk_rows).write.mode("overwrite").text(path)


def document_json(documents: DataFrame) -> DataFrame:
    """(doc_id, json): each document as one JSON object of title, source, metadata, blocks, assets without their bytes, and warnings.

    A block has type, content, level and metadata; what content is follows from the type.
    """
    def item(x):
        return F.struct(x["depth"].alias("depth"), x["text"].alias("text"), x["checked"].alias("checked"))

    def content(b):
        as_json = lambda c: F.to_json(c, {"ignoreNullFields": "true"})
        table = as_json(F.struct(b["rows"].alias("rows"), F.when(F.size(b["header"]) > 0, b["header"]).alias("header"), b["caption"].alias("caption")))
        pairs = as_json(F.map_from_arrays(F.transform(b["kv"], lambda p, i: F.concat(p["k"], F.repeat(F.lit("\x00"), i))), F.transform(b["kv"], lambda p: p["v"])))
        # A map can't hold a key twice, so the keys carry their number while it is one.
        pairs = F.replace(pairs, F.lit("\\u0000"), F.lit(""))
        quoted = F.regexp_extract(F.to_json(F.struct(F.coalesce(b["text"], F.lit("")).alias("x"))), "(?s)^\\{\"x\":(.*)\\}$", 1)
        return (F.when(b["type"] == "table", table).when(b["type"] == "list", as_json(F.transform(b["items"], item))).when(b["type"] == "key_values", pairs).when(b["type"].isin("rule", "page_break"), "null").otherwise(quoted))

    def block(b):
        facts = F.to_json(F.struct(b["page"].alias("page"), b["label"].alias("label"), b["lang"].alias("lang"), b["ordered"].alias("ordered"), b["src"].alias("src")))
        level = F.when(b["level"].isNotNull(), F.concat(F.lit(',"level":'), b["level"].cast("string"))).otherwise("")
        return F.concat(F.lit('{"type":"'), b["type"], F.lit('","content":'), content(b), level, F.when(facts != "{}", F.concat(F.lit(',"metadata":'), facts)).otherwise(""), F.lit("}"))

    head = F.to_json(F.struct("title", F.struct("filename", "format", F.col("detection.media_type").alias("media_type"), F.col("size_bytes").alias("bytes"), "sha256").alias("source")), {"ignoreNullFields": "false"})
    assets = F.to_json(F.transform("assets", lambda a: F.struct(a["asset_id"].alias("asset_id"), a["filename"].alias("filename"), a["media_type"].alias("media_type"), F.octet_length(a["data"]).alias("bytes"), a["width"].alias("width"), a["height"].alias("height"))))
    out = F.concat(
        F.regexp_replace(head, "\\}$", ""), F.lit(',"metadata":'), F.coalesce("metadata", F.lit("{}")), F.lit(',"blocks":['), F.array_join(F.transform("blocks", block), ","),
        F.lit('],"assets":'), assets, F.lit(',"warnings":'), F.to_json("warnings"), F.lit("}"),
    )
    return documents.where("error is null").select("doc_id", out.alias("json"))


def write_json(documents: DataFrame, path: str) -> None:
    """document_json, one object in a line."""
    document_json(documents).select("json").write.mode("overwrite").text(path)


def write_markdown(documents: DataFrame, path: str) -> None:
    """(stem, markdown) as Parquet. documents: stem, markdown. ``bundles`` makes files of it."""
    documents.select("stem", "markdown").write.mode("overwrite").parquet(path)


def receipts(documents: DataFrame, chunk_rows: DataFrame | None = None) -> DataFrame:
    """What became of each file: format, title, counts of blocks, words, characters, assets and chunks, warnings, error."""
    from ..operators.measure import block_words

    words = F.aggregate(F.transform("blocks", block_words), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    out = documents.select(
        "doc_id", "filename", "format", F.col("detection.via").alias("detected_via"), "title", F.size("blocks").alias("blocks"), words.alias("words"),
        (F.length("markdown") if "markdown" in documents.columns else F.lit(None).cast("int")).alias("characters"), F.size("assets").alias("assets"), "warnings", "error",
    )
    if chunk_rows is None:
        return out.withColumn("chunks", F.lit(0).cast("long"))
    return out.join(chunk_rows.groupBy("doc_id").agg(F.count("*").alias("chunks")), "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long")))


def bundles(documents: DataFrame, path: str, chunk_rows: DataFrame | None = None) -> DataFrame:
    """A folder for each document, written by the workers into a folder that all of them see: ``stem.md``, ``assets/`` and ``stem.chunks.jsonl``.

    documents: doc_id, stem, markdown, assets. Returns (doc_id, written): the files.
    For corpora use write_tables; a file for each document is for what people open.
    """
    import os

    import pyarrow as pa

    rows = documents.select("doc_id", "stem", "markdown", F.transform("assets", lambda a: F.struct(a["filename"], a["data"])).alias("assets"))
    if chunk_rows is not None:
        lines = chunk_rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", F.to_json(F.struct("id", "index", "text", "heading_path", "pages", "char_count", "token_estimate", "source"), {"ignoreNullFields": "false"}).alias("line")))).alias("ls"))
        rows = rows.join(lines.select("doc_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("chunks")), "doc_id", "left")
    else:
        rows = rows.withColumn("chunks", F.lit(None).cast("string"))

    def safe(name: str) -> str:
        return "".join(c if c.isalnum() or c in "._-" else "_" for c in name.replace("\\", "/").rpartition("/")[2]).lstrip(".") or "file"

    def put(target: str, data: bytes) -> str:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(f"{target}.part", "wb") as f:  # a task that runs again replaces whole files
            f.write(data)
        os.replace(f"{target}.part", target)
        return target

    def run(batches):
        for batch in batches:
            done = []
            for stem, markdown, assets, chunks in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                folder = f"{path}/{safe(stem)}"
                files = [put(f"{folder}/{safe(stem)}.md", markdown.encode())] if markdown is not None else []
                files += [put(f"{folder}/assets/{safe(a['filename'])}", a["data"]) for a in assets or [] if a["data"]]
                files += [put(f"{folder}/{safe(stem)}.chunks.jsonl", (chunks + "\n").encode())] if chunks else []
                done.append(files)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.list_(pa.string()))], ["doc_id", "written"])

    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], StructField("written", ArrayType(StringType()))]))
