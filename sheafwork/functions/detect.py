"""Format detection: content first, the name only where content says nothing."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import basename

# Format, media type, extensions.
FORMATS = (
    ("pdf", "application/pdf", (".pdf",)),
    ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", (".docx", ".docm")),
    ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation", (".pptx", ".pptm")),
    ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", (".xlsx", ".xlsm")),
    ("epub", "application/epub+zip", (".epub",)),
    ("zip", "application/zip", (".zip",)),
    ("html", "text/html", (".html", ".htm", ".xhtml")),
    ("xml", "application/xml", (".xml", ".rss", ".atom", ".svg")),
    ("json", "application/json", (".json",)),
    ("jsonl", "application/x-ndjson", (".jsonl", ".ndjson")),
    ("csv", "text/csv", (".csv",)),
    ("tsv", "text/tab-separated-values", (".tsv", ".tab")),
    ("ipynb", "application/x-ipynb+json", (".ipynb",)),
    ("eml", "message/rfc822", (".eml",)),
    ("rtf", "application/rtf", (".rtf",)),
    ("markdown", "text/markdown", (".md", ".markdown", ".mdx")),
    ("image", "image/*", (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp")),
    ("text", "text/plain", (".txt", ".text", ".log", ".rst", ".srt", ".vtt")),
)
# Extension of a source file and label of its fenced code.
CODE = (
    (".py", "python"), (".pyi", "python"), (".js", "javascript"), (".mjs", "javascript"), (".cjs", "javascript"), (".jsx", "jsx"), (".ts", "typescript"), (".tsx", "tsx"),
    (".go", "go"), (".rs", "rust"), (".rb", "ruby"), (".php", "php"), (".java", "java"), (".kt", "kotlin"), (".swift", "swift"), (".c", "c"), (".h", "c"), (".cc", "cpp"),
    (".cpp", "cpp"), (".hpp", "cpp"), (".cs", "csharp"), (".sh", "bash"), (".bash", "bash"), (".zsh", "bash"), (".fish", "fish"), (".ps1", "powershell"), (".sql", "sql"),
    (".r", "r"), (".jl", "julia"), (".lua", "lua"), (".pl", "perl"), (".scala", "scala"), (".dart", "dart"), (".ex", "elixir"), (".exs", "elixir"), (".erl", "erlang"),
    (".hs", "haskell"), (".clj", "clojure"), (".vim", "vim"), (".yaml", "yaml"), (".yml", "yaml"), (".toml", "toml"), (".ini", "ini"), (".cfg", "ini"), (".env", "dotenv"),
    (".dockerfile", "dockerfile"), (".tf", "hcl"), (".hcl", "hcl"), (".graphql", "graphql"), (".gql", "graphql"), (".proto", "protobuf"), (".css", "css"), (".scss", "scss"),
    (".less", "less"), (".vue", "vue"), (".svelte", "svelte"), (".make", "makefile"), (".gradle", "groovy"),
)
# Names without an extension that are code.
BARE_NAMES = (
    ("dockerfile", "dockerfile"), ("makefile", "makefile"), ("justfile", "just"), ("procfile", "yaml"),
    ("gemfile", "ruby"), ("rakefile", "ruby"), ("brewfile", "ruby"), ("cmakelists.txt", "cmake"),
)
# Extension and media type of images.
IMAGE_MEDIA = (
    (".png", "image/png"), (".jpg", "image/jpeg"), (".jpeg", "image/jpeg"), (".gif", "image/gif"),
    (".bmp", "image/bmp"), (".tif", "image/tiff"), (".tiff", "image/tiff"), (".webp", "image/webp"),
)
# Format, parser's priority (the least wins), label.
PARSERS = (
    ("pdf", 10, "PDF"), ("docx", 10, "Word"), ("pptx", 10, "PowerPoint"), ("xlsx", 10, "Excel"), ("epub", 15, "EPUB"), ("ipynb", 20, "Jupyter notebook"),
    ("markdown", 20, "Markdown"), ("eml", 25, "Email"), ("html", 30, "HTML"), ("code", 30, "Source code"), ("csv", 40, "CSV"), ("tsv", 40, "TSV"), ("json", 40, "JSON"),
    ("jsonl", 40, "JSON Lines"), ("xml", 45, "XML"), ("rtf", 50, "RTF"), ("ole2", 55, "Legacy Office"), ("image", 60, "Image"), ("zip", 70, "ZIP archive"), ("text", 900, "Plain text"),
)

_RESULT = "struct<format:string,media_type:string,extension:string,lang:string,confidence:double,via:string>"
_MEDIA = {f: m for f, m, _ in FORMATS}


def extension(name: Column) -> Column:
    """The lower-case last suffix; a leading dot alone makes none."""
    return F.lower(F.regexp_extract(basename(name), "[^.](\\.[^./]+)$", 1))


def _lookup(key: Column, pairs: dict[str, str]) -> Column:
    entries = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.try_element_at(F.create_map(*entries), key)


def code_language(name: Column) -> Column:
    """Label of a source file, by extension and then by bare name; null if it is none."""
    return F.coalesce(_lookup(extension(name), dict(CODE)), _lookup(F.lower(basename(name)), dict(BARE_NAMES)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def zip_names(content: pd.Series) -> pd.Series:
    """Names of the first members of a ZIP container; null if it can't be read."""

    def names(data: bytes | None) -> list[str] | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return z.namelist()[:400]
        except Exception:
            return None

    return content.map(names)


def _made(fmt: str, extension_: Column | str, confidence: float, via: str, media: str | None = None, lang: Column | str = "") -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(fmt).alias("format"), F.lit(media or _MEDIA[fmt]).alias("media_type"), as_column(extension_).alias("extension"),
        as_column(lang).alias("lang"), F.lit(confidence).alias("confidence"), F.lit(via).alias("via"),
    ).cast(_RESULT)


def by_magic(content: Column, name: Column, names: Column | None = None) -> Column:
    """Detection by the first bytes, null if they say nothing. ``names``: members of a ZIP container."""
    starts = lambda *hexes: [F.startswith(content, F.unhex(F.lit(h))) for h in hexes]
    ext = extension(name)
    image = lambda e: _made("image", e, 1.0, "magic", dict(IMAGE_MEDIA)[e])
    riff = starts("52494646")[0] & (F.substring(content, 9, 4) == F.unhex(F.lit("57454250")))
    # A bitmap's header has zeros in its reserved field; text that begins with BM has not.
    bitmap = starts("424D")[0] & (F.substring(content, 7, 4) == F.unhex(F.lit("00000000")))
    zipped = starts("504B0304")[0] | starts("504B0506")[0]
    out = F.when(starts("255044462D")[0], _made("pdf", ".pdf", 1.0, "magic")).when(starts("7B5C727466")[0], _made("rtf", ".rtf", 1.0, "magic"))
    out = out.when(starts("89504E470D0A1A0A")[0], image(".png")).when(starts("FFD8FF")[0], image(".jpg"))
    gif87, gif89 = starts("474946383761", "474946383961")
    out = out.when(gif87 | gif89, image(".gif")).when(bitmap, image(".bmp")).when(riff, image(".webp"))
    little, big = starts("49492A00", "4D4D002A")
    out = out.when(little | big, image(".tiff"))
    out = out.when(starts("D0CF11E0A1B11AE1")[0], _made("ole2", F.when(ext == "", ".doc").otherwise(ext), 1.0, "magic", "application/x-ole-storage"))
    if names is None:
        return out.when(zipped, _made("zip", ".zip", 0.9, "magic"))
    has = lambda test: F.exists(names, test)
    out = out.when(zipped & names.isNull(), _made("zip", ".zip", 0.4, "magic"))
    out = out.when(zipped & F.array_contains(names, "word/document.xml"), _made("docx", ".docx", 1.0, "magic"))
    out = out.when(zipped & has(lambda n: n.startswith("ppt/slides/") | (n == "ppt/presentation.xml")), _made("pptx", ".pptx", 1.0, "magic"))
    out = out.when(zipped & F.array_contains(names, "xl/workbook.xml"), _made("xlsx", ".xlsx", 1.0, "magic"))
    out = out.when(zipped & has(lambda n: n.endswith(".opf") | (n == "META-INF/container.xml")), _made("epub", ".epub", 0.95, "magic"))
    return out.when(zipped, _made("zip", ".zip", 0.9, "magic"))


def by_name(content: Column, name: Column) -> Column:
    """Detection by the name, then by the shape of the first 4096 bytes."""
    ext, lang = extension(name), code_language(name)
    out = F.when(lang.isNotNull(), _made("code", ext, 0.9, "extension", "text/plain", lang))
    for fmt, media, exts in FORMATS:
        if fmt == "image":
            for e, m in IMAGE_MEDIA:
                out = out.when(ext == e, _made("image", ext, 0.85, "extension", m))
        else:
            out = out.when(ext.isin(*exts), _made(fmt, ext, 0.85, "extension", media))
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    shape = F.regexp_replace(head, "^[ \\t\\n\\r\\f\\x0B]+", "")
    otherwise = lambda e: F.when(ext == "", e).otherwise(ext)
    out = out.when(F.instr(head, "\x00") > 0, _made("binary", ext, 0.3, "extension", "application/octet-stream"))
    out = out.when(shape.rlike("^[{\\[]"), _made("json", otherwise(".json"), 0.5, "content"))
    out = out.when(shape.rlike("(?i)^(<!doctype html|<html)"), _made("html", otherwise(".html"), 0.8, "content"))
    out = out.when(shape.startswith("<?xml"), _made("xml", otherwise(".xml"), 0.7, "content"))
    return out.otherwise(_made("text", ext, 0.3, "fallback"))


def detect(content: Column, name: Column, names: Column | None = None) -> Column:
    return F.coalesce(by_magic(content, name, names), by_name(content, name))


def with_detection(files: DataFrame, content: str = "content", name: str = "filename") -> DataFrame:
    """Adds ``detection`` in one scan; only the bytes of ZIP containers go to Python, for their members' names."""
    magic = F.startswith(F.col(content), F.unhex(F.lit("504B0304"))) | F.startswith(F.col(content), F.unhex(F.lit("504B0506")))
    members = files.withColumn("members", zip_names(F.when(magic, F.col(content))))
    return members.withColumn("detection", detect(F.col(content), F.col(name), F.col("members"))).drop("members")


def parsers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PARSERS), "format string, priority int, label string")


def resolve(detected: DataFrame, registry: DataFrame) -> DataFrame:
    """The parser of each row's format with the least priority; the plain-text parser where none serves it."""
    best = registry.groupBy("format").agg(F.min_by("label", F.struct("priority", "label")).alias("label"), F.min("priority").alias("priority"))
    return detected.join(F.broadcast(best), "format", "left").withColumn("label", F.coalesce("label", F.lit("Plain text"))).withColumn("priority", F.coalesce("priority", F.lit(900)))


def supported_formats(registry: DataFrame) -> DataFrame:
    return registry.groupBy("format").agg(F.min_by("label", F.struct("priority", "label")).alias("label"))
