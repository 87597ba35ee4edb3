"""Secret scans: candidate strings, and a random forest that removes false positives.

A text is cut into pieces at white space and at the marks ``{}[],;&``. Candidates are
pieces of at least ``SHORTEST`` characters that hold a digit, a value after a
credential-like name in the same piece or in the one or two before, a password in a
URL, and AWS key ids. The forest sees the candidate's length, its character classes
and the transitions between them, how likely its letter pairs are in words, its
entropy, how much of it dictionary words cover, the document's path and the
neighbouring pieces. It is fitted on labelled findings; without any of one's own, on
findings generated from fixed templates and hashes. Dictionary and letter pairs come
from the vocabulary file of a public tokenizer, whose path is a parameter.

All of it is DataFrame functions and Spark's own random forest. Defined results:
null and empty texts have no candidates; null path counts as empty; a text of any
length is scanned whole; candidates are independent of each other, so equal ones in a
text are each a finding; repeated rows give repeated findings; columns besides
doc_id, text and the path are not read, whatever their names; an empty table gives an
empty result. A secret that itself holds one of the marks is seen in parts.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Least length of a candidate.
SHORTEST = 8
#: Probability from which a candidate is reported as a secret.
THRESHOLD = 0.5
#: Generated labelled findings.
FINDINGS = 12000
#: Words of the dictionary, the most frequent ones of the vocabulary that have four letters or more.
DICTIONARY = 4000

_SEPARATORS = "[ \t\n\x0b\f\r{}\\[\\],;&]+"
# Words of names of credentials, of placeholders, of names of digests, of paths that hold examples.
_NAMES = "passw(?:or)?d|passphrase|secret|token(?!s)|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|credential|auth(?:orization)?(?![a-z])|bearer|pwd"
_PLACEHOLDER = "example|sample|dummy|placeholder|changeme|change_me|your[_-]|xxxx|insert|redacted|test|fake|^\\$|^<|\\*\\*\\*"
_DIGEST = "integrity|etag|sha-?(?:1|256|384|512)|md5|checksum|digest|commit|revision|fingerprint|hash|uuid|guid|crc"
_EXAMPLES = "test|spec|example|sample|fixture|doc|mock"
#: A piece that ends with such a name and = or :, one that ends with the name alone, and the marks that may follow it as a piece.
_ASSIGNS, _ENDS, _MARKS = f"(?i)(?:{_NAMES})[A-Za-z0-9_.-]*[\"']?(?::=|=>|[=:])[\"']?$", f"(?i)(?:{_NAMES})[A-Za-z0-9_.-]*[\"']?$", ("=", ":", ":=", "=>")
#: Schemes of an Authorization header, between its name and the value.
_SCHEMES = ("Bearer", "bearer", "Basic", "basic", "Token", "token")
_AWS = "(?:AKIA|ASIA)[A-Z0-9]{16}"
_IN_URL = "[A-Za-z][A-Za-z0-9+.-]*://[^/:@?#]*:([^/@]+)@"
#: A credential-like name and what is assigned to it, and any other name.
_NAMED = f"(?i)([A-Za-z0-9_.-]*(?:{_NAMES})[A-Za-z0-9_.-]*)[\"']?(?::=|=>|=|:(?!//))[\"']?([^\"'()<>]+)"
_OTHER = "^[\"'(]*([A-Za-z][A-Za-z_-]{2,30})[\"']?(?:=|:(?!//))"

FEATURES = (
    "length", "digits", "uppers", "lowers", "marks", "hex", "transitions", "case_transitions", "likely", "distinct", "entropy",
    "coverage", "vowels", "dots", "at_sign", "url", "named", "in_url", "assigned", "named_before", "key_block", "placeholder", "digest", "example_path",
)


class Words(NamedTuple):
    """The dictionary, and for each pair of letters how much more likely it is in its words than by chance, in tenths of a nat."""

    dictionary: tuple[str, ...]
    pairs: tuple[int, ...]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(4)
def words_of(path: str, size: int = DICTIONARY) -> Words:
    """From a vocabulary file in which a piece that begins a word is marked and a lower id is a more frequent piece."""
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    begin = "\u0120"
    words = [w[1:] for w, _ in sorted(ids.items(), key=lambda x: x[1]) if w.startswith(begin) and w[1:].isascii() and w[1:].isalpha() and w[1:].islower() and len(w) > 4]
    seen = Counter(a + b for w in words for a, b in zip(w, w[1:], strict=False))
    total = sum(seen.values())
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = tuple(round(10 * math.log(676 * (seen[a + b] + 1) / (total + 676))) for a in letters for b in letters)
    return Words(tuple(words[:size]), pairs)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, path, at, word, before, last, after): each candidate piece, its number, and its neighbours."""
    where = F.col(path) if path in docs.columns else F.lit("")
    rows = docs.where(F.col("text").rlike(f"[0-9]|{_AWS}|(?i)(?:{_NAMES})[A-Za-z0-9_.-]*[\"']?[ \t\n\x0b\f\r]*(?:=|:)|://[^/:@?#]*:[^/@]+@"))
    rows = rows.select("doc_id", F.coalesce(where.cast("string"), F.lit("")).alias("path"), F.split("text", _SEPARATORS).alias("words"))
    numbered = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    near = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    own = lambda w: w.rlike(f"[0-9]|{_AWS}") | w.rlike(f"(?i)(?:{_NAMES})[A-Za-z0-9_.-]*[\"']?[=:]") | w.rlike(_IN_URL)
    chosen = F.filter(numbered, lambda x: (F.length(x["word"]) >= SHORTEST) & (own(x["word"]) | _given(near(x["at"] - 2), near(x["at"] - 1))))
    around = F.transform(chosen, lambda x: F.struct(x["at"].alias("at"), x["word"].alias("word"), near(x["at"] - 2).alias("before"), near(x["at"] - 1).alias("last"), near(x["at"] + 1).alias("after")))
    return rows.select("doc_id", "path", F.inline(around))


def _given(before: Column, last: Column) -> Column:
    """Whether the one or two pieces before are a credential-like name with = or :, or an Authorization header's name and scheme."""
    marked = last.rlike("[=:>][\"']?$") & (last.rlike(_ASSIGNS) | (last.isin(*_MARKS) & before.rlike(_ENDS)))
    return marked | (last.isin(*_SCHEMES) & before.rlike(_ASSIGNS))


def _value(word: Column) -> tuple[Column, Column]:
    """(name, value): the name that the piece assigns to, and the value without quotes and punctuation; without a name, the whole piece."""
    named, in_url, other = F.regexp_extract(word, _NAMED, 1), F.regexp_extract(word, _IN_URL, 1), F.regexp_extract(word, _OTHER, 1)
    name = F.when(in_url != "", "in_url").when(named != "", named).otherwise(other)
    rest = F.when(in_url != "", in_url).when(named != "", F.regexp_extract(word, _NAMED, 2)).when(other != "", F.regexp_replace(word, _OTHER + "[=:>]*", "")).otherwise(word)
    return name, F.regexp_replace(rest, "^[\"'(<]+|[\"')>.:!?#*$%|]+$", "")


def featured(found: DataFrame, words: Words) -> DataFrame:
    """Adds ``value`` and the features to (word, before, last, after, path)."""
    name, value = _value(F.col("word"))
    rows = found.withColumn("name", name).withColumn("value", value)
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / n

    def flag(c: Column, pattern: str) -> Column:
        return c.rlike(f"(?i)(?:{pattern})").cast("double")

    counts = F.transform(F.array_distinct(F.split(v, "")), lambda c: F.when(c == "", 0.0).otherwise((F.length(v) - F.length(F.replace(v, c, F.lit("")))) / n))
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    near = F.concat_ws(" ", "before", "last")
    known = ",".join(f"'{w}'" for w in words.dictionary)
    covered = F.expr(f"aggregate(filter(regexp_extract_all(lower(regexp_replace(value, '([a-z])([A-Z])', '$1 $2')), '([a-z]+)', 1), p -> p in ({known})), 0, (a, p) -> a + length(p))")
    # The letters of each pair as one number, by which the table is read.
    letters = F.transform(F.split(F.lower(v), ""), lambda c: F.when(c.between("a", "z") & (F.length(c) == 1), F.ascii(c) - 97))
    table_ = F.expr(f"array({','.join(map(str, words.pairs))})")
    scores = F.zip_with(letters, F.slice(letters, 2, 1 << 30), lambda a, b: F.get(table_, a * 26 + b))
    scores = F.filter(scores, lambda x: x.isNotNull())
    likely = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0), lambda a, x: a + x) / F.size(scores)).otherwise(0.0)
    made = {
        "length": F.length(v).cast("double"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "marks": share("[^A-Za-z0-9]"),
        "hex": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "transitions": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        "case_transitions": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "likely": likely,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "entropy": entropy,
        "coverage": covered / n,
        "vowels": share("(?i)[aeiou]"),
        "dots": share("[.]"),
        "at_sign": v.contains("@").cast("double"),
        "url": F.col("word").contains("://").cast("double"),
        "named": flag(F.col("name"), _NAMES),
        "in_url": (F.col("name") == "in_url").cast("double"),
        "assigned": ((F.col("name") != "") | F.col("last").isin(*_MARKS) | F.col("last").rlike("[=:][\"']?$")).cast("double"),
        "named_before": (flag(near, _NAMES) + _given(F.col("before"), F.col("last")).cast("double")),
        "key_block": near.rlike("PRIVATE KEY-----$").cast("double"),
        "placeholder": flag(F.col("value"), _PLACEHOLDER),
        "digest": flag(F.concat_ws(" ", near, "name"), _DIGEST) + v.rlike("(?i)^(?:sha[0-9]+|md5|W/)").cast("double"),
        "example_path": flag(F.col("path"), _EXAMPLES),
    }
    return rows.withColumns({f"f_{k}": F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in made.items()})


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """n generated findings (word, before, last, after, path, label); every one follows from its number."""
    i = F.col("id")
    h = lambda salt: F.sha2(F.concat_ws("/", i.cast("string"), F.lit(salt)), 256)
    draw = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k))
    among = lambda salt, xs: F.element_at(F.array(*xs), (draw(salt, len(xs)) + 1).cast("int"))
    pick = lambda salt, *xs: among(salt, [F.lit(x) for x in xs])
    size = lambda salt, low, high: (draw(salt, high - low + 1) + low).cast("int")
    cut = lambda c, salt, low, high: F.substring(c, F.lit(1), size(salt, low, high))
    hexes = lambda salt, low, high: cut(F.concat(h(salt), h(salt + "+")), salt + "#", low, high)
    base64 = lambda salt, low, high: cut(F.translate(F.base64(F.unhex(F.concat(h(salt), h(salt + "+")))), "=\r\n", ""), salt + "#", low, high)
    solid = lambda salt, low, high: F.translate(base64(salt, low, high), "+/", "aB")
    wide = lambda salt, k: F.substring(F.translate(F.upper(solid(salt, 60, 60)), "0189", "ABCD"), F.lit(1), F.lit(k))
    number = lambda salt, k: F.substring(F.translate(F.concat(h(salt), h(salt + "+")), "abcdef", ""), F.lit(1), F.lit(k))
    syllables = ("the", "tion", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "que", "ment", "lich", "ung", "ado", "eau")
    plain_words = ("horse", "battery", "correct", "river", "green", "window", "letter", "summer", "monkey", "dragon", "stone", "paper", "silver", "garden", "winter", "market")
    spoken = lambda salt, k: F.concat(*[pick(f"{salt}{j}", *syllables) for j in range(k)])
    joined = lambda salt, k: F.concat(*[pick(f"{salt}{j}", *plain_words) for j in range(k)])
    word, other = spoken("w", 3), spoken("o", 3)
    quote = pick("quote", '"', "'", "")
    name = F.concat(pick("prefix", "", "", "db_", "my", "aws_", "x-", "app."), pick("name", "password", "token", "secret", "api_key", "passwd", "access_key", "auth_token", "client_secret", "apikey", "API_KEY", "SECRET_TOKEN", "pwd", "passphrase"))
    mark = pick("mark", "", ".", "", "")
    jwt = F.concat(F.lit("eyJ"), solid("jwt1", 20, 33), F.lit(".eyJ"), solid("jwt2", 20, 60), F.lit("."), solid("jwt3", 30, 43))
    branded = F.concat(pick("brand", "ghp_", "sk-", "xoxb-", "glpat-", "sk_live_", "npm_", "hf_", "pat-"), solid("brand", 20, 40))
    aws = F.concat(pick("aws", "AKIA", "ASIA"), wide("aws", 16))
    random = among("random", [hexes("hex", 16, 64), aws, base64("mix", 16, 60), branded, solid("solid", 12, 40), jwt])
    phrase = among("phrase", [joined("j", 3), F.concat(joined("j", 2), number("jn", 3)), F.concat(spoken("p", 4), solid("p", 4, 8)), F.concat(pick("sep0", "Tr0ub4dor", "P4ssw0rt", "hunter2", "S3cur3"), pick("sep", "&", "!", "-", "_"), solid("tail", 4, 9))])
    secret = among("secret", [random, random, phrase])
    plain = pick("plain", "required", "incorrect", "disabled", "encrypted", "optional", "forgotten", "undefined", "protected", "accepted", "rejected", "something", "whatever", "manager", "generator", "expired", "function", "authentication")
    fake = pick("fake", "changeme", "your_password_here", "example-token", "xxxxxxxxxxxx", "<your-secret>", "placeholder", "$DB_PASSWORD", "********", "test12345", "changeme123", "dummy-value-1", "REDACTED")
    host = F.concat(word, pick("tld", ".com", ".org", ".net", ".io", ".example.com"))
    scheme = pick("scheme", "postgres", "mysql", "redis", "amqp", "mongodb+srv", "https", "ftp")
    digest_name = pick("digest", "commit", "sha", "checksum", "revision", "digest", "md5:", "sha256:", "etag:", "ETag:", "hash", "\"integrity\":", "integrity", "fingerprint:")
    given = F.concat(pick("open", '"', "", ""), name, pick("given", ":", "=", '":', ":="))
    uuid = F.concat_ws("-", hexes("u1", 8, 8), hexes("u2", 4, 4), hexes("u3", 4, 4), hexes("u4", 4, 4), hexes("u5", 12, 12))
    kinds = [
        # (label, word, last, before)
        (1, F.concat(name, F.lit("="), quote, secret, quote, mark), word, other),
        (1, F.concat(quote, secret, quote), pick("eq", "=", ":", "=>", ":="), F.concat(quote, name, quote)),
        (1, F.concat(quote, secret, quote, mark), given, word),
        (1, F.concat(F.lit('"'), name, F.lit('":"'), secret, F.lit('"')), word, other),
        (1, F.concat(F.lit('"'), secret, F.lit('"')), F.concat(F.lit('"'), name, F.lit('":')), word),
        (1, F.concat(scheme, F.lit("://"), spoken("user", 2), F.lit(":"), secret, F.lit("@"), host, F.lit("/"), other), word, pick("dsn", "DATABASE_URL", "=", "url:", "dsn", "connect")),
        (1, F.concat(F.lit("https://"), host, F.lit("/v1?"), name, F.lit("="), random), word, other),
        (1, F.concat(aws, mark), word, other),
        (1, F.concat(branded, mark), word, other),
        (1, F.concat(jwt, mark), word, other),
        (1, base64("block", 60, 64), F.lit("KEY-----"), F.lit("PRIVATE")),
        (1, among("bearer", [jwt, solid("bearer", 24, 48), branded]), pick("bearer", "Bearer", "bearer", "Token"), pick("header", "Authorization:", "authorization:", '"Authorization":')),
        (0, F.concat(quote, fake, quote, mark), given, word),
        (0, F.concat(name, F.lit("="), quote, fake, quote), word, other),
        (0, F.concat(plain, mark), given, word),
        (0, F.concat(plain, mark), pick("eq3", "=", ":"), name),
        (0, F.concat(name, pick("kept", ":", "=", "_count=", "_id="), number("kept", 2)), word, other),
        (0, F.concat(word, F.lit("."), number("mail", 2), F.lit("@"), host, mark), word, other),
        (0, F.concat_ws(".", number("ip1", 2), number("ip2", 3), number("ip3", 2), F.concat(number("ip4", 3), mark)), word, other),
        (0, F.concat(number("digits", 16), mark), word, other),
        (0, F.concat(number("area", 3), F.lit("-"), number("phone", 4)), F.concat(F.lit("("), number("area2", 3), F.lit(")")), pick("dial", "+1", "+49", "tel", "call")),
        (0, F.concat(F.lit("20"), number("year", 2), F.lit("-"), number("month", 2), F.lit("-"), number("day", 2), pick("time", "", "T10:15:00Z", "T08:00:59", ".")), word, other),
        (0, F.concat(word, number("tail2", 2), mark), word, other),
        (0, hexes("sha", 32, 64), digest_name, word),
        (0, F.concat(pick("algorithm", "sha512-", "sha256-", "sha384-", "sha256:", "sha1-"), base64("sri", 40, 88)), pick("sri", "integrity", "\"integrity\":", "integrity:", "digest", "image"), word),
        (0, F.concat(F.lit('W/"'), hexes("etag", 16, 40), F.lit('"')), pick("etag", "etag:", "ETag:", "If-None-Match:"), word),
        (0, uuid, pick("id", "uuid", "id", "request", "id:", "trace-id:", "="), word),
        (0, F.concat(F.lit("https://"), host, F.lit("/"), other, F.lit("/"), number("page", 4)), word, other),
        (0, F.concat(F.lit("https://"), host, F.lit("/"), other, F.lit("-"), number("page2", 5), F.lit(".html?page="), number("page3", 1)), word, other),
        (0, F.concat(name, F.lit(":")), word, other),
        (0, F.concat(F.substring(number("isbn", 20), F.lit(1), F.lit(3)), F.lit("-"), number("isbn2", 10)), pick("isbn", "isbn", "ISBN", "tel", "no."), word),
        (0, F.concat(word, pick("dash", "_", "-"), F.lit("20"), number("file", 2), F.lit("_v"), number("file2", 1), pick("ext", ".pdf", ".txt", ".tar.gz", ".png")), word, other),
        (0, F.concat(F.lit("0x"), hexes("address", 8, 16)), pick("at", "at", "=", "address"), word),
        (0, F.concat_ws(":", *[hexes(f"mac{k}", 2, 2) for k in range(6)]), pick("mac", "mac", "ether", "link/ether"), word),
        (0, F.concat(F.lit("v"), number("v1", 1), F.lit("."), number("v2", 2), F.lit("."), number("v3", 1), pick("pre", "-beta", "-rc1", "", "-alpha.2")), pick("ver", "version", "release", "tag"), word),
        (0, F.concat(spoken("camel", 2), F.initcap(spoken("camel2", 2)), F.initcap(word), number("camel", 1)), word, other),
    ]
    options = F.array(*[F.struct(F.lit(y).alias("label"), w.alias("word"), last.alias("last"), before.alias("before")) for y, w, last, before in kinds])
    one = F.element_at(options, (draw("kind", len(kinds)) + 1).cast("int"))
    path = pick("path", "src1", "web", "app/config.py", "docs/readme.md", "lib/main.c", "tests/test_login.py", "books", "deploy/prod.yaml", "")
    return spark.range(0, n, 1, 4).select(one.alias("x"), path.alias("path"), word.alias("after")).select("x.label", "x.word", "x.last", "x.before", "after", "path")


def train(findings: DataFrame, words: Words | None = None, trees: int = 32, depth: int = 10) -> tuple[PipelineModel, Words]:
    """Fit the forest on labelled findings: word, before, last, after, path, label (1 is a secret). Findings without a label are left out."""
    words = words or words_of(vocabulary_path())
    rows = featured(findings, words).select(F.col("label").cast("double").alias("label"), *[f"f_{k}" for k in FEATURES]).where("label is not null").persist()
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=11)
    model = Pipeline(stages=[VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features"), forest]).fit(rows)
    rows.unpersist()
    return model, words


def scored(found: DataFrame, model: tuple[PipelineModel, Words]) -> DataFrame:
    """Adds ``value`` and ``probability`` to the candidates; those of which no value is left go."""
    forest, words = model
    out = forest.transform(featured(found, words).where("value <> ''"))
    return out.withColumn("probability", vector_to_array("probability")[1])


def scan(docs: DataFrame, model: tuple[PipelineModel, Words], threshold: float = THRESHOLD, path: str = "source") -> DataFrame:
    """(doc_id, at, value, probability, is_secret) of every candidate."""
    out = scored(candidates(docs, path), model)
    return out.select("doc_id", F.col("at").cast("long").alias("at"), "value", "probability").withColumn("is_secret", F.col("probability") >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), train(labelled_findings(spark)))
