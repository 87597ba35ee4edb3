"""Quality classifier, weak rules, token attribution, packing."""

import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheafwork.llm import packing, quality_crf, token_attribution, weak_rules
from sheafwork.llm.common import Workspace
from sheafwork.llm.textbytes import Block, Lines, Words, blocks
from sheafwork.llm.tokens import Encoder, vocabulary

from .brute import WORD

random.seed(5)
SYLLABLES = "the tion er an re on at en nd ti es or te of ed is it al ar st".split()


def prose(n, end="."):
    return " ".join("".join(random.choices(SYLLABLES, k=random.randint(1, 3))) for _ in range(n)).capitalize() + end


def good():
    return "\n".join(prose(random.randint(8, 40)) for _ in range(random.randint(1, 8)))


def bad():
    kind = random.randrange(4)
    words = prose(60).split()
    made = [" ".join(w + "###" for w in words), " ".join(w.upper() + "!!" for w in words), " ".join(w for w in words[:5] for _ in range(20)), " | ".join(words)][kind]
    return random.choice(["", prose(9) + "\n"]) + made


EDGES = [None, "", " \n\t\n", "a", "é" * 9000, "same line here.\n" * 300, "\n" * 500, "x\x1cy \x85 z w", "don't <|endoftext|> 漢字 İ"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, good() if i % 4 else bad(), 1 if i % 4 else 0) for i in range(600)]
    rows += [(1000 + i, t, None) for i, t in enumerate(EDGES)] + [(None, "no id.", None), (3, rows[3][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs = df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_words"), F.lit(2).alias("score")).repartition(3)
    return docs, df.where("quality is not null").select("doc_id", "quality"), rows


def test_quality_learns_and_holds_out(spark, corpus):
    docs, labels, rows = corpus
    model = quality_crf.train(spark, docs, labels.union(labels.limit(5)))
    out = quality_crf.score(docs, model).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    want = {i: q for i, _, q in rows if q is not None}
    held = [i for i in want if by[i]["held_out"]]
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in want)
    assert sum(by[i]["predicted"] == want[i] for i in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    kept = quality_crf.accepted(docs, model)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is not null").select("doc_id").distinct().count() == len({r["doc_id"] for r in out if r["predicted"] and r["doc_id"] is not None})


def test_quality_without_labels(spark, corpus):
    docs, labels, rows = corpus
    for some, share in ((labels.limit(0), 0.5), (labels.where("quality = 1"), None)):
        scores = {round(r["score"], 9) for r in quality_crf.score(docs, quality_crf.train(spark, docs, some)).collect()}
        assert len(scores) == 1 and (share is None or scores == {share})
    assert quality_crf.score(docs.limit(0), quality_crf.train(spark, docs, labels.limit(0))).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    length = np.array([4, 1, 6])
    s, t = rng.normal(size=11), rng.normal(size=(2, 2))
    a, b = quality_crf.forward_backward(s, length, t)
    at = 0
    for n in length:
        weight, ones = 0.0, np.zeros(n)
        for m in range(1 << n):
            y = [m >> k & 1 for k in range(n)]
            w = np.exp(sum(s[at + k] * y[k] for k in range(n)) + sum(t[y[k], y[k + 1]] for k in range(n - 1)))
            weight += w
            ones += w * np.array(y)
        assert np.allclose(1 / (1 + np.exp(-(a + b)[at : at + n])), ones / weight)
        at += n


def test_byte_arithmetic_matches_strings():
    texts = [t or "" for t in EDGES] + [good() for _ in range(50)]
    for block in blocks(pa.array(texts)):
        w, lines = Words(block), Lines(block)
        for k in range(block.n):
            text = texts[block.first + k].encode()
            mine = [bytes(block.data[a:b]) for a, b in zip(w.start[w.row == k], w.stop[w.row == k], strict=True)]
            assert mine == text.split()
            assert [bytes(block.data[a:b]) for a, b in zip(lines.start[lines.row == k], lines.stop[lines.row == k], strict=True)] == text.split(b"\n")


def test_weak_rules(spark, corpus):
    docs, _, rows = corpus
    out = weak_rules.judge(Workspace(spark, "t"), docs).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    for i, text, _ in rows:
        text = text or ""
        w = WORD.findall(text)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = by[i]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    judged = [(by[i], q) for i, _, q in rows if q is not None and not by[i]["base_failed"]]
    assert sum(r["kept"] == bool(q) for r, q in judged) / len(judged) > 0.95
    assert weak_rules.judge(Workspace(spark, "t"), docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def encode():
    with open(vocabulary(), encoding="utf-8") as f:
        return Encoder(f.read())


def test_encoder_is_the_tokenizer(encode):
    parts = [" ", "\n", "a", "É", "é", "ß", "'", "s", "1", "#", "!", "|", "<|endoftext|>", "́", "\x1c", "\x85", " ", "İ", "漢", "²", "×", "don't", "œ", "\x00"]
    texts = [t or "" for t in EDGES] + ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(3000)] + [good(), bad()]
    want = encode._tokenizer.encode_batch(texts, add_special_tokens=False)
    column = pa.array([*texts, None])
    assert [x.tolist() for x in encode.ids(column)] == [e.ids for e in want] + [[]]
    assert [list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in encode.spans(column)] == [e.offsets for e in want] + [[]]


def test_packing_round_trip(spark, corpus, encode):
    docs, _, rows = corpus
    window = 64
    pieces = packing.pack(Workspace(spark, "t"), docs, vocabulary(), window).collect()
    digests = packing.digest(packing.pack(Workspace(spark, "t"), docs, vocabulary(), window)).collect()
    assert Counter((p["doc_id"], p["start"], p["length"], p["sequence_id"], p["offset"]) for p in pieces) == Counter((p["doc_id"], p["start"], p["length"], p["sequence_id"], p["offset"]) for p in digests)
    stream = {}
    for p in pieces:
        stream.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    last = max(stream)
    for s, spans in stream.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == window or s == last
    by = {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
    for i, text, _ in rows:
        if i == 3:
            continue  # stands twice
        ids = [*encode._tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        got = b"".join(bytes(p["piece_ids"]) for p in sorted(by[i], key=lambda p: p["start"]))
        assert got == struct.pack(f"<{len(ids)}I", *ids) and by[i][0]["doc_tokens"] == len(ids)
    assert sum(p["start"] == 0 for p in by[3]) == 2
    assert packing.pack(Workspace(spark, "t"), docs.limit(0), vocabulary()).count() == 0


@pytest.mark.parametrize("rule", token_attribution.RULES)
def test_attribution_against_single_characters(spark, corpus, encode, rule):
    docs, _, rows = corpus
    size = 7
    out = token_attribution.attribute(docs, token_attribution.windows(F.col("text"), size), vocabulary(), rule).collect()
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], {})[r["section"]] = r
    for i, text, _ in rows[::40] + rows[600:]:
        if i in (3, None) or not text:
            continue
        want = Counter()
        for a, b in encode._tokenizer.encode(text, add_special_tokens=False).offsets:
            held = Counter(k // size for k in range(a, max(b, a + 1)))
            if rule == "fraction":
                for s, n in held.items():
                    want[s] += n / sum(held.values())
            else:
                want[min(held) if rule == "first" else max(sorted(held), key=lambda s: held[s])] += 1
        assert {s: round(r["n_tokens"], 6) for s, r in got[i].items() if r["n_tokens"]} == {s: round(n, 6) for s, n in want.items()}
    assert token_attribution.attribute(docs.limit(0), token_attribution.windows(F.col("text")), vocabulary()).count() == 0


def test_attribution_to_lines(spark):
    df = spark.createDataFrame([(1, "one two\n\nthree!! four"), (2, None)], "doc_id long, text string")
    out = token_attribution.attribute(df, token_attribution.lines(F.col("text")), vocabulary()).collect()
    assert [(r["section"], r["start"], r["stop"], r["n_tokens"]) for r in sorted(out, key=lambda r: r["section"]) if r["doc_id"] == 1] == [(0, 0, 7, 2.0), (1, 8, 8, 0.0), (2, 9, 21, 3.0)]


def test_block_of_nothing():
    assert list(blocks(pa.array([], pa.string()))) == []
    b = Block(0, np.zeros(0, np.uint8), np.zeros(3, np.int64))
    assert Words(b).n == 0 and Lines(b).n == 2
