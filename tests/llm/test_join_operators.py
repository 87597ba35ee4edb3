"""Line dedup, n-gram Jaccard join, cube mixing, embedding join, WARC records, the pipeline's stages."""

import random
import time
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.llm import cube_mixing, embedding_dedup, jaccard_join, line_dedup, warc
from sheafwork.llm.common import Workspace, components

from .brute import WORD, Sets, jaccard_components, line_removals

random.seed(11)


def word():
    return "".join(random.choices("abcdefghijklmnop", k=random.randint(2, 7)))


def copy_of(words, edits):
    out = list(words)
    for _ in range(edits):
        out[random.randrange(len(out))] = word()
    return out


@pytest.fixture(scope="module")
def near():
    """Exact copies, near copies in a small and a large group, a line in very many documents, odd texts."""
    rows = []
    base = [[word() for _ in range(random.choice([6, 20, 60, 150]))] for _ in range(25)]
    for w in base:
        for _ in range(random.randint(1, 4)):
            rows.append(" ".join(copy_of(w, random.choice([0, 0, 1, 2, 5]))))
    large = [word() for _ in range(120)]
    rows += [" ".join(copy_of(large, random.choice([0, 1, 2, 3, 4, 6, 9]))) for _ in range(150)]
    common = " ".join(word() for _ in range(14))
    rows += [common + "\n" + " ".join(word() for _ in range(random.choice([1, 2, 5, 40]))) for _ in range(150)]
    rows += [None, "", " \n ", "A b c", "a B\nc", "a b", "x" * 20000, " ".join(["again"] * 400), " ".join(["again"] * 300)]
    random.shuffle(rows)
    out = [(i, t) for i, t in enumerate(rows)]
    return [*out, out[5], (7000, out[9][1])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("token", F.lit("x")).repartition(5)


@pytest.mark.parametrize("hot", [4, 48])
def test_jaccard_join(spark, near, hot, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join.hot_shingles, "__defaults__", (hot, jaccard_join.KNOWN_HOT))
    got = jaccard_join.groups(Workspace(spark, "t"), frame(spark, near)).collect()
    assert len(got) == len(near)
    want = jaccard_components(near)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_stage_keeps_one(spark, near):
    docs = frame(spark, near)
    out = jaccard_join.stage(spark, docs, "")
    assert out.columns == docs.columns
    want = jaccard_components(near)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    assert jaccard_join.groups(Workspace(spark, "t"), docs.limit(0)).count() == 0


def test_jaccard_links_through_a_template(spark):
    """Extensions of a text are linked by that text alone; most share only hot shingles with it."""
    r = random.Random(7)
    rows = []
    for size in (14, 24, 34, 64, 84):
        template = [f"t{size}x{k}" for k in range(size)]
        rows.append(" ".join(template))
        for _ in range(70):
            more = max(1, int((size - 4) * r.choice([0.25, 0.3, 0.3 * r.random()])))
            rows.append(" ".join(template + [f"e{r.randrange(10**9)}" for _ in range(more)]))
    rows = list(enumerate(rows))
    want = jaccard_components(rows)
    assert len({c for _, c in want.values()}) == 5
    got = jaccard_join.groups(Workspace(spark, "t"), frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_same_doc_id_on_two_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    found = lambda rows: sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.groups(Workspace(spark, "t"), frame(spark, rows)).collect())
    assert found([(1, a), (1, b), (2, b + " tail")]) == [(1, 1), (1, 1), (2, 1)]
    got = jaccard_join.groups(Workspace(spark, "t"), frame(spark, [(None, a), (7, a + " end"), (None, b)])).collect()
    assert sorted((r["n_shingles"], str(r["component_id"])) for r in got) == [(36, "7"), (36, "None"), (37, "7")]
    kept = jaccard_join.stage(spark, frame(spark, [(0, a + " end"), (1, a), (1, b), (1, b), (3, ""), (3, ""), (None, a)]), "").collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in kept) == [(-1, a), (0, a + " end"), (1, b), (3, ""), (3, "")]


def test_jaccard_around_one_passage(spark):
    """Thousands of documents around one passage, few of which are similar; and near copies of a text that no row has."""
    r = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    rows = [" ".join(passage + [f"x{r.randrange(10**9)}" for _ in range(r.choice([3, 12, 14, 17, 30, 200]))]) for _ in range(1500)]
    base = [f"b{k}" for k in range(150)]
    for _ in range(500):
        text = list(base)
        for k in r.sample(range(150), r.choice([1, 2, 3, 4, 4, 5, 6])):
            text[k] = f"e{r.randrange(10**9)}"
        rows.append(" ".join(text))
    rows = list(enumerate(rows))
    want = jaccard_components(rows)
    got = jaccard_join.groups(Workspace(spark, "t"), frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_keeps_little_on_disk(spark, near, monkeypatch):
    """No step's shuffle files outlast it, and no prefixes or postings stay beside the whole sets."""
    live, columns = [], set()
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        every = blocks.getAllBlocks()
        return {every.apply(k).toString().split("_")[1] for k in range(every.size()) if every.apply(k).isShuffle()}

    def store(self, df, codec="zstd", f=Workspace.store):
        out = f(self, df, codec)
        for _ in range(50):  # files are removed in the background
            if len(new := shuffles() - before) <= 4:
                break
            time.sleep(0.1)
        live.append(len(new))
        return out

    def whole_sets(space, *args, f=jaccard_join._whole_sets):
        columns.update(c for path in Path(space.root).iterdir() for c in spark.read.parquet(str(path)).columns)
        return f(space, *args)

    before = shuffles()
    monkeypatch.setattr(Workspace, "store", store)
    monkeypatch.setattr(jaccard_join, "_whole_sets", whole_sets)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    jaccard_join.groups(Workspace(spark, "t"), frame(spark, near))
    assert max(live) <= 4  # small ones of the test for repeated ids
    assert "doc" in columns and not columns & {"prefix", "token", "hidden"}
    assert spark.conf.get(key) == was


@pytest.mark.parametrize("known", [0, 7, 1000, jaccard_join.KNOWN_HOT])
def test_jaccard_known_hot_shingles(spark, near, known, monkeypatch):
    """The most frequent shingles are known, about as many as asked for; the others change no result."""
    docs = frame(spark, near)
    bits, tokens, counts = jaccard_join.hot_shingles(Workspace(spark, "t"), docs, 4, known)
    sets = [s for (text,) in docs.select("text").toArrow().to_batches() for s in jaccard_join._sets(text)]
    every, n = np.unique(np.concatenate(sets) >> np.uint64(32 - bits), return_counts=True)
    want = dict(zip(every[n > 4].tolist(), n[n > 4].tolist(), strict=True))
    got = dict(zip(tokens.tolist(), counts.tolist(), strict=True))
    assert got.items() <= want.items() and len(got) <= 1.5 * known
    assert got == want or max((c for k, c in want.items() if k not in got), default=0) <= min(got.values(), default=10**9)
    assert known < len(want) or got == want
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    monkeypatch.setattr(jaccard_join.hot_shingles, "__defaults__", (4, known))
    rows = jaccard_join.groups(Workspace(spark, "t"), docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == jaccard_components(near)


def test_components(spark):
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(300)] + [(1000, k) for k in range(500, 700)] + [(k, k + 1) for k in range(2000, 2100)] + [(5, 5), (None, 3)]
    sets = Sets({n for e in edges for n in e if n is not None})
    for a, b in edges:
        if a is not None:
            sets.join(a, b)
    got = {r["node"]: r["component"] for r in components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = Counter(map(sets.find, sets.up))
    assert got == {n: sets.find(n) for n in sets.up if alone[sets.find(n)] > 1}


def mutated(line, edits):
    for _ in range(edits):
        p = random.randrange(len(line))
        line = random.choice([line[:p] + random.choice("xyé") + line[p + 1 :], line[:p] + line[p + 1 :], line[:p] + "z" + line[p:]])
    return line


@pytest.mark.parametrize(("threshold", "crowd", "small"), [(1, 32, 1000), (1, 4, 0), (2, 32, 0), (0, 32, 1000)])
def test_line_dedup(spark, threshold, crowd, small, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "SMALL", small)
    base = ["".join(random.choices("abcdefgh é", k=random.choice([15, 17, 40, 90]))) for _ in range(10)]
    rows = [(i, "\n".join(mutated(random.choice(base), random.choice([0, 1, 2, 3])) for _ in range(random.randint(0, 4)))) for i in range(80)]
    rows += [(500 + i, f"counter value number {i:03d} of a long running series") for i in range(60)]
    rows += [(700, None), (701, ""), (702, "\n\n"), (703, "y" * 5000 + "\n" + "y" * 5001), (704, "short\nshort"), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: set(r["gone"]) for r in line_dedup.removals(Workspace(spark, "t"), df, threshold).collect()}
    assert got == line_removals(rows[:-1], threshold, line_dedup.MIN_LENGTH)


def test_line_stage(spark):
    rows = [(1, "a line that stands in both documents\nown words of the first one", "s"), (2, "a line that stands in both documents", "s"), (3, "own words of the third one here\n\na line that stands in both documents", None), (4, None, None), (5, "", None), (None, "own words of the first one", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("gone", F.lit(1)).withColumn("h", F.lit(2))
    out = {r["doc_id"]: r for r in line_dedup.stage(spark, docs, "").collect()}
    assert set(out) == {1, 3, 4, 5, None}
    assert out[1]["text"] == "a line that stands in both documents" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[3]["text"] == "own words of the third one here\n" and out[4]["text"] is None and out[5]["text"] == ""
    assert line_dedup.stage(spark, docs.limit(0), "").count() == 0


def test_bit_parallel_distance(spark):
    from .brute import within

    pairs = [(a, b) for a in ("", "a", "abcdef", "abcdé", "bcdefg") for b in ("", "b", "abdef", "xabcdef", "abcdeg", "fedcba", "bcdefg")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for t in (0, 1, 2, 3):
        got = df.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), t).alias("w")).collect()
        assert all(r["w"] == within(r["a"], r["b"], t) for r in got)


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated sharing, for every source in order."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[k] for k in full)
        w = sum(weights[k % 3] for k in range(len(sizes)) if k not in full)
        goal = [most * s if k in full else (left * weights[k % 3] / w if w else 0) for k, s in enumerate(sizes)]
        over = {k for k in range(len(sizes)) if k not in full and goal[k] > most * sizes[k]}
        if not over:
            return goal
        full |= over


def test_mixing(spark):
    rows = [(i, random.choice(["a", "a", "a", "a", "b", "ç", "Z", None, "tiny"]), " ".join(["w"] * random.choice([0, 1, 5, 50, 300, 2000]))) for i in range(900)]
    rows += [(9000, "void", ""), (9001, "a", None), rows[4], (None, "b", "w w w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).repartition(4)
    out = cube_mixing.mix(Workspace(spark, "t"), df).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    want = dict(zip(order, shares([sizes[s] for s in order]), strict=True))
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(5, 0.01 * want[s]) for s in order)
    again = cube_mixing.mix(Workspace(spark, "t"), df.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    staged = Counter(r["doc_id"] for r in cube_mixing.stage(spark, df, "").collect())
    copies = Counter()
    for r in out:
        copies[r["doc_id"]] += r["copies"]
    assert staged == Counter({k: v for k, v in copies.items() if v})
    assert cube_mixing.mix(Workspace(spark, "t"), df.limit(0)).count() == 0


def test_mixing_keeps_documents_too(spark, monkeypatch):
    """With several blocks and a document in very many rows: words near the targets, and the numbers of documents that the rates ask for."""
    monkeypatch.setattr(cube_mixing.sample, "__defaults__", (7, 64))
    rows = [(i, random.choice("aaab"), " ".join(["w"] * random.randint(1, 400))) for i in range(3000)] + [(-1, "a", "x y z")] * 2000 + [(None, "b", " ".join(["w"] * 20000))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("rows", F.lit("clash")).withColumn("own", F.lit(1))
    out = cube_mixing.mix(Workspace(spark, "t"), df).collect()
    assert len(out) == len(rows)
    for source in "ab":
        mine = [r for r in out if r["source"] == source]
        target, size = mine[0]["target"], mine[0]["source_size"]
        assert abs(sum(r["taken"] for r in mine) - target) <= 0.001 * target
        # One unit more or less for each of the equal rows' units, the landing and the ones decided at once.
        assert abs(sum(r["copies"] for r in mine) - len(mine) * target / size) <= 3
    copies = sorted(r["copies"] for r in out if r["doc_id"] == -1)
    assert copies[-1] - copies[0] <= 1
    staged = cube_mixing.stage(spark, df, "")
    assert staged.columns == df.columns and staged.where("doc_id = -1").count() == sum(copies)


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    p, size = rng.random(2000), rng.integers(1, 5000, 2000)
    out = cube_mixing.flight(p, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() / (p * size).sum() - 1) < 1e-9
    kept = cube_mixing.flight(p, size, rng, left_out=12)
    assert (kept[-12:] == p[-12:]).all() and ((kept[:-12] > 0) & (kept[:-12] < 1)).sum() <= 2
    landed = cube_mixing.land(kept, size)
    assert set(landed) <= {0.0, 1.0} and abs(landed.sum() - p.sum()) <= 1 and abs((landed * size).sum() - (p * size).sum()) < 100
    mean = np.mean([cube_mixing.land(cube_mixing.flight(np.full(30, 0.3), np.arange(30), np.random.default_rng(k), left_out=3), np.arange(30)) for k in range(2000)], 0)
    assert abs(mean.mean() - 0.3) < 0.02 and np.abs(mean - 0.3).mean() < 0.1


@pytest.mark.parametrize("tile", [1 << 19, 16])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 24))
    rows = []
    for v in base:
        for _ in range(rng.integers(1, 7)):
            rows.append((v + rng.normal(size=24) * rng.choice([0, 0.05, 0.12, 0.3]), int(rng.integers(0, 2))))
    rows += [(base[0] * 2, 0)] * 30 + [(base[1] + rng.normal(size=24) * 0.05, 1) for _ in range(60)]
    data = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [1.0, None], 1), (904, [1.0], None), (905, [], 1), (906, [1e-30, 0.0], 1), (907, [2e-30, 0.0], 1), (908, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).repartition(4)
    got = {r["vec_id"]: r for r in embedding_dedup.dedup(Workspace(spark, "t"), df, tile=tile).collect()}
    assert len(got) == len(data) + len(odd)
    x = np.array([v for _, v, _ in data], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([k for *_, k in data])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    sets = Sets(range(len(data)))
    for i, j in zip(*np.nonzero(near), strict=True):
        sets.join(int(i), int(j))
    for i in range(len(data)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), sets.find(i), sets.find(i) == i)
    assert [got[i]["n_links"] for i in (900, 901, 902, 903, 904, 905, 908)] == [0] * 7
    assert got[906]["n_links"] == got[907]["n_links"] == 1 and got[907]["component_id"] == 906
    assert embedding_dedup.dedup(Workspace(spark, "t"), df.limit(0)).count() == 0


def test_embeddings_grid(spark):
    """Deep grids, doubles as they are, and the exact result at every number of coordinates."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 32))
    data = np.concatenate([base, base + rng.normal(size=base.shape) * rng.choice([0.02, 0.1, 0.14, 0.16], size=(400, 1)), base[:50]])
    x = data / np.linalg.norm(data, axis=1)[:, None]
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(data)], "vec_id long, embedding array<double>, label int")
    steps = embedding_dedup.plans(data, 0.98)
    assert steps[0] == (0.0, 100) and len(steps) > 3 and steps[-1][1] >= 400
    for plan in (100, 102, 205, 400, 804, 808):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(embedding_dedup, "plans", lambda *_, plan=plan: [(0.0, plan)])
            got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.dedup(Workspace(spark, "t"), df).collect()}
        assert [got[i] for i in range(len(data))] == near.sum(1).tolist()


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/é", "<html><head><title>T &amp; t</title><script>x<y</script></head><body><p>one<br>two</p><!-- no --></body>"), (2, None, None), (3, "http://b", ""), (None, "http://c", "plain"), (1, "http://a/é", "<p>again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit(0)).withColumn("record_id", F.lit("clash"))
    records = warc.derive(warc.responses(pages))
    got = records.collect()
    assert len(got) == 2 * len(rows)
    text = {r["page_id"]: r["block"] for r in got if r["record_type"] == "conversion" and r["target_uri"] != "http://a/é"}
    assert text == {2: "", 3: "", None: "plain"}
    first = next(r for r in got if r["record_type"] == "conversion" and "one" in r["block"])
    assert first["block"] == "T & t\none\ntwo"
    meta = next(r for r in got if r["record_type"] == "metadata" and r["refers_to"] == first["refers_to"])
    assert first["refers_to"] in meta["block"] and meta["source_headers"] in meta["block"] and first["payload_digest"] in meta["block"]
    assert first["concurrent_to"] == meta["record_id"] and meta["concurrent_to"] == first["record_id"]
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        warc.write(records, path, compression)
        back = warc.read(spark, path).collect()
        assert Counter((r["headers"]["warc-record-id"], bytes(r["block"]).decode()) for r in back) == Counter((r["record_id"], r["block"]) for r in got)
        assert {(r["headers"]["warc-refers-to"], r["headers"]["warc-refers-to-payload-digest"]) for r in back} == {(r["refers_to"], r["payload_digest"]) for r in got}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")
    (tmp_path / "bad" / "y.warc.gz").write_bytes(b"\x1f\x8bnot gzip")
    assert [bool(r["error"]) for r in warc.read(spark, str(tmp_path / "bad")).collect()] == [True, True]
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_warc_text(spark):
    """References and unclosed elements against the standard library's reading of references."""
    import html as std

    whole = {
        "caf&eacute; &#8217;x &mdash; &euro; &#x1F600; &amp;lt; &nosuch; & &#0; &#150; &hellip;": None,
        "a<script>var x = 1;": "a", "a<!-- never closed <p>b": "a", "a<p class='x": "a", "x<style>p{}</style >y": "x y", "x &copy y": "x &copy y",
        "<p>" + "long &amp; " * 30000 + "</p>": ("long & " * 30000).strip(), "&": "&", "&&amp;&": "&&&",
    }
    got = {r["html"]: r["text"] for r in spark.createDataFrame([(k,) for k in whole], "html string").select("html", warc.plain_text(F.col("html")).alias("text")).collect()}
    for k, v in whole.items():
        assert got[k] == (v if v is not None else std.unescape(k).replace("\xa0", " "))


def response(url, head, body, **fields):
    block = head.encode("latin-1") + b"\r\n\r\n" + body
    named = {"WARC-Type": "response", "WARC-Target-URI": url, "WARC-Date": "2021-05-06T07:08:09Z", "WARC-Record-ID": f"<urn:x:{url}>", **fields, "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in named.items()) + b"\r\n" + block + b"\r\n\r\n"


def test_warc_from_captures(spark, tmp_path):
    """From files of captures to derived records: own identifiers, dates, headers and digests; bodies chunked, zipped and in other charsets; a damaged end."""
    import gzip

    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nx: y\r\n\r\n"
    latin = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nX-Own: kept"
    chunked = "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip"
    packed = gzip.compress("<p>zipped ü</p>".encode())
    chunks = b"%x\r\n%s\r\n%x;ext=1\r\n%s\r\n0\r\n\r\n" % (5, packed[:5], len(packed) - 5, packed[5:])
    records = [
        info, response("http://a/", latin, "<p>caf\xe9</p>".encode("latin-1"), **{"WARC-Payload-Digest": "sha1:OWN", "WARC-Block-Digest": "sha1:BLOCK"}),
        response("http://b/", chunked, chunks), response("http://c/", "HTTP/1.1 200 OK", b"<meta charset='windows-1251'><p>\xcf\xf0</p>"), response("http://d/", "HTTP/1.1 404 Not Found", b""),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "in" / "b.warc.gz").write_bytes(gzip.compress(response("http://e/", "HTTP/1.1 200 OK", b"<p>whole")) + gzip.compress(response("http://f/", "HTTP/1.1 200 OK", bytes(random.choices(range(256), k=9000))))[:4000])
    read = warc.read(spark, str(tmp_path / "in"))
    assert Counter(r["record_type"] for r in read.where("error is null").collect()) == {"warcinfo": 1, "response": 5}
    assert read.where("error is not null").count() == 1
    got = warc.derive(warc.captured(read)).collect()
    texts = {r["target_uri"]: r for r in got if r["record_type"] == "conversion"}
    assert {k: r["block"] for k, r in texts.items()} == {"http://a/": "café", "http://b/": "zipped ü", "http://c/": "Пр", "http://d/": "", "http://e/": "whole"}
    a = texts["http://a/"]
    assert (a["refers_to"], a["date"], a["payload_digest"]) == ("<urn:x:http://a/>", "2021-05-06T07:08:09Z", "sha1:OWN") and "X-Own: kept" in a["source_headers"]
    meta = next(r for r in got if r["record_type"] == "metadata" and r["target_uri"] == "http://a/")
    assert "X-Own: kept" in meta["block"] and "sha1:BLOCK" in meta["block"]
    warc.write(warc.derive(warc.captured(read)), str(tmp_path / "out"))
    back = {r["headers"]["warc-record-id"]: bytes(r["block"]).decode() for r in warc.read(spark, str(tmp_path / "out")).collect()}
    assert back == {r["record_id"]: r["block"] for r in got}


def test_warc_sql(spark):
    c = duckdb.connect()
    c.execute("create view pages as select * from read_parquet('/root/testdata/sf0.001/pages.parquet')")
    want = c.execute(warc.sql()).df()
    got = warc.query(spark, "/root/testdata/sf0.001").toPandas()
    assert sorted(got["record_id"]) == sorted(want["record_id"]) and sorted(got["block_digest"]) == sorted(want["block_digest"])


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and all(r["length"] <= 2048 for r in out)
    odd = docs.limit(20).unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", "xx", None, 0), (-1, "", "xx", None, 0)], docs.schema)).withColumn("extra", F.lit("e"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_pipeline_stages_against_plain_versions(spark):
    """Each stage on what its predecessor kept, against a plain version of its decision; the last one by what its pieces say of the texts."""
    import corpus_pipeline
    from sheafwork.llm import quality_crf
    from sheafwork.llm.common import table
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    space = Workspace(spark, "t")
    stages = dict(corpus_pipeline.STAGES)
    docs = [table(spark, sf, "documents")]
    for name in list(stages)[:-1]:
        docs.append(space.store(stages[name](spark, docs[-1], sf)))
    rows = [sorted(map(tuple, d.select("doc_id", "text", "source").collect()), key=str) for d in docs]
    scores = {r["doc_id"]: r["score"] for r in quality_crf.query(spark, sf).collect()}
    assert rows[1] == [r for r in rows[0] if scores[r[0]] >= quality_crf.THRESHOLD] and 0 < len(rows[1]) < len(rows[0])
    gone = line_removals([(i, t) for i, t, _ in rows[1]], line_dedup.THRESHOLD, line_dedup.MIN_LENGTH)
    cut = {i: t if i not in gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t, _ in rows[1]}
    assert {i: t for i, t, _ in rows[2]} == {i: t for i, t in cut.items() if i not in gone or WORD.search(t)} and gone
    parts = jaccard_components([(i, t) for i, t, _ in rows[2]])
    assert [r[0] for r in rows[3]] == [r[0] for r in rows[2] if parts[r[0]][1] == r[0]]
    sizes, taken, largest = Counter(), Counter(), Counter()
    for _, t, s in rows[3]:
        sizes[s] += len(WORD.findall(t))
        largest[s] = max(largest[s], len(WORD.findall(t)))
    for _, t, s in rows[4]:
        taken[s] += len(WORD.findall(t))
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    want = dict(zip(order, shares([sizes[s] for s in order]), strict=True))
    assert all(abs(taken[s] - want[s]) <= max(largest[s] / 2, 0.01 * want[s]) for s in order)  # sources of a few documents
    assert max(Counter(r[0] for r in rows[4]).values()) <= 3
    import public_tokenizers

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = Counter({i: len(encoder.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _ in rows[4]})
    pieces = list(stages["packing"](spark, docs[-1], sf).collect())
    packed = Counter()
    for r in pieces:
        packed[r["doc_id"]] += r["length"]
    assert packed == Counter({i: n * k for i, k in Counter(r[0] for r in rows[4]).items() for n in [tokens[i]]})
