"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents whose sets of distinct 5-word shingles have a Jaccard similarity of 0.75
or more are linked, without loss; links are closed to components.

* Shingles have one global order: cold ones by hash, then the hot ones, the rarer
  first. Hot means found in more than ``HOT`` documents; all shingles of all
  documents are counted for that. The order decides cost only, never the result.
* In a set of n, two linked documents share at least l shingles among the first
  n - ceil(0.75 n) + l of each. A document's l is the one with the least estimated
  cost of scanning postings and verifying candidates; the longer the prefixes of a
  pair, the more shingles they must share there.
* Equal sets are one node from the start. Postings of cold shingles give all pairs.
  A pair goes on if its shared shingles and those behind its prefixes can make up the
  needed overlap, and is verified on the whole sets.
* Postings of hot shingles give clusters. A cluster's centre is the set of shingles
  that more than half of its nodes hold, and a node is described by its difference
  from it (see ``_clusters``). Nodes near the centre are linked by that alone;
  others can only be linked through shingles of their differences, which few hold.
* Pairs already joined by other links are not looked at, since only components are
  returned.

Defined results: null text and text without words have an empty set, n_shingles 0,
and are linked with nothing; under five words the whole sequence is one shingle;
repeated rows and ties are linked and share the smallest doc_id; rows of one doc_id
with different texts are separate, each with its own links; a row without doc_id is
linked like others and counts last in its component, whose id is null only if no row
of it has one; texts of any length are read whole; an empty table gives an empty
result; columns besides doc_id and text are not read, whatever their names. Shingles,
and sets of equal size, are compared by 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Workspace, bounded_batches, components, shuffles_released, table
from .textbytes import Words, blocks, mix

SHINGLE = 5
#: A shingle in more documents than this is hot.
HOT = 48
#: Hot shingles that the order knows, the most frequent ones: at most 25 MB for each worker. Others are ordered as cold ones and found hot when their postings are read.
KNOWN_HOT = 1 << 21
#: A known shingle in more documents than this needs no reading of its postings in one place to be found hot.
SURELY_HOT = 512
#: Lengths by which prefixes may grow.
LEVELS = (1, 2, 4, 8, 16, 32)

_U = np.uint64


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for block in blocks(column):
        words = Words(block, lower=True)
        at, h = words.windows(SHINGLE)
        cut = np.searchsorted(words.row, np.arange(block.n + 1))
        where = np.searchsorted(at, cut)
        for k in range(block.n):
            i, j = cut[k], cut[k + 1]
            if j - i >= SHINGLE:
                yield np.unique(h[where[k] : where[k + 1]])
            elif j > i:
                weights = np.arange(3, 3 + 2 * (j - i), 2, dtype=np.uint64)
                yield mix(np.array([(words.hash[i:j] * weights).sum() + _U(j - i)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def required(n: int) -> int:
    """Shingles that a set of n shares with any linked set, at least."""
    return -(-3 * n // 4)


# -- counting all shingles ---------------------------------------------------


def _fingerprints(bits: int):
    """Per bucket of the top bits: sorted distinct 32-bit fingerprints, gap-coded, and the counts above one."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(parts) >> _U(32 - bits), return_counts=True)
        cut = np.searchsorted(tokens >> _U(32), np.arange((1 << bits) + 1, dtype=np.uint64))
        keys, payload, more = [], [], []
        for b in np.flatnonzero(np.diff(cut)):
            low = (tokens[cut[b] : cut[b + 1]] & _U(0xFFFFFFFF)).astype(np.int64)
            gaps = np.diff(low, prepend=0).astype("<u4")
            keys.append(int(b))
            payload.append(gaps.view(np.uint8).reshape(-1, 4).T.tobytes())  # the high bytes are mostly zero and compress away
            n = counts[cut[b] : cut[b + 1]]
            often = np.flatnonzero(n > 1)
            more.append(np.stack([often, n[often]]).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(payload, pa.binary()), pa.array(more, pa.binary())], ["bucket", "gaps", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for s in _sets(batch.column(0)):
                held.append(s)
                size += len(s)
                if size > 1_500_000:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _frequent(hot: int):
    def decoded(gaps: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
        g = np.ascontiguousarray(np.frombuffer(gaps, np.uint8).reshape(4, -1).T).view("<u4").ravel()
        n = np.ones(len(g), np.int64)
        where, often = np.frombuffer(more, "<u4").reshape(2, -1)
        n[where] = often
        return np.cumsum(g, dtype=np.int64), n

    def folded(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        value, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(value, kind="stable")
        value, n = value[order], n[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        return value[first], np.add.reduceat(n, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; emits (fingerprint with its bucket, count) of the frequent ones."""
        now, held, size = None, [], 0

        def close() -> pa.RecordBatch:
            value, n = folded(held)
            return pa.RecordBatch.from_arrays([pa.array((now << 32) + value[n > hot], pa.int64()), pa.array(n[n > hot], pa.int64())], ["token", "n"])

        for batch in batches:
            for b, gaps, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if b != now and held:
                    yield close()
                    held, size = [], 0
                now = b
                held.append(decoded(gaps.as_py(), more.as_py()))
                size += len(held[-1][0])
                if size > 2 * len(held[0][0]) + 4_000_000:
                    held = [folded(held)]
                    size = len(held[0][0])
        if held:
            yield close()

    return run


def hot_shingles(space: Workspace, docs: DataFrame, hot: int = HOT, known: int = KNOWN_HOT) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, fingerprints, counts): the most frequent shingles that are hot, about ``known`` at most.

    The driver gets how many have each count, and then only those that are taken;
    of the last count a share by hash.

    A bucket holds about a quarter of what one input partition does, up to 65,536
    input partitions. A shingle is one entry of each one and a half million, however often
    it stands there, and the worker of a bucket adds up entries as they come.
    """
    parts = docs.rdd.getNumPartitions()
    bits = min(18, max(5, math.ceil(math.log2(max(parts, 1))) + 2))
    coded = docs.select("text").mapInArrow(_fingerprints(bits), "bucket int, gaps binary, more binary")
    counted = space.store(coded.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_frequent(hot), "token long, n long"))
    sizes = counted.groupBy("n").agg(F.count("*").alias("of")).toArrow().sort_by([("n", "descending")])
    least, share, room = 0, 1.0, known
    for n, of in zip(sizes["n"].to_pylist(), sizes["of"].to_pylist(), strict=True):
        if of > room:
            least, share = n, room / of
            break
        room -= of
    part = F.pmod(F.xxhash64("token"), F.lit(1 << 20)) < int(share * (1 << 20))
    top = counted.where((F.col("n") > least) | ((F.col("n") == least) & part)).toArrow().sort_by("token")
    space.drop(counted)
    return bits, top["token"].to_numpy().astype(np.uint64), top["n"].to_numpy().astype(np.uint32)


# -- prefixes ----------------------------------------------------------------


def choose_level(counts: np.ndarray, n: int) -> int:
    """The prefix extension with the least estimated cost; counts are of the shingles in global order.

    Scanning costs one per posting; each candidate takes up l postings and costs
    the two sets to verify.
    """
    base, most = n - required(n), required(n)
    total = np.cumsum(counts[: base + LEVELS[-1]])
    best, cost = 1, math.inf
    for level in LEVELS:
        if level > most:
            break
        postings = float(total[min(base + level, n) - 1])
        c = postings + (postings - (base + level)) / level * 2 * n / 16
        if c < cost:
            best, cost = level, c
    return best


def _node(s: np.ndarray) -> int:
    """The name of a set: a hash of its shingles, the same in any order."""
    return int(mix(np.array([mix(s ^ _U(0x5851F42D4C957F2D)).sum() + _U(len(s))], np.uint64)).view(np.int64)[0]) if len(s) else 0


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


_PREFIXES = "doc_id long, n long, node long, level int, end_count long, end_hash long, prefix array<long>, sure array<long>"


def _prefixes(bits: int, known):
    """known: broadcast (fingerprints, counts) of hot shingles. ``sure`` is the part of the prefix that is surely hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, often = known.value
        for batch in batches:
            sizes, nodes, levels, prefixes, sure, ends = [], [], [], [], [], []
            for s in _sets(batch.column(1)):
                n = len(s)
                sizes.append(n)
                nodes.append(_node(s))
                if n == 0:
                    levels.append(0)
                    prefixes.append(s.view(np.int64))
                    sure.append(s.view(np.int64))
                    ends.append((0, 0))
                    continue
                counts = np.ones(n, np.int64)
                if len(hot):
                    key = s >> _U(32 - bits)
                    place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    found = hot[place] == key
                    if found.any():
                        counts[found] = often[place[found]]
                        order = np.argsort(counts, kind="stable")
                        s, counts = s[order], counts[order]
                level = choose_level(counts, n)
                levels.append(level)
                p = n - required(n) + level
                split = int(np.searchsorted(counts[:p], SURELY_HOT, "right"))
                prefixes.append(s[:split].view(np.int64))
                sure.append(s[split:p].view(np.int64))
                ends.append((int(counts[p - 1]), int((s[p - 1 : p] ^ _U(1 << 63)).view(np.int64)[0])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(levels, pa.int32()),
                    pa.array([e[0] for e in ends], pa.int64()), pa.array([e[1] for e in ends], pa.int64()), _lists(prefixes), _lists(sure),
                ],
                [f.split()[0] for f in _PREFIXES.split(", ")],
            )

    return run


# -- postings ----------------------------------------------------------------

_SCAN = "kind int, a long, b long, token long, shared int"


def _scan(limit: int):
    """Postings (token, node, n) sorted by token, in. Out: kind 0, pairs of nodes and the cold shingles that
    their prefixes share in this batch; kind 1, the hot postings as they are.
    """

    def pairs(token: np.ndarray, node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of whole runs of at most ``limit``."""
        begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(begins, len(token)))
        left = [np.zeros(0, np.int64)]
        place = np.arange(len(token)) - np.repeat(begins, size)
        rest = np.repeat(size, size) - place - 1
        right = [np.zeros(0, np.int64)]
        for gap in range(1, int(size.max(initial=1))):
            i = np.flatnonzero(rest >= gap)
            left.append(i)
            right.append(i + gap)
        i, j = np.concatenate(left), np.concatenate(right)
        ok = (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])) & (node[i] != node[j])
        return node[i[ok]], node[j[ok]]

    def batch_of(kind: int, a, b, token, shared) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(token), pa.array(shared.astype(np.int32))], [f.split()[0] for f in _SCAN.split(", ")])

    def cold(token, node, n) -> pa.RecordBatch:
        a, b = pairs(token, node, n)
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
        return batch_of(0, a[first], b[first], np.zeros(len(first), np.int64), np.diff(np.append(first, len(a))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(0, np.int64)
        token, node, n = zero, zero, zero
        streaming = None  # a hot token of which rows have been passed on

        def finish(token, node, n, hot_token):
            """Whole runs, but that the first one is the rest of hot_token's."""
            if not len(token):
                return
            begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(begins, len(token)))
            many = size > limit
            if hot_token is not None and token[0] == hot_token:
                many[0] = True
            row_many = np.repeat(many, size)
            keep = np.repeat((size > 1) & ~many, size)
            if row_many.any():
                m = int(row_many.sum())
                yield batch_of(1, node[row_many], np.zeros(m, np.int64), token[row_many], np.zeros(m))
            if keep.any():
                yield cold(token[keep], node[keep], n[keep])

        for batch in batches:
            token = np.concatenate([token, batch.column(0).to_numpy(zero_copy_only=False)])
            node = np.concatenate([node, batch.column(1).to_numpy(zero_copy_only=False)])
            n = np.concatenate([n, batch.column(2).to_numpy(zero_copy_only=False)])
            if not len(token):
                continue
            open_ = int(np.searchsorted(token, token[-1], "left"))  # the last run may go on
            if len(token) - open_ > limit or (streaming is not None and token[-1] == streaming):
                yield from finish(token, node, n, streaming)
                streaming = token[-1]
                token, node, n = zero, zero, zero
            else:
                yield from finish(token[:open_], node[:open_], n[:open_], streaming)
                token, node, n = token[open_:], node[open_:], n[open_:]
        yield from finish(token, node, n, streaming)

    return run


# -- hot postings ------------------------------------------------------------


def _members(space: Workspace, rows: DataFrame, facts: DataFrame) -> DataFrame:
    """(r, node): the clusters. rows: (token, node), all hot postings.

    The nodes of a posting, in overlapping bands of set sizes, are a cluster under its
    node with most hot postings, so nodes that are similar and share a hot posting are
    in one cluster.
    """
    banded = rows.join(facts.select("node", "n", "hidden"), "node").withColumn("band", F.floor(F.log("n") / math.log(1.34)))
    banded = banded.select("token", "node", "hidden", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    heads = banded.groupBy("token", "band").agg(F.min(F.struct((-F.col("hidden")).alias("k"), F.xxhash64("node"), F.col("node").alias("r")))["r"].alias("r"), F.count("*").alias("of"))
    return space.store(banded.join(heads.where("of > 1").drop("of"), ["token", "band"]).select("r", "node").distinct())


def _clusters(space: Workspace, members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) by the nodes' differences from the centre of their cluster, and what is left to be compared.

    Two sets of n and m are similar if their symmetric difference is at most
    (n + m) / 7. With the differences D and E of the two from the same centre it is
    |D| + |E| - 2 |D n E|. So with slack = n - 7 |D|

    * two nodes are linked for certain if their slacks sum to 0 or more: each node is
      held against the one of most slack in its cluster;
    * a node that fails there (a loose one) must share elements of its difference
      with a partner, 14 for each element making up for the two slacks. Elements that
      no other node of the cluster holds do not count, and most loose nodes drop out
      for lack of others. The rest meet, for each element, the node of most slack
      that holds it.

    Left over are rows (r, t, node, slack, d, loose): cluster, element of the
    difference, the node and the number of its elements that others hold, for all
    nodes that may still be linked with a loose one.
    """
    whole = members.join(sets, "node")
    held = whole.select("r", F.explode("tokens").alias("t")).groupBy("r", "t").agg(F.count("*").alias("held"))
    half = members.groupBy("r").agg((F.count("*") / 2).alias("half"))
    centres = held.join(half, "r").where("held > half").groupBy("r").agg(F.collect_list("t").alias("centre"))
    centre = F.coalesce("centre", F.array().cast("array<long>"))
    apart = whole.join(centres, "r", "left").select("r", "node", F.size("tokens").cast("long").alias("n"), F.concat(F.array_except(centre, "tokens"), F.array_except("tokens", centre)).alias("apart"))
    apart = space.store(apart.select("r", "node", (F.col("n") - 7 * F.size("apart")).alias("slack"), "apart"))
    top = apart.groupBy("r").agg(F.max(F.struct("slack", "node")).alias("x")).select("r", F.col("x.slack").alias("most"), F.col("x.node").alias("best"))
    marked = apart.join(top, "r").withColumn("loose", F.col("slack") + F.col("most") < 0)
    near = space.store(marked.where("not loose and node <> best").select(F.col("node").alias("a"), F.col("best").alias("b")))
    unsettled = marked.where("loose").select("r").distinct()
    each = marked.join(unsettled, "r", "left_semi").select("r", "node", "slack", "most", "loose", F.explode("apart").alias("t"))
    shared = each.groupBy("r", "t").agg(F.count("*").alias("of"), F.max("loose").alias("any"), F.max(F.struct("slack", "node")).alias("x"))
    shared = shared.where("of > 1 and any").select("r", "t", F.col("x.slack").alias("top_slack"), F.col("x.node").alias("top"))
    each = space.store(each.join(shared, ["r", "t"]))
    nodes = each.groupBy("r", "node", "slack", "most", "loose").agg(F.count("*").alias("d"), F.max("top_slack").alias("near"))
    reach = nodes.groupBy("r").agg(F.max(F.col("slack") + 14 * F.col("d")).alias("reach"))
    nodes = space.store(nodes.join(reach, "r").where("not loose or (slack + 14 * d + least(most, near) >= 0 and slack + reach >= 0)").select("r", "node", "d", "loose"))
    # Only elements that a loose node with a chance holds say anything more.
    told = each.where("loose").join(nodes.where("loose").select("r", "node"), ["r", "node"], "left_semi").select("r", "t").distinct()
    each = space.store(each.join(told, ["r", "t"], "left_semi").join(nodes.drop("loose"), ["r", "node"]))
    met = each.where("loose and node <> top").groupBy("r", "node", "top", "slack", "top_slack").agg(F.count("*").alias("s")).where("14 * s + slack + top_slack >= 0")
    met = space.store(met.select(F.col("node").alias("a"), F.col("top").alias("b")).distinct())
    space.drop(members, apart)
    return near.union(met), each.select("r", "t", "node", "slack", "d", "loose")


def _loose_links(space: Workspace, each: DataFrame, comps: DataFrame) -> DataFrame:
    """Links (a, b) of loose nodes with nodes of other components, by counting the elements that differences share.

    Of two nodes of different components one at least is outside the component that
    most nodes of the cluster are in, so only elements that such nodes hold are met on.
    """
    nodes = each.groupBy("r", "node").agg(F.max("loose").alias("loose")).join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = space.store(nodes)
    sizes = nodes.groupBy("r", "component").agg(F.count("*").alias("of"))
    main = sizes.groupBy("r").agg(F.max(F.struct("of", "component"))["component"].alias("main"))
    minor = nodes.join(main, "r").where("component <> main").select("r", "node")
    told = each.join(minor, ["r", "node"], "left_semi").select("r", "t").distinct()
    live = space.store(each.join(told, ["r", "t"], "left_semi").join(nodes.select("r", "node", "component"), ["r", "node"]))
    x, y = live.where("loose").alias("x"), live.alias("y")
    meets = (F.col("x.r") == F.col("y.r")) & (F.col("x.t") == F.col("y.t")) & (F.col("x.component") != F.col("y.component")) & (~F.col("y.loose") | (F.col("x.node") < F.col("y.node")))
    slack = F.col("x.slack") + F.col("y.slack")
    pairs = x.join(y, meets & (slack + 14 * F.least("x.d", "y.d") >= 0))
    counted = pairs.groupBy(F.col("x.r"), F.col("x.node").alias("a"), F.col("y.node").alias("b"), slack.alias("slack")).agg(F.count("*").alias("s"))
    return counted.where("14 * s + slack >= 0").select("a", "b").distinct()


# -- the join ----------------------------------------------------------------


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s for s in _sets(batch.column(0)) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), _lists([s.view(np.int64) for s in sets])], ["node", "tokens"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([_node(s) for s in _sets(batch.column(1))], pa.int64())], ["doc_id", "h", "node"])


def _whole_sets(space: Workspace, docs: DataFrame, nodes: DataFrame, used: DataFrame) -> DataFrame:
    """(node, tokens) of the nodes in used. nodes: (node, doc), doc being any document of the node.

    A doc_id may stand on several texts, so the node is told from the text again.
    """
    wanted = used.join(nodes, "node").select("doc").distinct()
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi").select("text")
    sets = texts.mapInArrow(_whole, "node long, tokens array<long>")
    if space.repeated:
        sets = sets.join(used, "node", "left_semi").dropDuplicates(["node"])
    return space.store(sets)


def _verified(space: Workspace, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    good = 100 * common >= 75 * (F.size("ta") + F.size("tb") - common)
    return space.store(both.where(good).select("a", "b"))


def _behind(a: str, b: str) -> Column:
    """Shingles that two sets may share besides those in both prefixes.

    Of the prefix that ends first in the global order every shared shingle lies in
    the other prefix too, so only what stands behind it is not counted.
    """
    first = F.struct(f"{a}.end_count", f"{a}.end_hash") <= F.struct(f"{b}.end_count", f"{b}.end_hash")
    return F.when(first, F.col(f"{a}.n") - F.col(f"{a}.p")).otherwise(F.col(f"{b}.n") - F.col(f"{b}.p"))


def _possible(a: str, b: str, shared: Column) -> Column:
    """Whether sets that share so many cold shingles in their prefixes can be linked; an overlap of 3/7 of both sizes is needed."""
    found = shared + F.least(F.col(f"{a}.hidden"), F.col(f"{b}.hidden"))
    return (found >= F.least(f"{a}.level", f"{b}.level")) & (7 * (found + _behind(a, b)) >= 3 * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    ca = comps.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    joined = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def links(space: Workspace, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of every row, and links (a, b) between nodes that connect what is similar."""
    spark = space.spark
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    bits, hot, often = hot_shingles(space, docs)
    known = spark.sparkContext.broadcast((hot, often))
    rows = space.store(docs.mapInArrow(_prefixes(bits, known), _PREFIXES))
    known.unpersist()
    members = space.store(rows.select("doc_id", "n", "node"))
    space.repeated = not members.where("n > 0").groupBy("doc_id").count().where("count > 1").isEmpty()
    nodes = space.store(members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc")))
    own = nodes.select(F.col("node").alias("own"), "doc")
    one = rows.where("n > 0").join(own, (F.col("node") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi")
    one = one.dropDuplicates(["node"]) if space.repeated else one
    postings = one.select("n", "node", F.explode("prefix").alias("token")).select("token", "node", "n")
    scanned = space.store(postings.repartition("token").sortWithinPartitions("token").mapInArrow(_scan(HOT), _SCAN))
    hot_rows = scanned.where("kind = 1").select("token", F.col("a").alias("node")).union(one.select(F.explode("sure").alias("token"), "node"))
    hidden = hot_rows.groupBy("node").agg(F.count("*").alias("hidden"))
    facts = one.select("node", "n", "level", "end_count", "end_hash", (F.size("prefix") + F.size("sure")).alias("p")).join(hidden, "node", "left")
    facts = space.store(facts.withColumn("hidden", F.coalesce("hidden", F.lit(0))))
    cold = scanned.where("kind = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    x, y = facts.alias("x"), facts.alias("y")
    cold = cold.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(_possible("x", "y", F.col("shared")))
    cold = space.store(cold.select("a", "b", "shared"))
    clusters = _members(space, hot_rows, facts)
    space.drop(rows, scanned, facts)
    used = cold.select(F.col("a").alias("node")).union(cold.select("b")).union(clusters.select("node")).distinct()
    sets = _whole_sets(space, docs, nodes, used)
    # First each node with the partner it shares most with, and the clusters; then whatever is still apart.
    both = cold.unionByName(cold.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    best = both.groupBy("a").agg(F.max(F.struct("shared", F.col("b").alias("p")))["p"].alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = space.store(best.distinct())
    near, loose = _clusters(space, clusters, sets)
    comps = space.store(components(space, _verified(space, sets, first).union(near)).select("node", "component"))
    rest = _apart(cold.select("a", "b"), comps).join(first, ["a", "b"], "left_anti")
    found = _verified(space, sets, rest).union(_loose_links(space, loose, comps))
    return members, comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found)


def groups(space: Workspace, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) of every row; rows of one node have the same set."""
    with shuffles_released(space.spark):
        members, found = links(space, docs)
        nodes = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
        comps = components(space, found)
        top = nodes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        lowest = top.groupBy("component").agg(F.min("low").alias("component_id"))
        of = top.join(lowest, "component").select("node", "component_id")
        linked = members.where("n > 0").join(of, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "node")
        return space.settle(linked.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "node")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(Workspace(spark, "jaccard_join"), table(spark, sf_dir, "documents")).drop("node")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: one whose doc_id names the group.

    Rows without a doc_id, and rows without words, stay. Of several rows that have
    the group's doc_id one stays; their other columns are not looked at. A row goes
    for its own text's links only, whatever other rows have its doc_id.
    """
    space = Workspace(spark, "jaccard_join")
    found = groups(space, docs)
    if not space.repeated:
        gone = space.store(found.where("n_shingles > 0 and doc_id <> component_id").select("doc_id"))
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    found = space.store(found.where("n_shingles > 0 and doc_id is not null").distinct())
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("node").alias("node"))
    gone = found.join(kept, ["doc_id", "node"], "left_anti").select("doc_id", "node")
    # The text's hash tells the rows of one doc_id apart.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).where("doc_id is not null")
    told = rows.mapInArrow(_named, "doc_id long, h long, node long")
    hashes = space.store(told.join(gone, ["doc_id", "node"], "left_semi").select("doc_id", "h").distinct())
    left = docs.alias("d").join(hashes.alias("x"), (F.col("d.doc_id") == F.col("x.doc_id")) & (F.xxhash64("d.text") == F.col("x.h")), "left_anti")
    worded = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return left.where(worded).dropDuplicates(["doc_id", "text"]).unionByName(left.where(~worded))


def sql() -> str:
    """All pairs that share a shingle, in DuckDB's SQL."""
    return r"""
    with recursive w as (
        select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
    ), s as (
        select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' '))) end as s from w
    ), e as (select doc_id, len(s) as n, unnest(s) as t from s),
    links as materialized (
        select a.doc_id as a, b.doc_id as b from e a join e b on a.t = b.t and a.doc_id <> b.doc_id and 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
        group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
    ), reach as (select doc_id, doc_id as c from s union select l.b, r.c from reach r join links l on r.doc_id = l.a)
    select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(c) as component_id from s join reach r on s.doc_id = r.doc_id group by s.doc_id, s.s"""
