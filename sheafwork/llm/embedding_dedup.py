"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors with a cosine of at least c are at most 2 - 2c apart in squared
distance. After a fixed rotation the coordinates are split into blocks, and each
linked pair has a block whose squared distance is within that block's share of the
total, in proportion to its dimensions. Each block is range-joined on a grid over
its first coordinates: a vector is listed in its own cell and in those later cells
that a ball of the block's budget around it reaches, so a pair meets once in a block. In a cell every pair within the
block's share is verified on the whole vectors, and counts in the first block that
finds it. Cells send on numbers of links and a spanning forest, never all pairs.

Equal vectors of a label are joined before that and count by their number. How many
blocks a label is split into, and how many coordinates their grids have, follows from
its number of vectors and from what grids prune of a bounded sample of the vectors
(``SAMPLE``); that decides cost only. A label of few vectors is one block without a
grid. A cell that still holds many is cut into tiles that meet pairwise, so no task
holds more than a tile.

Defined results: a row whose label, vector or vec_id is null, or whose vector is
empty, zero or has a null or non-finite component, has no link and is its own component;
vectors of different lengths never link; vectors of floats or doubles are compared as
they are, in double precision; a vector of any length is compared whole; repeated rows
are linked copies; at ties the smallest vec_id stands for the component; columns besides
vec_id, label and embedding are not read, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Workspace, bounded_batches, components, table

COSINE = 0.98
BLOCKS = (1, 2, 4, 8)
#: Numbers that the vectors of one tile of a cell hold, at most; at 64 dimensions 8192 vectors.
TILE = 1 << 19
#: Grid coordinates of a block, at most.
MOST_COORDINATES = 8
#: Vectors from which the pruning of grids is estimated, at most.
SAMPLE = 2000
#: Pairs that are compared in the time that one listed row takes.
PAIRS_A_ROW = 400


@lru_cache(8)
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(d)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def spans(d: int, blocks: int) -> list[tuple[int, int]]:
    cut = np.linspace(0, d, min(blocks, d) + 1).astype(int)
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def shares(d: int, cosine: float, blocks: int) -> np.ndarray:
    """Each block's share of the squared distance, with room for rounding."""
    return np.array([(2 - 2 * cosine) * (j - i) / d for i, j in spans(d, blocks)]) * (1 + 1e-9) + 1e-12


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # keeps the squares of tiny and huge components finite
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def reached(y: np.ndarray, r: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(own cell of each row, (rows, their cells) by the coordinates that a step is taken in) for grid coordinates y.

    A cell is two radii wide, so the ball reaches over one side of it at most in each
    coordinate, and over several of them only if the squared gaps sum to no more than
    the squared radius.
    """
    width = 2.001 * r
    base = int(2 / width) + 8
    k = min(y.shape[1], int(62 / np.log2(base)))
    y = y[:, :k]
    place = base ** np.arange(k, dtype=np.int64)
    at = y / width
    cell = np.floor(at)
    part = at - cell
    step = np.where(part < 0.5, -1, 1)
    gap = (np.minimum(part, 1 - part) * width) ** 2
    home = ((cell.astype(np.int64) + base // 2) * place).sum(1)
    found = []
    for bits in range(1, 1 << k):
        taken = np.array([bits >> t & 1 for t in range(k)], bool)
        rows = np.flatnonzero(gap[:, taken].sum(1) <= r * r * (1 + 1e-9))
        if len(rows):
            found.append((rows, home[rows] + (step[rows][:, taken] * place[taken]).sum(1)))
    return home, found


def _list(cosine: float, schema: str):
    def run(batches):
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            label, rep, mult, many, dim = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            vec = batch.column(5)
            for d in np.unique(dim):
                for g in np.unique(many[dim == d]):
                    at = np.flatnonzero((dim == d) & (many == g))
                    own = vec.take(pa.array(at))
                    x = unit(own.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)) @ rotation(int(d))
                    blocks, coordinates = divmod(int(g), 100)
                    for b, (i, j) in enumerate(spans(int(d), blocks)):
                        r = np.sqrt(shares(int(d), cosine, blocks)[b]) * (1 + 1e-9)
                        home, others = reached(x[:, i : min(i + coordinates, j)], r)
                        listed = [(np.arange(len(at)), home, True)]
                        listed += [(rows[cell > home[rows]], cell[cell > home[rows]], False) for rows, cell in others]
                        for rows, cell, flag in listed:
                            if len(rows):
                                sel = at[rows]
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(label[sel]), pa.array(np.full(len(sel), 100 * blocks + b, np.int32)), pa.array(cell), pa.array(np.full(len(sel), flag)), pa.array(rep[sel]), pa.array(mult[sel]), vec.take(pa.array(sel))],
                                    names,
                                )

    return run


def plans(sample: np.ndarray, cosine: float) -> list[tuple[float, int]]:
    """(number of vectors of a label, plan from there on), ascending; a plan is 100 times the blocks and the coordinates of their grids.

    A plan's rows cost their listing; its pairs cost by the share of the sample's pairs
    that meet in its cells.
    """
    n, d = sample.shape
    if n < 32:
        return [(0.0, 100 * BLOCKS[0])]
    x = unit(sample) @ rotation(d)
    made, rows, meeting = [], [], []
    for blocks in BLOCKS:
        for k in range(MOST_COORDINATES + 1):
            listed = met = 0
            for (i, j), share in zip(spans(d, blocks), shares(d, cosine, blocks), strict=True):
                home, others = reached(x[:, i : min(i + k, j)], np.sqrt(share))
                order = np.sort(home)
                listed += n + sum((cell > home[at]).sum() for at, cell in others)
                met += (np.searchsorted(order, home, "right") - np.searchsorted(order, home, "left") - 1).sum()
                met += sum((np.searchsorted(order, cell, "right") - np.searchsorted(order, cell, "left")).sum() for _, cell in others)
            made.append(100 * blocks + k)
            rows.append(listed / n)
            meeting.append(max(met, 1) / (n * (n - 1)))
    size = np.geomspace(1, 1e12, 800)
    best = (np.outer(rows, size) * PAIRS_A_ROW + np.outer(meeting, size * size / 2)).argmin(0)
    starts = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    return [(float(size[i]) if i else 0.0, made[best[i]]) for i in starts]


def _low(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes is joined to."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _meet(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links inside one tile: kind 0 (rep, number of linked rows), kind 1 (rep, another rep it is joined with)."""
        pdf = pdf.sort_values(["rep", "own"])
        out = []
        for d, part in pdf.groupby(pdf["vec"].map(len), sort=True):
            v = unit(np.stack(part["vec"].to_numpy()))
            own, side, rep, mult = (part[c].to_numpy() for c in ("own", "side", "rep", "mult"))
            (blocks, b), same = divmod(int(part["block"].iloc[0]), 100), part["ti"].iloc[0] == part["tj"].iloc[0]
            share, cut = shares(int(d), cosine, blocks), spans(int(d), blocks)
            got_i, got_j = [], []
            for at in range(0, len(v), 512):
                near = v[at : at + 512] @ v.T >= cosine - 1e-9
                i, j = np.nonzero(near)
                i += at
                ok = (i < j) & (own[i] | own[j]) & (same | (side[i] != side[j]))
                i, j = i[ok], j[ok]
                for s in range(0, len(i), 20_000):
                    a, c = v[i[s : s + 20_000]], v[j[s : s + 20_000]]
                    delta = ((a - c) @ rotation(int(d))) ** 2
                    within = np.column_stack([delta[:, x:y].sum(1) for x, y in cut]) <= share
                    good = ((a * c).sum(1) >= cosine) & (within.argmax(1) == b) & within.any(1)
                    got_i.append(i[s : s + 20_000][good])
                    got_j.append(j[s : s + 20_000][good])
            if got_i:
                i, j = np.concatenate(got_i), np.concatenate(got_j)
                n = np.bincount(i, mult[j], len(v)) + np.bincount(j, mult[i], len(v))
                hit = np.flatnonzero(n)
                out.append(pd.DataFrame({"kind": 0, "rep": rep[hit], "value": n[hit].astype(np.int64)}))
                low = _low(len(v), i, j)
                hit = np.flatnonzero(low != np.arange(len(v)))
                out.append(pd.DataFrame({"kind": 1, "rep": rep[hit], "value": rep[low[hit]]}))
        return pd.concat(out) if out else pd.DataFrame({"kind": [], "rep": [], "value": []})

    return run


def dedup(space: Workspace, vectors: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = space.spark
    bounded_batches(spark)
    v = F.col("embedding")
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    usable = finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    element = "float" if vectors.schema["embedding"].dataType == ArrayType(FloatType()) else "double"
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    good = rows.where(usable)
    classes = space.store(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")))
    sizes = classes.groupBy("label").agg(F.count("*").alias("n"))
    # The vectors with the lowest hashes are a sample of no order; all of one length, the most frequent one.
    seen = classes.select("embedding", F.size("embedding").alias("d")).orderBy(F.xxhash64("embedding")).limit(SAMPLE).toPandas()
    steps = [(0.0, 100 * BLOCKS[0])]
    if len(seen):
        seen = seen[seen["d"] == seen["d"].mode()[0]]
        steps = plans(np.stack(seen["embedding"].to_numpy()), cosine)
    depth = F.lit(steps[0][1])
    for n, plan in steps[1:]:
        depth = F.when(F.col("n") >= n, plan).otherwise(depth)
    held = F.greatest(F.lit(16), F.floor(F.lit(tile) / F.greatest(F.col("d"), F.lit(1))))  # vectors of a tile
    schema = f"label long, block int, cell long, own boolean, rep long, mult long, vec array<{element}>"
    listed = classes.join(sizes.select("label", depth.cast("int").alias("depth")), "label").select("label", "rep", "mult", "depth", F.size("embedding").alias("d"), "embedding")
    listed = space.store(listed.mapInArrow(_list(cosine, schema), schema))
    key = ["label", "block", "cell"]
    full = listed.groupBy(*key).agg(F.count("*").alias("m"), F.count(F.when(F.col("own"), 1)).alias("owned"), F.max(F.size("vec")).alias("d")).where("owned > 0 and m > 1")
    full = full.withColumn("k", F.ceil(F.col("m") / held).cast("int")).select(*key, "k")
    tiled = listed.join(full, key).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
    tiled = tiled.withColumn("ti", F.least("side", "other")).withColumn("tj", F.greatest("side", "other"))
    met = space.store(tiled.groupBy(*key, "ti", "tj").applyInPandas(_meet(cosine), "kind int, rep long, value long"))
    counts = met.where("kind = 0").groupBy("rep").agg(F.sum("value").alias("links"))
    comps = components(space, met.where("kind = 1"), "rep", "value").select(F.col("node").alias("rep"), "component")
    of = classes.join(counts, "rep", "left").join(comps, "rep", "left")
    of = of.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return space.settle(out.unionByName(rest)).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(Workspace(spark, "embedding_dedup"), table(spark, sf_dir, "embeddings"))


def sql() -> str:
    """All pairs of a label, in DuckDB's SQL."""
    return f"""
    with recursive v as (
        select vec_id, label, cast(embedding as double[]) as v from embeddings
        where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links as materialized (
        select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= {COSINE}
    ), reach as (select vec_id, vec_id as c from embeddings union select l.b, r.c from reach r join links l on r.vec_id = l.a),
    c as (select vec_id, min(c) as component_id from reach group by vec_id), n as (select a as vec_id, count(*) as n from links group by a)
    select e.vec_id, coalesce(n, 0) as n_links, component_id, e.vec_id = component_id as kept from embeddings e join c on e.vec_id = c.vec_id left join n on e.vec_id = n.vec_id"""
