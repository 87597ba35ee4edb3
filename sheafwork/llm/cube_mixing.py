"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target of words; target over size is how often each of its words
is wanted on average. The whole part of that number is taken from every document;
the fraction is an inclusion probability. The flight phase of the cube method moves
the probabilities of a block of documents along the null space of the balancing
constraints (documents and words) until few are left undecided; those meet in ever
fewer blocks. At last some documents of a source, whose sizes add up to about any number
of words, land together: of all their roundings the one is taken that keeps the words
nearest to the wanted ones among those that keep the number of documents within one.

Equal rows (of one doc_id, source and text) are one unit with a number: what they are
wanted together is shared among them, so a document that stands in very many rows is
no large block. Blocks hold a bounded number of documents whatever the source's size,
so one source may hold most rows. All choices follow from hashes of doc_id, text and
the seed: reruns agree.

Defined results: null text has size 0 and is never needed; null source is a source of
its own, ordered last; a null doc_id is a value like others; repeated rows are taken
equally often, but for one that some of them are taken more; at ties of size the hash
decides; a source of size 0 has target 0; texts of any length are counted whole;
columns besides doc_id, source and text are not read, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents of one source that one flight handles.
BLOCK = 8192
#: Undecided documents that land together at the end.
LANDING = 18
#: Share of the wanted words to which the landing's sizes should add up to any number.
FINENESS = 0.001


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, size, rows): the number of words of each text, and how many rows are equal."""
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("rows"))


def ranked(sources: DataFrame) -> DataFrame:
    """A column ``place`` from 0 in the order of source, null last, without one task sorting all.

    A range partitioning gives every partition a stretch of the order; the
    partitions' counts (one number each) give the stretches' offsets.
    """
    order = F.col("source").asc_nulls_last()
    parts = sources.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    counts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(counts), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("inside", inside).join(base, "part").withColumn("place", F.col("base") + F.col("inside")).drop("part", "base", "inside")


def targets(space: Workspace, units: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, n, source_size, target): shares of all words by weight, none over ``most`` times its source's size.

    What a full source can't take is shared again by weight, which ends when no
    source is above its limit; each round fills at least one and reads one row per
    source.
    """
    per = units.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = space.store(ranked(space.store(per)).withColumn("weight", cycle).drop("place"))
    total, rate, full = per.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    limit = F.col("source_size") * most
    while True:
        over = limit < F.col("weight") * F.lit(rate) if full >= 0 else F.lit(False)
        filled, held, weight = per.agg(F.count(F.when(over, 1)), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        if filled == full or not weight:
            break
        full, rate = filled, (total - (held or 0)) / weight
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(float(rate)))
    return per.select("source", "n", "source_size", target.alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, left_out: int = 0) -> np.ndarray:
    """Probabilities with their sum and their size-weighted sum kept, of which at most two, and the last ``left_out``, lie strictly between 0 and 1.

    Three undecided units at a time move along the null space of the two constraints
    until one of them reaches 0 or 1; either end is chosen so that every unit keeps
    its probability on average.
    """
    p = p.copy()
    draws = iter(rng.random(len(p) + 8).tolist())
    value, weight = p.tolist(), size.tolist()
    held: list[int] = []
    low, high = 1e-9, 1 - 1e-9
    for i in range(len(value) - left_out):
        if not low < value[i] < high:
            value[i] = float(value[i] >= high)
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (weight[b] - weight[c], weight[c] - weight[a], weight[a] - weight[b])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = min(((1 - value[k]) / d if d > 0 else value[k] / -d) for k, d in zip(held, u, strict=True) if d)
        down = min((value[k] / d if d > 0 else (1 - value[k]) / -d) for k, d in zip(held, u, strict=True) if d)
        step = up if next(draws) * (up + down) < down else -down
        for k, d in zip(held, u, strict=True):
            value[k] += step * d
        left = []
        for k in held:
            if low < value[k] < high:
                left.append(k)
            else:
                value[k] = float(value[k] >= high)
        held = left
    return np.array(value)


def ladder(p: np.ndarray, size: np.ndarray, most: int = LANDING) -> np.ndarray:
    """Places of undecided units whose sizes add up to about any number up to twice the largest: each is at most the sum of those before it and a little."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return left
    left = left[np.argsort(size[left], kind="stable")]
    sizes, used = size[left].astype(float), np.zeros(len(left), bool)
    little, total, enough = max(1.0, FINENESS * float((p * size).sum())), 0.0, 2 * float(size[left[-1]])
    while used.sum() < min(most, len(left)) and total < enough:
        free = np.flatnonzero(~used)
        fit = free[sizes[free] <= total + little]
        at = fit[-1] if len(fit) else free[0]
        used[at] = True
        total += sizes[at]
    return np.sort(left[used])


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rounding of the few undecided units that keeps their words nearest to the wanted ones, of those that keep their number within one."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    words, number = np.zeros(1), np.zeros(1)
    for k in open_:  # of every subset, its bits the units in it
        words, number = np.append(words, words + size[k]), np.append(number, number + 1)
    words, number = np.abs(words - (p[open_] * size[open_]).sum()), np.abs(number - p[open_].sum())
    allowed = np.flatnonzero(number <= max(1.0, number.min()))
    best = allowed[np.lexsort((number[allowed], words[allowed]))[0]]
    p[open_] = best >> np.arange(len(open_)) & 1
    return p


def _fly(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large documents are decided first, so what is left to land is small.
        pdf = pdf.sort_values(["size", "h", "rows"], ascending=[False, True, True], kind="stable")
        first = pdf.iloc[0]
        rng = np.random.default_rng([seed, int(first["h"]) & (2**63 - 1), int(first["b"]), len(pdf)])
        size, p = pdf["size"].to_numpy(), pdf["p"].to_numpy(float)
        if first["level"] > 1:
            return pdf.assign(p=flight(p, size, rng))
        last = ladder(p, size)
        order = np.concatenate([np.setdiff1d(np.arange(len(p)), last), last]).astype(np.int64)
        out = p.copy()
        out[order] = land(flight(p[order], size[order], rng, left_out=len(last)), size[order])
        return pdf.assign(p=out)

    return run


def sample(space: Workspace, units: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """units (doc_id, source, text_hash, size, rows, copies, p, n) with ``extra`` 0 or 1, balanced inside each source.

    ``level`` is the number of blocks a source is dealt to, by its number of
    documents; the undecided of one round are dealt to fewer blocks in the next.
    """
    state = "doc_id long, source string, text_hash long, size long, rows long, copies long, p double, h long, level long, b long"
    units = units.withColumn("h", F.xxhash64("doc_id", "text_hash", F.lit(seed))).withColumn("level", F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("long")).drop("n")
    units = units.select("doc_id", "source", "text_hash", "size", "rows", "copies", "p", "h", "level")
    done = None
    while True:
        dealt = units.withColumn("b", F.pmod(F.xxhash64("h", "level"), F.col("level")))
        flown = space.store(dealt.groupBy("source", "b").applyInPandas(_fly(seed), state))
        decided = flown.where("p = 0 or p = 1")
        done = decided if done is None else done.unionByName(decided)
        units = flown.where("p > 0 and p < 1").drop("b").withColumn("level", F.greatest(F.ceil(2 * F.col("level") / block), F.lit(1)).cast("long"))
        if units.isEmpty():
            return done.select("doc_id", "source", "text_hash", "size", "rows", "copies", F.col("p").cast("long").alias("extra"))


def mixed_units(space: Workspace, docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, size, rows, source_size, target, total) of every unit; total is how often its rows are taken together."""
    base = space.store(sized(docs))
    # One row per source: broadcast only when their number is known to be small.
    goal = space.store(targets(space, base).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    small = goal.count() <= 100_000
    side = F.broadcast(goal) if small else goal
    joined = base.join(side, base["source"].eqNullSafe(goal["source"])).select("doc_id", base["source"], "text_hash", "size", "rows", "rate", "n")
    joined = joined.withColumn("copies", F.floor(F.col("rate") * F.col("rows")).cast("long")).withColumn("p", F.col("rate") * F.col("rows") - F.col("copies"))
    names = ["doc_id", "source", "text_hash", "size", "rows", "copies"]
    open_ = joined.where("p > 0 and size > 0").select(*names, "p", "n")
    settled = joined.where("not (p > 0 and size > 0)").select(*names, F.lit(0).cast("long").alias("extra"))
    out = sample(space, open_).unionByName(settled)
    return space.settle(out.join(side, out["source"].eqNullSafe(goal["source"])).select("doc_id", out["source"], "text_hash", "size", "rows", "source_size", "target", (F.col("copies") + F.col("extra")).alias("total")))


def mix(space: Workspace, docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row."""
    units = mixed_units(space, docs)
    # A unit's rows again, in stretches so that no array is long.
    stretch = 1 << 16
    rows = units.withColumn("at", F.explode(F.expr(f"sequence(0, (rows - 1) div {stretch})"))).withColumn("row", F.explode(F.expr(f"sequence(at * {stretch}, least(rows, (at + 1) * {stretch}) - 1)")))
    rows = rows.withColumn("copies", F.floor(F.col("total") / F.col("rows")) + F.when(F.col("row") < F.col("total") % F.col("rows"), 1).otherwise(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(Workspace(spark, "cube_mixing"), table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, as repeated rows.

    Rows with the same doc_id, source and text are exchangeable, whatever their other
    columns: each of them is given one of their numbers of copies.
    """
    chosen = mixed_units(Workspace(spark, "cube_mixing"), docs).where("total > 0").select("doc_id", "source", "text_hash", "rows", "total")
    d, m = docs.alias("d"), chosen.alias("m")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")) & (F.xxhash64("d.text") == F.col("m.text_hash"))
    own = F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("own")
    joined = d.join(m, same).select(own, "m.rows", "m.total", "m.text_hash")
    once = joined.where("rows = 1").select("own", "total")
    # Of equal rows the first ones take the remainder; equal as they are, any order will do.
    order = F.row_number().over(Window.partitionBy("own.doc_id", "own.source", "text_hash").orderBy(F.lit(0))) - 1
    several = joined.where("rows > 1").withColumn("at", order).select("own", (F.floor(F.col("total") / F.col("rows")) + F.when(F.col("at") < F.col("total") % F.col("rows"), 1).otherwise(0)).alias("total"))
    out = once.unionByName(several).where("total > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("total").cast("int")))).select("own.*")
