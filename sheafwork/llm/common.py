"""Shared helpers: reading tables, cutting lineage, exact connected components."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session. A local-mode session without it gets
    a folder under /tmp; a cluster without it is an error, because a machine's own
    folder is not visible to the other executors.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return "/tmp/checkpoints"
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


class Workspace:
    """Intermediate tables of one operator run, as Parquet in the shared folder.

    A written table cuts the lineage and outlives lost executors. ``drop`` removes
    a table once a later table that replaces it has been written; tables that the
    returned DataFrame still reads stay until ``close``, or until the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sheafwork/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._at_exit)

    def _at_exit(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the JVM may be gone already
                self.close()

    def store(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sheaf_path = path
        return out

    def settle(self, df: DataFrame) -> DataFrame:
        """Store a result and remove all tables before it, which nothing else may read any more."""
        before = self._n
        out = self.store(df)
        for n in range(1, before + 1):
            self._delete(f"{self.root}/{n:03d}")
        return out

    def drop(self, *stored: DataFrame) -> None:
        for df in stored:
            self._delete(df._sheaf_path)

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def bounded_batches(spark: SparkSession) -> None:
    """Hand Arrow batches of bounded bytes to Python, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


@contextlib.contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of an execution when it ends, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(space: Workspace, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph; component is its smallest node.

    Alternates large-star and small-star steps until no edge changes. Every step is
    a keyed aggregation with map-side combining and an equi-join that Spark can
    split, so a node of any degree is no single task's work. Self loops and nulls
    are ignored; nodes without an edge do not appear.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    e = space.store(e)
    before = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        step = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        new = space.store(step)
        state = _state(new)
        space.drop(e)
        e = new
        if state == before:
            break
        before = state
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
