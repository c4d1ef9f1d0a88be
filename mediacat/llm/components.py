"""Joins that stay even under hot keys, and connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediacat.session import shared_folder
from mediacat.sources.storage import Storage

HOT_KEYS = 256


class Scratch:
    """Tables of intermediate steps in the shared folder, removed when no longer read.

    Unlike a checkpoint, which first computes everything and then again to write it, a table
    takes one job, and is smaller.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, f"scratch-{uuid.uuid4().hex}"
        self._storage = Storage(spark, shared_folder(spark))
        self._folders: dict[int, str] = {}
        self._made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self._made += 1
        folder = f"{self.name}/{self._made}"
        path = f"{shared_folder(self.spark)}/{folder}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._folders[id(kept)] = folder
        kept._scratch = self  # an id is not used again while the frame lives
        return kept

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            self._storage.remove(self._folders.pop(id(df)))

    def drop_all(self) -> None:
        self._folders.clear()
        self._storage.remove(self.name)


def lookup(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join on ``key``, where few keys may hold most rows of ``left``.

    ``right`` has one row per key, and its column n counts the rows of the key on the left,
    ``total`` of them in all. Keys with more than a share of 1 / HOT_KEYS of them are fewer
    than HOT_KEYS, so their rows of ``right`` are broadcast; the others are shuffled. Both
    frames are read twice and must be cheap to read.
    """
    least = max(200, total // HOT_KEYS)
    hot = right.filter(F.col("n") > least)
    if hot.isEmpty():
        return left.join(right, key).drop("n")
    cold = right.filter(F.col("n") <= least)
    even = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return left.join(F.broadcast(hot), key).unionByName(even).drop("n")


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffles of finished steps.

    It does so when the driver collects its garbage, which in a job of many steps on a
    mostly idle driver may be much later than the disks of the executors would like. Each
    stage also leaves the driver a buffer of some megabytes from sending out its tasks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_ROWS_A_TASK = 20_000


@contextmanager
def one_plan(spark: SparkSession, rows: int) -> Iterator[None]:
    """Runs what is inside without adaptive re-planning, in as many tasks as ``rows`` need.

    The rounds below are many small plans. Re-planned after each exchange, or dealt out to
    as many tasks as large tables get, they fill the driver with threads and task metrics.
    Their hot keys are seen to by ``lookup``.
    """
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // _ROWS_A_TASK + 1)
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(tasks)}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the smallest node.

    Alternating large and small stars: each round hangs the neighbours of every node on the
    smallest of them, so the number of rounds grows with the logarithm of the size. Each
    round is written to the shared folder. Self-links and repeated links do no harm; no
    links, no rows. Nodes must not be NULL.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    scratch = Scratch(edges.sparkSession)
    current = scratch.keep(edges.select(low.alias("a"), high.alias("b")).distinct())
    with one_plan(edges.sparkSession, current.count()):
        return _hang(current, scratch)


def _hang(current: DataFrame, scratch: Scratch) -> DataFrame:
    """The components of links with a <= b, none of them twice."""
    before = None
    loops = current.filter("a = b").select(F.col("a").alias("node"))
    stars = current.filter("a <> b")
    while (links := _unfinished(stars)):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = scratch.keep(
            both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
            .select("a", F.least("a", "m").alias("m"), "n")
        )
        large = scratch.keep(lookup(stars, nearest, "a", 2 * links).filter("b <> m").select("m", "b"))
        least = scratch.keep(
            large.groupBy("b").agg(F.min("m").alias("least"), F.count("*").alias("n"))
        )
        small = lookup(large, least, "b", links)
        again = small.filter("m <> least").select(F.col("least").alias("a"), F.col("m").alias("b"))
        hung = small.select(F.col("least").alias("a"), "b")
        stars = scratch.keep(again.unionByName(hung).distinct())
        scratch.drop(nearest, large, least, *([before] if before is not None else []))
        before = stars
        release(stars.sparkSession)
    roots = stars.select(F.col("b").alias("node"), F.col("a").alias("component"))
    own = stars.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    found = roots.unionByName(own)
    if loops.isEmpty():
        return found
    alone = loops.distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))


def _unfinished(stars: DataFrame) -> int:
    """Number of links, or 0 once every node hangs on one other that hangs on none."""
    ends = stars.select(F.col("a").alias("node"), F.lit(0).alias("hangs")).unionByName(
        stars.select(F.col("b").alias("node"), F.lit(1).alias("hangs"))
    )
    nodes = ends.groupBy("node").agg(F.min("hangs").alias("least"), F.sum("hangs").alias("n"))
    row = nodes.agg(F.sum("n").alias("links"), F.max(F.expr("n > 1 OR n > least")).alias("open")).first()
    return row.links if row.open else 0
