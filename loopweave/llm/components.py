"""Connected components of an edge table: forests within tasks first, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few

#: Edges that a task joins in memory at a time, some 40 MB.
CHUNK = 100_000
#: Edges for a task of a step, on average, and tasks of a step at least: as their number is counted before each step, a
#: small table does not become as many tasks and files as the session has shuffle partitions, which the driver keeps.
TASK_EDGES, LEAST_TASKS = 50_000, 8


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what those of each task connect: one from each node to the smallest it reaches there.

    A map: a task of any size holds CHUNK edges at a time. A group of near copies leaves its task as a star of nodes,
    however many pairs it had.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        schema = None

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def out() -> pa.RecordBatch:
            pairs = [(x, r) for x in root if (r := find(x)) != x]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], schema.field(k).type) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root.setdefault(a, a)
                root.setdefault(b, b)
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            if len(root) >= CHUNK:
                yield out()
        if root:
            yield out()

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame, scratch: Scratch, tasks: int) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours.

    Only nodes with a larger neighbour matter, the centres of stars; they are broadcast while they are measured small,
    so a centre with very many nodes is no bottleneck.
    """
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top")).filter("top > u").select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    least = few(least.coalesce(tasks), scratch)
    return both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, scratch: Scratch, tasks: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).coalesce(tasks)
    several = few(least.filter("n > 1").select(F.col("u").alias("w"), "m"), scratch)
    moved = down.join(several, F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct().coalesce(tasks)


def _mark(edges: DataFrame) -> tuple:
    # the sum of hashes wraps in the decimal's place only after 10**18 edges
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), a <> b, of one orderable type; root: the component's smallest.

    A step groups by node with minima before the shuffle. The number of steps grows with the logarithm of the largest
    component; each is written to the shared folder, and what it was made from is deleted.
    """
    spark = edges.sparkSession
    held = Scratch(spark)
    now = held.settle(forest(edges.filter("a <> b")).distinct())
    mark = _mark(now)
    while mark[0]:
        after = Scratch(spark)
        used = Scratch(spark)
        tasks = max(LEAST_TASKS, -(-mark[0] // TASK_EDGES))
        new = after.settle(_small_star(used.settle(_large_star(now, used, tasks)), used, tasks))
        used.drop()
        held.drop()
        seen, mark = mark, _mark(new)
        now, held = new, after
        if mark == seen:
            break
    # all edges now go from a node to the smallest of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def extended(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, root) after further edges (a, b): only the roots of their ends go through `components` again."""
    side = lambda x: found.select(F.col("node").alias(f"_n{x}"), F.col("root").alias(f"_r{x}"))
    rooted = edges.join(side("a"), F.col("a") == F.col("_na"), "left").join(side("b"), F.col("b") == F.col("_nb"), "left")
    joined = components(rooted.select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b")).distinct())
    moved = few(joined.select(F.col("node").alias("_n"), F.col("root").alias("_r")))
    old = found.join(moved, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return old.unionByName(joined.join(found.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti"))
