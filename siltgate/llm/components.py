"""Connected components by alternating star contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _hang(near: DataFrame) -> DataFrame:
    """Hang every listed neighbour of u on the smallest of u and the neighbours."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = near.join(least, "u").select(F.col("v").alias("a"), "m", "u")
    return moved


#: Distinct edges up to which one task joins them (16 MB); more are contracted in rounds.
ONE_TASK = 1_000_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Union-find over all edges: (u, v) with v the smallest id of u's component."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                p, q = find(u), find(v)
                root[max(p, q)] = min(p, q)
        ids = [x for x in list(root) if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(i) for i in ids], pa.int64())], names=["u", "v"])

    return edges.coalesce(1).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, scratch: Scratch, one_task: int = ONE_TASK) -> DataFrame:
    """``edges(u, v)`` to ``(id, component)``: the smallest id that each id reaches.

    Each round is a large-star step (every larger neighbour of u is hung on
    u's smallest neighbour) and a small-star step (u and its smaller
    neighbours are hung on the smallest of them). The rounds end when a round
    changes nothing; all state stays in tables of the shared folder. Ids
    without edges are not returned; null ids and loops are ignored.
    """
    now = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if now.count() <= one_task:
        return scratch.table(_in_one_task(now)).select(F.col("u").alias("id"), F.col("v").alias("component"))
    mark = None
    while True:
        large = _hang(_symmetric(now)).where("a > u").select(F.col("a").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = scratch.table(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
