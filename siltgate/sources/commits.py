"""Commit graphs: the commits of a range, and where branches met.

A graph is a table ``commits(hash, parents)``. Reachability is expanded from
all ends of all ranges at once, several generations a round, until a round finds nothing new; every
generation is a join on the hash with the graph where it lies, every round a written table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stored import Scratch

#: Generations that a round of expansion covers (a power of two).
HOPS = 8
#: Written rounds that are read together before they are written as one table.
ROUNDS = 12
#: Commits of a part of the graph, about.
PART_ROWS = 100_000


def links(commits: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(below, parents), each commit with its parents, dealt out by the hash and kept while rounds read them; the number of parts.

    A join on the hash deals out its other side alone. The caller frees them.
    """
    spark = commits.sparkSession
    parents = F.filter(F.coalesce("parents", F.array()), lambda p: p.isNotNull() & (p != F.col("hash")))
    rows = scratch.table(commits.where("hash is not null").select(F.col("hash").alias("below"), parents.alias("parents")))
    # every generation is a stage, so small graphs get few parts
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, rows.count() // PART_ROWS)))
    return rows.repartition(n, "below").persist(), n


def reachable(commits: DataFrame, ends: DataFrame, hops: int = HOPS, scratch: Scratch | None = None, near: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(key, hash): the ends and all their ancestors, for ``ends(key, hash)``.

    Only what the ends reach is expanded. A row is open until its parents have been added; only commits that the table holds get closed.
    ``near`` are the table's ``links``, where the caller has them.
    Defined cases: ends and parents that the table doesn't hold reach nothing, as do nulls; a commit named twice counts once.
    """
    scratch = scratch or Scratch(commits.sparkSession, "commits")
    kept, n = near or links(commits, scratch)
    front = ends.select("key", "hash", F.lit(True).alias("open")).where("key is not null and hash is not null")
    once = lambda rows: rows.repartition(n, "hash").groupBy("key", "hash").agg(F.bool_and("open").alias("open"))
    rounds: list[DataFrame] = []
    try:
        while True:
            rows = once(front)
            for _ in range(hops):
                # closed rows travel along, so that none is opened twice in a round
                met = rows.hint("shuffle_hash").join(kept, (F.col("hash") == F.col("below")) & F.col("open"), "left")
                own, above = F.array(F.struct("hash", F.lit(False).alias("open"))), F.transform("parents", lambda p: F.struct(p.alias("hash"), F.lit(True).alias("open")))
                grown = F.when(~F.col("open"), own).when(F.col("below").isNotNull(), F.concat(own, above))
                rows = once(met.select("key", F.inline(grown)))
            front = scratch.table(rows.join(_closed(rounds), ["key", "hash"], "left_anti") if rounds else rows)
            rounds.append(front)
            front = front.where("open")
            if front.isEmpty():
                break
            if len(rounds) == ROUNDS:
                # the last round is read by the next one
                whole = scratch.table(_closed(rounds).withColumn("open", F.lit(False)))
                scratch.drop(*rounds[:-1])
                rounds = [whole]
    finally:
        if near is None:
            kept.unpersist()
    return _closed(rounds)


def _closed(rounds: list[DataFrame]) -> DataFrame:
    """(key, hash) of the rows of ``rounds`` that are closed."""
    return reduce(DataFrame.unionByName, [r.where("not open").select("key", "hash") for r in rounds])


def in_ranges(commits: DataFrame, ranges: DataFrame, hops: int = HOPS) -> DataFrame:
    """(range_id, hash): what ``stop`` reaches and ``start`` doesn't, for ``ranges(range_id, start, stop)``.

    Defined cases: a null or unknown start takes nothing away; an unknown stop gives no commits; a stop that the start reaches gives none.
    """
    side = lambda c, s: ranges.select(F.struct(F.col("range_id"), F.lit(s).alias("side")).alias("key"), F.col(c).alias("hash")).where("hash is not null")
    found = reachable(commits, side("start", 0).unionByName(side("stop", 1)), hops)
    rows = found.select("key.range_id", "key.side", "hash")
    return rows.where("side = 1").drop("side").join(rows.where("side = 0").drop("side"), ["range_id", "hash"], "left_anti")


def merge_bases(commits: DataFrame, pairs: DataFrame, hops: int = HOPS) -> DataFrame:
    """(pair_id, hash): the common ancestors of ``pairs(pair_id, left, right)`` that are no ancestors of another one.

    All that is above a common ancestor is common too, so those without a common child are the lowest. Criss-cross
    merges have several; unrelated ends have none.
    """
    scratch = Scratch(commits.sparkSession, "merge-base")
    near, n = links(commits, scratch)
    side = lambda c, s: pairs.select(F.struct(F.col("pair_id"), F.lit(s).alias("side")).alias("key"), F.col(c).alias("hash")).where("hash is not null")
    try:
        rows = reachable(commits, side("left", 0).unionByName(side("right", 1)), hops, scratch, (near, n)).select("key.pair_id", "key.side", "hash")
        common = scratch.table(rows.groupBy("pair_id", "hash").agg((F.min("side") < F.max("side")).alias("both")).where("both").drop("both"))
        above = common.hint("shuffle_hash").join(near, F.col("hash") == F.col("below")).select("pair_id", F.explode("parents").alias("hash"))
        return scratch.table(common.join(above, ["pair_id", "hash"], "left_anti"))
    finally:
        near.unpersist()


def merge_base(commits: DataFrame, pairs: DataFrame, hops: int = HOPS) -> DataFrame:
    """(pair_id, hash): one base a pair, the one with the latest ``date`` where the table has dates (ties and no dates: the smallest hash)."""
    found = merge_bases(commits, pairs, hops)
    if "date" not in commits.columns:
        return found.groupBy("pair_id").agg(F.min("hash").alias("hash"))
    dated = found.join(commits.groupBy("hash").agg(F.max("date").alias("date")), "hash")
    rank: Column = F.row_number().over(_latest())
    return dated.withColumn("r", rank).where("r = 1").select("pair_id", "hash")


def _latest():
    from pyspark.sql import Window as W

    return W.partitionBy("pair_id").orderBy(F.col("date").desc_nulls_last(), "hash")


def resolver(commits: DataFrame) -> Callable[[str, str], str | None]:
    """For ``comparison``: the merge base of two references of this graph, or None."""

    def base(left: str, right: str) -> str | None:
        row = merge_base(commits, commits.sparkSession.createDataFrame([(0, left, right)], "pair_id int, left string, right string")).first()
        return None if row is None else row["hash"]

    return base


def range_messages(messages: DataFrame, commits: DataFrame, ranges: DataFrame) -> DataFrame:
    """Messages of the commits in ``ranges``: range_id, path (the hash), content and text without the newlines at its end, for
    ``messages(hash, content)``; a commit of several ranges has a row in each."""
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\n+\z", "")
    rows = messages.select("hash", "content", text.alias("text"))
    return in_ranges(commits, ranges).join(rows, "hash").select("range_id", F.col("hash").alias("path"), "content", "text")
