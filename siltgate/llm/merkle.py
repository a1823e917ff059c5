"""Merkle manifest of a dataset with higher-order SQL functions.

Leaves are ordered, cut into blocks of ``FAN ** LEVELS`` and held as one array a block.
Within a block ``sequence``, ``transform``, ``slice`` and ``aggregate`` collapse the
levels; the block roots are the next round's leaves, until each group has one node.
On the way back every block hands its nodes the siblings that it holds and those that
its own root got from the block above, which are the proofs. A round is one
shuffle of a 256th of the round before, and no group, however large, meets in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch

#: Nodes that are hashed to one of the next level.
FAN = 16
#: Levels that a block collapses.
LEVELS = 2
#: Tables of counts with at most so many rows (under 64 MB) are broadcast.
SMALL = 500_000
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def _broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def placed(nodes: DataFrame, scratch: Scratch, by: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``nodes`` with pos, counted from 0 within ``by`` in the order of ``order``; (by, n)).

    One range shuffle puts all rows in order. In the stage that writes them a row's number is its
    partition and its place there; rows that agree in ``by`` and ``order`` must be equal, so
    a task that runs again numbers them alike. Counts of (by, partition) give each group's offsets.
    """
    dealt = nodes.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (by, *order)])
    dealt = dealt.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (by, *order)])
    here = scratch.table(dealt.select("*", F.monotonically_increasing_id().alias("number")).withColumn("part", F.shiftright("number", 33)))
    counts = here.groupBy(by, "part").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    # a group has at most as many rows here as there are partitions
    before = F.coalesce(F.sum("n").over(W.partitionBy(by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = scratch.table(counts.withColumn("offset", before - F.col("first")).select(by, "part", "offset", "n"))
    rows = here.join(_broadcast(counts.drop("n")), [by, "part"]).withColumn("pos", F.col("number") + F.col("offset")).drop("number", "offset", "part")
    return rows, counts.groupBy(by).agg(F.sum("n").alias("n"))


def _collapsed(fan: int) -> str:
    """All levels of a block: the leaves, and for each of ``steps`` the hashes of every ``fan`` nodes of the last."""
    up = f"transform(sequence(0, cast((size(element_at(ls, -1)) - 1) div {fan} as int)), i -> sha2(array_join(slice(element_at(ls, -1), i * {fan} + 1, {fan}), ''), 256))"
    return f"aggregate(slice(sequence(1, {LEVELS}), 1, steps), array(transform(members, m -> m.digest)), (ls, l) -> concat(ls, array({up})))"


def _siblings(fan: int) -> str:
    """What stands left and right of node i in its run, a level of the block each."""
    at = f"cast(i div cast(power({fan}, l) as int) as int)"
    left = f"array_join(slice(levels[l], {at} - {at} % {fan} + 1, {at} % {fan}), '')"
    right = f"array_join(slice(levels[l], {at} + 2, {fan} - 1 - {at} % {fan}), '')"
    return f"transform(slice(sequence(0, {LEVELS} - 1), 1, steps), l -> named_struct('left', {left}, 'right', {right}))"


PATH = "array<struct<left:string,right:string>>"


def tree(nodes: DataFrame, sizes: DataFrame, scratch: Scratch, by: str, carried: list[str], fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """A tree for each value of ``by``.

    ``nodes(by, pos, digest, *carried)`` with positions from 0, ``sizes(by, n)``. Returns (by, root), and
    (by, digest, *carried, path): a node's siblings level by level, as what stands left and right of it.
    """
    wide = fan**LEVELS
    most = sizes.agg(F.max("n")).first()[0] or 0
    rounds, now, extra, left = [], nodes, carried, most
    sizes = scratch.table(sizes)
    while True:
        r = len(rounds)
        # nodes of a group at this round; levels that are left for them
        many = F.ceil(F.col("n") / float(wide**r)).cast("long")
        steps = sum((many > fan**k).cast("int") for k in range(LEVELS))
        here = F.col("n") > wide**r if r else F.lit(True)
        member = F.struct("pos", "digest", *extra)
        held = now.groupBy(by, F.expr(f"pos div {wide}").alias("block")).agg(F.sort_array(F.collect_list(member)).alias("members"))
        held = held.join(_broadcast(sizes.where(here)), by).withColumn("steps", steps)
        held = scratch.table(held.withColumn("levels", F.expr(_collapsed(fan))).withColumn("root", F.expr("element_at(levels, -1)[0]")))
        rounds.append(held)
        left = -(-left // wide)
        if left <= 1:
            break
        now, extra = held.where(F.col("n") > wide ** (r + 1)).select(by, F.col("block").alias("pos"), F.col("root").alias("digest")), []
    roots = None
    for r, held in enumerate(rounds):
        one = held.where(F.col("n") <= wide ** (r + 1)).select(by, "root")
        roots = one if roots is None else roots.unionByName(one)
    above: DataFrame | None = None
    for r in range(len(rounds) - 1, -1, -1):
        held = rounds[r].select(by, "block", "members", "levels", "steps")
        if above is None:
            held = held.withColumn("upper", F.array().cast(PATH))
        else:
            held = held.join(above, [by, "block"], "left").withColumn("upper", F.coalesce("upper", F.array().cast(PATH)))
        names = ["pos", "digest", *(carried if r == 0 else [])]
        told = ", ".join(f"'{c}', m.{c}" for c in names)
        out = held.select(by, F.explode(F.expr(f"transform(members, (m, i) -> named_struct({told}, 'path', concat({_siblings(fan)}, upper)))")).alias("z"))
        if r:
            above = scratch.table(out.select(by, F.col("z.pos").alias("block"), F.col("z.path").alias("upper")))
        else:
            return roots, out.select(by, *[F.col(f"z.{c}").alias(c) for c in (*names[1:], "path")])
    raise AssertionError


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def manifest(docs: DataFrame, by: str = "source", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, fan: int = FAN, carried: dict[str, Column] | None = None) -> DataFrame:
    """Leaves of ``docs`` with their place in the dataset's tree: by, key, leaf, subroot, root, path and the ``carried`` columns.

    Each group of ``by`` has a tree over its leaves in the order of ``key``; the subroots, in the bytewise order of
    their groups, have the tree that gives ``root``. While there are several nodes, every ``fan`` consecutive ones become the hash
    of their hashes, also where the last run holds one. path: the siblings from the leaf up to the
    root, array<struct<left, right>>.

    Defined cases: a null field is ``-``; a null group comes first, as does a null key in its group; rows of one key come in the
    order of their leaves, so repeated rows are leaves each and swapping them changes nothing; a group of one row has its leaf as
    subroot, and a single group's subroot is the root; an empty table gives an empty result. Texts of any length are hashed whole. Other
    columns, whatever their names, are ignored. ``carried`` columns must follow from the row's ``fields``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    carried = carried or {}
    group = F.when(F.col(by).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(by).cast("string")))
    rows = scratch.table(docs.select(group.alias("grp"), F.col(key).alias("id"), leaf([F.col(c) for c in fields]).alias("digest"), *[c.alias(n) for n, c in carried.items()]))
    inner, sizes = placed(rows, scratch, "grp", ["id", "digest"])
    scratch.drop(rows)
    subroots, leaves = tree(inner, sizes, scratch, "grp", ["id", *carried], fan)
    # one tree over the groups
    tops = scratch.table(subroots.select(F.lit("").alias("all"), "grp", F.col("root").alias("digest")))
    outer, one = placed(tops, scratch, "all", ["grp", "digest"])
    roots, upper = tree(outer, one, scratch, "all", ["grp"], fan)
    top = upper.join(F.broadcast(roots), "all").select("grp", F.col("digest").alias("subroot"), "root", F.col("path").alias("upper"))
    out = leaves.join(_broadcast(scratch.table(top)), "grp")
    named = F.when(F.col("grp") != "-", F.substring("grp", 2, 1 << 30))
    return out.select(named.alias(by), F.col("id").alias(key), F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "upper").alias("path"), *carried)


def checked(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, and whether tampering shows: where 5 divides the crc32 of the decimal doc_id,
    the text's A-Z are lower-cased.

    doc_id, leaf, subroot, root, proof_sha256 (of all siblings from the leaf up, left to right), folded_root (what the tampered, else
    the original leaf and the original siblings give), verified.

    Defined cases: as in ``manifest``; a null doc_id and a null text aren't tampered with; a text without A-Z stays
    as it is and verifies.
    """
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False)) & F.coalesce(lower != F.col("text"), F.lit(False))
    now = F.when(hit, leaf([lower if c == "text" else F.col(c) for c in FIELDS]))
    out = manifest(docs, carried={"tampered": now})
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
