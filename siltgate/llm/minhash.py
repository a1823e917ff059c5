"""MinHash near-dedup by a signature-coordinate inverted join.

1. Every text becomes its set of distinct word shingles and a signature of
   ``k`` min-hash values. Documents with equal sets form one class, so a group
   of exact copies is one node however large it is.
2. Every node is posted under each (coordinate, value) pair. Values that only
   one node has cannot collide and leave at once. A node's postings are
   ordered by how many nodes share them; two signatures that agree on at least
   ``t`` of ``k`` coordinates must meet in the ``k - t + 1`` rarest ones (the
   prefix), so only those are merged. The frequent lists behind the prefix are
   skipped: they are never merged, but probed when a candidate's collisions are
   counted on the two whole signatures.
   A list that is long although it stands in a prefix holds frequent values;
   its nodes are posted anew under joint values: of k - t + 1 groups of
   coordinates, two signatures with t collisions agree on one whole group.
3. A list is merged without emitting its pairs: first each node is paired with
   the list's hub (the node with the most common values) and its neighbours,
   pairs with ``t`` collisions are confirmed on the full sets and contracted to
   components. What is still split is then compared across components only:
   short lists by a join, long ones block by block, where the sets are compared
   exactly and only links that join two components come out. No link between
   different components is lost, and a list gives no more rows than it has nodes
   in blocks, however many pairs collide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import components
from .scratch import Scratch
from .shingles import shingle_hashes, text_slices, word_hashes

#: A list's nodes are dealt into runs of about so many; the runs' hubs are paired in turn.
RUN = 4096
#: Neighbours in a list, besides the hub, that a node is first paired with.
NEAR = 3
#: Prefix lists beyond this length are replaced by those of joint values.
LONG = 32
#: Nodes of a long list that one task compares with as many others.
BLOCK = 2048
#: Shingles of a list's nodes that one task takes, about (16 MB), with as many others.
BLOCK_SHINGLES = 2_000_000
#: Sides of a join with at most so many rows of two or three integers (under 64 MB) are broadcast.
SMALL = 2_000_000


def _sets(col: pa.Array, width: int, lower: bool = True) -> list[np.ndarray]:
    hashes, to = shingle_hashes(*word_hashes(col, lower), width)
    return [np.unique(hashes[to[i] : to[i + 1]]) for i in range(len(to) - 1)]


def _constants(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def _signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k min-hash values (32 bits) of each non-empty set."""
    mul, add = _constants(k)
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), k), np.uint32)
    for j in range(k):
        x = flat * mul[j]
        x += add[j]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, j] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), at)
    return out


def signatures(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, n_shingles, set_id (equal for equal sets; null for empty ones), sig."""

    def run(batches):
        for whole in batches:
            for b in text_slices(whole, "text"):
                sets = _sets(b.column("text"), width)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                ids = [None] * len(sets)
                sig = [None] * len(sets)
                if len(full):
                    some = [sets[i] for i in full]
                    for i, row in zip(full, _signatures(some, k).view(np.int32)):
                        s = sets[i]
                        ids[i] = np.uint64(s.sum(dtype=np.uint64)).tobytes() + np.bitwise_xor.reduce(s * (s >> np.uint64(7) | np.uint64(1))).tobytes()
                        sig[i] = row
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n), pa.array(ids, pa.binary()), pa.array(sig, pa.list_(pa.int32()))],
                    names=["doc_id", "n_shingles", "set_id", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sig array<int>")


def match_threshold(k: int, similarity: float) -> int:
    """Collisions that a pair at the similarity reaches but for one time in 30,000."""
    return max(1, math.floor(k * similarity - 4 * math.sqrt(k * similarity * (1 - similarity))))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def _minority(c: np.ndarray) -> np.ndarray:
    """The nodes outside the largest component: each pair of two components has one of them."""
    kinds, of, size = np.unique(c, return_inverse=True, return_counts=True)
    return np.flatnonzero(of != size.argmax()) if len(kinds) > 1 else np.zeros(0, np.int64)


def spanning(ids: np.ndarray, c: np.ndarray, part: np.ndarray | None, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (u < v) between sets of ``percent`` similarity that join components ``c``, as a forest.

    With ``part`` only nodes of different parts are compared. The sets are taken
    relative to what most of them hold, H: of A and B with s(A) and s(B) in H and the
    symmetric differences D(A) and D(B), |A n B| = s(A) + s(B) - |H| + |D(A) n D(B)|.
    Near copies differ in little from H, so the counts cost little.
    """
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    values, token = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    count = np.bincount(token, minlength=len(values))
    common = np.flatnonzero(2 * count > len(sets))
    place = np.full(len(values), -1)
    place[common] = np.arange(len(common))
    inside = place[token] >= 0
    has = np.zeros((len(sets), len(common)), bool)
    has[owner[inside], place[token[inside]]] = True
    shared = has.sum(1)
    lacks, what = np.nonzero(~has)
    del has
    # tokens that only one difference holds can't be in two
    who, tok = np.concatenate([owner[~inside], lacks]), np.concatenate([token[~inside], common[what]])
    often = np.bincount(tok, minlength=len(values))
    who, tok = who[often[tok] > 1], tok[often[tok] > 1]
    by_token = np.argsort(tok, kind="stable")
    holders, starts = who[by_token], np.searchsorted(tok[by_token], np.arange(len(values) + 1))
    by_who = np.argsort(who, kind="stable")
    mine, to = tok[by_who], np.searchsorted(who[by_who], np.arange(len(sets) + 1))
    group = np.unique(c, return_inverse=True)[1]
    out = []
    for r in _minority(c).tolist():
        apart = group != group[r]
        if part is not None:
            apart &= part != part[r]
        if not apart.any():
            continue
        lists = [holders[starts[x] : starts[x + 1]] for x in mine[to[r] : to[r + 1]].tolist()]
        both = np.bincount(np.concatenate(lists), minlength=len(sets)) if lists else np.zeros(len(sets), np.int64)
        both = both + shared + shared[r] - len(common)
        for y in np.flatnonzero(apart & (both * (100 + percent) >= percent * (size + size[r]))).tolist():
            if group[y] != group[r]:
                out.append((int(min(ids[r], ids[y])), int(max(ids[r], ids[y]))))
                group[group == group[y]] = group[r]
    return out


class _Join:
    def __init__(self, docs: DataFrame, nodes: DataFrame, scratch: Scratch, width: int, percent: int, k: int, t: int) -> None:
        self.docs, self.nodes, self.scratch = docs, nodes, scratch
        self.width, self.percent, self.k, self.t = width, percent, k, t
        # k coordinates in k - t + 1 groups: t collisions leave fewer misses than groups
        parts = k - t + 1
        self.cut = [(i * k // parts, (i + 1) * k // parts) for i in range(parts)]

    def _shared(self, posted: DataFrame) -> DataFrame:
        """Postings whose key some other node has, with the number of its nodes."""
        df = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
        return posted.join(df, "key")

    def lists(self) -> DataFrame:
        """(key, grp, id, n, mass): the lists to merge. grp numbers the group of joint values (-1: one coordinate), mass tells how common a node's values are."""
        least = self.percent / (100 - self.percent) if self.percent < 100 else float("inf")
        able = self.nodes.where(F.col("n") >= least)
        posted = able.select("id", "n", F.posexplode("sig").alias("pos", "value")).select((F.shiftleft(F.col("pos").cast("long"), 32) + F.col("value").bitwiseAND(0xFFFFFFFF)).alias("key"), "id", "n")
        rows = self._shared(posted).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("p"), F.sum("df").alias("mass"))
        parts = self.k - self.t + 1
        free = parts - (self.k - F.size("p"))
        rows = rows.where(free > 0).select("id", "n", "mass", F.slice("p", F.lit(1), free).alias("p"))
        prefix = self.scratch.table(rows.select("id", "n", "mass", F.explode("p").alias("e"), (F.element_at("p", -1)["df"] > LONG).alias("long")).select("e.key", "e.df", "id", "n", "mass", "long"))
        again = prefix.where("long").groupBy("id").agg(F.first("mass").alias("mass"))
        joint = F.array(*[F.xxhash64(F.lit(i), F.slice("sig", a + 1, b - a)) for i, (a, b) in enumerate(self.cut)])
        wide = able.join(again, "id").select("id", "n", "mass", F.posexplode(joint).alias("grp", "key"))
        short = prefix.where(F.col("df") <= LONG).select("key", F.lit(-1).alias("grp"), "id", "n", "mass")
        return short.unionByName(self._shared(wide).select("key", "grp", "id", "n", "mass"))

    def _alike(self, pairs: DataFrame) -> DataFrame:
        """Of distinct (a, b) those with t collisions of whole signatures."""
        sig = self.nodes.select(F.col("id"), "sig")
        both = pairs.join(sig.withColumnsRenamed({"id": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"id": "b", "sig": "sb"}), "b")
        hits = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        return both.withColumn("hits", hits).where(F.col("hits") >= self.t).groupBy("a", "b").agg(F.max("hits").alias("hits"))

    def _fits(self, n: str, m: str):
        return (F.greatest(n, m) * self.percent <= F.least(n, m) * 100)

    def first_pairs(self, lists: DataFrame) -> DataFrame:
        """Each node with its list's hub and neighbours; long lists in runs whose hubs are paired too."""
        size = lists.groupBy("key").agg(F.count("*").alias("g")).where("g > 1")
        dealt = lists.join(size, "key").withColumn("run", F.when(F.col("g") > RUN, F.pmod(F.xxhash64("id"), F.ceil(F.col("g") / RUN))).otherwise(F.lit(0)))
        run = W.partitionBy("key", "run")
        order = run.orderBy("mass", "id")
        hub = F.max(F.struct("mass", "id", "n")).over(run)
        other = [F.lag(F.struct("mass", "id", "n"), i).over(order) for i in range(1, NEAR + 1)]
        near = dealt.select("key", "id", "n", hub.alias("hub"), F.array(*other).alias("o"))
        pairs = near.select("id", "n", F.explode(F.concat(F.array("hub"), F.col("o"))).alias("x")).where("x is not null")
        hubs = dealt.where(F.col("g") > RUN).groupBy("key", "run").agg(F.max(F.struct("mass", "id", "n")).alias("hub"))
        top = hubs.groupBy("key").agg(F.max("hub").alias("x"))
        among = hubs.join(top, "key").select(F.col("hub.id").alias("id"), F.col("hub.n").alias("n"), "x")
        both = pairs.unionByName(among).where(F.col("id") != F.col("x.id")).where(self._fits("n", "x.n"))
        return both.select(F.least("id", "x.id").alias("a"), F.greatest("id", "x.id").alias("b")).distinct()

    def rest_pairs(self, lists: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What the first pairs left split: candidate pairs of the short lists, and links of the long ones."""
        at = lists.join(member, "id", "left").select("key", "grp", "id", "n", F.coalesce("component", "id").alias("c"))
        mixed = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("g"), F.sum("n").alias("total"))
        mixed = mixed.where((F.col("lo") != F.col("hi")) & (F.col("g") > NEAR + 1))
        at = self.scratch.table(at.join(mixed.select("key", "g", "total"), "key"))
        short = at.where(F.col("g") <= LONG).select("key", "id", "n", "c")
        x, y = (short.withColumnsRenamed({c: f"{c}{i}" for c in ("id", "n", "c")}) for i in (1, 2))
        pairs = x.join(y, "key").where("id1 < id2 and c1 <> c2").where(self._fits("n1", "n2"))
        few = self._alike(pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct())
        return few.select("a", "b"), self._in_blocks(at.where(F.col("g") > LONG))

    def _in_blocks(self, at: DataFrame) -> DataFrame:
        """(u, v): a spanning forest of the links inside long lists, over the components so far.

        A list is dealt to blocks. Signatures are compared first: a block names
        the nodes that collide often enough with one of another component, in
        this list before any other that both are in. The named nodes' sets then
        meet in the same block, are compared exactly, and each link that joins
        two components comes out: fewer rows than the block has nodes.
        """
        t, percent, cut = self.t, self.percent, self.cut
        rows = at.withColumn("parts", F.greatest(F.ceil(F.col("g") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        rows = rows.select("key", F.col("grp").cast("long").alias("grp"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "n", "c")

        def named(table: pa.Table) -> pa.Table:
            part, ids, n, c = (table.column(x).to_numpy() for x in ("part", "id", "n", "c"))
            sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            whole = table.column("i")[0].as_py() == table.column("j")[0].as_py()
            earlier = cut[: table.column("grp")[0].as_py()]
            some = np.zeros(len(ids), bool)
            for r in _minority(c):
                rest = np.flatnonzero((c != c[r]) & (whole | (part != part[r])) & (np.maximum(n, n[r]) * percent <= np.minimum(n, n[r]) * 100))
                if len(rest):
                    same = sig[rest] == sig[r]
                    good = same.sum(1) >= t
                    for lo, hi in earlier:
                        good &= ~same[:, lo:hi].all(1)
                    if good.any():
                        some[r] = True
                        some[rest[good]] = True
            return table.select(["key", "i", "j", "part", "id", "n", "c"]).filter(pa.array(some))

        def linked(table: pa.Table) -> pa.Table:
            part, ids, n, c = (table.column(x).to_numpy() for x in ("part", "id", "n", "c"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set_id").combine_chunks()]
            whole = table.column("i")[0].as_py() == table.column("j")[0].as_py()
            links = spanning(ids, c, None if whole else part, sets, percent)
            return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

        signed = rows.join(self.nodes.select("id", "sig"), "id")
        few = self.scratch.table(signed.groupBy("key", "i", "j").applyInArrow(named, "key long, i long, j long, part long, id long, n long, c long"))
        return self._shipped(few, "id").groupBy("key", "i", "j").applyInArrow(linked, "u long, v long")

    def _shipped(self, keyed: DataFrame, on: str) -> DataFrame:
        """The rows of ``keyed`` with the shingle set of the text of ``on``."""
        names = [c for c in keyed.columns]
        width = self.width

        def run(batches):
            for whole in batches:
                for b in text_slices(whole, "text"):
                    sets = [s.tobytes() for s in _sets(b.column("text"), width)]
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sets, pa.binary())], names=[*names, f"set_{on}"])

        texts = self.docs.select(F.col("doc_id").cast("long").alias(on), F.col("text").cast("string").alias("text"))
        return texts.join(_small(keyed), on).select(*names, "text").mapInArrow(run, ", ".join(f"{c} long" for c in names) + f", set_{on} binary")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of (a, b) those whose full sets reach the similarity."""
        percent = self.percent

        def run(batches):
            for b in batches:
                keep = []
                for x, y in zip(b.column("set_a"), b.column("set_b")):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    same = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * same >= percent * (len(p) + len(q) - same))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["u", "v"]).filter(pa.array(keep))

        right = self._shipped(pairs.select("a", "b"), "b")
        left = self._shipped(pairs.select("a").distinct(), "a")
        return right.join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 64, collisions: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to one row for each: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |A n B| >= percent * |A u B| for their
    sets of distinct ``width``-word shingles (A-Z lower-cased; a text with fewer
    words has its whole sequence as its one shingle). component_id is the
    smallest doc_id that a document reaches over links, itself included; kept
    marks the documents that are their component's smallest.

    A pair is confirmed if its signatures agree on ``collisions`` of ``k``
    coordinates. The default loses a pair at the similarity once in about 30,000 cases;
    fewer collisions lose fewer and compare more: with 1, as good as none (0.2 ** 64 at 0.8).

    Defined cases: a null, empty or blank text has an empty set, n_shingles 0,
    and is linked with nothing; a null doc_id is linked with nothing, has a
    null component_id and is kept; rows that share a doc_id are one document
    with several texts and get a row each; equal texts are linked; an empty
    table gives an empty result; further columns of ``docs`` are ignored,
    whatever their names. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "minhash")
    t = collisions or match_threshold(k, percent / 100)
    base = scratch.table(signatures(docs, width, k))
    known = base.where("set_id is not null and doc_id is not null")
    nodes = scratch.table(known.groupBy("set_id", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")).select("set_id", "id", F.col("n_shingles").alias("n"), "sig"))
    join = _Join(docs, nodes, scratch, width, percent, k, t)
    lists = scratch.table(join.lists())
    alike = scratch.table(join._alike(join.first_pairs(lists)))
    best = alike.groupBy("b").agg(F.max_by("a", F.struct("hits", -F.col("a"))).alias("a")).select("a", "b")
    best = scratch.table(best)
    edges = scratch.table(join.confirmed(best))
    member = components(edges, scratch)

    def link(pairs: DataFrame) -> None:
        nonlocal edges, member
        of = lambda x: member.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
        split = scratch.table(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"))
        if split.isEmpty():
            return
        more = scratch.table(join.confirmed(split))
        if not more.isEmpty():
            edges = scratch.table(edges.unionByName(more))
            member = components(edges, scratch)

    link(alike.select("a", "b"))
    scratch.drop(alike, best)
    few, more = join.rest_pairs(lists, member)
    more = scratch.table(more)
    if not more.isEmpty():
        edges = scratch.table(edges.unionByName(more))
        member = components(edges, scratch)
    link(few)
    scratch.drop(lists)
    top = nodes.join(member, "id", "left").select("set_id", F.coalesce("component", "id").alias("top"))
    # rows of a doc_id with several texts reach each other
    out = base.join(top, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
