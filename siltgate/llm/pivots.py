"""Hard negatives with a pivot table.

Vectors get one more component, so that all have the same length and the Euclidean distance to an
(unaugmented) anchor falls as the inner product with it rises. The pivot table stores every row's distances to a few
pivots; by the triangle inequality they bracket its distance to an anchor, hence its
score, and only rows whose bracket reaches what is asked are scored exactly.

Rows lie in zones, those of their nearest pivot by distance, dealt to blocks of even size. A zone's smallest and largest distance to each
pivot bracket all of its rows at once: anchors are sent, many in a row, to the zones that can hold
an answer alone. A first visit to the most promising zone gives each anchor scores to beat.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch

#: Rows that the pivots are chosen from, at most (by a hash of the id).
SAMPLE = 5_000
PIVOTS = 16
#: Rings of equal numbers of sampled rows about each pivot; each is a zone.
RINGS = 8
#: Rows of a block and anchors of a batch, at most about.
BLOCK_ROWS, BATCH = 20_000, 512
#: Integers up to this size have exact sums of products in doubles.
EXACT = 1 << 53
SCORED = "anchor_id long, a_label long, seq long, vec_id long, label long, score long, k int"


def usable(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v array<double>): rows that take part, components floor(256 * x)."""
    v = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    v = v.where("vec_id is not null and label is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.coalesce(finite, F.lit(False))).withColumn("v", F.transform("v", lambda x: F.rint(x * 256 - F.pmod(x * 256, F.lit(1.0)))))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def choose(x: np.ndarray, k: int) -> np.ndarray:
    """Pivots far from each other: each is the row that lies farthest from those before (the first such)."""
    out = [x[int(((x - x.mean(0)) ** 2).sum(1).argmax())]]
    near = ((x - out[0]) ** 2).sum(1)
    while len(out) < k and near.max() > 0:
        out.append(x[int(near.argmax())])
        near = np.minimum(near, ((x - out[-1]) ** 2).sum(1))
    return np.array(out)


class Space:
    """The augmented vectors' geometry: pivots, and what distances to them say about scores."""

    def __init__(self, pivots: np.ndarray, longest: float) -> None:
        self.longest = longest
        self.pivots = self.augmented(pivots)
        # doubles err by a few parts in 1e16 of the squares; distances are widened by far more than that
        self.slack = 1e-6 * math.sqrt(longest) + 1e-9

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0))[:, None]])

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        y = np.hstack([x, np.zeros((len(x), 1))]) if query else self.augmented(x)
        square = (y * y).sum(1)[:, None] - 2 * y @ self.pivots.T + (self.pivots * self.pivots).sum(1)[None]
        return np.sqrt(np.maximum(square, 0))

    def most(self, square: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Upper bound of the scores of queries (|q|^2, distances d) with rows whose distances lie from low to high."""
        gap = np.zeros((len(d), len(low)))
        for j in range(d.shape[1]):
            np.maximum(gap, np.maximum(low[None, :, j] - d[:, None, j], d[:, None, j] - high[None, :, j]), out=gap)
        near = np.maximum(gap - self.slack, 0)
        return (square[:, None] + self.longest - near * near) / 2 + 1

    def least(self, square: np.ndarray, d: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Lower bound of those scores."""
        far = np.full((len(d), len(high)), np.inf)
        for j in range(d.shape[1]):
            np.minimum(far, d[:, None, j] + high[None, :, j], out=far)
        far = far + self.slack
        return (square[:, None] + self.longest - far * far) / 2 - 1


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers: in doubles where those are exact, else in Python's integers."""
    if not len(q) or not len(x) or float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(c) for c in r] for r in q], object) @ np.array([[int(c) for c in r] for r in x], object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, equal ones by smaller id."""
    few = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else np.arange(len(score))
    return few[np.lexsort((ids[few], -score[few].astype(object) if score.size and score.min() == -(1 << 63) else -score[few]))][:k]


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, ident: str = "vec_id", vector: str = "embedding", label: str = "label", moved: int = 7) -> DataFrame:
    """For each anchor (id divisible by ``every``) and each of its ``positives`` nearest rows of the same label, the
    first ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent of the positive's.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Scores are inner products of the
    integer components floor(256 * x); higher ones come first, ties go to the smaller id. Before that, rows
    whose id is divisible by ``moved`` get the label (label + 1) % 10 (0: none do).

    Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part, neither do rows
    of another length than the most common one (the longer at a tie); a zero vector is one like others. A row is no partner of rows
    of its own id; a repeated anchor id is asked once for each distinct vector and label. Fewer rows than asked give as many
    as there are; a positive score under zero has no negatives. Scores beyond 64 bits count as the largest or smallest
    number of 64 bits. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivots")
    good = usable(vectors, ident, vector, label)
    if moved:
        good = good.withColumn("label", F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    kinds = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("longest")).orderBy(F.desc("n"), F.desc("d")).first()
    if kinds is None or not kinds["d"]:
        return empty
    dim, total = int(kinds["d"]), int(kinds["n"])
    good = good.where(F.size("v") == dim)
    part = min(1.0, SAMPLE / total)
    pick = F.pmod(F.xxhash64("vec_id", F.lit("pivot")), F.lit(1_000_000)) < max(1, int(part * 1_000_000))
    sample = np.array([r.v for r in good.where(pick).orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(SAMPLE).select("v").collect()] or [good.first().v])
    space = Space(choose(sample, PIVOTS), float(kinds["longest"]) * (1 + 1e-12))
    n_pivots = len(space.pivots)
    # rings about each pivot, cut at the sampled rows' distances
    d = space.distances(sample)
    home = d.argmin(1)
    cuts = np.array([np.quantile(d[home == j, j], np.arange(1, RINGS) / RINGS) if (home == j).any() else np.zeros(RINGS - 1) for j in range(n_pivots)])

    def table(batches):
        """The pivot table: each row with its zone and its distances to the pivots."""
        for b in batches:
            d = space.distances(_matrix(b.column("v"), dim))
            home = d.argmin(1)
            zone = home * RINGS + (d[np.arange(len(d)), home][:, None] > cuts[home]).sum(1)
            pd = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * n_pivots), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), pa.array(zone.astype(np.int32)), pd], names=["vec_id", "label", "v", "zone", "pd"])

    rows = scratch.table(good.mapInArrow(table, "vec_id long, label long, v array<double>, zone int, pd array<double>"))
    # at most PIVOTS * RINGS rows, whatever the data
    bounds = rows.groupBy("zone").agg(F.count("*").alias("n"), *[f(F.col("pd")[j]).alias(f"{n}{j}") for n, f in (("lo", F.min), ("hi", F.max)) for j in range(n_pivots)]).orderBy("zone").collect()
    zones = np.array([r["zone"] for r in bounds])
    z_low, z_high = (np.array([[r[f"{n}{j}"] for j in range(n_pivots)] for r in bounds]) for n in ("lo", "hi"))
    parts = np.array([math.ceil(r["n"] / BLOCK_ROWS) for r in bounds])
    start = np.concatenate([[0], np.cumsum(parts)])[:-1]
    parts_of = F.element_at(F.create_map(*[F.lit(int(x)) for z, p in zip(zones, parts) for x in (z, p)]), F.col("zone"))
    start_of = F.element_at(F.create_map(*[F.lit(int(x)) for z, s in zip(zones, start) for x in (z, s)]), F.col("zone"))
    block = (start_of + F.pmod(F.xxhash64("vec_id", "label", "v"), parts_of)).cast("int")
    none = F.lit(None)
    entry = "block int, kind byte, vec_id long, label long, v array<double>, pd array<double>, seq long, bars array<long>, only int"
    entries = rows.select(block.alias("block"), F.lit(0).cast("byte").alias("kind"), "vec_id", "label", "v", "pd", none.cast("long").alias("seq"), none.cast("array<long>").alias("bars"), none.cast("int").alias("only"))
    anchors = rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", "v", "pd").distinct().withColumn("seq", F.xxhash64("label", "v"))

    def listed(cells: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))

    def send(home_only: bool, floor):
        """Anchors with their bars to the zones whose bracket reaches ``floor(bars)``: a row for each block of them."""

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, BATCH):
                    b = whole.slice(at, BATCH)
                    v, pd = _matrix(b.column("v"), dim), _matrix(b.column("pd_q"), n_pivots)
                    top = space.most((v * v).sum(1), pd, z_low, z_high)
                    reach = np.arange(len(zones))[None] == top.argmax(1)[:, None] if home_only else top >= floor(b)[:, None]
                    q, z = np.nonzero(reach)
                    q, z = np.repeat(q, parts[z]), np.concatenate([np.arange(start[i], start[i] + parts[i]) for i in z.tolist()] or [np.zeros(0, np.int64)])
                    take = pa.array(q)
                    cols = [pa.array(z.astype(np.int32)), pa.array(np.ones(len(q), np.int8)), *(b.column(c).take(take) for c in ("vec_id", "label", "v")), b.column("pd_q").take(take), b.column("seq").take(take), b.column("bars").take(take), pa.array(np.zeros(len(q), np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["block", "kind", "vec_id", "label", "v", "pd", "seq", "bars", "only"])

        return run

    def asked(df: DataFrame, home_only: bool, floor=None) -> DataFrame:
        # distances of the unaugmented anchor
        def measured(batches):
            for b in batches:
                v = _matrix(b.column("v"), dim)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "label", "v", "seq", "bars")), listed(space.distances(v, True))], names=["vec_id", "label", "v", "seq", "bars", "pd_q"])

        q = df.select("vec_id", "label", "v", "seq", "bars").mapInArrow(measured, "vec_id long, label long, v array<double>, seq long, bars array<long>, pd_q array<double>")
        return q.mapInArrow(send(home_only, floor), entry)

    def visited(queries: DataFrame, answer) -> DataFrame:
        """Each block's rows come first and are held; ``answer`` gets every batch of its anchors."""

        def run(batches):
            now, held, base = None, [], None
            for b in batches:
                blocks, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
                edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (kind[1:] != kind[:-1]), [True]])).tolist()
                for i, j in pairwise(edges):
                    piece = b.slice(i, j - i)
                    if blocks[i] != now:
                        now, held, base = blocks[i], [], None
                    if kind[i] == 0:
                        held.append((piece.column("vec_id").to_numpy(), piece.column("label").to_numpy(), _matrix(piece.column("v"), dim), _matrix(piece.column("pd"), n_pivots)))
                        continue
                    if base is None and held:
                        base = tuple(np.concatenate(x) for x in zip(*held))
                    if base is None:
                        continue
                    for at in range(0, piece.num_rows, 64):
                        yield from answer(piece.slice(at, 64), base)

        dealt = entries.unionByName(queries).repartition("block").sortWithinPartitions("block", "kind")
        return dealt.mapInArrow(run, SCORED)

    def survivors(b: pa.RecordBatch, base: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v, pd = _matrix(b.column("v"), dim), _matrix(b.column("pd"), n_pivots)
        square = (v * v).sum(1)
        return v, space.most(square, pd, base[3], base[3]), space.least(square, pd, base[3])

    def told(b: pa.RecordBatch, base: tuple, found: list[tuple[int, np.ndarray, np.ndarray, int]]):
        if found:
            q = np.concatenate([np.full(len(x[1]), x[0]) for x in found])
            at, score, k = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found]), np.concatenate([np.full(len(x[1]), x[3]) for x in found])
            take = pa.array(q)
            cols = [b.column("vec_id").take(take), b.column("label").take(take), b.column("seq").take(take), *(pa.array(x.astype(np.int64)) for x in (base[0][at], base[1][at], score)), pa.array(k.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["anchor_id", "a_label", "seq", "vec_id", "label", "score", "k"])

    def nearest(b: pa.RecordBatch, base: tuple):
        """The first ``positives`` of a block for each anchor, if they reach its bar."""
        v, top, _ = survivors(b, base)
        qid, qlabel = b.column("vec_id").to_numpy(), b.column("label").to_numpy()
        bars = _matrix(b.column("bars"), 1)[:, 0]
        may = (base[1][None] == qlabel[:, None]) & (base[0][None] != qid[:, None]) & (top >= bars[:, None])
        found = []
        for i in range(len(v)):
            at = np.flatnonzero(may[i])
            if len(at):
                s = scores(v[i : i + 1], base[2][at])[0]
                at, s = at[s >= bars[i]], s[s >= bars[i]]
                best = first(s, base[0][at], positives) if len(at) else np.zeros(0, np.int64)
                found.append((i, at[best], s[best], 0))
        yield from told(b, base, found)

    least = -(1 << 63)
    order = W.partitionBy("anchor_id", "a_label", "seq").orderBy(F.desc("score"), "vec_id")

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("p", F.row_number().over(order).cast("int")).where(F.col("p") <= positives)

    keys = ["vec_id", "label", "seq"]
    lone = F.array(F.lit(least))
    seed = ranked(visited(asked(anchors.withColumn("bars", lone), True), nearest))
    # the last of as many positives as are asked for is to be beaten or met; fewer leave no bar
    bar = scratch.table(seed.groupBy(F.col("anchor_id").alias("vec_id"), F.col("a_label").alias("label"), "seq").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") == positives).select(*keys, F.array("low").alias("bars")))
    with_bar = anchors.join(bar, keys, "left").withColumn("bars", F.coalesce("bars", lone))
    found = scratch.table(ranked(visited(asked(with_bar, False, lambda b: _matrix(b.column("bars"), 1)[:, 0].astype(np.float64)), nearest)).select("anchor_id", "a_label", "seq", "vec_id", "score", "p"))

    # for each positive the range that a negative's score must lie in, as pairs of bounds
    ceil_of = lambda c, n: -F.expr(f"cast(floor(-cast({c} as decimal(38,0)) * {n} / 100) as decimal(38,0))")
    floor_of = lambda c, n: F.expr(f"cast(floor(cast({c} as decimal(38,0)) * {n} / 100) as decimal(38,0))")
    span = F.struct("p", ceil_of("score", low).cast("long").alias("from"), floor_of("score", high).cast("long").alias("to"))
    spans = found.where("score >= 0").groupBy(F.col("anchor_id").alias("vec_id"), F.col("a_label").alias("label"), "seq").agg(F.sort_array(F.collect_list(span)).alias("s"))
    pad = lambda name, fill: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda p: F.coalesce(F.try_element_at(F.transform(F.filter("s", lambda x: x["p"] == p), lambda x: x[name]), F.lit(1)), F.lit(fill)))
    # a missing positive has an empty range
    ranges = F.concat(pad("from", (1 << 63) - 1), pad("to", least))

    def others(b: pa.RecordBatch, base: tuple):
        """For each anchor and positive the first ``negatives`` of a block within the range."""
        v, top, low_ = survivors(b, base)
        qlabel, qid = b.column("label").to_numpy(), b.column("vec_id").to_numpy()
        ranges = _matrix(b.column("bars"), 2 * positives)
        may = (base[1][None] != qlabel[:, None]) & (base[0][None] != qid[:, None])
        may &= (top >= ranges[:, :positives].min(1).astype(np.float64)[:, None]) & (low_ <= ranges[:, positives:].max(1).astype(np.float64)[:, None])
        found = []
        for i in range(len(v)):
            at = np.flatnonzero(may[i])
            if not len(at):
                continue
            s = scores(v[i : i + 1], base[2][at])[0]
            for p in range(positives):
                ok = np.flatnonzero((s >= ranges[i, p]) & (s <= ranges[i, positives + p]))
                if len(ok):
                    ok = ok[first(s[ok], base[0][at[ok]], negatives)]
                    found.append((i, at[ok], s[ok], p + 1))
        yield from told(b, base, found)

    with_range = anchors.join(spans, keys).withColumn("bars", ranges)
    hits = visited(asked(with_range, False, lambda b: _matrix(b.column("bars"), 2 * positives)[:, :positives].min(1).astype(np.float64)), others)
    per = W.partitionBy("anchor_id", "a_label", "seq", "k").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("rank", F.row_number().over(per).cast("int")).where(F.col("rank") <= negatives)
    told_ = found.select("anchor_id", "a_label", "seq", F.col("p").alias("k"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hits.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(told_, ["anchor_id", "a_label", "seq", "k"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
