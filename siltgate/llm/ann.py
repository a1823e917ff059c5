"""Approximate nearest neighbours with an inverted multi-index.

A vector's two halves are quantised by separate codebooks (k-means over a
bounded sample), so every row falls into one of codes * codes cells, whose inverted
lists hold the rows. A query walks the pairs of centroids in the order of their summed
squared distance, with a heap that holds the frontier, until the visited cells
hold enough rows. Neighbouring cells lie in blocks of even size (a cell larger than a
block in several). Each row goes to its block and each query to the blocks of the
cells that it visits, once; there it opens those lists alone, reranks their entries by
the exact distance and passes on its best ones.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch

#: Rows that the codebooks are fitted on, at most (chosen by a hash of the id).
SAMPLE = 20_000
#: Rows of that sample that are searched by brute force to set how far walks go, at most about, and what they must find.
ASKED, RECALL = 500, 0.96
#: Rows of a block, about.
BLOCK_ROWS = 10_000


def kmeans(x: np.ndarray, k: int, seed: int = 7, rounds: int = 15) -> np.ndarray:
    """Lloyd's algorithm from k-means++ seeds; fewer distinct points give fewer centres."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k and near.max() > 0:
        centres.append(x[rng.choice(len(x), p=near / near.sum())])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        label = squared(x, c).argmin(1)
        for j in range(len(c)):
            mine = x[label == j]
            if len(mine):
                c[j] = mine.mean(0)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def walk(left: np.ndarray, right: np.ndarray, sizes: list[int], enough: int) -> list[int]:
    """Non-empty cells in the order of left[i] + right[j] until they hold ``enough`` rows."""
    a, b = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    x, y, n = left[a].tolist(), right[b].tolist(), len(b)
    heap, out, have = [(x[0] + y[0], 0, 0)], [], 0
    while heap and have < enough:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * n + b[j]
        if sizes[cell]:
            out.append(cell)
            have += sizes[cell]
        # each pair enters once: along its row from the left, and a row's first pair from above
        if j + 1 < n:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return out


def needed_share(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], half: int, k: int, recall: float) -> float:
    """The smallest share of all rows that walks must reach to find ``recall`` of the true ``k`` nearest, on a bounded sample.

    Up to ``ASKED`` rows of the sample are searched by brute force; each true neighbour has the share of rows that its query's walk holds when it
    opens the neighbour's cell. More rows than the sample's lie nearer to a query, so the share holds for larger tables.
    """
    n_right = len(books[1])
    left, right = squared(x[:, :half], books[0]), squared(x[:, half:], books[1]) if n_right > 1 else np.zeros((len(x), 1))
    cell = left.argmin(1) * n_right + right.argmin(1)
    size = np.bincount(cell, minlength=len(books[0]) * n_right)
    full = np.flatnonzero(size)
    shares = []
    for q in range(0, len(x), max(1, len(x) // ASKED)):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1) - 1)[: min(k, len(d) - 1)]
        far = left[q][full // n_right] + right[q][full % n_right]
        order = np.argsort(far, kind="stable")
        held = np.empty(len(size))
        held[full[order]] = np.cumsum(size[full[order]]) / len(x)
        shares.append(held[cell[near]])
    every = np.sort(np.concatenate(shares)) if shares else np.ones(1)
    return float(every[min(len(every) - 1, math.ceil(recall * len(every)))]) if len(every) else 1.0


def usable(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, codes: int = 256, share: float | None = None, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    other rows. score is the Euclidean distance in double precision on the
    original vectors; equal distances go to the smaller id. A query's walk ends
    when its cells hold ``share`` of all rows, whatever their number, and ``k`` besides its own at least. Without ``share``
    it is the smallest that finds ``RECALL`` of the true neighbours in a bounded sample: a third for vectors without
    structure, a few hundredths for clustered ones.

    Defined cases: vectors that are null, empty, zero or have null or
    non-finite components take no part, neither do rows with a null id or with
    another length than the most common one (the longer at a tie). A repeated
    id is as many rows: each is a candidate for queries of other ids, and its
    query is asked once for each distinct vector (same query_id, own ranks).
    Fewer rows than ``k`` give as many as there are; an empty table none.
    Further columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    good = usable(vectors, ident, vector)
    dims = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dims is None:
        return empty
    dim, total = int(dims["d"]), int(dims["count"])
    good = good.where(F.size("v") == dim)
    # a bounded sample by a hash of the id: the same rows however the table is dealt
    part = min(1.0, SAMPLE / total)
    sample = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < max(1, int(part * 1_000_000))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    x = np.array([r.v for r in sample.select("v").collect()] or [good.first().v])
    half = max(1, dim // 2)
    books = (kmeans(x[:, :half], codes), kmeans(x[:, half:], codes) if dim > half else np.zeros((1, 0)))
    n_right = len(books[1])
    n_cells = len(books[0]) * n_right
    share = needed_share(x, books, half, k, RECALL) if share is None else share

    def matrix(col: pa.Array) -> np.ndarray:
        return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)

    def assign(batches):
        for b in batches:
            m = matrix(b.column("v"))
            cell = squared(m[:, :half], books[0]).argmin(1) * n_right + (squared(m[:, half:], books[1]).argmin(1) if n_right > 1 else 0)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int64))], names=["vec_id", "v", "cell"])

    rows = scratch.table(good.mapInArrow(assign, "vec_id long, v array<double>, cell long"))
    sizes = [0] * n_cells
    for r in rows.groupBy("cell").count().collect():  # at most codes * codes rows
        sizes[r["cell"]] = r["count"]
    enough = max(math.ceil(total * share), k + 1)
    # cells in runs of about BLOCK_ROWS rows; a larger cell is dealt to blocks of its own
    first, parts, at, have = [0] * n_cells, [1] * n_cells, 0, 0
    for cell, n in enumerate(sizes):
        if n > BLOCK_ROWS:
            at += have > 0
            first[cell], parts[cell], have = at, math.ceil(n / BLOCK_ROWS), 0
            at += parts[cell]
        else:
            if have + n > BLOCK_ROWS:
                at, have = at + 1, 0
            first[cell], have = at, have + n

    def sums(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(m[:, :half], books[0]), squared(m[:, half:], books[1]) if n_right > 1 else np.zeros((len(m), 1))

    _ENTRY = "block int, kind byte, id long, v array<double>, cells array<int>"
    names = ["block", "kind", "id", "v", "cells"]
    one_list = lambda lists: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)), pa.array(np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32)))

    def entries(batches):
        """Rows with their block: the parts of a large cell in turn."""
        turn = 0
        for b in batches:
            cell = b.column("cell").to_numpy()
            block = np.array(first, np.int64)[cell] + (np.arange(turn, turn + len(cell)) % np.array(parts)[cell])
            turn += len(cell)
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(np.zeros(len(cell), np.int8)), b.column("vec_id"), b.column("v"), one_list(cell[:, None])], names=names)

    def visits(batches):
        """A row for each block that holds cells of a query's walk, with those cells."""
        for b in batches:
            for r, (p, q) in enumerate(zip(*sums(matrix(b.column("v"))))):
                cells = np.array(walk(p, q, sizes, enough), np.int64)
                times = np.array(parts)[cells]
                held = np.repeat(cells, times)
                block = np.array(first)[held] + np.arange(len(held)) - np.repeat(np.cumsum(times) - times, times)
                order = np.argsort(block, kind="stable")
                block, held = block[order], held[order]
                cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                same = pa.array(np.full(len(cut), r))
                yield pa.RecordBatch.from_arrays([pa.array(block[cut].astype(np.int32)), pa.array(np.ones(len(cut), np.int8)), b.column("vec_id").take(same), b.column("v").take(same), one_list(np.split(held, cut[1:]))], names=names)

    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct().repartition("vec_id")
    dealt = rows.select("vec_id", "v", "cell").mapInArrow(entries, _ENTRY).unionByName(asked.mapInArrow(visits, _ENTRY))

    def rerank(batches):
        """Entries of a block come first and are held, by cell; then its queries, one by one."""
        now, held, lists = None, [], None
        for b in batches:
            block, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])])).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(block)]):
                piece = b.slice(i, j - i)
                if block[i] != now:
                    now, held, lists = block[i], [], None
                if kind[i] == 0:
                    held.append((matrix(piece.column("v")), piece.column("id").to_numpy(), piece.column("cells").flatten().to_numpy()))
                    continue
                if lists is None and held:
                    c, ids, cell = (np.concatenate([h[x] for h in held]) for x in range(3))
                    order = np.argsort(cell, kind="stable")
                    kinds, starts = np.unique(cell[order], return_index=True)
                    lists = (c[order], ids[order], kinds, np.append(starts, len(cell)))
                if lists is None:
                    continue
                c, ids, kinds, starts = lists
                out = []
                for qid, one, cells in zip(piece.column("id").to_pylist(), matrix(piece.column("v")), piece.column("cells")):
                    open_ = np.flatnonzero(np.isin(kinds, cells.values.to_numpy(), assume_unique=True))
                    seen = np.concatenate([np.arange(starts[x], starts[x + 1]) for x in open_.tolist()] or [np.zeros(0, np.int64)])
                    seen = seen[ids[seen] != qid]
                    d = np.sqrt(((c[seen] - one) ** 2).sum(1))
                    few = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                    few = few[np.lexsort((ids[seen[few]], d[few]))][:k]
                    out.append((np.full(len(few), qid), np.full(len(few), zlib.crc32(one.tobytes())), ids[seen[few]], d[few]))
                cols = [np.concatenate(x) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in cols[:3]), pa.array(cols[3])], names=["query_id", "q", "vec_id", "score"])

    found = dealt.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(rerank, "query_id long, q long, vec_id long, score double")
    order = W.partitionBy("query_id", "q").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
