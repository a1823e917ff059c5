"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: A sequence of c slots costs c + c * c / ATTENTION + OVERHEAD: its slots, what grows with their square, and what any sequence costs.
ATTENTION, OVERHEAD = 16_384, 64
#: Pieces that are packed together: more would fill the last bins better, fewer use less memory.
SHARD = 20_000


def cost(capacity, overhead: int = OVERHEAD, attention: int = ATTENTION):
    """What a sequence of so many slots costs."""
    return capacity + capacity * capacity / attention + overhead


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final capacity of each piece (no longer than the largest capacity).

    Pieces come longest first. A piece goes to the open bin that it leaves the
    least room in (the latest opened at a tie). If none has room, a bin is opened for it: each permitted
    size is filled in thought from the lengths that are still to come, the longest
    that fits first, and the size whose cost for each token so packed is least is
    taken (the smaller at a tie). At the end every bin gets the smallest permitted length that
    holds its contents. Pieces of length 0 go to the last bin, full or not.
    """
    caps = sorted(capacities)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    to_come = {int(x): int(c) for x, c in zip(*np.unique(lengths, return_counts=True)) if x}
    waiting = sum(1 << x for x in to_come)  # bit x: a piece of length x is still to come

    def filled(room: int) -> int:
        """Slots of ``room`` that pieces to come would fill."""
        full, taken = room, {}
        while here := waiting & ((1 << room + 1) - 1):
            x = here.bit_length() - 1
            while x > 0 and taken.get(x, 0) >= to_come[x]:
                here &= (1 << x) - 1
                x = here.bit_length() - 1
            if x <= 0:
                break
            some = min(room // x, to_come[x] - taken.get(x, 0))
            taken[x] = taken.get(x, 0) + some
            room -= some * x
        return full - room

    room: dict[int, list[int]] = {}
    mask = 0  # bit r: some bin has r free
    used: list[int] = []
    size: list[int] = []
    for i in order.tolist():
        need = int(lengths[i])
        if not need and used:
            bins[i], offsets[i] = len(used) - 1, used[-1]
            continue
        if need:
            to_come[need] -= 1
            if not to_come[need]:
                waiting &= ~(1 << need)
        fits = mask >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
        else:
            b = len(used)
            able = [c for c in caps if c >= need]
            size.append(min(able, key=lambda c: (cost(c, overhead, attention) / max(1, need + filled(c - need)), c)))
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += need
        free = size[b] - used[b]
        if free:
            room.setdefault(free, []).append(b)
            mask |= 1 << free
    final = np.array([next(c for c in caps if c >= u) for u in used], np.int64)
    return bins, offsets, final[bins] if n else final


def best_fit(docs: DataFrame, length: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION, shard: int = SHARD) -> DataFrame:
    """``docs(doc_id, <length>)`` to a row for each piece of a document.

    Columns: doc_id, piece (from 0), start and n_tokens (long: the piece's
    place in the document), bin_id (string), capacity (long, of the bin) and
    bin_start (long, the piece's place in the bin). Documents longer than the
    largest capacity are cut into pieces of that capacity and a rest; no token
    is dropped. Pieces are dealt by a hash to shards of about ``shard`` pieces
    that are packed one by one, which costs a few half-filled bins a shard.

    Defined cases: a null, zero or negative length gives one piece of length 0 in
    some bin; a null doc_id and repeated rows are packed like others, each row for
    itself; pieces of one length come in the order of doc_id, piece and number among equal rows, and of equally
    tight bins the latest opened is taken; an empty table gives an empty result; other columns,
    whatever their names, are ignored. Lengths of any size are cut, none is shortened.
    """
    top = max(capacities)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("_n"))
    # equal rows are numbered by their count, so that nothing depends on how the table is dealt
    rows = rows.groupBy("doc_id", "_n").agg(F.count("*").alias("_c")).select("doc_id", "_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))).alias("_row"))
    cut = rows.select("doc_id", "_n", "_row", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / top) - 1, F.lit(0)).cast("long"))).alias("piece"))
    pieces = cut.select("doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("_n") - F.col("piece") * top).alias("n_tokens"), "_row")
    total = rows.agg(F.sum(F.greatest(F.ceil(F.col("_n") / top), F.lit(1)))).first()[0] or 0
    shards = max(1, math.ceil(int(total) / shard))
    # the number keeps repeated rows from filling one shard
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "_row", "n_tokens"), F.lit(shards)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("_row", "ascending")])
        bins, offsets, final = pack(t.column("n_tokens").to_numpy(), capacities, overhead, attention)
        names = [f"{s}-{b}" for s, b in zip(t.column("shard").to_pylist(), bins.tolist())]
        cols = [*(t.column(c) for c in ("doc_id", "piece", "start", "n_tokens")), pa.array(names), pa.array(final), pa.array(offsets)]
        return pa.Table.from_arrays(cols, names=["doc_id", "piece", "start", "n_tokens", "bin_id", "capacity", "bin_start"])

    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece long, start long, n_tokens long, bin_id string, capacity long, bin_start long")


def word_count(text) -> F.Column:
    """Words of a text column (parts between white space), and one for the document's end."""
    return F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0, F.lit(1)).otherwise(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")) + 1).cast("long")
