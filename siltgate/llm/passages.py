"""Substring dedup with compact windows.

The tokens of a text are its runs of five words. For each of ``hashes`` hash
functions a Cartesian tree over the tokens' hashes gives the compact windows:
node c with subtree [l, r] stands for all subsequences of [l, r] that contain
c, for all of which c is the min-hash. Only windows of at least ``least``
tokens are kept, about two a ``least`` tokens. Windows with equal min-hash
share their subsequences' signature.

1. Equal texts are one; the copies name the smallest doc_id.
2. A first pass over the windows counts, per min-hash, its smallest and largest document:
   no window is written. A second pass keeps the windows whose min-hash two documents have.
3. Each document meets the smallest holder of its min-hashes, its source, where
   windows of ``need`` functions overlap (an interval join within the pair), and the pairs
   are confirmed on the token sequences.
4. What no confirmed passage covers meets the other holders of the same min-hash.
   The tokens about it, a byte each, are compared in blocks, so that only the pairs
   come out that agree about it as a passage must (see ``partners``), one for each place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .shingles import mix, shingle_hashes, text_slices, word_hashes

#: Sides of a join with at most so many rows of two to four integers (under 64 MB) are broadcast.
SMALL = 1_500_000
#: Holders of a min-hash that one task compares with as many others.
BLOCK = 16_384
#: Pieces of a stretch, two neighbouring ones of which hold what differs.
PIECES = 6
#: Tokens of the runs that rule out rows before that.
RUN = 9
#: Neighbourhoods that are cut out at a time (about 1 KB each).
AT_ONCE = 20_000


def _windows(h: np.ndarray, to: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, l, c, r) of the nodes that span ``least`` or more, for the sequences h[to[i]:to[i+1]].

    A node spans ``least`` exactly if it is the leftmost minimum of some
    stretch of ``least``; the nearest smaller ones on both sides span as much, so
    the subtrees' ends follow from the kept nodes alone.
    """
    n = len(h)
    none = np.zeros(0, np.int64)
    starts = np.concatenate([np.arange(a, b - least + 1) for a, b in zip(to[:-1].tolist(), to[1:].tolist()) if b - a >= least] or [none])
    if not len(starts):
        return none, none, none, none
    # the place in the low bits: equal hashes are ordered, and a minimum tells where it is
    bits = np.uint64((1 << n.bit_length()) - 1)
    low, w = (h.astype(np.uint64) & ~bits) | np.arange(n, dtype=np.uint64), 1
    while 2 * w <= least:
        low, w = np.minimum(low[w:], low[:-w]), 2 * w
    if w < least:
        low = np.minimum(low[least - w :], low[: w - least])
    mark = np.zeros(n, bool)
    mark[(low[starts] & bits).astype(np.int64)] = True
    c = np.flatnonzero(mark)
    row = np.searchsorted(to, c, "right") - 1
    # the hash ranks first, as above
    first, value = np.searchsorted(row, row), h[c].astype(np.uint64) & ~bits
    last = np.searchsorted(row, row, "right") - 1
    # equal hashes go to the leftmost: an equal one ends a subtree on the left only
    left = np.arange(len(c)) - 1
    while len(odd := np.flatnonzero((left >= first) & (value[left] > value))):
        left[odd] = left[left[odd]]
    right = np.arange(len(c)) + 1
    while len(odd := np.flatnonzero((right <= last) & (value[np.minimum(right, len(c) - 1)] >= value))):
        right[odd] = right[right[odd]]
    lo = np.where(left >= first, c[left] + 1, to[row])
    hi = np.where(right <= last, c[np.minimum(right, len(c) - 1)] - 1, to[row + 1] - 1)
    return row, lo - to[row], c - to[row], hi - to[row]


def windows(h: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r), both ends inside: the nodes of one sequence's Cartesian tree that span ``least`` or more.

    Equal hashes go to the leftmost.
    """
    rank = np.unique(h, return_inverse=True)[1].astype(np.uint64)
    _, l, c, r = _windows(rank << np.uint64(32), np.array([0, len(h)]), least)  # noqa: E741
    return list(zip(l.tolist(), c.tolist(), r.tolist()))


def _flat_tokens(col: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens and where each row's start; texts under ``words`` words have none."""
    hashes, bounds = word_hashes(col)
    flat, to = shingle_hashes(hashes, bounds, words)
    short = (np.diff(bounds) < words) & (np.diff(to) > 0)
    if short.any():
        keep = np.ones(len(flat), bool)
        keep[to[:-1][short]] = False
        flat, to = flat[keep], np.concatenate([[0], np.cumsum(np.diff(to) - short)])
    return flat, to


def _tokens(col: pa.Array, words: int) -> list[np.ndarray]:
    flat, to = _flat_tokens(col, words)
    return [flat[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist())]


def _seeds(hashes: int) -> list[np.uint64]:
    return [np.uint64(x) for x in np.random.default_rng(11).integers(1, 1 << 63, hashes)]


def _postings(docs: DataFrame, words: int, least: int, hashes: int, whole: bool) -> DataFrame:
    """The windows of all texts: (key, doc_id), with ``whole`` also fn, l, c, r."""
    seeds = _seeds(hashes)

    def run(batches):
        for every in batches:
            for b in text_slices(every, "text", 2 << 20):
                flat, to = _flat_tokens(b.column("text"), words)
                ids = b.column("doc_id")
                for f, seed in enumerate(seeds):
                    h = mix(flat + seed)
                    row, l, c, r = _windows(h, to, least)  # noqa: E741
                    if not len(row):
                        continue
                    # a repeated word or phrase repeats its token: the first window holds those of the overlapping ones
                    value = h[to[row] + c]
                    again = np.zeros(len(row), bool)
                    again[1:] = (row[1:] == row[:-1]) & (value[1:] == value[:-1]) & (np.diff(c) < words)
                    row, l, c, r, value = (x[~again] for x in (row, l, c, r, value))  # noqa: E741
                    cols = [pa.array(value.view(np.int64)), ids.take(pa.array(row))]
                    if whole:
                        cols += [pa.array(np.full(len(row), f, np.int8)), *(pa.array(x.astype(np.int32)) for x in (l, c, r))]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "doc_id", "fn", "l", "c", "r"][: len(cols)])

    return docs.mapInArrow(run, "key long, doc_id long, fn byte, l int, c int, r int" if whole else "key long, doc_id long")


def _neighbourhoods(docs: DataFrame, words: int, least: int, hashes: int) -> DataFrame:
    """``docs(doc_id, text, asked: array of key, fn, c, parts, open)`` to (key, doc_id, parts, open, near): near has the
    ``least`` tokens on either side of c, a byte each (0 outside the text)."""
    seeds = np.array(_seeds(hashes))
    side = np.arange(-least, least + 1)

    def run(batches):
        for every in batches:
            for b in text_slices(every, "text", 2 << 20):
                flat, to = _flat_tokens(b.column("text"), words)
                asked = b.column("asked")
                key, fn, c, parts, open_ = (x.to_numpy(zero_copy_only=False) for x in asked.flatten().flatten())
                row = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(asked).to_numpy(zero_copy_only=False))
                size = np.diff(to)[row]
                # another text of the same doc_id has another token there
                ok = np.flatnonzero(c < size)
                ok = ok[mix(flat[to[row[ok]] + c[ok]] + seeds[fn[ok]]).view(np.int64) == key[ok]]
                for a in range(0, len(ok), AT_ONCE):
                    x = ok[a : a + AT_ONCE]
                    place = c[x, None] + side
                    held = (place >= 0) & (place < size[x, None])
                    near = flat[np.where(held, to[row[x], None] + place, 0)]
                    byte = np.where(held, (near >> np.uint64(40)) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8)
                    wide = pa.FixedSizeBinaryArray.from_buffers(pa.binary(byte.shape[1]), len(byte), [None, pa.py_buffer(byte.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(key[x]), b.column("doc_id").take(pa.array(row[x])), pa.array(parts[x]), pa.array(open_[x].astype(bool)), wide], names=["key", "doc_id", "parts", "open", "near"])

    return docs.mapInArrow(run, "key long, doc_id long, parts long, open boolean, near binary")


def _collide(matches: DataFrame, need: int) -> DataFrame:
    """(doc_id, source_id) with windows of ``need`` functions over one token of the document."""

    def run(batches):
        for b in batches:
            keep = []
            for rows in b.column("m"):
                fn, l, r = (x.to_numpy(zero_copy_only=False) for x in rows.values.flatten())  # noqa: E741
                cover = np.zeros(int(r.max()) + 2, np.int32)
                for f in np.unique(fn):
                    mine = fn == f
                    step = np.zeros(len(cover), np.int32)
                    np.add.at(step, l[mine], 1)
                    np.add.at(step, r[mine] + 1, -1)
                    cover += np.cumsum(step) > 0
                keep.append(bool(cover.max() >= need))
            yield b.select(["doc_id", "source_id"]).filter(pa.array(keep, pa.bool_()))

    rows = matches.groupBy("doc_id", "source_id").agg(F.collect_list(F.struct(F.col("fn").cast("int"), "l", "r")).alias("m"), F.count_distinct("fn").alias("n"))
    return rows.where(F.col("n") >= need).select("doc_id", "source_id", "m").mapInArrow(run, "doc_id long, source_id long")


def partners(key: np.ndarray, doc: np.ndarray, open_: np.ndarray, near: np.ndarray, least: int, percent: int) -> np.ndarray:
    """For each open row the place of the smallest document's row of its key that has a near-equal
    stretch of ``least`` tokens about the middle, if that document is smaller than its own; or -1.

    Stretches with ``percent`` similarity differ in one gap of ``hole`` tokens at most. A changed word changes all tokens that hold it
    and moves none; an inserted or dropped one moves all that stands beyond it by one. So rows are first
    compared as they stand, then those that are left over with the tokens beyond the gap moved (``_moved``).
    """
    if (np.diff(doc) < 0).any():
        by = np.argsort(doc, kind="stable")
        out = np.full(len(doc), -1)
        to = partners(key[by], doc[by], open_[by], near[by], least, percent)
        out[by[to >= 0]] = by[to[to >= 0]]
        return out
    out = _agreeing(key, doc, open_, near, least, percent, False)
    rest = open_ & (out < 0)
    rows = np.flatnonzero(np.isin(key, key[rest])) if rest.any() else np.zeros(0, np.int64)
    if len(rows) > 1:
        to = _agreeing(key[rows], doc[rows], rest[rows], near[rows], least, percent, True)
        out[rows[to >= 0]] = rows[to[to >= 0]]
    return out


def _agreeing(key: np.ndarray, doc: np.ndarray, open_: np.ndarray, near: np.ndarray, least: int, percent: int, moved: bool) -> np.ndarray:
    """One round of ``partners``, rows in the order of doc.

    For each start the rows are grouped by all pieces but two neighbouring ones, which must hold the gap, and the rows of a
    group by all that stands about each place of the gap in them: the members of such a group agree as a
    passage must, so the smallest one will do, and no pair is compared or written. With ``moved`` a row
    stands for two more: with a gap one token wider behind the middle, or before it. They
    meet rows whose gap is narrower, since a gap's own tokens and width don't count.
    """
    out = np.full(len(doc), -1)
    left = open_.copy()
    hole = least - -(-2 * least * percent // (100 + percent))
    if moved and not hole:
        return out
    pieces = max(3, min(PIECES, least // max(1, hole)))
    cuts = [i * least // pieces for i in range(pieces + 1)]
    n, wide = near.shape
    held = np.zeros((wide + 1, n), np.int16)
    np.cumsum(near.T > 0, axis=0, out=held[1:])
    # hashes of all that stands before a place: the difference of two, divided by the base's power, is that of what is between
    up = np.uint64(0x9E3779B97F4A7C15 | 1)
    down = np.uint64(pow(int(up), -1, 1 << 64))
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(wide - 1, up)]))
    before = np.zeros((wide + 1, n), np.uint64)
    np.cumsum(near.T.astype(np.uint64) * powers[:, None], axis=0, out=before[1:])
    flat = before.ravel()

    def groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places (ascending, so in the order of doc) by hash, and for each the place of its group's first and one after its last."""
        bits = np.uint64((1 << len(h).bit_length()) - 1)
        by = np.sort((h & ~bits) | np.arange(len(h), dtype=np.uint64))
        new = np.flatnonzero((by[1:] ^ by[:-1]) > bits) + 1
        number = np.zeros(len(h), np.int64)
        number[new] = 1
        number = np.cumsum(number)
        start = np.concatenate([[0], new])
        return (by & bits).astype(np.int64), start[number], np.append(new, len(h))[number]

    def asked(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the group of each holds several documents and an open row."""
        some = np.concatenate([[0], np.cumsum(left[at])])
        return (doc[at[lo]] < doc[at[hi - 1]]) & (some[hi] - some[lo] > 0)

    def inside(a: int, size: int) -> np.ndarray:
        """The rows that have text at all of the places from a."""
        return np.flatnonzero(held[a + size] - held[a] == size) if a >= 0 and a + size <= wide else np.zeros(0, np.int64)

    mixed_key = mix(key.view(np.uint64))
    # most rows share a few words only: a stretch holds whole runs of RUN tokens at fixed places, all but
    # two of which must agree with some other document's
    run = max(1, min(RUN, (least - 2) // 5))
    full = (least - run + 1) // run - (2 if hole else 0)
    if full > 0:
        shared = np.zeros(n, np.int64)
        for a in range(1, wide - run, run):
            # beyond a wider gap a run stands one place further from the middle
            shifts = [0, *([1] if a > least else [-1] if a + run <= least else [])] if moved else [0]
            rows = [inside(a + d, run) for d in shifts]
            h = [(before[a + d + run][r] - before[a + d][r]) * {0: np.uint64(1), 1: down, -1: up}[d] for r, d in zip(rows, shifts)]
            rows, h = np.concatenate(rows), np.concatenate(h)
            if len(rows) > 1:
                if moved:
                    by = np.argsort(rows, kind="stable")
                    rows, h = rows[by], h[by]
                order, lo, hi = groups(mix(h) + mixed_key[rows])
                at = rows[order]
                hit = np.zeros(n, bool)
                hit[at[asked(at, lo, hi)]] = True
                shared += hit
        keep = np.flatnonzero(shared >= full)
        # a key whose open rows are all out has nothing to ask
        keep = keep[np.isin(key[keep], key[keep[left[keep]]])]
        if len(keep) < 0.9 * n:
            if len(keep) > 1:
                to = _agreeing(key[keep], doc[keep], open_[keep], near[keep], least, percent, moved)
                out[keep[to >= 0]] = keep[to[to >= 0]]
            return out

    # a row as it stands; with what is behind its gap moved; with what is before it moved
    head_shift, tail_shift = np.array([0, 0, -1]), np.array([0, 1, 0])
    head_power, tail_power = np.array([1, 1, int(up)], np.uint64), np.array([1, int(down), 1], np.uint64)
    for start in range(1, least + 1):
        if not left.any():
            break
        middle = least - start  # the middle's place in the stretch
        forms = [inside(start, least), *([inside(start, least + 1), inside(start - 1, least + 1)] if moved else [])]
        row = np.concatenate(forms)
        if len(row) < 2:
            continue
        form = np.repeat(np.arange(len(forms)), [len(f) for f in forms])
        if moved:
            by = np.argsort(row, kind="stable")
            row, form = row[by], form[by]
        own = mixed_key[row]
        first_part, last_part = head_shift[form] * n + row, tail_shift[form] * n + row

        def outside(i: np.ndarray, a: int, b: int) -> np.ndarray:
            """Hashes of a stretch without its places from a to b, alike for all forms."""
            head = flat[(start + a) * n + first_part[i]] - flat[start * n + first_part[i]]  # noqa: B023
            tail = flat[(start + least) * n + last_part[i]] - flat[(start + b) * n + last_part[i]]  # noqa: B023
            return head * head_power[form[i]] + tail * tail_power[form[i]] if moved else head + tail  # noqa: B023

        for gap in range(pieces - 1):
            a, b = cuts[gap], cuts[gap + 2]
            # the gap's places; both ends of the stretch agree
            places = range(max(1, a), min(least - 1, b) - hole + 1)
            if not len(places):
                continue
            use = np.arange(len(row))
            if moved:
                use = np.flatnonzero((form == 0) | ((form == 1) & (places[-1] > middle)) | ((form == 2) & (places[0] + hole <= middle)))
            order, lo, hi = groups(mix(outside(use, a, b) + np.uint64(gap)) + own[use])
            some = asked(row[use[order]], lo, hi)
            if moved:
                # rows as they stand have met already: a group needs a moved one besides
                stand = np.concatenate([[0], np.cumsum(form[use[order]] == 0)])
                some &= (stand[hi] > stand[lo]) & (stand[hi] - stand[lo] < hi - lo)
            if not some.any():
                continue
            few = use[np.sort(order[some])]
            for g in places:
                x = few
                if moved:
                    x = few[(form[few] == 0) | ((form[few] == 1) & (g > middle)) | ((form[few] == 2) & (g + hole <= middle))]
                if len(x) < 2:
                    continue
                sub, first, _ = groups(mix(outside(x, g, g + hole)) + own[x])
                here = row[x[sub]]
                y = here[first]
                good = left[here] & (doc[y] < doc[here])
                out[here[good]] = y[good]
                left[here[good]] = False
    return out


def _partners(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """(doc_id, source_id): each open holder with an earlier holder of its key whose neighbourhood agrees; at most one a block.

    Keys with many holders are compared block by block.
    """

    def pairs(t: pa.Table):
        key, doc, i, j = (t.column(n).to_numpy() for n in ("key", "doc_id", "i", "j"))
        near = np.frombuffer(b"".join(t.column("near").to_pylist()), np.uint8).reshape(len(doc), 2 * least + 1)
        block = mix(key.view(np.uint64) + i.astype(np.uint64) * np.uint64(0x10001) + j.astype(np.uint64)).view(np.int64)
        to = partners(block, doc, t.column("open").to_numpy(), near, least, percent)
        x = np.flatnonzero(to >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(doc[x]), pa.array(doc[to[x]])], names=["doc_id", "source_id"])

    def run(batches):
        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(n).to_numpy() for n in ("key", "i", "j")]
            # up to where the last key of the batch begins, all keys are whole
            last = np.flatnonzero((keys[0] != keys[0][-1]) | (keys[1] != keys[1][-1]) | (keys[2] != keys[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            before = tuple(held[-1].column(n)[-1].as_py() for n in ("key", "i", "j")) if held else None
            if before is not None and (cut or before != tuple(int(k[0]) for k in keys)):
                yield from pairs(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif cut:
                yield from pairs(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "doc_id", "open", "near")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "doc_id long, source_id long").distinct()


def _spans(found: DataFrame, words: int) -> DataFrame:
    """(doc_id, spans): the tokens of the passages found."""
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("begin", (F.col("begin") + F.col("n_words") - (words - 1)).alias("stop"))).alias("spans"))


_FOUND = "doc_id long, begin long, n_words long, source_id long, source_begin long, source_words long, similarity double"


def _uppermost(found: DataFrame) -> DataFrame:
    """Without the passages that lie in one of a smaller source: of m holders a document names one."""

    def run(batches):
        for b in batches:
            out = []
            for doc, rows in zip(b.column("doc_id").to_pylist(), b.column("m").to_pylist()):
                kept: list[dict] = []
                for x in sorted(rows, key=lambda x: (x["source_id"], x["begin"], -x["n_words"])):
                    if not any(k["source_id"] < x["source_id"] and k["begin"] <= x["begin"] and x["begin"] + x["n_words"] <= k["begin"] + k["n_words"] for k in kept):
                        kept.append(x)
                out += [{"doc_id": doc, **x} for x in kept]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    names = ["begin", "n_words", "source_id", "source_begin", "source_words", "similarity"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names[:-1]), ("similarity", pa.float64())])
    return found.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("m")).mapInArrow(run, _FOUND)


def _places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each token of a its place in b, or -1; of several places one that continues a neighbour's."""
    order = np.argsort(b, kind="stable")
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    where = np.where(b[order][at] == a, order[at], -1)
    for step in (1, -1):
        # only where a place doesn't continue its neighbour's is there anything to mend
        odd = np.flatnonzero((where[1:] >= 0) & (where[:-1] >= 0) & (np.diff(where) != 1))
        for i in (odd + 1 if step == 1 else odd[::-1]).tolist():
            while 0 <= i < len(a) and 0 <= i - step < len(a) and where[i] >= 0 and where[i - step] >= 0:
                to = where[i - step] + step
                if where[i] == to or not 0 <= to < len(b) or b[to] != a[i]:
                    break
                where[i] = to
                i += step
    return where


def aligned(a: np.ndarray, b: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Passages (begin, end, begin in b, end in b, similarity) of a near-repeated in b, in tokens.

    Runs that continue in both are joined while ``percent`` of the joined
    stretch is shared. A stretch of ``least`` tokens counts if its token set
    and that of the matching stretch of b reach the similarity; else it is
    parted at its widest gap and both parts are tried.
    """
    where = _places(a, b)
    cut = np.ones(len(a) + 1, bool)
    cut[1:-1] = (np.diff(where) != 1) | (where[1:] < 0) | (where[:-1] < 0)
    edge = np.flatnonzero(cut)
    runs = [(s, e) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()) if where[s] >= 0]
    groups: list[list[tuple[int, int]]] = []
    shared = 0
    for s, e in runs:
        if groups:
            first, last = groups[-1][0], groups[-1][-1]
            step = int(where[s]) - int(where[last[1] - 1])
            if 0 < step <= s - last[1] + least and 100 * (shared + e - s) >= percent * (e - first[0]):
                groups[-1].append((s, e))
                shared += e - s
                continue
        groups.append([(s, e)])
        shared = e - s
    out = []
    while groups:
        g = groups.pop()
        s, e = g[0][0], g[-1][1]
        if e - s < least:
            continue
        lo, hi = int(where[s]), int(where[e - 1]) + 1
        x, y = np.unique(a[s:e]), np.unique(b[lo:hi])
        same = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * same >= percent * (len(x) + len(y) - same):
            out.append((s, e, lo, hi, same / (len(x) + len(y) - same)))
        elif len(g) > 1:
            at = max(range(1, len(g)), key=lambda i: (g[i][0] - g[i - 1][1]) + int(where[g[i][0]]) - int(where[g[i - 1][1] - 1]))
            groups += [g[:at], g[at:]]
    return sorted(out)


def repeated_passages(docs: DataFrame, words: int = 5, passage: int = 50, percent: int = 80, hashes: int = 4, need: int = 2) -> DataFrame:
    """Passages of ``docs(doc_id, text)`` that near-repeat one of an earlier document.

    One row for each passage and source: doc_id, begin, n_words (the passage
    in words of the document), source_id, source_begin, source_words, similarity. The source of a
    group of passages with one signature is its smallest doc_id, so that a
    passage which m documents share gives m - 1 rows and not all pairs; the
    source's own row is the one it is named in. A passage has ``passage`` words
    at least, and the sets of its and the source's runs of ``words`` words have
    a similarity of ``percent`` / 100 at least.

    Defined cases: null, empty and shorter texts have no passages; rows with a
    null doc_id take no part; rows that share a doc_id are texts of one
    document and aren't compared with each other; equal texts give whole-text
    passages; of equally good sources the smaller doc_id is named; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    Words are those of ``near_duplicates``. Texts are read whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    least = passage - words + 1
    small = lambda df: F.broadcast(df) if df.count() <= SMALL else df
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    # Equal texts: two 64-bit hashes stand for a text.
    hashed = rows.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("again"), "text").alias("h2"))
    several = scratch.table(hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("hi")).where("first_id < hi").select("h1", "h2", "first_id"))
    copies = scratch.table(hashed.join(small(several), ["h1", "h2"]).where("doc_id <> first_id").select("h1", "h2", "doc_id", "first_id").distinct())
    alone = hashed.join(small(copies.select("h1", "h2", "doc_id")), ["h1", "h2", "doc_id"], "left_anti").select("doc_id", "text")
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = hashed.join(small(several), ["h1", "h2"]).where("doc_id = first_id").dropDuplicates(["h1", "h2"]).select("h1", "h2", size.alias("n_words")).where(F.col("n_words") >= passage)
    zero = F.lit(0).cast("long")
    whole = copies.join(small(scratch.table(sized)), ["h1", "h2"]).select("doc_id", zero.alias("begin"), "n_words", F.col("first_id").alias("source_id"), zero.alias("source_begin"), F.col("n_words").alias("source_words"), F.lit(1.0).alias("similarity")).distinct()

    held_by = _postings(alone, words, least, hashes, False).groupBy("key").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("hi"))
    first = scratch.table(held_by.where("source_id < hi").select("key", "source_id"))
    shared = scratch.table(_postings(alone, words, least, hashes, True).join(small(first), "key"))
    scratch.drop(first)

    def ship(keyed: DataFrame, on: str) -> DataFrame:
        names = keyed.columns

        def run(batches):
            for part in batches:
                for b in text_slices(part, "text"):
                    # 32 bits of a token will do where runs of many must agree
                    seqs = [t.astype(np.uint32).tobytes() for t in _tokens(b.column("text"), words)]
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seqs, pa.binary())], names=[*names, f"t_{on}"])

        return rows.withColumnRenamed("doc_id", on).join(small(keyed), on).select(*names, "text").mapInArrow(run, ", ".join(f"{c} long" for c in names) + f", t_{on} binary")

    def confirm(batches):
        names = ["doc_id", "begin", "n_words", "source_id", "source_begin", "source_words", "similarity"]
        for b in batches:
            out = []
            for d, s, x, y in zip(b.column("doc_id").to_pylist(), b.column("source_id").to_pylist(), b.column("t_doc_id"), b.column("t_source_id")):
                p, q = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                if len(p) and len(q):
                    out += [(d, i, j - i + words - 1, s, u, v - u + words - 1, sim) for i, j, u, v, sim in aligned(p, q, least, percent)]
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.float64())], names=names)

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, right = ship(pairs, "doc_id"), ship(pairs.select("source_id").distinct(), "source_id")
        both = left.join(right, "source_id").select("doc_id", "source_id", "t_doc_id", "t_source_id")
        return scratch.table(both.mapInArrow(confirm, _FOUND).distinct())

    met = scratch.table(_collide(shared.where("doc_id <> source_id"), need))
    found = confirmed(met)

    # The tokens that no passage covers meet the other holders of their min-hash.
    spans = _spans(found, words)
    covered = F.expr("exists(coalesce(spans, array()), s -> s.begin <= c and c < s.stop)")
    state = shared.join(F.broadcast(spans) if found.count() <= SMALL else spans, "doc_id", "left").select("key", "doc_id", "source_id", "fn", "c", (~covered).alias("open"))
    # a key's smallest holder has no earlier one, so its own state doesn't matter; two holders have met already
    holders = state.groupBy("key").agg(F.max(F.col("open") & (F.col("doc_id") != F.col("source_id"))).alias("any"), F.count("*").alias("g"))
    keys = scratch.table(holders.where("any and g > 2").select("key", F.ceil(F.col("g") / BLOCK).alias("parts")))
    if not keys.isEmpty():
        asked = scratch.table(state.join(small(keys), "key").select("doc_id", F.struct("key", F.col("fn").cast("int").alias("fn"), "c", "parts", "open").alias("a")))
        by_doc = asked.groupBy("doc_id").agg(F.collect_list("a").alias("asked"))
        # all lists together are as long as the table
        near = _neighbourhoods(alone.join(F.broadcast(by_doc) if asked.count() <= SMALL else by_doc, "doc_id").select("doc_id", "text", "asked"), words, least, hashes)
        more = scratch.table(_partners(near, least, percent).join(met, ["doc_id", "source_id"], "left_anti"))
        if not more.isEmpty():
            found = scratch.table(found.unionByName(confirmed(more)))
    scratch.drop(shared)
    return whole.unionByName(_uppermost(found))
