"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a run of characters that keys are made of and prose isn't. The network, in numpy, reads it with
what stands before and after it: one convolution over characters, the largest and mean
responses by part, a hidden layer, a logit. It is trained on every labelled finding of every text, calibrated on
the findings of texts that it wasn't trained on, and its thresholds are the highest ones that still find ``RECALL`` of those.

Findings are dealt into shards by a hash. Each pass over them trains one copy of the network on each shard and takes the
mean of the copies; the driver sees weights and counts, never findings.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .shingles import text_slices

#: Kinds in the order of equal starts; the last one is the network's.
KINDS = ("assign", "access", "hex", "network")
_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of hexadecimal digits is taken whole, so one of 16 and more is found without the shorter ones.
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
#: A digit, or capitals after small letters, within letters.
_MIXED = re.compile(r"[0-9]|[a-z][A-Z].*[a-z][A-Z]", re.S)
_LETTER = re.compile(r"[A-Za-z]")
_AFTER_SIGN = re.compile(r"[:=]\s*[\"'`]?\Z")

#: Characters before a candidate, of it (longer ones are read in several pieces) and after it.
BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH, FILTERS, HIDDEN = 5, 16, 16
#: Findings of one shard, about.
SHARD = 16_384
#: Passes over a single shard, and over all shards after two on the first one.
PASSES, ROUNDS = 5, 2
#: Share of the rarer label in what a pass reads: rarer findings are read more than once.
RARE = 8
#: Findings of each label in a shard that is trained on, about, at least: where there are fewer, several shards read the same ones.
EACH = 32
#: Share of the calibration findings of label 1 that each threshold must find.
RECALL = 0.95
#: Fewer findings of label 1 than these set no threshold of their own.
LEAST = 20
_VOCAB = 99


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in order."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str, every: bool = False) -> list[tuple[int, int]]:
    """(start, end) of the runs that a secret may be; ``every``: also those that look like words."""
    out = []
    for m in _RUN.finditer(text):
        s = m.group()
        a, b = m.start() + len(s) - len(s.lstrip(".-/=")), m.end() - len(s) + len(s.rstrip(".-/"))
        if b - a >= 12 and (every or _MIXED.search(s)):
            out.append((a, b))
    return out


def _codes() -> np.ndarray:
    small = np.full(128, 98, np.uint8)
    small[32:127] = np.arange(1, 96)
    small[[9, 10, 13]] = 96
    return small


_SMALL = _codes()


def encoded(pieces: list[str]) -> np.ndarray:
    """Windows of equal length as character classes: 0 padding, ASCII one by one, line ends, other letters, the rest."""
    raw = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(pieces), BEFORE + INSIDE + AFTER)
    out = _SMALL[np.minimum(raw, 127)]
    out[raw >= 128] = 97
    out[raw == 0] = 0
    return out


def window(text: str, start: int, end: int) -> list[str]:
    """The candidate's windows: one for each ``INSIDE`` characters of it."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    after = text[end : end + AFTER].ljust(AFTER, "\0")
    return [before + text[a : min(end, a + INSIDE)].ljust(INSIDE, "\0") + after for a in range(start, end, INSIDE)]


#: The parts whose responses are pooled: before, inside, after.
_PARTS = ((0, BEFORE - 2), (BEFORE - 2, BEFORE + INSIDE - 2), (BEFORE + INSIDE - 2, BEFORE + INSIDE + AFTER - WIDTH + 1))

_WEIGHTS = ("conv", "shift", "w1", "b1", "w2", "b2")


@dataclass
class Network:
    """Weights, calibration (a, b) and a threshold for assigned and for bare candidates."""

    conv: np.ndarray
    shift: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, float] = (0.5, 0.5)
    report: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        n = (len(_PARTS) + 1) * FILTERS
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0] if len(s) < 3 else 25), s).astype(np.float32)
        return cls(draw(WIDTH, _VOCAB, FILTERS), np.zeros(FILTERS, np.float32), draw(n, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, 1), np.zeros(1, np.float32))

    def vector(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([getattr(self, n).ravel() for n in _WEIGHTS])

    def moved(self, vector: np.ndarray) -> Network:
        """A network of the same shapes with these weights."""
        out, at = {}, 0
        for n in _WEIGHTS:
            w = getattr(self, n)
            out[n], at = np.array(vector[at : at + w.size], np.float32).reshape(w.shape), at + w.size
        return replace(self, **out)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        n, at = x.shape[1] - WIDTH + 1, x.astype(np.intp)
        out = np.take(self.conv[0], at[:, :n], axis=0)
        out += self.shift
        more = np.empty_like(out)
        for k in range(1, WIDTH):
            out += np.take(self.conv[k], at[:, k : k + n], axis=0, out=more, mode="clip")
        np.maximum(out, 0, out=out)
        a, b = _PARTS[1]
        pooled = np.hstack([*(out[:, i:j].max(1) for i, j in _PARTS), out[:, a:b].mean(1)])
        hidden = np.maximum(pooled @ self.w1 + self.b1, 0)
        return (hidden @ self.w2 + self.b2)[:, 0], (out, pooled, hidden)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 128])[0] for i in range(0, len(x), 128)] or [np.zeros(0, np.float32)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return self.chance(self.logits(x))

    def chance(self, z: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * z.astype(np.float64) + b, -60, 60)))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        z, (out, pooled, hidden) = self.forward(x)
        dz = ((1 / (1 + np.exp(-z)) - y) * weight / len(y)).astype(np.float32)[:, None]
        dh = (dz @ self.w2.T) * (hidden > 0)
        dp = dh @ self.w1.T
        # places before and behind, so that the answers of all filters over a character are one run
        n, edge = out.shape[1], WIDTH - 1
        room = np.zeros((len(x), n + 2 * edge, FILTERS), dp.dtype)
        d = room[:, edge : edge + n]
        a, b = _PARTS[1]
        d[:, a:b] = dp[:, None, len(_PARTS) * FILTERS :] / (b - a)
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
        for i, (a, b) in enumerate(_PARTS):
            top = (out[:, a:b] == pooled[:, None, i * FILTERS : (i + 1) * FILTERS]).argmax(1) + a
            d[rows, top, cols] += dp[:, i * FILTERS : (i + 1) * FILTERS]
        d *= out > 0
        runs = np.lib.stride_tricks.as_strided(room, (room.size // FILTERS - edge, WIDTH * FILTERS), (FILTERS * room.itemsize, room.itemsize))
        order = np.argsort(x, axis=None, kind="stable")[np.count_nonzero(x == 0) :]  # padding says nothing
        code = x.ravel()[order]
        starts = np.flatnonzero(np.diff(code, prepend=np.uint8(0)))
        row, place = np.divmod(order, x.shape[1])
        conv = np.zeros((_VOCAB, WIDTH, FILTERS), dp.dtype)
        conv[code[starts]] = np.add.reduceat(runs[row * room.shape[1] + place], starts).reshape(-1, WIDTH, FILTERS)[:, ::-1]
        conv = conv.transpose(1, 0, 2)
        return [conv, d.sum((0, 1)), pooled.T @ dh, dh.sum(0), hidden.T @ dz, dz.sum(0)]


def fit(net: Network, x: np.ndarray, y: np.ndarray, rounds: int, rate: float = 0.004, batch: int = 128, seed: int = 5) -> Network:
    """Adam on the weighted log loss over every finding, both labels weighing the same; the rate falls to a tenth."""
    net = net.moved(net.vector())
    net.conv[:, 0] = 0
    rng = np.random.default_rng(seed)
    up, down = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rare, common = sorted((up, down), key=len)
    again = np.resize(rare, max(len(rare), len(common) // (RARE - 1))) if len(rare) else rare
    share = len(again if rare is up else common) / (len(again) + len(common))
    weight = np.where(y == 1, 0.5 / max(1e-9, share), 0.5 / max(1e-9, 1 - share))
    m, v, t, steps = [0.0] * 6, [0.0] * 6, 0, rounds * -(-(len(again) + len(common)) // batch)
    for _ in range(rounds):
        order = rng.permutation(np.concatenate([again, common]))
        for i in range(0, len(order), batch):
            at, t = order[i : i + batch], t + 1
            step = rate * min(1.0, t / 20) * (1 - 0.9 * t / steps)
            for j, g in enumerate(net.gradients(x[at], y[at], weight[at])):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.99 * v[j] + 0.01 * g * g
                w = getattr(net, _WEIGHTS[j])
                w -= (step * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


#: Weights are added up as whole numbers of this size, so their order doesn't matter.
_UNIT = 1 << 32


def _bytes(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.uint8)


def fitted(shards: DataFrame, n: int) -> Network:
    """The network after every pass; ``shards(shard, x, y)`` hold all findings, a row each shard."""
    net = Network.fresh(5)

    def trained(of: DataFrame, rounds: int, rate: float) -> Network:
        def run(batches):
            for b in batches:
                for shard, x, y in zip(*(b.column(c) for c in ("shard", "x", "y"))):
                    got = fit(net, _bytes(x).reshape(-1, BEFORE + INSIDE + AFTER), _bytes(y), rounds, rate, seed=shard.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array([np.rint(got.vector().astype(np.float64) * _UNIT).astype(np.int64)], pa.list_(pa.int64()))], names=["w"])

        one = of.select("shard", "x", "y").mapInArrow(run, "w array<long>").select(F.posexplode("w").alias("at", "w"))
        # as many rows as weights
        mean = one.groupBy("at").agg(F.sum("w").alias("w"), F.count("w").alias("n")).orderBy("at").collect()
        return net.moved(np.array([r["w"] / r["n"] / _UNIT for r in mean]))

    if n == 1:
        return trained(shards, PASSES, 0.004)
    # copies that start from nothing would differ too much for a mean
    net = trained(shards.where("shard = 0"), 2, 0.004)
    for i in range(ROUNDS):
        net = trained(shards, 1, 0.003 / (1 + i))
    return net


def _kth(scores: DataFrame, k: int) -> float:
    """The value ``z`` that has ``k`` smaller rows, by counts of the upper and then of the lower half of its bits."""
    low, value = 0, F.col("o")
    for shift in (16, 0):
        counts = sorted((r["p"], r["count"]) for r in scores.where(F.shiftright(value, 16) == low if shift == 0 else F.lit(True)).groupBy(F.shiftright(value, shift).alias("p")).count().collect())
        for p, n in counts:
            if k < n:
                low = p
                break
            k -= n
    return float(_floats(np.array([low]))[0])


def _ordered(z: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the single-precision values."""
    i = np.asarray(z, np.float32).view(np.int32).astype(np.int64)
    return np.where(i < 0, -(i & 0x7FFFFFFF), i)


def _floats(o: np.ndarray) -> np.ndarray:
    return np.where(o < 0, -o | -0x80000000, o).astype(np.int32).view(np.float32)


def calibrated(net: Network, shards: DataFrame, recall: float = RECALL) -> Network:
    """Scales the logits of all findings in ``shards(x, y, assigned)`` to probabilities (Newton steps on the smoothed log loss),
    then sets the thresholds."""
    scratch = Scratch(shards.sparkSession, "secret-scores")

    def run(batches):
        for b in batches:
            for x, y, assigned in zip(*(b.column(c) for c in ("x", "y", "assigned"))):
                z = net.logits(_bytes(x).reshape(-1, BEFORE + INSIDE + AFTER)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.float64)), pa.array(_ordered(z)), pa.array(_bytes(y) == 1), pa.array(_bytes(assigned) == 1)], names=["z", "o", "y", "assigned"])

    scores = scratch.table(shards.select("x", "y", "assigned").mapInArrow(run, "z double, o long, y boolean, assigned boolean"))
    many = {(r["y"], r["assigned"]): r["count"] for r in scores.groupBy("y", "assigned").count().collect()}
    up, down = (sum(n for (y, _), n in many.items() if y is label) for label in (True, False))
    z, a, b = F.col("z"), 1.0, 0.0
    target = F.when(F.col("y"), (up + 1) / (up + 2)).otherwise(1 / (down + 2))
    chance = lambda a, b: 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), a * z + b))))
    for _ in range(50):
        p = chance(a, b)
        g = scores.select(z, (p - target).alias("r"), F.greatest(p * (1 - p), F.lit(1e-9)).alias("s")).agg(*[F.sum(c).alias(n) for n, c in (("rz", F.col("r") * z), ("r", F.col("r")), ("szz", F.col("s") * z * z), ("sz", F.col("s") * z), ("s", F.col("s")))]).first()
        step = np.linalg.solve(np.array([[g["szz"] + 1e-6, g["sz"]], [g["sz"], g["s"] + 1e-6]]), [g["rz"], g["r"]])
        step *= min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        a, b = float(a - step[0]), float(b - step[1])
        if np.abs(step).max() < 1e-6:
            break
    net = replace(net, scale=(max(a, 1e-3), b))

    def highest(assigned: bool) -> float:
        mine, n = scores.where(F.col("y") & (F.col("assigned") == assigned)), many.get((True, assigned), 0)
        if n < LEAST:
            mine, n = scores.where("y"), up
        if not n:
            return 1.0
        # just under the finding that is one too many to lose
        k = min(n - 1, int(np.floor((1 - recall) * n)))
        return float(net.chance(np.array([_kth(mine, k)]))[0] * (1 - 1e-6))

    net.thresholds = (highest(True), highest(False))
    p = chance(*net.scale)
    hit = p >= F.when(F.col("assigned"), net.thresholds[0]).otherwise(net.thresholds[1])
    y = F.col("y").cast("int")
    r = scores.agg(F.avg(F.when(F.col("y"), hit.cast("int"))).alias("recall"), F.avg(F.when(hit, y)).alias("precision"), F.avg((p - y) * (p - y)).alias("brier")).first()
    net.report = {**r.asDict(), "findings": up + down}
    scratch.drop(scores)
    return net


_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789-_")


def _varied(rng: random.Random, rows: list[tuple[str, str, str, int]]) -> list[tuple[str, str, str, int]]:
    """More findings of the same labels: secrets in other alphabets and places, and words in the shapes of names, paths, dates and versions."""
    words = [c for _, c, _, y in rows if y == 0 and c.isalpha()] or ["documentation", "configuration"]
    around = [(b, a) for b, _, a, y in rows if y == 0] or [("", "")]
    some, below = rng.choice, lambda n: int(rng.random() * n)
    number = lambda n: str(below(10**n)).zfill(n)
    shapes = (
        lambda w, v, c: f"{w[:c]}/{v[:c]}/{w[c:]}.html",
        lambda w, v, c: f"{w[:c]}{v[:c].title()}{w[c:].title()}",
        lambda w, v, c: f"{w}{number(2)}",
        lambda w, v, c: f"{w[:c]}.{v}{number(1)}.example.com",
        lambda w, v, c: f"{number(4)}-{number(2)}-{number(2)}T{number(2)}",
        lambda w, v, c: f"{number(2)}.{number(3)}.{number(8)}",
        lambda w, v, c: f"{w}_{v[:c]}_{number(3)}",
        lambda w, v, c: f"{w[:c]}-{v[:c]}-{number(1)}.{number(2)}.{number(1)}",
        lambda w, v, c: f"{number(3)}-{number(4)}-{number(6)}",
    )
    out = []
    for before, _, after, y in rows:
        if y == 1:
            for least, (b, a) in ((20, (before, after)), (24, some(around))):
                out.append((b, "".join(rng.choices(some(_ALPHABETS), k=least + below(65 - least))), a, 1))
        else:
            w, v = words[below(len(words))], words[below(len(words))]
            out.append((before, shapes[below(len(shapes))](w, v, 3 + below(6)), after, 0))
    return [(b, c if len(c) >= 12 else c.ljust(12, "0"), a, y) for b, c, a, y in out]


_FINDING = "h long, calibration boolean, before string, value string, after string, y int"


def _weak(text: str) -> Iterator[tuple[int, int, int]]:
    """Findings that the patterns label: 1 where one lies in a pattern's match (runs of digits alone are left out), 0 elsewhere."""
    spans, at, over = base_spans(text), 0, []
    for a, b in candidates(text, every=True):
        while at < len(spans) and spans[at][0] < b:
            over.append(spans[at])
            at += 1
        over = [s for s in over if a < s[1]]
        if not over:
            yield a, b, 0
        elif any(k < 2 for _, _, k in over) or _LETTER.search(text, a, b):
            yield a, b, 1


def labelled_findings(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(h, calibration, before, value, after, y) of every finding of every different text; ``h`` is a hash of text and place.

    ``known(doc_id, start, stop, label)`` are findings in code points; without it the patterns label all documents.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    by_text, given = F.xxhash64("text", F.lit("secrets")), known is not None
    if not given:
        texts = texts.select("text", by_text.alias("h"))
    else:
        spans = known.where("start >= 0 and stop > start and label in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_set(F.struct(F.col("start").cast("int").alias("a"), F.col("stop").cast("int").alias("b"), F.col("label").cast("int").alias("y"))).alias("spans"))
        texts = texts.join(spans, "doc_id").select("text", by_text.alias("h"), "spans")

    def rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), *(pa.array(c, pa.string()) for c in cols[2:5]), pa.array(cols[5], pa.int32())], names=["h", "calibration", "before", "value", "after", "y"])

    def run(batches):
        for whole in batches:
            for b in text_slices(whole, "text", 1 << 20):
                out = []
                told = b.column("spans").to_pylist() if given else [None] * b.num_rows
                for text, h, spans in zip(b.column("text").to_pylist(), b.column("h").to_pylist(), told):
                    found = _weak(text) if spans is None else sorted((s["a"], s["b"], s["y"]) for s in spans)
                    for x, y, label in found:
                        digest = int.from_bytes(hashlib.sha256(f"{h}:{x}".encode()).digest()[:8], "big", signed=True)
                        out.append((digest, h % 4 == 0, text[max(0, x - BEFORE) : x], text[x : min(y, x + INSIDE)], text[y : y + AFTER], label))
                        if len(out) >= 20_000:
                            yield rows(out)
                            out = []
                yield rows(out)

    return texts.mapInArrow(run, _FINDING).distinct()


def sharded(rows: DataFrame, n: int, times: tuple[int, int] = (1, 1)) -> DataFrame:
    """(calibration, shard, x, y, assigned): ``labelled_findings`` and variants of them as windows, in ``n`` shards by their hash;
    those to fit on in so many shards as ``times`` says for their label."""

    def pack(table: pa.Table) -> pa.Table:
        found = sorted(zip(*(table.column(c).to_pylist() for c in ("h", "before", "value", "after", "y"))))
        calibration, shard = table.column("calibration")[0].as_py(), table.column("shard")[0].as_py()
        mine = [r[1:] for r in found]
        mine += _varied(random.Random(2 * shard + calibration), mine)
        x = encoded([b[-BEFORE:].rjust(BEFORE, "\0") + c[:INSIDE].ljust(INSIDE, "\0") + a[:AFTER].ljust(AFTER, "\0") for b, c, a, _ in mine])
        flags = (bytes(r[3] for r in mine), bytes(bool(_AFTER_SIGN.search(r[0])) for r in mine))
        return pa.table({"calibration": [calibration], "shard": pa.array([shard], pa.int32()), "x": [x.tobytes()], "y": [flags[0]], "assigned": [flags[1]]})

    more = F.when(F.col("calibration"), 0).otherwise(F.when(F.col("y") == 1, times[1] - 1).otherwise(times[0] - 1))
    dealt = rows.withColumn("more", F.explode(F.sequence(F.lit(0), more))).withColumn("shard", F.pmod(F.pmod("h", F.lit(n)) + F.col("more"), F.lit(n)).cast("int")).drop("more")
    dealt = dealt.repartition(2 * n, "calibration", "shard")
    return dealt.groupBy("calibration", "shard").applyInArrow(pack, "calibration boolean, shard int, x binary, y binary, assigned binary")


def train(docs: DataFrame, known: DataFrame | None = None, recall: float = RECALL, shard: int = SHARD) -> Network | None:
    """A calibrated network, or None without findings of both labels to fit and to calibrate on."""
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = scratch.table(labelled_findings(docs, known))
    many = {(r["calibration"], r["y"]): r["count"] for r in rows.groupBy("calibration", "y").count().collect()}
    if len(many) < 4:
        scratch.drop(rows)
        return None
    n = math.ceil((many[False, 0] + many[False, 1]) / shard)
    # a copy that saw one label alone would spoil the mean
    times = tuple(min(n, math.ceil(EACH * n / many[False, y])) for y in (0, 1))
    shards = scratch.table(sharded(rows, n, times))
    scratch.drop(rows)
    net = calibrated(fitted(shards.where("not calibration"), n), shards.where("calibration"), recall)
    scratch.drop(shards)
    return net


_SPANS = "array<struct<kind:string,start:int,stop:int,score:double>>"


def findings(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array<struct<kind, start, stop, score>> in the order of start and kind.

    Matches of the fixed patterns have no score. A candidate that meets none of them is added, as kind ``network``, where its
    calibrated score reaches the threshold of its sort (after a sign of assignment, or bare). Places are code points, stop exclusive.

    Defined cases: a null or empty text has no spans; texts are read whole, long candidates piece by piece (the largest
    score counts); repeated rows are scanned each; without a network the patterns stand alone; an empty table stays empty; an own column ``spans`` is replaced.
    """
    keep = [f for f in docs.schema if f.name != "spans"]
    names = [f.name for f in keep]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for whole in batches:
            for b in text_slices(whole, text, 4 << 20):
                found: list[list[tuple]] = []
                waiting: list[tuple[int, int, int, bool, int]] = []
                pieces: list[str] = []
                best: list[np.ndarray] = []

                def flush(pieces=pieces, best=best) -> None:
                    if pieces:
                        best.append(net.score(encoded(pieces)))
                        pieces.clear()

                for i, t in enumerate(b.column(text).to_pylist()):
                    t = t or ""
                    spans = base_spans(t)
                    found.append([(a, k, z, None) for a, z, k in spans])
                    if net is None:
                        continue
                    ends, at, last = [s[1] for s in spans], 0, -1
                    for a, z in candidates(t):
                        # spans come in the order of their starts
                        while at < len(spans) and spans[at][0] < z:
                            last, at = max(last, ends[at]), at + 1
                        if last > a:
                            continue
                        w = window(t, a, z)
                        waiting.append((i, a, z, bool(_AFTER_SIGN.search(t[max(0, a - BEFORE) : a])), len(w)))
                        pieces += w
                        if len(pieces) >= 4096:
                            flush()
                flush()
                score = np.concatenate(best or [np.zeros(0)])
                ends = np.cumsum([0, *(w[4] for w in waiting)])
                for j, (i, a, z, assigned, _) in enumerate(waiting):
                    p = float(score[ends[j] : ends[j + 1]].max())
                    if p >= net.thresholds[0 if assigned else 1]:
                        found[i].append((a, 3, z, p))
                cells = pa.array([[{"kind": KINDS[k], "start": a, "stop": z, "score": p} for a, k, z, p in sorted(f, key=lambda s: s[:2])] for f in found], kind)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), cells], names=[*names, "spans"])

    from pyspark.sql.types import StructType

    schema = StructType([*keep, *StructType.fromDDL(f"spans {_SPANS}")])
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def redacted(docs: DataFrame, net: Network | None, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span of its text replaced; overlapping spans become one mark. Defined cases as in ``findings``."""
    names = docs.columns
    out = findings(docs.withColumnRenamed("spans", "own spans") if "spans" in names else docs, net)
    cut = F.aggregate("spans", F.struct(F.lit("").alias("s"), F.lit(0).alias("at")), lambda a, x: F.when(x["stop"] <= a["at"], a).otherwise(F.struct(F.concat(a["s"], F.when(x["start"] >= a["at"], F.concat(F.substring("text", a["at"] + 1, x["start"] - a["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("s"), x["stop"].alias("at"))), lambda a: F.concat(a["s"], F.substring("text", a["at"] + 1, F.lit((1 << 31) - 1))))
    out = out.withColumn("text", F.when(F.size("spans") > 0, cut).otherwise(F.col("text"))).drop("spans")
    return out.withColumnRenamed("own spans", "spans").select(*names) if "spans" in names else out


def span_table(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of ``docs(doc_id, text)``, the network trained on them; a null
    doc_id is scanned like others. Further cases as in ``findings``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = findings(rows, train(docs, known)).select("doc_id", "spans")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return out.select("doc_id", *[n(k) for k in KINDS[:3]], F.sha2(said(F.filter("spans", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"), said("spans").alias("spans"))
