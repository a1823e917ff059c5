"""Toxicity by a weighted finite-state pattern grammar.

A text is read clause by clause. A lexical transducer turns words into symbols
(insult, threat, target, negation, reporting verb, other); a negation, a
reported-speech, a threat and a target transducer are composed with it, each
rewriting symbols or adding weight; the weight of a clause's path is its score.
Only matched clauses count, so a negated or quoted insult weighs less than one
that is aimed at somebody.

The insult lexicon and its weights (log-odds) are learned: word forms and word
beginnings that explain labelled documents are picked one by one, each for the
documents that the earlier ones leave unexplained.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .shingles import text_slices

#: Words of the grammar's classes.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown fool fools imbecile pig pigs vermin filth bastard jerk".split()
THREATS = "kill hurt destroy beat shoot stab burn punish attack strangle crush".split()
TARGETS = "you your you're youre u he she they him her them his their we everyone people all these those that this".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't neither nor without hardly".split()
REPORTS = "said says say called calls claimed claims wrote writes reported alleged quoted accused according heard".split()
#: The same classes in Spanish, French and German; insults of those languages are learned.
THREATS += "matar golpear destruir apuñalar quemar tuer frapper détruire poignarder brûler töten schlagen zerstören erschießen verbrennen".split()
TARGETS += "tú ti usted ustedes vosotros ellos ellas toi vous ils elles dich euch ihnen".split()
NEGATIONS += "nunca jamás tampoco sin pas jamais ni nicht kein keine keinen nie niemals ohne".split()
REPORTS += "dijo dice dicen llamó escribió afirmó acusó según dit disait disent appelle écrit affirme accusé selon sagte sagt sagen nannte schrieb behauptet angeblich laut".split()
#: Weight of a listed insult without evidence, and of a threat aimed at a target.
PRIOR, THREAT = 4.0, 4.5
#: Labelled rows that the lexicon is learned from, at most about: of label 1 and of label 0.
SAMPLE = (2_000, 4_000)
#: Hashes of a text by which its near copies are known.
SKETCH = 48
#: Lengths of the word beginnings that are learned.
BEGINNINGS = (4, 5, 6)
#: What a clause's weight is taken down by before it becomes a score.
BIAS = 2.0

OTHER, INSULT, DENIED, QUOTED, THREATEN, TARGET, NEGATE, REPORT = range(8)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_CUT = re.compile(r"[.!?;\n]")


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (state, symbol, weight); a missing arc copies the symbol and stays or goes to ``rest``."""

    arcs: dict[tuple[int, int], tuple[int, int, float]]
    rest: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol, 0.0)


def compose(parts: list[Transducer]) -> dict:
    """The product machine as a table: (states, symbol) -> (states, symbol, weight)."""
    start = (0,) * len(parts)
    table, todo = {}, [start]
    while todo:
        states = todo.pop()
        if (states, OTHER) in table:
            continue
        for symbol in range(8):
            out, weight, nxt = symbol, 0.0, []
            for part, s in zip(parts, states):
                s, out, w = part.step(s, out)
                weight += w
                nxt.append(s)
            table[states, symbol] = (tuple(nxt), out, weight)
            todo.append(tuple(nxt))
    return table


def grammar() -> dict:
    """Reported speech, negation, threats and targets, composed in that order."""
    # a reporting verb quotes the insults and threats of its clause that follow
    reported = Transducer({(0, REPORT): (1, REPORT, 0.0), (1, INSULT): (1, QUOTED, 0.0), (1, THREATEN): (1, OTHER, 0.0)})
    # a negation reaches over three symbols
    negation = Transducer({(s, NEGATE): (3, NEGATE, 0.0) for s in range(4)} | {(s, INSULT): (s - 1, DENIED, 0.0) for s in (1, 2, 3)} | {(s, THREATEN): (s - 1, OTHER, 0.0) for s in (1, 2, 3)}, {3: 2, 2: 1, 1: 0})
    # a threat counts when a target follows within two symbols
    threat = Transducer({(s, THREATEN): (2, THREATEN, 0.0) for s in range(3)} | {(s, TARGET): (0, TARGET, THREAT) for s in (1, 2)}, {2: 1, 1: 0})
    # an insult within four symbols after a target weighs more
    target = Transducer({(s, TARGET): (4, TARGET, 0.0) for s in range(5)} | {(s, INSULT): (s - 1, INSULT, 0.5) for s in (1, 2, 3, 4)}, {4: 3, 3: 2, 2: 1, 1: 0})
    return compose([reported, negation, threat, target])


#: Share of an insult's weight that a clause keeps by what the grammar makes of it.
KEEP = {INSULT: 1.0, QUOTED: 0.5, DENIED: 0.25}


class Scorer:
    def __init__(self, words: dict[str, float], beginnings: dict[str, float]) -> None:
        import ahocorasick

        self.words, self.begin = words, beginnings
        self.lengths = sorted({len(b) for b in beginnings}, reverse=True)
        self.fixed = {w: s for s, ws in ((REPORT, REPORTS), (NEGATE, NEGATIONS), (TARGET, TARGETS), (THREATEN, THREATS)) for w in ws}
        self.table = grammar()
        self.start = next(iter(self.table))[0]
        self.find = ahocorasick.Automaton()
        for w in [*words, *beginnings, *THREATS]:
            self.find.add_word(w, len(w))
        self.find.make_automaton()

    def insult(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in self.lengths:
            if len(word) > n and (w := self.begin.get(word[:n], 0.0)) > found:
                found = w
        return found

    def clause(self, text: str) -> float:
        """Weight of the clause's path: its heaviest insult and a part of the others, threats and targets."""
        states, best, more = self.start, 0.0, 0.0
        for word in _WORD.findall(text):
            weight = self.insult(word)
            symbol = INSULT if weight > 0 else self.fixed.get(word, OTHER)
            states, out, extra = self.table[states, symbol]
            got = weight * KEEP.get(out, 0.0) + extra
            if got > best:
                best, more = got, more + best
            else:
                more += got
        return best + 0.1 * min(more, 10.0)

    def score(self, text: str) -> float:
        low = text.lower()
        top, hits, seen, cuts = 0.0, 0, -1, None
        for end, _ in self.find.iter(low):
            if end <= seen:
                continue
            if cuts is None:
                cuts = [m.start() for m in _CUT.finditer(low)]
            at = bisect.bisect_left(cuts, end)
            a, seen = cuts[at - 1] + 1 if at else 0, cuts[at] if at < len(cuts) else len(low)
            w = self.clause(low[a:seen])
            hits += w > BIAS
            top = max(top, w)
        return 1 / (1 + math.exp(BIAS - top - 0.3 * math.log1p(max(0, hits - 1))))


def _features(text: str) -> set[str]:
    """Words and beginnings of longer words."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


def _sketch(text: str) -> list[int]:
    """The smallest hashes of a text's runs of five words: about as many of them agree as the texts' runs do."""
    words = text.lower().split()
    runs = {zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))}
    return sorted(runs)[:SKETCH]


def text_classes(sketches: dict[int, list[int]]) -> dict[int, int]:
    """Each document's class: copies and near copies of one text, linked where half of a sketch agrees, are one."""
    up = {d: d for d in sketches}

    def top(d: int) -> int:
        while up[d] != d:
            up[d] = up[up[d]]
            d = up[d]
        return d

    first: dict[int, list[int]] = {}
    for d in sorted(sketches):
        mine, met = sketches[d], {}
        for h in mine:
            for e in first.get(h, ()):
                met[e] = met.get(e, 0) + 1
        near = [e for e, n in met.items() if 2 * n >= min(len(mine), len(sketches[e]))]
        for e in near:
            up[max(top(d), top(e))] = min(top(d), top(e))
        if not near:  # one of a class stands for it
            for h in mine:
                first.setdefault(h, []).append(d)
    return {d: top(d) for d in sketches}


def held_out(doc_id) -> F.Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings with their weights, from labelled rows that are not held out.

    The sample is bounded by ``sample`` (rows of label 1 and 0, chosen by a hash
    of doc_id). A document that is labelled both ways is left out.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("y")).where("lo = y").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"))
    size = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.lit(0.0)
    for y, most in ((1, sample[0]), (0, sample[1])):
        share = F.when(F.col("y") == y, F.lit(min(1.0, most / max(1, size.get(y, 1))))).otherwise(share)
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)

    def run(batches):
        for whole in batches:
            for b in text_slices(whole, "text", 1 << 20):
                per = [sorted(_features(t or "")) for t in b.column("text").to_pylist()]
                rep = pa.array(np.repeat(np.arange(len(per)), [len(p) for p in per]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rep), b.column("y").take(rep), pa.array([f for p in per for f in p], pa.string())], names=["doc_id", "y", "f"])

    def sketch(batches):
        for whole in batches:
            for b in text_slices(whole, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_sketch(t or "") for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = scratch.table(texts.join(F.broadcast(some), "doc_id").select("doc_id", "y", "text"))
    rows = scratch.table(chosen.mapInArrow(run, "doc_id long, y int, f string"))
    n_pos, n_neg = (rows.where(f"y = {y}").select("doc_id").distinct().count() for y in (1, 0))
    words: dict[str, float] = {w: PRIOR for w in INSULTS}
    if not n_pos or not n_neg:
        return words, {}
    # at most SKETCH numbers for each document of label 1 in the bounded sample
    sketches: dict[int, list[int]] = {}
    for r in chosen.where("y = 1").select("doc_id", "text").mapInArrow(sketch, "doc_id long, s array<long>").collect():
        sketches[r["doc_id"]] = sorted({*sketches.get(r["doc_id"], []), *r["s"]})[:SKETCH]
    classes = docs.sparkSession.createDataFrame(list(text_classes(sketches).items()), "doc_id long, c long")
    stats = rows.join(F.broadcast(classes), "doc_id", "left").groupBy("f").agg(F.countDistinct(F.when(F.col("y") == 1, F.col("doc_id"))).alias("p"), F.countDistinct(F.when(F.col("y") == 0, F.col("doc_id"))).alias("n"), F.countDistinct(F.when(F.col("y") == 1, F.col("c"))).alias("texts"))
    odds = F.log((F.col("p") + 0.5) / (n_pos + 1)) - F.log((F.col("n") + 0.5) / (n_neg + 1))
    least = max(3, math.ceil(0.005 * n_pos))
    listed = F.col("f").isin(INSULTS)
    # copies of a document are one text, insults turn up in many
    # at most n_pos * features of a document / least rows, from the bounded sample
    good = scratch.table(stats.withColumn("w", odds).where(((F.col("p") >= least) & (F.col("texts") >= least) & (F.col("w") >= 2.5) & (F.col("p") >= 10 * F.col("n"))) | listed))
    weight = {r["f"]: (r["w"], r["p"], r["n"]) for r in good.collect()}
    for w in INSULTS:  # evidence against a listed word
        if w in weight and weight[w][2] >= 3 and weight[w][0] < 2.5:
            words[w] = max(0.0, weight[w][0])
    cover: dict[str, set[int]] = {}
    for r in rows.where("y = 1").join(F.broadcast(good.select("f")), "f").select("f", "doc_id").distinct().collect():
        cover.setdefault(r["f"], set()).add(r["doc_id"])
    begin: dict[str, float] = {}
    left = set().union(*cover.values()) if cover else set()
    while cover:
        # most documents explained; at a tie whole words, then longer beginnings
        f = max(cover, key=lambda f: (len(cover[f] & left), weight[f][0], not f.endswith("*"), len(f), f))
        gain = len(cover[f] & left)
        if gain < least:
            break
        if f.endswith("*"):
            begin[f[:-1]] = min(8.0, max(PRIOR, weight[f][0]))
        elif weight[f][0] >= 2.5:
            words[f] = min(8.0, max(PRIOR, weight[f][0]))
        left -= cover.pop(f)
    for f in cover:  # strong on its own, whatever else those documents have
        if not f.endswith("*") and weight[f][0] >= 4 and len(cover[f]) >= max(5, 0.04 * n_pos):
            words[f] = min(8.0, weight[f][0])
    return {w: v for w, v in words.items() if v > 0}, begin


def score(docs: DataFrame, words: dict[str, float], beginnings: dict[str, float], threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (double, 0 to 1) and predicted (int), from the text alone; own columns of those names are replaced."""
    made = {"score", "predicted"}
    keep = [f for f in docs.schema if f.name not in made]
    names = [f.name for f in keep]

    def run(batches):
        s = Scorer(words, beginnings)
        for whole in batches:
            for b in text_slices(whole, "text", 4 << 20):
                got = np.array([s.score(t or "") for t in b.column("text").to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*names).mapInArrow(run, schema)


def toxic_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, held_out, score and predicted.

    Labels are learned from rows with crc32(doc_id as text) mod 3 <> 1; the
    others are held out. Only the text enters a score.

    Defined cases: a null or empty text has the score of a text without a
    match; a null doc_id is not held out and scored like others; repeated rows
    are scored each; without labels of both kinds the listed insults stand
    alone; an empty table gives an empty result; other columns are ignored.
    Texts are read whole.
    """
    words, begin = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score(rows, words, begin, threshold)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
