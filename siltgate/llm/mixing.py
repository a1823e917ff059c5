"""Mixing sources to target weights by iterative proportional fitting.

Native throughout: DataFrame and SQL functions only. Documents are counted
into cells (source, language, topic); the cells' token weights are raked to
each margin's target in turn; a document is kept with its cell's calibrated
probability, decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch

MARGINS = ("source", "lang", "topic")
#: Default targets: a margin's own shares to these powers.
POWERS = {"source": 0.8, "lang": 0.9, "topic": 0.95}
#: Cell tables with at most so many rows are raked in one task and broadcast (under 64 MB at 128 bytes a cell).
SMALL = 500_000


def n_tokens(text) -> F.Column:
    """Parts of a text between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def topic(text, tokens) -> F.Column:
    """The form of a text as its topic: table, snippet or prose."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(bars >= 8, "table").when(F.coalesce(tokens, F.lit(0)) < 50, "snippet").otherwise("prose")


def _target(now: DataFrame, m: str, power: float, wanted: dict | None) -> DataFrame:
    """(_m, to_<m>): the share that each value of a margin shall have; values without tokens can have none."""
    shares = now.groupBy(m).agg(F.sum("share").alias("s"))
    if wanted is None:
        raised = shares.select(F.col(m).alias("_m"), F.when(F.col("s") > 0, F.pow("s", F.lit(float(power)))).otherwise(0.0).alias("_t"))
    else:
        told = now.sparkSession.createDataFrame([(v, float(w)) for v, w in wanted.items()], "_v string, _w double")
        met = shares.join(F.broadcast(told), F.col(m).cast("string").eqNullSafe(F.col("_v")), "left")
        raised = met.select(F.col(m).alias("_m"), F.when(F.col("s") > 0, F.coalesce("_w", F.lit(0.0))).otherwise(0.0).alias("_t"))
    norm = raised.agg(F.sum("_t")).first()[0] or 0.0
    return raised.select("_m", (F.col("_t") / F.lit(norm or 1.0)).alias(f"to_{m}"))


def error(cells: DataFrame) -> float:
    """The largest difference between a margin value's weight and its target."""
    parts = [cells.groupBy(m).agg(F.abs(F.sum("weight") - F.first(f"to_{m}")).alias("e")).select("e") for m in MARGINS]
    return float(parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.max("e")).first()[0] or 0.0)


def rake(cells: DataFrame, scratch: Scratch, powers: dict[str, float], rounds: int, targets: dict[str, dict] | None = None, tolerance: float = 0.0) -> DataFrame:
    """``cells(source, lang, topic, tokens, n)`` with share (of all tokens), weight (raked share) and each margin's target to_<margin>.

    ``targets`` gives weights by value for a margin, relative to each other (values that it doesn't name get none); a
    margin without them has its own shares to the power in ``powers`` as target, normalised: 1 leaves it
    as it is, 0 makes its values equal. Every fifth round the largest marginal error is measured, and no more
    rounds follow where it is ``tolerance`` at most. Cells without tokens have weight 0.
    """
    cells = scratch.table(cells)
    small = cells.count() <= SMALL
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    # in one partition the margins' windows need no exchange
    now = (cells.repartition(1) if small else cells).withColumn("share", F.when(F.lit(total) > 0, F.col("tokens") / F.lit(float(total or 1))).otherwise(0.0)).withColumn("weight", F.col("share"))
    for m in MARGINS:
        target = _target(now, m, powers.get(m, 1.0), (targets or {}).get(m))
        now = now.join(F.broadcast(target) if small else target, F.col(m).eqNullSafe(F.col("_m")), "left").drop("_m")
    held = now = scratch.table(now)
    now = now.repartition(1) if small else now
    for r in range(rounds):
        for m in MARGINS:
            have = F.sum("weight").over(W.partitionBy(m))
            now = now.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"to_{m}") / have).otherwise(0.0))
        if not small or r % 5 == 4:
            now = scratch.table(now)
            scratch.drop(held)
            held = now
            if r % 5 == 4 and r + 1 < rounds and tolerance > 0 and error(now) <= tolerance:
                break
            now = now.repartition(1) if small else now
    return now


def mix(docs: DataFrame, powers: dict[str, float] | None = None, rounds: int = 10, seed: str = "mix", targets: dict[str, dict] | None = None, tolerance: float = 0.0) -> DataFrame:
    """``docs`` with topic, n_tokens, weight, probability and kept.

    weight is the raked share of a document's cell over the cell's share of
    tokens; probability is weight over the largest weight, so no document is
    needed twice and the kept tokens have the targets' composition in
    expectation. kept compares it with a hash of doc_id, alike on every run. ``targets``, ``powers`` and ``tolerance`` as in ``rake``:
    for instance ``targets={"source": {"web": 0.6, "books": 0.4}}``.

    Defined cases: a null source or language is a value of its own; a null or
    empty text has no tokens and topic snippet; documents of cells without
    tokens have weight 0 and are not kept; a null doc_id is decided by its
    text; repeated rows are decided alike; an empty table gives an empty result.
    Columns named as the new ones are replaced, all others returned untouched, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    powers = powers or POWERS
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = ("topic", "n_tokens", "weight", "probability", "kept")
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "source", "lang", text.alias("text"))
    rows = own.withColumn("n_tokens", n_tokens(F.col("text"))).withColumn("topic", topic(F.col("text"), F.col("n_tokens")))
    counted = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    raked = rake(counted, scratch, powers, rounds, targets, tolerance).select(*[F.col(m).alias(f"_{m}") for m in MARGINS], F.when(F.col("share") > 0, F.col("weight") / F.col("share")).otherwise(0.0).alias("weight"))
    raked = scratch.table(raked)
    top = raked.agg(F.max("weight")).first()[0] or 0.0
    side = F.broadcast(raked) if raked.count() <= SMALL else raked
    same = [F.col(m).eqNullSafe(F.col(f"_{m}")) for m in MARGINS]
    out = rows.join(side, same[0] & same[1] & same[2], "left").drop(*[f"_{m}" for m in MARGINS])
    chance = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce("doc_id", F.concat(F.lit("text:"), F.md5("text"))))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    out = out.withColumn("probability", F.when(F.lit(top) > 0, F.col("weight") / F.lit(top or 1.0)).otherwise(0.0))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in made]
    return out.withColumn("kept", chance < F.col("probability")).select(*kept, *made)
