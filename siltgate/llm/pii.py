"""Personal data: pattern spans, and information-theoretic sanitisation of terms that give it away.

Native throughout: DataFrame and SQL functions only.

The base finds e-mail addresses, IP addresses, card and phone numbers. The
method then protects their values as entities: over the corpus' distinct lines
it estimates how much of an entity's information content a term discloses,

    disclosure(t, e) = PMI(t; e) / IC(e),   PMI = ln(n(t,e) N / (n(t) n(e))),   IC = -ln(n(e) / N),

with n counted in distinct lines, so that copies of a line count once. Terms
that disclose at least ``share`` of an entity that they meet in ``support`` lines or more are
marked wherever they occur, and are generalised or removed in ``sanitised``. Every entity
takes part by default, also one that stands in a single line; a larger ``support`` is a floor
that leaves the rarer ones out. Small counts are met by a bound instead: a term that stands in
n(t) of N lines meets the entity in all n(t,e) lines by chance with about (n(t) n(e) / (n(t,e) N)) ** n(t,e),
and it is marked only if that is at most ``CHANCE``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
#: The patterns, with possessive loops where the next character decides anyway, and starts
#: that skip the inside of a run: the same leftmost matches in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that texts without a match mostly fail.
HINTS = {"email": "instr({t}, '@') > 0", "ip": r"{t} rlike '[0-9][.][0-9]'", "card": r"{t} rlike '[0-9][ -]?[0-9]'", "phone": "instr({t}, '+') > 0"}
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)",
    "card": f"length({_DIGITS}) between 16 and 19 and aggregate(reverse(split({_DIGITS}, '')), named_struct('s', 0, 'i', 0), (a, d) -> named_struct('s', a.s + case when a.i % 2 = 0 then cast(d as int) when cast(d as int) > 4 then 2 * cast(d as int) - 9 else 2 * cast(d as int) end, 'i', a.i + 1), a -> a.s) % 10 = 0",
    "phone": f"length({_DIGITS}) between 8 and 15",
}
#: Words of a text that can be terms.
TERM = r"\p{L}{3,}"
#: Tables of marked terms with at most so many rows are broadcast (under 64 MB at 640 bytes a row).
SMALL = 100_000
#: Lists of terms alone with at most so many rows are broadcast (about 64 MB).
TERMS = 1_000_000
#: Pairs of a text with at most so many rows are broadcast as lists (under 64 MB at 64 bytes a pair).
PAIRS = 1_000_000
#: Matches of a text whose lengths are summed in one run.
RUN = 128
#: Probability up to which a term's meetings with an entity aren't put down to chance.
CHANCE = 0.005
_EMPTY = "cast(array() as array<struct<kind:string,s:int,e:int,v:string>>)"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _found(kind: str, text: str, pattern: str, valid: str, hint: str) -> str:
    """SQL for the array of (kind, s, e, v): matches with their places in code points.

    The parts between matches and the matches alternate; summing their lengths
    gives the places, and only valid matches are appended. The sums run over
    runs of RUN pairs, and then inside each run, so that no long array is copied for each match.
    """
    step = f"""named_struct('p', a.p + length(coalesce(x.g, '')) + length(coalesce(x.m, '')), 'o',
        case when x.m is not null and exists(array(x.m), m -> {valid})
        then concat(a.o, array(named_struct('kind', '{kind}', 's', a.p + length(x.g), 'e', a.p + length(x.g) + length(x.m), 'v', x.m))) else a.o end)"""
    pairs = f"transform(arrays_zip(split({text}, {_quoted(pattern)}, -1), regexp_extract_all({text}, {_quoted(pattern)}, 0)), z -> named_struct('g', z.`0`, 'm', z.`1`))"
    runs = f"transform(array({pairs}), y -> transform(sequence(0, (size(y) - 1) div {RUN}), i -> slice(y, i * {RUN} + 1, {RUN})))[0]"
    size = "aggregate(r, 0, (n, x) -> n + length(coalesce(x.g, '')) + length(coalesce(x.m, '')))"
    starts = f"aggregate({runs}, named_struct('p', 0, 'o', cast(array() as array<struct<p:int,r:array<struct<g:string,m:string>>>>)), (t, r) -> named_struct('p', t.p + {size}, 'o', concat(t.o, array(named_struct('p', t.p, 'r', r)))), t -> t.o)"
    found = f"flatten(transform({starts}, w -> aggregate(w.r, named_struct('p', w.p, 'o', {_EMPTY}), (a, x) -> {step}, a -> a.o)))"
    return f"case when {hint.format(t=text)} then {found} else {_EMPTY} end"


def base_spans(docs: DataFrame, text: str = "_text") -> DataFrame:
    """``docs`` with an array column for each kind (``_email`` and so on)."""
    return docs.withColumns({f"_{k}": F.expr(_found(k, text, PATTERNS[k], VALID[k], HINTS[k])) for k in KINDS})


def _entity() -> str:
    """An entity's value without case and punctuation."""
    return "concat(kind, ':', case when kind = 'email' then lower(v) when kind = 'ip' then v else regexp_replace(v, '[^0-9]', '') end)"


def _words(text: str) -> str:
    """Distinct lower-case terms of a text, e-mail addresses aside."""
    clean = f"case when {HINTS['email'].format(t=text)} then regexp_replace({text}, {_quoted(PATTERNS['email'])}, ' ') else {text} end"
    return f"array_distinct(regexp_extract_all(lower({clean}), {_quoted(TERM)}, 0))"


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def _alike(of: str, rows: DataFrame) -> DataFrame:
    """``rows(line, <of>)`` to (<of>, n, class): equal classes stand in the same lines."""
    mark = F.xxhash64(F.count("*"), F.bit_xor("line"), F.bit_xor(F.xxhash64(F.lit(of), "line")))
    return rows.groupBy(of).agg(F.count("*").alias("n"), mark.alias("class"))


def disclosing_terms(docs: DataFrame, scratch: Scratch, share: float = 0.9, support: int = 1) -> DataFrame:
    """``docs(_text)`` to (term): the terms that disclose an entity, from all lines of the corpus.

    Entities that stand in the same lines are counted as one class, and so are
    terms, so a line gives a pair for each two classes and not for each address and word in it.
    """
    lines = docs.select(F.explode(F.split("_text", "\n")).alias("_text")).where("_text <> ''")
    hinted = lines.where(" or ".join(f"({h.format(t='_text')})" for h in HINTS.values()))
    held = base_spans(hinted).select("_text", F.concat(*[f"_{k}" for k in KINDS]).alias("x")).where("size(x) > 0")
    held = scratch.table(held.distinct().select(F.xxhash64("_text").alias("line"), F.expr(f"array_distinct(transform(transform(x, s -> struct(s.kind as kind, s.v as v)), s -> {_entity().replace('kind', 's.kind').replace('(v', '(s.v').replace('then v ', 'then s.v ')}))").alias("entities"), F.expr(_words("_text")).alias("terms")))
    entities = held.select("line", F.explode("entities").alias("e"))
    terms = held.select("line", F.explode("terms").alias("term"))
    of_e = scratch.table(_alike("e", entities).where(F.col("n") >= support))
    of_t = scratch.table(_alike("term", terms))
    met_e = entities.join(_maybe_broadcast(of_e), "e").select("line", F.col("class").alias("ce"), F.col("n").alias("n_e")).distinct()
    met_t = terms.join(_maybe_broadcast(of_t), "term").select("line", F.col("class").alias("ct"), F.col("n").alias("n_held")).distinct()
    met = scratch.table(met_e.join(met_t, "line").groupBy("ce", "ct", "n_e", "n_held").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support))
    if met.isEmpty():
        return terms.select("term").limit(0)
    # all lines of all documents count, copies once. Only the distinct lines are shuffled, not their words: those are
    # counted where they stand. The empty term stands in every line.
    words = F.explode(F.expr(f"concat(array(''), {_words('_text')})"))
    vocabulary = scratch.table(lines.distinct().select(words.alias("term")).groupBy("term").agg(F.count("*").alias("n_t")))
    n_lines = vocabulary.where("term = ''").first()["n_t"]
    pmi = lambda n_t: F.log(F.col("n_et") * F.lit(float(n_lines)) / (F.col(n_t) * F.col("n_e")))
    content = F.log(F.lit(float(n_lines)) / F.col("n_e"))
    discloses = lambda n_t: (pmi(n_t) >= share * content) & (F.col("n_et") * pmi(n_t) >= -math.log(CHANCE))
    # n_t is at least the number of held lines with the term: common terms fail on that bound already
    some = met.where((content > 0) & discloses("n_held")).select(F.col("ct").alias("class"), "n_e", "n_et").distinct()
    met = scratch.table(of_t.select("term", "class").join(_maybe_broadcast(scratch.table(some)), "class").drop("class"))
    if met.isEmpty():
        return met.select("term")
    return scratch.table(met.join(vocabulary, "term").where(discloses("n_t")).select("term").distinct())


def annotated(docs: DataFrame, share: float = 0.9, support: int = 1) -> DataFrame:
    """``docs`` as _row (a struct of its columns), _text (null as empty), _email, _ip, _card, _phone and _term.

    Each of the last five is an array of (kind, s, e, v) in the order of s: code points, e
    exclusive. _term has the occurrences of disclosing terms that don't touch a base span.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    terms = disclosing_terms(rows.select("_text"), scratch, share, support)
    found = base_spans(rows)
    if terms.isEmpty():
        return found.withColumn("_term", F.expr(_EMPTY))
    # which marked terms a text has, by the text's hash: copies are looked up once
    texts = rows.select(F.xxhash64("_text").alias("_key"), F.explode(F.expr(_words("_text"))).alias("term")).join(F.broadcast(terms) if terms.count() <= TERMS else terms, "term")
    pairs = scratch.table(texts.distinct())
    marked = pairs.groupBy("_key").agg(F.collect_list("term").alias("_marked"))
    word = _found("term", "_text", TERM, "array_contains(_marked, lower(m))", "true")
    touches = " or ".join(f"exists(_{k}, b -> b.s < w.e and w.s < b.e)" for k in KINDS)
    spans = F.expr(f"case when _marked is null then {_EMPTY} else filter({word}, w -> not ({touches})) end")
    side = F.broadcast(marked) if pairs.count() <= PAIRS else marked
    return found.withColumn("_key", F.xxhash64("_text")).join(side, "_key", "left").withColumn("_term", spans).drop("_key", "_marked")


def span_table(docs: DataFrame, share: float = 0.9, support: int = 1) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_term.

    base_sha256 is the SHA-256 of ``kind:start:end`` of the base spans, by kind,
    then start, joined by commas; spans has the base spans and then the terms.

    Defined cases: a null text is an empty one and has no spans; a null doc_id
    and repeated rows are treated like others, a row each; an empty table gives
    an empty result; other columns, also those named like the working columns
    of this module, are ignored. Texts are searched whole.
    """
    told = lambda ks: F.expr(f"array_join(transform(concat({', '.join('_' + k for k in ks)}), x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")
    out = annotated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), share, support)
    return out.select(F.col("_row.doc_id").alias("doc_id"), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(told(KINDS), 256).alias("base_sha256"), told((*KINDS, "term")).alias("spans"), F.size("_term").cast("long").alias("n_term"))


def sanitised(docs: DataFrame, share: float = 0.9, support: int = 1) -> DataFrame:
    """``docs`` with the base spans of text generalised to their kind and disclosing terms removed.

    Where spans overlap, the one that starts first covers the others; the
    stretch that they cover together is replaced once. Texts without spans stay
    as they are, null and empty included. All other columns, whatever their names, are returned
    untouched; repeated rows are changed alike, a row each; a null doc_id or no doc_id at all
    makes no difference; an empty table gives an empty result. Texts are searched whole; equal counts leave no tie to break.
    """
    out = annotated(docs, share, support)
    joined = f"array_sort(concat({', '.join('_' + k for k in (*KINDS, 'term'))}), (l, r) -> case when l.s <> r.s then l.s - r.s else r.e - l.e end)"
    put = "case when x.kind = 'term' then '' else concat('[', upper(x.kind), ']') end"
    # pieces are joined once at the end, and gathered in runs, so a text is copied a few times only
    step = f"""case when x.s < a.p then named_struct('p', greatest(a.p, x.e), 'o', a.o)
        else named_struct('p', x.e, 'o', concat(a.o, array(substring(_text, a.p + 1, x.s - a.p), {put}))) end"""
    run = f"aggregate(slice(y, i * {RUN} + 1, {RUN}), named_struct('p', b.p, 'o', cast(array() as array<string>)), (a, x) -> {step}, a -> named_struct('p', a.p, 'o', concat(b.o, array(array_join(a.o, '')))))"
    text = f"""transform(array({joined}), y -> aggregate(sequence(0, (size(y) - 1) div {RUN}), named_struct('p', 0, 'o', cast(array() as array<string>)), (b, i) -> {run},
        b -> concat(array_join(b.o, ''), substring(_text, b.p + 1))))[0]"""
    some = " + ".join(f"size(_{k})" for k in (*KINDS, "term"))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c != "text"]
    new = F.expr(f"case when {some} = 0 then cast(_row.text as string) else {text} end").alias("text")
    at = docs.columns.index("text")
    return out.select(*kept[:at], new, *kept[at:])
