"""In-comment directives and comment units: running values and gaps-and-islands, in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.language import LANGUAGES, trimmed
from . import scan

PREFIX = "siltgate:"


def _language(raw: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    low = F.lower(trimmed(raw))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), low), low)


def parsed(text: Column, prefix: str = PREFIX) -> Column:
    """struct(action, lang): what a comment says, ``none`` for ordinary ones."""
    t = trimmed(text)
    low = F.lower(t)
    rest = lambda head: _language(F.substring(t, len(prefix + head) + 1, F.length(t)))
    is_ = lambda head: low.startswith(prefix + head)
    say = lambda action, lang=F.lit(""): F.struct(F.lit(action).alias("action"), lang.alias("lang"))
    return (
        F.when(~low.startswith(prefix), say("none"))
        .when(is_("file-lang="), say("file", rest("file-lang=")))
        .when(is_("disable:lang="), say("disable", rest("disable:lang=")))
        .when(is_("disable"), say("disable"))
        .when(is_("enable"), say("enable"))
        .when(is_("ignore"), say("ignore"))
        .when(is_("lang="), say("lang", rest("lang=")))
        .otherwise(say("other"))
    )


def states(comments: DataFrame, default_language: str | Column, prefix: str = PREFIX) -> DataFrame:
    """``comments`` with skip and lang.

    Directives act from their place on. disable outranks ignore, which skips
    one comment, then lang, then file-lang, then the default. Without
    file-lang a comment in a disabled stretch uses up a pending ignore; with
    it, it does not.

    A directive sets a part of the state and leaves the rest, so the state before a comment is the last value of each
    part; an ignore is pending if no comment that uses it up has come since. What a block of comments does to
    the state is a map on it: its last values, and the last comment that uses up an ignore for each of the four ways
    in which the block can be entered (disabled or not, with file-lang or not). The maps are composed from block to
    block, so one long file is read by many tasks. Rows are in the order of seq, an integer unique within a path.
    """
    default = F.lit(default_language) if isinstance(default_language, str) else default_language
    names = list(comments.columns)
    by = ["_path"]
    rows = comments.select(F.struct(*[comments[f"`{c}`"] for c in names]).alias("_row"), F.col("path").alias("_path"), F.col("seq").alias("_seq"), parsed(F.col("text"), prefix).alias("_said"), default.alias("_fallback"))
    rows = scan.cut(rows, "_seq")
    action, lang = F.col("_said.action"), F.col("_said.lang")
    plain = action == "none"
    sets = {
        "off": F.when(action == "disable", F.struct(F.lit(True).alias("on"), lang.alias("lang"))).when(action == "enable", F.struct(F.lit(False).alias("on"), F.lit("").alias("lang"))),
        "lang": F.when(action == "lang", lang),
        "file": F.when(action == "file", lang),
        "ignore": F.when(action == "ignore", F.col("_seq")),
    }
    before = scan.here(by, "_seq")
    rows = rows.withColumns({f"_{n}": F.last(c, ignorenulls=True).over(before) for n, c in sets.items()})
    entries = [(off, file) for off in (False, True) for file in (False, True)]
    uses = {f"_used{int(off)}{int(file)}": F.when(plain & ~(F.coalesce("_off.on", F.lit(off)) & F.coalesce(F.col("_file") != "", F.lit(file))), F.col("_seq")) for off, file in entries}
    blocks = rows.groupBy("_path", "_b").agg(*[scan.latest(c, "_seq").alias(f"_{n}") for n, c in sets.items()], *[F.max(c).alias(n) for n, c in uses.items()])
    over = scan.earlier(by)
    blocks = blocks.select("_path", "_b", *uses, *[F.last(f"_{n}", ignorenulls=True).over(over).alias(f"_g_{n}") for n in sets])
    entered = lambda off, file: (F.coalesce("_g_off.on", F.lit(False)) == off) & (F.coalesce(F.col("_g_file") != "", F.lit(False)) == file)
    chosen = F.coalesce(*[F.when(entered(off, file), F.col(f"_used{int(off)}{int(file)}")) for off, file in entries])
    blocks = blocks.withColumn("_g_used", F.max(chosen).over(over))
    rows = rows.withColumns({n: F.max(c).over(before) for n, c in uses.items()})
    rows = scan.given(rows, blocks, by, {f"_g_{n}": F.col(f"_g_{n}") for n in (*sets, "used")})
    used = F.greatest(F.coalesce(*[F.when(entered(off, file), F.col(f"_used{int(off)}{int(file)}")) for off, file in entries]), F.col("_g_used"))
    off, ignore = F.coalesce("_off", "_g_off"), F.coalesce("_ignore", "_g_ignore")
    disabled, off_lang = F.coalesce(off["on"], F.lit(False)), F.coalesce(off["lang"], F.lit(""))
    pending = F.coalesce(ignore > F.coalesce(used, ignore - 1), F.lit(False))
    skip = F.when(~plain, True).when(disabled, off_lang == "").otherwise(pending)
    chosen_lang = F.coalesce(F.nullif(F.coalesce("_lang", "_g_lang"), F.lit("")), F.col("_file"), F.col("_g_file"), F.lit(""))
    said = F.when(~plain, "").when(disabled, off_lang).when(pending, "").otherwise(chosen_lang)
    return rows.select(*[F.col("_row")[c].alias(c) for c in names if c not in ("skip", "lang")], skip.alias("skip"), F.when(~skip & (said == ""), F.col("_fallback")).otherwise(said).alias("lang"))


def outlined(comments: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """``comments`` with no more of their texts than ``states`` and ``outlines`` ask: directives whole, of others one letter, or nothing where there is no text."""
    said = F.lower(trimmed(F.col("text"))).startswith(prefix)
    return comments.withColumn("text", F.when(said, F.col("text")).when(F.trim("text") != "", "x").otherwise(""))


def _members(stated: DataFrame, check_strings: bool) -> DataFrame:
    """The rows that count, with the unit_id of each. All windows are by path, so the rows are shuffled once."""
    kinds = ["Comment", "String"] if check_strings else ["Comment"]
    order = W.partitionBy("path").orderBy("seq")
    alone = F.col("is_block") | (F.col("kind") == "String")
    rows = stated.where(~F.col("skip") & F.col("kind").isin(kinds) & F.col("path").isNotNull()).withColumn("alone", alone)
    before = lambda c: F.lag(c).over(order)
    hard = F.coalesce(F.col("alone") | before("alone") | (before("lang") != F.col("lang")), F.lit(True))
    gap = F.coalesce(F.col("line") > before("end_line") + 1, F.lit(True))
    rows = rows.withColumns({"hard": hard, "gap": gap}).withColumn("chunk", F.sum((F.col("hard") | F.col("gap")).cast("int")).over(order))
    # level two: a chunk after a textless one continues it unless its start is hard; only a chunk's first row is hard or has a gap
    rows = rows.withColumn("has_text", F.bool_or(F.trim("text") != "").over(W.partitionBy("path", "chunk")))
    starts = F.col("hard") | (F.col("gap") & F.coalesce(before("has_text"), F.lit(False)))
    return rows.withColumn("starts", starts.cast("int")).withColumn("unit_id", F.sum("starts").over(order).cast("long"))


#: What a unit has besides its text.
_EXTENT = {"line": F.min, "end_line": F.max, "lang": F.first, "kind": F.first}


def units(stated: DataFrame, check_strings: bool = False) -> DataFrame:
    """Runs of line comments as one text: path, unit_id, text, line, end_line, lang, kind.

    Blocks and strings stand alone. Line comments of one language join while
    each starts on the line after the last; as long as a run has no text yet,
    gaps don't end it. Skipped rows and imports are left out, as are units
    without text unless they are blocks.
    """
    texts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    out = _members(stated, check_strings).groupBy("path", "unit_id").agg(
        F.array_join(F.filter(texts, lambda t: F.trim(t) != ""), "\n").alias("text"), *[f(c).alias(c) for c, f in _EXTENT.items()], F.bool_or("is_block").alias("is_block")
    )
    return out.where((F.col("text") != "") | F.col("is_block")).drop("is_block")


def outlines(stated: DataFrame, check_strings: bool = False) -> DataFrame:
    """The same units with the numbers of their comments (seqs, in order) in place of the text, which ``unit_texts`` adds."""
    out = _members(stated, check_strings).groupBy("path", "unit_id").agg(
        F.sort_array(F.collect_list("seq")).alias("seqs"), *[f(c).alias(c) for c, f in _EXTENT.items()], F.bool_or((F.trim("text") != "") | F.col("is_block")).alias("counts")
    )
    return out.where("counts").drop("counts")


def touched(unit_rows: DataFrame, added: DataFrame) -> DataFrame:
    """Units with an added line: those that end no earlier than the first added line from their own first line on.

    Units and added lines are read from a file's end to its beginning in one pass, so no unit is
    joined with itself, nor compared with all lines of its file, and its lines are not spread.
    """
    names = unit_rows.columns
    lines = added.where("path is not null").select("path", "line", F.col("line").alias("_added"))
    both = unit_rows.withColumn("_added", F.lit(None).cast("long")).unionByName(lines, allowMissingColumns=True)
    upward = W.partitionBy("path").orderBy(F.col("line").desc(), F.col("_added").isNull()).rowsBetween(W.unboundedPreceding, -1)
    rows = both.withColumn("_next", F.last("_added", ignorenulls=True).over(upward)).where("_added is null")
    return rows.where((F.col("line") <= F.col("_next")) & (F.col("_next") <= F.col("end_line"))).select(*names)
