"""Checks of commit and chat messages: ``messages(path, text[, content])`` to findings.

Everything is row-local: lines come from one explode and are filtered before
anything else, so the same functions run on streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PolicyConfig
from ..functions import chars, encoding, globs, language
from ..sources import commits
from .findings import finding, union
from .lines import explode_lines

ORDER = ("coauthor", "invisible", "lookalike", "bad_bytes", "emoji", "language", "conventional", "subject_limit", "body_limit", "custom")
#: type[(scope)][!]: text, with Unicode white space and only the newline as a line end.
CONVENTIONAL = r"(?dU)^([^\s(:!]+)(\([^)]*\))?(!)?: .+"
#: A prefix as it is taken off before the language test; here the space is optional.
PREFIX = r"^[\p{IsAlphabetic}\p{N}_-]+(?:\([^)]*\))?!?:[ ]*"


def subject(text: Column) -> Column:
    return language.trimmed(F.substring_index(F.regexp_replace(text, r"\n+\z", ""), "\n", 1))


def trailer_email(line: Column) -> Column:
    """Between the last < and the > after it, else empty."""
    return F.when((F.instr(line, "<") > 0) & (F.instr(line, ">") > 0), F.regexp_extract(line, r"<([^<]*)>[^<>]*\z", 1)).otherwise("")


def coauthor_lines(df: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """Co-author trailers whose address matches one of the globs."""
    rows = explode_lines(df.where(F.lower(text).contains("co-authored-by:")), text).withColumn("trailer", language.trimmed(F.col("line_text")))
    rows = rows.where(F.lower("trailer").startswith("co-authored-by:")).withColumn("email", F.lower(language.trimmed(trailer_email(F.col("trailer")))))
    hit = F.lit(False)
    for p in patterns:
        r = globs.fnmatch_regex(p.lower())
        if r is not None:
            hit = hit | F.col("email").rlike(f"^(?s:{r})\\z")
    return rows.where(hit)


def conventional(text: Column, types: list[str], require_scope: bool = False, allow_merge: bool = True, allow_revert: bool = True) -> Column:
    """Null for a good subject, else ``format``, ``type`` or ``scope``."""
    s = subject(text)
    free = (s == "") | s.startswith("fixup! ") | s.startswith("squash! ")
    free = free | s.startswith("Merge ") if allow_merge else free
    free = free | s.startswith("Revert ") if allow_revert else free
    kind = F.translate(F.regexp_extract(s, CONVENTIONAL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lower = [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in types]
    scope = F.coalesce(F.regexp_extract(s, CONVENTIONAL, 2), F.lit(""))
    out = F.when(free, F.lit(None).cast("string")).when(~s.rlike(CONVENTIONAL), "format").when(~kind.isin(lower), "type")
    return out.when(scope.isin("", "()"), "scope") if require_scope else out


def language_lines(df: DataFrame, required: str, least: int, skip_prefixes: list[str], text: str = "text") -> DataFrame:
    """Lines in another language than required; the subject without its type prefix."""
    s = subject(F.col(text))
    rows = df.withColumn("_s", s)
    for p in skip_prefixes:
        rows = rows.where(~F.col("_s").startswith(p))
    rows = rows.withColumn("_t", F.regexp_replace(text, r"\n+\z", "")).drop(text)
    lines = explode_lines(rows, "_t")
    said = F.when(F.col("line") == 1, F.regexp_replace("_s", PREFIX, "")).otherwise(language.trimmed(F.col("line_text")))
    judged = lines.withColumn("line_text", said).withColumn("_j", language.required(F.col("line_text"), required, least))
    return judged.where(F.col("_j.has_content") & ~F.col("_j.ok")).withColumn("detected", language.dominant(F.col("line_text"))).drop("_s", "_j")


def subject_length(text: Column) -> Column:
    return F.char_length(subject(text))


def long_body_lines(df: DataFrame, most: int, text: str = "text") -> DataFrame:
    """Lines after the subject (and one blank separator) that are longer than ``most``."""
    rows = df.withColumn("_t", F.regexp_replace(text, r"\n+\z", "")).drop(text)
    second = F.try_element_at(F.split("_t", "\n", -1), F.lit(2))
    rows = rows.withColumn("_from", F.when(language.trimmed(second) == "", 3).otherwise(2))
    lines = explode_lines(rows, "_t").withColumn("length", F.char_length("line_text"))
    return lines.where((F.col("line") >= F.col("_from")) & (F.col("length") > most)).drop("_from")


def custom_rule_hits(df: DataFrame, rules: list[dict], text: str = "text") -> DataFrame:
    """Required rules that no part of the text meets (line 0), and lines that meet the others.

    Rules are literals of the plan: one pass over the lines tests them all.
    """
    usable = [(i, r) for i, r in enumerate(rules) if r.get("pattern")]
    need = [(i, r) for i, r in usable if r.get("required")]
    ban = [(i, r) for i, r in usable if not r.get("required")]
    parts = []
    told = lambda i, r, cond: F.when(cond, F.struct(F.lit(i).alias("seq"), F.lit(r.get("name", "")).alias("rule"), F.lit(r.get("message", "")).alias("message")))
    keep = [c for c in df.columns if c != text]
    if need:
        missing = F.array_compact(F.array(*[told(i, r, ~F.col(text).rlike("(?dU)" + r["pattern"])) for i, r in need]))
        parts.append(df.select(*keep, F.lit(0).cast("long").alias("line"), F.explode(missing).alias("hit")))
    if ban:
        lines = explode_lines(df, text)
        hits = F.array_compact(F.array(*[told(i, r, F.col("line_text").rlike("(?dU)" + r["pattern"])) for i, r in ban]))
        parts.append(lines.select(*keep, "line", F.explode(hits).alias("hit")))
    if not parts:
        return df.select(*keep, F.lit(0).cast("long").alias("line")).where("false").withColumns({"seq": F.lit(0), "rule": F.lit(""), "message": F.lit("")})
    return union(parts).select(*keep, "line", "hit.seq", "hit.rule", "hit.message")


def _marked(chars_: Column, cls: str, told: Callable[[Column, Column], Column]) -> Column:
    """Findings for the characters of a line that are of a class, by their place."""
    return F.filter(F.transform(chars_, lambda c, i: F.when(c.rlike(cls), told(c, (i + 1).cast("long")))), lambda x: x.isNotNull())


#: A finding before its path is known.
_FOUND = "array<struct<check:string,line:bigint,col:bigint,code:string,params:map<string,string>>>"


def check_messages(messages: DataFrame, cfg: PolicyConfig) -> DataFrame:
    """All enabled message checks over ``messages(path, text[, content])``, in one pass.

    A text is split into lines once. What is judged by message stands on its first line; a line's findings are one array, empty for a clean
    one without looking at its characters. Every byte that is not UTF-8 is a finding with its line, column and
    hexadecimal value; only messages with such bytes are read as bytes.
    """
    m = cfg.commit_message
    none = F.array().cast(_FOUND)
    zero = F.lit(0).cast("long")

    def told(check: str, code: str | Column, at: Column, col: Column = zero, **params: Column) -> Column:
        pairs = [x for k, v in sorted(params.items()) for x in (F.lit(k), v.cast("string"))]
        table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        return F.struct(F.lit(check).alias("check"), at.alias("line"), col.alias("col"), (F.lit(code) if isinstance(code, str) else code).alias("code"), table.alias("params"))

    def when(condition: Column, *found: Column) -> Column:
        return F.when(condition, F.array(*found).cast(_FOUND)).otherwise(none)

    bytes_too = m.no_bad_runes and "content" in messages.columns
    text = F.col("text")
    lines = F.split(text, "\n", -1)
    plain = F.transform(lines, lambda x: F.struct(x.alias("t"), F.lit(None).cast("string").alias("b")))
    if bytes_too:
        view = F.split(F.decode(F.col("content"), "ISO-8859-1"), "\n", -1)
        both = F.transform(F.arrays_zip(lines.alias("t"), view.alias("b")), lambda x: F.struct(F.coalesce(x["t"], F.lit("")).alias("t"), x["b"].alias("b")))
        plain = F.when(F.is_valid_utf8(F.col("content").cast("string")), plain).otherwise(both)
    head = {"_subject": subject(text), "_n": F.size(F.split(F.regexp_replace(text, r"\n+\z", ""), "\n", -1))}
    if m.body_limit_enabled:
        head["_from"] = F.when(language.trimmed(F.try_element_at(lines, F.lit(2))) == "", 3).otherwise(2)
    required = [(i, r) for i, r in enumerate(cfg.custom_message_rules or []) if r.get("pattern") and r.get("required")]
    banned = [(i, r) for i, r in enumerate(cfg.custom_message_rules or []) if r.get("pattern") and not r.get("required")]
    whole = [when(~text.rlike("(?dU)" + r["pattern"]), told("custom", "custom_rule", zero, rule=F.lit(r.get("name", "")), message=F.lit(r.get("message", "")))) for _, r in required]
    head["_missing"] = F.concat(*whole) if whole else none
    rows = messages.where("text is not null").select(F.col("path").cast("string").alias("path"), F.posexplode(plain).alias("_p", "_l"), *[c.alias(n) for n, c in head.items()])

    t, at = F.col("_l.t"), (F.col("_p") + 1).cast("long")
    first, inner = F.col("_p") == 0, F.col("_p") < F.col("_n")
    units = F.when(F.length(t) > 0, F.filter(F.split(t, ""), lambda c: c != "")).otherwise(F.array().cast("array<string>"))
    found: list[Column] = []
    if m.no_ai_coauthor:
        trailer = language.trimmed(t)
        email = F.lower(language.trimmed(trailer_email(trailer)))
        globbed = [r for p in m.coauthor_patterns if (r := globs.fnmatch_regex(p.lower())) is not None]
        hit = F.lower(t).contains("co-authored-by:") & F.lower(trailer).startswith("co-authored-by:")
        hit = hit & email.rlike("|".join(f"(?:^(?s:{r})\\z)" for r in globbed)) if globbed else F.lit(False)
        found.append(when(hit, told("coauthor", "ai_coauthor", at, trailer=trailer)))

    def by_class(check: str, code: str, cls: str, **params: Callable[[Column], Column]) -> Column:
        return F.when(t.rlike(cls), _marked(units, cls, lambda c, col: told(check, code, at, col, char=chars.u_plus(chars.code_point(c)), **{k: f(c) for k, f in params.items()})).cast(_FOUND)).otherwise(none)

    if m.no_unicode_spaces:
        found.append(by_class("invisible", "invisible_char", chars.INVISIBLE, name=lambda c: chars.name_of_invisible(chars.code_point(c))))
    if m.no_ambiguous_chars:
        found.append(by_class("lookalike", "ambiguous_char", chars.lookalike_class(m.locale), looks_like=lambda c: chars.lookalike_of(c, m.locale)))
    if bytes_too:
        found.append(F.when(F.col("_l.b").isNotNull(), F.transform(encoding.bad_places(F.col("_l.b")), lambda x: told("bad_bytes", "bad_byte", at, x["col"].cast("long"), byte=x["byte"])).cast(_FOUND)).otherwise(none))
    if m.no_emoji:
        found.append(by_class("emoji", "emoji", chars.EMOJI_REPORTED))
    if m.language_enabled:
        free = F.lit(False)
        for p in m.skip_prefixes:
            free = free | F.col("_subject").startswith(p)
        said = F.when(first, F.regexp_replace("_subject", PREFIX, "")).otherwise(language.trimmed(t))
        found.append(when(inner & ~free & language.is_foreign(said, m.required_language, m.min_length), told("language", "language", at, detected=language.dominant(said))))
    if m.conventional_enabled:
        fault = conventional(F.col("_subject"), m.all_types(), m.require_scope, m.allow_merge, m.allow_revert)
        found.append(when(first & fault.isNotNull(), told("conventional", F.concat(F.lit("conventional_"), fault), F.lit(1).cast("long"))))
    if m.subject_limit_enabled:
        found.append(when(first & (F.char_length("_subject") > m.subject_limit), told("subject_limit", "subject_too_long", F.lit(1).cast("long"), length=F.char_length("_subject"))))
    if m.body_limit_enabled:
        found.append(when(inner & (at >= F.col("_from")) & (F.char_length(t) > m.body_limit), told("body_limit", "body_line_too_long", at, length=F.char_length(t))))
    if required:
        found.append(F.when(first, F.col("_missing")).otherwise(none))
    for _, r in banned:
        found.append(when(t.rlike("(?dU)" + r["pattern"]), told("custom", "custom_rule", at, rule=F.lit(r.get("name", "")), message=F.lit(r.get("message", "")))))
    if not found:
        return finding(messages.where("false"), "none", "none")
    out = rows.select("path", F.concat(*found).alias("f")).where(F.size("f") > 0).select("path", F.explode("f").alias("f"))
    return out.select("f.check", "path", "f.line", "f.col", "f.code", "f.params")


def check_push(messages: DataFrame, graph: DataFrame, ranges: DataFrame, cfg: PolicyConfig) -> DataFrame:
    """The findings of every commit that a push brings: range_id, hash, and a finding's columns with the first seven characters of the hash as path.

    ``messages(hash, content)``, ``graph(hash, parents)``, ``ranges(range_id, start, stop)``. A commit of several ranges is checked once
    and told for each. Commits without a message have no findings.
    """
    told = commits.in_ranges(graph, ranges)
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\n+\z", "")
    rows = messages.join(told.select("hash").distinct(), "hash", "left_semi").select(F.col("hash").cast("string").alias("path"), "content", text.alias("text"))
    found = check_messages(rows, cfg).withColumnRenamed("path", "_hash")
    out = found.join(told, F.col("_hash") == F.col("hash").cast("string"))
    return out.select("range_id", "hash", "check", F.substring("_hash", 1, 7).alias("path"), "line", "col", "code", "params")


def bad_bytes(df: DataFrame, content: str = "content") -> DataFrame:
    """Each byte that strict UTF-8 decoding cannot use: line, col (from 1; such a byte is a column), byte (hexadecimal)."""
    keep = [c for c in df.columns if c != content]
    rows = df.where(~F.is_valid_utf8(F.col(content).cast("string"))).withColumn("_b", F.decode(F.col(content), "ISO-8859-1")).select(*keep, "_b")
    # no byte of a longer character is a newline, so lines can be read one by one
    lines = explode_lines(rows, "_b")
    return lines.select(*keep, "line", F.explode(encoding.bad_places(F.col("line_text"))).alias("x")).select(*keep, "line", F.col("x.col").cast("long").alias("col"), F.col("x.byte").alias("byte"))
