"""Whole-file checks over ``corpus(path, content, text)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IMAGES, PolicyConfig, normalize_policy
from ..functions import chars, encoding, globs, language
from . import directives
from .comments import parse_comments, unit_texts
from .editorconfig import Section, definitions
from .findings import finding, union
from .unicode import emoji_occurrences, invisible_occurrences, lookalike_occurrences


def ignored(path: Column, cfg: PolicyConfig, own: list[str] | None = None) -> Column:
    return globs.matches_any(path, [*cfg.global_ignore, *(own or [])])


def policy_for(path: Column, cfg: PolicyConfig) -> Column:
    """allow, lfs or block: the first rule with the extension, images allowed, else the default."""
    ext = globs.ext_lower(path)
    out = None
    for exts, policy in cfg.binary_file.rules:
        cond = ext.isin([e.lower() for e in exts])
        out = F.when(cond, normalize_policy(policy)) if out is None else out.when(cond, normalize_policy(policy))
    images = ext.isin(IMAGES)
    out = F.when(images, "allow") if out is None else out.when(images, "allow")
    return out.otherwise(normalize_policy(cfg.binary_file.default_policy))


def binary_findings(paths: DataFrame, cfg: PolicyConfig, attributes: DataFrame | None = None) -> DataFrame:
    """``paths(path)`` of binary files to findings; ``attributes(path, filter)`` tells what large-file storage tracks."""
    rows = paths.where(~ignored(F.col("path"), cfg, cfg.binary_file.ignore_files)).withColumn("policy", policy_for(F.col("path"), cfg)).where("policy <> 'allow'")
    if attributes is not None:
        tracked = attributes.where(F.col("filter") == "lfs").select("path").distinct()
        lfs, block = rows.where("policy = 'lfs'").join(tracked, "path", "left_anti"), rows.where("policy = 'block'")
        rows = lfs.unionByName(block)
    return finding(rows, "binary", F.concat(F.lit("binary_"), F.col("policy")))


def binary_files(corpus: DataFrame, cfg: PolicyConfig, attributes: DataFrame | None = None) -> DataFrame:
    return binary_findings(corpus.where(encoding.is_binary(F.col("content"))).select("path"), cfg, attributes)


def encoding_findings(corpus: DataFrame, cfg: PolicyConfig, sections: list[Section] | None = None) -> DataFrame:
    """Text files that are not structurally UTF-8; files with another configured charset are left out."""
    rows = corpus.where(~ignored(F.col("path"), cfg, cfg.encoding.ignore_files))
    if sections:
        rows = definitions(rows, sections).where(F.coalesce(F.col("charset"), F.lit("utf-8")).isin("utf-8", "utf-8-bom"))
    bad = rows.where(~encoding.is_binary(F.col("content")) & (F.length("content") > 0) & ~encoding.is_structural_utf8(F.col("content")))
    return finding(bad, "encoding", "not_utf8", bad_bytes=encoding.bad_byte_count(F.col("content")), charset=encoding.guessed_charset(F.col("content")))


def unicode_findings(corpus: DataFrame, cfg: PolicyConfig) -> DataFrame:
    """One finding for each invisible or look-alike character."""
    rows = corpus.where(~ignored(F.col("path"), cfg, cfg.encoding.ignore_files)).select("path", "text")
    parts = []
    if cfg.encoding.no_invisible_chars:
        parts.append(finding(invisible_occurrences(rows), "unicode", "invisible_char", "line", "col", char=chars.u_plus(F.col("code_point")), name=F.col("name")))
    if cfg.encoding.no_ambiguous_chars:
        parts.append(finding(lookalike_occurrences(rows, locale=cfg.encoding.locale), "unicode", "ambiguous_char", "line", "col", char=chars.u_plus(F.col("code_point")), looks_like=F.col("looks_like")))
    return union(parts) if parts else finding(rows.where("false"), "unicode", "none")


def comment_scope(corpus: DataFrame, cfg: PolicyConfig) -> DataFrame:
    """The files whose comments are checked, with the language each must use: the first matching rule's, else the default."""
    c = cfg.comment_language
    from .comments.lexers import extensions_for

    exts = [*c.extensions, *extensions_for(c.languages)]
    rules = [(p, lang) for p, lang in c.file_languages if lang]
    rows = corpus.where(globs.has_extension(F.col("path"), exts) & ~ignored(F.col("path"), cfg, [*c.ignore_files, *cfg.comment_ignore]))
    return rows.withColumn("required", globs.first_match(F.col("path"), rules, c.required_language))


def comment_units(corpus: DataFrame, cfg: PolicyConfig, added: DataFrame | None = None) -> DataFrame:
    """Units of the checked files, with directives applied; with ``added(path, line)`` those that have an added line.

    Which comments make a unit, and which units count, is found without their texts; those are read at the end.
    """
    scope = comment_scope(corpus, cfg)
    comments = directives.outlined(parse_comments(scope))
    # the required language depends on the path alone, so no join is needed
    rules = [(p, lang) for p, lang in cfg.comment_language.file_languages if lang]
    default = globs.first_match(F.col("path"), rules, cfg.comment_language.required_language)
    found = directives.outlines(directives.states(comments, default), cfg.comment_language.check_strings)
    return unit_texts(scope, found if added is None else directives.touched(found, added))


def judge_units(units: DataFrame, cfg: PolicyConfig) -> DataFrame:
    """Units in another language than their own, after allowed words are taken out."""
    c = cfg.comment_language
    rows = units.where("kind <> 'String'").withColumn("said", language.strip_allowed_words(F.col("text"), c.allowed_words))
    # only the unit's own language is asked, and what a class of characters settles comes first
    foreign = None
    for lang in language.ORDER:
        wrong = language.is_foreign(F.col("said"), lang, c.min_length, c.skip_directives)
        foreign = F.when(F.col("lang") == lang, wrong) if foreign is None else foreign.when(F.col("lang") == lang, wrong)
    wrong = rows.where(foreign)
    parts = [finding(wrong, "comment_language", "language", "line", required=F.col("lang"), detected=language.dominant(F.col("said")), text=language.truncate(F.col("text"), 80))]
    if c.no_emoji:
        parts.append(finding(emoji_occurrences(rows.withColumnRenamed("line", "unit_line")), "comment_language", "emoji", F.col("unit_line") + F.col("line") - 1, "col", char=chars.u_plus(F.col("code_point"))))
    return union(parts)


def comment_language(corpus: DataFrame, cfg: PolicyConfig) -> DataFrame:
    return judge_units(comment_units(corpus, cfg), cfg)
