"""Automatic fixes as projections; nothing is written in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PolicyConfig
from ..functions import chars, encoding, globs, language
from .messages import trailer_email


def drop_coauthors(text: Column, patterns: list[str]) -> Column:
    """Without matching trailers; blank lines at the end shrink to one newline in any case."""
    regexes = [r for p in patterns if (r := globs.fnmatch_regex(p.lower())) is not None]

    def keep(line: Column) -> Column:
        trailer = language.trimmed(line)
        email = F.lower(language.trimmed(trailer_email(trailer)))
        hit = F.lit(False)
        for r in regexes:
            hit = hit | email.rlike(f"^(?s:{r})\\z")
        return ~(F.lower(trailer).startswith("co-authored-by:") & hit)

    kept = F.array_join(F.filter(F.split(text, "\n", -1), keep), "\n")
    return F.regexp_replace(kept, r"\n{2,}\z", "\n")


def fixed_message(content: Column, cfg: PolicyConfig) -> Column:
    """Bad bytes, trailers, invisible and look-alike characters, in that order."""
    m = cfg.commit_message
    text = encoding.without_bad_bytes(content) if m.no_bad_runes else encoding.lossy_text(content)
    text = drop_coauthors(text, m.coauthor_patterns) if m.no_ai_coauthor else text
    text = chars.without_invisible(text) if m.no_unicode_spaces else text
    return chars.without_lookalikes(text, m.locale) if m.no_ambiguous_chars else text


def fixed_file(content: Column, cfg: PolicyConfig) -> Column:
    """Bad bytes always; invisible and look-alike characters by the encoding flags, with the message locale's table."""
    text = encoding.without_bad_bytes(content)
    text = chars.without_invisible(text) if cfg.encoding.no_invisible_chars else text
    return chars.without_lookalikes(text, cfg.commit_message.locale) if cfg.encoding.no_ambiguous_chars else text


def fix_table(df: DataFrame, fixed: Column, content: str = "content") -> DataFrame:
    """path, original, fixed of the rows that the fix changes (a table, for a later write)."""
    out = df.select("path", encoding.lossy_text(F.col(content)).alias("original"), fixed.alias("fixed"))
    return out.where("original <> fixed")
