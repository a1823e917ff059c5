"""Natural-language tests by script, as column expressions."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import SCRIPTS, char_class

#: Locale codes and the language they require.
LANGUAGES = {"ko": "korean", "en": "english", "ja": "japanese", "zh": "chinese", "zh-hans": "chinese", "zh-hant": "chinese"}
BCP47 = {"korean": "ko", "english": "en", "japanese": "ja", "chinese": "zh"}
#: Comments that start so are technical whatever their language.
TECHNICAL_PREFIXES = (
    "todo fixme hack note: xxx bug nolint noqa nosec noinspection go:generate go:build go:embed go:linkname +build eslint- tslint: prettier-ignore "
    "http:// https:// ftp:// @param @return @throws @type @deprecated @ts-ignore @ts-nocheck @ts-expect-error"
).split() + ["suppress warnings"]
#: Allowed words that are replaced by chained expressions, at most.
CHAINED = 20
#: Order in which equal counts are resolved.
ORDER = ("korean", "japanese", "chinese", "english")
CLASS = {k: char_class(v) for k, v in SCRIPTS.items()}


def normalize_locale(s: str) -> str:
    """Language of a code or full name (``any`` included), else empty."""
    s = s.strip().lower()
    return LANGUAGES.get(s) or (s if s in BCP47 or s == "any" else "")


def language_to_bcp47(name: str) -> str:
    return BCP47.get(name, name)


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def has_script(text: Column, language: str) -> Column:
    return text.rlike(CLASS[language]) if language in CLASS else F.lit(False)


def is_tags_only(text: Column) -> Column:
    """Only ``<...>`` tags with blanks between, after an optional ``/`` or ``/ ``."""
    body = trimmed(F.regexp_replace(trimmed(text), r"^/ ?", ""))
    return body.rlike(r"(?U)\A(?:<[^>]*>\s*)+\z")


def has_content(text: Column, least: int, extra: list[str] | None = None) -> Column:
    """Enough letters to judge, and neither tags only nor a technical comment."""
    prefixes = "|".join(re.escape(p.lower()) for p in [*TECHNICAL_PREFIXES, *(extra or [])] if p)
    # what trimming leaves at the end matters only to prefixes that end in white space
    late = any(p != p.rstrip() for p in extra or [])
    technical = F.lower(trimmed(text) if late else text).rlike(rf"(?U)\A\s*+(?:{prefixes})")
    return (F.char_length(text) >= least) & ~(text.contains("<") & is_tags_only(text)) & ~technical & (F.regexp_count(text, F.lit(r"\p{IsAlphabetic}")) >= least)


def required(text: Column, language: str, least: int, extra: list[str] | None = None) -> Column:
    """struct(ok, has_content): does the text meet the required language?"""
    content = has_content(text, least, extra)
    if language in ("", "any"):
        return F.when(content, F.struct(F.lit(True).alias("ok"), F.lit(True).alias("has_content"))).otherwise(F.struct(F.lit(True).alias("ok"), F.lit(False).alias("has_content")))
    pair = lambda ok, has: F.struct(F.lit(ok).alias("ok"), F.lit(has).alias("has_content"))
    any_script = text.rlike("|".join(CLASS.values()))
    if language == "english":
        foreign = text.rlike("|".join(CLASS[k] for k in ("korean", "japanese", "chinese")))
        judged = F.when(foreign, pair(False, True)).when(has_script(text, "english"), pair(True, True)).otherwise(pair(True, False))
    else:
        judged = F.when(has_script(text, language), pair(True, True)).when(~any_script, pair(True, False)).otherwise(pair(False, True))
    return F.when(content, judged).otherwise(pair(True, False))


def is_foreign(text: Column, language: str, least: int, extra: list[str] | None = None) -> Column:
    """Whether a text has content and fails the required language; what a class of characters settles is asked first."""
    if language in ("", "any"):
        return F.lit(False)
    if language == "english":
        wrong = text.rlike("|".join(CLASS[k] for k in ("korean", "japanese", "chinese")))
    else:
        wrong = ~has_script(text, language) & text.rlike("|".join(CLASS.values()))
    return (F.char_length(text) >= least) & wrong & has_content(text, least, extra)


def traits(text: Column, least: int, extra: list[str] | None = None) -> Column:
    """struct(content, korean, japanese, chinese, english): all that ``judged`` asks of a text, found once."""
    return F.struct(has_content(text, least, extra).alias("content"), *[has_script(text, k).alias(k) for k in ORDER])


def judged(t: Column, language: str) -> Column:
    """struct(ok, has_content) by ``traits``, as ``required`` gives it."""
    foreign, some = t["korean"] | t["japanese"] | t["chinese"], t["korean"] | t["japanese"] | t["chinese"] | t["english"]
    if language in ("", "any"):
        ok, has = F.lit(True), t["content"]
    elif language == "english":
        ok, has = ~t["content"] | ~foreign, t["content"] & some
    else:
        ok, has = ~t["content"] | (t[language] if language in CLASS else F.lit(False)) | ~some, t["content"] & some
    return F.struct(ok.alias("ok"), has.alias("has_content"))


def script_counts(text: Column) -> dict[str, Column]:
    return {k: F.regexp_count(text, F.lit(CLASS[k])) for k in ORDER}


def most_frequent(n: dict[str, Column]) -> Column:
    """The script with the largest count; at a tie the first of ORDER; ``unknown`` without any."""
    most = F.greatest(*n.values())
    out = F.when(most == 0, "unknown")
    for k in ORDER:
        out = out.when(n[k] == most, k)
    return out


def dominant(text: Column) -> Column:
    """The script with most characters, see ``most_frequent``."""
    return most_frequent(script_counts(text))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


class Words:
    """Finds all words of a list in one pass over a text: a trie over code points whose nodes know where to go on when a text leaves it."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for i, w in enumerate(words):
            at = 0
            for c in w:
                at = self.next[at].setdefault(c, len(self.next))
                if at == len(self.next):
                    self.next.append({})
                    self.ends.append(-1)
            self.ends[at] = i
        # breadth first: a node's fallback is the longest word beginning that ends its path, ``shorter`` the next word among those
        self.back, self.shorter = [0] * len(self.next), [-1] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            for c, to in self.next[at].items():
                back = self.back[at]
                while back and c not in self.next[back]:
                    back = self.back[back]
                self.back[to] = self.next[back].get(c, 0) if at else 0
                queue.append(to)
            self.shorter[at] = self.back[at] if self.ends[self.back[at]] >= 0 else self.shorter[self.back[at]]

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(word, start) of every occurrence, overlapping ones included."""
        at, follow, back, ends, shorter = 0, self.next, self.back, self.ends, self.shorter
        for i, c in enumerate(text):
            while at and c not in follow[at]:
                at = back[at]
            at = follow[at].get(c, 0)
            hit = at if ends[at] >= 0 else shorter[at]
            while hit > 0:
                w = ends[hit]
                yield w, i + 1 - len(self.words[w])
                hit = shorter[hit]


def _blanked(text: str, words: Words) -> str:
    """``words`` are in their order: a word starts nowhere that an earlier one or its own last place covers."""
    whole = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    latin = lambda c: c.isascii() and c.isalpha()
    gone = bytearray(len(text))
    for w, at in sorted(words.find(whole)):
        end = at + len(words.words[w])
        if not gone[at] and not (at and latin(text[at - 1])) and not (end < len(text) and latin(text[end])):
            gone[at:end] = b"\1" * (end - at)
    return "".join(" " if g else c for g, c in zip(gone, text)) if any(gone) else text


def strip_allowed_words(text: Column, words: list[str]) -> Column:
    """Allowed words replaced by spaces, longest first, where no ASCII letter touches them.

    A few words of ASCII letters only are exact as chained regular expressions; other
    words can adjoin each other, which needs the original text at each step. Those, and long lists, are
    found in one pass over a text, whatever their number.
    """
    ordered = sorted({w.lower() for w in words if w}, key=lambda w: (-len(w), w))
    if not ordered:
        return text
    if len(ordered) <= CHAINED and all(w.isascii() and w.isalpha() for w in ordered):
        for w in ordered:
            text = F.regexp_replace(text, f"(?i)(?<![A-Za-z]){w}(?![A-Za-z])", " " * len(w))
        return text

    @F.pandas_udf(T.StringType())
    def strip(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = Words(ordered)  # once a task
        for s in parts:
            yield s.map(lambda t: None if t is None else _blanked(t, found))

    return strip(text)


def is_technical(text: Column) -> Column:
    """Whether a string is a path or media type (it has a slash) or a constant's name (ASCII without small letters)."""
    return text.contains("/") | text.rlike(r"\A[\x00-\x60\x7B-\x7F]*\z")
