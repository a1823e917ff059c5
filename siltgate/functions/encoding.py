"""Byte-level text tests through the one-to-one ISO-8859-1 view of binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Well-formed UTF-8 by lead byte and continuation bytes only: overlong forms and surrogates pass.
STRUCTURAL = r"[\x00-\x7F]+|[\xC0-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF7][\x80-\xBF]{3}"
#: Well-formed UTF-8 by the Unicode standard's table.
STRICT = r"[\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
#: Leading bytes of common binary formats (hex), from their public specifications.
SIGNATURES = (
    "89504E470D0A1A0A FFD8FF 474946383761 474946383961 424D 49492A00 4D4D002A 00000100 25504446 504B0304 504B0506 504B0708 1F8B08 425A68 FD377A585A00 377ABCAF271C 526172211A07 "
    "28B52FFD 7F454C46 4D5A CAFEBABE FEEDFACE FEEDFACF CEFAEDFE CFFAEDFE 0061736D 4F676753 664C6143 494433 1A45DFA3 D0CF11E0A1B11AE1 53514C69746520666F726D6174203300 774F4646 774F4632 00010000 4F54544F 213C617263683E"
).split()
BOM = "EFBBBF"


def _bytes(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def is_structural_utf8(content: Column) -> Column:
    return F.regexp_replace(_bytes(content), STRUCTURAL, "") == ""


def bad_byte_count(content: Column) -> Column:
    """Bytes that strict UTF-8 decoding cannot use."""
    return F.length(F.regexp_replace(_bytes(content), STRICT, ""))


def bad_places(line: Column) -> Column:
    """array<struct<col, byte>> for a line in the ISO-8859-1 view: one match reads it as characters and single bad bytes,
    whose places are their columns."""
    one = "[\\x00-\\x7F]|" + STRICT.split("|", 1)[1]
    units = F.regexp_extract_all(line, F.lit(f"(?s){one}|."), F.lit(0))
    bad = F.transform(units, lambda c, i: F.when((F.length(c) == 1) & (c >= "\x80"), F.struct((i + 1).alias("col"), F.hex(F.encode(c, "ISO-8859-1")).alias("byte"))))
    # lines without a bad byte are not taken apart
    return F.when(F.length(F.regexp_replace(line, STRICT, "")) > 0, F.filter(bad, lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<col:int,byte:string>>"))


def without_bad_bytes(content: Column) -> Column:
    good = F.array_join(F.regexp_extract_all(_bytes(content), F.lit(f"({STRICT})"), F.lit(1)), "")
    return F.decode(F.encode(good, "ISO-8859-1"), "UTF-8")


def lossy_text(content: Column) -> Column:
    """Text of bytes, with U+FFFD for what is not UTF-8."""
    return F.make_valid_utf8(content.cast("string"))


def starts_with_bytes(content: Column, hexed: str) -> Column:
    return F.substring(content, 1, len(hexed) // 2) == F.unhex(F.lit(hexed))


def has_bom(content: Column) -> Column:
    return F.coalesce(starts_with_bytes(content, BOM), F.lit(False))


def is_binary(content: Column) -> Column:
    """A known signature at the start, or a NUL byte anywhere; empty content is text."""
    signed = F.lit(False)
    for s in SIGNATURES:
        signed = signed | starts_with_bytes(content, s)
    webp = starts_with_bytes(content, "52494646") & (F.substring(content, 9, 4) == F.unhex(F.lit("57454250")))
    # a search in the binary column itself steps by characters and can pass over a byte after a cut-off one
    nul = F.contains(_bytes(content), F.lit("\x00"))
    return F.coalesce((F.length(content) > 0) & (signed | webp | nul), F.lit(False))


#: Legacy charsets by what their texts are made of: all units that are valid, where two-byte units mostly lie, and frequent ones
#: (public statistics of the languages: particles, common characters, comma and full stop).
HIGH = r"[\x81-\xFE][\x40-\x7E\x80-\xFE]"
CHARSETS = {
    "EUC-KR": (r"[\x00-\x7F]|[\x81-\xFE][\x41-\x5A\x61-\x7A\x81-\xFE]", r"[\xB0-\xC8][\xA1-\xFE]", "이다의는에을가고한하지로도사를어기은리인서자해있"),
    "EUC-JP": (r"[\x00-\x7F]|[\xA1-\xFE][\xA1-\xFE]|\x8E[\xA1-\xDF]|\x8F[\xA1-\xFE]{2}", r"[\xA4\xA5\xB0-\xCF][\xA1-\xFE]", "のにをはがとでしたてるいすまなれからもこん、。"),
    "Shift_JIS": (r"[\x00-\x7F\xA0-\xDF]|[\x81-\x9F\xE0-\xFC][\x40-\x7E\x80-\xFC]", r"[\x82\x83\x88-\x97][\x40-\x7E\x80-\xFC]", "のにをはがとでしたてるいすまなれからもこん、。"),
    "GB18030": (r"[\x00-\x80]|[\x81-\xFE][\x40-\x7E\x80-\xFE]|[\x81-\xFE][0-9][\x81-\xFE][0-9]", r"[\xB0-\xD7][\xA1-\xFE]", "的一是了不在有我他这个中来上大为和国地到，。"),
    "Big5": (r"[\x00-\x80]|[\x81-\xFE][\x40-\x7E\xA1-\xFE]", r"[\xA4-\xC6][\x40-\x7E\xA1-\xFE]", "的一是了不在有我他這個中來上大為和國地到，。"),
}
#: What a frequent unit counts beside one that merely lies where most do, what a lone letter of ISO-8859-1 counts, and
#: what letters that stand together in a word with ASCII ones count.
FREQUENT, LONE, JOINED = 4, 2, 6
#: Runs of ASCII letters and bytes beyond ASCII that hold one of these, and those of them that can be words of ISO-8859-1:
#: letters alone, all capitals or small ones after the first.
RUNS = r"(?<![A-Za-z\x80-\xFF])[A-Za-z]*+[\x80-\xFF][A-Za-z\x80-\xFF]*+"
WORD = r"\A(?:[A-Z\xC0-\xD6\xD8-\xDE]?[a-z\xDF-\xF6\xF8-\xFF]*|[A-Z\xC0-\xD6\xD8-\xDF]+)\z"


def _units(codec: str, letters: str) -> str:
    """A class of two-byte units, as they stand in the ISO-8859-1 view."""
    hexed = sorted({c.encode(codec).hex().upper() for c in letters if len(c.encode(codec)) == 2})
    return "|".join(f"\\x{h[:2]}\\x{h[2:]}" for h in hexed)


def guessed_charset(content: Column) -> Column:
    """The likeliest charset of bytes that are no UTF-8: ISO-8859-1 or one of ``CHARSETS``.

    A charset with an invalid unit is out. Of the rest each has a score: its units that lie where the language's
    characters do, and its frequent ones more, over all its two-byte units; for ISO-8859-1, which
    allows everything, letters beyond ASCII that stand alone among ASCII ones or together in what can be a word, over all bytes beyond ASCII.
    """
    view = _bytes(content)
    high = F.regexp_count(view, F.lit(r"[\x80-\xFF]"))
    lone = F.regexp_count(view, F.lit(r"(?<![\x80-\xFF])[\xA0-\xFF](?![\x80-\xFF])"))
    words = F.filter(F.regexp_extract_all(view, F.lit(RUNS), F.lit(0)), lambda x: x.rlike(WORD))
    together = lambda xs: F.regexp_count(F.array_join(xs, " "), F.lit(r"(?<=[\x80-\xFF])[\x80-\xFF]|[\x80-\xFF](?=[\x80-\xFF])"))
    joined, bare = together(F.filter(words, lambda x: x.rlike("[A-Za-z]"))), together(F.filter(words, lambda x: ~x.rlike("[A-Za-z]")))
    latin = F.lit(float(LONE)) * (lone + bare) + F.lit(float(JOINED)) * joined
    scores = [F.struct((latin / F.greatest(high, F.lit(1))).alias("score"), F.lit(0).alias("order"), F.lit("ISO-8859-1").alias("name"))]
    for i, (name, (unit, home, letters)) in enumerate(CHARSETS.items()):
        pairs = F.regexp_extract_all(view, F.lit(r"[\x81-\x9F\xE0-\xFC][\x40-\x7E\x80-\xFC]" if name == "Shift_JIS" else HIGH), F.lit(0))
        share = lambda cls, p=pairs: F.size(F.filter(p, lambda x: x.rlike(rf"^(?:{cls})\z"))) / F.greatest(F.size(p), F.lit(1))
        score = F.when(view.rlike(rf"\A(?:{unit})*+\z"), share(home) + F.lit(float(FREQUENT)) * share(_units(name, letters)))
        scores.append(F.struct(score.alias("score"), F.lit(-1 - i).alias("order"), F.lit(name).alias("name")))
    # null scores are the smallest; equal ones go to the first listed
    return F.array_max(F.array(*scores))["name"]


def utf8_report(content: Column) -> Column:
    """struct(valid, has_bom, detected_charset, confidence): the charset by the mark, by validity or as ``guessed_charset`` has it (confidence 0)."""
    valid = (F.length(content) == 0) | is_structural_utf8(content)
    return F.struct(valid.alias("valid"), has_bom(content).alias("has_bom"), F.when(valid, "utf-8").otherwise(guessed_charset(content)).alias("detected_charset"), F.when(valid, 100).otherwise(0).alias("confidence"))
