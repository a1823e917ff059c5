"""Character classes as regular expressions and column expressions.

Every boolean test is one ``rlike`` on a literal class, so it runs in
generated code and never multiplies rows; only lines that pass it are split
into characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (first, last, step) of the invisible and non-standard white space code points.
INVISIBLE_RANGES = [
    (0x0B, 0x0D, 1), (0x7F, 0xA0, 33), (0xAD, 0x34F, 674), (0x61C, 0x115F, 2883), (0x1160, 0x17B4, 1620), (0x17B5, 0x180B, 86), (0x180C, 0x180E, 1),
    (0x1CBB, 0x1CBC, 1), (0x2000, 0x200F, 1), (0x202A, 0x202F, 1), (0x205F, 0x206F, 1), (0x2800, 0x3000, 2048), (0x3164, 0xFE00, 52380), (0xFE01, 0xFE0F, 1),
    (0xFFA0, 0xFFA0, 1), (0xFFF0, 0xFFF8, 1), (0xFFFC, 0xFFFC, 1), (0x133FC, 0x1D173, 40311), (0x1D174, 0x1D17A, 1), (0xE0000, 0xE007F, 1), (0xE0100, 0xE01EF, 1),
]
#: White space that is always allowed.
ALLOWED_BLANKS = {0x20, 0x09, 0x0A, 0x0D}
#: Invisible code points whose reported name differs from no Unicode name; the others have none.
NAMED_INVISIBLE = [
    0xA0, 0xAD, 0x34F, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x202A, 0x2030), 0x205F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, *range(0x206A, 0x2070), 0x2800, 0x3000, 0xFFA0,
]
#: Code points that the fixer turns into a plain space; other invisible ones are deleted.
SPACE_VARIANTS = [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x1680]
#: Emoji ranges; joiners and the emoji selector count as emoji but are not reported.
EMOJI_RANGES = [
    (0xFE0F, 0xFE0F), (0x200D, 0x200D), (0x20E3, 0x20E3), (0x2600, 0x26FF), (0x2700, 0x27BF), (0x2B50, 0x2B50), (0x2B55, 0x2B55), (0x2B1B, 0x2B1C),
    (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2199), (0x21A9, 0x21AA), (0x231A, 0x231B), (0x2328, 0x2328), (0x23CF, 0x23CF), (0x23E9, 0x23F3),
    (0x23F8, 0x23FA), (0x25AA, 0x25AB), (0x25B6, 0x25B6), (0x25C0, 0x25C0), (0x25FB, 0x25FE), (0x1F300, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF),
    (0x1F1E0, 0x1F1FF), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FA6F), (0x1FA70, 0x1FAFF), (0xE0020, 0xE007F),
]
EMOJI_SILENT = (0xFE0F, 0x200D)
#: Script ranges.
SCRIPTS = {
    "korean": [(0xAC00, 0xD7A3), (0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xD7B0, 0xD7FF)],
    "japanese": [(0x3041, 0x309F), (0x30A0, 0x30FF), (0x31F0, 0x31FF)],
    "chinese": [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF)],
    "english": [(0x41, 0x5A), (0x61, 0x7A)],
}

#: Look-alikes that depend on the locale, as (code point, ASCII).
LOCAL_LOOKALIKES = {
    0xA0: " ", 0xB4: "`", 0xD7: "x", 0x131: "i", 0x399: "I", 0x3F1: "p", 0x410: "A", 0x412: "B", 0x415: "E", 0x417: "3", 0x41A: "K", 0x41C: "M", 0x41D: "H", 0x41E: "O",
    0x420: "P", 0x421: "C", 0x422: "T", 0x423: "Y", 0x425: "X", 0x42C: "b", 0x430: "a", 0x431: "6", 0x433: "r", 0x435: "e", 0x43E: "o", 0x440: "p", 0x441: "c", 0x443: "y",
    0x445: "x", 0x2013: "-", 0x2018: "`", 0x2019: "`", 0x2035: "`", 0x30CE: "/", 0xFF01: "!", 0xFF03: "#", 0xFF08: "(", 0xFF09: ")", 0xFF0C: ",", 0xFF1A: ":", 0xFF1B: ";",
    0xFF1F: "?", 0xFF5E: "~",
}
#: What a locale's table leaves out of the above; its own script's letters and punctuation are ordinary there.
_CYRILLIC = [c for c in LOCAL_LOOKALIKES if 0x410 <= c <= 0x445]
NOT_LOOKALIKE = {
    "_default": [],
    "ja": [0xA0, 0x30CE, 0xFF08, 0xFF09, 0xFF1F, 0xFF5E],
    "ko": [0xA0, 0x2018, 0x2019],
    "ru": [0xA0, *_CYRILLIC, 0x2013],
    "zh-hans": [0xA0, 0x2013, 0x2018, 0x2019, 0xFF03, 0xFF0C, 0xFF1B, 0xFF1F],
    "zh-hant": [0xA0, 0x2018, 0x2019, 0x2035, 0xFF01, 0xFF08, 0xFF09, 0xFF0C, 0xFF1A, 0xFF1F],
}
#: Look-alikes in every locale that no decomposition gives.
COMMON_LOOKALIKES = {
    0xB8: ",", 0x17F: "f", 0x391: "A", 0x392: "B", 0x395: "E", 0x396: "Z", 0x397: "H", 0x39A: "K", 0x39C: "M", 0x39D: "N", 0x39F: "O", 0x3A1: "P", 0x3A4: "T", 0x3A5: "Y",
    0x3A7: "X", 0x3B1: "a", 0x3B3: "y", 0x3B9: "i", 0x3BD: "v", 0x3BF: "o", 0x3C1: "p", 0x3C3: "o", 0x3C5: "u", 0x3F2: "c", 0x3F3: "j", 0x3F9: "C", 0x405: "S", 0x406: "I",
    0x408: "J", 0x455: "s", 0x456: "i", 0x458: "j", 0x474: "V", 0x475: "v", 0x4AE: "Y", 0x4AF: "y", 0x4BB: "h", 0x4C0: "I", 0x4CF: "i", 0x501: "d", 0x50C: "G", 0x51B: "q",
    0x51C: "W", 0x51D: "w", 0x55D: "`", 0x561: "w", 0x566: "q", 0x570: "h", 0x578: "n", 0x57D: "u", 0x585: "o", 0x589: ":", 0x13A0: "D", 0x13A1: "R", 0x13A2: "T", 0x13A9: "Y",
    0x13AA: "A", 0x13AB: "J", 0x13AC: "E", 0x13B3: "W", 0x13B7: "M", 0x13BB: "H", 0x13C0: "G", 0x13C3: "Z", 0x13CF: "b", 0x13D2: "R", 0x13D4: "W", 0x13D5: "S", 0x13D9: "V",
    0x13DA: "S", 0x13DE: "L", 0x13DF: "C", 0x13E2: "P", 0x13E6: "K", 0x13F3: "G", 0x13F4: "B", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x201A: ",", 0x201B: "`", 0x2024: ".",
    0x2028: " ", 0x2029: " ", 0x2032: "`", 0x2039: "<", 0x203A: ">", 0x2043: "-", 0x2044: "/", 0x204E: "*", 0x2053: "~", 0x205A: ":", 0x2212: "-", 0x2215: "/", 0x2216: "\\",
    0x2217: "*", 0x2223: "I", 0x2228: "v", 0x222A: "U", 0x2236: ":", 0x223C: "~", 0x22A4: "T", 0x22C1: "v", 0x22C3: "U", 0x2373: "i", 0x2374: "p", 0x237A: "a", 0x2573: "X",
    0x2768: "(", 0x2769: ")", 0x276E: "<", 0x276F: ">", 0x2772: "(", 0x2773: ")", 0x2774: "{", 0x2775: "}", 0x2795: "+", 0x2796: "-", 0x29F5: "\\", 0x29F8: "/", 0x29F9: "\\",
    0x3007: "O", 0x3014: "(", 0x3015: ")", 0x30A0: "=", 0xA4D0: "B", 0xA4D1: "P", 0xA4D2: "d", 0xA4D3: "D", 0xA4D4: "T", 0xA4D6: "G", 0xA4D7: "K", 0xA4D9: "J", 0xA4DA: "C",
    0xA4DC: "Z", 0xA4DD: "F", 0xA4DF: "M", 0xA4E0: "N", 0xA4E1: "L", 0xA4E2: "S", 0xA4E3: "R", 0xA4E6: "V", 0xA4E7: "H", 0xA4EA: "W", 0xA4EB: "X", 0xA4EC: "Y", 0xA4EE: "A",
    0xA4F0: "E", 0xA4F2: "I", 0xA4F3: "O", 0xA4F4: "U",
}
#: The spaces that look like a plain one in every locale.
COMMON_SPACES = [*range(0x2000, 0x200B), 0x202F, 0x205F]
#: Blocks whose compatibility decomposition to one ASCII character makes a look-alike.
COMPATIBILITY_BLOCKS = [(0x2100, 0x214F), (0x2160, 0x217F), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x1FBF0, 0x1FBF9)]


@cache
def common_lookalikes() -> dict[int, str]:
    """Look-alikes of every locale: the listed ones, the spaces and those of the compatibility rule.

    A decomposition to l, 1 or | looks like I and one to 0 like O; m is told
    apart from its variants. Styled Greek letters go through their plain form.
    """
    out = {c: " " for c in COMMON_SPACES} | dict(COMMON_LOOKALIKES)
    for first, last in COMPATIBILITY_BLOCKS:
        for code in range(first, last + 1):
            plain = unicodedata.normalize("NFKD", chr(code))
            if len(plain) == 1 and plain != chr(code) and code not in LOCAL_LOOKALIKES:
                plain = {"l": "I", "1": "I", "|": "I", "0": "O"}.get(plain, plain)
                ascii_form = plain if ord(plain) < 128 else COMMON_LOOKALIKES.get(ord(plain)) or LOCAL_LOOKALIKES.get(ord(plain))
                if ascii_form and ascii_form != "m":
                    out[code] = ascii_form
    return out


def table_key(locale: str) -> str:
    """The look-alike table of a locale tag: subtags dropped from the right, then the Chinese and the default fallback."""
    key = locale
    while key:
        if key in NOT_LOOKALIKE and not key.startswith("_"):
            return key
        cut = max(key.rfind("-"), key.rfind("_"))
        key = key[:cut] if cut >= 0 else ""
    if locale in ("zh-CN", "zh_CN"):
        return "zh-hans"
    return "zh-hant" if locale.startswith("zh") else "_default"


def read_confusables(lines: Iterable[str]) -> dict[int, str]:
    """Pairs for ``extra`` from the lines of the Unicode Consortium's public ``confusables.txt`` (code ; target ; kind # remark):
    single characters beyond ASCII whose target is one ASCII character."""
    out: dict[int, str] = {}
    for raw in lines:
        fields = [f.strip() for f in raw.lstrip("\ufeff").partition("#")[0].split(";")]
        if len(fields) < 2 or not re.fullmatch(r"[0-9A-Fa-f]{4,6}", fields[0]) or not re.fullmatch(r"[0-9A-Fa-f]{4,6}", fields[1]):
            continue
        code, target = int(fields[0], 16), int(fields[1], 16)
        if code > 127 and 32 <= target < 127:
            out[code] = chr(target)
    return out


def lookalikes(locale: str = "", extra: dict[int, str] | None = None) -> dict[int, str]:
    """All look-alikes in a locale. ``extra`` adds pairs, such as those of a full confusables file."""
    left_out = set(NOT_LOOKALIKE[table_key(locale)])
    local = {c: a for c, a in LOCAL_LOOKALIKES.items() if c not in left_out}
    return common_lookalikes() | local | (extra or {})


@cache
def invisible_codes() -> tuple[int, ...]:
    return tuple(sorted({c for a, b, step in INVISIBLE_RANGES for c in range(a, b + 1, step)} - ALLOWED_BLANKS))


def invisible_name(code: int) -> str:
    return unicodedata.name(chr(code), "") if code in NAMED_INVISIBLE else ""


def _runs(codes) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [tuple(x) for x in out]


def char_class(ranges) -> str:
    """A Java character class of (first, last) pairs."""
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" if a != b else f"\\x{{{a:X}}}" for a, b in ranges) + "]"


# A class is tested range by range, so a lookahead first passes over the characters that most texts are made of.
INVISIBLE = r"(?![\x20-\x7E])" + char_class(_runs(invisible_codes()))
EMOJI = r"(?![\x{0}-\x{1FFF}])" + char_class(EMOJI_RANGES)
EMOJI_REPORTED = r"(?![\x{0}-\x{1FFF}])" + char_class([r for r in EMOJI_RANGES if r[0] not in EMOJI_SILENT])


def lookalike_class(locale: str = "", extra: dict[int, str] | None = None) -> str:
    return r"(?![\x00-\x7F])" + char_class(_runs(lookalikes(locale, extra)))


def code_point(c: Column) -> Column:
    """The code point of a one-character string."""
    return F.ascii(c)


def u_plus(code: Column) -> Column:
    return F.format_string("U+%04X", code)


def is_invisible(c: Column) -> Column:
    return c.rlike(f"^{INVISIBLE}$")


def contains_invisible(text: Column) -> Column:
    return text.rlike(INVISIBLE)


def contains_lookalike(text: Column, locale: str = "") -> Column:
    return text.rlike(lookalike_class(locale))


def contains_emoji(text: Column) -> Column:
    return text.rlike(EMOJI)


def is_space_variant(c: Column) -> Column:
    return c.isin([chr(x) for x in SPACE_VARIANTS])


def name_of_invisible(code: Column) -> Column:
    pairs = [x for c in NAMED_INVISIBLE for x in (F.lit(c), F.lit(invisible_name(c)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(""))


def lookalike_of(c: Column, locale: str = "", extra: dict[int, str] | None = None) -> Column:
    """The ASCII character that a one-character string looks like, else null."""
    table = lookalikes(locale, extra)
    plain = F.translate(c, "".join(map(chr, table)), "".join(table.values()))
    return F.when(c.rlike(f"^{lookalike_class(locale, extra)}$"), plain)


def without_invisible(text: Column) -> Column:
    """Space variants as plain spaces, other invisible characters dropped, in one pass."""
    rest = [c for c in invisible_codes() if c not in SPACE_VARIANTS]
    return F.translate(text, "".join(map(chr, [*SPACE_VARIANTS, *rest])), " " * len(SPACE_VARIANTS))


def without_lookalikes(text: Column, locale: str = "", extra: dict[int, str] | None = None) -> Column:
    table = lookalikes(locale, extra)
    return F.translate(text, "".join(map(chr, table)), "".join(table.values()))
