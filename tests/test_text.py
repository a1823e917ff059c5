"""Characters, encodings, languages and globs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltgate.functions import chars, encoding, globs, language


def one(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()


def test_character_classes(spark):
    invisible = [0x0B, 0x0C, 0x7F, 0xA0, 0xAD, 0x200B, 0x200D, 0x202E, 0x2060, 0x3000, 0xFE0F, 0xFFA0, 0x1D173, 0xE0001, 0xE01EF]
    visible = [0x20, 0x09, 0x41, 0xFEFF, 0x2028, 0x2029, 0xE9, 0xAC00, 0x1F600]
    got = one(spark, [(chr(c),) for c in invisible + visible], "c string", x=chars.is_invisible(F.col("c")))
    assert [r.x for r in got] == [True] * len(invisible) + [False] * len(visible)
    assert len(chars.invisible_codes()) == 464 - 1 or len(chars.invisible_codes()) == 464
    assert chars.invisible_name(0x200B) == "ZERO WIDTH SPACE" and chars.invisible_name(0x0B) == ""


def test_lookalikes_by_locale(spark):
    assert chars.lookalikes("en")[0x410] == "A" and chars.lookalikes("ko")[0x43E] == "o"
    assert 0x410 not in chars.lookalikes("ru") and 0x2018 not in chars.lookalikes("ko") and 0xFF0C not in chars.lookalikes("zh-CN")
    assert 0xFF41 in chars.lookalikes("ja") and chars.lookalikes("x")[0x1D400] == "A" and chars.lookalikes("x")[0x1D7CE] == "O"
    assert [chars.table_key(x) for x in ("zh-hans-x", "zh-CN", "zh-TW", "fr", "ko_KR", "")] == ["zh-hans", "zh-hans", "zh-hant", "_default", "ko", "_default"]
    got = one(spark, [("А",), ("A",), ("한",), ("х",), ("\U0001d41a",)], "c string", x=chars.lookalike_of(F.col("c"), "en"))
    assert [r.x for r in got] == ["A", None, None, "x", "a"]
    text = "pаss​word x\U0001d41a"
    assert one(spark, [(text,)], "c string", x=chars.without_lookalikes(chars.without_invisible(F.col("c")), "en"))[0].x == "password xa"


def test_emoji(spark):
    yes, no = "😀🚀✅⭐❤🇰™♠🧪", "A©®한1é"
    got = one(spark, [(c,) for c in yes + no], "c string", x=chars.contains_emoji(F.col("c")))
    assert [r.x for r in got] == [True] * len(yes) + [False] * len(no)


def structural(b: bytes) -> bool:
    i = 0
    while i < len(b):
        n = 1 if b[i] < 0x80 else 2 if 0xC0 <= b[i] < 0xE0 else 3 if 0xE0 <= b[i] < 0xF0 else 4 if 0xF0 <= b[i] < 0xF8 else 0
        if not n or i + n > len(b) or any(not 0x80 <= x < 0xC0 for x in b[i + 1 : i + n]):
            return False
        i += n
    return True


def test_utf8_tests_against_byte_scanners(spark):
    rng = random.Random(1)
    pool = [b"a", b"\xc3\xa9", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf0\x9f\x98\x80", b"\xf7\xbf\xbf\xbf", b"\xff", b"\xe2\x82", b"\n", b"\x80"]
    rows = [b"".join(rng.choice(pool) for _ in range(rng.randint(0, 8))) for _ in range(400)]
    got = one(spark, [(bytearray(r),) for r in rows], "c binary", s=encoding.is_structural_utf8(F.col("c")), n=encoding.bad_byte_count(F.col("c")), f=encoding.without_bad_bytes(F.col("c")))
    for r, g in zip(rows, got):
        kept, bad, i = b"", 0, 0
        while i < len(r):
            for n in (1, 2, 3, 4):
                try:
                    r[i : i + n].decode()
                    kept, i = kept + r[i : i + n], i + n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                bad, i = bad + 1, i + 1
        assert (g.s, g.n, g.f) == (structural(r), bad, kept.decode())


def test_binary_and_bom(spark):
    rows = [(b"",), (b"text",), (b"a\0b",), (b"\x7fELF\1",), (b"\x89PNG\r\n\x1a\n",), (b"\xef\xbb\xbfx",)]
    got = one(spark, [(bytearray(r[0]),) for r in rows], "c binary", b=encoding.is_binary(F.col("c")), m=encoding.has_bom(F.col("c")))
    assert [r.b for r in got] == [False, False, True, True, True, False] and got[5].m and not got[1].m


@pytest.mark.parametrize("path,patterns,want", [
    ("src/a.go", ["*.go"], True), ("src/a.go", ["src/*.go"], True), ("src/b/a.go", ["src/*.go"], False), ("src/b/a.go", ["src/**/*.go"], True), ("src/a.go", ["src/**/a.go"], True),
    ("a//b", ["a/b"], True), ("x", [], False), ("locales/ko/x.json", ["locales/**"], True), ("f1.txt", ["f[0-9].txt"], True), ("fa.txt", ["f[^0-9].txt"], True), ("f*.txt", ["f\\*.txt"], True),
    ("f.txt", ["f[", "f.txt\\"], False), ("f]", ["f[]]"], False), ("vendor", ["vendor/**"], True),
])
def test_globs(spark, path, patterns, want):
    assert one(spark, [(path,)], "p string", x=globs.matches_any(F.col("p"), patterns))[0].x is want


def test_paths(spark):
    rows = [("a/b.tar.GZ",), ("",), ("///",), ("a/.bashrc",), ("x/",), ("Dockerfile.dev",), ("d/my.dockerfile",)]
    got = one(spark, rows, "p string", b=globs.base(F.col("p")), e=globs.ext_lower(F.col("p")), o=globs.ext_of(F.col("p")), d=globs.has_extension(F.col("p"), ["dockerfile", ".gz"]))
    assert [r.b for r in got] == ["b.tar.GZ", ".", "/", ".bashrc", "x", "Dockerfile.dev", "my.dockerfile"]
    assert [r.e for r in got][:4] == [".gz", ".", "", ".bashrc"] and [r.o for r in got][3] == ""
    assert [r.d for r in got] == [True, False, False, False, False, True, True]


TEXTS = {"korean": "한국어로 작성된 설명", "japanese": "これは日本語の説明です", "chinese": "这是中文的说明文字", "english": "This is an explanation"}


@pytest.mark.parametrize("need", list(TEXTS))
def test_required_language(spark, need):
    got = one(spark, [(k, t) for k, t in TEXTS.items()], "k string, t string", k=F.col("k"), j=language.required(F.col("t"), need, 5), d=language.dominant(F.col("t")))
    for r in got:
        ok = r.k == need or (need == "chinese" and r.k == "japanese")  # kanji count as Han
        assert (r.j.ok, r.j.has_content) == (ok, True), r.k
        assert r.d == r.k


def test_content_and_words(spark):
    rows = [("TODO later",), ("hi",), ("<a> <b/>",), ("/ <summary>",), ("https://x.example.org",), ("12345 67890",), ("plain words",)]
    got = one(spark, rows, "t string", x=language.has_content(F.col("t"), 5))
    assert [r.x for r in got] == [False, False, False, False, False, False, True]
    rows = [("use Java and JavaScript",), ("C++C++ x",), ("aJava Java1",)]
    assert [r.x for r in one(spark, rows, "t string", x=language.strip_allowed_words(F.col("t"), ["Java", "JavaScript"]))] == ["use      and           ", "C++C++ x", "aJava     1"]
    assert [r.x for r in one(spark, rows[1:2], "t string", x=language.strip_allowed_words(F.col("t"), ["C++"]))] == ["C++    x"]
    assert language.normalize_locale(" EN ") == "english" and language.normalize_locale("xx") == "" and language.normalize_locale("any") == "any"


def test_technical_strings(spark):
    from pyspark.sql import functions as F

    from siltgate.functions import language

    rows = [("a/b", True), ("MAX_SIZE", True), ("", True), ("{|}~ 9", True), ("Max", False), ("É", False), ("x", False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r.got == r.want for r in df.select("want", language.is_technical(F.col("t")).alias("got")).collect())


def plain_strip(text, words):
    """Word by word over the whole text."""
    low, gone = "".join(c.lower() if len(c.lower()) == 1 else c for c in text), [False] * len(text)
    latin = lambda c: c.isascii() and c.isalpha()
    for w in sorted({w.lower() for w in words if w}, key=lambda w: (-len(w), w)):
        for at in range(len(text) - len(w) + 1):
            end = at + len(w)
            if low[at:end] == w and not gone[at] and not (at and latin(text[at - 1])) and not (end < len(text) and latin(text[end])):
                gone[at:end] = [True] * len(w)
    return "".join(" " if g else c for g, c in zip(gone, text))


def test_allowed_words_in_one_pass(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abC+é語 ") for _ in range(n))
    for size in (1, 3, 12, 60):
        words = [word(rng.randrange(1, 6)) for _ in range(size)] + ["", "aB"]
        texts = [None, "", *(word(rng.randrange(0, 60)) for _ in range(60))]
        got = one(spark, [(t,) for t in texts], "t string", s=language.strip_allowed_words(F.col("t"), words))
        assert [r["s"] for r in got] == [None if t is None else plain_strip(t, words) for t in texts], words
    # letters only: few words are chained expressions, many are not
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(50)]
    texts = ["".join(rng.choice("abcABC .") for _ in range(50)) for _ in range(50)]
    for some in (words[:5], words):
        got = one(spark, [(t,) for t in texts], "t string", s=language.strip_allowed_words(F.col("t"), some))
        assert [r["s"] for r in got] == [plain_strip(t, some) for t in texts]


def test_many_allowed_words_take_one_pass():
    found = language.Words(sorted({f"word{i}x" for i in range(10_000)}, key=lambda w: (-len(w), w)))
    text = " ".join(f"word{i}x and" for i in range(0, 20_000, 7))
    assert sum(1 for _ in found.find(text)) == sum(i < 10_000 for i in range(0, 20_000, 7))


def test_traits_give_what_required_gives(spark):
    texts = ["", "abc", "hello there", "한국어 설명입니다", "これは説明です", "这是一个说明", "mixed 한국어 text", "12345 67890", "<b> <i>", "TODO: something", "éàüöß ñandú", "hello 漢字 there"]
    for lang in ("korean", "japanese", "chinese", "english", "any", "other"):
        got = one(spark, [(t,) for t in texts], "t string", a=language.required(F.col("t"), lang, 5), b=language.judged(language.traits(F.col("t"), 5), lang), c=language.is_foreign(F.col("t"), lang, 5))
        assert all(r["a"] == r["b"] and r["c"] == (r["a"].has_content and not r["a"].ok) for r in got), lang


def test_nul_after_a_cut_off_character(spark):
    rows = [(b"ab\xe9\x00",), (b"\xf0\x00x",), (b"\xc3\x00",), (b"ab\xe9",), (b"",), (b"\x00",)]
    got = one(spark, [(bytearray(b),) for (b,) in rows], "c binary", b=encoding.is_binary(F.col("c")))
    assert [r["b"] for r in got] == [True, True, True, False, False, True]
