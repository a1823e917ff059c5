"""Messages, fixes, comments, directives, diffs, lint, layout and reports."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltgate import config
from siltgate.config import PolicyConfig
from siltgate.operators import changes, directives, editorconfig, files, fixes, lint, messages, repo, report
from siltgate.operators.comments import html_comments, lexers, parse_comments
from siltgate.sources import gitdiff


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_messages(spark):
    cfg = PolicyConfig()
    m = cfg.commit_message
    m.conventional_enabled = m.subject_limit_enabled = m.body_limit_enabled = m.no_emoji = m.language_enabled = True
    m.required_language, m.subject_limit, m.body_limit = "english", 20, 30
    rows = [
        ("ok", "feat: add a thing\n\nbody text\n"),
        ("bot", "fix: thing here\n\nCo-authored-by: C <x@cursor.sh>\nCo-authored-by: P <p@example.org>"),
        ("chars", "fix: a b pаss"),
        ("type", "wip: some thing"),
        ("form", "no prefix here"),
        ("long", "feat: " + "x" * 30 + "\n\n" + "y" * 40),
        ("emoji", "feat: good 😀"),
        ("lang", "feat: add\n\n한국어로 작성된 본문"),
        ("merge", "Merge branch x into y and more"),
    ]
    df = table(spark, [(i, t, bytearray(t.encode())) for i, t in rows] + [("bytes", "feat: x", bytearray(b"feat: x\xff\xfe"))], "path string, text string, content binary")
    got = {}
    for r in messages.check_messages(df, cfg).collect():
        got.setdefault(r.path, []).append((r.check, r.line))
    assert "ok" not in got
    assert got["bot"] == [("coauthor", 3), ("body_limit", 3), ("body_limit", 4)] or sorted(got["bot"]) == [("body_limit", 3), ("body_limit", 4), ("coauthor", 3)]
    assert sorted(c for c, _ in got["chars"]) == ["invisible", "lookalike"]  # a no-break space is no look-alike in the default locale
    assert got["type"] == [("conventional", 1)] and got["form"] == [("conventional", 1)]
    assert sorted(got["long"]) == [("body_limit", 3), ("subject_limit", 1)]
    assert got["emoji"] == [("emoji", 1)] and got["lang"] == [("language", 3)] and got["bytes"] == [("bad_bytes", 1)] * 2 and got["merge"] == [("subject_limit", 1)]


def test_bad_byte_places(spark):
    df = table(spark, [("a", bytearray(b"x\xffy\n\xc3\xa9\xfe"))], "path string, content binary")
    assert [(r.line, r.col, r.byte) for r in messages.bad_bytes(df).collect()] == [(1, 2, "FF"), (2, 2, "FE")]


def places(b):
    """Byte by byte: what no character can begin or hold is bad, and decoding goes on after it."""
    out, line, col, i = [], 1, 1, 0
    while i < len(b):
        for n in (1, 2, 3, 4):
            try:
                c = b[i : i + n].decode()
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                break
        else:
            out.append((line, col, f"{b[i]:02X}"))
            col, i = col + 1, i + 1
            continue
        line, col, i = (line + 1, 1, i + n) if c == "\n" else (line, col + 1, i + n)
    return out


def test_bad_bytes_against_a_decoder(spark):
    rng = random.Random(4)
    parts = [b"a", b"\n", b"\r", "é".encode(), "語".encode(), "😀".encode(), b"\xff", b"\xc3", b"\xe8\xaa", b"\xf0\x9f", b"\xed\xa0\x80", b"\xc0\xaf", b"\x80", b"\xf4\x90\x80\x80", b"\x00", b"\xc2\x85"]
    rows = [(str(i), bytearray(b"".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))))) for i in range(400)] + [("long", bytearray(b"x" * 50_000 + b"\xff"))]
    got, checked = {}, {}
    df = table(spark, rows, "path string, content binary")
    for r in messages.bad_bytes(df).collect():
        got.setdefault(r.path, []).append((r.line, r.col, r.byte))
    cfg = PolicyConfig()
    for f in ("no_ai_coauthor", "no_unicode_spaces", "no_ambiguous_chars"):
        setattr(cfg.commit_message, f, False)
    for r in messages.check_messages(df.selectExpr("path", "make_valid_utf8(cast(content as string)) as text", "content"), cfg).collect():
        checked.setdefault(r.path, []).append((r.line, r.col, r.params["byte"]))
    want = {p: places(bytes(b)) for p, b in rows if places(bytes(b))}
    assert {p: sorted(v) for p, v in got.items()} == want and {p: sorted(v) for p, v in checked.items()} == want


def test_fixes_are_idempotent(spark):
    cfg = PolicyConfig()
    text = "fix: pаss​ x\n\nCo-authored-by: C <a@codeium.com>\n\n\n"
    df = table(spark, [("a", bytearray(text.encode() + b"\xff"))], "path string, content binary")
    once = df.select("path", F.encode(fixes.fixed_message(F.col("content"), cfg), "UTF-8").alias("content"))
    twice = once.select(fixes.fixed_message(F.col("content"), cfg).alias("x")).collect()[0].x
    assert once.collect()[0].content.decode() == twice == "fix: pass x\n"


SOURCES = {
    "a.ts": ('// one\nimport x from "m"; /* two\n * three */ const s = `t ${a} //no`;\n//\nlet q = "a\\"b // c";\n', [("one", 1, "Comment"), ("m", 2, "Import"), ("two\nthree", 2, "Comment"), ("t ${a} //no", 3, "String"), ("ab // c", 5, "String")]),
    "a.c": ('#include "x.h"\nchar c = \'"\'; // end\n/* open', [("x.h", 1, "Import"), ('"', 2, "String"), ("end", 2, "Comment")]),
    "a.py": ('#!/usr/bin/x\n# one\nx = "a # b"\n"""doc\nmore"""\n# /// script\n# dep\n# ///\n', [("one", 2, "Comment"), ("a # b", 3, "String"), ("doc\nmore", 4, "String"), ("/// script", 6, "Import"), ("dep", 7, "Import"), ("///", 8, "Import")]),
    "a.go": ('// head\npackage x\nimport (\n\t"fmt"\n)\n//\nvar s = "a\\tb" // t\nvar r = \'"\'\n', [("head", 1, "Comment"), ("fmt", 4, "Import"), ("", 6, "Comment"), ("t", 7, "Comment"), ("a\tb", 7, "String")]),
    "b.go": ("// no package\n", []),
    "Dockerfile": ("FROM x # base\n# next\n", [("base", 1, "Comment"), ("next", 2, "Comment")]),
    "a.sh": ("#!/bin/sh\n# one\necho # two\n  #\n", [("one", 2, "Comment")]),
    "a.rb": ("# one\n=begin\ntwo\n=end\nx\n", [("one", 1, "Comment"), ("two", 2, "Comment")]),
    "a.html": ("<p>\n<!-- one\n * two --></p><!-- --><!-- open", [("one\ntwo", 2, "Comment")]),
    "a.md": ("```\n<!-- no -->\n```\n<!-- yes\nmore -->\n[//]: # (link)\ntext <!-- inline -->\n", [("yes\nmore", 4, "Comment"), ("link", 6, "Comment")]),
    "a.tf": ('# one\nx = "a ${f("b{")} # no" // two\ny = <<-EOT\n  # body\n  EOT\n/* c */\n', [("one", 1, "Comment"), ('a ${f("b{")} # no', 2, "String"), ("two", 2, "Comment"), ("  # body", 3, "String"), ("c", 6, "Comment")]),
    "a.unknown": ("# no", []),
}


def test_lexers(spark):
    df = table(spark, [(p, s) for p, (s, _) in SOURCES.items()] + [(None, "# x"), ("n.py", None)], "path string, text string")
    got = {}
    for r in parse_comments(df).orderBy("path", "seq").collect():
        got.setdefault(r.path, []).append((r.text, r.line, r.kind))
    assert got == {p: want for p, (_, want) in SOURCES.items() if want}
    page = table(spark, [("a", SOURCES["a.html"][0])], "path string, html string")
    assert [(r.text, r.line, r.end_line) for r in html_comments(page).collect()] == [("one\ntwo", 2, 3)]
    assert lexers.extensions_for(["go", "ruby", "x"]) == [".go", ".rb", ".rake", ".gemspec"]


def brute_states(rows, default):
    off, off_lang, nxt, lang, filed, out = False, "", False, "", "", []
    for t in rows:
        body = t.strip().lower()
        if not body.startswith("siltgate:"):
            if off:
                out.append((off_lang == "", off_lang))
                nxt = nxt and bool(filed)
            elif nxt:
                out.append((True, ""))
                nxt = False
            else:
                out.append((False, lang or filed))
            continue
        out.append((True, ""))
        rest = body[len("siltgate:") :]
        full = lambda s: config.LANGUAGES.get(s.strip(), s.strip())
        if rest.startswith("file-lang="):
            filed = full(rest[10:])
        elif rest.startswith("disable:lang="):
            off, off_lang = True, full(rest[13:])
        elif rest.startswith("disable"):
            off, off_lang = True, ""
        elif rest.startswith("enable"):
            off, off_lang = False, ""
        elif rest.startswith("ignore"):
            nxt = True
        elif rest.startswith("lang="):
            lang = full(rest[5:])
    return [(s, lg if s or lg else default) for s, lg in out]


def test_directives_against_a_loop(spark):
    rng = random.Random(2)
    words = ["text", "more", "siltgate:ignore", "SILTGATE:disable", "siltgate:enable", "siltgate:lang=ja", "siltgate:file-lang=en", "siltgate:disable:lang=zh", "siltgate:what"]
    seqs = {f"p{i}": [rng.choice(words) for _ in range(rng.randint(1, 9))] for i in range(250)}
    rows = [(p, n, t, n, n, False, "Comment") for p, ts in seqs.items() for n, t in enumerate(ts)]
    df = table(spark, rows, "path string, seq long, text string, line long, end_line long, is_block boolean, kind string")
    got = {}
    for r in directives.states(df, "korean").orderBy("path", "seq").collect():
        got.setdefault(r.path, []).append((r.skip, r.lang))
    assert got == {p: brute_states(ts, "korean") for p, ts in seqs.items()}


def brute_units(rows):
    out, now = [], None

    def close():
        nonlocal now
        if now and now["texts"]:
            out.append(("\n".join(now["texts"]), now["line"], now["end"]))
        now = None

    for text, line, end, block, skip, lang in rows:
        if skip:
            continue
        if block:
            close()
            out.append((text, line, end))
            continue
        if now and now["lang"] == lang and (line <= now["end"] + 1 or not now["texts"]):
            now["end"] = max(now["end"], end)
        else:
            close()
            now = {"lang": lang, "line": line, "end": end, "texts": []}
        if text.strip():
            now["texts"].append(text)
    close()
    return out


def test_units_against_a_loop(spark):
    rng = random.Random(4)
    cases, rows = {}, []
    for i in range(300):
        line, case = 1, []
        for n in range(rng.randint(1, 10)):
            line += rng.choice([1, 1, 1, 2, 3])
            r = (rng.choice(["a", "b", "", ""]), line, line, rng.random() < 0.1, rng.random() < 0.15, rng.choice(["x", "x", "y"]))
            case.append(r)
            rows.append((f"p{i}", n, *r[:4], "Comment", *r[4:]))
        cases[f"p{i}"] = brute_units(case)
    df = table(spark, rows, "path string, seq long, text string, line long, end_line long, is_block boolean, kind string, skip boolean, lang string")
    got = {}
    for r in directives.units(df).orderBy("path", "unit_id").collect():
        got.setdefault(r.path, []).append((r.text, r.line, r.end_line))
    assert got == {p: c for p, c in cases.items() if c}


DIFF = """diff --git a/x.go b/x.go
index 1..2 100644
--- a/x.go
+++ b/x.go
@@ -1,3 +1,4 @@
 keep
+new one
-gone
 keep
+last
@@ -10 +12,2 @@ ctx
+far
diff --git "a/\\355\\225\\234.txt" "b/\\355\\225\\234.txt"
deleted file mode 100644
--- "a/\\355\\225\\234.txt"
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/sub b/sub
new file mode 160000
--- /dev/null
+++ b/sub
@@ -0,0 +1 @@
+Subproject commit 1
diff --git a/old b/moved
similarity index 100%
rename from old
rename to moved"""


def test_diff(spark):
    got = {r.path: r for r in gitdiff.parse_diff(table(spark, [(1, DIFF)], "diff_id int, diff string")).collect()}
    assert set(got) == {"x.go", "한.txt", "sub", "moved"}
    assert got["x.go"].added_lines == [2, 4, 12] and got["x.go"].has_removed_lines
    assert got["한.txt"].is_deleted and got["sub"].is_submodule and got["sub"].is_new and got["moved"].added_lines == []
    assert gitdiff.unquote('"a\\tb\\x41\\101\\""') == 'a\tbAA"' and gitdiff.unquote('"a\\q"') == '"a\\q"' and gitdiff.unquote("a") == "a"
    listing = "3\t1\ta.txt\0-\t-\tb.png\0-\t-\t\0old.bin\0new.bin\0"
    assert sorted(r.path for r in gitdiff.binary_files(table(spark, [(1, listing)], "i int, listing string")).collect()) == ["b.png", "new.bin"]
    lines = ["r a1 q 0000", "r 0000 q b1", "r a2 q b2", "bad"]
    assert [(r.start, r.stop) for r in gitdiff.push_ranges(table(spark, [(x,) for x in lines], "line string")).collect()] == [(None, "a1"), ("b2", "a2")]
    assert gitdiff.comparison(["a..b"]) == ("a", "b") and gitdiff.comparison(["a"]) == ("a", "") and gitdiff.diff_arguments("", "") == ["--staged"]


@given(st.lists(st.from_regex(r"[a-c_.]{0,3}[0-9]{0,12}[a-c]{0,2}", fullmatch=True), min_size=2, max_size=2))
def test_natural_order(names):
    import re

    def key(s):
        return re.sub(r"0*(\d{20})(?!\d)", r"\1", re.sub(r"(\d+)", "0" * 20 + r"\1", s))

    def parts(s):
        return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D", s)]

    a, b = names
    if all(x[0] == y[0] for x, y in zip(parts(a), parts(b))):
        assert (key(a) < key(b)) == (parts(a) < parts(b))


def test_change_checks(spark):
    cfg = PolicyConfig(protected_paths=["ci/**"], append_only_paths=["m/**"], filename_order="numeric")
    diff = table(spark, [("ci/a", True, False), ("m/10.sql", False, True), ("m/2.sql", False, True), ("m/1.sql", False, False), ("m/3.sql", False, False), ("m/0.sql", True, False)], "path string, is_deleted boolean, is_new boolean")
    old = table(spark, [("m/1.sql", bytearray(b"a")), ("m/3.sql", bytearray(b"a")), ("m/9.sql", bytearray(b"z"))], "path string, content binary")
    new = table(spark, [("m/1.sql", bytearray(b"ab")), ("m/3.sql", bytearray(b"ba")), ("m/2.sql", bytearray(b"")), ("m/10.sql", bytearray(b""))], "path string, content binary")
    assert [(r.path, r.code) for r in changes.protected_paths(diff, cfg).collect()] == [("ci/a", "protected_deleted")]
    assert sorted((r.path, r.code) for r in changes.append_only(diff, old, new, cfg).collect()) == [("m/0.sql", "append_only_deleted"), ("m/2.sql", "append_only_order"), ("m/3.sql", "append_only_modified")]


def test_lint(spark):
    good = {"a.json": '{"a": [1, 2]} 3', "b.jsonc": '{"a": 1, // c\n}', "e.json": "", "a.toml": "a = 1\n", "a.xml": "<a><b/></a>", "e.xml": "", "r.xml": "<a/><b/>", "package-lock.json": "{", "x.txt": "{"}
    bad = {"b.json": '{"a": 1,}', "c.json": '{} x', "n.json": "NaN", "c.jsonc": "{a: 1}", "d.jsonc": '{"a": 1} /* open', "b.toml": "a = \n", "b.xml": "<a></b>", "c.xml": "<a>"}
    df = table(spark, [*good.items(), *bad.items()], "path string, text string")
    assert {r.path for r in lint.lint(df).collect()} == set(bad)
    assert lint.check_json('{"a": 1}\n{"b": }')[0][0] == 2
    assert lint.strip_comments('"//x" /* a\nb */ 1 // c') == '"//x" \n 1 '
    assert lint.strip_trailing_commas('{"a": ",]", }') == '{"a": "]" }'


def test_editorconfig(spark):
    sections = editorconfig.parse("root=true\n[*]\ncharset = UTF-8\n[*.{go,md}]\nend_of_line=lf\nindent_style=tab\ninsert_final_newline=true\ntrim_trailing_whitespace=true\n[docs/**.md]\ntrim_trailing_whitespace=unset\n")
    rows = [("a.go", "x \r\n  y\n\tz"), ("docs/a/b.md", "x \n"), ("b.txt", "﻿x")]
    df = table(spark, [(p, t, bytearray(t.encode())) for p, t in rows], "path string, text string, content binary")
    got = sorted((r.path, r.code, r.line) for r in editorconfig.check(df, sections).collect())
    assert got == [("a.go", "end_of_line", 1), ("a.go", "final_newline", 0), ("a.go", "indent_style", 2), ("a.go", "trailing_whitespace", 1), ("b.txt", "charset_bom", 1)]


def test_file_checks_and_report(spark):
    cfg = PolicyConfig()
    cfg.comment_language.required_language = "english"
    cfg.encoding.no_invisible_chars = cfg.encoding.no_ambiguous_chars = True
    cfg.binary_file.rules = [([".bin"], "lfs")]
    rows = [("a.py", "# 한국어 주석입니다\n# plain words here\n".encode()), ("b.bin", b"a\0b"), ("c.png", b"\x89PNG\r\n\x1a\n"), ("d.exe", b"MZ\0"), ("e.txt", b"\xff\xfe x"), ("f.txt", "a​b".encode()), ("g.json", b"{")]
    df = table(spark, [(p, bytearray(b), b.decode("utf-8", "replace")) for p, b in rows], "path string, content binary, text string")
    found = report.findings(report.Inputs(corpus=df), cfg)
    got = sorted((r.path, r.check) for r in found.collect())
    assert ("a.py", "comment_language") in got and ("b.bin", "binary") in got and ("d.exe", "binary") in got and ("c.png", "binary") not in got
    assert ("e.txt", "encoding") in got and ("f.txt", "unicode") in got and ("g.json", "lint") in got
    guides = table(spark, [("lint", "see the lint guide")], "check string, text string")
    doc = json.loads(report.report_json(found, guides).collect()[0].report)
    assert doc["status"] == "fail" and doc["summary"]["total"] == len(got) and doc["guides"] == ["see the lint guide"]
    assert [r.check for r in report.summary(found).collect()][0] == "binary"
    empty = json.loads(report.report_json(found.where("false")).collect()[0].report)
    assert empty["status"] == "pass" and empty["summary"]["total"] == 0
    lfs = table(spark, [("b.bin", "lfs")], "path string, filter string")
    assert {r.path for r in files.binary_files(df, cfg, lfs).collect()} == {"d.exe"}
    with pytest.raises(ValueError):
        report.selected(False, "nope")
    assert [c.name for c in report.selected(True, "lint,unicode")] == ["unicode", "lint"] and len(report.selected(False)) == 7 and len(report.selected(True)) == 10
    assert report.interpolate("a %{x} %{y}", {"x": 1}) == "a 1 %{y}"


def test_layout(spark):
    paths = [("a/package.json", 1), ("a/node_modules/x/i.js", 100), ("a/node_modules/x/node_modules/y.js", 2000), ("b/node_modules/x.js", 5), ("c/m.py", 1), ("c/__pycache__/m.pyc", 7), ("v/pyvenv.cfg", 1), (".venv/pyvenv.cfg", 3), ("README.md", 2), (".eslintrc.json", 1)]
    df = table(spark, [(p, s, True) for p, s in paths], "path string, size long, tracked boolean")
    # an environment is found by its marker, whatever its name
    assert {r.dir for r in repo.walked(df).collect()} == {"a/node_modules", "c/__pycache__", ".venv", "v"}
    got = [(r.cache_dir, r.size, r.shown) for r in repo.cache_sizes(df).collect()]
    assert got == [("a/node_modules", 2100, "2.1 KB"), ("c/__pycache__", 7, "7 B"), (".venv", 3, "3 B"), ("v", 1, "1 B")]
    changed = table(spark, [("a/node_modules/x/i.js", False), ("a/node_modules/x/node_modules/y.js", False), ("c/m.py", False)], "path string, is_deleted boolean")
    assert len(repo.staged_cache_dirs(changed, df, PolicyConfig()).collect()) == 1
    assert [(r.language, r.n_files) for r in repo.language_counts(df).collect()][0] == ("TypeScript/JavaScript", 3)
    assert [(r.language, r.config) for r in repo.lint_configs(df).collect()] == [("TypeScript/JavaScript", ".eslintrc.json")]


def test_config():
    base = {"comment_language": {"locale": "en", "ignore_files": ["a"], "extensions": [".go"]}, "lint": {"enabled": False}}
    over = {"comment_language": {"ignore_files": ["b"], "extensions": [".py"], "no_emoji": True}, "lint": {"enabled": True}}
    out = config.merge(base, over)
    assert out["comment_language"] == {"locale": "en", "ignore_files": ["a", "b"], "extensions": [".py"], "no_emoji": True} and out["lint"] == {"enabled": False}
    cfg = config.build(out)
    assert cfg.comment_language.required_language == "english" and cfg.commit_message.required_language == "korean" and cfg.comment_language.min_length == 5
    assert config.PolicyConfig().commit_message.all_types() == config.TYPES and len(config.MessagePolicy(type_locale="ko").all_types()) == 23
    assert config.parse_ttl("7d") == 604800 and config.parse_ttl("x") is None and config.word_lines("# c\n a \n\nb") == ["a", "b"]
    assert any("malformed" in w for w in config.validate({"exceptions": {"global_ignore": ["a["]}}))
    assert config.parse("") == {} and report.detect_locale({"LANG": "ko_KR.UTF-8"}) == "ko" and report.detect_locale({}) == "en"
    assert report.detect_locale({"LC_ALL": "C", "LANG": "ko_KR.UTF-8"}) == "en" and report.detect_locale({"LC_ALL": "", "LANG": "ja.UTF-8"}) == "ja" and report.detect_locale({"LC_ALL": "fr_FR", "LANG": "ko"}) == "en"
    m = PolicyConfig()
    m.commit_message.subject_limit_enabled = True
    assert "72" in report.message_hint(m) and report.message_hint(m, "merge") == "" and config.normalize_policy("X") == "block"


def test_cache_folders_need_their_proof(spark):
    yes = [("a/node_modules/x", "a/yarn.lock"), ("b/dist/x", "b/Cargo.toml"), ("c/.dart_tool/package_config.json", None), ("d/.output/x", "d/nuxt.config.ts"), ("e/.yarn/x", "e/package.json"), ("f/.bun/x", "f/bun.lock"), ("g/.nox/x", "g/noxfile.py"), ("h/.embuild/espressif/x", None), ("i/build/build.ninja", None), ("j/vendor/x", "j/Gemfile"), ("k/__pycache__/x", "k/m.py"), ("l/target/x", "l/build.sbt"), ("m/.gradle/x", "m/gradlew")]
    no = [("n/.pytest_cache/x", None), ("o/coverage/x", "o/package.json"), ("p/venv/pyvenv.cfg", None), ("q/.embuild/espressif", None), ("r/dist/x", "r/setup.py"), ("s/node_modules/x", "s/sub/package.json"), ("t/bin/x", "t/a.csproj")]
    paths = [x for pair in yes + no for x in pair if x]
    got = {r.dir for r in repo.cache_dirs(table(spark, [(x,) for x in paths], "path string")).collect()}
    assert got == {"/".join(x.split("/")[:2]) for x, _ in yes}


def test_diff_flags(spark):
    head = "diff --git a/f b/f\n"
    cases = {
        "gone": head + "index 1..0\n--- a/f\n+++ /dev/null\n@@ -1 +0,0 @@\n-x",
        "index": head + "index 1..2 120000\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n-x\n+y",
        "link": head + "new file mode 120000\n--- /dev/null\n+++ b/f\n@@ -0,0 +1 @@\n+y",
        "module": head + "old mode 100644\nnew mode 160000\n",
        "empty": head + "deleted file mode 100644\nindex 1..0\n",
    }
    out = {r.diff_id: (r.is_deleted, r.is_new, r.is_submodule, r.is_symlink) for r in gitdiff.parse_diff(table(spark, list(cases.items()), "diff_id string, diff string")).collect()}
    assert out == {"gone": (True, False, False, False), "index": (False,) * 4, "link": (False, True, False, True), "module": (False, False, True, False), "empty": (False,) * 4}
