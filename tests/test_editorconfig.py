import random
import re

from siltgate.operators import editorconfig as ec


def resolve(path, configs):
    """File by file from the top, a root starting anew."""
    out = {}
    parts = path.split("/")
    for i in range(len(parts)):
        folder = "/".join(parts[:i])
        text = configs.get(folder)
        if text is None:
            continue
        if ec.is_root(text):
            out = {}
        for s in ec.parse(text):
            if re.search(ec.section_regex(s.pattern).replace(r"\z", r"\Z"), "/".join(parts[i:])):
                out.update(s.properties)
    return tuple(None if out.get(p) in (None, "unset") else out[p] for p in ec.PROPERTIES)


def test_nested_files_against_a_plain_resolver(spark):
    rng = random.Random(2)
    names = ["a", "b", "src", "lib.d"]
    globs = ["*", "*.py", "*.{js,py}", "src/**", "/a.py", "b/*.js", "**/x?.py", "{x1,x2}.js", "[!x]*", "**.js"]
    values = {"charset": ["utf-8", "latin1", "unset"], "end_of_line": ["lf", "crlf"], "indent_style": ["space", "tab", "unset"], "insert_final_newline": ["true", "false"], "trim_trailing_whitespace": ["true"]}

    def config():
        lines = rng.choice([["root = true"], ["# c", "ROOT=True"], [], [], [], ["root = false"]])[:]
        for _ in range(rng.randrange(0, 4)):
            lines.append(f"[{rng.choice(globs)}]")
            for k in rng.sample(list(values), rng.randrange(1, 4)):
                lines.append(f"{k} = {rng.choice(values[k])}")
        return "\n".join(lines)

    folder = lambda: "/".join(rng.choice(names) for _ in range(rng.randrange(0, 4)))
    configs = {folder(): config() for _ in range(25)} | {"": config()}
    paths = sorted({"/".join(x for x in (folder(), rng.choice(["a.py", "x1.py", "x2.js", "y.js", "Makefile"])) if x) for _ in range(150)})
    files = spark.createDataFrame([(p, "own") for p in paths] + [(None, "own")], "path string, charset string")
    table = spark.createDataFrame([(f"{d}/.editorconfig" if d else ".editorconfig", t) for d, t in configs.items()] + [("a/other", "[*]\ncharset = x"), (None, "x"), ("b/.editorconfig2", None)], "path string, text string")
    want = {p: resolve(p, configs) for p in paths} | {None: (None,) * 5}
    for most in (ec.SMALL, 0):
        ec.SMALL, keep = most, ec.SMALL
        try:
            got = {r.path: tuple(r[p] for p in ec.PROPERTIES) for r in ec.nested_definitions(files, table).collect()}
        finally:
            ec.SMALL = keep
        assert got == want


def test_nearest_wins_and_root_cuts(spark):
    table = spark.createDataFrame([(".editorconfig", "[*]\nend_of_line = lf\ninsert_final_newline = true"), ("a/.editorconfig", "[*.py]\nend_of_line = crlf"), ("b/.editorconfig", "root = true\n[*.py]\nend_of_line = crlf")], "path string, text string")
    files = spark.createDataFrame([(p, bytearray(t.encode()), t) for p, t in (("a/x.py", "x\r\ny"), ("b/x.py", "x\ny"), ("x.py", "x"))], "path string, content binary, text string")
    got = {(r.path, r.code) for r in ec.check(files, table).collect()}
    assert got == {("a/x.py", "final_newline"), ("b/x.py", "end_of_line"), ("x.py", "final_newline")}


def test_no_section_files(spark):
    files = spark.createDataFrame([("a/b.py",)], "path string")
    assert ec.nested_definitions(files, spark.createDataFrame([], "path string, text string")).first()[1:] == (None,) * 5
