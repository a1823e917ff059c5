import random

import pytest

from siltgate.operators import directives, scan
from siltgate.sources import gitdiff

from .test_checks import brute_states


@pytest.fixture(params=[3, 7, 10_000])
def block(request):
    scan.BLOCK, keep = request.param, scan.BLOCK
    yield request.param
    scan.BLOCK = keep


COMMENTS = "path string, seq long, text string, line long, end_line long, is_block boolean, kind string"


def test_long_files_of_directives(spark, block):
    rng = random.Random(5)
    words = ["text", "more", "siltgate:ignore", "siltgate:disable", "siltgate:enable", "siltgate:lang=ja", "siltgate:file-lang=en", "siltgate:file-lang=", "siltgate:disable:lang=zh", "siltgate:what"]
    seqs = {f"p{i}": rng.choices(words, [6, 6, 1, 1, 1, 1, 0.3, 0.2, 1, 1], k=n) for i, n in enumerate([120, 90, 60, 1, 2, 3, 4, 30])}
    rows = [(p, 5 * n, t, n, n, False, "Comment") for p, ts in seqs.items() for n, t in enumerate(ts)]
    got = {}
    for r in directives.states(spark.createDataFrame(rows, COMMENTS).repartition(5), "korean").orderBy("path", "seq").collect():
        got.setdefault(r.path, []).append((r.skip, r.lang))
    assert got == {p: brute_states(ts, "korean") for p, ts in seqs.items()}


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("p", 0, "a", 1, 1, False, "Comment", "own", True)], COMMENTS + ", lang string, skip boolean")
    row = directives.states(df, "english").first()
    assert row.lang == "english" and row.skip is False and directives.states(df.limit(0), "english").collect() == []


def plain_diff(text):
    """One pass over the lines."""
    files, file, line, hunk = [], None, 0, False
    for raw in text.split("\n"):
        if raw.startswith("diff --git "):
            file, hunk = {"path": raw.split(" b/", 1)[1], "added": [], "removed": False, "new": False}, False
            files.append(file)
        elif file is None:
            continue
        elif raw.startswith("+++ b/"):
            file["path"] = raw[6:]
        elif raw.startswith("+++ ") or raw.startswith("--- "):
            continue
        elif raw.startswith("new file mode "):
            file["new"] = True
        elif raw.startswith("@@"):
            line, hunk = int(raw.split("+")[1].split(",")[0].split(" ")[0]), True
        elif raw.startswith("+"):
            if hunk:
                file["added"].append(line)
            line += 1
        elif raw.startswith("-"):
            file["removed"] |= hunk
        elif raw.startswith(" "):
            line += 1
    return sorted((f["path"], tuple(sorted(set(f["added"]))), f["removed"], f["new"]) for f in files)


def test_long_diffs(spark, block):
    rng = random.Random(7)
    diffs = []
    for d in range(6):
        lines = ["warning: something before"] if d % 2 else []
        for f in range(rng.randrange(0, 9)):
            lines += [f"diff --git a/f{d}_{f} b/f{d}_{f}"] + (["new file mode 100644"] if f % 3 == 0 else []) + (["--- a/x", f"+++ b/f{d}_{f}"] if f % 4 else []) + (["+before any hunk"] if f % 5 == 1 else [])
            for h in range(rng.randrange(0, 4)):
                lines.append(f"@@ -1,{rng.randrange(9)} +{1 + 100 * h + rng.randrange(50)},3 @@ text")
                lines += [rng.choice([" same", "+new", "-old", "\\ No newline at end of file", "+"]) for _ in range(rng.randrange(0, 20))]
        diffs.append((d, "\n".join(lines)))
    got = {}
    for r in gitdiff.parse_diff(spark.createDataFrame(diffs, "diff_id int, diff string")).collect():
        got.setdefault(r.diff_id, []).append((r.path, tuple(r.added_lines), r.has_removed_lines, r.is_new))
    assert {d: sorted(got.get(d, [])) for d, _ in diffs} == {d: plain_diff(t) for d, t in diffs}


def test_one_long_diff_is_read_by_many_tasks(spark):
    """The rows of a single diff come out in several partitions."""
    text = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -0,0 +1 @@\n" + "\n".join(["+x"] * 60_000)
    rows = gitdiff.diff_rows(spark.createDataFrame([(1, text)], "diff_id int, diff string")).where("line is not null")
    assert rows.selectExpr("min(line)", "max(line)", "count(distinct line)").first()[:] == (1, 60_000, 60_000)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        assert rows.selectExpr("spark_partition_id() as p").distinct().count() > 1
    finally:
        spark.conf.unset(key)


def test_sums_before(spark):
    from pyspark.sql import functions as F

    from siltgate.functions.arrays import sums_before

    rng = random.Random(9)
    rows = [([rng.randrange(-3, 9) for _ in range(n)],) for n in (0, 1, 2, 255, 256, 257, 600, 5000)] + [(None,)]
    out = spark.createDataFrame(rows, "v array<int>").select("v", sums_before(F.col("v")).alias("s"), sums_before(F.col("v"), 3).alias("t")).collect()
    for r in out:
        want = [sum(r.v[:i]) for i in range(len(r.v))] if r.v is not None and len(r.v) < 1000 else None
        if r.v is None:
            assert not r.s and not r.t
        else:
            assert r.s == r.t and (want is None or r.s == want) and len(r.s) == len(r.v)


def test_many_comments_of_one_page(spark):
    import re

    from siltgate.operators.comments import html_comments

    rng = random.Random(10)
    page = "".join(rng.choice(["text ", "\n", "<!-- a -->", "<!-- b\n * c\n-->", "<!---->", "<p>"]) for _ in range(6000)) + "<!-- open"
    want = []
    for m in re.finditer(r"(?s)<!--(.*?)-->", page):
        text = "\n".join(x for x in (re.sub(r"^\*", "", y.strip()).strip() for y in m[1].split("\n")) if x)
        if text:
            want.append((text, page.count("\n", 0, m.start()) + 1, page.count("\n", 0, m.end()) + 1))
    got = html_comments(spark.createDataFrame([(1, page)], "id int, html string")).collect()
    assert sorted((r.text, r.line, r.end_line) for r in got) == sorted(want) and len(want) > 1500
