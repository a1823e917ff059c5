"""Change sets as tables: unified diffs, NUL-separated listings and push ranges."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..operators import scan

#: The one-letter escapes of C-style quoted paths.
ESCAPES = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, '"': 34, "'": 39}
_ESCAPE = re.compile(rb"\\(?:x([0-9A-Fa-f]{2})|([0-7]{1,3})|(.))|\\\Z", re.S)


def unquote(path: str | None) -> str | None:
    """A C-style quoted path as it is; unquoted and malformed ones unchanged."""
    if path is None or len(path) < 2 or path[0] != '"' or path[-1] != '"':
        return path
    bad = False

    def put(m: re.Match) -> bytes:
        nonlocal bad
        if m[1]:
            return bytes([int(m[1], 16)])
        if m[2] and int(m[2], 8) < 256:
            return bytes([int(m[2], 8)])
        if m[3] and chr(m[3][0]) in ESCAPES:
            return bytes([ESCAPES[chr(m[3][0])]])
        bad = True
        return b""

    inner = path[1:-1]
    if re.search(r'(?<!\\)(?:\\\\)*"', inner):
        return path
    out = _ESCAPE.sub(put, inner.encode())
    return path if bad else out.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def _unquoted(s: pd.Series) -> pd.Series:
    return s.map(unquote)


def clean_path(path: Column) -> Column:
    """Only quoted paths leave the JVM."""
    return F.when(path.startswith('"'), _unquoted(path)).otherwise(path)


def header_path(line: Column) -> Column:
    """The new side of ``diff --git a/x b/y``: the quoted one, else what follows the first `` b/``."""
    quoted = F.regexp_extract(line, r'("b/(?:[^"\\]|\\.)*")\s*$', 1)
    plain = F.regexp_extract(line, r"^diff --git .*? b/(.*)$", 1)
    return F.when(quoted != "", F.concat(F.lit('"'), F.substring(quoted, 4, F.length(quoted)))).otherwise(plain)


def diff_rows(diffs: DataFrame, diff: str = "diff", key: str = "diff_id") -> DataFrame:
    """Unified diffs to a row for each of their lines: key, pos, l, k (its kind), file (its number from 1), hunk (whether one of the
    file has begun) and line (of the new side, for added lines).

    A running count of headers gives the file; a hunk header tells the number of its first line, and
    the count of added and context lines since then the rest. Both counts run in two levels over blocks of lines, and
    what a block hands on is its counts and its last hunk header: one diff of any length is read by many tasks.
    """
    rows = diffs.select(F.col(key).alias("_key"), F.posexplode(F.split(diff, "\n", -1)).alias("pos", "l"))
    kind = (
        F.when(F.col("l").startswith("diff --git "), "file")
        .when(F.col("l").startswith("+++ b/") | F.col("l").startswith('+++ "b/'), "name")
        .when(F.col("l") == "+++ /dev/null", "deleted")
        .when(F.col("l").startswith("+++ ") | F.col("l").startswith("--- "), "other")
        .when(F.col("l").startswith("new file mode "), "new")
        .when(F.col("l").rlike(r"^(old mode|new mode) "), "mode")
        .when(F.col("l").startswith("@@"), "hunk")
        .when(F.col("l").startswith("+"), "add")
        .when(F.col("l").startswith("-"), "remove")
        .when(F.col("l").startswith(" "), "keep")
        .otherwise("other")
    )
    by = ["_key"]
    rows = scan.cut(rows.withColumn("k", kind), "pos")
    upto = scan.here(by, "pos", inclusive=True)
    counts = {"_files": (F.col("k") == "file").cast("long"), "_moves": F.col("k").isin("add", "keep").cast("long")}
    rows = rows.withColumns({n: F.sum(c).over(upto) for n, c in counts.items()})
    first = F.coalesce(F.regexp_extract("l", r"\+(\d+)", 1).try_cast("long"), F.lit(0))
    header = F.when(F.col("k") == "hunk", F.struct("_files", "_moves", first.alias("first")))
    blocks = rows.groupBy("_key", "_b").agg(*[F.max(n).alias(n) for n in counts], scan.latest(header, "pos").alias("_hunk"))
    over = scan.earlier(by)
    blocks = blocks.withColumns({f"_g{n}": F.sum(n).over(over) for n in counts})
    # a header's counts from the beginning of the diff
    whole = F.struct(*[(F.col("_hunk")[n] + F.coalesce(f"_g{n}", F.lit(0))).alias(n) for n in counts], F.col("_hunk.first").alias("first"))
    blocks = blocks.withColumn("_g_hunk", F.last(F.when(F.col("_hunk").isNotNull(), whole), ignorenulls=True).over(over))
    rows = rows.withColumn("_hunk", F.last(header, ignorenulls=True).over(upto))
    rows = scan.given(rows, blocks, by, {n: F.col(n) for n in ("_g_files", "_g_moves", "_g_hunk")})
    total = {n: F.col(n) + F.coalesce(f"_g{n}", F.lit(0)) for n in counts}
    own = F.struct(*[(F.col("_hunk")[n] + F.coalesce(f"_g{n}", F.lit(0))).alias(n) for n in counts], F.col("_hunk.first").alias("first"))
    rows = rows.withColumn("_last", F.coalesce(F.when(F.col("_hunk").isNotNull(), own), F.col("_g_hunk"))).withColumn("file", total["_files"])
    hunk = F.coalesce(F.col("_last._files") == F.col("file"), F.lit(False))
    line = F.when((F.col("k") == "add") & hunk, F.col("_last.first") + total["_moves"] - F.col("_last._moves") - 1)
    return rows.select(F.col("_key").alias(key), "pos", "l", "k", "file", hunk.alias("hunk"), line.alias("line")).where("file > 0")


def parse_diff(diffs: DataFrame, diff: str = "diff", key: str = "diff_id") -> DataFrame:
    """Unified diffs to a row per file.

    key, path, is_deleted, is_new, has_removed_lines, is_submodule, is_symlink,
    added_lines (sorted). Added text that looks like a header is read as
    one, as ``git diff`` consumers do. ``diff_rows`` has the lines themselves, where a file's are too many for one row.
    """
    rows = diff_rows(diffs, diff, key)
    name = F.when(F.col("k") == "name", F.when(F.col("l").startswith('+++ "'), F.concat(F.lit('"'), F.substring("l", 8, F.length("l")))).otherwise(F.substring("l", 7, F.length("l"))))
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    mode = lambda m: has(F.col("k").isin("new", "mode") & (F.element_at(F.split(F.trim("l"), " "), -1) == m))
    out = rows.groupBy(key, "file").agg(
        F.coalesce(scan.latest(name, "pos"), F.max(F.when(F.col("k") == "file", header_path(F.col("l"))))).alias("path"),
        has(F.col("k") == "deleted").alias("is_deleted"),
        has(F.col("k") == "new").alias("is_new"),
        has((F.col("k") == "remove") & F.col("hunk")).alias("has_removed_lines"),
        mode("160000").alias("is_submodule"),
        mode("120000").alias("is_symlink"),
        F.sort_array(F.collect_set("line")).alias("added_lines"),
    )
    return out.withColumn("path", clean_path(F.col("path"))).drop("file")


def added_lines(files: DataFrame) -> DataFrame:
    """(path, line) of the files that still have content."""
    return files.where("not is_deleted and not is_submodule and not is_symlink").select("path", F.explode("added_lines").alias("line"))


def split_nul(listing: Column) -> Column:
    """A NUL-separated listing as an array; empty for an empty one."""
    body = F.regexp_replace(listing, r"\x00+\z", "")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "\\x00", -1))


def binary_files(listings: DataFrame, listing: str = "listing") -> DataFrame:
    """Paths that a NUL-separated numstat marks as binary (``-`` for both counts).

    A rename record has an empty path and its old and new path in the two next fields; the new one counts.
    """
    keep = [c for c in listings.columns if c != listing]
    rows = listings.select(*keep, F.posexplode(split_nul(F.col(listing))).alias("pos", "f"))
    order = W.partitionBy(*keep).orderBy("pos") if keep else W.orderBy("pos")
    two = F.lead("f", 2).over(order)
    rows = rows.withColumn("path", F.when(F.col("f").rlike(r"^[-\d]+\t[-\d]+\t$"), two).otherwise(F.regexp_extract("f", r"^[-\d]+\t[-\d]+\t(.+)$", 1)))
    return rows.where(F.col("f").startswith("-\t-\t") & (F.col("path") != "")).select(*keep, "path")


def staged(files: DataFrame) -> DataFrame:
    return files.where("not is_deleted").select("path")


def content_at(blobs: DataFrame, ref: str, paths: DataFrame | None = None) -> DataFrame:
    """(path, content) of a reference, for the given paths or all of them."""
    out = blobs.where(F.col("ref") == ref).select("path", "content")
    return out if paths is None else out.join(paths.select("path").distinct(), "path", "left_semi")


def tree_files(blobs: DataFrame, ref: str) -> DataFrame:
    return blobs.where(F.col("ref") == ref).select("path").distinct()


def push_ranges(lines: DataFrame, line: str = "line", base: str | None = None) -> DataFrame:
    """``local-ref local-sha remote-ref remote-sha`` lines to (start, stop); deleted refs are left out, new ones start at ``base`` (None: null)."""
    f = F.split(F.trim(F.col(line)), r"\s+")
    zero = lambda c: c.rlike("^0+$")
    rows = lines.select(f.alias("f")).where((F.size("f") == 4) & ~zero(F.col("f")[1]))
    return rows.select(F.when(zero(F.col("f")[3]), F.lit(base)).otherwise(F.col("f")[3]).alias("start"), F.col("f")[1].alias("stop"))


def commit_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages (one file each, named by hash) without trailing newlines."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "content", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\n+\z", "").alias("text"))


def corpus_from_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a folder as (path, content, text)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "content", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def comparison(args: list[str], staged_only: bool = False, merge_base: Callable[[str, str], str | None] | None = None) -> tuple[str, str]:
    """(from, to) of zero, one or two arguments; empty strings: the last commit against the index.

    ``A...B`` starts at the merge base (see ``commits.resolver``), or at A where there is none.
    """
    if len(args) > 2:
        raise ValueError("at most two references")
    if staged_only or not args:
        return "", ""
    if len(args) == 2:
        return args[0], args[1]
    for dots in ("...", ".."):
        if dots in args[0]:
            a, _, b = args[0].partition(dots)
            a, b = a or "HEAD", b or "HEAD"
            return (merge_base(a, b) or a if merge_base and dots == "..." else a), b
    return args[0], ""


def diff_arguments(start: str, stop: str) -> list[str]:
    return [start, stop] if start and stop else [start] if start else ["--staged"] if not stop else ["HEAD", stop]
