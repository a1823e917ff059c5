"""White-space rules of ``.editorconfig`` files."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import encoding, globs
from .findings import finding, union
from .lines import explode_lines

#: Indented lines of a file that the indentation rule looks at.
SAMPLE_LINES = 100
PROPERTIES = ("charset", "end_of_line", "indent_style", "insert_final_newline", "trim_trailing_whitespace")


@dataclass
class Section:
    pattern: str
    properties: dict[str, str]


def parse(text: str) -> list[Section]:
    """Sections in order; keys and values in lower case, comments and unknown lines aside."""
    out: list[Section] = []
    for raw in text.split("\n"):
        line = raw.strip()
        if not line or line[0] in "#;":
            continue
        if line[0] == "[" and line.endswith("]"):
            out.append(Section(line[1:-1], {}))
        elif "=" in line and out:
            k, _, v = line.partition("=")
            out[-1].properties[k.strip().lower()] = v.strip().lower()
    return out


def is_root(text: str) -> bool:
    """Whether ``root = true`` stands before the first section."""
    for raw in text.split("\n"):
        line = raw.strip()
        if line.startswith("[") and line.endswith("]"):
            return False
        k, eq, v = line.partition("=")
        if eq and line[0] not in "#;" and k.strip().lower() == "root":
            return v.strip().lower() == "true"
    return False


def section_regex(pattern: str) -> str:
    """A section's glob over root-relative paths: a glob without a slash applies in every folder."""
    body, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            deep = pattern[i : i + 2] == "**"
            body += ".*" if deep else "[^/]*"
            i += deep
        elif c == "?":
            body += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            inner = pattern[i + 1 : j]
            body += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner).replace("\\", "\\\\") + "]"
            i = j
        elif c == "{" and "}" in pattern[i:]:
            span = re.match(r"\{(-?\d+)\.\.(-?\d+)\}", pattern[i:])
            if span:
                lo, hi = sorted((int(span[1]), int(span[2])))
                body += "(?:" + "|".join(str(x) for x in range(lo, min(hi, lo + 999) + 1)) + ")"
                i += span.end() - 1
            else:
                body, depth = body + "(?:", depth + 1
        elif c == "}" and depth:
            body, depth = body + ")", depth - 1
        elif c == "," and depth:
            body += "|"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            body += re.escape(pattern[i])
        else:
            body += re.escape(c)
        i += 1
    rooted = "/" in pattern.strip("/") or pattern.startswith("/")
    return "^" + ("" if rooted else "(?:.*/)?") + body.removeprefix("/") + r"\z"


def property_of(path: Column, sections: list[Section], name: str) -> Column:
    """The last matching section that sets the property decides; ``unset`` and none are null."""
    out = F.lit(None).cast("string")
    for s in sections:
        if name in s.properties:
            out = F.when(path.rlike(section_regex(s.pattern)), F.lit(s.properties[name])).otherwise(out)
    return F.nullif(out, F.lit("unset"))


def parsed_configs(configs: DataFrame) -> DataFrame:
    """``configs(path, text)``, a row an ``.editorconfig`` file, to (dir, root, sections): its folder (empty for the top one), and
    its sections in order as array<struct<regex, the properties>>. Unreadable globs match nothing."""

    def run(batches):
        for b in batches:
            dirs, roots, cells = [], [], []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist()):
                found = []
                for sec in parse(text):
                    regex = section_regex(sec.pattern)
                    try:
                        re.compile(regex.replace(r"\z", r"\Z"))
                    except re.error:
                        continue
                    found.append({"regex": regex, **{k: sec.properties.get(k) for k in PROPERTIES}})
                dirs.append(path.rpartition("/")[0])
                roots.append(is_root(text))
                cells.append(found)
            kind = pa.list_(pa.struct([(n, pa.string()) for n in ("regex", *PROPERTIES)]))
            yield pa.RecordBatch.from_arrays([pa.array(dirs, pa.string()), pa.array(roots, pa.bool_()), pa.array(cells, kind)], names=["dir", "root", "sections"])

    rows = configs.where("path is not null and text is not null").select("path", "text").where(globs.base(F.col("path")) == ".editorconfig")
    return rows.mapInArrow(run, f"dir string, root boolean, {_SECTIONS}")


#: Folders with sections of at most so many rows are broadcast.
SMALL = 100_000
_SECTIONS = f"sections array<struct<regex:string,{','.join(f'{p}:string' for p in PROPERTIES)}>>"


def _chains(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(dir, chain): for each folder of ``files`` with a section file in or above it those files' sections, the outermost
    first, from the nearest file that is a root on."""
    dirs = files.select(_folder(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).withColumn("up", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    told = parsed_configs(configs).withColumnRenamed("dir", "up")
    met = above.join(told, "up").groupBy("dir").agg(F.sort_array(F.collect_list(F.struct("depth", "root", "up", "sections"))).alias("all"))
    last_root = F.aggregate(F.col("all"), F.lit(0), lambda a, x: F.when(x["root"], x["depth"]).otherwise(a))
    return met.withColumn("from", last_root).select("dir", F.filter("all", lambda x: x["depth"] >= F.col("from")).alias("chain"))


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def nested_definitions(files: DataFrame, configs: DataFrame) -> DataFrame:
    """``files`` with a column a property, resolved from all ``.editorconfig`` files above each (``configs(path, text)``).

    A file's sections apply to paths under its folder and match relative to it. Of nested files the nearer one decides, in a file the last
    matching section that sets the property; a file with ``root = true`` hides all above it. Folders meet the
    section files above them once, files then take their folder's chain: sections are folded natively, per property.

    Defined cases: ``unset`` and no section give null; files in folders without any section file keep all nulls; a null path too; own columns of
    the properties' names are replaced.
    """
    keep = [c for c in files.columns if c not in PROPERTIES]
    chains = _chains(files, configs)
    # a chain has a few hundred bytes a section; beyond the bound the join shuffles
    chains = F.broadcast(chains) if chains.count() <= SMALL else chains
    rows = files.select(*keep, _folder(F.col("path")).alias("_dir")).join(chains.withColumnRenamed("dir", "_dir"), "_dir", "left")
    relative = lambda x: F.when(x["up"] == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length(x["up"]) + 2, F.length("path")))
    empty = F.struct(*[F.lit(None).cast("string").alias(p) for p in PROPERTIES])
    matching = F.flatten(F.transform("chain", lambda x: F.filter(x["sections"], lambda s: F.rlike(relative(x), s["regex"]))))
    folded = F.aggregate(matching, empty, lambda a, s: F.struct(*[F.coalesce(s[p], a[p]).alias(p) for p in PROPERTIES]))
    rows = rows.withColumn("_props", F.coalesce(folded, empty))
    return rows.select(*keep, *[F.nullif(F.col("_props")[p], F.lit("unset")).alias(p) for p in PROPERTIES])


def definitions(files: DataFrame, sections: list[Section] | DataFrame) -> DataFrame:
    """The properties of each file, by one section list or by a table of nested section files."""
    if isinstance(sections, DataFrame):
        return nested_definitions(files, sections)
    return files.withColumns({p: property_of(F.col("path"), sections, p) for p in PROPERTIES})


def trailing_blank(line: Column) -> Column:
    bare = F.regexp_replace(line, r"\r+\z", "")
    return bare.rlike(r"[ \t]\z")


def check(files: DataFrame, sections: list[Section] | DataFrame) -> DataFrame:
    """``files(path, content, text)`` to findings, one a rule and file at most; ``sections`` as in ``definitions``."""
    d = definitions(files, sections)
    marked = d.where((F.col("charset") == "utf-8") & encoding.has_bom(F.col("content")))
    final = d.where((F.col("insert_final_newline") == "true") & (F.col("text") != "") & ~F.endswith("text", F.lit("\n")))
    parts = [finding(marked, "editorconfig", "charset_bom", 1), finding(final, "editorconfig", "final_newline", 0)]
    rules = F.col("end_of_line").isin("lf", "crlf") | (F.col("trim_trailing_whitespace") == "true") | F.col("indent_style").isin("space", "tab")
    rows = d.where(rules).select("path", "end_of_line", "trim_trailing_whitespace", "indent_style", F.size(F.split("text", "\n", -1)).alias("n"), "text")
    lines = explode_lines(rows)
    l = F.col("line_text")  # noqa: E741
    ends = F.endswith("line_text", F.lit("\r"))
    wrong_end = (F.col("line") < F.col("n")) & (((F.col("end_of_line") == "lf") & ends) | ((F.col("end_of_line") == "crlf") & ~ends))
    blank_end = (F.col("trim_trailing_whitespace") == "true") & trailing_blank(l)
    indent = F.regexp_extract(l, r"^([ \t]+)[^ \t\r]", 1)
    counted = F.when(F.col("indent_style").isin("space", "tab") & (indent != ""), F.lit(1)).otherwise(0)
    nth = F.sum(counted).over(W.partitionBy("path").orderBy("line"))
    bad_indent = ((F.col("indent_style") == "space") & indent.contains("\t")) | ((F.col("indent_style") == "tab") & indent.contains(" ") & ~indent.startswith("\t"))
    lines = lines.withColumn("bad_indent", (counted == 1) & (nth <= SAMPLE_LINES) & bad_indent)
    first = lines.groupBy("path").agg(F.min(F.when(wrong_end, F.col("line"))).alias("end_of_line"), F.min(F.when(blank_end, F.col("line"))).alias("trailing_whitespace"), F.min(F.when(F.col("bad_indent"), F.col("line"))).alias("indent_style"))
    for code in ("end_of_line", "trailing_whitespace", "indent_style"):
        parts.append(finding(first.where(F.col(code).isNotNull()), "editorconfig", code, F.col(code)))
    return union(parts)
