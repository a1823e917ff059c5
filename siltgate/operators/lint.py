"""Syntax of data files. Parsers of nested formats run on Arrow batches; dispatch and filters stay native."""

from __future__ import annotations

import json
import re
import tomllib
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LOCK_FILES, PolicyConfig
from ..functions import globs

#: A string, or a comment to take out.
_COMMENT = re.compile(r'("(?:\\[\s\S]|[^"\\])*(?:"|\Z)|\'(?:\\[\s\S]|[^\'\\])*(?:\'|\Z))|(//[^\n]*)|(/\*[\s\S]*?\*/)|(/\*)')
_JSON_BLANK = re.compile(r"[ \t\n\r]*")
TOOL = "siltgate"

Error = tuple[int, str]


def line_at(text: str, offset: int) -> int:
    return 1 + text.count("\n", 0, offset)


def strip_comments(text: str) -> str:
    """Comments outside strings removed, newlines of block comments kept; ValueError if a block is open."""

    def put(m: re.Match) -> str:
        if m[4]:
            raise ValueError("a block comment is not closed")
        return m[1] if m[1] is not None else "\n" * m[3].count("\n") if m[3] else ""

    return _COMMENT.sub(put, text)


def strip_trailing_commas(text: str) -> str:
    """Commas before a closing bracket removed, inside strings too."""
    return re.sub(r",(?=[ \t\n\r]*[}\]])", "", text)


def strip_trailing_commas_column(text: Column) -> Column:
    return F.regexp_replace(text, r",(?=[ \t\n\r]*[}\]])", "")


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def check_json(text: str) -> list[Error]:
    """Values separated by white space, none included; the first error only."""
    decoder = json.JSONDecoder(parse_constant=_no_constant)
    at = _JSON_BLANK.match(text).end()
    while at < len(text):
        try:
            _, at = decoder.raw_decode(text, at)
        except json.JSONDecodeError as e:
            return [(e.lineno, e.msg)]
        except (ValueError, RecursionError) as e:
            return [(line_at(text, at), str(e))]
        at = _JSON_BLANK.match(text, at).end()
    return []


def check_jsonc(text: str) -> list[Error]:
    try:
        return check_json(strip_comments(text))
    except ValueError as e:
        return [(0, str(e))]


def check_relaxed_json(text: str) -> list[Error]:
    """JSON with comments and trailing commas; keys still need quotes."""
    try:
        return check_json(strip_trailing_commas(strip_comments(text)))
    except ValueError as e:
        return [(0, str(e))]


def check_yaml(text: str) -> list[Error]:
    """All documents; the first error, of no line. Needs PyYAML."""
    try:
        import yaml
    except ImportError:
        return []
    try:
        for _ in yaml.safe_load_all(text):
            pass
    except yaml.YAMLError as e:
        return [(0, str(e).split("\n")[0])]
    except (ValueError, RecursionError) as e:
        return [(0, str(e))]
    return []


def check_toml(text: str) -> list[Error]:
    try:
        tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        m = re.search(r"line (\d+)", str(e))
        return [(int(m[1]) if m else line_at(text, len(text)), str(e))]
    except RecursionError as e:
        return [(0, str(e))]
    return []


def check_xml(text: str) -> list[Error]:
    """Balanced and well-formed; nothing at all is valid, and so are several roots."""
    body = re.sub(r"\A\ufeff?\s*(?:<\?xml[^>]*\?>)?\s*(?:<!DOCTYPE(?:[^\[>]|\[[^\]]*\])*>)?", lambda m: "\n" * m[0].count("\n"), text)
    parser = expat.ParserCreate()
    parser.UseForeignDTD(True)
    try:
        parser.Parse("<r>" + body + "</r>", True)
    except expat.ExpatError as e:
        return [(e.lineno, expat.ErrorString(e.code))]
    return []


CHECKS = {"yaml": check_yaml, "json": check_json, "jsonc": check_jsonc, "relaxed_json": check_relaxed_json, "xml": check_xml, "toml": check_toml}


def has_skip_comment(text: Column, prefixes: tuple[str, ...] = ("#", "//"), tool: str = TOOL) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.contains(f"{p} {tool}: skip-lint")
    return out


def lint_kind(path: Column, text: Column, cfg: PolicyConfig) -> Column:
    """The check for a file, null for none: by extension, switches, ignore lists and skip comments."""
    ext, rule = globs.ext_lower(path), cfg.lint
    spared = lambda r: globs.matches_any(path, r.ignore_files) if r.ignore_files else F.lit(False)
    yaml_skip = has_skip_comment(text, ("#",)) if rule["yaml"].comment_filter else F.lit(False)
    json_skip = (globs.matches_any(path, rule["json"].ignore_files) if rule["json"].ignore_files else globs.base(path).isin(LOCK_FILES))
    json_kind = "relaxed_json" if rule["json"].relaxed else "jsonc" if rule["json"].comment_filter else "json"
    out = F.when(F.lit(not cfg.lint_enabled), F.lit(None).cast("string"))
    out = out.when(ext.isin(".yaml", ".yml") & F.lit(rule["yaml"].enabled) & ~spared(rule["yaml"]) & ~yaml_skip, "yaml")
    out = out.when((ext == ".jsonc") & F.lit(rule["json"].enabled), "relaxed_json")
    out = out.when((ext == ".json") & F.lit(rule["json"].enabled) & ~json_skip, json_kind)
    out = out.when((ext == ".xml") & F.lit(rule["xml"].enabled) & ~spared(rule["xml"]), "xml")
    return out.when((ext == ".toml") & F.lit(rule["toml"].enabled) & ~spared(rule["toml"]), "toml")


def lint(files: DataFrame, cfg: PolicyConfig | None = None) -> DataFrame:
    """``files(path, text)`` to errors(path, kind, line, message); line 0 is unknown."""

    def run(batches):
        for b in batches:
            out = [(p, k, *e) for p, k, t in zip(*(b.column(c).to_pylist() for c in ("path", "kind", "text"))) for e in CHECKS[k](t)]
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int64(), pa.string()])], names=["path", "kind", "line", "message"])

    rows = files.where("path is not null and text is not null").withColumn("kind", lint_kind(F.col("path"), F.col("text"), cfg or PolicyConfig()))
    return rows.where("kind is not null").select("path", "kind", "text").mapInArrow(run, "path string, kind string, line long, message string")
