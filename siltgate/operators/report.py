"""Registry of checks, summaries, JSON reports, guides and message templates."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PolicyConfig
from . import catalogue, changes, editorconfig, files, lint, repo
from .findings import finding, union


@dataclass(frozen=True)
class Inputs:
    """Tables a run can read; None where a mode has none."""

    corpus: DataFrame
    paths: DataFrame | None = None
    diff: DataFrame | None = None
    old: DataFrame | None = None
    attributes: DataFrame | None = None
    sections: tuple = ()


@dataclass(frozen=True)
class Check:
    name: str
    run: Callable[[Inputs, PolicyConfig], DataFrame] | None
    diff: Callable[[Inputs, PolicyConfig], DataFrame] | None


def _changed(i: Inputs) -> DataFrame:
    return i.corpus.join(i.diff.where("not is_deleted").select("path").distinct(), "path", "left_semi")


def _lint(corpus: DataFrame, cfg: PolicyConfig) -> DataFrame:
    rows = lint.lint(corpus, cfg)
    return finding(rows, "lint", F.concat(F.lit("lint_"), F.col("kind")), "line", message=F.col("message"))


#: In the order of reports.
CHECKS = [
    Check("binary", lambda i, c: files.binary_files(i.corpus, c, i.attributes), lambda i, c: files.binary_files(_changed(i), c, i.attributes)),
    Check("encoding", lambda i, c: files.encoding_findings(i.corpus, c, list(i.sections)), lambda i, c: files.encoding_findings(_changed(i), c, list(i.sections))),
    Check("unicode", lambda i, c: files.unicode_findings(i.corpus, c), lambda i, c: files.unicode_findings(_changed(i), c)),
    Check("lint", lambda i, c: _lint(i.corpus, c), lambda i, c: _lint(_changed(i), c)),
    Check("editorconfig", lambda i, c: editorconfig.check(i.corpus, list(i.sections)), lambda i, c: editorconfig.check(_changed(i), list(i.sections))),
    Check("comment_language", lambda i, c: files.comment_language(i.corpus, c), lambda i, c: changes.comment_language(i.diff, _changed(i), c)),
    Check("custom_rules", None, lambda i, c: changes.custom_rules(i.diff, _changed(i), c)),
    Check("protected_paths", None, lambda i, c: changes.protected_paths(i.diff, c)),
    Check("append_only", None, lambda i, c: changes.append_only(i.diff, i.old, i.corpus, c)),
    Check("cache_dir", lambda i, c: repo.committed_cache_dirs(i.paths, c), lambda i, c: repo.staged_cache_dirs(i.diff, i.paths, c)),
]
ORDINAL = {c.name: n for n, c in enumerate(CHECKS)}


def selected(diff: bool, only: str = "") -> list[Check]:
    """The checks of a mode, or the listed ones (comma-separated); an unknown name is an error."""
    have = [c for c in CHECKS if (c.diff if diff else c.run)]
    names = [n.strip() for n in only.split(",") if n.strip()]
    if unknown := [n for n in names if n not in {c.name for c in have}]:
        raise ValueError(f"unknown check {unknown[0]!r}; known: {', '.join(c.name for c in have)}")
    return [c for c in have if not names or c.name in names]


def with_only(cfg: PolicyConfig, names: list[str]) -> PolicyConfig:
    """A copy in which the chosen checks are switched on; the two character flags keep their value."""
    on = set(names)
    return replace(
        cfg,
        comment_language=replace(cfg.comment_language, enabled=cfg.comment_language.enabled or "comment_language" in on),
        binary_file=replace(cfg.binary_file, enabled=cfg.binary_file.enabled or "binary" in on),
        encoding=replace(cfg.encoding, enabled=cfg.encoding.enabled or bool(on & {"encoding", "unicode"})),
        lint_enabled=cfg.lint_enabled or "lint" in on,
        editorconfig_enabled=cfg.editorconfig_enabled or "editorconfig" in on,
        cache_dir_enabled=cfg.cache_dir_enabled or "cache_dir" in on,
        protected_enabled=cfg.protected_enabled or "protected_paths" in on,
        append_only_enabled=cfg.append_only_enabled or "append_only" in on,
    )


def _enabled(name: str, cfg: PolicyConfig, i: Inputs) -> bool:
    return {
        "comment_language": cfg.comment_language.enabled,
        "binary": cfg.binary_file.enabled,
        "encoding": cfg.encoding.enabled and cfg.encoding.require_utf8,
        "unicode": cfg.encoding.enabled,
        "lint": cfg.lint_enabled,
        "editorconfig": cfg.editorconfig_enabled and bool(i.sections),
        "cache_dir": cfg.cache_dir_enabled and i.paths is not None,
        "custom_rules": bool(cfg.custom_diff_rules),
        "protected_paths": cfg.protected_enabled,
        "append_only": cfg.append_only_enabled and i.old is not None,
    }[name]


def findings(inputs: Inputs, cfg: PolicyConfig, only: str = "") -> DataFrame:
    """All enabled checks as one plan; a disabled one builds no branch."""
    diff = inputs.diff is not None
    checks = selected(diff, only)
    cfg = with_only(cfg, [c.name for c in checks]) if only else cfg
    parts = [(c.diff if diff else c.run)(inputs, cfg) for c in checks if cfg.enabled and _enabled(c.name, cfg, inputs)]
    return union(parts) if parts else finding(inputs.corpus.where("false"), "none", "none")


def ordinal(check: Column) -> Column:
    pairs = [F.lit(x) for kv in ORDINAL.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), check), F.lit(len(ORDINAL)))


def summary(found: DataFrame) -> DataFrame:
    """check, n in the order of the registry."""
    return found.groupBy("check").agg(F.count("*").alias("n")).orderBy(ordinal(F.col("check")), "check")


def report_json(found: DataFrame, guides: DataFrame | None = None) -> DataFrame:
    """One row with the JSON report: status, violations, summary and guides.

    The report is one document, so its findings meet in one row; large runs
    keep ``findings`` as a table and report the summary.
    """
    found = found.withColumn("message", message(F.col("code"), F.col("params")))
    rows = F.sort_array(F.collect_list(F.struct(ordinal(F.col("check")).alias("_o"), "path", "line", "col", "check", "message")))
    counts = found.groupBy("check").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("check", "n")))).alias("by_check"))
    listed = found.agg(F.transform(rows, lambda x: F.struct(x["path"].alias("file"), x["line"].alias("line"), x["message"].alias("message"), x["check"].alias("check"))).alias("violations"))
    one = counts.join(listed)  # both sides have one row
    parts = [F.when(F.col("total") == 0, "pass").otherwise("fail").alias("status"), "violations", F.struct("total", "by_check").alias("summary")]
    if guides is not None:
        text = failed_guides(found, guides).agg(F.array_sort(F.collect_list(F.struct("o", "text"))).alias("g"))
        one = one.join(text).withColumn("guides", F.transform("g", lambda x: x["text"]))
        parts.append("guides")
    return one.select(F.to_json(F.struct(*parts)).alias("report"))


def failed_guides(found: DataFrame, guides: DataFrame) -> DataFrame:
    """(o, check, text): one guide for each check with findings, in order."""
    return found.select("check").distinct().join(F.broadcast(guides), "check").select(ordinal(F.col("check")).alias("o"), "check", "text")


#: English texts by code.
TEMPLATES = {code: texts[0] for code, texts in catalogue.TEXTS.items()}


def interpolate(template: str, values: dict[str, str]) -> str:
    """Placeholders without a value stay."""
    return re.sub(r"%\{(\w+)\}", lambda m: str(values.get(m[1], m[0])), template)


def message(code: Column, params: Column, texts: dict[str, str] | None = None) -> Column:
    """A finding's text by one catalogue; a code without a template gives ``[code]``. ``catalogue.translated`` has all languages."""
    pairs = [F.lit(x) for kv in (texts or TEMPLATES).items() for x in kv]
    text = F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.concat(F.lit("["), code, F.lit("]")))
    return catalogue.filled(text, params)


def detect_locale(env: dict[str, str] | None = None) -> str:
    """The language of the first of SILTGATE_LANG, LC_ALL, LC_MESSAGES, LANG that is set; English for any but the catalogues' own."""
    env = os.environ if env is None else env
    value = next((v for k in ("SILTGATE_LANG", "LC_ALL", "LC_MESSAGES", "LANG") if (v := env.get(k, ""))), "")
    tag = re.split(r"(?<=.)[._]", value.lower())[0]
    return tag if tag in ("ko", "ja", "zh") else "en"


def message_hint(cfg: PolicyConfig, source: str = "", existing: str = "") -> str:
    """A comment block on the message policy for an editor; empty where a message is given or has it already."""
    head = "# Message policy"
    if source in ("message", "merge", "squash", "commit") or head in existing:
        return ""
    m, out = cfg.commit_message, [head]
    if m.conventional_enabled:
        out.append("# type(scope): text, with type one of " + ", ".join(m.all_types()))
    if m.language_enabled:
        out.append(f"# language: {m.required_language}")
    if m.subject_limit_enabled:
        out.append(f"# subject: at most {m.subject_limit} characters")
    if m.body_limit_enabled:
        out.append(f"# body lines: at most {m.body_limit} characters")
    return "\n".join(out) + "\n"
