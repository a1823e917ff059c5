"""Checks of change sets: ``files`` from ``parse_diff``, contents by reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PolicyConfig
from ..functions import globs
from ..sources.gitdiff import added_lines
from .files import comment_units, judge_units
from .findings import finding, union
from .lines import explode_lines


def comment_language(files: DataFrame, contents: DataFrame, cfg: PolicyConfig) -> DataFrame:
    """As the whole-file check, for units with an added line (all units in full mode)."""
    kept = files.where("not is_deleted and not is_submodule and not is_symlink")
    corpus = contents.join(kept.select("path").distinct(), "path", "left_semi")
    return judge_units(comment_units(corpus, cfg, None if cfg.comment_language.full else added_lines(files)), cfg)


def custom_rules(files: DataFrame, contents: DataFrame, cfg: PolicyConfig) -> DataFrame:
    """Added lines that meet a rule; required rules have no meaning here. All rules are tested in one pass."""
    rules = [(i, r) for i, r in enumerate(cfg.custom_diff_rules) if r.get("pattern") and not r.get("required")]
    lines = explode_lines(contents.select("path", "text")).join(added_lines(files), ["path", "line"])
    if not rules:
        return finding(lines.where("false"), "custom_rules", "none")
    hits = F.array_compact(F.array(*[F.when(F.col("line_text").rlike("(?dU)" + r["pattern"]), F.struct(F.lit(i).alias("seq"), F.lit(r.get("name", "")).alias("rule"), F.lit(r.get("message", "")).alias("message"))) for i, r in rules]))
    rows = lines.select("path", "line", F.explode(hits).alias("h"))
    return finding(rows, "custom_rules", "custom_rule", "line", rule=F.col("h.rule"), message=F.col("h.message"), seq=F.col("h.seq"))


def protected_paths(files: DataFrame, cfg: PolicyConfig) -> DataFrame:
    """Any change of a protected path."""
    code = F.when(F.col("is_deleted"), "protected_deleted").when(F.col("is_new"), "protected_added").otherwise("protected_modified")
    return finding(files.where(globs.matches_any(F.col("path"), cfg.protected_paths)), "protected_paths", code)


def natural_key(name: Column) -> Column:
    """Digit runs padded to 20 places, so that plain order is natural order."""
    return F.regexp_replace(F.regexp_replace(name, r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")


def directory(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*)/[^/]+/*$", 1), F.lit("")), F.lit("."))


def filename_order(new: DataFrame, existing: DataFrame, patterns: list[str]) -> DataFrame:
    """New files whose name does not come after all existing ones of the same folder (same globs), with the latest one."""
    tracked = existing.where(globs.matches_any(F.col("path"), patterns))
    latest = tracked.groupBy(directory(F.col("path")).alias("dir")).agg(F.max_by(globs.base(F.col("path")), F.encode(natural_key(globs.base(F.col("path"))), "UTF-8")).alias("latest"))
    rows = new.where(globs.matches_any(F.col("path"), patterns)).withColumn("dir", directory(F.col("path"))).join(latest, "dir")
    mine, top = (F.encode(natural_key(c), "UTF-8") for c in (globs.base(F.col("path")), F.col("latest")))
    return rows.where(~(top < mine)).select("path", "latest")


def append_only(files: DataFrame, old: DataFrame, new: DataFrame, cfg: PolicyConfig) -> DataFrame:
    """Append-only paths: deleted files, changed beginnings, and new files out of order.

    ``old`` and ``new`` are (path, content) at both sides; a file that the old side lacks is not compared.
    """
    rows = files.where(globs.matches_any(F.col("path"), cfg.append_only_paths))
    gone = finding(rows.where("is_deleted"), "append_only", "append_only_deleted")
    kept = rows.where("not is_deleted and not is_new")
    was, now = (d.select("path", F.col("content").alias(n)) for d, n in ((old, "was"), (new, "now")))
    both = kept.join(was, "path").join(now, "path")
    changed = finding(both.where(~F.startswith("now", F.col("was"))), "append_only", "append_only_modified")
    parts = [gone, changed]
    if cfg.filename_order == "numeric":
        late = filename_order(rows.where("is_new").select("path"), old.select("path"), cfg.append_only_paths)
        parts.append(finding(late, "append_only", "append_only_order", latest=F.col("latest")))
    return union(parts)
