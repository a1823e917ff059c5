"""Versions of the configuration schema: which one a document has, and how it is brought up to date.

A version is what the one before it has, less what it drops, plus what it adds. A document belongs to the
oldest version that takes all of its keys, unless it has a key that marks a newer one that takes them too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .config import parse

#: Keys of the first version, with their kinds (? flag, # number, $ text, * list of texts, % map of texts; [] items of a list).
FIRST = """preset.url$ preset.cache.enabled? preset.cache.ttl$ preset.cache.dir$
comment_language.enabled? comment_language.required_language$ comment_language.languages* comment_language.extensions* comment_language.min_length# comment_language.skip_directives*
comment_language.check_mode$ comment_language.ignore_files* comment_language.locale$ comment_language.check_strings? comment_language.skip_technical_strings?
comment_language.file_languages[].pattern$ comment_language.file_languages[].language$
commit_message.no_coauthor? commit_message.coauthor_remove_emails* commit_message.no_unicode_spaces? commit_message.no_ambiguous_chars? commit_message.no_bad_runes? commit_message.locale$
commit_message.language_check.enabled? commit_message.language_check.required_language$ commit_message.language_check.min_length# commit_message.language_check.skip_prefixes*
commit_message.conventional_commit.enabled? commit_message.conventional_commit.types* commit_message.conventional_commit.require_scope? commit_message.conventional_commit.allow_merge_commits? commit_message.conventional_commit.allow_revert_commits?
exceptions.global_ignore* exceptions.comment_language_ignore*"""
#: Later versions by name, with what they drop and add and the keys that mark them.
LATER = {
    "v1.0.1": (
        "",
        """comment_language.no_emoji? commit_message.enabled? commit_message.no_emoji? commit_message.conventional_commit.type_aliases% commit_message.conventional_commit.locale$
        binary_file.enabled? binary_file.ignore_files* lint.enabled? lint.yaml.enabled? lint.yaml.comment_filter? lint.yaml.ignore_files* lint.json.enabled? lint.json.allow_json5? lint.json.comment_filter? lint.json.ignore_files*
        lint.xml.enabled? lint.xml.ignore_files* encoding.enabled? encoding.require_utf8? encoding.ignore_files* editorconfig.enabled? editorconfig.ignore_files*""",
        "binary_file lint encoding editorconfig commit_message.enabled commit_message.no_emoji comment_language.no_emoji",
    ),
    "v1.0.2": ("commit_message.no_coauthor?", "commit_message.no_ai_coauthor?", "commit_message.no_ai_coauthor"),
    "v1.1.0": (
        "",
        """comment_language.allowed_words* comment_language.allowed_words_file$ comment_language.allowed_words_url$ comment_language.allowed_words_cache.enabled? comment_language.allowed_words_cache.ttl$ comment_language.allowed_words_cache.dir$
        encoding.no_invisible_chars? encoding.no_ambiguous_chars? encoding.locale$""",
        "comment_language.allowed_words comment_language.allowed_words_file comment_language.allowed_words_url comment_language.allowed_words_cache encoding.no_invisible_chars encoding.no_ambiguous_chars encoding.locale",
    ),
    "v1.2.0": (
        "comment_language.required_language$ comment_language.file_languages[].language$ commit_message.language_check.required_language$",
        "comment_language.file_languages[].locale$ commit_message.language_check.locale$",
        "comment_language.allowed_words comment_language.allowed_words_file comment_language.allowed_words_url comment_language.allowed_words_cache encoding.no_invisible_chars encoding.no_ambiguous_chars encoding.locale",
    ),
}
CURRENT, UNKNOWN = "v1.2.0", "unknown"
#: The version after which keys have new names, then old and new names; an old key beside its new one goes.
RENAMES = {"v1.0.1": [("no_coauthor", "no_ai_coauthor")], "v1.1.0": [("required_language", "locale"), ("language", "locale")]}
#: What a rename is told as.
TOLD = {"v1.0.1": "commit_message.no_coauthor → commit_message.no_ai_coauthor", "v1.1.0": "required_language / language → locale"}


@dataclass
class Version:
    name: str
    kinds: dict[str, str]
    marks: list[str] = field(default_factory=list)


def _keys(text: str) -> dict[str, str]:
    return {k[:-1]: k[-1] for k in text.split()}


def versions() -> list[Version]:
    """All versions, the oldest first."""
    out = [Version("v1.0.0", _keys(FIRST))]
    for name, (dropped, added, marks) in LATER.items():
        gone = _keys(dropped)
        out.append(Version(name, {k: v for k, v in out[-1].kinds.items() if k not in gone} | _keys(added), marks.split()))
    return out


def _text(v: object) -> bool:
    return isinstance(v, str)


_IS = {
    "?": lambda v: v is None or isinstance(v, bool),
    "#": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "$": _text,
    "*": lambda v: isinstance(v, list) and all(map(_text, v)),
    "%": lambda v: isinstance(v, dict) and all(_text(k) and _text(x) for k, x in v.items()),
}


def accepts(version: Version, node: object, at: str = "") -> bool:
    """Whether a version knows every key of a document and the kind of every value."""
    kind = version.kinds.get(at)
    if kind:
        return _IS[kind](node)
    if any(k.startswith(f"{at}[].") for k in version.kinds):
        return isinstance(node, list) and all(accepts(version, x, f"{at}[]") for x in node)
    if at and not any(k.startswith(f"{at}.") for k in version.kinds):
        return False
    return isinstance(node, dict) and all(_text(k) and accepts(version, v, f"{at}.{k}" if at else k) for k, v in node.items())


def _has(node: object, path: str) -> bool:
    for name in path.split("."):
        if not isinstance(node, dict) or name not in node:
            return False
        node = node[name]
    return True


def detect_version(text: str) -> str:
    """The name of a document's version, ``unknown`` for one that no version takes. An empty document is of the first."""
    try:
        doc = parse(text)
    except ValueError:
        return UNKNOWN
    doc = {} if doc is None else doc
    taken = [v for v in versions() if accepts(v, doc)]
    if not taken:
        return UNKNOWN
    marked = [v for v in taken[1:] if any(_has(doc, m) for m in v.marks)]
    return marked[-1].name if marked else taken[0].name


def _line(key: str) -> re.Pattern:
    return re.compile(rf"^([ \t]*){re.escape(key)}:")


def _without_stale(lines: list[str], old: str, new: str) -> list[str]:
    """Without the lines of ``old`` whose block has ``new``: the lines about it that are indented no less."""
    indent = lambda x: len(x) - len(x.lstrip(" \t"))
    blank = lambda x: not x.strip() or x.lstrip(" \t").startswith("#")

    def peer(i: int) -> bool:
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(lines) and (blank(lines[j]) or indent(lines[j]) >= indent(lines[i])):
                if not blank(lines[j]) and indent(lines[j]) == indent(lines[i]) and _line(new).match(lines[j]):
                    return True
                j += step
        return False

    return [x for i, x in enumerate(lines) if not (_line(old).match(x) and peer(i))]


def migrate(text: str) -> tuple[str, list[str]]:
    """A document in the current version, and what was renamed, line by line, so that comments and order stay.

    ValueError: a document that no version takes, before or after.
    """
    name = detect_version(text)
    if name == UNKNOWN:
        raise ValueError("the configuration is of no known version")
    if name == CURRENT:
        return text, []
    order, told = [v.name for v in versions()], []
    lines = text.split("\n")
    for step in order[order.index(name) :]:
        for old, new in RENAMES.get(step, []):
            lines = _without_stale(lines, old, new) if len(RENAMES[step]) > 1 else lines
        for old, new in RENAMES.get(step, []):
            lines = [_line(old).sub(rf"\g<1>{new}:", x) for x in lines]
        told += [TOLD[step]] if step in RENAMES else []
    out = "\n".join(lines)
    if not accepts(versions()[-1], parse(out) or {}):
        raise ValueError("the configuration is of no known version after its keys were renamed")
    return out, told
