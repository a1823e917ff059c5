"""Comment and string extraction: a token grammar per language, scanned by one regular expression.

Each lexer yields (text, line, end_line, is_block, kind). Strings are tokens
because directives and units need to know where comments don't begin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Row = tuple[str, int, int, bool, str]

DQ, SQ = r'"(?:\\[\s\S]|[^"\\\n]|\\\Z)*(?:"|(?=\n)|\Z)', r"'(?:\\[\s\S]|[^'\\\n]|\\\Z)*(?:'|(?=\n)|\Z)"
LINE, BLOCK = r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)"
_ESCAPED = re.compile(r"\\[\s\S]")
_IMPORTS = re.compile(r"\s*(?:#include[\s\S]*|(?:[\s\S]* )?from|import)\s*\Z")


def clean_block(raw: str) -> str:
    """Lines without blanks and one leading star; empty ones dropped."""
    lines = (re.sub(r"^\*", "", x.strip()).strip() for x in raw.split("\n"))
    return "\n".join(x for x in lines if x)


class Scanner:
    """Tokens with their line, and the code before them on the current line."""

    def __init__(self, grammar: str) -> None:
        self.grammar = re.compile(grammar)

    def tokens(self, source: str) -> Iterator[tuple[re.Match, int, int, str]]:
        """(match, line, end line, code before it). Newlines after a backslash in quotes are not counted as lines."""
        line, at, code = 1, 0, ""
        for m in self.grammar.finditer(source):
            gap = source[at : m.start()]
            line += gap.count("\n")
            self.gap(gap, code)
            code = gap[gap.rfind("\n") + 1 :] if "\n" in gap else code + gap
            inside = m[0].count("\n")
            if m.lastgroup in ("dq", "sq"):
                inside = 0
            yield m, line, line + inside, code
            line += inside
            at = m.end()

    def gap(self, gap: str, code: str) -> None:
        """Called with the code between two tokens."""


_CSTYLE = Scanner(rf"(?P<line>{LINE})|(?P<block>{BLOCK})|(?P<dq>{DQ})|(?P<sq>{SQ})")
_TEMPLATES = Scanner(rf"(?P<line>{LINE})|(?P<block>{BLOCK})|(?P<dq>{DQ})|(?P<sq>{SQ})|(?P<tick>`(?:\\[\s\S]|[^`\\]|\\\Z)*(?:`|\Z))")


def _body(token: str, quote: str) -> str:
    inner = token[1:-1] if len(token) > 1 and token.endswith(quote) and not re.search(r"(?<!\\)(?:\\\\)*\\\Z", token[1:-1]) else token[1:]
    return _ESCAPED.sub("", inner)


def cstyle(source: str, templates: bool = False) -> Iterator[Row]:
    for m, line, end, code in (_TEMPLATES if templates else _CSTYLE).tokens(source):
        t = m[0]
        if m.lastgroup == "line":
            if text := t[2:].strip():
                yield text, line, end, False, "Comment"
        elif m.lastgroup == "block":
            if len(t) >= 4 and t.endswith("*/"):
                yield clean_block(t[2:-2]), line, end, True, "Comment"
        elif text := _body(t, t[0]):
            closed = m.lastgroup == "tick" and len(t) > 1 and t.endswith("`")
            yield text, line, end, False, "Import" if not closed and _IMPORTS.match(code) else "String"


_PYTHON = Scanner(rf"(?P<line>#[^\n]*)|(?P<long>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z))|(?P<dq>{DQ})|(?P<sq>{SQ})")
_SCRIPT_OPEN = re.compile(r"/// \s*[^\W_](?:[^\W_]|[-.])*\s*\Z|/// \s*[-.](?:[^\W_]|[-.])*\s*\Z")


def python(source: str) -> Iterator[Row]:
    script = False
    for m, line, end, _ in _PYTHON.tokens(source):
        t = m[0]
        if m.lastgroup == "line":
            text = t[1:].strip()
            if not text or line == 1 and text.startswith("!"):
                continue
            kind = "Comment"
            if script or _SCRIPT_OPEN.match(text):
                kind, script = "Import", not (script and text == "///")
            yield text, line, end, False, kind
        elif m.lastgroup == "long":
            body = t[3:-3] if len(t) >= 6 and t.endswith(t[:3]) else t[3:]
            if body:
                yield body.strip(), line, end, False, "String"
        elif body := _body(t, t[0]):
            yield body.strip(), line, end, False, "String"


class _GoScanner(Scanner):
    def __init__(self) -> None:
        super().__init__(rf"(?P<line>{LINE})|(?P<block>{BLOCK})|(?P<dq>{DQ})|(?P<raw>`[^`]*(?:`|\Z))|(?P<sq>{SQ})")
        self.block = False

    def gap(self, gap: str, code: str) -> None:
        for m in re.finditer(r"[()]", gap):
            before = gap[: m.start()]
            before = before[before.rfind("\n") + 1 :] if "\n" in before else code + before
            if m[0] == "(" and before.strip().endswith("import"):
                self.block = True
            elif m[0] == ")":
                self.block = False


_GO_GATE = re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))*+package(?!\w)(?:\s|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))*+[^\W\d]")
_GO_ESCAPE = re.compile(r"\\(?:([abfnrtv\\\"])|x([0-9A-Fa-f]{2})|([0-7]{3})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|([\s\S]|\Z))")
#: One-letter escapes.
_GO_CHARS = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, '"': 34}


def go_unquote(body: str) -> str:
    """An interpreted string's value; the raw text if an escape is malformed."""
    out, at = bytearray(), 0
    for m in _GO_ESCAPE.finditer(body):
        out += body[at : m.start()].encode("utf-8", "surrogatepass")
        at = m.end()
        if m[1]:
            out.append(_GO_CHARS[m[1]])
        elif m[2]:
            out.append(int(m[2], 16))
        elif m[3] and int(m[3], 8) < 256:
            out.append(int(m[3], 8))
        elif (m[4] or m[5]) and (code := int(m[4] or m[5], 16)) < 0x110000 and not 0xD800 <= code < 0xE000:
            out += chr(code).encode()
        else:
            return body
    return (out + body[at:].encode("utf-8", "surrogatepass")).decode("utf-8", "replace")


def go(source: str) -> list[Row]:
    if not _GO_GATE.match(source):
        return []
    scanner, rows = _GoScanner(), []
    for m, line, end, code in scanner.tokens(source):
        t = m[0]
        kind = "Import" if scanner.block or code.split()[:1] == ["import"] else "String"
        if m.lastgroup == "line":
            rows.append((t[2:].strip(), line, end, False, "Comment"))
        elif m.lastgroup == "block":
            if len(t) >= 4 and t.endswith("*/"):
                rows.append((clean_block(t[2:-2]), line, end, True, "Comment"))
        elif m.lastgroup == "raw":
            body = t[1:-1] if len(t) > 1 and t.endswith("`") else t[1:]
            if body := body.replace("\r", ""):
                rows.append((body, line, end, False, kind))
        elif m.lastgroup == "dq":
            closed = len(t) > 1 and t.endswith('"') and not re.search(r"(?<!\\)(?:\\\\)*\\\Z", t[1:-1])
            if body := go_unquote(t[1:-1]) if closed else t[1:][:-1]:
                rows.append((body, line, end, False, kind))
    return sorted(rows, key=lambda r: (r[1], r[4] != "Comment"))


def dockerfile(source: str) -> Iterator[Row]:
    for n, text in enumerate(source.split("\n"), 1):
        body = text.partition("#")[2].strip()
        if body and not (n == 1 and body.startswith("!")):
            yield body, n, n, False, "Comment"


def hash_style(source: str, blocks: bool = False) -> Iterator[Row]:
    inside: list[str] | None = None
    first = n = 0
    for n, text in enumerate(source.split("\n"), 1):
        if blocks and inside is None and text.startswith("=begin"):
            inside, first = [], n
        elif inside is not None:
            if text.startswith("=end"):
                if body := "\n".join(x for x in inside if x):
                    yield body, first, n, True, "Comment"
                inside = None
            else:
                inside.append(text.strip())
        else:
            t = text.strip()
            if t.startswith("#") and not (n == 1 and t.startswith("#!")) and (body := t[1:].strip()):
                yield body, n, n, False, "Comment"
    if inside is not None and (body := "\n".join(x for x in inside if x)):
        yield body, first, n, True, "Comment"


def html(source: str) -> Iterator[Row]:
    line, at = 1, 0
    for m in re.finditer(r"<!--([\s\S]*?)-->", source):
        line += source.count("\n", at, m.start())
        at = m.start()
        if body := clean_block(m[1]):
            yield body, line, line + m[0].count("\n"), True, "Comment"


_LINK = re.compile(r"""\[//\]: # (?:\(([^)]*)\)|"([^"]*)"|'([^']*)')""")


def markdown(source: str) -> Iterator[Row]:
    lines = source.split("\n")
    n, fenced = 0, False
    while n < len(lines):
        t = lines[n].strip()
        n += 1
        if t.startswith(("```", "~~~")):
            fenced = not fenced
        elif fenced:
            continue
        elif t.startswith("<!--"):
            first = n
            while "-->" not in lines[n - 1] and n < len(lines):
                n += 1
            raw = "\n".join(lines[first - 1 : n]).strip()
            end = raw.find("-->")
            if end >= 4 and (body := raw[4:end].strip()):
                yield body, first, n, True, "Comment"
        elif m := _LINK.match(t):
            if body := (m[1] or m[2] or m[3] or "").strip():
                yield body, n, n, False, "Comment"


class _Hcl:
    """Strings nest through their interpolations, so they are followed by depth."""

    step = re.compile(r'\n|#[^\n]*|//[^\n]*|/\*|"|<<-?(\w+)[^\n]*\n')
    quoted = re.compile(r'\\[\s\S]?|\n|"|\$\$\{|%%\{|[$%]\{')
    inner = re.compile(r'\\[\s\S]?|\n|"|[{}]')

    def __init__(self, source: str) -> None:
        self.s, self.line = source, 1

    def string(self, at: int) -> tuple[int, int]:
        """From the place after a quote: the body's end and where to go on."""
        while m := self.quoted.search(self.s, at):
            at = m.end()
            if m[0] == "\n":
                return m.start(), m.start()
            if m[0] == '"':
                return m.start(), at
            if m[0] in ("${", "%{"):
                depth = 1
                while depth and (k := self.inner.search(self.s, at)):
                    at = k.end()
                    if k[0] == "\n":
                        self.line += 1
                    elif k[0] == '"':
                        _, at = self.string(at)
                    elif k[0] in "{}":
                        depth += 1 if k[0] == "{" else -1
                if depth:
                    return len(self.s), len(self.s)
        return len(self.s), len(self.s)

    def rows(self) -> Iterator[Row]:
        at = 0
        while m := self.step.search(self.s, at):
            t, at, first = m[0], m.end(), self.line
            if t == "\n":
                self.line += 1
            elif t[0] == "#" or t[:2] == "//":
                if body := t[1 if t[0] == "#" else 2 :].strip():
                    yield body, first, first, False, "Comment"
            elif t == "/*":
                end = self.s.find("*/", at)
                raw = self.s[at:] if end < 0 else self.s[at:end]
                at = len(self.s) if end < 0 else end + 2
                self.line += raw.count("\n")
                yield clean_block(raw), first, self.line, True, "Comment"
            elif t == '"':
                end, to = self.string(at)
                if body := self.s[at:end].replace("$${", "${").replace("%%{", "%{"):
                    yield body, first, self.line, False, "String"
                at = to
            else:
                lines = []
                line = first + 1
                while True:
                    stop = self.s.find("\n", at)
                    text = self.s[at:] if stop < 0 else self.s[at:stop]
                    closed = text.strip() == m[1]
                    if not closed:
                        lines.append(text)
                    if closed or stop < 0:
                        at = len(self.s) if stop < 0 else stop
                        break
                    at, line = stop + 1, line + 1
                self.line = line
                if body := "\n".join(lines):
                    yield body, first, line, False, "String"


def hcl(source: str) -> Iterator[Row]:
    return _Hcl(source).rows()


#: The extensions of each language; Dockerfiles go by name.
EXTENSIONS = {
    "go": [".go"], "typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "java": [".java"], "kotlin": [".kt", ".kts"], "python": [".py"],
    "c": [".c", ".h"], "cpp": [".cpp", ".cc", ".cxx", ".hpp"], "csharp": [".cs"], "swift": [".swift"], "rust": [".rs"], "dockerfile": ["dockerfile"],
    "markdown": [".md", ".markdown"], "ruby": [".rb", ".rake", ".gemspec"], "shell": [".sh", ".bash", ".zsh", ".fish", ".ksh"], "php": [".php", ".phtml"],
    "html": [".html", ".htm", ".svg"], "hcl": [".hcl", ".tf", ".tfvars"],
}
LEXERS = {
    "go": go, "typescript": lambda s: cstyle(s, True), "javascript": lambda s: cstyle(s, True), **{k: cstyle for k in ("java", "kotlin", "c", "cpp", "csharp", "swift", "rust", "php")},
    "python": python, "dockerfile": dockerfile, "markdown": markdown, "ruby": lambda s: hash_style(s, True), "shell": hash_style, "html": html, "hcl": hcl,
}
BY_EXTENSION = {e: k for k, es in EXTENSIONS.items() for e in es}


def language_of(path: str) -> str | None:
    """Dockerfiles by name, others by their extension as it is written."""
    name = path.rstrip("/").rpartition("/")[2]
    low = name.lower()
    if low == "dockerfile" or low.startswith("dockerfile.") or low.endswith(".dockerfile"):
        return "dockerfile"
    stem, dot, ext = name.rpartition(".")
    return BY_EXTENSION.get("." + ext) if dot and stem and ext != "dockerfile" else None


def extensions_for(languages: list[str]) -> list[str]:
    return list(dict.fromkeys(e for k in languages for e in EXTENSIONS.get(k, [])))
