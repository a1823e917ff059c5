"""The registered queries and the SQL they are checked against.

Every query runs over its whole tables. State-machine parsers and data-file
syntax have no fair SQL form; those queries are checked by pytest instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TYPES, PolicyConfig
from ..functions import chars, encoding, globs, language
from ..operators import catalogue, changes, directives, editorconfig, lint, messages, repo, report, unicode
from ..operators.comments import hash_comments, html_comments, parse_comments
from ..operators.lines import explode_lines
from ..sources import commits
from ..sources.gitdiff import parse_diff
from .views import CYRILLIC_A, GRIN, HEART, NBSP, ZWSP, load, oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The characters that docs_marked puts in, as DuckDB regular expressions.
_INVISIBLE, _LOOKALIKE, _EMOJI = f"[{NBSP}{ZWSP}]", f"[{CYRILLIC_A}{NBSP}]", f"[{GRIN}{HEART}]"
#: The common tables that split a view into lines and characters.
_LINES = "ls as (select * exclude (a), unnest(a) as line_text, unnest(range(1, len(a) + 1)) as line from (select *, string_split(text, chr(10)) as a from {view}))"
_CHARS = "cs as (select * exclude (b), unnest(b) as c, unnest(range(1, len(b) + 1)) as col from (select *, string_split(line_text, '') as b from ls where length(line_text) > 0))"


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL it must equal."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return put


def _split(v: str, rest: str) -> str:
    return "with " + _LINES.format(view=v) + ", " + _CHARS + " " + rest


@query(_split("docs_marked", f"select source, kind, sum(n)::bigint as n_chars, count(*)::bigint as n_docs from (select source, doc_id, 'invisible' as kind, count(*) as n from cs where regexp_matches(c, '{_INVISIBLE}') group by all union all select source, doc_id, 'lookalike' as kind, count(*) as n from cs where regexp_matches(c, '{_LOOKALIKE}') group by all) group by all"))
def unicode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invisible and look-alike characters per source."""
    return unicode.unicode_summary(view(spark, sf_dir, "docs_marked"), "source", "doc_id", locale="en")


@query(_split("docs_marked", f"select doc_id, line::bigint as line, col::bigint as col, unicode(c) as code_point, case unicode(c) when 160 then 'NO-BREAK SPACE' else 'ZERO WIDTH SPACE' end as name from cs where regexp_matches(c, '{_INVISIBLE}')"))
def invisible_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unicode.invisible_occurrences(view(spark, sf_dir, "docs_marked")).select("doc_id", "line", "col", "code_point", "name")


@query(_split("docs_marked", f"select doc_id, line::bigint as line, col::bigint as col, unicode(c) as code_point, case unicode(c) when 160 then ' ' else 'a' end as looks_like from cs where regexp_matches(c, '{_LOOKALIKE}')"))
def lookalike_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unicode.lookalike_occurrences(view(spark, sf_dir, "docs_marked"), locale="en").select("doc_id", "line", "col", "code_point", "looks_like")


@query(_split("docs_marked", f"select doc_id, line::bigint as line, col::bigint as col, unicode(c) as code_point from cs where regexp_matches(c, '{_EMOJI}')"))
def emoji_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unicode.emoji_occurrences(view(spark, sf_dir, "docs_marked")).select("doc_id", "line", "col", "code_point")


_N = {"korean": "[가-힣]", "japanese": "[ぁ-ゟ゠-ヿ]", "chinese": "[一-鿿]", "english": "[A-Za-z]"}
_COUNTS = "select doc_id, text, " + ", ".join(f"len(regexp_extract_all(text, '{r}')) as {k}" for k, r in _N.items()) + " from docs_scripts"


@query(f"with n as ({_COUNTS}) select doc_id, korean::bigint as korean, japanese::bigint as japanese, chinese::bigint as chinese, english::bigint as english, case greatest(korean, japanese, chinese, english) when 0 then 'unknown' when korean then 'korean' when japanese then 'japanese' when chinese then 'chinese' else 'english' end as dominant from n")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each script and the dominant one."""
    counted = F.struct(*[v.cast("long").alias(k) for k, v in language.script_counts(F.col("text")).items()])
    rows = view(spark, sf_dir, "docs_scripts").select("doc_id", F.explode(F.array(counted)).alias("n"))  # each count once, below
    return rows.select("doc_id", "n.*", language.most_frequent({k: F.col("n")[k] for k in language.ORDER}).alias("dominant"))


_LETTERS = "len(regexp_extract_all(text, '[\\p{L}]'))"


@query(f"with n as ({_COUNTS}), j as (select *, length(text) >= 5 and {_LETTERS} >= 5 as content from n) select doc_id, lang, case when not content then true when lang = 'english' then korean + japanese + chinese = 0 else (case lang when 'korean' then korean when 'japanese' then japanese else chinese end) > 0 or korean + japanese + chinese + english = 0 end as ok, case when not content then false when lang = 'english' then korean + japanese + chinese > 0 or english > 0 else korean + japanese + chinese + english > 0 end as has_content from j, (values ('korean'), ('japanese'), ('chinese'), ('english')) as l(lang)")
def required_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text against each of the four languages."""
    rows = view(spark, sf_dir, "docs_scripts")
    rows = rows.select("doc_id", language.traits(F.col("text"), 5).alias("t"))
    told = [F.struct(F.lit(k).alias("lang"), language.judged(F.col("t"), k).alias("j")) for k in ("korean", "japanese", "chinese", "english")]
    return rows.select("doc_id", F.explode(F.array(*told)).alias("x")).select("doc_id", "x.lang", "x.j.ok", "x.j.has_content")


@query("with " + _LINES.format(view="msgs") + " select msg_id, line::bigint as line, trim(line_text) as trailer from ls where lower(trim(line_text)) like 'co-authored-by:%' and regexp_matches(lower(line_text), '<[^<]*@cursor\\.sh>')")
def coauthor_trailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.coauthor_lines(view(spark, sf_dir, "msgs"), PolicyConfig().commit_message.coauthor_patterns).select("msg_id", "line", "trailer")


_SUBJECT = "trim(split_part(text, chr(10), 1))"
_TYPE = f"lower(regexp_extract({_SUBJECT}, '^([^\\s(:!]+)(\\([^)]*\\))?(!)?: .+', 1))"


@query(f"select msg_id, case when {_SUBJECT} = '' or {_SUBJECT} like 'Merge %' or {_SUBJECT} like 'Revert %' or {_SUBJECT} like 'fixup! %' or {_SUBJECT} like 'squash! %' then null when not regexp_matches({_SUBJECT}, '^([^\\s(:!]+)(\\([^)]*\\))?(!)?: .+') then 'format' when {_TYPE} not in ({', '.join(repr(t) for t in TYPES)}) then 'type' when regexp_extract({_SUBJECT}, '^([^\\s(:!]+)(\\([^)]*\\))?(!)?: .+', 2) in ('', '()') then 'scope' end as fault from msgs")
def conventional_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "msgs").select("msg_id", messages.conventional(F.col("text"), TYPES, require_scope=True).alias("fault"))


@query(f"select msg_id, length({_SUBJECT})::bigint as n from msgs where length({_SUBJECT}) > 72")
def subject_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "msgs").select("msg_id", messages.subject_length(F.col("text")).cast("long").alias("n")).where("n > 72")


@query("with " + _LINES.format(view="msgs") + " select msg_id, line::bigint as line, length(line_text)::bigint as length from ls where line >= 3 and length(line_text) > 100")
def body_line_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.long_body_lines(view(spark, sf_dir, "msgs"), 100).select("msg_id", "line", F.col("length").cast("long").alias("length"))


_RULES = [{"name": "double", "pattern": r"\b(\w)o", "message": "m"}, {"name": "signed", "pattern": "Co-authored-by", "message": "s", "required": True}, {"name": "digits", "pattern": r"\d{3}", "message": "d"}]


@query("with " + _LINES.format(view="msgs") + " select msg_id, line::bigint as line, rule from (select msg_id, line, 'double' as rule from ls where regexp_matches(line_text, '(^|[^\\p{L}\\p{N}_])[\\p{L}\\p{N}_]o') union all select msg_id, line, 'digits' from ls where regexp_matches(line_text, '[0-9]{3}') union all select msg_id, 0, 'signed' from msgs where not contains(text, 'Co-authored-by'))")
def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.custom_rule_hits(view(spark, sf_dir, "msgs"), _RULES).select("msg_id", "line", "rule")


@query(f"select doc_id, replace(replace(replace(text, '{NBSP}', ' '), '{ZWSP}', ''), '{CYRILLIC_A}', 'a') as fixed from docs_marked")
def fixed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = chars.without_lookalikes(chars.without_invisible(F.col("text")), "en")
    return view(spark, sf_dir, "docs_marked").select("doc_id", fixed.alias("fixed"))


_EC = "root = true\n[*.txt]\ncharset = utf-8\nend_of_line = lf\ninsert_final_newline = true\ntrim_trailing_whitespace = true\nindent_style = space\n"
_BLANKS = _LINES.format(view="docs_blanks").replace("as line from", "as line, len(a) as n from")


def _ec(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    rows = view(spark, sf_dir, "docs_blanks").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", F.encode("text", "UTF-8").alias("content"))
    found = editorconfig.check(rows, editorconfig.parse(_EC)).where(F.col("code") == code)
    return found.select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("doc_id"), "line")


@query(f"with {_BLANKS} select doc_id, min(line)::bigint as line from ls where line < n and ends_with(line_text, chr(13)) group by doc_id")
def crlf_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ec(spark, sf_dir, "end_of_line")


@query(f"with {_BLANKS} select doc_id, min(line)::bigint as line from ls where regexp_matches(rtrim(line_text, chr(13)), '[ \\t]$') group by doc_id")
def trailing_ws_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ec(spark, sf_dir, "trailing_whitespace")


@query(f"with {_BLANKS}, i as (select *, row_number() over (partition by doc_id order by line) as k from ls where regexp_matches(line_text, '^[ \\t]+[^ \\t\\r]')) select doc_id, min(line)::bigint as line from i where k <= 100 and regexp_matches(line_text, '^ *\\t') group by doc_id")
def indent_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ec(spark, sf_dir, "indent_style")


@query("select doc_id, 0::bigint as line from docs_blanks where text <> '' and not ends_with(text, chr(10))")
def final_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ec(spark, sf_dir, "final_newline")


#: What the section files of the view say, by rule; k is the number of a file's second folder.
_NESTED = """with t as (select path, split_part(path, '/', 1) as src, try_cast(substr(split_part(path, '/', 2), 2) as int) as k, regexp_extract(path, '([^/]+)$', 1) as name, regexp_extract(path, '^[^/]+/[^/]+/(.*)$', 1) as rest from tree_paths),
    s as (select *, k % 3 = 0 as own, k % 3 = 0 and k % 5 = 0 as own_root, length(src) % 2 = 1 as src_root from t)
    select path, case when own and regexp_matches(name, '[.](js|ts)$') then 'utf-8' when not own_root and not src_root and regexp_matches(name, '[.](py|rs)$') then 'latin1' end as charset,
    case when own and regexp_matches(rest, '^build/.*[.]py$') then 'crlf' when not own_root and not src_root then 'lf' end as end_of_line,
    case when own and regexp_matches(name, '^f.[0-9]') then null when not own_root and name like '%.py' then 'tab' when not own_root and not src_root then 'space' end as indent_style,
    case when not own_root and k::varchar like '1%' then 'true' end as insert_final_newline, cast(null as varchar) as trim_trailing_whitespace from s"""


@query(_NESTED)
def nested_editorconfig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of every path from the section files above it."""
    return editorconfig.definitions(view(spark, sf_dir, "tree_paths").select("path"), view(spark, sf_dir, "ec_files"))


@query("select path, regexp_matches(path, '^([^/]+/)*en/[^/]*[.]py$') or regexp_matches(regexp_extract(path, '([^/]+)$', 1), '^f[0-9][13579][.][^/]*$') as ignored from repo_paths")
def glob_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "repo_paths").select("path", globs.matches_any(F.col("path"), ["**/en/*.py", "f[0-9][13579].*"]).alias("ignored"))


@query("select path, case when lower(regexp_extract(path, '([.][^./]*)$', 1)) = '.gz' then 'lfs' when lower(regexp_extract(path, '([.][^./]*)$', 1)) = '.png' then 'allow' else 'block' end as policy from repo_paths")
def binary_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.files import policy_for

    cfg = PolicyConfig()
    cfg.binary_file.rules = [([".gz"], "lfs")]
    return view(spark, sf_dir, "repo_paths").select("path", policy_for(F.col("path"), cfg).alias("policy"))


_LANGUAGES = " ".join(f"when '{e}' then '{n}'" for e, n in repo.LANGUAGE_BY_EXT.items())


@query(f"select * from (select case e {_LANGUAGES} end as language, count(*)::bigint as n_files from (select lower(regexp_extract(path, '[^/]([.][^./]*)$', 1)) as e from tree_paths) group by all) where language is not null")
def ext_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.language_counts(view(spark, sf_dir, "tree_paths"))


_HTML = "with c as (select page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) as raw from pages)"


@query(f"{_HTML}, t as (select page_id, array_to_string(list_filter(list_transform(string_split(raw, chr(10)), lambda x: trim(regexp_replace(trim(x), '^[*]', ''))), lambda x: x <> ''), chr(10)) as text from c) select page_id, text from t where text <> ''")
def html_comments_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_comments(load(spark, sf_dir, "pages")["pages"].select("page_id", "html")).select("page_id", "text")


@query("with " + _LINES.format(view="scripts") + " select path, line::bigint as line, trim(substr(trim(line_text), 2)) as text from ls where starts_with(trim(line_text), '#') and not (line = 1 and starts_with(trim(line_text), '#!')) and trim(substr(trim(line_text), 2)) <> ''")
def hash_comments_of_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_comments(view(spark, sf_dir, "scripts").select("path", "text")).select("path", "line", "text")


#: Comment rows: a document's lines, some of them directives, with gaps in the line numbers.
_ROWS = """rows0 as (select concat('d', doc_id) as path, unnest(range(1, len(a) + 1)) as seq, unnest(a) as body from (select doc_id, string_split(replace(text, '. ', concat('.', chr(10))), chr(10)) as a from documents)),
    rows1 as (select path, seq, case when length(body) % 11 = 0 then 'siltgate:ignore' when length(body) % 13 = 0 then 'siltgate:disable' when length(body) % 17 = 0 then 'siltgate:enable'
    when length(body) % 19 = 0 then 'siltgate:lang=ja' else body end as text, seq + seq // 4 as line from rows0)"""


def _comment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")["documents"].select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.replace("text", F.lit(". "), F.lit(".\n")).alias("text"))
    rows = explode_lines(docs).select("path", F.col("line").alias("seq"), F.col("line_text").alias("b"))
    n = F.length("b")
    said = F.when(n % 11 == 0, "siltgate:ignore").when(n % 13 == 0, "siltgate:disable").when(n % 17 == 0, "siltgate:enable").when(n % 19 == 0, "siltgate:lang=ja").otherwise(F.col("b"))
    at = F.col("seq") + F.floor(F.col("seq") / 4)
    return rows.select("path", "seq", said.alias("text"), at.cast("long").alias("line"), at.cast("long").alias("end_line"), F.lit(False).alias("is_block"), F.lit("Comment").alias("kind"))


#: Without file-lang the state before a row is that of the last directives, and an ignore acts on the row after it.
_STATES = f"""with {_ROWS}, s as (select *, starts_with(text, 'siltgate:') as dir,
    coalesce(last_value(case when text = 'siltgate:disable' then 1 when text = 'siltgate:enable' then 0 end ignore nulls) over w, 0) as off,
    coalesce(last_value(case when text = 'siltgate:lang=ja' then 'japanese' end ignore nulls) over w, 'english') as l,
    count(*) filter (where not starts_with(text, 'siltgate:')) over w as plain,
    max(case when text = 'siltgate:ignore' then seq end) over w as last_ignore from rows1 window w as (partition by path order by seq rows between unbounded preceding and 1 preceding)),
    p as (select *, coalesce(max(case when not dir then seq end) over (partition by path order by seq rows between unbounded preceding and 1 preceding), 0) as last_plain from s),
    st as (select path, seq, text, line, dir or off = 1 or coalesce(last_ignore > last_plain, false) as skip, case when dir or off = 1 or coalesce(last_ignore > last_plain, false) then '' else l end as lang from p)"""


@query(f"{_STATES} select path, seq::bigint as seq, skip, lang from st")
def directive_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directives.states(_comment_rows(spark, sf_dir), "english").select("path", "seq", "skip", "lang")


_UNITS = f"""{_STATES}, k as (select *, case when lag(line) over w is null or lag(lang) over w <> lang or line > lag(line) over w + 1 then 1 else 0 end as b from st where not skip window w as (partition by path order by seq)),
    u as (select *, sum(b) over (partition by path order by seq) as uid from k), un as (select path, uid, string_agg(text, chr(10) order by seq) filter (where trim(text) <> '') as text, min(line) as line, max(line) as end_line, any_value(lang) as lang from u group by path, uid)"""


@query(f"{_UNITS} select path, line::bigint as line, end_line::bigint as end_line, lang, md5(text) as digest from un where text is not null")
def comment_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of comment rows without textless lines."""
    rows = directives.units(directives.states(_comment_rows(spark, sf_dir), "english"))
    return rows.select("path", "line", "end_line", "lang", F.md5("text").alias("digest"))


@query(f"{_UNITS} select path, line::bigint as line, end_line::bigint as end_line from un where text is not null and exists (select 1 from rows1 a where a.path = un.path and a.line between un.line and un.end_line and a.line % 9 = 0)")
def added_line_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with a line that is divisible by 9 and counts as added."""
    rows = _comment_rows(spark, sf_dir)
    return directives.touched(directives.units(directives.states(rows, "english")), rows.where("line % 9 = 0").select("path", "line")).select("path", "line", "end_line")


@query("with " + _LINES.format(view="documents") + " select doc_id, line::bigint as line from ls where line % 3 = 0 and regexp_matches(line_text, '[0-9]{3}')")
def diff_custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on the lines that are divisible by 3 and count as added."""
    docs = load(spark, sf_dir, "documents")["documents"].select(F.col("doc_id").cast("string").alias("path"), "text")
    n = F.size(F.split("text", "\n", -1))
    diff = docs.select("path", F.lit(False).alias("is_deleted"), F.lit(False).alias("is_submodule"), F.lit(False).alias("is_symlink"), F.filter(F.transform(F.sequence(F.lit(1), n), lambda x: x.cast("long")), lambda x: x % 3 == 0).alias("added_lines"))
    cfg = PolicyConfig(custom_diff_rules=[{"name": "digits", "pattern": r"[0-9]{3}", "message": "m"}])
    return changes.custom_rules(diff, docs, cfg).select(F.col("path").cast("long").alias("doc_id"), "line")


@query("with e as (select concat('m/', lang) as dir, max(doc_id) as top from documents where doc_id % 2 = 0 group by lang) select concat('m/', lang, '/v', doc_id, '.sql') as path, concat('v', top, '.sql') as latest from documents d join e on e.dir = concat('m/', lang) where doc_id % 2 = 1 and not top < doc_id")
def filename_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents as new migrations against the even ones."""
    path = F.concat(F.lit("m/"), "lang", F.lit("/v"), F.col("doc_id").cast("string"), F.lit(".sql"))
    docs = load(spark, sf_dir, "documents")["documents"].select("doc_id", path.alias("path"))
    return changes.filename_order(docs.where("doc_id % 2 = 1").select("path"), docs.where("doc_id % 2 = 0").select("path"), ["m/**"])


@query("select path, case doc_id % 3 when 0 then 'protected_deleted' when 1 then 'protected_added' else 'protected_modified' end as code from repo_paths where doc_id >= 0 and (starts_with(path, 'src1/') or regexp_matches(path, '[.]md$'))")
def protected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "repo_paths").where("doc_id >= 0").withColumn("is_deleted", F.col("doc_id") % 3 == 0).withColumn("is_new", F.col("doc_id") % 3 == 1)
    return changes.protected_paths(rows, PolicyConfig(protected_paths=["src1/**", "*.md"])).select("path", "code")


@query("select doc_id from documents where doc_id % 3 = 1 or doc_id % 3 = 0 and text = ''")
def append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New contents that don't begin with the old ones: every third document got a line in front."""
    docs = load(spark, sf_dir, "documents")["documents"].select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    old = docs.select("path", F.encode("text", "UTF-8").alias("content"))
    now = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("new\n"), "text")).when(F.col("doc_id") % 3 == 2, F.concat("text", F.lit("\nnew"))).otherwise(F.col("text"))
    new = docs.select("path", F.encode(now, "UTF-8").alias("content"))
    files = docs.select("path", F.lit(False).alias("is_deleted"), F.lit(False).alias("is_new"))
    cfg = PolicyConfig(append_only_paths=["**"])
    return changes.append_only(files, old, new, cfg).select(F.col("path").cast("long").alias("doc_id"))


#: Fixed values, written here once more so that the SQL doesn't rest on the operator's own tables: name, then what must stand beside it or (after >) inside.
_CACHE_RULES = """node_modules package.json package-lock.json yarn.lock pnpm-lock.yaml bun.lockb bun.lock
dist package.json package-lock.json yarn.lock pnpm-lock.yaml bun.lockb bun.lock go.mod Cargo.toml
out next.config.js next.config.ts next.config.mjs next.config.cjs package.json
build package.json Cargo.toml build.gradle build.gradle.kts settings.gradle settings.gradle.kts gradlew gradlew.bat pubspec.yaml wails.json CMakeLists.txt >CMakeCache.txt >build.ninja
target Cargo.toml pom.xml build.sbt
vendor go.mod Cargo.toml composer.json Gemfile package.json
.gradle build.gradle build.gradle.kts settings.gradle settings.gradle.kts gradlew gradlew.bat
.next next.config.js next.config.ts next.config.mjs next.config.cjs package.json
.nuxt nuxt.config.js nuxt.config.ts nuxt.config.mjs
.output nuxt.config.js nuxt.config.ts nuxt.config.mjs
.svelte-kit svelte.config.js svelte.config.ts svelte.config.cjs
.yarn yarn.lock package.json
.bun bun.lockb bun.lock package.json
__pycache__ *.py pyproject.toml setup.py setup.cfg requirements.txt
.pytest_cache pytest.ini pyproject.toml setup.cfg tox.ini requirements.txt conftest.py
.mypy_cache mypy.ini .mypy.ini pyproject.toml setup.cfg
.ruff_cache ruff.toml pyproject.toml
.turbo turbo.json package.json
.parcel-cache package.json
.tox tox.ini setup.cfg pyproject.toml
.nox noxfile.py
.venv >pyvenv.cfg
.embuild sdkconfig.defaults sdkconfig idf_component.yml >espressif/
.dart_tool pubspec.yaml >package_config.json"""
_RULE_ROWS = ", ".join(f"('{name}', '{x.lstrip('>')}', {str(x.startswith('>')).lower()})" for name, *xs in map(str.split, _CACHE_RULES.split("\n")) for x in xs)
#: A walk from the root, one level of folders a step.
_CACHES = f"""with recursive rules(name, entry, inside) as (values {_RULE_ROWS}),
    parts as (select path, string_split(path, '/') as p from tree_paths),
    folders as (select distinct array_to_string(p[1:i], '/') as dir, array_to_string(p[1:i - 1], '/') as up, p[i] as name from (select p, unnest(range(1, len(p))) as i from parts)),
    entries as (select array_to_string(p[1:len(p) - 1], '/') as place, p[len(p)] as entry from parts union select array_to_string(p[1:len(p) - 1], '/'), '*.py' from parts where path like '%.py' union select up, concat(name, '/') from folders),
    proven as (select distinct dir from folders join rules using (name) join entries on entries.entry = rules.entry and entries.place = case when inside then dir else up end),
    kinds as (select dir, up, case when name in ('.git', '.svn', '.hg', '.bzr') then 'closed' when dir in (select place from entries where entry in ('pyvenv.cfg', 'pyvenv.cfg/')) then 'found'
        when name in (select name from rules) then case when dir in (select dir from proven) then 'found' else 'closed' end when name like '.%' then 'closed' else 'entered' end as kind from folders),
    walk as (select dir, kind from kinds where up = '' union all select k.dir, k.kind from walk w join kinds k on k.up = w.dir where w.kind = 'entered')"""


@query(f"{_CACHES} select dir as path, count(*)::bigint as files from walk join tree_paths on starts_with(path, concat(dir, '/')) where kind = 'found' group by dir")
def cache_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache folders and environments that a walk over the paths finds."""
    found = repo.committed_cache_dirs(view(spark, sf_dir, "tree_paths").select("path"), PolicyConfig())
    return found.select("path", F.col("params")["files"].cast("long").alias("files"))


@query(f"""{_CACHES}, up as (select t.path, k.dir, row_number() over (partition by t.path order by length(k.dir) desc) as r from (select distinct path from tree_paths where doc_id % 2 = 0) t
    join (select dir from proven union select place from entries where entry in ('pyvenv.cfg', 'pyvenv.cfg/')) k on starts_with(t.path, concat(k.dir, '/')) where k.dir <> '')
    select dir as cache_dir, min(path) as path from up where r = 1 and not regexp_matches(dir, '(^|/)dist$') group by dir""")
def staged_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first changed path in each nearest cache folder or environment; ``dist`` is ignored."""
    rows = view(spark, sf_dir, "tree_paths")
    changed = rows.where("doc_id % 2 = 0").select("path", F.lit(False).alias("is_deleted"))
    found = repo.staged_cache_dirs(changed, rows.select("path"), PolicyConfig(cache_dir_ignore=["dist"]))
    return found.select("path", F.col("params")["dir"].alias("cache_dir"))


#: Everything that each end of a range reaches, itself included.
_REACH = """with recursive edge as (select hash, p1 as parent from commit_graph where p1 is not null union select hash, p2 from commit_graph where p2 is not null),
    ends as (select range_id, 'start' as side, start_hash as hash from commit_ranges union select range_id, 'stop', stop_hash from commit_ranges union select range_id, 'left', left_hash from commit_ranges union select range_id, 'right', right_hash from commit_ranges),
    reach as (select range_id, side, hash from ends where hash is not null union select r.range_id, r.side, e.parent from reach r join edge e on e.hash = r.hash)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "commit_graph").select("hash", F.array("p1", "p2").alias("parents")), view(spark, sf_dir, "commit_ranges")


@query(f"{_REACH} select range_id::bigint as range_id, hash from reach where side = 'stop' except select range_id::bigint, hash from reach where side = 'start'")
def push_range_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits: parents are the customer's order before, and in a third of them one of other customers."""
    graph, ranges = _graph(spark, sf_dir)
    return commits.in_ranges(graph, ranges.select(F.col("range_id").cast("long").alias("range_id"), F.col("start_hash").alias("start"), F.col("stop_hash").alias("stop")))


@query(f"""{_REACH}, common as (select range_id, hash from reach where side = 'left' intersect select range_id, hash from reach where side = 'right')
    select range_id::bigint as range_id, hash from common c where not exists (select 1 from edge e join common d on d.hash = e.hash and d.range_id = c.range_id where e.parent = c.hash)""")
def merge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest common ancestors of two ends of each part of that graph."""
    graph, ranges = _graph(spark, sf_dir)
    pairs = ranges.select(F.col("range_id").cast("long").alias("pair_id"), F.col("left_hash").alias("left"), F.col("right_hash").alias("right"))
    return commits.merge_bases(graph, pairs).withColumnRenamed("pair_id", "range_id")


@query(f"select 'conventional' as check_name, count(*)::bigint as n from msgs where not ({_SUBJECT} = '' or {_SUBJECT} like 'Merge %' or {_SUBJECT} like 'Revert %' or {_SUBJECT} like 'fixup! %' or {_SUBJECT} like 'squash! %') and ({_TYPE} not in ({', '.join(repr(t) for t in TYPES)})) union all select 'coauthor', count(*) from (with {_LINES.format(view='msgs')} select 1 from ls where lower(trim(line_text)) like 'co-authored-by:%cursor.sh>') union all select 'invisible', sum(length(text) - length(replace(text, '{ZWSP}', '')))::bigint from msgs union all select 'subject_limit', count(*) from msgs where length({_SUBJECT}) > 60")
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All message checks in one plan, counted."""
    cfg = PolicyConfig()
    m = cfg.commit_message
    m.conventional_enabled = m.subject_limit_enabled = True
    m.subject_limit, m.no_ambiguous_chars, m.no_bad_runes = 60, False, False
    rows = view(spark, sf_dir, "msgs").select(F.col("msg_id").cast("string").alias("path"), "text")
    return report.summary(messages.check_messages(rows, cfg)).withColumnRenamed("check", "check_name")


@query("select doc_id, len(regexp_extract_all(text, '[^\\x00-\\x7F]'))::bigint as bad from documents")
def bad_byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in ISO-8859-1, where every letter beyond ASCII is a byte that UTF-8 can't use."""
    docs = load(spark, sf_dir, "documents")["documents"]
    return docs.select("doc_id", encoding.bad_byte_count(F.encode("text", "ISO-8859-1")).cast("long").alias("bad"))


#: Sentences in the bytes of their charsets, put behind the ASCII part of the documents.
_SENTENCES = {
    "EUC-KR": "이 파일은 한국어로 작성된 설명을 담고 있습니다.".encode("euc_kr").hex(),
    "EUC-JP": "このファイルには日本語で書かれた説明が入っています。".encode("euc_jp").hex(),
    "Shift_JIS": "このファイルには日本語で書かれた説明が入っています。".encode("shift_jis").hex(),
    "GB18030": "这个文件里有用中文写的说明，在运行之前应该检查一下设置。".encode("gb18030").hex(),
    "Big5": "這個檔案裡有用中文寫的說明，在執行之前應該檢查一下設定。".encode("big5").hex(),
    "ISO-8859-1": "Le fichier a été créé après une mise à jour.".encode("latin-1").hex(),
    "utf-8": "Die Prüfung der Größe".encode().hex(),
}


@query("select doc_id, case doc_id % 7 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(_SENTENCES)) + " end as charset from documents")
def charset_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The charset found in every document, written in seven ways."""
    docs = load(spark, sf_dir, "documents")["documents"]
    tails = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in _SENTENCES.values()]), (F.col("doc_id") % 7 + 1).cast("int"))
    content = F.concat(F.encode(F.regexp_replace("text", r"[^\x00-\x7F]", ""), "UTF-8"), tails)
    return docs.select("doc_id", encoding.utf8_report(content)["detected_charset"].alias("charset"))


@query("select doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') as fixed from documents")
def bad_bytes_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")["documents"]
    return docs.select("doc_id", encoding.without_bad_bytes(F.encode("text", "ISO-8859-1")).alias("fixed"))


@query("with d as (select doc_id, string_split(text, chr(10)) as a from documents) select concat('docs/', doc_id, '.txt') as path, len(a)::bigint as n_added, len(a)::bigint as last_line from d")
def parsed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the diff that adds it, parsed again."""
    docs = load(spark, sf_dir, "documents")["documents"]
    name = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    body = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit("+"), x)), "\n")
    text = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), name, F.lit("\n@@ -0,0 +1,1 @@\n"), body)
    files = parse_diff(docs.select(F.col("doc_id").alias("diff_id"), text.alias("diff")))
    return files.select("path", F.size("added_lines").cast("long").alias("n_added"), F.array_max("added_lines").alias("last_line"))


@query("select path, concat(regexp_replace(case when size < 1024 then concat(size, ' B') else format('{:.1f} KB', size / 1024.0) end, '^$', '')) as shown from repo_paths where size < 1048576")
def shown_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "repo_paths").select("path", repo.format_bytes(F.col("size")).alias("shown"))


@query()
def parsed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments and strings of the documents as C-like, Python and Markdown sources."""
    docs = load(spark, sf_dir, "documents")["documents"]
    ext = F.element_at(F.array(*[F.lit(e) for e in (".ts", ".py", ".md", ".tf", ".go")]), (F.col("doc_id") % 5 + 1).cast("int"))
    head = F.when(F.col("doc_id") % 5 == 4, F.lit("package x\n")).otherwise(F.lit(""))
    marks = F.replace(F.replace("text", F.lit(". "), F.lit(". // ")), F.lit(", "), F.lit(", # "))
    return parse_comments(docs.select(F.concat(F.lit("s/"), F.col("doc_id").cast("string"), ext).alias("path"), F.concat(head, marks).alias("text")))


@query()
def linted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as JSON, TOML and XML files."""
    events = load(spark, sf_dir, "events")["events"]
    ext = F.element_at(F.array(F.lit(".json"), F.lit(".toml"), F.lit(".xml")), (F.col("event_id") % 3 + 1).cast("int"))
    return lint.lint(events.select(F.concat(F.col("event_id").cast("string"), ext).alias("path"), F.col("props").alias("text")))


_TECHNICAL = "|".join(re.escape(p) for p in language.TECHNICAL_PREFIXES)
_CONTENT = "length(said) >= 5 and len(regexp_extract_all(said, '[\\p{L}]')) >= 5 and not regexp_matches(said, '^(<[^>]*>\\s*)+$') and not regexp_matches(lower(trim(said)), '^(" + _TECHNICAL + ")')"
_SAID = ", ".join(f"len(regexp_extract_all(said, '{r}')) as {k}" for k, r in _N.items())
_FINDINGS = f"""with {_LINES.format(view="msgs")}, body as (select msg_id, rtrim(text, chr(10)) as t from msgs), size as (select msg_id, len(string_split(t, chr(10))) as n, {_SUBJECT.replace("text", "t")} as subject from body),
    {_CHARS},
    told as (select ls.msg_id, line, case when line = 1 then regexp_replace(subject, '^[\\p{{L}}\\p{{N}}_-]+(\\([^)]*\\))?!?:[ ]*', '') else trim(line_text, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) end as said from ls join size using (msg_id)
        where line <= n and not (starts_with(subject, 'Merge ') or starts_with(subject, 'Revert ') or starts_with(subject, 'fixup! ') or starts_with(subject, 'squash! '))),
    judged as (select *, {_SAID} from told)
    select 'coauthor' as "check", msg_id::varchar as path, line::bigint as line, 0::bigint as col, 'ai_coauthor' as code, concat('{{"trailer":"', trim(line_text), '"}}') as params from ls where lower(trim(line_text)) like 'co-authored-by:%cursor.sh>'
    union all select 'invisible', msg_id::varchar, line, col, 'invisible_char', case unicode(c) when 160 then '{{"char":"U+00A0","name":"NO-BREAK SPACE"}}' else '{{"char":"U+200B","name":"ZERO WIDTH SPACE"}}' end from cs where regexp_matches(c, '{_INVISIBLE}')
    union all select 'language', msg_id::varchar, line, 0, 'language', concat('{{"detected":"', case greatest(korean, japanese, chinese, english) when japanese then 'japanese' when chinese then 'chinese' else 'english' end, '"}}') from judged where korean = 0 and japanese + chinese + english > 0 and {_CONTENT}
    union all select 'conventional', msg_id::varchar, 1, 0, case when not regexp_matches(subject, '^([^\\s(:!]+)(\\([^)]*\\))?(!)?: .+') then 'conventional_format' else 'conventional_type' end, '{{}}' from size
        where not (subject = '' or subject like 'Merge %' or subject like 'Revert %' or subject like 'fixup! %' or subject like 'squash! %') and lower(regexp_extract(subject, '^([^\\s(:!]+)(\\([^)]*\\))?(!)?: .+', 1)) not in ({", ".join(repr(t) for t in TYPES)})
    union all select 'subject_limit', msg_id::varchar, 1, 0, 'subject_too_long', concat('{{"length":"', length(subject), '"}}') from size where length(subject) > 72
    union all select 'body_limit', msg_id::varchar, line, 0, 'body_line_too_long', concat('{{"length":"', length(line_text), '"}}') from ls join size using (msg_id) where line between 3 and n and length(line_text) > 100"""


@query(_FINDINGS)
def message_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All message checks as one findings table."""
    cfg = PolicyConfig()
    m = cfg.commit_message
    m.language_enabled = m.conventional_enabled = m.subject_limit_enabled = m.body_limit_enabled = m.no_emoji = True
    rows = view(spark, sf_dir, "msgs").select(F.col("msg_id").cast("string").alias("path"), "text", F.encode("text", "UTF-8").alias("content"))
    return messages.check_messages(rows, cfg).withColumn("params", F.to_json("params"))


_TEXTS = ", ".join(f"('{loc}', '{code}', '{text.replace(chr(39), chr(39) * 2)}')" for code in ("ai_coauthor", "conventional_format", "conventional_type", "subject_too_long", "body_line_too_long") for loc, text in zip(catalogue.LOCALES, catalogue.TEXTS[code]) if (loc, code) != ("zh", "subject_too_long"))


@query(f"""with f as ({_FINDINGS}), t(locale, code, text) as (values {_TEXTS}),
    l as (select *, split_part('en_US.UTF-8,ko,ja-JP,zh_Hant-TW,fr,zh,de-AT', ',', (path::bigint % 7 + 1)::int) as tag from f),
    c as (select *, case when tag like 'ko%' then 'ko' when tag like 'ja%' then 'ja' when tag like 'zh%' then 'zh' else 'en' end as loc from l)
    select path, line, col, tag as locale, replace(replace(coalesce(own.text, en.text, concat('[', c.code, ']')), '%{{trailer}}', coalesce(json_extract_string(params, '$.trailer'), '%{{trailer}}')), '%{{length}}', coalesce(json_extract_string(params, '$.length'), '%{{length}}')) as text
    from c left join t own on own.locale = c.loc and own.code = c.code left join t en on en.locale = 'en' and en.code = c.code""")
def translated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message findings, each in its message's locale; some codes and one Chinese text are not in the catalogue."""
    codes = ["ai_coauthor", "conventional_format", "conventional_type", "subject_too_long", "body_line_too_long"]
    texts = catalogue.table(spark).where(F.col("code").isin(codes) & ~((F.col("locale") == "zh") & (F.col("code") == "subject_too_long")))
    cfg = PolicyConfig()
    m = cfg.commit_message
    m.language_enabled = m.conventional_enabled = m.subject_limit_enabled = m.body_limit_enabled = m.no_emoji = True
    rows = view(spark, sf_dir, "msgs").select(F.col("msg_id").cast("string").alias("path"), "text", F.encode("text", "UTF-8").alias("content"))
    tags = F.array(*[F.lit(x) for x in ("en_US.UTF-8", "ko", "ja-JP", "zh_Hant-TW", "fr", "zh", "de-AT")])
    found = messages.check_messages(rows, cfg).withColumn("locale", F.element_at(tags, (F.col("path").cast("long") % 7 + 1).cast("int")))
    return catalogue.translated(found, F.col("locale"), texts).select("path", "line", "col", "locale", "text")
