"""Registered queries of predicates, listings and reports, with the SQL they are checked against.

They stand apart from ``catalog`` for their number alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TYPES, PolicyConfig
from ..functions import chars, globs, language
from ..operators import changes, editorconfig, files, fixes, lint, messages, repo
from ..operators.comments import parse_comments
from ..sources import gitdiff
from .catalog import _CACHES, _LINES, _REACH, _TECHNICAL, _graph, query
from .views import GRIN, HEART, NBSP, ZWSP, load, view


@query(f"""with {_LINES.format(view="msgs")}, k as (select msg_id, string_agg(line_text, chr(10) order by line) as t from ls where not (lower(trim(line_text)) like 'co-authored-by:%cursor.sh>') group by msg_id),
    f as (select msg_id, replace(replace(regexp_replace(t, '\\n\\n+$', chr(10)), '{ZWSP}', ''), '{NBSP}', ' ') as fixed from k)
    select msg_id::varchar as path, fixed from f join msgs using (msg_id) where fixed <> text""")
def fixed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that a fix changes: trailers of assistants, invisible characters, blank lines at the end."""
    rows = view(spark, sf_dir, "msgs").select(F.col("msg_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return fixes.fix_table(rows, fixes.fixed_message(F.col("content"), PolicyConfig())).select("path", "fixed")


@query(f"""{_CACHES} select dir as cache_dir, sum(size)::bigint as size, count(*) filter (tracked)::bigint as tracked_files, count(*) filter (not tracked)::bigint as untracked_files,
    case when sum(size) < 1024 then concat(sum(size), ' B') when sum(size) < 1048576 then format('{{:.1f}} KB', sum(size) / 1024.0) else format('{{:.1f}} MB', sum(size) / 1048576.0) end as shown
    from walk join (select path, size, doc_id % 3 <> 0 as tracked from tree_paths) on starts_with(path, concat(dir, '/')) where kind = 'found' group by dir""")
def cache_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, tracked and untracked files of the cache folders that a walk finds."""
    rows = view(spark, sf_dir, "tree_paths").select("path", "size", (F.col("doc_id") % 3 != 0).alias("tracked"))
    return repo.cache_sizes(rows)


@query("""select path, case when lower(regexp_extract(path, '([.][^./]*)$', 1)) = '.gz' then 'binary_lfs' else 'binary_block' end as code from repo_paths
    where doc_id >= 0 and doc_id % 3 <> 1 and lower(regexp_extract(path, '([.][^./]*)$', 1)) <> '.png' and not regexp_matches(path, '(^|/)f[0-9]*5[.][^/]*$') and not (lower(regexp_extract(path, '([.][^./]*)$', 1)) = '.gz' and doc_id % 2 = 0)""")
def staged_binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NUL-separated listing a path, some of them renames, read back and judged by policy, ignore globs and large-file attributes."""
    rows = view(spark, sf_dir, "repo_paths").where("doc_id >= 0")
    record = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("-\t-\t"), "path", F.lit("\0"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("3\t0\t"), "path", F.lit("\0")))
    listing = F.concat(F.lit("1\t2\tbefore.txt\0"), record.otherwise(F.concat(F.lit("-\t-\t\0old.bin\0"), "path", F.lit("\0"))), F.lit("0\t0\tafter.txt\0"))
    found = gitdiff.binary_files(rows.select("doc_id", listing.alias("listing")))
    cfg = PolicyConfig(global_ignore=["f*5.*"])
    cfg.binary_file.rules = [([".gz"], "lfs")]
    attributes = rows.where("doc_id % 2 = 0").select("path", F.lit("lfs").alias("filter"))
    return files.binary_findings(found.select("path"), cfg, attributes).select("path", "code")


@query("""with p as (select path, regexp_extract(path, '([^/]+)$', 1) as name from repo_paths)
    select path, name as base, regexp_matches(path, '^src1/([^/]+/)*[^/]*[.]md$') as deep, regexp_matches(name, '^f[0-9]*[.]go$') as by_name, regexp_matches(path, '^[^/]+/en/[^/]*$') as one_level,
    lower(regexp_extract(name, '([.][^.]*)$', 1)) as ext, regexp_matches(lower(name), '[.](py|png|gz)$') as listed,
    case when regexp_matches(path, '^src1/') then 'japanese' when regexp_matches(name, '[.]md$') then 'english' else 'korean' end as lang from p""")
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs by path and by name, extensions and the first matching rule of every path."""
    p = F.col("path")
    rules = [("src1/**", "japanese"), ("*.md", "english"), ("src1/*.md", "chinese")]
    return view(spark, sf_dir, "repo_paths").select(
        "path", globs.base(p).alias("base"), globs.match_path(p, "src1/**/*.md").alias("deep"), globs.matches_any(p, ["f*[0-9].go"]).alias("by_name"), globs.match_path(p, "*/en/*").alias("one_level"),
        globs.ext_lower(p).alias("ext"), globs.has_extension(p, [".py", ".PNG", ".gz"]).alias("listed"), globs.first_match(p, rules, "korean").alias("lang"),
    )


@query(f"""with d as (select doc_id, text, case doc_id % 5 when 0 then '<b> <i>' when 1 then '/ <div>' when 2 then 'application/json' when 3 then 'MAX_SIZE' else text end as said from docs_marked)
    select doc_id, regexp_matches(text, '[{GRIN}{HEART}]') as emoji, regexp_matches(text, '[{NBSP}{ZWSP}]') as invisible, doc_id % 5 < 2 as tags, contains(said, '/') or not regexp_matches(said, '[^\\x00-\\x60\\x7B-\\x7F]') as technical,
    case when length(text) > 80 then concat(substr(text, 1, 80), '…') else text end as short,
    trim(replace(replace(replace(concat('Ünter ', lower(said)), ' the ', '     '), ' the ', '     '), ' and ', '     ')) <> '' as some from d""")
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emoji, invisible characters, tag-only and technical texts, shortened ones."""
    rows = view(spark, sf_dir, "docs_marked")
    n, t = F.col("doc_id") % 5, F.col("text")
    said = F.when(n == 0, "<b> <i>").when(n == 1, "/ <div>").when(n == 2, "application/json").when(n == 3, "MAX_SIZE").otherwise(t)
    return rows.select(
        "doc_id", chars.contains_emoji(t).alias("emoji"), chars.contains_invisible(t).alias("invisible"), language.is_tags_only(said).alias("tags"), language.is_technical(said).alias("technical"), language.truncate(t, 80).alias("short"),
        (F.trim(language.strip_allowed_words(F.concat(F.lit("Ünter "), said), ["the", "and"])) != "").alias("some"),
    )


@query("""select path, line, bad_bytes, charset from (select concat(doc_id, '.txt') as path, 0::bigint as line, len(regexp_extract_all(text, '[^\\x00-\\x7F]'))::varchar as bad_bytes, 'ISO-8859-1' as charset, doc_id, text from documents)
    where bad_bytes <> '0' and doc_id % 4 <> 3 and doc_id % 11 <> 0""")
def encoding_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in ISO-8859-1 as files: binary ones (a NUL byte) and files with another configured charset are left out."""
    docs = load(spark, sf_dir, "documents")["documents"]
    content = F.encode("text", "ISO-8859-1")
    content = F.when(F.col("doc_id") % 11 == 0, F.concat(content, F.unhex(F.lit("00")))).otherwise(content)
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 3, ".latin").otherwise(".txt"))
    found = files.encoding_findings(docs.select(name.alias("path"), content.alias("content"), "text"), PolicyConfig(), editorconfig.parse("[*.latin]\ncharset = latin1"))
    return found.select("path", "line", F.col("params")["bad_bytes"].alias("bad_bytes"), F.col("params")["charset"].alias("charset"))


@query("""select o_orderkey, case when o_orderkey % 5 in (0, 4) then 'base' else concat('b', o_orderkey) end as start, concat('a', o_orderkey) as stop from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0""")
def push_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of a push for every order: deleted refs and malformed lines are left out, new refs start at the base."""
    orders = load(spark, sf_dir, "orders")["orders"].select("o_orderkey")
    k, zero = F.col("o_orderkey"), F.lit("0" * 40)
    local = F.when(k % 7 == 0, zero).otherwise(F.concat(F.lit("a"), k.cast("string")))
    remote = F.when(k % 5 == 0, zero).when(k % 5 == 4, "base").otherwise(F.concat(F.lit("b"), k.cast("string")))
    line = F.concat_ws(" ", F.concat(F.lit(" refs/"), k.cast("string")), local, F.lit("refs/x"), remote, F.when(k % 11 == 0, "more"))
    return gitdiff.push_ranges(orders.select(line.alias("line")), base="base").select(F.regexp_extract("stop", r"\d+", 0).cast("long").alias("o_orderkey"), "start", "stop")


@query("select event_id from events where not json_valid(case event_id % 4 when 0 then substr(props, 1, length(props) - 1) when 1 then concat(props, ',') when 2 then concat('[', props, ', ', props, ']') else props end)")
def broken_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as files, half of them damaged."""
    events = load(spark, sf_dir, "events")["events"]
    n, p = F.col("event_id") % 4, F.col("props")
    text = F.when(n == 0, F.substring(p, F.lit(1), F.length(p) - 1)).when(n == 1, F.concat(p, F.lit(","))).when(n == 2, F.concat(F.lit("["), p, F.lit(", "), p, F.lit("]"))).otherwise(p)
    found = lint.lint(events.select(F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("path"), text.alias("text")))
    return found.select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("event_id")).distinct()


@query("""select doc_id, 'append_only_deleted' as code from documents where doc_id % 4 = 0 union all select doc_id, 'append_only_modified' from documents where doc_id % 4 = 1 and text <> ''""")
def append_only_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted files, changed beginnings, longer files and new ones under an append-only path."""
    docs = load(spark, sf_dir, "documents")["documents"]
    n, path = F.col("doc_id") % 4, F.col("doc_id").cast("string").alias("path")
    old = docs.where(n != 3).select(path, F.encode("text", "UTF-8").alias("content"))
    new = docs.where(n != 0).select(path, F.encode(F.when(n == 1, F.concat(F.lit("x"), "text")).otherwise(F.concat("text", F.lit("more"))), "UTF-8").alias("content"))
    rows = docs.select(path, (n == 0).alias("is_deleted"), (n == 3).alias("is_new"))
    found = changes.append_only(rows, old, new, PolicyConfig(append_only_paths=["**"]))
    return found.select(F.col("path").cast("long").alias("doc_id"), "code")


#: Every line of a document is a comment of its source, after a statement.
_COMMENTS = f"""with {_LINES.format(view="documents")}, p as (select doc_id, path from sources),
    c as (select path, doc_id, 2 * line + case when doc_id % 8 = 3 then 1 else 0 end as line, trim(line_text) as text from ls join p using (doc_id))"""


@query(f"{_COMMENTS} select path, line::bigint as line, text from c where text <> ''")
def line_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line comments of sources in eight languages."""
    rows = parse_comments(view(spark, sf_dir, "sources").select("path", "text"))
    return rows.where("kind = 'Comment' and not is_block and text <> ''").select("path", "line", "text")


#: Comments that have content and hold no Korean letter, in files for which no rule asks for English.
_WRONG = f"""{_COMMENTS}, j as (select *, len(regexp_extract_all(text, '[\\p{{L}}]')) as letters, doc_id % 8 = 4 as english from c)
    select path, line::bigint as line, case when english then 'english' else 'korean' end as required from j
    where length(text) >= 5 and letters >= 5 and not regexp_matches(text, '^(<[^>]*>\\s*)+$') and not regexp_matches(lower(text), '^({_TECHNICAL})') and regexp_matches(text, '[A-Za-z가-힣ぁ-ゟ゠-ヿ一-鿿]') and not english"""


def _comment_policy() -> PolicyConfig:
    cfg = PolicyConfig()
    cfg.comment_language.languages = ["python", "ruby", "hcl", "go", "typescript", "java", "rust", "dockerfile"]
    cfg.comment_language.file_languages = [("*.ts", "english")]
    return cfg


@query(_WRONG)
def comments_in_other_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of whole files that aren't Korean; those of one language must be English and are."""
    found = files.comment_language(view(spark, sf_dir, "sources").select("path", "text"), _comment_policy())
    return found.select("path", "line", F.col("params")["required"].alias("required"))


@query(f"select * from ({_WRONG}) where line % 6 = 0")
def added_comments_in_other_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a change that adds the lines divisible by six."""
    rows = view(spark, sf_dir, "sources").select("path", "text")
    n = F.size(F.split("text", "\n", -1))
    diff = rows.select("path", F.lit(False).alias("is_deleted"), F.lit(False).alias("is_submodule"), F.lit(False).alias("is_symlink"), F.filter(F.transform(F.sequence(F.lit(1), n), lambda x: x.cast("long")), lambda x: x % 6 == 0).alias("added_lines"))
    found = changes.comment_language(diff, rows, _comment_policy())
    return found.select("path", "line", F.col("params")["required"].alias("required"))


@query(f"""{_REACH}, told as (select range_id::bigint as range_id, hash from reach where side = 'stop' except select range_id::bigint, hash from reach where side = 'start'),
    m as (select doc_id, trim(concat(case doc_id % 3 when 0 then 'feat: ' when 1 then 'wip: ' else '' end, split_part(text, chr(10), 1))) as subject from documents)
    select range_id, hash, 'conventional' as "check", case when not regexp_matches(subject, '^([^\\s(:!]+)(\\([^)]*\\))?(!)?: .+') then 'conventional_format' else 'conventional_type' end as code from told join m on m.doc_id = told.hash
    where subject <> '' and lower(regexp_extract(subject, '^([^\\s(:!]+)(\\([^)]*\\))?(!)?: .+', 1)) not in ({", ".join(repr(t) for t in TYPES)}) and not (subject like 'Merge %' or subject like 'Revert %' or subject like 'fixup! %' or subject like 'squash! %')
    union all select range_id, hash, 'subject_limit', 'subject_too_long' from told join m on m.doc_id = told.hash where length(subject) > 72""")
def push_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, with the documents of their numbers as messages."""
    docs = load(spark, sf_dir, "documents")["documents"]
    head = F.when(F.col("doc_id") % 3 == 0, "feat: ").when(F.col("doc_id") % 3 == 1, "wip: ").otherwise("")
    bodies = docs.select(F.col("doc_id").alias("hash"), F.encode(F.concat(head, F.col("text")), "UTF-8").alias("content"))
    cfg = PolicyConfig()
    m = cfg.commit_message
    m.conventional_enabled = m.subject_limit_enabled = True
    m.no_ai_coauthor = m.no_unicode_spaces = m.no_ambiguous_chars = m.no_bad_runes = False
    graph, ranges = _graph(spark, sf_dir)
    pushed = ranges.select(F.col("range_id").cast("long").alias("range_id"), F.col("start_hash").alias("start"), F.col("stop_hash").alias("stop"))
    return messages.check_push(bodies, graph, pushed, cfg).select("range_id", "hash", "check", "code")
