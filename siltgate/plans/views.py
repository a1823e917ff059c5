"""Deterministic views of the test tables in which every check has something to find.

Each view is one SELECT that Spark and DuckDB both run, with the special
characters as literals and newlines as chr(10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.repo import BESIDE, CACHE_DIRS, INSIDE, LANGUAGE_BY_EXT
from ..session import ship

NBSP, ZWSP, CYRILLIC_A, GRIN, HEART = " ", "​", "а", "\U0001f600", "❤"
HANGUL, KANA, HAN = "한국어 설명입니다", "これは説明です", "这是一个说明"

#: Entries that prove a cache folder from beside it and from inside.
_OUTER = sorted({x.replace("*", "m") for xs in BESIDE.values() for x in xs})
_INNER = sorted({x + "x.c" if x.endswith("/") else x for xs in INSIDE.values() for x in xs})


def _nth(values: list[str], number: str) -> str:
    """SQL for the value that a number falls on."""
    return f"split_part('{','.join(values)}', ',', cast({number} % {len(values)} + 1 as int))"


VIEWS = {
    "docs_marked": f"""select doc_id, source, lang, case
        when doc_id % 5 = 0 then replace(text, ' the ', '{NBSP}the{ZWSP} ')
        when doc_id % 7 = 0 then replace(text, 'a', '{CYRILLIC_A}')
        when doc_id % 11 = 0 then concat(replace(text, '.', ' {GRIN}.'), '{HEART}')
        else text end as text from documents""",
    "docs_scripts": f"""select doc_id, source, case doc_id % 4
        when 0 then concat('{HANGUL} ', text) when 1 then concat('{KANA}', chr(10), text)
        when 2 then concat('{HAN}', text) else text end as text from documents""",
    "docs_blanks": """select doc_id, case doc_id % 6
        when 0 then replace(text, chr(10), concat(chr(13), chr(10))) when 1 then replace(text, '.', concat('. ', chr(10)))
        when 2 then concat(chr(9), replace(text, chr(10), concat(chr(10), '  ', chr(9)))) when 3 then concat(text, chr(10))
        when 4 then concat('x', chr(10), '  y', chr(10), chr(9), 'z', chr(10), text) else text end as text from documents""",
    "msgs": f"""select conv_id * 1000 + turn as msg_id, concat(case conv_id % 6
        when 0 then 'feat: ' when 1 then 'fix(x)!: ' when 2 then 'Merge ' when 3 then 'wip: ' when 4 then 'docs(): ' else '' end,
        substr(replace(text, chr(10), ' '), 1, 50 + cast(turn % 5 as int) * 10), chr(10), chr(10), text, case turn % 3
        when 0 then concat(chr(10), 'Co-authored-by: Helper <bot@cursor.sh>') when 1 then concat(chr(10), 'Co-Authored-By: A. Person <a@example.org>')
        else '{ZWSP}' end) as text from conversations""",
    "repo_paths": """select doc_id, concat(source, '/', lang, '/', case when doc_id % 9 = 0 then 'node_modules/' when doc_id % 10 = 0 then '__pycache__/' else '' end,
        'f', doc_id, case doc_id % 7 when 0 then '.go' when 1 then '.py' when 2 then '.PNG' when 3 then '.tar.gz' when 4 then '.md' when 5 then '.Dockerfile' else '' end) as path,
        n_chars as size from documents
        union all select distinct -1 as doc_id, concat(source, '/', lang, '/package.json') as path, 10 as size from documents where lang <> 'es'
        union all select distinct -2 as doc_id, concat(source, '/', lang, '/setup.py') as path, 20 as size from documents where lang = 'en'""",
    "tree_paths": f"""select doc_id, concat(source, '/p', doc_id % 97, '/', case doc_id % 13 when 3 then concat('env', doc_id % 4, '/lib/') when 5 then '.hid/' when 7 then 'build/sub/' when 9 then '.git/' else '' end,
        case when doc_id % 2 = 0 then concat({_nth(CACHE_DIRS + ['src'], 'doc_id')}, '/') else '' end,
        case when doc_id % 5 = 0 then {_nth(_INNER, 'doc_id')} else concat('f', doc_id, {_nth(sorted(LANGUAGE_BY_EXT) + ['.bin'], 'doc_id')}) end) as path, n_chars as size from documents
        union all select distinct -1 as doc_id, concat(source, '/p', doc_id % 97, case when doc_id % 3 = 0 then '/.hid' else '' end, '/', {_nth(_OUTER, 'doc_id % 97')}) as path, 10 as size from documents
        union all select distinct -2 as doc_id, concat(source, '/p', doc_id % 97, '/env', doc_id % 3, '/pyvenv.cfg') as path, 10 as size from documents where doc_id % 4 = 1
        union all select distinct -3 as doc_id, concat(source, '/p', doc_id % 97, '/env', doc_id % 4, '/lib/package.json') as path, 10 as size from documents""",
    "sources": """select doc_id, concat('src/', doc_id, split_part('.py,.rb,.tf,.go,.ts,.java,.rs,.dockerfile', ',', cast(doc_id % 8 + 1 as int))) as path,
        concat(case when doc_id % 8 = 3 then concat('package x', chr(10)) else '' end, case when doc_id % 8 in (0, 1, 2) then 'x = 1' when doc_id % 8 = 7 then 'RUN x' else 'var x = 1;' end, chr(10), case when doc_id % 8 in (0, 1, 2, 7) then '# ' else '// ' end,
        replace(text, chr(10), concat(chr(10), case when doc_id % 8 in (0, 1, 2) then 'x = 1' when doc_id % 8 = 7 then 'RUN x' else 'var x = 1;' end, chr(10), case when doc_id % 8 in (0, 1, 2, 7) then '# ' else '// ' end))) as text
        from documents""",
    "ec_files": """select '.editorconfig' as path, concat('[*]', chr(10), 'indent_style = Space', chr(10), 'end_of_line = lf', chr(10), '[*.{py,rs}]', chr(10), 'charset = latin1', chr(10)) as text from region where r_regionkey = 0
        union all select distinct concat(source, '/.editorconfig') as path, concat(case when length(source) % 2 = 1 then concat('; top', chr(10), 'root = TRUE', chr(10)) else '' end, '[*.py]', chr(10), 'indent_style = tab', chr(10),
        '[p1*/**]', chr(10), 'insert_final_newline = true', chr(10)) as text from documents
        union all select distinct concat(source, '/p', doc_id % 97, '/.editorconfig') as path, concat(case when doc_id % 97 % 5 = 0 then concat('root = true', chr(10)) else '' end, '[*.{js,ts}]', chr(10), 'charset = utf-8', chr(10),
        '[build/**.py]', chr(10), 'end_of_line = crlf', chr(10), '[f?[0-9]*]', chr(10), 'indent_style = unset', chr(10), 'root = true', chr(10)) as text from documents where doc_id % 97 % 3 = 0""",
    "commit_graph": """select o_orderkey as hash, floor(o_custkey / 20) as cluster, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as p1,
        case when o_orderkey % 3 = 0 then lag(o_orderkey, 3) over (partition by floor(o_custkey / 20) order by o_orderkey) end as p2 from orders""",
    "commit_ranges": """select floor(o_custkey / 20) as range_id, max(case when o_custkey % 3 = 0 then o_orderkey end) as start_hash, max(o_orderkey) as stop_hash,
        max(case when o_custkey % 3 = 1 then o_orderkey end) as left_hash, max(case when o_custkey % 3 = 2 then o_orderkey end) as right_hash from orders group by 1""",
    "scripts": """select doc_id, concat('src/', doc_id, '.sh') as path, concat('#!/bin/sh', chr(10), replace(text, '. ', concat('.', chr(10), '# '))) as text from documents""",
}


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    ship(spark)
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables it names."""
    sql = VIEWS[name]
    tables = load(spark, sf_dir, *[t for t in ("documents", "conversations", "pages", "orders", "region") if f"from {t}" in sql])
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces of the view itself are no names
    for t in tables:
        sql = sql.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(sql, **tables)


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names as common tables."""
    used = [v for v in VIEWS if v in sql]
    if not used:
        return sql
    body = sql.lstrip()
    head = next((h for h in ("with recursive ", "with ") if body.startswith(h)), "")
    return f"{head or 'with '}{', '.join(f'{v} as ({VIEWS[v]})' for v in used)}{', ' if head else ' '}{body.removeprefix(head)}"
