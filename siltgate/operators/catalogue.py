"""Texts of findings in several languages: a table of (locale, code), joined by broadcast, with a fallback chain a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts by code in English, Korean, Japanese and Chinese; ``%{name}`` is filled from a finding's parameters.
LOCALES = ("en", "ko", "ja", "zh")
TEXTS = {
    "ai_coauthor": ("an assistant is named as co-author: %{trailer}", "어시스턴트가 공동 작성자로 적혀 있습니다: %{trailer}", "アシスタントが共同作成者になっています: %{trailer}", "共同作者中写有助手: %{trailer}"),
    "invisible_char": ("invisible character %{char} %{name}", "보이지 않는 문자 %{char} %{name}", "見えない文字 %{char} %{name}", "不可见字符 %{char} %{name}"),
    "ambiguous_char": ("%{char} looks like '%{looks_like}'", "%{char} 문자는 '%{looks_like}'와 닮았습니다", "%{char} は '%{looks_like}' に似ています", "%{char} 看起来像 '%{looks_like}'"),
    "bad_byte": ("byte 0x%{byte} is not UTF-8", "바이트 0x%{byte}는 UTF-8이 아닙니다", "バイト 0x%{byte} は UTF-8 ではありません", "字节 0x%{byte} 不是 UTF-8"),
    "emoji": ("emoji %{char}", "이모지 %{char}", "絵文字 %{char}", "表情符号 %{char}"),
    "language": ("written in %{detected}", "%{detected} 언어로 쓰여 있습니다", "%{detected} で書かれています", "使用了 %{detected} 语言"),
    "conventional_format": ("the subject is not of the form type(scope): text", "제목이 type(scope): text 형식이 아닙니다", "件名が type(scope): text の形ではありません", "标题不符合 type(scope): text 的形式"),
    "conventional_type": ("unknown commit type", "알 수 없는 커밋 유형입니다", "不明なコミット種別です", "未知的提交类型"),
    "conventional_scope": ("a scope is required", "범위(scope)가 필요합니다", "スコープが必要です", "需要写明范围"),
    "subject_too_long": ("the subject has %{length} characters", "제목이 %{length}자입니다", "件名が %{length} 文字あります", "标题有 %{length} 个字符"),
    "body_line_too_long": ("the line has %{length} characters", "이 줄은 %{length}자입니다", "この行は %{length} 文字あります", "该行有 %{length} 个字符"),
    "custom_rule": ("%{rule}: %{message}",) * 4,
    "binary_block": ("binary files of this kind are blocked", "이런 종류의 바이너리 파일은 막혀 있습니다", "この種のバイナリーは禁止されています", "禁止此类二进制文件"),
    "binary_lfs": ("the file belongs into large-file storage", "이 파일은 대용량 저장소에 두어야 합니다", "このファイルは大容量ストレージに置いてください", "该文件应放入大文件存储"),
    "not_utf8": ("the file is not UTF-8 (%{charset}?)", "파일이 UTF-8이 아닙니다 (%{charset}?)", "ファイルが UTF-8 ではありません (%{charset}?)", "文件不是 UTF-8 (%{charset}?)"),
    "charset_bom": ("the file starts with a byte-order mark", "파일이 바이트 순서 표시로 시작합니다", "ファイルがバイト順マークで始まります", "文件以字节顺序标记开头"),
    "end_of_line": ("wrong line end", "줄 끝 문자가 다릅니다", "改行コードが違います", "行尾符不正确"),
    "final_newline": ("no newline at the end", "끝에 줄바꿈이 없습니다", "末尾に改行がありません", "末尾没有换行"),
    "trailing_whitespace": ("blanks at the end of the line", "줄 끝에 공백이 있습니다", "行末に空白があります", "行尾有空白"),
    "indent_style": ("wrong indentation", "들여쓰기가 다릅니다", "字下げが違います", "缩进不正确"),
    **{f"lint_{k}": ("%{message}",) * 4 for k in ("yaml", "json", "jsonc", "relaxed_json", "xml", "toml")},
    "cache_dir_staged": ("%{dir} is a cache folder", "%{dir}는 캐시 폴더입니다", "%{dir} はキャッシュフォルダーです", "%{dir} 是缓存目录"),
    "cache_dir_committed": ("the cache folder holds %{files} tracked files", "캐시 폴더에 추적되는 파일이 %{files}개 있습니다", "キャッシュフォルダーに追跡ファイルが %{files} 個あります", "缓存目录中有 %{files} 个被跟踪的文件"),
    "protected_deleted": ("a protected file is deleted", "보호된 파일이 삭제되었습니다", "保護されたファイルが削除されています", "受保护的文件被删除"),
    "protected_added": ("a file is added under a protected path", "보호된 경로에 파일이 추가되었습니다", "保護されたパスにファイルが追加されています", "受保护的路径下新增了文件"),
    "protected_modified": ("a protected file is changed", "보호된 파일이 변경되었습니다", "保護されたファイルが変更されています", "受保护的文件被修改"),
    "append_only_deleted": ("an append-only file is deleted", "추가 전용 파일이 삭제되었습니다", "追記専用ファイルが削除されています", "只可追加的文件被删除"),
    "append_only_modified": ("existing content of an append-only file is changed", "추가 전용 파일의 기존 내용이 변경되었습니다", "追記専用ファイルの既存の内容が変更されています", "只可追加的文件的已有内容被修改"),
    "append_only_order": ("the name must come after %{latest}", "이름은 %{latest} 다음이어야 합니다", "名前は %{latest} より後でなければなりません", "名称必须排在 %{latest} 之后"),
}


def table(spark: SparkSession, texts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(locale, code, text)."""
    rows = [(loc, code, text) for code, ts in (texts or TEXTS).items() for loc, text in zip(LOCALES, ts)]
    return spark.createDataFrame(rows, "locale string, code string, text string")


def filled(template: Column, params: Column) -> Column:
    """Placeholders replaced in one pass: a value's own text is not read again; those without a value stay."""
    parts = F.regexp_extract_all(template, F.lit(r"(?s)%\{[^}]*\}|[^%]+|%"), F.lit(0))
    name = lambda x: F.substring(x, 3, F.length(x) - 3)
    value = lambda x: F.coalesce(F.try_element_at(params, name(x)), x)
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("%{") & x.endswith("}"), value(x)).otherwise(x)), "")


def chain(locale: Column, last: str = "en") -> Column:
    """The locales to look in: the whole tag, its beginnings, then ``last``: zh_Hant-TW, zh-hant, zh, en."""
    tag = F.lower(F.translate(F.coalesce(locale, F.lit("")), "_", "-"))
    parts = F.split(F.regexp_replace(tag, r"[.@].*$", ""), "-")
    whole = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))
    return F.concat(whole, F.array(F.lit(last)))


def translated(found: DataFrame, locale: str | Column, texts: DataFrame | None = None) -> DataFrame:
    """``found(code, params, ...)`` with ``text``, each row in its own locale.

    ``texts(locale, code, text)`` defaults to the catalogue of this module; it has a row a locale and code, so it is broadcast, as
    one map a code. Where a text is missing the next locale of ``chain`` has it; a code that no locale has gives ``[code]``.
    A null locale is English; an own column ``text`` is replaced.
    """
    texts = table(found.sparkSession) if texts is None else texts
    by_code = texts.where("text is not null").groupBy("locale", "code").agg(F.max("text").alias("t")).groupBy(F.col("code").alias("_code")).agg(F.map_from_entries(F.collect_list(F.struct(F.lower(F.translate("locale", "_", "-")), "t"))).alias("_texts"))
    loc = F.lit(locale) if isinstance(locale, str) else locale
    keep = [c for c in found.columns if c != "text"]
    rows = found.select(*keep, chain(loc).alias("_chain")).join(F.broadcast(by_code), F.col("code") == F.col("_code"), "left")
    some = F.filter(F.transform("_chain", lambda x: F.try_element_at("_texts", x)), lambda x: x.isNotNull())
    template = F.coalesce(F.try_element_at(some, F.lit(1)), F.concat(F.lit("["), "code", F.lit("]")))
    return rows.select(*keep, filled(template, F.col("params")).alias("text"))
