"""Occurrences of invisible, look-alike and emoji characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chars
from .lines import explode_chars, explode_lines


def _occurrences(df: DataFrame, text: str, cls: str, within: str | None = None) -> DataFrame:
    """Characters of a class with line and column; texts and lines without one are never split."""
    rows = explode_lines(df.where(F.col(text).rlike(cls)), text)
    rows = explode_chars(rows.where(F.col("line_text").rlike(cls))).where(F.col("char").rlike(within or cls))
    return rows.withColumn("code_point", chars.code_point(F.col("char")))


def invisible_occurrences(df: DataFrame, text: str = "text") -> DataFrame:
    """line, col, char, code_point, name of each invisible character."""
    return _occurrences(df, text, chars.INVISIBLE).withColumn("name", chars.name_of_invisible(F.col("code_point")))


def lookalike_occurrences(df: DataFrame, text: str = "text", locale: str = "", extra: dict[int, str] | None = None) -> DataFrame:
    """line, col, char, code_point, looks_like of each look-alike of an ASCII character."""
    return _occurrences(df, text, chars.lookalike_class(locale, extra)).withColumn("looks_like", chars.lookalike_of(F.col("char"), locale, extra))


def emoji_occurrences(df: DataFrame, text: str = "text") -> DataFrame:
    """line, col, char, code_point of each emoji; joiners and selectors are not reported."""
    return _occurrences(df, text, chars.EMOJI_REPORTED)


def unicode_summary(df: DataFrame, by: str, key: str, text: str = "text", locale: str = "") -> DataFrame:
    """Per group and kind: occurrences and documents."""
    keep = df.select(by, key, text)
    found = invisible_occurrences(keep, text).select(by, key, F.lit("invisible").alias("kind")).unionByName(lookalike_occurrences(keep, text, locale).select(by, key, F.lit("lookalike").alias("kind")))
    return found.groupBy(by, "kind", key).agg(F.count("*").alias("n")).groupBy(by, "kind").agg(F.sum("n").alias("n_chars"), F.count("*").alias("n_docs"))
