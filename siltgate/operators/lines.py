"""Texts as lines and characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_lines(df: DataFrame, text: str = "text", into: str = "line_text", number: str = "line") -> DataFrame:
    """A row for each line, numbered from 1; a trailing newline gives a last empty line, ``\\r`` stays."""
    keep = [c for c in df.columns if c not in (text, into, number)]
    out = df.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("_p", into))
    return out.withColumn(number, (F.col("_p") + 1).cast("long")).drop("_p")


def explode_chars(df: DataFrame, text: str = "line_text", into: str = "char", number: str = "col") -> DataFrame:
    """A row for each code point, numbered from 1; an empty text gives none."""
    keep = [c for c in df.columns if c not in (text, into, number)]
    out = df.where(F.length(text) > 0).select(*keep, F.posexplode(F.split(F.col(text), "")).alias("_p", into))
    return out.where(F.col(into) != "").withColumn(number, (F.col("_p") + 1).cast("long")).drop("_p")
