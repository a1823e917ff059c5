"""The common shape of findings: structured rows, rendered last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("check", "path", "line", "col", "code", "params")


def finding(df: DataFrame, check: str, code: str | Column, line: str | Column | int = 0, col: str | Column | int = 0, path: str | Column = "path", **params: Column) -> DataFrame:
    """Rows of ``df`` as findings. line and col 0: unknown or of no place."""
    at = lambda x: F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x
    pairs = [x for k, v in sorted(params.items()) for x in (F.lit(k), v.cast("string"))]
    table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(
        F.lit(check).alias("check"),
        (F.col(path) if isinstance(path, str) else path).cast("string").alias("path"),
        at(line).cast("long").alias("line"),
        at(col).cast("long").alias("col"),
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        table.alias("params"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
