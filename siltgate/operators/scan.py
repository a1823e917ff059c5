"""Running values over ordered rows, in two levels.

A window over a whole file or diff puts it in one task. Here the rows of a group are cut into blocks of
neighbouring places: each block has its own window, what the blocks amount to is carried from block to
block (a row a block), and every row combines what its block was given with what stands
before it there. A group of any length is dealt to as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Places of a block.
BLOCK = 8192


def cut(rows: DataFrame, order: str, block: int | None = None) -> DataFrame:
    """``rows`` with the block ``_b`` of each, by an integer column that is unique within a group."""
    return rows.withColumn("_b", F.expr(f"`{order}` div {block or BLOCK}"))


def here(by: list[str], order: str, inclusive: bool = False) -> WindowSpec:
    """The rows of a block before a row, or up to it."""
    return W.partitionBy(*by, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)


def earlier(by: list[str]) -> WindowSpec:
    """The blocks of a group before a block."""
    return W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)


def latest(value: Column, order: str) -> Column:
    """A block's last value that isn't null."""
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


def given(rows: DataFrame, blocks: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """``rows`` with what the earlier blocks hand to theirs; blocks that get nothing are not joined."""
    told = blocks.select(*[F.col(c).alias(f"_on_{c}") for c in (*by, "_b")], *[v.alias(n) for n, v in values.items()])
    told = told.where(" or ".join(f"{n} is not null" for n in values))
    on = F.lit(True)
    for c in (*by, "_b"):
        on = on & (F.col(c).eqNullSafe(F.col(f"_on_{c}")) if c != "_b" else F.col(c) == F.col(f"_on_{c}"))
    return rows.join(told, on, "left").drop(*[f"_on_{c}" for c in (*by, "_b")])
