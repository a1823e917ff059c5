"""Running values within one array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are summed in one run.
RUN = 256


def sums_before(values: Column, run: int = RUN) -> Column:
    """For each element of an array of numbers the sum of those before it, as array<bigint>.

    A fold that appends copies its result for every element. Here runs are summed, the runs' sums are added up, and each
    run then goes on from its own: what is copied grows with the array and not with its square.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / run).cast("int"))), lambda i: F.slice(values, i * run + 1, run))

    def carried(items: Column, first: Column) -> Column:
        return F.aggregate(items, F.struct(first.alias("p"), none.alias("o")), lambda a, x: F.struct((a["p"] + x.cast("long")).alias("p"), F.concat(a["o"], F.array(a["p"])).alias("o")), lambda a: a["o"])

    totals = F.transform(runs, lambda r: F.aggregate(r, zero, lambda s, x: s + x.cast("long")))
    out = F.flatten(F.transform(F.arrays_zip(runs.alias("r"), carried(totals, zero).alias("f")), lambda z: carried(z["r"], z["f"])))
    return F.when(F.size(values) > 0, out).otherwise(none)
