"""Row numbers and running sums over keys of any size.

A window over a huge key (or over no key) puts all of its rows into one task. Here rows are dealt to ranges of the whole order,
numbered and summed inside each range, and moved on by what earlier ranges of their key hold: a table with a row for each key and
range. Ranges are cut by Spark's sampled splitters, so a key over many ranges is worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winlens.sources.scratch import materialize

_RANGE = "_range"


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, str] | None = None, number: str = "row", total: str | None = None) -> DataFrame:
    """rows with their number (from 1) in the order of their key, and for each of sums, name to column, the running sum up to the row.

    order must tell the rows of a key apart, or the numbers of equal ones are arbitrary; its nulls come first. total, if given, names
    a column for the number of rows of the key. Sums of a column skip nulls. An empty table gives an empty result; a null key is a key.
    """
    sums = sums or {}
    ranged = materialize(rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in [*by, *order])).withColumn(_RANGE, F.spark_partition_id()), "ranges")
    held = ranged.groupBy(*by, _RANGE).agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_n_{name}") for name, c in sums.items()))
    key = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = key.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = held.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col(_RANGE).alias("_of"), zero(F.sum("_n").over(before)).alias("_at"), F.sum("_n").over(key).alias("_total"), *(zero(F.sum(f"_n_{name}").over(before)).alias(f"_at_{name}") for name in sums))
    local = Window.partitionBy(_RANGE, *by).orderBy(*(F.col(c).asc_nulls_first() for c in order))
    inside = ranged.withColumns({"_row": F.row_number().over(local), **{f"_sum_{name}": F.sum(c).over(local.rowsBetween(Window.unboundedPreceding, 0)) for name, c in sums.items()}})
    same = F.col(_RANGE) == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = inside.join(offsets, same)
    made = {number: F.col("_row") + F.col("_at"), **{name: zero(F.col(f"_sum_{name}")) + F.col(f"_at_{name}") for name in sums}}
    if total:
        made[total] = F.col("_total")
    return out.select(*rows.columns, *(c.alias(name) for name, c in made.items()))
