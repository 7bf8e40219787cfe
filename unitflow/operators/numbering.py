"""Running numbers and running sums over a whole table, without a window that gathers it in one task.

Rows are dealt to ranges of the order and numbered within them; the rows of each range are counted, counts are summed range by
range, and a row's number is its range's sum and its place. The sums themselves are taken level by level: FAN ranges make a group, FAN groups a
group of groups, so no task ever sums more than FAN rows of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitflow.functions.written import written

FAN = 2048
#: A row's place in its partition is the lower bits of what monotonically_increasing_id() gives.
_PLACE_BITS = 33


def sums_before(sums: DataFrame, key: str, value: str, top: int, by: tuple[str, ...] = (), name: str = "before", fan: int = FAN) -> DataFrame:
    """sums with the sum of `value` over the rows of smaller `key`, for each `by` apart. Keys are integers from 0 to top, at most one row
    for each within `by`."""
    if top < fan:
        order = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn(name, F.coalesce(F.sum(value).over(order), F.lit(0)).cast("long"))
    group, upto, inner = f"{key}__group", f"{key}__upto", f"{key}__inside"  # each level has names of its own
    grouped = sums.withColumn(group, F.floor(F.col(key) / fan).cast("long"))
    groups = grouped.groupBy(*by, group).agg(F.sum(value).alias("__sum"))
    groups = sums_before(groups, group, "__sum", top // fan, by, upto, fan).drop("__sum")
    inside = Window.partitionBy(*by, group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = grouped.withColumn(inner, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = own.join(groups, [*by, group])
    return out.select(*sums.columns, (F.col(upto) + F.col(inner)).cast("long").alias(name))


def numbered(df: DataFrame, *order: str, name: str = "number", fan: int = FAN) -> DataFrame:
    """df with a running number from 0 in the order of the columns `order` (nulls first); rows that are equal in it get different numbers.

    One shuffle by ranges, whose result is written: it is read once for the counts of the ranges (a few bytes each) and once for the rows.
    """
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.select("*", F.shiftright(place, _PLACE_BITS).cast("int").alias("__range"), place.bitwiseAND((1 << _PLACE_BITS) - 1).alias("__place")), "numbered")
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    top = dealt.agg(F.max("__range")).first()[0] or 0
    before = sums_before(counts, "__range", "__n", top, fan=fan).drop("__n")
    return dealt.join(before, "__range").select(*df.columns, (F.col("before") + F.col("__place")).alias(name))
