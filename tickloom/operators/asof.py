"""As-of join: to each row the nearest row of another table on or before (or on or after) it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], direction: str = "backward") -> DataFrame:
    """Columns of `left` and `values` of the nearest row of `right` with equal keys; NULL without one.

    backward: the last row at or before `on`; forward: the first at or after it. Both tables go through one shuffle on
    the keys and one sort; a key's rows are a series, bounded by its calendar. Of right rows at one point the largest
    values count, as a struct in the order given. A NULL `on` or key on the left matches nothing.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction {direction!r} is neither backward nor forward")
    keys = list(keys)
    found = F.struct(*values)
    kind = right.select(found.alias("f")).schema["f"].dataType
    rows = left.select(*keys, on, F.struct("*").alias("_row"), F.lit(None).cast(kind).alias("_found"), F.lit(1).alias("_side"))
    points = right.filter(F.col(on).isNotNull()).groupBy(*keys, on).agg(F.max(found).alias("_found"))
    points = points.select(*keys, on, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_found", F.lit(0).alias("_side"))
    at = F.col(on).asc_nulls_first() if direction == "backward" else F.col(on).desc_nulls_first()
    seen = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.unionByName(points).withColumn("_near", F.last("_found", ignorenulls=True).over(seen)).filter("_side = 1")
    return joined.select("_row.*", *(F.col(f"_near.{v}").alias(v) for v in values))
