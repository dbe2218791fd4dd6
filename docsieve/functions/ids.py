"""Dense numbers in a global order, without a single task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.shared import cut


def dense_ids(rows: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """rows with name: their place in the order, from start. A range sort, then each range's count before it."""
    ranged = cut(rows.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_mono", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).drop("_n")  # a row for each task of the sort
    out = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    local = F.col("_mono") - F.shiftleft(F.col("_part"), 33)
    return out.withColumn(name, (F.col("_before") + local + start).cast("long")).drop("_part", "_mono", "_before")
