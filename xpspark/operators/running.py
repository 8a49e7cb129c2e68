"""Running sums over groups of any size.

A window over a whole group would put it in one task. Places are longs, so a group is cut twice by their high bits: a
window never holds more than ``2 ** BITS`` places of one group, and the sums of blocks before a row are added by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 21


def before(rows: DataFrame, group: list[str], at: str, tie: str, weight: str, n: str, total: str) -> DataFrame:
    """``rows`` with ``n``, the sum of ``weight`` up to and with the row by (``at``, ``tie``), and ``total``, that of its group.

    ``at`` must not be negative.
    """
    rows = rows.withColumn("__block", F.shiftright(at, BITS))
    sums = rows.groupBy(*group, "__block").agg(F.sum(weight).alias("__s")).withColumn("__far", F.shiftright("__block", BITS))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    near = F.coalesce(F.sum("__s").over(earlier(*group, "__far").orderBy("__block")), F.lit(0))
    far = sums.groupBy(*group, "__far").agg(F.sum("__s").alias("__f"))
    far = far.select(*group, "__far", F.coalesce(F.sum("__f").over(earlier(*group).orderBy("__far")), F.lit(0)).alias("__before"), F.sum("__f").over(Window.partitionBy(*group)).alias(total))
    offsets = sums.withColumn("__near", near).join(far, [*group, "__far"]).select(*group, "__block", (F.col("__near") + F.col("__before")).alias("__offset"), total)
    own = Window.partitionBy(*group, "__block").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn(n, F.sum(weight).over(own)).join(offsets, [*group, "__block"])
    return out.withColumn(n, F.col(n) + F.col("__offset")).drop("__block", "__offset")
