"""Numbers of rows in order, gapless from 0 within each group, without one task for a group.

Rows are dealt by ranges of (group, order), so a group of any size, and rows that are equal in both, are cut over as many
tasks as they need. What was dealt is written with the number of its range; rows are then numbered within a range by a
window, and what stands before is summed over one row for each range and group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, fixed: bool = False) -> DataFrame:
    """``rows``, written below the shared folder, with ``idx``: 0, 1, ... in each group by ``order``, nulls first, strings
    by their bytes. Ties go any way, but one way. Group columns have no nulls; no column is called idx, tie or stretch.
    ``fixed`` says that ``rows`` is a written table without ties, which needn't be written again first."""
    ties = [] if fixed else ["tie"]
    written = rows if fixed else cut(rows.withColumn("tie", F.monotonically_increasing_id()), f"{name}-rows")
    dealt = cut(written.repartitionByRange(*group, *order, *ties).withColumn("stretch", F.spark_partition_id()), f"{name}-stretches")
    if not fixed:
        free(written)
    before = Window.partitionBy(*group).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*group, "stretch").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = dealt.withColumn("k", F.row_number().over(Window.partitionBy("stretch", *group).orderBy(*order, *ties)))
    out = own.join(starts, [*group, "stretch"]).withColumn("idx", F.col("start") + F.col("k") - 1).select(*rows.columns, "idx")
    out = cut(out, f"{name}-numbered")
    free(dealt)
    return out
