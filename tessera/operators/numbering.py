"""Positions of rows within groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import materialize


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Adds the position, from 1, of each row in its group (by) and order, like row_number(), for groups of any size.

    Rows are dealt by ranges of (by, order), so that a large group spreads over many tasks; each range is numbered on its
    own, and the number of the group's rows in earlier ranges, a small table, is added. The ranges are written down first:
    Spark samples anew whenever it deals by range, and both steps need the same ranges. Ties may be numbered either way.
    Rows whose group columns are null form a group.
    """
    dealt = materialize(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)))
    sizes = dealt.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return local.join(offsets, same).select(*df.columns, (F.col("_local") + F.col("_before")).alias(name))
