"""Running sums, numbers and neighbours over a whole table in order, without bringing all rows to one task.

Rows are dealt by range of their order and written once; sums and last values of the ranges, one row each, carry over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def _dealt(df: DataFrame, order: list[str]) -> DataFrame:
    return written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")


def _carried(totals: DataFrame, of: Column) -> DataFrame:
    """Per range what ``of`` says of all ranges before it: a window over one row per range."""
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("__part", of.over(before).alias("__carried")))


def running_sum(df: DataFrame, order: list[str], value: str | Column = "n", out: str = "upto") -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row."""
    dealt = _dealt(df.withColumn("__value", F.col(value) if isinstance(value, str) else value), order)
    carried = _carried(dealt.groupBy("__part").agg(F.sum("__value").alias("__sum")), F.sum("__sum"))
    within = F.sum("__value").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(out, within).join(carried, "__part").withColumn(out, F.col(out) + F.coalesce("__carried", F.lit(0))).drop("__part", "__value", "__carried")


def numbered(df: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """``df`` with gapless numbers from 1."""
    return running_sum(df, order, F.lit(1).cast("long"), out)


def previous(df: DataFrame, order: list[str], column: str, out: str = "prev") -> DataFrame:
    """``df`` with the value of ``column`` in the row before."""
    dealt = _dealt(df, order)
    carried = _carried(dealt.groupBy("__part").agg(F.max_by(F.struct(column), F.struct(*order)).alias("__last")), F.last("__last", True))
    within = F.lag(F.struct(column)).over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn(out, within).join(carried, "__part").withColumn(out, F.coalesce(F.col(out), F.col("__carried"))[column]).drop("__part", "__carried")
