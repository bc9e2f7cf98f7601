"""Consecutive numbers over any number of rows, without one task seeing them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import pinned


def next_number(df: DataFrame, column: str) -> int:
    """One above the largest number in use; 1 for an empty table."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("top")).first()["top"] + 1


class NumberMark:
    """The highest number ever handed out, so that none is handed out twice.

    Kept beside the register it belongs to, as rows that are only added: the
    largest counts. A writer adds its row before its numbers are used, so a
    failure between the two leaves a gap and never a number used twice. ``step``
    names the writer's turn; with ``before`` a turn that is repeated starts where
    it started the first time.
    """

    _SCHEMA = "step long, last long"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/numbers"

    def last(self, before: int | None = None) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return 0
        marks = self.spark.read.schema(self._SCHEMA).parquet(self.folder)
        if before is not None:
            marks = marks.where(F.col("step") < before)
        return marks.agg(F.coalesce(F.max("last"), F.lit(0)).alias("top")).first()["top"]

    def advance(self, last: int, step: int = 0) -> None:
        row = self.spark.range(1).select(F.lit(step).cast("long").alias("step"), F.lit(last).cast("long").alias("last"))
        row.write.mode("append").parquet(self.folder)

    def restart(self, last: int) -> None:
        """A full load begins its numbers anew."""
        row = self.spark.range(1).select(F.lit(0).cast("long").alias("step"), F.lit(last).cast("long").alias("last"))
        row.write.mode("overwrite").parquet(self.folder)


def number_rows(df: DataFrame, order_by: Sequence[str], out: str, start: int | Column) -> DataFrame:
    """Add ``out`` = ``start``, ``start + 1``, ... in ``order_by`` order.

    Rows are range-partitioned, so each slice can be numbered on its own once
    the sizes of the slices before it are known. The slices are written first:
    a second evaluation of the range partitioning could cut them elsewhere.
    ``order_by`` must identify a row.
    """
    order_by = list(order_by)
    sliced = df.repartitionByRange(*order_by).withColumn("_slice", F.spark_partition_id())
    sliced = pinned(sliced, "numbering")
    # One row per slice: bounded by the number of shuffle partitions.
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_slice").orderBy(*order_by)
    start = F.lit(start) if isinstance(start, int) else start
    return (
        sliced.withColumn("_rank", F.row_number().over(within))
        .join(F.broadcast(offsets), "_slice")
        .withColumn(out, (start + F.col("_offset") + F.col("_rank") - 1).cast("int"))
        .drop("_slice", "_rank", "_offset")
    )
