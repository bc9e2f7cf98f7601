"""Which keys of a stored table have very many rows: sketches kept beside it.

A sketch of the most frequent keys is made once, when rows are stored, from the
key columns alone; sketches of loads merge. A lookup join that asks for it need
not count its left side. Counts are estimates that are never too low by more than
the sketch's error, about one part in the number of keys tracked: enough to deal
a crowded key over several tasks, which is all they are used for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that a sketch tracks, and so the bound of its size.
TRACKED = 100_000
#: Keys that are told from a sketch, the most frequent first.
TOLD = 10_000


class KeySketches:
    """Sketches below a warehouse folder, by table and key columns."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.folder = spark, f"{warehouse.rstrip('/')}/key_sketches"

    def _path(self, table: str, keys: Sequence[str]) -> str:
        return f"{self.folder}/{table}/{'-'.join(keys)}"

    def store(self, table: str, rows: DataFrame, keys: Sequence[str], load: int = 0, first: bool = True) -> None:
        """The sketch of a load's rows; ``first`` forgets the loads before it, others are added to them."""
        key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key")
        sketch = rows.select(key).agg(F.expr(f"approx_top_k_accumulate(key, {TRACKED})").alias("sketch"))
        target = self._path(table, keys) if first else f"{self._path(table, keys)}/carga={load}"
        if first:
            sketch = sketch.withColumn("carga", F.lit(load))
            sketch.write.mode("overwrite").partitionBy("carga").parquet(target)
        else:
            sketch.write.mode("overwrite").parquet(target)

    def counts(self, table: str, keys: Sequence[str], schema: T.StructType) -> DataFrame | None:
        """The most frequent keys with ``_rows``, over all loads; None where no sketch is stored."""
        path = self._path(table, keys)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        merged = self.spark.read.parquet(path).agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
        told = merged.select(F.expr(f"inline(approx_top_k_estimate(sketch, {TOLD}))"))
        key = T.StructType([schema[k] for k in keys])
        return told.select(F.from_json("item", key).alias("key"), F.col("count").alias("_rows")).select("key.*", "_rows")
