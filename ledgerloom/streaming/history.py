"""The scoreboard run after run: stored per date, with the change since the run before."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.model.tables import RetailTables
from ledgerloom.plans.quality import scoreboard

_SCHEMA = (
    "cod string, verificacao string, severidade string, ocorrencias bigint, data_execucao date"
)


def record(tables: RetailTables, run: date, folder: str) -> None:
    """Store the scoreboard of a run, worked out from scratch."""
    store(scoreboard(tables), run, folder)


def store(lines: DataFrame, run: date, folder: str) -> None:
    """Store a scoreboard; a second run on the same date replaces the first."""
    lines.coalesce(1).write.mode("overwrite").parquet(
        f"{folder.rstrip('/')}/data_execucao={run.isoformat()}"
    )


def trend(spark: SparkSession, folder: str) -> DataFrame:
    """All runs, each rule with its change since the previous run."""
    runs = spark.read.schema(_SCHEMA).parquet(folder)
    # A window per rule over one row per run: small however large the tables are.
    by_rule = Window.partitionBy("cod").orderBy("data_execucao")
    return runs.withColumn("variacao", F.col("ocorrencias") - F.lag("ocorrencias").over(by_rule))
