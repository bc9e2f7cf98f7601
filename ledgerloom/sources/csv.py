"""Text files: faithful CSV reading and writing.

An empty field without quotes is NULL and ``""`` is an empty string, quotes
inside a value are doubled, blanks around a value are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.model.schema import TABLES, Table
from ledgerloom.model.tables import RetailTables
from ledgerloom.session import pinned

CORRUPT = "_corrupt"

# A marker no text file holds, so that an empty field and "" stay different.
_NO_VALUE = "\u0000"

_READ = {
    "header": True,
    "encoding": "UTF-8",
    "quote": '"',
    "escape": '"',
    "nullValue": _NO_VALUE,
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "enforceSchema": True,
    # A parser that skips unselected columns does not see that a row is ragged.
    "columnPruning": False,
}
_WRITE = {
    "header": True,
    "encoding": "UTF-8",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": '""',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_text(
    spark: SparkSession,
    path: str,
    table: Table,
    strict: bool = False,
    match_header: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """Every column as text, in file order.

    Rows with too few or too many fields keep their text in ``_corrupt``;
    ``strict`` fails on them instead. ``match_header`` also checks the header
    names against the schema. ``multiline`` allows line breaks inside quoted
    values, at the price of one task per file.
    """
    schema = table.raw_schema
    options = {**_READ, "enforceSchema": not match_header, "multiLine": multiline}
    if strict:
        return spark.read.schema(schema).options(**options, mode="FAILFAST").csv(path)
    schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(schema)
        .options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        .csv(path)
    )


@dataclass(frozen=True)
class Staged:
    rows: DataFrame  # well-formed rows, every column as text
    ragged: DataFrame  # ``_corrupt``: the text of the others


def stage_text(spark: SparkSession, path: str, table: Table, **options) -> Staged:
    """Parse a file once into a staging table and split off its ragged rows.

    Staging keeps the raw text at hand for later proofs, and spares every
    reader after the first the parsing.
    """
    staged = pinned(read_text(spark, path, table, **options), f"staging-{table.name}")
    return Staged(
        staged.where(F.col(CORRUPT).isNull()).drop(CORRUPT),
        staged.where(F.col(CORRUPT).isNotNull()).select(CORRUPT),
    )


def write_text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.options(**_WRITE).mode(mode).csv(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A tab with all its columns as text, headerless ones included, names from the file."""
    return spark.read.options(**_READ).option("inferSchema", False).csv(path)


def stage_folder(spark: SparkSession, folder: str) -> tuple[RetailTables, dict[str, DataFrame]]:
    """Staging tables and ragged rows of a folder with one CSV file or directory per table."""
    staged = {
        t.name: stage_text(spark, f"{folder.rstrip('/')}/{t.file}.csv", t) for t in TABLES.values()
    }
    return (
        RetailTables(**{name: s.rows for name, s in staged.items()}),
        {name: s.ragged for name, s in staged.items()},
    )
