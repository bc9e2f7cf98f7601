"""Spreadsheet tabs: column contract, overflow block, date texts, ingest report."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.casts import blank_to_null, to_date, to_decimal, to_whole
from ledgerloom.model.schema import DATE, INT, LONG, TEXT, PURCHASE_ORDER
from ledgerloom.sources.csv import write_text

# Names a reader gives to columns without heading, date pattern
_NO_HEADING = re.compile(r"^(Unnamed.*|_c\d+)$")
_MIDNIGHT = r"^\d{4}-\d{2}-\d{2} 00:00:00$"

# Meaning of the overflow block of the order tab, by position
OVERFLOW_COLUMNS = (
    "data_pedido", "item", "produto_id", "descricao_produto", "ordem_compra", "qtde_pedida",
    "filial_id", "data_entrega", "qtde_entregue", "qtde_pendente", "preco_compra",
)


@dataclass(frozen=True)
class Sheet:
    name: str
    found: int  # columns in the tab
    table: DataFrame
    overflow: DataFrame | None
    source: DataFrame  # all columns as they arrived


def overflow_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if _NO_HEADING.match(c)]


def first_columns(df: DataFrame, count: int) -> DataFrame:
    return df.select([F.col(f"`{c}`") for c in df.columns[:count]])


def overflow_block(df: DataFrame) -> DataFrame | None:
    """Columns without heading; rows empty in all of them are left out."""
    names = overflow_names(df)
    if not names:
        return None
    return df.select([F.col(f"`{c}`") for c in names]).na.drop(how="all")


def typed_overflow(block: DataFrame) -> DataFrame:
    """The overflow block of the order tab under its positional names, typed."""
    out = []
    for source, name in zip(block.columns, OVERFLOW_COLUMNS, strict=True):
        dtype, raw = PURCHASE_ORDER.typed_schema[name].dataType, F.col(f"`{source}`")
        if dtype == TEXT:
            value = blank_to_null(raw)
        elif dtype == DATE:
            value = to_date(raw)
        elif dtype in (INT, LONG):
            value = to_whole(raw, dtype)
        else:
            value = to_decimal(raw, dtype)
        out.append(value.alias(name))
    return block.select(*out)


def trim_midnights(df: DataFrame) -> DataFrame:
    """``2025-01-11 00:00:00`` to ``2025-01-11`` in columns where every value looks like that.

    One aggregate decides for all columns. A column with a single value of
    another shape, or without any value, stays as it is.
    """
    checks = [F.bool_and(F.col(f"`{c}`").rlike(_MIDNIGHT)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    verdict = df.agg(F.struct(*checks).alias("all_match")).scalar()
    return df.select(
        [
            F.when(verdict.getField(f"c{i}"), F.substring(F.col(f"`{c}`"), 1, 10))
            .otherwise(F.col(f"`{c}`"))
            .alias(c)
            for i, c in enumerate(df.columns)
        ]
    )


def extract(name: str, df: DataFrame, contract: int) -> Sheet:
    """Split a tab into its table and its overflow block; no value is dropped.

    The overflow block keeps its date texts as they are.
    """
    table = trim_midnights(first_columns(df, contract))
    return Sheet(name, len(df.columns), table, overflow_block(df), df)


def write_side_file(sheet: Sheet, folder: str) -> str | None:
    """The overflow block of a tab as text beside its table; where it lies, if there is one."""
    if sheet.overflow is None:
        return None
    path = f"{folder.rstrip('/')}/{sheet.name}_sem_cabecalho"
    write_text(sheet.overflow, path, mode="overwrite")
    return path


def ingest_report(sheets: list[Sheet]) -> DataFrame:
    """Per tab: rows, columns kept and found, and the size of its overflow block; one pass each."""
    report = None
    for sheet in sheets:
        names = overflow_names(sheet.source)
        filled = F.coalesce(*[F.col(f"`{c}`") for c in names]).isNotNull() if names else F.lit(False)
        line = sheet.source.agg(
            F.lit(sheet.name).alias("tabela"),
            F.count("*").alias("linhas"),
            F.lit(len(sheet.table.columns)).alias("colunas_mantidas"),
            F.lit(sheet.found).alias("colunas_encontradas"),
            F.lit(len(names)).alias("colunas_sem_cabecalho"),
            F.count_if(filled).alias("linhas_sem_cabecalho"),
        )
        report = line if report is None else report.unionByName(line)
    return report
