"""Typed loads: raw text in, typed rows out, with every unusable value named.

A load never aborts on a bad value. Each typed row carries ``_faults``: a
comma-separated text naming the columns whose raw text was filled in but could
not be read as the column's type. :func:`judge` adds the integrity faults, and
the caller decides which rows to keep.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.casts import blank_to_null, digits, is_blank, to_clock, to_date, to_decimal, to_whole
from ledgerloom.model.schema import DATE, INT, LONG, TABLES, TEXT, Table
from ledgerloom.model.schema import Column as TableColumn
from ledgerloom.model.tables import RetailTables
from ledgerloom.operators.integrity import check_faults, duplicate_keys, null_faults, width_faults
from ledgerloom.operators.skew import lookup_join
from ledgerloom.session import pinned, pinned_at

FAULTS = "_faults"


def _read_as(column: TableColumn) -> Column:
    dtype, raw = column.type, F.col(column.name)
    if dtype == TEXT:  # a required text keeps an empty string, an optional one has none
        return F.trim(raw) if column.required else blank_to_null(raw)
    if dtype == DATE:
        return to_date(raw)
    if dtype in (INT, LONG):
        return to_whole(raw, dtype)
    return to_decimal(raw, dtype)


# Columns that do not simply follow their declared type, from raw columns and from
# what could be read in them (``_read_x`` of column x).
_SPECIAL: dict[str, dict[str, Callable[[], Column]]] = {
    "supplier": {"fornecedor_num": lambda: digits(F.col("idfornecedor"))},
    "branch_product": {"idfornecedor_num": lambda: F.lit(None).cast(INT)},
    "purchase_order": {
        "ordem_compra": lambda: F.coalesce("_read_ordem_compra", F.lit(0)),
        "qtde_entregue": lambda: F.coalesce("_read_qtde_entregue", _zero()),
        "qtde_pendente": lambda: F.greatest(
            F.coalesce("_read_qtde_pedida", _zero()) - F.coalesce("_read_qtde_entregue", _zero()),
            _zero(),
        ).cast("decimal(14,3)"),
    },
    "goods_receipt": {},
    "sales": {
        "horariomov": lambda: F.when(is_blank(F.col("horariomov")), F.lit("00:00:00")).otherwise(F.col("_read_horariomov")),
    },
}


def _zero() -> Column:
    return F.lit(0).cast("decimal(14,3)")


def skipped_rows(name: str, raw: DataFrame) -> DataFrame:
    """Raw rows a load passes over because their key is blank."""
    return raw.where(is_blank(F.col(TABLES[name].row_key)))


def skip_report(raw: RetailTables) -> DataFrame:
    """Rows read and rows passed over, per table; one pass each."""
    lines = None
    for name, table in TABLES.items():
        line = raw[name].agg(
            F.lit(name).alias("tabela"),
            F.count("*").alias("lidas"),
            F.count_if(is_blank(F.col(table.row_key))).alias("puladas"),
        )
        lines = line if lines is None else lines.unionByName(line)
    return lines


def _read(name: str, raw: DataFrame) -> DataFrame:
    """Raw rows with ``_read_x`` for each raw column x.

    The casts are made as one row of a generator, so that they are evaluated once
    and not again in every filter and projection that the values end up in.
    """
    table = TABLES[name]
    values = [
        (to_clock(F.col(c.name)) if c.name == "horariomov" else _read_as(c)).alias(f"_read_{c.name}")
        for c in table.columns
        if c.name in table.raw_columns
    ]
    return raw.select(*table.raw_columns, F.inline(F.array(F.struct(*values))))


def _typed(table: Table) -> list[Column]:
    special = _SPECIAL[table.name]
    return [
        (special[c.name]() if c.name in special else F.col(f"_read_{c.name}")).alias(c.name)
        for c in table.columns
    ]


def _unreadable(table: Table) -> dict[str, Column]:
    """Per raw column that can fail to parse: whether its text did."""
    return {
        c.name: F.col(f"_read_{c.name}").isNull() & ~is_blank(F.col(c.name))
        for c in table.columns
        if c.name in table.raw_columns and (c.type != TEXT or c.name == "horariomov")
    }


def _faults(table: Table) -> Column:
    return F.concat_ws(",", F.lit(None), *[F.when(bad, F.lit(f"ilegivel:{c}")) for c, bad in _unreadable(table).items()])


def typed_rows(name: str, raw: DataFrame) -> DataFrame:
    """Raw rows with a key, cast to the typed columns, plus the ``_faults`` text."""
    table = TABLES[name]
    read = _read(name, raw.where(~is_blank(F.col(table.row_key))))
    return read.select(*_typed(table), _faults(table).alias(FAULTS))


def load(name: str, raw: DataFrame) -> DataFrame:
    """The typed table without the fault column: rows with unreadable values left out.

    :func:`quarantine` has what is left out.
    """
    table = TABLES[name]
    read = _read(name, raw.where(~is_blank(F.col(table.row_key))))
    for bad in _unreadable(table).values():
        read = read.where(~bad)
    return read.select(*_typed(table))


BLANK_KEY = "chave em branco"


def quarantine(raw: RetailTables) -> DataFrame:
    """Raw rows that no load takes in, as text, with the reasons; all tables.

    ``linha`` has the raw values in column order, a missing one as nothing.
    """
    found = None
    for name, table in TABLES.items():
        reason = F.when(is_blank(F.col(table.row_key)), F.lit(BLANK_KEY)).otherwise(_faults(table))
        values = [F.coalesce(c, F.lit("")) for c in table.raw_columns]
        rows = _read(name, raw[name]).select(F.lit(name).alias("tabela"), F.concat_ws("|", *values).alias("linha"), reason.alias("motivo"))
        rows = rows.where("motivo <> ''")
        found = rows if found is None else found.unionByName(rows)
    return found


def load_all(raw: RetailTables) -> RetailTables:
    return RetailTables(**{name: partial(_load_from, name, raw) for name in TABLES})


def _load_from(name: str, raw: RetailTables) -> DataFrame:
    return load(name, raw[name])


def unreadable(name: str, raw: DataFrame) -> DataFrame:
    """Rows a load could not read, with the names of the columns at fault."""
    return typed_rows(name, raw).where(F.col(FAULTS) != "")


def supplier_code_issues(raw: DataFrame) -> DataFrame:
    """Codes without digits, and codes whose digits give a number another code has too."""
    rows = typed_rows("supplier", raw).select("idfornecedor", "fornecedor_num")
    mute = rows.where("fornecedor_num IS NULL").select(
        "idfornecedor", "fornecedor_num", F.lit("SEM NUMERO").alias("problema")
    )
    clashing = (
        rows.where("fornecedor_num IS NOT NULL")
        .groupBy("fornecedor_num")
        .agg(F.min("idfornecedor").alias("_first"), F.max("idfornecedor").alias("_last"))
        .where("_first <> _last")
        .select("fornecedor_num")
    )
    clash = lookup_join(
        rows.where("fornecedor_num IS NOT NULL"), clashing, ["fornecedor_num"], "left_semi"
    ).select("idfornecedor", "fornecedor_num", F.lit("NUMERO REPETIDO").alias("problema"))
    return mute.unionByName(clash)


class LoadCounts:
    """What one load sees of a table, observed on its way: no pass of its own.

    ``values`` runs nothing; it is there once the rows have been written.
    """

    def __init__(self, name: str):
        self.table = TABLES[name]
        self._arriving, self._typed = Observation(f"arriving-{name}"), Observation(f"typed-{name}")

    def arriving(self, raw: DataFrame) -> DataFrame:
        blank = F.count_if(is_blank(F.col(self.table.row_key)))
        return raw.observe(self._arriving, F.count(F.lit(1)).alias("lidas"), blank.alias("puladas"))

    def typed(self, rows: DataFrame) -> DataFrame:
        """``rows`` have the fault text as :func:`typed_rows` gives it."""
        readable = F.col(FAULTS) == ""
        nulls = [F.count_if(readable & F.col(c).isNull()).alias(f"nulos_{c}") for c in self.table.required]
        return rows.observe(self._typed, F.count_if(readable).alias("final"), F.count_if(~readable).alias("ilegiveis"), *nulls)

    @property
    def values(self) -> dict[str, int]:
        return {**self._arriving.get, **self._typed.get}


def load_report(spark: SparkSession, counts: dict[str, LoadCounts]) -> DataFrame:
    """The figures of a finished run: per table rows read, skipped, unreadable and typed, and NULLs per required column."""
    rows = []
    for name, seen in counts.items():
        values = seen.values
        rows += [(name, measure, values[measure]) for measure in ("lidas", "puladas", "ilegiveis", "final")]
        rows += [(name, f"nulos:{c}", values[f"nulos_{c}"]) for c in TABLES[name].required]
    return spark.createDataFrame(rows, "tabela string, medida string, valor long")


@dataclass(frozen=True)
class Judged:
    """One load, split in two: the parts add up to the typed rows."""

    rows: DataFrame  # typed columns, ``_faults``, ``aceito``
    stored: str  # the folder of the cast rows, which the others are read from

    @property
    def accepted(self) -> DataFrame:
        return self.rows.where("aceito").drop(FAULTS, "aceito")

    @property
    def quarantined(self) -> DataFrame:
        return self.rows.where("NOT aceito").drop("aceito")


def judge(name: str, rows: DataFrame) -> Judged:
    """Add the integrity faults of a table to its typed rows and mark the clean ones.

    Faults: a required column without value, a broken check, text wider than
    its column, and a key or unique column held by more than one row (every
    such row is set aside, since none can be preferred over the others).
    """
    table = TABLES[name]
    if FAULTS not in rows.columns:
        rows = rows.withColumn(FAULTS, F.lit(""))
    found = [*null_faults(table), *check_faults(table), *width_faults(table)]
    rows = rows.withColumn(FAULTS, F.concat_ws(",", F.nullif(FAULTS, F.lit("")), *found))
    # Keys are counted and looked up below: the casts run once, not for each.
    rows, stored = pinned_at(rows, f"judged-{name}")
    clean = F.col(FAULTS) == ""
    for label, keys in (("chave", table.key), *((f"unico:{u}", (u,)) for u in table.unique)):
        # A row set aside already cannot make its key ambiguous.
        repeated = duplicate_keys(rows.where(clean), keys).drop("ocorrencias").withColumn("_repeated", F.lit(True))
        # As a rule few keys repeat: written, their size is known, and all rows need not be shuffled to meet them.
        rows = rows.join(pinned(repeated, f"repeated-{name}"), list(keys), "left")
        fault = F.when(F.col("_repeated") & clean, F.lit(f"repetido:{label}"))
        rows = rows.withColumn(FAULTS, F.coalesce(fault, FAULTS)).drop("_repeated")
    order = [c.name for c in table.columns]
    return Judged(rows.select(*order, FAULTS, clean.alias("aceito")), stored)
