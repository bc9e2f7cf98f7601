"""Typed tables on disk: full refresh, history and the onboarding run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.model.schema import TABLES
from ledgerloom.model.tables import RetailTables
from ledgerloom.operators.frequent import KeySketches
from ledgerloom.operators.numbering import NumberMark, next_number
from ledgerloom.operators.resolve import backfill
from ledgerloom.plans.load import LoadCounts, judge, typed_rows
from ledgerloom.session import drop_scratch, pinned, shuffles_dropped, tasks_for

# Facts are read by period: the date each is clustered on.
_DATE_OF = {"sales": "data_emissao", "purchase_order": "data_pedido", "goods_receipt": "data_entrada"}

# Keys that lookup joins over all rows of a fact go by; sketched from the stored key columns.
_LOOKED_UP_BY = {"sales": [("filial_id", "produto_id")], "purchase_order": [("ordem_compra",)]}


def write_table(name: str, df: DataFrame, warehouse: str, partitions: int | None = None, stored: bool = False) -> str:
    """Replace a typed table as a whole.

    ``stored`` says that ``df`` does no more than read files, so that it may be read twice.

    ``partitions`` is the number of ranges of a fact, by default that of the
    session's shuffles or, if more, what its files ask for; choose it so that a
    range holds what a task can sort.

    Facts are range-partitioned by date, with the key behind it so that one
    busy day is spread out, and sorted inside each file: row groups carry
    narrow date ranges and a date filter skips the others.
    """
    path = f"{warehouse.rstrip('/')}/{name}"
    df = df.withColumns({c: F.expr(e) for c, e in TABLES[name].stamps.items() if c not in df.columns})
    if name in _DATE_OF:
        date = _DATE_OF[name]
        ranges = [date, *[k for k in TABLES[name].key if k != date]]
        # The ranges are found from a sample, which would compute the rows once more.
        rows = df if stored else pinned(df, f"to-store-{name}")
        partitions = partitions or tasks_for(rows)
        df = rows.repartitionByRange(*([partitions] if partitions else []), *ranges).sortWithinPartitions(date)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if name in _LOOKED_UP_BY:
        spark = df.sparkSession
        stored = spark.read.schema(df.schema).parquet(path)
        for keys in _LOOKED_UP_BY[name]:
            KeySketches(spark, warehouse).store(name, stored, keys)
    return path


@dataclass(frozen=True)
class Onboarded:
    tables: RetailTables
    quarantine: dict[str, DataFrame]
    counts: dict[str, LoadCounts]  # what the run saw on its way, without a pass of its own


def onboard(spark: SparkSession, raw: RetailTables, warehouse: str, partitions: int | None = None) -> Onboarded:
    """Raw tables to typed tables: cast, judge, link suppliers, write.

    Cast rows are written once, by the judgement that reads them twice; from
    there accepted rows go to the typed table and the others to quarantine, and
    they are removed. One table follows the other, and no step leaves shuffles.
    Suppliers that the catalogue names and the
    supplier file lacks are registered, as the resolver does for new products; a
    full load begins their numbers anew. Counts are observed while cast rows are
    written: the only scan of a raw table.
    """
    warehouse = warehouse.rstrip("/")
    linked = ("branch_product", "supplier")  # written together, once both are judged
    judged, quarantine = {}, {}
    counts = {name: LoadCounts(name) for name in TABLES}

    def store(rows: dict[str, DataFrame]) -> None:
        for name, accepted in rows.items():
            write_table(name, accepted, f"{warehouse}/typed", partitions, stored=True)
        for name in rows:
            drop_scratch(spark, judged[name].stored)

    with shuffles_dropped(spark):
        for name in TABLES:
            split = judged[name] = judge(name, counts[name].typed(typed_rows(name, counts[name].arriving(raw[name]))))
            path = f"{warehouse}/quarantine/{name}"
            split.quarantined.write.mode("overwrite").parquet(path)
            quarantine[name] = spark.read.schema(split.quarantined.schema).parquet(path)
            if name not in linked:
                store({name: split.accepted})
        products, registered = backfill(judged["branch_product"].accepted, judged["supplier"].accepted)
        store({"branch_product": products, "supplier": judged["supplier"].accepted.unionByName(registered)})
        tables = RetailTables.read(spark, f"{warehouse}/typed")
        NumberMark(spark, warehouse).restart(next_number(tables.supplier, "fornecedor_num") - 1)
    return Onboarded(tables, quarantine, counts)
