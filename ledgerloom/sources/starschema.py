"""Retail tables derived from a TPC-H-like star schema.

The expressions below are plain SQL that reads the same in Spark and DuckDB,
so that a check query can start from identical input. Money arrives as double:
each amount is turned into whole cents once and stays exact from there on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.model.schema import TABLES
from ledgerloom.model.tables import RetailTables
from ledgerloom.operators.skew import lookup_join
from ledgerloom.session import pinned, shuffles_dropped, spread, tasks_for

_UNITS = "CAST(round(l_quantity) AS BIGINT)"
_RETAIL = "CAST(p_retailprice AS DECIMAL(10,2))"
_COST = f"{_RETAIL} * CAST(7 + p_partkey % 5 AS DECIMAL(4,0)) * 0.1"
# Extended price / quantity in 1/10000, rounded half up with whole numbers.
_PRICE_POINTS = f"(CAST(round(l_extendedprice * 100) AS BIGINT) * 200 + {_UNITS})"
_UNIT_PRICE = (
    f"CAST(CAST(({_PRICE_POINTS} - {_PRICE_POINTS} % (2 * {_UNITS})) / (2 * {_UNITS}) AS BIGINT)"
    " AS DECIMAL(12,0)) * 0.0001"
)
# Quantity reduced by the discount, rounded down with whole numbers.
_KEPT = f"({_UNITS} * (100 - CAST(round(l_discount * 100) AS BIGINT)))"
_DELIVERED = f"CAST(({_KEPT} - {_KEPT} % 100) / 100 AS BIGINT)"
_BRANCH = "CAST(1 + l_suppkey % 3 AS INT)"
_PRODUCT = "'P' || CAST(l_partkey AS STRING)"
# Faults arise from other keys, not from missing rows: parts above size 45 are
# catalogued under another code, returned lines are received for another order.
_LISTED = "CASE WHEN p_size > 45 THEN 'X' ELSE 'P' END || CAST(p_partkey AS STRING)"
_RECEIVED_FOR = "CASE WHEN l_returnflag = 'R' THEN l_orderkey + 900000000 ELSE l_orderkey END"
_DESCRIPTION = "CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || ' ' || p_brand END"

SALES = {
    "venda_id": "l_orderkey",
    "data_emissao": "CAST(o_orderdate AS DATE)",
    "horariomov": "CASE WHEN extract(day FROM l_shipdate) % 2 = 0 THEN '08:00:00' ELSE '14:30:00' END",
    "produto_id": _PRODUCT,
    "qtde_vendida": (
        "CAST(CASE WHEN l_linenumber = 7 THEN CAST(l_quantity AS DECIMAL(10,2)) * 0.9"
        " ELSE CAST(l_quantity AS DECIMAL(10,2)) END AS DECIMAL(14,3))"
    ),
    "valor_unitario": (
        f"CAST(CASE WHEN l_linenumber <= 4 THEN {_RETAIL} ELSE {_UNIT_PRICE} END AS DECIMAL(12,4))"
    ),
    "filial_id": _BRANCH,
    "item": "l_linenumber",
    "unidade_medida": "'UN'",
}

PURCHASE_ORDER = {
    "pedido_id": "l_orderkey",
    "item": "l_linenumber",
    "ordem_compra": "CASE WHEN l_orderkey % 10 = 0 THEN CAST(0 AS BIGINT) ELSE l_orderkey END",
    "data_pedido": "CAST(o_orderdate AS DATE)",
    "produto_id": _PRODUCT,
    "descricao_produto": _DESCRIPTION,
    "qtde_pedida": "CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_quantity AS DECIMAL(14,3)) END",
    "filial_id": _BRANCH,
    "data_entrega": "CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END",
    "qtde_entregue": f"CAST({_DELIVERED} AS DECIMAL(14,3))",
    "qtde_pendente": (
        "CAST(greatest(CASE WHEN l_tax = 0 THEN 0 ELSE"
        f" {_UNITS} END - {_DELIVERED}, 0) AS DECIMAL(14,3))"
    ),
    "preco_compra": f"CAST({_COST} AS DECIMAL(12,4))",
    "fornecedor_id": "CAST(l_suppkey + 1 AS INT)",
}

GOODS_RECEIPT = {
    "ordem_compra": _RECEIVED_FOR,
    "nro_nfe": "'NFE' || CAST(l_orderkey AS STRING)",
    "item": "l_linenumber",
    "produto_id": _PRODUCT,
    "descricao_produto": "CAST(NULL AS STRING)",
    "data_entrada": "CAST(l_shipdate AS DATE)",
    "qtde_recebida": f"CAST(greatest({_UNITS} + l_linenumber - 3, 0) AS DECIMAL(14,3))",
    "filial_id": _BRANCH,
    "custo_unitario": f"CAST({_UNIT_PRICE} AS DECIMAL(12,4))",
}

BRANCH_PRODUCT = {
    "filial_id": "filial_id",
    "idproduto": _LISTED,
    "descricao": _DESCRIPTION,
    "estoque": "CAST(p_size AS DECIMAL(14,3))",
    "preco_unitario": f"CAST({_RETAIL} AS DECIMAL(12,4))",
    "preco_compra": f"CAST({_COST} AS DECIMAL(12,4))",
    "preco_venda": f"CAST({_RETAIL} AS DECIMAL(12,4))",
    "idfornecedor": "'F' || CAST(p_partkey % 9 AS STRING)",
    "idfornecedor_num": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey % 9 AS INT) END",
}

SUPPLIER = {
    "idfornecedor": "'F' || CAST(s_suppkey AS STRING)",
    "fornecedor_num": "CAST(s_suppkey AS INT)",
    "razao_social": "s_name",
}

# What the tables read of an order line, its order and its part.
_LINE_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_shipdate", "o_orderdate", "p_partkey", "p_name", "p_brand", "p_retailprice",
]

# Raw text with the faults a load has to cope with: blank keys, padded codes,
# ids written as decimals, bad dates and times, words where a number belongs.
_DAY = "CAST(CAST({} AS DATE) AS STRING)"
RAW_SALES = {
    "venda_id": (
        "CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN '  '"
        " WHEN l_linenumber = 6 THEN CAST(l_orderkey AS STRING) || '.0'"
        " ELSE CAST(l_orderkey AS STRING) END"
    ),
    "data_emissao": f"CASE WHEN l_orderkey % 211 = 3 THEN '1997-02-31' ELSE {_DAY.format('o_orderdate')} END",
    "horariomov": (
        "CASE WHEN l_linenumber = 3 THEN '' WHEN l_orderkey % 131 = 5 THEN '99:99:99'"
        " WHEN extract(day FROM l_shipdate) % 2 = 0 THEN '08:00:00' ELSE '14:30:00' END"
    ),
    "produto_id": f"CASE WHEN l_linenumber = 2 THEN ' ' || {_PRODUCT} || ' ' ELSE {_PRODUCT} END",
    "qtde_vendida": (
        "CASE WHEN l_orderkey % 307 = 7 THEN 'doze' WHEN l_orderkey % 401 = 9 THEN NULL"
        f" WHEN l_orderkey % 503 = 11 THEN '-' || CAST({SALES['qtde_vendida']} AS STRING)"
        f" ELSE CAST({SALES['qtde_vendida']} AS STRING) END"
    ),
    "valor_unitario": f"CAST({SALES['valor_unitario']} AS STRING)",
    "filial_id": f"CAST({_BRANCH} AS STRING) || CASE WHEN l_linenumber = 5 THEN '.0' ELSE '' END",
    "item": "CAST(l_linenumber AS STRING)",
    "unidade_medida": "CASE WHEN l_orderkey % 601 = 13 THEN 'CAIXA' WHEN l_linenumber = 4 THEN ' ' ELSE 'UN' END",
}

RAW_PURCHASE_ORDER = {
    "pedido_id": (
        "CASE WHEN l_orderkey % 89 = 0 AND l_linenumber = 2 THEN '' ELSE CAST(l_orderkey AS STRING) END"
    ),
    "data_pedido": f"CASE WHEN l_orderkey % 151 = 4 THEN ' ' ELSE {_DAY.format('o_orderdate')} END",
    "item": "CAST(l_linenumber AS STRING) || '.0'",
    "produto_id": _PRODUCT,
    "descricao_produto": _DESCRIPTION,
    "ordem_compra": (
        "CASE WHEN l_orderkey % 20 = 0 THEN NULL WHEN l_orderkey % 10 = 0 THEN '0'"
        " ELSE CAST(l_orderkey AS STRING) END"
    ),
    "qtde_pedida": f"CASE WHEN l_tax = 0 THEN NULL ELSE CAST({_UNITS} AS STRING) END",
    "filial_id": f"CAST({_BRANCH} AS STRING)",
    "data_entrega": f"CASE WHEN l_discount = 0 THEN '' ELSE {_DAY.format('l_shipdate')} END",
    "qtde_entregue": f"CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST({_DELIVERED} AS STRING) END",
    "preco_compra": f"CAST({PURCHASE_ORDER['preco_compra']} AS STRING)",
    "fornecedor_id": (
        "CASE WHEN l_orderkey % 173 = 6 THEN 'F' ELSE '' END || CAST(l_suppkey + 1 AS STRING)"
    ),
}

RAW_GOODS_RECEIPT = {
    "data_entrada": f"CASE WHEN l_linenumber = 7 THEN ' ' ELSE {_DAY.format('l_shipdate')} END",
    "nro_nfe": (
        "CASE WHEN l_orderkey % 83 = 1 AND l_linenumber = 3 THEN '   '"
        " ELSE ' NFE' || CAST(l_orderkey AS STRING) END"
    ),
    "item": "CAST(l_linenumber AS STRING)",
    "produto_id": _PRODUCT,
    "descricao_produto": "CASE WHEN l_linenumber = 1 THEN ' ' ELSE 'item ' || CAST(l_linenumber AS STRING) END",
    "ordem_compra": f"CAST({_RECEIVED_FOR} AS STRING) || '.5'",
    "qtde_recebida": f"CAST({GOODS_RECEIPT['qtde_recebida']} AS STRING)",
    "filial_id": f"CAST({_BRANCH} AS STRING)",
    "custo_unitario": (
        "CASE WHEN l_orderkey % 701 = 5 THEN '123456789012.00'"
        f" ELSE CAST({GOODS_RECEIPT['custo_unitario']} AS STRING) END"
    ),
}

RAW_BRANCH_PRODUCT = {
    "filial_id": "CAST(filial_id AS STRING)",
    "idproduto": f"CASE WHEN p_partkey % 67 = 0 THEN ' ' ELSE ' ' || {_LISTED} END",
    "descricao": f"' ' || {_DESCRIPTION}",
    "estoque": "CASE WHEN p_partkey % 59 = 2 THEN '-5' ELSE CAST(p_size AS STRING) END",
    "preco_unitario": f"CAST({BRANCH_PRODUCT['preco_unitario']} AS STRING)",
    "preco_compra": f"CAST({BRANCH_PRODUCT['preco_compra']} AS STRING)",
    "preco_venda": f"CAST({BRANCH_PRODUCT['preco_venda']} AS STRING)",
    "idfornecedor": "CASE WHEN p_partkey % 13 = 0 THEN '  ' ELSE 'F' || CAST(p_partkey % 9 AS STRING) || ' ' END",
}

RAW_SUPPLIER = {
    "idfornecedor": (
        "CASE WHEN s_suppkey % 17 = 3 THEN ' ' WHEN s_suppkey % 19 = 5 THEN 'SEM NUMERO ' || s_name"
        " WHEN s_suppkey % 23 = 7 THEN 'G' || CAST(s_suppkey - 1 AS STRING)"
        " ELSE ' F' || CAST(s_suppkey AS STRING) END"
    ),
    "razao_social": "CASE WHEN s_suppkey % 29 = 9 THEN '   ' ELSE s_name || ' ' END",
}

# Change events on products: op, old and new supplier columns.
_KNOWN = "'F' || CAST(p_partkey % 9 AS STRING)"
_NEXT = "CAST((p_partkey + 1) % 9 AS STRING)"
CHANGES = {
    "seq": "p_partkey * 2 + turn",
    "op": "CASE WHEN p_partkey % 5 <= 1 AND turn = 0 THEN 'INSERT' ELSE 'UPDATE' END",
    "filial_id": "CAST(1 + p_partkey % 2 AS INT)",
    "idproduto": "'P' || CAST(p_partkey AS STRING)",
    "old_idfornecedor": f"CASE WHEN p_partkey % 5 <= 1 AND turn = 0 THEN NULL ELSE {_KNOWN} END",
    "old_idfornecedor_num": (
        "CASE WHEN p_partkey % 5 <= 1 AND turn = 0 THEN NULL ELSE CAST(p_partkey % 9 AS INT) END"
    ),
    "new_idfornecedor": (
        "CASE WHEN turn = 1 THEN 'F' || CAST(910000 + p_partkey % 15 AS STRING)"
        " WHEN p_partkey % 55 = 0 THEN '  '"
        f" WHEN p_partkey % 35 = 0 THEN ' ' || {_KNOWN} || ' '"
        f" WHEN p_partkey % 5 = 0 THEN {_KNOWN}"
        " WHEN p_partkey % 5 = 1 THEN 'F' || CAST(900000 + p_partkey % 20 AS STRING)"
        f" WHEN p_partkey % 5 = 2 THEN 'F' || {_NEXT}"
        f" WHEN p_partkey % 20 = 3 THEN NULL ELSE {_KNOWN} END"
    ),
    "new_idfornecedor_num": (
        "CASE WHEN p_partkey % 5 <= 1 AND turn = 0 AND p_partkey % 10 <> 5 THEN NULL"
        " WHEN p_partkey % 10 = 5 AND turn = 0 THEN CAST((p_partkey + 4) % 9 AS INT)"
        # Some of these numbers exist, some are handed out on the way, most never are.
        " WHEN p_partkey % 10 = 9 THEN CAST(p_partkey + 2 AS INT)"
        " WHEN p_partkey % 5 = 4 THEN CAST(p_partkey + 1 AS INT)"
        " WHEN p_partkey % 5 = 3 AND p_partkey % 7 = 0 THEN NULL"
        f" WHEN p_partkey % 5 = 3 OR p_partkey % 15 = 2 THEN CAST({_NEXT} AS INT)"
        " ELSE CAST(p_partkey % 9 AS INT) END"
    ),
}


# The order tab as a spreadsheet export: 12 named columns, then 11 without
# heading that hold displaced rows. Order dates all end in midnight; delivery
# dates do so except for the empty texts, which keep the column as it is.
_DISPLACED = "l_linenumber = 7"
ORDER_SHEET = {
    **RAW_PURCHASE_ORDER,
    "data_pedido": f"{_DAY.format('o_orderdate')} || ' 00:00:00'",
    "data_entrega": (
        f"CASE WHEN l_discount = 0 THEN '' ELSE {_DAY.format('l_shipdate')} || ' 00:00:00' END"
    ),
}
OVERFLOW = {
    "Unnamed: 12": f"{_DAY.format('o_orderdate')} || ' 00:00:00'",
    "Unnamed: 13": "CAST(l_linenumber AS STRING)",
    "Unnamed: 14": _PRODUCT,
    "Unnamed: 15": _DESCRIPTION,
    "Unnamed: 16": "CAST(CASE WHEN l_orderkey % 10 = 0 THEN p_partkey ELSE l_orderkey END AS STRING)",
    "Unnamed: 17": f"CAST({_UNITS} + CASE WHEN l_orderkey % 6 = 0 THEN 20 ELSE 0 END AS STRING)",
    "Unnamed: 18": f"CAST({_BRANCH} AS STRING)",
    "Unnamed: 19": f"{_DAY.format('l_shipdate')} || ' 00:00:00'",
    "Unnamed: 20": f"CAST({_DELIVERED} AS STRING)",
    "Unnamed: 21": f"CAST({_UNITS} - {_DELIVERED} AS STRING)",
    "Unnamed: 22": f"CAST({PURCHASE_ORDER['preco_compra']} AS STRING)",
}
for _name, _expr in OVERFLOW.items():
    ORDER_SHEET[f'"{_name}"'] = f"CASE WHEN {_DISPLACED} THEN {_expr} END"


def projection(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


_TYPED = {
    "supplier": SUPPLIER, "branch_product": BRANCH_PRODUCT, "purchase_order": PURCHASE_ORDER,
    "goods_receipt": GOODS_RECEIPT, "sales": SALES,
}
_RAW = {
    "supplier": RAW_SUPPLIER, "branch_product": RAW_BRANCH_PRODUCT, "purchase_order": RAW_PURCHASE_ORDER,
    "goods_receipt": RAW_GOODS_RECEIPT, "sales": RAW_SALES,
}


# Keys that an order line has by itself.
_LINE_KEYS = {
    "sales": {"venda_id", "produto_id", "filial_id", "item"},
    "purchase_order": {"pedido_id", "item", "ordem_compra", "produto_id", "filial_id", "fornecedor_id"},
}


class StarSchema:
    """The retail tables over one data folder, raw and typed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._opened[name]

    @cached_property
    def _lines(self) -> DataFrame:
        """Order lines with their order and part; both parents are unique per key."""
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
        parts = self.table("part").withColumn("l_partkey", F.col("p_partkey"))
        lines = self.table("lineitem")
        dated = lines.join(spread(orders, ["l_orderkey"], lines), "l_orderkey")
        tasks = tasks_for(lines)
        if tasks is None:
            return dated.join(parts, "l_partkey")
        # Cut finely, the join of a part with very many lines is no longer split by Spark itself.
        counts = lines.select("l_partkey", F.lit(1).alias("_rows"))
        return lookup_join(dated, parts, ["l_partkey"], "inner", counts, tasks=tasks)

    def with_stored_lines(self) -> StarSchema:
        """The same tables, for jobs of many passes: lines are joined and written once, and each pass reads that."""
        stored = StarSchema(self.spark, self.folder)
        with shuffles_dropped(self.spark):
            stored._lines = pinned(self._lines.select(*_LINE_COLUMNS), "lines")
        return stored

    @property
    def _catalogue_rows(self) -> DataFrame:
        """Parts, stocked by branches 1 and 2."""
        return self.table("part").withColumn("filial_id", F.explode(F.array(F.lit(1), F.lit(2))))

    def _source(self, name: str) -> DataFrame:
        if name == "supplier":
            return self.table("supplier")
        if name == "branch_product":
            return self._catalogue_rows
        return self.table("lineitem") if name == "goods_receipt" else self._lines

    @property
    def typed(self) -> RetailTables:
        """The typed tables, each opened when a query asks for it."""
        tables = RetailTables(**{name: partial(self._projected, name, _TYPED[name]) for name in TABLES})
        for name in _LINE_KEYS:
            tables = tables.with_counts(name, partial(self._line_counts, name))
        return tables.as_stored("supplier", "branch_product", "goods_receipt")

    def _line_counts(self, name: str, keys: Sequence[str]) -> DataFrame | None:
        """Keys of order lines as they are, before they meet orders and parts."""
        if not _LINE_KEYS[name].issuperset(keys):
            return None
        columns = {k: _TYPED[name][k] for k in keys} | {"_rows": "1"}
        return self.table("lineitem").selectExpr(*projection(columns))

    def _projected(self, name: str, columns: dict[str, str]) -> DataFrame:
        return self._source(name).selectExpr(*projection(columns))

    def raw_view(self, name: str) -> DataFrame:
        """Raw text of a table, computed on each read."""
        return self._projected(name, _RAW[name])

    @property
    def raw(self) -> RetailTables:
        return RetailTables(**{name: partial(self.raw_view, name) for name in TABLES})

    @property
    def order_sheet(self) -> DataFrame:
        return self._lines.selectExpr(
            *[f"{expr} AS {name}".replace('"', "`") for name, expr in ORDER_SHEET.items()]
        )

    def stream(self, name: str) -> DataFrame:
        """A table as a file stream: the rows already there arrive first."""
        return (
            self.spark.readStream.schema(self.table(name).schema)
            .option("pathGlobFilter", f"{name}.parquet")
            .parquet(self.folder)
        )

    @staticmethod
    def sale_lines(lines: DataFrame) -> DataFrame:
        """What a sale line says about itself, without its order's date."""
        columns = {c: SALES[c] for c in ("venda_id", "item", "filial_id", "produto_id", "horariomov")}
        return lines.selectExpr(*projection(columns))

    @property
    def changes(self) -> DataFrame:
        return self.changes_of(self.table("part"))

    @staticmethod
    def changes_of(parts: DataFrame) -> DataFrame:
        """One event per part, and a second one for every sixth part of the first kind."""
        rounds = F.when(F.expr("p_partkey % 30 = 0"), F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0))
        )
        return parts.withColumn("turn", F.explode(rounds)).selectExpr(*projection(CHANGES))
