"""The five typed tables, declared once.

Column names, types, keys and bounds are fixed values: they are the data
contract of the CSV files and the typed layer.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

QTY = T.DecimalType(14, 3)
PRICE = T.DecimalType(12, 4)
LONG = T.LongType()
INT = T.IntegerType()
TEXT = T.StringType()
DATE = T.DateType()


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    required: bool = False
    default: str | None = None  # SQL literal used when a batch omits the column
    length: int | None = None


@dataclass(frozen=True)
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    prospective: bool = False  # history exempt, every new row checked
    cascades: bool = False  # follows a renamed parent, and is cleared when the parent goes


@dataclass(frozen=True)
class Table:
    name: str
    file: str  # base name of the CSV file and of the spreadsheet tab
    raw_columns: tuple[str, ...]  # file order
    columns: tuple[Column, ...]
    key: tuple[str, ...]
    row_key: str  # a row whose raw value here is blank is skipped by the load
    checks: dict[str, str] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    #: Columns of the stored table that say when a row was stored; no comparison reads them.
    stamps: dict[str, str] = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return [c.name for c in self.columns if c.required]

    @property
    def typed_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type) for c in self.columns])

    @property
    def raw_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, TEXT) for c in self.raw_columns])


# ---- fixed values: names, types, keys, defaults and bounds of the tables ----

SUPPLIER = Table(
    name="supplier",
    file="fornecedor",
    raw_columns=("idfornecedor", "razao_social"),
    columns=(
        Column("idfornecedor", TEXT, required=True, length=25),
        Column("fornecedor_num", INT, required=True),
        Column("razao_social", TEXT, required=True, length=255),
    ),
    key=("idfornecedor",),
    row_key="idfornecedor",
    unique=("fornecedor_num",),
    checks={"razao_social_preenchida": "length(trim(razao_social)) > 0"},
    stamps={"criado_em": "now()"},
)

BRANCH_PRODUCT = Table(
    name="branch_product",
    file="produtos_filial",
    raw_columns=(
        "filial_id", "idproduto", "descricao", "estoque",
        "preco_unitario", "preco_compra", "preco_venda", "idfornecedor",
    ),
    columns=(
        Column("filial_id", INT, required=True),
        Column("idproduto", TEXT, required=True, length=25),
        Column("descricao", TEXT, required=True, length=255),
        Column("estoque", QTY, required=True, default="0"),
        Column("preco_unitario", PRICE, required=True, default="0"),
        Column("preco_compra", PRICE, required=True, default="0"),
        Column("preco_venda", PRICE, required=True, default="0"),
        Column("idfornecedor", TEXT, length=25),
        Column("idfornecedor_num", INT),
    ),
    key=("filial_id", "idproduto"),
    row_key="idproduto",
    checks={
        "estoque_nao_negativo": "estoque >= 0",
        "preco_compra_nao_negativo": "preco_compra >= 0",
        "preco_venda_nao_negativo": "preco_venda >= 0",
        "preco_unitario_nao_negativo": "preco_unitario >= 0",
    },
    foreign_keys=(
        ForeignKey("produto_fornecedor_texto", ("idfornecedor",), "supplier", ("idfornecedor",), cascades=True),
        ForeignKey("produto_fornecedor_numero", ("idfornecedor_num",), "supplier", ("fornecedor_num",), cascades=True),
    ),
)

PURCHASE_ORDER = Table(
    name="purchase_order",
    file="pedido_compra",
    raw_columns=(
        "pedido_id", "data_pedido", "item", "produto_id", "descricao_produto",
        "ordem_compra", "qtde_pedida", "filial_id", "data_entrega",
        "qtde_entregue", "preco_compra", "fornecedor_id",
    ),
    columns=(
        Column("pedido_id", LONG, required=True),
        Column("item", INT, required=True, default="1"),
        Column("ordem_compra", LONG, required=True, default="0"),
        Column("data_pedido", DATE),
        Column("produto_id", TEXT, required=True, length=25),
        Column("descricao_produto", TEXT, length=255),
        Column("qtde_pedida", QTY),
        Column("filial_id", INT),
        Column("data_entrega", DATE),
        Column("qtde_entregue", QTY, required=True, default="0"),
        Column("qtde_pendente", QTY, required=True, default="0"),
        Column("preco_compra", PRICE, default="0"),
        Column("fornecedor_id", INT),
    ),
    key=("pedido_id", "produto_id", "item"),
    row_key="pedido_id",
    checks={
        "qtde_pedida_nao_negativa": "qtde_pedida >= 0",
        "qtde_entregue_nao_negativa": "qtde_entregue >= 0",
        "preco_compra_nao_negativo": "preco_compra >= 0",
    },
    foreign_keys=(
        ForeignKey("pedido_fornecedor_numero", ("fornecedor_id",), "supplier", ("fornecedor_num",), cascades=True),
    ),
)

GOODS_RECEIPT = Table(
    name="goods_receipt",
    file="entradas_mercadoria",
    raw_columns=(
        "data_entrada", "nro_nfe", "item", "produto_id", "descricao_produto",
        "ordem_compra", "qtde_recebida", "filial_id", "custo_unitario",
    ),
    columns=(
        Column("ordem_compra", LONG, required=True),
        Column("nro_nfe", TEXT, required=True, length=255),
        Column("item", INT, required=True, default="1"),
        Column("produto_id", TEXT, required=True, length=25),
        Column("descricao_produto", TEXT, length=255),
        Column("data_entrada", DATE),
        Column("qtde_recebida", QTY),
        Column("filial_id", INT),
        Column("custo_unitario", PRICE, required=True, default="0"),
    ),
    key=("ordem_compra", "item", "produto_id", "nro_nfe"),
    row_key="nro_nfe",
    checks={
        "qtde_recebida_nao_negativa": "qtde_recebida >= 0",
        "custo_unitario_nao_negativo": "custo_unitario >= 0",
    },
)

SALES = Table(
    name="sales",
    file="venda",
    raw_columns=(
        "venda_id", "data_emissao", "horariomov", "produto_id", "qtde_vendida",
        "valor_unitario", "filial_id", "item", "unidade_medida",
    ),
    columns=(
        Column("venda_id", LONG, required=True),
        Column("data_emissao", DATE, required=True),
        Column("horariomov", TEXT, required=True, default="'00:00:00'"),
        Column("produto_id", TEXT, required=True, length=25),
        Column("qtde_vendida", QTY, required=True),
        Column("valor_unitario", PRICE, required=True, default="0"),
        Column("filial_id", INT, required=True, default="1"),
        Column("item", INT, required=True, default="1"),
        Column("unidade_medida", TEXT, length=3),
    ),
    key=("filial_id", "venda_id", "data_emissao", "produto_id", "item", "horariomov"),
    row_key="venda_id",
    checks={
        "qtde_vendida_nao_negativa": "qtde_vendida >= 0",
        "valor_unitario_nao_negativo": "valor_unitario >= 0",
    },
    foreign_keys=(
        ForeignKey(
            "venda_produto", ("filial_id", "produto_id"),
            "branch_product", ("filial_id", "idproduto"), prospective=True,
        ),
    ),
)

# Parents before children: the order in which a full load runs.
TABLES: dict[str, Table] = {
    t.name: t for t in (SUPPLIER, BRANCH_PRODUCT, PURCHASE_ORDER, GOODS_RECEIPT, SALES)
}
