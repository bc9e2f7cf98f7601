"""The quality rules as views, and the scoreboard over them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.period import Period
from ledgerloom.functions.text import day, to_cents
from ledgerloom.model import labels
from ledgerloom.model.tables import RetailTables
from ledgerloom.operators.skew import PART, lookup_join
from ledgerloom.plans.reports import QTY_SUM, amount
from ledgerloom.session import spread, tasks_for

_FRACTION = "unidade_medida = 'UN' AND qtde_vendida % 1 <> 0"
_ZEROED = "ordem_compra = 0"
_INVERTED = "data_entrega < data_pedido"
_BELOW_COST = "preco_venda < preco_compra"
_SALE_KEY = ["filial_id", "produto_id"]
_TWIN_KEY = ["produto_id", "data_pedido", "preco_compra"]
_EXCESS = "recebida > qtde_pedida"
#: What the scoreboard's counts of sales and of order lines are kept by.
SOLD_KEY = ["filial_id", "produto_id", "valor_unitario"]
_LINE = ["pedido_id", "produto_id"]
LINE_KEY = ["ordem_compra", "pedido_id", "produto_id", "qtde_pedida", "qtde_entregue"]


def _line_total() -> Column:
    return to_cents(amount()).cast("decimal(20,2)").alias("valor_total")


def _catalogue_keys(tables: RetailTables) -> DataFrame:
    return tables.branch_product.select("filial_id", F.col("idproduto").alias("produto_id"))


# ---- sales ------------------------------------------------------------------


def uncatalogued_sales(tables: RetailTables) -> DataFrame:
    counts = tables.key_counts("sales", _SALE_KEY)
    sales = tables.sales.select("venda_id", *_SALE_KEY, "data_emissao", "qtde_vendida", "valor_unitario")
    return lookup_join(sales, _catalogue_keys(tables).distinct(), _SALE_KEY, "left_anti", counts).select(
        "venda_id",
        "filial_id",
        "produto_id",
        day(F.col("data_emissao")).alias("data_emissao"),
        "qtde_vendida",
        "valor_unitario",
        _line_total(),
    )


def branches_without_catalogue(tables: RetailTables) -> DataFrame:
    per_branch = tables.sales.groupBy("filial_id").agg(
        F.count("*").alias("qtde_vendas"), to_cents(F.sum(amount())).alias("valor_total")
    )
    listed = tables.branch_product.select("filial_id").distinct()
    return per_branch.join(listed, ["filial_id"], "left_anti")


def fractional_quantities(tables: RetailTables) -> DataFrame:
    return tables.sales.where(_FRACTION).select(
        "venda_id",
        "produto_id",
        day(F.col("data_emissao")).alias("data_emissao"),
        "qtde_vendida",
        "unidade_medida",
        _line_total(),
    )


def diverging_sale_prices(tables: RetailTables) -> DataFrame:
    prices = tables.branch_product.select(
        "filial_id", F.col("idproduto").alias("produto_id"), "preco_venda", "preco_unitario"
    )
    sales = tables.sales.select("venda_id", *_SALE_KEY, "data_emissao", "valor_unitario")
    return (
        lookup_join(sales, prices, _SALE_KEY, "inner", tables.key_counts("sales", _SALE_KEY))
        .where("valor_unitario <> preco_venda")
        .select(
            "venda_id",
            "produto_id",
            day(F.col("data_emissao")).alias("data_emissao"),
            F.col("valor_unitario").alias("preco_praticado"),
            F.col("preco_venda").alias("preco_cadastro"),
            F.col("preco_unitario").alias("preco_unitario_cadastro"),
            F.round(F.col("valor_unitario") - F.col("preco_venda"), 2)
            .cast("decimal(14,2)")
            .alias("diferenca"),
        )
    )


def sales_by_month(tables: RetailTables, scope: date) -> DataFrame:
    """Sales per month; ``scope`` is the first day of the month under review."""
    month = F.trunc("data_emissao", "month")
    return (
        tables.sales.groupBy(month.alias("month"))
        .agg(
            F.count("*").alias("qtde_vendas"),
            F.sum("qtde_vendida").cast(QTY_SUM).alias("qtde_total"),
            to_cents(F.sum(amount())).alias("valor_total"),
        )
        .select(
            F.date_format("month", "MM/yyyy").alias("competencia"),
            "qtde_vendas",
            "qtde_total",
            "valor_total",
            F.when(F.col("month") == F.lit(scope), labels.IN_SCOPE)
            .otherwise(labels.OUT_OF_SCOPE)
            .alias("situacao"),
        )
        .orderBy("competencia")
    )


# ---- purchase orders --------------------------------------------------------


def zeroed_orders(tables: RetailTables) -> DataFrame:
    return tables.purchase_order.where(_ZEROED).select(
        "pedido_id",
        "produto_id",
        "item",
        day(F.col("data_pedido")).alias("data_pedido"),
        "qtde_pedida",
        "fornecedor_id",
    )


def _twins(tables: RetailTables) -> DataFrame:
    """Product, date and price shared by at least two different orders.

    Where the smallest and largest order id differ, every line of the group
    has a counterpart; no line has to be compared with another.
    """
    return twin_groups(tables).where("low <> high").drop("low", "high")


def twin_groups(tables: RetailTables) -> DataFrame:
    """All groups of equal product, date and price: order lines, smallest and largest order."""
    rows = _twin_candidates(tables).select(*_TWIN_KEY, "pedido_id")
    return (
        spread(rows, _TWIN_KEY, rows)
        .groupBy(*_TWIN_KEY)
        .agg(
            F.count("*").alias("ocorrencias"),
            F.min("pedido_id").alias("low"),
            F.max("pedido_id").alias("high"),
        )
    )


def _twin_candidates(tables: RetailTables) -> DataFrame:
    return tables.purchase_order.where(
        "produto_id IS NOT NULL AND data_pedido IS NOT NULL"
        " AND preco_compra IS NOT NULL AND pedido_id IS NOT NULL"
    )


def duplicate_orders(tables: RetailTables) -> DataFrame:
    twins = _twins(tables)
    # The groups know how many lines they have.
    counts = twins.select(*_TWIN_KEY, F.col("ocorrencias").alias("_rows"))
    return lookup_join(_twin_candidates(tables), twins, _TWIN_KEY, "inner", counts).select(
        "pedido_id",
        "produto_id",
        day(F.col("data_pedido")).alias("data_pedido"),
        "ordem_compra",
        "qtde_pedida",
        "qtde_entregue",
        "preco_compra",
        "ocorrencias",
    )


def inverted_dates(tables: RetailTables) -> DataFrame:
    return tables.purchase_order.where(_INVERTED).select(
        "pedido_id",
        "produto_id",
        day(F.col("data_pedido")).alias("data_pedido"),
        day(F.col("data_entrega")).alias("data_entrega"),
        F.date_diff("data_entrega", "data_pedido").alias("dias_diferenca"),
    )


# ---- orders against receipts ------------------------------------------------


def _received(tables: RetailTables, lines: DataFrame, match: list[str], grain: list[str]) -> DataFrame:
    """Order lines at ``grain`` with the quantity received for their order.

    Receipts are summed first. Lines that agree in ``grain`` each count the
    receipt once, as a join of lines and receipts would.
    """
    receipts = (
        tables.goods_receipt.groupBy(*match)
        .agg(F.sum("qtde_recebida").cast(QTY_SUM).alias("recebida"))
    )
    # Without the orders that have no link the counts are, if anything, too high.
    counts = tables.key_counts("purchase_order", match)
    lines = lines.where("ordem_compra <> 0").select(*grain)
    joined = lookup_join(lines, receipts, match, "inner", counts, together=grain)
    return joined.groupBy(*grain, PART).agg(F.sum("recebida").cast(QTY_SUM).alias("recebida")).drop(PART)


def _match(strict: bool) -> list[str]:
    return ["ordem_compra", "item", "produto_id"] if strict else ["ordem_compra"]


def received_above_ordered(tables: RetailTables, strict: bool = False) -> DataFrame:
    """Orders that received more than they asked for.

    Receipts match by order number alone. ``strict`` matches them by order,
    item and product instead.
    """
    grain = ["ordem_compra", "pedido_id", "produto_id", "qtde_pedida"] + (["item"] if strict else [])
    excess = F.col("recebida") - F.col("qtde_pedida")
    return (
        _received(tables, tables.purchase_order, _match(strict), grain)
        .where("recebida > qtde_pedida")
        .select(
            *grain,
            F.col("recebida").alias("qtde_recebida"),
            excess.cast(QTY_SUM).alias("excesso"),
        )
    )


def delivered_vs_receipt(tables: RetailTables, strict: bool = False) -> DataFrame:
    """Orders whose delivered quantity is not what the receipts add up to."""
    grain = ["ordem_compra", "pedido_id", "produto_id", "qtde_pedida", "qtde_entregue"]
    grain += ["item"] if strict else []
    gap = F.col("recebida") - F.col("qtde_entregue")
    return (
        _received(tables, tables.purchase_order, _match(strict), grain)
        .where("recebida <> qtde_entregue")
        .withColumns({"divergencia": gap.cast(QTY_SUM)})
        .withColumnsRenamed(
            {"qtde_entregue": "qtde_entregue_pedido", "recebida": "qtde_recebida_nf"}
        )
    )


# ---- catalogue --------------------------------------------------------------


def negative_margins(tables: RetailTables) -> DataFrame:
    margin = F.col("preco_venda") - F.col("preco_compra")
    share = F.lit(100) * margin / F.nullif("preco_compra", F.lit(0))
    return tables.branch_product.where(_BELOW_COST).select(
        "filial_id",
        "idproduto",
        "descricao",
        "preco_compra",
        "preco_venda",
        "preco_unitario",
        F.round(margin, 2).cast("decimal(14,2)").alias("margem_absoluta"),
        F.round(share, 2).cast("decimal(20,2)").alias("margem_percentual"),
    )


def idle_suppliers(tables: RetailTables) -> DataFrame:
    used = tables.branch_product.select("idfornecedor").distinct()
    return tables.supplier.join(used, ["idfornecedor"], "left_anti").select(
        "idfornecedor", "fornecedor_num", "razao_social"
    )


RULES: dict[str, Callable[[RetailTables], DataFrame]] = {
    "QA-01": uncatalogued_sales,
    "QA-02": branches_without_catalogue,
    "QA-03": fractional_quantities,
    "QA-04": zeroed_orders,
    "QA-05": duplicate_orders,
    "QA-06": inverted_dates,
    "QA-07": received_above_ordered,
    "QA-08": delivered_vs_receipt,
    "QA-09": negative_margins,
    "QA-10": diverging_sale_prices,
    "QA-11": idle_suppliers,
}


# ---- scoreboard -------------------------------------------------------------


def dimension_lines(tables: RetailTables) -> DataFrame:
    """QA-09 and QA-11, which read the catalogue and the suppliers alone."""
    margins = _counted(tables.branch_product, {"QA-09": F.count_if(F.expr(_BELOW_COST))})
    return margins.unionByName(_counted(idle_suppliers(tables), {"QA-11": F.count("*")}))


def _line(code: str, count: Column) -> Column:
    title, severity = labels.SCOREBOARD[code]
    return F.struct(
        F.lit(code).alias("cod"),
        F.lit(title).alias("verificacao"),
        F.lit(severity).alias("severidade"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("ocorrencias"),
    )


def _counted(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """One line per rule from a single aggregate, zero counts included."""
    lines = F.array(*[_line(code, count) for code, count in counts.items()])
    return df.agg(lines.alias("lines")).select(F.inline("lines"))


def _sales_lines(tables: RetailTables) -> DataFrame:
    """QA-01, -02, -03 and -10 from one pass over the sales, counted per key before any join."""
    branches = tables.branch_product.select("filial_id", F.lit(True).alias("stocked")).distinct()
    prices = spread(catalogue_prices(tables), _SALE_KEY, tables.sales)
    priced = sales_per_branch(sold_per_key(tables.sales), prices).join(branches, "filial_id", "left")
    return _counted(
        priced,
        {
            "QA-01": F.sum("unlisted"),
            "QA-02": F.count_if(F.col("stocked").isNull()),
            "QA-03": F.sum("fractions"),
            "QA-10": F.sum("off_price"),
        },
    )


def sold_per_key(sales: DataFrame) -> DataFrame:
    """Sale lines per branch, product and price; counts of parts of the sales add up."""
    return sales.groupBy(*SOLD_KEY).agg(
        F.count("*").alias("n"),
        F.count_if(F.expr(_FRACTION)).alias("fractions"),
    )


def catalogue_prices(tables: RetailTables) -> DataFrame:
    return tables.branch_product.select("filial_id", F.col("idproduto").alias("produto_id"), "preco_venda")


def sales_per_branch(sold: DataFrame, prices: DataFrame) -> DataFrame:
    """Per branch its lines without a catalogue entry, with a fraction, and off the catalogue's price."""
    prices = prices.select("*", F.lit(True).alias("listed"))
    # Two steps: a catalogue key that repeats must not count a sale twice.
    return (
        sold.join(prices, _SALE_KEY, "left")
        .groupBy("filial_id", "produto_id", "valor_unitario")
        .agg(
            F.first("n").alias("n"),
            F.first("fractions").alias("fractions"),
            F.first("listed").alias("listed"),
            F.sum(F.when(F.expr("valor_unitario <> preco_venda"), F.col("n"))).alias("off_price"),
        )
        .groupBy("filial_id")
        .agg(
            F.sum(F.when(F.col("listed").isNull(), F.col("n"))).alias("unlisted"),
            F.sum("fractions").alias("fractions"),
            F.sum("off_price").alias("off_price"),
        )
    )


def _order_lines(tables: RetailTables) -> DataFrame:
    """QA-04, -06, -07 and -08 from one pass over the orders, counted per grain before the join."""
    # Lines without an order number meet no receipt.
    receipts = received_per_order(tables.goods_receipt.where("ordem_compra <> 0"))
    counts = tables.key_counts("purchase_order", ["ordem_compra"])
    per_order = lines_per_order(lines_per_grain(tables.purchase_order), receipts, counts, tasks_for(tables.purchase_order))
    return _counted(
        per_order,
        {
            "QA-04": F.sum("zeroed"),
            "QA-06": F.sum("inverted"),
            "QA-07": F.count_if(F.expr(_EXCESS)),
            "QA-08": F.sum("off"),
        },
    )


def lines_per_grain(orders: DataFrame) -> DataFrame:
    """Order lines that agree in all that the rules read; counts of parts of the orders add up."""
    rows = orders.select(*LINE_KEY, F.expr(_INVERTED).alias("_inverted"))
    tasks = tasks_for(orders)
    # By order and product, so that what lines_per_order groups them by needs no further move.
    met = rows.repartition(*_LINE) if tasks is None else rows.repartition(tasks, *_LINE)
    return met.groupBy(*LINE_KEY).agg(F.count("*").alias("n"), F.count_if("_inverted").alias("inverted"))


def received_per_order(receipts: DataFrame) -> DataFrame:
    rows = receipts.select("ordem_compra", "qtde_recebida")
    return spread(rows, ["ordem_compra"], receipts).groupBy("ordem_compra").agg(F.sum("qtde_recebida").cast(QTY_SUM).alias("received"))


def lines_per_order(lines: DataFrame, receipts: DataFrame, counts: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Each row of ``lines`` with its lines that differ, have no link or are inverted.

    ``recebida`` is what all lines of its order, product and quantity received together; one of
    their rows has it. They are added up before they meet the receipts, and moved once for that.
    ``counts`` and ``tasks`` are those of a lookup join by order number.
    """
    grain = [c for c in LINE_KEY if c != "qtde_entregue"]
    by_delivery = Window.partitionBy(*grain).orderBy("qtde_entregue")
    lines = lines.withColumns(
        {
            "_all": F.sum("n").over(by_delivery.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_more": F.lead(F.lit(True)).over(by_delivery),
        }
    ).withColumn("_all", F.when(F.col("_more").isNull(), F.col("_all"))).drop("_more")
    # Lines that agree in the grain each count the receipt once.
    met = lookup_join(lines, receipts.where("ordem_compra <> 0"), ["ordem_compra"], "left", counts, tasks=tasks)
    return met.select(
        *grain,
        (F.col("received") * F.col("_all")).cast(QTY_SUM).alias("recebida"),
        F.when((F.col("received") * F.col("n")).cast(QTY_SUM) != F.col("qtde_entregue"), 1).otherwise(0).alias("off"),
        F.when(F.expr(_ZEROED), F.col("n")).alias("zeroed"),
        "inverted",
    )


def scoreboard(tables: RetailTables, settle: Callable[[DataFrame], DataFrame] = lambda part: part) -> DataFrame:
    """One line per rule: code, title, severity and number of findings.

    Counts, unlike the views, need no row detail, so rules that read the same
    table share a pass over it. Twin orders need groups of their own. ``settle``
    is given each part as it is made (see ``session.in_turn``).
    """
    parts = [
        settle(_sales_lines(tables)),
        settle(_order_lines(tables)),
        settle(_counted(_twins(tables), {"QA-05": F.sum("ocorrencias")})),
        settle(dimension_lines(tables)),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines.orderBy(severity_rank(), "cod")


def severity_rank() -> Column:
    rank = F.lit(len(labels.SEVERITIES))
    for i, name in reversed(list(enumerate(labels.SEVERITIES, start=1))):
        rank = F.when(F.col("severidade") == name, i).otherwise(rank)
    return rank


# ---- questions for the data owner -------------------------------------------


#: Rule findings in the order in which they are discussed.
DECISIONS: dict[str, Callable[[RetailTables], DataFrame]] = {
    "uncatalogued_sales": lambda t: uncatalogued_sales(t).orderBy("produto_id", "venda_id"),
    "branches_without_catalogue": lambda t: branches_without_catalogue(t).orderBy("filial_id"),
    "fractional_quantities": lambda t: fractional_quantities(t).orderBy("venda_id", "produto_id"),
    "duplicate_orders": lambda t: duplicate_orders(t).orderBy("produto_id", "pedido_id"),
    "delivered_vs_receipt": lambda t: delivered_vs_receipt(t).orderBy(
        F.abs("divergencia").desc_nulls_first(), "pedido_id", "produto_id"
    ),
    "negative_margins": lambda t: negative_margins(t).orderBy("idproduto", "filial_id"),
    "widest_price_gaps": lambda t: widest_price_gaps(t),
    "inverted_dates": lambda t: inverted_dates(t).orderBy("dias_diferenca", "pedido_id"),
}


def widest_price_gaps(tables: RetailTables, top: int = 10) -> DataFrame:
    """The ``top`` sales furthest from their catalogue price; ties by sale, then product."""
    return (
        diverging_sale_prices(tables)
        .orderBy(
            F.abs("diferenca").desc_nulls_first(),
            "venda_id",
            "produto_id",
            "preco_praticado",
            "data_emissao",
        )
        .limit(top)
    )


def register_views(tables: RetailTables, scope: Period, prefix: str = "") -> list[str]:
    """Name every rule as a temporary view, recomputed on each read."""
    frames = {code: rule(tables) for code, rule in RULES.items()}
    frames["QA-12"] = sales_by_month(tables, scope.start)
    frames["QA-P"] = scoreboard(tables)
    names = []
    for code, frame in frames.items():
        name = prefix + labels.RULE_VIEWS[code]
        frame.createOrReplaceTempView(name)
        names.append(name)
    return names
