"""Sales and purchase reports.

Facts are aggregated to the join key before they meet the catalogue, so a
product or branch with very many rows reaches the join as one row.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.period import Period
from ledgerloom.functions.text import REAIS, NumberStyle, code_and_text, day, money, to_cents, weekday
from ledgerloom.model import labels
from ledgerloom.model.tables import RetailTables
from ledgerloom.operators.skew import lookup_join

QTY_SUM = T.DecimalType(24, 3)


def amount() -> Column:
    return F.col("qtde_vendida") * F.col("valor_unitario")


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast(QTY_SUM))


def present(df: DataFrame, headings: str) -> DataFrame:
    """Rename the columns of a report to the headings its readers know."""
    return df.withColumnsRenamed(labels.HEADINGS[headings])


def _sales_by_product(tables: RetailTables, period: Period) -> DataFrame:
    """One row per product and branch sold in the period."""
    return (
        tables.sales.where(period.holds("data_emissao"))
        .groupBy("filial_id", "produto_id")
        .agg(
            F.count("*").alias("n"),
            F.sum("qtde_vendida").alias("qty"),
            F.sum(amount()).alias("amount"),
            F.sum("valor_unitario").alias("prices"),
            F.min("data_emissao").alias("first"),
        )
    )


def _catalogue(tables: RetailTables) -> DataFrame:
    return tables.branch_product.select(
        "filial_id", F.col("idproduto").alias("produto_id"), "descricao", "idproduto"
    )


def _receipts_by_order(tables: RetailTables) -> DataFrame:
    """Received quantity per purchase order number; zero links to nothing."""
    return (
        tables.goods_receipt.where("ordem_compra <> 0")
        .groupBy("ordem_compra")
        .agg(F.sum("qtde_recebida").cast(QTY_SUM).alias("recebida"), F.lit(True).alias("linked"))
    )


# ---- sales ------------------------------------------------------------------


def monthly_sales(tables: RetailTables, period: Period) -> DataFrame:
    """Sales per product and branch, products without catalogue entry included."""
    sold = _sales_by_product(tables, period)
    joined = sold.join(_catalogue(tables), ["filial_id", "produto_id"], "left")
    return (
        # A description that repeats in the catalogue folds into one line again.
        joined.groupBy("produto_id", "descricao", "filial_id")
        .agg(
            F.sum("n").alias("qtde_notas"),
            F.sum("qty").cast(QTY_SUM).alias("qtde_total_vendida"),
            to_cents(F.sum("amount")).alias("valor_total_reais"),
            (F.sum("prices").cast("decimal(22,4)") / F.sum("n").cast("decimal(12,0)")).alias("mean"),
        )
        .select(
            "produto_id",
            F.coalesce("descricao", F.lit(labels.UNCATALOGUED)).alias("descricao"),
            F.col("filial_id").alias("filial"),
            "qtde_notas",
            "qtde_total_vendida",
            "valor_total_reais",
            F.round("mean", 2).cast("decimal(14,2)").alias("preco_medio_unitario"),
        )
        .orderBy(F.desc_nulls_first("valor_total_reais"), "produto_id", "filial")
    )


def monthly_sales_with_total(tables: RetailTables, period: Period) -> DataFrame:
    """Sales per product and, as the last line, the grand total."""
    per_product = (
        tables.sales.where(period.holds("data_emissao"))
        .groupBy("produto_id")
        .agg(F.sum("qtde_vendida").alias("qty"), F.sum(amount()).alias("amount"))
    )
    total_title = labels.TOTAL_PREFIX + period.title.upper()
    return (
        # Both levels come from the per-product rows, not from the sales twice.
        per_product.groupingSets([["produto_id"], []], "produto_id")
        .agg(
            F.grouping("produto_id").alias("is_total"),
            F.sum("qty").cast(QTY_SUM).alias("qtde_total_vendida"),
            to_cents(F.sum("amount")).alias("valor_total_reais"),
        )
        .orderBy("is_total", F.desc_nulls_first("valor_total_reais"), "produto_id")
        .select(
            F.coalesce("produto_id", F.lit(total_title)).alias("produto_id"),
            "qtde_total_vendida",
            "valor_total_reais",
        )
    )


def sales_by_label(tables: RetailTables, period: Period, above: int = 10) -> DataFrame:
    """Sold quantity per product label, with an alert for products not catalogued."""
    joined = _sales_by_product(tables, period).join(
        _catalogue(tables), ["filial_id", "produto_id"], "left"
    )
    return (
        joined.withColumn("produto", code_and_text(F.col("produto_id"), F.col("descricao")))
        .groupBy("produto", "idproduto")
        .agg(
            F.sum("qty").cast(QTY_SUM).alias("qtde_requisitada"),
            day(F.min("first")).alias("data_solicitacao"),
            to_cents(F.sum("amount")).alias("valor_total"),
        )
        .where(F.col("qtde_requisitada") > above)
        .select(
            "produto",
            "qtde_requisitada",
            "data_solicitacao",
            "valor_total",
            F.when(F.col("idproduto").isNull(), labels.UNCATALOGUED_ALERT).alias("alerta"),
        )
        .orderBy(F.desc_nulls_first("qtde_requisitada"), "produto")
    )


def period_card(tables: RetailTables, period: Period, style: NumberStyle = REAIS) -> DataFrame:
    """The period on one line."""
    # Distinct counts over product and branch pairs need no second copy of the sales.
    pairs = (
        tables.sales.where(period.holds("data_emissao"))
        .groupBy("produto_id", "filial_id")
        .agg(
            F.count("*").alias("n"),
            F.sum("qtde_vendida").alias("qty"),
            F.sum(amount()).alias("amount"),
            F.min("data_emissao").alias("first"),
            F.max("data_emissao").alias("last"),
        )
    )
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("qtde_lancamentos"),
        F.count_distinct("produto_id").alias("produtos_distintos"),
        F.count_distinct("filial_id").alias("filiais"),
        F.sum("qty").cast(QTY_SUM).alias("qtde_total"),
        money(F.sum("amount"), style).alias("faturamento_total"),
        day(F.min("first")).alias("primeira_venda"),
        day(F.max("last")).alias("ultima_venda"),
    ).select(F.lit(period.title).alias("periodo"), "*")


def _daily(tables: RetailTables, period: Period) -> DataFrame:
    return (
        tables.sales.where(period.holds("data_emissao"))
        .groupBy("data_emissao")
        .agg(F.count("*").alias("lancamentos"), F.sum(amount()).alias("amount"))
    )


def daily_revenue(
    tables: RetailTables, period: Period, style: NumberStyle = REAIS, language: str = "en"
) -> DataFrame:
    return (
        _daily(tables, period)
        .orderBy("data_emissao")
        .select(
            day(F.col("data_emissao")).alias("dia"),
            weekday(F.col("data_emissao"), language).alias("dia_semana"),
            "lancamentos",
            money(F.col("amount"), style).alias("faturamento"),
        )
    )


def days_without_sales(tables: RetailTables, period: Period, language: str = "en") -> DataFrame:
    """Working days (Monday to Friday) of the period on which nothing was sold."""
    spark = tables.sales.sparkSession
    calendar = spark.range(1).select(
        F.explode(
            F.sequence(F.lit(period.start), F.date_sub(F.lit(period.end), 1))
        ).alias("data_emissao")
    )
    working = calendar.where(~F.dayofweek("data_emissao").isin(1, 7))
    return (
        working.join(_daily(tables, period), "data_emissao", "left_anti")
        .orderBy("data_emissao")
        .select(
            day(F.col("data_emissao")).alias("dia"),
            weekday(F.col("data_emissao"), language).alias("dia_semana"),
        )
    )


def sale_gaps(tables: RetailTables, period: Period) -> DataFrame:
    """Runs of days of the period without a sale, for every branch and product that ever sold.

    One row per run with a working day (Monday to Friday) in it: first and last
    day, and its working days. A sale before or behind the period counts as one
    at its edge, so a key has at most as many rows as the period has days, and
    two; the runs lie between them, without a calendar.
    """
    key = ["filial_id", "produto_id"]
    edge, end = F.date_sub(F.lit(period.start), 1), F.lit(period.end)
    within = F.least(F.greatest(F.col("data_emissao"), edge), end)
    active = tables.sales.where("data_emissao IS NOT NULL").select(*key, within.alias("dia")).distinct()
    in_order = Window.partitionBy(*key).orderBy("dia")
    behind = F.struct(F.date_add("dia", 1).alias("primeiro_dia"), F.date_sub(F.coalesce(F.lead("dia").over(in_order), end), 1).alias("ultimo_dia"))
    ahead = F.when(F.lag("dia").over(in_order).isNull(), F.struct(F.lit(period.start).alias("primeiro_dia"), F.date_sub("dia", 1).alias("ultimo_dia")))
    runs = active.select(*key, F.array_compact(F.array(ahead, behind)).alias("runs")).select(*key, F.inline("runs"))
    days = _working_days_before(F.date_add("ultimo_dia", 1)) - _working_days_before(F.col("primeiro_dia"))
    return runs.where("primeiro_dia <= ultimo_dia").withColumn("dias_uteis", days).where("dias_uteis > 0")


def _working_days_before(d: Column) -> Column:
    """Working days from a Monday long ago up to, but without, the day."""
    n = F.datediff(d, F.lit(date(1900, 1, 1)))
    return (F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))).cast("int")


# ---- purchase orders --------------------------------------------------------


def _open_orders(tables: RetailTables) -> DataFrame:
    """Order lines not fully received, each with one class and its balance."""
    joined = lookup_join(
        tables.purchase_order, _receipts_by_order(tables), ["ordem_compra"], "left",
        tables.key_counts("purchase_order", ["ordem_compra"]),
    )
    received = _or_zero("recebida")
    zeroed = F.col("ordem_compra") == 0
    unlinked = F.col("linked").isNull()
    situation = (
        F.when(zeroed, labels.ZEROED).when(unlinked, labels.UNLINKED).otherwise(labels.PARTIAL)
    )
    return joined.where(zeroed | unlinked | (received < F.col("qtde_pedida"))).select(
        "pedido_id",
        "ordem_compra",
        "produto_id",
        "descricao_produto",
        day(F.col("data_pedido")).alias("data_pedido"),
        "qtde_pedida",
        received.alias("qtde_recebida"),
        (F.col("qtde_pedida") - received).cast(QTY_SUM).alias("saldo_pendente"),
        situation.alias("situacao"),
    )


def open_orders(tables: RetailTables) -> DataFrame:
    return _open_orders(tables).orderBy("situacao", "pedido_id")


def open_orders_summary(tables: RetailTables) -> DataFrame:
    return (
        _open_orders(tables)
        .groupBy("situacao")
        .agg(
            F.count("*").alias("qtde_pedidos"),
            F.sum("saldo_pendente").cast(QTY_SUM).alias("saldo_total_pendente"),
        )
        .orderBy(F.desc("qtde_pedidos"), "situacao")
    )


def _requisitions(tables: RetailTables, period: Period) -> DataFrame:
    label = code_and_text(F.col("produto_id"), F.col("descricao_produto"))
    return (
        tables.purchase_order.where(period.holds("data_pedido"))
        .groupBy(label.alias("produto"))
        .agg(
            F.sum("qtde_pedida").cast(QTY_SUM).alias("qtde_requisitada"),
            F.count("*").alias("qtde_solicitacoes"),
            day(F.min("data_pedido")).alias("data_solicitacao"),
            day(F.max("data_pedido")).alias("ultima_solicitacao"),
        )
    )


def requisitions_by_quantity(tables: RetailTables, period: Period, above: int = 10) -> DataFrame:
    """Products of which more than ``above`` units were ordered."""
    return (
        _requisitions(tables, period)
        .where(F.col("qtde_requisitada") > above)
        .orderBy(F.desc_nulls_first("qtde_requisitada"), "produto")
    )


def requisitions_by_count(tables: RetailTables, period: Period, above: int = 10) -> DataFrame:
    """Products ordered more than ``above`` times."""
    return (
        _requisitions(tables, period)
        .where(F.col("qtde_solicitacoes") > above)
        .drop("ultima_solicitacao")
        .orderBy(F.desc_nulls_first("qtde_requisitada"), "produto")
    )


def catalogue_with_orders(
    tables: RetailTables, period: Period, above: int = 10, style: NumberStyle = REAIS
) -> DataFrame:
    """Catalogue lines with their supplier and what was ordered of the product.

    Orders are matched by product alone, so a product listed by two branches
    shows the same ordered quantity on both lines.
    """
    ordered = (
        tables.purchase_order.where(period.holds("data_pedido"))
        .groupBy(F.col("produto_id").alias("idproduto"))
        .agg(
            F.sum("qtde_pedida").cast(QTY_SUM).alias("qtde_requisitada"),
            F.min("data_pedido").alias("first"),
        )
        # The report keeps only these, so the outer join of the two is an inner one.
        .where(F.col("qtde_requisitada") > above)
    )
    supplier = tables.supplier.select(
        "idfornecedor", "fornecedor_num", "razao_social", F.col("idfornecedor").alias("code")
    )
    lines = lookup_join(tables.branch_product, ordered, ["idproduto"], "inner")
    return (
        lookup_join(lines, supplier, ["idfornecedor"], "left")
        .orderBy(F.desc("qtde_requisitada"), "idproduto", "filial_id")
        .select(
            code_and_text(F.col("idproduto"), F.col("descricao")).alias("produto"),
            F.col("filial_id").alias("filial"),
            F.concat_ws(" - ", "code", "razao_social").alias("fornecedor"),
            F.col("fornecedor_num").alias("cod_fornecedor_num"),
            "estoque",
            money(F.col("preco_compra"), style, symbol=False).alias("preco_compra"),
            money(F.col("preco_venda"), style, symbol=False).alias("preco_venda"),
            "qtde_requisitada",
            day(F.col("first")).alias("data_solicitacao"),
        )
    )


# ---- reconciliation between modules -----------------------------------------


def order_vs_receipt(tables: RetailTables, period: Period, strict: bool = False) -> DataFrame:
    """What was ordered, what the order says was delivered, what the notes say came in.

    Receipts match by order number, so each line of an order is compared with
    the whole receipt, and identical lines merge. ``strict`` keeps lines apart
    by order id and item, and matches receipts by order, item and product.
    """
    match = ["ordem_compra", "item", "produto_id"] if strict else ["ordem_compra"]
    receipts = (
        tables.goods_receipt.where("ordem_compra <> 0")
        .groupBy(*match)
        .agg(F.sum("qtde_recebida").cast(QTY_SUM).alias("recebida"))
    )
    lines = tables.purchase_order.where(period.holds("data_pedido"))
    grain = [
        "ordem_compra", "produto_id", "descricao_produto",
        "data_pedido", "qtde_pedida", "qtde_entregue",
    ] + (["pedido_id", "item"] if strict else [])
    received, ordered = F.col("recebido"), F.col("qtde_pedida")
    situation = (
        F.when(F.col("ordem_compra") == 0, labels.NO_LINK)
        .when(received == 0, labels.NOT_RECEIVED)
        .when(received > ordered, labels.OVER_RECEIVED)
        .when(received < ordered, labels.PART_RECEIVED)
        .otherwise(labels.COMPLETE)
    )
    return (
        lookup_join(lines, receipts, match, "left", tables.key_counts("purchase_order", match))
        .groupBy(*grain)
        .agg(F.sum("recebida").cast(QTY_SUM).alias("recebida"))
        .withColumn("recebido", _or_zero("recebida"))
        .select(
            F.col("ordem_compra").alias("ordem"),
            F.concat_ws(" - ", "produto_id", "descricao_produto").alias("produto"),
            day(F.col("data_pedido")).alias("data_pedido"),
            ordered.alias("pedido"),
            F.col("qtde_entregue").alias("entregue"),
            "recebido",
            (received - F.col("qtde_entregue")).cast(QTY_SUM).alias("divergencia"),
            situation.alias("situacao"),
            *(["pedido_id", "item"] if strict else []),
        )
        .orderBy(F.desc_nulls_first(F.abs("divergencia")), "ordem", "produto")
    )


def stock_movement(tables: RetailTables, period: Period) -> DataFrame:
    """Stock of each catalogue line against what came in and went out in the period."""
    keys = ["filial_id", "idproduto"]
    came_in = (
        tables.goods_receipt.where(period.holds("data_entrada"))
        .groupBy("filial_id", F.col("produto_id").alias("idproduto"))
        .agg(F.sum("qtde_recebida").cast(QTY_SUM).alias("in_qty"))
    )
    went_out = (
        tables.sales.where(period.holds("data_emissao"))
        .groupBy("filial_id", F.col("produto_id").alias("idproduto"))
        .agg(F.sum("qtde_vendida").cast(QTY_SUM).alias("out_qty"))
    )
    stock = F.col("estoque")
    alert = (
        F.when(stock < 0, labels.NEGATIVE_STOCK)
        .when(F.col("saidas") > stock + F.col("entradas"), labels.OVERSOLD)
        .otherwise(labels.STOCK_OK)
    )
    return (
        tables.branch_product.join(came_in, keys, "left")
        .join(went_out, keys, "left")
        .withColumns({"entradas": _or_zero("in_qty"), "saidas": _or_zero("out_qty")})
        .orderBy(F.desc("saidas"), "idproduto", "filial_id")
        .select(
            F.concat_ws(" - ", "idproduto", "descricao").alias("produto"),
            stock.alias("estoque_atual"),
            "entradas",
            "saidas",
            (F.col("entradas") - F.col("saidas")).cast(QTY_SUM).alias("saldo_do_mes"),
            alert.alias("alerta"),
        )
    )
