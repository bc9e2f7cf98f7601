"""Reports on small tables with the awkward cases."""

from datetime import date
from decimal import Decimal as D

import pytest
from conftest import rows_of

from ledgerloom.functions.period import Period
from ledgerloom.functions.text import PLAIN, money, weekday
from ledgerloom.plans import quality, reports

FEB = Period.month(2025, 2)


def sale(i, product, qty, price, day="2025-02-10", branch=1, unit="UN", time="08:00:00", item=1):
    return {
        "venda_id": i, "data_emissao": day, "horariomov": time, "produto_id": product,
        "qtde_vendida": qty, "valor_unitario": price, "filial_id": branch, "item": item,
        "unidade_medida": unit,
    }


def product(code, text="Produto", branch=1, stock=10, buy=5, sell=8, supplier="F1"):
    return {
        "filial_id": branch, "idproduto": code, "descricao": text, "estoque": stock,
        "preco_unitario": sell, "preco_compra": buy, "preco_venda": sell, "idfornecedor": supplier,
    }


def order(i, code, link, asked, got=0, day="2025-02-01", due="2025-02-05", price=5, text="Produto", item=1):
    return {
        "pedido_id": i, "item": item, "ordem_compra": link, "data_pedido": day, "produto_id": code,
        "descricao_produto": text, "qtde_pedida": asked, "filial_id": 1, "data_entrega": due,
        "qtde_entregue": got, "preco_compra": price, "fornecedor_id": 1,
    }


def receipt(link, qty, code="P1", note="N1", item=1, day="2025-02-03"):
    return {
        "ordem_compra": link, "nro_nfe": note, "item": item, "produto_id": code,
        "data_entrada": day, "qtde_recebida": qty, "filial_id": 1, "custo_unitario": 5,
    }


def test_period():
    assert Period.month(2025, 12) == Period(date(2025, 12, 1), date(2026, 1, 1))
    assert Period.month(2025, 1, 2).title == "Janeiro/2025 a Fevereiro/2025"
    assert FEB.title == "Fevereiro/2025"


def test_monthly_sales_keeps_uncatalogued_products_and_folds_repeats(tables):
    t = tables(
        sales=[
            sale(1, "P1", 2, "8.005"), sale(2, "P1", 1, "8.010"), sale(3, "P9", 1, 100),
            sale(4, "P1", 1, 8, day="2025-03-01"), sale(5, "P1", 1, 8, branch=2),
        ],
        # The same line twice: a join counts every sale of it twice.
        branch_product=[product("P1"), product("P1"), product("P2")],
    )
    got = [tuple(r) for r in reports.monthly_sales(t, FEB).collect()]
    assert got == [
        ("P9", "*** SEM CADASTRO ***", 1, 1, D("1.000"), D("100.00"), D("100.00")),
        ("P1", "Produto", 1, 4, D("6.000"), D("48.04"), D("8.01")),
        ("P1", "*** SEM CADASTRO ***", 2, 1, D("1.000"), D("8.00"), D("8.00")),
    ]


def test_total_line_comes_last_and_adds_up(tables):
    t = tables(sales=[sale(1, "P1", 2, 3), sale(2, "P2", 1, 9), sale(3, "P1", 1, 1)])
    got = [tuple(r) for r in reports.monthly_sales_with_total(t, FEB).collect()]
    assert got == [
        ("P2", D("1.000"), D("9.00")),
        ("P1", D("3.000"), D("7.00")),
        (">>> TOTAL FEVEREIRO/2025", D("4.000"), D("16.00")),
    ]


def test_open_orders_classes(tables):
    t = tables(
        purchase_order=[
            order(1, "P1", 0, 5), order(2, "P1", 2, 5), order(3, "P1", 3, 5), order(4, "P1", 4, 5),
            order(5, "P1", 5, None), order(6, "P1", 0, None), order(7, "P1", 7, None),
        ],
        goods_receipt=[
            receipt(3, 1), receipt(3, 2, note="N2"), receipt(4, 5), receipt(5, 1), receipt(0, 99),
        ],
    )
    assert rows_of(reports.open_orders(t), "pedido_id", "qtde_recebida", "saldo_pendente", "situacao") == [
        (1, D("0.000"), D("5.000"), "ORDEM DE COMPRA ZERADA"),
        (2, D("0.000"), D("5.000"), "SEM ENTRADA VINCULADA"),
        (3, D("3.000"), D("2.000"), "PARCIALMENTE RECEBIDO"),
        (6, D("0.000"), None, "ORDEM DE COMPRA ZERADA"),
        (7, D("0.000"), None, "SEM ENTRADA VINCULADA"),
    ]
    assert rows_of(reports.open_orders_summary(t)) == [
        ("ORDEM DE COMPRA ZERADA", 2, D("5.000")),
        ("PARCIALMENTE RECEBIDO", 1, D("2.000")),
        ("SEM ENTRADA VINCULADA", 2, D("5.000")),
    ]


def test_requisitions_label_and_thresholds(tables):
    t = tables(
        purchase_order=[order(i, "P1", 0, 1, text=" Sabao ") for i in range(11)]
        + [order(20, "P2", 0, 11, text=" "), order(21, "P3", 0, 10), order(22, "P4", 0, 99, day=None)]
    )
    by_quantity = reports.requisitions_by_quantity(t, FEB)
    assert rows_of(by_quantity, "produto", "qtde_requisitada") == [
        ("P1 - Sabao", D("11.000")),
        ("P2", D("11.000")),
    ]
    assert rows_of(reports.requisitions_by_count(t, FEB), "produto", "qtde_solicitacoes") == [("P1 - Sabao", 11)]
    assert reports.present(by_quantity, "requisitions").columns == [
        "Produto", "Qtde Requisitada", "Qtde Solicitacoes", "Data Solicitacao", "Ultima Solicitacao",
    ]


def test_sales_by_label_spans_branches(tables):
    t = tables(
        sales=[sale(1, "P1", 6, 1), sale(2, "P1", 6, 1, branch=2), sale(3, "P1", 20, 1, branch=3)],
        branch_product=[product("P1"), product("P1", branch=2)],
    )
    assert rows_of(reports.sales_by_label(t, FEB), "produto", "qtde_requisitada", "alerta") == [
        ("P1", D("20.000"), "PRODUTO SEM CADASTRO"),
        ("P1 - Produto", D("12.000"), None),
    ]


def test_catalogue_repeats_orders_per_branch(tables):
    t = tables(
        branch_product=[product("P1"), product("P1", branch=2, supplier="F9"), product("P2")],
        supplier=[{"idfornecedor": "F1", "fornecedor_num": 1, "razao_social": "Um"}],
        purchase_order=[order(1, "P1", 0, 12), order(2, "P2", 0, 10)],
    )
    got = rows_of(reports.catalogue_with_orders(t, FEB), "filial", "fornecedor", "qtde_requisitada", "preco_venda")
    assert got == [(1, "F1 - Um", D("12.000"), "8,00"), (2, "", D("12.000"), "8,00")]


def test_order_vs_receipt_grain(tables):
    t = tables(
        purchase_order=[
            order(1, "P1", 1, 10, 10), order(1, "P2", 1, 10, 3, item=2),
            order(2, "P3", 2, 4, 4), order(3, "P3", 2, 4, 4),  # identical but for the order id
            order(4, "P4", 4, None, 0), order(5, "P5", 0, 1, 0), order(6, "P6", 6, 1, 0),
            order(7, "P7", 7, 2, 2),
        ],
        goods_receipt=[
            receipt(1, 7), receipt(1, 3, "P2", item=2), receipt(2, 4, "P3"), receipt(4, 1, "P4"), receipt(7, 2, "P7"),
        ],
    )
    wide = rows_of(reports.order_vs_receipt(t, FEB), "produto", "recebido", "divergencia", "situacao")
    assert wide == [
        ("P1 - Produto", D("10.000"), D("0.000"), "COMPLETO"),
        ("P2 - Produto", D("10.000"), D("7.000"), "COMPLETO"),
        ("P3 - Produto", D("8.000"), D("4.000"), "RECEBIDO A MAIOR"),
        ("P4 - Produto", D("1.000"), D("1.000"), "COMPLETO"),
        ("P5 - Produto", D("0.000"), D("0.000"), "SEM VINCULO"),
        ("P6 - Produto", D("0.000"), D("0.000"), "NAO RECEBIDO"),
        ("P7 - Produto", D("2.000"), D("0.000"), "COMPLETO"),
    ]
    strict = rows_of(reports.order_vs_receipt(t, FEB, strict=True), "pedido_id", "recebido", "situacao")
    assert strict[:3] == [(1, D("3.000"), "PARCIAL"), (1, D("7.000"), "PARCIAL"), (2, D("4.000"), "COMPLETO")]


def test_stock_movement_alerts(tables):
    t = tables(
        branch_product=[product("P1", stock=9), product("P2", stock=-1), product("P3", stock=5)],
        sales=[sale(1, "P1", 53, 1), sale(2, "P3", 8, 1)],
        goods_receipt=[receipt(1, 3, "P3")],
    )
    assert rows_of(reports.stock_movement(t, FEB), "produto", "saldo_do_mes", "alerta") == [
        ("P1 - Produto", D("-53.000"), "SAIDA MAIOR QUE DISPONIVEL"),
        ("P2 - Produto", D("0.000"), "ESTOQUE NEGATIVO"),
        ("P3 - Produto", D("-5.000"), "ok"),
    ]


def test_card_and_days(tables):
    t = tables(
        sales=[sale(1, "P1", 1, "1234567.005", day="2025-02-07"), sale(2, "P1", 1, 1, day="2025-02-28", branch=2)]
    )
    assert tuple(reports.period_card(t, FEB).first()) == (
        "Fevereiro/2025", 2, 1, 2, D("2.000"), "R$ 1.234.568,01", "07/02/2025", "28/02/2025",
    )
    assert [tuple(r) for r in reports.daily_revenue(t, FEB, PLAIN).collect()] == [
        ("07/02/2025", "Fri", 1, "1,234,567.01"),
        ("28/02/2025", "Fri", 1, "1.00"),
    ]
    idle = reports.days_without_sales(t, FEB, "pt").collect()
    assert len(idle) == 18
    assert tuple(idle[0]) == ("03/02/2025", "Seg")


def test_runs_of_days_without_a_sale_per_branch_and_product(tables):
    days = {
        ("P1", 1): ["2025-01-31", "2025-02-03", "2025-02-04", "2025-02-04", "2025-02-10", "2025-03-01"],
        ("P1", 2): ["2025-02-28"],
        ("P2", 1): ["2024-12-01"],
        ("P3", 1): [f"2025-02-{d:02d}" for d in range(1, 29)],
        # Only a weekend is missing.
        ("P4", 1): [f"2025-02-{d:02d}" for d in range(1, 29) if d not in (8, 9)],
    }
    t = tables(sales=[sale(1, p, 1, 1, day=d, branch=b) for (p, b), ds in days.items() for d in ds])
    expected = []
    for (product, branch), sold in days.items():
        idle = [date(2025, 2, d) for d in range(1, 29) if f"2025-02-{d:02d}" not in sold]
        runs = []
        for d in idle:
            if runs and (d - runs[-1][-1]).days == 1:
                runs[-1].append(d)
            else:
                runs.append([d])
        expected += [(branch, product, r[0], r[-1], n) for r in runs if (n := sum(d.weekday() < 5 for d in r))]
    assert rows_of(reports.sale_gaps(t, FEB)) == sorted(expected, key=lambda r: [str(v) for v in r])
    assert reports.sale_gaps(tables(), FEB).count() == 0


def test_empty_period(tables):
    t = tables(sales=[sale(1, "P1", 1, 1, day="2025-05-07")])
    assert reports.monthly_sales(t, FEB).count() == 0
    assert reports.period_card(t, FEB).first()["qtde_lancamentos"] == 0
    assert reports.days_without_sales(t, FEB).count() == 20


@pytest.mark.parametrize("value, shown", [("2.345", "2,35"), ("-2.345", "-2,35"), ("1000", "1.000,00"), ("0.005", "0,01")])
def test_money_rounds_half_away_from_zero(spark, value, shown):
    df = spark.sql(f"SELECT CAST('{value}' AS DECIMAL(20,4)) AS v")
    assert df.select(money(df.v, symbol=False)).first()[0] == shown


def test_weekday(spark):
    df = spark.sql("SELECT DATE '2025-02-01' AS d")
    assert tuple(df.select(weekday(df.d), weekday(df.d, "pt")).first()) == ("Sat", "Sab")


# ---- quality ----------------------------------------------------------------


@pytest.fixture
def messy(tables):
    return tables(
        supplier=[{"idfornecedor": c, "fornecedor_num": i, "razao_social": c} for i, c in enumerate(("F1", "F2"))],
        branch_product=[
            product("P1"), product("P1"), product("P2", buy=9), product("P3", buy=0, sell=-1), product("P4", supplier=None),
        ],
        sales=[
            sale(1, "P1", "2.5", 8), sale(2, "P1", 1, 9), sale(3, "P9", "1.5", 1, unit="KG"),
            sale(4, "P1", 1, 8, branch=3), sale(5, "P2", 1, 8), sale(5, "P2", 1, 8, time="09:00:00"),
        ],
        purchase_order=[
            order(1, "P1", 0, 5), order(2, "P1", 2, 5, 1), order(2, "P1", 2, 5, 1, item=2),
            order(3, "P2", 3, None, 7), order(4, "P2", 4, 5, 5, due=None), order(5, "P3", 5, 5, 5, due="2025-01-30"),
            order(6, "P4", 6, 5, day=None), order(7, "P4", 6, 5, day=None), order(8, "P5", 8, 5, price=None),
        ],
        goods_receipt=[
            receipt(2, 4), receipt(2, 1, note="N2"), receipt(3, 7), receipt(4, 6), receipt(5, 5), receipt(0, 9),
        ],
    )


def test_scoreboard_counts_what_the_views_show(messy):
    board = {r["cod"]: r["ocorrencias"] for r in quality.scoreboard(messy).collect()}
    assert board == {code: rule(messy).count() for code, rule in quality.RULES.items()}
    assert board["QA-05"] == 5 and board["QA-10"] == 2 and board["QA-01"] == 2


def test_scoreboard_order_and_zero_lines(tables):
    got = [(r["severidade"], r["cod"], r["ocorrencias"]) for r in quality.scoreboard(tables()).collect()]
    assert [g[0] for g in got] == ["CRITICA"] + ["ALTA"] * 6 + ["MEDIA"] * 3 + ["BAIXA"]
    assert len(got) == 11 and all(g[2] == 0 for g in got)


def test_duplicates_need_two_orders(messy):
    assert rows_of(quality.duplicate_orders(messy), "pedido_id", "ocorrencias") == [
        (1, 3), (2, 3), (2, 3), (3, 2), (4, 2),
    ]


def test_receipts_against_orders(messy):
    # Identical lines of order 2 each count the whole receipt of 5.
    assert rows_of(quality.received_above_ordered(messy), "pedido_id", "qtde_recebida", "excesso") == [
        (2, D("10.000"), D("5.000")),
        (4, D("6.000"), D("1.000")),
    ]
    assert rows_of(quality.delivered_vs_receipt(messy), "pedido_id", "divergencia") == [
        (2, D("9.000")),
        (4, D("1.000")),
    ]


def test_margin_is_safe_on_zero_cost(messy):
    got = rows_of(quality.negative_margins(messy), "idproduto", "margem_absoluta", "margem_percentual")
    assert got == [("P2", D("-1.00"), D("-11.11")), ("P3", D("-1.00"), None)]


def test_other_rules(messy):
    assert rows_of(quality.branches_without_catalogue(messy)) == [(3, 1, D("8.00"))]
    assert rows_of(quality.fractional_quantities(messy), "venda_id") == [(1,)]
    assert rows_of(quality.inverted_dates(messy), "pedido_id", "dias_diferenca") == [(5, -2)]
    assert rows_of(quality.idle_suppliers(messy), "idfornecedor") == [("F2",)]
    assert rows_of(quality.sales_by_month(messy, date(2025, 2, 1))) == [
        ("02/2025", 6, D("8.000"), D("54.50"), "ESCOPO DE VALIDACAO")
    ]


def test_widest_gaps_are_limited_and_ordered(tables):
    t = tables(branch_product=[product("P1", sell=8)], sales=[sale(i, "P1", 1, 8 + i) for i in range(15)])
    got = [r["diferenca"] for r in quality.widest_price_gaps(t).collect()]
    assert got == [D(f"{i}.00") for i in range(14, 4, -1)]


def test_views_are_named_and_live(spark, messy):
    names = quality.register_views(messy, FEB, prefix="t_")
    assert len(names) == 13
    assert spark.table("t_vw_pedido_sem_ordem_compra").count() == 1
    assert spark.table("t_vw_painel_qualidade").count() == 11
