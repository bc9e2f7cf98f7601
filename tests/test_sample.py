"""Known results on a sample set of the five CSV files.

Set RETAIL_SAMPLE to a folder holding venda.csv, pedido_compra.csv,
entradas_mercadoria.csv, produtos_filial.csv and fornecedor.csv (122 rows in
all) and, for the displaced block, one further CSV file of 11 columns.
"""

import glob
import os
import shutil
from datetime import date
from decimal import Decimal as D

import pytest
from conftest import rows_of

from ledgerloom.functions.period import Period
from ledgerloom.functions.text import PLAIN
from ledgerloom.model.schema import SALES
from ledgerloom.operators import integrity, resolve
from ledgerloom.plans import load, quality, reconcile, reports
from ledgerloom.sources import csv, sheet, warehouse

FOLDER = os.environ.get("RETAIL_SAMPLE")
pytestmark = pytest.mark.skipif(not FOLDER, reason="RETAIL_SAMPLE names no folder")

FEB = Period.month(2025, 2)
JAN_FEB = Period.month(2025, 1, 2)


@pytest.fixture(scope="module")
def raw(spark):
    staged, ragged = csv.stage_folder(spark, FOLDER)
    assert all(df.count() == 0 for df in ragged.values())
    return staged


@pytest.fixture(scope="module")
def tables(spark, raw, tmp_path_factory):
    done = warehouse.onboard(spark, raw, str(tmp_path_factory.mktemp("wh")))
    assert all(df.count() == 0 for df in done.quarantine.values())
    return done.tables


def test_counts_and_checksum(raw, tables):
    assert rows_of(reconcile.row_count_differences(raw, tables)) == sorted(
        [
            ("supplier", 20, 20, 0), ("branch_product", 20, 20, 0), ("purchase_order", 29, 29, 0),
            ("goods_receipt", 20, 20, 0), ("sales", 33, 33, 0),
        ]
    )
    assert tuple(reconcile.financial_checksum(raw, tables).first()) == (D("34768.22"), D("34768.22"), D("0.00"), 0)
    assert reconcile.repeated_documents(tables.sales).count() == 0


def test_scoreboard(tables):
    board = {r["cod"]: r["ocorrencias"] for r in quality.scoreboard(tables).collect()}
    assert board == {
        "QA-01": 13, "QA-02": 2, "QA-03": 5, "QA-04": 11, "QA-05": 18, "QA-06": 20,
        "QA-07": 7, "QA-08": 18, "QA-09": 4, "QA-10": 20, "QA-11": 3,
    }
    assert board == {code: rule(tables).count() for code, rule in quality.RULES.items()}
    assert tuple(reconcile.acceptance(tables).first())[1:] == (13, False)
    assert [r["severidade"] for r in quality.scoreboard(tables).collect()][0] == "CRITICA"


def test_months(tables):
    assert rows_of(quality.sales_by_month(tables, date(2025, 2, 1))) == [
        ("01/2025", 12, D("220.500"), D("17947.15"), "fora do escopo"),
        ("02/2025", 14, D("173.220"), D("14093.17"), "ESCOPO DE VALIDACAO"),
        ("03/2025", 7, D("28.000"), D("2727.89"), "fora do escopo"),
    ]


def test_february(tables):
    sold = reports.monthly_sales(tables, FEB).collect()
    assert len(sold) == 14
    assert sum(r["descricao"] == "*** SEM CADASTRO ***" for r in sold) == 6
    total = reports.monthly_sales_with_total(tables, FEB).collect()
    assert len(total) == 15
    assert tuple(total[-1]) == (">>> TOTAL FEVEREIRO/2025", D("173.220"), D("14093.17"))
    assert tuple(reports.period_card(tables, FEB).first()) == (
        "Fevereiro/2025", 14, 14, 2, D("173.220"), "R$ 14.093,17", "07/02/2025", "28/02/2025",
    )
    assert reports.period_card(tables, FEB, PLAIN).first()["faturamento_total"] == "14,093.17"
    assert reports.daily_revenue(tables, FEB).count() == 6
    assert reports.days_without_sales(tables, FEB).count() == 15  # one of the six days is a Saturday


def test_orders(tables):
    assert rows_of(reports.open_orders_summary(tables)) == [
        ("ORDEM DE COMPRA ZERADA", 11, D("96.000")),
        ("PARCIALMENTE RECEBIDO", 10, D("347.000")),
    ]
    assert reports.open_orders(tables).count() == 21
    assert reports.requisitions_by_quantity(tables, JAN_FEB).count() == 19
    assert reports.requisitions_by_count(tables, JAN_FEB).count() == 0
    assert reports.sales_by_label(tables, JAN_FEB).count() == 8
    assert reports.catalogue_with_orders(tables, JAN_FEB).count() == 19
    classes = reports.order_vs_receipt(tables, FEB).groupBy("situacao").count()
    assert rows_of(classes) == [("PARCIAL", 5), ("RECEBIDO A MAIOR", 3), ("SEM VINCULO", 9)]


def test_stock(tables):
    movement = reports.stock_movement(tables, FEB)
    assert movement.count() == 20
    assert rows_of(movement.where("alerta <> 'ok'"), "produto", "alerta") == [
        ("P14 - Produto 14", "SAIDA MAIOR QUE DISPONIVEL")
    ]


def test_links(raw, tables):
    typed = load.load("branch_product", raw.branch_product)
    assert rows_of(resolve.link_coverage(typed)) == [(20, 0, 20)]
    assert rows_of(resolve.link_coverage(tables.branch_product)) == [(20, 20, 0)]
    assert integrity.foreign_key_report(tables).count() == 0
    assert rows_of(integrity.validate(SALES.foreign_keys[0], tables.sales, tables.branch_product)) == [
        ("venda_produto", 13, False)
    ]
    zeroed, twins = quality.zeroed_orders(tables), quality.duplicate_orders(tables)
    assert zeroed.join(twins, "pedido_id", "left_semi").count() == 11


def test_displaced_block(spark, tables, tmp_path):
    (hidden,) = [p for p in glob.glob(f"{FOLDER}/*.csv") if os.path.basename(p).startswith("_")]
    path = str(tmp_path / "block.csv")
    shutil.copyfile(hidden, path)  # Spark passes over names that start with an underscore
    block = sheet.typed_overflow(sheet.overflow_block(csv.read_sheet(spark, path)))
    found = rows_of(
        reconcile.displaced_rows(block, tables.purchase_order), "pedido_id", "campos_divergentes", "pendente_confere"
    )
    assert [f[0] for f in found] == list(range(12, 21))
    assert [f[1] for f in found] == [""] * 7 + [
        "ordem_compra,qtde_pedida", "ordem_compra,qtde_pedida,qtde_entregue",
    ]
    assert all(f[2] for f in found)
