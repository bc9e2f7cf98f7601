"""Text files, spreadsheet tabs, warehouse and proofs of a load."""

import hashlib
import re

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.model.schema import SALES, SUPPLIER, TABLES
from ledgerloom.model.tables import RetailTables
from ledgerloom.operators import digests
from ledgerloom.plans import load, reconcile
from ledgerloom.sources import csv, sheet, warehouse
from ledgerloom.sources.starschema import StarSchema


def write(tmp_path, text, name="a.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_missing_and_empty_fields_stay_apart(spark, tmp_path):
    path = write(tmp_path, 'idfornecedor,razao_social\nF1,""\nF2,\nF3,  \nF4,"a ""b"", c"\nF5,São João\n')
    rows = csv.read_text(spark, path, SUPPLIER)
    assert rows_of(rows, "idfornecedor", "razao_social") == [
        ("F1", ""), ("F2", None), ("F3", "  "), ("F4", 'a "b", c'), ("F5", "São João"),
    ]


def test_ragged_rows_are_kept_apart(spark, tmp_path):
    path = write(tmp_path, "idfornecedor,razao_social\nF1,a\nF2\nF3,b,c\n")
    staged = csv.stage_text(spark, path, SUPPLIER)
    assert rows_of(staged.rows, "idfornecedor") == [("F1",)]
    assert rows_of(staged.ragged) == [("F2",), ("F3,b,c",)]


@pytest.mark.parametrize("column", ["idfornecedor", "*"])
def test_ragged_rows_are_seen_whatever_is_selected(spark, tmp_path, column):
    path = write(tmp_path, "idfornecedor,razao_social\nF1,a\nF2\nF3,b,c\n")
    lenient = csv.read_text(spark, path, SUPPLIER).where(F.col(csv.CORRUPT).isNull())
    assert lenient.select(column).collect()[0][0] == "F1"
    assert len(lenient.select(column).collect()) == 1
    with pytest.raises(Exception):
        csv.read_text(spark, path, SUPPLIER, strict=True).select(column).collect()


def test_renamed_header_is_noticed(spark, tmp_path):
    path = write(tmp_path, "codigo,razao_social\nF1,a\n")
    assert csv.read_text(spark, path, SUPPLIER).count() == 1
    with pytest.raises(Exception):
        csv.read_text(spark, path, SUPPLIER, strict=True, match_header=True).collect()


def test_line_break_inside_quotes(spark, tmp_path):
    path = write(tmp_path, 'idfornecedor,razao_social\nF1,"a\nb"\nF2,c\n')
    rows = csv.read_text(spark, path, SUPPLIER, multiline=True)
    assert rows_of(rows, "idfornecedor", "razao_social") == [("F1", "a\nb"), ("F2", "c")]


def test_text_survives_a_round_trip(spark, tmp_path):
    rows = [("F1", None), ("F2", ""), ("F3", ' "x", y '), (None, "z"), ("", None)]
    csv.write_text(spark.createDataFrame(rows, SUPPLIER.raw_schema), str(tmp_path / "out"))
    back = csv.stage_text(spark, str(tmp_path / "out"), SUPPLIER)
    assert rows_of(back.rows) == sorted(rows, key=lambda r: [str(v) for v in r])
    assert back.ragged.count() == 0


def test_sheet_split(spark, tmp_path):
    path = write(
        tmp_path,
        "a,d,e,,\n1,2025-01-02 00:00:00,2025-01-02 00:00:00,x,2025-01-02 00:00:00\n"
        "2,,2025-01-03,,\n3,2025-01-04 00:00:00,,,y\n",
    )
    tab = csv.read_sheet(spark, path)
    split = sheet.extract("tab", tab, 3)
    assert rows_of(split.table) == [
        ("1", "2025-01-02", "2025-01-02 00:00:00"), ("2", None, "2025-01-03"), ("3", "2025-01-04", None),
    ]
    assert rows_of(split.overflow) == [("x", "2025-01-02 00:00:00"), (None, "y")] or rows_of(split.overflow) == [
        (None, "y"), ("x", "2025-01-02 00:00:00"),
    ]
    plain = sheet.extract("plain", tab.select("a"), 1)
    assert rows_of(sheet.ingest_report([split, plain])) == [("plain", 3, 1, 1, 0, 0), ("tab", 3, 3, 5, 2, 2)]


def test_column_of_nulls_is_left_alone(spark):
    df = spark.createDataFrame([(None, "2025-01-02 00:00:00")], "a string, b string")
    assert rows_of(sheet.trim_midnights(df)) == [(None, "2025-01-02")]


@pytest.fixture
def raw(raw_frame):
    sales = [
        {
            "venda_id": str(i), "data_emissao": "2025-02-01", "horariomov": "08:00:00", "produto_id": "P1",
            "qtde_vendida": "2.5", "valor_unitario": "10.01", "filial_id": "1", "item": "1", "unidade_medida": "UN",
        }
        for i in range(4)
    ]
    sales[3]["qtde_vendida"] = "doze"
    given = {
        "supplier": [{"idfornecedor": "F1", "razao_social": "Um"}, {"idfornecedor": " ", "razao_social": "Dois"}],
        "branch_product": [
            {
                "filial_id": "1", "idproduto": p, "descricao": "x", "estoque": "1", "preco_unitario": "1",
                "preco_compra": "1", "preco_venda": "2", "idfornecedor": f,
            }
            for p, f in (("P1", "F1"), ("P2", "F7"))
        ],
        "sales": sales,
    }
    return RetailTables(**{n: raw_frame(n, given.get(n, [])) for n in TABLES})


def test_onboarding(spark, raw, tmp_path):
    done = warehouse.onboard(spark, raw, str(tmp_path / "wh"))
    assert rows_of(done.tables.branch_product, "idproduto", "idfornecedor_num") == [("P1", 1), ("P2", 2)]
    assert rows_of(done.tables.supplier, "idfornecedor", "fornecedor_num") == [("F1", 1), ("F7", 2)]
    assert done.tables.sales.count() == 3
    assert rows_of(done.quarantine["sales"], "venda_id", "_faults") == [(3, "ilegivel:qtde_vendida,nulo:qtde_vendida")]
    # A second run replaces the first.
    again = warehouse.onboard(spark, raw, str(tmp_path / "wh"))
    assert again.tables.sales.count() == 3 and again.tables.supplier.count() == 2


def test_load_counts_see_a_row_that_the_load_loses(raw, monkeypatch):
    whole = dict(rows_of(reconcile.load_counts(raw), "tabela", "final"))
    monkeypatch.setattr(reconcile, "load", lambda name, rows: load.load(name, rows).where("false"), raising=False)
    lost = dict(rows_of(reconcile.load_counts(raw), "tabela", "final"))
    assert any(whole.values()) and not any(lost.values())


def test_proofs(raw):
    typed = load.load_all(raw)
    assert ("supplier", 2, 1, 1) in rows_of(reconcile.row_count_differences(reconcile.row_counts(raw, typed)))
    assert rows_of(reconcile.load_counts(raw)) == rows_of(reconcile.row_counts(raw, typed))
    assert [str(v) for v in reconcile.financial_checksum(raw, typed).first()] == [
        "75.08", "75.08", "0.00", "1",
    ]
    traced = reconcile.trace_sales(raw, typed)
    assert traced.where("linhas_destino IS NULL").count() == 1
    assert reconcile.trace_document(raw, typed, 1).count() == 2


def test_amounts_that_change_places_within_a_key_show(raw_frame):
    base = {"data_emissao": "2025-02-01", "horariomov": " ", "produto_id": " P1 ", "filial_id": "1.0", "item": "1", "unidade_medida": "UN"}
    lines = [(1, "08:00:00", "2", "10"), (1, "09:00:00", "3.000", "20.5"), (2, " ", "1", "1"), (2, " ", "1", "1"), (3, " ", "4", "4")]
    rows = [{**base, "venda_id": str(v), "horariomov": h, "qtde_vendida": q, "valor_unitario": p} for v, h, q, p in lines]
    raw = RetailTables(**{n: raw_frame(n, rows if n == "sales" else []) for n in TABLES})
    typed = load.load_all(raw)
    assert reconcile.changed_sales(raw, typed).count() == 0
    assert {r["igual"] for r in reconcile.trace_sales(raw, typed).collect()} == {True}
    assert {r["igual"] for r in reconcile.sale_digests(raw, typed, 2).collect()} == {True}

    def altered(column, change):
        return typed.with_table("sales", typed.sales.withColumn(column, F.expr(change).cast(typed.sales.schema[column].dataType)))

    swapped = altered("qtde_vendida", "CASE WHEN horariomov = '08:00:00' THEN 3 WHEN horariomov = '09:00:00' THEN 2 ELSE qtde_vendida END")
    before, after = ({k: v for k, v in r.asDict().items() if k != "igual"} for r in (
        reconcile.trace_sales(raw, typed).where("venda_id = 1").first(), reconcile.trace_sales(raw, swapped).where("venda_id = 1").first()))
    assert before == after  # no sum, count, smallest or largest value tells
    assert rows_of(reconcile.changed_sales(raw, swapped), "venda_id", "linhas_origem", "linhas_destino") == [(1, 2, 2)]
    assert sum(not r["igual"] for r in reconcile.sale_digests(raw, swapped, 64).collect()) == 1
    for changed, key in (
        (altered("unidade_medida", "CASE WHEN venda_id = 3 THEN 'KG' ELSE unidade_medida END"), 3),
        (altered("venda_id", "CASE WHEN venda_id = 3 THEN 4 ELSE venda_id END"), 3),
        # One of two equal rows is lost, the other entered twice.
        (typed.with_table("sales", typed.sales.where("venda_id <> 2").unionByName(typed.sales.where("venda_id = 2").limit(1))), 2),
    ):
        assert (key,) in rows_of(reconcile.changed_sales(raw, changed), "venda_id")


def test_digests_are_sums_of_numbers_of_rows(spark):
    """Enough rows for a carry from one half of a sum to the other."""
    rows = spark.range(300).selectExpr("id", "id % 2 AS half")
    found = digests.digests(rows, [F.col("half")], digests.row_digest([F.col("id")]), "n").select("half", "n", digests.digest_text([F.col(c) for c in digests.SUMS]))
    md5 = [hashlib.md5(str(i).encode()).hexdigest() for i in range(300)]
    wanted = [(h, 150, ":".join(str(sum(int(d[at : at + 15], 16) for d in md5[h::2])) for at in (0, 15))) for h in (0, 1)]
    assert rows_of(found) == wanted


def test_traces_read_each_side_once_and_share_its_joins(spark):
    star = StarSchema(spark, "/root/testdata/sf0.001")
    raw, typed = star.raw, load.load_all(star.raw)
    for traced in (reconcile.changed_sales(raw, typed), reconcile.sale_digests(raw, typed), reconcile.trace_sales(raw, typed)):
        plan = traced._jdf.queryExecution().optimizedPlan().toString()
        kept = [re.sub(r"#\d+L?", "", line).strip(" :+-") for line in plan.splitlines() if "Filter" in line and "l_orderkey" in line and "97" in line]
        assert len(kept) == 2 and kept[0] == kept[1], kept


def test_digests_per_bucket_are_summed_as_longs(spark):
    star = StarSchema(spark, "/root/testdata/sf0.001")
    plan = reconcile.sale_digests(star.raw, load.load_all(star.raw))._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(shiftright(" in plan and "as decimal(20,0)" not in plan


def test_same_document_at_two_times(frame):
    base = {"venda_id": 1, "data_emissao": "2025-02-01", "produto_id": "P1", "filial_id": 1, "item": 1}
    sales = frame("sales", [{**base, "horariomov": h} for h in ("08:00:00", "09:00:00", "09:00:00")] + [{**base, "venda_id": 2}])
    assert rows_of(reconcile.repeated_documents(sales)) == [(1, 1, "P1", 1, 3, 2)]


def test_displaced_block_names_differences(spark, frame):
    base = {
        "item": 1, "produto_id": "P1", "descricao_produto": "x", "ordem_compra": 12, "qtde_pedida": 91, "filial_id": 1,
        "data_pedido": "2025-02-25", "data_entrega": "2025-02-20", "qtde_entregue": 48, "qtde_pendente": 43, "preco_compra": "6.92",
    }
    orders = frame(
        "purchase_order",
        [{**base, "pedido_id": 12}, {**base, "pedido_id": 21, "qtde_pedida": 12}, {**base, "pedido_id": 13, "produto_id": "P2", "ordem_compra": 0}],
    )
    text = spark.createDataFrame(
        [
            ("2025-02-25 00:00:00", "1", p, "x", "12", "91", "1", "2025-02-20 00:00:00", "48", pending, "6.92")
            for p, pending in (("P1", "43"), ("P2", "40"), ("P3", "43"))
        ],
        sheet.OVERFLOW_COLUMNS and ", ".join(f"`Unnamed: {12 + i}` string" for i in range(11)),
    )
    got = rows_of(reconcile.displaced_rows(sheet.typed_overflow(sheet.overflow_block(text)), orders))
    assert got[0] == (12, "P1", "", True, True)
    assert got[1] == (13, "P2", "ordem_compra", False, False)
    assert got[2][:2] == (None, "P3") and got[2][3] is False


def test_acceptance_needs_a_clean_board(tables):
    assert tuple(reconcile.acceptance(tables()).first()) == (0, 0, True)
    sold = tables(sales=[{"venda_id": 1, "produto_id": "P1", "filial_id": 1, "qtde_vendida": 1, "valor_unitario": 1}])
    assert tuple(reconcile.acceptance(sold).first()) == (2, 1, False)


def test_date_filter_reaches_the_files(spark, frame, tmp_path, capsys):
    sales = frame("sales", [{"venda_id": i, "data_emissao": f"2025-0{1 + i % 3}-01", "filial_id": 1} for i in range(30)])
    path = warehouse.write_table("sales", sales, str(tmp_path))
    back = spark.read.schema(SALES.typed_schema).parquet(path)
    back.where(F.col("data_emissao") >= F.to_date(F.lit("2025-02-01"))).select("venda_id").explain()
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(data_emissao,2025-02-01)" in plan
    assert "ReadSchema: struct<venda_id:bigint,data_emissao:date>" in plan


def test_checksum_shows_what_a_load_loses(raw_frame):
    """A word, a price that no column holds, and a quantity with five decimals."""
    base = {"data_emissao": "2025-02-01", "horariomov": "08:00:00", "produto_id": "P1", "filial_id": "1", "item": "1"}
    amounts = (("10", "2.00"), ("doze", "5.00"), ("1", "123456789012.00"), (" 1.23456 ", "1000"))
    sales = [
        {**base, "venda_id": str(i), "qtde_vendida": q, "valor_unitario": p} for i, (q, p) in enumerate(amounts, 1)
    ]
    raw = RetailTables(**{n: raw_frame(n, sales if n == "sales" else []) for n in TABLES})
    row = reconcile.financial_checksum(raw, load.load_all(raw)).first()
    assert str(row["total_origem"]) == "123456790266.56" and row["linhas_ilegiveis"] == 1
    assert row["diferenca"] == row["total_origem"] - row["total_destino"] > 123456789000
    left_out = rows_of(load.quarantine(raw), "tabela", "motivo")
    assert left_out == [("sales", "ilegivel:qtde_vendida"), ("sales", "ilegivel:valor_unitario")]


def test_side_file_holds_the_block_without_headings(spark, tmp_path):
    tab = spark.createDataFrame([("1", "a", "x"), ("2", "b", None)], "`id` string, `name` string, `Unnamed: 2` string")
    path = sheet.write_side_file(sheet.extract("pedido_compra", tab, 2), str(tmp_path))
    assert rows_of(csv.read_sheet(spark, path)) == [("x",)]
    assert sheet.write_side_file(sheet.extract("venda", tab.drop("Unnamed: 2"), 2), str(tmp_path)) is None


def test_stored_suppliers_say_when(spark, raw, tmp_path):
    warehouse.onboard(spark, raw, str(tmp_path / "wh"))
    stored = spark.read.parquet(str(tmp_path / "wh/typed/supplier"))
    assert stored.where("criado_em IS NOT NULL").count() == 2


def test_stored_lines_give_the_same_tables_from_one_join(spark):
    star = StarSchema(spark, "/root/testdata/sf0.001")
    stored = star.with_stored_lines()
    for name in ("sales", "purchase_order"):
        for ours, theirs in ((stored.typed[name], star.typed[name]), (stored.raw[name], star.raw[name])):
            assert all("/lines-" in file for file in ours.inputFiles())
            assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()


def test_joins_are_cut_by_the_size_of_files(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id AS k", "id % 7 AS v").write.parquet(str(tmp_path / "facts"))
    facts, side = spark.read.parquet(str(tmp_path / "facts")), spark.range(1000).selectExpr("id AS k")
    assert session.spread(side, ["k"], facts) is side  # small files: the session's own number
    monkeypatch.setattr(session, "FILE_BYTES_PER_TASK", 100)
    assert session.spread(side, ["k"], facts).rdd.getNumPartitions() > 8
