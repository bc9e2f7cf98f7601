"""Constraints as checks, with the NULL rules of SQL."""

from decimal import Decimal

from conftest import rows_of

from ledgerloom.model.schema import BRANCH_PRODUCT, PURCHASE_ORDER, SALES, SUPPLIER, ForeignKey, Table
from ledgerloom.model.tables import RetailTables
from ledgerloom.operators import integrity
from ledgerloom.sources.bucketed import bucketed

PRODUCT = {
    "filial_id": 1, "idproduto": "P1", "descricao": "x", "estoque": 1,
    "preco_unitario": 1, "preco_compra": 1, "preco_venda": 1,
}
SALE = {
    "venda_id": 1, "data_emissao": "2025-01-11", "horariomov": "08:00:00", "produto_id": "P1",
    "qtde_vendida": 5, "valor_unitario": 1, "filial_id": 1, "item": 1,
}


def test_keys_repeated_or_incomplete(frame):
    orders = frame(
        "purchase_order",
        [
            {"pedido_id": 1, "produto_id": "P1", "item": 1},
            {"pedido_id": 1, "produto_id": "P1", "item": 1},
            {"pedido_id": 2, "produto_id": "P1", "item": 1},
            {"pedido_id": None, "produto_id": "P1", "item": 1},
        ],
    )
    assert rows_of(integrity.key_violations(PURCHASE_ORDER, orders)) == [
        ("purchase_order", "1|P1|1", "CHAVE REPETIDA", 2),
        ("purchase_order", "?|P1|1", "CHAVE NULA", 1),
    ]


def test_unique_ignores_null(frame):
    suppliers = frame(
        "supplier",
        [{"idfornecedor": c, "fornecedor_num": n} for c, n in (("A", 1), ("B", 1), ("C", None), ("D", None))],
    )
    assert rows_of(integrity.unique_violations(SUPPLIER, suppliers)) == [
        ("supplier", "fornecedor_num", "1", 2)
    ]


def test_checks_pass_on_null(tables):
    found = integrity.check_violations(
        tables(
            purchase_order=[
                {"pedido_id": 1, "produto_id": "P", "item": 1, "qtde_pedida": None, "preco_compra": None},
                {"pedido_id": 2, "produto_id": "P", "item": 1, "qtde_pedida": -1, "preco_compra": -1},
            ],
            supplier=[{"idfornecedor": "F1", "razao_social": "  "}],
        )
    )
    assert rows_of(found) == [
        ("purchase_order", "preco_compra_nao_negativo", "2|P|1"),
        ("purchase_order", "qtde_pedida_nao_negativa", "2|P|1"),
        ("supplier", "razao_social_preenchida", "F1"),
    ]


def test_reference_passes_on_null_part(tables):
    t = tables(
        branch_product=[PRODUCT],
        sales=[
            SALE,
            {**SALE, "produto_id": "P9"},
            {**SALE, "produto_id": "P9", "venda_id": 2},
            {**SALE, "filial_id": None, "produto_id": "P9"},
        ],
    )
    fk = SALES.foreign_keys[0]
    assert rows_of(integrity.missing_parents(fk, t.sales, t.branch_product)) == [(1, "P9", 2)]
    assert integrity.orphans(fk, t.sales, t.branch_product).count() == 2
    assert rows_of(integrity.validate(fk, t.sales, t.branch_product)) == [("venda_produto", 2, False)]
    judged = integrity.admit(fk, t.sales, t.branch_product)
    assert judged.where("aceito").count() == 2
    assert judged.count() == t.sales.count()


def test_gate_leaves_history_alone(tables):
    """Old orphans stay stored; the same product in a new batch is set aside."""
    history = tables(sales=[{**SALE, "produto_id": "P9"}], branch_product=[PRODUCT])
    batch = tables(sales=[{**SALE, "venda_id": 2}, {**SALE, "venda_id": 3, "produto_id": "P9"}]).sales
    judged = integrity.admit(SALES.foreign_keys[0], batch, history.branch_product)
    stored = history.sales.unionByName(judged.where("aceito").drop("aceito"))
    assert rows_of(stored, "venda_id") == [(1,), (2,)]


def test_cascade(spark, tables):
    products = tables(
        branch_product=[{**PRODUCT, "idproduto": p, "idfornecedor": f} for p, f in
                        (("P1", "F1"), ("P2", "F2"), ("P3", "F3"), ("P4", None))]
    ).branch_product
    changes = spark.createDataFrame([("F1", "F100"), ("F2", None)], "old string, new string")
    assert rows_of(integrity.cascade(products, "idfornecedor", changes), "idproduto", "idfornecedor") == [
        ("P1", "F100"),
        ("P2", None),
        ("P3", "F3"),
        ("P4", None),
    ]


def test_one_change_of_a_supplier_reaches_three_columns_in_two_tables(spark, tables):
    t = tables(
        supplier=[{"idfornecedor": f"F{i}", "fornecedor_num": i, "razao_social": "x"} for i in range(1, 6)],
        branch_product=[{**PRODUCT, "idproduto": f"P{i}", "idfornecedor": f"F{i}", "idfornecedor_num": i} for i in range(1, 6)]
        + [{**PRODUCT, "idproduto": "P9", "idfornecedor": "F1", "idfornecedor_num": 2}, {**PRODUCT, "idproduto": "P10"}],
        purchase_order=[{"pedido_id": i, "item": 1, "produto_id": "P1", "fornecedor_id": i if i < 6 else None} for i in range(1, 7)],
    )
    rows = [("F1", "F100", 1, 100), ("F2", None, 2, None), ("F3", "F3", 3, 30), ("F4", "F40", 4, 4)]
    changes = spark.createDataFrame(rows, "old_idfornecedor string, new_idfornecedor string, old_fornecedor_num int, new_fornecedor_num int")
    after = integrity.cascade_all(t, {"supplier": changes})
    assert rows_of(after.supplier, "idfornecedor", "fornecedor_num") == [("F100", 100), ("F3", 30), ("F40", 4), ("F5", 5)]
    assert rows_of(after.branch_product, "idproduto", "idfornecedor", "idfornecedor_num") == [
        ("P1", "F100", 100),
        ("P10", None, None),
        ("P2", None, None),
        ("P3", "F3", 30),
        ("P4", "F40", 4),
        ("P5", "F5", 5),
        ("P9", "F100", None),
    ]
    assert rows_of(after.purchase_order, "pedido_id", "fornecedor_id") == [(1, 100), (2, None), (3, 30), (4, 4), (5, 5), (6, None)]
    assert after.branch_product.columns == t.branch_product.columns
    untouched = integrity.cascade_all(t, {})
    assert untouched.branch_product is t.branch_product


def test_changes_are_carried_on_to_children_of_children(spark):
    """A key that follows its parent takes its own children along."""

    def table(name, columns, key, *fks):
        return Table(name=name, file=name, raw_columns=columns, columns=(), key=key, row_key=columns[0], foreign_keys=fks)

    declared = {
        t.name: t
        for t in (
            table("grand", ("g",), ("g",)),
            table("parent", ("g", "p"), ("g", "p"), ForeignKey("pg", ("g",), "grand", ("g",), cascades=True)),
            table("child", ("cg", "cp"), ("cg", "cp"), ForeignKey("cp", ("cg", "cp"), "parent", ("g", "p"), cascades=True)),
        )
    }
    data = {"grand": [("a",), ("b",)], "parent": [("a", 1), ("b", 1), ("b", 2)], "child": [("a", 1), ("b", 1), ("b", 1), ("z", 1)]}
    names = {"grand": "g string", "parent": "g string, p int", "child": "cg string, cp int"}
    tables_ = RetailTables(**{n: spark.createDataFrame(r, names[n]) for n, r in data.items()})
    changes = spark.createDataFrame([("b", "c")], "old_g string, new_g string")
    after = integrity.cascade_all(tables_, {"grand": changes}, declared)
    assert rows_of(after["grand"]) == [("a",), ("c",)]
    assert rows_of(after["parent"]) == [("a", 1), ("c", 1), ("c", 2)]
    assert rows_of(after["child"]) == [("a", 1), ("c", 1), ("c", 1), ("z", 1)]


def test_default_answers_omission_only(spark):
    batch = spark.createDataFrame([(1, "P1", None)], "filial_id int, idproduto string, preco_venda decimal(12,4)")
    row = integrity.fill_omitted(BRANCH_PRODUCT, batch).first()
    assert row["preco_venda"] is None
    assert row["preco_compra"] == Decimal("0.0000")
    assert row["descricao"] is None


def test_report_only_rules(tables):
    t = tables(
        branch_product=[PRODUCT, {**PRODUCT, "preco_venda": 0}, {**PRODUCT, "preco_venda": None}],
        purchase_order=[{"data_pedido": "2025-01-02", "data_entrega": "2025-01-01"}, {"data_pedido": "2025-01-02"}],
    )
    assert rows_of(integrity.report_only(t), "regra", "ocorrencias") == [
        ("entrega_apos_pedido", 1),
        ("margem_nao_negativa", 1),
    ]


def test_domain_report_counts_width_and_digits(raw_frame):
    from ledgerloom.model.schema import TABLES
    from ledgerloom.model.tables import RetailTables

    rows = {"sales": [{"unidade_medida": "CAIXA", "valor_unitario": "99999999.99995"}, {"unidade_medida": "UN "}]}
    raw = RetailTables(**{n: raw_frame(n, rows.get(n, [])) for n in TABLES})
    found = integrity.domain_report(raw).where("ocorrencias > 0")
    assert rows_of(found, "coluna", "regra", "ocorrencias") == [
        ("unidade_medida", "ate 3 caracteres", 1),
        ("valor_unitario", "8 digitos inteiros", 1),
    ]


def test_key_checks_of_bucketed_tables_move_no_rows(tables, tmp_path):
    t = tables(
        sales=[{**SALE, "venda_id": i, "produto_id": f"P{i % 7}"} for i in range(40)],
        branch_product=[{**PRODUCT, "idproduto": f"P{i}"} for i in range(5)],
    )
    fk = SALES.foreign_keys[0]
    stored = bucketed(t, 4, str(tmp_path))
    checked = integrity.validate(fk, stored.sales, stored.branch_product)
    assert rows_of(checked) == rows_of(integrity.validate(fk, t.sales, t.branch_product))
    missing = integrity.missing_parents(fk, stored.sales, stored.branch_product)
    for df in (missing, integrity.duplicate_keys(stored.branch_product, BRANCH_PRODUCT.key)):
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows_of(missing, "produto_id", "linhas") == [("P5", 5), ("P6", 5)]
