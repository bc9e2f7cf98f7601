"""Supplier resolution, branch by branch."""

import random

import pytest
from conftest import rows_of

from ledgerloom.operators import resolve
from ledgerloom.operators.numbering import NumberMark

SCHEMA = (
    "seq bigint, op string, filial_id int, idproduto string, old_idfornecedor string,"
    " old_idfornecedor_num int, new_idfornecedor string, new_idfornecedor_num int"
)


@pytest.fixture
def suppliers(frame):
    return frame(
        "supplier",
        [{"idfornecedor": f"F{i}", "fornecedor_num": i, "razao_social": f"Fornecedor {i}"} for i in range(1, 21)],
    )


@pytest.fixture
def outcome(spark, suppliers):
    def run(*events):
        data = [(i, op, 1, product, *old, *new) for i, (op, product, old, new) in enumerate(events)]
        return resolve.resolve(spark.createDataFrame(data, SCHEMA), suppliers)

    return run


NONE = (None, None)


def one(result):
    row = result.events.first()
    return row["ramo"], row["idfornecedor"], row["idfornecedor_num"]


@pytest.mark.parametrize(
    "op, old, new, expected",
    [
        ("INSERT", NONE, ("F5", None), ("CODIGO", "F5", 5)),
        ("INSERT", NONE, ("F99", None), ("CODIGO NOVO", "F99", 21)),
        ("UPDATE", ("F5", 5), ("F12", 5), ("CODIGO", "F12", 12)),
        ("UPDATE", ("F12", 12), ("F12", 3), ("NUMERO", "F3", 3)),
        ("UPDATE", ("F3", 3), ("F3", 9999), ("RECUSADO", None, None)),
        # both changed: the code decides
        ("UPDATE", ("F5", 5), ("F7", 9), ("CODIGO", "F7", 7)),
        # number cleared: found again from the code
        ("UPDATE", ("F5", 5), ("F5", None), ("CODIGO", "F5", 5)),
        # padded, blank and missing codes
        ("INSERT", NONE, ("  F5 ", None), ("CODIGO", "F5", 5)),
        ("INSERT", NONE, ("   ", None), ("VAZIO", None, None)),
        ("UPDATE", ("F5", 5), (None, 5), ("VAZIO", None, None)),
        ("INSERT", NONE, (None, 4), ("NUMERO", "F4", 4)),
        # an insert with a pair that does not belong together keeps it
        ("INSERT", NONE, ("F5", 4), ("NUMERO", "F5", 4)),
        # nothing changed, number missing: backfill
        ("UPDATE", ("F6", None), ("F6", None), ("CODIGO", "F6", 6)),
    ],
)
def test_branches(outcome, op, old, new, expected):
    assert one(outcome((op, "P1", old, new))) == expected


def test_one_registration_for_many_rows(outcome):
    result = outcome(*[("INSERT", f"P{i}", NONE, (code, None)) for i, code in enumerate(["F99", " F99", "F98", "F99"])])
    assert rows_of(result.new_suppliers) == [
        ("F98", 22, "FORNECEDOR PENDENTE DE CADASTRO - F98"),
        ("F99", 21, "FORNECEDOR PENDENTE DE CADASTRO - F99"),
    ]
    assert rows_of(result.events, "seq", "ramo", "idfornecedor_num") == [
        (0, "CODIGO NOVO", 21), (1, "CODIGO", 21), (2, "CODIGO NOVO", 22), (3, "CODIGO", 21),
    ]
    assert result.notices.count() == 2


def test_rejection_names_number_product_and_branch(outcome):
    rejected = outcome(("UPDATE", "P7", ("F3", 3), ("F3", 9999))).rejected
    assert rejected.first()["motivo"] == "idfornecedor_num 9999 nao existe em fornecedor (produto P7, filial 1)"


def test_last_accepted_event_decides(outcome):
    result = outcome(
        ("INSERT", "P1", NONE, ("F5", None)),
        ("UPDATE", "P1", ("F5", 5), ("F12", 5)),
        ("UPDATE", "P1", ("F12", 12), ("F12", 9999)),
        ("INSERT", "P2", NONE, ("F1", None)),
    )
    assert rows_of(result.final_state) == [(1, "P1", "F12", 12), (1, "P2", "F1", 1)]


def test_resolving_twice_changes_nothing(outcome, spark, suppliers):
    first = outcome(("INSERT", "P1", NONE, ("F99", None)))
    grown = suppliers.unionByName(first.new_suppliers)
    again = resolve.resolve(
        spark.createDataFrame([(0, "INSERT", 1, "P1", None, None, "F99", None)], SCHEMA), grown
    )
    assert again.new_suppliers.count() == 0
    assert one(again) == ("CODIGO", "F99", 21)


def test_backfill_and_coverage(tables, suppliers):
    base = {"descricao": "x", "estoque": 1, "preco_unitario": 1, "preco_compra": 1, "preco_venda": 1, "filial_id": 1}
    products = tables(
        branch_product=[
            {**base, "idproduto": "P1", "idfornecedor": "F2"},
            {**base, "idproduto": "P2", "idfornecedor": "F3", "idfornecedor_num": 9},
            {**base, "idproduto": "P3", "idfornecedor": "F50"},
            {**base, "idproduto": "P4"},
        ]
    ).branch_product
    assert rows_of(resolve.link_coverage(products)) == [(4, 1, 3)]
    filled, registered = resolve.backfill(products, suppliers)
    assert rows_of(filled, "idproduto", "idfornecedor", "idfornecedor_num") == [
        ("P1", "F2", 2),
        ("P2", "F3", 9),
        ("P3", "F50", 21),
        ("P4", None, None),
    ]
    assert rows_of(registered, "idfornecedor") == [("F50",)]
    assert rows_of(resolve.link_coverage(filled)) == [(4, 3, 1)]
    assert rows_of(resolve.mismatched_pairs(filled, suppliers), "idproduto", "dono_do_numero") == [("P2", "F9")]


def test_apply_keeps_products_without_events_and_adds_new_ones(outcome, tables):
    base = {"descricao": "x", "estoque": 1, "filial_id": 1}
    products = tables(
        branch_product=[
            {**base, "idproduto": "P1", "idfornecedor": "F5", "idfornecedor_num": 5},
            {**base, "idproduto": "P2", "idfornecedor": "F6", "idfornecedor_num": 6},
        ]
    ).branch_product
    result = outcome(("UPDATE", "P1", ("F5", 5), (None, 5)), ("INSERT", "P3", NONE, ("F7", None)))
    assert rows_of(resolve.apply_to_products(products, result), "idproduto", "idfornecedor", "idfornecedor_num") == [
        ("P1", None, None),
        ("P2", "F6", 6),
        ("P3", "F7", 7),
    ]


def test_a_number_counts_from_the_event_that_registered_it(outcome):
    result = outcome(
        ("INSERT", "P1", NONE, (None, 21)),  # not there yet
        ("INSERT", "P2", NONE, ("F99", None)),  # registers 21
        ("INSERT", "P3", NONE, (None, 21)),
        ("UPDATE", "P4", ("F1", 1), ("F1", 21)),
        ("INSERT", "P5", NONE, (None, 22)),
        ("INSERT", "P6", NONE, ("F50", None)),  # registers 22
        ("INSERT", "P7", NONE, ("F2", 22)),  # a pair that does not belong together stays
    )
    assert rows_of(result.events, "seq", "ramo", "idfornecedor", "idfornecedor_num") == [
        (0, "RECUSADO", None, None),
        (1, "CODIGO NOVO", "F99", 21),
        (2, "NUMERO", "F99", 21),
        (3, "NUMERO", "F99", 21),
        (4, "RECUSADO", None, None),
        (5, "CODIGO NOVO", "F50", 22),
        (6, "NUMERO", "F2", 22),
    ]


def one_by_one(events, register):
    """The rule applied to one event after the other, as a trigger would."""
    register, found = dict(register), []
    for seq, op, _, _, old_code, old_num, code, num in events:
        text_changed, number_changed = (op == "UPDATE" and a != b for a, b in ((code, old_code), (num, old_num)))
        if text_changed:
            num = None
        if num is not None:
            owner = next((c for c, n in register.items() if n == num), None)
            if owner is None:
                found.append((seq, "RECUSADO", None, None))
            else:
                found.append((seq, "NUMERO", owner if code is None or number_changed else code, num))
            continue
        code = (code or "").strip(" ") or None
        if code is None:
            found.append((seq, "VAZIO", None, None))
            continue
        branch = "CODIGO" if code in register else "CODIGO NOVO"
        register.setdefault(code, max(register.values()) + 1)
        found.append((seq, branch, code, register[code]))
    return found, register


@pytest.mark.parametrize("seed", range(3))
def test_random_events_as_one_by_one(spark, suppliers, seed):
    draw = random.Random(seed)
    codes = [None, "", " ", *[f"F{i}" for i in (1, 2, 3, 30, 31, 32, 33, 34)], " F30", "F31 "]
    numbers = [None, None, 1, 2, 20, *range(21, 28)]
    events = []
    for seq in draw.sample(range(1000), 150):
        old = (draw.choice(codes), draw.choice(numbers)) if draw.random() < 0.6 else (None, None)
        new = (draw.choice([draw.choice(codes), old[0]]), draw.choice([draw.choice(numbers), old[1]]))
        events.append((seq, draw.choice(["INSERT", "UPDATE"]), 1, f"P{draw.randrange(30)}", *old, *new))
    result = resolve.resolve(spark.createDataFrame(events, SCHEMA).repartition(4), suppliers)
    expected, register = one_by_one(sorted(events), {f"F{i}": i for i in range(1, 21)})
    assert rows_of(result.events, "seq", "ramo", "idfornecedor", "idfornecedor_num") == sorted(expected, key=lambda r: [str(v) for v in r])
    assert dict(rows_of(result.new_suppliers, "idfornecedor", "fornecedor_num")) == {c: n for c, n in register.items() if n > 20}


def test_numbers_are_never_handed_out_twice(spark, suppliers, tmp_path):
    """The largest supplier is registered, removed, and its number stays used."""
    mark = NumberMark(spark, str(tmp_path))
    assert mark.last() == 0
    insert = [(0, "INSERT", 1, "P1", None, None, "F99", None)]
    first = resolve.resolve(spark.createDataFrame(insert, SCHEMA), suppliers, mark.last()).new_suppliers
    assert rows_of(first, "idfornecedor", "fornecedor_num") == [("F99", 21)]
    mark.advance(21, step=0)
    # F99 is deleted: the register is what it was before.
    again = resolve.resolve(spark.createDataFrame(insert, SCHEMA), suppliers, mark.last()).new_suppliers
    assert rows_of(again, "idfornecedor", "fornecedor_num") == [("F99", 22)]
    mark.advance(22, step=1)
    assert (mark.last(), mark.last(before=1), mark.last(before=0)) == (22, 21, 0)
    mark.restart(20)
    assert mark.last() == 20
