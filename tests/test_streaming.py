"""Streams over several arrivals, and batches that run twice."""

import random
from datetime import date, datetime

import pytest
from conftest import rows_of

from ledgerloom.model.schema import SALES
from ledgerloom.operators.resolve import resolve
from ledgerloom.plans import quality
from ledgerloom.plans.increments import RunningScoreboard
from ledgerloom.streaming.gate import ReferenceGate
from ledgerloom.streaming.history import record, trend
from ledgerloom.streaming.reprocessed import RepeatAlerts, repeated_keys
from ledgerloom.streaming.suppliers import SupplierStream

CHANGES = (
    "seq bigint, op string, filial_id int, idproduto string, old_idfornecedor string,"
    " old_idfornecedor_num int, new_idfornecedor string, new_idfornecedor_num int"
)


def _arrive(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_gate_over_two_arrivals_with_a_parent_added_between(spark, frame, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = {"filial_id": 1, "item": 1, "data_emissao": "2025-02-01"}
    first = frame("sales", [{**base, "venda_id": i, "produto_id": p} for i, p in ((1, "P1"), (2, "P2"))])
    second = frame("sales", [{**base, "venda_id": i, "produto_id": p} for i, p in ((3, "P2"), (4, "P9"))])
    catalogue = str(tmp_path / "cat")
    frame("branch_product", [{"filial_id": 1, "idproduto": "P1"}]).write.parquet(catalogue)
    _arrive(first, inbox)

    def run():
        gate = ReferenceGate(SALES.foreign_keys[0], lambda: spark.read.parquet(catalogue), out)
        gate.run(_stream(spark, first.schema, inbox))
        return gate.rows(first)

    assert rows_of(run(), "venda_id", "aceito") == [(1, True), (2, False)]
    frame("branch_product", [{"filial_id": 1, "idproduto": "P2"}]).write.mode("append").parquet(catalogue)
    _arrive(second, inbox)
    assert rows_of(run(), "venda_id", "aceito") == [(1, True), (2, False), (3, True), (4, False)]
    assert run().count() == 4  # nothing new: nothing stored again


def test_parent_added_between_two_batches_of_one_run(spark, frame, tmp_path):
    inbox, out, catalogue = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cat")
    base = {"filial_id": 1, "item": 1, "data_emissao": "2025-02-01", "produto_id": "P2"}
    frame("branch_product", [{"filial_id": 1, "idproduto": "P1"}]).write.parquet(catalogue)
    for i in (1, 2):
        _arrive(frame("sales", [{**base, "venda_id": i}]), inbox)

    def parents():
        """What is there now; afterwards the product arrives."""
        now = spark.read.parquet(catalogue)
        if now.where("idproduto = 'P2'").isEmpty():
            frame("branch_product", [{"filial_id": 1, "idproduto": "P2"}]).write.mode("append").parquet(catalogue)
        return now

    schema = frame("sales", []).schema
    gate = ReferenceGate(SALES.foreign_keys[0], parents, out)
    gate.run(_stream(spark, schema, inbox))
    assert sorted(r["aceito"] for r in gate.rows(frame("sales", [])).collect()) == [False, True]


def test_supplier_stream_numbers_once_and_replays_alike(spark, frame, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    suppliers = frame("supplier", [{"idfornecedor": "F1", "fornecedor_num": 1, "razao_social": "Um"}])
    for seq, codes in ((0, ["F9", "F8", "F1"]), (10, ["F9", "F7"])):
        events = [(seq + i, "INSERT", 1, f"P{seq + i}", None, None, c, None) for i, c in enumerate(codes)]
        _arrive(spark.createDataFrame(events, CHANGES), inbox)
    schema = spark.createDataFrame([], CHANGES).schema
    job = SupplierStream(suppliers, out)
    job.run(_stream(spark, schema, inbox))
    register = rows_of(job.suppliers(), "idfornecedor", "fornecedor_num")
    assert sorted(n for _, n in register) == [1, 2, 3, 4]
    numbers = dict(register)
    got = {r["new_idfornecedor"]: r["idfornecedor_num"] for r in job.events(schema).collect()}
    assert got == numbers

    # Batch 1 again, as after a failure between its two writes.
    replay = job.events(schema).where("batch = 1").select(*schema.names)
    replay = spark.createDataFrame(replay.collect(), schema)
    job._resolve(replay, 1)
    assert rows_of(job.suppliers(), "idfornecedor", "fornecedor_num") == register
    assert job.events(schema).count() == 5


def test_stream_and_batch_resolve_alike(spark, frame, tmp_path):
    suppliers = frame("supplier", [{"idfornecedor": "F1", "fornecedor_num": 1, "razao_social": "Um"}])
    events = [
        (0, "INSERT", 1, "P1", None, None, " F1 ", None),
        (1, "UPDATE", 1, "P1", "F1", 1, "F5", 1),
        (2, "UPDATE", 1, "P2", "F1", 1, "F1", 77),
    ]
    changes = spark.createDataFrame(events, CHANGES)
    _arrive(changes, str(tmp_path / "in"))
    job = SupplierStream(suppliers, str(tmp_path / "out"))
    job.run(_stream(spark, changes.schema, str(tmp_path / "in")))
    batch = resolve(changes, suppliers).events
    assert rows_of(job.events(changes.schema).drop("batch"), *batch.columns) == rows_of(batch)


def test_repeats_across_arrivals(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc bigint, at timestamp_ntz"
    for rows in (
        ["(1, timestamp_ntz'2025-02-01 08:00:00')", "(2, timestamp_ntz'2025-02-01 09:00:00')"],
        ["(1, timestamp_ntz'2025-02-01 23:59:59')", "(2, timestamp_ntz'2025-02-02 00:00:00')"],
        ["(1, timestamp_ntz'2025-02-01 10:00:00')"],
    ):
        _arrive(spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(doc, at)").selectExpr("CAST(doc AS BIGINT) doc", "at"), inbox)
    counts = repeated_keys(_stream(spark, schema, inbox), ["doc"], "at")
    alerts = RepeatAlerts(["doc"], out)
    alerts.run(counts)
    assert rows_of(alerts.alerts(counts)) == [(date(2025, 2, 1), 1, 3, 3)]


def _documents(spark, rows, folder):
    values = ", ".join(f"({'NULL' if d is None else d}, timestamp_ntz'{at}')" if at else f"({d}, NULL)" for d, at in rows)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t(doc, at)").selectExpr("CAST(doc AS BIGINT) doc", "CAST(at AS TIMESTAMP_NTZ) at")
    _arrive(df, folder)
    return df.schema


def test_late_rows_are_told_over_restarts(spark, tmp_path):
    """Every arrival is a run of its own that goes on from the checkpoint."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrivals = [
        [(1, "2025-02-01 08:00:00"), (2, "2025-02-01 09:00:00"), (None, "2025-02-01 09:00:00"), (3, None)],
        # The day before is open for two more days; a repeated second is one time.
        [(1, "2025-02-01 08:00:00.5"), (1, "2025-02-01 23:59:59"), (None, "2025-02-01 10:00:00"), (9, "2025-02-04 00:00:00")],
        # Now it is closed, and its rows are late, also a document's first; the third of February is not.
        [(1, "2025-02-01 12:00:00"), (4, "2025-02-01 12:00:00"), (1, "2025-02-03 12:00:00"), (1, "2025-02-03 12:00:00")],
        [(1, "2025-02-03 13:00:00"), (9, "2025-02-09 00:00:00")],
        [(1, "2025-02-03 14:00:00")],
    ]
    late = []
    for rows in arrivals:
        schema = _documents(spark, rows, inbox)
        alerts = RepeatAlerts(["doc"], out)
        found = repeated_keys(_stream(spark, schema, inbox), ["doc"], "at")
        alerts.run(found)
        late.append(alerts.late(found).count())
    assert late == [0, 0, 2, 2, 3]
    assert rows_of(alerts.late(found), "doc", "dia", "horario") == [
        (1, date(2025, 2, 1), datetime(2025, 2, 1, 12)),
        (1, date(2025, 2, 3), datetime(2025, 2, 3, 14)),
        (4, date(2025, 2, 1), datetime(2025, 2, 1, 12)),
    ]
    assert rows_of(alerts.alerts(found)) == [
        (date(2025, 2, 1), 1, 3, 2),
        (date(2025, 2, 1), None, 2, 2),
        (date(2025, 2, 3), 1, 3, 2),
    ]


def test_state_of_closed_days_is_dropped(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(i, "2025-02-01 08:00:00") for i in range(20)], [(0, "2025-02-07 08:00:00")]):
        schema = _documents(spark, rows, inbox)
        alerts = RepeatAlerts(["doc"], out)
        alerts.run(repeated_keys(_stream(spark, schema, inbox), ["doc"], "at"))
    state = spark.read.format("statestore").option("stateVarName", "days").load(f"{out}/checkpoint")
    assert rows_of(state.selectExpr("key.doc", "user_map_key.dia")) == [(0, (date(2025, 2, 7) - date(1970, 1, 1)).days)]


@pytest.mark.parametrize("delay, held", [("2 days", [5, 6, 7]), ("47 hours 59 minutes", [6, 7]), ("1 month", [1, 4, 5, 6, 7])])
def test_days_that_a_batch_closes_are_told_but_not_stored(spark, tmp_path, delay, held):
    """Also before the watermark moves, the state is no larger than the open days; later rows of the others are late."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    days = [1, 1, 4, 5, 5, 6, 7]
    alerts = RepeatAlerts(["doc"], out)
    for rows in ([(1, f"2025-02-{d:02} 23:59:59") for d in days], [(1, f"2025-02-{d:02} 10:00:00") for d in (4, 6)]):
        schema = _documents(spark, rows, inbox)
        found = repeated_keys(_stream(spark, schema, inbox), ["doc"], "at", delay)
        alerts.run(found)
    state = spark.read.format("statestore").option("stateVarName", "days").option("batchId", 0).load(f"{out}/checkpoint")
    assert sorted(r.dia - (date(2025, 1, 31) - date(1970, 1, 1)).days for r in state.select("user_map_key.dia").collect()) == held
    late = [4] if delay != "1 month" else []
    assert rows_of(alerts.late(found), "dia") == [(date(2025, 2, d),) for d in late]
    repeated = {1: (2, 1), 5: (2, 1), 6: (2, 2)} | ({} if late else {4: (2, 2)})
    assert rows_of(alerts.alerts(found), "dia", "ocorrencias", "horarios_distintos") == [(date(2025, 2, d), *repeated[d]) for d in sorted(repeated)]


@pytest.mark.parametrize("delay", ["2 days", "47 hours 59 minutes", "1 month"])
def test_documents_that_share_a_group_have_the_same_alerts(spark, tmp_path, delay):
    """Three groups for sixty documents, some without a number, against a group for each, over runs that go on."""
    draw = random.Random(3)
    inbox = str(tmp_path / "in")
    outs = {n: str(tmp_path / f"out{n}") for n in (None, 1, 3)}
    for first in (1, 4, 9, 2):
        rows = [(draw.choice([None, *range(60)]), f"2025-02-{first + draw.randrange(4):02} {draw.randrange(24):02}:00:00") for _ in range(200)]
        schema = _documents(spark, rows, inbox)
        for n, out in outs.items():
            RepeatAlerts(["doc"], out).run(repeated_keys(_stream(spark, schema, inbox), ["doc"], "at", delay, buckets=n))
    like = repeated_keys(_stream(spark, schema, inbox), ["doc"], "at", delay)
    found = [(rows_of(alerts.alerts(like)), rows_of(alerts.late(like))) for alerts in (RepeatAlerts(["doc"], out) for out in outs.values())]
    assert found[0] == found[1] == found[2] and found[0][0]
    assert bool(found[0][1]) == (delay != "1 month")


def test_state_of_shared_groups_holds_open_days_only(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    held = []
    for rows in (
        [(i, f"2025-02-{d:02} 08:00:00") for i in range(20) for d in (1, 6, 7)],
        [(0, "2025-02-08 08:00:00")],
        [(0, "2025-02-20 08:00:00")],
    ):
        schema = _documents(spark, rows, inbox)
        RepeatAlerts(["doc"], out).run(repeated_keys(_stream(spark, schema, inbox), ["doc"], "at", buckets=4))
        state = spark.read.format("statestore").option("stateVarName", "days").load(f"{out}/checkpoint")
        held.append(rows_of(state.groupBy("list_element.dia").count().selectExpr("dia - datediff('2025-01-31', '1970-01-01')", "`count`")))
    # All groups but one of the second arrival get no more rows: timers drop their days.
    assert held == [[(6, 20), (7, 20)], [(6, 20), (7, 20), (8, 1)], [(20, 1)]]


def test_history_of_the_scoreboard(spark, tables, tmp_path):
    folder = str(tmp_path / "runs")
    empty = tables()
    dirty = tables(purchase_order=[{"pedido_id": 1, "ordem_compra": 0}, {"pedido_id": 2, "ordem_compra": 0}])
    record(empty, date(2025, 1, 1), folder)
    record(empty, date(2025, 1, 2), folder)
    record(dirty, date(2025, 1, 2), folder)  # the same day again
    runs = trend(spark, folder)
    assert runs.count() == 22
    assert rows_of(runs.where("cod = 'QA-04'"), "data_execucao", "ocorrencias", "variacao") == [
        (date(2025, 1, 1), 0, None),
        (date(2025, 1, 2), 2, 2),
    ]


def test_running_scoreboard_equals_one_from_scratch(spark, tables, tmp_path):
    draw = random.Random(5)
    prices = {1: [("P1", 2), ("P2", 3), ("P3", 4)], 2: [("P1", 2)]}

    def catalogue(changed=()):
        rows = [(b, p, dict(changed).get((b, p), v)) for b, products in prices.items() for p, v in products]
        rows += [(b, p, v) for (b, p), v in changed if p not in dict(prices.get(b, ()))]
        return [
            {"filial_id": b, "idproduto": p, "preco_venda": v, "preco_compra": 3, "idfornecedor": "F1"} for b, p, v in rows if v is not None
        ]

    def load(n):
        sales = [
            {"venda_id": i, "filial_id": draw.choice([1, 2, 3, None]), "produto_id": draw.choice(["P1", "P2", "P3", "P4"]), "data_emissao": "2025-02-01",
             "qtde_vendida": draw.choice(["1", "1.5"]), "valor_unitario": draw.choice([2, 3]), "unidade_medida": "UN"}
            for i in range(n)
        ]
        orders = [
            {"pedido_id": draw.randrange(9), "ordem_compra": draw.choice([0, 1, 2, 3, 4, 5]), "produto_id": draw.choice(["P1", "P2"]), "item": 1,
             "qtde_pedida": draw.choice([1, 2, None]), "qtde_entregue": draw.choice([0, 1, 2]), "preco_compra": draw.choice([1, 2, None]),
             "data_pedido": draw.choice(["2025-02-01", "2025-02-02", None]), "data_entrega": draw.choice(["2025-02-01", "2025-02-05", None])}
            for _ in range(n)
        ]
        receipts = [{"ordem_compra": draw.choice([0, 1, 2, 3, 7]), "qtde_recebida": draw.choice([1, 2, "0.5"])} for _ in range(n // 2)]
        return {"sales": sales, "purchase_order": orders, "goods_receipt": receipts}

    suppliers = [{"idfornecedor": "F1", "fornecedor_num": 1}, {"idfornecedor": "F2", "fornecedor_num": 2}]
    loads = [load(20), load(3), {"sales": [], "purchase_order": [], "goods_receipt": []}, load(6)]
    catalogues = [catalogue(), catalogue(), catalogue([((1, "P1"), 3), ((3, "P4"), 2), ((2, "P1"), None)]), catalogue([((3, "P4"), 2)])]
    running, whole = RunningScoreboard(spark, str(tmp_path), buckets=8), {k: [] for k in loads[0]}
    for i, (rows, cat) in enumerate(zip(loads, catalogues)):
        whole = {k: v + rows[k] for k, v in whole.items()}
        everything = tables(**whole, branch_product=cat, supplier=suppliers)
        part = tables(**rows, branch_product=cat, supplier=suppliers)
        running.add(i, part)
        if i == 1:
            running.add(i, part)  # the same load again, as after a failure
        assert rows_of(running.scoreboard(i, everything)) == rows_of(quality.scoreboard(everything))


def test_running_scoreboard_reads_touched_buckets_only(spark, tables, tmp_path):
    def sales(*products):
        return tables(sales=[{"venda_id": 1, "filial_id": 1, "produto_id": p, "valor_unitario": 1, "qtde_vendida": 1} for p in products])

    running = RunningScoreboard(spark, str(tmp_path), buckets=16)
    running.add(0, sales(*[f"P{i}" for i in range(200)]))
    running.add(1, sales("P7"))
    keys, buckets = running._touched(["sold"], 1)
    assert rows_of(keys) == [(1, "P7")] and len(buckets) == 1
    merged = running._merged("sold", 1, keys, buckets)
    assert rows_of(merged, "produto_id", "n") == [("P7", 2)]
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    scan = merged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "bucket" in scan.split("PartitionFilters")[1].split("]")[0], plan


def test_finished_batches_become_one_snapshot(spark, frame, tmp_path):
    """Seven arrivals, merged every other batch: the same register, numbers and events as unmerged."""
    suppliers = frame("supplier", [{"idfornecedor": "F1", "fornecedor_num": 1, "razao_social": "Um"}])
    inbox = str(tmp_path / "in")
    for k in range(7):
        events = [(10 * k + i, "INSERT", 1, f"P{k}{i}", None, None, c, None) for i, c in enumerate(("F1", f"F{10 + k}", f"F{10 + k // 2}"))]
        _arrive(spark.createDataFrame(events, CHANGES), inbox)
    schema = spark.createDataFrame([], CHANGES).schema

    def run(folder, every):
        job = SupplierStream(suppliers, str(tmp_path / folder), every)
        job.run(_stream(spark, schema, inbox))
        return job

    plain, merged = run("plain", 100), run("merged", 2)
    for a, b in ((plain.suppliers(), merged.suppliers()), (plain.events(schema), merged.events(schema))):
        assert rows_of(a, *a.columns) == rows_of(b, *b.columns) and a.columns == b.columns
    assert rows_of(plain.suppliers(before=3), "idfornecedor") == rows_of(merged.suppliers(before=3), "idfornecedor")
    # Merged up to 6; the batches and the snapshot before the last merge but one are gone.
    left = sorted(p.name for p in (tmp_path / "merged" / "suppliers").glob("batch=*"))
    assert left == ["batch=4", "batch=5", "batch=6"]
    assert sorted(p.name for p in (tmp_path / "merged" / "suppliers" / "merged").iterdir()) == ["upto=4", "upto=6"]
    assert len(list((tmp_path / "merged" / "events" / "merged").iterdir())) == 3

    # The last batch again, and a merge that never was complete.
    (tmp_path / "merged" / "suppliers" / "merged" / "upto=7").mkdir()
    before = rows_of(merged.suppliers(), "idfornecedor", "fornecedor_num")
    replay = spark.createDataFrame(merged.events(schema).where("batch = 6").select(*schema.names).collect(), schema)
    merged._resolve(replay, 6)
    assert rows_of(merged.suppliers(), "idfornecedor", "fornecedor_num") == before
    assert merged.events(schema).count() == 21


def test_gate_over_many_batches_in_few_folders(spark, frame, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = {"filial_id": 1, "item": 1, "data_emissao": "2025-02-01"}
    for i in range(5):
        _arrive(frame("sales", [{**base, "venda_id": 2 * i + k, "produto_id": p} for k, p in enumerate(("P1", "P2"))]), inbox)
    parent = frame("branch_product", [{"filial_id": 1, "idproduto": "P1"}])
    like = frame("sales", [])
    gate = ReferenceGate(SALES.foreign_keys[0], lambda: parent, out, every=2)
    gate.run(_stream(spark, like.schema, inbox))
    got = gate.rows(like)
    assert rows_of(got, "venda_id", "aceito") == [(i, i % 2 == 0) for i in range(10)]
    assert sorted(r["batch"] for r in got.collect()) == sorted(2 * list(range(5)))
    # Two merges and the last batch, each with one file of either kind.
    assert len(got.inputFiles()) == 6


def test_first_load_looks_up_no_keys(spark, tables, tmp_path):
    running = RunningScoreboard(spark, str(tmp_path / "running"))
    running.add(0, tables(purchase_order=[{"pedido_id": 1, "ordem_compra": 0}, {"pedido_id": 2, "ordem_compra": 3}]))
    assert running._touched(["lines", "received"], 0)[0] is None
    running.add(1, tables(purchase_order=[{"pedido_id": 4, "ordem_compra": 3}]))
    assert rows_of(running._touched(["lines", "received"], 1)[0]) == [(3,)]
    assert running._totals(1)["QA-04"] == 1
