"""What jobs of many passes leave and move on disk."""

import os

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom import session
from ledgerloom.model.schema import TABLES
from ledgerloom.operators import skew
from ledgerloom.plans import quality
from ledgerloom.sources import warehouse
from ledgerloom.sources.starschema import StarSchema


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """1,500 orders of four lines each, 300 parts, 20 suppliers."""
    path = str(tmp_path_factory.mktemp("star"))
    day = F.expr("timestamp '1997-01-01 00:00:00' + make_interval(0, 0, 0, CAST(l_orderkey % 500 AS INT))")
    lines = spark.range(6000).selectExpr(
        "id DIV 4 AS l_orderkey", "id * 7 % 300 AS l_partkey", "id % 20 AS l_suppkey", "CAST(1 + id % 4 AS INT) AS l_linenumber",
        "CAST(1 + id % 50 AS DOUBLE) AS l_quantity", "CAST(1000 + id * 13 % 9000 AS DOUBLE) AS l_extendedprice",
        "CAST(id % 10 AS DOUBLE) / 100 AS l_discount", "CAST(id % 8 AS DOUBLE) / 100 AS l_tax",
        "CASE WHEN id % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag", "'F' AS l_linestatus",
    ).withColumn("l_shipdate", day)
    tables = {
        "lineitem": lines,
        "orders": spark.range(1500).select(F.col("id").alias("l_orderkey")).select(F.col("l_orderkey").alias("o_orderkey"), day.alias("o_orderdate")),
        "part": spark.range(300).selectExpr(
            "id AS p_partkey", "'part ' || id AS p_name", "'brand' AS p_brand", "CAST(1 + id % 50 AS INT) AS p_size", "CAST(900 + id % 100 AS DOUBLE) AS p_retailprice"
        ),
        "supplier": spark.range(20).selectExpr("id AS s_suppkey", "'supplier ' || id AS s_name"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture
def shuffled(spark, monkeypatch):
    """Bytes of shuffle files written since the test began that are still there; no table is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = (f.getPath() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()))
        return {f for f in found if os.path.basename(f).startswith("shuffle_")}

    old = files()
    yield lambda: sum(os.path.getsize(f) for f in files() - old if os.path.exists(f))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scoreboard_keeps_no_shuffles_of_its_parts(spark, folder, shuffled):
    found = entry.queries()["QA-P"](spark, folder)
    assert len(found.collect()) == 11
    assert shuffled() < 10_000


def test_order_lines_meet_their_receipts_and_are_not_moved_again(spark, tables, shuffled):
    line = {"ordem_compra": 7, "pedido_id": 7, "produto_id": "P1", "qtde_pedida": 9, "item": 1}
    # Two lines of a grain that differ in what was delivered: what they received counts together.
    orders = [{**line, "qtde_entregue": 5}, {**line, "qtde_entregue": 6}, {**line, "qtde_entregue": 5}, {**line, "produto_id": "P2", "qtde_pedida": 5, "qtde_entregue": 5}, {**line, "ordem_compra": 0, "qtde_entregue": 1}]
    given = tables(purchase_order=orders, goods_receipt=[{"ordem_compra": 7, "qtde_recebida": 2}, {"ordem_compra": 7, "qtde_recebida": 3}])
    per_order = quality.lines_per_order(quality.lines_per_grain(given.purchase_order), quality.received_per_order(given.goods_receipt), None, 5)
    assert rows_of(per_order.agg(F.max("recebida").cast("int"), F.sum("off"), F.sum("zeroed"), F.count_if(F.expr(quality._EXCESS)))) == [(15, 2, 1, 1)]
    plan = per_order._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan[: plan.index("SortMergeJoin")]


def test_acceptance_keeps_no_shuffles_of_its_parts(spark, folder, shuffled):
    found = entry.queries()["R6"](spark, folder)
    assert len(found.collect()) == 1
    assert shuffled() < 10_000


def test_views_are_counted_one_after_the_other(spark, folder, shuffled):
    found = entry.queries()["A9"](spark, folder)
    assert len(found.collect()) == 13
    assert shuffled() < 10_000


@pytest.mark.parametrize("rule", [quality.received_above_ordered, quality.delivered_vs_receipt])
@pytest.mark.parametrize("strict", [False, True])
def test_order_lines_with_their_receipts_are_grouped_where_they_met(spark, tables, shuffled, monkeypatch, rule, strict):
    line = {"pedido_id": 7, "qtde_pedida": 9, "qtde_entregue": 1, "item": 1}
    orders = [{**line, "ordem_compra": o, "produto_id": f"P{i % 3}"} for i in range(20) for o in (7, 8, 0, None)]
    receipts = [{"ordem_compra": o, "item": 1, "produto_id": f"P{i}", "qtde_recebida": i + 1} for o in (7, 9, 0) for i in range(3)]
    given = tables(purchase_order=orders, goods_receipt=receipts)
    whole = rows_of(rule(given, strict))
    received = [1, 2, 3] if strict else [6, 6, 6]
    assert [int(r["recebida" if "recebida" in r else "qtde_recebida_nf" if "qtde_recebida_nf" in r else "qtde_recebida"]) for r in sorted((r.asDict() for r in rule(given, strict).collect()), key=lambda r: r["produto_id"])] == [n * lines for n, lines in zip(received, (7, 7, 6)) if rule is quality.delivered_vs_receipt or n * lines > 9]
    plan = rule(given, strict)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan[: plan.index("SortMergeJoin")]
    # The same where an order has more lines than a task should take.
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 3)
    assert rows_of(rule(given, strict)) == whole


def test_onboarding_keeps_typed_tables_and_what_it_set_aside_only(spark, folder, shuffled, tmp_path):
    star = StarSchema(spark, folder)
    path = session.scratch_path(spark, "probe")
    kept = lambda: {n for n in os.listdir(os.path.dirname(path).removeprefix("file:")) if n.startswith("judged-")}
    before = kept()
    done = warehouse.onboard(spark, star.raw, str(tmp_path / "warehouse"))
    assert shuffled() < 10_000
    assert kept() == before
    for name in TABLES:
        values = done.counts[name].values
        assert done.tables[name].count() + done.quarantine[name].count() >= values["final"] > 0


def test_ranges_of_a_fact_follow_the_size_of_its_files(spark, frame, tmp_path, monkeypatch):
    rows = frame("sales", [{"venda_id": i, "data_emissao": f"2025-01-{1 + i % 28:02}", "filial_id": 1, "produto_id": f"P{i}", "item": 1} for i in range(400)])
    monkeypatch.setattr(session, "FILE_BYTES_PER_TASK", 200)
    stored = session.pinned(rows.coalesce(1), "sales")
    wanted = session.tasks_for(stored)
    assert wanted > int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = warehouse.write_table("sales", stored, str(tmp_path), stored=True)
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows_of(spark.read.schema(stored.schema).parquet(path)) == rows_of(stored)
