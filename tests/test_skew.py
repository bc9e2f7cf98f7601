"""Joins and numbering that do not depend on how keys are spread."""

import pytest
from conftest import rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.model.schema import TABLES
from ledgerloom.model.tables import RetailTables
from ledgerloom import session
from ledgerloom.operators import integrity, skew
from ledgerloom.operators.frequent import KeySketches
from ledgerloom.operators.numbering import next_number, number_rows
from ledgerloom.operators.skew import count_rows, crowded_keys, lookup_join
from ledgerloom.plans import quality, reconcile, reports
from ledgerloom.sources import warehouse
from ledgerloom.sources.starschema import StarSchema

FEW = 3


@pytest.fixture
def skewed(spark):
    """Key 0 holds a third of the rows, NULL some, the rest is spread."""
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0)
        .when(F.col("id") % 50 == 1, None)
        .otherwise(F.col("id") % 97)
        .alias("k"),
        F.col("id").alias("v"),
    )


def test_crowded_keys_and_their_parts(skewed):
    counts = count_rows(skewed, ["k"])
    assert rows_of(crowded_keys(counts, ["k"], 100), "_crowded_k", "_parts") == [(0, 4)]
    assert crowded_keys(counts, ["k"]).isEmpty()


def test_many_medium_keys_are_all_split(spark):
    """Keys that each hold far less than a 256th of the rows, but more than a task should take."""
    left = spark.range(40_000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("v"))
    right = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert crowded_keys(count_rows(left, ["k"]), ["k"], 10).where("_parts = 4").count() == 1000
    joined = lookup_join(left, right, ["k"], "inner", rows_per_task=10)
    assert joined.count() == 40_000 and joined.where("w <> 2 * k").isEmpty()


def test_building_the_plan_runs_nothing(spark, skewed):
    right = spark.range(60).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    spark.sparkContext.setJobGroup("plan-only", "")
    try:
        lookup_join(skewed, right, ["k"], "left", rows_per_task=FEW)
        assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_empty_sides(spark, skewed):
    empty = skewed.where("false")
    right = spark.range(3).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    assert lookup_join(empty, right, ["k"], "left", rows_per_task=FEW).count() == 0
    assert lookup_join(skewed, right.where("false"), ["k"], "left", rows_per_task=FEW).count() == 900


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("type_of_key", ["bigint", "int"])
def test_hot_path_gives_the_same_rows(spark, skewed, how, type_of_key):
    right = spark.range(0, 60).select(
        F.col("id").cast(type_of_key).alias("k"), (F.col("id") * 10).alias("w")
    )
    assert rows_of(lookup_join(skewed, right, ["k"], how, rows_per_task=FEW)) == rows_of(
        skewed.join(right, "k", how)
    )


def test_right_keys_may_repeat(spark, skewed):
    right = spark.range(0, 50).select(F.lit(0).cast("bigint").alias("k"), F.col("id").alias("w"))
    joined = lookup_join(skewed, right, ["k"], "inner", rows_per_task=FEW)
    assert joined.count() == skewed.where("k = 0").count() * 50


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    left=st.lists(st.tuples(st.sampled_from([None, "a", "b", "c"]), st.integers(0, 2)), min_size=1, max_size=40),
    right=st.sets(st.tuples(st.sampled_from(["a", "b", "d"]), st.integers(0, 2))),
    how=st.sampled_from(["inner", "left", "left_semi", "left_anti"]),
)
def test_two_part_keys_match_the_plain_join(spark, left, right, how):
    df = spark.createDataFrame(left, "a string, b int")
    looked_up = spark.createDataFrame([(*r, 1) for r in right], "a string, b int, w int")
    assert rows_of(lookup_join(df, looked_up, ["a", "b"], how, rows_per_task=FEW)) == rows_of(
        df.join(looked_up, ["a", "b"], how)
    )


def test_numbers_follow_the_order_without_gaps(spark):
    codes = spark.range(5000).select(F.concat(F.lit("F"), F.col("id").cast("string")).alias("code"))
    numbered = number_rows(codes.repartition(7), ["code"], "n", 101)
    got = [tuple(r) for r in numbered.orderBy("code").select("code", "n").collect()]
    assert got == [(c, 101 + i) for i, c in enumerate(sorted(f"F{i}" for i in range(5000)))]


def test_numbering_uses_more_than_one_slice(spark):
    codes = spark.range(5000).select(F.col("id").alias("code"))
    plan = number_rows(codes, ["code"], "n", 1)
    assert plan.count() == 5000
    assert plan.select("n").distinct().count() == 5000


def test_next_number(spark):
    assert next_number(spark.createDataFrame([], "n int"), "n") == 1
    assert next_number(spark.createDataFrame([(7,), (None,)], "n int"), "n") == 8


def test_sketches_of_stored_tables_stand_in_for_a_count(spark, tables, tmp_path, monkeypatch):
    sales = [{"venda_id": i, "filial_id": 1, "produto_id": "P1" if i % 2 else f"P{i}", "data_emissao": "2025-02-01", "item": 1, "qtde_vendida": 1, "valor_unitario": 1} for i in range(60)]
    orders = [{"pedido_id": i, "ordem_compra": 7 if i % 3 else i, "produto_id": "P1", "item": 1, "qtde_pedida": 1, "qtde_entregue": 0} for i in range(30)]
    given = tables(sales=sales, purchase_order=orders, goods_receipt=[{"ordem_compra": 7, "qtde_recebida": 3}], branch_product=[{"filial_id": 1, "idproduto": "P4", "preco_venda": 2}])
    for name in TABLES:
        warehouse.write_table(name, given[name], str(tmp_path))
    stored = RetailTables.read(spark, str(tmp_path))
    assert given.key_counts("sales", ["filial_id", "produto_id"]) is None
    counts = stored.key_counts("sales", ["filial_id", "produto_id"])
    assert rows_of(counts.where("_rows > 5"), "filial_id", "produto_id", "_rows") == [(1, "P1", 30)]
    assert rows_of(stored.key_counts("purchase_order", ["ordem_compra"]).where("_rows > 1")) == [(7, 20)]
    assert stored.with_table("sales", given.sales).key_counts("sales", ["filial_id", "produto_id"]) is None
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 10)
    for name, rule in (("sales", quality.uncatalogued_sales), ("sales", quality.diverging_sale_prices), ("purchase_order", quality.received_above_ordered), ("purchase_order", quality.delivered_vs_receipt), ("purchase_order", reports.open_orders)):
        found = rule(stored)
        assert rows_of(found) == rows_of(rule(given))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        own = {"sales": "venda_id#", "purchase_order": "pedido_id#"}[name]
        assert sum("Relation [" in line and own in line for line in plan.splitlines()) == 1


def test_sketches_of_loads_add_up(spark, tmp_path):
    sketches = KeySketches(spark, str(tmp_path))
    rows = spark.range(100).select((F.col("id") % 4).alias("k"))
    assert sketches.counts("t", ["k"], rows.schema) is None
    sketches.store("t", rows, ["k"])
    sketches.store("t", rows.where("k = 1").unionByName(rows.where("k = 9")), ["k"], load=1, first=False)
    assert rows_of(sketches.counts("t", ["k"], rows.schema)) == [(0, 25), (1, 50), (2, 25), (3, 25)]
    sketches.store("t", rows.where("k = 2"), ["k"])
    assert rows_of(sketches.counts("t", ["k"], rows.schema)) == [(2, 25)]


def test_rows_are_counted_by_buckets_of_keys(spark, skewed, monkeypatch):
    """What the count passes on does not grow with the keys."""
    monkeypatch.setattr(skew, "BUCKETS", 2)
    right = spark.range(0, 60).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = lookup_join(skewed, right, ["k"], how, rows_per_task=FEW)
        assert rows_of(joined) == rows_of(skewed.join(right, "k", how))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_bucket#" in plan and "Aggregate [k#" not in plan


def test_sales_are_counted_before_they_meet_their_orders(spark):
    typed = StarSchema(spark, "/root/testdata/sf0.001").typed
    bare = typed.with_table("sales", typed.sales)
    for rule in (quality.uncatalogued_sales, quality.diverging_sale_prices):
        plan = rule(typed)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Relation [" in line and "o_orderdate#" in line for line in plan.splitlines()) == 1
        assert rows_of(rule(typed)) == rows_of(rule(bare))
    assert typed.key_counts("sales", ["data_emissao"]) is None


@pytest.mark.parametrize("job", [integrity.primary_key_report, quality.scoreboard, quality.widest_price_gaps, reconcile.acceptance])
def test_joins_and_groups_are_cut_by_the_size_of_files(spark, monkeypatch, job):
    """However few partitions the session sets, a task's rows do not grow with the files."""
    coarse = job(StarSchema(spark, "/root/testdata/sf0.001").typed)
    monkeypatch.setattr(session, "FILE_BYTES_PER_TASK", 10_000)
    fine = job(StarSchema(spark, "/root/testdata/sf0.001").typed)
    assert rows_of(fine) == rows_of(coarse)
    plan = fine._jdf.queryExecution().optimizedPlan().toString()
    assert sum("RepartitionByExpression [l_partkey#" in line for line in plan.splitlines()) > 0
    cut_by = {"primary_key_report": "[ordem_compra#", "scoreboard": "[pedido_id#", "acceptance": "[pedido_id#"}.get(job.__name__, "[l_partkey#")
    assert f"RepartitionByExpression {cut_by}" in plan


def test_lookup_over_a_number_of_tasks(spark, skewed):
    right = spark.range(0, 60).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    joined = lookup_join(skewed, right, ["k"], "left", rows_per_task=FEW, tasks=20)
    assert rows_of(joined) == rows_of(skewed.join(right, "k", "left"))
