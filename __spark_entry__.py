"""Entry points: the flagship report, every query by name, and their check queries.

a session and a data folder and returns a DataFrame.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import date
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracle import oracle_sql as _oracle_sql
from ledgerloom.functions.period import Period
from ledgerloom.model.schema import SALES, SUPPLIER, TABLES
from ledgerloom.operators import integrity, resolve
from ledgerloom.operators.numbering import next_number, number_rows
from ledgerloom.plans import load, quality, reconcile, reports
from ledgerloom.plans.increments import RunningScoreboard
from ledgerloom.session import in_turn, scratch_path
from ledgerloom.sources import csv, sheet, warehouse
from ledgerloom.sources.bucketed import bucketed
from ledgerloom.sources.starschema import StarSchema
from ledgerloom.streaming.gate import ReferenceGate
from ledgerloom.streaming.history import store, trend
from ledgerloom.streaming.reprocessed import BUCKETS, RepeatAlerts, repeated_keys
from ledgerloom.streaming.suppliers import SupplierStream

try:
    import corpus_pipeline
    from ledgerloom.llm import queries as _llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "ledgerloom.llm"):
        raise
    _llm = None

MONTH = Period.month(1997, 2)
TWO_MONTHS = Period.month(1997, 1, 2)
YEAR = Period.month(1997, 1, 12)

Query = Callable[[SparkSession, str], DataFrame]


def _on_typed(job, *args, **kwargs) -> Query:
    return lambda spark, folder: job(StarSchema(spark, folder).typed, *args, **kwargs)


def _on_raw(job, *args) -> Query:
    return lambda spark, folder: job(StarSchema(spark, folder).raw, *args)


def _on_stored_lines(job, label: str) -> Query:
    """A job of many passes over the typed tables: lines are joined once, and one part runs after the other."""
    return lambda spark, folder: job(StarSchema(spark, folder).with_stored_lines().typed, in_turn(spark, label))


def _on_load(job) -> Query:
    """A job over the raw tables and their typed load."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        raw = StarSchema(spark, folder).raw
        return job(raw, load.load_all(raw))

    return run


def _csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    csv.write_text(StarSchema(spark, folder).raw_view("sales"), path)
    return csv.stage_text(spark, path, TABLES["sales"]).rows


def _csv_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    csv.write_text(StarSchema(spark, folder).raw_view("purchase_order"), path)
    return csv.read_text(spark, path, TABLES["purchase_order"], strict=True)


def _order_table(spark: SparkSession, folder: str) -> DataFrame:
    contract = len(TABLES["purchase_order"].raw_columns)
    return sheet.first_columns(StarSchema(spark, folder).order_sheet, contract)


def _overflow(spark: SparkSession, folder: str) -> DataFrame:
    return sheet.overflow_block(StarSchema(spark, folder).order_sheet)


def _ingest_report(spark: SparkSession, folder: str) -> DataFrame:
    star = StarSchema(spark, folder)
    tabs = {
        t.file: star.order_sheet if t.name == "purchase_order" else star.raw_view(t.name)
        for t in TABLES.values()
    }
    return sheet.ingest_report(
        [
            sheet.extract(t.file, tabs[t.file], len(t.raw_columns))
            for t in TABLES.values()
        ]
    )


def _full_refresh(spark: SparkSession, folder: str) -> DataFrame:
    sales = StarSchema(spark, folder).typed.sales
    root = scratch_path(spark, "refresh")
    warehouse.write_table("sales", sales.where("data_emissao < DATE '1998-01-01'"), root)
    path = warehouse.write_table("sales", sales, root)
    return spark.read.schema(SALES.typed_schema).parquet(path)


def _typed_sink(spark: SparkSession, folder: str) -> DataFrame:
    orders = load.load("purchase_order", StarSchema(spark, folder).raw_view("purchase_order"))
    path = warehouse.write_table("purchase_order", orders, scratch_path(spark, "typed"))
    return spark.read.schema(TABLES["purchase_order"].typed_schema).parquet(path)


def _views(spark: SparkSession, folder: str) -> DataFrame:
    names = quality.register_views(StarSchema(spark, folder).with_stored_lines().typed, MONTH)
    count = in_turn(spark, "views")
    counts = [
        count(spark.sql(f"SELECT '{name}' AS visao, count(*) AS linhas FROM {name}")) for name in names
    ]
    return reduce(DataFrame.unionByName, counts)


def _displaced(spark: SparkSession, folder: str) -> DataFrame:
    star = StarSchema(spark, folder)
    orders = star.typed.purchase_order
    block = sheet.typed_overflow(sheet.overflow_block(star.order_sheet))
    return reconcile.displaced_rows(block, orders)


# ---- loads ------------------------------------------------------------------


def _load(name: str) -> Query:
    return lambda spark, folder: load.load(name, StarSchema(spark, folder).raw_view(name))


def _supplier_issues(spark: SparkSession, folder: str) -> DataFrame:
    return load.supplier_code_issues(StarSchema(spark, folder).raw_view("supplier"))


def _onboarding(spark: SparkSession, folder: str) -> DataFrame:
    """The whole run, raw to typed: rows stored and rows set aside per table."""
    raw = StarSchema(spark, folder).with_stored_lines().raw
    done = warehouse.onboard(spark, raw, scratch_path(spark, "warehouse"))
    lines = [
        done.tables[name].agg(
            F.lit(name).alias("tabela"),
            F.count("*").alias("gravadas"),
        ).withColumn("quarentena", done.quarantine[name].agg(F.count("*").alias("n")).scalar())
        for name in TABLES
    ]
    return reduce(DataFrame.unionByName, lines)


def _load_report(spark: SparkSession, folder: str) -> DataFrame:
    """The whole run, and the counts it observed on its way."""
    raw = StarSchema(spark, folder).with_stored_lines().raw
    done = warehouse.onboard(spark, raw, scratch_path(spark, "warehouse"))
    return load.load_report(spark, done.counts)


def _numbered_products(spark: SparkSession, folder: str) -> DataFrame:
    typed = StarSchema(spark, folder).typed
    codes = typed.sales.select("produto_id").distinct()
    return number_rows(codes, ["produto_id"], "numero", next_number(typed.supplier, "fornecedor_num"))


# ---- integrity --------------------------------------------------------------


def _unique(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = load.load("supplier", StarSchema(spark, folder).raw_view("supplier"))
    return integrity.unique_violations(SUPPLIER, suppliers)


def _sales_fk(job) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        typed = StarSchema(spark, folder).typed
        return job(SALES.foreign_keys[0], typed.sales, typed.branch_product)

    return run


def _admitted(spark: SparkSession, folder: str) -> DataFrame:
    typed = StarSchema(spark, folder).typed
    fk = SALES.foreign_keys[0]
    return integrity.admit(fk, typed.sales, typed.branch_product, typed.key_counts("sales", fk.columns))


def _cascade(spark: SparkSession, folder: str) -> DataFrame:
    typed = StarSchema(spark, folder).typed
    number = F.col("fornecedor_num") % 10
    changes = typed.supplier.where(number.isin(3, 5)).select(
        F.col("idfornecedor").alias("old"),
        F.when(number == 3, F.concat("idfornecedor", F.lit("-B"))).alias("new"),
    )
    return integrity.cascade(typed.branch_product, "idfornecedor", changes)


def _validated_by_bucket(spark: SparkSession, folder: str) -> DataFrame:
    typed = bucketed(StarSchema(spark, folder).typed, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return integrity.validate(SALES.foreign_keys[0], typed.sales, typed.branch_product)


def _all_cascades(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers renamed, renumbered and removed; what their products and orders then point at."""
    typed = StarSchema(spark, folder).typed
    number = F.col("fornecedor_num") % 10
    changes = typed.supplier.where(number.isin(3, 5, 7)).select(
        F.col("idfornecedor").alias("old_idfornecedor"),
        F.when(number == 5, None).when(number == 7, F.col("idfornecedor")).otherwise(F.concat("idfornecedor", F.lit("-B"))).alias("new_idfornecedor"),
        F.col("fornecedor_num").alias("old_fornecedor_num"),
        F.when(number == 3, F.col("fornecedor_num")).when(number == 7, F.col("fornecedor_num") + 500_000).cast("int").alias("new_fornecedor_num"),
    )
    after = integrity.cascade_all(typed, {"supplier": changes})
    named = [
        ("supplier", F.lit(None).cast("int"), F.col("idfornecedor"), F.col("idfornecedor"), F.col("fornecedor_num")),
        ("branch_product", F.col("filial_id"), F.col("idproduto"), F.col("idfornecedor"), F.col("idfornecedor_num")),
        ("purchase_order", F.col("item"), F.concat_ws("|", F.col("pedido_id").cast("string"), "produto_id"), F.lit(None).cast("string"), F.col("fornecedor_id")),
    ]
    parts = [after[t].select(F.lit(t).alias("tabela"), a.alias("parte"), b.alias("chave"), c.alias("codigo"), n.alias("numero")) for t, a, b, c, n in named]
    return reduce(DataFrame.unionByName, parts)


def _defaults(spark: SparkSession, folder: str) -> DataFrame:
    batch = StarSchema(spark, folder).typed.sales.drop(
        "horariomov", "valor_unitario", "item", "unidade_medida"
    )
    return integrity.fill_omitted(SALES, batch)


# ---- supplier resolution ----------------------------------------------------


def _resolution(pick: Callable[[resolve.Resolution], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        star = StarSchema(spark, folder)
        return pick(resolve.resolve(star.changes, star.typed.supplier))

    return run


def _branch(name: str) -> Query:
    return _resolution(
        lambda r: r.events.where(F.col("ramo") == name).select(
            "seq", "filial_id", "idproduto", "idfornecedor", "idfornecedor_num"
        )
    )


def _products_after(spark: SparkSession, folder: str) -> DataFrame:
    star = StarSchema(spark, folder)
    products = star.typed.branch_product
    return resolve.apply_to_products(products, resolve.resolve(star.changes, star.typed.supplier))


def _mismatched(spark: SparkSession, folder: str) -> DataFrame:
    star = StarSchema(spark, folder)
    suppliers = star.typed.supplier
    outcome = resolve.resolve(star.changes, suppliers)
    products = resolve.apply_to_products(star.typed.branch_product, outcome)
    return resolve.mismatched_pairs(products, suppliers.unionByName(outcome.new_suppliers))


def _altered(raw, typed):
    """Quantities of two items of some sales moved from one to the other: no sum over sales tells."""
    moved = F.expr("CASE WHEN venda_id % 53 = 1 AND item = 1 THEN 1 WHEN venda_id % 53 = 1 AND item = 2 THEN -1 ELSE 0 END")
    sales = typed.sales.withColumn("qtde_vendida", (F.col("qtde_vendida") + moved).cast("decimal(14,3)"))
    return raw, typed.with_table("sales", sales)


def _changed(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.changed_columns(StarSchema(spark, folder).changes).select(
        "seq", "op", "texto_mudou", "numero_mudou"
    )


def _code_wins(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.code_wins(StarSchema(spark, folder).changes).select(
        "seq", "new_idfornecedor", "num"
    )


def _new_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    star = StarSchema(spark, folder)
    events = resolve.code_wins(star.changes)
    suppliers = star.typed.supplier
    return resolve.register(resolve.unknown_codes(events, suppliers), suppliers).drop("desde")


def _backfill(spark: SparkSession, folder: str) -> DataFrame:
    typed = StarSchema(spark, folder).typed
    return resolve.backfill(typed.branch_product, typed.supplier)[0]


def _coverage(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.link_coverage(StarSchema(spark, folder).typed.branch_product)


# ---- questions, proofs, streams ---------------------------------------------


def _decision(name: str) -> Query:
    return _on_typed(quality.DECISIONS[name])


def _gate_stream(spark: SparkSession, folder: str) -> DataFrame:
    star = StarSchema(spark, folder)
    sales = star.sale_lines(star.stream("lineitem"))
    gate = ReferenceGate(SALES.foreign_keys[0], lambda: star.typed.branch_product, scratch_path(spark, "gate"))
    gate.run(sales)
    return gate.rows(sales).drop("batch")


def _supplier_stream(spark: SparkSession, folder: str) -> DataFrame:
    star = StarSchema(spark, folder)
    changes = star.changes_of(star.stream("part"))
    job = SupplierStream(star.typed.supplier, scratch_path(spark, "suppliers"))
    job.run(changes)
    return job.events(changes.schema).select(
        "seq", "filial_id", "idproduto", "ramo", "idfornecedor", "idfornecedor_num"
    )


def _scoreboard_history(spark: SparkSession, folder: str) -> DataFrame:
    """Two loads, up to a day and from it on; the second one costs what it touches."""
    typed = StarSchema(spark, folder).with_stored_lines().typed
    path, running = scratch_path(spark, "history"), RunningScoreboard(spark, scratch_path(spark, "running"))
    cut = F.lit(date(1998, 1, 1))
    sales, orders = typed.sales, typed.purchase_order
    early = typed.with_table("sales", sales.where(F.col("data_emissao") < cut)).with_table("purchase_order", orders.where(F.col("data_pedido") < cut))
    late = typed.with_table("sales", sales.where(F.col("data_emissao") >= cut)).with_table("purchase_order", orders.where(F.col("data_pedido") >= cut))
    late = late.with_table("goods_receipt", typed.goods_receipt.where("false"))
    for load_, (new, day) in enumerate(((early, date(2026, 1, 1)), (late, date(2026, 1, 2)))):
        running.add(load_, new)
        store(running.scoreboard(load_, typed), day, path)
    return trend(spark, path)


_EVENT_KEYS = ["user_id", "event_type"]


def _repeat_stream(spark: SparkSession, folder: str) -> DataFrame:
    events = StarSchema(spark, folder).stream("events")
    found = repeated_keys(events, _EVENT_KEYS, "ts", buckets=BUCKETS)
    alerts = RepeatAlerts(_EVENT_KEYS, scratch_path(spark, "repeats"))
    alerts.run(found)
    return alerts.alerts(found)


def _late_events(spark: SparkSession, folder: str) -> DataFrame:
    """All events in three arrivals, every tenth of them only with the last, each taken in by a run of its own."""
    events = StarSchema(spark, folder).table("events")
    inbox, alerts = scratch_path(spark, "inbox"), RepeatAlerts(_EVENT_KEYS, scratch_path(spark, "repeats"))
    for arrival in ("event_id % 10 <> 9 AND ts < DATE '2024-01-16'", "event_id % 10 <> 9 AND ts >= DATE '2024-01-16'", "event_id % 10 = 9"):
        events.where(arrival).write.mode("append").parquet(inbox)
        found = repeated_keys(spark.readStream.schema(events.schema).parquet(inbox), _EVENT_KEYS, "ts", buckets=BUCKETS)
        alerts.run(found)
    return alerts.late(found)


# ---- contract ---------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Sales per product and branch for one month, uncatalogued products included."""
    return reports.monthly_sales(StarSchema(spark, "/root/testdata/sf0.001").typed, MONTH)


def queries() -> dict[str, Query]:
    return _queries() | ({**_llm.QUERIES, "pipeline": corpus_pipeline.run} if _llm else {})


def _queries() -> dict[str, Query]:
    return {
        "A1": _csv_round_trip,
        "A2": _order_table,
        "A3": _overflow,
        "A4": lambda spark, folder: sheet.trim_midnights(_order_table(spark, folder)),
        "A5": _ingest_report,
        "A6": _csv_sink,
        "A7": _full_refresh,
        "A8": _typed_sink,
        "A9": _views,
        "A10": _displaced,
        "B1": _load("supplier"),
        "B1-issues": _supplier_issues,
        "B2": _load("branch_product"),
        "B3": _load("purchase_order"),
        "B4": _load("goods_receipt"),
        "B5": _load("sales"),
        "B6": _on_raw(load.skip_report),
        "B7": _numbered_products,
        "LOAD": _onboarding,
        "LOAD-out": _on_raw(load.quarantine),
        "LOAD-counts": _load_report,
        "C1": _on_typed(integrity.primary_key_report),
        "C2": _unique,
        "C3": _on_load(lambda _, typed: integrity.null_report(typed)),
        "C4": _on_load(lambda _, typed: integrity.check_violations(typed)),
        "C5": _on_typed(integrity.foreign_key_report),
        "C6": _admitted,
        "C7": _sales_fk(integrity.validate),
        "C7-bucketed": _validated_by_bucket,
        "C8": _on_raw(integrity.domain_report),
        "C9": _cascade,
        "C9-all": _all_cascades,
        "C10": _defaults,
        "C11": _on_typed(integrity.report_only),
        "T1": _changed,
        "T2": _code_wins,
        "T3": _branch(resolve.NUMBER_KEPT),
        "T4": _resolution(lambda r: r.rejected),
        "T5": _branch(resolve.EMPTY),
        "T6": _branch(resolve.KNOWN_CODE),
        "T7": _new_suppliers,
        "T8": _backfill,
        "T9": _coverage,
        "T-products": _products_after,
        "T-notices": _resolution(lambda r: r.notices),
        "T-mismatch": _mismatched,
        "T-state": _resolution(lambda r: r.final_state),
        "P1": _on_typed(reports.monthly_sales, MONTH),
        "P2": _on_typed(reports.monthly_sales_with_total, MONTH),
        "P3": _on_typed(reports.open_orders),
        "P4": _on_typed(reports.open_orders_summary),
        "P5": _on_typed(reports.requisitions_by_quantity, TWO_MONTHS),
        "P6": _on_typed(reports.requisitions_by_count, YEAR),
        "P7": _on_typed(reports.sales_by_label, TWO_MONTHS),
        "P8": _on_typed(reports.catalogue_with_orders, TWO_MONTHS),
        "P9": _on_typed(reports.period_card, MONTH),
        "P10": _on_typed(reports.daily_revenue, MONTH),
        "P11": _on_typed(reports.order_vs_receipt, MONTH),
        "P11-strict": _on_typed(reports.order_vs_receipt, MONTH, strict=True),
        "P12": _on_typed(reports.stock_movement, MONTH),
        "P13": _on_typed(quality.widest_price_gaps),
        "P13-1": _decision("uncatalogued_sales"),
        "P13-2": _decision("branches_without_catalogue"),
        "P13-3": _decision("fractional_quantities"),
        "P13-4": _decision("duplicate_orders"),
        "P13-5": _decision("delivered_vs_receipt"),
        "P13-6": _decision("negative_margins"),
        "P13-7": _decision("widest_price_gaps"),
        "P13-8": _decision("inverted_dates"),
        "P14": _on_typed(reports.sale_gaps, MONTH),
        "P14-days": _on_typed(reports.days_without_sales, MONTH),
        **{code: _on_typed(rule) for code, rule in quality.RULES.items()},
        "QA-07-strict": _on_typed(quality.received_above_ordered, strict=True),
        "QA-08-strict": _on_typed(quality.delivered_vs_receipt, strict=True),
        "QA-12": _on_typed(quality.sales_by_month, MONTH.start),
        "QA-P": _on_stored_lines(quality.scoreboard, "scoreboard"),
        "R1": _on_raw(reconcile.load_counts),
        "R2": _on_raw(lambda raw: reconcile.row_count_differences(reconcile.load_counts(raw))),
        "R3": _on_load(reconcile.financial_checksum),
        "R4": _on_typed(lambda tables: reconcile.repeated_documents(tables.sales)),
        "R5": _on_load(reconcile.trace_sales),
        "R5-buckets": _on_load(reconcile.sale_digests),
        "R5-changed": _on_load(lambda raw, typed: reconcile.changed_sales(*_altered(raw, typed))),
        "R6": _on_stored_lines(reconcile.acceptance, "acceptance"),
        "ST1": _gate_stream,
        "ST2": _supplier_stream,
        "ST3": _scoreboard_history,
        "ST4": _repeat_stream,
        "ST4-late": _late_events,
    }


def oracle_sql() -> dict[str, str]:
    return _oracle_sql() | (_llm.ORACLE if _llm else {})
