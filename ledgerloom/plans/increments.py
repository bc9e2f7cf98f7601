"""The scoreboard kept up by loads: a load costs what it touches, not what is stored.

Each load leaves its counts per key, as parts that add up: sale lines per branch,
product and price; order lines per order and what the rules compare; received
quantities per order; order lines per product, date and price. A rule's total
changes by what the keys of the load found after it, less what they found
before. So only those keys' counts are read again, out of the buckets they lie
in. Findings that need no other row (fractions, orders without link, inverted
dates) are added as they are. A catalogue that changed touches the keys whose
entries differ from those of the load before.

Loads are numbered upwards. A load that is run again overwrites its own parts
and gives the same totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.model.tables import RetailTables
from ledgerloom.plans import quality

_SALE_KEY = ["filial_id", "produto_id"]
_TWIN_KEY = ["produto_id", "data_pedido", "preco_compra"]
_TOTALS = "cod string, ocorrencias long, carga int"

#: Per part: the columns whose rows are judged together, the rest of its key, and how its counts add up.
_PARTS: dict[str, tuple[list[str], list[str], dict[str, str]]] = {
    "sold": (_SALE_KEY, ["valor_unitario"], {"n": "sum", "fractions": "sum"}),
    "lines": (["ordem_compra"], [c for c in quality.LINE_KEY if c != "ordem_compra"], {"n": "sum", "inverted": "sum"}),
    "received": (["ordem_compra"], [], {"received": "sum"}),
    "twins": (_TWIN_KEY, [], {"ocorrencias": "sum", "low": "min", "high": "max"}),
}


class RunningScoreboard:
    """Counts below a folder, in as many buckets of keys as ``buckets`` says."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.schemas: dict[str, T.StructType] = {}

    def add(self, load: int, new: RetailTables) -> None:
        """Take in a load: its new sales, orders and receipts, and the whole catalogue and suppliers."""
        lines = quality.lines_per_grain(new.purchase_order)
        delta = {
            "sold": quality.sold_per_key(new.sales),
            "lines": lines.where("ordem_compra <> 0"),
            "received": quality.received_per_order(new.goods_receipt).where("ordem_compra <> 0"),
            "twins": quality.twin_groups(new),
        }
        for part, rows in delta.items():
            self._store(part, rows, load)
        prices = quality.catalogue_prices(new)
        self.schemas["catalogue"] = prices.schema
        prices.write.mode("overwrite").parquet(f"{self.folder}/catalogue/carga={load}")
        changes = {
            **self._sales_changes(load),
            **self._order_changes(load),
            "QA-05": self._change("twins", load, self._touched(["twins"], load), lambda rows: rows.agg(F.sum(F.when(F.expr("low <> high"), F.col("ocorrencias"))))),
        }
        direct = new.purchase_order.agg(F.count_if(F.expr(quality._ZEROED)).alias("zeroed"), F.count_if(F.expr(quality._INVERTED)).alias("inverted")).first()
        fractions = self._part("sold", load, load).agg(F.sum("fractions")).first()[0]
        changes |= {"QA-03": fractions or 0, "QA-04": direct["zeroed"] or 0, "QA-06": direct["inverted"] or 0}
        before = self._totals(load - 1)
        totals = {code: before.get(code, 0) + change for code, change in changes.items()}
        rows = [(code, int(n)) for code, n in totals.items()] + [("QA-02", self._unstocked_branches(load))]
        stored = self.spark.createDataFrame(rows, "cod string, ocorrencias long").coalesce(1)
        stored.write.mode("overwrite").parquet(f"{self.folder}/totals/carga={load}")

    def scoreboard(self, load: int, tables: RetailTables) -> DataFrame:
        """One line per rule as it stands after a load; catalogue and suppliers are read as they are."""
        totals = self._totals(load)
        kept = [quality._line(code, F.lit(n)) for code, n in sorted(totals.items())]
        lines = self.spark.range(1).select(F.inline(F.array(*kept)))
        return lines.unionByName(quality.dimension_lines(tables)).orderBy(quality.severity_rank(), "cod")

    # ---- stored parts -----------------------------------------------------------

    def _bucket(self, key: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _store(self, part: str, rows: DataFrame, load: int) -> None:
        self.schemas[part] = rows.schema
        bucketed = rows.withColumn("bucket", self._bucket(_PARTS[part][0])).repartition("bucket")
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{part}/carga={load}")

    def _part(self, part: str, first: int, last: int, buckets: Sequence[int] | None = None) -> DataFrame:
        added = [T.StructField("carga", T.IntegerType()), T.StructField("bucket", T.IntegerType())]
        rows = self.spark.read.schema(T.StructType([*self.schemas[part].fields, *added])).parquet(f"{self.folder}/{part}")
        rows = rows.where(F.col("carga").between(first, last))
        return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))

    def _merged(self, part: str, last: int, touched: DataFrame | None, buckets: Sequence[int]) -> DataFrame:
        """The counts of the touched keys, or of all, over all loads up to ``last``."""
        key, rest, counts = _PARTS[part]
        rows = self._part(part, 0, last, buckets)
        met = rows if touched is None else rows.join(touched, [rows[k].eqNullSafe(touched[k]) for k in key], "left_semi")
        sums = [getattr(F, how)(c).cast(self.schemas[part][c].dataType).alias(c) for c, how in counts.items()]
        return met.groupBy(*key, *rest).agg(*sums)

    def _touched(self, parts: Sequence[str], load: int, others: DataFrame | None = None) -> tuple[DataFrame | None, list[int]]:
        """Keys that a load brings in any of the parts, and their buckets, ``buckets`` at most.

        The first load brings in all there is: no keys are looked up for it.
        """
        if not self._totals(load - 1):
            return None, list(range(self.buckets))
        key = _PARTS[parts[0]][0]
        keys = others
        for part in parts:
            rows = self._part(part, load, load).select(*key)
            keys = rows if keys is None else keys.unionByName(rows)
        keys = keys.distinct()
        return keys, [r[0] for r in keys.select(self._bucket(key).alias("b")).distinct().collect()]

    def _totals(self, load: int) -> dict[str, int]:
        """The totals of the last load up to this one; none before the first."""
        if load < 0 or not self._exists("totals"):
            return {}
        rows = self.spark.read.schema(_TOTALS).parquet(f"{self.folder}/totals").where(F.col("carga") <= load).collect()
        last = max((r["carga"] for r in rows), default=None)
        return {r["cod"]: r["ocorrencias"] for r in rows if r["carga"] == last}

    def _exists(self, part: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    # ---- what a load changes ------------------------------------------------------

    def _change(self, part: str, load: int, touched: tuple[DataFrame | None, list[int]], count) -> int:
        """What the touched keys count after the load, less what they counted before."""
        keys, buckets = touched
        if not buckets:
            return 0
        after, before = (count(self._merged(part, last, keys, buckets)).first()[0] or 0 for last in (load, load - 1))
        return after - before

    def _catalogue(self, load: int) -> DataFrame:
        """The catalogue as it was with a load, or with the last one before it."""
        schema = T.StructType([*self.schemas["catalogue"].fields, T.StructField("carga", T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/catalogue").where(F.col("carga") <= load)
        last = rows.agg(F.max("carga")).first()[0]
        return rows.where(F.col("carga") == F.lit(last)).drop("carga")

    def _sales_changes(self, load: int) -> dict[str, int]:
        old, new = self._catalogue(load - 1), self._catalogue(load)

        def entries(prices: DataFrame, name: str) -> DataFrame:
            return prices.groupBy(*_SALE_KEY).agg(F.sort_array(F.collect_list("preco_venda")).alias(name))

        both = entries(old, "old").join(entries(new, "new"), _SALE_KEY, "full")
        touched = self._touched(["sold"], load, both.where("NOT (old <=> new)").select(*_SALE_KEY))
        keys, buckets = touched
        if not buckets:
            return {"QA-01": 0, "QA-10": 0}
        found = []
        for last, prices in ((load, new), (load - 1, old)):
            per_branch = quality.sales_per_branch(self._merged("sold", last, keys, buckets), prices)
            found.append(per_branch.agg(F.sum("unlisted").alias("QA-01"), F.sum("off_price").alias("QA-10")).first())
        return {code: (found[0][code] or 0) - (found[1][code] or 0) for code in ("QA-01", "QA-10")}

    def _order_changes(self, load: int) -> dict[str, int]:
        keys, buckets = self._touched(["lines", "received"], load)
        if not buckets:
            return {"QA-07": 0, "QA-08": 0}
        found = []
        for last in (load, load - 1):
            lines, received = (self._merged(part, last, keys, buckets) for part in ("lines", "received"))
            per_order = quality.lines_per_order(lines, received)
            found.append(per_order.agg(F.count_if(F.expr(quality._EXCESS)).alias("QA-07"), F.sum("off").alias("QA-08")).first())
        return {code: (found[0][code] or 0) - (found[1][code] or 0) for code in ("QA-07", "QA-08")}

    def _unstocked_branches(self, load: int) -> int:
        """Branches that sold and have no catalogue: as many rows as there are branches and loads."""
        path = f"{self.folder}/branches"
        self._part("sold", load, load).select("filial_id").distinct().coalesce(1).write.mode("overwrite").parquet(f"{path}/carga={load}")
        schema = T.StructType([self.schemas["sold"]["filial_id"], T.StructField("carga", T.IntegerType())])
        sold = self.spark.read.schema(schema).parquet(path).where(F.col("carga") <= load).select("filial_id").distinct()
        stocked = self._catalogue(load).select("filial_id").distinct()
        return sold.join(stocked, "filial_id", "left_anti").count()
