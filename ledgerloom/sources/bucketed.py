"""Sales and catalogue stored by branch and product, so that checks of sale keys move no rows.

Both tables are cut into the same number of buckets by a hash of (branch,
product). Grouping the sales by that key, and joining them with the catalogue on
it, then happen bucket by bucket, without an exchange. Worth its one shuffle
where several checks read the same load.
"""

from __future__ import annotations

import uuid

from ledgerloom.model.tables import RetailTables
from ledgerloom.session import scratch_path

BUCKETED_BY = {"sales": ("filial_id", "produto_id"), "branch_product": ("filial_id", "idproduto")}


def bucketed(tables: RetailTables, buckets: int, folder: str | None = None) -> RetailTables:
    """The tables, with sales and catalogue written below ``folder`` in ``buckets`` buckets each.

    Choose ``buckets`` so that one holds what a task can sort; the busiest key
    lies in one bucket, folded to one row before it is joined.
    """
    spark = tables.sales.sparkSession
    folder = (folder or scratch_path(spark, "bucketed")).rstrip("/")
    for name, key in BUCKETED_BY.items():
        table = f"ledgerloom_{name}_{uuid.uuid4().hex}"
        rows = tables[name].repartition(buckets, *key)
        rows.write.bucketBy(buckets, *key).sortBy(*key).option("path", f"{folder}/{name}").saveAsTable(table)
        tables = tables.with_table(name, spark.table(table))
    return tables
