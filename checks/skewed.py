"""A copy of a data folder in which one order, part, supplier and day hold a third of the lines.

``python -m checks.skewed source target`` writes it. A tenth of the lines are
exact copies of one line.
"""

from __future__ import annotations

import os
import sys

import duckdb

from checks.compare import TABLE_NAMES

_LINES = """
SELECT CASE WHEN hot THEN 10 ELSE l_orderkey END AS l_orderkey,
       CASE WHEN hot THEN 3 ELSE l_partkey END AS l_partkey,
       CASE WHEN hot THEN 1 ELSE l_suppkey END AS l_suppkey,
       * EXCLUDE (l_orderkey, l_partkey, l_suppkey, hot)
FROM (SELECT *, (row_number() OVER ()) % 3 = 0 AS hot FROM '{src}/lineitem.parquet')
UNION ALL
SELECT l.* FROM (SELECT * FROM '{src}/lineitem.parquet' ORDER BY ALL LIMIT 1) l,
     range((SELECT count(*) // 10 FROM '{src}/lineitem.parquet'))"""

_EVENTS = """
SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id,
       event_type, value, props FROM '{src}/events.parquet'"""


def write(source: str, target: str) -> str:
    os.makedirs(target, exist_ok=True)
    con = duckdb.connect()
    special = {"lineitem": _LINES, "events": _EVENTS}
    for name in TABLE_NAMES:
        sql = special.get(name, "SELECT * FROM '{src}/" + name + ".parquet'").format(src=source)
        con.execute(f"COPY ({sql}) TO '{target}/{name}.parquet' (FORMAT parquet)")
    return target


if __name__ == "__main__":
    write(*sys.argv[1:3])
