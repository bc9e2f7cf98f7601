"""The typed tables a report or rule reads, as one bundle of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.model.schema import TABLES
from ledgerloom.operators.frequent import KeySketches


class RetailTables:
    """DataFrames by table name; one given as a function is opened when it is first asked for."""

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        self._tables = tables
        #: Finds stored counts of a table's most frequent keys, for tables as they were stored.
        self._counts: dict[str, Callable[[Sequence[str]], DataFrame | None]] = {}
        #: Tables that are read from files as they are: to group their rows means to move them.
        self._stored: frozenset[str] = frozenset()

    def __getitem__(self, name: str) -> DataFrame:
        table = self._tables[name]
        if callable(table):
            table = self._tables[name] = table()
        return table

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        return self[name]

    def with_table(self, name: str, df: DataFrame) -> RetailTables:
        changed = RetailTables(**{**self._tables, name: df})
        changed._counts = {n: f for n, f in self._counts.items() if n != name}
        changed._stored = self._stored - {name}
        return changed

    def as_stored(self, *names: str) -> RetailTables:
        """The same tables, known to be read from files without a join."""
        known = RetailTables(**self._tables)
        known._counts, known._stored = self._counts, self._stored | {*names}
        return known

    def is_stored(self, name: str) -> bool:
        return name in self._stored

    def with_counts(self, name: str, find: Callable[[Sequence[str]], DataFrame | None]) -> RetailTables:
        """The same tables, and a cheaper way to count rows per key of one of them than to read it."""
        known = RetailTables(**self._tables)
        known._counts, known._stored = {**self._counts, name: find}, self._stored
        return known

    def key_counts(self, name: str, keys: Sequence[str]) -> DataFrame | None:
        """Keys of a table with ``_rows`` to be added up, where they are known more cheaply than from its rows.

        A stored table has the keys with the most rows, from a sketch stored beside it.
        """
        found = self._counts.get(name)
        return found(keys) if found else None

    @staticmethod
    def read(spark: SparkSession, warehouse: str) -> RetailTables:
        """Open the typed Parquet tables of a warehouse folder, schema given."""
        tables = RetailTables(
            **{
                name: spark.read.schema(t.typed_schema).parquet(f"{warehouse.rstrip('/')}/{name}")
                for name, t in TABLES.items()
            }
        )
        sketches = KeySketches(spark, warehouse)
        for name, t in TABLES.items():
            tables._counts[name] = partial(lambda n, schema, keys: sketches.counts(n, keys, schema), name, t.typed_schema)
        return tables.as_stored(*TABLES)
