"""Supplier resolution on a stream of product changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.model.schema import SUPPLIER
from ledgerloom.operators.numbering import NumberMark
from ledgerloom.operators.resolve import resolve
from ledgerloom.streaming.folders import BatchFolders


class SupplierStream:
    """Resolves micro-batches against a supplier register that grows with them.

    Batch ``n`` sees the given suppliers and those registered by batches below
    ``n``; its own register as its events come. A replay gives the same numbers and
    overwrites the same folders. One writer at a time: numbers are handed out above
    the highest that ever was, also if its supplier has been removed since.

    Every ``every`` batches the register becomes one snapshot and the events since
    the last time one folder, so a batch opens a bounded number of folders.
    """

    def __init__(self, suppliers: DataFrame, folder: str, every: int = 32):
        self.base = suppliers.select("idfornecedor", "fornecedor_num", "razao_social")
        self.spark = suppliers.sparkSession
        self.folder = folder.rstrip("/")
        self.mark = NumberMark(self.spark, self.folder)
        self.registered = BatchFolders(self.spark, f"{self.folder}/suppliers", every, whole=True)
        self.resolved = BatchFolders(self.spark, f"{self.folder}/events", every)

    def run(self, changes: DataFrame) -> None:
        query = (
            changes.writeStream.foreachBatch(self._resolve)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def _resolve(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            self.registered.tidy(SUPPLIER.typed_schema, batch_id)
            self.resolved.tidy(_resolved(batch.schema), batch_id)
            outcome = resolve(batch, self.suppliers(before=batch_id), self.mark.last(before=batch_id))
            top = outcome.new_suppliers.agg(F.max("fornecedor_num").alias("top")).first()["top"]
            if top is not None:
                self.mark.advance(top, step=batch_id)
            self.registered.write(outcome.new_suppliers, batch_id)
            self.resolved.write(outcome.events, batch_id)
        finally:
            batch.unpersist()

    def suppliers(self, before: int | None = None) -> DataFrame:
        """The register: given suppliers, and those of the batches below ``before``."""
        return self.base.unionByName(self.registered.read(SUPPLIER.typed_schema, before).drop("batch"))

    def events(self, schema: T.StructType) -> DataFrame:
        """Resolved events; ``schema`` is that of the change stream."""
        return self.resolved.read(_resolved(schema))


def _resolved(schema: T.StructType) -> T.StructType:
    added = [
        T.StructField("texto_mudou", T.BooleanType()),
        T.StructField("numero_mudou", T.BooleanType()),
        T.StructField("ramo", T.StringType()),
        T.StructField("idfornecedor", T.StringType()),
        T.StructField("idfornecedor_num", T.IntegerType()),
    ]
    return T.StructType([*schema.fields, *added])
