"""Reference check on a stream: rows with a parent pass, the others are set aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.model.schema import ForeignKey
from ledgerloom.operators.integrity import admit
from ledgerloom.streaming.folders import BatchFolders


class ReferenceGate:
    """Writes each micro-batch once, split by ``aceito``.

    A batch that is replayed after a failure overwrites its own folder, so no
    row is stored twice. ``parent`` opens the parent table; it is called for every
    batch, so parents added meanwhile count. Stored history is not looked at, but
    every ``every`` batches the folders since the last time become one.
    """

    def __init__(self, fk: ForeignKey, parent: Callable[[], DataFrame], folder: str, every: int = 32):
        self.fk = fk
        self.parent = parent
        self.folder = folder.rstrip("/")
        self.every = every

    def run(self, stream: DataFrame) -> None:
        """Take in everything that has arrived, then stop."""
        query = (
            stream.writeStream.foreachBatch(self._store)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def _store(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            stored = self._stored(batch)
            stored.tidy(_judged(batch.schema), batch_id)
            stored.write(admit(self.fk, batch, self.parent()), batch_id)
        finally:
            batch.unpersist()

    def rows(self, like: DataFrame) -> DataFrame:
        """All judged rows so far; ``like`` gives the columns of the stream."""
        return self._stored(like).read(_judged(like.schema))

    def _stored(self, like: DataFrame) -> BatchFolders:
        return BatchFolders(like.sparkSession, f"{self.folder}/rows", self.every, split_by=("aceito",))


def _judged(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("aceito", T.BooleanType())])
