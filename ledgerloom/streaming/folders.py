"""One folder per micro-batch, and finished ones brought together.

A replayed batch overwrites its own folder, so no row is stored twice. That leaves
as many folders as there were batches; every ``every`` batches the finished ones
are merged into one, which readers take in their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file that a merge writes.
FILE_BYTES = 256 << 20


class BatchFolders:
    """Rows by micro-batch below ``folder``, read back with a column ``batch``.

    ``whole``: each merge takes in the one before it, so one snapshot stands for all
    finished batches (for tables read by every batch, such as a register). Without
    it a merge covers the batches since the last one, and rows are rewritten once.

    A merge counts once it is complete; a job that ends within one leaves the
    batches as they were. What a merge replaces is removed at the next merge, so a
    query that began before it still finds its files. ``tidy`` is called by the
    writer with the batch it is about to write: only batches below it are merged,
    and the writer may replay that one at any time.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = 32, whole: bool = False, split_by: tuple[str, ...] = ()):
        self.spark, self.folder, self.every, self.whole, self.split_by = spark, folder.rstrip("/"), every, whole, split_by

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").partitionBy(*self.split_by).parquet(f"{self.folder}/batch={batch_id}")

    def read(self, columns: T.StructType, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those below ``before``; ``columns`` are those of the rows."""
        schema = T.StructType([*columns.fields, T.StructField("batch", T.LongType())])
        merged = self._numbered("merged", "upto")
        top = max(merged, default=0)
        parts = []
        if merged:
            taken = [top] if self.whole else merged
            parts += [self.spark.read.schema(schema).parquet(f"{self.folder}/merged/upto={k}") for k in taken]
        single = [n for n in self._numbered("", "batch") if n >= top and (before is None or n < before)]
        if single:
            paths = [f"{self.folder}/batch={n}" for n in single]
            parts.append(self.spark.read.schema(schema).option("basePath", self.folder).parquet(*paths))
        found = parts[0] if parts else self.spark.createDataFrame([], schema)
        for part in parts[1:]:
            found = found.unionByName(part)
        return found if before is None else found.where(F.col("batch") < before)

    def tidy(self, columns: T.StructType, batch_id: int) -> bool:
        """Merge the batches below ``batch_id`` if there are enough of them; whether it did."""
        merged = self._numbered("merged", "upto")
        top = max(merged, default=0)
        if batch_id - top < self.every:
            return False
        rows = self.read(columns, before=batch_id)
        if not self.whole:
            rows = rows.where(F.col("batch") >= top)
        taken = [f"batch={n}" for n in self._numbered("", "batch") if top <= n < batch_id]
        taken += [f"merged/upto={top}"] if self.whole and merged else []
        # Files of a full size each, whatever the number of small ones and of cores; no rows are shuffled.
        rows = rows.coalesce(max(1, -(-sum(map(self._bytes, taken)) // FILE_BYTES)))
        rows.write.mode("overwrite").partitionBy(*self.split_by).parquet(f"{self.folder}/merged/upto={batch_id}")
        for n in self._numbered("", "batch"):
            if n < top:
                self._remove(f"batch={n}")
        if self.whole:
            for k in merged:
                if k < top:
                    self._remove(f"merged/upto={k}")
        return True

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbered(self, below: str, key: str) -> list[int]:
        """Numbers of the complete folders ``key=number``."""
        path, files = self._path(below)
        if not files.exists(path):
            return []
        names = [status.getPath().getName() for status in files.listStatus(path)]
        found = [int(n.split("=")[1]) for n in names if n.startswith(f"{key}=")]
        return sorted(n for n in found if files.exists(self._path(f"{below}/{key}={n}/_SUCCESS".lstrip("/"))[0]))

    def _bytes(self, name: str) -> int:
        path, files = self._path(name)
        return files.getContentSummary(path).getLength()

    def _remove(self, name: str) -> None:
        path, files = self._path(name)
        files.delete(path, True)
