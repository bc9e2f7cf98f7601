"""Session settings and the shared scratch area."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_removed_at_end: set[str] = set()

# Set only on sessions this package builds; a session handed in is left alone.
_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join partitions even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Stream state on disk: keys of several days do not fit into memory.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app: str = "ledgerloom", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    # Python workers of a local session find this package where the driver has it.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[1]))
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared folder the cluster names for checkpoints.

    Where none is named, a local session uses its warehouse folder; any other
    must name one. What lies here is removed when the driver's JVM ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    mine = f"{root.rstrip('/')}/ledgerloom/{spark.sparkContext.applicationId}"
    if mine not in _removed_at_end:
        path = spark._jvm.org.apache.hadoop.fs.Path(mine)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _removed_at_end.add(mine)
    return f"{mine}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pinned(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Later reads see exactly the same rows even if executors are lost, which a
    recomputed range partitioning or a re-run stage would not promise.
    """
    return pinned_at(df, label)[0]


def pinned_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As :func:`pinned`, and the folder, for ``drop_scratch`` once nothing reads it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind them.

    Else these stay until the driver happens to collect its garbage, so that a job
    of several steps, each of which is written, has all their shuffles on disk at once.
    """
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def in_turn(spark: SparkSession, label: str) -> Callable[[DataFrame], DataFrame]:
    """Runs a part of a query on its own and keeps what it returns: parts need the disk of the largest, not of all."""

    def settle(part: DataFrame) -> DataFrame:
        with shuffles_dropped(spark):
            return pinned(part.coalesce(1), label)

    return settle


#: Bytes of columnar files whose rows one task of a join should take, about half a million of them.
FILE_BYTES_PER_TASK = 8 << 20


def tasks_for(read: DataFrame) -> int | None:
    """Tasks that the files behind ``read`` ask for; None where the session's own number is fine enough."""
    spark = read.sparkSession
    size = 0
    for file in read.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    needed = -(-size // FILE_BYTES_PER_TASK)
    return None if needed <= int(spark.conf.get("spark.sql.shuffle.partitions")) else needed


def spread(side: DataFrame, keys: Sequence[str], read: DataFrame) -> DataFrame:
    """``side`` of a join on ``keys``, cut as finely as the files behind the other side, ``read``, ask for.

    A join takes the finer of its sides' partitions, so that a task's rows do not
    grow with the tables. Where the session's own number is fine enough it stays.
    Rows to be grouped by keys that few of them share are cut likewise, ``read``
    being the rows themselves.
    """
    tasks = tasks_for(read)
    return side if tasks is None else side.repartition(tasks, *keys)
