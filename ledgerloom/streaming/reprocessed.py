"""Alert on documents that arrive more than once within a day, and on rows too late to tell.

State is kept per document: for each day that is still open the number of rows
and their different times of day. A day closes when the watermark passes its
end; a timer then drops it. So a document's state holds the days within ``delay``
of the newest arrival, and a day at most as many times as it has seconds. Rows
of a closed day are counted nowhere and come out as a result of their own.

A day that the document's own rows of a batch are sure to close is counted and
told, but not stored: with the next batch it is closed, and nothing asks for it.

Each group of the processor costs several round trips to the JVM and a batch of
its own for what it yields, however few its rows. With ``buckets`` documents share
groups by a hash of their keys (:class:`OpenDaysOfMany`): the results are the same.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REPEATED, LATE = "REPETIDO", "ATRASADO"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = date(1970, 1, 1)

#: Groups of documents for streams of many: some hundred documents each where there are millions.
BUCKETS = 4096
_DAY_MS = 86_400_000


def as_instant(local: Column) -> Column:
    """A timestamp without zone read as UTC, whatever the zone of the session."""
    return F.timestamp_micros(
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), local)
    )


class OpenDays(StatefulProcessor):
    """Counts a document's rows by day, and sets aside rows of days that are closed."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The different times are whole seconds of the day, as 32-bit numbers in order.
        self.days = handle.getMapState("days", "dia int", "ocorrencias long, horarios binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # The next batch's watermark is at least what the rows of this one are sure to make it.
        watermark = sure = timerValues.getCurrentWatermarkInMs()
        arrived: dict[int, list[int]] = {}
        for row in rows:
            if (row._day + 1) * _DAY_MS <= watermark:
                yield self._row(key, LATE, row._day, row._second, None, None)
            else:
                arrived.setdefault(row._day, []).append(row._second)
                if row._sure is not None:
                    sure = max(sure, row._sure)
        # Each call is a round trip to the JVM: all days in one.
        stored = {day: tuple(value) for (day,), value in self.days.iterator()} if arrived else {}
        for day, seconds in arrived.items():
            count, times = stored.get(day, (0, b""))
            known = array("I", bytes(times))
            different = sorted({*known, *seconds})
            count += len(seconds)
            if (day + 1) * _DAY_MS > sure:
                if day not in stored:
                    self.handle.registerTimer((day + 1) * _DAY_MS)
                self.days.updateValue((day,), (count, array("I", different).tobytes()))
            if count > 1:
                yield self._row(key, REPEATED, day, None, count, len(different))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.days.removeKey((expiredTimerInfo.getExpiryTimeInMs() // _DAY_MS - 1,))
        yield from ()

    def _row(self, key, kind: str, day: int, second: int | None = None, count: int | None = None, different: int | None = None) -> Row:
        dia = _EPOCH + timedelta(days=day)
        at = None if second is None else datetime.combine(dia, datetime.min.time()) + timedelta(seconds=second)
        return Row(**dict(zip(self.keys, key)), tipo=kind, dia=dia, horario=at, ocorrencias=count, horarios_distintos=different)


class OpenDaysOfMany(OpenDays):
    """The same for all documents of a bucket: their open days are read and written as one list.

    A row is the bucket, the keys and the second since 1970. One timer, for the last
    of the days that are stored, empties a bucket to which no more rows come.
    """

    def __init__(self, fields: list[T.StructField], delay_ms: int | None):
        super().__init__([f.name for f in fields])
        self.delay_ms = delay_ms
        stored = [T.StructField("dia", T.IntegerType()), T.StructField("ocorrencias", T.LongType()), T.StructField("horarios", T.BinaryType())]
        self.schema = T.StructType([*fields, *stored])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getListState("days", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        newest, arrived = None, {}
        for _, *document, at in rows:
            day, second = divmod(at, 86_400)
            if (day + 1) * _DAY_MS <= watermark:
                yield self._row(document, LATE, day, second)
            else:
                arrived.setdefault((*document, day), []).append(second)
                newest = at if newest is None else max(newest, at)
        if not arrived:
            return
        stored = self._stored()
        last = max((day for *_, day in stored), default=None)
        for (*document, day), seconds in arrived.items():
            count, times = stored.get((*document, day), (0, b""))
            different = sorted({*array("I", times), *seconds})
            count += len(seconds)
            stored[*document, day] = (count, array("I", different).tobytes())
            if count > 1:
                yield self._row(document, REPEATED, day, None, count, len(different))
        # The next batch's watermark is at least what the rows of this one are sure to make it.
        sure = watermark if self.delay_ms is None else max(watermark, newest * 1000 - self.delay_ms)
        still = self._keep(stored, sure)
        if still and max(still) != last:
            self.handle.registerTimer((max(still) + 1) * _DAY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stored, closed = self._stored(), expiredTimerInfo.getExpiryTimeInMs()
        if any((day + 1) * _DAY_MS <= closed for *_, day in stored):
            self._keep(stored, closed)
        yield from ()

    def _stored(self) -> dict[tuple, tuple[int, bytes]]:
        """By keys and day the count and the times."""
        return {(*row[:-2],): (row[-2], bytes(row[-1])) for row in self.days.get()}

    def _keep(self, days: dict[tuple, tuple[int, bytes]], closed: int) -> set[int]:
        """Store the days that end after ``closed``, and return which they are."""
        still = [(*named, *value) for named, value in days.items() if (named[-1] + 1) * _DAY_MS > closed]
        if still:
            self.days.put(still)
        elif days:
            self.days.clear()
        return {row[-3] for row in still}


def repeated_keys(stream: DataFrame, keys: list[str], time: str, delay: str = "2 days", buckets: int | None = None) -> DataFrame:
    """Per document and day the count so far, if above one, and each late row.

    Columns: the keys, ``tipo`` (REPETIDO or ATRASADO), ``dia``, ``horario`` of a
    late row, and for repeated documents ``ocorrencias`` and
    ``horarios_distintos``. A row counts as late once its day ended ``delay``
    before the newest row that arrived with an earlier micro-batch. ``stream``
    has no watermark of its own, which could hold this one back. ``buckets``: over
    how many groups documents are dealt, a group for each if None; a checkpoint
    goes on with the number it was begun with.
    """
    second = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    marked = stream.where(F.col(time).isNotNull()).withColumn("_at", as_instant(F.col(time))).withWatermark("_at", delay)
    # Without the time column itself the late rows are not filtered out ahead of the processor.
    rows = marked.select(*keys, F.unix_date(F.to_date(time)).alias("_day"), second.cast("int").alias("_second"), _sure(time, delay).alias("_sure"))
    fields = [*[stream.schema[k] for k in keys], T.StructField("tipo", T.StringType()), T.StructField("dia", T.DateType())]
    fields += [T.StructField("horario", T.TimestampNTZType()), T.StructField("ocorrencias", T.LongType()), T.StructField("horarios_distintos", T.IntegerType())]
    if buckets is None:
        return rows.groupBy(*keys).transformWithState(OpenDays(keys), T.StructType(fields), "Update", "EventTime")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")
    at = F.unix_date(F.to_date(time)).cast("long") * 86_400 + second
    many = OpenDaysOfMany(fields[: len(keys)], _delay_ms(stream.sparkSession, delay))
    return marked.select(bucket, *keys, at.alias("_second")).groupBy("_bucket").transformWithState(many, T.StructType(fields), "Update", "EventTime")


def _delay_ms(spark: SparkSession, delay: str) -> int | None:
    """NULL for delays in months, which have no one length."""
    if "month" in delay.lower() or "year" in delay.lower():
        return None
    day = "TIMESTAMP_NTZ'2000-01-31 00:00:00'"
    return spark.sql(f"SELECT timestampdiff(MILLISECOND, {day} - INTERVAL '{delay}', {day})").first()[0]


def _sure(time: str, delay: str) -> Column:
    """The watermark, in milliseconds, that a row alone brings about; NULL for delays in months, which have no one length."""
    if "month" in delay.lower() or "year" in delay.lower():
        return F.lit(None).cast("long")
    local = F.col(time).cast("timestamp_ntz")
    return F.unix_millis(as_instant(local - F.expr(f"INTERVAL '{delay}'")))


@contextmanager
def _rocksdb(spark: SparkSession):
    """State with timers needs this store; the session's own choice is put back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class RepeatAlerts:
    """Stores what each micro-batch found; the latest count of a document and day is the alert.

    A batch that is replayed after a failure overwrites its own folder.
    """

    def __init__(self, keys: list[str], folder: str):
        self.keys = keys
        self.folder = folder.rstrip("/")

    def run(self, found: DataFrame) -> None:
        """Take in everything that has arrived, then stop; a later run goes on from there."""
        with _rocksdb(found.sparkSession):
            query = (
                found.writeStream.outputMode("update")
                .foreachBatch(self._store)
                .option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()

    def _store(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("tipo").parquet(f"{self.folder}/found/batch={batch_id}")

    def _found(self, like: DataFrame, kind: str) -> DataFrame:
        schema = T.StructType([*like.schema.fields, T.StructField("batch", T.LongType())])
        return like.sparkSession.read.schema(schema).parquet(f"{self.folder}/found").where(F.col("tipo") == kind)

    def alerts(self, like: DataFrame) -> DataFrame:
        """Documents seen more than once in a day; counts only grow, so the largest is current."""
        return self._found(like, REPEATED).groupBy("dia", *self.keys).agg(
            F.max("ocorrencias").alias("ocorrencias"), F.max("horarios_distintos").alias("horarios_distintos")
        )

    def late(self, like: DataFrame) -> DataFrame:
        """Rows that came when their day was closed."""
        return self._found(like, LATE).select("dia", *self.keys, "horario")
