"""Event windows, for batch and stream alike, and the stateful streams: tails, patches and job states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, column: str = "ts", late: str | None = None) -> DataFrame:
    """Event time as a timestamp with a zone; streams also get a watermark."""
    out = events.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, late) if late else out


def tumbling(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, event_type, n, total of each window of event time."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = timed(events, late=late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """user_id, start, finish, n of each user's sessions; a session ends a gap after its last event."""
    out = timed(events, late=late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def once(events: DataFrame, key: str, late: str) -> DataFrame:
    """Each event once, as far back as the watermark."""
    return timed(events, late=late).dropDuplicatesWithinWatermark([key])


def read_stream(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files, whether the table is one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


#: Parts of a patched table; a batch rewrites only those it touches.
BUCKETS = 64


def _versions(spark: SparkSession, base: str, before: int | None = None) -> dict[int, int]:
    """The version each bucket stands at: at most BUCKETS rows."""
    from tessera.sources.files import exists

    if not exists(spark, f"{base}/_versions"):
        return {}
    rows = spark.read.schema("bucket int, version long").json(f"{base}/_versions")
    rows = rows if before is None else rows.where(F.col("version") < before)
    return {r.bucket: r.version for r in rows.groupBy("bucket").agg(F.max("version").alias("version")).collect()}


def _read_buckets(spark: SparkSession, base: str, held: dict[int, int], like: DataFrame) -> DataFrame:
    """The rows of these buckets; one whose rows all went has no folder."""
    from tessera.sources.files import exists

    paths = [p for k, v in sorted(held.items()) if exists(spark, p := f"{base}/v{v}/bucket={k}")]
    return spark.read.schema(like.schema).parquet(*paths) if paths else like.limit(0)


def apply_patches(patches: DataFrame, base: str, key: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Apply each batch of (op, row) to the table at `base`, which is kept in buckets of keys. The buckets a batch touches are written
    anew under its number and become part of the table by one small pointer file, so a batch that is run again after a failure
    gives the same table, and a batch costs its own buckets, not the table."""

    def one(batch: DataFrame, number: int) -> None:
        from tessera.operators.merging import apply_patch

        spark = batch.sparkSession
        place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = [r.bucket for r in batch.select(place.alias("bucket")).distinct().collect()]
        if not touched:
            return
        held = {k: v for k, v in _versions(spark, base, number).items() if k in set(touched)}
        rows = _read_buckets(spark, base, held, batch.drop("op"))
        apply_patch(rows, batch, key).withColumn("bucket", place).write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/v{number}")
        pointers = spark.createDataFrame([(k, number) for k in touched], "bucket int, version long")
        pointers.coalesce(1).write.mode("append").json(f"{base}/_versions")

    return patches.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def patched_table(spark: SparkSession, base: str, like: DataFrame | None = None) -> DataFrame:
    held = _versions(spark, base)
    if like is None:
        first = spark.read.option("recursiveFileLookup", True).parquet(*{f"{base}/v{v}" for v in held.values()})
        like = first.limit(0)
    return _read_buckets(spark, base, held, like)


def token_events(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, seq, delta, done: a text as the events of its tokens, the last one empty and done; for batch and stream alike."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=\s)(?=\S)"), lambda x: x != "")
    events = F.concat(F.transform(parts, lambda x: F.struct(x.alias("delta"), F.lit(False).alias("done"))), F.array(F.struct(F.lit("").alias("delta"), F.lit(True).alias("done"))))
    return texts.select(*keys, F.posexplode(events).alias("seq", "e")).select(*keys, "seq", "e.delta", "e.done")


#: The states of a review job and those that may follow.
NEXT = {
    None: ("queued",),
    "queued": ("running", "failed"),
    "running": ("hitl_waiting", "completed", "failed"),
    "hitl_waiting": ("applying", "failed"),
    "applying": ("completed", "failed"),
    "completed": (),
    "failed": (),
}


def follow(state: str | None, asked: str) -> tuple[str | None, bool]:
    """The state after a request, and whether it was allowed."""
    return (asked, True) if asked in NEXT.get(state, ()) else (state, False)


def job_states(events: DataFrame) -> DataFrame:
    """A stream of (review_id, seq, asked) to (review_id, seq, state, allowed): each job's state is kept by key, requests that do not
    follow from it change nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get[0] if held.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, asked in zip(rows.seq, rows.asked, strict=True):
            state, ok = follow(state, asked)
            out.append((key[0], seq, state, ok))
        if state is not None:
            held.update((state,))
        yield pd.DataFrame(out, columns=["review_id", "seq", "state", "allowed"])

    return events.groupBy("review_id").applyInPandasWithState(step, "review_id string, seq long, state string, allowed boolean", "state string", "append", GroupStateTimeout.NoTimeout)


def run_all(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table of that name in memory; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, top: str) -> DataFrame:
    """Run a stream over all that is there, into Parquet files below `top`."""
    q = stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{top}/out")


class InOrder(StatefulProcessor):
    """A job's requests are followed in the order of their numbers 1, 2, ..., in whatever order and batch they come.

    A request whose turn has not come is held back until the gap closes, or until a timer gives the gap up; what is numbered below the
    next turn was answered or given up, and is dropped. In a terminal state the order is no matter: whatever comes is answered,
    and nothing is held any more.

    Each state variable is one value, read and written once a job and batch, as every access is a request to the engine; a job that
    has no answer in a batch yields no frame.
    """

    def __init__(self, key: str, wait_ms: int | None = None):
        self.key, self.wait_ms = key, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, state string")
        self.held = handle.getValueState("held", "seq array<long>, asked array<string>")

    def _drain(self, key: str, rows: dict[int, str], following: int, state: str | None, waiting: bool) -> Iterator[pd.DataFrame]:
        """The answers; afterwards `rows` holds what still waits. `waiting`: something is held in the state."""
        out = []
        while following in rows:
            state, ok = follow(state, rows.pop(following))
            out.append((key, following, state, ok))
            following += 1
        if NEXT.get(state) == ():
            out += [(key, seq, state, False) for seq in sorted(rows)]
            rows.clear()
        self.at.update((following, state))
        if rows:
            self.held.update((list(rows), list(rows.values())))
        elif waiting:
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=[self.key, "seq", "state", "allowed"])

    def _now(self) -> tuple[dict[int, str], int, str | None]:
        if (at := self.at.get()) is None:
            return {}, 1, None
        held = self.held.get()
        return dict(zip(*held, strict=True)) if held else {}, at[0], at[1]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, following, state = self._now()
        waiting = bool(held)
        for part in rows:
            for seq, asked in zip(part.seq, part.asked, strict=True):
                if seq >= following:
                    held.setdefault(int(seq), asked)  # a request that comes again is one
        yield from self._drain(key[0], held, following, state, waiting)
        if self.wait_ms and held and not waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, _, state = self._now()
        if held:
            yield from self._drain(key[0], held, min(held), state, True)
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def close(self) -> None:
        pass


def ordered_states(events: DataFrame, key: str = "review_id", wait_ms: int | None = None) -> DataFrame:
    """A stream of (key, seq, asked) to (key, seq, state, allowed) by the numbers' order; needs the RocksDB state store, which is set.
    With `wait_ms`, a gap is given up after that time; such a stream looks at its timers until it is stopped, even if all its input
    is read, so it is for triggers that go on. Without it gaps stay open."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.groupBy(key).transformWithStateInPandas(InOrder(key, wait_ms), f"{key} string, seq long, state string, allowed boolean", "Append", "ProcessingTime" if wait_ms else "None")
