"""Keyed state with timers, initial values and expiry: delayed retries, lifetime counters and lasting sets on streams.

All are stateful processors of Structured Streaming, kept by the RocksDB store; `rocksdb` sets it for the queries started
within. Each docstring says which batch result the stream must equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def rocksdb(spark: SparkSession, idle: bool = True):
    """Within, queries start with the state store that these processors need; afterwards settings are as before.

    idle: whether batches without data run, as event-time timers need; state that expires by the clock would ask for
    them without end, so a stream that is to stop must do without.
    """
    wanted = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", _IDLE: str(idle).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def wait_seconds(attempt: int, base: int = 15, most: int = 300) -> int:
    """What functions.text.backoff_seconds gives: doubling from `base`, at most `most`."""
    return min(most, base * 2 ** min(attempt - 1, 5))


class _Retries(StatefulProcessor):
    def __init__(self, transient: list[str], most: int):
        self.transient, self.most = [t.lower() for t in transient], most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getListState("attempts", "at long, error string")
        self.waiting = handle.getMapState("waiting", "due long", "attempts int")
        self.dead = handle.getValueState("dead", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        failures = sorted((r["at_ms"], r["error"] or "") for r in rows)
        if self.dead.exists():
            return
        n = sum(1 for _ in self.attempts.get()) if self.attempts.exists() else 0
        for at, error in failures:
            n += 1
            self.attempts.appendValue((at, error))
            if n >= self.most or not any(t in error.lower() for t in self.transient):
                self.dead.update((at,))
                yield Row(job=key[0], kind="dead", attempts=n, at_ms=at, due_ms=None)
                return
            due = at + 1000 * wait_seconds(n)
            self.waiting.updateValue((due,), (n,))
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        (n,) = self.waiting.getValue((due,))
        self.waiting.removeKey((due,))
        if not self.dead.exists() or self.dead.get()[0] > due:
            yield Row(job=key[0], kind="retry", attempts=n, at_ms=due - 1000 * wait_seconds(n), due_ms=due)

    def close(self) -> None:
        pass


def delayed_retries(failures: DataFrame, key: str, at: str, error: str, transient: list[str], most: int = 10, late: str = "0 seconds") -> DataFrame:
    """job, kind, attempts, at_ms, due_ms: failed jobs that come back when their time has come, and dead letters.

    A job's failures are its attempts, in order of time. A failure with none of the transient marker words, or the `most`-th,
    kills the job: `dead`, at once, and nothing of it comes back later. Any other registers a timer, and the job comes back
    (`retry`) when the stream's time has passed the failure's by 15 seconds, doubled for each attempt up to 300. Failures up
    to `late` behind the newest are still put in order; two failures of a job with one due time come back once.

    Equal to a batch over all failures: numbered by time within the job up to the first deadly one, those whose time is due
    by the end of the stream and before the job's death.
    """
    named = failures.select(F.col(key).alias("job"), F.col(at).alias("at"), F.col(error).cast("string").alias("error"))
    timed = named.withWatermark("at", late).withColumn("at_ms", F.expr("unix_millis(at)"))
    kind = dict(timed.dtypes)["job"]
    schema = f"job {kind}, kind string, attempts int, at_ms long, due_ms long"
    return timed.groupBy("job").transformWithState(_Retries(transient, most), schema, "Append", "EventTime")


class _Lifetime(StatefulProcessor):
    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "n long")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.used.update((max(int(initialState["floor"] or 0), (self.used.get() or (0,))[0]),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        used, n = (self.used.get() or (0,))[0], sum(1 for _ in rows)
        allowed = max(0, min(self.cap - used, n))
        if allowed:  # each call of the store is a round trip
            self.used.update((used + allowed,))
        yield Row(key=key[0], allowed=allowed, capped=n - allowed)

    def close(self) -> None:
        pass


def floor_of(key: str, *known: DataFrame) -> DataFrame:
    """key, floor: the largest count that any of the frames (key, n) knows of a key: a trace, a checkpoint, a task's own."""
    out = None
    for f in known:
        f = f.select(key, F.col("n").cast("long").alias("n"))
        out = f if out is None else out.unionByName(f)
    return out.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("n").alias("floor"))


def lifetime_counter(stream: DataFrame, key: str, floor: DataFrame, cap: int = 3) -> DataFrame:
    """key, allowed, capped for each batch: with what `floor` (key, floor) says is used already, never more than `cap` a key.

    The floor is the state's initial value; keys that it lacks start from 0. Equal to a batch that allows each key
    least(rows, greatest(cap - floor, 0)).
    """
    kind = dict(stream.dtypes)[key]
    start = floor.select(key, "floor").groupBy(key)
    return stream.select(key).groupBy(key).transformWithState(_Lifetime(cap), f"key {kind}, allowed long, capped long", "Update", "None", initialState=start)


class _Sources(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sources = handle.getMapState("sources", "source string", "n long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        counts: dict[str, int] = {}
        for r in rows:
            counts[r[1]] = counts.get(r[1], 0) + 1
        for s, n in sorted(counts.items()):
            known = self.sources.getValue((s,))  # each call of the store is a round trip
            self.sources.updateValue((s,), (n + (known[0] if known else 0),))
            if not known:
                yield Row(key=key[0], source=s)

    def close(self) -> None:
        pass


def lasting_sources(stream: DataFrame, key: str, source: str, keep_days: int = 30) -> DataFrame:
    """key, source: each source of a key when it is first seen; the sets outlive restarts, and a source unseen for keep_days goes.

    A null source counts as an empty text. Equal to the distinct pairs of a batch, as long as none has expired; `held` reads
    the sets from the checkpoint. A key's set is dealt by a hash of the source over as many shares as there are partitions, so a
    few keys with many sources are not the work of a few tasks.
    """
    kind = dict(stream.dtypes)[key]
    named = stream.select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
    shares = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.withColumn("share", F.pmod(F.xxhash64("source"), F.lit(shares)).cast("int"))
    return dealt.groupBy("key", "share").transformWithState(_Sources(keep_days * 86_400_000), f"key {kind}, source string", "Append", "ProcessingTime")


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, source, n: what lasting_sources holds in a checkpoint, read from the state store itself."""
    rows = spark.read.format("statestore").option("stateVarName", "sources").load(checkpoint)
    return rows.select("key.key", "user_map_key.source", F.col("user_map_value.value.n").alias("n"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", idle: bool = True) -> None:
    """A stream, until all that is there has been read, into Parquet; started again with its checkpoint, it goes on from there."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with rocksdb(stream.sparkSession, idle):
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
