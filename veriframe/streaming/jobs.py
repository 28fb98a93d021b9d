"""Queues and keyed state as Structured Streaming: an outbox, a bounded counter, a rolling alarm.

Each has a batch twin in operators.relational that defines its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """A folder as a queue: its files, oldest first, at most `files` in one batch."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def outbox(stream: DataFrame, admit, key: str, publish: Callable[[DataFrame, int], None], target: str, checkpoint: str, volatile: tuple[str, ...] = ()) -> StreamingQuery:
    """Admitted rows to `target`, once for each key and content, and those that are new to `publish`.

    The content leaves out volatile columns. What has been seen is kept as state, so a batch costs what it brings, however
    long the history; a batch that is run again finds the state as it was before it, and its own folder, which it replaces.
    """
    stable = [c for c in stream.columns if c not in volatile]
    admitted = stream.filter(admit).withColumn("content", F.sha2(F.to_json(F.struct(*sorted(stable))), 256)).dropDuplicates([key, "content"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        publish(batch.sparkSession.read.parquet(f"{target}/batch={number}"), number)

    return admitted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bounded_counter(stream: DataFrame, key: str, cap: int = 3) -> DataFrame:
    """key, allowed, capped for each batch: at most `cap` rows of each key are allowed over the stream's life."""

    def update(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        n = sum(len(f) for f in frames)
        allowed = max(0, min(cap - used, n))
        state.update((used + allowed,))
        yield pd.DataFrame({key: [k[0]], "allowed": [allowed], "capped": [n - allowed]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, allowed long, capped long", "used long", "update", "NoTimeout")


def rolling_alarm(stream: DataFrame, key: str, time: str, source: str, seconds: int = 600, least: int = 3, retain: int = 12) -> DataFrame:
    """key, distinct, alarm for each batch: how many distinct sources a key had within `seconds` of its newest event.

    A source counts once, with its newest time, and at most the last `retain` sources of a key are held.
    """

    def update(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for f in frames:
            for s, t in zip(f[source].astype(str), f["_seconds"], strict=True):
                held[s] = max(float(t), held.get(s, float("-inf")))
        newest = max(held.values())
        live = sorted(((t, s) for s, t in held.items() if t >= newest - seconds), reverse=True)[:retain]
        state.update(([s for _, s in live], [t for t, _ in live]))
        yield pd.DataFrame({key: [k[0]], "distinct": [len(live)], "alarm": [len(live) >= least]})

    kind = dict(stream.dtypes)[key]
    timed = stream.withColumn("_seconds", F.unix_micros(F.col(time).cast("timestamp")) / 1e6)
    return timed.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, distinct long, alarm boolean", "sources array<string>, times array<double>", "update", "NoTimeout")


def split_failures(rows: DataFrame, error: str, transient: list[str], attempts: str = "attempts", now: float = 0.0, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Failed jobs to retry, with the time from which on, and the dead ones: by marker words and the number of attempts."""
    from veriframe.functions.text import any_keyword, backoff_seconds

    again = any_keyword(F.lower(error), [t.lower() for t in transient]) & (F.col(attempts) < most)
    retry = rows.filter(again).withColumn("retry_not_before", F.lit(now) + backoff_seconds(F.col(attempts)))
    return retry, rows.filter(~again)


def migrate_revision(jobs: DataFrame, column: str, revisions: dict[str, str]) -> DataFrame:
    """Jobs with their revision rewritten; one that is not listed fails the query."""
    table = F.create_map(*[F.lit(x) for kv in revisions.items() for x in kv])
    new = F.try_element_at(table, F.col(column))
    return jobs.withColumn(column, F.when(new.isNotNull(), new).otherwise(F.raise_error(F.concat(F.lit("unlisted revision "), F.coalesce(F.col(column), F.lit("null"))))))


def merge_queues(*queues: DataFrame, key: str, order: str) -> DataFrame:
    """Queues in order of priority, each key once, from the first queue that has it."""
    from veriframe.operators.relational import first_by

    tagged = None
    for i, q in enumerate(queues):
        q = q.withColumn("priority", F.lit(i))
        tagged = q if tagged is None else tagged.unionByName(q, allowMissingColumns=True)
    return first_by(tagged, [key], ["priority", order])
