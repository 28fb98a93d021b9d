"""Writers. Spark's commit protocol makes each of them all or nothing for one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.operators import relational as R


def fixed_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in this order as text: nested ones as JSON, absent and null ones empty, all others dropped."""

    def cell(c: str):
        if c not in df.columns:
            return F.lit("")
        nested = isinstance(df.schema[c].dataType, T.ArrayType | T.StructType | T.MapType)
        return F.coalesce(F.to_json(c) if nested else F.col(c).cast("string"), F.lit(""))

    return df.select(*[cell(c).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite", one_file: bool = False) -> None:
    """CSV with a header. one_file is for reports that are small by nature."""
    out = fixed_columns(df, columns)
    (out.coalesce(1) if one_file else out).write.mode(mode).csv(path, header=True, escape='"')


def write_buckets(df: DataFrame, path: str, bucket: str, mode: str = "overwrite") -> DataFrame:
    """A folder of CSV for each bucket; returns the counts."""
    df.write.mode(mode).partitionBy(bucket).csv(path, header=True, escape='"')
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows of keys that are not there yet as Parquet (first of a key by all columns); returns how many."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in df.columns]))
    fresh = df.withColumn("_r", rank).filter("_r = 1").drop("_r")
    spark = df.sparkSession
    from veriframe.sources.readers import _exists

    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh = fresh.cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def write_events(df: DataFrame, path: str, time: str, rows_per_file: int = 1_000_000) -> None:
    """Append gzip JSON Lines by day, in files of bounded length."""
    df.withColumn("event_date", F.to_date(time)).write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("event_date").json(path, compression="gzip")


def indexed_upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old (with `index`) and new: known keys are replaced and keep their index, others go on after the largest.

    The numbering runs over the new rows only, dealt out by ranges of their order.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    latest = new.withColumn("_r", rank).filter("_r = 1").drop("_r")
    replaced = latest.join(old.select(*keys, "index"), keys)
    added = latest.join(old.select(*keys), keys, "left_anti")
    top = old.agg(F.coalesce(F.max("index"), F.lit(0)).alias("_top"))
    added = R.numbered(added, [*order, *keys], "_n").join(F.broadcast(top)).withColumn("index", F.col("_n") + F.col("_top")).drop("_n", "_top")
    kept = old.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(replaced.select(*kept.columns)).unionByName(added.select(*kept.columns))


def summary_json(df: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One row, `value`: the aggregates as one JSON object, in the order given."""
    return df.agg(F.to_json(F.struct(*[c.alias(name) for name, c in counters.items()])).alias("value"))


def trace_rows(df: DataFrame, texts: dict[str, int], lists: dict[str, int], dropped: list[str] = ()) -> DataFrame:
    """df with texts cut to so many characters and lists to so many members, for a trace; heavy columns dropped."""
    short = {c: F.substring(c, 1, n) for c, n in texts.items()} | {c: F.slice(c, 1, n) for c, n in lists.items()}
    return df.drop(*dropped).withColumns(short)


def annotation_tasks(df: DataFrame, image: str, choices: list[str], texts: list[str]) -> DataFrame:
    """Rows as annotation task JSON, one text a row."""
    tag = lambda name, kind: F.struct(F.lit(name).alias("from_name"), F.struct(F.array(F.col(name).cast("string")).alias(kind)).alias("value"))
    results = F.concat(
        *[F.array(F.to_json(tag(c, "choices"))) for c in choices],
        *[F.array(F.to_json(tag(c, "text"))) for c in texts],
    )
    head = F.to_json(F.struct(F.col(image).alias("image")))
    return df.select(F.concat(F.lit('{"data":'), head, F.lit(',"annotations":[{"result":['), F.array_join(results, ","), F.lit("]}]}")).alias("value"))


def chat_lines(df: DataFrame, prompt: str, answer: str) -> DataFrame:
    """A training line in chat format for each row."""
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    return df.select(F.to_json(F.struct(F.array(turn("human", prompt), turn("gpt", answer)).alias("conversations"))).alias("value"))


def mistakes(df: DataFrame, wrong: str, correct: str) -> DataFrame:
    """Distinct (wrong, correct) pairs that differ other than in case."""
    return df.filter(F.lower(wrong) != F.lower(correct)).select(wrong, correct).distinct()
