"""Mixing sources to target weights by Poisson replication.

Each source gets a target repetition rate: its weight's share of the output over its share of the input. A document is
repeated as often as the inverse of the Poisson distribution with that mean says at a number in [0, 1) hashed from the
seed and the document; the copies are then dealt out in the order of another hash. Every step is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import cut, partitions

#: Terms of all sources' distributions (8 bytes each) up to which the table of rates is broadcast; beyond, it is joined
#: by a shuffle on the source.
BROADCAST_TERMS = 1_000_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by bars; null parts count as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def target_rates(docs: DataFrame, weights: dict[str, float] | None, size_col: str | None, total: float | None) -> DataFrame:
    """source, rate, cdf: the mean number of copies of each source, and P(copies <= k) for k = 0, 1, ...

    Sizes are sums of size_col (characters, say; null counts as 0), or rows if it is None. weights None: all sources
    alike. A source that has no weight, or no size, has the rate 0. `total` is the size of the output; None: the input's.
    """
    size = F.lit(1.0) if size_col is None else F.coalesce(F.col(size_col), F.lit(0)).cast("double")
    sizes = docs.groupBy("source").agg(F.sum(size).alias("size"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 0.0)], "source string, weight double")
        weighted = sizes.join(given, "source", "left").fillna(0.0, ["weight"])
    sums = weighted.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes"))  # one row
    rates = weighted.join(F.broadcast(sums)).select(
        "source",
        F.when((F.col("size") > 0) & (F.col("weights") > 0), F.col("weight") / F.col("weights") * (F.lit(total) if total is not None else F.col("sizes")) / F.col("size")).otherwise(0.0).alias("rate"),
    )
    # ln P(k) = ln P(k - 1) + ln r - ln k, from ln P(0) = -r; the terms beyond `top` are below 1e-16.
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    zero = F.struct(F.lit(0.0).alias("log_p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))

    def step(acc, k):
        log_p = F.when(k == 0, -F.col("rate")).otherwise(acc["log_p"] + F.log(F.col("rate")) - F.log(k.cast("double")))
        total_p = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total_p.alias("sum"), F.concat(acc["cdf"], F.array(total_p)).alias("cdf"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(0), top), zero, step)["cdf"]).otherwise(F.array(F.lit(1.0)))
    return rates.select("source", "rate", cdf.alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 20, id_col: str = "doc_id", size_col: str | None = None, total: float | None = None) -> DataFrame:
    """docs with each row repeated by its count, in shuffled order, with `copy` (from 1) and `mix_key`, the order's hash.

    The number of copies is a function of the seed and the id alone, so repeated rows with one id have the same count.
    Null ids draw as one id, and the null source is a source of its own. Columns of docs named `copy` or `mix_key` are
    replaced; all others, whatever their names, come back as they were. The rows are dealt out by hash over all partitions and sorted by it within each; an empty table stays so.
    """
    own = [c for c in docs.columns if c not in ("copy", "mix_key")]
    rates = cut(target_rates(docs, weights, size_col, total).select("source", "cdf"))
    if (rates.agg(F.sum(F.size("cdf"))).first()[0] or 0) <= BROADCAST_TERMS:
        rates = F.broadcast(rates)
    # The row is one column here, so that no helper can clash with a column of it.
    row_id = F.col("row")[id_col]
    drawn = docs.select(F.struct(*own).alias("row")).withColumn("u", uniform(F.lit(seed), row_id)).join(rates, F.col("row")["source"].eqNullSafe(F.col("source")), "left")
    copies = F.size(F.filter("cdf", lambda p: p <= F.col("u")))
    repeated = drawn.withColumn("n", copies).filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    keyed = repeated.select("row.*", "copy", F.md5(F.concat_ws("|", F.lit(f"{seed} order"), row_id.cast("string"), F.col("copy").cast("string"))).alias("mix_key"))
    return keyed.repartition(partitions(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")
