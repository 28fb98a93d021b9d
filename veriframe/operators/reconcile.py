"""Reconciling what is here with what is elsewhere: listings by content and name, rules by revision, shards by wanted keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.functions import text as T


def reconcile_listing(local: DataFrame, remote: DataFrame, key: str, name: str, content: Sequence[str], place: str) -> DataFrame:
    """key, status, reason, place: where each local object is in a remote listing, by content first, then by name.

    content: columns of both that stand for what is inside (size and MD5, say), the remote ones may be null. One remote object
    of the same content is `verified`; of several, the one that has the same name, if there is just one, else `ambiguous`.
    Without any, one object of the name is a `mismatch`, whose reason names the columns that differ (an unknown value
    does), several are `ambiguous`, none is `missing`. place is that of the remote object found. A null in the local content or
    name matches nothing.
    """
    there = remote.select(F.col(name).alias("_name"), F.col(place).alias(place), *[F.col(c).alias(f"_{c}") for c in content])
    one = lambda n, c: F.when(n == 1, c)
    by_content = there.groupBy(*[f"_{c}" for c in content]).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_one"))
    by_both = there.groupBy("_name", *[f"_{c}" for c in content]).agg(F.count(F.lit(1)).alias("_m"), F.min(place).alias("_same"))
    by_name = there.groupBy("_name").agg(F.count(F.lit(1)).alias("_k"), F.min(place).alias("_named"), *[F.min(f"_{c}").alias(f"_was_{c}") for c in content])
    on = lambda df, *more: [local[c] == df[f"_{c}"] for c in content] + list(more)
    joined = local.join(by_content, on(by_content), "left").drop(*[f"_{c}" for c in content])
    joined = joined.join(by_both, on(by_both, local[name] == by_both["_name"]), "left").drop("_name", *[f"_{c}" for c in content])
    joined = joined.join(by_name, local[name] == by_name["_name"], "left")
    differs = T.add_if(*[(~F.col(c).eqNullSafe(F.col(f"_was_{c}")), c) for c in content])
    found = F.coalesce(one(F.col("_n"), F.col("_one")), one(F.col("_m"), F.col("_same")))
    none = F.col("_n").isNull()
    status = F.when(found.isNotNull(), "verified").when(~none, "ambiguous").when(F.col("_k") == 1, "mismatch").when(F.col("_k") > 1, "ambiguous").otherwise("missing")
    reason = F.when(none & (F.col("_k") == 1), F.array_join(differs, ",")).when(~none & found.isNull(), "content").when(none & (F.col("_k") > 1), "name").otherwise("")
    return joined.select(key, status.alias("status"), reason.alias("reason"), F.coalesce(found, F.when(none, one(F.col("_k"), F.col("_named")))).alias(place))


def replay(passes: DataFrame, rules: DataFrame, revisions: Sequence[str], default: str = "verified") -> DataFrame:
    """passes with a column for each revision: the decision of its first rule that holds, else the default.

    rules is data: revision, priority, condition (an SQL expression over the columns of passes), decision. All revisions are
    evaluated in one pass over the stored rows. The table of rules is read by the driver, as it becomes part of the plan.
    """
    listed = rules.filter(F.col("revision").isin(*revisions)).orderBy("revision", "priority", "condition").collect()
    chains = {r: [(F.expr(x["condition"]), x["decision"]) for x in listed if x["revision"] == r] for r in revisions}
    return passes.withColumns({r: T.first_match(*[(F.coalesce(c, F.lit(False)), d) for c, d in chain], default=default) if chain else F.lit(default) for r, chain in chains.items()})


def revalidate(passes: DataFrame, key: str, attempt: str, rules: DataFrame, old: str, new: str) -> DataFrame:
    """key, old, new, changed: what the last stored pass of each key decides under two revisions of the rules."""
    decided = replay(passes, rules, [old, new]).groupBy(key).agg(F.max_by(F.struct(F.col(old).alias("old"), F.col(new).alias("new")), attempt).alias("d"))
    return decided.select(key, "d.old", "d.new", (F.col("d.old") != F.col("d.new")).alias("changed"))


def scan_shards(spark: SparkSession, paths: Sequence[str], wanted: DataFrame, key: str, shards: int = 256) -> DataFrame:
    """The rows of the wanted keys from traces that rules.write_shards wrote with as many shards, in one scan of them all.

    The shards that wanted keys hash to, a number each and no more than there are shards, become a partition filter, so that
    others are not read; the keys themselves are joined by a left semi join. A null key is wanted by nobody.
    """
    keys = wanted.select(key).filter(F.col(key).isNotNull()).distinct()
    hit = sorted(r[0] for r in keys.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")).distinct().collect())
    traces = None
    for p in paths:
        t = spark.read.parquet(p)
        traces = t if traces is None else traces.unionByName(t)
    return traces.filter(F.col("shard").isin(*hit) if hit else F.lit(False)).drop("shard").join(keys, key, "left_semi")
