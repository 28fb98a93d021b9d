"""Joins, votes, windows and set operations whose results are defined for ambiguous keys, ties and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


# Joins -----------------------------------------------------------------------------------------------------------------


def unique_lookup(probe: DataFrame, build: DataFrame, keys: Sequence[str], value: str, status: str = "lookup") -> DataFrame:
    """probe with build's value where the key has exactly one distinct value; status: matched, ambiguous or missing.

    Never fans out: the build side is one row for each key before the join.
    """
    one = build.groupBy(*keys).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("_v"))
    joined = probe.join(one, list(keys), "left")
    label = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "matched").otherwise("ambiguous")
    return joined.withColumn(status, label).withColumn(value, F.when(F.col("_n") == 1, F.col("_v"))).drop("_n", "_v")


def exactly_one(probe: DataFrame, build: DataFrame, keys: Sequence[str], columns: Sequence[str], status: str = "match") -> DataFrame:
    """probe with build's columns where exactly one build row has the key; status: one, none or several."""
    agg = [F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in columns]]
    joined = probe.join(build.groupBy(*keys).agg(*agg), list(keys), "left")
    label = F.when(F.col("_n").isNull(), "none").when(F.col("_n") == 1, "one").otherwise("several")
    return joined.select(*[F.col(c) for c in probe.columns], label.alias(status), *[F.when(F.col("_n") == 1, F.col(c)).alias(c) for c in columns])


def cascade_lookup(probe: DataFrame, stages: Sequence[tuple[DataFrame, Sequence[str]]], value: str) -> DataFrame:
    """The value from the first stage whose key is found exactly once; `stage` tells which (from 1), null if none."""
    out = probe
    for i, (build, keys) in enumerate(stages):
        one = build.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), F.min(value).alias(f"_v{i}")).filter("_c = 1").drop("_c")
        out = out.join(one, list(keys), "left")
    found = [F.col(f"_v{i}") for i in range(len(stages))]
    stage = F.coalesce(*[F.when(c.isNotNull(), F.lit(i + 1)) for i, c in enumerate(found)])
    return out.withColumn("stage", stage).withColumn(value, F.coalesce(*found)).drop(*[f"_v{i}" for i in range(len(stages))])


def full_outer_status(left: DataFrame, right: DataFrame, keys: Sequence[str], only_left: str, only_right: str, both: Column) -> DataFrame:
    """A full outer join with a status; `both` is a column over l.* and r.* for keys on both sides."""
    a, b = left.withColumn("_l", F.lit(True)).alias("l"), right.withColumn("_r", F.lit(True)).alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    status = F.when(F.col("r._r").isNull(), only_left).when(F.col("l._l").isNull(), only_right).otherwise(both)
    return a.join(b, on, "full_outer").select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], status.alias("status"))


def field_upsert(old: DataFrame, new: DataFrame, key: str, always_new: Sequence[str] = ()) -> DataFrame:
    """New rows over old ones, column by column: a blank does not overwrite, but for the columns always taken from new."""
    rest = [c for c in old.columns if c != key]
    o, n = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in rest], F.lit(True).alias("_o")), new.select(key, *[F.col(c).alias(f"_n_{c}") for c in rest if c in new.columns], F.lit(True).alias("_n"))

    def merged(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"_o_{c}")
        if c in always_new:
            return F.when(F.col("_n"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
        return F.when(_blank(F.col(f"_n_{c}")), F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}"))

    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "kept").otherwise("updated")
    return o.join(n, key, "full_outer").select(key, *[merged(c).alias(c) for c in rest], kind.alias("change"))


def guarded_overlay(durable: DataFrame, memory: DataFrame, key: str, value: str, proved: Column, unresolved: Column) -> DataFrame:
    """Memory wins, unless durable is proved (a column over d.*) and memory unresolved (over m.*)."""
    joined = durable.alias("d").join(memory.alias("m"), F.col(f"d.{key}") == F.col(f"m.{key}"), "full_outer")
    side = F.when(F.col(f"m.{key}").isNull(), "durable").when(F.col(f"d.{key}").isNull(), "memory").when(proved & unresolved, "durable").otherwise("memory")
    return joined.select(F.coalesce(f"d.{key}", f"m.{key}").alias(key), side.alias("side"), F.when(side == "durable", F.col(f"d.{value}")).otherwise(F.col(f"m.{value}")).alias(value))


def best_overlap(left: DataFrame, right: DataFrame, item: str, left_key: str, right_key: str, max_shared: int | None = None) -> DataFrame:
    """For each left key the right key that shares most distinct items; ties go to the smaller right key.

    Pairs are those that share an item; max_shared leaves out items that more right keys have, if given. An item's right keys
    go to its left keys as lists of up to 1,000, and pairs are made and counted only where all lists of a left key are: what is
    shuffled is a number for each pair, with no key or count beside it.
    """
    a, b = left.select(left_key, item).distinct(), right.select(right_key, item).distinct()
    if max_shared is not None:
        b = b.join(b.groupBy(item).count().filter(F.col("count") <= max_shared).select(item), item, "left_semi")
    part = F.floor((F.row_number().over(Window.partitionBy(item).orderBy(right_key)) - 1) / 1000)
    lists = b.withColumn("_part", part).groupBy(item, "_part").agg(F.collect_list(right_key).alias("_keys"))
    pairs = a.join(lists.hint("merge"), item).select(left_key, "_keys").repartition(left_key).select(left_key, F.explode("_keys").alias(right_key))
    counts = pairs.filter(F.col(left_key) != F.col(right_key)).groupBy(left_key, right_key).agg(F.count(F.lit(1)).alias("shared"))
    best = F.min_by(F.struct(right_key, "shared"), F.struct(-F.col("shared"), F.col(right_key)))
    return counts.groupBy(left_key).agg(best.alias("b")).select(left_key, f"b.{right_key}", "b.shared")


def unique_completion(probe: DataFrame, catalog: DataFrame, probe_col: str, value_col: str, most: int = 3, family: int = 3) -> DataFrame:
    """probe with `completion`: the one catalog value that starts with it and is 1 to `most` characters longer, else null.

    Both sides meet by equality: every catalog value is filed under each of its prefixes that is so much shorter. Spark's
    estimate does not know how many these are, so they are kept from being broadcast.
    """
    cuts = F.explode(F.sequence(F.lit(1), F.lit(most)))
    filed = catalog.select(value_col).distinct().select(value_col, cuts.alias("cut")).filter(F.length(value_col) - F.col("cut") >= family)
    filed = filed.select(F.expr(f"left({value_col}, length({value_col}) - cut)").alias(probe_col), value_col)
    one = filed.groupBy(probe_col).agg(F.count(F.lit(1)).alias("_n"), F.min(value_col).alias("completion")).filter("_n = 1").drop("_n")
    return probe.join(one.hint("merge"), probe_col, "left")


def unique_embedded(probe: DataFrame, catalog: DataFrame, probe_col: str, value_col: str, least: int = 8) -> DataFrame:
    """probe with `embedded`: the one catalog value of `least` characters or more inside it and not equal to it, else null.

    Values and probes meet on the value's first `least` characters, which a value inside the probe shares with it.
    """
    values = catalog.select(value_col).distinct().filter(F.length(value_col) >= least).withColumn("_g", F.substring(value_col, 1, least))
    probes = probe.select(probe_col).distinct()
    grams = probes.filter(F.length(probe_col) > least).select(probe_col, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(probe_col) - least + 1), lambda i: F.substring(F.col(probe_col), i, F.lit(least))))).alias("_g"))
    hits = grams.hint("merge").join(values, "_g").filter(F.col(probe_col).contains(F.col(value_col)) & (F.col(probe_col) != F.col(value_col)))
    one = hits.groupBy(probe_col).agg(F.count_distinct(value_col).alias("_n"), F.min(value_col).alias("embedded")).filter("_n = 1").drop("_n")
    return probe.join(one.hint("merge"), probe_col, "left")


def unique_first_letter(probe: DataFrame, catalog: DataFrame, probe_col: str, value_col: str) -> DataFrame:
    """probe with `alternative`: the one catalog value of the same length that differs in the first character alone."""
    values = catalog.select(value_col).distinct().withColumn("_t", F.expr(f"substring({value_col}, 2)"))
    probes = probe.select(probe_col).distinct().withColumn("_t", F.expr(f"substring({probe_col}, 2)"))
    hits = probes.hint("merge").join(values, "_t").filter((F.length(probe_col) == F.length(value_col)) & (F.col(probe_col) != F.col(value_col)))
    one = hits.groupBy(probe_col).agg(F.count(F.lit(1)).alias("_n"), F.min(value_col).alias("alternative")).filter("_n = 1").drop("_n")
    return probe.join(one.hint("merge"), probe_col, "left")


def near_pairs(probe: DataFrame, catalog: DataFrame, probe_col: str, value_col: str, most: int = 2, family: int = 3) -> DataFrame:
    """Probes and catalog values of the same first characters, each pair once, with their edit distance (`_d`), up to `most`.

    Both sides are filed under what is left of them with up to `most` characters deleted behind the family, as hashes, and meet
    by equality; texts within `most` edits have such a rest in common. So texts of one family meet only if they are close:
    no pair is made that is more than twice `most` apart. Null texts pair with nothing.

    The rests are many times the texts, which Spark's estimate does not know: without the hint it would broadcast them. A pair
    meets by several rests; counting them keeps the distance, which is dear, behind the step that makes pairs distinct.
    """
    from veriframe.functions.folds import deletions, osa_distance

    def filed(df: DataFrame, c: str) -> DataFrame:
        rest = F.explode(F.transform(deletions(F.substring(c, family + 1, 1 << 30), most), lambda t: F.xxhash64(F.substring(c, 1, family), t)))
        return df.select(c).filter(F.col(c).isNotNull()).distinct().select(c, rest.alias("_key"))

    pairs = filed(probe, probe_col).hint("merge").join(filed(catalog, value_col), "_key").groupBy(probe_col, value_col).agg(F.count(F.lit(1)).alias("_n"))
    same = F.substring(probe_col, 1, family) == F.substring(value_col, 1, family)
    distance = F.when(F.col("_n") > 0, osa_distance(F.col(probe_col), F.col(value_col), most))
    return pairs.filter(same).withColumn("_d", distance).drop("_n").filter(F.col("_d") <= most)


def _nearest(probe: DataFrame, catalog: DataFrame, probe_col: str, value_col: str, family: int = 3) -> DataFrame:
    """The probes that have one closest catalog value (see unique_nearest), each once, with `nearest` and `distance`.

    Texts have many times more rests for two edits than for one. So one edit is tried first; only probes with nothing so near,
    and the values of their families, are filed for two.
    """
    nearest = lambda c: F.struct("_d", c)

    def closest(texts: DataFrame, values: DataFrame, most: int) -> DataFrame:
        pairs = near_pairs(texts, values, probe_col, value_col, most, family)
        return pairs.groupBy(probe_col).agg(F.min(nearest(value_col)).alias("_b"), F.min("_d").alias("_m"), F.max_by(value_col, F.struct(-F.col("_d"), value_col)).alias("_z"))

    one = closest(probe, catalog, 1)
    far = probe.select(probe_col).filter(F.length(probe_col) >= 9).distinct().join(one.select(probe_col).hint("merge"), probe_col, "left_anti")
    salts = F.explode(F.sequence(F.lit(0), F.lit(15)))  # one family may have most values
    families = far.select(F.substring(probe_col, 1, family).alias("_f")).distinct().select("_f", salts.alias("_s"))
    salted = catalog.select(value_col, F.substring(value_col, 1, family).alias("_f"), F.pmod(F.hash(value_col), F.lit(16)).alias("_s"))
    values = salted.join(families.hint("merge"), ["_f", "_s"], "left_semi")
    best = one.unionByName(closest(far, values, 2))
    allowed = F.when(F.length(probe_col) >= 9, 2).when(F.length(probe_col) >= 8, 1).otherwise(0)
    unique = F.col("_z") == F.col(f"_b.{value_col}")  # of several that are closest, the first and the last differ
    return best.filter((F.col("_m") <= allowed) & unique).select(probe_col, F.col(f"_b.{value_col}").alias("nearest"), F.col("_m").alias("distance"))


def unique_nearest(probe: DataFrame, catalog: DataFrame, probe_col: str, value_col: str, family: int = 3) -> DataFrame:
    """probe with `nearest`: the one closest catalog value, at one edit (from 8 characters) or two (from 9), else null.

    Only values of the same first characters are compared, and of these only those that are close (see near_pairs).
    """
    return probe.join(_nearest(probe, catalog, probe_col, value_col, family).hint("merge"), probe_col, "left")


def staged_match(probe: DataFrame, catalog: DataFrame, probe_col: str, value_col: str) -> DataFrame:
    """probe with `matched` and `stage`: the value itself (exact), else its one completion, else its one nearest, else null.

    The nearest values are dear to find, so they are sought only for what no earlier stage has matched.
    """
    exact = catalog.select(F.col(value_col).alias(probe_col), F.lit(True).alias("_exact")).distinct().hint("merge")
    found = unique_completion(probe.join(exact, probe_col, "left"), catalog, probe_col, value_col)
    unmatched = found.filter(F.col("_exact").isNull() & F.col("completion").isNull())
    out = found.join(_nearest(unmatched, catalog, probe_col, value_col).hint("merge"), probe_col, "left")
    stage = F.when(F.col("_exact"), "exact").when(F.col("completion").isNotNull(), "completion").when(F.col("nearest").isNotNull(), "nearest")
    matched = F.when(F.col("_exact"), F.col(probe_col)).otherwise(F.coalesce("completion", "nearest"))
    return out.withColumns({"stage": stage, "matched": matched}).drop("_exact", "completion", "nearest", "distance")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, change: added, removed or changed, by null-safe comparison of all other columns."""
    rest = [c for c in before.columns if c != key]
    a = before.select(key, F.struct(*rest).alias("_a"))
    b = after.select(key, F.struct(*rest).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def pending(all_rows: DataFrame, done: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in none of the done sets."""
    out = all_rows
    for d in done:
        out = out.join(d.select(*keys), list(keys), "left_anti")
    return out


def veto_candidates(inventory: DataFrame, key: str, content: Sequence[str], done: Sequence[DataFrame]) -> DataFrame:
    """Inventory rows that are in no done set and whose key does not stand for different contents, each key once."""
    clear = inventory.groupBy(key).agg(F.count_distinct(F.struct(*content)).alias("_n"), *[F.min(c).alias(c) for c in content]).filter("_n = 1").drop("_n")
    return pending(clear, done, [key])


# Votes and checks ------------------------------------------------------------------------------------------------------


def quorum(votes: DataFrame, key: str, value: str, order: str, least: int = 2) -> DataFrame:
    """key, winner, n: the value with the most votes if it has `least` or more and no other as many; nulls don't vote."""
    counted = votes.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("_o"))
    top = counted.groupBy(key).agg(F.max("n").alias("_top"), F.max_by(value, F.struct("n", "_o", value)).alias("_v"), F.min_by(value, F.struct(-F.col("n"), "_o", value)).alias("_w"))
    alone = F.col("_v").eqNullSafe(F.col("_w"))  # of several values with most votes, the last and the first differ
    won = (F.col("_top") >= least) & alone
    keys = votes.select(key).distinct()
    return keys.join(top, key, "left").select(key, F.when(won, F.col("_v")).alias("winner"), F.when(won, F.col("_top")).alias("n"))


def joint_quorum(votes: DataFrame, key: str, first: str, second: str, order: str, least: int = 2) -> DataFrame:
    """key, first, second: both by quorum, or, if both have one but no pair of these has `least` votes, neither."""
    a = quorum(votes, key, first, order, least).select(key, F.col("winner").alias(first))
    b = quorum(votes, key, second, order, least).select(key, F.col("winner").alias(second))
    pairs = votes.groupBy(key, first, second).agg(F.count(F.lit(1)).alias("_pair"))
    joined = a.join(b, key).join(pairs, [key, first, second], "left")
    keep = F.col(first).isNull() | F.col(second).isNull() | (F.coalesce("_pair", F.lit(0)) >= least)
    return joined.select(key, F.when(keep, F.col(first)).alias(first), F.when(keep, F.col(second)).alias(second))


def dependency_check(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, rows, values, consistent, for keys with several rows: whether all have one value."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(value).alias("values")).filter("rows > 1").withColumn("consistent", F.col("values") == 1)


def flag_duplicates(rows: DataFrame, key: Column, flag: str = "duplicate") -> DataFrame:
    """All members of keys that occur more than once are flagged."""
    keyed = rows.withColumn("_k", key)
    twice = keyed.groupBy("_k").count().filter("count > 1").select("_k", F.lit(True).alias(flag))
    return keyed.join(twice, "_k", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_k")


def gap_check(rows: DataFrame, key: str, number: str, cap: int = 3) -> DataFrame:
    """key, distinct numbers, largest, gap (they are not 1 to the largest), floor (the larger of both, at most cap)."""
    out = rows.groupBy(key).agg(F.count_distinct(number).alias("distinct"), F.max(number).alias("largest"), F.min(number).alias("_least"))
    gap = (F.col("distinct") != F.col("largest")) | (F.col("_least") < 1)
    return out.select(key, "distinct", "largest", gap.alias("gap"), F.least(F.lit(cap), F.greatest("distinct", "largest")).alias("floor"))


def consumed_floor(calls: DataFrame, key: str, run: str, attempt: str, call: str, cap: int = 3) -> DataFrame:
    """key, consumed, gap_runs: how many calls a key has used up at least, and in how many runs the attempts are not 1 to the last.

    The largest of its distinct calls, of its largest attempt, and of the sum over its runs of the larger of the run's rows
    and its largest attempt; at most `cap`.
    """
    runs = calls.groupBy(key, run).agg(F.count(F.lit(1)).alias("_n"), F.max(attempt).alias("_last"), F.min(attempt).alias("_least"), F.count_distinct(attempt).alias("_d"))
    gap = (F.col("_least") != 1) | (F.col("_d") != F.col("_last"))
    floors = runs.groupBy(key).agg(F.sum(F.greatest("_n", "_last")).alias("_sum"), F.max("_last").alias("_max"), F.count_if(gap).alias("gap_runs"))
    distinct = calls.groupBy(key).agg(F.count_distinct(call).alias("_calls"))
    return floors.join(distinct, key).select(key, F.least(F.lit(cap), F.greatest("_calls", "_sum", "_max")).cast("bigint").alias("consumed"), "gap_runs")


# Windows ---------------------------------------------------------------------------------------------------------------


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order, which should be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")


def first_by(rows: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")


def last_n(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def last_three(rows: DataFrame, keys: Sequence[str], order: Sequence[str], least: int = 3) -> DataFrame:
    """Of keys with `least` rows or more the last `least`, renumbered from 1 as `attempt`."""
    down = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    kept = rows.withColumn("_d", down).filter(F.col("_d") <= least)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return kept.withColumn("_n", n).filter(F.col("_n") >= least).withColumn("attempt", least + 1 - F.col("_d")).drop("_d", "_n")


def running_sum(rows: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with `name`, the sum of `value` over all rows before in the given total order, without bringing them to one task.

    Rows are dealt out by ranges of the order and written; each range goes on from the sum of those before it.
    """
    from veriframe.sources.readers import shared_folder

    spark = rows.sparkSession
    shared_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))  # a row for each range
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(before(Window.orderBy("_range"))), F.lit(0)).alias("_start"))
    within = F.coalesce(F.sum(value).over(before(Window.partitionBy("_range").orderBy(*order))), F.lit(0))
    return ranged.withColumn("_within", within).join(F.broadcast(starts), "_range").withColumn(name, F.col("_within") + F.col("_start")).drop("_range", "_within", "_start")


def previous_row(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """rows with `name`, a struct of the columns of the row before of the same key in the given total order; null for the first.

    Rows are dealt out by ranges of key and order, so that a key with most of the rows lies in many tasks; only the first row
    of a key in a range looks over the border, to the last row of that key in a range before. Null keys are one key.
    """
    from veriframe.sources.readers import shared_folder

    spark = rows.sparkSession
    shared_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, key, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    w = Window.partitionBy("_range", key).orderBy(*order)
    lasts = ranged.groupBy("_range", F.col(key).alias("_key")).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))  # a row for each range, about
    over = lasts.withColumn("_before", F.lag("_last").over(Window.partitionBy("_key").orderBy("_range"))).select(F.col("_range").alias("_r"), "_key", "_before")
    placed = ranged.withColumns({"_own": F.lag(F.struct(*columns)).over(w), "_nth": F.row_number().over(w)})
    joined = placed.join(over, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(name, F.when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col("_own"))).drop("_range", "_own", "_nth", "_r", "_key", "_before")


def class_sums(groups: DataFrame, count: str, classes: dict[str, Column]) -> DataFrame:
    """class, total: how many rows the grouped counts of each class add up to; a group may be in several classes, or none."""
    sums = groups.agg(*[F.coalesce(F.sum(F.when(F.coalesce(c, F.lit(False)), F.col(count))), F.lit(0)).alias(n) for n, c in classes.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("class"), F.col(n).cast("long").alias("total")) for n in classes])).alias("c")).select("c.*")


def dataset_splits(rows: DataFrame, unit: str, order: Sequence[str], group: str, ratios: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """The first row of each unit by order, with the split of its group: units come once, and no group is in two splits."""
    kept = first_by(rows, [unit], order)
    return kept.join(hash_split(kept, group, ratios).select(F.col(group).alias("_group"), "split"), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows with `name`, 1, 2, ... in the given total order over all rows."""
    return running_sum(rows.withColumn("_one", F.lit(1)), order, "_one", name).withColumn(name, F.col(name) + 1).drop("_one")


def hash_split(rows: DataFrame, group: str, ratios: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """group, rows, split: whole groups, by the order of their hashes, to train, dev and holdout by cumulative share.

    The running sum is over groups, dealt out by ranges of their hashes.
    """
    groups = rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows")).withColumn("_hash", F.sha2(F.col(group).cast("string"), 256))
    total = groups.agg(F.sum("rows").alias("_all"))
    share = running_sum(groups, ["_hash", group], "rows", "_b").join(F.broadcast(total))  # one row
    split = F.when(F.col("_b") < ratios[0] * F.col("_all"), "train").when(F.col("_b") < (ratios[0] + ratios[1]) * F.col("_all"), "dev").otherwise("holdout")
    return share.select(group, "rows", split.alias("split"))


def stratified_sample(rows: DataFrame, stratum: str, parts: Sequence[str], n: int) -> DataFrame:
    """n rows of each stratum, those with the least hashes of the parts."""
    digest = F.substring(F.sha1(F.concat_ws("|", *[F.col(p).cast("string") for p in parts])), 1, 12)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("digest", *parts))
    return rows.withColumn("digest", digest).withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def rolling_distinct(rows: DataFrame, key: str, time: str, value: str, seconds: int, least: int) -> DataFrame:
    """Rows at which `least` or more distinct values of the key came within the last `seconds`, with their number.

    Time is cut into spans of that length and every row is filed under its own span and the next, so that a key's rows are
    dealt out by span; only rows in their own span are asked for.
    """
    micros, length = F.unix_micros(F.col(time).cast("timestamp")), seconds * 1_000_000
    filed = rows.withColumns({"_t": micros, "_own": F.floor(micros / length)}).withColumn("_span", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    back = Window.partitionBy(key, "_span").orderBy("_t").rangeBetween(-length, 0)
    counted = filed.withColumn("distinct", F.size(F.collect_set(value).over(back)))
    return counted.filter((F.col("_span") == F.col("_own")) & (F.col("distinct") >= least)).drop("_t", "_own", "_span")


def bounded_counter(rows: DataFrame, key: str, order: Sequence[str], cap: int = 3) -> DataFrame:
    """Rows with `allowed`: whether they are among the first `cap` of their key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("call", rank).withColumn("allowed", F.col("call") <= cap)


def breaker(rows: DataFrame, key: str, order: Sequence[str], failed: Column, least: int = 5) -> DataFrame:
    """key, failures: islands of `least` or more failures in a row."""
    by = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_f", failed).withColumn("_island", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("_f").groupBy(key, "_island").agg(F.count(F.lit(1)).alias("failures")).filter(F.col("failures") >= least).drop("_island")


def sequence_total(rows: DataFrame, key: str, order: Sequence[str], number: str) -> DataFrame:
    """key, total: the largest numbers of all segments added up; a segment ends where the number falls."""
    by = Window.partitionBy(key).orderBy(*order)
    reset = F.when(F.col(number) < F.lag(number).over(by), 1).otherwise(0)
    island = F.sum("_reset").over(by.rowsBetween(Window.unboundedPreceding, 0))
    segments = rows.withColumn("_reset", reset).withColumn("_island", island).groupBy(key, "_island").agg(F.max(number).alias("_m"))
    return segments.groupBy(key).agg(F.sum("_m").alias("total"))


def sequence_restored(rows: DataFrame, key: str, order: Sequence[str], number: str) -> DataFrame:
    """key, total: as sequence_total, but after the first fall a number above the total so far is taken as a total itself.

    A fold over one key's numbers in order; null numbers and those below 1 are passed over.
    """
    kept = rows.filter(F.col(number) > 0).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(number).cast("bigint").alias("_n")))).alias("_all"))
    start = F.struct(*[F.lit(0).cast("bigint").alias(x) for x in ("total", "base", "highest", "last")])

    def step(a, row):
        n = row["_n"]
        fell = (a["last"] > 0) & (n < a["last"])
        base, highest = F.when(fell, a["total"]).otherwise(a["base"]), F.when(fell, F.lit(0)).otherwise(a["highest"])
        adopt = (base > 0) & (n > a["total"])
        top = F.greatest(highest, n)
        return F.struct(
            F.when(adopt, n).otherwise(F.greatest(a["total"], base + top)).alias("total"), F.when(adopt, F.lit(0).cast("bigint")).otherwise(base).alias("base"),
            F.when(adopt, n).otherwise(top).cast("bigint").alias("highest"), n.alias("last"),
        )

    return kept.select(key, F.aggregate("_all", start, step)["total"].alias("total"))


def numbered_names(rows: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """rows with `target`: the name, and from its second taker on with `_2`, `_3` and so on."""
    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(*order))
    return rows.withColumn("target", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n.cast("string"))))
