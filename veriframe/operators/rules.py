"""Row rules and small table operators: sparse projections, states, conditional updates, expansions, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators import relational as R


# Projections and predicates --------------------------------------------------------------------------------------------


def sparse_json(columns: Sequence[str]) -> Column:
    """The allowed columns as a JSON object without null and empty values."""
    return F.to_json(F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]))


def without_fields(df: DataFrame, heavy: Sequence[str]) -> DataFrame:
    """df without the heavy columns, and without fields of these names one level inside structs."""
    out = df.drop(*heavy)
    for f in out.schema.fields:
        inner = [x for x in getattr(f.dataType, "names", []) if x in heavy]
        if inner:
            out = out.withColumn(f.name, F.col(f.name).dropFields(*inner))
    return out


def member(c: Column, allowed: Sequence[str]) -> Column:
    """Membership in a set; an empty set lets everything pass."""
    return c.isin(*allowed) if allowed else F.lit(True)


def is_complete(view: Column, attempts: Column, verified: Column, review: Column, evidence: Column, run: Column, time: Column, current: Column, bound: Column) -> Column:
    """A record that needs no more work: verified, not under review, attempts enough for its view (three for distant, two for
    family, else one), bound to the current rules where its period asks for these, and with evidence and a trace of its run."""
    needed = F.when(view == "distant", 3).when(view == "family", 2).otherwise(1)
    traced = T.present(run) | T.present(time)
    return T.truthy(verified) & ~T.truthy(review) & (F.coalesce(attempts, F.lit(0)) >= needed) & (~current | bound) & T.present(evidence) & traced


def priority_rank(c: Column, order: Sequence[str] = ("P1", "P2")) -> Column:
    """0 for no priority, and more the earlier it stands in the order."""
    return F.coalesce(*[F.when(c == p, F.lit(len(order) - i)) for i, p in enumerate(order)], F.lit(0))


def review_state(review: Column, verified: Column, status: Column, words: Sequence[str] = ("review", "pending")) -> Column:
    """review, verified or unknown: an explicit review flag wins, then a verified one, then words in the status."""
    return F.when(T.truthy(review), "review").when(T.truthy(verified), "verified").when(T.any_keyword(F.lower(status), list(words)), "review").otherwise("unknown")


def display_spec(price: Column, context: Column) -> Column:
    """Whether the price's digits stand in the context as a size, rate or resolution rather than as a price."""
    unit = F.concat(F.lit(r"(?i)(?<![0-9])"), T.digits_int(price).cast("string"), F.lit(r"\s*(hz|nits|x\s*[0-9]|p\b|吋|inch)"))
    return F.coalesce(F.regexp_like(context, unit), F.lit(False))


def raw_structure(c: Column) -> Column:
    """Whether a prose holds a JSON object or array with a key."""
    return F.coalesce(c.rlike(r'(?s)[{\[].*"[^"]+"\s*:.*[}\]]'), F.lit(False))


def trusted_hint(locked: Column, provenance: Column, version: Column, allowed: Sequence[str], current: str) -> Column:
    return F.coalesce(T.truthy(locked) & provenance.isin(*allowed) & (version == current), F.lit(False))


def is_stale(time: Column, now: Column, hours: int = 24) -> Column:
    """Older than so many hours at `now`; an unknown time is stale."""
    return F.coalesce(time < now - F.make_dt_interval(hours=F.lit(hours)), F.lit(True))


def pass_label(attempt: Column, labels: Sequence[str] = ("first", "second", "third")) -> Column:
    """The label of an attempt, clamped to the labels there are."""
    return F.element_at(F.array(*map(F.lit, labels)), T.clamp(attempt, 1, len(labels)).cast("int"))


def merge_allowed(base: Column, changes: Column, allowed: Sequence[str]) -> Column:
    """A map with the changes of allowed keys over it."""
    kept = F.map_filter(changes, lambda k, _: k.isin(*allowed))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(kept, k)), kept)


# Tables ----------------------------------------------------------------------------------------------------------------


def update_where(df: DataFrame, predicate: Column, changes: dict[str, Column]) -> DataFrame:
    """The columns set together where the predicate holds, with `changed` for the count of it."""
    hit = F.coalesce(predicate, F.lit(False))
    marked = df.withColumn("changed", hit)
    return marked.withColumns({c: F.when(F.col("changed"), v).otherwise(F.col(c)) for c, v in changes.items()})


def split_rows(df: DataFrame, blocked: Column) -> tuple[DataFrame, DataFrame]:
    """Safe and blocked rows; a null condition is safe."""
    b = F.coalesce(blocked, F.lit(False))
    return df.filter(~b), df.filter(b)


def expand_targets(rows: DataFrame, targets: DataFrame, keys: Sequence[str], target: str, original: str) -> DataFrame:
    """A row for each distinct target of its key; rows without one keep their original name."""
    many = targets.select(*keys, F.col(target).alias("_t")).distinct()
    return rows.join(many, list(keys), "left").withColumn(target, F.coalesce("_t", original)).drop("_t")


def header_detail(headers: DataFrame, details: DataFrame, on: str, header_filter: Column, detail_filter: Column) -> DataFrame:
    """Details under the headers that name them, both filtered."""
    return headers.filter(header_filter).join(details.filter(detail_filter), on)


def authority_overlay(rows: DataFrame, authority: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the authority's columns over their own where its key is known, and `conflict` where these differ."""
    given = authority.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_known"))
    joined = rows.join(given, key, "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = joined.withColumn("conflict", F.coalesce(F.col("_known") & differs, F.lit(False)))
    return out.withColumns({c: F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_known", *[f"_{c}" for c in columns])


def recent_average(rows: DataFrame, key: str, order: str, value: str, n: int = 50) -> DataFrame:
    """key, average of the last n values, and the last one."""
    return R.last_n(rows, [key], [order], n).groupBy(key).agg(F.avg(value).alias("average"), F.max_by(value, order).alias("last"))


def secondary_majority(rows: DataFrame, key: str, value: str, current: str, least: int = 2) -> DataFrame:
    """key, holds: exactly one value has `least` votes or more, and it is the current one."""
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    won = counted.groupBy(key).agg(F.count(F.lit(1)).alias("winners"), F.min(value).alias("_v"))
    now = rows.groupBy(key).agg(F.max(current).alias("_c"))
    return now.join(won, key, "left").select(key, F.coalesce((F.col("winners") == 1) & (F.col("_v") == F.col("_c")), F.lit(False)).alias("holds"))


def first_strategy(*frames: DataFrame, key: str) -> DataFrame:
    """All rows of each key from the first strategy that has any, with its number (from 1)."""
    out = None
    for i, f in enumerate(frames, 1):
        f = f.withColumn("strategy", F.lit(i))
        out = f if out is None else out.unionByName(f)
    best = out.groupBy(key).agg(F.min("strategy").alias("strategy"))
    return out.join(best, [key, "strategy"], "left_semi")


def first_present(rows: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """The first present value of each column by order."""
    return rows.groupBy(key).agg(*[F.min_by(c, F.when(T.present(F.col(c).cast("string")), F.col(order))).alias(c) for c in columns])


def suggestions(probe: DataFrame, catalog: DataFrame, probe_col: str, value_col: str, limit: int = 4, family: int = 3, most: int = 3) -> DataFrame:
    """The closest catalog values of the probe's family, by edit distance and then by name, with their rank.

    All beyond `most` edits count as most + 1 and rank by name alone, so of these a family's first `limit` names are enough.
    """
    near = R.near_pairs(probe, catalog, probe_col, value_col, most, family).withColumnRenamed("_d", "distance")
    named = catalog.select(value_col).distinct().withColumn("_f", F.substring(value_col, 1, family))
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("_f").orderBy(value_col))).filter(F.col("_n") <= limit).drop("_n")
    asked = probe.select(probe_col).distinct().withColumn("_f", F.substring(probe_col, 1, family))
    far = asked.join(first, "_f").drop("_f").join(near.drop("distance"), [probe_col, value_col], "left_anti").withColumn("distance", F.lit(most + 1))
    rank = F.row_number().over(Window.partitionBy(probe_col).orderBy("distance", value_col))
    return near.unionByName(far).withColumn("rank", rank).filter(F.col("rank") <= limit)


def input_fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the number of rows and a hash of all of them that does not depend on their order.

    Rows are hashed one by one and the hashes summed in parts, so nothing is collected.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"p{i}") for i in range(8)]
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), *parts)
    return sums.select("rows", F.sha2(F.concat_ws("|", "rows", *[F.coalesce(F.col(f"p{i}"), F.lit(0)) for i in range(8)]), 256).alias("fingerprint"))


def limited_rules(rules: DataFrame, key: str, text: str, order: str, most: int = 12, chars: int = 2400) -> DataFrame:
    """The newest rule of each key, the newest `most` of these, as long as their texts stay within `chars` together."""
    newest = R.latest_by(rules, [key], [order]).orderBy(F.desc(order)).limit(most)  # bounded, so one window is enough
    w = Window.orderBy(F.desc(order))
    used = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return newest.withColumn("_u", used).filter(F.col("_u") <= chars).drop("_u")


def all_or_nothing(rows: DataFrame, unresolved: Column) -> DataFrame:
    """All rows if none is unresolved, else none; the count is a one-row aggregate."""
    bad = rows.agg(F.count_if(unresolved).alias("_bad"))
    return rows.join(F.broadcast(bad)).filter("_bad = 0").drop("_bad")


def blockers(rows: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """blocker, n: how many rows each rule blocks, and how many are free of all (`ready`)."""
    marked = rows.select(T.add_if(*rules).alias("b"))
    return marked.select(F.explode(F.when(F.size("b") == 0, F.array(F.lit("ready"))).otherwise(F.col("b"))).alias("blocker")).groupBy("blocker").agg(F.count(F.lit(1)).alias("n"))


def write_shards(rows: DataFrame, path: str, key: str, shards: int = 256) -> None:
    """Rows as Parquet by the hash of their key, so that one key lies in one shard; a shard of a hot key gets several files."""
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    rows.withColumn("shard", shard).write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).partitionBy("shard").parquet(path)


def overlay_repairs(rows: DataFrame, repairs: DataFrame, keys: Sequence[str], same: Column) -> DataFrame:
    """Rows replaced by their proved repair, unless `same` (over r.* and n.*) says it is there already."""
    columns = [c for c in rows.columns if c not in keys]
    joined = rows.alias("r").join(repairs.select(*keys, *columns, F.lit(True).alias("_n")).alias("n"), list(keys), "left")
    use = F.col("n._n").isNotNull() & ~F.coalesce(same, F.lit(False))
    return joined.select(*keys, *[F.when(use, F.col(f"n.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in columns], use.alias("repaired"))
