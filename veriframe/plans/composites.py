"""Compositions: evidence contracts, decisions over passes, scoring, audits and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators import relational as R


def gate(df: DataFrame, rules: list[tuple[Column, str]], reasons: str = "reasons", ok: str = "healthy") -> DataFrame:
    """df with the reasons of all broken rules and whether there is none."""
    return df.withColumn(reasons, T.add_if(*rules)).withColumn(ok, F.size(reasons) == 0)


def decide(passes: DataFrame, key: str, attempt: str, reasons: str, most: int = 3, view: str = "view", distant: str = "distant") -> DataFrame:
    """passes with `decision`: retry (reasons, attempts left), unresolved (reasons, none left) or verified.

    A distant view at the last attempt is verified only if all earlier views of the key are distant as well.
    """
    before = Window.partitionBy(key).orderBy(attempt).rowsBetween(Window.unboundedPreceding, -1)
    far = F.coalesce(F.bool_and(F.col(view) == distant).over(before), F.lit(True))
    has = F.size(reasons) > 0
    mixed = (F.col(view) == distant) & (F.col(attempt) >= most) & ~F.col("_far")
    decision = F.when(has & (F.col(attempt) < most), "retry").when(has | mixed, "unresolved").otherwise("verified")
    return passes.withColumn("_far", far).withColumn("decision", decision).drop("_far")


def disagreements(passes: DataFrame, key: str, attempt: str, model: str, price: str, owned: Column | None = None, bound: Column | None = None) -> DataFrame:
    """passes with `disagrees`: the model is none of the earlier ones, or an earlier pass had the same model at another price.

    owned: passes whose models count, as the current or an earlier one; bound: earlier passes whose prices count. All do if left out.
    """
    yes = F.lit(True)
    marked = passes.withColumns({"_digits": T.digits_int(F.col(price)), "_owned": F.coalesce(yes if owned is None else owned, F.lit(False)), "_bound": F.coalesce(yes if bound is None else bound, F.lit(False))})

    def earlier(condition: Column, *same: str) -> Column:
        before = Window.partitionBy(key, *same).orderBy(attempt).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(condition.cast("int")).over(before), F.lit(0))

    known, priced = F.col(model).isNotNull(), F.col("_bound") & F.col("_digits").isNotNull()
    moved = F.col("_owned") & known & (earlier(F.col("_owned") & known) > 0) & (earlier(F.col("_owned"), model) == 0)
    repriced = known & F.col("_digits").isNotNull() & (earlier(priced, model) > earlier(priced, model, "_digits"))
    return marked.withColumn("disagrees", moved | repriced).drop("_digits", "_owned", "_bound")


def eligible(passes: DataFrame, flags: list[str], health: str, allowed: list[str]) -> DataFrame:
    """Passes whose flags all hold and whose health reasons are among the allowed ones."""
    ok = F.size(F.array_except(F.col(health), F.array(*map(F.lit, allowed)).cast("array<string>"))) == 0
    for f in flags:
        ok = ok & F.coalesce(F.col(f), F.lit(False))
    return passes.filter(ok)


def cascade(voters: DataFrame, key: str, buckets: dict[str, Column], rules: list[tuple[Column, str]], default: str) -> DataFrame:
    """key, the number of voters in each bucket, and `rule`: the first whose condition over these numbers holds."""
    counts = voters.groupBy(key).agg(*[F.count_if(c).alias(name) for name, c in buckets.items()], F.count(F.lit(1)).alias("voters"))
    return counts.withColumn("rule", T.first_match(*rules, default=default))


def electorate(votes: DataFrame, key: str, safe: Column, first: str, second: str, order: str) -> DataFrame:
    """Joint quorum over safe votes; a key with fewer than two of these gets nulls and the ownership `ambiguous`."""
    kept = votes.filter(safe)
    n = votes.groupBy(key).agg(F.count_if(safe).alias("safe"))
    joined = n.join(R.joint_quorum(kept, key, first, second, order), key, "left")
    few = F.col("safe") < 2
    return joined.select(key, F.when(~few, F.col(first)).alias(first), F.when(~few, F.col(second)).alias(second), F.when(few, "ambiguous").otherwise("owned").alias("ownership"))


def repeated_pair_veto(votes: DataFrame, key: str, first: str, second: str, matched: Column, safe: Column, least: int = 2) -> DataFrame:
    """key, veto: some pair has `least` matched votes or more, but fewer of these are safe. Votes without either value don't count."""
    counts = F.coalesce(matched, F.lit(False)) & T.present(F.col(first).cast("string")) & T.present(F.col(second).cast("string"))
    pairs = votes.groupBy(key, first, second).agg(F.count_if(counts).alias("_all"), F.count_if(counts & F.coalesce(safe, F.lit(False))).alias("_safe"))
    return pairs.groupBy(key).agg(F.bool_or((F.col("_all") >= least) & (F.col("_safe") < least)).alias("veto"))


def reconcile_counts(votes: DataFrame, key: str, count: str, distant: Column, nothing: Column, more: Column, one: Column, least: int = 3) -> DataFrame:
    """key, reconciled: how many objects the supporting votes agree on.

    distant, a condition that holds for all votes of a key or none: 0 where `nothing` does, too, else the least count, but
    `least` at least. Of other keys, two votes for `more` make it the largest count, `least` at least; else two for `one`
    make it 1; else it stays open (null).
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    far, none = F.bool_and(yes(distant)), F.bool_and(yes(nothing))
    value = (
        F.when(far & none, 0)
        .when(far, F.greatest(F.lit(least), F.coalesce(F.min(count), F.lit(least))))
        .when(F.count_if(yes(more)) >= 2, F.greatest(F.lit(least), F.coalesce(F.max(count), F.lit(least))))
        .when(F.count_if(yes(one)) >= 2, 1)
    )
    return votes.groupBy(key).agg(value.alias("reconciled"))


def first_evidence(passes: DataFrame, key: str, attempt: str, evidence: str) -> DataFrame:
    """key, evidence: of an array of structs with a cue, the first of each cue over all passes, by cue."""
    rows = passes.select(key, attempt, F.explode(evidence).alias("e")).withColumn("cue", F.col("e.cue"))
    return R.first_by(rows, [key, "cue"], [attempt]).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("cue", "e"))), lambda x: x["e"]).alias(evidence))


def extra_digit(majority: Column, current: Column, reference: Column) -> Column:
    """Whether the majority's price is the current one with a digit too many: at five times the reference, the current below three."""
    m, c = majority.cast("string"), current.cast("string")
    return T.one_inserted(m, c) & (majority >= 5 * reference) & (current <= 3 * reference)


def with_rollback(df: DataFrame, changes: dict[str, Column], invariant: Column) -> DataFrame:
    """df with the columns changed where the invariant, over the new values, holds; `applied` tells where."""
    trial = df.withColumns({f"_new_{c}": v for c, v in changes.items()}).withColumn("applied", F.coalesce(invariant, F.lit(False)))
    out = trial.withColumns({c: F.when(F.col("applied"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in changes})
    return out.drop(*[f"_new_{c}" for c in changes])


def whole_history_agrees(passes: DataFrame, key: str, values: list[str], clean: Column) -> DataFrame:
    """key, agrees: all clean passes say the same, and there is one."""
    n = F.count_distinct(F.when(clean, F.struct(*values)))
    return passes.groupBy(key).agg((n == 1).alias("agrees"))


def clean_runs(passes: DataFrame, keys: list[str], run: str, attempt: str, digest: str, clean: Column) -> DataFrame:
    """Of each key the newest run of two or three passes that ends with attempt 3, has one hash, and is clean throughout."""
    runs = passes.groupBy(*keys, run).agg(F.max(attempt).alias("last"), F.count(F.lit(1)).alias("n"), F.count_distinct(digest).alias("hashes"), F.bool_and(clean).alias("clean"))
    return R.latest_by(runs.filter("last = 3 and n in (2, 3) and hashes = 1 and clean"), keys, [run])


def score_manifest(cases: DataFrame, predictions: DataFrame, key: str, fields: list[str], latency: str) -> DataFrame:
    """One row: accuracy of each field and of all, mean latency, missing, duplicate and unknown ids, and the gate.

    Cases without exactly one prediction count as wrong. cases has the expected values under the same names.
    """
    one = R.exactly_one(cases.select(key, *[F.col(f).alias(f"want_{f}") for f in fields]), predictions, [key], [*fields, latency])
    right = {f: F.coalesce(F.col(f).eqNullSafe(F.col(f"want_{f}")) & (F.col("match") == "one"), F.lit(False)) for f in fields}
    exact = F.lit(True)
    for c in right.values():
        exact = exact & c
    mean = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    unknown = predictions.join(cases.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    scored = one.agg(
        *[mean(c).alias(f"{f}_rate") for f, c in right.items()], mean(exact).alias("exact_rate"), F.avg(F.col(latency).cast("double")).alias("mean_latency"),
        F.count_if(F.col("match") == "none").alias("missing"), F.count_if(F.col("match") == "several").alias("duplicate"), F.coalesce(F.bool_and(exact), F.lit(True)).alias("all_exact"),
    )
    return scored.join(F.broadcast(unknown)).withColumn("gate", F.col("all_exact") & (F.col("missing") + F.col("duplicate") + F.col("unknown") == 0)).drop("all_exact")


def promote(candidate: DataFrame, baseline: DataFrame, exact: str, risks: list[str]) -> DataFrame:
    """One row: whether the candidate's exact rate is strictly better and none of its risks is higher."""
    c, b = candidate.select(*[F.col(x).alias(f"c_{x}") for x in (exact, *risks)]), baseline.select(*[F.col(x).alias(f"b_{x}") for x in (exact, *risks)])
    ok = F.col(f"c_{exact}") > F.col(f"b_{exact}")
    for r in risks:
        ok = ok & (F.col(f"c_{r}") <= F.col(f"b_{r}"))
    return c.join(F.broadcast(b)).select(ok.alias("promote"))


def count_proof(checks: dict[str, tuple[DataFrame, DataFrame]], key: str) -> DataFrame:
    """One row: `issues`, the names of the pairs of frames whose distinct keys differ, and `complete`."""
    out = None
    for name, (a, b) in checks.items():
        x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
        one = x.join(y, key, "full_outer").agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    failed = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("name"))))
    return out.agg(failed.alias("issues")).withColumn("complete", F.size("issues") == 0)


def progress(discovered: DataFrame, summary: DataFrame, reruns: DataFrame) -> DataFrame:
    """folder, image_count, processed, ready, period, status: counts are the largest of three tables, the last status wins."""
    frames = [f.withColumn("_order", F.lit(i)) for i, f in enumerate((discovered, summary, reruns))]
    all_rows = frames[0].unionByName(frames[1], allowMissingColumns=True).unionByName(frames[2], allowMissingColumns=True)
    order = F.struct("_order", "status")
    return all_rows.groupBy(F.lower("folder").alias("folder")).agg(
        *[F.max(c).alias(c) for c in ("image_count", "processed", "ready")],
        F.min_by("period", F.when(F.coalesce("period", F.lit("")) != "", F.col("_order"))).alias("period"),
        F.max_by("status", F.when(F.coalesce("status", F.lit("")) != "", order)).alias("status"),
    )


def crossed_threshold(status: DataFrame, processed: str, total: str, last: str, step: int) -> DataFrame:
    """Rows whose processed count has passed another multiple of `step` since the last notice, with it and the percentage."""
    mark = F.floor(F.col(processed) / step) * step
    return status.withColumn("threshold", mark).filter((mark > F.col(last)) & (mark > 0)).withColumn("percent", F.bround(F.try_divide(F.col(processed) * 100.0, F.col(total)), 1))


def staged_groups(rows: DataFrame, reasons: str, contains: list[str], keys: list[str]) -> DataFrame:
    """Candidates grouped for a rerun: those with one of the wanted substrings in a reason (none wanted: all), by keys."""
    wanted = F.lit(True) if not contains else T.any_keyword(F.col(reasons), contains)
    return rows.filter(wanted).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("file_name")).alias("files"))


def frozen(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row: how many keys were added, removed and changed since the snapshot was taken, and whether none was."""
    d = R.snapshot_diff(expected, actual, key)
    out = d.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")])
    return out.withColumn("intact", F.col("added") + F.col("removed") + F.col("changed") == 0)


def review_queue(rows: DataFrame, year: str, reason: str, limit: int, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the year with the reason's substring (limit 0: all, at most 1000), and the years' and reasons' counts before that."""
    period = F.coalesce(F.substring("period", 1, 4), F.lit(""))
    years = rows.groupBy(period.alias("year")).agg(F.count(F.lit(1)).alias("n"))
    reasons = rows.select(F.explode(T.split_set(F.col("reasons"))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    kept = rows.filter((F.lit(year) == "") | (period == year)).filter((F.lit(reason) == "") | (F.instr(F.col("reasons"), reason) > 0))
    kept = kept.orderBy(*order)
    return (kept.limit(min(limit, 1000)) if limit > 0 else kept), years, reasons
