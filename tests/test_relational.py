from pyspark.sql import functions as F

from veriframe.operators import relational as R
from veriframe.plans import composites as C


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_lookups_never_fan_out(spark):
    build = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (3, "d")], "k int, v string")
    probe = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    assert rows(R.unique_lookup(probe, build, ["k"], "v"), "k", "v", "lookup") == [(1, "a", "matched"), (2, None, "ambiguous"), (3, "d", "matched"), (4, None, "missing")]
    assert rows(R.exactly_one(probe, build, ["k"], ["v"]), "k", "v", "match") == [(1, "a", "one"), (2, None, "several"), (3, None, "several"), (4, None, "none")]


def test_quorum_rejects_ties(spark):
    votes = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "a", 1), (2, "b", 2), (3, None, 1), (4, "x", 1), (4, "x", 2), (4, "y", 3), (4, "y", 4)], "k int, v string, o int")
    assert rows(R.quorum(votes, "k", "v", "o"), "k", "winner") == [(1, "a"), (2, None), (3, None), (4, None)]


def test_joint_quorum_never_mixes_majorities(spark):
    votes = spark.createDataFrame([(1, "m", "p", 1), (1, "m", "q", 2), (1, "n", "q", 3), (2, "m", "p", 1), (2, "m", "p", 2)], "k int, a string, b string, o int")
    assert rows(R.joint_quorum(votes, "k", "a", "b", "o"), "k", "a", "b") == [(1, None, None), (2, "m", "p")]


def test_fuzzy_joins(spark):
    catalog = spark.createDataFrame([("S27HG806EF",), ("S27HG807EF",), ("S32FM703UC",), ("S27HG806CF",)], "v string")
    probe = spark.createDataFrame([("S27HG806E8",), ("S27HG806DF",), ("S32FM703",)], "p string")
    near = rows(R.unique_nearest(probe, catalog, "p", "v"), "p", "nearest")
    assert near == [("S27HG806DF", None), ("S27HG806E8", "S27HG806EF"), ("S32FM703", None)]
    assert rows(R.unique_completion(probe, catalog, "p", "v"), "p", "completion") == [("S27HG806DF", None), ("S27HG806E8", None), ("S32FM703", "S32FM703UC")]
    inside = spark.createDataFrame([("xx S32FM703UC yy",), ("S32FM703UC",)], "p string")
    assert rows(R.unique_embedded(inside, catalog, "p", "v"), "p", "embedded") == [("S32FM703UC", None), ("xx S32FM703UC yy", "S32FM703UC")]
    assert rows(R.unique_first_letter(spark.createDataFrame([("X32FM703UC",)], "p string"), catalog, "p", "v"), "alternative") == [("S32FM703UC",)]


def test_diff_sees_what_size_does_not(spark):
    a = spark.createDataFrame([("f", 10, "h1"), ("g", 1, "x"), ("n", 1, None)], "k string, size int, hash string")
    b = spark.createDataFrame([("f", 10, "h2"), ("h", 1, "x"), ("n", 1, None)], "k string, size int, hash string")
    assert rows(R.snapshot_diff(a, b, "k"), "k", "change") == [("f", "changed"), ("g", "removed"), ("h", "added")]
    assert C.frozen(a, b, "k").first().asDict() == {"added": 1, "removed": 1, "changed": 1, "intact": False}


def test_windows(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 3, 4), (1, 4, 1)], "k int, t int, n int")
    assert rows(R.sequence_total(df, "k", ["t"], "n"), "k", "total") == [(1, 10)]
    assert rows(R.last_three(df, ["k"], ["t"]), "t", "attempt") == [(2, 1), (3, 2), (4, 3)]
    assert rows(R.gap_check(df, "k", "n"), "k", "gap", "floor") == [(1, True, 3)]
    assert rows(R.breaker(df, "k", ["t"], F.col("n") >= 3, 3), "failures") == [(3,)]
    assert rows(R.numbered_names(spark.createDataFrame([("A", 1), ("a", 2)], "n string, o int"), "n", ["o"]), "target") == [("A",), ("a_2",)]


def test_score_keeps_missing_and_duplicates_in_the_denominator(spark):
    cases = spark.createDataFrame([("a", "m"), ("b", "n")], "id string, model string")
    predictions = spark.createDataFrame([("a", "m", 1.0), ("a", "m", 2.0), ("z", "m", None)], "id string, model string, ms double")
    got = C.score_manifest(cases, predictions, "id", ["model"], "ms").first()
    assert (got["exact_rate"], got["duplicate"], got["missing"], got["unknown"], got["gate"]) == (0.0, 1, 1, 1, False)


def test_decisions(spark):
    passes = spark.createDataFrame(
        [("a", 1, ["r"], "single"), ("a", 3, ["r"], "single"), ("b", 1, [], "single"), ("b", 3, [], "distant"), ("c", 2, [], "distant"), ("c", 3, [], "distant")], "k string, attempt int, reasons array<string>, view string"
    )
    got = rows(C.decide(passes, "k", "attempt", "reasons"), "k", "attempt", "decision")
    assert got == [("a", 1, "retry"), ("a", 3, "unresolved"), ("b", 1, "verified"), ("b", 3, "unresolved"), ("c", 2, "verified"), ("c", 3, "verified")]
    votes = spark.createDataFrame([("a", "m", "10", True, 1), ("a", "m", "10", True, 2), ("b", "m", "1", True, 1), ("b", "m", "1", False, 2)], "k string, model string, price string, ok boolean, o int")
    assert rows(C.electorate(votes, "k", F.col("ok"), "model", "price", "o"), "k", "model", "price", "ownership") == [("a", "m", "10", "owned"), ("b", None, None, "ambiguous")]
    assert rows(C.disagreements(votes, "k", "o", "model", "price"), "k", "o", "disagrees") == [("a", 1, False), ("a", 2, False), ("b", 1, False), ("b", 2, False)]
    fixed = C.with_rollback(spark.createDataFrame([(1,), (5,)], "x int"), {"x": F.col("x") * 10}, F.col("_new_x") < 20)
    assert rows(fixed, "x", "applied") == [(10, True), (5, False)]
    counted = C.cascade(votes, "k", {"good": F.col("ok")}, [(F.col("good") >= 2, "majority")], "missing")
    assert rows(counted, "k", "rule") == [("a", "majority"), ("b", "missing")]
    assert spark.range(1).select(C.extra_digit(F.lit(129900), F.lit(12990), F.lit(13000)).alias("x")).first()["x"] is True


def test_upsert_and_progress(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(1, "", "z"), (3, "c", None)], "k int, v string, w string")
    assert rows(R.field_upsert(old, new, "k", ["w"]), "k", "v", "w", "change") == [(1, "a", "z", "updated"), (2, "b", "y", "kept"), (3, "c", None, "added")]
    d = spark.createDataFrame([("F", 5, 0, 0, "202601", "")], "folder string, image_count int, processed int, ready int, period string, status string")
    s = spark.createDataFrame([("f", 4, 3, 1, "", "running")], d.schema)
    assert rows(C.progress(d, s, s.limit(0)), "folder", "image_count", "processed", "period", "status") == [("f", 5, 3, "202601", "running")]


def test_best_overlap_reads_every_row(spark, tmp_path):
    from veriframe.plans import registry

    rows = [(s, p, float(q)) for s, p, q in ((1, 1, 50), (2, 1, 50), (1, 2, 3), (3, 2, 4), (1, 3, 5), (3, 3, 6), (3, 3, 45), (4, 9, 50))]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    sold = {(s, p) for s, p, _ in rows}
    want = []
    for s in {s for s, _ in sold}:
        shared = {o: sum((o, p) in sold for z, p in sold if z == s) for o, _ in sold if o != s}
        best = min(((-n, o) for o, n in shared.items() if n), default=None)
        want += [(s, best[1], -best[0])] if best else []
    got = registry.queries()["q14_best_overlap"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) == [(1, 3, 2), (2, 1, 1), (3, 1, 2)]


def test_disagreement_is_with_the_set_of_earlier_models(spark):
    from veriframe.plans import composites as C

    passes = [("a", 1, "A", "10", True), ("a", 2, "B", "10", True), ("a", 3, "A", "10", True), ("a", 4, "C", None, True), ("a", 5, "B", "1,1", True), ("b", 1, "X", "5", False), ("b", 2, "Y", "5", True), ("b", 3, None, "5", True), ("b", 4, "Z", "5", False)]
    df = spark.createDataFrame(passes, "k string, o int, model string, price string, owned boolean")
    flagged = lambda **kw: sorted((r["k"], r["o"]) for r in C.disagreements(df, "k", "o", "model", "price", **kw).filter("disagrees").collect())
    assert flagged() == [("a", 2), ("a", 4), ("a", 5), ("b", 2), ("b", 4)]
    assert flagged(owned=df["owned"], bound=df["o"] > 2) == [("a", 2), ("a", 4)]


def test_previous_row_over_ranges(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(7)
    got = {(r["k"], r["o"]): r["p"] and r["p"]["v"] for r in R.previous_row(df, "k", ["o"], ["v"], "p").collect()}
    last, want = {}, {}
    for k, o, v in rows:
        want[k, o] = last.get(k)
        last[k] = v
    assert got == want
    assert R.previous_row(df.limit(0), "k", ["o"], ["v"], "p").count() == 0


def test_no_group_is_in_two_splits(spark):
    df = spark.range(400).select((F.col("id") % 150).alias("u"), "id", F.when(F.col("id") % 150 % 13 > 0, F.col("id") % 150 % 13).alias("g"))
    rows = R.dataset_splits(df, "u", ["id"], "g").collect()
    assert len(rows) == 150 and all(r["u"] == r["id"] for r in rows)
    of = {}
    for r in rows:
        of.setdefault(r["g"], set()).add(r["split"])
    assert all(len(s) == 1 for s in of.values()) and {"train"} < set().union(*of.values())
