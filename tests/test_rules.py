from pyspark.sql import functions as F

from veriframe.operators import rules as U
from veriframe.operators.relational import best_overlap


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_projections(spark):
    df = spark.createDataFrame([("a", "", None, ("x", "y"))], "k string, e string, n string, s struct<raw:string,ok:string>")
    assert df.select(U.sparse_json(["k", "e", "n"]).alias("j")).first()["j"] == '{"k":"a"}'
    assert U.without_fields(df, ["n", "raw"]).first().asDict(True) == {"k": "a", "e": "", "s": {"ok": "y"}}


def test_predicates(spark):
    df = spark.createDataFrame([("144", "144 Hz panel"), ("12900", "sale 12900"), (None, None)], "p string, t string")
    assert [r["x"] for r in df.select(U.display_spec(F.col("p"), F.col("t")).alias("x")).collect()] == [True, False, False]
    one = spark.createDataFrame([('so {"a": 1}', "yes", "", "in review", 7)], "t string, v string, r string, s string, n int")
    got = one.select(
        U.raw_structure(F.col("t")).alias("a"), U.review_state(F.col("r"), F.lit(None).cast("string"), F.col("s")).alias("b"), U.pass_label(F.col("n")).alias("c"), U.priority_rank(F.lit("P1")).alias("d"),
        U.is_complete(F.lit("distant"), F.lit(3), F.col("v"), F.col("r"), F.lit("e"), F.lit("run"), F.lit(None), F.lit(True), F.lit(True)).alias("e"), U.member(F.col("v"), []).alias("f"),
        U.trusted_hint(F.col("v"), F.lit("human"), F.lit("1"), ["human"], "1").alias("g"), U.is_stale(F.lit(None).cast("timestamp"), F.current_timestamp()).alias("h"),
        U.merge_allowed(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)), ["a"]).alias("i"),
    ).first()
    assert tuple(got) == (True, "review", "third", 2, True, True, True, True, {"a": 2})


def test_tables(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", None)], "k int, v string, n int")
    assert rows(U.update_where(df, F.col("n") > 5, {"v": F.lit("z")}), "v", "changed") == [("a", False), ("a", False), ("z", True)]
    safe, blocked = U.split_rows(df, F.col("n") > 5)
    assert safe.count() == 2 and blocked.count() == 1
    targets = spark.createDataFrame([(1, "t1"), (1, "t2"), (1, "t2")], "k int, target string")
    assert rows(U.expand_targets(df.filter("v = 'a'"), targets, ["k"], "target", "v"), "k", "target") == [(1, "t1"), (1, "t2"), (2, "a")]
    assert rows(U.authority_overlay(df.filter("n is null or n = 5"), spark.createDataFrame([(2, "q")], "k int, v string"), "k", ["v"]), "k", "v", "conflict") == [(1, "a", False), (2, "q", True)]
    assert rows(U.recent_average(df, "k", "v", "n", 1), "k", "average", "last") == [(1, 6.0, 6), (2, None, None)]
    votes = spark.createDataFrame([(1, "h", "h"), (1, "h", "h"), (2, "x", "y"), (2, "x", "y")], "k int, h string, c string")
    assert rows(U.secondary_majority(votes, "k", "h", "c"), "k", "holds") == [(1, True), (2, False)]
    assert rows(U.first_strategy(df.filter("k = 2"), df, key="k"), "k", "v", "strategy") == [(1, "a", 2), (1, "b", 2), (2, "a", 1)]
    assert rows(U.first_present(spark.createDataFrame([(1, 1, ""), (1, 2, "b"), (1, 3, "c")], "k int, o int, v string"), "k", "o", ["v"]), "v") == [("b",)]
    assert U.input_fingerprint(df, ["k", "v"]).first() == U.input_fingerprint(df.orderBy(F.desc("v")), ["v", "k"]).first()
    assert U.input_fingerprint(df, ["k", "v"]).first()["fingerprint"] != U.input_fingerprint(df.limit(2), ["k", "v"]).first()["fingerprint"]
    assert U.all_or_nothing(df, F.col("n").isNull()).count() == 0 and U.all_or_nothing(df, F.lit(False)).count() == 3
    assert rows(U.blockers(df, [(F.col("n").isNull(), "no_n"), (F.col("v") == "a", "is_a")]), "blocker", "n") == [("is_a", 2), ("no_n", 1), ("ready", 1)]
    assert rows(U.limited_rules(df, "v", "v", "k", most=2, chars=1), "v") == [("a",)]
    repaired = U.overlay_repairs(df, spark.createDataFrame([(2, "r", 9)], "k int, v string, n int"), ["k"], F.col("r.v") == F.col("n.v"))
    assert rows(repaired, "k", "v", "repaired") == [(1, "a", False), (1, "b", False), (2, "r", True)]
    assert rows(U.header_detail(df, targets, "k", F.col("v") == "a", F.col("target") == "t1"), "k", "target") == [(1, "t1")]


def test_suggestions_and_shards(spark, tmp_path):
    catalog = spark.createDataFrame([("S27AB",), ("S27AC",), ("X",)], "v string")
    got = rows(U.suggestions(spark.createDataFrame([("S27AX",)], "p string"), catalog, "p", "v", 2), "v", "distance", "rank")
    assert got == [("S27AB", 1, 1), ("S27AC", 1, 2)]
    U.write_shards(catalog, str(tmp_path / "s"), "v", 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3


def test_overlap_ties_go_to_the_smaller_key(spark):
    items = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "k int, i string")
    assert rows(best_overlap(items, items.withColumnRenamed("k", "o"), "i", "k", "o"), "k", "o") == [(1, 2), (2, 1), (3, 1)]


def test_overlap_counts_where_a_left_key_is(spark):
    """An item with more keys than a list holds; the pairs themselves are not shuffled, only the lists of right keys."""
    items = spark.range(1203).selectExpr("id k", "'x' i").union(spark.createDataFrame([(5, "y"), (1200, "y"), (5, "y")], "k long, i string"))
    best = best_overlap(items, items.withColumnRenamed("k", "o"), "i", "k", "o")
    got = rows(best, "k", "o", "shared")
    assert len(got) == 1203 and (5, 1200, 2) in got and (1200, 5, 2) in got and (0, 1, 1) in got and (7, 0, 1) in got
    plan = best._jdf.queryExecution().executedPlan().toString().splitlines()
    explode = next(i for i, line in enumerate(plan) if "Generate" in line)
    assert not any("Exchange" in line for line in plan[:explode])
