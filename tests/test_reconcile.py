import gzip
import random

from pyspark.sql import functions as F

from veriframe.functions import domain as D
from veriframe.operators import reconcile as N
from veriframe.operators import rules as S
from veriframe.plans import adjudication as A
from veriframe.sources import readers


def test_numbers_hold_across_splits(spark, tmp_path):
    rng, want = random.Random(1), set()
    for name in ("a.jsonl", "b.jsonl", "c.jsonl.gz"):
        lines = [rng.choice(['{"k": 1}', '{"k": "long ' + "x" * 90 + '"}', "", "[1]", "bad {"]) for _ in range(400)]
        want |= {(name, i + 1, x) for i, x in enumerate(lines) if x in ("[1]", "bad {")}
        with (gzip.open if name.endswith("gz") else open)(tmp_path / name, "wt") as f:
            f.write("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        bad = readers.numbered_errors(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert {(r["file"].split("/")[-1], r["number"], r["line"]) for r in bad.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_monologues(spark):
    cases = {
        "分析...\n獨白：我看到一台三十二吋的螢幕，標價一萬二。\n{": "我看到一台三十二吋的螢幕，標價一萬二。",
        "獨白：短。\n独白: 這個才夠長可以當作答案 JSON 結構": "這個才夠長可以當作答案",
        "草稿：獨白": "", "草稿：草稿：獨白：一段夠長的草稿文字在這裡 ```json": "一段夠長的草稿文字在這裡",
        "我看到前面的架子上有一台機器在賣\n1. 我看到這是一個列表的項目不算\n這台機器在中間的位置看得很清楚的\n{\n我看到這個在後面所以不算數的": "這台機器在中間的位置看得很清楚的",
        "這張判斷是分析用的不算是獨白吧": "", "我看到短的": "", "": "", None: "",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r["m"] for r in df.select("i", D.monologue(F.col("t")).alias("m")).orderBy("i").collect()] == list(cases.values())


def test_listing_statuses(spark):
    local = spark.createDataFrame([(1, "a", 5, "x"), (2, "b", 6, "y"), (3, "c", 7, "z"), (4, "d", 8, "w"), (5, "e", 9, "v"), (6, "f", 9, "v"), (7, "g", 1, None), (8, None, 2, "q")], "id int, name string, size int, md5 string")
    remote = [("other", 5, "x", 10), ("b", 6, "y", 20), ("b2", 6, "y", 21), ("c", 7, "changed", 30), ("d", 80, None, 40), ("e", 9, "v", 50), ("e", 9, "v", 51), ("g", 1, None, 70), ("f", 9, "v", 60)]
    there = spark.createDataFrame(remote, "name string, size int, md5 string, place int")
    got = {r["id"]: (r["status"], r["reason"], r["place"]) for r in N.reconcile_listing(local, there, "id", "name", ["size", "md5"], "place").collect()}
    assert got == {
        1: ("verified", "", 10), 2: ("verified", "", 20), 3: ("mismatch", "md5", 30), 4: ("mismatch", "size,md5", 40), 5: ("ambiguous", "content", None), 6: ("verified", "", 60),
        7: ("mismatch", "", 70), 8: ("missing", "", None),
    }


def test_shards_that_nobody_wants_are_not_read(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    S.write_shards(rows, str(tmp_path / "t"), "k", 16)
    wanted = spark.createDataFrame([(3,), (3,), (500,), (5000,), (None,)], "k long")
    found = N.scan_shards(spark, [str(tmp_path / "t")], wanted, "k", 16)
    assert sorted(r["k"] for r in found.collect()) == [3, 500]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in plan.replace("isnotnull(shard#", "shard").replace("PartitionFilters: [isnotnull", "PartitionFilters: [shard")
    read = {f.split("shard=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(read) <= 16 and "shard" not in found.columns
    assert N.scan_shards(spark, [str(tmp_path / "t")], wanted.limit(0), "k", 16).count() == 0


def test_replay_takes_the_first_rule_of_each_revision(spark):
    passes = spark.createDataFrame([("a", 1, 5), ("a", 2, 50), ("b", 1, None), ("c", 1, 7)], "k string, n int, v int")
    rules = spark.createDataFrame([("new", 2, "v > 4", "retry"), ("new", 1, "v > 40", "dead"), ("old", 1, "v > 6", "retry")], "revision string, priority int, condition string, decision string")
    got = {tuple(r) for r in N.revalidate(passes, "k", "n", rules, "old", "new").collect()}
    assert got == {("a", "retry", "dead", True), ("b", "verified", "verified", False), ("c", "retry", "retry", False)}


def test_health_relaxations(spark):
    cases = [
        (True, [], "x", 1, 1, 1, 1), (False, [], "x", 0, 0, 0, 0), (None, ["other"], A.DISTANT, 0, 0, 0, 0), (False, [A.LOCAL_CONFLICT[0]], A.DISTANT, 0, 1, 0, 1), (False, [A.LOCAL_CONFLICT[0]], A.SINGLE, 0, 0, 0, 1),
        (False, [A.FAMILY_CONFLICTS[2]], A.SINGLE, 0, 0, 1, 1), (False, list(A.FAMILY_CONFLICTS), A.DISTANT, 0, 0, 0, 1), (False, [A.FAMILY_CONFLICTS[2], "other"], A.DISTANT, 0, 0, 0, 0),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, h boolean, r array<string>, v string")
    h, r, v = F.col("h"), F.col("r"), F.col("v")
    got = df.select("i", A.usable(h, r, v), A.usable(h, r, v, True), A.intact(h, r), A.intact(h, r, True)).orderBy("i").collect()
    assert [tuple(map(int, x[1:])) for x in got] == [c[3:] for c in cases]


def test_final_rows_roll_back(spark):
    """A distant majority would erase the one pair that owned passes repeat: the key keeps nothing."""
    schema = "k string, n int, view string, screens int, main boolean, owner string, model string, price int, safe boolean, cues array<struct<cue:string,strength:string>>, flags array<string>, image string"
    far = lambda k, n, owner, model: (k, n, A.DISTANT, 0, False, owner, model, 9 if model else None, True, [("c", "strong")], None, "h")
    one = lambda k, n, model, price, safe=True, image="h": (k, n, A.SINGLE, 1, True, "matched", model, price, safe, [(str(n), "weak"), ("c", "weak")], None, image)
    rows = [far("a", 1, "x", None), far("a", 2, "x", None), far("a", 3, "x", None)]
    rows += [far("b", 1, "x", None), far("b", 2, "matched", "M"), far("b", 3, "x", None), one("b", 0, "M", 9)]  # its oldest pass does not count
    rows += [one("c", 1, "M", 9), one("c", 2, "M", 9), one("c", 3, "N", 9)]
    rows += [one("d", 1, "M", 9), one("d", 2, "M", 9, safe=False), one("d", 3, "N", 9)]
    rows += [one("e", 1, "M", 9), one("e", 2, "M", 9, image="other"), one("e", 3, "N", 9), one("f", 1, "M", 9), one("f", 2, "M", 9)]
    rows += [far("g", 1, "x", None), far("g", 2, "x", None), one("g", 3, "M", 9), one("h", 1, "M", 9), far("h", 2, "matched", "M"), far("h", 3, "matched", "M")]
    df = spark.createDataFrame(rows, schema)
    c, no = F.col, F.lit(False)
    of = A.buckets(c("view"), c("screens"), c("main"), c("owner"), no, no, no)
    got = {r["k"]: r for r in A.finalise(df, "k", "n", of, "flags", F.lit(True), "image").collect()}
    assert (got["a"]["rule"], got["a"]["screens"], [x["cue"] for x in got["a"]["cues"]]) == (A.NO_SCREEN_RULES[0], 0, ["c"])
    assert got["b"]["verified"] and got["b"]["model"] is None and got["b"]["support"] == [1, 3]
    assert (got["c"]["rule"], got["c"]["model"], got["c"]["price"], [x["cue"] for x in got["c"]["cues"]]) == ("two_pass_single_view_consensus", "M", 9, ["1", "c", "2", "3"])
    assert {k: got[k]["reason"] for k in "defgh"} == {"d": A.BLOCKED, "e": A.OTHER_IMAGE, "f": A.UNHEALTHY, "g": "", "h": A.MISSING}
    assert not any(got["d"][x] for x in ("rule", "view", "model", "price", "screens", "cues", "support"))
    erased = spark.createDataFrame([far("z", 1, "x", None), (*far("z", 2, "x", None)[:3], 0, False, "x", None, None, True, [], None, "h"), one("z", 3, "M", 9)], schema)
    pair = spark.createDataFrame([one("y", 1, "M", 9), (*one("y", 2, "M", 9)[:10], ["three_pass_zero_screen_scene_consensus"], "h"), (*one("y", 3, "M", 9)[:10], ["three_pass_zero_screen_scene_consensus"], "h")], schema)
    out = {r["k"]: r["reason"] for r in A.finalise(erased.unionByName(pair), "k", "n", of, "flags", F.lit(True), "image").collect()}
    assert out == {"z": "", "y": A.ERASED}


def test_last_three_of_very_many(spark):
    """A key with very many passes, dealt in any order, goes by its last three; nothing gathers them but windows."""
    many = spark.range(9000).select(F.lit("k").alias("k"), (F.col("id") * 7 % 9000).alias("n"), (-(F.col("id") * 7 % 9000)).alias("back"), F.lit(None).cast("array<string>").alias("flags"))
    passes = many.unionByName(many.filter("n < 2").withColumn("k", F.lit("two"))).repartition(3)
    for order in ((), ("n",)):
        decided = A.decide_view(passes, "k", "n", {"single": F.col("n") >= 8998}, "flags", ["back"], order=order)
        assert "Aggregate" not in decided._jdf.queryExecution().executedPlan().toString()
        got = {r["k"]: r for r in decided.collect()}
        assert {k: [(p["attempt"], p["back"]) for p in r["passes"]] for k, r in got.items()} == {"k": [(n, -n) for n in (8997, 8998, 8999)], "two": [(0, 0), (1, -1)]}
        assert {k: (r["rule"], [p["attempt"] for p in r["support"]]) for k, r in got.items()} == {"k": ("two_pass_single_view_consensus", [8998, 8999]), "two": (None, [])}


def test_injected_functions(spark):
    from veriframe.operators import injected as J

    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5), (3, "c", 2.0)], "k int, error string, v double")
    one = J.map_rows(df, lambda row: {"k": row["k"] * 2, "n": None if row["v"] is None else str(1 / (row["v"] - 2))}, "k long, n string")
    got = sorted(one.collect(), key=lambda r: (r["v"] is not None, r["v"]))
    assert [(r["k"], r["v"], r["n"], r["error"]) for r in got] == [(2, None, None, None), (4, 1.5, "-2.0", None), (None, 2.0, None, "ZeroDivisionError: float division by zero")] or got[2]["error"].startswith("ZeroDivisionError")
    assert J.map_rows(df.limit(0), lambda row: {}, "x int").count() == 0
    passes = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, None)], "k string, n int, v string")
    out = J.decide_rows(passes, "k", "n", lambda r, n, h: f"{r['v']}{n}{len(h)}").collect()
    assert sorted(r["decision"] for r in out) == ["None10", "x10", "y21"]
