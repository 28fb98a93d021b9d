import gzip
import json

from pyspark.sql import functions as F

from veriframe.operators import relational as R
from veriframe.sources import readers, sinks
from veriframe.streaming import jobs


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfname,note\nx,"two\nlines"\ny,\n')
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), ["name", "note", "absent"]).collect()
    assert [tuple(r) for r in got] == [("x", "two\nlines", ""), ("y", "", "")]
    assert readers.read_csv(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0
    df = spark.createDataFrame([("x", [1, 2])], "name string, nested array<int>")
    sinks.write_csv(df, str(tmp_path / "out"), ["nested", "name", "other"])
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first().asDict() == {"nested": "[1,2]", "name": "x", "other": None}
    (tmp_path / "f_202601").mkdir()
    (tmp_path / "f_202601/s.csv").write_text("a\n1\n")
    assert tuple(readers.read_csv_folders(spark, str(tmp_path / "*/s.csv"), ["a"]).first()) == ("1", "f_202601", "202601")


def test_json(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"k": 1}\n\n[2]\nbad ' + "ab" * 32 + "\n")
    good, bad = readers.read_jsonl(spark, str(tmp_path / "a.jsonl.gz"), "k int")
    assert [r["k"] for r in good.collect()] == [1] and bad.count() == 2
    assert [r["key"] for r in readers.poisoned_keys(bad).collect()] == ["ab" * 32]
    (tmp_path / "b.json").write_text(' [{"k": 1}, {"k": 2}]')
    assert readers.read_json_or_jsonl(spark, str(tmp_path / "b.json"), "k int").count() == 2
    task = {"data": {"image": "i", "ocr_meta": {"price": "9"}}, "annotations": [{"result": [{"from_name": "model", "value": {"text": ["M"]}}]}]}
    (tmp_path / "c.json").write_text(json.dumps(task))
    schema = "data struct<image:string,ocr_meta:map<string,string>>, annotations array<struct<result:array<struct<from_name:string,value:struct<choices:array<string>,text:array<string>>>>>>"
    assert tuple(readers.flatten_annotations(spark.read.schema(schema).json(str(tmp_path / "c.json")), ["model", "price"]).first()) == ("i", "M", "9")


def test_dimensions_and_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# c\na|1,200|s|t\n\nA|1300|u|v\nb|x|\n")
    assert [tuple(r) for r in readers.read_pipe_dimension(spark, str(tmp_path / "p.txt")).collect()] == [("A", 1300, "u", "v")]
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.JPG").write_bytes(b"1")
    (tmp_path / "img/b.txt").write_bytes(b"2")
    known, other = readers.scan_files(spark, str(tmp_path / "img"))
    assert known.count() == 1 and other.count() == 1
    html = spark.createDataFrame([("NT$12,900 x 售價: 9990 $100",)], "h string")
    assert html.select(readers.prices_in(F.col("h")).alias("p")).first()["p"] == [9990, 12900]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert sinks.append_new(df, str(tmp_path / "t"), "k") == 2
    assert sinks.append_new(df, str(tmp_path / "t"), "k") == 0
    old = spark.createDataFrame([(1, "x", 1)], "k int, v string, index int")
    assert sorted(tuple(r) for r in sinks.indexed_upsert(old, df, ["k"], ["v"]).collect()) == [(1, "b", 1), (2, "c", 2)]
    assert json.loads(sinks.annotation_tasks(df.limit(1), "k", ["v"], []).first()["value"])["data"] == {"image": 1}


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [(i, i % 3, "error" if i % 2 else "ok", i * 60) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, user long, kind string, s long").withColumn("ts", F.timestamp_seconds("s"))
    for i in range(4):
        df.filter(F.col("id") % 4 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "id long, user long, kind string, s long, ts timestamp"
    stream = lambda: jobs.file_stream(spark, str(tmp_path / "in"), schema, files=1)
    q = jobs.bounded_counter(stream(), "user", 3).writeStream.format("memory").queryName("counter").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["user"]: (r["a"], r["c"]) for r in spark.sql("select user, sum(allowed) a, sum(capped) c from counter group by user").collect()}
    want = {r["user"]: (r["a"], r["c"]) for r in R.bounded_counter(df, "user", ["id"], 3).groupBy("user").agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("c")).collect()}
    assert got == want
    published = []
    for _ in range(2):
        jobs.outbox(stream(), F.col("kind") == "error", "id", lambda b, n: published.append(b.count()), str(tmp_path / "out"), str(tmp_path / "c2"), volatile=("s",)).awaitTermination()
    assert sum(published) == 20 == spark.read.parquet(str(tmp_path / "out")).count()
    q = jobs.rolling_alarm(stream().filter("kind = 'error'"), "kind", "ts", "user").writeStream.format("memory").queryName("alarm").outputMode("update").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select max(distinct) m from alarm").first()["m"] == 3


def test_retries_and_queues(spark):
    failed = spark.createDataFrame([(1, "Timeout reached", 2), (2, "bad file", 1), (3, None, 1)], "id int, error string, attempts int")
    retry, dead = jobs.split_failures(failed, F.coalesce("error", F.lit("")), ["timeout"], now=100.0)
    assert [(r["id"], r["retry_not_before"]) for r in retry.collect()] == [(1, 130.0)] and dead.count() == 2
    a, b = spark.createDataFrame([(1, 5)], "k int, o int"), spark.createDataFrame([(1, 1), (2, 1)], "k int, o int")
    assert sorted((r["k"], r["priority"]) for r in jobs.merge_queues(a, b, key="k", order="o").collect()) == [(1, 0), (2, 1)]
