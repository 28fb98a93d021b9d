from pyspark.sql import functions as F

from veriframe.streaming import jobs, state

SCHEMA = "job int, s long, error string, at timestamp"


def arrivals(spark, path, *batches):
    """A stream of batches of (job, second, error) rows, one file each."""
    for rows in batches:
        df = spark.createDataFrame(rows, "job int, s long, error string").withColumn("at", F.timestamp_seconds(F.col("s") + 100))
        df.coalesce(1).write.mode("append").parquet(path)
    return jobs.file_stream(spark, path, SCHEMA, files=1)


def test_retries_come_back_in_time_and_die_at_the_cap(spark, tmp_path):
    batches = [
        [(1, 0, "Timeout"), (2, 5, "no such file"), (3, 7, None)],
        [(1, 20, "timeout again"), (4, 21, "TIMEOUT")],  # job 1 came back at 15, and comes back at 50
        [(1, 40, "timeout"), (4, 30, "broken")],  # its third attempt kills it before that; job 4 dies before it is due
        [(9, 1000, "timeout")],  # time passes
    ]
    stream = arrivals(spark, str(tmp_path / "in"), *batches)
    out = str(tmp_path / "out")
    state.run_to_end(state.delayed_retries(stream, "job", "at", "error", ["timeout"], most=3), out, str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(out).drop("batch").collect()}
    assert got == {(2, "dead", 1, 105_000, None), (3, "dead", 1, 107_000, None), (1, "retry", 1, 100_000, 115_000), (1, "dead", 3, 140_000, None), (4, "dead", 2, 130_000, None)}


def test_waiting_is_what_columns_say(spark):
    from veriframe.functions.text import backoff_seconds

    rows = spark.range(1, 12).select("id", backoff_seconds(F.col("id")).alias("w")).collect()
    assert [state.wait_seconds(r["id"]) for r in rows] == [r["w"] for r in rows]


def test_second_run_never_allows_more_than_the_rest(spark, tmp_path):
    rows = [(j, i, "x") for j in range(4) for i in range(j)]  # job 0 has none, 1 one, 2 two, 3 three rows
    stream = arrivals(spark, str(tmp_path / "in"), rows)
    nothing = spark.createDataFrame([], "job int, n long")
    state.run_to_end(state.lifetime_counter(stream, "job", state.floor_of("job", nothing), cap=2), str(tmp_path / "a"), str(tmp_path / "s1"), "update")
    first = spark.read.parquet(str(tmp_path / "a")).groupBy(F.col("key").alias("job")).agg(F.sum("allowed").alias("n"))
    assert {tuple(r) for r in first.collect()} == {(1, 1), (2, 2), (3, 2)}
    trace = spark.createDataFrame([(1, 0), (5, 9), (None, 3)], "job int, n int")
    state.run_to_end(state.lifetime_counter(stream, "job", state.floor_of("job", first, trace), cap=2), str(tmp_path / "b"), str(tmp_path / "s2"), "update")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "b")).drop("batch").collect()} == {(1, 1, 0), (2, 0, 2), (3, 0, 3)}


def test_sets_outlive_a_restart(spark, tmp_path):
    path, out, ck = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([(1, 0, "a"), (1, 1, "b"), (2, 2, None)], [(1, 3, "a"), (1, 4, "c")]):
        stream = arrivals(spark, path, rows)
        state.run_to_end(state.lasting_sources(stream, "job", "error"), out, ck, idle=False)
    assert {tuple(r) for r in state.held(spark, ck).collect()} == {(1, "a", 2), (1, "b", 1), (1, "c", 1), (2, "", 1)}
    assert sorted(tuple(r) for r in spark.read.parquet(out).drop("batch").collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "")]


def test_outbox_knows_its_history_without_reading_it(spark, tmp_path):
    path, published = str(tmp_path / "in"), []
    for rows in ([(1, 0, "a"), (1, 0, "a"), (2, 0, "b")], [(1, 9, "a"), (2, 0, "c")]):
        stream = arrivals(spark, path, rows)
        jobs.outbox(stream, F.lit(True), "job", lambda b, n: published.append(sorted((r["job"], r["error"]) for r in b.collect())), str(tmp_path / "out"), str(tmp_path / "s"), volatile=("s", "at")).awaitTermination()
    assert published == [[(1, "a"), (2, "b")], [(2, "c")]]


def test_sources_of_one_key_are_spread(spark, tmp_path):
    stream = arrivals(spark, str(tmp_path / "in"), [(1, i, f"s{i}") for i in range(40)])
    ck = str(tmp_path / "state")
    state.run_to_end(state.lasting_sources(stream, "job", "error"), str(tmp_path / "out"), ck, idle=False)
    held = spark.read.format("statestore").option("stateVarName", "sources").load(ck)
    assert held.select("key").distinct().count() > 1 and state.held(spark, ck).count() == 40


def test_counter_reads_its_key_alone(spark, tmp_path):
    stream = arrivals(spark, str(tmp_path / "in"), [(1, 0, "a")])
    counted = state.lifetime_counter(stream, "job", state.floor_of("job", spark.createDataFrame([], "job int, n long")))
    analyzed = counted._jdf.queryExecution().analyzed().toString()
    project = next(line for line in analyzed.splitlines() if "Project [job" in line)
    assert "error" not in project


def test_batches_are_files_in_equal_number(spark, tmp_path):
    from veriframe.plans.replays import event_stream

    events = spark.range(3000).selectExpr("id event_id", "timestamp_seconds(id) ts", "id % 7 user_id", "'click' event_type", "1.0D value", "'{}' props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    stream = event_stream(spark, str(tmp_path), "true", str(tmp_path / "in"), parts=3, least=400)
    seen = []
    query = stream.writeStream.foreachBatch(lambda b, n: seen.append(b.agg(F.count("*"), F.min("event_id"), F.max("event_id")).first())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in seen] == [(1000, 0, 999), (1000, 1000, 1999), (1000, 2000, 2999)]
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 6
