"""Audit queries over the driver tables: compositions of the library's operators, with the SQL that must agree."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriframe.functions import domain as D
from veriframe.functions import text as T
from veriframe.operators import relational as R
from veriframe.plans import composites as C
from veriframe.plans.catalogue import table
from veriframe.plans.registry import query


@query("q46_stream_outbox", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND value >= 5")
def q46(spark, sf):
    """The events table as a stream into an outbox, until all of it is read; what was published is the result."""
    from veriframe.sources.readers import shared_folder
    from veriframe.streaming.jobs import file_stream, outbox

    folder = f"{shared_folder(spark)}/outbox-{uuid.uuid4().hex}"
    kind = spark.read.parquet(f"{sf}/events.parquet").schema.simpleString().removeprefix("struct<").removesuffix(">")
    stream = file_stream(spark, f"{sf}/events.parque[t]", kind.replace(":", " "))
    outbox(stream, (F.col("event_type") == "error") & (F.col("value") >= 5), "event_id", lambda batch, n: None, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{folder}/out").select("event_id", "user_id", "event_type")


@query(
    "q47_receipt_staleness",
    """SELECT l_returnflag, count(*) AS n, count(*) FILTER (coalesce(NOT (l_shipdate > o_orderdate + INTERVAL 2 SECOND) OR l_linestatus = o_orderstatus, false)) AS trusted FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def q47(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ok = D.receipt_trusted(F.col("l_shipdate"), F.col("o_orderdate"), F.col("l_linestatus") == F.col("o_orderstatus"))
    return joined.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("trusted"))


@query(
    "q48_folder_audit",
    """WITH c AS (SELECT 'customers' AS name, count(*) AS n FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL
       UNION ALL SELECT 'parts', count(*) FROM (SELECT DISTINCT p_partkey AS k FROM part) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL)
       SELECT coalesce(array_to_string(list(name ORDER BY name) FILTER (n > 0), ';'), '') AS issues, coalesce(bool_and(n = 0), true) AS complete FROM c""",
)
def q48(spark, sf):
    k = lambda name, c: table(spark, sf, name).select(F.col(c).alias("k"))
    checks = {"customers": (k("customer", "c_custkey"), table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))), "parts": (k("part", "p_partkey"), k("lineitem", "l_partkey"))}
    return C.count_proof(checks, "k").select(F.array_join("issues", ";").alias("issues"), "complete")


@query(
    "q49_rename_plan",
    """WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') || '-' || p_type AS target FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY lower(target) ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY lower(target)) AS c FROM n)
       SELECT p_partkey, CASE WHEN i = 1 THEN target ELSE target || '_' || i END AS target, c > 1 AS conflict FROM r""",
)
def q49(spark, sf):
    """Target names from segments, numbered where taken; all members of a collision are flagged."""
    named = table(spark, sf, "part").select("p_partkey", T.build_name(T.sanitize_segment(F.col("p_name")), F.col("p_type")).alias("name"))
    flagged = R.flag_duplicates(named, F.lower("name"), "conflict")
    return R.numbered_names(flagged, "name", ["p_partkey"]).select("p_partkey", "target", "conflict")


@query(
    "q50_staged_groups",
    """SELECT l_suppkey, year(l_shipdate) AS y, count(*) AS n, array_to_string(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))), ';') AS files FROM lineitem WHERE l_discount >= 0.09 AND l_returnflag = 'R' GROUP BY 1, 2""",
)
def q50(spark, sf):
    reasons = F.array_join(T.add_if((F.col("l_discount") >= 0.09, "deep_discount"), (F.col("l_tax") == 0, "untaxed")), ";")
    rows = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_suppkey", F.year("l_shipdate").alias("y"), F.col("l_partkey").cast("string").alias("file_name"), reasons.alias("reasons"))
    return C.staged_groups(rows, "reasons", ["discount"], ["l_suppkey", "y"]).select("l_suppkey", "y", "n", F.array_join("files", ";").alias("files"))


@query(
    "q51_rule_cascade",
    """WITH v AS (SELECT p_name, count(*) AS voters, count(*) FILTER (p_size <= 10) AS small, count(*) FILTER (p_type = 'ECONOMY') AS economy, count(*) FILTER (p_retailprice > 1000) AS costly FROM part GROUP BY 1)
       SELECT p_name, CASE WHEN small >= 8 THEN 'small_consensus' WHEN economy >= 6 THEN 'economy_consensus' WHEN costly * 2 > voters THEN 'costly_majority' ELSE 'majority_missing' END AS rule FROM v""",
)
def q51(spark, sf):
    buckets = {"small": F.col("p_size") <= 10, "economy": F.col("p_type") == "ECONOMY", "costly": F.col("p_retailprice") > 1000}
    rules = [(F.col("small") >= 8, "small_consensus"), (F.col("economy") >= 6, "economy_consensus"), (F.col("costly") * 2 > F.col("voters"), "costly_majority")]
    return C.cascade(table(spark, sf, "part"), "p_name", buckets, rules, "majority_missing").select("p_name", "rule")


_PASSES = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events"


@query(
    "q52_clean_runs",
    f"""WITH r AS (SELECT user_id, i // 3 AS run, max(i % 3 + 1) AS last, count(*) AS n, count(DISTINCT event_type) AS hashes, bool_and(value >= 1) AS clean FROM ({_PASSES}) GROUP BY 1, 2)
        SELECT user_id, CAST(max(run) AS BIGINT) AS run FROM r WHERE last = 3 AND n IN (2, 3) AND hashes = 1 AND clean GROUP BY 1""",
)
def q52(spark, sf):
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    passes = table(spark, sf, "events").withColumn("i", i).withColumn("run", F.floor(F.col("i") / 3)).withColumn("attempt", F.col("i") % 3 + 1)
    return C.clean_runs(passes, ["user_id"], "run", "attempt", "event_type", F.col("value") >= 1).select("user_id", "run")


@query("q53_whole_history", "SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus)) FILTER (l_tax > 0) = 1 AS agrees FROM lineitem GROUP BY 1")
def q53(spark, sf):
    return C.whole_history_agrees(table(spark, sf, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"], F.col("l_tax") > 0)


@query(
    "q54_threshold_crossing",
    """WITH s AS (SELECT l_suppkey, count(*) AS processed, count(*) FILTER (l_returnflag <> 'N') AS last FROM lineitem GROUP BY 1)
       SELECT l_suppkey, CAST(processed // 50 * 50 AS BIGINT) AS threshold FROM s WHERE processed // 50 * 50 > last AND processed >= 50""",
)
def q54(spark, sf):
    status = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("l_returnflag") != "N").alias("last"))
    return C.crossed_threshold(status.withColumn("total", F.col("processed")), "processed", "total", "last", 50).select("l_suppkey", "threshold")


_DECIDED = """SELECT conv_id, turn + 1 AS attempt, CASE WHEN length(text) > 400 THEN 'distant' ELSE 'single' END AS view, (contains(text, 'the') OR text IS NULL) AS bad FROM conversations"""


@query(
    "q55_retry_decisions",
    f"""WITH d AS (SELECT *, coalesce(bool_and(view = 'distant') OVER (PARTITION BY conv_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS all_distant FROM ({_DECIDED}))
        SELECT decision, count(*) AS n FROM (SELECT CASE WHEN bad AND attempt < 3 THEN 'retry' WHEN bad OR (view = 'distant' AND attempt >= 3 AND NOT all_distant) THEN 'unresolved' ELSE 'verified' END AS decision FROM d) GROUP BY 1""",
)
def q55(spark, sf):
    view = F.when(F.length("text") > 400, "distant").otherwise("single")
    rows = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("attempt"), view.alias("view"), T.add_if((F.col("text").contains("the") | F.col("text").isNull(), "bad")).alias("reasons"))
    return C.decide(rows, "conv_id", "attempt", "reasons").groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q56_review_queue",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS period FROM orders WHERE year(o_orderdate) = 1997 AND (o_totalprice > 400000) ORDER BY o_orderkey LIMIT 300""",
)
def q56(spark, sf):
    reasons = F.array_join(T.add_if((F.col("o_totalprice") > 400000, "price_conflict"), (F.col("o_orderstatus") == "P", "partial")), ";")
    rows = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("period"), reasons.alias("reasons"))
    return C.review_queue(rows, "1997", "conflict", 300, ["o_orderkey"])[0].select("o_orderkey", "period")


@query(
    "q57_review_counts",
    """SELECT 'year' AS kind, CAST(year(o_orderdate) AS VARCHAR) AS label, count(*) AS n FROM orders GROUP BY 2
       UNION ALL SELECT 'reason', 'price_conflict', count(*) FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'reason', 'partial', count(*) FROM orders WHERE o_orderstatus = 'P'""",
)
def q57(spark, sf):
    reasons = F.array_join(T.add_if((F.col("o_totalprice") > 400000, "price_conflict"), (F.col("o_orderstatus") == "P", "partial")), ";")
    rows = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("period"), reasons.alias("reasons"))
    _, years, counts = C.review_queue(rows, "1997", "conflict", 300, ["o_orderkey"])
    return years.select(F.lit("year").alias("kind"), F.col("year").alias("label"), "n").unionByName(counts.select(F.lit("reason").alias("kind"), F.col("reason").alias("label"), "n"))


@query(
    "q58_ratio_alarm",
    """SELECT l_shipdate >= TIMESTAMP '1998-01-01' AS late, CASE WHEN count(*) FILTER (l_quantity < 10) = 0 THEN 1.0 ELSE count(*) FILTER (l_quantity < 10 AND l_tax = 0 AND l_discount = 0)::DOUBLE / count(*) FILTER (l_quantity < 10) END AS ratio FROM lineitem GROUP BY 1""",
)
def q58(spark, sf):
    text = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string"))
    return table(spark, sf, "lineitem").groupBy((F.col("l_shipdate") >= "1998-01-01").alias("late")).agg(D.missing_ratio(text("l_tax"), text("l_discount"), F.col("l_quantity") < 10).alias("ratio"))


@query(
    "q59_resolution",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_brand = 'Brand#1' THEN p_brand WHEN p_type = p_brand THEN p_brand ELSE 'unresolved' END AS owner, CASE p_type WHEN 'ECONOMY' THEN 'E' WHEN 'STANDARD' THEN 'S' ELSE p_type END AS short FROM part""",
)
def q59(spark, sf):
    other = F.when(F.col("p_size") % 3 == 0, "n/a").when(F.col("p_brand") == "Brand#1", F.col("p_brand")).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", D.resolve([F.col("p_brand"), other]).alias("owner"), D.alias(F.col("p_type"), {"ECONOMY": "E", "STANDARD": "S"}).alias("short"))


@query(
    "q60_token_cost",
    "SELECT doc_id, round(n_chars / 1e6 * 3.0 + length(source) / 1e6 * 15.0, 6) AS cost, least(300, 15 * power(2, least(doc_id % 9, 5)))::INT AS wait FROM documents WHERE n_chars IS NOT NULL",
)
def q60(spark, sf):
    return table(spark, sf, "documents").filter("n_chars is not null").select("doc_id", T.linear_cost(F.col("n_chars"), F.length("source"), 3.0, 15.0).alias("cost"), T.backoff_seconds((F.col("doc_id") % 9 + 1).cast("int")).alias("wait"))


@query(
    "q61_category_progress",
    """WITH s AS (SELECT o_custkey, o_orderstatus, o_orderdate, o_orderkey FROM orders) SELECT c_nationkey, count(*) AS images, count(*) FILTER (o_orderstatus = 'F') AS processed, max(o_orderdate) AS latest, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order
       FROM s JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def q61(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("o_orderstatus") == "F").alias("processed"), F.max("o_orderdate").alias("latest"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("q62_regression_judge", "SELECT e.event_id, CASE WHEN e.value < 5 AND e.event_type <> 'error' THEN 'event_type' ELSE '' END AS failed FROM events e")
def q62(spark, sf):
    wanted = {"event_type": F.when(F.col("value") < 5, F.lit("error"))}
    return table(spark, sf, "events").select("event_id", F.array_join(D.judge_fields({"event_type": F.col("event_type")}, wanted), ";").alias("failed"))


@query(
    "q63_fallback_fields",
    """WITH t AS (SELECT page_id, regexp_extract_all(upper(replace(html, 'ß', 'ss')), '[A-Z][A-Z0-9]{7,}') AS tok, list_filter(regexp_extract_all(html, '[0-9]+'), lambda x: length(x) IN (4, 5) AND x[1] <> '0') AS p FROM pages),
       m AS (SELECT *, list_max(list_transform(tok, lambda x: length(x))) AS longest, list_max(list_transform(p, lambda x: len(list_filter(p, lambda y: y = x)))) AS most FROM t)
       SELECT page_id, CASE WHEN list_contains(tok, 'EXAMPLE1') THEN 'EXAMPLE1' ELSE list_filter(tok, lambda x: length(x) = longest)[1] END AS model, list_filter(p, lambda x: len(list_filter(p, lambda y: y = x)) = most)[1] AS price, true AS requires_retry FROM m""",
)
def q63(spark, sf):
    """Untrusted fields from free text; the tie rules are tested on small cases."""
    return table(spark, sf, "pages").select("page_id", D.fallback_fields(F.col("html"), ["EXAMPLE1"]).alias("f")).select("page_id", "f.*")
