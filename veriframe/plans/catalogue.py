"""Queries over the driver tables, each exercising operators of the library, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators import relational as R
from veriframe.plans.registry import query


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(c):
    return F.round(F.col(c) * 100).cast("bigint")


@query(
    "q01_price_groups",
    """SELECT p_brand AS brand, CAST(floor(p_retailprice / 100) AS BIGINT) AS band, count(*) AS n, to_json(list(l_orderkey ORDER BY l_orderkey, l_linenumber, l_suppkey)[1:3])::VARCHAR AS first_orders,
       array_to_string(list_sort(list_distinct(list(year(l_shipdate)))), ';') AS years
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def q01(spark, sf):
    """Grouped report: count, first three members in order, the sorted set of years."""
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    keyed = joined.select(F.col("p_brand").alias("brand"), F.floor(F.col("p_retailprice") / 100).alias("band"), "l_orderkey", "l_linenumber", "l_suppkey", F.year("l_shipdate").alias("year"))
    order = Window.partitionBy("brand", "band").orderBy("l_orderkey", "l_linenumber", "l_suppkey")
    firsts = keyed.withColumn("r", F.row_number().over(order)).filter("r <= 3").groupBy("brand", "band").agg(F.array_sort(F.collect_list(F.struct("r", "l_orderkey"))).alias("f"))
    counted = keyed.groupBy("brand", "band").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("year")).cast("array<string>"), ";").alias("years"))
    return counted.join(firsts, ["brand", "band"]).select("brand", "band", "n", F.to_json("f.l_orderkey").alias("first_orders"), "years")


@query(
    "q02_category_metrics",
    """SELECT o_orderpriority AS priority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS failed,
       count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) AS failed_rate FROM orders GROUP BY 1""",
)
def q02(spark, sf):
    n, f = F.count(F.lit(1)), F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(n.alias("total"), f.alias("failed"), F.try_divide(f.cast("double"), n).alias("failed_rate"))


_REASONS = [("l_discount > 0.08", "deep_discount"), ("l_quantity >= 45", "bulk"), ("l_returnflag = 'R'", "returned"), ("l_tax = 0", "untaxed")]


@query(
    "q03_reason_explode",
    f"""WITH r AS (SELECT year(l_shipdate) AS y, unnest([x FOR x IN [{", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _REASONS)}] IF x IS NOT NULL]) AS reason FROM lineitem)
        SELECT reason, count(*) AS n_all, count(*) FILTER (y = 1998) AS n_year FROM r GROUP BY reason""",
)
def q03(spark, sf):
    """Reasons as an encoded set, exploded; counted before and after the year's filter."""
    encoded = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y"), F.array_join(T.add_if(*[(F.expr(c), n) for c, n in _REASONS]), ";").alias("reasons"))
    return encoded.select("y", F.explode(T.split_set(F.col("reasons"))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("y") == 1998).alias("n_year"))


@query(
    "q04_first_match_bucket",
    "SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount >= 0.09 THEN 'discount' WHEN l_quantity < 5 THEN 'small' ELSE 'plain' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1",
)
def q04(spark, sf):
    bucket = T.first_match((F.col("l_returnflag") == "R", "returned"), (F.col("l_discount") >= 0.09, "discount"), (F.col("l_quantity") < 5, "small"), default="plain")
    return table(spark, sf, "lineitem").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "q05_priority",
    """WITH r AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, CASE WHEN o_totalprice > 400000 THEN 'large_value' END, CASE WHEN o_orderstatus = 'P' THEN 'partial' END], lambda x: x IS NOT NULL) AS reasons FROM orders)
       SELECT o_orderkey, array_to_string(reasons, ';') AS reasons, CASE WHEN list_contains(reasons, 'urgent') THEN 'P1' ELSE 'P2' END AS priority FROM r WHERE len(reasons) > 0""",
)
def q05(spark, sf):
    reasons = T.add_if((F.col("o_orderpriority") == "1-URGENT", "urgent"), (F.col("o_totalprice") > 400000, "large_value"), (F.col("o_orderstatus") == "P", "partial"))
    out = table(spark, sf, "orders").select("o_orderkey", reasons.alias("r")).filter(F.size("r") > 0)
    return out.select("o_orderkey", F.array_join("r", ";").alias("reasons"), F.when(F.exists("r", lambda x: x.contains("urgent")), "P1").otherwise("P2").alias("priority"))


@query("q06_pending_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q06(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.pending(table(spark, sf, "customer").select("c_custkey"), [orders.filter("o_totalprice > 400000"), orders.filter("o_orderstatus = 'P'")], ["c_custkey"])


@query(
    "q07_semi_flags",
    "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48) AS bulk, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount = 0) AS returned FROM part",
)
def q07(spark, sf):
    items = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    out = table(spark, sf, "part").select("p_partkey")
    for name, condition in (("bulk", "l_quantity >= 48"), ("returned", "l_returnflag = 'R' and l_discount = 0")):
        hits = items.filter(condition).select("p_partkey", F.lit(True).alias(name)).distinct()
        out = out.join(hits, "p_partkey", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


_SLICE = "SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders WHERE year(o_orderdate) = {} GROUP BY 1"


def _slice(spark, sf, year):
    return table(spark, sf, "orders").filter(F.year("o_orderdate") == year).groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias("v"))


@query(
    "q08_full_outer_status",
    f"""SELECT CASE WHEN b.o_custkey IS NULL THEN 'missing_result' WHEN a.o_custkey IS NULL THEN 'missing_source' WHEN b.v > a.v THEN 'grown' ELSE 'ready' END AS status, count(*) AS n
        FROM ({_SLICE.format(1996)}) a FULL JOIN ({_SLICE.format(1997)}) b ON a.o_custkey = b.o_custkey GROUP BY 1""",
)
def q08(spark, sf):
    both = F.when(F.col("r.v") > F.col("l.v"), "grown").otherwise("ready")
    return R.full_outer_status(_slice(spark, sf, 1996), _slice(spark, sf, 1997), ["o_custkey"], "missing_result", "missing_source", both).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


#: Two states of the events: those under value 15 as they were, those from 5 up as they are; every event is in one or both.
_OLD = "SELECT event_id, event_type, value, props FROM events WHERE value < 15"
_NEW = "SELECT event_id, CASE WHEN event_type = 'click' THEN '' ELSE upper(event_type) END AS event_type, CASE WHEN value < 10 THEN value * 2 END AS value, props FROM events WHERE value >= 5"


@query(
    "q09_field_upsert",
    f"""SELECT coalesce(o.event_id, n.event_id) AS event_id, CASE WHEN coalesce(n.event_type, '') = '' THEN o.event_type ELSE n.event_type END AS event_type,
        CASE WHEN n.value IS NULL THEN o.value ELSE n.value END AS value, CASE WHEN n.event_id IS NOT NULL THEN n.props ELSE o.props END AS props,
        CASE WHEN o.event_id IS NULL THEN 'added' WHEN n.event_id IS NULL THEN 'kept' ELSE 'updated' END AS change FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.event_id = n.event_id""",
)
def q09(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value", "props")
    new = e.filter("value >= 5").select("event_id", F.when(F.col("event_type") == "click", "").otherwise(F.upper("event_type")).alias("event_type"), F.when(F.col("value") < 10, F.col("value") * 2).alias("value"), "props")
    return R.field_upsert(e.filter("value < 15"), new, "event_id", always_new=["props"])


@query(
    "q10_unique_lookup",
    """WITH b AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL),
       p AS (SELECT o_orderkey, l AS l_linenumber FROM orders, range(1, 8) AS t(l))
       SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS lookup, count(*) AS n FROM p LEFT JOIN b ON o_orderkey = l_orderkey AND p.l_linenumber = b.l_linenumber GROUP BY 1""",
)
def q10(spark, sf):
    probe = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("l_linenumber"))
    return R.unique_lookup(probe, table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey").groupBy("lookup").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q11_cascade_join",
    """WITH old AS (SELECT doc_id AS target, text, lang, source, n_chars FROM documents), probe AS (SELECT doc_id, text, lang, source, n_chars FROM documents),
       a AS (SELECT md5(text) AS h, min(target) AS v FROM old GROUP BY 1 HAVING count(*) = 1), b AS (SELECT lang, source, n_chars, min(target) AS v FROM old GROUP BY 1, 2, 3 HAVING count(*) = 1)
       SELECT doc_id, coalesce(a.v, b.v) AS target, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 END AS stage
       FROM probe LEFT JOIN a ON md5(text) = h LEFT JOIN b ON probe.lang = b.lang AND probe.source = b.source AND probe.n_chars = b.n_chars""",
)
def q11(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"), "lang", "source", "n_chars")
    old = docs.withColumnRenamed("doc_id", "target")
    out = R.cascade_lookup(docs, [(old, ["h"]), (old, ["lang", "source", "n_chars"])], "target")
    return out.select("doc_id", "target", "stage")


_UNIT = "CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT)"


@query(
    "q12_price_compare",
    f"""SELECT CASE WHEN r <= 0 OR r IS NULL THEN 'unknown' WHEN p = r THEN 'match' WHEN p > r THEN 'high' ELSE 'low' END AS status, count(*) AS n, sum(floor((p - r) * 10000 / r))::BIGINT AS basis_points
        FROM (SELECT {_UNIT} AS p, CAST(round(p_retailprice * 100) AS BIGINT) AS r FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) GROUP BY 1""",
)
def q12(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").select(F.expr(_UNIT).alias("p"), cents("p_retailprice").alias("r"))
    return joined.groupBy(T.price_status(F.col("p"), F.col("r")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor((F.col("p") - F.col("r")) * 10000 / F.col("r"))).cast("bigint").alias("basis_points"))


@query("q13_dim_unique", "SELECT p_type || ' ' || p_size AS panel, count(DISTINCT p_brand) AS brands, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS brand FROM part GROUP BY 1")
def q13(spark, sf):
    grouped = table(spark, sf, "part").groupBy(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("panel")).agg(F.collect_set("p_brand").alias("s"))
    return grouped.select("panel", F.size("s").cast("bigint").alias("brands"), F.when(F.size("s") == 1, F.get("s", F.lit(0))).alias("brand"))


@query(
    "q14_best_overlap",
    """WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
       p AS (SELECT a.l_suppkey AS s, b.l_suppkey AS other, count(*) AS shared FROM s a JOIN s b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2)
       SELECT s AS l_suppkey, other, shared FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY shared DESC, other) AS r FROM p) WHERE r = 1""",
)
def q14(spark, sf):
    sold = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    return R.best_overlap(sold, sold.withColumnRenamed("l_suppkey", "other"), "l_partkey", "l_suppkey", "other")


@query(
    "q15_fuzzy_nearest",
    """WITH c AS (SELECT c_custkey, left(upper(md5(CAST(c_custkey AS VARCHAR))), 10) AS code FROM customer), t AS (SELECT c_custkey, code[1:5] || code[7] || code[6] || code[8:10] AS typed FROM c),
       s AS (SELECT typed, code, damerau_levenshtein(typed, code) AS d FROM (SELECT DISTINCT typed FROM t) JOIN (SELECT DISTINCT code FROM c) ON left(typed, 3) = left(code, 3)),
       b AS (SELECT typed, min(d) AS m, count(*) FILTER (d = low) AS n, min(code) FILTER (d = low) AS code FROM (SELECT *, min(d) OVER (PARTITION BY typed) AS low FROM s) GROUP BY typed)
       SELECT c_custkey, t.typed, b.code AS nearest, CAST(b.m AS INTEGER) AS distance FROM t LEFT JOIN b ON t.typed = b.typed AND b.n = 1 AND b.m <= 2""",
)
def q15(spark, sf):
    """Customer codes with two neighbouring characters swapped, corrected against the codes by unique nearest edit distance."""
    codes = table(spark, sf, "customer").select("c_custkey", F.substring(F.upper(F.md5(F.col("c_custkey").cast("string"))), 1, 10).alias("code"))
    broken = codes.select("c_custkey", F.concat(F.substring("code", 1, 5), F.substring("code", 7, 1), F.substring("code", 6, 1), F.substring("code", 8, 3)).alias("typed"))
    return R.unique_nearest(broken, codes, "typed", "code").select("c_custkey", "typed", "nearest", "distance")


@query(
    "q16_prefix_completion",
    """WITH v AS (SELECT DISTINCT p_name || ' ' || p_brand AS value FROM part), p AS (SELECT DISTINCT left(value, length(value) - 1) AS probe FROM v),
       c AS (SELECT probe, count(*) AS n, min(value) AS completion FROM p JOIN v ON starts_with(value, probe) AND length(value) - length(probe) BETWEEN 1 AND 3 GROUP BY probe),
       f AS (SELECT probe, count(*) AS n, min(value) AS alternative FROM p JOIN v ON length(value) = length(probe) AND substr(value, 2) = substr(probe, 2) AND value <> probe GROUP BY probe),
       e AS (SELECT probe, count(*) AS n, min(value) AS embedded FROM p JOIN v ON contains(probe, value) AND value <> probe AND length(value) >= 8 GROUP BY probe)
       SELECT probe, completion, alternative, embedded FROM p LEFT JOIN (FROM c WHERE n = 1) c USING (probe) LEFT JOIN (FROM f WHERE n = 1) f USING (probe) LEFT JOIN (FROM e WHERE n = 1) e USING (probe)""",
)
def q16(spark, sf):
    values = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("value")).distinct()
    probe = values.select(F.expr("left(value, length(value) - 1)").alias("probe")).distinct()
    out = R.unique_completion(probe, values, "probe", "value")
    out = R.unique_first_letter(out, values, "probe", "value")
    return R.unique_embedded(out, values, "probe", "value").select("probe", "completion", "alternative", "embedded")


@query(
    "q17_snapshot_diff",
    """WITH a AS (SELECT event_id, event_type, value FROM events WHERE value < 20), b AS (SELECT event_id, event_type, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value FROM events WHERE value >= 3)
       SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN a.event_id IS NULL THEN 'added' WHEN b.event_id IS NULL THEN 'removed' ELSE 'changed' END AS change
       FROM a FULL JOIN b ON a.event_id = b.event_id WHERE a.event_id IS NULL OR b.event_id IS NULL OR a.value IS DISTINCT FROM b.value OR a.event_type IS DISTINCT FROM b.event_type""",
)
def q17(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    after = e.filter("value >= 3").withColumn("value", F.when(F.col("event_type") != "view", F.col("value")))
    return R.snapshot_diff(e.filter("value < 20"), after, "event_id")


@query(
    "q18_overlay_guarded",
    """WITH d AS (SELECT event_id, value, event_type FROM events WHERE value < 15), m AS (SELECT event_id, value + 1 AS value, event_type FROM events WHERE value >= 5),
       s AS (SELECT coalesce(d.event_id, m.event_id) AS event_id, CASE WHEN m.event_id IS NULL THEN 'durable' WHEN d.event_id IS NULL THEN 'memory' WHEN d.event_type = 'purchase' AND m.value < 10 THEN 'durable' ELSE 'memory' END AS side, d.value AS dv, m.value AS mv FROM d FULL JOIN m ON d.event_id = m.event_id)
       SELECT event_id, side, CASE side WHEN 'durable' THEN dv ELSE mv END AS value FROM s""",
)
def q18(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", "event_type")
    memory = e.filter("value >= 5").withColumn("value", F.col("value") + 1)
    return R.guarded_overlay(e.filter("value < 15"), memory, "event_id", "value", F.col("d.event_type") == "purchase", F.col("m.value") < 10)


@query("q19_latest_per_key", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def q19(spark, sf):
    return R.latest_by(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("q20_history_last_n", "SELECT conv_id, turn, role, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def q20(spark, sf):
    return R.last_n(table(spark, sf, "conversations"), ["conv_id"], ["turn"], 3).select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("chars")).sortWithinPartitions("conv_id", "turn")


@query("q21_dedup_first", "SELECT min(doc_id) AS doc_id, md5(text) AS digest, count(*) AS copies FROM documents GROUP BY md5(text)")
def q21(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(
    "q22_last_three",
    """SELECT user_id, event_type, event_id, (4 - r)::INT AS attempt FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE r <= 3 AND n >= 3""",
)
def q22(spark, sf):
    return R.last_three(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "attempt")


_VOTE = """SELECT p_name, CASE WHEN t >= 2 AND w = 1 THEN v END AS {0} FROM (
  SELECT p_name, max(n) AS t, count(*) FILTER (n = top) AS w, min({0}) FILTER (n = top) AS v FROM (SELECT *, max(n) OVER (PARTITION BY p_name) AS top FROM (SELECT p_name, {0}, count(*) AS n FROM part GROUP BY 1, 2)) GROUP BY 1)"""


@query("q23_quorum", f"SELECT p_name, p_brand AS winner FROM ({_VOTE.format('p_brand')})")
def q23(spark, sf):
    return R.quorum(table(spark, sf, "part"), "p_name", "p_brand", "p_partkey").select("p_name", "winner")


@query(
    "q23b_joint_pair_quorum",
    f"""WITH j AS (SELECT a.p_name, a.p_brand, b.p_type, (SELECT count(*) FROM part p WHERE p.p_name = a.p_name AND p.p_brand = a.p_brand AND p.p_type = b.p_type) AS pair FROM ({_VOTE.format('p_brand')}) a JOIN ({_VOTE.format('p_type')}) b ON a.p_name = b.p_name)
        SELECT p_name, CASE WHEN p_brand IS NULL OR p_type IS NULL OR pair >= 2 THEN p_brand END AS p_brand, CASE WHEN p_brand IS NULL OR p_type IS NULL OR pair >= 2 THEN p_type END AS p_type FROM j""",
)
def q23b(spark, sf):
    return R.joint_quorum(table(spark, sf, "part"), "p_name", "p_brand", "p_type", "p_partkey")


@query("q24_fd_check", "SELECT p_name, count(*) AS rows, count(DISTINCT p_type) AS values, count(DISTINCT p_type) = 1 AS consistent FROM part GROUP BY p_name HAVING count(*) > 1")
def q24(spark, sf):
    return R.dependency_check(table(spark, sf, "part"), "p_name", "p_type")


@query("q24b_duplicates", "SELECT p_partkey, count(*) OVER (PARTITION BY lower(p_name), p_size) > 1 AS duplicate FROM part")
def q24b(spark, sf):
    return R.flag_duplicates(table(spark, sf, "part"), F.struct(F.lower("p_name"), "p_size")).select("p_partkey", "duplicate")


@query(
    "q25_gap_check",
    """SELECT l_orderkey, count(DISTINCT l_linenumber) AS distinct, max(l_linenumber) AS largest, count(DISTINCT l_linenumber) <> max(l_linenumber) OR min(l_linenumber) < 1 AS gap,
       least(3, greatest(count(DISTINCT l_linenumber), max(l_linenumber)))::BIGINT AS floor FROM lineitem GROUP BY 1""".replace("AS distinct,", 'AS "distinct",'),
)
def q25(spark, sf):
    return R.gap_check(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "q26_lag_duplicate",
    """SELECT event_type, count(*) AS n FROM (SELECT event_type, user_id, CAST(value AS BIGINT) AS v, lag(CAST(value AS BIGINT)) OVER w AS pv, lag(user_id) OVER w AS pu FROM (SELECT event_type, user_id, floor(value) AS value, ts, event_id FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE v = pv AND user_id <> pu GROUP BY 1""",
)
def q26(spark, sf):
    """Events whose whole value equals the one before of their type, by another user."""
    e = table(spark, sf, "events").select("event_type", "ts", "event_id", "user_id", F.floor("value").alias("v"))
    flagged = R.previous_row(e, "event_type", ["ts", "event_id"], ["v", "user_id"], "p").filter((F.col("v") == F.col("p.v")) & (F.col("user_id") != F.col("p.user_id")))
    return flagged.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q27_hash_split",
    """WITH g AS (SELECT source, count(*) AS rows FROM documents GROUP BY 1), s AS (SELECT *, coalesce(sum(rows) OVER (ORDER BY sha256(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(rows) OVER () AS t FROM g)
       SELECT source, rows, CASE WHEN b < 0.8 * t THEN 'train' WHEN b < 0.9 * t THEN 'dev' ELSE 'holdout' END AS split FROM s""",
)
def q27(spark, sf):
    return R.hash_split(table(spark, sf, "documents"), "source")


@query("q28_stratified_sample", "SELECT event_type, event_id, digest FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY digest, event_id) AS r FROM (SELECT event_type, event_id, left(sha1(event_id::VARCHAR), 12) AS digest FROM events)) WHERE r <= 5")
def q28(spark, sf):
    return R.stratified_sample(table(spark, sf, "events"), "event_type", ["event_id"], 5).select("event_type", "event_id", "digest")


@query(
    "q29_rolling_distinct",
    """SELECT a.event_id, a.event_type, count(DISTINCT b.user_id)::INT AS "distinct" FROM events a JOIN events b ON a.event_type = b.event_type AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts WHERE a.event_type = 'error' GROUP BY 1, 2 HAVING count(DISTINCT b.user_id) >= 3""",
)
def q29(spark, sf):
    errors = table(spark, sf, "events").filter("event_type = 'error'")
    return R.rolling_distinct(errors, "event_type", "ts", "user_id", 600, 3).select("event_id", "event_type", "distinct")


@query("q30_bounded_counter", "SELECT user_id, least(count(*), 3)::BIGINT AS allowed, greatest(count(*) - 3, 0)::BIGINT AS capped FROM events GROUP BY 1")
def q30(spark, sf):
    return R.bounded_counter(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("capped"))


@query(
    "q31_breaker",
    """WITH m AS (SELECT user_id, event_type <> 'purchase' AS f, sum(CASE WHEN event_type <> 'purchase' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
       SELECT user_id, count(*) AS failures FROM m WHERE f GROUP BY user_id, g HAVING count(*) >= 5""",
)
def q31(spark, sf):
    return R.breaker(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "purchase")


@query(
    "q31b_sequence_total",
    """WITH r AS (SELECT *, CASE WHEN k < lag(k) OVER w THEN 1 ELSE 0 END AS reset FROM (SELECT user_id, ts, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       s AS (SELECT *, sum(reset) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM r)
       SELECT user_id, sum(m)::BIGINT AS total FROM (SELECT user_id, g, max(k) AS m FROM s GROUP BY 1, 2) GROUP BY 1""",
)
def q31b(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    return R.sequence_total(e, "user_id", ["ts", "event_id"], "k")


@query(
    "q32_progress",
    """SELECT r_name, count(DISTINCT n_nationkey) AS folders, count(*) AS total, count(*) FILTER (processed) AS processed, (count(*) FILTER (processed) * 10000 // count(*))::BIGINT AS basis_points,
       CASE WHEN count(*) FILTER (processed) = count(*) THEN 'complete' WHEN count(*) FILTER (processed) = 0 THEN 'pending' ELSE 'running' END AS status
       FROM (SELECT r_name, n_nationkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS processed FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1""",
)
def q32(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("done")).distinct()
    rows = table(spark, sf, "customer").join(done, "c_custkey", "left").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n, p = F.count(F.lit(1)), F.count("done")
    status = F.when(p == n, "complete").when(p == 0, "pending").otherwise("running")
    return rows.groupBy("r_name").agg(F.count_distinct("n_nationkey").alias("folders"), n.alias("total"), p.alias("processed"), F.floor(p * 10000 / n).alias("basis_points"), status.alias("status"))


@query(
    "q33_manifest",
    """WITH l AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1),
       m AS (SELECT o_orderkey, array_to_string(list_filter([CASE WHEN lines IS NULL THEN 'no_lines' END, CASE WHEN returned > 1 THEN 'returned' END, CASE WHEN shipped < o_orderdate THEN 'shipped_early' END, CASE WHEN o_totalprice < 50000 THEN 'absurd_price' END], lambda x: x IS NOT NULL), ';') AS reasons
             FROM orders LEFT JOIN l ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F')
       SELECT CASE WHEN reasons = '' THEN 'ready' ELSE 'review_required' END AS status, reasons, count(*) AS n FROM m GROUP BY ALL""",
)
def q33(spark, sf):
    """Orders not yet uploaded (status F), classified as ready or for review with their reasons."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.max("l_shipdate").alias("shipped"))
    rows = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").join(lines, "o_orderkey", "left")
    reasons = T.add_if((F.col("lines").isNull(), "no_lines"), (F.col("returned") > 1, "returned"), (F.col("shipped") < F.col("o_orderdate"), "shipped_early"), (F.col("o_totalprice") < 50000, "absurd_price"))
    out = rows.select(F.array_join(reasons, ";").alias("reasons"))
    return out.groupBy(F.when(F.col("reasons") == "", "ready").otherwise("review_required").alias("status"), "reasons").agg(F.count(F.lit(1)).alias("n"))


_TERMS, _NOT = ["tion", "rest", "oux", "keit"], ["not", "non", "ne"]


def _unnegated_sql(term: str) -> str:
    before = f"list_transform(range(1, len(string_split(t, '{term}'))), lambda i: right(array_to_string(string_split(t, '{term}')[1:i], '{term}'), 28))"
    return f"len(list_filter({before}, lambda x: NOT ({' OR '.join(f'''contains(x, '{n}')''' for n in _NOT)}))) > 0"


@query(
    "q34_risk_audit",
    f"""WITH d AS (SELECT doc_id, coalesce(lower(text), '') AS t FROM documents), h AS (SELECT {" + ".join(f"({_unnegated_sql(t)})::INT" for t in _TERMS)} AS hits FROM d)
        SELECT CASE WHEN hits >= 3 THEN 'high' WHEN hits >= 1 THEN 'medium' ELSE 'low' END AS risk, count(*) AS n FROM h GROUP BY 1""",
)
def q34(spark, sf):
    """Documents by how many terms occur without a negation in the 28 characters before."""
    t = table(spark, sf, "documents").select(F.coalesce(F.lower("text"), F.lit("")).alias("t"))
    hits = sum((T.unnegated(F.col("t"), x, _NOT).cast("int") for x in _TERMS[1:]), T.unnegated(F.col("t"), _TERMS[0], _NOT).cast("int"))
    return t.select(hits.alias("hits")).groupBy(F.when(F.col("hits") >= 3, "high").when(F.col("hits") >= 1, "medium").otherwise("low").alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "q35_scoring",
    """SELECT lang, count(*) AS cases, count(l.doc_id) AS predicted, count(*) - count(l.doc_id) AS missing, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS exact_rate,
       sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS danger_rate, coalesce(bool_and(toxic = 0), true) AS gate FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def q35(spark, sf):
    """Predictions against cases; cases without one stay in the denominator."""
    one = R.exactly_one(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"])
    n = F.count(F.lit(1))
    return one.groupBy("lang").agg(
        n.alias("cases"), F.count_if(F.col("match") == "one").alias("predicted"), F.count_if(F.col("match") == "none").alias("missing"),
        (F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double") / n).alias("exact_rate"), (F.count_if(F.col("toxic") == 1).cast("double") / n).alias("danger_rate"),
        F.coalesce(F.bool_and(F.col("toxic") == 0), F.lit(True)).alias("gate"),
    )


@query(
    "q36_invariants",
    """SELECT violation, count(*) AS n FROM (SELECT unnest([x FOR x IN [CASE WHEN l_shipdate < o_orderdate THEN 'shipped_before_order' END, CASE WHEN o_orderstatus = 'F' AND l_linestatus <> 'F' THEN 'open_line_of_closed_order' END, CASE WHEN l_extendedprice > o_totalprice THEN 'line_over_total' END] IF x IS NOT NULL]) AS violation FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""",
)
def q36(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = T.add_if((F.col("l_shipdate") < F.col("o_orderdate"), "shipped_before_order"), ((F.col("o_orderstatus") == "F") & (F.col("l_linestatus") != "F"), "open_line_of_closed_order"), (F.col("l_extendedprice") > F.col("o_totalprice"), "line_over_total"))
    return joined.select(F.explode(found).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("q37_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AND json_extract(props, '$.k') IS NOT NULL AS valid FROM events")
def q37(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), (F.size(T.json_shape(F.col("props"), ["k"])) == 0).alias("valid"))


@query(
    "q38_html_extract",
    r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS chars,
        len(regexp_extract_all(html, '[0-9]{3,}'))::INT AS numbers FROM pages""",
)
def q38(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length(T.strip_html(F.col("html"))).cast("bigint").alias("chars"), F.size(F.regexp_extract_all("html", F.lit("[0-9]{3,}"), F.lit(0))).alias("numbers"))


@query(
    "q39_name_parse_build",
    """WITH p AS (SELECT p_partkey, string_split(p_name || '-' || p_brand || '-' || p_type, '-') AS a FROM part)
       SELECT p_partkey, a[1] AS head, a[len(a)] AS tail, array_to_string([replace(a[1], ' ', '_'), replace(a[2], '#', ''), a[len(a)]], '-') AS rebuilt, len(a)::INT AS parts FROM p""",
)
def q39(spark, sf):
    a = table(spark, sf, "part").select("p_partkey", T.name_parts(T.build_name(F.col("p_name"), F.col("p_brand"), F.col("p_type"))).alias("a"))
    first, second, last = F.get("a", F.lit(0)), F.get("a", F.lit(1)), F.try_element_at("a", F.lit(-1))
    return a.select("p_partkey", first.alias("head"), last.alias("tail"), T.build_name(T.sanitize_segment(first), F.replace(second, F.lit("#"), F.lit("")), last).alias("rebuilt"), F.size("a").alias("parts"))


@query(
    "q40_period_policy",
    "SELECT strftime(o_orderdate, '%Y%m') AS period, year(o_orderdate)::INT AS y, year(o_orderdate) = 2000 AS symbol, count(*) AS n FROM orders WHERE year(o_orderdate) >= 2000 GROUP BY ALL",
)
def q40(spark, sf):
    named = table(spark, sf, "orders").select(T.period_of(F.concat(F.lit("photo_"), F.date_format("o_orderdate", "yyyyMM"), F.lit("_x"))).alias("period")).filter("period is not null")
    return named.groupBy("period", T.year_of(F.col("period")).alias("y"), T.include_symbol(F.col("period"), 2000).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "q41_repetition",
    r"""WITH d AS (SELECT doc_id, CASE WHEN contains(text, '{') THEN trim(split_part(text, '{', 1), e' \t\n\x0b\x0c\r') ELSE coalesce(text, '') END AS w FROM documents),
       p AS (SELECT doc_id, w, list_reverse(regexp_extract_all(w, '[A-Za-z0-9]+(?::[A-Za-z0-9]+)?|[\x{4e00}-\x{9fff}]{2,}'))[1:120] AS tokens, right(regexp_replace(w, '[ \t\n\x0b\f\r]+', '', 'g'), 1600) AS tail,
              list_filter(list_transform(string_split(w, chr(10)), lambda x: trim(x, e' \t\n\x0b\x0c\r')), lambda x: length(x) > 15) AS lines FROM d)
       SELECT doc_id,
         len(list_filter(list_distinct(tokens), lambda t: length(t) >= 4 AND len(list_filter(tokens, lambda x: x = t)) >= 12)) > 0
         OR len(list_filter([4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40], lambda n: length(tail) >= 8 * n AND ends_with(tail, repeat(right(tail, n), 6)))) > 0
         OR len(list_distinct(lines[-15:])) < len(lines[-15:])
         OR (len(lines) >= 2 AND length(w) > 200 AND len(list_filter(range(0, length(w) - 30, 50), lambda i: length(w) - length(replace(w, substr(w, i::INT + 1, 30), '')) >= 90)) > 0) AS repeats
       FROM p""",
)
def q41(spark, sf):
    """Texts that loop."""
    from veriframe.functions.folds import loops, watched_prose

    return table(spark, sf, "documents").select("doc_id", loops(watched_prose(F.col("text"))).alias("repeats"))


@query(
    "q42_balanced_json",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END::INT AS objects, '{"k":' || json_extract(props, '$.k') || '}' AS first FROM events""",
)
def q42(spark, sf):
    from veriframe.functions.folds import json_objects

    prose = F.concat(F.lit("The answer {is} "), "props", F.when(F.col("event_id") % 3 == 0, F.lit(' and {"a": "}{"} too')).otherwise(" only {"))
    found = table(spark, sf, "events").select("event_id", json_objects(prose).alias("found"))
    return found.select("event_id", F.size("found").alias("objects"), F.get("found", F.lit(0)).alias("first"))


_USERS = "(SELECT DISTINCT user_id, day(ts) FROM events WHERE event_type = '{}')"


@query(
    "q43_set_ops",
    f"""WITH a AS {_USERS.format("error")}, b AS {_USERS.format("purchase")}
        SELECT 'union' AS op, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'difference', count(*) FROM (FROM a EXCEPT FROM b)
        UNION ALL SELECT 'intersection', count(*) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'symmetric', count(*) FROM ((FROM a EXCEPT FROM b) UNION ALL (FROM b EXCEPT FROM a))""",
)
def q43(spark, sf):
    e = table(spark, sf, "events")
    a, b = (e.filter(F.col("event_type") == t).select("user_id", F.dayofmonth("ts")).distinct() for t in ("error", "purchase"))
    parts = {"union": a.union(b).distinct(), "difference": a.exceptAll(b), "intersection": a.intersect(b), "symmetric": a.exceptAll(b).unionByName(b.exceptAll(a))}
    out = None
    for name, frame in parts.items():
        one = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "q44_backfill",
    """WITH c AS (SELECT p_name || p_size AS id, min(p_brand) AS p_brand, min(p_type) AS p_type FROM part GROUP BY 1 HAVING count(DISTINCT (p_brand, p_type)) = 1)
       SELECT * FROM c WHERE id NOT IN (SELECT p_name || p_size FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 49)""",
)
def q44(spark, sf):
    parts = table(spark, sf, "part").withColumn("id", F.concat("p_name", F.col("p_size").cast("string")))
    sold = table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return R.veto_candidates(parts, "id", ["p_brand", "p_type"], [parts.join(sold, "p_partkey", "left_semi")])


@query(
    "q45_reconcile",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'), b AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS p FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2)
       SELECT CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' ELSE 'several' END AS match, count(*) AS n FROM a LEFT JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1""",
)
def q45(spark, sf):
    items = table(spark, sf, "lineitem")
    probe = items.filter("l_shipdate < '1997-01-01'").select("l_orderkey", "l_linenumber")
    build = items.filter("l_shipdate >= '1997-01-01'").select("l_orderkey", "l_linenumber", "l_partkey")
    return R.exactly_one(probe, build, ["l_orderkey", "l_linenumber"], ["l_partkey"]).groupBy("match").agg(F.count(F.lit(1)).alias("n"))
