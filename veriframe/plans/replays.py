"""Queries over streams with state, replays and reconciliations: each with the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriframe.functions import domain as D
from veriframe.operators import reconcile as N
from veriframe.operators import rules as S
from veriframe.plans import adjudication as A
from veriframe.plans.catalogue import table
from veriframe.plans.exhibits import folder
from veriframe.plans.registry import query
from veriframe.sources import readers
from veriframe.streaming import jobs, state


def event_stream(spark: SparkSession, sf: str, where: str, path: str, parts: int = 3, least: int = 250_000) -> DataFrame:
    """The events as a stream that arrives by time, in `parts` batches one after the other, and of these the rows wanted.

    Every batch has equally many files, each of `least` rows or so at least, or one file if there are fewer: rows are dealt in turn,
    so that none is empty.
    """
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    span = (last - first) // parts + 1
    within = [F.expr(f"unix_micros(ts) >= {first + i * span} AND unix_micros(ts) < {first + (i + 1) * span}") for i in range(parts)]
    smallest = min(events.agg(*[F.count_if(w) for w in within]).first())
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), smallest // least))
    for w in within:
        events.filter(w).repartition(files).write.mode("append").parquet(path)
    kind = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    return jobs.file_stream(spark, path, kind, files=files).filter(where)


@query(
    "q140_delayed_retries",
    """WITH f AS (SELECT user_id AS job, epoch_us(ts) // 1000 AS at_ms, value < 90 AS again, (row_number() OVER (PARTITION BY user_id ORDER BY ts))::INT AS attempts FROM events WHERE event_type = 'error'),
       d AS (SELECT job, min(attempts) AS last, arg_min(at_ms, attempts) AS died FROM f WHERE attempts >= 10 OR NOT again GROUP BY job),
       r AS (SELECT f.*, d.last, d.died, at_ms + 1000 * least(300, 15 * power(2, least(attempts - 1, 5)))::BIGINT AS due_ms FROM f LEFT JOIN d ON d.job = f.job)
       SELECT job, 'dead' AS kind, attempts, at_ms, NULL::BIGINT AS due_ms FROM r WHERE attempts = last
       UNION ALL SELECT job, 'retry', attempts, at_ms, due_ms FROM r WHERE (last IS NULL OR attempts < last) AND (died IS NULL OR due_ms < died) AND due_ms < (SELECT max(at_ms) FROM f)""",
)
def q140(spark, sf):
    """Failures as attempts of jobs: what comes back when its time has come, and the dead letters."""
    at = folder(spark, "retries")
    failures = event_stream(spark, sf, "event_type = 'error'", f"{at}/in").withColumn("error", F.when(F.col("value") < 90, "a Timeout").otherwise("corrupt"))
    state.run_to_end(state.delayed_retries(failures, "user_id", "ts", "error", ["timeout"], most=10), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").drop("batch")


@query(
    "q141_lifetime_counter",
    """WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, greatest(count(*) FILTER (event_type = 'purchase' AND value < 10), count(*) FILTER (event_type = 'view' AND value < 5)) AS floor FROM events GROUP BY 1)
       SELECT user_id, least(clicks, greatest(3 - floor, 0))::BIGINT AS allowed, (clicks - least(clicks, greatest(3 - floor, 0)))::BIGINT AS capped FROM u WHERE clicks > 0""",
)
def q141(spark, sf):
    """At most three of each user over its life, of which a trace and a checkpoint know some are used already."""
    at = folder(spark, "lifetime")
    events = table(spark, sf, "events")
    known = [events.filter(w).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")) for w in ("event_type = 'purchase' AND value < 10", "event_type = 'view' AND value < 5")]
    stream = event_stream(spark, sf, "event_type = 'click'", f"{at}/in")
    state.run_to_end(state.lifetime_counter(stream, "user_id", state.floor_of("user_id", *known)), f"{at}/out", f"{at}/state", "update")
    return spark.read.parquet(f"{at}/out").groupBy(F.col("key").alias("user_id")).agg(F.sum("allowed").alias("allowed"), F.sum("capped").alias("capped"))


@query("q142_lasting_sources", "SELECT event_type AS key, CAST(user_id AS VARCHAR) AS source, count(*) AS n FROM events GROUP BY ALL")
def q142(spark, sf):
    """The sources of each kind of event, as the state store holds them after a stream that was stopped and started again."""
    at = folder(spark, "sources")
    stream = event_stream(spark, sf, "true", f"{at}/in", parts=2)
    for _ in range(2):  # the second start finds its state, and nothing new
        state.run_to_end(state.lasting_sources(stream, "event_type", "user_id"), f"{at}/out", f"{at}/state", idle=False)
    return state.held(spark, f"{at}/state")


# Three passes -----------------------------------------------------------------------------------------------------------

_FLAG = f"""CASE WHEN l_orderkey % 7 = 0 THEN list_value({", ".join(f"'{r.name}'" for r in A.RULES)})[(l_orderkey // 7 % {len(A.RULES)} + 1)::INT] END"""
_VIEW = f"CASE WHEN l_returnflag = 'N' THEN '{A.SINGLE}' ELSE '{A.DISTANT}' END"
_PASSES = f"""p AS (
  SELECT l_orderkey AS k, attempt, {_VIEW} AS view, (l_quantity::BIGINT % 5)::INT AS screens, l_partkey % 3 = 0 AS main, CASE WHEN l_linestatus = 'O' THEN 'matched' ELSE 'other' END AS owner,
         l_suppkey % 7 = 0 AS weak, l_suppkey % 7 IN (1, 2) AS edge, l_suppkey % 7 = 3 AS family, l_discount > 0.02 AS geometry, l_tax > 0.07 AS counter, {_FLAG} AS flag,
         CASE WHEN l_partkey % 4 > 0 THEN 'M' || (l_partkey % 2) END AS model, CASE WHEN l_suppkey % 5 > 0 THEN (l_suppkey % 2)::INT END AS price, l_discount < 0.1 AS safe, l_tax < 0.08 AS healthy, CASE WHEN l_extendedprice > 99000 THEN 'B' ELSE 'A' END AS image,
         ['s' || l_suppkey % 7, 'cue'] AS cues, row_number() OVER (PARTITION BY l_orderkey ORDER BY attempt DESC) AS back
  FROM (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))::INT AS attempt FROM lineitem)),
l AS (SELECT * FROM p WHERE back <= 3),
b AS (
  SELECT *, coalesce(view = '{A.DISTANT}' AND (screens = 0 OR screens >= 3) AND NOT main AND owner <> 'matched', false) AS distant, view = '{A.SINGLE}' AND NOT weak AS single, view = '{A.SINGLE}' AND edge AS edge_cut,
         view = '{A.SINGLE}' AND weak AS weak_wide, family AND geometry AS family_geometry, counter AS counterevidence, true AS usable, attempt % 3 <> 0 AS prior_bound, model IS NOT NULL AS winning_pair,
         family AS narrated_fixture, screens >= 3 AS identity_free_wide, screens = 0 AS zero_screen, model IS NULL AS identity_free_single FROM l),
c AS (SELECT *, distant AND screens = 0 AS no_screen, distant AND screens <> 0 AS multi_screen FROM b),
n AS (
  SELECT k, max(flag) AS flag, {", ".join(f"count(*) FILTER ({x}) AS n_{x}" for x in ("family", "family_geometry", "counterevidence", "multi_screen", "weak_wide", "edge_cut", "no_screen", "distant", "single"))}
  FROM c GROUP BY k),
r AS (SELECT k, CASE {" ".join(f"WHEN {x.when or f"flag = '{x.name}'"} THEN {i}" for i, x in enumerate(A.RULES))} END AS number FROM n),
s AS (
  SELECT c.*, r.number, coalesce(CASE r.number {" ".join(f"WHEN {i} THEN {' OR '.join(x.support)}" for i, x in enumerate(A.RULES))} END, false) AS supports,
         CASE r.number {" ".join(f"WHEN {i} THEN '{x.name}'" for i, x in enumerate(A.RULES))} END AS rule, CASE r.number {" ".join(f"WHEN {i} THEN '{x.view}'" for i, x in enumerate(A.RULES))} END AS final
  FROM c JOIN r USING (k))"""


_LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]  # the order of an order's lines


def _passes(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    """Order lines as passes: an order is a key, its lines are attempts; every seventh order has a rule's flag."""
    number = F.floor(F.col("l_orderkey") / 7) % len(A.RULES)
    flag = F.when(F.col("l_orderkey") % 7 == 0, F.array(F.get(F.array(*[F.lit(r.name) for r in A.RULES]), number.cast("int"))))
    ship = F.col("l_suppkey") % 7
    down = Window.partitionBy("l_orderkey").orderBy(*[F.desc(c) for c in _LINES])  # as the last three are found: sorted once
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    attempt = (F.count(F.lit(1)).over(whole) + 1 - F.row_number().over(down)).cast("int")
    df = table(spark, sf, "lineitem").withColumn("attempt", attempt).select(
        F.col("l_orderkey").alias("k"), "attempt", *_LINES, F.when(F.col("l_returnflag") == "N", A.SINGLE).otherwise(A.DISTANT).alias("view"), (F.col("l_quantity").cast("long") % 5).cast("int").alias("screens"),
        (F.col("l_partkey") % 3 == 0).alias("main"), F.when(F.col("l_linestatus") == "O", "matched").otherwise("other").alias("owner"), (ship == 0).alias("weak"), ship.isin(1, 2).alias("edge"), (ship == 3).alias("family"),
        (F.col("l_discount") > 0.02).alias("geometry"), (F.col("l_tax") > 0.07).alias("counter"), flag.alias("flags"), F.when(F.col("l_partkey") % 4 > 0, F.concat(F.lit("M"), (F.col("l_partkey") % 2).cast("string"))).alias("model"),
        F.when(F.col("l_suppkey") % 5 > 0, (F.col("l_suppkey") % 2).cast("int")).alias("price"), (F.col("l_discount") < 0.1).alias("safe"), (F.col("l_tax") < 0.08).alias("healthy"), F.when(F.col("l_extendedprice") > 99000, "B").otherwise("A").alias("image"),
        F.transform(F.array(F.concat(F.lit("s"), ship.cast("string")), F.lit("cue")), lambda c: F.struct(c.alias("cue"), F.lit("strong").alias("strength"))).alias("cues"),
    )
    c = F.col
    own = A.buckets(c("view"), c("screens"), c("main"), c("owner"), c("weak"), c("edge"), c("family"))
    other = {"family_geometry": c("family") & c("geometry"), "counterevidence": c("counter"), "prior_bound": c("attempt") % 3 != 0, "winning_pair": c("model").isNotNull(), "narrated_fixture": c("family")}
    return df, own | other | {"identity_free_wide": c("screens") >= 3, "zero_screen": c("screens") == 0, "identity_free_single": c("model").isNull()}


@query("q143_rule_cascade", f"WITH {_PASSES} SELECT k, rule, final AS view, coalesce(list(attempt ORDER BY attempt) FILTER (supports), []) AS support FROM s GROUP BY k, rule, final")
def q143(spark, sf):
    """The first of 28 ordered rules that holds for each order's last three lines, and the lines that support it."""
    df, own = _passes(spark, sf)
    decided = A.decide_view(df, "k", "attempt", own, "flags", [], order=_LINES)
    return decided.select("k", "rule", "view", F.transform("support", lambda p: p["attempt"]).alias("support"))


@query(
    "q144_three_pass_final",
    f"""WITH {_PASSES},
    v AS (SELECT *, owner = 'matched' AND model IS NOT NULL AND price IS NOT NULL AS votes FROM s),
    y AS (SELECT k, model, price, count(*) AS seen, count(*) FILTER (supports) AS n, count(*) FILTER (supports AND safe) AS good FROM v WHERE votes GROUP BY k, model, price),
    z AS (SELECT k, bool_or(n >= 2 AND good < 2) AS blocked, count(*) FILTER (good >= 2) AS agreed, any_value(model) FILTER (good >= 2) AS model, any_value(price) FILTER (good >= 2) AS price,
                 count(*) AS pairs, count(*) FILTER (seen >= 2) AS repeated, any_value(model) FILTER (seen >= 2) AS want_model, any_value(price) FILTER (seen >= 2) AS want_price FROM y GROUP BY k),
    g AS (SELECT k, any_value(rule) AS rule, any_value(final) AS view, count(*) FILTER (healthy) AS well, count(DISTINCT lower(image)) AS images, min(screens) FILTER (supports) AS fewest, max(screens) FILTER (supports) AS most,
                 coalesce(list(attempt ORDER BY attempt) FILTER (supports), []) AS support, list(cues ORDER BY attempt) FILTER (supports) AS cues FROM v GROUP BY k),
    t AS (SELECT g.*, coalesce(z.blocked, false) AS blocked, CASE WHEN view = '{A.SINGLE}' AND agreed = 1 THEN z.model END AS model, CASE WHEN view = '{A.SINGLE}' AND agreed = 1 THEN z.price END AS price,
                 coalesce(pairs = 1 AND repeated = 1, false) AS fixed, want_model, want_price FROM g LEFT JOIN z ON z.k = g.k),
    q AS (SELECT *, CASE WHEN well < 3 THEN '{A.UNHEALTHY}' WHEN images <> 1 THEN '{A.OTHER_IMAGE}' WHEN rule IS NULL THEN '{A.MISSING}' WHEN view = '{A.SINGLE}' AND blocked THEN '{A.BLOCKED}'
                         WHEN fixed AND (model IS DISTINCT FROM want_model OR price IS DISTINCT FROM want_price) THEN '{A.ERASED}' ELSE '' END AS reason FROM t)
    SELECT k, reason = '' AS verified, reason, CASE WHEN reason = '' THEN rule END AS rule, CASE WHEN reason = '' THEN view END AS view, CASE WHEN reason = '' THEN model END AS model, CASE WHEN reason = '' THEN price END AS price,
           CASE WHEN reason = '' THEN CASE WHEN view = '{A.SINGLE}' THEN most WHEN rule IN {A.NO_SCREEN_RULES} THEN 0 ELSE greatest(3, coalesce(fewest, 3)) END END AS screens,
           CASE WHEN reason = '' THEN array_to_string(list_sort(list_distinct(flatten(coalesce(cues, [])))), ',') END AS cues, CASE WHEN reason = '' THEN support END AS support FROM q""",
)
def q144(spark, sf):
    """Orders settled by their last three lines, or the reason why not."""
    df, own = _passes(spark, sf)
    final = A.finalise(df, "k", "attempt", own, "flags", A.usable(F.col("healthy"), F.array().cast("array<string>"), F.col("view"), local_distant=True), "image", _LINES)
    return final.withColumn("cues", F.array_join(F.array_sort(F.transform("cues", lambda c: c["cue"])), ","))


# Reconciliation and replays ---------------------------------------------------------------------------------------------


@query("q145_numbered_errors", "SELECT event_type AS file, number, 'cut off ' || event_id AS line FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS number FROM events) WHERE value < 2")
def q145(spark, sf):
    """A file of lines for each kind of event, some cut off: each bad line with its number in its file."""
    at = folder(spark, "numbered")
    line = F.when(F.col("value") < 2, F.concat(F.lit("cut off "), F.col("event_id").cast("string"))).otherwise(F.col("props"))
    lines = table(spark, sf, "events").select("event_type", "event_id", line.alias("value"))
    lines.repartition("event_type").sortWithinPartitions("event_type", "event_id").drop("event_id").write.partitionBy("event_type").text(at)
    found = readers.numbered_errors(spark, f"{at}/*/*.txt")
    return found.withColumn("file", F.regexp_extract("file", "event_type=([^/]*)/", 1))


_TOLD = """CASE user_id % 6 WHEN 0 THEN 'Steps first.' || chr(10) || '獨白：我看到' || event_type || '很清楚地在這裡' || chr(10) || '{"k": 1}' WHEN 1 THEN '獨白：短' || chr(10) || '草稿：草稿: a draft of ' || event_type || ' view_type: x'
         WHEN 2 THEN '我看到一台機器在左邊的架子上 first' || chr(10) || '我看到 ' || event_type || ' and a long line' || chr(10) || '- 我看到 this is a list entry' || chr(10) || '{"k": 1}' || chr(10) || '我看到 a line behind the JSON'
         WHEN 3 THEN '我看到 分類 ' || event_type || ' is about words' WHEN 4 THEN NULL ELSE props END"""


@query(
    "q146_monologues",
    """SELECT event_id, CASE user_id % 6 WHEN 0 THEN '我看到' || event_type || '很清楚地在這裡' WHEN 1 THEN 'a draft of ' || event_type WHEN 2 THEN '我看到 ' || event_type || ' and a long line' ELSE '' END AS monologue FROM events""",
)
def q146(spark, sf):
    """What is said in reasonings with markers, drafts, plain lines, or nothing of the kind."""
    told = F.expr(_TOLD.replace("chr(10)", r"'\n'"))
    return table(spark, sf, "events").select("event_id", D.monologue(told).alias("monologue"))


_LISTED = """r AS (
  SELECT o_orderkey % 100000 AS place, 'n' || (o_orderkey // 3) AS name, o_custkey % 50 AS size, CASE WHEN o_orderkey % 11 > 0 THEN md5(o_orderstatus || (o_custkey % 7)) END AS md5 FROM orders WHERE o_orderkey % 5 > 0),
l AS (SELECT o_orderkey AS id, 'n' || (o_orderkey // 3) AS name, (o_custkey + CASE WHEN o_orderpriority = '1-URGENT' THEN 50000 ELSE 0 END) % 60000 % 50 + CASE WHEN o_orderpriority = '2-HIGH' THEN 1000 ELSE 0 END AS size,
      md5(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'other' ELSE o_orderstatus END || (o_custkey % 7)) AS md5 FROM orders)"""


@query(
    "q147_remote_listing",
    f"""WITH {_LISTED},
    c AS (SELECT size, md5, count(*) AS n, min(place) AS one FROM r GROUP BY 1, 2), b AS (SELECT name, size, md5, count(*) AS m, min(place) AS same FROM r GROUP BY 1, 2, 3), k AS (SELECT name, count(*) AS k, min(place) AS named, min(size) AS size, min(md5) AS md5 FROM r GROUP BY 1),
    j AS (SELECT l.*, c.n, b.m, k.k, k.named, CASE WHEN c.n = 1 THEN c.one WHEN b.m = 1 THEN b.same END AS found, k.size IS DISTINCT FROM l.size AS other_size, k.md5 IS DISTINCT FROM l.md5 AS other_md5
          FROM l LEFT JOIN c ON c.size = l.size AND c.md5 = l.md5 LEFT JOIN b ON b.name = l.name AND b.size = l.size AND b.md5 = l.md5 LEFT JOIN k ON k.name = l.name)
    SELECT id, CASE WHEN found IS NOT NULL THEN 'verified' WHEN n IS NOT NULL THEN 'ambiguous' WHEN k = 1 THEN 'mismatch' WHEN k > 1 THEN 'ambiguous' ELSE 'missing' END AS status,
           CASE WHEN n IS NULL AND k = 1 THEN concat_ws(',', CASE WHEN other_size THEN 'size' END, CASE WHEN other_md5 THEN 'md5' END) WHEN n IS NOT NULL AND found IS NULL THEN 'content' WHEN n IS NULL AND k > 1 THEN 'name' ELSE '' END AS reason,
           coalesce(found, CASE WHEN n IS NULL AND k = 1 THEN named END) AS place FROM j""",
)
def q147(spark, sf):
    """Orders as objects here and in a listing there, by size and MD5, then by name."""
    orders = table(spark, sf, "orders")
    name, priority = F.expr("'n' || (o_orderkey DIV 3)").alias("name"), F.col("o_orderpriority")
    digest = lambda c: F.md5(F.concat(c, (F.col("o_custkey") % 7).cast("string")))
    remote = orders.filter("o_orderkey % 5 > 0").select((F.col("o_orderkey") % 100_000).alias("place"), name, (F.col("o_custkey") % 50).alias("size"), F.when(F.col("o_orderkey") % 11 > 0, digest(F.col("o_orderstatus"))).alias("md5"))
    size = (F.col("o_custkey") + F.when(priority == "1-URGENT", 50_000).otherwise(0)) % 60_000 % 50 + F.when(priority == "2-HIGH", 1000).otherwise(0)
    local = orders.select(F.col("o_orderkey").alias("id"), name, size.alias("size"), digest(F.when(priority == "3-MEDIUM", "other").otherwise(F.col("o_orderstatus"))).alias("md5"))
    return N.reconcile_listing(local, remote, "id", "name", ["size", "md5"], "place")


@query(
    "q148_revalidation",
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events),
       d AS (SELECT CASE WHEN event_type = 'error' THEN 'retry' WHEN value > 50 THEN 'unresolved' ELSE 'verified' END AS old, CASE WHEN value > 80 THEN 'unresolved' WHEN event_type IN ('error', 'view') AND value > 5 THEN 'retry' ELSE 'verified' END AS new FROM p WHERE back = 1)
       SELECT old, new, old <> new AS changed, count(*) AS n FROM d GROUP BY ALL""",
)
def q148(spark, sf):
    """Stored passes under two revisions of the rules: how many decisions stay and how many change, and to what."""
    rules = [
        ("r1", 1, "event_type = 'error'", "retry"), ("r1", 2, "value > 50", "unresolved"),
        ("r2", 1, "value > 80", "unresolved"), ("r2", 2, "event_type IN ('error', 'view') AND value > 5", "retry"), ("r3", 1, "true", "dead"),
    ]
    stored = spark.createDataFrame(rules, "revision string, priority int, condition string, decision string")
    return N.revalidate(table(spark, sf, "events"), "user_id", "event_id", stored, "r1", "r2").groupBy("old", "new", "changed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q149_trace_scan",
    """WITH w AS (SELECT c_custkey FROM customer WHERE c_nationkey = 7) SELECT trace, o_orderkey, o_custkey FROM (SELECT 'a' AS trace, * FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'b', * FROM orders WHERE o_orderstatus = 'F') WHERE o_custkey IN (SELECT c_custkey FROM w)""",
)
def q149(spark, sf):
    """Two traces in shards, and of both the rows of some customers: shards that none of them hashes to are not read."""
    at = folder(spark, "traces")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    for trace, kept in (("a", "o_orderstatus <> 'F'"), ("b", "o_orderstatus = 'F'")):
        S.write_shards(orders.filter(kept).select(F.lit(trace).alias("trace"), "o_orderkey", "o_custkey"), f"{at}/{trace}", "o_custkey", 32)
    wanted = table(spark, sf, "customer").filter("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return N.scan_shards(spark, [f"{at}/a", f"{at}/b"], wanted, "o_custkey", 32)


_BITS = {f: (3 + i % 11, i % 3) for i, f in enumerate(A.RETRY_FLAGS)}
_SEEN = ", ".join(f"(user_id + event_id // 7) % {m} = {r} AS {f}" for f, (m, r) in _BITS.items() if f != "valid")
_FIELDS = f"""SELECT user_id AS k, event_id, CASE WHEN user_id % 3 = 0 THEN '{A.DISTANT}' WHEN event_id % 29 = 0 THEN '失敗' ELSE '{A.SINGLE}' END AS view, CASE WHEN event_id % 5 = 0 AND user_id % 3 > 0 THEN event_type END AS model,
    CASE WHEN event_id % 10 = 0 AND user_id % 3 > 0 THEN 'p' END AS price, CASE event_id % 13 WHEN 0 THEN '模糊' WHEN 1 THEN '正常' END AS quality, CASE event_id % 7 WHEN 0 THEN '近景' WHEN 1 THEN '{A.DISTANT}' END AS hint,
    CASE WHEN event_id % 2 = 0 THEN 'matched' ELSE 'other' END AS owner, CAST(event_id % 5 AS INT) AS screens, event_id % 4 > 0 AS valid"""


@query(
    "q159_retry_reasons",
    f"""WITH p AS ({_FIELDS}, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, {_SEEN} FROM events), f AS (SELECT *, ((nth - 1) % 3 + 1)::INT AS attempt, (nth - 1) // 3 AS run, 3 AS most FROM p),
    c AS (SELECT * REPLACE (coalesce(hint, '') AS hint, coalesce(quality, '') AS quality), {", ".join(f"({w}) AS r{i}" for i, (_, w) in enumerate([(r, w.replace("hint <>", "coalesce(hint, '') <>")) for r, w in A.RETRY_REASONS]))} FROM f),
    d AS (SELECT *, list_distinct_kept AS found FROM (SELECT *, list_filter([CASE WHEN NOT valid THEN 'contract' END, {", ".join(f"CASE WHEN r{i} THEN '{r}' END" for i, (r, _) in enumerate(A.RETRY_REASONS))},
             CASE WHEN view = '{A.DISTANT}' AND quality NOT IN {A.QUALITY_FINE} THEN '{A.QUALITY_REASONS[A.DISTANT]}' || quality WHEN view = '{A.SINGLE}' AND quality NOT IN {A.QUALITY_FINE} THEN '{A.QUALITY_REASONS[A.SINGLE]}' || quality END], lambda x: x IS NOT NULL) AS list_distinct_kept FROM c)),
    e AS (SELECT *, CASE WHEN len(found) = 0 AND view = '{A.DISTANT}' AND attempt >= 3 AND NOT wide_resolved AND count(*) FILTER (view = '{A.DISTANT}') OVER (PARTITION BY k, run) < 3 THEN ['{A.NO_DISTANT_CONSENSUS}'] ELSE found END AS reasons FROM d)
    SELECT event_id, array_to_string(reasons, ';') AS reasons, CASE WHEN len(reasons) > 0 AND attempt < 3 THEN 'retry' WHEN len(reasons) > 0 OR NOT valid THEN 'unresolved' ELSE 'verified' END AS decision FROM e""",
)
def q159(spark, sf):
    """Three passes after the other of each user, with made-up findings, and the reasons for another pass that follow."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    seen = _SEEN.replace("//", "DIV")
    df = spark.sql(f"{_FIELDS.replace('//', 'DIV')}, user_id, {seen} FROM {{events}}", events=table(spark, sf, "events")).withColumn("_n", nth - 1)
    df = df.withColumns({"nth": (F.col("_n") % 3 + 1).cast("int"), "run": F.struct("k", F.floor(F.col("_n") / 3)), "contract_reasons": F.array(F.lit("contract"))})
    out = A.retry_reasons(df, "run", "nth")
    return out.select("event_id", F.array_join("reasons", ";").alias("reasons"), "decision")


@query(
    "q160_danger_classes",
    f"""WITH c AS (SELECT event_id, event_type IN ('view', 'click') AS far, event_type = 'error' AS family, user_id % 2 = 0 AS guard, CASE user_id % 4 WHEN 0 THEN '{A.DISTANT}' WHEN 1 THEN '{A.SINGLE}' WHEN 2 THEN 'distant_view' END AS view, CASE user_id % 3 WHEN 0 THEN 'M1' WHEN 1 THEN '' END AS model FROM events),
    d AS (SELECT event_id, list_filter([CASE WHEN far AND view <> '{A.DISTANT}' THEN 'distant_view_misclassification' END, CASE WHEN family AND view IN ('{A.DISTANT}', 'distant_view') THEN 'followme_misclassification' END, CASE WHEN guard AND model <> '' THEN 'model_hallucination' END], lambda x: x IS NOT NULL) AS d FROM c)
    SELECT array_to_string(d, ',') AS dangers, len(d) > 0 AS dangerous, count(*) AS n FROM d GROUP BY ALL""",
)
def q160(spark, sf):
    """Predictions by the dangerous errors that their cases' tags make of them."""
    c = F.col
    tags = F.array_compact(F.array(F.when(c("event_type").isin("view", "click"), "distant_view"), F.when(c("event_type") == "error", "followme_pro"), F.when(c("user_id") % 2 == 0, "hallucination_guard")))
    view = F.when(c("user_id") % 4 == 0, A.DISTANT).when(c("user_id") % 4 == 1, A.SINGLE).when(c("user_id") % 4 == 2, "distant_view")
    model = F.when(c("user_id") % 3 == 0, "M1").when(c("user_id") % 3 == 1, "")
    found = A.dangers(tags, F.lit(A.DISTANT), F.lit(None).cast("string"), view, model)
    marked = table(spark, sf, "events").select(found.alias("d"))
    return marked.groupBy(F.array_join("d", ",").alias("dangers"), (F.size("d") > 0).alias("dangerous")).agg(F.count(F.lit(1)).alias("n"))
