"""Queries that take each of the smaller functions over a whole table: prices, names, keys, times, sets, JSON and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions import domain as D
from veriframe.functions import folds
from veriframe.functions import text as T
from veriframe.operators import relational as R
from veriframe.operators import rules as S
from veriframe.plans.catalogue import table
from veriframe.plans.exhibits import folder
from veriframe.plans.registry import query
from veriframe.plans.replays import event_stream
from veriframe.sources import readers
from veriframe.streaming import jobs, state

_PRICE, _REFERENCE = "p_size * 300", "p_partkey % 7 * 500"
_GIVEN = f"CASE p_partkey % 4 WHEN 0 THEN 'about 900' WHEN 1 THEN '499.5' WHEN 2 THEN CAST({_PRICE} AS {{}}) END"


@query(
    "q150_price_checks",
    f"""SELECT p_partkey, CASE WHEN {_REFERENCE} > 0 THEN round_even(({_PRICE} - {_REFERENCE})::DOUBLE / ({_REFERENCE}) * 100, 1) END AS diff,
          CASE WHEN {_REFERENCE} <= 0 THEN '?' WHEN {_PRICE} = {_REFERENCE} THEN '✓' WHEN {_PRICE} > {_REFERENCE} THEN '↑' ELSE '↓' END AS symbol, coalesce(TRY_CAST({_GIVEN.format("VARCHAR")} AS DOUBLE) BETWEEN 500 AND 500000, false) AS plausible FROM part""",
)
def q150(spark, sf):
    price, reference = F.expr(_PRICE), F.expr(_REFERENCE)
    return table(spark, sf, "part").select("p_partkey", T.percent_diff(price, reference).alias("diff"), T.price_symbol(T.price_status(price, reference)).alias("symbol"), T.plausible_price(F.expr(_GIVEN.format("STRING"))).alias("plausible"))


_FILE = "CASE WHEN p_size % 2 = 0 THEN 'M' || p_size || '-a_B-' || p_partkey || '-x-' || p_size WHEN p_size % 3 = 0 THEN 'Shelf_' || p_partkey || '-' || p_size ELSE 'Shelf-' || p_brand END"


@query(
    "q151_names_and_keys",
    f"""WITH f AS (SELECT *, {_FILE} AS file FROM part), p AS (SELECT *, regexp_split_to_array(file, '[-_]') AS parts FROM f)
       SELECT p_partkey, CASE WHEN len(parts) >= 6 AND starts_with(upper(parts[1]), 'M') THEN lower(array_to_string(parts[1:len(parts) - 1], '-')) ELSE lower(regexp_replace(file, '[_-]\\d+$', '')) END AS label,
              lower(replace('C:\\Data/' || file, '\\', '/')) AS path, sha256(lower(file)) AS id, substr(sha256(p_partkey || '|' || p_brand), 1, 16) AS key, '{{"p_brand":"' || p_brand || '","p_size":' || p_size || '}}' AS json FROM p""",
)
def q151(spark, sf):
    file = F.col("file")
    parts = table(spark, sf, "part").withColumn("file", F.expr(_FILE))
    key = T.composite_key(F.col("p_partkey").cast("string"), F.col("p_brand"), length=16)
    return parts.select("p_partkey", T.group_label(file).alias("label"), T.path_key(F.concat(F.lit("C:\\Data/"), file)).alias("path"), T.stable_id(file).alias("id"), key.alias("key"), T.canonical_json("p_size", "p_brand").alias("json"))


@query(
    "q152_times",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts)) - 28800000000 WHEN 2 THEN NULL END AS parsed,
         coalesce(CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 8 HOUR END < TIMESTAMP '2024-01-19', true) AS stale, epoch_us(ts) AS from_ns FROM events""",
)
def q152(spark, sf):
    """Times with a zone or Z, and none; whether they are older than a day at a time; and modification times in nanoseconds."""
    ts = F.col("ts").cast("timestamp")
    written = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    told = F.when(F.col("event_id") % 4 == 0, F.concat(written, F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.concat(written, F.lit("+08:00"))).when(F.col("event_id") % 4 == 2, "yesterday")
    parsed = T.parse_time(told)
    now = F.lit("2024-01-20T00:00:00Z").cast("timestamp")
    return table(spark, sf, "events").select("event_id", F.unix_micros(parsed).alias("parsed"), S.is_stale(parsed, now, 24).alias("stale"), F.unix_micros(T.from_mtime_ns(F.unix_micros(ts) * 1000)).alias("from_ns"))


_SET = "event_type || '; ' || CASE WHEN user_id % 2 = 0 THEN 'error' ELSE 'new' END || ';;' || event_type"


@query(
    "q153_maps_and_sets",
    """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN event_type ELSE 'kept' END AS changed, 'base' AS fixed, event_type IN ('error', 'click') AS wanted, true AS open,
         array_to_string(list_filter(['err', 'view', 'c'], lambda w: contains(event_type, w)), ',') AS terms,
         CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'Fehler' ELSE CASE event_type WHEN 'error' THEN 'Fehler' WHEN 'view' THEN 'Blick' ELSE event_type END || '；' || CASE WHEN user_id % 2 = 0 THEN 'Fehler' ELSE 'new' END END AS labels FROM events""",
)
def q153(spark, sf):
    """Maps changed where that is allowed, membership, matched terms, and encoded sets with labels."""
    base = F.create_map(F.lit("a"), F.lit("kept"), F.lit("b"), F.lit("base"))
    changes = F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("not allowed"))).otherwise(F.create_map(F.lit("b"), F.lit("nor this")))
    merged = S.merge_allowed(base, changes, ["a", "c"])
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id", merged["a"].alias("changed"), merged["b"].alias("fixed"), S.member(kind, ["error", "click"]).alias("wanted"), S.member(kind, []).alias("open"),
        F.array_join(T.hit_terms(kind, ["err", "view", "c"]), ",").alias("terms"), T.translate_set(F.expr(_SET), {"error": "Fehler", "view": "Blick"}).alias("labels"),
    )


@query(
    "q154_product_lists",
    """WITH p AS (SELECT 'S' || p_partkey AS short, CASE WHEN p_size % 2 = 0 THEN 'S' || p_partkey ELSE 'F' || p_partkey END AS long, CASE WHEN p_size * 100 BETWEEN 1000 AND 1000000 THEN p_size * 100 WHEN p_partkey * 10 BETWEEN 1000 AND 1000000 THEN p_partkey * 10 END AS price FROM part)
       SELECT short AS code, price::INT AS price FROM p WHERE price IS NOT NULL UNION SELECT long, price::INT FROM p WHERE price IS NOT NULL""",
)
def q154(spark, sf):
    """Product lists as JSON documents, one for each part, read and taken apart into codes and prices."""
    at = folder(spark, "products")
    part = table(spark, sf, "part")
    full = F.concat(F.when(F.col("p_size") % 2 == 0, "S").otherwise("F"), F.col("p_partkey").cast("string"))
    model = F.struct(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("shortCode"), full.alias("fullCode"), (F.col("p_size") * 100).cast("string").alias("promotionPrice"), (F.col("p_partkey") * 10).cast("string").alias("price"))
    part.select(F.array(F.struct(F.array(model).alias("modelList"))).alias("productList")).write.json(at)
    schema = "productList array<struct<modelList:array<struct<shortCode:string,fullCode:string,promotionPrice:string,price:string>>>>"
    return readers.explode_products(readers.read_json_or_jsonl(spark, at, schema))


@query(
    "q155_page_prices",
    """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_size * 1000, p_partkey % 40000, 9990], lambda n: n BETWEEN 5000 AND 30000))), ',') AS prices FROM part WHERE p_partkey % 40000 >= 1000
       UNION ALL SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_size * 1000, 9990], lambda n: n BETWEEN 5000 AND 30000))), ',') FROM part WHERE p_partkey % 40000 < 1000""",
)
def q155(spark, sf):
    """Prices in pages: behind a currency sign or a price word, in the range; other numbers are none."""
    page = F.concat(F.lit("<b>NT$ "), F.format_number(F.col("p_size") * 1000, 0), F.lit("</b> Price: "), (F.col("p_partkey") % 40_000).cast("string"), F.lit(" <i>特價 9990</i> 12345 pieces, "), F.lit("code 20000"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(readers.prices_in(page), ",").alias("prices"))


@query(
    "q156_broken_answers",
    """WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events)
       SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"k": ' || k || '}' WHEN 1 THEN '{"k": [' || k || ',{"price":""}]}' WHEN 2 THEN '{"k": "' || k || '"}' ELSE '{"k": ' || k || '}' END AS repaired,
              CASE event_id % 4 WHEN 0 THEN '{"k":' || k || '}' WHEN 1 THEN '{"model":' || k || '}' WHEN 2 THEN '{"q":' || k || '}' END AS answer FROM k""",
)
def q156(spark, sf):
    """Answers cut off, fenced or with a comma too many, repaired; and the object that an answer gives."""
    case, k = F.col("event_id") % 4, F.get_json_object("props", "$.k")
    cut = F.when(case == 0, F.rtrim(F.col("props"), F.lit("}"))).when(case == 1, F.concat(F.lit('{"k": ['), k, F.lit(',{"price":'))).when(case == 2, F.concat(F.lit('// a note\n{"k": "'), k)).otherwise(F.concat(F.lit('```json\n{"k": '), k, F.lit(",}\n```")))
    said = F.when(case == 0, F.concat(F.lit('so\n{"x": 1}\n '), "props")).when(case == 1, F.concat(F.lit('it is {"model":\n'), k, F.lit("}, {bad}"))).when(case == 2, F.concat(F.lit('```json\n{"q":\n'), k, F.lit("}\n```"))).otherwise("nothing")
    return table(spark, sf, "events").select("event_id", folds.repair_json(cut).alias("repaired"), folds.answer_json(said, ["view_type", "model"]).alias("answer"))


@query(
    "q157_stream_alarm",
    """WITH m AS (SELECT event_type, max(ts) AS newest FROM events GROUP BY 1), n AS (SELECT e.event_type, least(count(DISTINCT user_id), 12) AS n FROM events e JOIN m ON m.event_type = e.event_type AND e.ts >= newest - INTERVAL 6 HOUR GROUP BY 1)
       SELECT event_type, n AS "distinct", n >= 3 AS alarm FROM n""",
)
def q157(spark, sf):
    """How many users each kind of event had in its last six hours, and whether that is an alarm, as a stream tells at its end."""
    at = folder(spark, "alarm")
    state.run_to_end(jobs.rolling_alarm(event_stream(spark, sf, "true", f"{at}/in"), "event_type", "ts", "user_id", 6 * 3600), f"{at}/out", f"{at}/state", "update")
    last = spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.max_by(F.struct("distinct", "alarm"), "batch").alias("l"))
    return last.select("event_type", "l.distinct", "l.alarm")


@query("q158_json_documents", "SELECT n_nationkey, n_name FROM nation")
def q158(spark, sf):
    """A JSON array of nations for each region, read as documents; one that is cut off is left out."""
    at = folder(spark, "documents")
    nation = table(spark, sf, "nation")
    arrays = nation.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))  # five regions
    broken = spark.range(1).select((F.col("id") - 1).alias("n_regionkey"), F.lit('[{"n_nationkey": 1, "n_na').alias("value"))
    arrays.unionByName(broken).write.partitionBy("n_regionkey").text(at)
    read = readers.read_json(spark, f"{at}/*/*.txt", "n_nationkey long, n_name string")
    return read.filter("_corrupt_record IS NULL").select("n_nationkey", "n_name")


@query(
    "q161_narration_faults",
    """SELECT event_id, CASE user_id % 9 WHEN 0 THEN 'raw_structure' WHEN 1 THEN '' WHEN 2 THEN 'raw_structure' WHEN 3 THEN 'instruction_echo' WHEN 4 THEN 'raw_structure' WHEN 5 THEN 'raw_structure,instruction_echo' WHEN 6 THEN 'raw_structure' ELSE '' END AS faults FROM events""",
)
def q161(spark, sf):
    """Narrations with JSON, fields, fences or instructions in them, and plain ones."""
    told = {
        0: F.concat(F.lit("I see "), "props"), 1: F.concat(F.lit("I see {k} and [k "), "event_type"), 2: F.lit('so "Price" = 5'), 3: F.concat(F.lit("不得抄寫 "), "event_type"), 4: F.lit("``` JSON\n [x"),
        5: F.lit("followme_physical_evidence: 更正後"), 6: F.lit("the list [1, 2] of [them"), 7: F.lit("a model of clarity, its price is fine"),
    }
    text = F.coalesce(*[F.when(F.col("user_id") % 9 == i, c) for i, c in told.items()])
    return table(spark, sf, "events").select("event_id", F.array_join(D.narration_faults(text), ",").alias("faults"))


_CLASSES = {"metal": "p_type LIKE '%STEEL%' OR p_type LIKE '%BRASS%'", "small": "p_size < 10", "branded": "p_brand LIKE '%1'", "other": "p_size >= 40 AND p_type NOT LIKE '%STEEL%'"}


@query(
    "q162_class_sums",
    f"""WITH g AS (SELECT p_type, p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) SELECT class, total::BIGINT AS total FROM (SELECT {", ".join(f"coalesce(sum(n) FILTER ({c}), 0) AS {n}" for n, c in _CLASSES.items())} FROM g) UNPIVOT (total FOR class IN ({", ".join(_CLASSES)}))""",
)
def q162(spark, sf):
    """How many parts there are of classes that overlap, from counts by type, brand and size."""
    groups = table(spark, sf, "part").groupBy("p_type", "p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return R.class_sums(groups, "n", {n: F.expr(c) for n, c in _CLASSES.items()})


@query(
    "q163_dataset_splits",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders), k AS (SELECT o_custkey, o_orderkey, o_custkey % 97 AS g FROM o WHERE r = 1),
       c AS (SELECT g, count(*) AS n FROM k GROUP BY 1), s AS (SELECT g, coalesce(sum(n) OVER (ORDER BY sha256(g::VARCHAR), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM c)
       SELECT o_custkey, o_orderkey, CASE WHEN b < 0.8 * t THEN 'train' WHEN b < (0.8 + 0.1) * t THEN 'dev' ELSE 'holdout' END AS split FROM k JOIN s USING (g)""",
)
def q163(spark, sf):
    """The first order of each customer, split so that no group of customers is in two splits."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_custkey") % 97).alias("g"))
    return R.dataset_splits(orders, "o_custkey", ["o_orderkey"], "g").select("o_custkey", "o_orderkey", "split")


_PAGE = """CASE p_partkey % 6 WHEN 0 THEN 'ab<b>ls' || p_partkey || 'exzw</b> from nt$ 12,' || (100 + p_size) || ' NT$5' WHEN 1 THEN 'LS' || p_partkey || 'EXZW at NT$ 900, LS' || p_partkey || 'E now' WHEN 2 THEN 'a LS' || p_partkey || 'E: NT$' || (2000 + p_size)
    WHEN 3 THEN 'NT$3,000 before LS' || p_partkey || 'EXZW <script type="application/ld+json">{"offers": {"price": "' || p_size || '.9"}}</script>' WHEN 4 THEN 'NT$ 4,000 for all' ELSE '' END"""


@query(
    "q168_page_cascade",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 12100 + p_size WHEN 2 THEN 2000 + p_size WHEN 3 THEN p_size END::INT AS price FROM part""",
)
def q168(spark, sf):
    """Prices on pages by model: behind the full name, the short name, or in the structured data; none where the amount is too low or stands before."""
    short = F.concat(F.lit("LS"), F.col("p_partkey").cast("string"), F.lit("E"))
    return table(spark, sf, "part").select("p_partkey", readers.page_price(F.expr(_PAGE), F.concat(short, F.lit("XZW")), short).alias("price"))
