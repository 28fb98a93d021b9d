"""Whole workflows composed of the operators: upload manifests, risk audits, evidence backfills and trace migrations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.functions import domain as D
from veriframe.functions import text as T
from veriframe.operators import injected as J
from veriframe.operators import relational as R
from veriframe.plans.catalogue import table
from veriframe.plans.exhibits import folder
from veriframe.plans.registry import query
from veriframe.sources import readers, sinks


def marked(rows: DataFrame, key: str, **sets: DataFrame) -> DataFrame:
    """rows with a boolean for each set, whether their key is in it; a set is brought down to its keys before it is joined."""
    for name, s in sets.items():
        rows = rows.join(s.select(key).distinct().withColumn(name, F.lit(True)), key, "left").fillna(False, [name])
    return rows


def upload_manifest(inventory: DataFrame, key: str, year: Column, wanted: str, order: Sequence[Column], limit: int, verified: DataFrame, evidence: DataFrame, corrected: DataFrame, conflicts: DataFrame, uploaded: DataFrame) -> dict[str, DataFrame]:
    """Six outputs of one marked inventory: `ready` (the first `limit` of the wanted year by order), `review`, `corrections`,
    `uploaded`, and the counts `by_reason` and `by_year`.

    What lacks verification or evidence, or is in conflict, is for review, with all its reasons; what has been uploaded goes
    up again only if it was corrected since. Five sets are joined by key; the limit comes last.
    """
    m = marked(inventory, key, verified=verified, evidence=evidence, corrected=corrected, conflict=conflicts, uploaded=uploaded)
    m = m.withColumns({"reasons": T.add_if((~F.col("verified"), "unverified"), (~F.col("evidence"), "no_evidence"), (F.col("conflict"), "conflict")), "year": year})
    clear = F.size("reasons") == 0
    fresh = m.filter(clear & (~F.col("uploaded") | F.col("corrected")) & (F.col("year") == wanted))
    return {
        "ready": fresh.orderBy(*order).limit(limit), "review": m.filter(~clear), "corrections": m.filter(clear & F.col("uploaded") & F.col("corrected")), "uploaded": m.filter("uploaded AND NOT corrected"),
        "by_reason": m.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")), "by_year": m.filter(clear).groupBy("year").agg(F.count(F.lit(1)).alias("n")),
    }


def risk_audit(records: DataFrame, texts: DataFrame, key: str, text: str, terms: list[str], negations: list[str], high: int = 3, sample: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records with the terms that stand in their text without a negation, and a risk class; the classes' counts; and a sample.

    The risk is high from `high` terms on, medium from one, else low; records without a text have none. The sample has of
    each class the `sample` records with the least hashes of their key.
    """
    joined = records.join(texts.select(key, text), key, "left").withColumn("_t", F.coalesce(F.lower(text), F.lit("")))
    hits = F.array_compact(F.array(*[F.when(T.unnegated(F.col("_t"), t, negations), F.lit(t)) for t in terms]))
    judged = joined.withColumn("terms", hits).withColumn("risk", T.first_match((F.size("terms") >= high, "high"), (F.size("terms") >= 1, "medium"), default="low")).drop("_t", text)
    counts = judged.groupBy("risk").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains("terms", t)).alias(f"n_{i}") for i, t in enumerate(terms)])
    return judged, counts, R.stratified_sample(judged, "risk", [key], sample)


def backfill_candidates(inventory: DataFrame, key: str, content: Sequence[str], done: Sequence[DataFrame], receipts: DataFrame, modified: str, confirmed: str, digest: str) -> DataFrame:
    """Inventory keys that stand for one content, are in none of the done sets, and whose receipt, if there is one, is not to
    be trusted: the source changed after it, to other content. receipts has the key, `confirmed` and the content's digest then."""
    clear = R.veto_candidates(inventory, key, [*content, modified, digest], done)
    held = receipts.select(F.col(key).alias("_key"), F.col(confirmed).alias("_confirmed"), F.col(digest).alias("_digest"))
    trusted = D.receipt_trusted(F.col(modified), F.col("_confirmed"), F.col(digest) == F.col("_digest"))
    return clear.join(held, F.col(key) == F.col("_key"), "left").filter(F.col("_key").isNull() | ~trusted).select(key, *content)


def migrate_trace(spark: SparkSession, source: str, schema: str, candidates: DataFrame, key: str, value: str, target: str) -> DataFrame:
    """Rows of a legacy trace, each with the value that its key has among the candidates, into the target; and what happened.

    All or nothing: a malformed line, or a key with no value or several, keeps everything back. Rows whose key the target has
    are not written again. One row: lines, malformed, unresolved, written.
    """
    good, _ = readers.read_jsonl(spark, source, schema)
    malformed = readers.numbered_errors(spark, source).count()
    found = R.unique_lookup(good, candidates, [key], value)
    n, unresolved = found.agg(F.count(F.lit(1)), F.count_if(F.col("lookup") != "matched")).first()
    written = 0 if malformed or unresolved else sinks.append_new(found.drop("lookup"), target, key)
    return spark.range(1).select(F.lit(n).cast("long").alias("lines"), F.lit(malformed).cast("long").alias("malformed"), F.lit(unresolved).cast("long").alias("unresolved"), F.lit(written).cast("long").alias("written"))


@query(
    "q164_upload_manifest",
    """WITH m AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N') AS verified, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 40) AS evidence,
              o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_tax = 0) AS corrected, o_orderpriority = '5-LOW' AS conflict, o_custkey % 3 = 0 AS uploaded FROM orders),
       c AS (SELECT *, verified AND evidence AND NOT conflict AS clear FROM m), r AS (SELECT o_orderkey FROM c WHERE clear AND (NOT uploaded OR corrected) AND y = 1997 ORDER BY o_custkey DESC, o_orderkey LIMIT 200)
       SELECT 'ready' AS output, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM r UNION ALL SELECT 'review', count(*), sum(o_orderkey)::BIGINT FROM c WHERE NOT clear UNION ALL SELECT 'corrections', count(*), sum(o_orderkey)::BIGINT FROM c WHERE clear AND uploaded AND corrected
       UNION ALL SELECT 'uploaded', count(*), sum(o_orderkey)::BIGINT FROM c WHERE uploaded AND NOT corrected
       UNION ALL SELECT 'by_reason', 1, count(*) FILTER (NOT verified) + 7 * count(*) FILTER (NOT evidence) + 49 * count(*) FILTER (conflict) FROM c UNION ALL SELECT 'by_year', count(DISTINCT y), sum(y)::BIGINT FROM c WHERE clear""",
)
def q164(spark, sf):
    """Orders to go up: counts and key sums of all six outputs."""
    line, orders = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), table(spark, sf, "orders")
    out = upload_manifest(
        orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey", F.year("o_orderdate").cast("string"), "1997", [F.desc("o_custkey"), F.asc("o_orderkey")], 200,
        line.filter("l_returnflag = 'N'"), line.filter("l_quantity < 40"), line.filter("l_tax = 0"), orders.filter("o_orderpriority = '5-LOW'"), orders.filter("o_custkey % 3 = 0"),
    )
    weight = F.when(F.col("reason") == "unverified", 1).when(F.col("reason") == "no_evidence", 7).otherwise(49)
    parts = [f.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit(k).alias("output"), "n", "keys") for k, f in out.items() if not k.startswith("by_")]
    parts.append(out["by_reason"].agg(F.sum(weight * F.col("n")).alias("keys")).select(F.lit("by_reason").alias("output"), F.lit(1).cast("long").alias("n"), "keys"))
    parts.append(out["by_year"].agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("year").cast("long") * F.col("n")).alias("keys")).select(F.lit("by_year").alias("output"), "n", "keys"))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total


_TERMS, _NOT = ["tion", "rest", "oux"], ["not", "ne"]


def _stands(term: str) -> str:
    before = f"list_transform(range(1, len(string_split(t, '{term}'))), lambda i: right(array_to_string(string_split(t, '{term}')[1:i], '{term}'), 28))"
    return f"len(list_filter({before}, lambda x: NOT ({' OR '.join(f'''contains(x, '{n}')''' for n in _NOT)}))) > 0"


@query(
    "q165_risk_sample",
    f"""WITH h AS (SELECT l.doc_id, list_filter([{", ".join(f"CASE WHEN {_stands(t)} THEN '{t}' END" for t in _TERMS)}], lambda x: x IS NOT NULL) AS terms FROM labels l LEFT JOIN (SELECT doc_id, coalesce(lower(text), '') AS t FROM documents) d ON d.doc_id = l.doc_id),
       r AS (SELECT *, CASE WHEN len(terms) >= 3 THEN 'high' WHEN len(terms) >= 1 THEN 'medium' ELSE 'low' END AS risk FROM h)
       SELECT risk, doc_id, array_to_string(terms, ',') AS terms, all_n FROM (SELECT *, count(*) OVER (PARTITION BY risk) AS all_n, row_number() OVER (PARTITION BY risk ORDER BY left(sha1(doc_id::VARCHAR), 12), doc_id) AS k FROM r) WHERE k <= 5""",
)
def q165(spark, sf):
    """Labelled documents by the risky terms in their texts: a sample of each class, with how many it has."""
    _, counts, sample = risk_audit(table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", _TERMS, _NOT)
    return sample.join(counts.select("risk", F.col("n").alias("all_n")), "risk").select("risk", "doc_id", F.array_join("terms", ",").alias("terms"), "all_n")


@query(
    "q166_backfill",
    """WITH i AS (SELECT o_custkey, min(o_orderstatus) AS content, min(o_orderdate) AS modified, min(md5(o_orderstatus)) AS digest FROM orders GROUP BY 1 HAVING count(DISTINCT (o_orderstatus, o_orderdate)) = 1 AND bool_and(o_orderstatus IS NOT NULL)),
       r AS (SELECT c_custkey, TIMESTAMP '1995-06-01' AS confirmed, md5(CASE WHEN c_nationkey < 12 THEN 'O' ELSE 'F' END) AS digest FROM customer WHERE c_nationkey % 3 > 0)
       SELECT i.o_custkey, content AS o_orderstatus FROM i LEFT JOIN r ON r.c_custkey = i.o_custkey WHERE i.o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
       AND (r.c_custkey IS NULL OR NOT (NOT (i.modified > r.confirmed + INTERVAL 2 SECOND) OR i.digest = r.digest))""",
)
def q166(spark, sf):
    """Customers with one order's content, not done, whose receipt is none or stale."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("modified"), F.md5("o_orderstatus").alias("digest"))
    customer = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    held = customer.filter("c_nationkey % 3 > 0").select("o_custkey", F.lit("1995-06-01 00:00:00").cast("timestamp").alias("confirmed"), F.md5(F.when(F.col("c_nationkey") < 12, "O").otherwise("F")).alias("digest"))
    return backfill_candidates(orders, "o_custkey", ["o_orderstatus"], [customer.filter("c_mktsegment = 'BUILDING'")], held, "modified", "confirmed", "digest")


@query(
    "q167_trace_migration",
    """SELECT 'clean' AS run, count(*) AS lines, 0::BIGINT AS malformed, 0::BIGINT AS unresolved, count(DISTINCT s_suppkey) AS written FROM supplier UNION ALL SELECT 'again', count(*), 0, 0, 0 FROM supplier
       UNION ALL SELECT 'broken', count(*) FILTER (s_nationkey > 3), count(*) FILTER (s_nationkey <= 3), count(*) FILTER (s_nationkey > 3 AND s_nationkey % 2 = 0), 0 FROM supplier""",
)
def q167(spark, sf):
    """A trace of suppliers moved with their nations, moved again, and one that is kept back for its errors."""
    at = folder(spark, "migration")
    supplier = table(spark, sf, "supplier")
    line = F.to_json(F.struct("s_suppkey", "s_nationkey"))
    supplier.select(line.alias("value")).write.text(f"{at}/clean")
    supplier.select(F.when(F.col("s_nationkey") > 3, line).otherwise("cut off {").alias("value")).write.text(f"{at}/broken")
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    by_supplier = supplier.select("s_suppkey", "s_nationkey").join(names, "s_nationkey").select("s_suppkey", "n_name")
    two = by_supplier.unionByName(supplier.filter("s_nationkey % 2 = 0").select("s_suppkey", F.lit("another").alias("n_name")))
    out = None
    for run, path, candidates in (("clean", "clean", by_supplier), ("again", "clean", by_supplier), ("broken", "broken", two)):
        one = migrate_trace(spark, f"{at}/{path}", "s_suppkey long, s_nationkey int", candidates, "s_suppkey", "n_name", f"{at}/target").select(F.lit(run).alias("run"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "q169_row_function",
    """SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN upper(p_brand) || '/' || p_size END AS tag, CASE WHEN p_size % 7 > 0 THEN (p_size * 3)::BIGINT END AS tripled, CASE WHEN p_size % 7 = 0 THEN 'ValueError: size ' || p_size END AS error FROM part""",
)
def q169(spark, sf):
    """A function of the user's for each part; where it raises, the row says so."""

    def tagged(row, context):
        if row["p_size"] % 7 == 0:
            raise ValueError(f"size {row['p_size']}")
        return {"tag": f"{row['p_brand'].upper()}/{row['p_size']}", "tripled": row["p_size"] * context["factor"]}

    return J.map_rows(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), tagged, "tag string, tripled long", {"factor": 3}).drop("p_brand", "p_size")


@query(
    "q170_decision_function",
    """SELECT conv_id, turn, CASE WHEN role = lag(role) OVER w THEN 'repeated' WHEN turn >= 3 THEN 'capped' ELSE 'open' END AS decision FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS c FROM conversations) WHERE c = 1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def q170(spark, sf):
    """A decision of the user's over each turn and those before it, of turns that are one row each."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    single = rows.join(rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("c")).filter("c = 1").drop("c"), ["conv_id", "turn"], "left_semi")

    def decide(record, attempt, history, most):
        if history and record["role"] is not None and history[-1]["role"] == record["role"]:
            return "repeated"
        return "capped" if attempt >= most else "open"

    return J.decide_rows(single, "conv_id", "turn", decide).select("conv_id", "turn", "decision")
