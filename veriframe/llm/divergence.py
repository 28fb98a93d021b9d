"""How far the sources of each language differ in their terms, as plain relational algebra.

Terms are exploded and counted by language and source; a language keeps the terms of enough documents. Each group is crossed
with its language's kept terms, so that terms it lacks count as zero; the dense table joined with itself on language and
term gives the divergence of each pair of sources, and joined with the language's own counts what makes a source stand out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import cut, partitions

#: Terms are maximal runs of ASCII letters and of any characters beyond ASCII; all other characters stand between them.
_UPPER = "".join(chr(c) for c in range(0x41, 0x5B))
_BETWEEN = "".join(chr(c) for c in range(0x80) if not chr(c).isalpha())
#: Documents that a kept term must be in, at least, and ranks of terms that are returned.
LEAST_DOCUMENTS, TOP = 10, 10
#: Probabilities are integers of this many parts.
PARTS = 1_000_000_000


def _within(left: DataFrame, right: DataFrame, key: str, by: Column) -> DataFrame:
    """All rows of left beside all of right with the same key: left is dealt out by a hash, right copied to each share.

    So the rows of one key are spread over as many tasks as there are, whichever key holds most.
    """
    shares = partitions(left.sparkSession)
    dealt = left.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(shares)).cast("int"))
    copied = right.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return dealt.join(copied, [key, "_share"]).drop("_share")


def _probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(PARTS * (count + 2) / (total + 2 * kept)), exact: the product may pass 64 bits."""
    part = F.lit(PARTS).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    whole = (total + 2 * kept).cast("decimal(20,0)")
    return 1 + F.call_function("div", part, whole)


def _difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); with PARTS as it is, all fit 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term in each group, and the rows that have it.

    docs has lang, source and text, none of them null. A text's terms are sorted, so that each first of a run counts its
    document: no shuffle is needed but the one that sums up, after each task has.
    """
    spaced = F.translate("text", _UPPER + _BETWEEN, _UPPER.lower() + " " * len(_BETWEEN))
    terms = F.sort_array(F.split(spaced, " "))
    each = docs.select("lang", "source", terms.alias("terms")).select("lang", "source", "terms", F.posexplode("terms").alias("at", "term"))
    first = (F.col("at") == 0) | (F.get("terms", F.col("at") - 1) != F.col("term"))
    marked = each.select("lang", "source", "term", first.cast("int").alias("first")).filter("term <> ''")  # between two characters that both part terms
    return marked.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("docs"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how each (lang, source) group differs from others, and in which terms.

    Part `pair`: for each other source of the language (item), the sum over the language's kept terms of (p - q)^2 / (p + q)
    with both groups' smoothed probabilities, rounded down by term; 0 if the language keeps none. Part `term`: the `top` kept
    terms that the group has and uses more than its language does, by the same measure. Ranks start at 1 in each group and
    part, by value descending, then by the item's bytes.

    Null texts, languages and sources count as empty strings, so null and '' are one group; a text without terms still makes
    its group occur. Each row is a document, repeated ones too; ties cannot occur, as items of a group and part differ. A
    language's only source has no pairs. Other columns are not read; an empty table gives an empty result.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = cut(named.select("lang", "source").distinct())
    of_term = Window.partitionBy("lang", "term")  # a row for each source at most
    counted = term_counts(named).select("*", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("in"))
    found = cut(counted.filter(F.col("in") >= least).select("lang", "source", "term", "n", "lang_n"))

    kept = found.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    sizes = cut(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")))
    totals = groups.join(sizes, "lang").join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"])

    crossed = _within(kept, totals, "lang", F.col("term"))
    dense = crossed.join(found.drop("lang_n"), ["lang", "source", "term"], "left").fillna(0, ["n"])
    dense = dense.select(
        "lang", "source", "term", "n",
        _probability(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        _probability(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"),
    )
    dense = cut(dense)

    # The measure is symmetric: each pair is summed once and told to both.
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = dense.drop("q", "n").join(other, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(_difference(F.col("p"), F.col("q"))).alias("value"))
    bare = groups.join(sizes, "lang", "left_anti")
    zeros = _within(bare, bare.withColumnRenamed("source", "item"), "lang", F.col("source")).filter("source < item").withColumn("value", F.lit(0).cast("long"))
    once = sums.unionByName(zeros)
    pairs = once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    terms = dense.filter("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), _difference(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    ranked = pairs.withColumns({"part": F.lit("pair"), "rank": rank}).select(*columns)
    return ranked.unionByName(terms.withColumns({"part": F.lit("term"), "rank": rank}).filter(F.col("rank") <= top).select(*columns))
