"""Line dedup: repeated runs of lines found by a suffix array over line ids, later copies deleted.

Every document is a sequence of line ids; a suffix is a place (document, line). Distributed prefix doubling ranks the
suffixes: at level k two places have the same rank if the 2^k lines from there on are the same, and the rank of level k + 1
is made of the rank of level k here and that 2^k lines further on. Only ranks that several places share go on to the next
level, so the rounds end with the longest repeated run, and what they sort shrinks from the repeated lines down.

Places that share their first n lines are one longest-common-prefix interval of the suffix array. What matters is the
depth at which an interval holds enough words: from each place the fewest lines with that many words, and likewise up to
each place. The rank of any depth n is that of two overlapping runs of 2^k lines, at its start and at its end. A run whose
interval holds an earlier place is a later copy, and the maximal repeated runs of enough words are the unions of these:
every line of such a maximal run lies in a shortest run of enough words that begins or ends within it.

A rank is a pair of 64-bit hashes of what it stands for, and the order of the suffixes is that of the ranks: which of two
different lines sorts first has no bearing on the intervals. Intervals are aggregated to their first place, never
collected, so a line may occur in any share of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import cut

#: Words that a repeated run of lines needs to be deleted.
MIN_WORDS = 50


def pair(*parts: Column) -> list[Column]:
    """Two independent 64-bit hashes of the parts."""
    return [F.xxhash64(*parts).alias("r1"), F.xxhash64(F.lit(77), *parts).alias("r2")]


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (id and a hash of the text), line (from 0), r1, r2 (the line's id), words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = lambda x: F.size(F.filter(F.split(x, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    split = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("line", "t"))
    return split.select("doc", "line", *pair(F.col("t")), words(F.col("t")).alias("words"))


def shared(ranked: DataFrame) -> DataFrame:
    """The places whose rank (r1, r2) other places have too, with `first`, the first place of that rank."""
    place = F.struct("doc", "line")
    intervals = ranked.groupBy("r1", "r2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("r1", "r2", "first")
    return ranked.join(intervals, ["r1", "r2"])


def doubled(level: DataFrame, k: int) -> DataFrame:
    """Of the ranks of 2^(k - 1) lines (doc, line, r1, r2) those of 2^k lines, at the places that other places agree with."""
    on = level.select("doc", (F.col("line") - 2 ** (k - 1)).alias("line"), F.col("r1").alias("s1"), F.col("r2").alias("s2"))
    wider = level.join(on, ["doc", "line"]).select("doc", "line", *pair(F.lit(k), F.col("r1"), F.col("r2"), F.col("s1"), F.col("s2")))
    return cut(shared(wider).select("doc", "line", "r1", "r2"))


def later_of(spans: DataFrame, level: DataFrame, k: int) -> DataFrame:
    """doc, line, last: the spans (doc, line, n) of 2^k to 2^(k + 1) - 1 lines that stand at an earlier place, too."""
    ends = spans.withColumn("end", F.col("line") + F.col("n") - 2**k)
    begin = level.select("doc", "line", F.col("r1").alias("b1"), F.col("r2").alias("b2"))
    end = level.select("doc", F.col("line").alias("end"), F.col("r1").alias("e1"), F.col("r2").alias("e2"))
    ranked = ends.join(begin, ["doc", "line"]).join(end, ["doc", "end"]).select("doc", "line", "n", *pair(F.col("n"), F.col("b1"), F.col("b2"), F.col("e1"), F.col("e2")))
    return shared(ranked).filter(F.col("first") != F.struct("doc", "line")).select("doc", "line", (F.col("line") + F.col("n") - 1).alias("last"))


def shortest_runs(level: DataFrame, min_words: int) -> DataFrame:
    """doc, line, n: from and up to each place the fewest shared lines in a row that have min_words words."""
    by_line = Window.partitionBy("doc").orderBy("line")
    rows = level.withColumn("island", F.col("line") - F.row_number().over(by_line))
    island = Window.partitionBy("doc", "island")
    rows = rows.withColumn("after", F.sum("words").over(island.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("after") - F.col("words"))
    # A line is in the run from here if the lines between have too few words without it; ties are lines without words.
    ahead = island.orderBy("before").rangeBetween(0, min_words - 1)
    back = island.orderBy("after").rangeBetween(1 - min_words, 0)
    rows = rows.withColumn("to", F.max("line").over(ahead)).withColumn("to_words", F.max("after").over(ahead) - F.col("before"))
    rows = rows.withColumn("from", F.min("line").over(back)).withColumn("from_words", F.col("after") - F.min("before").over(back))
    none = F.lit(None).cast("struct<line:int,n:int>")
    ends = F.array(
        F.when(F.col("to_words") >= min_words, F.struct("line", (F.col("to") - F.col("line") + 1).alias("n"))).otherwise(none),
        F.when(F.col("from_words") >= min_words, F.struct(F.col("from").alias("line"), (F.col("line") - F.col("from") + 1).alias("n"))).otherwise(none),
    )
    return rows.select("doc", F.explode(F.array_distinct(F.array_compact(ends))).alias("run")).select("doc", "run.line", "run.n").distinct()


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc, runs: for each document with later copies the (first, last) lines of the runs to delete, which don't meet.

    Spans of different sizes can't be the same, so each level's are resolved, and written, before the next level is made.
    """
    lines = cut(shared(lines_of(docs, id_col, text_col)).select("doc", "line", "words", "r1", "r2").distinct())
    spans = cut(shortest_runs(lines, min_words))
    most = spans.agg(F.max("n")).first()[0] or 0
    level, k = lines.select("doc", "line", "r1", "r2"), 0
    copies = cut(later_of(spans.filter("n = 1"), level, 0))
    while 2 ** (k + 1) <= most:
        k += 1
        level = doubled(level, k)
        copies = copies.unionByName(cut(later_of(spans.filter(F.col("n").between(2**k, 2 ** (k + 1) - 1)), level, k)))
    order = Window.partitionBy("doc").orderBy("line", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("line") <= reach + 1, 0).otherwise(1)
    joined = copies.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order)).groupBy("doc", "island").agg(F.min("line").alias("first"), F.max("last").alias("last"))
    return joined.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs without later copies of repeated line runs, and with deleted_lines and emptied.

    A run of whole lines of one document with min_words words or more goes if the same lines stand, in the same order, at
    an earlier place: in a document of smaller id (then of smaller hash of the text), or higher up in the same one, even
    overlapping. The earliest copy stays. `emptied` tells that no word is left of a document that had some.

    Null texts stay null and empty ones empty; null ids come first. Rows that agree in id and text are one document: each
    gets the same result, and they are no copies of each other. Columns named deleted_lines or emptied are replaced, and
    all others, whatever their names, come back as they were; n_chars, if there, becomes the length of the new text. An empty table stays empty.
    """
    own = [c for c in docs.columns if c not in ("deleted_lines", "emptied")]
    runs = later_copies(docs, id_col, text_col, min_words)
    # The row is one column here, so that no helper can clash with a column of it.
    text, row_id = F.col("row")[text_col], F.col("row")[id_col]
    keyed = docs.select(F.struct(*own).alias("row")).withColumn("h", F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = keyed.join(runs, (F.col("h") == F.col("doc.h")) & row_id.eqNullSafe(F.col("doc.id")), "left")
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.exists("runs", lambda r: (i >= r["first"]) & (i <= r["last"])))
    cut_text = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(kept, "\n"))
    deleted = F.coalesce(F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1), F.lit(0))
    new = joined.select("row", cut_text.alias("new"), deleted.alias("deleted"), F.col("runs").isNotNull().alias("changed"))
    values = {c: F.col("row")[c] for c in own} | {text_col: F.col("new")}
    if "n_chars" in own:
        values["n_chars"] = F.when(F.col("changed"), F.length("new")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    emptied = F.col("changed") & ~F.col("new").rlike(r"[^\x20\x09-\x0D]")
    return new.select(*[v.alias(c) for c, v in values.items()], F.col("deleted").alias("deleted_lines"), emptied.alias("emptied"))
