"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant.

Counts of each whole text become a vector of transformed statistics. For each language and source the centre and
covariance of the most concentrated three quarters of the documents are found by concentration steps from a robust start
(medians and quartiles); a document goes if its Mahalanobis distance from that centre is beyond the cut-off. Estimates
are mergeable aggregates and quantile sketches over all rows, so a group may hold any share of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import cut

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"

#: The statistics of the vector and the least spread that each is taken to have, in units of the transformed statistic.
FLOORS = {"word_length": 0.06, "symbols": 0.12, "dup_lines": 0.12, "repeats": 0.12, "upper": 0.12, "stutter": 0.12}
#: Share of a group's rows that the estimate rests on, concentration steps, and the squared distance beyond which a
#: document goes: the 0.999 quantile of the chi-square distribution with six degrees of freedom. The floors make it rarer
#: for clean text than that.
SUPPORT, STEPS, CUTOFF = 0.75, 3, 22.46
#: Median of the chi-square distribution with as many degrees of freedom as there are statistics.
CHI2_MEDIAN = 5.348
#: Groups up to which the table of estimates is broadcast; beyond, it is joined by a shuffle.
BROADCAST_GROUPS = 20_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def repeated_words(hashes: Column) -> Column:
    """How many words lie in windows of five that occur twice or more, from the words' hashes."""

    def count(h):
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))

    def covered(w):
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(o):
            twin = F.transform(o, lambda e, j: F.when(F.coalesce(e["x"] == F.get(o, j - 1)["x"], F.lit(False)) | F.coalesce(e["x"] == F.get(o, j + 1)["x"], F.lit(False)), e["i"]))
            return F.array_sort(F.array_compact(twin))

        steps = lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))).cast("long")),
            F.lit(0).cast("long"),
            lambda a, b: a + b,
        )
        return let(let(ordered, places), steps)

    return F.when(F.size(hashes) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, count))


def statistics(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, lang, source, the five counts of the contract, and n_upper, n_stutter, of whole texts (null: empty)."""
    lines = F.filter(F.split("t", "\n", -1), lambda x: without(x, SPACES) != "")
    return (
        docs.select(F.col(id_col), "lang", "source", F.coalesce("text", F.lit("")).alias("t"))
        .withColumn("h", F.transform(words_of(F.col("t")), lambda w: F.xxhash64(w)))
        .select(
            id_col,
            "lang",
            "source",
            F.size("h").cast("long").alias("n_words"),
            F.length(without(F.col("t"), SPACES)).cast("long").alias("word_chars"),
            (F.length("t") - F.length(without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("h")).alias("n_repeat_words"),
            (F.length("t") - F.length(without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_upper"),
            F.size(F.filter(F.zip_with("h", F.slice(F.col("h"), F.lit(2), F.greatest(F.size("h") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)).cast("long").alias("n_stutter"),
        )
    )


def vector() -> dict[str, Column]:
    """Statistics on scales where clean text is about normal; short texts are drawn towards the usual, as they vary more."""
    n = F.col("n_words")
    return {
        "word_length": F.log((F.col("word_chars") + 100.0) / (n + 20.0)),
        "symbols": F.sqrt(F.col("n_symbols") / (n + 10.0)),
        "dup_lines": F.log1p(F.col("n_dup_lines").cast("double")) / 4.0,
        "repeats": F.sqrt(F.greatest(F.col("n_repeat_words") - 8.0, F.lit(0.0)) / (n + 20.0)),
        "upper": F.sqrt(F.col("n_upper") / (F.col("word_chars") + 40.0)),
        "stutter": F.sqrt(F.greatest(F.col("n_stutter") - 1.0, F.lit(0.0)) / (n + 10.0)),
    }


def _join_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    groups = cut(groups)
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, "group")


def _with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """d2: the squared Mahalanobis distance, by forward substitution through the Cholesky factor."""
    names = list(FLOORS)
    joined = _join_groups(rows, estimates)
    for i, x in enumerate(names):
        rest = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}_{j}") * F.col(f"y{j}")
        joined = joined.withColumn(f"y{i}", rest / F.col(f"l{i}_{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(names))), F.col("y0") * F.col("y0"))
    return joined.select(*rows.columns, d2.alias("d2"))


def _estimates(subset: DataFrame) -> DataFrame:
    """Per group the mean and the Cholesky factor of the covariance, with the least spreads added to its diagonal."""
    names = list(FLOORS)
    d = range(len(names))
    out = subset.groupBy("group").agg(
        *[F.avg(names[i]).alias(f"m{i}") for i in d],
        *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i in d for j in range(i + 1)],
    )
    for i in d:
        for j in range(i + 1):
            left = F.col(f"c{i}_{j}") + (FLOORS[names[i]] ** 2 if i == j else 0.0)
            for k in range(j):
                left = left - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"l{j}_{j}"))
    return out.select("group", *[f"m{i}" for i in d], *[f"l{i}_{j}" for i in d for j in range(i + 1)])


def _most_concentrated(rows: DataFrame) -> DataFrame:
    limits = rows.groupBy("group").agg(F.percentile_approx("d2", SUPPORT, 10_000).alias("limit"))
    return _join_groups(rows, limits).filter("d2 <= limit").drop("limit")


def distances(vectors: DataFrame) -> DataFrame:
    """vectors (group, the statistics of FLOORS, any other columns) with d2, the distance from the group's MCD centre."""
    names = list(FLOORS)
    quartiles = vectors.groupBy("group").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"q_{x}") for x in names])
    start = _join_groups(vectors, quartiles)
    far = F.lit(0.0)
    for x in names:
        spread = F.greatest((F.col(f"q_{x}")[2] - F.col(f"q_{x}")[0]) / 1.349, F.lit(FLOORS[x]))
        far = far + F.pow((F.col(x) - F.col(f"q_{x}")[1]) / spread, F.lit(2.0))
    rows = start.select(*vectors.columns, far.alias("d2"))
    for _ in range(STEPS):
        rows = _with_distance(vectors, _estimates(_most_concentrated(rows)))
    # The subset is narrower than the whole: widened until the median distance is that of a normal distribution.
    widths = rows.groupBy("group").agg(F.greatest(F.lit(1.0), F.percentile_approx("d2", 0.5, 10_000) / CHI2_MEDIAN).alias("width"))
    return _join_groups(rows, widths).select(*vectors.columns, (F.col("d2") / F.col("width")).alias("d2"))


def judge(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    base_failed: fewer than ten words, or over a fifth of the words in repeated windows of five. Such documents take no
    part in the estimates and have no distance. Null and empty texts have no words, so they fail. Null languages and
    sources are groups of their own; a group of one document is its own centre. Repeated rows are judged alike, each
    counting in the estimates. Other columns of docs are not read; an empty table gives an empty result.
    """
    counted = statistics(docs, id_col).withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    group = F.concat_ws("\x01", F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00")))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = cut(counted.select(F.col(id_col), group.alias("group"), *own, *[c.alias(k) for k, c in vector().items()]))
    measured = distances(rows.filter("not base_failed"))
    failed = rows.filter("base_failed").withColumn("d2", F.lit(None).cast("double"))
    kept = F.coalesce(F.col("d2") <= CUTOFF, F.lit(False))
    return measured.unionByName(failed).select(id_col, *own, kept.alias("kept"), F.col("d2").alias("distance"))
