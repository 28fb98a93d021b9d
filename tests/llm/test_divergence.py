import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from veriframe.llm import divergence as D


def brute_force(rows, least=10, top=10):
    """(lang, source, part, item, value, rank) from (text, lang, source), in plain Python with unbounded integers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        counts.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        v = len(kept)

        def chances(of, kept=kept, v=v):
            total = sum(of(t) for t in kept)
            return {t: 1 + 10**9 * (of(t) + 2) // (total + 2 * v) for t in kept}

        q = chances(lambda t, lang=lang, sources=sources: sum(counts[lang, s, t] for s in sources))
        p = {s: chances(lambda t, lang=lang, s=s: counts[lang, s, t]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for i, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode("utf-8", "surrogatepass")))[:most]):
                    out.add((lang, s, part, item, value, i + 1))
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = [tuple(r) for r in D.audit(df, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_small_cases(spark):
    rows = [
        ("A a b", "x", "s1"), ("a-b é É", "x", "s2"), ("a", "x", "s2"), (None, "x", "s3"), ("", None, None), ("zz", None, ""), ("zz", "", "t"),
        ("only", "y", "alone"), ("q" * 3000 + " a" * 4000, "x", "s1"), ("A\x00b\x7fb[c", "x", "s1"), ("A\x00b\x7fb[c", "x", "s1"),
    ]
    for least in (1, 2, 5):
        assert found(spark, rows, least=least, top=2) == brute_force(rows, least, 2)
    # Nothing is kept, yet each pair of sources is told, with 0.
    assert {r[3:] for r in found(spark, rows, least=10) if r[0] == "x"} == {("s1", 0, 1), ("s2", 0, 1), ("s2", 0, 2), ("s3", 0, 2)}


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert D.audit(empty).collect() == []
    rows = [("a b", "x", "s", 1, 2, 3), ("a", "x", "t", 1, 2, 3)]
    df = spark.createDataFrame(rows, "text string, lang string, source string, term int, n int, rank int")
    got = {tuple(r) for r in D.audit(df, least=1).collect()}
    assert got == brute_force([r[:3] for r in rows], 1)


def test_large_counts_stay_exact(spark):
    """The product passes 64 bits: 10^9 times 10^10."""
    from pyspark.sql import functions as F

    row = spark.range(1).select(D._probability(F.lit(10**10), F.lit(10**11), F.lit(7)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**10 + 2) // (10**11 + 14)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.text("abAB é.\x00[1\n", max_size=30)), st.sampled_from(["x", "y", None]), st.sampled_from(["s", "t", "u", None])), max_size=25), st.integers(1, 3))
def test_brute_force(spark, rows, least):
    assert found(spark, rows, least=least, top=3) == brute_force(rows, least, 3)


@pytest.mark.parametrize("shares", [1])
def test_within_pairs_all_rows_of_a_key(spark, shares):
    from pyspark.sql import functions as F

    a = spark.createDataFrame([("k", i) for i in range(20)] + [("l", 99)], "k string, i int")
    b = spark.createDataFrame([("k", "p"), ("k", "q"), ("m", "r")], "k string, s string")
    got = sorted((r["i"], r["s"]) for r in D._within(a, b, "k", F.col("i")).collect())
    assert got == sorted((i, s) for i in range(20) for s in "pq")
