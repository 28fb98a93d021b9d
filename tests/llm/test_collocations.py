import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from veriframe.llm import collocations as C


def brute_force(rows, max_n=4, least=30, percent=80, top=2000):
    """Rows of the result from (text, lang), with every longer phrase looked through for every shorter one."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, max_n + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    return sorted(tuple(r) for r in C.mine(df, **kw).collect())


def test_small_cases(spark):
    rows = [
        ("New York is big. new york, NEW\tYORK! is new  york", "en"), ("new york is big;is big:is big\nnew\ryork", "en"), (None, "en"), ("", None), ("a a a a a a", None),
        ("a a a a", "und"), ("é É \x00b \x00b", "fr"), ("é É \x00b \x00b", "fr"), ("x.y", "fr"), ("the same words come again " * 400, "xx"),
    ]
    for least, top in ((2, 2000), (3, 2)):
        for block in (1, 1 << 20):
            assert found(spark, rows, least=least, top=top, block_bytes=block) == brute_force(rows, least=least, top=top)


def test_dropped_phrases_drop_others(spark):
    """A phrase goes by a longer one that goes by a longer one still."""
    rows = [("a b c d", "l")] * 8 + [("a b c", "l"), ("a b", "l"), ("b c d", "l")]
    got = found(spark, rows, least=5)
    assert got == brute_force(rows, least=5) and [r[2] for r in got] == ["a b c d"]


def test_empty_and_extra_columns(spark):
    assert C.mine(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    df = spark.createDataFrame([(1, "a b", "l", 1, 2, "x", 4), (None, "a b", "l", 1, 2, "x", 4), (None, "a b", "l", 1, 2, "x", 4)], "doc_id long, text string, lang string, n int, a int, phrase string, block int")
    assert [tuple(r) for r in C.mine(df, least=3).collect()] == [("l", 1, "a b", 3, 3, 3, 6, 1_000_000)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abA .\té", max_size=40), st.sampled_from(["x", None])), max_size=15), st.integers(1, 4), st.sampled_from([2, 3, 4]))
def test_brute_force(spark, rows, least, max_n):
    assert found(spark, rows, least=least, max_n=max_n) == brute_force(rows, least=least, max_n=max_n)
