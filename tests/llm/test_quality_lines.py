import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from veriframe.llm import line_dedup as L
from veriframe.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    five = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = set()
    for i in range(len(w) - 4):
        if five[tuple(w[i : i + 5])] > 1:
            marked.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)


def test_counts_on_hard_texts(spark, docs):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "a b c d", "a b c d e", "a b c d e f a b c d e", "x " * 30, "a\xa0b c\u2003d\x1ce f", "##|| <a> \n##|| <a> ", "😀 é" * 7, "w\r\nw\r\nw"]
    texts += [" ".join(rng.choices("abc", k=rng.randint(1, 60))) for _ in range(40)] + [" ".join(rng.choices(["p", "q"], k=30_000))]
    table = docs([(i if i else None, t, "en" if i % 2 else None, "s") for i, t in enumerate(texts)]).withColumn("group", F.lit("clash"))
    got = {r["doc_id"]: r for r in Q.judge(table).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i or None], counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert Q.judge(table.limit(0)).count() == 0


def test_outliers_against_numpy(spark):
    rng = np.random.default_rng(0)
    names = list(Q.FLOORS)
    x = rng.normal(0, 1, (400, len(names)))
    x[:60] += 9
    df = spark.createDataFrame([("g", *map(float, r), i) for i, r in enumerate(x)], ", ".join(["group string", *(f"{n} double" for n in names), "i int"]))
    d = np.array([r["d2"] for r in Q.distances(df).orderBy("i").collect()])
    floors = np.diag([Q.FLOORS[n] ** 2 for n in names])
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    dist = (((x - q[1]) / np.maximum((q[2] - q[0]) / 1.349, [Q.FLOORS[n] for n in names])) ** 2).sum(axis=1)
    for _ in range(Q.STEPS):
        s = x[dist <= np.quantile(dist, Q.SUPPORT, method="inverted_cdf")]
        m, inv = s.mean(axis=0), np.linalg.inv(np.cov(s.T, bias=True) + floors)
        dist = np.einsum("ij,jk,ik->i", x - m, inv, x - m)
    dist /= max(1, np.quantile(dist, 0.5, method="inverted_cdf") / Q.CHI2_MEDIAN)
    assert np.allclose(d, dist, rtol=1e-3)
    assert (d[:60] > Q.CUTOFF).all() and (d[60:] > Q.CUTOFF).mean() < 0.02


def test_junk_goes_and_clean_stays(spark, docs):
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(400)]
    clean = [" ".join(rng.choices(words, k=rng.randint(15, 300))) for _ in range(150)]
    junk = [" ".join(w + "###" for w in rng.choices(words, k=100)), " ".join(rng.choices(words, k=100)).upper(), " | ".join(rng.choices(words, k=100)), " ".join(w for x in rng.choices(words, k=20) for w in [x] * 4)]
    got = {r["doc_id"]: r["kept"] for r in Q.judge(docs([(i, t, "en", "s") for i, t in enumerate(clean + junk)])).collect()}
    assert not any(got[i] for i in range(150, 154)) and sum(got[i] for i in range(150)) >= 149


def naive_dedup(rows, least):
    """Longest previous match from every place, by comparing all pairs of places."""
    distinct = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    place = [(d, k) for d, (_, t) in enumerate(distinct) for k in range(len(t.split("\n")))]
    lines = [t.split("\n") for _, t in distinct]
    gone = collections.defaultdict(set)
    for n, (d, k) in enumerate(place):
        for e, j in place[:n]:
            m = 0
            while k + m < len(lines[d]) and j + m < len(lines[e]) and lines[d][k + m] == lines[e][j + m]:
                m += 1
            if sum(len(WORD.findall(x)) for x in lines[d][k : k + m]) >= least:
                gone[d].update(range(k, k + m))
    return {key: "\n".join(x for k, x in enumerate(lines[d]) if k not in gone[d]) if gone[d] else key[1] for d, key in enumerate(distinct)}


def test_lines_against_brute_force(spark, docs):
    rng = random.Random(11)
    for least in (3, 6):
        pool = ["", " ", "a", "b c", "d e f", "g", "h i j k"]
        rows = [(i if i else None, "\n".join(rng.choices(pool, k=rng.randint(1, 14)))) for i in range(14)] + [(20, None), (21, "")]
        rows += rows[2:5]
        table = docs(rows).withColumn("line", F.lit("clash")).withColumn("runs", F.lit(1)).withColumn("emptied", F.lit(7))
        for name in ("_runs", "_key", "_h", "_id", "_cut", "row", "h", "doc", "new", "deleted", "changed"):
            table = table.withColumn(name, F.lit("clash"))
        want = naive_dedup(rows, least)
        got = L.dedup(table, min_words=least).collect()
        assert len(got) == len(rows)
        for r in got:
            same = [w for (i, t), w in want.items() if i == r["doc_id"]]
            assert (r["text"] or "") in same and (r["text"] is not None) == (r["doc_id"] != 20)
            assert r["n_chars"] is None or r["n_chars"] == len(r["text"])
            assert r["_runs"] == r["_key"] == r["row"] == r["h"] == r["doc"] == r["new"] == "clash" and r["runs"] == 1
    assert L.dedup(docs([])).count() == 0


def test_long_run_and_passage(spark, docs):
    run = "\n".join(f"line {i} of a long story that goes on" for i in range(300))
    passage = " ".join(f"w{i}" for i in range(60))
    got = {r["doc_id"]: r for r in L.dedup(docs([(1, run), (2, "new\n" + run + "\nend"), (3, run), (4, passage + "\nx"), (5, "y\n" + passage), (6, "short\nlines"), (7, "short\nlines")])).collect()}
    assert got[1]["text"] == run and got[2]["text"] == "new\nend" and got[3]["emptied"] and got[3]["text"] == ""
    assert got[4]["deleted_lines"] == 0 and got[5]["text"] == "y" and got[7]["text"] == "short\nlines"
