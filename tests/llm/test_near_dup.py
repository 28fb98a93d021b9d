import random

import numpy as np
from pyspark.sql import functions as F

from veriframe.llm import near_dedup as N


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def naive(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.8):
        got = []
        for _ in range(200):
            n = 200
            k = int(n * 2 * share / (1 + share))
            x = rng.integers(0, 2**63, 2 * n - k, dtype=np.uint64)
            s = N.signatures([x[:n], np.concatenate([x[:k], x[n:]])])
            got.append((s[0] == s[1]).mean())
        true = k / (2 * n - k)
        assert abs(np.mean(got) - true) < 0.01 and np.std(got) < 1.05 * np.sqrt(true * (1 - true) / N.SLOTS)


def test_hashes_are_the_sets():
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "a b c d", "A  b\tc\nd e f", "é É ß İ"] + [" ".join(rng.choices("abcd", k=rng.randint(1, 90))) for _ in range(60)] + ["long " * 50_000]
    sets, hashed = [shingles(t) for t in texts], [N.shingle_hashes(t) for t in texts]
    assert [len(s) for s in sets] == [len(h) for h in hashed]
    for i in range(len(texts)):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(np.intersect1d(hashed[i], hashed[j]))


def edited(words, rng, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.random()}"
    return " ".join(w)


def test_groups_against_brute_force(spark, docs):
    rng = random.Random(2)
    rows = [(100, None), (101, ""), (102, "few words"), (103, "few  WORDS"), (104, " ")]
    base = [f"b{i}" for i in range(300)]
    rows += [(200 + i, edited(base, rng, rng.choice((1, 3, 5, 8)))) for i in range(80)]  # a large group of unlike copies
    for g in range(15):
        words = [f"g{g}w{i}" for i in range(rng.randint(6, 200))]
        rows += [(1000 + 10 * g + i, edited(words, rng, rng.choice((0, 0, 1, 2, 4)))) for i in range(6)]
    rng.shuffle(rows)
    table = docs(rows).withColumn("key", F.lit("clash")).withColumn("digest", F.lit("clash"))
    for percent in (80, 85):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.group(table, percent).collect()}
        assert got == naive(rows, percent)
    kept = {r["doc_id"] for r in N.representatives(table, 80).collect()}
    assert kept == {i for i, (_, c) in naive(rows, 80).items() if i == c}
    assert N.group(docs([])).count() == 0 and N.representatives(docs([])).count() == 0


def test_repeated_rows_and_null_ids(spark, docs):
    text = " ".join(f"w{i}" for i in range(40))
    got = sorted((repr(r["doc_id"]), repr(r["component_id"]), r["kept"]) for r in N.group(docs([(None, text), (5, text), (5, text), (3, text + " more"), (9, "other text here")])).collect())
    assert got == [("3", "3", True), ("5", "3", False), ("5", "3", False), ("9", "9", True), ("None", "None", True)]


def test_one_id_with_several_texts(spark, docs):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "other"])
    text = " ".join(base)
    rows = [(5, text), (1, text), (7, near), (1, "a lesser text that is quite another"), (8, "quite alone here as well it seems"), (9, "A lesser TEXT that is quite another"), (9, text.upper()), (9, text)]
    got = {r["doc_id"]: r["component_id"] for r in N.group(docs(rows).withColumn("gone", F.lit(1))).collect()}
    assert got == {5: 1, 1: 1, 7: 1, 8: 8, 9: 1}
    alone = [(5, text), (7, near), (3, "an id of several texts"), (3, "that are linked with nothing else")]
    assert {r["doc_id"]: r["component_id"] for r in N.group(docs(alone)).collect()} == {5: 5, 7: 5, 3: 3}
    kept = N.representatives(docs(rows).withColumn("gone", F.lit(1)).withColumn("row", F.lit("clash")))
    assert sorted((r["doc_id"], r["row"]) for r in kept.collect()) == [(1, "clash"), (1, "clash"), (8, "clash")]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = list(range(200))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert got == {n: top(n) for a, b in links if a != b for n in (a, b)}
